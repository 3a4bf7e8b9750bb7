"""Ordinal risk and confidence as columns, and aggregates that keep the first of equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def risk_rank(risk: Column, unknown: int = 3) -> Column:
    """high 0, medium 1, low 2, anything else `unknown`. Callers differ in that default."""
    return F.when(risk == "high", 0).when(risk == "medium", 1).when(risk == "low", 2).otherwise(unknown)


def risk_weight(risk: Column) -> Column:
    """high 3, medium 2, low 1, anything else 0."""
    return F.when(risk == "high", 3).when(risk == "medium", 2).when(risk == "low", 1).otherwise(0)


def risk_name(rank: Column) -> Column:
    return F.when(rank == 0, "high").when(rank == 1, "medium").otherwise("low")


def min_confidence(a: Column, b: Column) -> Column:
    """The weaker of two confidences."""
    order = lambda c: F.when(c == "low", 0).when(c == "medium", 1).otherwise(2)
    return F.when(order(a) <= order(b), a).otherwise(b)


def first_best(value: Column, rank: Column, seq: Column) -> Column:
    """value of the row of least rank, and of the least seq among equals."""
    return F.min_by(value, F.struct(rank, seq))


def first_of(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row for each value of keys: the one of least `order` where df has it, then of the least other columns.

    Equal rows are interchangeable, so the result does not hang on the order of
    input. Columns must be orderable.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    by = [F.col(f"`{c}`") for c in ([order] if order in df.columns else []) + rest] or [F.lit(0)]
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_nth = 1").drop("_nth")

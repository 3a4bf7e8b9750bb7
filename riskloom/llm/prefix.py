"""Global prefix sums with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.scratch import materialise


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own that no recomputation changes.

    Repeated rows get different numbers, so they can be ranked and joined back.
    """
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def global_prefix(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Add, for each {new: value}, the sum of value over all rows before this one.

    order must be a total order. Range partitions are written with their number,
    their totals give offsets (one row per partition, so one small window), and
    a window inside each partition adds the rest. No task sees more than its own
    partition, whatever key is frequent. An empty table gives an empty table.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    ranged = df.withColumns(keys)
    cut = materialise(ranged.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_part").agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(F.broadcast(offsets), "_part")  # at most n rows
    out = joined.withColumns({k: F.col(f"_o_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()})
    return out.drop("_part", *keys, *(f"_o_{k}" for k in sums))

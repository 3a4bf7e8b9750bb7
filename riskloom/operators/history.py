"""Aggregates over stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ranks import risk_name, risk_rank


def report_items(reports: DataFrame) -> DataFrame:
    """One row per finding of reports (timestamp, items): timestamp, file, line, risk, seq."""
    at = reports.select("timestamp", F.posexplode("items").alias("seq", "item"))
    return at.select("timestamp", F.col("item.file").alias("file"), F.col("item.line").alias("line"), F.coalesce("item.risk", F.lit("low")).alias("risk"), "seq")


def hotspots(items: DataFrame, top: int = 10, seq: str = "seq") -> DataFrame:
    """file, n_flagged, max_risk, last_seen of the files flagged most; equal counts by first seen.

    items has file, risk, timestamp and an order. Empty files are left out, and
    an unknown risk counts as low.
    """
    named = items.filter("file is not null and cast(file as string) <> ''")
    grouped = named.groupBy("file").agg(
        F.count("*").alias("n_flagged"),
        risk_name(F.min(risk_rank(F.col("risk"), 2))).alias("max_risk"),
        F.max("timestamp").alias("last_seen"),
        F.min(seq).alias("_first"),
    )
    return grouped.orderBy(F.desc("n_flagged"), "_first").limit(top).drop("_first")


def file_history(items: DataFrame, files: DataFrame, recent: int = 3, newest_first: tuple = ()) -> DataFrame:
    """file, flagged_count, nth, timestamp, risk, line: the latest findings of wanted files, one row each."""
    order = newest_first or (F.desc("timestamp"), F.col("seq"))
    wanted = items.join(files.select("file").distinct(), "file", "left_semi")
    nth = F.row_number().over(Window.partitionBy("file").orderBy(*order))
    few = wanted.withColumn("nth", nth).filter(F.col("nth") <= recent).withColumn("nth", F.col("nth").cast("long"))  # tasks send `recent` rows of a file
    return few.join(wanted.groupBy("file").agg(F.count("*").alias("flagged_count")), "file")


def risk_trend(reports: DataFrame) -> DataFrame:
    """risk, counts: one array per risk, from the oldest report to the newest; null counts are 0."""
    long = reports.unpivot("timestamp", ["high", "medium", "low"], "risk", "n")
    ordered = F.sort_array(F.collect_list(F.struct("timestamp", F.coalesce("n", F.lit(0)).alias("n"))))
    return long.groupBy("risk").agg(F.transform(ordered, lambda x: x.n).alias("counts"))


def reports_with_file(reports: DataFrame, part: str) -> DataFrame:
    """Reports in which a finding's file contains part."""
    return reports.filter(F.exists("items", lambda i: F.contains(i.file, F.lit(part))))

"""Joins and merges of line intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.store import dealt


def overlapping(left: DataFrame, right: DataFrame, on: list[str], before: int = 3, after: int = 150, width: int = 256) -> DataFrame:
    """Rows of left (s, e) that come within reach of a point p of right with equal keys.

    s <= p + after and e >= p - before. Both sides are dealt to cells of `width`
    lines, so that a key with many rows joins cell by cell, not all with all.
    """
    cell = lambda c: F.floor(c / width)
    marked = left.withColumn("_row", F.struct(*left.columns))
    cells = marked.withColumn("_cell", F.explode(F.sequence(cell(F.col("s") - after), cell(F.col("e") + before))))
    points = right.select(*on, "p").distinct().withColumn("_cell", cell(F.col("p")))
    met = cells.join(points, [*on, "_cell"]).filter((F.col("s") <= F.col("p") + after) & (F.col("e") >= F.col("p") - before))
    return met.select("_row").distinct().select("_row.*")


def merge_intervals(df: DataFrame, by: list[str], gap: int = 5, start: str = "s", end: str = "e", most: int | None = None) -> DataFrame:
    """by, island, s, e, n: intervals of a group merged where the gap is at most `gap`.

    With most, an island ends after that many lines.
    """
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col(start) - reach > gap) | reach.isNull()
    numbered = df.withColumn("island", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*by, "island").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.count("*").alias("n"))
    return out if most is None else out.withColumn("e", F.least("e", F.col("s") + most - 1))


def nearest_before(points: DataFrame, marks: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """Points with the values of the latest mark at or before them, by key: a backward as-of join.

    Marks come before points of the same place. Both sides are sorted together
    and values filled forward, so the cost is one sort.
    """
    mark = F.struct(*(F.col(v) for v in values))
    left = points.withColumns({"_m": F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType), "_k": F.lit(1)})
    right = marks.select(*by, at, mark.alias("_m"), F.lit(0).alias("_k"))
    both = left.unionByName(right, allowMissingColumns=True)
    fill = F.last("_m", True).over(Window.partitionBy(*by).orderBy(at, "_k"))
    filled = both.withColumn("_f", fill).filter("_k = 1")
    return filled.select(*points.columns, *(F.col(f"_f.{v}").alias(v) for v in values))


def innermost(points: DataFrame, spans: DataFrame, by: list[str], width: int = 64) -> DataFrame:
    """Points (p) with the span (s, e and more) that encloses them and begins last; none leave them out.

    Spans are dealt to cells of `width` lines.
    """
    cell = lambda c: F.floor(c / width)
    dealt = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("s")), cell(F.col("e")))))
    met = points.withColumn("_cell", cell(F.col("p"))).join(dealt, [*by, "_cell"]).filter("s <= p and p <= e").drop("_cell")
    best = Window.partitionBy(*points.columns).orderBy(F.desc("s"), "e")
    return met.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def symbol_end(lines: DataFrame, symbols: DataFrame, by: str = "file", most: int = 300, fallback: int = 80) -> DataFrame:
    """Symbols (file, start_line) with end_line: where braces opened from there are closed again.

    Lines are file, line, text. Within `most` lines the first at which as many
    braces are closed as opened ends it; without braces the last line before one
    that is indented no deeper does; else it is start_line + fallback.
    """
    cell = lambda c: F.floor(c / most)
    cells = symbols.withColumn("_cell", F.explode(F.sequence(cell(F.col("start_line")), cell(F.col("start_line") + most - 1)))).hint("merge")
    near = cells.join(lines.withColumn("_cell", cell(F.col("line"))), [by, "_cell"]).drop("_cell")
    near = near.filter((F.col("line") >= F.col("start_line")) & (F.col("line") < F.col("start_line") + most))
    near = dealt(near, by)
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c)))
    key = Window.partitionBy(*symbols.columns).orderBy("line")
    run = key.rowsBetween(Window.unboundedPreceding, 0)
    depth, opened = F.sum(count("{") - count("}")).over(run), F.sum(count("{")).over(run)
    indent = F.length("text") - F.length(F.ltrim("text"))
    marked = near.withColumns({"depth": depth, "opened": opened, "indent": indent, "base": F.first(indent).over(run)})
    closed = F.min(F.when((F.col("opened") > 0) & (F.col("depth") <= 0), F.col("line")))
    dedent = F.min(F.when((F.col("line") > F.col("start_line")) & (F.trim("text") != "") & (F.col("indent") <= F.col("base")), F.col("line") - 1))
    ends = marked.groupBy(*symbols.columns).agg(closed.alias("c"), dedent.alias("d"), F.max("opened").alias("o"))
    end = F.when(F.col("o") > 0, F.col("c")).otherwise(F.col("d"))
    return ends.select(*symbols.columns, F.coalesce(end, F.col("start_line") + fallback).alias("end_line"))


def snippet(lines: Column, at: Column, around: int = 5, most: int = 12) -> Column:
    """Lines of an array around a line number, cut after `most`."""
    start = F.greatest(at - around, F.lit(1))
    n = F.least(at + around, F.size(lines)) - start + 1
    text = F.array_join(F.slice(lines, start, F.least(n, F.lit(most))), "\n")
    return F.when(n > most, F.concat(text, F.lit("\n… (truncated)"))).otherwise(text)


def relevant_snippets(symbols: DataFrame, lines: DataFrame, around: int = 3, gap: int = 5, most: int = 150) -> DataFrame:
    """file, s, e, text around symbols (file, start_line, end_line): ranges with a margin, merged if near, cut at `most` lines."""
    ranges = symbols.select("file", F.greatest(F.col("start_line") - around, F.lit(1)).alias("s"), (F.col("end_line") + around).alias("e"))
    islands = merge_intervals(ranges, ["file"], gap, most=most).select("file", "s", "e")
    # ranges of a file do not meet, so the last to begin is the only one that a line can lie in: one sort by file, no join
    none = F.lit(None)
    marks = islands.select("file", F.col("s").cast("long").alias("line"), F.lit(0).alias("_k"), none.cast("string").alias("text"), F.struct("s", "e").alias("_i"))
    rows = lines.select("file", F.col("line").cast("long").alias("line"), F.lit(1).alias("_k"), "text", none.cast(marks.schema["_i"].dataType).alias("_i"))
    last = F.last("_i", True).over(Window.partitionBy("file").orderBy("line", "_k").rowsBetween(Window.unboundedPreceding, 0))
    inside = dealt(rows.unionByName(marks), "file").withColumn("_i", last).filter("_k = 1 and line <= _i.e").select("file", "line", "text", "_i.*")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x.text), "\n")
    return inside.groupBy("file", "s", "e").agg(text.alias("text"))

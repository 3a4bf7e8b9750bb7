"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.prefix import global_prefix, with_row_id
from riskloom.llm.scratch import fresh, materialise


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """One row per source: source, source_size, n_docs, first rank, target.

    Sources are ordered by code point, null last; weights repeat along that
    order. A target is a share of the whole size by weight, at most `most`
    times the source's size. What is over goes to the others by weight: with
    sources in order of cap / weight, the level is the largest of
    (whole - caps before) / (weights from here on). Sources may be many; both
    prefix sums are global ones. An empty source (size 0) has target 0.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = per.withColumn("_one", F.lit(1).cast("long"))
    ranked = global_prefix(per, [F.col("source").isNull(), F.col("source")], {"_first": "n_docs", "_nth": "_one"})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_nth") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    capped = materialise(capped, "sources")
    levels = global_prefix(capped, [F.col("_cap") / F.col("_w"), F.col("_nth")], {"_caps": "_cap", "_ws": "_w"})
    whole = capped.agg(F.sum("source_size").alias("_whole"), F.sum("_w").alias("_all_w"))
    level = levels.join(F.broadcast(whole)).agg(F.max((F.col("_whole") - F.col("_caps")) / (F.col("_all_w") - F.col("_ws"))).alias("_level"))  # one row each
    target = F.least(F.col("_cap"), F.col("_level") * F.col("_w"))
    return capped.join(F.broadcast(level)).select("source", "source_size", "n_docs", "_first", target.alias("target"))


def sample_copies(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """Add source_size, target and copies to rows (_uid, doc_id, source, size).

    Within its source a document is expected target / source_size times. Those
    expectations are prefix-summed in order of size, so that neighbours are
    alike, and one random offset per source is added; a copy is made for each
    integer crossed. Counts differ from the expectation by less than one, hence
    never more than `most`. The offset is a hash of seed and source, so reruns
    agree. Null sources form a source; empty documents may be taken, at size 0.
    """
    targets = materialise(source_targets(sized, weights, most), "targets")
    order = [F.col("source").isNull(), F.col("source"), -F.col("size"), F.col("doc_id"), F.col("_uid")]
    ranked = global_prefix(sized.withColumn("_one", F.lit(1).cast("long")), order, {"_rank": "_one"}).drop("_one")
    joined = ranked.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    digest = F.md5(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))))
    offset = F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / float(1 << 28)
    before = F.floor(rate * (F.col("_rank") - F.col("_first")) + offset)
    after = F.floor(rate * (F.col("_rank") - F.col("_first") + 1) + offset)
    return joined.withColumn("copies", F.least(F.lit(most).cast("long"), after - before)).drop("_rank", "_first", "n_docs")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """The mixed corpus: each row of docs as often as sample_copies() says.

    Columns are those of docs. Empty tables give empty tables.
    """
    uid, copies = fresh(docs, "_uid"), fresh(docs, "_copies")
    rows = with_row_id(docs, uid)
    lean = rows.select(F.col(uid).alias("_uid"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = sample_copies(lean, weights, most, seed).filter("copies > 0")
    every = F.sequence(F.lit(1).cast("long"), F.col("copies")).alias(copies)
    return rows.join(taken.select(F.col("_uid").alias(uid), every), uid).withColumn(copies, F.explode(copies)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = with_row_id(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "_uid")
    out = sample_copies(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (3 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps, coalesce(sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM w),
v AS (SELECT max(((SELECT sum(source_size) FROM s)::DOUBLE - caps) / ((SELECT sum(w) FROM w) - ws)) AS level FROM l),
t AS (SELECT source, source_size, least(cap, level * w) AS target FROM w CROSS JOIN v),
r AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id) - 1 AS rank,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, CAST('0x' || substr(md5('17:' || coalesce('=' || d.source, '')), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS o FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(3, CAST(floor(rate * (rank + 1) + o) - floor(rate * rank + o) AS BIGINT)) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""

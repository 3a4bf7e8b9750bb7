"""Stored relations: incremental maintenance by content, versioned folders, source trees and reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The version of the stored graph; folders that scans of scripts and of back-end code leave out.
VERSION = 2
SKIP = ("node_modules", ".git", "dist", "build", "__pycache__", ".cache", ".riskloom")
BACKEND_SKIP = ("bin", "obj", ".git", ".vs", "node_modules", "dist", "build", "__pycache__", ".riskloom")

REPORT = (
    "timestamp string, commit string, verdict string, high long, medium long, low long, elapsed double, "
    "items array<struct<file: string, line: long, risk: string, symbol: string, reason: string>>, "
    "fix_candidates array<struct<id: long, mode: string, title: string, reason: string, command_hint: string, impact: string, file: string, line: long, evidence: string, suggestion: string>>"
)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, which all executors share, and read back.

    Only where the setting is missing, as in tests on one machine, a temporary
    folder is set; on a cluster that is an error.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "hop")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many parts as shuffles have, by these columns.

    The number is given, so parts are not joined by their bytes: rows that are
    alike shrink in a shuffle, and few tasks would hold them all.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the folder of spark.checkpoint.dir; it goes when the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/riskloom-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    fs, hadoop = _filesystem(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def source_tree(spark: SparkSession, root: str, extensions: Sequence[str], skip: Sequence[str] = SKIP) -> DataFrame:
    """path (relative), content of files with these extensions, outside skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.split("://")[-1].rstrip("/") + "/")
    rel = F.call_function("substring_index", F.regexp_replace("path", "^[a-z]+:/*", "/"), base, F.lit(-1))
    kept = files.select(rel.alias("path"), "content").filter(F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(*extensions))
    return kept.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(s) for s in skip))))


def read_diffs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """diff_id (the path), text of files that each hold a unified diff: where a plan over changes begins."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("diff_id"), F.col("value").alias("text"))


def text_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, old, new of two source trees (path, content); a side that lacks the file is null."""
    side = lambda df, name: df.select(F.col("path").alias("file"), F.col("content").cast("string").alias(name))
    return side(old, "old").join(side(new, "new"), "file", "full")


def file_states(stored: DataFrame, current: DataFrame, key: str = "file") -> DataFrame:
    """key, state: added, changed, removed or same, by the content hash of both sides."""
    both = stored.select(key, F.col("file_hash").alias("was")).join(current.select(key, F.col("file_hash").alias("now")), key, "full")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return both.select(key, state.alias("state"))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def incremental_update(stored: DataFrame, states: DataFrame, parsed: DataFrame, key: str = "file") -> DataFrame:
    """Stored rows of files that stay the same, and parsed rows of new and changed files.

    A file that did not parse has no rows in parsed, so it counts as new next time.
    """
    kept = stored.join(states.filter("state = 'same'"), key, "left_semi")
    new = parsed.join(states.filter("state in ('added', 'changed')"), key, "left_semi")
    return kept.unionByName(new)


def is_fresh(states: DataFrame) -> DataFrame:
    """One row: is every file the same?"""
    return states.agg((F.count_if(F.col("state") != "same") == 0).alias("fresh"))


def graph_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/v={VERSION}/{name}"


def save_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(graph_path(root, name))


def load_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges), or None where this version has not been stored; then an old store of JSON lines counts, if there is one."""
    fs, path = _filesystem(spark, graph_path(root, "edges"))
    if fs.exists(path):
        return spark.read.parquet(graph_path(root, "nodes")), spark.read.parquet(graph_path(root, "edges"))
    nodes, edges = (f"{root.rstrip('/')}/{n}.json" for n in ("nodes", "edges"))
    if all(fs.exists(_filesystem(spark, p)[1]) for p in (nodes, edges)):
        return load_graph_json(spark, nodes, edges)
    return None


def drop_other_versions(spark: SparkSession, root: str) -> list[str]:
    """Delete stored graphs of other versions, so that the next update fills the store anew; their folders' names."""
    fs, path = _filesystem(spark, root)
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    old = [p for p in found if p.getName().startswith("v=") and p.getName() != f"v={VERSION}"]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)


def load_reports(spark: SparkSession, folder: str, limit: int = 30) -> DataFrame:
    """The latest reports by timestamp; malformed files and those without one are left out.

    Files are named *_report.json, or as save_reports() names them.
    """
    raw = spark.read.option("multiLine", True).option("pathGlobFilter", "{*_report,part-*}.json").option("mode", "PERMISSIVE").schema(REPORT).json(folder)
    return raw.filter("coalesce(timestamp, '') <> ''").orderBy(F.desc("timestamp")).limit(limit)


def save_reports(reports: DataFrame, folder: str) -> None:
    """Each report to a file of its own, for load_reports()."""
    reports.write.mode("append").option("maxRecordsPerFile", 1).json(folder)


def latest_queue(spark: SparkSession, path: str) -> DataFrame:
    """Fix candidates of one report file with defaults for missing fields; none for a bad file."""
    raw = spark.read.option("multiLine", True).schema(REPORT).json(path)
    c = raw.select(F.explode("fix_candidates").alias("c")).select("c.*")
    texts = [f.name for f in c.schema if f.dataType.simpleString() == "string"]
    return c.na.fill("", texts).na.fill(0, ["id", "line"])


def markdown(items: DataFrame, by: str = "report_id", seq: str = "seq") -> DataFrame:
    """A report's text: a heading for each section and its findings by risk."""
    from riskloom.functions.ranks import risk_rank

    line = F.format_string("- **%s** `%s:%s` %s", "risk", "file", F.col("line").cast("string"), "reason")
    rows = F.sort_array(F.collect_list(F.struct(risk_rank(F.col("risk"), 9).alias("r"), F.col(seq).alias("s"), line.alias("t"))))
    sections = items.groupBy(by, "section").agg(F.concat_ws("\n", F.concat(F.lit("## "), F.first("section")), F.array_join(F.transform(rows, lambda x: x.t), "\n")).alias("text"))
    return sections.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "text"))), lambda x: x.text), "\n\n").alias("markdown"))


def parse_tests(files: DataFrame) -> DataFrame:
    """file, describe, it, line of test cases; a describe holds for the cases after it.

    Calls whose name only ends in it or test count too.
    """
    from pyspark.sql import Window

    describe, case = r"describe\s*\(\s*['\"`](.+?)['\"`]", r"(?:it|test)\s*\(\s*['\"`](.+?)['\"`]"
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    is_describe = F.col("text").rlike(describe)
    name = F.when(is_describe, F.regexp_extract("text", describe, 1))
    filled = lines.withColumn("describe", F.coalesce(F.last(name, True).over(Window.partitionBy("file").orderBy("n")), F.lit("")))
    kept = filled.filter(~is_describe & F.col("text").rlike(case))
    return kept.select("file", "describe", F.regexp_extract("text", case, 1).alias("it"), (F.col("n") + 1).alias("line"))


def related_tests(tests: DataFrame, changed: DataFrame) -> DataFrame:
    """Tests whose describe or name contains the stem of a changed file (column stem).

    Stems go to every task in rows of bounded size, see in_blocks(); a test that
    several blocks fit comes once.
    """
    from riskloom.operators.retrieval import in_blocks

    stems = changed.select(F.regexp_replace(F.lower("stem"), r"\.(spec|test)$", "").alias("stem")).filter("stem <> ''").distinct()
    text = F.lower(F.concat_ws("\n", "describe", "it"))
    found = [tests.join(F.broadcast(some)).filter(F.exists("_s", lambda s: F.contains(text, s.stem))).drop("_s") for some in in_blocks(stems, "stem")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out if len(found) == 1 else out.dropDuplicates()


def load_skills(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """name, text, ok, error of rule files; one that is empty or missing is not ok, and has an error for a text."""
    there = {p: fs.exists(h) for p in paths for fs, h in [_filesystem(spark, p)]}
    lost = [(p.rsplit("/", 1)[-1].rsplit(".", 1)[0], None, False, f"missing: {p}") for p, ok in there.items() if not ok]
    out = spark.createDataFrame(lost, "name string, text string, ok boolean, error string")
    if kept := [p for p, ok in there.items() if ok]:
        raw = spark.read.text(kept, wholetext=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1))
        bare = F.regexp_replace("value", r"^\s+|\s+$", "")
        ok = bare != ""
        out = raw.select("name", F.format_string("# Skill: %s\n%s", "name", bare).alias("text"), ok.alias("ok"), F.when(~ok, F.concat(F.lit("empty: "), "name")).alias("error")).unionByName(out)
    return out


def vue_script(content: Column) -> Column:
    """(body, line_offset) of a component's script: one with setup before others, none with src."""
    tags = F.regexp_extract_all(content, F.lit(r"(?s)<script\b[^>]*>.*?</script>"), F.lit(0))
    own = F.filter(tags, lambda t: ~t.rlike(r"^<script\b[^>]*\bsrc\s*="))
    setup = F.filter(own, lambda t: t.rlike(r"^<script\b[^>]*\bsetup\b"))
    best = F.coalesce(F.try_element_at(setup, F.lit(1)), F.try_element_at(own, F.lit(1)))
    head = F.regexp_extract(best, r"^<script\b[^>]*>", 0)
    before = F.call_function("substring_index", content, best, F.lit(1))
    offset = F.length(before) - F.length(F.replace(before, F.lit("\n"))) + F.length(head) - F.length(F.replace(head, F.lit("\n")))
    body = F.regexp_extract(best, r"(?s)^<script\b[^>]*>(.*?)</script>$", 1)
    return F.when(best.isNotNull(), F.struct(body.alias("body"), offset.cast("int").alias("line_offset")))


def load_graph_json(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from JSON lines; rows that are malformed or lack their key are left out."""
    read = spark.read.option("mode", "DROPMALFORMED")
    n = read.schema("id string, node_type string, file string, name string, line int, attributes array<string>").json(nodes)
    e = read.schema("source string, target string, edge_type string, evidence string, confidence string").json(edges)
    return n.filter("id is not null"), e.filter("source is not null and target is not null")


def run_row(lines: DataFrame, project: str, scope: str, elapsed: float, commit: str) -> DataFrame:
    """A row per diff of what was reviewed: project, scope, files, lines, seconds, commit."""
    from riskloom.sources.diff import change_counts

    return change_counts(lines).select("diff_id", F.lit(project).alias("project"), F.lit(scope).alias("scope"), "n_files", "n_changed", F.lit(float(elapsed)).alias("elapsed"), F.lit(commit).alias("commit"))

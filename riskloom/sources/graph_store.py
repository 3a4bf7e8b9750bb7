"""A stored code graph with its text index, kept up to date file by file.

Rows of a file lie in one of a fixed number of buckets, by a hash of its name.
An update writes only the buckets that hold a changed file, each as a new
generation beside the old one, and then a manifest that names the generation of
each bucket. Readers follow the newest manifest, so they see an update wholly or
not at all, and a failed one leaves nothing but files that vacuum() removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import fulltext
from riskloom.sources.store import _filesystem, checkpointed, content_hash, file_states

#: Columns of the stored tables besides bucket.
TABLES = {
    "files": "file string, file_hash string",
    "nodes": "id string, node_type string, file string, name string, line int",
    "edges": "source string, target string, edge_type string, file string",
    "terms": "id string, col string, pos int, term string, length int, file string",
}
#: What of a node can be searched.
SEARCHED = ("name", "node_type", "file")
Parse = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def parse_scripts(changed: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of changed scripts (file, content); imports are resolved among all files. Null contents do not parse."""
    from riskloom.operators import languages

    read = changed.filter("content is not null")
    exports = languages.script_exports(read).withColumn("id", F.concat_ws(":", "file", "name"))
    own = read.select(F.col("file").alias("id"), F.lit("file").alias("node_type"), "file", F.col("file").alias("name"), F.lit(0).alias("line"))
    imports = languages.script_imports(read, every).withColumn("file", F.col("source"))
    links = exports.select(F.col("file").alias("source"), F.col("id").alias("target"), F.lit("exports").alias("edge_type"), "file")
    return own.unionByName(exports.select("id", "node_type", "file", "name", "line")), imports.unionByName(links)


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, path = _filesystem(spark, f"{root}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, root: str) -> dict:
    """version, n_buckets and the generation of each bucket that has rows; version 0 before the first update."""
    found = _manifests(spark, root)
    if not found:
        return {"version": 0, "n_buckets": 0, "buckets": {}}
    text = spark.read.text(f"{root}/manifest/{found[-1]}", wholetext=True).first()[0]
    return json.loads(text)


def stored(spark: SparkSession, root: str, table: str, told: dict | None = None) -> DataFrame:
    """The rows of a stored table, with their bucket, as of a manifest; the newest where none is given."""
    told = manifest(spark, root) if told is None else told
    schema = f"{TABLES[table]}, bucket int"
    paths = []
    for bucket, generation in told["buckets"].items():
        path = f"{root}/{table}/generation={generation}/bucket={bucket}"
        fs, hadoop = _filesystem(spark, path)
        if fs.exists(hadoop):
            paths.append(path)
    if not paths:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(f"{schema}, generation string").option("basePath", f"{root}/{table}").parquet(*paths)
    return read.drop("generation")


def update_graph(files: DataFrame, root: str, parse: Parse = parse_scripts, n_buckets: int = 64) -> dict:
    """Bring the store at root in line with files (file, content); version, states and the buckets written.

    Files that are new or whose content changed are parsed; those that are gone
    lose their rows. A file's hash is stored only where parsing gave it a file
    node, else it is empty, so that the next update tries again. If nothing
    changed, nothing is written. Of two updates at the same time one commits and
    the other raises an error. A null content counts as a file that does not
    parse; names are unique.
    """
    spark = files.sparkSession
    told = manifest(spark, root)
    n = told["n_buckets"] or n_buckets
    bucket = F.pmod(F.xxhash64("file"), F.lit(n)).cast("int").alias("bucket")
    now = files.select("file", "content", F.coalesce(content_hash(F.col("content")), F.lit("none")).alias("file_hash"))
    before = {t: stored(spark, root, t, told) for t in TABLES}
    states = checkpointed(file_states(before["files"], now).withColumn("bucket", bucket))
    counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
    changed = states.filter("state <> 'same'")
    touched = sorted(r[0] for r in changed.select("bucket").distinct().collect())  # at most n
    if not touched:
        return {"version": told["version"], "states": counts, "buckets": []}
    fresh = checkpointed(now.join(changed.filter("state <> 'removed'").select("file"), "file", "left_semi"))
    nodes, edges = parse(fresh.select("file", "content"), now.select("file"))
    nodes = checkpointed(nodes)
    done = nodes.filter("node_type = 'file'").select("file").distinct().withColumn("ok", F.lit(True))
    stamped = fresh.join(done, "file", "left").select("file", F.when(F.col("ok"), F.col("file_hash")).otherwise("").alias("file_hash"))
    keyed = nodes.select(F.col("id"), *(F.col(c).alias(c) for c in SEARCHED))
    terms = fulltext.text_index(keyed, "id", *SEARCHED).join(nodes.select("id", F.col("file").alias("file")).distinct(), "id")
    made = {"files": stamped, "nodes": nodes, "edges": edges, "terms": terms}
    generation, kept = uuid.uuid4().hex, states.filter("state = 'same'").select("file")
    for table, rows in made.items():
        columns = [c.split()[0] for c in TABLES[table].split(", ")]
        old = before[table].filter(F.col("bucket").isin(touched)).join(kept, "file", "left_semi")
        out = old.select(*columns, "bucket").unionByName(rows.select(*columns, bucket))
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{table}/generation={generation}")
    version = told["version"] + 1
    _commit(spark, root, {"version": version, "n_buckets": n, "buckets": told["buckets"] | {str(b): generation for b in touched}})
    return {"version": version, "states": counts, "buckets": touched}


def _commit(spark: SparkSession, root: str, told: dict) -> None:
    """The manifest appears at once, by a rename; another of the same version is an error."""
    fs, final = _filesystem(spark, f"{root}/manifest/{told['version']}")
    _, draft = _filesystem(spark, f"{root}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {told['version']} of the graph was stored meanwhile")


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete generations that the newest manifest does not name, and older manifests; the number of folders gone."""
    told = manifest(spark, root)
    used, gone = set(told["buckets"].values()), 0
    for table in TABLES:
        fs, path = _filesystem(spark, f"{root}/{table}")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getPath().getName().removeprefix("generation=") not in used:
                fs.delete(s.getPath(), True)
                gone += 1
    for v in _manifests(spark, root)[:-1]:
        fs, path = _filesystem(spark, f"{root}/manifest/{v}")
        fs.delete(path, False)
    return gone


def graph_is_fresh(files: DataFrame, root: str) -> bool:
    """Does the store hold every file with its present content, and no other?"""
    now = files.select("file", F.coalesce(content_hash(F.col("content")), F.lit("none")).alias("file_hash"))
    return file_states(stored(files.sparkSession, root, "files"), now).filter("state <> 'same'").isEmpty()


def search_graph(spark: SparkSession, root: str, queries: DataFrame, k: int = 20) -> DataFrame:
    """query, rank from 0, id, name, node_type, file of the nodes that each query (query, text) finds, the best first."""
    found = fulltext.top_texts(fulltext.search(stored(spark, root, "terms").select("id", "col", "pos", "term", "length"), queries), k)
    return found.join(stored(spark, root, "nodes"), "id").select("query", "rank", "id", "name", "node_type", "file")

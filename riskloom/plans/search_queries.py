"""Full-text search over the driver's parts, and hybrid search fed by it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from riskloom.operators import fulltext as T
from riskloom.operators import graph as G
from riskloom.operators import retrieval as Q
from riskloom.plans.code_queries import _EDGES, graph_edges
from riskloom.plans.findings_queries import table
from riskloom.plans.source_queries import script_files
from riskloom.sources import graph_store as GS
from riskloom.sources import store as S

#: Queries over names, brands and types of parts, each with what it means in SQL over a name's two words, the brand's two and the type.
#: `hits` counts a query's phrases one by one, so that their scores can be added.
ASKED = (
    ("word", "widget", "has('widget')", (("w1", "widget"),)),
    ("stem", "rods", "has('rod')", (("w1", "rod"),)),
    ("and", "red bolt", "has('red') AND has('bolt')", (("w1", "red"), ("w2", "bolt"))),
    ("phrase", '"cold widget"', "p_name = 'cold widget'", (("pair", "cold widget"),)),
    ("or", '"hot ring" OR anvils', "p_name = 'hot ring' OR has('anvil')", (("pair", "hot ring"), ("w2", "anvil"))),
    ("not", "gears NOT (old OR new)", "has('gear') AND NOT has('old') AND NOT has('new')", (("w1", "gear"), ("w2", "old"), ("w3", "new"))),
    ("column", "p_type: large", "lower(p_type) = 'large'", (("type", "large"),)),
    ("broken", 'red AND "bolt', "false", ()),
)


def _parts(spark, sf_dir):
    return T.text_index(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_type", "p_brand")


def text_search(spark, sf_dir):
    """Every part that each query finds, with the rounded score."""
    asked = spark.createDataFrame([(name, text) for name, text, *_ in ASKED], "query string, text string")
    return T.search(_parts(spark, sf_dir), asked).select("query", F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"))


def _phrase_sql(name: str, kind: str, text: str) -> str:
    """p_partkey, tf of one phrase of a query: a name has each of its words once, and a type may be one of them."""
    if kind == "pair":
        tf = f"CAST(p_name = '{text}' AS BIGINT)"
    elif kind == "type":
        tf = f"CAST(lower(p_type) = '{text}' AS BIGINT)"
    else:
        tf = f"CAST(list_contains(string_split(p_name, ' '), '{text}') AS BIGINT) + CAST(lower(p_type) = '{text}' AS BIGINT)"
    return f"SELECT '{name}' AS query, '{kind} {text}' AS phrase, p_partkey, {tf} AS tf FROM part"


_HITS = " UNION ALL ".join(_phrase_sql(name, kind, text) for name, _, _, phrases in ASKED for kind, text in phrases)
_HAS = r"(list_contains(string_split(p_name, ' '), '\1') OR lower(p_type) = '\1')"
_TESTS = " UNION ALL ".join(f"SELECT '{name}' AS query, p_partkey FROM part WHERE {re.sub(r"has\('(\w+)'\)", _HAS, test)}" for name, _, test, _ in ASKED)
TEXT_SEARCH = f"""
WITH h AS (SELECT * FROM ({_HITS}) WHERE tf > 0), st AS (SELECT count(*) AS n, avg(len(string_split(p_name, ' ')) + 1 + 2) AS mean FROM part),
d AS (SELECT query, phrase, count(*) AS df FROM h GROUP BY ALL), m AS ({_TESTS})
SELECT query, p_partkey, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(string_split(p_name, ' ')) + 3) / mean))), 6) AS score
FROM h JOIN d USING (query, phrase) JOIN m USING (query, p_partkey) JOIN part USING (p_partkey) CROSS JOIN st GROUP BY query, p_partkey"""


def hybrid_search(spark, sf_dir):
    """The tree below a region, customers whose lines use a symbol and those that a text query finds, fused without the seeds."""
    bfs = G.reach(graph_edges(spark, sf_dir), table(spark, sf_dir, "region").filter("r_regionkey = 1").select(F.lit("r1").alias("node")))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file"), F.col("c_mktsegment").alias("body"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"), F.col("n_name").alias("body"))
    files = customers.unionByName(nations)
    lines = files.select("file", F.lit(1).alias("line"), F.concat("body", F.lit("()")).alias("text"))
    symbols = spark.createDataFrame([(0, "MACHINERY", "c3")], "seq int, symbol string, self_file string")
    used = Q.call_sites(lines, symbols).select("file").distinct()
    grep = Q.global_rank(used, [F.col("file")], "rank").select("file", (F.col("rank") - 1).alias("rank"))
    found = T.search(T.text_index(files, "file", "body"), spark.createDataFrame([("q", "buildings")], "query string, text string"))
    best = Q.global_rank(found, [-F.round("score", 9), F.col("id")], "rank").select(F.col("id").alias("file"), (F.col("rank") - 1).alias("rank"))
    seeds = spark.createDataFrame([("n1",), ("c3",)], "file string")
    return Q.hybrid(bfs, grep, best, seeds).select("file", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


HYBRID = f"""
WITH RECURSIVE e AS {_EDGES}, w(node, depth, path) AS (SELECT DISTINCT target, 1, [target] FROM e WHERE source = 'r1' AND edge_type = 'imports'
  UNION ALL SELECT e.target, w.depth + 1, list_append(w.path, e.target) FROM w JOIN e ON e.source = w.node WHERE w.depth < 3 AND NOT list_contains(w.path, e.target)),
a AS (SELECT node AS file, row_number() OVER (ORDER BY depth, node) AS rn FROM (SELECT DISTINCT node, depth FROM w)),
t AS (SELECT 'c' || c_custkey AS file, row_number() OVER (ORDER BY c_mktsegment = 'BUILDING', 'c' || c_custkey) AS rn FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') AND c_custkey <> 3),
u AS (SELECT 'bfs' AS l, * FROM a UNION ALL SELECT 'fts', * FROM t)
SELECT file, round(sum(1.0::DOUBLE / (60 + rn)), 9) AS score, string_agg(DISTINCT l, ',' ORDER BY l) AS sources FROM u WHERE file NOT IN ('n1', 'c3') GROUP BY file"""

def stored_graph(spark, sf_dir):
    """A graph of a script a part, stored, then brought up to date after changes: what lies there, what was written, what a search finds.

    Every tenth part's script gets another function, one in ten goes, and every
    twentieth has no content and so does not parse.
    """
    old = script_files(spark, sf_dir).select("p_partkey", "file", "content")
    rest = F.col("p_partkey") % 10
    changed = F.when(F.col("p_partkey") % 20 == 3, None).when(rest == 0, F.replace("content", F.lit("function show"), F.lit("function render"))).otherwise(F.col("content"))
    new = old.filter(rest != 1).select("p_partkey", "file", changed.alias("content"))
    root = S.scratch_path(spark, "graph")
    first = GS.update_graph(old, root, n_buckets=16)
    second = GS.update_graph(new, root)
    third = GS.update_graph(new, root)  # only what did not parse is tried again
    GS.vacuum(spark, root)
    nodes = GS.stored(spark, root, "nodes").select(F.lit("node").alias("kind"), F.col("id").alias("key"), F.col("line").cast("long").alias("n"))
    edges = GS.stored(spark, root, "edges").select(F.lit("edge").alias("kind"), F.concat_ws(" ", "source", "edge_type", "target").alias("key"), F.lit(0).cast("long").alias("n"))
    states = [(f"update {i}", state, n) for i, told in enumerate((first, second, third)) for state, n in told["states"].items()]
    told = spark.createDataFrame([*states, ("fresh", "", int(GS.graph_is_fresh(new, root)))], "kind string, key string, n long")
    asked = spark.createDataFrame([("hit", "render* NOT node_type: file")], "query string, text string")
    hits = GS.search_graph(spark, root, asked, 1 << 30).select(F.col("query").alias("kind"), F.col("id").alias("key"), F.lit(0).cast("long").alias("n"))
    return nodes.unionByName(edges).unionByName(told).unionByName(hits)


STORED_GRAPH = """
WITH p AS (SELECT p_partkey AS k, p_partkey % 10 AS m, 'web/p' || p_partkey || '.ts' AS f FROM part), l AS (SELECT * FROM p WHERE m <> 1 AND k % 20 <> 3),
x(name, line) AS (VALUES ('show', 2), ('useIt', 4), ('Card', 5), ('Big', 6)), n AS (SELECT k, m, f, CASE WHEN name = 'show' AND m = 0 THEN 'render' ELSE name END || k AS name, line FROM l CROSS JOIN x),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE m = 1) AS gone, count(*) FILTER (WHERE m <> 1 AND (m = 0 OR k % 20 = 3)) AS changed, count(*) FILTER (WHERE k % 20 = 3) AS bad FROM p)
SELECT 'node' AS kind, f AS key, CAST(0 AS BIGINT) AS n FROM l UNION ALL SELECT 'node', f || ':' || name, line FROM n
UNION ALL SELECT 'edge', f || ' exports ' || f || ':' || name, 0 FROM n
UNION ALL SELECT 'edge', f || ' imports web/p' || (k + 1) || '.ts', 0 FROM l WHERE k + 1 IN (SELECT k FROM p) AND (k + 1 IN (SELECT k FROM p WHERE m <> 1) OR m <> 0)
UNION ALL SELECT 'update 0', 'added', n FROM s UNION ALL SELECT 'update 1', 'same', n - gone - changed FROM s UNION ALL SELECT 'update 1', 'changed', changed FROM s UNION ALL SELECT 'update 1', 'removed', gone FROM s
UNION ALL SELECT 'update 2', 'changed', bad FROM s UNION ALL SELECT 'update 2', 'same', n - gone - bad FROM s UNION ALL SELECT 'fresh', '', CAST(bad = 0 AS BIGINT) FROM s
UNION ALL SELECT 'hit', f || ':' || name, 0 FROM n WHERE name LIKE 'render%'"""

QUERIES = {"stored_graph": (stored_graph, STORED_GRAPH), "text_search": (text_search, TEXT_SEARCH), "hybrid_search": (hybrid_search, HYBRID)}

"""Diff, rule, graph, search and interval operators bound to the driver's tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.operators import contracts as C
from riskloom.operators import graph as G
from riskloom.operators import intervals as I
from riskloom.operators import retrieval as Q
from riskloom.operators import rules as M
from riskloom.plans.findings_queries import table
from riskloom.sources import diff as D

_DDL = (
    "DROP TABLE t{k};", "ALTER TABLE t{k} DROP COLUMN c{k};", "alter table t{k} rename column c{k} to d;", "ALTER TABLE t{k} ALTER COLUMN c{k} TYPE bigint;",
    "ALTER TABLE t{k} ADD COLUMN c{k} int NOT NULL;", "ALTER TABLE t{k} ADD COLUMN c{k} int NOT NULL DEFAULT 0;", "ALTER TABLE t{k} ADD COLUMN c{k} int;",
    "CREATE INDEX CONCURRENTLY i{k} ON t (a);", "CREATE INDEX i{k} ON t (a);", "DROP INDEX i{k};", "CREATE TABLE IF NOT EXISTS t{k} (a int);", "-- DROP TABLE t{k};", "SELECT 1;",
)


def part_diffs(spark, sf_dir):
    """A diff for every fifty parts: a migration of ten lines in two hunks for every ten parts, every third file new."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    line = F.lit(None).cast("string")
    for i, text in enumerate(_DDL):
        line = F.when(F.col("k") % 13 == i, F.replace(F.lit(text), F.lit("{k}"), F.col("k").cast("string"))).otherwise(line)
    mark = F.when(F.col("k") % 10 == 5, F.concat(F.lit("@@ -50 +60,5 @@ ctx\n+"), line)).otherwise(F.concat(F.lit("+"), line))
    name = F.concat(F.lit("db/f"), (F.col("k") / 10).cast("long").cast("string"), F.lit(".sql"))
    lines = p.select((F.col("k") / 50).cast("long").alias("diff_id"), (F.col("k") / 10).cast("long").alias("f"), name.alias("name"), "k", mark.alias("line"))
    body = lines.groupBy("diff_id", "f", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x.line), "\n").alias("body"))
    head = F.concat(F.lit("diff --git a/"), "name", F.lit(" b/"), "name", F.when(F.col("f") % 3 == 0, "\nnew file mode 100644").otherwise("\nindex 1..2 100644"), F.lit("\n--- a/"), "name", F.lit("\n+++ b/"), "name", F.lit("\n@@ -0,0 +1,5 @@\n"), "body", F.lit("\n-old line\n same"))
    return body.groupBy("diff_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", head.alias("t")))), lambda x: x.t), "\n").alias("text"))


def diff_files(spark, sf_dir):
    files = D.diff_files(D.diff_lines(part_diffs(spark, sf_dir)))
    h = F.transform("hunks", lambda h: F.concat_ws("+", h.start_line, h.line_count))
    return files.select("diff_id", "path", "is_new_file", "is_deleted", F.array_join(h, ",").alias("hunks"))


DIFF_FILES = """
SELECT p_partkey // 50 AS diff_id, 'db/f' || (p_partkey // 10) || '.sql' AS path, (p_partkey // 10) % 3 = 0 AS is_new_file, false AS is_deleted,
  CASE WHEN count(*) FILTER (p_partkey % 10 = 5) > 0 THEN '1+5,60+5' ELSE '1+5' END AS hunks FROM part GROUP BY p_partkey // 50, p_partkey // 10"""


def change_counts(spark, sf_dir):
    return D.change_counts(D.diff_lines(part_diffs(spark, sf_dir)))


CHANGE_COUNTS = "SELECT p_partkey // 50 AS diff_id, count(DISTINCT p_partkey // 10) AS n_files, count(*) + count(DISTINCT p_partkey // 10) AS n_changed FROM part GROUP BY 1"


def ddl_rules(spark, sf_dir):
    found = M.migration_findings(D.diff_lines(part_diffs(spark, sf_dir)))
    return found.select("diff_id", "path", F.col("line").cast("long").alias("line"), "operation", F.col("table").alias("table_name"), F.col("column").alias("column_name"), "risk")


DDL_RULES = """
WITH p AS (SELECT p_partkey AS k, p_partkey % 13 AS m, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS n FROM part)
SELECT k // 50 AS diff_id, 'db/f' || (k // 10) || '.sql' AS path, 5 + n + CASE WHEN k % 10 >= 5 AND k // 10 * 10 + 5 IN (SELECT k FROM p) THEN 1 ELSE 0 END AS line,
  ['DROP TABLE', 'DROP COLUMN', 'RENAME COLUMN', 'ALTER COLUMN TYPE', 'ADD COLUMN NOT NULL', 'ADD COLUMN NOT NULL DEFAULT', 'ADD COLUMN', 'CREATE INDEX CONCURRENTLY', 'CREATE INDEX', 'DROP INDEX', 'CREATE TABLE'][CAST(m + 1 AS INTEGER)] AS operation,
  CASE WHEN m IN (0, 1, 2, 3, 4, 5, 6, 10) THEN 't' || k ELSE '' END AS table_name, CASE WHEN m BETWEEN 1 AND 6 THEN 'c' || k ELSE '' END AS column_name,
  CASE WHEN m <= 4 THEN 'high' WHEN m IN (5, 8) THEN 'medium' ELSE 'low' END AS risk FROM p WHERE m < 11"""


def hunk_filter(spark, sf_dir):
    lines = D.diff_lines(part_diffs(spark, sf_dir))
    symbols = table(spark, sf_dir, "part").filter("p_partkey % 30 = 7").select(F.concat(F.lit("f"), (F.col("p_partkey") / 10).cast("long").cast("string"), F.lit(".sql")).alias("file"), F.lit(55).alias("start_line"))
    out = D.hunks_for_symbols(lines, symbols, after=10)
    return out.select("diff_id", (F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))


HUNK_FILTER = """
WITH f AS (SELECT p_partkey // 50 AS diff_id, p_partkey // 10 AS f, count(*) AS n, count(*) FILTER (p_partkey % 10 >= 5) AS second, count(*) FILTER (p_partkey % 10 = 5) AS cut, count(*) FILTER (p_partkey % 30 = 7) AS sym FROM part GROUP BY 1, 2),
g AS (SELECT diff_id, sum(7 + n + cut) AS whole, sum(CASE WHEN sym > 0 AND cut > 0 THEN 7 + second END) AS near FROM f GROUP BY 1)
SELECT diff_id, CAST(coalesce(near, whole) AS BIGINT) AS n_lines FROM g"""


def files_filter(spark, sf_dir):
    lines = D.diff_lines(part_diffs(spark, sf_dir))
    files = table(spark, sf_dir, "part").filter("p_partkey % 30 = 7").select(F.concat(F.lit("f"), (F.col("p_partkey") / 10).cast("long").cast("string"), F.lit(".sql")).alias("file"))
    return D.diff_for_files(lines, files).select("diff_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


FILES_FILTER = """
SELECT diff_id, CAST(sum(7 + n + cut) AS BIGINT) AS n_lines FROM (SELECT p_partkey // 50 AS diff_id, p_partkey // 10 AS f, count(*) AS n, count(*) FILTER (p_partkey % 10 = 5) AS cut, bool_or(p_partkey % 30 = 7) AS hit FROM part GROUP BY 1, 2) WHERE hit GROUP BY 1"""


def part_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("a/alembic/versions/x"), k, F.lit(".py")))
    ends = ("Migrations/X{k}Migration.cs", "app/migrations/0{k}_x.py", "database/migrations/x{k}.php", "src/api/openapi.yaml", "proto/x{k}.proto", "web/View{k}.vue", "db/x{k}.SQL", "docs/.env")
    for i, e in enumerate(ends):
        path = path.when(F.col("p_partkey") % 9 == i + 1, F.replace(F.lit(e), F.lit("{k}"), k))
    return p.select("p_partkey", path.alias("path"))


_PATHS = """(SELECT p_partkey, p_partkey % 9 AS m, ['a/alembic/versions/x' || p_partkey || '.py', 'Migrations/X' || p_partkey || 'Migration.cs', 'app/migrations/0' || p_partkey || '_x.py', 'database/migrations/x' || p_partkey || '.php',
  'src/api/openapi.yaml', 'proto/x' || p_partkey || '.proto', 'web/View' || p_partkey || '.vue', 'db/x' || p_partkey || '.SQL', 'docs/.env'][CAST(p_partkey % 9 + 1 AS INTEGER)] AS path FROM part)"""


def path_routing(spark, sf_dir):
    path = F.col("path")
    return part_paths(spark, sf_dir).select("p_partkey", M.is_migration(path).alias("is_migration"), M.schema_kind(path).alias("kind"), T.language_of(path).alias("language"), T.extension(path).alias("ext"), T.dirname(path).alias("dir"), T.stem(path).alias("stem"))


PATH_ROUTING = f"""
SELECT p_partkey, m IN (0, 1, 2, 3, 7) AS is_migration, CASE m WHEN 4 THEN 'openapi' WHEN 5 THEN 'proto' END AS kind,
  CASE m WHEN 0 THEN 'python' WHEN 1 THEN 'csharp' WHEN 2 THEN 'python' WHEN 3 THEN 'php' WHEN 6 THEN 'vue' ELSE 'unknown' END AS language,
  CASE WHEN m = 8 THEN '' ELSE lower('.' || split_part(path, '.', -1)) END AS ext, regexp_replace(path, '/[^/]*$', '') AS dir,
  CASE WHEN m = 8 THEN '.env' ELSE regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') END AS stem FROM {_PATHS}"""


def graph_edges(spark, sf_dir):
    """The tree of regions, nations and customers as imports from below to above, with some exports of customers."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    one = n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("source"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("target"), F.lit("imports").alias("edge_type"))
    two = c.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("source"), F.concat(F.lit("c"), F.col("c_custkey")).alias("target"), F.lit("imports").alias("edge_type"))
    three = c.filter("c_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("source"), F.concat(F.lit("c"), F.col("c_custkey"), F.lit(":x")).alias("target"), F.lit("exports").alias("edge_type"))
    back = c.filter("c_custkey % 40 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("source"), F.concat(F.lit("n"), F.col("c_custkey") % 25).alias("target"), F.lit("imports").alias("edge_type"))
    return one.unionByName(two).unionByName(three).unionByName(back)


_EDGES = """(SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'imports' AS edge_type FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'imports' FROM customer UNION ALL SELECT 'c' || c_custkey, 'c' || c_custkey || ':x', 'exports' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'c' || c_custkey, 'n' || (c_custkey % 25), 'imports' FROM customer WHERE c_custkey % 40 = 0)"""


def impact_bfs(spark, sf_dir):
    seeds = table(spark, sf_dir, "region").filter("r_regionkey = 1").select(F.lit("r1").alias("node"))
    return G.reach(graph_edges(spark, sf_dir), seeds)


IMPACT_BFS = f"""
WITH RECURSIVE e AS {_EDGES}, w(node, depth, path) AS (SELECT DISTINCT target, 1, [target] FROM e WHERE source = 'r1' AND edge_type = 'imports'
  UNION ALL SELECT e.target, w.depth + 1, list_append(w.path, e.target) FROM w JOIN e ON e.source = w.node WHERE w.depth < 3 AND NOT list_contains(w.path, e.target))
SELECT DISTINCT node, depth FROM w"""


def risk_propagation(spark, sf_dir):
    """Customers as changed files; who imports them is above in the tree."""
    edges = graph_edges(spark, sf_dir).filter("edge_type = 'imports' and not startswith(source, 'c')")
    c = table(spark, sf_dir, "customer")
    symbols = c.select(F.col("c_custkey").alias("symbol_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("file"), F.when(F.col("c_custkey") % 100 == 0, "login").otherwise("show").alias("symbol"), F.lit("function").alias("symbol_type"), F.when(F.col("c_custkey") % 150 == 0, "added").otherwise("modified").alias("change_type"))
    out = G.propagate_risk(symbols, edges)
    return out.select("symbol_id", F.array_join("path", ">").alias("path"), "depth", "risk", "confidence", "needs_human_review")


RISK_PROPAGATION = """
WITH c AS (SELECT c_custkey AS i, 'c' || c_custkey || ':' || CASE WHEN c_custkey % 100 = 0 THEN 'login' ELSE 'show' END AS p0, c_custkey % 100 = 0 AS hit, 'n' || c_nationkey AS p1, 'r' || n_regionkey AS p2, c_custkey % 150 = 0 AS added FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT i AS symbol_id, p0 AS path, 0 AS depth, CASE WHEN added THEN 'medium' ELSE 'high' END AS risk, 'high' AS confidence, false AS needs_human_review FROM c
UNION ALL SELECT i, p0 || '>' || p1, 1, CASE WHEN hit THEN 'high' ELSE 'medium' END, 'high', false FROM c
UNION ALL SELECT i, p0 || '>' || p1 || '>' || p2, 2, CASE WHEN hit THEN 'high' ELSE 'medium' END, 'medium', true FROM c"""


def backend_propagation(spark, sf_dir):
    e = graph_edges(spark, sf_dir).filter("not startswith(source, 'c')")
    edges = e.select("source", "target", F.when(F.col("source").startswith("r"), "calls").otherwise("writes_db").alias("edge_type"), F.when(F.col("source").startswith("r"), "medium").otherwise("high").alias("confidence"), F.lit("seen").alias("evidence"))
    r = table(spark, sf_dir, "region")
    symbols = r.select(F.col("r_regionkey").cast("long").alias("symbol_id"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("node_id"), F.when(F.col("r_regionkey") == 0, "controller_action").otherwise("method").alias("symbol_type"), F.array().cast("array<string>").alias("attributes"), F.lower("r_name").alias("text"))
    out = G.propagate_backend_risk(symbols, edges)
    return out.select("symbol_id", "node", "depth", "risk", "confidence", "needs_human_review", F.array_join("rule_hits", ",").alias("rules"))


_WORD = " OR ".join(f"contains(lower(r_name), '{w}')" for w in G.NODE_WORDS)
BACKEND_PROPAGATION = f"""
WITH r AS (SELECT r_regionkey AS i, r_regionkey = 0 AS act, {_WORD} AS hit FROM region)
SELECT CAST(i AS BIGINT) AS symbol_id, 'r' || i AS node, 0 AS depth, CASE WHEN act OR hit THEN 'high' ELSE 'medium' END AS risk, 'high' AS confidence, false AS needs_human_review,
  CASE WHEN act AND hit THEN 'controller_action_changed,business_keyword_hit' WHEN act THEN 'controller_action_changed' WHEN hit THEN 'business_keyword_hit' ELSE 'backend_symbol_changed' END AS rules FROM r
UNION ALL SELECT CAST(i AS BIGINT), 'n' || n_nationkey, 1, CASE WHEN hit THEN 'high' ELSE 'medium' END, 'medium', true,
  CASE WHEN act AND hit THEN 'business_keyword_hit,controller_action_changed' WHEN act THEN 'controller_action_changed' WHEN hit THEN 'business_keyword_hit' ELSE 'backend_symbol_changed' END FROM r JOIN nation ON n_regionkey = i
UNION ALL SELECT CAST(i AS BIGINT), 'c' || c_custkey, 2, 'high', 'medium', true,
  CASE WHEN act AND hit THEN 'business_keyword_hit,controller_action_changed,db_write_path' WHEN act THEN 'controller_action_changed,db_write_path' WHEN hit THEN 'business_keyword_hit,db_write_path' ELSE 'backend_symbol_changed,db_write_path' END FROM r JOIN nation ON n_regionkey = i JOIN customer ON c_nationkey = n_nationkey"""


def direct_importers(spark, sf_dir):
    targets = table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("target"))
    return G.importers(graph_edges(spark, sf_dir), targets)


IMPORTERS = f"SELECT DISTINCT target, source FROM {_EDGES} WHERE edge_type = 'imports' AND target IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 7 = 0)"


def supply_edges(spark, sf_dir):
    """Suppliers to parts."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target"), F.lit("CALLS").alias("edge_type"))


_SUPPLY = "(SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"


def degree(spark, sf_dir):
    return G.degrees(supply_edges(spark, sf_dir))


_DEGREE = f"SELECT node, count(*) AS degree FROM (SELECT source AS node FROM {_SUPPLY} UNION ALL SELECT target FROM {_SUPPLY}) GROUP BY node"


def supply_nodes(spark, sf_dir):
    d = G.degrees(supply_edges(spark, sf_dir))
    key = F.substr("node", F.lit(2)).cast("long")
    return d.select("node", (key % 7).cast("string").alias("community"), F.when(key % 5 == 0, ".ts").otherwise(".vue").alias("language"), F.when(F.col("node").startswith("p"), 1).otherwise(F.col("degree")).alias("degree"), (key % 3 == 0).alias("is_test"))


def surprise(spark, sf_dir):
    edges = supply_edges(spark, sf_dir).select(F.col("target").alias("source"), F.col("source").alias("target"), "edge_type")
    out = G.surprise(edges, supply_nodes(spark, sf_dir))
    return out.select("source", "target", "score", F.array_join("reasons", ",").alias("reasons"), "suspicious")


SURPRISE = f"""
WITH d AS ({_DEGREE}), n AS (SELECT node, CAST(substr(node, 2) AS BIGINT) AS k, CASE WHEN node[1] = 'p' THEN 1 ELSE degree END AS degree FROM d), m AS (SELECT median(degree) AS med FROM n),
e AS (SELECT DISTINCT target AS source, source AS target FROM {_SUPPLY}),
j AS (SELECT e.*, a.k % 7 <> b.k % 7 AS r1, (a.k % 5 = 0) <> (b.k % 5 = 0) AS r2, a.degree <= 2 AND b.degree >= med * 3 AS r3, (a.k % 3 = 0) <> (b.k % 3 = 0) AS r4 FROM e JOIN n a ON e.source = a.node JOIN n b ON e.target = b.node CROSS JOIN m),
s AS (SELECT *, round_even(0.0::DOUBLE + CASE WHEN r1 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN r2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN r3 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN r4 THEN 0.15::DOUBLE ELSE 0 END, 4) AS score FROM j)
SELECT source, target, score, concat_ws(',', CASE WHEN r1 THEN 'cross-community' END, CASE WHEN r2 THEN 'cross-language' END, CASE WHEN r3 THEN 'edge-to-hub' END, CASE WHEN r4 THEN 'cross-test-boundary' END) AS reasons, score >= 0.35 AS suspicious FROM s"""


def supply_paths(spark, sf_dir):
    """A path a line: order, supplier, part, end. The id names all three, as an order may have a supplier twice."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    path_id = F.concat_ws(":", "l_orderkey", "l_suppkey", "l_partkey")
    rows = l.select(path_id.alias("path_id"), F.array(F.concat(F.lit("o"), F.col("l_orderkey")), F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey")), F.lit("end")).alias("path"))
    return rows


_SPATHS = "(SELECT concat_ws(':', l_orderkey, l_suppkey, l_partkey) AS path_id, 'o' || l_orderkey AS a, 's' || l_suppkey AS b, 'p' || l_partkey AS c FROM lineitem)"


def bridges(spark, sf_dir):
    return G.bridges(supply_paths(spark, sf_dir))


BRIDGES = f"SELECT node, count(DISTINCT path_id) AS n_paths FROM (SELECT path_id, b AS node FROM {_SPATHS} UNION ALL SELECT path_id, c FROM {_SPATHS}) GROUP BY node HAVING count(DISTINCT path_id) >= 2"


def path_edges(spark, sf_dir):
    return G.path_edges(supply_paths(spark, sf_dir)).select("source", "target", "path_id")


PATH_EDGES = f"SELECT source, target, min(path_id) AS path_id FROM (SELECT a AS source, b AS target, path_id FROM {_SPATHS} UNION ALL SELECT b, c, path_id FROM {_SPATHS} UNION ALL SELECT c, 'end', path_id FROM {_SPATHS}) GROUP BY ALL"


def untested(spark, sf_dir):
    """Hotspots of a change without related tests; and of one with tests, which are all regions, and which so has none."""
    nodes, regions = supply_nodes(spark, sf_dir), table(spark, sf_dir, "region")
    out = None
    for covered, tests in ((False, regions.limit(0)), (True, regions)):
        rows = G.untested_hotspots(nodes, tests).select("node", F.col("degree").cast("long").alias("degree"), F.lit(covered).alias("covered"))
        out = rows if out is None else out.unionByName(rows)
    return out


UNTESTED = f"SELECT node, degree, false AS covered FROM ({_DEGREE}) WHERE node[1] <> 'p' AND degree >= 5 AND CAST(substr(node, 2) AS BIGINT) % 3 <> 0"


def augmented(spark, sf_dir):
    paths = supply_paths(spark, sf_dir).select(F.slice("path", 1, 3).alias("path"), F.lit("high").alias("risk"), F.lit("high").alias("confidence"))
    hits = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("file"))
    out = G.augment_paths(paths, hits)
    return out.groupBy("risk", F.size("path").alias("size")).agg(F.count("*").alias("n"))


AUGMENTED = f"""
SELECT * FROM (SELECT 'high' AS risk, 3 AS size, count(*) AS n FROM {_SPATHS} UNION ALL SELECT 'low', 1, count(*) FROM part WHERE 'p' || p_partkey NOT IN (SELECT c FROM {_SPATHS})) WHERE n > 0"""

_TERMS = (("q1", "the"), ("q1", "license"), ("q2", "general"), ("q2", "public"), ("q3", "unfoundword"), ("q3", "released"))


def bm25(spark, sf_dir):
    terms = spark.createDataFrame(_TERMS, "query string, term string")
    return Q.bm25(table(spark, sf_dir, "documents"), terms, "doc_id", "text").select("query", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_BM25 = """
q(query, term) AS (VALUES ('q1', 'the'), ('q1', 'license'), ('q2', 'general'), ('q2', 'public'), ('q3', 'unfoundword'), ('q3', 'released')),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM w),
tf AS (SELECT doc_id, len(t) AS size, term, len(list_filter(t, lambda x: x = term)) AS tf FROM w CROSS JOIN (SELECT DISTINCT term FROM q)),
h AS (SELECT * FROM tf WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
sc AS (SELECT query, doc_id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM h JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY 1, 2)"""
BM25 = f"WITH {_BM25} SELECT query, doc_id, round(score, 6) AS score FROM sc"


def cosines(spark, sf_dir):
    """query, id, score: the cosine of every embedding with the one of least id. Vectors of no length score 0."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = e.agg(F.min_by("v", "id").alias("q"))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q")))
    score = F.when(size > 0, dot(F.col("v"), F.col("q")) / size).otherwise(0.0)
    return e.join(F.broadcast(asked)).select(F.lit("e").alias("query"), "id", F.round(score, 9).alias("score"))


def rrf_hybrid(spark, sf_dir):
    """A list of words and one of vectors, fused."""
    terms = spark.createDataFrame(_TERMS[:2], "query string, term string")
    scores = Q.bm25(table(spark, sf_dir, "documents"), terms, "doc_id", "text").withColumn("score", F.round("score", 6))
    one = Q.top_hits(scores, 50).select(F.lit(0).alias("list_no"), (F.col("rank") - 1).alias("rank"), F.col("id").alias("item"))
    two = Q.top_hits(cosines(spark, sf_dir), 50).select(F.lit(1).alias("list_no"), (F.col("rank") - 1).alias("rank"), F.col("id").alias("item"))
    out = Q.rrf(one.unionByName(two))
    return out.select("item", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


RRF = f"""
WITH {_BM25}, a AS (SELECT doc_id AS item, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rn FROM sc WHERE query = 'q1'), b AS (SELECT vec_id AS item, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 9) DESC, vec_id) AS rn FROM embeddings),
u AS (SELECT 0 AS l, * FROM a WHERE rn <= 50 UNION ALL SELECT 1, * FROM b WHERE rn <= 50)
SELECT item, round(sum(1.0::DOUBLE / (60 + rn)), 9) AS score, string_agg(DISTINCT l::VARCHAR, ',' ORDER BY l::VARCHAR) AS sources FROM u GROUP BY item"""


def document_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", F.lit("src"), "source", F.concat(F.lit("d"), F.col("doc_id"), F.lit(".py"))).alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "text")).select("file", (F.col("n") + 1).alias("line"), "text")


def call_sites(spark, sf_dir):
    symbols = spark.createDataFrame([(1, "Licens", "src/src1/x.py"), (2, "Vers", "src/src2/d22.py"), (3, "Nothere", "a.py")], "seq long, symbol string, self_file string")
    out = Q.call_sites(document_lines(spark, sf_dir), symbols)
    return out.select("seq", "symbol", "file", F.col("line").cast("long").alias("line"), F.col("order").alias("place"))


CALL_SITES = """
WITH s(seq, symbol, self_file, dir) AS (VALUES (1, 'Licens', 'src/src1/x.py', 'src/src1'), (2, 'Vers', 'src/src2/d22.py', 'src/src2'), (3, 'Nothere', 'a.py', '')),
l AS (SELECT 'src/' || source || '/d' || doc_id || '.py' AS file, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
h AS (SELECT seq, symbol, file, line, CASE WHEN starts_with(file, dir || '/') THEN 2 WHEN dir <> '' THEN 1 ELSE 0 END AS near FROM l JOIN s ON contains(text, symbol) AND file <> self_file
  WHERE NOT regexp_matches(ltrim(text), '^(#|//|/\\*|\\*|import |from |import\\{|using |use |require )') AND (contains(text, symbol || '(') OR contains(text, symbol || '.')
    OR NOT (contains(text, ': ' || symbol) OR contains(text, '->' || symbol) OR contains(text, '-> ' || symbol) OR contains(text, '[' || symbol) OR contains(text, '| ' || symbol) OR contains(text, symbol || ']') OR contains(text, symbol || ','))))
SELECT CAST(seq AS BIGINT) AS seq, symbol, file, line, place FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY near DESC, file, line) AS place FROM h)"""


def symbol_mentions(spark, sf_dir):
    """symbol, n_lines, n_files: lines of documents that contain the words of benchmark items."""
    symbols = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("symbol")).filter("symbol <> ''").distinct()
    return Q.mention_counts(document_lines(spark, sf_dir).select("file", "text"), symbols)


SYMBOL_MENTIONS = """
WITH s AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS symbol FROM benchmark), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT symbol, count(*) AS n_lines, count(DISTINCT doc_id) AS n_files FROM l JOIN s ON contains(l.text, symbol) WHERE symbol <> '' GROUP BY symbol"""


def ship_ranges(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    s = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return l.select(F.col("l_suppkey").alias("file"), s.alias("s"), (s + F.col("l_quantity").cast("int")).alias("e"))


_RANGES = "(SELECT l_suppkey AS file, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(floor(l_quantity) AS BIGINT) AS e FROM lineitem)"


def merge_intervals(spark, sf_dir):
    return I.merge_intervals(ship_ranges(spark, sf_dir), ["file"]).select("file", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "n")


MERGE = f"""
WITH r AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_RANGES}),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT file, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY file, k"""


def hunk_overlap(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_suppkey") * 37 % 3000).cast("int").alias("p"))
    rows = ship_ranges(spark, sf_dir).distinct()
    out = I.overlapping(rows, points, ["file"])
    return out.select("file", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


OVERLAP = f"SELECT DISTINCT r.file, s, e FROM {_RANGES} r JOIN (SELECT s_suppkey AS file, s_suppkey * 37 % 3000 AS p FROM supplier) t ON r.file = t.file AND s <= p + 150 AND e >= p - 3"


def as_of_decl(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    marks = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("decl_id"))
    return I.nearest_before(e.select("user_id", "ts", "event_id"), marks, ["user_id"], "ts", ["decl_id"]).select("event_id", "decl_id")


AS_OF = "SELECT e.event_id, d.event_id AS decl_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') d ON e.user_id = d.user_id AND e.ts >= d.ts"


def innermost(spark, sf_dir):
    spans = ship_ranges(spark, sf_dir).distinct()
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.explode(F.sequence(F.lit(10), F.lit(3000), F.lit(100))).alias("p"))
    return I.innermost(points, spans, ["file"]).select("file", F.col("p").cast("long").alias("p"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


INNERMOST = f"""
SELECT file, p, s, e FROM (SELECT t.file, p, s, e, row_number() OVER (PARTITION BY t.file, p ORDER BY s DESC, e) AS rn FROM (SELECT s_suppkey AS file, unnest(range(10, 3001, 100)) AS p FROM supplier) t JOIN {_RANGES} r ON r.file = t.file AND s <= p AND p <= e) WHERE rn = 1"""


def proto_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    name = F.concat(F.lit("f"), F.col("k"))
    old = F.concat(F.lit("-  string "), name, F.lit(" = "), F.col("k"), F.lit(";"))
    new = (
        F.when(F.col("k") % 6 == 0, F.concat(F.lit("+  string "), name, F.lit(" = "), F.col("k") + 100000, F.lit(";")))
        .when(F.col("k") % 6 == 1, F.concat(F.lit("+  int32 "), name, F.lit(" = "), F.col("k"), F.lit(";")))
        .when(F.col("k") % 6 == 2, F.concat(F.lit("+  string g"), F.col("k"), F.lit(" = "), F.col("k"), F.lit(";")))
        .when(F.col("k") % 6 == 3, F.concat(F.lit("+  int32 g"), F.col("k"), F.lit(" = "), F.col("k"), F.lit(";")))
        .when(F.col("k") % 6 == 4, F.concat(F.lit("+  string "), name, F.lit(" = "), F.col("k"), F.lit(";")))
    )
    lines = p.select(F.lit("a.proto").alias("path"), F.explode(F.array_compact(F.array(old, new, F.when(F.col("k") % 11 == 0, F.concat(F.lit("-  STATE_"), F.col("k"), F.lit(" = 1;")))))).alias("line"), "k").withColumn("pos", F.col("k"))
    return C.proto_findings(lines, ("path",)).select("change_type", "item", "risk")


PROTO = """
SELECT CASE p_partkey % 6 WHEN 0 THEN 'changed_field_number' WHEN 2 THEN 'renamed_field' WHEN 5 THEN 'removed_field' ELSE 'changed_field_type' END AS change_type, CASE WHEN p_partkey % 6 = 2 THEN 'f' || p_partkey || ' → g' || p_partkey ELSE 'f' || p_partkey END AS item,
  CASE WHEN p_partkey % 6 = 2 THEN 'low' ELSE 'high' END AS risk FROM part WHERE p_partkey % 6 <> 4
UNION ALL SELECT 'added_field', 'g' || p_partkey, 'low' FROM part WHERE p_partkey % 6 IN (2, 3) UNION ALL SELECT 'removed_enum_value', 'STATE_' || p_partkey, 'high' FROM part WHERE p_partkey % 11 = 0"""


def spec_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), F.col("p_partkey").alias("k"))
    body = lambda props, req: f'{{"requestBody": {{"content": {{"application/json": {{"schema": {{"properties": {{{props}}}, "required": [{req}]}}}}}}}}}}'
    old = f'{{"paths": {{"/a": {{"get": {{}}, "post": {body(chr(34) + "x" + chr(34) + ": {" + chr(34) + "type" + chr(34) + ": " + chr(34) + "string" + chr(34) + "}, " + chr(34) + "y" + chr(34) + ": {" + chr(34) + "type" + chr(34) + ": " + chr(34) + "string" + chr(34) + "}", chr(34) + "x" + chr(34))}}}, "/b": {{"get": {{}}}}}}}}'
    new = {
        0: old.replace(', "/b": {"get": {}}', ""),
        1: old.replace('"get": {}, "post"', '"post"'),
        2: old.replace('"x": {"type": "string"}', '"x": {"type": "integer"}'),
        3: old.replace('"required": ["x"]', '"required": ["x", "y"]').replace('"/b"', '"/c"'),
        4: old.replace('"y": {"type": "string"}', '"z": {"type": "string"}'),
        5: old.replace('"x": {"type": "string"}, ', "").replace('"required": ["x"]', '"required": ["w"]').replace('"properties": {', '"properties": {"w": {}, '),
        6: "not json",
    }
    text = F.lit(None).cast("string")
    for i, t in new.items():
        text = F.when(F.col("k") % 7 == i, F.lit(t)).otherwise(text)
    return C.openapi_findings(p.select("file", F.lit(old).alias("old"), text.alias("new"))).select("file", "change_type", "item", "risk")


SPEC = """
WITH c(m, t, i, r) AS (VALUES (0, 'removed_endpoint', '/b', 'high'), (1, 'removed_method', 'GET /a', 'high'), (2, 'changed_field_type', 'POST /a → x', 'high'), (3, 'added_required_field', 'POST /a → y', 'high'), (3, 'removed_endpoint', '/b', 'high'), (3, 'added_endpoint', 'GET /c', 'low'),
  (4, 'added_optional_field', 'POST /a → z', 'low'), (5, 'removed_required_field', 'POST /a → x', 'high'), (5, 'added_required_field', 'POST /a → w', 'high'))
SELECT CAST(p_partkey AS VARCHAR) AS file, t AS change_type, i AS item, r AS risk FROM part JOIN c ON p_partkey % 7 = m"""


def node_upsert(spark, sf_dir):
    l = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("name"))  # noqa: E741
    return G.upsert_nodes(l)


UPSERT = "SELECT o_custkey AS id, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS name FROM orders GROUP BY 1"


def node_contexts(spark, sf_dir):
    p = part_paths(spark, sf_dir)
    edges = p.select(F.col("path").alias("source"), F.concat(F.lit("lib/test_"), F.col("p_partkey") % 4, F.lit(".ts")).alias("target"))
    return G.node_context(edges)


NODE_CONTEXTS = f"""
WITH e AS (SELECT path AS source, 'lib/test_' || (p_partkey % 4) || '.ts' AS target FROM {_PATHS}), n AS (SELECT source AS node FROM e UNION ALL SELECT target FROM e)
SELECT node, regexp_replace(node, '/[^/]*$', '') AS community, CASE WHEN node = 'docs/.env' THEN '' ELSE lower('.' || split_part(node, '.', -1)) END AS language, count(*) AS degree, contains(lower(node), 'test') AS is_test FROM n GROUP BY node"""

QUERIES = {
    "diff_files": (diff_files, DIFF_FILES),
    "change_counts": (change_counts, CHANGE_COUNTS),
    "ddl_rules": (ddl_rules, DDL_RULES),
    "files_filter": (files_filter, FILES_FILTER),
    "hunk_filter": (hunk_filter, HUNK_FILTER),
    "path_routing": (path_routing, PATH_ROUTING),
    "impact_bfs": (impact_bfs, IMPACT_BFS),
    "risk_propagation": (risk_propagation, RISK_PROPAGATION),
    "backend_propagation": (backend_propagation, BACKEND_PROPAGATION),
    "importers": (direct_importers, IMPORTERS),
    "degree": (degree, _DEGREE),
    "surprise": (surprise, SURPRISE),
    "bridges": (bridges, BRIDGES),
    "path_edges": (path_edges, PATH_EDGES),
    "untested_hotspots": (untested, UNTESTED),
    "augmented_paths": (augmented, AUGMENTED),
    "bm25": (bm25, BM25),
    "rrf_hybrid": (rrf_hybrid, RRF),
    "call_sites": (call_sites, CALL_SITES),
    "symbol_mentions": (symbol_mentions, SYMBOL_MENTIONS),
    "merge_intervals": (merge_intervals, MERGE),
    "hunk_overlap": (hunk_overlap, OVERLAP),
    "as_of_decl": (as_of_decl, AS_OF),
    "innermost": (innermost, INNERMOST),
    "proto_diff": (proto_diff, PROTO),
    "spec_diff": (spec_diff, SPEC),
    "node_upsert": (node_upsert, UPSERT),
    "node_context": (node_contexts, NODE_CONTEXTS),
}

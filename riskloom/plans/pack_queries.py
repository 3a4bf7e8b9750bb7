"""Packs, contexts, prompts and lists around a review, bound to the driver's tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.operators import findings as O
from riskloom.operators import graph as G
from riskloom.operators import replies as R
from riskloom.operators import retrieval as Q
from riskloom.plans.code_queries import BRIDGES, SURPRISE, UNTESTED, bridges, supply_edges, supply_nodes, surprise
from riskloom.plans.findings_queries import _ORDER_ROWS, FIX_QUEUE, order_items, table

_RANK = "CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"


def customer_paths(spark, sf_dir) -> DataFrame:
    """A path for every customer from its nation, a pack for every nation."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        F.col("c_nationkey").cast("long").alias("pack_id"),
        k.alias("seq"),
        F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("c"), (k % 500).cast("string"))).alias("path"),
        F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("risk"),
        F.when(k % 2 == 0, "high").otherwise("low").alias("confidence"),
        F.array_compact(F.array(F.when(k % 5 == 0, "auth_path_changed"), F.when(k % 7 == 0, "db_write_path"), F.when(k % 110 == 0, "endpoint_path"))).alias("rule_hits"),
    )


_CPATHS = """(SELECT CAST(c_nationkey AS BIGINT) AS pack_id, c_custkey AS seq, 'n' || c_nationkey AS source, 'c' || (c_custkey % 500) AS endpoint, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, c_custkey % 5 = 0 AS auth, c_custkey % 7 = 0 AS db, c_custkey % 110 = 0 AS web FROM customer)"""
_PACKED = "array<struct<path: array<string>, risk: string, confidence: string>>"


def context_packs(spark, sf_dir):
    """The best path of each endpoint, as the pack of each nation tells it."""
    packs = R.context_pack(customer_paths(spark, sf_dir))
    rows = packs.select("pack_id", F.posexplode(F.from_json("pack", f"struct<impact_paths: {_PACKED}>").getField("impact_paths")).alias("nth", "p"))
    return rows.select("pack_id", F.col("nth").cast("long").alias("nth"), F.array_join("p.path", ">").alias("path"), "p.risk", "p.confidence")


CONTEXT_PACKS = f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY pack_id, endpoint ORDER BY {_RANK}, seq) AS rn FROM {_CPATHS}),
m AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY {_RANK}, seq) AS nth FROM b WHERE rn = 1)
SELECT pack_id, nth - 1 AS nth, source || '>' || endpoint AS path, risk, confidence FROM m WHERE nth <= 25"""


def backend_packs(spark, sf_dir):
    paths = customer_paths(spark, sf_dir)
    edges = paths.select("pack_id", "seq", F.col("path")[0].alias("source"), F.col("path")[1].alias("target"), F.lit("calls").alias("edge_type"), "confidence")
    snippets = paths.select("pack_id", "seq", F.col("path")[1].alias("file"), F.lit("t").alias("text"))
    packs = R.backend_pack(paths, edges, snippets)
    kind = f"struct<impact_paths: {_PACKED}, edges: array<struct<source: string, target: string, confidence: string>>, snippets: array<struct<file: string>>, rules: array<string>>"
    p = packs.select("pack_id", F.from_json("pack", kind).alias("p"))
    return p.select(
        "pack_id",
        F.array_join(F.transform("p.impact_paths", lambda x: x.path[1]), ",").alias("paths"),
        F.array_join(F.transform("p.edges", lambda x: x.target), ",").alias("edges"),
        F.array_join(F.transform("p.snippets", lambda x: x.file), ",").alias("snippets"),
        F.array_join("p.rules", ",").alias("rules"),
    )


BACKEND_PACKS = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY {_RANK}, seq) AS a, row_number() OVER (PARTITION BY pack_id ORDER BY CASE confidence WHEN 'high' THEN 0 ELSE 1 END, seq) AS b, row_number() OVER (PARTITION BY pack_id ORDER BY seq) AS c FROM {_CPATHS})
SELECT pack_id, string_agg(endpoint, ',' ORDER BY a) FILTER (a <= 25) AS paths, string_agg(endpoint, ',' ORDER BY b) FILTER (b <= 30) AS edges, string_agg(endpoint, ',' ORDER BY c) FILTER (c <= 12) AS snippets,
  concat_ws(',', CASE WHEN bool_or(auth) THEN 'auth_path_changed' END, CASE WHEN bool_or(db) THEN 'db_write_path' END, CASE WHEN bool_or(web) THEN 'endpoint_path' END) AS rules FROM r GROUP BY pack_id"""


def review_focus(spark, sf_dir):
    paths = customer_paths(spark, sf_dir)
    rules = O.rule_set(paths).select(F.lit(-1).cast("long").alias("pack_id"), F.array_join("rules", ",").alias("focus"))
    return R.review_focus(paths, "pack_id").unionByName(rules)


REVIEW_FOCUS = f"""
SELECT pack_id, concat_ws(', ', CASE WHEN bool_or(auth) THEN 'auth paths' END, CASE WHEN bool_or(db) THEN 'database writes' END, CASE WHEN bool_or(web) THEN 'endpoints' END, CASE WHEN bool_or(risk = 'high') THEN 'high risk' END) AS focus FROM {_CPATHS} GROUP BY pack_id
UNION ALL SELECT -1, concat_ws(',', CASE WHEN bool_or(auth) THEN 'auth_path_changed' END, CASE WHEN bool_or(db) THEN 'db_write_path' END, CASE WHEN bool_or(web) THEN 'endpoint_path' END) FROM {_CPATHS}"""


def asked_models(spark, sf_dir):
    """Prompts of all parts answered by a given function, and the findings, issues and back-end findings in its replies."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("{"), F.col("p_partkey").cast("string"), F.lit("}")).alias("pack"), F.lit("+x").alias("diff"))
    asked = R.ask(R.prompt(p, "Look."), lambda text: f'Sure: [{{"file": "f", "line": {len(text)}, "category": "c", "issue_type": "i"}}]')
    out = None
    for name, fields, column in (("findings", R.FINDING, "file"), ("quality", R.QUALITY, "issue_type"), ("backend", R.BACKEND, "category")):
        rows = R.parse_reply(asked.select("p_partkey", "reply"), fields).select("p_partkey", F.lit(name).alias("list"), F.col("line").cast("long").alias("line"), F.col(column).alias("what"), "risk")
        out = rows if out is None else out.unionByName(rows)
    return out


ASKED = "SELECT p_partkey, list, CAST(13 + length(p_partkey::VARCHAR) AS BIGINT) AS line, what, 'low' AS risk FROM part CROSS JOIN (VALUES ('findings', 'f'), ('quality', 'i'), ('backend', 'c')) v(list, what)"


def web_issues(spark, sf_dir):
    return O.web_issues(order_items(spark, sf_dir), "report").select("report", "seq", "id", "title", F.col("mode"))


WEB_ISSUES = f"""
SELECT report, seq, row_number() OVER (PARTITION BY report ORDER BY {_RANK}, seq) AS id, substr(reason, 1, 120) AS title, CASE WHEN coalesce(human, false) THEN 'manual' WHEN kind IN ('missing_error_handling', 'dead_code') THEN 'auto' ELSE 'assist' END AS mode FROM {_ORDER_ROWS}"""


def issue_candidates(spark, sf_dir):
    items = order_items(spark, sf_dir)
    out = O.with_candidates(items, O.fix_queue(items, "report"), ("report", "file", "line"))
    return out.select("report", "seq", "fix_id", "fix_mode")


CANDIDATES = f"""
WITH q AS ({FIX_QUEUE}), o AS (SELECT q.*, 'f' || (seq % 50) AS file, seq % 97 AS line FROM q), c AS (SELECT report, file, line, min(id) AS id, arg_min(mode, id) AS mode FROM o GROUP BY 1, 2, 3)
SELECT i.report, i.seq, c.id AS fix_id, c.mode AS fix_mode FROM {_ORDER_ROWS} i LEFT JOIN c ON i.report = c.report AND i.file = c.file AND i.line = c.line"""


def queue_items(spark, sf_dir):
    """The first item of the queue of the report with the least id."""
    queue = O.fix_queue(order_items(spark, sf_dir), "report")
    least = queue.agg(F.min("report").alias("report"))
    return O.queue_item(queue.join(F.broadcast(least), "report", "left_semi"), 1).select("report", "seq", "id", "mode")  # one row


QUEUE_ITEMS = f"SELECT report, seq, id, mode FROM ({FIX_QUEUE}) WHERE id = 1 AND report = (SELECT min(report) FROM ({FIX_QUEUE}))"


def contract_checkpoints(spark, sf_dir):
    items = order_items(spark, sf_dir)
    some = O.contract_checkpoint(items, "orders")
    return some.unionByName(O.contract_checkpoint(items.filter("seq < 0"), "none")).drop("fix_mode")


CONTRACTS = f"""
SELECT 'orders' AS name, arg_min(risk, ({_RANK}, seq)) AS status, arg_min(reason, ({_RANK}, seq)) AS reason, arg_min(file || ':' || line, ({_RANK}, seq)) AS evidence, count(*) AS n FROM {_ORDER_ROWS}
UNION ALL SELECT 'none', 'ok', 'no change', '-', 0"""


def api_checkpoints(spark, sf_dir):
    """API rows of all orders, and of those without a high risk."""
    items = order_items(spark, sf_dir)
    return O.contract_checkpoint(items, "all", counts_low=True).unionByName(O.contract_checkpoint(items.filter("risk <> 'high'"), "not high", counts_low=True))


API_CHECKPOINTS = f"""
SELECT 'all' AS name, arg_min(risk, ({_RANK}, seq)) AS status, arg_min(reason, ({_RANK}, seq)) AS reason, arg_min(file || ':' || line, ({_RANK}, seq)) AS evidence, 'manual' AS fix_mode, count(*) AS n FROM {_ORDER_ROWS}
UNION ALL SELECT 'not high', 'low', count(*) || ' changes, none of high risk', arg_min(file, seq), '-', count(*) FROM {_ORDER_ROWS} WHERE risk <> 'high'"""


def cluster_nodes(spark, sf_dir):
    clusters = O.blast_clusters(customer_paths(spark, sf_dir)).select("source", "endpoint", "risk")
    items = order_items(spark, sf_dir).withColumn("file", F.concat(F.lit("c"), (F.col("report") % 300).cast("string")))
    p = table(spark, sf_dir, "part")
    symbols = p.filter("p_partkey % 25 > 2").select(F.concat(F.lit("n"), (F.col("p_partkey") % 25).cast("string")).alias("file"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_partkey").alias("seq"))
    out = O.cluster_nodes(clusters, items, symbols)
    return out.select("source", "endpoint", "risk", "label", F.col("line").cast("long").alias("line"), "reason")


CLUSTER_NODES = f"""
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, endpoint ORDER BY {_RANK}, seq) AS rn FROM {_CPATHS}) WHERE rn = 1),
f AS (SELECT 'c' || (report % 300) AS file, arg_min(line, seq) AS line, arg_min(reason, seq) AS reason FROM {_ORDER_ROWS} GROUP BY 1),
s AS (SELECT 'n' || (p_partkey % 25) AS file, 's' || max(p_partkey) AS symbol FROM part WHERE p_partkey % 25 > 2 GROUP BY 1)
SELECT source, endpoint, risk, coalesce(symbol, source) AS label, CAST(coalesce(line, 0) AS BIGINT) AS line, coalesce(reason, '') AS reason FROM c LEFT JOIN f ON f.file = c.endpoint LEFT JOIN s ON s.file = c.source"""


def contexts(spark, sf_dir):
    """The minimal, standard and verbose context of all orders as findings and nations as paths."""
    n = table(spark, sf_dir, "nation")
    paths = n.select(F.col("n_nationkey").alias("seq"), F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_name")).alias("path"))
    snippets = n.select(F.col("n_name").alias("file"), F.col("n_nationkey").alias("s"), F.lit("t").alias("text"))
    minimal = O.minimal_context(order_items(spark, sf_dir), paths)
    whole = O.verbose_context(O.standard_context(minimal, snippets), spark.createDataFrame([("+x",)], "text string"), paths)
    return whole.select("n_high", "n_medium", F.array_join("key_risks", "|").alias("key_risks"), F.array_join("endpoints", ",").alias("endpoints"), F.array_join(F.transform("snippets", lambda x: x.file), ",").alias("snippets"), "text", F.array_join("chains", ",").alias("chains"))


CONTEXTS = f"""
SELECT count(*) FILTER (risk = 'high') AS n_high, count(*) FILTER (risk = 'medium') AS n_medium, (SELECT string_agg(reason, '|' ORDER BY seq) FROM (SELECT * FROM {_ORDER_ROWS} WHERE risk = 'high' ORDER BY seq LIMIT 3)) AS key_risks,
  (SELECT string_agg(n_name, ',' ORDER BY n_nationkey) FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 10)) AS endpoints, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation) AS snippets, '+x' AS text,
  (SELECT string_agg('r' || n_regionkey || ' → ' || n_name, ',' ORDER BY 'r' || n_regionkey || ' → ' || n_name) FROM nation) AS chains FROM {_ORDER_ROWS}"""


def second_looks(spark, sf_dir):
    """Callers of the symbols in the files of uncertain findings."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = lambda letter: F.concat(F.lit(letter), (k % 60).cast("string"))
    symbols = p.select(name("f").alias("file"), name("s").alias("symbol")).distinct()
    callers = p.select(name("s").alias("symbol"), k.alias("order"), F.concat(F.lit("g"), k.cast("string")).alias("file"), (k % 9).alias("line"), F.concat(F.lit("x"), k.cast("string"), F.lit("\ny")).alias("snippet"))
    return O.adversarial_context(order_items(spark, sf_dir), symbols, callers, lines=5)


SECOND_LOOKS = f"""
WITH u AS (SELECT DISTINCT file FROM {_ORDER_ROWS} WHERE risk = 'high' AND NOT sure),
c AS (SELECT 's' || (p_partkey % 60) AS symbol, 'f' || (p_partkey % 60) AS file, p_partkey AS k, row_number() OVER (PARTITION BY p_partkey % 60 ORDER BY p_partkey) AS n FROM part)
SELECT symbol, array_to_string(string_split(string_agg('g' || k || ':' || (k % 9) || ':x' || k || chr(10) || 'y', chr(10) ORDER BY n), chr(10))[1:5], chr(10)) AS text FROM c WHERE n <= 3 AND file IN (SELECT file FROM u) GROUP BY symbol"""


def review_questions(spark, sf_dir):
    spots = G.untested_hotspots(supply_nodes(spark, sf_dir), table(spark, sf_dir, "region").filter("r_regionkey < 0"))
    return G.review_questions(surprise(spark, sf_dir), spots, bridges(spark, sf_dir)).select("question")


QUESTIONS = f"""
WITH q AS (SELECT * FROM (SELECT 0 AS kind, score AS weight, 'Why does ' || source || ' depend on ' || target || '?' AS question FROM ({SURPRISE}) WHERE suspicious ORDER BY score DESC, source, target LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 1, CAST(degree AS DOUBLE), 'What tests cover ' || node || '?' FROM ({UNTESTED}) ORDER BY degree DESC, node LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 2, CAST(n_paths AS DOUBLE), 'What breaks if ' || node || ' changes?' FROM ({BRIDGES}) ORDER BY n_paths DESC, node LIMIT 3))
SELECT question FROM q ORDER BY kind, weight DESC, question LIMIT 7"""


def chat_models(spark, sf_dir):
    parts = ("gpt-", "text-embedding-", "tts-", "my-ada-", "chat-", "davinci-002-", "o-embed-")
    name = F.element_at(F.array(*(F.lit(x) for x in parts)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return R.chat_models(table(spark, sf_dir, "part").select(F.concat(name, F.col("p_partkey").cast("string")).alias("name")))


CHAT_MODELS = "SELECT ['gpt-', '', '', '', 'chat-', '', 'o-embed-'][CAST(p_partkey % 7 + 1 AS INTEGER)] || p_partkey AS name FROM part WHERE p_partkey % 7 IN (0, 4, 6)"


def all_findings(spark, sf_dir):
    """Findings of two lists as one, by list."""
    both = O.union_findings(order_items(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.lit("low").alias("risk")))
    return O.sort_by_risk(both.groupBy("list_no", "risk").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))).select(F.col("list_no").cast("long").alias("list_no"), "risk", "n", "seq")


ALL_FINDINGS = f"SELECT CAST(0 AS BIGINT) AS list_no, risk, count(*) AS n, min(seq) AS seq FROM {_ORDER_ROWS} GROUP BY risk UNION ALL SELECT 1, 'low', count(*), min(s_suppkey) FROM supplier"


def first_ranks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return Q.first_ranks(e.select("user_id", "event_type", "event_id"), "event_type", "user_id", rank="event_id")


FIRST_RANKS = "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2"


def query_kinds(spark, sf_dir):
    names = ("OrderService", "snake_case", "a.b", "plain")
    name = F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("p_partkey") % 4 + 1).cast("int"))
    kinds = T.query_kind(F.concat(name, F.col("p_partkey").cast("string")))
    entries = F.transform(F.array_sort(F.map_entries(kinds)), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(entries, ",").alias("kinds"))


QUERY_KINDS = "SELECT p_partkey, ['class=1.5,component=1.3', 'function=1.5', 'qualified=2.0', ''][CAST(p_partkey % 4 + 1 AS INTEGER)] AS kinds FROM part"

QUERIES = {
    "context_packs": (context_packs, CONTEXT_PACKS),
    "backend_packs": (backend_packs, BACKEND_PACKS),
    "review_focus": (review_focus, REVIEW_FOCUS),
    "asked_models": (asked_models, ASKED),
    "web_issues": (web_issues, WEB_ISSUES),
    "issue_candidates": (issue_candidates, CANDIDATES),
    "queue_items": (queue_items, QUEUE_ITEMS),
    "contract_checkpoints": (contract_checkpoints, CONTRACTS),
    "api_checkpoints": (api_checkpoints, API_CHECKPOINTS),
    "cluster_nodes": (cluster_nodes, CLUSTER_NODES),
    "contexts": (contexts, CONTEXTS),
    "second_looks": (second_looks, SECOND_LOOKS),
    "review_questions": (review_questions, QUESTIONS),
    "chat_models": (chat_models, CHAT_MODELS),
    "all_findings": (all_findings, ALL_FINDINGS),
    "first_ranks": (first_ranks, FIRST_RANKS),
    "query_kinds": (query_kinds, QUERY_KINDS),
}

"""Findings and history operators bound to the driver's tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import text as T
from riskloom.operators import findings as O
from riskloom.operators import history as H
from riskloom.operators import replies as R
from riskloom.sources import store as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_risk(kind: Column) -> Column:
    return F.when(kind == "error", "high").when(kind == "purchase", "medium").otherwise("low")


EVENT_RISK = "CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END"
EVENT_RANK = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END"


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: the user is the file, its kind the risk."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("file"),
        event_risk(F.col("event_type")).alias("risk"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, "auth token").otherwise(F.col("event_type")).alias("reason"),
        F.col("props").alias("evidence"),
        (F.col("event_id") % 3 == 0).alias("needs_human_review"),
    )


def hotspots(spark, sf_dir):
    return H.hotspots(event_items(spark, sf_dir))


HOTSPOTS = f"""
SELECT user_id AS file, count(*) AS n_flagged, CASE min({EVENT_RANK}) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS max_risk, max(ts) AS last_seen
FROM events GROUP BY user_id ORDER BY count(*) DESC, min(event_id) LIMIT 10"""


def file_history(spark, sf_dir):
    """The last events of customers who are users."""
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"))
    out = H.file_history(event_items(spark, sf_dir), files)
    return out.select("file", "flagged_count", "nth", "timestamp", "risk")


FILE_HISTORY = f"""
SELECT file, flagged_count, nth, timestamp, risk FROM (
  SELECT user_id AS file, count(*) OVER (PARTITION BY user_id) AS flagged_count,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth, ts AS timestamp, {EVENT_RISK} AS risk
  FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) WHERE nth <= 3"""


def risk_trend(spark, sf_dir):
    days = event_items(spark, sf_dir).withColumn("timestamp", F.to_date("timestamp"))
    reports = O.risk_counts(days, "timestamp").withColumnsRenamed({"n_high": "high", "n_medium": "medium", "n_low": "low"})
    return H.risk_trend(reports).select("risk", F.posexplode("counts").alias("nth", "n"))


RISK_TREND = f"""
WITH d AS (SELECT CAST(ts AS DATE) AS day, {EVENT_RISK} AS risk FROM events), days AS (SELECT DISTINCT day FROM d), r(risk) AS (VALUES ('high'), ('medium'), ('low'))
SELECT r.risk, CAST(row_number() OVER (PARTITION BY r.risk ORDER BY days.day) - 1 AS INTEGER) AS nth,
  (SELECT count(*) FROM d WHERE d.day = days.day AND d.risk = r.risk) AS n FROM days CROSS JOIN r"""


def sparklines(spark, sf_dir):
    days = event_items(spark, sf_dir).withColumn("timestamp", F.to_date("timestamp"))
    reports = O.risk_counts(days, "timestamp").withColumnsRenamed({"n_high": "high", "n_medium": "medium", "n_low": "low"})
    return H.risk_trend(reports).select("risk", T.sparkline(F.col("counts")).alias("line"))


SPARKLINES = f"""
WITH t AS ({RISK_TREND}), m AS (SELECT *, max(n) OVER (PARTITION BY risk) AS top FROM t)
SELECT risk, string_agg(substr(' ▁▂▃▄▅▆▇█', CASE WHEN top > 0 THEN CAST(n * 8 // top AS INTEGER) ELSE 0 END + 1, 1), '' ORDER BY nth) AS line FROM m GROUP BY risk"""


def risk_counts(spark, sf_dir):
    return O.risk_counts(event_items(spark, sf_dir), "file")


RISK_COUNTS = f"""
SELECT user_id AS file, count(*) FILTER ({EVENT_RISK} = 'high') AS n_high, count(*) FILTER ({EVENT_RISK} = 'medium') AS n_medium, count(*) FILTER ({EVENT_RISK} = 'low') AS n_low
FROM events GROUP BY user_id"""


def verdict(spark, sf_dir):
    items = event_items(spark, sf_dir).withColumn("file", F.col("file") * 100 + F.dayofmonth("timestamp"))
    return O.verdicts(items, "file")


_VERDICT_ROWS = f"""(SELECT user_id * 100 + day(ts) AS file, {EVENT_RISK} AS risk, event_id % 3 = 0 AS human,
  lower(CASE WHEN event_id % 2 = 0 THEN 'auth token' ELSE event_type END || ' ' || props) AS txt FROM events)"""
VERDICT = f"""
SELECT file, CASE WHEN bool_or(risk = 'high' AND NOT human AND (contains(txt, 'header') OR contains(txt, 'request') OR contains(txt, 'auth') OR contains(txt, 'permission') OR contains(txt, 'token') OR contains(txt, 'cookie'))) THEN 'block'
  WHEN bool_or(risk = 'high') THEN 'fix' WHEN bool_or(risk = 'medium') THEN 'watch' ELSE 'pass' END AS verdict
FROM {_VERDICT_ROWS} GROUP BY file"""


def web_verdict(spark, sf_dir):
    items = event_items(spark, sf_dir).withColumn("file", F.col("file") * 100 + F.dayofmonth("timestamp"))
    return O.web_verdicts(items, "file")


WEB_VERDICT = f"""
SELECT file, CASE WHEN bool_or(risk = 'high') THEN 'critical' WHEN bool_or(risk = 'medium') THEN 'needs_review' ELSE 'pass' END AS verdict FROM {_VERDICT_ROWS} GROUP BY file"""


def gate(spark, sf_dir):
    return O.has_high(event_items(spark, sf_dir))


GATE = "SELECT bool_or(event_type = 'error') AS stop FROM events"


def document_items(spark, sf_dir):
    """Documents as findings with their whole texts."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq"),
        F.col("source").alias("file"),
        F.col("n_chars").alias("line"),
        F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low").alias("risk"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")).alias("reason"),
        F.col("text").alias("description"),
        F.lit("").alias("evidence"),
        (F.col("doc_id") % 5 == 0).alias("needs_human_review"),
        F.when(F.col("doc_id") % 7 < 3, "missing_error_handling").otherwise("other").alias("issue_type"),
    )


def checkpoints(spark, sf_dir):
    return O.checkpoints(document_items(spark, sf_dir))


def _checkpoints_sql() -> str:
    quote = lambda w: w.replace("'", "''")
    rows = ", ".join(f"({i}, '{quote(n)}', [{', '.join(repr(w) for w in ws)}])" for i, (n, ws) in enumerate(O.CHECKPOINTS.items()))
    auth = " OR ".join(f"contains(lower(reason), '{w}')" for w in O.AUTH_WORDS)
    return f"""
WITH k(place, name, words) AS (VALUES {rows}),
d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS reason,
  text AS description, source || ':' || n_chars AS ev, doc_id % 5 = 0 AS human, doc_id % 7 < 3 AS missing FROM documents),
h AS (SELECT k.place, k.name, d.*, row_number() OVER (PARTITION BY k.place ORDER BY CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, doc_id) AS rn
  FROM k JOIN d ON len(list_filter(k.words, lambda w: contains(lower(reason || ' ' || description), w))) > 0)
SELECT CAST(k.place AS INTEGER) AS place, k.name, coalesce(h.risk, 'ok') AS status, CASE WHEN h.risk IS NULL THEN 'no evident risk' WHEN reason <> '' THEN reason ELSE description END AS reason, coalesce(h.ev, '-') AS evidence,
  CASE WHEN h.risk IS NULL THEN '-' WHEN human THEN 'manual' WHEN missing THEN CASE WHEN {auth} THEN 'manual' ELSE 'auto' END ELSE 'assist' END AS fix_mode
FROM k LEFT JOIN h ON k.place = h.place AND h.rn = 1"""


def order_items(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("report"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").otherwise("low").alias("risk"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string")).otherwise("do it").alias("suggestion"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(None).cast("boolean")).otherwise(F.col("o_orderkey") % 5 == 0).alias("needs_human_review"),
        F.when(F.col("o_orderkey") % 6 == 0, "missing_error_handling").when(F.col("o_orderkey") % 6 == 1, "dead_code").otherwise("").alias("issue_type"),
        F.when(F.col("o_orderkey") % 2 == 0, "login fails").otherwise("slow").alias("reason"),
        F.lit("").alias("description"),
        F.concat(F.lit("f"), (F.col("o_orderkey") % 50).cast("string")).alias("file"),
        (F.col("o_orderkey") % 97).alias("line"),
        F.when(F.col("o_orderkey") % 3 == 1, "high").otherwise("low").alias("confidence"),
    )


def fix_queue(spark, sf_dir):
    return O.fix_queue(order_items(spark, sf_dir), "report").select("report", "seq", "id", "mode", "impact", "command_hint")


_ORDER_ROWS = """(SELECT o_custkey AS report, o_orderkey AS seq, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'do it' END AS suggestion, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 5 = 0 END AS human,
  CASE o_orderkey % 6 WHEN 0 THEN 'missing_error_handling' WHEN 1 THEN 'dead_code' ELSE '' END AS kind, o_orderkey % 2 = 0 AS auth,
  CASE WHEN o_orderkey % 2 = 0 THEN 'login fails' ELSE 'slow' END AS reason, 'f' || (o_orderkey % 50) AS file, o_orderkey % 97 AS line, o_orderkey % 3 = 1 AS sure FROM orders)"""
_RANK = "CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
FIX_QUEUE = f"""
WITH m AS (SELECT *, CASE WHEN coalesce(human, false) THEN 'manual' WHEN kind = 'missing_error_handling' AND NOT auth THEN 'auto' WHEN kind = 'dead_code' THEN 'auto' WHEN human IS NOT NULL THEN 'assist' ELSE 'manual' END AS mode,
  CASE WHEN coalesce(human, false) THEN CASE WHEN risk = 'high' THEN 'blocking' ELSE 'high_value' END WHEN kind = 'missing_error_handling' AND NOT auth THEN 'advised' WHEN kind = 'dead_code' THEN 'later'
    WHEN human IS NOT NULL AND risk = 'high' THEN 'high_value' ELSE 'advised' END AS impact,
  row_number() OVER (PARTITION BY report ORDER BY {_RANK}, seq) AS id FROM {_ORDER_ROWS} WHERE suggestion <> '' OR risk = 'high')
SELECT report, seq, id, mode, impact, CASE mode WHEN 'auto' THEN 'fix ' || id WHEN 'assist' THEN 'fix ' || id || ' --preview' ELSE 'detail ' || id END AS command_hint FROM m"""


def verification(spark, sf_dir):
    items = order_items(spark, sf_dir).withColumn("group_id", F.col("report"))
    replies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.lit(0).alias("index"), (F.col("c_custkey") % 2 == 0).alias("confirmed"), F.lit("checked").alias("reason"))
    return O.after_verification(items, replies).select("report", "seq", "uncertain", "confirmed")


VERIFICATION = f"""
WITH i AS (SELECT *, risk = 'high' AND NOT sure AS uncertain FROM {_ORDER_ROWS}),
n AS (SELECT *, row_number() OVER (PARTITION BY report, uncertain ORDER BY seq) - 1 AS index FROM i)
SELECT report, seq, uncertain, CASE WHEN uncertain AND index = 0 AND report IN (SELECT c_custkey FROM customer) THEN report % 2 = 0 ELSE true END AS confirmed FROM n"""


def inline_comments(spark, sf_dir):
    return O.inline_comments(order_items(spark, sf_dir)).select("seq", "body")


INLINE = f"""
SELECT seq, '[' || upper(risk) || '] ' || reason || CASE WHEN suggestion <> '' THEN chr(10) || chr(10) || 'Suggestion: ' || suggestion ELSE '' END AS body FROM {_ORDER_ROWS} WHERE risk IN ('high', 'medium') AND line > 0"""


def summary_comments(spark, sf_dir):
    return O.summary_comment(order_items(spark, sf_dir), "report").select("report", "body")


SUMMARY = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY {_RANK}, seq) AS n FROM {_ORDER_ROWS})
SELECT report, CASE WHEN bool_or(risk = 'high') THEN 'critical' WHEN bool_or(risk = 'medium') THEN 'needs_review' ELSE 'pass' END || ': ' || count(*) FILTER (risk = 'high') || ' high, ' || count(*) FILTER (risk = 'medium') || ' medium, ' || count(*) FILTER (risk = 'low') || ' low' || chr(10)
  || string_agg('- [' || risk || '] ' || file || ':' || line || ' ' || reason, chr(10) ORDER BY n) FILTER (n <= 10) AS body FROM r GROUP BY report"""


def best_path_per_endpoint(spark, sf_dir):
    return O.best_paths(event_items(spark, sf_dir), end="file").select("file", "seq", "risk")


BEST_PATHS = f"""
SELECT file, seq, risk FROM (SELECT user_id AS file, event_id AS seq, {EVENT_RISK} AS risk, row_number() OVER (PARTITION BY user_id ORDER BY {EVENT_RANK}, event_id) AS rn FROM events)
WHERE rn = 1 ORDER BY {_RANK}, seq LIMIT 25"""


def event_paths(spark, sf_dir):
    """Paths of the users' kinds of event in a day."""
    e = table(spark, sf_dir, "events").withColumn("path_id", F.col("user_id") * 1000 + F.dayofyear("ts"))
    every = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x.event_type)
    p = e.groupBy("path_id").agg(every.alias("path"), F.max_by("event_type", "event_id").alias("last"))
    return p.withColumn("risk", event_risk(F.col("last"))).withColumn("seq", F.col("path_id"))


_PATHS = f"""(SELECT user_id * 1000 + dayofyear(ts) AS path_id, list(event_type ORDER BY event_id) AS path,
  CASE arg_max(event_type, event_id) WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS risk FROM events GROUP BY 1)"""


def impact_blocks(spark, sf_dir):
    items = document_items(spark, sf_dir).withColumn("file", F.when(F.col("seq") % 2 == 0, "error").otherwise("purchase"))
    out = O.impact_blocks(event_paths(spark, sf_dir), items)
    return out.select("source", "risk", F.explode("chains").alias("c")).select("source", "risk", "c.path_id", F.posexplode("c.chain").alias("place", "n")).select("source", "risk", "path_id", "place", "n.file", F.col("n.risk").alias("node_risk"), F.col("n.line").alias("line"))


IMPACT_BLOCKS = f"""
WITH b AS (SELECT file, arg_min(risk, (r, doc_id)) AS risk, arg_min(n_chars, (r, doc_id)) AS line FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'purchase' END AS file, doc_id, n_chars,
  CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk, doc_id % 3 AS r FROM documents) GROUP BY file),
p AS (SELECT *, path[1] AS source, min(CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) OVER (PARTITION BY path[1]) AS worst FROM {_PATHS} WHERE len(path) >= 2),
x AS (SELECT source, worst, path_id, unnest(path) AS file, generate_subscripts(path, 1) AS i FROM p)
SELECT source, CASE worst WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk, path_id, CAST(i - 1 AS INTEGER) AS place, x.file, coalesce(b.risk, 'low') AS node_risk, coalesce(b.line, 0) AS line FROM x LEFT JOIN b ON x.file = b.file"""


def blast_clusters(spark, sf_dir):
    return O.blast_clusters(event_paths(spark, sf_dir)).select("source", "endpoint", "path_id", "risk")


BLAST = f"""
SELECT source, endpoint, path_id, risk FROM (SELECT path[1] AS source, path[-1] AS endpoint, path_id, risk, row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY {_RANK}, path_id) AS rn FROM {_PATHS} WHERE path[1] <> path[-1]) WHERE rn = 1"""


def chain_tree(spark, sf_dir):
    return O.merged_chains(event_paths(spark, sf_dir)).select(F.array_join("prefix", ">").alias("prefix"), "depth", "node", "first_path")


CHAIN_TREE = f"""
SELECT array_to_string(path[1:n], '>') AS prefix, CAST(n AS INTEGER) AS depth, path[n] AS node, min(path_id) AS first_path FROM (SELECT path_id, path, unnest(range(1, len(path) + 1)) AS n FROM {_PATHS}) GROUP BY ALL"""


def minimal_context(spark, sf_dir):
    out = O.minimal_context(document_items(spark, sf_dir), event_paths(spark, sf_dir))
    return out.select("n_high", "n_medium", F.array_join("key_risks", "|").alias("key_risks"), F.array_join("endpoints", "|").alias("endpoints"))


MINIMAL = f"""
WITH d AS (SELECT doc_id, doc_id % 3 AS r, CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(text, 1, 80) END AS reason FROM documents),
e AS (SELECT path[-1] AS e, min(path_id) AS s FROM {_PATHS} GROUP BY 1 ORDER BY 2 LIMIT 10)
SELECT count(*) FILTER (r = 0) AS n_high, count(*) FILTER (r = 1) AS n_medium, (SELECT string_agg(reason, '|' ORDER BY doc_id) FROM (SELECT * FROM d WHERE r = 0 ORDER BY doc_id LIMIT 3)) AS key_risks,
  (SELECT string_agg(e, '|' ORDER BY s) FROM e) AS endpoints FROM d"""


#: Secrets and personal data of documents.
SECRETS = ("[0-9a-f]{40}", "[A-Za-z0-9.]+@[A-Za-z0-9.]+", "[0-9]{16}")


def redacted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text"), SECRETS).alias("text"))


REDACTED = "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[0-9a-f]{40}', '[REDACTED]', 'g'), '[A-Za-z0-9.]+@[A-Za-z0-9.]+', '[REDACTED]', 'g'), '[0-9]{16}', '[REDACTED]', 'g') AS text FROM documents"


def token_savings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", T.token_estimate(F.col("text")).alias("baseline"), T.token_estimate(F.substring("text", 1, 800)).alias("used"))
    return O.savings(d, "source")


TOKEN_SAVINGS = """
WITH d AS (SELECT source, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END AS b, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (least(length(text), 800) + 3) // 4) END AS u FROM documents),
s AS (SELECT source, CAST(sum(b) AS BIGINT) AS baseline, CAST(sum(u) AS BIGINT) AS used FROM d WHERE b > 0 GROUP BY source)
SELECT *, greatest(baseline - used, 0) AS saved, CAST(round_even(greatest(baseline - used, 0) * 100 / baseline, 0) AS BIGINT) AS saved_percent FROM s"""


def reply_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    obj = F.to_json(F.struct(F.col("event_type").alias("file"), F.when(F.col("event_id") % 3 == 0, F.lit("x")).otherwise(F.col("user_id").cast("string")).alias("line"), F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string")).otherwise("high").alias("risk"), (F.col("user_id") % 2 == 0).alias("needs_human_review")))
    broken = F.when(F.col("event_id") % 10 == 0, '[{"file": ').otherwise(F.concat(F.lit("Here it is: ["), obj, F.lit(', 7, {"reason": "b"}] done')))
    out = R.parse_reply(e.select("event_id", broken.alias("reply")))
    return out.select("event_id", "seq", "file", "line", "risk", "confidence", "reason", "needs_human_review")


REPLY_PARSE = """
WITH e AS (SELECT * FROM events WHERE event_id % 10 <> 0)
SELECT event_id, 0 AS seq, event_type AS file, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS INTEGER) AS line, CASE WHEN event_id % 4 = 0 THEN 'low' ELSE 'high' END AS risk, 'medium' AS confidence, '' AS reason, user_id % 2 = 0 AS needs_human_review FROM e
UNION ALL SELECT event_id, 2, '', 0, 'low', 'medium', 'b', false FROM e"""


def incremental_update(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    stored = d.filter("file % 13 <> 0").select("file", S.content_hash(F.col("text")).alias("file_hash"))
    now = d.filter("file % 11 <> 0").withColumn("text", F.when(F.col("file") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    parsed = now.select("file", S.content_hash(F.col("text")).alias("file_hash"))
    states = S.file_states(stored, parsed)
    return S.incremental_update(stored, states, parsed).join(states, "file").select("file", "state", "file_hash")


INCREMENTAL = """
SELECT doc_id AS file, CASE WHEN doc_id % 13 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS state, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS file_hash FROM documents WHERE doc_id % 11 <> 0"""


def file_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    stored = d.filter("file % 13 <> 0").select("file", S.content_hash(F.col("text")).alias("file_hash"))
    now = d.filter("file % 11 <> 0").select("file", S.content_hash(F.when(F.col("file") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("file_hash"))
    return S.file_states(stored, now).groupBy("state").agg(F.count("*").alias("n"))


FILE_STATES = """
SELECT CASE WHEN doc_id % 13 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM documents WHERE NOT (doc_id % 13 = 0 AND doc_id % 11 = 0) GROUP BY 1"""

QUERIES = {
    "hotspots": (hotspots, HOTSPOTS),
    "file_history": (file_history, FILE_HISTORY),
    "risk_trend": (risk_trend, RISK_TREND),
    "sparklines": (sparklines, SPARKLINES),
    "risk_counts": (risk_counts, RISK_COUNTS),
    "verdict": (verdict, VERDICT),
    "web_verdict": (web_verdict, WEB_VERDICT),
    "gate": (gate, GATE),
    "checkpoints": (checkpoints, _checkpoints_sql()),
    "fix_queue": (fix_queue, FIX_QUEUE),
    "verification": (verification, VERIFICATION),
    "inline_comments": (inline_comments, INLINE),
    "summary_comments": (summary_comments, SUMMARY),
    "best_path_per_endpoint": (best_path_per_endpoint, BEST_PATHS),
    "impact_blocks": (impact_blocks, IMPACT_BLOCKS),
    "blast_clusters": (blast_clusters, BLAST),
    "chain_tree": (chain_tree, CHAIN_TREE),
    "minimal_context": (minimal_context, MINIMAL),
    "redacted": (redacted, REDACTED),
    "token_savings": (token_savings, TOKEN_SAVINGS),
    "reply_parse": (reply_parse, REPLY_PARSE),
    "incremental_update": (incremental_update, INCREMENTAL),
    "file_states": (file_states, FILE_STATES),
}

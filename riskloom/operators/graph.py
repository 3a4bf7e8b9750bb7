"""Dependency graphs: building, bounded traversal and risk along paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ranks import first_of, min_confidence
from riskloom.functions.text import contains_any, dirname, extension

#: Words that raise the risk of a front-end path.
PATH_WORDS = ("auth", "login", "logout", "token", "session", "permission", "request", "intercept", "trade", "pay", "order", "header", "guard", "route", "middleware")
#: Words that raise the risk of back-end nodes.
NODE_WORDS = ("auth", "authorize", "token", "permission", "role", "order", "trade", "pay", "payment", "amount", "submit", "save", "delete", "create", "update", "transaction", "dbcontext", "repository")
#: Rules of edge types.
EDGE_RULES = {"requires_auth": "auth_path_changed", "writes_db": "db_write_path", "calls_external_api": "external_api_path", "exposes_endpoint": "endpoint_path"}
#: Symbol types whose change is of high risk, and rules of some.
HIGH_TYPES = ("controller_action", "model_property", "entity_property", "repository_method")
TYPE_RULES = {"controller_action": "controller_action_changed", "model_property": "model_contract_changed", "entity_property": "entity_persistence_changed"}

#: Spark's default of spark.shuffle.sort.bypassMergeThreshold: a shuffle of so many parts writes them straight to files.
PARTS = 200


def _cut(df: DataFrame) -> DataFrame:
    """Write a hop's rows, so that the next hop neither repeats them nor grows the plan."""
    from riskloom.sources.store import checkpointed

    return checkpointed(df)


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3, edge_type: str | None = "imports", first_only: bool = True) -> DataFrame:
    """node, depth: ends of simple paths of up to `depth` edges from seeds, each node once for each depth.

    Only the first edge has to be of edge_type, unless first_only is false. The
    seed itself is not part of a path, so a cycle may come back to it.
    """
    all_ = edges.select("source", "target", *(["edge_type"] if edge_type else []))
    typed = all_.filter(F.col("edge_type") == edge_type) if edge_type else all_
    step = (all_ if first_only else typed).select("source", "target")
    front = typed.join(seeds.select(F.col("node").alias("source")).distinct(), "source").select(F.col("target").alias("node"), F.array("target").alias("path")).distinct()
    out = None
    for d in range(1, depth + 1):
        front = _cut(front) if d < depth else front  # the last hop is read once
        level = front.select("node").distinct().withColumn("depth", F.lit(d))
        out = level if out is None else out.unionByName(level)
        if d < depth:
            grown = front.join(step, front.node == step.source).filter(~F.array_contains("path", F.col("target")))
            front = grown.select(F.col("target").alias("node"), F.array_append("path", F.col("target")).alias("path")).distinct()
    return out


def reach_sql(edges: str, seeds: str, depth: int) -> str:
    """The same as a recursive query, for views of small graphs."""
    return f"""
WITH RECURSIVE walk(node, depth, path) AS (
  SELECT DISTINCT e.target, 1, array(e.target) FROM {edges} e JOIN {seeds} s ON e.source = s.node WHERE e.edge_type = 'imports'
  UNION ALL
  SELECT e.target, w.depth + 1, array_append(w.path, e.target) FROM walk w JOIN {edges} e ON e.source = w.node
  WHERE w.depth < {int(depth)} AND NOT array_contains(w.path, e.target)
)
SELECT DISTINCT node, depth FROM walk"""


def path_class(path: Column, depth: Column) -> Column:
    """(risk, confidence) of a front-end path by its length and words."""
    hit = contains_any(F.lower(F.array_join(path, " ")), PATH_WORDS)
    risk = F.when(depth <= 2, F.when(hit, "high").otherwise("medium")).otherwise(F.when(hit, "medium").otherwise("low"))
    confidence = F.when(depth <= 1, "high").when(depth == 2, "medium").otherwise("low")
    return F.struct(risk.alias("risk"), confidence.alias("confidence"))


def _hop(front: DataFrame, edges: DataFrame, visited: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Nodes that a breadth-first search of each symbol sees now for the first time, by the least path."""
    grown = front.join(edges, front.node == edges.near).select("symbol_id", F.col("far").alias("node"), F.array_append("path", F.col("far")).alias("path"), *extra)
    fresh = grown.join(visited, ["symbol_id", "node"], "left_anti")
    rest = [c for c in fresh.columns if c not in ("symbol_id", "node")]
    least = F.min(F.struct("path", *(c for c in rest if c != "path"))).alias("b")
    return fresh.groupBy("symbol_id", "node").agg(least).select("symbol_id", "node", *(F.col(f"b.{c}") for c in rest))


def propagate_risk(symbols: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Impact of changed symbols (symbol_id, file, symbol, symbol_type, change_type) on what imports their files.

    edges has source and target of imports. One row per symbol for itself and
    one for each file that a breadth-first search over importers sees first, up
    to `depth` hops: path, depth, risk, confidence, evidence, needs_human_review.
    Of equally short paths the least one counts.
    """
    importers = edges.select(F.col("target").alias("near"), F.col("source").alias("far")).distinct()
    origin = symbols.select(
        "symbol_id",
        F.col("file").alias("node"),
        F.array(F.concat_ws(":", "file", "symbol")).alias("path"),
        F.lit(0).alias("depth"),
        F.when(F.col("change_type") == "modified", "high").otherwise("medium").alias("risk"),
        F.lit("high").alias("confidence"),
        F.concat_ws(" ", F.lit("changed"), "symbol_type", "symbol").alias("evidence"),
        F.lit(False).alias("needs_human_review"),
    )
    out = _cut(origin)
    visited = front = out.select("symbol_id", "node", F.col("path"))
    visited = visited.select("symbol_id", "node")
    for d in range(1, depth + 1):
        front = _cut(_hop(front, importers, visited))
        made = F.struct(path_class(F.col("path"), F.lit(d)).alias("c"))
        rows = front.withColumn("m", made).select(
            "symbol_id",
            "node",
            "path",
            F.lit(d).alias("depth"),
            F.col("m.c.risk").alias("risk"),
            F.col("m.c.confidence").alias("confidence"),
            F.concat(F.repeat(F.lit("→"), F.lit(d)), F.lit(" "), F.element_at("path", -2), F.lit(" is imported by "), "node").alias("evidence"),
            F.lit(d >= 2).alias("needs_human_review"),
        )
        out = out.unionByName(rows)
        visited = visited.unionByName(front.select("symbol_id", "node"))
    return out


def origin_rules(symbol_type: Column, attributes: Column, text: Column) -> Column:
    """Sorted rules of a changed back-end symbol; text is its file, name and class."""
    found = [F.when(symbol_type == t, r) for t, r in TYPE_RULES.items()]
    found += [F.when(F.array_contains(attributes, "Authorize"), "auth_attribute_present"), F.when(contains_any(F.lower(text), NODE_WORDS), "business_keyword_hit")]
    return F.array_compact(F.array(*found))


def edge_rules(edge_type: Column, target: Column) -> Column:
    found = [F.when(edge_type == t, r) for t, r in EDGE_RULES.items()]
    return F.array_compact(F.array(*found, F.when(contains_any(F.lower(target), NODE_WORDS), "business_keyword_hit")))


def propagate_backend_risk(symbols: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """Impact of changed back-end symbols along outgoing edges, with the rules met on the way.

    symbols: symbol_id, node_id, symbol_type, attributes, text. edges: source,
    target, edge_type, confidence, evidence. Rows as of propagate_risk(), with
    rule_hits.
    """
    rules = origin_rules(F.col("symbol_type"), F.col("attributes"), F.col("text"))
    origin = symbols.withColumn("r", rules).select(
        "symbol_id",
        F.col("node_id").alias("node"),
        F.array("node_id").alias("path"),
        F.lit(0).alias("depth"),
        F.when(F.col("symbol_type").isin(*HIGH_TYPES) | (F.size("r") > 0), "high").otherwise("medium").alias("risk"),
        F.lit("high").alias("confidence"),
        F.concat_ws(" ", F.lit("changed"), "symbol_type").alias("evidence"),
        F.lit(False).alias("needs_human_review"),
        F.when(F.size("r") > 0, F.col("r")).otherwise(F.array(F.lit("backend_symbol_changed"))).alias("rule_hits"),
    )
    out = _cut(origin)
    front = out.select("symbol_id", "node", "path", F.col("rule_hits").alias("rules"))
    visited = out.select("symbol_id", "node")
    step = edges.select(F.col("source").alias("near"), F.col("target").alias("far"), "edge_type", F.col("confidence").alias("edge_confidence"), F.col("evidence").alias("edge_evidence"))
    more = edge_rules(F.col("edge_type"), F.col("far"))
    for d in range(1, depth + 1):
        front = _cut(_hop(front, step, visited, (F.concat("rules", more).alias("rules"), F.col("edge_type"), F.col("edge_confidence"), F.col("edge_evidence"))))
        marked = F.col("edge_type").isin(*EDGE_RULES) | F.array_contains("rules", "business_keyword_hit")
        risk = F.when(marked, "high").otherwise("medium" if d <= 2 else "low")
        own = F.when(marked, "high" if d <= 1 else "medium").otherwise("high" if d <= 1 else "medium" if d == 2 else "low")
        rows = front.select(
            "symbol_id",
            "node",
            "path",
            F.lit(d).alias("depth"),
            risk.alias("risk"),
            min_confidence(own, F.col("edge_confidence")).alias("confidence"),
            F.col("edge_evidence").alias("evidence"),
            ((F.col("edge_confidence") != "high") | F.lit(d >= 2)).alias("needs_human_review"),
            F.array_sort(F.array_distinct("rules")).alias("rule_hits"),
        )
        out = out.unionByName(rows)
        visited = visited.unionByName(front.select("symbol_id", "node"))
        front = front.select("symbol_id", "node", "path", "rules")
    return out


def importers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, source of distinct direct importers of targets (column target)."""
    own = edges.filter("edge_type = 'imports'") if "edge_type" in edges.columns else edges
    return own.join(targets.select("target").distinct(), "target", "left_semi").select("target", "source").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree over all edges, counted at both ends; repeated edges count."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def node_context(edges: DataFrame) -> DataFrame:
    """node, community, language, degree, is_test by the path and degree of each file."""
    return degrees(edges).select("node", dirname(F.col("node")).alias("community"), extension(F.col("node")).alias("language"), "degree", F.contains(F.lower("node"), F.lit("test")).alias("is_test"))


def surprise(edges: DataFrame, nodes: DataFrame, least: float = 0.35) -> DataFrame:
    """Edges (source, target, edge_type, source_kind) scored by what sets their ends apart.

    nodes: node, community, language, degree, is_test; missing ones count as
    unknown. Of a repeated edge the first by seq counts
    (where edges have it, then by the other columns). suspicious is a score of
    `least` or more; reasons tells the rules met.
    """
    mid = nodes.agg(F.when(F.count("degree") >= 2, F.median("degree")).alias("median"))
    side = lambda p: nodes.select(F.col("node").alias(p), F.struct("community", "language", "degree", "is_test").alias(f"{p}_n"))
    once = first_of(edges, ["source", "target"])
    both = once.join(side("source"), "source", "left").join(side("target"), "target", "left").join(F.broadcast(mid))  # one row
    s, t = F.col("source_n"), F.col("target_n")
    known = s.community.isNotNull() & t.community.isNotNull()
    apart = F.when(known, s.community != t.community).otherwise(dirname(F.col("source").cast("string")) != dirname(F.col("target").cast("string")))
    a, b = extension(F.col("source").cast("string")), extension(F.col("target").cast("string"))
    a = F.coalesce(s.language, a)
    b = F.coalesce(t.language, b)
    hub = (s.degree <= 2) & (t.degree >= F.col("median") * 3)
    test = F.coalesce(s.is_test, F.lit(False)) != F.coalesce(t.is_test, F.lit(False))
    kind = F.col("source_kind") if "source_kind" in edges.columns else F.lit("")
    rules = [
        ("cross-community", 0.30, apart),
        ("cross-language", 0.20, (a != "") & (b != "") & (a != b)),
        ("edge-to-hub", 0.20, hub),
        ("cross-test-boundary", 0.15, test),
        ("bad-edge-type", 0.15, (F.col("edge_type") == "CALLS") & (kind == "Type")),
    ]
    score = F.bround(sum((F.when(c, w).otherwise(0.0) for _, w, c in rules), F.lit(0.0)), 4)
    reasons = F.array_compact(F.array(*(F.when(c, n) for n, _, c in rules)))
    return both.select("source", "target", score.alias("score"), reasons.alias("reasons"), (score >= least).alias("suspicious"))


def path_edges(paths: DataFrame) -> DataFrame:
    """source, target of neighbours on paths (path_id, path), the first path of each kept.

    The least of texts is found by sorting. Edges are dealt out before that, so
    that each is sorted once, in a small part; else a scan's rows would be
    sorted, and spilled, as well. Up to `PARTS` parts are dealt without a sort.
    """
    n = F.size("path")
    pairs = F.arrays_zip(F.slice("path", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("s"), F.slice("path", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("t"))
    long = paths.filter(n >= 2).select("path_id", F.explode(pairs).alias("p")).select("path_id", F.col("p.s").alias("source"), F.col("p.t").alias("target"))
    parts = max(PARTS, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return long.repartition(parts, "source", "target").groupBy("source", "target").agg(F.min("path_id").alias("path_id")).withColumn("edge_type", F.lit("CALLS"))


def bridges(paths: DataFrame, least: int = 2) -> DataFrame:
    """node, n_paths of nodes inside at least `least` paths."""
    inner = paths.filter(F.size("path") > 2).select("path_id", F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("node"))
    return inner.groupBy("node").agg(F.countDistinct("path_id").alias("n_paths")).filter(F.col("n_paths") >= least)


def untested_hotspots(nodes: DataFrame, tests: DataFrame, least: int = 5) -> DataFrame:
    """Nodes of degree `least` or more that are no tests, if there are no related tests at all; unknown ones count as tests."""
    none = tests.agg((F.count("*") == 0).alias("none"))
    return nodes.join(F.broadcast(none)).filter(F.col("none") & ~F.coalesce("is_test", F.lit(True)) & (F.col("degree") >= least)).drop("none")


def review_questions(edges: DataFrame, spots: DataFrame, bridge: DataFrame, each: int = 3, most: int = 7) -> DataFrame:
    """Up to `most` questions: surprising edges by score, untested hotspots by degree, bridges by paths."""
    parts = [
        (edges.filter("suspicious").orderBy(F.desc("score"), "source", "target").limit(each), F.format_string("Why does %s depend on %s?", "source", "target"), F.col("score")),
        (spots.orderBy(F.desc("degree"), "node").limit(each), F.format_string("What tests cover %s?", "node"), F.col("degree").cast("double")),
        (bridge.orderBy(F.desc("n_paths"), "node").limit(each), F.format_string("What breaks if %s changes?", "node"), F.col("n_paths").cast("double")),
    ]
    out = None
    for k, (df, text, weight) in enumerate(parts):
        one = df.select(F.lit(k).alias("kind"), weight.alias("weight"), text.alias("question"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("kind", F.desc("weight"), "question").limit(most)


def augment_paths(paths: DataFrame, hits: DataFrame) -> DataFrame:
    """Paths and, for files that no path ends in, one path of the hit alone at low risk and confidence."""
    ends = paths.select(F.element_at("path", -1).alias("file")).distinct()
    extra = hits.select("file").distinct().join(ends, "file", "left_anti")
    return paths.unionByName(extra.select(F.array("file").alias("path"), F.lit("low").alias("risk"), F.lit("low").alias("confidence")), allowMissingColumns=True)


def method_index(nodes: DataFrame) -> DataFrame:
    """name, node_id: full names `Type.method` of the last node, short names of the first."""
    full = nodes.groupBy(F.concat_ws(".", "class_name", "symbol").alias("name")).agg(F.max_by("node_id", "seq").alias("node_id"))
    short = nodes.groupBy(F.col("symbol").alias("name")).agg(F.min_by("node_id", "seq").alias("node_id"))
    return full.unionByName(short.join(full, "name", "left_anti"))


def resolve_calls(calls: DataFrame, index: DataFrame) -> DataFrame:
    """Calls (source, field_type, method, evidence) as edges: `Type.method` if known, else the method's name; none to itself."""
    named = lambda n: index.select(F.col("name").alias(n), F.col("node_id").alias(f"{n}_id"))
    keyed = calls.withColumns({"full": F.concat_ws(".", "field_type", "method"), "short": F.col("method")})
    found = keyed.join(named("full"), "full", "left").join(named("short"), "short", "left").withColumn("target", F.coalesce("full_id", "short_id"))
    return found.filter("target is not null and target <> source").select("source", "target", F.lit("calls").alias("edge_type"), "evidence", F.lit("medium").alias("confidence"))


def upsert_nodes(nodes: DataFrame, seq: str = "seq", key: str = "id") -> DataFrame:
    """The last row of each node."""
    last = Window.partitionBy(key).orderBy(F.desc(seq))
    return nodes.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")

"""Verdicts, queues, checkpoints and impact summaries over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ranks import first_best, risk_name, risk_rank, risk_weight
from riskloom.functions.text import contains_any

#: Fixed values. `userId` never hits, as texts are in lower case; it is kept so.
BLOCK_WORDS = ("header", "request", "auth", "permission", "token", "cookie", "userId")
#: Fixed values.
AUTH_WORDS = ("auth", "permission", "login", "logout", "权限", "登录")
#: Checkpoints in order, with their words.
CHECKPOINTS = {
    "请求上下文": ("header", "request", "context", "userid", "token", "cookie"),
    "状态同步": ("store", "state", "sync", "init", "初始化", "持久化"),
    "页面跳转": ("router", "redirect", "navigate", "跳转", "回首页"),
    "异常处理": ("loading", "error", "catch", "exception", "失败", "恢复"),
    "权限/登录态": ("auth", "permission", "login", "logout", "权限", "登录"),
    "测试覆盖": ("test", "spec", "assert", "断言", "覆盖"),
    "类型/空值": ("null", "undefined", "type", "类型", "空值"),
    "样式/布局": ("css", "style", "layout", "class", "样式"),
    "性能/重复请求": ("debounce", "throttle", "duplicate", "重复", "防抖"),
}


def union_findings(*lists: DataFrame) -> DataFrame:
    """All rows of several lists, with list_no so that their order is kept."""
    out = None
    for n, df in enumerate(lists):
        one = df.withColumn("list_no", F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def sort_by_risk(items: DataFrame, seq: str = "seq", unknown: int = 3) -> DataFrame:
    return items.orderBy(risk_rank(F.col("risk"), unknown), seq)


def risk_counts(items: DataFrame, *by: str) -> DataFrame:
    """n_high, n_medium and n_low of each group."""
    return items.groupBy(*by).agg(*(F.count_if(F.col("risk") == r).alias(f"n_{r}") for r in ("high", "medium", "low")))


def finding_text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def verdicts(items: DataFrame, *by: str) -> DataFrame:
    """verdict of each group: block, fix, watch or pass.

    A high finding blocks if no human need look at it and its reason or evidence
    has a block word; other high ones ask for a fix, medium ones for attention.
    """
    hits = contains_any(finding_text("reason", "evidence"), BLOCK_WORDS)
    high = F.col("risk") == "high"
    flags = items.groupBy(*by).agg(
        F.bool_or(high & ~F.coalesce("needs_human_review", F.lit(False)) & hits).alias("_block"),
        F.bool_or(high).alias("_high"),
        F.bool_or(F.col("risk") == "medium").alias("_medium"),
    )
    label = F.when(F.col("_block"), "block").when(F.col("_high"), "fix").when(F.col("_medium"), "watch").otherwise("pass")
    return flags.select(*by, label.alias("verdict"))


def web_verdicts(items: DataFrame, *by: str) -> DataFrame:
    """critical, needs_review or pass."""
    worst = F.min(risk_rank(F.col("risk"), 3))
    return items.groupBy(*by).agg(F.when(worst == 0, "critical").when(worst == 1, "needs_review").otherwise("pass").alias("verdict"))


def has_high(items: DataFrame) -> DataFrame:
    """One row: does a finding of high risk stop the gate? False for no findings."""
    return items.agg(F.coalesce(F.bool_or(F.col("risk") == "high"), F.lit(False)).alias("stop"))


def fix_class(items: DataFrame) -> DataFrame:
    """Add mode and impact of a fix. needs_human_review is null for findings that have no such field."""
    human, kind = F.coalesce("needs_human_review", F.lit(False)), F.coalesce("issue_type", F.lit(""))
    auth = contains_any(finding_text("reason", "description"), AUTH_WORDS)
    high = F.col("risk") == "high"
    mode = (
        F.when(human, "manual")
        .when((kind == "missing_error_handling") & ~auth, "auto")
        .when(kind.isin("redundant", "dead_code"), "auto")
        .when(F.col("needs_human_review").isNotNull(), "assist")
        .otherwise("manual")
    )
    impact = (
        F.when(human, F.when(high, "blocking").otherwise("high_value"))
        .when((kind == "missing_error_handling") & ~auth, "advised")
        .when(kind.isin("redundant", "dead_code"), "later")
        .when(F.col("needs_human_review").isNotNull(), F.when(high, "high_value").otherwise("advised"))
        .otherwise("advised")
    )
    return items.withColumns({"mode": mode, "impact": impact})


def fix_queue(items: DataFrame, *by: str, seq: str = "seq") -> DataFrame:
    """Findings with a suggestion or of high risk, numbered from 1 by risk within each group."""
    kept = fix_class(items).filter((F.coalesce("suggestion", F.lit("")) != "") | (F.col("risk") == "high"))
    order = Window.partitionBy(*by).orderBy(risk_rank(F.col("risk"), 3), seq)
    numbered = kept.withColumn("id", F.row_number().over(order).cast("long"))
    verb = F.when(F.col("mode") == "auto", F.format_string("fix %d", "id")).when(F.col("mode") == "assist", F.format_string("fix %d --preview", "id")).otherwise(F.format_string("detail %d", "id"))
    return numbered.withColumn("command_hint", verb)


def queue_item(queue: DataFrame, number: int) -> DataFrame:
    return queue.filter(F.col("id") == number).limit(1)


def checkpoint_mode(human: Column, kind: Column, reason: Column) -> Column:
    auth = contains_any(F.lower(F.coalesce(reason, F.lit(""))), AUTH_WORDS)
    return F.when(F.coalesce(human, F.lit(False)), "manual").when(kind == "missing_error_handling", F.when(auth, "manual").otherwise("auto")).otherwise("assist")


def checkpoints(items: DataFrame, words: dict[str, Sequence[str]] | None = None, seq: str = "seq") -> DataFrame:
    """One row per checkpoint: place, name, status, reason, evidence, fix_mode.

    The representative is the first finding of highest risk whose text has one
    of the words; without one the status is ok. Each finding is tested against
    every word in its own row, so the few checkpoints cost no join.
    """
    table = words or CHECKPOINTS
    text = finding_text("reason", "description", "evidence")
    hits = F.array(*(F.when(contains_any(text, w), F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"))) for i, (n, w) in enumerate(table.items())))
    long = items.withColumn("_c", F.explode(F.array_compact(hits)))
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise(F.coalesce("description", F.lit("")))
    row = F.struct(
        F.col("risk").alias("status"),
        reason.alias("reason"),
        F.concat_ws(":", "file", "line").alias("evidence"),
        checkpoint_mode(F.col("needs_human_review"), F.col("issue_type"), F.col("reason")).alias("fix_mode"),
    )
    best = long.groupBy("_c.place", "_c.name").agg(first_best(row, -risk_weight(F.col("risk")), F.col(seq)).alias("b"))
    all_ = items.sparkSession.createDataFrame([(i, n) for i, n in enumerate(table)], "place int, name string")
    ok = F.struct(F.lit("ok").alias("status"), F.lit("no evident risk").alias("reason"), F.lit("-").alias("evidence"), F.lit("-").alias("fix_mode"))
    return all_.join(best, ["place", "name"], "left").withColumn("b", F.coalesce("b", ok)).select("place", "name", "b.*")


def contract_checkpoint(items: DataFrame, name: str, seq: str = "seq", counts_low: bool = False) -> DataFrame:
    """One row for migration or API findings: the first of highest risk, to be fixed by hand; ok without any.

    With counts_low, as for APIs, findings of which none is high give their
    number, status low and the first one's file.
    """
    best = first_best(F.struct("risk", "reason", F.concat_ws(":", "file", "line").alias("evidence")), -risk_weight(F.col("risk")), F.col(seq))
    worst = items.agg(F.count("*").alias("n"), best.alias("b"), F.min_by("file", F.struct(seq, "file")).alias("f"), F.count_if(F.col("risk") == "high").alias("n_high"))
    none = F.col("n") == 0
    low = ~none & (F.col("n_high") == 0) & F.lit(counts_low)
    return worst.select(
        F.lit(name).alias("name"),
        F.when(none, "ok").when(low, "low").otherwise(F.col("b.risk")).alias("status"),
        F.when(low, F.format_string("%d changes, none of high risk", "n")).otherwise(F.coalesce("b.reason", F.lit("no change"))).alias("reason"),
        F.when(low, F.col("f")).otherwise(F.coalesce("b.evidence", F.lit("-"))).alias("evidence"),
        F.when(none | low, "-").otherwise("manual").alias("fix_mode"),
        "n",
    )


def best_paths(paths: DataFrame, top: int = 25, end: str = "endpoint", seq: str = "seq") -> DataFrame:
    """The best path of each endpoint, by risk and then order, and the best of these."""
    by = Window.partitionBy(end).orderBy(risk_rank(F.col("risk"), 3), seq)
    return paths.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n").orderBy(risk_rank(F.col("risk"), 3), seq).limit(top)


def impact_blocks(paths: DataFrame, findings: DataFrame, seq: str = "seq") -> DataFrame:
    """source, risk, chains of paths of two nodes or more; chain nodes carry their file's first finding of least rank."""
    best = findings.groupBy("file").agg(first_best(F.struct("line", "reason", "risk"), risk_rank(F.col("risk"), 2), F.col(seq)).alias("f"))
    long = paths.filter(F.size("path") >= 2).select("path_id", "risk", F.element_at("path", 1).alias("source"), F.posexplode("path").alias("at", "file"))
    node = F.struct("at", "file", F.coalesce("f.line", F.lit(0)).alias("line"), F.coalesce("f.reason", F.lit("")).alias("reason"), F.coalesce("f.risk", F.lit("low")).alias("risk"))
    chains = long.join(best, "file", "left").withColumn("node", node).groupBy("path_id", "risk", "source").agg(F.sort_array(F.collect_list("node")).alias("chain"))
    return chains.groupBy("source").agg(risk_name(F.min(risk_rank(F.col("risk"), 2))).alias("risk"), F.sort_array(F.collect_list(F.struct("path_id", "chain"))).alias("chains"))


def blast_clusters(paths: DataFrame, seq: str = "seq") -> DataFrame:
    """source, endpoint, risk: the best path of each endpoint other than the source itself."""
    pairs = paths.select("*", F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("endpoint")).filter("source <> endpoint")
    by = Window.partitionBy("source", "endpoint").orderBy(risk_rank(F.col("risk"), 3), seq)
    return pairs.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def merged_chains(paths: DataFrame) -> DataFrame:
    """The tree of all paths: one row per distinct prefix, with its depth and node."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    tree = paths.filter(F.size("path") > 0).select(F.explode(prefixes).alias("prefix"), "path_id")
    return tree.groupBy("prefix").agg(F.min("path_id").alias("first_path")).select("prefix", F.size("prefix").alias("depth"), F.element_at("prefix", -1).alias("node"), "first_path")


def rule_set(paths: DataFrame) -> DataFrame:
    """All distinct rules of paths, sorted, one row."""
    return paths.select(F.explode("rule_hits").alias("r")).agg(F.array_sort(F.collect_set("r")).alias("rules"))


def minimal_context(findings: DataFrame, paths: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: n_high, n_medium, the first three high reasons (80 characters), ten first distinct endpoints."""
    high = findings.filter("risk = 'high'").orderBy(seq).limit(3)
    reasons = high.agg(F.transform(F.sort_array(F.collect_list(F.struct(seq, F.substring("reason", 1, 80).alias("t")))), lambda x: x.t).alias("key_risks"))
    counts = findings.agg(F.count_if(F.col("risk") == "high").alias("n_high"), F.count_if(F.col("risk") == "medium").alias("n_medium"))
    ends = paths.select(F.element_at("path", -1).alias("e"), seq).groupBy("e").agg(F.min(seq).alias("s")).orderBy("s").limit(10)
    ends = ends.agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "e"))), lambda x: x.e).alias("endpoints"))
    return counts.join(F.broadcast(reasons)).join(F.broadcast(ends))  # one row each


def savings(phases: DataFrame, *by: str) -> DataFrame:
    """baseline, used, saved and saved_percent over phases with a baseline."""
    from riskloom.functions.text import saved_percent

    kept = phases.filter("baseline > 0").groupBy(*by).agg(F.sum("baseline").alias("baseline"), F.sum("used").alias("used"))
    return kept.select("*", F.greatest(F.col("baseline") - F.col("used"), F.lit(0)).alias("saved"), saved_percent(F.col("baseline"), F.col("used")).alias("saved_percent"))


def verification_split(findings: DataFrame) -> DataFrame:
    """Add uncertain: high risk that is not of high confidence goes to verification."""
    return findings.withColumn("uncertain", (F.col("risk") == "high") & (F.coalesce("confidence", F.lit("")) != "high"))


def after_verification(findings: DataFrame, replies: DataFrame, seq: str = "seq") -> DataFrame:
    """Findings with verdict rows (index, confirmed, reason) on the uncertain ones: certain ones first, then those not refuted."""
    split = verification_split(findings)
    doubt = split.filter("uncertain").withColumn("index", F.row_number().over(Window.partitionBy("group_id").orderBy(seq)) - 1)
    checked = doubt.join(replies.withColumnRenamed("reason", "adv_reason"), ["group_id", "index"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(True)))
    sure = split.filter("not uncertain").withColumn("confirmed", F.lit(True))
    return sure.unionByName(checked, allowMissingColumns=True)


def inline_comments(findings: DataFrame, least: str = "medium") -> DataFrame:
    """Findings that may be posted beside a line: of enough risk, with a file and a line."""
    floor = {"high": 2, "medium": 1, "low": 0}.get(least, 1)
    kept = findings.filter((risk_weight(F.col("risk")) - 1 >= floor) & (F.coalesce("file", F.lit("")) != "") & (F.coalesce("line", F.lit(0)) > 0))
    body = F.concat_ws("\n\n", F.concat(F.lit("["), F.upper("risk"), F.lit("] "), F.col("reason")), F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("Suggestion: "), "suggestion")))
    return kept.withColumn("body", body)


def summary_comment(findings: DataFrame, *by: str, top: int = 10, seq: str = "seq") -> DataFrame:
    """Counts, verdict and up to ten findings by risk as a text, per group."""
    order = Window.partitionBy(*by).orderBy(risk_rank(F.col("risk"), 3), seq)
    line = F.format_string("- [%s] %s:%s %s", "risk", "file", F.col("line").cast("string"), "reason")
    lines = findings.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top)
    listed = lines.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", line.alias("t")))), lambda x: x.t), "\n").alias("lines"))
    heads = risk_counts(findings, *by).join(web_verdicts(findings, *by), list(by))
    head = F.format_string("%s: %d high, %d medium, %d low", "verdict", "n_high", "n_medium", "n_low")
    return heads.join(listed, list(by)).withColumn("body", F.concat_ws("\n", head, "lines"))


def issue_mode(human: Column, kind: Column) -> Column:
    return F.when(F.coalesce(human, F.lit(False)), "manual").when(F.coalesce(kind, F.lit("")).isin("missing_error_handling", "redundant", "dead_code"), "auto").otherwise("assist")


def web_issues(items: DataFrame, *by: str, seq: str = "seq") -> DataFrame:
    """Findings as numbered issues by risk: id, title of 120 characters, mode."""
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise(F.coalesce("description", F.lit("")))
    number = F.row_number().over(Window.partitionBy(*by).orderBy(risk_rank(F.col("risk"), 3), seq)).cast("long")
    return items.select("*", number.alias("id"), F.substring(reason, 1, 120).alias("title"), issue_mode(F.col("needs_human_review"), F.col("issue_type")).alias("mode"))


def with_candidates(items: DataFrame, queue: DataFrame, keys: Sequence[str] = ("file", "line")) -> DataFrame:
    """Findings with the id and mode of the first candidate of their file and line, null for none."""
    first = queue.groupBy(*keys).agg(F.min(F.struct("id", "mode")).alias("c"))
    return items.join(first, list(keys), "left").withColumns({"fix_id": F.col("c.id"), "fix_mode": F.col("c.mode")}).drop("c")


def cluster_nodes(clusters: DataFrame, findings: DataFrame, symbols: DataFrame, seq: str = "seq") -> DataFrame:
    """Cluster rows with the first finding of the endpoint's file and the source's symbol: the last one, else the file's name."""
    first = findings.groupBy(F.col("file").alias("endpoint")).agg(F.min_by(F.struct("line", "reason"), seq).alias("f"))
    names = symbols.groupBy(F.col("file").alias("source")).agg(F.max_by("symbol", seq).alias("symbol"))
    both = clusters.join(first, "endpoint", "left").join(names, "source", "left")
    label = F.coalesce("symbol", F.element_at(F.split("source", "/"), -1))
    return both.select(*clusters.columns, label.alias("label"), F.coalesce("f.line", F.lit(0)).alias("line"), F.coalesce("f.reason", F.lit("")).alias("reason"))


def standard_context(minimal: DataFrame, snippets: DataFrame) -> DataFrame:
    """The minimal context with snippets (file, s, text) as one array."""
    rows = snippets.agg(F.sort_array(F.collect_list(F.struct("file", "s", "text"))).alias("snippets"))
    return minimal.join(F.broadcast(rows))  # one row each


def verbose_context(standard: DataFrame, diff: DataFrame, paths: DataFrame) -> DataFrame:
    """The standard context with the diff (one row) and all chains of the paths."""
    one = F.lit(1).alias("_one")  # one row each, of any size: Spark broadcasts what is small
    chains = paths.agg(F.sort_array(F.collect_list(F.array_join("path", " → "))).alias("chains")).select("chains", one)
    return standard.select("*", one).join(diff.select("text", one), "_one").join(chains, "_one").drop("_one")


def adversarial_context(findings: DataFrame, symbols: DataFrame, callers: DataFrame, each: int = 3, lines: int = 30) -> DataFrame:
    """symbol, text: up to three callers of the symbols in the files of uncertain findings, thirty lines in all."""
    files = verification_split(findings).filter("uncertain").select("file").distinct()
    wanted = symbols.join(files, "file", "left_semi").select("symbol").distinct()
    order = Window.partitionBy("symbol").orderBy("order")
    some = callers.join(wanted, "symbol", "left_semi").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= each)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "file", "line", "snippet"))), lambda x: F.concat_ws(":", x.file, x.line, x.snippet)), "\n")
    return some.groupBy("symbol").agg(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n").alias("text"))


def send_comments(comments: DataFrame, send) -> None:
    """Call send(rows) with an iterator over the comments of each partition, on the executors; what it does is up to the caller."""
    comments.foreachPartition(send)

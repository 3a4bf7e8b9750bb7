"""Model replies and context documents: the parts around a call that are data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ranks import risk_rank
from riskloom.functions.text import json_array_in

#: Fields of findings in replies and what stands for missing ones.
FINDING = {"file": "", "line": "0", "symbol": "", "risk": "low", "confidence": "medium", "reason": "", "suggestion": None, "needs_human_review": "false"}
QUALITY = {"file": "", "line": "0", "issue_type": "", "description": "", "evidence": "", "risk": "low", "confidence": "medium", "suggestion": None}
BACKEND = {"file": "", "line": "0", "symbol": "", "risk": "low", "confidence": "medium", "category": "", "reason": "", "evidence": "", "suggestion": None, "needs_human_review": "false"}


def parse_reply(replies: DataFrame, fields: dict[str, str | None] = FINDING, text_col: str = "reply") -> DataFrame:
    """One row per object of the JSON array in each reply, with defaults; seq is its place.

    Text around the array is left out. No array, bad JSON and members that are
    no objects give nothing. A line that is no number is 0.
    """
    keyed = replies.withColumn("_a", F.from_json(json_array_in(F.col(text_col)), "array<string>"))
    rest = [c for c in replies.columns if c != text_col]
    objects = keyed.select(*rest, F.posexplode("_a").alias("seq", "o")).filter(F.col("o").rlike(r"^\s*\{"))

    def value(name: str, default: str | None) -> Column:
        text = F.get_json_object("o", f"$.{name}")
        whole = F.coalesce(text, F.lit(default)) if default is not None else text
        if name == "line":
            return F.coalesce(whole.try_cast("int"), F.lit(0)).alias(name)
        if name == "needs_human_review":
            return F.coalesce(whole.try_cast("boolean"), F.lit(False)).alias(name)
        return whole.alias(name)

    return objects.select(*rest, "seq", *(value(n, d) for n, d in fields.items()))


def prompt(packs: DataFrame, instructions: str, text_col: str = "diff", limit: int = 120_000) -> DataFrame:
    """Packs with a prompt of instructions, the pack as JSON and the diff; a diff over `limit` characters raises."""
    guarded = F.when(F.length(text_col) > limit, F.raise_error(F.lit("the diff is too long"))).otherwise(F.col(text_col))
    return packs.withColumn("prompt", F.concat_ws("\n\n", F.lit(instructions), "pack", guarded))


def ask(prompts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Prompts with the reply of a given function; no model is built in."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(model)

    return prompts.withColumn("reply", run("prompt"))


def context_pack(paths: DataFrame, by: str = "pack_id", top: int = 25, seq: str = "seq") -> DataFrame:
    """One JSON document per pack with its best path of each endpoint, by risk."""
    end = Window.partitionBy(by, F.element_at("path", -1)).orderBy(risk_rank(F.col("risk"), 3), seq)
    order = Window.partitionBy(by).orderBy(risk_rank(F.col("risk"), 3), seq)
    best = paths.withColumn("_n", F.row_number().over(end)).filter("_n = 1").withColumn("_m", F.row_number().over(order)).filter(F.col("_m") <= top)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("_m", "path", "risk", "confidence"))), lambda x: F.struct(x.path.alias("path"), x.risk.alias("risk"), x.confidence.alias("confidence")))
    return best.groupBy(by).agg(F.to_json(F.struct(rows.alias("impact_paths"))).alias("pack"))


def review_focus(paths: DataFrame, *by: str) -> DataFrame:
    """What a review should look at, from rules and risks of paths."""
    rule = lambda r: F.bool_or(F.array_contains("rule_hits", r))
    flags = [("auth paths", rule("auth_path_changed")), ("database writes", rule("db_write_path")), ("external calls", rule("external_api_path")), ("endpoints", rule("endpoint_path")), ("high risk", F.bool_or(F.col("risk") == "high"))]
    return paths.groupBy(*by).agg(F.concat_ws(", ", *(F.when(c, n) for n, c in flags)).alias("focus"))


def reassembled(lines: DataFrame, by: str) -> DataFrame:
    """Texts from lines (pos, line)."""
    return lines.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("text"))


def backend_pack(paths: DataFrame, edges: DataFrame, snippets: DataFrame, by: str = "pack_id", sizes: tuple[int, int, int] = (25, 30, 12), seq: str = "seq") -> DataFrame:
    """One JSON document per pack: paths by risk, edges with sure ones first, snippets in order."""

    def first(df: DataFrame, order: list, n: int, name: str, columns: list[str]) -> DataFrame:
        ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= n)
        row = F.struct("_n", F.struct(*columns).alias("r"))
        return ranked.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x.r).alias(name))

    one = first(paths, [risk_rank(F.col("risk"), 3), F.col(seq)], sizes[0], "impact_paths", ["path", "risk", "confidence", "rule_hits"])
    two = first(edges, [F.when(F.col("confidence") == "high", 0).otherwise(1), F.col(seq)], sizes[1], "edges", ["source", "target", "edge_type", "confidence"])
    three = first(snippets, [F.col(seq)], sizes[2], "snippets", ["file", "text"])
    rules = paths.groupBy(by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("rule_hits")))).alias("rules"))
    both = one.join(two, by, "left").join(three, by, "left").join(rules, by)
    return both.select(by, F.to_json(F.struct("impact_paths", "edges", "snippets", "rules")).alias("pack"))


#: Parts of names of models that cannot chat.
NO_CHAT = ("embedding", "whisper", "tts-", "dall-e", "moderation", "babbage", "davinci-002", "ada-", "curie-")


def chat_models(models: DataFrame, leave_out: tuple[str, ...] = NO_CHAT) -> DataFrame:
    """Names of models that can chat, sorted."""
    from riskloom.functions.text import contains_any

    return models.filter(~contains_any(F.lower("name"), leave_out)).orderBy("name")

"""Whole reviews: from diffs and files to findings, impact and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators import contracts, findings, graph, intervals, languages, rules
from riskloom.sources import diff as D
from riskloom.sources.store import checkpointed


def script_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JavaScript, TypeScript and Vue files: files, exports, imports."""
    exports = languages.script_exports(files)
    named = exports.withColumn("id", F.concat_ws(":", "file", "name"))
    own = files.select(F.col("file").alias("id"), F.lit("file").alias("node_type"), "file", F.col("file").alias("name"), F.lit(0).alias("line"))
    nodes = own.unionByName(named.select("id", "node_type", "file", "name", "line"))
    edges = languages.script_imports(files).unionByName(named.select(F.col("file").alias("source"), F.col("id").alias("target"), F.lit("exports").alias("edge_type")))
    return nodes, edges


def code_graph(files: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of back-end files of several languages, in one plan each.

    Lexed lines are written, as declarations, bodies and routes read them, and
    so are symbols, as every kind of edge reads them.
    """
    nodes = checkpointed(languages.code_symbols(files, names, checkpointed(languages.lexed_files(files, names))))
    return nodes, languages.code_edges(files, nodes, names)


def changed_code(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that a diff's changed lines lie in, with its diff_id: the innermost one of each line, once."""
    points = D.changed_lines(lines).select("diff_id", "file", F.col("line").alias("p"))
    spans = symbols.withColumns({"s": F.col("start_line"), "e": F.col("end_line")})
    found = intervals.innermost(points, spans, ["file"])
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("diff_id", "node_id").orderBy("start_line", "end_line")))
    return ranked.filter("_n = 1").select("diff_id", *symbols.columns)


def changed_scripts(lines: DataFrame, files: DataFrame) -> DataFrame:
    """diff_id, file, symbol, symbol_type, start_line, change_type: the declaration at or before each changed line, once.

    A symbol of a file that is new in the diff is added, others are modified.
    """
    points = D.changed_lines(lines)
    marks = languages.declarations(files).withColumn("start_line", F.col("line"))
    found = intervals.nearest_before(points, marks, ["file"], "line", ["symbol", "symbol_type", "start_line"]).filter("symbol is not null")
    new = D.diff_files(lines).select("diff_id", F.col("path").alias("file"), "is_new_file")
    kind = F.when(F.coalesce("is_new_file", F.lit(False)), "added").otherwise("modified")
    return found.join(new, ["diff_id", "file"], "left").select("diff_id", "file", "symbol", "symbol_type", "start_line", kind.alias("change_type")).distinct()


def static_review(diffs: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """diff_id, file, line, risk, kind, what: findings of each diff without a model.

    specs: file, old, new of OpenAPI documents, with diff_id where they belong
    to a diff. Diffs are judged apart, also where they touch the same path.
    """
    lines = D.diff_lines(diffs)
    own = rules.migration_findings(lines).select("diff_id", F.col("path").alias("file"), "line", "risk", F.lit("migration").alias("kind"), F.concat_ws(" ", "operation", "table", "column").alias("what"))
    what = F.concat_ws(" ", "change_type", "item").alias("what")
    api = contracts.proto_findings(lines).select("diff_id", F.col("path").alias("file"), F.lit(0).alias("line"), "risk", F.lit("api").alias("kind"), what)
    out = own.unionByName(api)
    if specs is not None:
        by = ("diff_id", "file") if "diff_id" in specs.columns else ("file",)
        more = contracts.openapi_findings(specs, by=by).select(*by, F.lit(0).alias("line"), "risk", F.lit("api").alias("kind"), what)
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def gate(diffs: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """One row: does a high finding stop the change?"""
    return findings.has_high(static_review(diffs, specs))


def impact(diffs: DataFrame, files: DataFrame, names: Sequence[str] = (), depth: int = 3) -> DataFrame:
    """Paths of what a diff's symbols reach, with its diff_id: importers of scripts, and callees of back-end code.

    Symbols that several diffs change are followed once.
    """
    lines = D.diff_lines(diffs)
    _, edges = script_graph(files)
    changed = changed_scripts(lines, files).withColumn("symbol_id", F.xxhash64("file", "symbol", "symbol_type", "start_line", "change_type"))
    symbols = changed.drop("diff_id").distinct()
    keep = ["symbol_id", "path", "depth", "risk", "confidence", "evidence", "needs_human_review"]
    front = graph.propagate_risk(symbols, edges.filter("edge_type = 'imports'"), depth).select(*keep)
    out = changed.select("diff_id", "symbol_id").join(front, "symbol_id")
    if names:
        nodes, links = code_graph(files, names)
        within = changed_code(lines, nodes).withColumn("symbol_id", F.xxhash64("node_id", "start_line"))
        once = within.select("symbol_id", "node_id", "symbol_type", "attributes", F.concat_ws(" ", "file", "symbol", "class_name").alias("text")).distinct()
        back = graph.propagate_backend_risk(once, links, depth + 1).select(*keep)
        out = out.unionByName(within.select("diff_id", "symbol_id").join(back, "symbol_id"))
    return out

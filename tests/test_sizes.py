"""Plans that stay bounded when tables grow: nothing of an input's size is broadcast, and what stands in one row is not joined."""

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_broadcast_no_tree(spark):
    from riskloom.operators.languages import script_imports

    files = spark.range(3).select(F.format_string("web/p%d.ts", "id").alias("file"), F.format_string("import { f } from './p%d'", F.col("id") + 1).alias("content"))
    out = script_imports(files)
    assert "Broadcast" not in plan(out)
    assert sorted((r.source, r.target) for r in out.collect()) == [("web/p0.ts", "web/p1.ts"), ("web/p1.ts", "web/p2.ts")]


def test_snippets_need_no_join(spark):
    from riskloom.operators.intervals import relevant_snippets

    lines = spark.range(1, 301).select(F.lit("f").alias("file"), F.col("id").alias("line"), F.concat(F.lit("l"), "id").alias("text"))
    symbols = spark.range(2).select(F.lit("f").alias("file"), (F.col("id") * 40 + 10).cast("int").alias("start_line"), (F.col("id") * 200 + 12).cast("int").alias("end_line"))
    out = relevant_snippets(symbols, lines)
    assert "Join" not in plan(out)
    rows = sorted((r.s, r.e, r.text) for r in out.collect())
    assert [(s, e) for s, e, _ in rows] == [(7, 15), (47, 196)]
    assert [t.split("\n") for *_, t in rows] == [[f"l{i}" for i in range(s, e + 1)] for s, e, _ in rows]


def test_symbol_ends_broadcast_no_symbols(spark):
    from riskloom.operators.intervals import symbol_end

    lines = spark.range(1, 5).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("line"), F.when(F.col("id") == 1, "a {").when(F.col("id") == 3, "}").otherwise("x").alias("text"))
    out = symbol_end(lines, spark.range(1).select(F.lit("f").alias("file"), F.lit(1).alias("start_line")))
    assert "Broadcast" not in plan(out)
    assert [r.end_line for r in out.collect()] == [3]


def test_documents_of_one_row_are_not_joined(spark):
    from riskloom.operators.contracts import openapi_findings

    old, new = '{"paths": {"/a": {"get": {}, "put": {}}, "/b": {"get": {}}}}', '{"paths": {"/a": {"get": {}}, "/c": {"get": {}}}}'
    out = openapi_findings(spark.range(2).select("id", F.lit(old).alias("old"), F.lit(new).alias("new")), by="id")
    assert "Join" not in plan(out)
    assert sorted((r.change_type, r.item) for r in out.filter("id = 1").collect()) == [("added_endpoint", "GET /c"), ("removed_endpoint", "/b"), ("removed_method", "PUT /a")]


def test_diffs_are_cut_in_their_rows(spark):
    from riskloom.sources.diff import diff_lines

    text = "before\ndiff --git a/x b/x\nnew file\n@@ -1 +1 @@\n-a\n+b\n@@ -9 +9 @@\n+c\ndiff --git a/y b/z\n"
    out = diff_lines(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "diff_id long, text string"))
    assert "Window" not in plan(out) and "Sort" not in plan(out)
    got = sorted((r.diff_id, r.pos, r.line[:4], r.old_path, r.path, r.block_line, r.hunk, r.kind) for r in out.collect())
    assert got == [
        (1, 1, "diff", "x", "x", 1, 0, "header"), (1, 2, "new ", "x", "x", 2, 0, "header"), (1, 3, "@@ -", "x", "x", 3, 1, "header"), (1, 4, "-a", "x", "x", 4, 1, "removed"), (1, 5, "+b", "x", "x", 5, 1, "added"),
        (1, 6, "@@ -", "x", "x", 6, 2, "header"), (1, 7, "+c", "x", "x", 7, 2, "added"), (1, 8, "diff", "y", "z", 1, 0, "header"), (1, 9, "", "y", "z", 2, 0, "context"),
    ]


def test_path_edges_are_sorted_after_they_are_dealt(spark):
    from riskloom.operators.graph import path_edges

    out = path_edges(spark.createDataFrame([("b", ["x", "y", "z"]), ("a", ["x", "y"]), ("c", ["y"]), ("d", [])], "path_id string, path array<string>"))
    assert "Sort" not in plan(out).split("Exchange", 1)[1]
    assert sorted((r.source, r.target, r.path_id) for r in out.collect()) == [("x", "y", "a"), ("y", "z", "b")]


def test_sides_of_a_field_meet_without_a_join(spark):
    from riskloom.operators.contracts import proto_findings

    rows = [(1, "-string a = 1;"), (2, "+int32 a = 1;"), (3, "-string b = 2;"), (4, "+string c = 2;"), (5, "-  OLD_ONE = 1;"), (6, "-  KEPT = 2;"), (7, "+  KEPT = 3;"), (8, "-string a = 9;")]
    out = proto_findings(spark.createDataFrame([("a.proto", *r) for r in rows], "path string, pos int, line string"), ("path",))
    assert plan(out).count("Join") <= 1 and "FullOuter" not in plan(out)
    assert sorted((r.change_type, r.item, r.risk) for r in out.collect()) == [("added_field", "c", "low"), ("changed_field_number", "a", "high"), ("removed_enum_value", "OLD_ONE", "high"), ("renamed_field", "b → c", "low")]

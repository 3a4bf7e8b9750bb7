"""Reviews from diff to verdict on a small tree."""

from pyspark.sql import functions as F

from riskloom.operators import findings as O
from riskloom.operators import intervals as I
from riskloom.plans import review as V
from riskloom.sources import diff as D

FILES = {
    "web/login.ts": "import { api } from './api'\nexport const login = async () => {\n  return api()\n}\n",
    "web/api.ts": "export function api() {\n  return 1\n}\nexport function other() {\n}\n",
    "web/page.vue": "<script>\nimport { login } from './login'\n</script>\n",
    "svc/OrderService.cs": "public class OrderService {\n  public void Save(int id) {\n    _db.SaveChanges();\n  }\n  public void Peek() {\n  }\n}\n",
}
DIFF = """diff --git a/web/api.ts b/web/api.ts
--- a/web/api.ts
+++ b/web/api.ts
@@ -1,3 +1,3 @@
 export function api() {
-  return 0
+  return 1
 }
diff --git a/svc/OrderService.cs b/svc/OrderService.cs
--- a/svc/OrderService.cs
+++ b/svc/OrderService.cs
@@ -3,1 +3,1 @@
-    _db.Save();
+    _db.SaveChanges();
diff --git a/db/1.sql b/db/1.sql
new file mode 100644
--- /dev/null
+++ b/db/1.sql
@@ -0,0 +1 @@
+DROP TABLE users;
diff --git a/a.proto b/a.proto
--- a/a.proto
+++ b/a.proto
@@ -1 +0,0 @@
-  string name = 1;"""


def inputs(spark):
    return spark.createDataFrame([(1, DIFF)], "diff_id long, text string"), spark.createDataFrame(list(FILES.items()), "file string, content string")


def test_static_review(spark):
    diffs, _ = inputs(spark)
    got = {(r.file, r.line, r.risk, r.what) for r in V.static_review(diffs).collect()}
    assert got == {("db/1.sql", 6, "high", "DROP TABLE users "), ("a.proto", 0, "high", "removed_field name")}
    assert V.gate(diffs).first().stop is True
    specs = spark.createDataFrame([("openapi.json", '{"paths": {"/a": {"get": {}}}}', '{"paths": {"/b": {"get": {}}}}')], "file string, old string, new string")
    assert V.static_review(diffs, specs).filter("file = 'openapi.json'").count() == 2
    assert V.gate(diffs.limit(0)).first().stop is False


def test_impact(spark):
    diffs, files = inputs(spark)
    got = {(">".join(r.path), r.depth, r.risk, r.confidence) for r in V.impact(diffs, files, ["csharp"]).collect()}
    assert got == {
        ("web/api.ts:api", 0, "high", "high"),
        ("web/api.ts:api>web/login.ts", 1, "high", "high"),
        ("web/api.ts:api>web/login.ts>web/page.vue", 2, "high", "medium"),
        ("svc/OrderService.cs:OrderService.Save", 0, "high", "high"),
        ("svc/OrderService.cs:OrderService.Save>db:svc/OrderService.cs:3", 1, "high", "high"),
    }


def test_graphs(spark):
    _, files = inputs(spark)
    nodes, edges = V.script_graph(files)
    assert {(r.source, r.target) for r in edges.filter("edge_type = 'imports'").collect()} == {("web/login.ts", "web/api.ts"), ("web/page.vue", "web/login.ts")}
    assert {r.id for r in nodes.filter("node_type <> 'file'").collect()} == {"web/login.ts:login", "web/api.ts:api", "web/api.ts:other"}
    changed = V.changed_code(D.diff_lines(inputs(spark)[0]), V.code_graph(files, ["csharp"])[0])
    assert [r.symbol for r in changed.collect()] == ["Save"]


def test_patch_from_diff(spark):
    text = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c"
    hunks = D.patch_hunks(D.diff_lines(spark.createDataFrame([(1, text)], "diff_id long, text string")))
    files = spark.createDataFrame([("f", ["x", "a", "b", "c"])], "path string, lines array<string>")
    assert D.apply_patch(hunks, files).first().lines == ["x", "a", "B", "c"]


def test_contexts(spark):
    items = spark.createDataFrame([(0, "a", 3, "low", "r0", None, None, True), (1, "a", 3, "high", "r1", "", "dead_code", False), (2, "b", 1, "high", None, "d" * 200, "", None)], "seq long, file string, line int, risk string, reason string, description string, issue_type string, needs_human_review boolean")
    issues = {r.id: (r.seq, r.mode, len(r.title)) for r in O.web_issues(items).collect()}
    assert issues == {1: (1, "auto", 2), 2: (2, "assist", 120), 3: (0, "manual", 2)}
    queue = O.fix_queue(items.withColumn("suggestion", F.lit("s")))
    assert {(r.seq, r.fix_id) for r in O.with_candidates(items, queue).collect()} == {(0, 1), (1, 1), (2, 2)}
    paths = spark.createDataFrame([(0, ["a", "b"], "high"), (1, ["a", "c"], "low")], "seq long, path array<string>, risk string")
    nodes = O.cluster_nodes(O.blast_clusters(paths), items, spark.createDataFrame([("a", "S", 0), ("a", "T", 1)], "file string, symbol string, seq long"))
    assert {(r.endpoint, r.label, r.line) for r in nodes.collect()} == {("b", "T", 1), ("c", "T", 0)}
    lines = spark.createDataFrame([("a", i, f"l{i}") for i in range(1, 60)], "file string, line int, text string")
    symbols = spark.createDataFrame([("a", 10, 12), ("a", 24, 25), ("a", 50, 51)], "file string, start_line int, end_line int")
    spans = I.relevant_snippets(symbols, lines)
    assert sorted((r.s, r.e) for r in spans.collect()) == [(7, 15), (21, 28), (47, 54)] or sorted((r.s, r.e) for r in spans.collect()) == [(7, 28), (47, 54)]
    whole = O.verbose_context(O.standard_context(O.minimal_context(items, paths), spans), spark.createDataFrame([("+x",)], "text string"), paths).first()
    assert whole.n_high == 2 and whole.chains == ["a → b", "a → c"] and whole.text == "+x"


def test_diffs_of_one_path(spark):
    """Diffs that touch one path are judged apart: what one removes another may add."""
    head = "diff --git a/a.proto b/a.proto\n--- a/a.proto\n+++ b/a.proto\n"
    diffs = spark.createDataFrame([(1, head + "@@ -1 +0,0 @@\n-  string name = 1;"), (2, head + "@@ -50 +50 @@\n+  string name = 1;")], "diff_id long, text string")
    got = {(r.diff_id, r.what) for r in V.static_review(diffs).collect()}
    assert got == {(1, "removed_field name"), (2, "added_field name")}
    assert {(r.diff_id, r.line) for r in D.changed_lines(D.diff_lines(diffs)).collect()} == {(1, 1), (2, 50)}
    hunks = D.patch_hunks(D.diff_lines(diffs))
    files = spark.createDataFrame([("a.proto", ["  string name = 1;", "x"])], "path string, lines array<string>")
    assert {(r.diff_id, tuple(r.lines)) for r in D.apply_patch(hunks, files).collect()} == {(1, ("x",)), (2, ("  string name = 1;", "x"))}


def test_comments_and_texts_keep_the_class(spark):
    from riskloom.operators import languages as L

    cs = "public class AController {\n  public void Go() {\n    /* if (x) { */\n  }\n  public void Stop() {\n  }\n}\n"
    py = 'class A:\n    def one(self):\n        x = """\nat column 0\n"""\n    def two(self):\n        pass\n'
    files = spark.createDataFrame([("a.cs", cs), ("a.py", py)], "file string, content string")
    got = {(r.file, r.class_name, r.symbol, r.symbol_type, r.start_line, r.end_line) for r in L.code_symbols(files, ["csharp", "python"]).collect()}
    assert got == {
        ("a.cs", "AController", "Go", "controller_action", 2, 4), ("a.cs", "AController", "Stop", "controller_action", 5, 6),
        ("a.py", "A", "one", "method", 2, 5), ("a.py", "A", "two", "method", 6, 7),
    }
    assert L.code_symbols(files.limit(0), "java").count() == 0


def test_repeated_edges_count_once_in_their_order(spark):
    from riskloom.operators import graph as G

    nodes = spark.createDataFrame([("a/x.ts", "a", ".ts", 1, False), ("a/y.ts", "a", ".ts", 9, False)], "node string, community string, language string, degree long, is_test boolean")
    rows = [("a/x.ts", "a/y.ts", "imports", "controller_action", 2), ("a/x.ts", "a/y.ts", "calls", "", 1)]
    told = {tuple(G.surprise(spark.createDataFrame(r, "source string, target string, edge_type string, source_kind string, seq int"), nodes).select("score", F.array_join("reasons", ",")).first()) for r in (rows, rows[::-1])}
    assert len(told) == 1

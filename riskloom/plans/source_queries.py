"""Operators over code, diffs and stored files, bound to files made of the driver's tables, with DuckDB SQL that gives the same rows.

The SQL never reads code: it lists what the rules of each language make of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import extension
from riskloom.operators import graph as G
from riskloom.operators import history as H
from riskloom.operators import intervals as I
from riskloom.operators import languages as L
from riskloom.operators import retrieval as Q
from riskloom.operators import rules as M
from riskloom.plans import review as V
from riskloom.plans.code_queries import DDL_RULES, DIFF_FILES, graph_edges, part_diffs, part_paths
from riskloom.plans.code_queries import _EDGES, _PATHS
from riskloom.plans.findings_queries import table
from riskloom.sources import diff as D
from riskloom.sources import store as S

LANGUAGES = ("csharp", "java", "python", "nodejs", "go", "php", "cpp")
#: A file of each language for the parts whose key has that remainder by seven: path and lines.
FILES = (
    ("api/Order{k}Controller.cs", ("namespace Shop {", "public class Order{k}Controller {", "  private readonly OrderService _svc;", "  public string Name { get; set; }", "  [Authorize]", '  [HttpPost("a, b")]', "  public async Task<int> Create(int id) {", "    _svc.Stop(id); // }", "    if (id > 0) { await _db.SaveChangesAsync(); }", "    return 1;", "  }", "  public int Peek() => 1;", "  public void Stop()", "  {", "    client.SendAsync(id);", "  }", "}", "}")),
    ("srv/A{k}.java", ("@RestController", "public class A{k} {", "  private final B b;", '  @PreAuthorize("x")', '  @PostMapping("/a")', "  public void go(int a,", "      int c) {", "    restTemplate.getForObject();", "    repo.save(x);", "  }", "  @Override", "  public String show() {", '    return "}";', "  }", "}", "class B{k}Service {", "  public void run() { }", "}")),
    ("svc/app{k}.py", ("class Repo{k}:", "    def put(self, db):", "        def inner():", "            return 1", "        db.commit()", "", "    def __repr__(self):", "        return 'x'", "@app.get('/x{k}')", "def route(user=Depends(current_user)):", "    requests.get('u')", "def helper():", "    pass")),
    ("node/pay{k}.ts", ("@Controller('p')", "export class Pay{k} {", "  constructor(private readonly svc: Svc) {", "  }", "  @Get('x')", "  async list() {", "    await axios.get('u');", "    return this.svc.find();", "  }", "  find() {", "  }", "}", "router.post('/p{k}', handler);")),
    ("m/store{k}.go", ("type Box{k} struct {", "\trepo *Repo", "}", "", "func (s *Box{k}) Put(c *gin.Context) {", "\ttx.Commit()", "\tgo run()", "}", "func List{k}(c *gin.Context) {", "}")),
    ("p/Pay{k}Controller.php", ("class Pay{k}Controller {", "  public function __construct(Svc $svc) {", "  }", "  public function store() {", "    $this->authorize('x');", "    $m->save();", "  }", "}")),
    ("c/box{k}.cpp", ("class Box{k} {", "  int get(HttpRequest r) {", "    return 1;", "  }", "};", "void Keep{k}::store() {", "  std::lock_guard<std::mutex> l(m);", "  auto p = std::move(q);", "  db.Insert(p);", "}")),
)
#: What each declares: remainder, class, name, kind, first and last line, attributes.
SYMBOLS = (
    (0, "Order{k}Controller", "Name", "property", 4, 4, ""), (0, "Order{k}Controller", "Create", "controller_action", 7, 11, "Authorize,HttpPost"), (0, "Order{k}Controller", "Peek", "controller_action", 12, 12, ""), (0, "Order{k}Controller", "Stop", "controller_action", 13, 16, ""),
    (1, "A{k}", "go", "controller_action", 6, 10, "PreAuthorize,PostMapping,RestController"), (1, "A{k}", "show", "controller_action", 12, 14, "Override,RestController"), (1, "B{k}Service", "run", "service_method", 17, 17, ""),
    (2, "Repo{k}", "put", "repository_method", 2, 5, ""), (2, "", "route", "controller_action", 10, 11, "app.get"),
    (3, "Pay{k}", "list", "controller_action", 6, 9, "Get,Controller"), (3, "Pay{k}", "find", "method", 10, 11, "Controller"), (3, "", "get:u", "controller_action", 7, 7, "GET"), (3, "", "post:/p{k}", "controller_action", 13, 13, "POST"),
    (4, "Box{k}", "Put", "repository_method", 5, 8, ""), (4, "", "List{k}", "controller_action", 9, 10, ""),
    (5, "Pay{k}Controller", "store", "controller_action", 4, 7, ""),
    (6, "Box{k}", "get", "controller_action", 2, 4, ""), (6, "Keep{k}", "store", "repository_method", 6, 10, ""),
)
#: What they do: remainder, source, target, kind, confidence. {f} is the file; a target of {first} is the method of that name in the first file.
EDGES = (
    (0, "Order{k}Controller.Create", "auth:Order{k}Controller.Create", "requires_auth", "high"), (0, "Order{k}Controller.Create", "endpoint:Order{k}Controller.Create", "exposes_endpoint", "high"), (0, "Order{k}Controller.Create", "db:{f}:9", "writes_db", "high"), (0, "Order{k}Controller.Create", "{first}", "calls", "medium"), (0, "Order{k}Controller.Stop", "external:{f}:15", "calls_external_api", "medium"),
    (1, "A{k}.go", "auth:A{k}.go", "requires_auth", "high"), (1, "A{k}.go", "endpoint:A{k}.go", "exposes_endpoint", "high"), (1, "A{k}.go", "external:{f}:8", "calls_external_api", "medium"), (1, "A{k}.go", "db:{f}:9", "writes_db", "high"),
    (2, "Repo{k}.put", "db:{f}:5", "writes_db", "high"), (2, "route", "auth:{f}:route", "requires_auth", "high"), (2, "route", "external:{f}:11", "calls_external_api", "medium"),
    (3, "Pay{k}.list", "endpoint:Pay{k}.list", "exposes_endpoint", "high"), (3, "Pay{k}.list", "external:{f}:7", "calls_external_api", "medium"), (3, "Pay{k}.list", "{first}", "calls", "medium"),
    (4, "Box{k}.Put", "db:{f}:6", "writes_db", "high"), (4, "Box{k}.Put", "concurrency:{f}:7", "concurrency_boundary", "medium"),
    (5, "Pay{k}Controller.store", "auth:Pay{k}Controller.store", "requires_auth", "high"), (5, "Pay{k}Controller.store", "db:{f}:6", "writes_db", "high"),
    (6, "Keep{k}.store", "storage:{f}:9", "writes_db", "high"), (6, "Keep{k}.store", "concurrency:{f}:7", "concurrency_boundary", "high"), (6, "Keep{k}.store", "memory:{f}:8", "memory_ownership", "medium"),
)


def _key(column: str = "p_partkey") -> Column:
    return F.col(column).cast("string")


def _with_key(text: str) -> Column:
    return F.replace(F.lit(text), F.lit("{k}"), _key())


def _by_rest(of: list[Column], n: int) -> Column:
    out = F.lit(None).cast("string")
    for i, c in enumerate(of):
        out = F.when(F.col("p_partkey") % n == i, c).otherwise(out)
    return out


def _rows(values: tuple) -> str:
    """A VALUES list; text in single quotes."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v)
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in values)


_K = "CAST(p_partkey AS VARCHAR)"
_PATH_ROWS = _rows(tuple((i, p) for i, (p, _) in enumerate(FILES)))


def code_files(spark, sf_dir) -> DataFrame:
    """A file of one of seven languages for every part."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", _by_rest([_with_key(f) for f, _ in FILES], 7).alias("file"), _by_rest([_with_key("\n".join(t)) for _, t in FILES], 7).alias("content"))


def code_symbols(spark, sf_dir):
    nodes, _ = V.code_graph(code_files(spark, sf_dir), LANGUAGES)
    return nodes.select("node_id", "symbol_type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.array_join("attributes", ",").alias("attributes"), F.size(F.split("body", "\n")).cast("long").alias("n_lines"))


CODE_SYMBOLS = f"""
WITH f(m, file) AS (VALUES {_PATH_ROWS}), s(m, cls, name, kind, a, b, attrs) AS (VALUES {_rows(SYMBOLS)})
SELECT replace(file || ':' || CASE WHEN cls = '' THEN '' ELSE cls || '.' END || name, '{{k}}', {_K}) AS node_id, kind AS symbol_type, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, attrs AS attributes,
  CAST(CASE WHEN kind = 'property' OR name LIKE '%:%' THEN 1 ELSE b - a + 1 END AS BIGINT) AS n_lines FROM part JOIN f ON p_partkey % 7 = f.m JOIN s ON s.m = f.m"""


def code_edges(spark, sf_dir):
    _, edges = V.code_graph(code_files(spark, sf_dir), LANGUAGES)
    return edges.select("source", "target", "edge_type", "confidence")


CODE_EDGES = f"""
WITH f(m, file) AS (VALUES {_PATH_ROWS}), e(m, src, goal, kind, sure) AS (VALUES {_rows(EDGES)}), p AS (SELECT p_partkey, f.m, replace(file, '{{k}}', {_K}) AS file FROM part JOIN f ON p_partkey % 7 = f.m),
first AS (SELECT m, min(file) AS file, arg_min(p_partkey, file) AS k FROM p GROUP BY m)
SELECT p.file || ':' || replace(src, '{{k}}', {_K}) AS source, CASE WHEN goal <> '{{first}}' THEN replace(replace(goal, '{{f}}', p.file), '{{k}}', {_K}) WHEN p.m = 0 THEN first.file || ':Order' || first.k || 'Controller.Stop' ELSE first.file || ':Pay' || first.k || '.find' END AS target,
  kind AS edge_type, sure AS confidence FROM p JOIN e ON e.m = p.m JOIN first ON first.m = p.m"""

#: A changed line of each language's file, and the symbol that it is in.
CHANGED = ((0, 10, "Order{k}Controller.Create"), (1, 9, "A{k}.go"), (2, 4, "Repo{k}.put"), (3, 8, "Pay{k}.list"), (4, 7, "Box{k}.Put"), (5, 6, "Pay{k}Controller.store"), (6, 9, "Keep{k}.store"))


def changed_code(spark, sf_dir):
    files = code_files(spark, sf_dir)
    at = _by_rest([F.lit(str(n)) for _, n, _ in CHANGED], 7)
    text = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\n@@ -"), at, F.lit(",1 +"), at, F.lit(",1 @@\n-old\n+new"))
    lines = D.diff_lines(files.select(F.col("p_partkey").alias("diff_id"), text.alias("text")))
    nodes, _ = V.code_graph(files, LANGUAGES)
    return V.changed_code(lines, nodes).select("diff_id", "node_id", "symbol")


CHANGED_CODE = f"""
WITH f(m, file) AS (VALUES {_PATH_ROWS}), c(m, line, name) AS (VALUES {_rows(CHANGED)})
SELECT p_partkey AS diff_id, replace(file || ':' || name, '{{k}}', {_K}) AS node_id, split_part(name, '.', 2) AS symbol FROM part JOIN f ON p_partkey % 7 = f.m JOIN c ON c.m = f.m"""


def script_files(spark, sf_dir) -> DataFrame:
    """A script for every part that imports the next one's."""
    text = F.concat(F.lit("import { f } from './p"), (F.col("p_partkey") + 1).cast("string"), _with_key("'\nexport function show{k}() {\n}\nexport const useIt{k} = 1\nexport class Card{k} {}\nexport const Big{k} = 2\n"))
    return table(spark, sf_dir, "part").select("p_partkey", _with_key("web/p{k}.ts").alias("file"), text.alias("content"))


def script_nodes(spark, sf_dir):
    nodes, _ = V.script_graph(script_files(spark, sf_dir).select("file", "content"))
    return nodes.select("id", "node_type", F.col("line").cast("long").alias("line"))


SCRIPT_NODES = """
WITH n(name, kind, line) AS (VALUES ('', 'file', 0), (':show', 'function', 2), (':useIt', 'hook', 4), (':Card', 'class', 5), (':Big', 'component', 6))
SELECT 'web/p' || p_partkey || '.ts' || CASE WHEN name = '' THEN '' ELSE name || p_partkey END AS id, kind AS node_type, CAST(line AS BIGINT) AS line FROM part CROSS JOIN n"""


def script_edges(spark, sf_dir):
    _, edges = V.script_graph(script_files(spark, sf_dir).select("file", "content"))
    return edges.select("source", "target", "edge_type")


SCRIPT_EDGES = """
WITH n(name) AS (VALUES (':show'), (':useIt'), (':Card'), (':Big'))
SELECT 'web/p' || p_partkey || '.ts' AS source, 'web/p' || p_partkey || '.ts' || name || p_partkey AS target, 'exports' AS edge_type FROM part CROSS JOIN n
UNION ALL SELECT 'web/p' || p_partkey || '.ts', 'web/p' || (p_partkey + 1) || '.ts', 'imports' FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)"""


def changed_scripts(spark, sf_dir):
    files = script_files(spark, sf_dir)
    new = F.when(F.col("p_partkey") % 4 == 0, "\nnew file mode 100644").otherwise("")
    text = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", new, F.lit("\n@@ -3,1 +3,1 @@\n-old\n+new"))
    lines = D.diff_lines(files.select(F.col("p_partkey").alias("diff_id"), text.alias("text")))
    out = V.changed_scripts(lines, files.select("file", "content"))
    return out.select("diff_id", "file", "symbol", "symbol_type", F.col("start_line").cast("long").alias("start_line"), "change_type")


CHANGED_SCRIPTS = "SELECT p_partkey AS diff_id, 'web/p' || p_partkey || '.ts' AS file, 'show' || p_partkey AS symbol, 'function' AS symbol_type, CAST(2 AS BIGINT) AS start_line, CASE WHEN p_partkey % 4 = 0 THEN 'added' ELSE 'modified' END AS change_type FROM part"


def added_symbols(spark, sf_dir):
    line = _by_rest([_with_key(t) for t in ("+  function f{k}() {", "+  const g{k} = async (x) => 1", "+function h{k}() {", "+  class C{k} {", "+ export const e{k} = 1")], 5)
    return Q.changed_symbols(table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("diff_id"), line.alias("line"))).select("diff_id", "symbol")


ADDED_SYMBOLS = "SELECT p_partkey % 10 AS diff_id, ['f', 'g', '', 'C', 'e'][CAST(p_partkey % 5 + 1 AS INTEGER)] || p_partkey AS symbol FROM part WHERE p_partkey % 5 <> 2"


def usages(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    seq = F.col("p_partkey") % 12
    sites = p.select(seq.alias("seq"), F.concat(F.lit("s"), seq.cast("string")).alias("symbol"), _with_key("f{k}").alias("file"), (F.col("p_partkey") % 50).alias("line"), _with_key("t{k}").alias("text"))
    return Q.usages(sites).select("seq", "symbol", "text")


USAGES = """
SELECT seq, 's' || seq AS symbol, substr(string_agg(file || ':' || line || ':' || t, chr(10) ORDER BY file, line, t), 1, 3000) AS text
FROM (SELECT p_partkey % 12 AS seq, 'f' || p_partkey AS file, p_partkey % 50 AS line, 't' || p_partkey AS t FROM part) WHERE seq < 10 GROUP BY seq"""

#: Migrations of four frameworks: path, added lines, and the findings (line, operation, table, column, risk).
MIGRATIONS = (
    ("a/alembic/versions/x{k}.py", ("op.drop_table('t{k}')", "op.add_column('t', sa.Column('c{k}', sa.Int(), nullable=False))", "op.alter_column('t', 'a', new_column_name='b')"), ((3, "DROP TABLE", "t{k}", "", "high"), (4, "ADD COLUMN", "t", "c{k}", "high"), (5, "RENAME COLUMN", "", "", "high"))),
    ("Migrations/X{k}.cs", ('migrationBuilder.DropColumn(name: "c{k}", table: "t");', 'migrationBuilder.AddColumn<int>(name: "d{k}", table: "t");'), ((3, "DROP COLUMN", "t", "c{k}", "high"), (4, "ADD COLUMN", "t", "d{k}", "low"))),
    ("app/migrations/0{k}_x.py", ("migrations.RemoveField(", "    model_name='m{k}',", "    name='f',", ")", "migrations.DeleteModel(name='Old{k}')"), ((0, "DROP COLUMN", "m{k}", "f", "high"), (0, "DROP TABLE", "Old{k}", "", "high"))),
    ("database/migrations/x{k}.php", ("DROP TABLE t{k};", "// nothing"), ((3, "DROP TABLE", "t{k}", "", "high"),)),
)


def framework_migrations(spark, sf_dir):
    texts = [_with_key(f"diff --git a/{p} b/{p}\n@@ -0,0 +1,{len(t)} @@\n" + "\n".join(f"+{x}" for x in t)) for p, t, _ in MIGRATIONS]
    lines = D.diff_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("diff_id"), _by_rest(texts, 4).alias("text")))
    found = M.migration_findings(lines)
    return found.select("path", F.col("line").cast("long").alias("line"), "operation", F.col("table").alias("table_name"), F.col("column").alias("column_name"), "risk")


_FOUND = _rows(tuple((i, p, *f) for i, (p, _, fs) in enumerate(MIGRATIONS) for f in fs))
FRAMEWORK_MIGRATIONS = f"""
WITH v(m, path, line, op, t, c, risk) AS (VALUES {_FOUND})
SELECT replace(path, '{{k}}', {_K}) AS path, CAST(line AS BIGINT) AS line, op AS operation, replace(t, '{{k}}', {_K}) AS table_name, replace(c, '{{k}}', {_K}) AS column_name, risk FROM part JOIN v ON p_partkey % 4 = v.m"""


def merge_requests(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    new = F.when(k % 5 == 0, _with_key("b{k}")).otherwise(_with_key("a{k}"))
    changes = p.select((k / 10).cast("long").alias("diff_id"), k.alias("seq"), _with_key("a{k}").alias("old_path"), new.alias("new_path"), (k % 5 == 1).alias("new_file"), (k % 5 == 2).alias("deleted_file"), (k % 5 == 0).alias("renamed_file"), _with_key("@@ -1 +1 @@\n-x\n+y{k}\n").alias("diff"))
    lines = D.diff_lines(D.merge_request_diff(changes))
    same = D.same_path_blocks(lines).groupBy("diff_id", "path").agg(F.count("*").alias("n_same"))
    files = D.diff_files(lines).join(same, ["diff_id", "path"], "left")
    return files.select("diff_id", "path", "is_new_file", "is_deleted", F.size("hunks").cast("long").alias("n_hunks"), F.coalesce("n_same", F.lit(0).cast("long")).alias("n_same"))


MERGE_REQUESTS = """
SELECT p_partkey // 10 AS diff_id, CASE WHEN p_partkey % 5 = 0 THEN 'b' ELSE 'a' END || p_partkey AS path, p_partkey % 5 = 1 AS is_new_file, p_partkey % 5 = 2 AS is_deleted, CAST(1 AS BIGINT) AS n_hunks,
  CAST(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 7 ELSE 6 END AS BIGINT) AS n_same FROM part"""


def merge_request_meta(spark, sf_dir):
    reply = F.when(F.col("p_partkey") % 7 == 0, "{bad").otherwise(_with_key('{"id": 1, "diff_refs": {"base_sha": "b{k}", "head_sha": "h{k}", "start_sha": "s{k}"}}'))
    return D.merge_request_meta(table(spark, sf_dir, "part").select("p_partkey", reply.alias("reply"))).drop("reply")


MERGE_META = "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 'b' || p_partkey END AS base_sha, CASE WHEN p_partkey % 7 <> 0 THEN 'h' || p_partkey END AS head_sha, CASE WHEN p_partkey % 7 <> 0 THEN 's' || p_partkey END AS start_sha FROM part"


def static_review(spark, sf_dir):
    return V.static_review(part_diffs(spark, sf_dir)).select("diff_id", "file", F.col("line").cast("long").alias("line"), "risk", "kind", "what")


STATIC_REVIEW = f"SELECT diff_id, path AS file, line, risk, 'migration' AS kind, operation || ' ' || table_name || ' ' || column_name AS what FROM ({DDL_RULES})"


def patched_files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = _with_key("diff --git a/f{k} b/f{k}\n--- a/f{k}\n+++ b/f{k}\n@@ -1,3 +1,3 @@\n a\n-b{k}\n+B{k}\n c")
    hunks = D.patch_hunks(D.diff_lines(p.select(F.col("p_partkey").alias("diff_id"), text.alias("text"))))
    old = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("x"), F.lit("q"), F.lit("c"))).otherwise(F.array(F.lit("x"), F.lit("a "), F.concat(_with_key("b{k}"), F.lit("  ")), F.lit("c")))
    out = D.apply_patch(hunks, p.select(_with_key("f{k}").alias("path"), old.alias("lines")))
    return out.select("path", F.array_join("lines", "|").alias("text"), "ok")


PATCHED = "SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'x|q|c' ELSE 'x|a|B' || p_partkey || '|c' END AS text, p_partkey % 3 <> 0 AS ok FROM part"


def test_cases(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("describe('Cart"), (F.col("p_partkey") % 5).cast("string"), _with_key("', () => {\n  it('adds {k}', f)\n})\ntest(`pays`, g)"))
    tests = S.parse_tests(p.select(_with_key("t{k}.spec.ts").alias("file"), text.alias("content")))
    changed = spark.createDataFrame([("Cart3.spec",), ("other",)], "stem string")
    near = S.related_tests(tests, changed).select("file", "line", F.lit(True).alias("near"))
    return tests.join(near, ["file", "line"], "left").select("file", F.col("describe").alias("suite"), F.col("it").alias("name"), F.col("line").cast("long").alias("line"), F.coalesce("near", F.lit(False)).alias("related"))


TEST_CASES = """
SELECT 't' || p_partkey || '.spec.ts' AS file, 'Cart' || (p_partkey % 5) AS suite, CASE WHEN line = 2 THEN 'adds ' || p_partkey ELSE 'pays' END AS name, CAST(line AS BIGINT) AS line, p_partkey % 5 = 3 AS related FROM part CROSS JOIN (VALUES (2), (4)) t(line)"""


def _stored_reports(spark, sf_dir) -> str:
    """Reports of all nations, a file each."""
    n = table(spark, sf_dir, "nation")
    day = F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")
    item = F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file"), F.col("n_nationkey").cast("long").alias("line"), F.when(F.col("n_nationkey") % 2 == 0, "high").otherwise("low").alias("risk"), F.col("n_name").alias("symbol"), F.lit("").alias("reason"))
    fix = F.struct(F.col("n_nationkey").cast("long").alias("id"), F.lit("auto").alias("mode"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("title"))
    root = S.scratch_path(spark, "reports")
    S.save_reports(n.select(F.concat(F.lit("2024-01-"), day, F.lit(" 10:00")).alias("timestamp"), F.col("n_name").alias("commit"), F.array(item).alias("items"), F.array(fix).alias("fix_candidates")), root)
    return root


def stored_reports(spark, sf_dir):
    reports = S.load_reports(spark, _stored_reports(spark, sf_dir), 10)
    named = H.reports_with_file(reports, "r1").select("timestamp", F.lit(True).alias("named"))
    return H.report_items(reports).join(named, "timestamp", "left").select("timestamp", "file", "line", "risk", F.coalesce("named", F.lit(False)).alias("named"))


STORED_REPORTS = """
SELECT '2024-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || ' 10:00' AS timestamp, 'r' || n_regionkey AS file, CAST(n_nationkey AS BIGINT) AS line, CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'low' END AS risk, n_regionkey = 1 AS named
FROM nation ORDER BY n_nationkey DESC LIMIT 10"""


def fix_candidates(spark, sf_dir):
    return S.latest_queue(spark, _stored_reports(spark, sf_dir)).select("id", "mode", "title", "line", "evidence")


FIX_CANDIDATES = "SELECT CAST(n_nationkey AS BIGINT) AS id, 'auto' AS mode, CASE WHEN n_nationkey % 3 > 0 THEN n_name ELSE '' END AS title, CAST(0 AS BIGINT) AS line, '' AS evidence FROM nation"


def graph_store(spark, sf_dir):
    """The graph stored and read twice: as tables of this version, and as the JSON lines of an old store."""
    edges = graph_edges(spark, sf_dir)
    nodes = G.degrees(edges).select(F.col("node").alias("id"), F.lit("file").alias("node_type"))
    new, old = S.scratch_path(spark, "graph"), S.scratch_path(spark, "graph")
    S.save_graph(nodes, edges, new)
    edges.write.parquet(f"{new}/v=1/edges")
    dropped = S.drop_other_versions(spark, new)
    nodes.write.json(f"{old}/nodes.json")
    edges.write.json(f"{old}/edges.json")
    out = None
    for name, root in (("tables", new), ("json", old)):
        n, e = S.load_graph(spark, root)
        rows = n.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(e.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))
        rows = rows.withColumns({"store": F.lit(name), "dropped": F.lit(",".join(dropped))})
        out = rows if out is None else out.unionByName(rows)
    return out.select("store", "kind", "n", "dropped")


GRAPH_STORE = f"""
WITH e AS {_EDGES}, n AS (SELECT 'file' AS kind, count(DISTINCT node) AS n FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) UNION ALL SELECT edge_type, count(*) FROM e GROUP BY 1)
SELECT store, kind, n, 'v=1' AS dropped FROM n CROSS JOIN (VALUES ('tables'), ('json')) s(store)"""


def freshness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), S.content_hash(F.col("text")).alias("file_hash"))
    full = S.incremental_update(d.limit(0), S.file_states(d.limit(0), d), d)
    same = S.is_fresh(S.file_states(full, d)).select(F.lit("same").alias("store"), "fresh")
    return same.unionByName(S.is_fresh(S.file_states(d.filter("file > 3"), d)).select(F.lit("older").alias("store"), "fresh"))


FRESHNESS = "SELECT 'same' AS store, true AS fresh UNION ALL SELECT 'older', (SELECT count(*) = 0 FROM documents WHERE doc_id <= 3)"


def rule_files(spark, sf_dir):
    """Texts of rule files: of all nations, an empty and a missing one."""
    root = S.scratch_path(spark, "rules")
    names = table(spark, sf_dir, "nation").select("n_name").unionByName(spark.createDataFrame([("",)], "n_name string"))
    names.write.option("maxRecordsPerFile", 1).text(root)
    out = S.load_skills(spark, [root, f"{root}/none.md"])
    return out.select(F.regexp_replace("text", r"^# Skill: [^\n]*\n", "").alias("text"), "ok", F.col("error").isNotNull().alias("failed"))


RULE_FILES = "SELECT n_name AS text, true AS ok, false AS failed FROM nation UNION ALL SELECT '', false, true UNION ALL SELECT NULL, false, true"


def source_trees(spark, sf_dir):
    """Files of three folders as scans of scripts and of back-end code see them."""
    root = S.scratch_path(spark, "tree")
    names = table(spark, sf_dir, "nation").select("n_name").repartition(1)
    for folder in ("src/a", "node_modules/x", "bin"):
        names.write.text(f"{root}/{folder}")
    out = None
    for scan, skip in (("scripts", S.SKIP), ("backend", S.BACKEND_SKIP)):
        files = S.source_tree(spark, root, [".txt"], skip)
        n = F.size(F.split(F.trim(F.col("content").cast("string"), F.lit("\n")), "\n")).cast("long")
        rows = files.groupBy(F.lit(scan).alias("scan"), F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).agg(F.sum(n).alias("n_lines"))
        out = rows if out is None else out.unionByName(rows)
    return out


SOURCE_TREES = "SELECT scan, folder, CAST((SELECT count(*) FROM nation) AS BIGINT) AS n_lines FROM (VALUES ('scripts', 'src/a'), ('scripts', 'bin'), ('backend', 'src/a')) v(scan, folder)"


def stored_diffs(spark, sf_dir):
    """Diffs written as files and read back."""
    root = S.scratch_path(spark, "diffs")
    part_diffs(spark, sf_dir).select("text").write.option("maxRecordsPerFile", 1).text(root)
    files = D.diff_files(D.diff_lines(S.read_diffs(spark, root)))
    return files.select("path", "is_new_file", F.size("hunks").cast("long").alias("n_hunks"))


STORED_DIFFS = f"SELECT path, is_new_file, CAST(len(string_split(hunks, ',')) AS BIGINT) AS n_hunks FROM ({DIFF_FILES})"


def old_and_new(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.col("text").cast("binary").alias("content"))
    pairs = S.text_pairs(d.filter("doc_id % 13 <> 0"), d.filter("doc_id % 11 <> 0"))
    return pairs.select("file", F.octet_length("old").cast("long").alias("old_bytes"), F.octet_length("new").cast("long").alias("new_bytes"))


OLD_AND_NEW = "SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN doc_id % 13 <> 0 THEN octet_length(encode(text)) END AS old_bytes, CASE WHEN doc_id % 11 <> 0 THEN octet_length(encode(text)) END AS new_bytes FROM documents WHERE doc_id % 13 <> 0 OR doc_id % 11 <> 0"


def vue_scripts(spark, sf_dir):
    pages = ['<template/>\n<script src="x"></script>\n<script lang="ts">\na{k}\n</script>\n<script setup>\nb{k}\n</script>', '<script lang="ts">\na{k}\n</script>', "<p/>"]
    v = S.vue_script(_by_rest([_with_key(t) for t in pages], 3))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v.body", F.col("v.line_offset").cast("long").alias("line_offset"))


VUE_SCRIPTS = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN chr(10) || 'b' || p_partkey || chr(10) WHEN 1 THEN chr(10) || 'a' || p_partkey || chr(10) END AS body, CAST(CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 0 END AS BIGINT) AS line_offset FROM part"


def callers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rest = (F.col("p_partkey") % 3).cast("string")
    text = F.array(F.concat(F.lit("import run"), rest), F.concat(F.lit("x = run"), rest, F.lit("("), _key(), F.lit(")")), F.concat(F.lit("# run"), rest, F.lit("()")), F.lit("mod.use()"))
    lines = p.select(F.concat(F.lit("d"), (F.col("p_partkey") % 7).cast("string"), _with_key("/f{k}.py")).alias("file"), F.posexplode(text).alias("n", "text")).select("file", (F.col("n") + 1).alias("line"), "text")
    symbols = spark.createDataFrame([(1, "run0", "d0/f21.py"), (2, "run1", "d1/x.py"), (3, "Nope", "d2/mod.py"), (4, "Absent", "")], "seq long, symbol string, self_file string")
    out = Q.caller_contexts(lines, symbols, per_symbol=5, total=12)
    return out.select("seq", "symbol", F.col("order").alias("nth"), "file", F.col("line").cast("long").alias("line"), "n_sites", "snippet", "language")


CALLERS = """
WITH s(seq, symbol, word, self_file, dir, line) AS (VALUES (1, 'run0', 'run0', 'd0/f21.py', 'd0', 2), (2, 'run1', 'run1', 'd1/x.py', 'd1', 2), (3, 'Nope', 'mod', 'd2/mod.py', 'd2', 4)),
f AS (SELECT p_partkey, 'd' || (p_partkey % 7) AS d, 'd' || (p_partkey % 7) || '/f' || p_partkey || '.py' AS file, 'run' || (p_partkey % 3) AS run FROM part),
h AS (SELECT s.*, f.file, f.p_partkey, f.run, row_number() OVER (PARTITION BY seq ORDER BY CASE WHEN d = dir THEN 1 ELSE 0 END DESC, f.file) AS nth, count(*) OVER (PARTITION BY seq) AS n FROM s JOIN f ON (word = run OR word = 'mod') AND f.file <> self_file),
t AS (SELECT *, row_number() OVER (ORDER BY seq, nth) AS all_nth FROM h WHERE nth <= 5)
SELECT CAST(seq AS BIGINT) AS seq, symbol, nth, file, CAST(line AS BIGINT) AS line, n AS n_sites, 'import ' || run || chr(10) || 'x = ' || run || '(' || p_partkey || ')' || chr(10) || '# ' || run || '()' || chr(10) || 'mod.use()' AS snippet, 'python' AS language FROM t WHERE all_nth <= 12"""


def symbol_ends(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.array(*(F.lit(t) for t in ("function a() {", "  if (x) {", "  }", "}", "def b():", "    pass", "done")))
    lines = p.select(_with_key("f{k}").alias("file"), F.posexplode(text).alias("n", "text")).select("file", (F.col("n") + 1).alias("line"), "text")
    symbols = p.select(_with_key("f{k}").alias("file"), F.explode(F.array(F.lit(1), F.lit(5), F.lit(7))).alias("start_line"))
    return I.symbol_end(lines, symbols).select("file", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


SYMBOL_ENDS = "SELECT 'f' || p_partkey AS file, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line FROM part CROSS JOIN (VALUES (1, 4), (5, 6), (7, 87)) v(s, e)"


def snippets(spark, sf_dir):
    """Lines around a line of a text of thirty, and around three symbols of a file of sixty lines."""
    p = table(spark, sf_dir, "part")
    at = (F.col("p_partkey") % 30 + 1).cast("int")
    lines = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda x: F.concat(F.lit("l"), x.cast("string")))
    one = p.select(_with_key("f{k}").alias("file"), at.cast("long").alias("s"), I.snippet(lines, at, 8).alias("text"))
    every = p.select(_with_key("g{k}").alias("file"), F.explode(F.sequence(F.lit(1), F.lit(60))).alias("line")).withColumn("text", F.concat(F.lit("l"), F.col("line").cast("string")))
    symbols = p.select(_with_key("g{k}").alias("file"), F.explode(F.array(*(F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for a, b in ((10, 12), (20, 25), (50, 51))))).alias("x")).select("file", "x.*")
    return one.unionByName(I.relevant_snippets(symbols, every).select("file", F.col("s").cast("long").alias("s"), "text"))


_LINES = "(SELECT string_agg('l' || i, chr(10) ORDER BY i) FROM range({a}, {b}) r(i))"
SNIPPETS = f"""
WITH p AS (SELECT p_partkey, CAST(p_partkey % 30 + 1 AS BIGINT) AS mid FROM part), w AS (SELECT *, greatest(mid - 8, 1) AS a, least(mid + 8, 30) AS b FROM p),
x AS (SELECT w.*, string_agg('l' || i, chr(10) ORDER BY i) FILTER (i < a + 12) AS text FROM w JOIN range(1, 31) r(i) ON i BETWEEN a AND b GROUP BY ALL)
SELECT 'f' || p_partkey AS file, mid AS s, text || CASE WHEN b - a + 1 > 12 THEN chr(10) || '… (truncated)' ELSE '' END AS text FROM x
UNION ALL SELECT 'g' || p_partkey, CAST(s AS BIGINT), t FROM part CROSS JOIN (SELECT 7 AS s, {_LINES.format(a=7, b=29)} AS t UNION ALL SELECT 47, {_LINES.format(a=47, b=55)}) v"""


def diff_languages(spark, sf_dir):
    text = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n+x"))
    out = L.languages_in_diff(part_paths(spark, sf_dir).select(F.col("p_partkey").alias("diff_id"), text.alias("text")))
    return out.select("diff_id", F.array_join("languages", ",").alias("languages"), "frontend")


DIFF_LANGUAGES = f"SELECT p_partkey AS diff_id, CASE m WHEN 0 THEN 'python' WHEN 1 THEN 'csharp' WHEN 2 THEN 'python' WHEN 3 THEN 'php' ELSE '' END AS languages, m = 6 AS frontend FROM {_PATHS}"


def language_profiles(spark, sf_dir):
    """Supported languages with the parts' files of each."""
    files = part_paths(spark, sf_dir).select(extension(F.col("path")).alias("extension")).groupBy("extension").count()
    known = L.profiles(spark).join(files, "extension", "left")
    return known.groupBy("language", F.col("place").cast("long").alias("place")).agg(F.array_join(F.sort_array(F.collect_list("extension")), ",").alias("extensions"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_files"))


PROFILES = f"""
SELECT language, CAST(place AS BIGINT) AS place, extensions, (SELECT count(*) FROM {_PATHS} WHERE list_contains(string_split(extensions, ','), lower('.' || split_part(path, '.', -1)))) AS n_files
FROM (VALUES ('csharp', 0, '.cs'), ('java', 1, '.java'), ('python', 2, '.py'), ('nodejs', 3, '.cjs,.js,.mjs,.ts,.tsx'), ('go', 4, '.go'), ('php', 5, '.php'), ('cpp', 6, '.cc,.cpp,.cxx,.h,.hpp')) v(language, place, extensions)"""


def run_rows(spark, sf_dir):
    return S.run_row(D.diff_lines(part_diffs(spark, sf_dir)), "shop", "staged", 1.5, "c")


RUN_ROWS = "SELECT p_partkey // 50 AS diff_id, 'shop' AS project, 'staged' AS scope, count(DISTINCT p_partkey // 10) AS n_files, count(*) + count(DISTINCT p_partkey // 10) AS n_changed, 1.5::DOUBLE AS elapsed, 'c' AS commit FROM part GROUP BY 1"

QUERIES = {
    "code_symbols": (code_symbols, CODE_SYMBOLS),
    "code_edges": (code_edges, CODE_EDGES),
    "changed_code": (changed_code, CHANGED_CODE),
    "script_nodes": (script_nodes, SCRIPT_NODES),
    "script_edges": (script_edges, SCRIPT_EDGES),
    "changed_scripts": (changed_scripts, CHANGED_SCRIPTS),
    "added_symbols": (added_symbols, ADDED_SYMBOLS),
    "usages": (usages, USAGES),
    "framework_migrations": (framework_migrations, FRAMEWORK_MIGRATIONS),
    "merge_requests": (merge_requests, MERGE_REQUESTS),
    "merge_request_meta": (merge_request_meta, MERGE_META),
    "static_review": (static_review, STATIC_REVIEW),
    "patched_files": (patched_files, PATCHED),
    "test_cases": (test_cases, TEST_CASES),
    "stored_reports": (stored_reports, STORED_REPORTS),
    "fix_candidates": (fix_candidates, FIX_CANDIDATES),
    "graph_store": (graph_store, GRAPH_STORE),
    "freshness": (freshness, FRESHNESS),
    "rule_files": (rule_files, RULE_FILES),
    "source_trees": (source_trees, SOURCE_TREES),
    "stored_diffs": (stored_diffs, STORED_DIFFS),
    "old_and_new": (old_and_new, OLD_AND_NEW),
    "vue_scripts": (vue_scripts, VUE_SCRIPTS),
    "callers": (callers, CALLERS),
    "symbol_ends": (symbol_ends, SYMBOL_ENDS),
    "snippets": (snippets, SNIPPETS),
    "diff_languages": (diff_languages, DIFF_LANGUAGES),
    "language_profiles": (language_profiles, PROFILES),
    "run_rows": (run_rows, RUN_ROWS),
}

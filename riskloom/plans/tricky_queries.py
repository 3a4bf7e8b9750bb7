"""Code with comments, strings and declarations over many lines, in seven languages, bound to the driver's parts.

The SQL never reads code: it lists what each file declares.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import languages as L
from riskloom.plans import review as V
from riskloom.plans.findings_queries import table
from riskloom.plans.source_queries import LANGUAGES, _by_rest, _rows, _with_key

#: A file of each language for the parts whose key has that remainder by seven.
FILES = (
    ("api/T{k}Controller.cs", (
        "public class T{k}Controller", "{", "  /* if (x) { */", '  private string open = @"{ ""', '  { public void No() { ";', "  // {", "  [Authorize(Roles = \"a, (b\")]", "  [HttpPost(", '    "x")]',
        "  public async Task<int> Go(", "    int id, // (", "    string s = \"{\")", "  {", "    var c = '{';", "    await _db.SaveChangesAsync();", "  }", "  [HttpGet] public int Peek(int a) => 1;", "}", "/* class Gone { */", "class Last {", "  public void End() { }", "}",
    )),
    ("srv/T{k}.java", (
        "/**", " * class Not {", " */", "@RestController", "@RequestMapping(", '    value = "/x",', "    method = {A, B})", "public class T{k} {", '  String q = """', "    select { from", '    """;', "  @GetMapping(path = f(g(h(i(1)))))", "  public String show(",
        "      @Param(\"a\") int a,", "      int b)", "      throws E {", '    return "}"; /* } */', "  }", "  // public void gone() {", "}",
    )),
    ("svc/t{k}.py", (
        '"""Text with', "class Not:", '    def no(self): """', "class Repo{k}:", '    """Doc', "at column 0", '"""', "", "    def put(", "        self,", "        db=(1,", "  2),", "    ):", "        x = '''", "def fake(): pass", "'''", "        db.commit()", "",
        "    # def gone(self):", "    def get(self):", "        return [", "  1]", "@app.get(", "    '/x'", ")", "async def route(", "    a):", "    pass",
    )),
    ("node/t{k}.ts", (
        "const page = `", "class Not { ${x}", "`;", "/* class Gone {", "*/", "@Controller('p')", "export class T{k} {", "  @Get('x')", "  async list(", "    a: string,", "    b = '){'", "  ) {", "    return `}`;", "  }", "  // find() {", "  find() {", "  }", "}", "// router.get('/no')", "router.post('/p{k}', async (q, r) => {", "  done();", "});",
    )),
    ("m/t{k}.go", ("var raw = `", "func No() {", "`", "type Box{k} struct {", "\trepo *Repo // {", "}", "func (s *Box{k}) Put(", "\tc *gin.Context,", "\tn int,", ") {", "\tr := '{'", '\ts := "}"', "\ttx.Commit()", "}", "/* func Gone() { */", "func List{k}(c *gin.Context) {", "}")),
    ("p/T{k}Controller.php", ("<?php", "# class Not {", "/* {", "*/", "class T{k}Controller {", "  #[Route('/x')]", "  public function store(", "    $a = '{',", "    $b = 1", "  ) {", "    // }", "    $m->save();", "  }", "  public function show() { return \"}\"; }", "}")),
    ("c/t{k}.cpp", ('auto raw = R"(class Not {', ')";', "/* { */", "class Box{k} {", "  int get(HttpRequest r,", "          char c = '{') {", "    return 1; // }", "  }", "};", "void Keep{k}::store(", "    int a) {", '  db.Insert("{");', "}")),
)
#: What each declares: remainder, class, name, kind, first and last line, attributes.
SYMBOLS = (
    (0, "T{k}Controller", "Go", "controller_action", 10, 16, "Authorize,HttpPost"), (0, "T{k}Controller", "Peek", "controller_action", 17, 17, "HttpGet"), (0, "Last", "End", "method", 21, 21, ""),
    (1, "T{k}", "show", "controller_action", 13, 18, "GetMapping,RestController,RequestMapping"),
    (2, "Repo{k}", "put", "repository_method", 9, 17, ""), (2, "Repo{k}", "get", "repository_method", 20, 22, ""), (2, "", "route", "controller_action", 26, 28, "app.get"),
    (3, "T{k}", "list", "controller_action", 9, 14, "Get,Controller"), (3, "T{k}", "find", "method", 16, 17, "Controller"), (3, "", "post:/p{k}", "controller_action", 20, 20, "POST"),
    (4, "Box{k}", "Put", "method", 7, 14, ""), (4, "", "List{k}", "controller_action", 16, 17, ""),
    (5, "T{k}Controller", "store", "controller_action", 7, 13, ""), (5, "T{k}Controller", "show", "controller_action", 14, 14, ""),
    (6, "Box{k}", "get", "controller_action", 5, 8, ""), (6, "Keep{k}", "store", "repository_method", 10, 13, ""),
)
_K = "CAST(p_partkey AS VARCHAR)"
_PATHS = _rows(tuple((i, p, len(t)) for i, (p, t) in enumerate(FILES)))


def tricky_files(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", _by_rest([_with_key(f) for f, _ in FILES], 7).alias("file"), _by_rest([_with_key("\n".join(t)) for _, t in FILES], 7).alias("content"))


def tricky_symbols(spark, sf_dir):
    nodes, _ = V.code_graph(tricky_files(spark, sf_dir), LANGUAGES)
    return nodes.select("node_id", "symbol_type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.array_join("attributes", ",").alias("attributes"))


TRICKY_SYMBOLS = f"""
WITH f(m, file, n) AS (VALUES {_PATHS}), s(m, cls, name, kind, a, b, attrs) AS (VALUES {_rows(SYMBOLS)})
SELECT replace(file || ':' || CASE WHEN cls = '' THEN '' ELSE cls || '.' END || name, '{{k}}', {_K}) AS node_id, kind AS symbol_type, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, attrs AS attributes
FROM part JOIN f ON p_partkey % 7 = f.m JOIN s ON s.m = f.m"""

#: For each file the lines that begin in a comment or string.
INSIDE = ((0, 5), (1, 2), (1, 3), (1, 10), (1, 11), (2, 2), (2, 3), (2, 6), (2, 7), (2, 15), (2, 16), (3, 2), (3, 3), (3, 5), (4, 2), (4, 3), (5, 4), (6, 2))


def line_states(spark, sf_dir):
    """Lines, logical lines and lines that begin in a comment or string, of one file after another joined to long ones."""
    files = tricky_files(spark, sf_dir)
    copies = F.array_join(F.array_repeat("content", 20), "\n")
    lines = L.lexed_files(files.select("file", copies.alias("content")))
    return lines.groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if("inside").alias("n_inside"), F.sum("opens").cast("long").alias("n_opens"), F.sum("shuts").cast("long").alias("n_shuts"))


#: Braces of each file's code.
BRACES = ((0, 4), (1, 3), (2, 0), (3, 4), (4, 3), (5, 3), (6, 3))
LINE_STATES = f"""
WITH f(m, file, n) AS (VALUES {_PATHS}), i(m, line) AS (VALUES {_rows(INSIDE)}), b(m, n) AS (VALUES {_rows(BRACES)})
SELECT replace(file, '{{k}}', {_K}) AS file, CAST(20 * f.n AS BIGINT) AS n_lines, CAST(20 * (SELECT count(*) FROM i WHERE i.m = f.m) AS BIGINT) AS n_inside, CAST(20 * b.n AS BIGINT) AS n_opens, CAST(20 * b.n AS BIGINT) AS n_shuts
FROM part JOIN f ON p_partkey % 7 = f.m JOIN b ON b.m = f.m"""

QUERIES = {"tricky_symbols": (tricky_symbols, TRICKY_SYMBOLS), "line_states": (line_states, LINE_STATES)}

"""The lexer against a scan of whole texts, character by character."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.lexer import SYNTAX, lex

#: For each language what opens and closes text that is no code: opening, closing, does a backslash escape, may it span lines.
KINDS = {
    "java": ((('//', None, False, False), ("/*", "*/", False, True), ('"""', '"""', True, True), ('"', '"', True, False))),
    "python": ((("#", None, False, False), ('"""', '"""', True, True), ("'''", "'''", True, True), ('"', '"', True, False), ("'", "'", True, False))),
    "nodejs": ((("//", None, False, False), ("/*", "*/", False, True), ("`", "`", True, True), ('"', '"', True, False), ("'", "'", True, False))),
    "go": ((("//", None, False, False), ("/*", "*/", False, True), ("`", "`", False, True), ('"', '"', True, False))),
    "php": ((("//", None, False, False), ("#", None, False, False), ("/*", "*/", False, True), ('"', '"', True, False), ("'", "'", True, False))),
    "cpp": ((("//", None, False, False), ("/*", "*/", False, True), ('"', '"', True, False))),
}


def scan(language, text):
    """(code, inside) of each line."""
    out, kind = [], None
    for line in text.split("\n"):
        inside, code, i = kind is not None, "", 0
        while i < len(line):
            if kind is None:
                kind = next((k for k in KINDS[language] if line.startswith(k[0], i)), None)
                if kind is None:
                    code += line[i]
                    i += 1
                else:
                    i += len(kind[0])
                    code += '""' if kind[1] not in (None, "*/") else ""
            elif kind[1] and line.startswith(kind[1], i):
                i += len(kind[1])
                kind = None
            else:
                i += 2 if kind[2] and line[i] == "\\" else 1
        if kind and not kind[3]:
            kind = None
        out.append((code, inside))
    return out


def lexed(spark, texts):
    rows = [(f"{language}{i}", language, n, line) for i, (language, text) in enumerate(texts) for n, line in enumerate(text.split("\n"), 1)]
    df = spark.createDataFrame(rows, "file string, language string, line int, text string")
    out = {}
    for r in sorted(lex(df).collect(), key=lambda r: (r.file, r.line)):
        out.setdefault(r.file, []).append(r)
    return [out[f"{language}{i}"] for i, (language, _) in enumerate(texts)]


def test_random_texts(spark):
    rng = random.Random(6)
    parts = ['"', '"""', "'''", "`", "//", "/*", "*/", "#", "a", " { ", "}", "(", ")", "\n", "\n", "\\x", "x = ", ";"]
    texts = []
    for language in KINDS:
        own = [p for p in parts if p not in ("'''",) or language == "python"]
        own += ["'"] if any(k[0] == "'" for k in KINDS[language]) else []
        texts += [(language, "".join(rng.choice(own) for _ in range(rng.randrange(60)))) for _ in range(60)]
    texts = [(a, t) for a, t in texts if '""""' not in t and "''''" not in t and "\\\n" not in t]
    for (language, text), rows in zip(texts, lexed(spark, texts), strict=True):
        assert [(r.code, r.inside) for r in rows] == scan(language, text), (language, text)


@pytest.mark.parametrize(
    "language, text, code",
    [
        ("csharp", 'var s = @"a ""q"" {\n b\\" + "}"; // {', ['var s = ""', ' + ""; ']),
        ("csharp", 'x = $@"{', ["x = \"\""]),
        ("csharp", "char c = '{'; char d = '\\''; int e = '\\u0041';", ['char c = ""; char d = ""; int e = "";']),
        ("cpp", 'auto s = R"(one {\n" two)"; int n = 1\'000\'000; {', ['auto s = ""', "; int n = 1'000'000; {"]),
        ("php", "#[Attr]\n# gone {", ["#[Attr]", ""]),
        ("java", 'String s = """\n  { " }\n  """; int i; /* a */ b', ['String s = ""', "", '; int i;  b']),
        ("java", "/" * 6000 + "\n" + '"' + "x" * 20000 + '"{', ["", '""{']),
    ],
)
def test_literals(spark, language, text, code):
    assert [r.code for r in lexed(spark, [(language, text)])[0]] == code


def test_logical_lines(spark):
    texts = [
        ("python", "@app.get(\n    '/x',\n)\ndef f(a,\n      b=[\n  1]):\n    '''\ntext\n'''\n    x = (1 +\n\ndef g(): pass"),
        ("nodejs", "router.post('/p', async (req, res) => {\n  go(1,\n   2)\n  function inner(a,\n    b) {\n  }\n});\nnext()"),
    ]
    py, js = lexed(spark, texts)
    assert [(r.line, r.logical) for r in py if r.head and r.logical.strip()] == [(1, '@app.get(     "", )'), (4, "def f(a,       b=[   1]):"), (7, '    ""  '), (10, "    x = (1 + "), (12, "def g(): pass")]
    assert [(r.line, r.logical) for r in js if r.head] == [(1, 'router.post("", async (req, res) => {'), (2, "  go(1,    2)"), (4, "  function inner(a,     b) {"), (6, "  }"), (7, "});"), (8, "next()")]


def test_long_comment(spark):
    """The state comes from hundreds of lines above; files do not touch each other."""
    long = "/* {\n" + "x {\n" * 700 + "*/ int a; {"
    a, b = lexed(spark, [("java", long), ("java", "int b; {\n" * 3)])
    assert sum(r.opens for r in a) == 1 and a[-1].code == " int a; {" and not any(r.code for r in a[:-1])
    assert sum(r.opens for r in b) == 3
    assert set(SYNTAX) == {"csharp", "java", "python", "nodejs", "go", "php", "cpp"}
    assert lex(spark.createDataFrame([], "file string, language string, line int, text string")).count() == 0
    odd = lex(spark.createDataFrame([("f", "lisp", 1, "; // a")], "file string, language string, line int, text string"))
    assert odd.select(F.col("code")).first().code == "; // a"


def test_files_in_one_pass(spark):
    """A file costs no pass, window or shuffle a doubling of its lines; returns and marks of the lexer's own stay apart."""
    from riskloom.operators.lexer import lex_files

    text = "/* {\r\n" + "x {\r\n" * 700 + "*/ int a; {\r\nb \u0001\u0003{"
    lines = lex_files(spark.createDataFrame([("f.java", "java", text)], "file string, language string, content string"))
    states = lines.select("file", "line", "text", "code", "inside", "opens")
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    rows = sorted(states.collect(), key=lambda r: r.line)
    assert [r.line for r in rows if not r.inside] == [1, 703] and rows[1].text == "x {"
    assert [(r.code, r.opens) for r in rows[701:]] == [(" int a; {", 1), ("b   {", 1)]

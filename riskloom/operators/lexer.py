"""What of each line is code: a lexer that reads each file's text once.

Comments and literals are found by one regular expression over the whole text,
from left to right, so those that span lines need no state and no pass per line.
They are taken out with their lines kept, and a mark tells lines that begin in
one. Files are rows, so the work is spread by files and grows with their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that set apart what is no code while a text is lexed: where it begins and ends, and where a string ends or a comment begins.
_OPEN, _SHUT, _BETWEEN = "\u0001", "\u0002", "\u0003"


@dataclass(frozen=True)
class Literal:
    """Text that is no code: how it opens, one piece of what it holds, how it closes; spans where it may span lines."""

    opens: str
    holds: str
    closes: str
    spans: bool = False


@dataclass(frozen=True)
class Syntax:
    """comment: a comment up to the end of its line. block: /* */ comments. blocks_by_indent: no braces."""

    comment: str
    literals: tuple[Literal, ...]
    block: bool = True
    blocks_by_indent: bool = False


_DOUBLE = Literal('"', r'\\.|[^"\\\n]', '"')
_SINGLE = Literal("'", r"\\.|[^'\\\n]", "'")
_TEXT = Literal('"""', r'\\.|(?!""")[^\\]', '"""', True)
#: One character; other single quotes mean nothing.
_CHARACTER = Literal(r"'(?=(?:\\[^'\s]*+\\?|[^'\\\n])')", r"\\.|[^'\\\n]", "'")
_BLOCK = Literal(r"/\*", r"(?!\*/).", r"\*/", True)
#: A string whose quote is not the first of three.
_PLAIN = Literal('"(?!"")', r'\\.|[^"\\\n]', '"')

SYNTAX = {
    "csharp": Syntax("//.*", (Literal(r'(?:@\$?|\$@)"', '""|[^"]', '"(?!")', True), Literal('"""', '(?!""").', '"""', True), _PLAIN, _CHARACTER)),
    "java": Syntax("//.*", (_TEXT, _PLAIN, _CHARACTER)),
    "python": Syntax("#.*", (_TEXT, Literal("'''", r"\\.|(?!''')[^\\]", "'''", True), _PLAIN, Literal("'(?!'')", r"\\.|[^'\\\n]", "'")), block=False, blocks_by_indent=True),
    "nodejs": Syntax("//.*", (Literal("`", r"\\.|[^`\\]", "`", True), _DOUBLE, _SINGLE)),
    "go": Syntax("//.*", (Literal("`", "[^`]", "`", True), _DOUBLE, _CHARACTER)),
    "php": Syntax(r"//.*|#(?!\[).*", (_DOUBLE, _SINGLE)),
    "cpp": Syntax("//.*", (Literal(r'\bR"\(', r'(?!\)").', r'\)"', True), _DOUBLE, _CHARACTER)),
}


def _no_code(syntax: Syntax) -> str:
    """A pattern of comments and literals; group 1 is a literal, group 2 a comment that may span lines.

    Repetitions are possessive, so that long texts need no stack.
    """

    def whole(x: Literal) -> str:
        return f"(?:{x.opens})(?s:{x.holds})*+(?:{x.closes}|\\\\?\\z)" if x.spans else f"(?:{x.opens})(?:{x.holds})*+(?:{x.closes}|(?=\n)|\\z)"

    return f"(?=[\"'`/#@$R])(?:{syntax.comment}|({'|'.join(map(whole, syntax.literals))})|({whole(_BLOCK) if syntax.block else '(?!)'}))"


def _codes(text: Column, syntax: Syntax) -> Column:
    """The code of each line of a text; _OPEN is the first character of lines that begin in a comment or string."""
    bare = F.regexp_replace(text, f"[{_OPEN}-{_BETWEEN}]", " ")
    marked = F.regexp_replace(bare, _no_code(syntax), f"{_OPEN}$1{_BETWEEN}$2{_SHUT}")
    # every other part is no code: of strings the quotes stay, of all the ends of lines
    lines = lambda x: F.repeat(F.lit(f"\n{_OPEN}"), F.length(x) - F.length(F.replace(x, F.lit("\n"))))
    gone = lambda x: F.concat(F.when(F.startswith(x, F.lit(_BETWEEN)), "").otherwise('""'), lines(x))
    parts = F.transform(F.split(marked, f"[{_OPEN}{_SHUT}]"), lambda x, i: F.when(i % 2 == 1, gone(x)).otherwise(x))
    return F.split(F.array_join(parts, ""), "\n")


def _lexed(files: DataFrame, names: list[str], text: Column, rows: Column) -> DataFrame:
    """Lines of files (file, language) from a text and the rows of its lines, with code and inside, then what _logical() adds."""
    codes = F.split(text, "\n")
    for n in names:
        codes = F.when(F.col("language") == n, _codes(text, SYNTAX[n])).otherwise(codes)
    each = files.select("file", "language", F.explode(F.arrays_zip(rows.alias("row"), codes.alias("code"))).alias("x"))
    inside = F.startswith("code", F.lit(_OPEN))
    out = each.select("file", "language", "x.row.*", "x.code").withColumns({"inside": inside, "code": F.when(inside, F.substr("code", F.lit(2))).otherwise(F.col("code"))})
    return _logical(out, [n for n in names if SYNTAX[n].blocks_by_indent])


def lex_files(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """lex() of files (file, language, content). They are dealt out by file before they are cut into lines, which so are not shuffled.

    The number of parts is given: texts shrink in a shuffle, and by their bytes there many files would be one task's.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("file", "language", F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("content")).repartition(n, "file")
    rows = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    return _lexed(dealt, list(names or SYNTAX), F.col("content"), rows)


def lex(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Lines (file, language, line, text) with code, inside, head, logical, stop, opens, shuts.

    code is the text without comments and without what strings hold; inside
    tells whether the line begins in a comment or string. Lines whose brackets
    are still open go on in the next: head marks the first line of each such
    logical line, logical is its whole code, null on other lines, and stop its
    last line. In
    languages with braces a line that ends in a brace or semicolon ends the
    logical line too, so functions within a call's brackets are seen. opens and
    shuts count braces of the code. Unknown languages have no comments.
    """
    rest = [c for c in lines.columns if c not in ("file", "language", "line")]
    files = lines.groupBy("file", "language").agg(F.sort_array(F.collect_list(F.struct("line", *rest))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda x: F.coalesce(x.text, F.lit(""))), "\n")
    return _lexed(files, list(names or SYNTAX), text, F.col("rows"))


def _logical(lines: DataFrame, by_indent: list[str]) -> DataFrame:
    """head, logical, opens and shuts: see lex()."""
    count = lambda chars: F.length("code") - F.length(F.translate("code", chars, ""))
    indent = F.col("language").isin(by_indent)
    net = F.when(indent, count("([{") - count(")]}")).otherwise(count("([") - count(")]"))
    done = F.when(indent, F.lit(False)).otherwise(F.col("code").rlike(r"[{};]\s*$") | (net < 0))
    starts = indent & ~F.col("inside") & F.col("code").rlike(r"^\s*(?:@|(?:async\s+)?def\s|class\s)")  # these cannot stand in brackets
    by = Window.partitionBy("file").orderBy("line")
    upto = lambda end: by.rowsBetween(Window.unboundedPreceding, end)
    cut = F.coalesce(F.lag("_done").over(by), F.lit(False)) | F.col("_starts")
    out = lines.withColumns({"opens": count("{"), "shuts": count("}"), "_net": net, "_done": done, "_starts": starts})
    # brackets that are open since the last cut; all by one order of lines
    out = out.withColumns({"_cut": cut, "_before": F.coalesce(F.sum("_net").over(upto(-1)), F.lit(0))})
    depth = F.col("_before") - F.coalesce(F.last(F.when(F.col("_cut"), F.col("_before")), True).over(upto(0)), F.lit(0))
    out = out.withColumn("head", (depth <= 0) & ~F.col("inside"))
    out = out.withColumn("_group", F.sum(F.col("head").cast("int")).over(upto(0)))
    own = Window.partitionBy("file", "_group").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stop = F.max("line").over(own)
    joined = F.array_join(F.transform(F.collect_list(F.struct("line", "code")).over(own), lambda x: x.code), " ")
    return out.withColumns({"logical": F.when(F.col("head"), joined), "stop": stop}).drop("_net", "_done", "_starts", "_cut", "_before", "_group")

"""What back-end code of seven languages shows: symbols, calls, writes, auth and endpoints.

A declaration is a logical line of code that fits a pattern, so parameters,
attributes and decorators may span lines, and comments and strings do not
count: see operators.lexer. It ends where the braces that are open before it are
closed again, or in Python where a line is indented no deeper. Ends and
enclosing classes are found by filling values along sorted lines, so no
declaration meets all lines of its file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.ranks import first_of
from riskloom.functions.text import contains_any, extension
from riskloom.operators.lexer import SYNTAX, lex_files


@dataclass(frozen=True)
class Language:
    """Patterns of a language. Group 1 of class_ and method is the name; of field its type, and group 2 the field.

    auth_marks and route_marks fit names of attributes or decorators; with
    class_marks those of the class count for its methods.
    """

    extensions: tuple[str, ...]
    class_: str
    method: str
    field: str = ""
    call: str = ""
    auth: str = ""
    writes: str = ""
    external: str = ""
    concurrency: str = ""
    memory: str = ""
    field_first: bool = False
    writes_to: str = "db"
    property_: str = ""
    auth_marks: str = ""
    route_marks: str = ""
    class_marks: bool = False


#: Extensions of files and patterns of edges.
LANGUAGES = {
    "csharp": Language(
        (".cs",),
        r"\b(?:class|record|interface)\s+(\w+)",
        r"^\s*(?:public|private|protected|internal)\s+(?:static\s+|async\s+|virtual\s+|override\s+)*[\w<>\[\],\s?]+?\s+(\w+)\s*\(",
        r"private\s+readonly\s+(\w+)\s+(_\w+)",
        r"\b(_\w+)\.(\w+)\s*\(",
        writes=r"SaveChanges(?:Async)?\s*\(",
        external=r"(?:GetAsync|PostAsync|PutAsync|DeleteAsync|SendAsync)\s*\(",
        property_=r"^\s*(?:public|private|protected|internal)\s+(?!class\b|interface\b|record\b|enum\b|struct\b)(?:static\s+|virtual\s+|override\s+|required\s+)*[\w<>\[\],.?]+\s+(\w+)\s*(?:\{|=>)",
        auth_marks="^Authorize$",
        route_marks="^Http",
    ),
    "java": Language(
        (".java",),
        r"\b(?:class|interface|enum)\s+(\w+)",
        r"^\s*(?:public|private|protected)\s+(?:static\s+|final\s+|synchronized\s+)*[\w<>\[\],\s?]+?\s+(\w+)\s*\(",
        r"(?:private|protected)\s+(?:final\s+)?(\w+)\s+(\w+)\s*[;=]",
        r"\b(?:this\.)?(\w+)\.(\w+)\s*\(",
        writes=r"\.save\(|\.delete\(|\.saveAll\(|\.saveAndFlush\(",
        external=r"restTemplate\.|webClient\.|httpClient\.",
        auth_marks="^(PreAuthorize|Secured|RolesAllowed)$",
        route_marks="^(Get|Post|Put|Delete|Patch|Request)Mapping",
        class_marks=True,
    ),
    "python": Language(
        (".py",),
        r"^\s*class\s+(\w+)",
        r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
        auth=r"(?i)(?:Depends|Security)\s*\(\s*[^)]*(?:current_user|auth|user|token|principal)",
        writes=r"\.commit\s*\(|\.save\s*\(|\.delete\s*\(|\.add\s*\(|session\.add|db\.add",
        external=r"requests\.(get|post|put|delete)|httpx\.",
    ),
    "nodejs": Language(
        (".js", ".ts", ".mjs", ".cjs", ".tsx"),
        r"\bclass\s+(\w+)",
        r"^\s*(?:export\s+)?(?:public\s+|private\s+|protected\s+)?(?:async\s+)?(?:function\s+)?(?!if\b|for\b|while\b|switch\b|return\b|catch\b)(\w+)\s*\([^;]*\{\s*$",
        r"(?:private|protected)\s+(?:readonly\s+)?(\w+)\s*:\s*(\w+)",
        r"this\.(\w+)\.(\w+)\s*\(",
        writes=r"prisma\.\w+\.(create|update|delete|upsert)|\.save\s*\(|repository\.(save|delete)",
        external=r"axios\.|fetch\s*\(|http\.(get|post)",
        field_first=True,
        auth_marks="^(UseGuards|AuthGuard|JwtAuthGuard|RolesGuard|Roles)$",
        route_marks="^(Get|Post|Put|Delete|Patch|Options|All)$",
        class_marks=True,
    ),
    "go": Language(
        (".go",),
        r"^type\s+(\w+)\s+struct",
        r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(",
        r"^\s+(\w+)\s+\*?(\w+)\s*$",
        r"\b\w+\.(\w+)\.(\w+)\s*\(",
        writes=r"\.Create\s*\(|\.Save\s*\(|\.Delete\s*\(|\.Updates\s*\(|tx\.Commit\s*\(",
        concurrency=r"\.Lock\s*\(|\.Unlock\s*\(|sync\.Mutex|\bgo\s+\w+\(",
        field_first=True,
    ),
    "php": Language(
        (".php",),
        r"\bclass\s+(\w+)",
        r"^\s*(?:public|private|protected)\s+(?:static\s+)?function\s+(\w+)\s*\(",
        r"(\w+)\s+\$(\w+)",
        r"\$this->(\w+)->(\w+)\s*\(",
        r"\$this->authorize\s*\(|auth\(\)|->middleware\s*\(\s*['\"]auth",
        writes=r"->save\s*\(|->delete\s*\(|->create\s*\(|DB::transaction|->update\s*\(",
    ),
    "cpp": Language(
        (".cc", ".cpp", ".cxx", ".h", ".hpp"),
        r"\b(?:class|struct)\s+(\w+)\s*[:{]",
        r"^[\w:<>&*\s]+?\b(?:\w+::)?(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{",
        writes=r"\.Save\s*\(|\.Insert\s*\(|\.Update\s*\(|\.Delete\s*\(|\.Write\s*\(",
        concurrency=r"lock_guard|unique_lock|\.lock\s*\(|\.unlock\s*\(|std::thread|std::async",
        memory=r"\bdelete\s+|std::move\s*\(|\.reset\s*\(|std::make_unique",
        writes_to="storage",
    ),
}
#: Parts of Python decorators that make a route, and methods of routes in scripts.
ROUTES = (".get", ".post", ".put", ".delete", ".patch", ".options", "route", "api_view")
VERBS = ("get", "post", "put", "delete", "patch", "options", "head")
#: Deepest indentation of Python declarations that is told apart.
_DEEPEST = 64
#: Lines of a cell in which bodies meet their lines.
_CELL = 64
#: Other names of languages.
ALIASES = {"node.js": "nodejs", "c++": "cpp"}
#: Confidence of edges; locks are more certain in C++.
CONFIDENCE = {"requires_auth": "high", "exposes_endpoint": "high", "calls": "medium", "writes_db": "high", "calls_external_api": "medium", "memory_ownership": "medium"}


def language_name(name: str) -> str:
    return ALIASES.get(name.lower(), name.lower())


def profiles(spark) -> DataFrame:
    """language, extension, place: the dimension of supported languages."""
    return spark.createDataFrame([(k, e, i) for i, (k, v) in enumerate(LANGUAGES.items()) for e in v.extensions], "language string, extension string, place int")


def languages_in_diff(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "text") -> DataFrame:
    """id, languages (in the order of the profiles), frontend: what a diff's paths are written in."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text_col, F.lit(r" b/[^ \n]+(\.[A-Za-z0-9]+)"), F.lit(1)), lambda e: F.lower(e)))
    names = F.array_compact(F.array(*(F.when(F.arrays_overlap(found, F.array(*(F.lit(e) for e in v.extensions))), k) for k, v in LANGUAGES.items())))
    front = F.array(*(F.lit(e) for e in (".js", ".ts", ".jsx", ".tsx", ".vue")))
    return diffs.select(id_col, names.alias("languages"), F.arrays_overlap(found, front).alias("frontend"))


def symbol_kind(language: str, class_name: Column, name: Column, path: Column, marks: Column, class_marks: Column, params: Column) -> Column:
    """controller_action, service_method, repository_method or method.

    marks and class_marks are names of attributes, params the first list in
    parentheses of the declaration, in Go that of a receiver. Each language has
    its own rule for what a web entry is and where names are looked for.
    """
    has = lambda text, *words: contains_any(F.lower(text), words)
    ends = lambda word: F.endswith(class_name, F.lit(word))
    where = F.concat_ws(" ", class_name, path)
    if language == "csharp":
        rules = (ends("Controller") | F.exists(marks, lambda m: m.startswith("Http")), ends("Service"), ends("Repository"))
    elif language == "java":
        of_class = lambda *names: F.arrays_overlap(class_marks, F.array(*(F.lit(n) for n in names)))
        web = of_class("RestController", "Controller") | F.exists(F.concat(marks, class_marks), lambda m: F.endswith(m, F.lit("Mapping")))
        rules = (web, of_class("Service") | ends("Service"), of_class("Repository") | ends("Repository"))
    elif language == "nodejs":
        web = F.exists(F.concat(marks, class_marks), lambda m: m.rlike(LANGUAGES["nodejs"].route_marks)) | has(where, "controller")
        rules = (web, has(where, "service"), has(where, "repo"))
    elif language == "python":
        rules = (is_route(marks), has(where, "service"), has(where, "repo"))
    elif language == "php":
        rules = (has(where, "controller"), has(where, "service"), has(where, "repo"))
    elif language == "go":
        web = contains_any(params, ("gin.Context", "echo.Context", "fiber.Ctx", "http.ResponseWriter"))
        rules = (web, has(where, "service"), has(where, "repo", "store"))
    else:
        where = F.concat_ws(" ", class_name, name)
        rules = (contains_any(params, ("ServerContext", "HttpRequest")), has(where, "service"), has(where, "repo", "store"))
    kind = F.when(rules[0], "controller_action").when(rules[1], "service_method").when(rules[2], "repository_method")
    return (kind.when(has(where, "handler"), "controller_action") if language in ("go", "cpp") else kind).otherwise("method")


def property_kind(class_name: Column, path: Column) -> Column:
    """entity_property, model_property or property, by the path and class."""
    where = F.lower(F.concat_ws(" ", path, class_name))
    return F.when(F.contains(where, F.lit("entity")), "entity_property").when(contains_any(where, ("model", "dto", "request", "response")), "model_property").otherwise("property")


def is_route(marks: Column) -> Column:
    """Is one of a Python declaration's decorators a route?"""
    return F.exists(marks, lambda m: contains_any(F.lower(m), ROUTES))


def _nested(depth: int) -> str:
    """A pattern of parentheses, with others in them up to this depth."""
    out = r"\([^()]*+\)"
    for _ in range(depth):
        out = rf"\((?:[^()]++|{out})*+\)"
    return out


_PARENTHESES = _nested(8)
_AT = rf"^\s*(?:@\s*[\w.]+\s*(?:{_PARENTHESES})?\s*)++"
_SQUARE = rf"^\s*(?:\[(?:[^\[\]()]++|{_PARENTHESES}|\[[^\[\]]*+\])*+\]\s*)++"


def _marks(logical: Column, language: str) -> tuple[Column, Column]:
    """(names, rest): attributes or decorators that a logical line begins with, and what it declares."""
    lead = _SQUARE if language == "csharp" else _AT
    bare = F.regexp_replace(F.regexp_extract(logical, lead, 0), _PARENTHESES, "")
    if language == "csharp":
        names = F.regexp_extract_all(bare, F.lit(r"[\[,]\s*(\w[\w.]*)"), F.lit(1))
    else:
        names = F.regexp_extract_all(bare, F.lit(r"@\s*(\w[\w.]*)"), F.lit(1))
    if language == "java":
        names = F.transform(names, lambda n: F.element_at(F.split(n, r"\."), -1))
    return names, F.regexp_replace(logical, lead, "")


def _ends(lines: DataFrame, by_indent: bool) -> DataFrame:
    """Lines (file, line, text, code, class and name of what they declare) with level and, where they declare, end_line."""
    by = Window.partitionBy("file").orderBy("line")
    ahead = Window.partitionBy("file", "level").orderBy("line", "k").rowsBetween(0, Window.unboundedFollowing)
    none = F.lit(None).cast("int")
    if by_indent:
        # the last line of a block may be one of a text or bracket that goes on
        full = F.max(F.when(F.col("inside") | (F.trim("code") != ""), F.col("line")))
        code = lines.withColumns({"level": F.length("text") - F.length(F.ltrim("text")), "upto": full.over(by.rowsBetween(Window.unboundedPreceding, -1)), "final": full.over(Window.partitionBy("file"))})
        code = code.filter(F.col("head") & (F.trim("code") != "")).withColumn("before", F.lag("level").over(by))
        closes, levels, end = F.col("before").isNotNull() & (F.col("level") <= F.col("before")), F.sequence("level", "before"), F.col("upto")
        rest = F.col("final")
    else:
        code = lines.withColumn("after", F.sum(F.col("opens") - F.col("shuts")).over(by).cast("int")).withColumn("level", (F.col("after") - F.col("opens") + F.col("shuts")).cast("int"))
        top = (F.col("level") + F.col("opens") - 1).cast("int")
        closes, levels, end = (F.col("shuts") > 0) & (top >= F.col("after")), F.sequence("after", top), F.col("line")
        rest = F.col("line")
    # what a line closes and what it declares come from its own row, so that lines are worked on once
    own = F.struct(*(c for c in (*_KEPT, "logical", "stop", "final") if c in code.columns and c not in ("file", "level", "line")))
    entry = lambda level, k, end, h: F.struct(level.alias("level"), F.lit(k).alias("k"), end.alias("end"), h.alias("_h"))
    no_head = F.lit(None).cast(code.select(own.alias("h")).schema["h"].dataType)
    shut = F.when(closes, F.transform(levels, lambda x: entry(x, 0 if by_indent else 1, end, no_head)))
    told = F.when(F.col("name").isNotNull() | F.col("class").isNotNull(), F.array(entry(F.col("level"), 1 if by_indent else 0, none, own)))
    both = code.select("file", "line", F.explode(F.flatten(F.array_compact(F.array(shut, told)))).alias("e")).select("file", "line", "e.*")
    marked = both.withColumn("end_line", F.first("end", True).over(ahead)).filter("_h is not null")
    out = marked.select("file", "level", "line", "end_line", "_h.*")
    bodiless = F.lit(not by_indent) & F.col("logical").rlike(r";\s*$") & ~F.contains("logical", F.lit("{"))
    return out.withColumn("end_line", F.when(bodiless, F.col("stop")).otherwise(F.coalesce("end_line", rest)))


def _owned(heads: DataFrame, by_indent: bool) -> DataFrame:
    """Declarations of methods with owner: the class, or in Python also the function, that they stand in."""
    scope = F.struct("class", F.col("line").alias("from"), F.col("end_line").alias("to"), F.col("marks").alias("class_marks"))
    own = F.struct(*heads.columns)
    none, nothing = F.lit(None).cast(heads.select(scope.alias("s")).schema["s"].dataType), F.lit(None).cast(heads.select(own.alias("h")).schema["h"].dataType)
    entry = lambda at, k, scope, h: F.struct(at.alias("at"), F.lit(k).alias("k"), scope.alias("scope"), h.alias("_h"))
    below = F.sequence(F.col("level") + 1, F.lit(_DEEPEST)) if by_indent else F.array(F.col("level") + 1)
    opens = F.when(F.col("level") < _DEEPEST if by_indent else F.col("class").isNotNull(), F.transform(below, lambda at: entry(at, 0, scope, nothing)))
    named = F.when(F.col("name").isNotNull(), F.array(entry(F.col("level"), 1, none, own)))
    both = heads.select("file", "line", F.explode(F.flatten(F.array_compact(F.array(opens, named)))).alias("e")).select("file", "line", "e.*")
    near = F.last("scope", True).over(Window.partitionBy("file", "at").orderBy("line", "k").rowsBetween(Window.unboundedPreceding, -1))
    filled = both.withColumn("scope", near).filter("k = 1").select("_h.*", "scope")
    return filled.withColumn("owner", F.when(F.col("scope.to") >= F.col("line"), F.col("scope"))).drop("scope")


def _language(names: Sequence[str]) -> Column:
    """The language of a file by its extension."""
    ending, out = extension(F.col("file")), F.lit(None).cast("string")
    for n in names:
        out = F.when(ending.isin(*LANGUAGES[n].extensions), n).otherwise(out)
    return out


def _each(names: Sequence[str], of: Callable[[str, Language], Column | None], other: Column) -> Column:
    """of(name, its patterns) for rows of each language; `other` where that is None."""
    out = other
    for n in names:
        value = of(n, LANGUAGES[n])
        if value is not None:
            out = F.when(F.col("language") == n, value).otherwise(out)
    return out


def lexed_files(files: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Lines of the files of these languages, with what of them is code: see lexer.lex(). One plan for all languages."""
    wanted = [language_name(n) for n in names or LANGUAGES]
    own = files.select("file", "content", _language(wanted).alias("language")).filter("language is not null")
    return lex_files(own, wanted)


_KEPT = ["file", "language", "level", "line", "end_line", "declared", "class", "name", "is_property", "marks"]


def _told(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Lines of files of these languages alone, with what they declare and the marks above it."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartition(n, "file")  # code shrinks in a shuffle: by its bytes there, few tasks would sort it all
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    parts = {n: _marks(F.col("logical"), n) for n in names}
    told = lines.withColumns({"own_marks": _each(names, lambda n, _: parts[n][0], none), "declared": _each(names, lambda n, _: parts[n][1], null)})
    declared = F.col("declared")
    fits = lambda of: _each(names, lambda n, spec: F.when(declared.rlike(of(spec)), F.regexp_extract("declared", of(spec), 1)) if of(spec) else None, null)
    told = told.withColumns({"class": fits(lambda x: x.class_), "method": fits(lambda x: x.method), "prop": fits(lambda x: x.property_)})
    free = F.col("class").isNull()
    told = told.withColumns({"name": F.when(free, F.coalesce("method", "prop")), "is_property": free & F.col("method").isNull() & F.col("prop").isNotNull()})
    # marks and what stands below them have as many other logical lines before them
    by = Window.partitionBy("file").orderBy("line")
    other = F.when(F.col("head") & (F.trim("declared") != ""), 1).otherwise(0)
    told = told.withColumn("run", F.coalesce(F.sum(other).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    group = Window.partitionBy("file", "run").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return told.withColumn("marks", F.flatten(F.collect_list("own_marks").over(group))).drop("run", "own_marks", "method", "prop")


def code_symbols(files: DataFrame, language: str | Sequence[str], lexed: DataFrame | None = None) -> DataFrame:
    """file, class_name, symbol, symbol_type, start_line, end_line, node_id, attributes, body of what code of one or more languages declares.

    files: file, content; lexed: their lexed_files(), where they are there
    already. All languages go through one plan. attributes are the names of
    decorators or attributes in front of the declaration, on its own line or on
    those above, in Java and Node also those of the class. Functions outside a
    class have the id file:name. C# properties have types of their own. Calls
    such as router.post('/path', ...) are controller actions of Node with the id
    file:method:path. Properties and routes have no body, as no edges are read
    from them. Constructors of PHP and Node, special methods of Python but
    __init__, and its functions that are no routes outside a class, are left out.
    """
    from riskloom.sources.store import checkpointed

    names = [language_name(n) for n in ([language] if isinstance(language, str) else language)]
    lines = (checkpointed(lexed_files(files, names)) if lexed is None else lexed).filter(F.col("language").isin(names))
    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    indent = [n for n in names if SYNTAX[n].blocks_by_indent]
    heads = None
    for own in filter(None, (indent, [n for n in names if n not in indent])):
        found = _owned(_ends(_told(lines.filter(F.col("language").isin(own)), own), own == indent).select(*_KEPT), own == indent)
        heads = found if heads is None else heads.unionByName(found)
    owner = F.coalesce("owner.class", F.lit(""))
    outside = F.regexp_extract("declared", r"(\w+)::~?\w+\s*\(", 1)
    owner = F.when(F.col("language") == "go", F.regexp_extract("declared", r"^func\s+\(\s*\w+\s+\*?(\w+)", 1)).when((F.col("language") == "cpp") & (outside != ""), outside).otherwise(owner)
    inner = F.col("owner").isNotNull() & F.col("owner.class").isNull()
    special = F.col("name").startswith("__") & (F.col("name") != "__init__")
    python = ~inner & F.when(F.col("owner").isNull(), (F.col("level") == 0) & is_route(F.col("marks"))).otherwise(~special)
    made = F.col("language").isin("nodejs", "php") & F.col("name").isin("constructor", "__construct")
    named = heads.filter(F.when(F.col("language") == "python", python).otherwise(~made)).withColumn("class_name", owner)
    params = F.regexp_extract("declared", r"\(([^)]*)\)?", 1)
    class_marks = F.coalesce("owner.class_marks", none)
    kind = _each(names, lambda n, _: symbol_kind(n, F.col("class_name"), F.col("name"), F.col("file"), F.col("marks"), class_marks, params), null)
    kind = F.when(F.col("is_property"), property_kind(F.col("class_name"), F.col("file"))).otherwise(kind)
    node = F.concat(F.col("file"), F.lit(":"), F.when(F.col("class_name") != "", F.concat("class_name", F.lit("."))).otherwise(""), F.col("name"))
    attributes = _each(names, lambda _, spec: F.concat("marks", class_marks) if spec.class_marks else None, F.col("marks"))
    out = named.select("file", "class_name", F.col("name").alias("symbol"), kind.alias("symbol_type"), F.col("line").alias("start_line"), "end_line", node.alias("node_id"), attributes.alias("attributes"), "is_property")
    whole = _bodies(out.filter("not is_property"), lines.select("file", "line", "text")).unionByName(out.filter("is_property").withColumn("body", F.lit(""))).drop("is_property")
    return whole.unionByName(_routes(lines.filter("language = 'nodejs'"))) if "nodejs" in names else whole


def _bodies(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols with body, their lines from start_line to end_line; both sides meet in cells of lines."""
    cell = lambda c: F.floor(F.col(c) / _CELL)
    spans = symbols.select("file", "start_line", "end_line").distinct().withColumn("cell", F.explode(F.sequence(cell("start_line"), cell("end_line"))))
    inside = lines.withColumn("cell", cell("line")).join(spans, ["file", "cell"]).filter("line between start_line and end_line")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x.text), "\n")
    return symbols.join(inside.groupBy("file", "start_line", "end_line").agg(text.alias("body")), ["file", "start_line", "end_line"]).select(*symbols.columns, "body")


def _routes(lines: DataFrame) -> DataFrame:
    """Calls of web methods, as of routers: a controller action each, named method:path or by the method alone."""
    pattern = rf"(?i)\w\.({'|'.join(VERBS)})\s*\(\s*(?:'([^']*)'|\"([^\"]*)\")?"
    in_code = ~F.col("inside") & F.col("code").rlike(rf"(?i)\w\.({'|'.join(VERBS)})\s*\(")
    calls = lines.filter(in_code & F.col("text").rlike(pattern)).select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("call"))
    verb, path = F.lower(F.regexp_extract("call", pattern, 1)), F.concat(F.regexp_extract("call", pattern, 2), F.regexp_extract("call", pattern, 3))
    name = F.concat_ws(":", verb, F.when(path != "", path))
    return calls.select(
        "file", F.lit("").alias("class_name"), name.alias("symbol"), F.lit("controller_action").alias("symbol_type"), F.col("line").alias("start_line"), F.col("line").alias("end_line"),
        F.concat_ws(":", "file", name).alias("node_id"), F.array(F.upper(verb)).alias("attributes"), F.lit("").alias("body"),
    )


#: Kinds of edges that a pattern over lines of a body shows: edge type, which pattern, the target's prefix.
_SHOWN = (("writes_db", "writes", None), ("calls_external_api", "external", "external"), ("concurrency_boundary", "concurrency", "concurrency"), ("memory_ownership", "memory", "memory"))


def _with(parts: Sequence[Column], name: str) -> Callable[[Column], Column]:
    """A struct of these columns and an array's element."""
    return lambda x: F.struct(*parts, x.alias(name))


def code_edges(files: DataFrame, symbols: DataFrame, language: str | Sequence[str]) -> DataFrame:
    """source, target, edge_type, evidence, confidence of what methods of one or more languages do.

    calls edges need field types, and are resolved with an index over all
    symbols of the language: see operators.graph.resolve_calls. All languages go
    through one plan, which cuts each body into lines once.
    """
    from riskloom.operators.graph import method_index, resolve_calls
    from riskloom.sources.store import checkpointed

    names = [language_name(n) for n in ([language] if isinstance(language, str) else language)]
    null = F.lit(None).cast("string")
    own = symbols.withColumn("language", _language(names)).filter("language is not null")
    own = checkpointed(own.filter((F.col("language") != "nodejs") | (F.col("class_name") != "")))  # functions outside a class have no edges
    node = F.concat_ws(".", F.when(F.col("class_name") != "", F.col("class_name")), "symbol")
    no = F.lit(False)
    above = _each(names, lambda _, s: F.exists("attributes", lambda a: a.rlike(s.auth_marks)) if s.auth_marks else None, no)
    guarded = above | _each(names, lambda _, s: F.col("body").rlike(s.auth) if s.auth else None, no)
    routed = _each(names, lambda _, s: F.exists("attributes", lambda a: a.rlike(s.route_marks)) if s.route_marks else None, no)
    guard = F.concat(F.lit("auth:"), F.when(F.col("language") == "python", F.col("node_id")).otherwise(node))
    edge = lambda test, goal, kind: F.when(test, F.struct(goal.alias("target"), F.lit(kind).alias("edge_type")))
    marked = F.explode(F.array_compact(F.array(edge(guarded, guard, "requires_auth"), edge(routed, F.concat(F.lit("endpoint:"), node), "exposes_endpoint"))))
    whole = own.filter("body <> ''").select("node_id", "file", "start_line", marked.alias("e"))
    out = whole.select(F.col("node_id").alias("source"), "e.target", "e.edge_type", F.concat_ws(":", "file", "start_line").alias("evidence"), F.lit("high").alias("confidence"))
    lines = own.select("language", "file", "node_id", "start_line", F.posexplode(F.split("body", "\n")).alias("offset", "code"))
    place = F.concat_ws(":", "file", F.col("start_line") + F.col("offset"))
    hits = []
    for kind, which, prefix in _SHOWN:
        found = _each(names, lambda _, s, w=which: F.regexp_extract_all("code", F.lit(getattr(s, w)), F.lit(0)) if getattr(s, w) else None, F.array().cast("array<string>"))
        goal = F.lit(prefix) if prefix else _each(names, lambda _, s: F.lit(s.writes_to), null)
        sure = F.lit(CONFIDENCE[kind]) if kind in CONFIDENCE else F.when(F.col("language") == "cpp", "high").otherwise("medium")
        parts = (F.concat_ws(":", goal, place).alias("target"), F.lit(kind).alias("edge_type"), sure.alias("confidence"))
        hits.append(F.transform(found, _with(parts, "hit")))
    shown = lines.select(F.col("node_id").alias("source"), place.alias("place"), F.explode(F.concat(*hits)).alias("e"))
    out = out.unionByName(shown.select("source", "e.target", "e.edge_type", F.concat_ws(" ", "place", "e.hit").alias("evidence"), "e.confidence"))
    call = lambda text, group: _each(names, lambda _, s: F.regexp_extract(text, s.call, group) if s.call else None, null)
    raw = files.select("file", "content", _language(names).alias("language")).filter("language is not null").select("file", "language", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    shows = _each(names, lambda _, s: F.col("text").rlike(s.field) if s.field else None, no)
    part = lambda first: _each(names, lambda _, s: F.regexp_extract("text", s.field, 2 if s.field_first == first else 1) if s.field else None, null)
    fields = raw.filter(shows).select("file", "line", part(True).alias("field_type"), part(False).alias("field"))
    each_hit = _each(names, lambda _, s: F.regexp_extract_all("code", F.lit(s.call), F.lit(0)) if s.call else None, F.array().cast("array<string>"))
    calls = lines.select("language", "file", F.col("node_id").alias("source"), place.alias("evidence"), F.explode(each_hit).alias("hit"))
    # methods of one language are not looked for in another
    of_language = lambda c: F.concat_ws(":", "language", c)
    named = calls.select("file", "source", "evidence", call("hit", 1).alias("field"), of_language(call("hit", 2)).alias("method"))
    typed = named.join(first_of(fields, ["file", "field"], "line").drop("line"), ["file", "field"])
    index = method_index(own.select("class_name", of_language(F.col("symbol")).alias("symbol"), "node_id", F.struct("file", "start_line").alias("seq")))
    return out.unionByName(resolve_calls(typed, index))


def script_exports(files: DataFrame) -> DataFrame:
    """file, name, node_type, line of exports of JavaScript, TypeScript and Vue files, by patterns over lines."""
    pattern = r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+(\w+)"
    lines = files.filter(extension(F.col("file")).isin(".js", ".ts", ".jsx", ".tsx", ".vue")).select("file", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    name = F.regexp_extract("text", pattern, 1)
    kind = (
        F.when(F.col("text").rlike(r"define(?:Store|Component)\s*\("), "component")
        .when(F.col("text").rlike(r"\bclass\s"), "class")
        .when(name.rlike(r"^use[A-Z]"), "hook")
        .when(name.rlike(r"^[A-Z]"), "component")
        .otherwise("function")
    )
    return lines.filter(F.col("text").rlike(pattern)).select("file", name.alias("name"), kind.alias("node_type"), (F.col("n") + 1).alias("line"))


def script_imports(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """source, target, edge_type of relative imports, resolved to files of the tree; others are left out.

    known: file, the whole tree, where files are a part of it. A spec is tried as it is, with each extension and as a folder's index; the
    first that exists counts.
    """
    pattern = r"(?:from|import|require\()\s*['\"](\.{1,2}/[^'\"]+)['\"]"
    specs = files.select("file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("spec"))
    parts = F.split(F.concat_ws("/", F.regexp_replace("file", r"/?[^/]*$", ""), "spec"), "/")
    step = lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array_append(a, x))
    base = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    ends = ["", ".js", ".ts", ".jsx", ".tsx", ".vue", "/index.js", "/index.ts", "/index.jsx", "/index.tsx", "/index.vue"]
    tried = specs.withColumn("base", base).select("file", "spec", F.posexplode(F.array(*(F.concat("base", F.lit(e)) for e in ends))).alias("place", "target"))
    # a tree has any number of files, and columns that are made are taken for small ones: never broadcast
    tree = (files if known is None else known).select(F.col("file").alias("target")).distinct().hint("merge")
    found = tried.join(tree, "target")
    best = found.groupBy("file", "spec").agg(F.min_by("target", "place").alias("target"))
    return best.select(F.col("file").alias("source"), "target", F.lit("imports").alias("edge_type")).distinct()


def declarations(files: DataFrame) -> DataFrame:
    """file, symbol, symbol_type, line of declarations in scripts, the first fitting pattern of a line."""
    #: Fixed values, in order.
    patterns = (
        (r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)", "function"),
        (r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(", "function"),
        (r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?function", "function"),
        (r"^\s*(?:export\s+)?class\s+(\w+)", "class"),
        (r"^\s*(?:const|let)\s+(\w+)\s*=\s*defineComponent\(", "component"),
        (r"^\s*(?:const|let)\s+(\w+)\s*=\s*defineStore\(", "component"),
    )
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.regexp_extract("text", p, 1).alias("symbol"), F.lit(k).alias("symbol_type"))) for p, k in patterns)))
    return lines.withColumn("d", F.try_element_at(found, F.lit(1))).filter("d is not null").select("file", "d.*", (F.col("n") + 1).alias("line"))

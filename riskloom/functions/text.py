"""String functions over paths, diffs and model replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is redacted unless other patterns are given.
REDACT = [r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", r"AKIA[0-9A-Z]{16}"]

#: Languages of file extensions.
LANGUAGES = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".vue": "vue",
    ".java": "java",
    ".go": "go",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
}


def redact(text: Column, patterns: Sequence[str] = tuple(REDACT), mark: str = "[REDACTED]") -> Column:
    """Each pattern in order, replaced everywhere."""
    for p in patterns:
        text = F.regexp_replace(text, p, mark.replace("$", "\\$"))
    return text


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Is one of the words in text? Case is as given."""
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1; 0 for null and empty."""
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def saved_percent(baseline: Column, used: Column) -> Column:
    """Saved share in per cent, rounded half to even; 0 without a baseline."""
    saved = F.greatest(baseline - used, F.lit(0))
    return F.when(baseline > 0, F.bround(saved * 100 / baseline, 0)).otherwise(0).cast("long")


def query_kind(symbol: Column) -> Column:
    """Boosts by the shape of a name, the first shape that fits: Pascal, snake, dotted."""
    pascal = symbol.rlike(r"^[A-Z]") & ~F.contains(symbol, F.lit("_")) & ~F.contains(symbol, F.lit("."))
    none = F.lit(None).cast("map<string,double>")
    return (
        F.when(pascal, F.create_map(F.lit("class"), F.lit(1.5), F.lit("component"), F.lit(1.3)))
        .when(F.contains(symbol, F.lit("_")), F.create_map(F.lit("function"), F.lit(1.5)))
        .when(F.contains(symbol, F.lit(".")), F.create_map(F.lit("qualified"), F.lit(2.0)))
        .otherwise(F.coalesce(none, F.from_json(F.lit("{}"), "map<string,double>")))
    )


def json_array_in(reply: Column) -> Column:
    """The text from the first [ to the last ] of a model's reply; empty if there is none."""
    return F.regexp_extract(reply, r"(?s)(\[.*\])", 1)


def sparkline(values: Column) -> Column:
    """One block character a value, scaled to the largest."""
    marks = F.array(*(F.lit(c) for c in " ▁▂▃▄▅▆▇█"))
    top = F.array_max(values)
    level = lambda v: F.when(top > 0, F.floor(v * 8 / top)).otherwise(0).cast("int") + 1
    return F.array_join(F.transform(values, lambda v: F.element_at(marks, level(v))), "")


def common_prefix_parts(a: Column, b: Column) -> Column:
    """How many leading path parts two paths share."""
    both = F.arrays_zip(F.split(a, "/").alias("x"), F.split(b, "/").alias("y"))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda s, p: F.struct((s.n + F.when(s.on & p.x.eqNullSafe(p.y), 1).otherwise(0)).alias("n"), (s.on & p.x.eqNullSafe(p.y)).alias("on"))
    return F.aggregate(both, start, step, lambda s: s.n)

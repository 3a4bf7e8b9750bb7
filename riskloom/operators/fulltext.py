"""Full-text search: stemmed positional postings, a query language, ranks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.store import checkpointed

#: The suffixes of the second, third and fourth step of the stemmer, and what replaces them.
_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: A consonant, with y after a vowel, and runs of either. A word's measure counts runs of vowels followed by consonants.
_C, _V = "(?:[^aeiouy]|(?<![^aeiou])y)", "(?:[aeiou]|(?<=[^aeiou])y)"
_M0, _M1 = f"^{_C}*{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}+{_C}"
#: Consonant, vowel, consonant other than w, x and y, and of one byte, at the end.
_CVC = f"{_C}{_V}(?![wxy]|[^\\x00-\\x7f]){_C}$"
#: Tokens that are not stemmed: shorter or longer.
_LEAST, _MOST = 3, 64


def with_stem(df: DataFrame, word: str, name: str) -> DataFrame:
    """df with the Porter stem of a column of lower-case tokens; tokens of under 3 or over 64 bytes stay as they are.

    Each step is a projection of its own, as each reads its input many times.
    Write the result before filtering on it: Spark would pull a condition down
    through all of them.
    """
    w, less, root, suffix = F.col("_w"), F.col("_less"), F.col("_root"), F.col("_suffix")
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    out = df.withColumn("_w", F.col(word))
    out = out.withColumn("_w", F.when(w.rlike("(sses|ies)$"), cut(w, 2)).when(w.rlike("[^s]s$"), cut(w, 1)).otherwise(w))
    out = out.withColumn("_less", F.regexp_replace(w, "(ed|ing)$", ""))
    mended = (
        F.when(less.rlike("(at|bl|iz)$"), F.concat(less, F.lit("e")))
        .when(less.rlike(r"([^aeioulsz])\1$"), cut(less, 1))
        .when(less.rlike(f"^{_C}*{_V}+{_C}+$") & less.rlike(_CVC), F.concat(less, F.lit("e")))
        .otherwise(less)
    )
    out = out.withColumn("_w", F.when(w.rlike("eed$"), F.when(cut(w, 3).rlike(_M0), cut(w, 1)).otherwise(w)).when((less != w) & less.rlike(_V), mended).otherwise(w))
    out = out.withColumn("_w", F.when(w.rlike("y$") & cut(w, 1).rlike(_V), F.concat(cut(w, 1), F.lit("i"))).otherwise(w))
    for table in (_STEP_2, _STEP_3):
        pattern = f"^(.*?)({'|'.join(sorted(table, key=len, reverse=True))})$"
        known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
        out = out.withColumns({"_root": F.regexp_extract(w, pattern, 1), "_suffix": F.regexp_extract(w, pattern, 2)})
        out = out.withColumn("_w", F.when((suffix != "") & root.rlike(_M0), F.concat(root, F.try_element_at(known, suffix))).otherwise(w))
    pattern = f"^(.*?)({'|'.join(sorted(_STEP_4, key=len, reverse=True))}|(?<=[st])ion)$"
    out = out.withColumns({"_root": F.regexp_extract(w, pattern, 1), "_suffix": F.regexp_extract(w, pattern, 2)})
    out = out.withColumn("_w", F.when((suffix != "") & root.rlike(_M1), root).otherwise(w)).withColumn("_less", cut(w, 1))
    out = out.withColumn("_w", F.when(w.rlike("e$") & (less.rlike(_M1) | (less.rlike(_M0) & ~less.rlike(_CVC))), less).otherwise(w))
    out = out.withColumn("_w", F.when(w.rlike("ll$") & cut(w, 1).rlike(_M1), cut(w, 1)).otherwise(w))
    stem = F.when(F.octet_length(F.col(word)).between(_LEAST, _MOST), w).otherwise(F.col(word))
    return out.withColumn(name, stem).drop("_less", "_root", "_suffix", "_w")


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with one mark, and the letters without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xE0, 0x250)]
    kept = [(c, d[0]) for c, d in pairs if len(d) == 2 and d[0].isascii()]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


_MARKED, _PLAIN = _folds()


def terms(text: Column) -> Column:
    """Runs of letters and digits in order, lower case, without the marks of Latin letters; not stemmed."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKED, _PLAIN), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def text_index(docs: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """id, col, pos, term, length: one row a token of the named columns; length counts the tokens of all of them.

    Texts without tokens have one row without a term, so that they count. The
    rows are written: they are the stored form of the index.
    """
    words = docs.select(F.col(id_col).alias("id"), F.array(*(F.struct(F.lit(c).alias("col"), terms(F.col(c)).alias("w")) for c in columns)).alias("c"))
    sized = words.withColumn("length", F.aggregate("c", F.lit(0), lambda a, x: a + F.size(x.w)))
    by_column = sized.select("id", "length", F.explode("c").alias("c"))
    long = by_column.select("id", "length", F.col("c.col").alias("col"), F.posexplode("c.w").alias("pos", "word"))
    # each word is stemmed once; where the vocabulary is small Spark sends it to the tokens, else a common word's rows are split
    stems = checkpointed(with_stem(long.select("word").distinct(), "word", "term"))
    out = long.join(stems, "word").select("id", "col", "pos", "term", "length")
    bare = sized.filter("length = 0").select("id", F.lit(None).cast("string").alias("col"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("term"), "length")
    return checkpointed(out.unionByName(bare))


class _Syntax(Exception):
    """The text is no query."""


def _lexemes(text: str) -> Iterator[tuple[str, str]]:
    """(kind, value): str, word, or a sign standing for itself."""
    i = 0
    while i < len(text):
        c = text[i]
        if c == '"':
            out, i = "", i + 1
            while True:
                at = text.find('"', i)
                if at < 0:
                    raise _Syntax
                out += text[i:at]
                i = at + 1
                if text[i : i + 1] != '"':
                    break
                out += '"'
                i += 1
            yield "str", out
        elif c.isspace():
            i += 1
        elif c in "(){}:*+":
            yield c, c
            i += 1
        else:
            at = i
            while i < len(text) and ((text[i].isascii() and text[i].isalnum()) or text[i] == "_" or not text[i].isascii()):
                i += 1
            if i == at:
                raise _Syntax
            word = text[at:i]
            yield (word, word) if word in ("AND", "OR", "NOT") else ("word", word)


def parse(text: str) -> tuple[list[dict], list[str]]:
    """(phrases, program) of a query; the program names phrases by number and is in postfix order.

    A word or quoted string is a phrase, and p + q one of both; * after it makes
    its last token a prefix; name: or {name name}: before it or before
    parentheses keeps it to columns. Neighbours are joined by AND and bind
    closest, then NOT, AND and OR.
    """
    found, phrases, at = list(_lexemes(text)), [], 0

    def peek(ahead: int = 0) -> str:
        return found[at + ahead][0] if at + ahead < len(found) else ""

    def take(*kinds: str) -> str:
        nonlocal at
        if peek() not in kinds:
            raise _Syntax
        at += 1
        return found[at - 1][1]

    def columns() -> list[str] | None:
        if peek() in ("word", "str") and peek(1) == ":":
            name = take("word", "str")
            take(":")
            return [name.lower()]
        if peek() != "{":
            return None
        take("{")
        names = []
        while peek() != "}":
            names.append(take("word", "str").lower())
        take("}")
        take(":")
        return names

    def one(within: list[str] | None) -> list[str]:
        own = columns()
        if own is not None:
            within = own if within is None else [c for c in own if c in within]
        if peek() == "(":
            take("(")
            out = either(within)
            take(")")
            return out
        parts = [take("word", "str")]
        while peek() == "+":
            take("+")
            parts.append(take("word", "str"))
        prefix = peek() == "*" and bool(take("*"))
        phrases.append({"parts": parts, "prefix": prefix, "columns": within})
        return [str(len(phrases) - 1)]

    def joined(of, sign: str, *signs: str):
        def run(within: list[str] | None) -> list[str]:
            out = of(within)
            while peek() in signs:
                if peek() == sign:
                    take(sign)
                out += [*of(within), sign]
            return out

        return run

    near = joined(one, "AND", "word", "str", "(", "{")
    either = joined(joined(joined(near, "NOT", "NOT"), "AND", "AND"), "OR", "OR")
    program = either(None)
    if at < len(found):
        raise _Syntax
    return phrases, program


_PARSED = "phrases array<struct<parts: array<string>, prefix: boolean, columns: array<string>>>, program array<string>"


def _parsed(text: Column) -> Column:
    """phrases and program of each query; null for what is none."""
    @F.arrow_udf(f"struct<{_PARSED.replace('phrases array', 'phrases: array').replace('program array', 'program: array')}>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                phrases, program = parse(t or "")
                out.append({"phrases": phrases, "program": program})
            except _Syntax:
                out.append(None)
        phrase = pa.struct([("parts", pa.list_(pa.string())), ("prefix", pa.bool_()), ("columns", pa.list_(pa.string()))])
        return pa.array(out, pa.struct([("phrases", pa.list_(phrase)), ("program", pa.list_(pa.string()))]))

    return run(text)


def search(index: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, id, score of what each query (query, text) finds in a text_index(); a higher score is better.

    A query that is no well-formed one, or has a phrase without any token, finds
    nothing there. Phrases are found by joining their tokens to postings on the
    term and grouping by where the phrase would begin, so a phrase costs its
    tokens' postings and no text is read. The score is BM25 with phrases for
    terms; one in over half of the texts weighs 1e-6.
    """
    asked = checkpointed(queries.select("query", _parsed(F.col("text")).alias("p")).filter("p is not null").select("query", "p.*"))
    each = asked.select("query", F.posexplode("phrases").alias("phrase", "p")).select("query", "phrase", "p.prefix", "p.columns", F.flatten(F.transform("p.parts", terms)).alias("words"))
    tokens = each.select("query", "phrase", "prefix", "columns", F.size("words").alias("n"), F.posexplode("words").alias("nth", "word"))
    last = F.col("prefix") & (F.col("nth") == F.col("n") - 1)
    tokens = checkpointed(with_stem(tokens.withColumn("open", last), "word", "term").select("query", "phrase", "columns", "n", "nth", "open", "term"))
    open_ = tokens.filter("open").select("term").distinct()
    lengths = [r[0] for r in open_.select(F.length("term").alias("n")).distinct().collect()]  # at most as many as a word is long
    if lengths:
        heads = index.filter("term is not null").select("term").distinct().select("term", F.explode(F.array(*(F.substring("term", 1, n) for n in lengths))).alias("head"))
        wider = tokens.filter("open").withColumnRenamed("term", "head").join(heads.distinct(), "head").drop("head")
        tokens = tokens.filter("not open").unionByName(wider)
    met = index.filter("term is not null").join(tokens, "term")
    met = met.filter(F.col("columns").isNull() | F.array_contains("columns", F.lower("col")))
    places = met.groupBy("query", "phrase", "n", "id", "col", (F.col("pos") - F.col("nth")).alias("start")).agg(F.countDistinct("nth").alias("seen"), F.first("length").alias("length")).filter("seen = n")
    hits = checkpointed(places.groupBy("query", "phrase", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length")))
    texts = index.groupBy("id").agg(F.first("length").alias("length")).agg(F.count("*").alias("total"), F.avg("length").alias("mean"))  # one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    known = hits.groupBy("query", "phrase").agg(F.count("*").alias("df")).join(F.broadcast(texts)).select("query", "phrase", idf.alias("idf"), "mean")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = hits.join(known, ["query", "phrase"]).groupBy("query", "id").agg(F.sum(part).alias("score"), F.collect_set("phrase").alias("seen"))
    return scored.join(asked.select("query", "program"), "query").filter(_holds(F.col("program"), F.col("seen"))).select("query", "id", "score")


def _holds(program: Column, seen: Column) -> Column:
    """Does a program hold for a set of phrases? It is run on a stack, an array whose first element is the top."""

    def step(stack: Column, sign: Column) -> Column:
        top, under, rest = F.get(stack, F.lit(0)), F.get(stack, F.lit(1)), F.slice(stack, F.lit(3), F.greatest(F.size(stack) - 2, F.lit(0)))
        both = F.when(sign == "AND", under & top).when(sign == "OR", under | top).otherwise(under & ~top)
        return F.when(sign.isin("AND", "OR", "NOT"), F.concat(F.array(both), rest)).otherwise(F.concat(F.array(F.array_contains(seen, sign.try_cast("int"))), stack))

    return F.element_at(F.aggregate(program, F.array().cast("array<boolean>"), step), 1)


def top_texts(found: DataFrame, k: int = 20) -> DataFrame:
    """query, id, score, rank from 0 of each query's k best; ties by id."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by) - 1).filter(F.col("rank") < k)

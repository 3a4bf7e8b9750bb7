"""Unified diffs as relations of files, lines and hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def diff_lines(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "text") -> DataFrame:
    """One row per line of each diff: pos, line, old_path, path, block_line, kind, hunk.

    path is what follows the first ` b/` of the file's header and is filled
    forward; block_line counts a file's lines from 1 at its header. kind is
    header, added, removed or context. hunk counts a file's hunks from 1, 0
    before the first. Lines before any file header are left out. Diffs are dealt
    out by id, and each is cut into files, hunks and lines in its own row.
    """
    from riskloom.sources.store import dealt

    whole = dealt(diffs.select(id_col, F.col(text_col).alias("_text")), id_col).select(id_col, F.split("_text", "\n").alias("_l"))
    heads = F.filter(F.transform("_l", lambda x, i: F.when(x.startswith("diff --git "), i)), lambda i: i.isNotNull())
    files = whole.select(id_col, "_l", heads.alias("_b")).select(id_col, F.explode(_slices("_l", "_b")).alias("_f"))
    head = F.element_at("_f.lines", 1)
    tail = F.substring_index(F.regexp_replace(head, "^diff --git a/", ""), " b/", 1)
    own = files.select(id_col, F.col("_f.at").alias("_at"), F.col("_f.lines").alias("_l"), F.regexp_extract(head, r"^.*? b/(.*)$", 1).alias("path"), tail.alias("old_path"))
    starts = F.filter(F.transform("_l", lambda x, i: F.when((i == 0) | x.rlike(_HUNK), i)), lambda i: i.isNotNull())
    hunks = own.withColumn("_b", starts).select(id_col, "_at", "path", "old_path", F.posexplode(_slices("_l", "_b")).alias("_n", "_h"))
    lines = hunks.select(id_col, "_at", "path", "old_path", "_n", F.col("_h.at").alias("_in"), F.posexplode("_h.lines").alias("_i", "line"))
    place = F.col("_in") + F.col("_i")
    hunk = F.col("_n").cast("long")
    named = lines.select(id_col, (F.col("_at") + place).alias("pos"), "line", "path", "old_path", (place + 1).alias("block_line"), hunk.alias("hunk"))
    meta = F.col("line").rlike(r"^(diff --git |index |new file|deleted file|similarity |rename |old mode|new mode|--- |\+\+\+ |@@ )")
    kind = (
        F.when(meta & ((F.col("hunk") == 0) | F.col("line").rlike("^@@ |^(---|\\+\\+\\+) ")), "header")
        .when(F.col("line").startswith("+"), "added")
        .when(F.col("line").startswith("-"), "removed")
        .otherwise("context")
    )
    return named.withColumn("kind", kind)


def _slices(lines: str, starts: str) -> Column:
    """at, lines of each slice of an array that begins at one of these places, counted from 0, and ends before the next."""
    end = lambda n: F.coalesce(F.get(starts, n + 1), F.size(lines))
    return F.transform(starts, lambda s, n: F.struct(s.alias("at"), F.slice(lines, s + 1, end(n) - s).alias("lines")))


def diff_files(lines: DataFrame, id_col: str = "diff_id") -> DataFrame:
    """One row per file of a diff: path, is_new_file, is_deleted, hunks[start_line, line_count] in order."""
    start = F.regexp_extract("line", _HUNK, 1)
    count = F.regexp_extract("line", _HUNK, 2)
    hunk = F.when(F.col("line").rlike(_HUNK), F.struct(F.col("pos"), start.cast("int").alias("start_line"), F.when(count == "", 1).otherwise(count.cast("int")).alias("line_count")))
    grouped = lines.groupBy(id_col, "path").agg(
        F.bool_or(F.col("line").startswith("new file") & (F.col("hunk") == 0)).alias("is_new_file"),
        F.bool_or(F.col("line").startswith("deleted file") & (F.col("hunk") == 0)).alias("is_deleted"),
        F.sort_array(F.collect_list(hunk)).alias("h"),
    )
    return grouped.select(id_col, "path", "is_new_file", "is_deleted", F.transform("h", lambda h: F.struct(h.start_line.alias("start_line"), h.line_count.alias("line_count"))).alias("hunks"))


def is_added(line: Column) -> Column:
    return line.startswith("+") & ~line.startswith("+++")


def is_removed(line: Column) -> Column:
    return line.startswith("-") & ~line.startswith("---")


def change_counts(lines: DataFrame, id_col: str = "diff_id") -> DataFrame:
    """Changed files and changed lines of each diff."""
    changed = is_added(F.col("line")) | is_removed(F.col("line"))
    return lines.groupBy(id_col).agg(F.countDistinct("path").alias("n_files"), F.count_if(changed).alias("n_changed"))


def same_path_blocks(lines: DataFrame) -> DataFrame:
    """Lines of files whose old and new path are equal; a renamed file has none."""
    return lines.filter("path = old_path and not contains(path, ' ')")


def diff_for_files(lines: DataFrame, files: DataFrame, id_col: str = "diff_id") -> DataFrame:
    """The diff text restricted to files (column file): equal paths or paths that end in / and the file.

    A suffix is matched by equality: each path is expanded to its suffixes, so
    the join hashes and no pair of all lines with all files is formed.
    """
    paths = lines.select("path").distinct()
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    wanted = paths.select("path", F.explode(tails).alias("file")).join(files.select("file").distinct(), "file", "left_semi").select("path").distinct()
    kept = lines.join(wanted, "path", "left_semi")
    own = Window.partitionBy(id_col, "path")
    body = kept.withColumn("_rows", F.count("*").over(own)).filter("_rows > 1")  # a header needs a line after it
    return body.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("text"))


def hunks_for_symbols(lines: DataFrame, symbols: DataFrame, id_col: str = "diff_id", before: int = 3, after: int = 150) -> DataFrame:
    """The diff text restricted to hunks near symbols (file, start_line); the whole diff where none is.

    A hunk stays if it begins at most `after` lines below a symbol and ends at
    most `before` lines above it.
    """
    rows = lines.withColumns({"_s": F.when(F.col("line").rlike(_HUNK), F.regexp_extract("line", _HUNK, 1).cast("int")), "_n": F.regexp_extract("line", _HUNK, 2)})
    heads = rows.filter("_s is not null").select(id_col, "path", "hunk", "_s", (F.col("_s") + F.when(F.col("_n") == "", 1).otherwise(F.col("_n").cast("int")) - 1).alias("_e"))
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    near = heads.withColumn("file", F.explode(tails)).join(symbols.select("file", "start_line"), "file")
    near = near.filter((F.col("_s") <= F.col("start_line") + after) & (F.col("_e") >= F.col("start_line") - before))
    kept = near.select(id_col, "path", "hunk").distinct()
    some = kept.select(id_col, "path").distinct().withColumn("hunk", F.lit(0).cast("long"))
    chosen = lines.join(kept.unionByName(some), [id_col, "path", "hunk"], "left_semi")
    text = lambda df: df.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("text"))
    return text(lines).withColumnRenamed("text", "_all").join(text(chosen), id_col, "left").select(id_col, F.coalesce("text", "_all").alias("text"))


def merge_request_diff(changes: DataFrame, id_col: str = "diff_id") -> DataFrame:
    """A unified diff from change rows (seq, old_path, new_path, new_file, deleted_file, renamed_file, diff)."""
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("diff --git a/"), "old_path", F.lit(" b/"), "new_path"),
        F.when(F.col("new_file"), "new file mode 100644"),
        F.when(F.col("deleted_file"), "deleted file mode 100644"),
        F.when(F.col("renamed_file"), F.concat(F.lit("rename from "), "old_path", F.lit("\nrename to "), "new_path")),
        F.concat(F.lit("--- "), F.when(F.col("new_file"), "/dev/null").otherwise(F.concat(F.lit("a/"), "old_path"))),
        F.concat(F.lit("+++ "), F.when(F.col("deleted_file"), "/dev/null").otherwise(F.concat(F.lit("b/"), "new_path"))),
        F.rtrim(F.col("diff"), F.lit("\n")),
    )
    return changes.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", head.alias("t")))), lambda x: x.t), "\n").alias("text"))


def apply_patch(patches: DataFrame, files: DataFrame) -> DataFrame:
    """Apply hunks by content: (path, seq, old_lines, new_lines) on (path, lines).

    Where patches have a diff_id, each diff is applied on its own and gives its
    own row of a file. Each hunk replaces the first block of lines that equals its old lines, up to
    trailing blanks. A hunk without old lines does nothing. ok is false, and
    lines stay, if any hunk finds no block. Hunks fold over one file's lines,
    which must fit a row.
    """
    trimmed = lambda a: F.transform(a, lambda x: F.rtrim(x))
    own = [c for c in ("diff_id", "path") if c in patches.columns]
    bare = patches.select(*own, "seq", "old_lines", "new_lines", trimmed(F.col("old_lines")).alias("old_bare"), trimmed(F.col("new_lines")).alias("new_bare"))
    hunks = bare.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("seq", "old_lines", "new_lines", "old_bare", "new_bare"))).alias("hunks"))

    def step(state: Column, h: Column) -> Column:
        size = F.size(h.old_lines)
        room = F.greatest(F.size(state.bare) - size + 1, F.lit(0))
        places = F.when(room > 0, F.sequence(F.lit(1), room)).otherwise(F.array().cast("array<int>"))
        first = F.try_element_at(h.old_bare, F.lit(1))
        found = F.filter(places, lambda i: (F.element_at(state.bare, i) == first) & (F.slice(state.bare, i, size) == h.old_bare))
        at = F.try_element_at(found, F.lit(1))
        put = lambda old, new: F.concat(F.slice(old, F.lit(1), at - 1), new, F.slice(old, at + size, F.size(old)))
        hit = (size > 0) & at.isNotNull()
        return F.struct(
            F.when(hit, put(state.lines, h.new_lines)).otherwise(state.lines).alias("lines"),
            F.when(hit, put(state.bare, h.new_bare)).otherwise(state.bare).alias("bare"),
            (state.ok & ((size == 0) | at.isNotNull())).alias("ok"),
        )

    start = F.struct(F.col("lines"), trimmed(F.col("lines")).alias("bare"), F.lit(True).alias("ok"))
    done = files.join(hunks, "path").withColumn("r", F.aggregate("hunks", start, step))
    return done.select(*own, F.when(F.col("r.ok"), F.col("r.lines")).otherwise(F.col("lines")).alias("lines"), F.col("r.ok").alias("ok"))


def patch_hunks(lines: DataFrame, id_col: str = "diff_id") -> DataFrame:
    """diff_id, path, seq, old_lines, new_lines of each hunk, for apply_patch()."""
    body = lines.filter("hunk > 0 and kind <> 'header'")
    part = lambda keep: F.transform(F.filter(F.sort_array(F.collect_list(F.struct("pos", "kind", "line"))), keep), lambda x: F.substr(x.line, F.lit(2)))
    return body.groupBy(F.col(id_col).alias("diff_id"), "path", F.col("hunk").alias("seq")).agg(part(lambda x: x.kind != "added").alias("old_lines"), part(lambda x: x.kind != "removed").alias("new_lines"))


def merge_request_meta(replies: DataFrame, column: str = "reply") -> DataFrame:
    """The three commits of a merge request from its JSON."""
    parsed = F.from_json(column, "struct<diff_refs: struct<base_sha: string, head_sha: string, start_sha: string>>")
    return replies.withColumn("_m", parsed.getField("diff_refs")).select(*replies.columns, "_m.base_sha", "_m.head_sha", "_m.start_sha")


def changed_lines(lines: DataFrame, id_col: str = "diff_id") -> DataFrame:
    """diff_id, file, line of added lines by their number in the new file, and of the place of removed ones."""
    start = F.regexp_extract("line", _HUNK, 1)
    inside = lines.filter("hunk > 0").withColumn("_s", F.when(start != "", start.cast("int")))
    own = Window.partitionBy(id_col, "path", "hunk").orderBy("pos")
    step = F.when(F.col("_s").isNotNull() | (F.col("kind") == "removed"), 0).otherwise(1)
    at = F.first("_s").over(own) + F.sum(step).over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1
    numbered = inside.withColumn("_n", F.when(F.col("kind") == "removed", F.greatest(at + 1, F.lit(1))).otherwise(at))
    return numbered.filter("kind in ('added', 'removed')").select(F.col(id_col).alias("diff_id"), F.col("path").alias("file"), F.col("_n").alias("line")).distinct()

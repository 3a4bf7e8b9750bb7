"""First-match rules over lines of schema migrations, and file routing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import contains_any, extension
from riskloom.sources.diff import is_added, same_path_blocks


@dataclass(frozen=True)
class Rule:
    """A pattern and what it means; table and column are group numbers, 0 for none."""

    operation: str
    risk: str
    pattern: str
    table: int = 0
    column: int = 0
    reason: str = ""
    suggestion: str = ""


#: Patterns, operations and risks, tried in this order.
DDL = (
    Rule("DROP TABLE", "high", r"(?is)DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?(\w+)", 1, 0, "the data is lost for good", "back up, rename and watch before dropping"),
    Rule("DROP COLUMN", "high", r"(?is)ALTER\s+TABLE\s+(\w+)\s+DROP\s+COLUMN\s+(\w+)", 1, 2, "the column's data is lost for good", "deprecate the column until nothing reads or writes it"),
    Rule("RENAME COLUMN", "high", r"(?is)ALTER\s+TABLE\s+(\w+)\s+RENAME\s+(?:COLUMN\s+)?(\w+)\s+TO\s+(\w+)", 1, 2, "queries and mappings of the old name break", "add the new column, write both, move the data, then drop the old one"),
    Rule("ALTER COLUMN TYPE", "high", r"(?is)ALTER\s+TABLE\s+(\w+)\s+(?:ALTER|MODIFY)\s+COLUMN\s+(\w+)\s+(\w+)", 1, 2, "values may be cut silently", "check that stored values fit the new type"),
    Rule("ADD COLUMN NOT NULL", "high", r"(?is)ALTER\s+TABLE\s+(\w+)\s+ADD\s+COLUMN\s+(\w+)\s+\w+.*NOT\s+NULL(?!.*DEFAULT)", 1, 2, "inserts without the column fail", "give a default until all rows have a value"),
    Rule("ADD COLUMN NOT NULL DEFAULT", "medium", r"(?is)ALTER\s+TABLE\s+(\w+)\s+ADD\s+COLUMN\s+(\w+)\s+\w+.*NOT\s+NULL.*DEFAULT", 1, 2, "a large table may be locked whole", "migrate a large table in batches"),
    Rule("ADD COLUMN", "low", r"(?is)ALTER\s+TABLE\s+(\w+)\s+ADD\s+COLUMN\s+(\w+)", 1, 2, "a nullable column is compatible"),
    Rule("CREATE INDEX CONCURRENTLY", "low", r"(?is)CREATE\s+INDEX\s+CONCURRENTLY\s+(\w+)", 0, 0, "no lock is held"),
    Rule("CREATE INDEX", "medium", r"(?is)CREATE\s+INDEX\s+(\w+)", 0, 0, "the table is locked meanwhile", "use CREATE INDEX CONCURRENTLY"),
    Rule("DROP INDEX", "low", r"(?is)DROP\s+INDEX\s+(\w+)", 0, 0, "queries that use the index slow down", "check that no slow query needs it"),
    Rule("CREATE TABLE", "low", r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)", 1, 0, "a new table breaks nothing"),
)
#: Alembic calls.
ALEMBIC = (
    Rule("DROP TABLE", "high", r"op\.drop_table\(\s*['\"](\w+)['\"]", 1, 0, "the data is lost for good"),
    Rule("DROP COLUMN", "high", r"op\.drop_column\(\s*['\"](\w+)['\"]\s*,\s*['\"](\w+)['\"]", 1, 2, "the column's data is lost for good"),
    Rule("ADD COLUMN", "high", r"(?i)op\.add_column\(\s*['\"](\w+)['\"]\s*,\s*.*Column\((?=\s*['\"](\w+)['\"])?.*nullable\s*=\s*False", 1, 2, "inserts without the column fail", "set server_default until all rows have a value"),
    Rule("ADD COLUMN", "low", r"(?i)op\.add_column\(\s*['\"](\w+)['\"]\s*,\s*.*Column\((?=\s*['\"](\w+)['\"])?.*nullable\s*=\s*True", 1, 2, "a nullable column is compatible"),
    Rule("RENAME COLUMN", "high", r"op\.alter_column\(.*new_column_name", 0, 0, "mappings of the old name break"),
)
#: Entity Framework calls. The name stands before the table.
EF_CORE = (
    Rule("DROP TABLE", "high", r"(?i)migrationBuilder\.DropTable\(.*?name:\s*\"(\w+)\"", 1, 0, "the data is lost for good"),
    Rule("DROP COLUMN", "high", r"(?i)migrationBuilder\.DropColumn\(.*?name:\s*\"(\w+)\".*?table:\s*\"(\w+)\"", 2, 1, "the column's data is lost for good"),
    Rule("ADD COLUMN", "high", r"(?is)migrationBuilder\.AddColumn<.*?>\(.*?name:\s*\"(\w+)\".*?table:\s*\"(\w+)\".*nullable: false", 2, 1, "inserts without the column fail"),
    Rule("ADD COLUMN", "low", r"(?is)migrationBuilder\.AddColumn<.*?>\(.*?name:\s*\"(\w+)\".*?table:\s*\"(\w+)\"", 2, 1, "a nullable column is compatible"),
)
#: Django operations over all added lines of a file, models first; the flag says whether null=True makes it low.
DJANGO = (
    ("DROP TABLE", r"(?is)migrations\.DeleteModel\(.*?name=['\"](\w+)['\"]", False),
    ("DROP COLUMN", r"(?is)migrations\.RemoveField\(.*?model_name=['\"](\w+)['\"].*?name=['\"](\w+)['\"]", False),
    ("ADD COLUMN", r"(?is)migrations\.AddField\(.*?model_name=['\"](\w+)['\"].*?name=['\"](\w+)['\"].*?field=.*?null\s*=\s*(True|False)", True),
)
#: Paths of migrations.
MIGRATION_PATHS = (r"(?i)\.sql$", r"(?i)alembic/versions/.*\.py$", r"Migrations/.*Migration\.cs$", r"Migrations/.*\.cs$", r"(?i).*/migrations/\d+.*\.py$", r"(?i)database/migrations/.*\.php$")
#: Paths of API descriptions.
OPENAPI_PATH, PROTO_PATH = r"(?i)(swagger|openapi|api[-_]docs?)\.(json|ya?ml)$", r"(?i)\.proto$"

ITEM = ("operation", "table", "column", "risk", "reason", "suggestion")


def first_match(line: Column, rules: Sequence[Rule]) -> Column:
    """A struct of the first rule that fits, null for none. `(?U)` makes \\w fit all letters."""
    out = None
    for r in rules:
        p = "(?U)" + r.pattern
        part = lambda g, p=p: F.regexp_extract(line, p, g) if g else F.lit("")
        value = F.struct(
            F.lit(r.operation).alias("operation"),
            part(r.table).alias("table"),
            part(r.column).alias("column"),
            F.lit(r.risk).alias("risk"),
            F.lit(r.reason).alias("reason"),
            F.lit(r.suggestion).alias("suggestion"),
        )
        out = F.when(line.rlike(p), value) if out is None else out.when(line.rlike(p), value)
    return out


def ddl_rule(line: Column) -> Column:
    """The first DDL rule of a line without its sign; comments have none."""
    text = F.trim(line)
    verb = contains_any(F.upper(text), ("DROP", "ALTER", "CREATE"))  # every rule has one; most lines have none
    return F.when(verb & ~text.startswith("--"), first_match(text, DDL))


def is_migration(path: Column) -> Column:
    out = F.lit(False)
    for p in MIGRATION_PATHS:
        out = out | path.rlike(p)
    return out


def schema_kind(path: Column) -> Column:
    return F.when(path.rlike(OPENAPI_PATH), "openapi").when(path.rlike(PROTO_PATH), "proto")


def migration_findings(lines: DataFrame, id_col: str = "diff_id") -> DataFrame:
    """Findings of migration files in diff lines; see diff_lines() for the input.

    line counts the file's block from 1, and is 0 for Django, whose operations
    span lines. SQL and PHP use the DDL rules, C# those of Entity Framework,
    Python those of Alembic under an alembic path and else of Django.
    """
    own = same_path_blocks(lines).filter(is_migration(F.col("path")))
    added = own.filter(is_added(F.col("line"))).withColumn("code", F.substr("line", F.lit(2)))
    ext = extension(F.col("path"))
    alembic = F.contains(F.lower("path"), F.lit("alembic"))
    rule = (
        F.when(ext.isin(".sql", ".php"), ddl_rule(F.col("code")))
        .when(ext == ".cs", first_match(F.col("code"), EF_CORE))
        .when((ext == ".py") & alembic, first_match(F.col("code"), ALEMBIC))
    )
    by_line = added.withColumn("r", rule).filter("r is not null").select(id_col, "path", F.col("block_line").alias("line"), F.lit(0).alias("nth"), *(F.col(f"r.{c}") for c in ITEM))
    django = added.filter((ext == ".py") & ~alembic).groupBy(id_col, "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x.code), "\n").alias("text"))
    found = None
    for k, (operation, pattern, flagged) in enumerate(DJANGO):
        p = "(?U)" + pattern
        hits = django.select(id_col, "path", F.posexplode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("at", "hit"))
        low = F.lower(F.regexp_extract("hit", p, 3)) == "true" if flagged else F.lit(False)
        row = hits.select(
            id_col,
            "path",
            F.lit(0).alias("line"),
            (F.lit(k * 10_000) + F.col("at")).alias("nth"),
            F.lit(operation).alias("operation"),
            F.regexp_extract("hit", p, 1).alias("table"),
            (F.regexp_extract("hit", p, 2) if k else F.lit("")).alias("column"),
            F.when(low, "low").otherwise("high").alias("risk"),
            F.when(low, "a nullable column is compatible").otherwise("cannot be undone, or old rows break").alias("reason"),
            F.lit("").alias("suggestion"),
        )
        found = row if found is None else found.unionByName(row)
    return by_line.unionByName(found).withColumn("needs_human_review", F.lit(True))

"""Reviews in which many diffs touch one path, and API documents as they are in practice, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import contracts as C
from riskloom.plans import review as V
from riskloom.plans.findings_queries import table
from riskloom.sources import diff as D


def _keyed(text: str):
    return F.replace(F.lit(text), F.lit("{k}"), F.col("p_partkey").cast("string"))


def shared_lines(spark, sf_dir):
    """Changed lines of a diff for each part, all of them of three files."""
    name = F.concat(F.lit("src/s"), (F.col("p_partkey") % 3).cast("string"), F.lit(".ts"))
    text = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, _keyed("\n@@ -{k},2 +{k},3 @@\n ctx\n-old\n+new\n+newer\n@@ -9{k}0 +9{k}0 @@\n+tail"))
    lines = D.diff_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("diff_id"), text.alias("text")))
    return D.changed_lines(lines).select("diff_id", "file", F.col("line").cast("long").alias("line"))


SHARED_LINES = """
SELECT p_partkey AS diff_id, 'src/s' || (p_partkey % 3) || '.ts' AS file, p_partkey + 1 AS line FROM part
UNION ALL SELECT p_partkey, 'src/s' || (p_partkey % 3) || '.ts', p_partkey + 2 FROM part
UNION ALL SELECT p_partkey, 'src/s' || (p_partkey % 3) || '.ts', CAST('9' || p_partkey || '0' AS BIGINT) FROM part"""


def shared_patches(spark, sf_dir):
    """Each of many diffs applied to one file."""
    p = table(spark, sf_dir, "part")
    text = _keyed("diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n a\n-b\n+b{k}\n@@ -4,1 +4,1 @@\n-d\n+d{k}")
    hunks = D.patch_hunks(D.diff_lines(p.select(F.col("p_partkey").alias("diff_id"), text.alias("text"))))
    file = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit("f").alias("path"), F.array(*map(F.lit, "abcd")).alias("lines"))
    return D.apply_patch(hunks, file).select("diff_id", "path", F.array_join("lines", "|").alias("text"), "ok")


SHARED_PATCHES = "SELECT p_partkey AS diff_id, 'f' AS path, 'a|b' || p_partkey || '|c|d' || p_partkey AS text, true AS ok FROM part WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = 0)"


def shared_review(spark, sf_dir):
    """Findings of a diff for each part, all of one message file, one migration and one API document.

    One diff removes the field that another adds, and each must be told.
    """
    p = table(spark, sf_dir, "part")
    sign = F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("+")
    text = F.concat(F.lit("diff --git a/a.proto b/a.proto\n--- a/a.proto\n+++ b/a.proto\n@@ -1 +1 @@\n"), sign, F.lit("  string name = 1;\ndiff --git a/db/1.sql b/db/1.sql\n@@ -0,0 +1 @@\n"), _keyed("+DROP TABLE t{k};"))
    old, new = '{"paths": {"/a": {"summary": "s", "get": {}}, "/b": {"get": {}}}}', '{"paths": {"/a": {"summary": "t", "get": {}}}}'
    specs = p.select(F.col("p_partkey").alias("diff_id"), F.lit("openapi.json").alias("file"), F.lit(old).alias("old"), F.when(F.col("p_partkey") % 5 == 0, new).otherwise(old).alias("new"))
    found = V.static_review(p.select(F.col("p_partkey").alias("diff_id"), text.alias("text")), specs)
    return found.select("diff_id", "file", F.col("line").cast("long").alias("line"), "risk", "kind", "what")


SHARED_REVIEW = """
SELECT p_partkey AS diff_id, 'a.proto' AS file, CAST(0 AS BIGINT) AS line, CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END AS risk, 'api' AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'removed_field name' ELSE 'added_field name' END AS what FROM part
UNION ALL SELECT p_partkey, 'db/1.sql', 3, 'high', 'migration', 'DROP TABLE t' || p_partkey || ' ' FROM part
UNION ALL SELECT p_partkey, 'openapi.json', 0, 'high', 'api', 'removed_endpoint /b' FROM part WHERE p_partkey % 5 = 0"""

#: Documents with what stands beside methods in practice: shared parameters, summaries, extensions, lists of types, references.
_OLD_SPEC = """{"openapi": "3.1.0", "x-owner": ["a", 1], "paths": {"x-note": "n", "/a": {"parameters": [{"name": "id"}], "summary": "get: {}", "x-rate": 5, "get": {"tags": ["t"]},
 "post": {"requestBody": {"description": "d", "content": {"text/plain": {}, "application/json": {"schema": {"type": "object", "properties": {"x": {"type": "string"}, "y": {"type": ["string", "null"]}, "z": {"$ref": "#/z"}}, "required": ["x"]}}}}}},
 "/b": {"parameters": [], "get": {}}, "/c": null}}"""
_NEW_SPECS = (
    _OLD_SPEC.replace('"get": {"tags": ["t"]},', ""),
    _OLD_SPEC.replace('"x": {"type": "string"}', '"x": {"type": "integer"}'),
    _OLD_SPEC.replace('["string", "null"]', '"string"'),
    _OLD_SPEC.replace('"z": {"$ref": "#/z"}', '"z": {"type": "string"}, "w": {"type": "string"}').replace('"/c": null', '"/d": {"get": {}, "parameters": [1]}'),
    _OLD_SPEC.replace('"summary": "get: {}", ', "").replace('"required": ["x"]', '"required": ["x", "z"]'),
    _OLD_SPEC.replace('"openapi": "3.1.0"', '"openapi": "3.0.0"'),
    '["no", "document"]',
)


def spec_documents(spark, sf_dir):
    new = F.lit(None).cast("string")
    for i, t in enumerate(_NEW_SPECS):
        new = F.when(F.col("p_partkey") % len(_NEW_SPECS) == i, F.lit(t)).otherwise(new)
    specs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("diff_id"), F.lit("openapi.json").alias("file"), F.lit(_OLD_SPEC).alias("old"), new.alias("new"))
    return C.openapi_findings(specs, by=("diff_id", "file")).select("diff_id", "file", "change_type", "item", "risk")


SPEC_DOCUMENTS = """
WITH c(m, t, i, r) AS (VALUES (0, 'removed_method', 'GET /a', 'high'), (1, 'changed_field_type', 'POST /a → x', 'high'), (2, 'changed_field_type', 'POST /a → y', 'high'), (3, 'added_optional_field', 'POST /a → w', 'low'), (3, 'removed_endpoint', '/c', 'high'),
  (3, 'added_endpoint', 'GET /d', 'low'), (3, 'added_endpoint', 'PARAMETERS /d', 'low'), (4, 'removed_method', 'SUMMARY /a', 'high'), (4, 'added_required_field', 'POST /a → z', 'high'))
SELECT p_partkey AS diff_id, 'openapi.json' AS file, t AS change_type, i AS item, r AS risk FROM part JOIN c ON p_partkey % 7 = m"""

QUERIES = {
    "shared_lines": (shared_lines, SHARED_LINES),
    "shared_patches": (shared_patches, SHARED_PATCHES),
    "shared_review": (shared_review, SHARED_REVIEW),
    "spec_documents": (spec_documents, SPEC_DOCUMENTS),
}

"""Changes of API descriptions: OpenAPI documents and protobuf messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.diff import is_added, is_removed
from riskloom.sources.store import dealt

_FIELD = r"(?U)^\s*(?:repeated\s+)?(\w+)\s+(\w+)\s*=\s*(\d+)\s*;"
_ENUM = r"^\s*([A-Z][A-Z0-9_]+)\s*=\s*(\d+)\s*;"
#: An object of which each value is kept as JSON text, so that values of any kind may stand side by side.
_OBJECT = "map<string, string>"


def proto_findings(lines: DataFrame, by: tuple = ("diff_id", "path")) -> DataFrame:
    """Changed, renamed, removed and added fields and removed enum values of .proto files in diff lines.

    Each diff is compared on its own: `by` names the diff and the path.

    Of lines that name a field twice the last counts. A renamed field is found
    by its number; the new name also counts as added.
    """
    keys = list(by)
    own = lines.filter(F.col("path").endswith(".proto"))
    removed, added = is_removed(F.col("line")), is_added(F.col("line"))
    code = own.filter(removed | added).select(*keys, "pos", F.when(removed, "old").otherwise("new").alias("side"), F.substr("line", F.lit(2)).alias("code"))
    part = lambda n: F.regexp_extract("code", _FIELD, n)
    fields = code.filter(F.col("code").rlike(_FIELD)).select(*keys, "pos", "side", part(2).alias("name"), part(1).alias("type"), part(3).cast("long").alias("number"))
    last = lambda side: F.max_by(F.struct("type", "number"), F.when(F.col("side") == side, F.col("pos"))).alias(side)
    both = fields.groupBy(*keys, "name").agg(last("old"), last("new"))  # both sides of a name meet in one aggregate
    again = fields.filter("side = 'new'").groupBy(*keys, "number").agg(F.max_by(F.struct("name", "type"), "pos").alias("again"))
    gone = both.withColumn("number", F.col("old.number")).join(again, [*keys, "number"], "left")
    renamed = F.col("new").isNull() & F.col("again").isNotNull()
    kind = (
        F.when(F.col("old").isNull(), "added_field")
        .when(F.col("new").isNotNull() & (F.col("old.number") != F.col("new.number")), "changed_field_number")
        .when(F.col("new").isNotNull() & (F.col("old.type") != F.col("new.type")), "changed_field_type")
        .when(F.col("new").isNotNull(), None)
        .when(renamed & (F.col("old.type") == F.col("again.type")), "renamed_field")
        .when(renamed, "changed_field_type")
        .otherwise("removed_field")
    )
    fields = gone.withColumn("change_type", kind).filter("change_type is not null")
    item = F.when(F.col("change_type") == "renamed_field", F.concat_ws(" → ", "name", "again.name")).otherwise(F.col("name"))
    enum = code.filter(F.col("code").rlike(_ENUM)).select(*keys, "side", F.regexp_extract("code", _ENUM, 1).alias("name"))
    enums = enum.groupBy(*keys, "name").agg(F.bool_or(F.col("side") == "new").alias("new")).filter("not new")
    out = fields.select(*keys, "change_type", item.alias("item")).unionByName(enums.select(*keys, F.lit("removed_enum_value").alias("change_type"), F.col("name").alias("item")))
    return out.withColumn("risk", F.when(F.col("change_type").isin("added_field", "renamed_field"), "low").otherwise("high"))


def _fields(text: Column) -> Column:
    """The fields of a JSON object in order, each as JSON text; none for what is no object."""
    return F.coalesce(F.from_json(text, _OBJECT), F.expr(f"cast(map() as {_OBJECT})"))


def _body(method: Column) -> Column:
    """Fields of the first schema of a method's request body that has any."""
    content = _fields(F.try_element_at(_fields(F.try_element_at(_fields(method), F.lit("requestBody"))), F.lit("content")))
    schemas = F.transform(F.map_values(content), lambda m: _fields(F.try_element_at(_fields(m), F.lit("schema"))))
    return F.coalesce(F.try_element_at(F.filter(schemas, lambda x: F.size(x) > 0), F.lit(1)), F.expr(f"cast(map() as {_OBJECT})"))


def openapi_findings(specs: DataFrame, old: str = "old", new: str = "new", by: str | tuple = "file") -> DataFrame:
    """Removed and added endpoints and methods, and changes of request bodies.

    specs has two JSON texts a row; YAML ones are turned to JSON before. A row
    with a text that is empty or no document gives nothing. Whatever stands
    under a path counts as one of its methods, as summary or parameters do; only
    objects have a request body. Types are compared as JSON, so a list of types
    differs from one of them. `by` names the columns that identify a row.
    """
    keys = [by] if isinstance(by, str) else list(by)
    whole = specs.filter((F.size(F.json_object_keys(old)) > 0) & (F.size(F.json_object_keys(new)) > 0))
    side = lambda text: _fields(F.try_element_at(_fields(F.col(text)), F.lit("paths")))
    has = lambda m, k: F.map_contains_key(m, k)
    # both texts stand in one row, so their paths meet there, without a join
    maps = dealt(whole.select(*keys, old, new), *keys).select(*keys, side(old).alias("o"), side(new).alias("n"))
    each = maps.select(*keys, "o", "n", F.explode(F.array_union(F.map_keys("o"), F.map_keys("n"))).alias("path"))
    value = lambda m: F.when(has(m, F.col("path")), _fields(F.try_element_at(m, F.col("path"))))
    paths = each.select(*keys, "path", value("o").alias("om"), value("n").alias("nm"))
    label = F.concat_ws(" ", F.upper("method"), "path")
    told = lambda kind, item: F.struct(F.lit(kind).alias("change_type"), item.alias("item"))
    methods = lambda kind, found: F.transform(found, lambda m: told(kind, F.concat_ws(" ", F.upper(m), F.col("path"))))
    of_path = (
        F.when(F.col("nm").isNull(), F.array(told("removed_endpoint", F.col("path"))))
        .when(F.col("om").isNull(), methods("added_endpoint", F.map_keys("nm")))
        .otherwise(methods("removed_method", F.filter(F.map_keys("om"), lambda m: ~has("nm", m))))
    )
    ends = paths.select(*keys, F.explode(of_path).alias("c")).select(*keys, "c.*")
    both = paths.filter("om is not null and nm is not null").select(*keys, "path", F.explode("om").alias("method", "o"), "nm")
    kept = both.filter(has("nm", F.col("method"))).select(*keys, label.alias("label"), _body(F.col("o")).alias("o"), _body(F.try_element_at("nm", F.col("method"))).alias("n"))
    names = lambda s: F.coalesce(F.from_json(F.try_element_at(s, F.lit("required")), "array<string>"), F.array().cast("array<string>"))
    part = lambda s: _fields(F.try_element_at(s, F.lit("properties")))
    bodies = kept.select(*keys, "label", part("o").alias("op"), part("n").alias("np"), names("o").alias("oq"), names("n").alias("nq"))
    kind = lambda m, k: F.nullif(F.try_element_at(_fields(F.try_element_at(m, k)), F.lit("type")), F.lit(""))
    op, np_, oq, nq = (F.col(c) for c in ("op", "np", "oq", "nq"))
    tagged = lambda found, name: F.transform(found, lambda k: F.struct(F.lit(name).alias("t"), k.alias("k")))
    changes = F.concat(
        tagged(F.filter(F.array_distinct(oq), lambda k: ~has(np_, k)), "removed_required_field"),
        tagged(F.filter(F.map_keys(op), lambda k: has(np_, k) & (kind(op, k) != kind(np_, k))), "changed_field_type"),
        tagged(F.array_except(nq, oq), "added_required_field"),
        tagged(F.filter(F.map_keys(np_), lambda k: ~has(op, k) & ~F.array_contains(nq, k)), "added_optional_field"),
    )
    fields = bodies.select(*keys, "label", F.explode(changes).alias("c")).select(*keys, F.col("c.t").alias("change_type"), F.concat_ws(" → ", "label", "c.k").alias("item"))
    out = ends.unionByName(fields)
    return out.withColumn("risk", F.when(F.col("change_type").isin("added_endpoint", "added_optional_field"), "low").otherwise("high"))


def yaml_to_json(text):
    """YAML documents as JSON texts, JSON as it is; null for what is neither. Needs a YAML library on the executors."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import json

        def one(t):
            if not t:
                return None
            if t.lstrip().startswith("{"):
                return t
            try:
                import yaml

                return json.dumps(yaml.safe_load(t))
            except Exception:
                return None

        return s.map(one)

    return run(text)

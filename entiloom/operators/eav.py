"""From flat documents to one table for each component type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import alias_of, entity_id, file_of, key_of, q, truthy
from ..sources.tables import collected

META = ("entity_id", "component_index", "modifier")


def spine(paths: DataFrame) -> DataFrame:
    """value (the id), path, alias, entity_key, filepath of every entity; paths: column path."""
    p = F.col("path")
    return paths.select("path").distinct().select(entity_id(p).alias("value"), "path", alias_of(p).alias("alias"), key_of(p).alias("entity_key"), file_of(p).alias("filepath"))


def split_pairs(pairs: DataFrame) -> DataFrame:
    """owner, spine_path, index, type, modifier, field, value, seq of pairs (path, value, seq) that were flattened
    elsewhere: `owner[index].type modifier.field`. Paths of another form drop out.

    The path is cut at its last `].`, then at the last bracket before it and the first point behind it."""
    rest = F.substring_index("path", "].", -1)
    cut = pairs.withColumn("_rest", rest).withColumn("_left", F.expr("left(path, greatest(length(path) - length(_rest) - 2, 0))"))
    cut = cut.withColumn("_at", F.substring_index("_left", "[", -1)).withColumn("_owner", F.expr("left(_left, greatest(length(_left) - length(_at) - 1, 0))"))
    whole = cut.filter("_rest != '' and _owner != '' and _at rlike '^[0-9]+$'").withColumn("_head", F.substring_index("_rest", ".", 1))
    after = lambda text, head: F.nullif(F.expr(f"substring({text}, length({head}) + 2)"), F.lit(""))
    name = whole.withColumn("_type", F.substring_index("_head", " ", 1))
    return name.select(
        F.regexp_replace("_owner", r"\.data$", "").alias("owner"), F.concat("_left", F.lit("]."), "_head").alias("spine_path"), F.col("_at").cast("bigint").alias("index"),
        F.col("_type").alias("type"), after("_head", "_type").alias("modifier"), after("_rest", "_head").alias("field"), "value", "seq",
    )


def key_value(parts: DataFrame, *also: str) -> DataFrame:
    """The long table: entity_id, entity_key, entity_path, filepath, component_index, component_type, modifier,
    spine_path, field (`value` for a plain one), value, seq, and also these columns. parts: rows as flatten() and split_pairs() give them."""
    owner = F.col("owner")
    named = {"entity_path": owner, "component_index": F.col("index"), "component_type": F.col("type"), "field": F.coalesce("field", F.lit("value"))}
    made = {"entity_id": entity_id(owner), "entity_key": key_of(owner), "filepath": file_of(owner)}
    kept = {c: F.col(c) for c in ("modifier", "spine_path", "value", "seq", *also)}
    return parts.select(*[c.alias(n) for n, c in (made | named | kept).items()])


def long_rows(flat: DataFrame) -> DataFrame:
    """key_value() of flattened documents with the column kind: their pairs, and a row without a type for each entity,
    whose path is entity_path. So both are told in one pass."""
    return key_value(flat.withColumn("owner", F.coalesce("owner", "path")), "kind")


def component_types(kv: DataFrame) -> DataFrame:
    """One row for each instance: entity_id, component_index, component_type, modifier, derived, skip_on_export; the flags
    come from component_type entries of the entity that has the type's name."""
    said = kv.filter((F.col("component_type") == "component_type") & truthy(F.col("value"))).groupBy(F.col("entity_key").alias("component_type"))
    flags = said.agg(F.max(F.col("field") == "derived").alias("derived"), F.max(F.col("field") == "skip_on_export").alias("skip_on_export"))
    out = kv.select("entity_id", "component_index", "component_type", "modifier").distinct().join(flags, "component_type", "left")
    return out.select("entity_id", "component_index", "component_type", "modifier", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("derived", "skip_on_export")])


def fields_by_type(kv: DataFrame) -> dict[str, list[str]]:
    """Field names of each type, in order of appearance; bounded by the schema, not by the rows."""
    rows = kv.groupBy("component_type", "field").agg(F.min("seq").alias("seq"))
    out: dict[str, list[str]] = {}
    for r in collected(rows, "component_type", "seq", "field"):
        out.setdefault(r.component_type, []).append(r.field)
    return out


def pivot(kv: DataFrame, component_type: str, fields: list[str]) -> DataFrame:
    """The wide table of one type. The last value of a repeated field counts, and the first modifier. Each field is a
    conditional aggregate, so one map-side combined grouping makes the whole row."""
    last = [F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f) for f in fields]
    rows = kv.filter(F.col("component_type") == component_type).groupBy("entity_id", "component_index")
    return rows.agg(F.min_by("modifier", "seq").alias("modifier"), *last)


def unpivot(table: DataFrame) -> DataFrame:
    """entity_id, component_index, modifier, field, value of all non-null fields, ids of references left out."""
    fields = [c for c in table.columns if c not in META and not c.endswith("_eid")]
    none = F.array().cast("array<struct<field:string,value:string>>")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(q(f)).cast("string").alias("value")) for f in fields]) if fields else none
    keep = F.filter(pairs, lambda x: x["value"].isNotNull())
    modifier = F.col("modifier") if "modifier" in table.columns else F.lit(None).cast("string").alias("modifier")
    return table.select("entity_id", "component_index", modifier, F.explode(keep).alias("x")).select("entity_id", "component_index", "modifier", "x.field", "x.value")

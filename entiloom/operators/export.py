"""From component tables back to documents."""

from __future__ import annotations

import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import depth_of, name_part
from .eav import META, unpivot
from .graph import hierarchy_parent, other_parents


def exportable(filepath: Column) -> Column:
    return filepath.isNotNull() & ~filepath.startswith("builtins") & ~filepath.endswith(".py")


def kept_types(component_type: DataFrame | None, names: list[str]) -> list[str]:
    """Names without derived and skipped types; flags are few rows."""
    if component_type is None or "derived" not in component_type.columns:
        return names
    drop = {r.component_type for r in component_type.filter("derived or skip_on_export").select("component_type").distinct().collect()}
    return [n for n in names if n not in drop]


def parents_left(edges: DataFrame, spine: DataFrame) -> DataFrame:
    """Parent rows that the nesting of the exported documents doesn't show, with the parent's key as value."""
    mine = edges.join(spine.filter(exportable(F.col("filepath"))).select(F.col("value").alias("entity_id")).distinct(), "entity_id", "left_semi")
    rest = other_parents(mine, hierarchy_parent(mine))
    keys = spine.groupBy(F.col("value").alias("parent_eid")).agg(F.min("entity_key").alias("value"))
    return rest.join(keys, "parent_eid", "left").select(*edges.columns, *([] if "value" in edges.columns else ["value"]))


def entries(tables: dict[str, DataFrame], spine: DataFrame) -> DataFrame:
    """entity_id, component_index, name (the type and its modifier), fields array<struct<field,value>>; no fields: a tag.

    Each type unpivots with its own columns; rows are joined to the exportable entities once, all together."""
    ids = spine.filter(exportable(F.col("filepath"))).select(F.col("value").alias("entity_id")).distinct()
    out = None
    for name, t in tables.items():
        if not {"entity_id", "component_index"} <= set(t.columns):
            continue
        rows = t if "modifier" in t.columns else t.withColumn("modifier", F.lit(None).cast("string"))
        fields = [c for c in rows.columns if c not in META and not c.endswith("_eid")]
        pairs = unpivot(rows).groupBy("entity_id", "component_index", "modifier")
        listed = pairs.agg(F.sort_array(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, fields)), F.col("field")).alias("at"), "field", "value"))).alias("fields")) if fields else None
        keys = rows.select("entity_id", "component_index", "modifier").distinct()
        if listed is None:
            keys = keys.withColumn("fields", F.array().cast("array<struct<field:string,value:string>>"))
        else:
            same = keys["entity_id"].eqNullSafe(listed["entity_id"]) & keys["component_index"].eqNullSafe(listed["component_index"]) & keys["modifier"].eqNullSafe(listed["modifier"])
            slim = F.transform("fields", lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value")))
            keys = keys.join(listed, same, "left").select(keys["*"], F.coalesce(slim, F.array().cast("array<struct<field:string,value:string>>")).alias("fields"))
        label = F.concat_ws(" ", F.lit(name), F.nullif(F.col("modifier"), F.lit("")))
        tag = (F.size("fields") == 1) & (F.get("fields", F.lit(0))["field"] == "value") & (F.get("fields", F.lit(0))["value"] == "")
        part = keys.select("entity_id", F.col("component_index").cast("bigint"), label.alias("name"), F.when(~tag, F.col("fields")).otherwise(F.array().cast("array<struct<field:string,value:string>>")).alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out.join(ids, "entity_id", "left_semi")


def ordered_spine(spine: DataFrame) -> DataFrame:
    """filepath, place, path: exported entities of each file, parents before children, then by path."""
    order = Window.partitionBy("filepath").orderBy(depth_of(F.col("path")), "path")
    return spine.filter(exportable(F.col("filepath"))).select("filepath", "value", name_part(F.col("path")).alias("path"), F.row_number().over(order).alias("place"))


def quoted(text: Column) -> Column:
    """A text as YAML (and JSON) writes it between double quotes."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def entry_line(c: Column) -> Column:
    """A component as an item of a list: its name alone, with its value, or with its fields."""
    name, fields = quoted(c["name"]), c["fields"]
    plain = (F.size(fields) == 1) & (F.get(fields, F.lit(0))["field"] == "value")
    pairs = F.array_join(F.transform(fields, lambda x: F.concat(quoted(x["field"]), F.lit(": "), quoted(x["value"]))), ", ")
    shown = F.when(F.size(fields) == 0, F.lit("")).when(plain, F.concat(F.lit(": "), quoted(F.get(fields, F.lit(0))["value"]))).otherwise(F.concat(F.lit(": {"), pairs, F.lit("}")))
    return F.concat(F.lit("- "), name, shown)


def lines(tables: dict[str, DataFrame], spine: DataFrame) -> DataFrame:
    """filepath, place, text: the YAML lines of each exported entity, in the order of its file.

    Entities come depth first, by the parts of their path, so what an entity opens is told by the one before it (parents
    without rows of their own are opened with their first child), and whether it has children by the one behind it. An
    entity with components and children keeps its own under `data`. No file is held as a whole."""
    whole = entries(tables, spine).groupBy(F.col("entity_id").alias("value")).agg(F.sort_array(F.collect_list(F.struct("component_index", "name", "fields"))).alias("components"))
    inside = spine.filter(exportable(F.col("filepath"))).select("filepath", "value", F.split(name_part(F.col("path")), r"\.").alias("parts"))
    order = Window.partitionBy("filepath").orderBy("parts", "value")
    none = F.array().cast("array<string>")
    rows = inside.join(whole, "value", "left").select(
        "filepath", F.row_number().over(order).alias("place"), "parts", F.coalesce("components", F.array().cast(whole.schema["components"].dataType)).alias("components"),
        F.coalesce(F.lag("parts").over(order), none).alias("before"), F.coalesce(F.lead("parts").over(order), none).alias("after"),
    )
    depth = F.size("parts")
    same = F.aggregate(F.sequence(F.lit(0), depth - 1), F.lit(0), lambda n, i: F.when((n == i) & F.coalesce(F.get("before", i) == F.get("parts", i), F.lit(False)), n + 1).otherwise(n))
    rows = rows.withColumn("same", same).withColumn("parent", (F.size("after") > depth) & (F.slice("after", F.lit(1), depth) == F.col("parts")))
    indent = lambda n: F.repeat(F.lit(" "), n * 4)
    open_ = F.filter(F.transform("parts", lambda x, i: F.when((i >= F.col("same")) & (i < depth - 1), F.concat(indent(i), quoted(x), F.lit(":")))), lambda x: x.isNotNull())
    own = F.size("components") > 0
    head = F.concat(indent(depth - 1), quoted(F.element_at("parts", -1)), F.when(own | F.col("parent"), ":").otherwise(": []"))
    data = F.when(own & F.col("parent"), F.array(F.concat(indent(depth), F.lit("data:")))).otherwise(none)
    deep = depth + F.col("parent").cast("int")
    items = F.transform("components", lambda c: F.concat(indent(deep), entry_line(c)))
    return rows.select("filepath", "place", F.concat(F.array_join(F.concat(open_, F.array(head), data, items), "\n"), F.lit("\n")).alias("text"))


def documents(rows: DataFrame) -> DataFrame:
    """filepath, text of lines(): documents as values, for readers that take them whole."""
    listed = F.sort_array(F.collect_list(F.struct("place", "text")))
    return rows.groupBy("filepath").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("text"))


def write_documents(rows: DataFrame, output_dir: str | None = None) -> list[str]:
    """Files written from lines(), sorted: below output_dir under the source's path, else in the source's place; a source
    that is not YAML is never overwritten, its document goes beside it. The executors write, a file as its lines come in, so
    paths must be on a file system that they share (in local mode any); the driver sees the names only."""

    def write(batches):
        name, target, part, out = None, None, None, None

        def close():
            out.close()
            part.replace(target)
            path = Path(name)
            return str(Path(output_dir or ".") / path.with_suffix(target.suffix).relative_to(path.anchor) if output_dir else target.relative_to(here) if not path.is_absolute() else target)

        for batch in batches:
            written = []
            for filepath, text in zip(batch.filepath, batch.text, strict=True):
                if filepath != name:
                    if out:
                        written.append(close())
                    path = Path(filepath)
                    target = path.with_suffix(".yaml") if path.suffix not in (".yaml", ".yml") else path
                    if output_dir:
                        target = Path(output_dir) / target.relative_to(target.anchor)
                    name, target = filepath, Path(here) / target
                    target.parent.mkdir(parents=True, exist_ok=True)
                    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")  # a task may run twice; whole files are moved into place
                    out = part.open("w", encoding="utf-8", newline="")
                out.write(text)
            yield pd.DataFrame({"path": written})
        if out:
            yield pd.DataFrame({"path": [close()]})

    here = str(Path.cwd())
    ordered = rows.repartition("filepath").sortWithinPartitions("filepath", "place").select("filepath", "text")
    return sorted(r.path for r in ordered.mapInPandas(write, "path string").collect())

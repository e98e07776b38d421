"""Schemas kept as data: compiled on the driver, applied as one projection, violations told apart in one scan."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import double_to_long, q, to_boolean, to_double, to_long
from ..functions.sums import sum_value
from ..sources.tables import collected, empty

#: Declared types that are coerced, and what to.
COERCED = {"str": "string", "bool": "boolean", "int": "bigint", "float": "double", "rating": "double"}
VIOLATION = "entity_id string, component_index bigint, component_type string, field string, value string, error_type string"


@dataclass(frozen=True)
class FieldRule:
    name: str
    type: str | None = None
    nullable: bool = True
    default: object = None
    range: object = None


def parse_range(text: object) -> object:
    if text is None or text == "":
        return None
    if not isinstance(text, str):
        return text
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def as_bool(x: object, otherwise: bool) -> bool:
    return otherwise if x is None or x == "" else x if isinstance(x, bool) else str(x).strip().lower() in ("true", "1", "yes", "t", "y")


def compile_rules(field: DataFrame, spine: DataFrame) -> dict[str, list[FieldRule]]:
    """Rules of each component type: the fields of the entities whose key is the type's name; the first definition of a
    name counts. What is collected are field definitions, as many as the schema has, so they are what is sent to the
    entities, which are scanned once and not shuffled."""
    want = [c if c in field.columns else f"null as {c}" for c in ("type", "nullable", "default", "range")]
    owned = field.selectExpr("entity_id", "component_index", "value", *[w.replace("default", "`default`").replace("range", "`range`") for w in want])
    known = spine.filter("entity_key is not null").select(F.col("value").alias("entity_id"), "entity_key", "path")
    rows = known.join(F.broadcast(owned.filter("value is not null and value != ''")), "entity_id")
    out: dict[str, dict[str, FieldRule]] = {}
    for r in collected(rows, "entity_key", "path", "component_index", "value"):
        rules = out.setdefault(r.entity_key, {})
        rules.setdefault(str(r["value"]), FieldRule(str(r["value"]), r["type"] or None, as_bool(r["nullable"], True), None if r["default"] in (None, "") else r["default"], parse_range(r["range"])))
    return {k: list(v.values()) for k, v in out.items()}


SUM = r"^[0-9.eE()\s]*[-+*/][-+*/0-9.eE()\s]*$"


def with_arithmetic(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts such as `4 / 50` in these columns become their value."""
    worked = {c: F.when(F.col(q(c)).rlike(SUM) & to_double(F.col(q(c))).isNull(), sum_value(F.col(q(c)))) for c in columns}
    return df.withColumns({c: F.coalesce(w.cast("string"), F.col(q(c))) for c, w in worked.items()}) if worked else df


def coerced(col: Column, kind: str, source: str) -> Column:
    if source == "string":
        return {"boolean": to_boolean, "bigint": to_long, "double": to_double, "string": lambda c: c}[kind](col)
    if kind == "bigint" and source in ("double", "float"):
        return double_to_long(col)
    return col.cast(kind)


def default_of(rule: FieldRule) -> Column:
    kind = COERCED.get(rule.type or "", "string")
    text = F.lit(str(rule.default))
    return coerced(text, kind, "string") if kind != "string" else text


def coerce(table: DataFrame, rules: list[FieldRule]) -> DataFrame:
    """table with every typed column present, of its type, and filled with its default. An empty text of a str column
    counts as null before its default; other rows and columns stay."""
    typed = {r.name: COERCED[r.type] for r in rules if r.type in COERCED}
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    table = with_arithmetic(table, [c for c, k in typed.items() if k in ("double", "bigint") and kinds.get(c) == "string"])
    columns = {c: F.col(q(c)) for c in table.columns}
    for rule in rules:
        kind = typed.get(rule.name)
        if kind:
            columns[rule.name] = coerced(columns[rule.name], kind, kinds[rule.name]) if rule.name in kinds else F.lit(None).cast(kind)
        if rule.default is not None and rule.name in columns:
            col = F.nullif(columns[rule.name], F.lit("")) if rule.type == "str" else columns[rule.name]
            columns[rule.name] = F.coalesce(col, default_of(rule))
    return table.select(*[c.alias(n) for n, c in columns.items()])


def violations(table: DataFrame, component_type: str, rules: list[FieldRule]) -> DataFrame:
    """Rows of VIOLATION: nulls where none may be, and text outside its list of values. One scan finds all."""
    found = []
    told = lambda name, value, kind: F.struct(F.lit(name).alias("field"), value.alias("value"), F.lit(kind).alias("error_type"))
    for rule in rules:
        if rule.name not in table.columns:
            continue
        col = F.col(q(rule.name))
        if not rule.nullable:
            found.append(F.when(col.isNull(), told(rule.name, F.lit(None).cast("string"), "nullable")))
        if rule.type == "str" and isinstance(rule.range, list):
            found.append(F.when(col.isNotNull() & ~col.isin([str(x) for x in rule.range]), told(rule.name, col.cast("string"), "range")))
    if not found:
        return empty(table.sparkSession, VIOLATION)
    rows = table.select("entity_id", F.col("component_index").cast("bigint"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return rows.select("entity_id", "component_index", F.lit(component_type).alias("component_type"), "x.field", "x.value", "x.error_type")


def empty_table(spark: SparkSession, rules: list[FieldRule]) -> DataFrame:
    fields = [f"{q(r.name)} {COERCED.get(r.type or '', 'string')}" for r in rules] or ["value string"]
    return spark.createDataFrame([], ", ".join(["entity_id string", "component_index bigint", "modifier string", *fields]))

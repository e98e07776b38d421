"""Views over component tables: inner joins on the entity, and the current versions of slowly changing ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from .eav import META

SPINE = "entity_id"


def field_list(wanted: str | Iterable[str], columns: Callable[[str], list[str]]) -> dict[str, list[str]]:
    """table -> fields of `type` and `type.field` entries, in order, each once; the spine's alias comes first unless the
    spine is asked for. columns raises KeyError for unknown tables."""
    wanted = [wanted] if isinstance(wanted, str) else list(wanted)
    if SPINE not in wanted and f"{SPINE}.alias" not in wanted:
        wanted = [f"{SPINE}.alias", *wanted]
    out: dict[str, list[str]] = {}
    for name in wanted:
        table, dot, field = name.partition(".")
        hidden = {*META, *(["value"] if table == SPINE else [])}
        fields = [field] if dot else [c for c in columns(table) if c not in hidden]
        if dot:
            columns(table)
        have = out.setdefault(table, [])
        have += [f for f in fields if f not in have]
    return out


def view(wanted: str | Iterable[str], table_of: Callable[[str], DataFrame]) -> DataFrame:
    """entity_id and `type.field` columns of entities that have all types. Fields of one type stay in their rows; two
    types with several rows of an entity give all combinations."""
    parts = []
    for name, fields in field_list(wanted, lambda t: table_of(t).columns).items():
        t = table_of(name)
        key = F.col("value").alias("entity_id") if name == SPINE else F.col("entity_id")
        parts.append(t.select(key, *[F.col(q(f)).alias(f"{name}.{f}") for f in fields]))
    return reduce(lambda a, b: a.join(b, "entity_id"), parts)


def current(table: DataFrame, time_field: str | None, ties: Iterable[str] = ("component_index",)) -> DataFrame:
    """The row of the latest time for each entity; null times come last, equal times go by `ties`, highest first, then
    by a hash of the row. Without a time field, the table."""
    if time_field is None or time_field not in table.columns:
        return table
    whole = F.struct(*[F.col(q(c)) for c in table.columns])
    order = F.struct(F.col(q(time_field)), *[F.col(q(c)) for c in ties if c in table.columns], F.bitwise_not(F.xxhash64(*[F.col(q(c)) for c in table.columns])))
    # the greatest order of each entity is combined before the shuffle; nulls are the least
    return table.groupBy("entity_id").agg(F.max_by(whole, order).alias("r")).select("r.*")


def stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, columns matched by name, missing ones null; columns whose types differ become text."""
    kinds_a, kinds_b = dict(a.dtypes), dict(b.dtypes)
    odd = [c for c in kinds_a if c in kinds_b and kinds_a[c] != kinds_b[c]]
    text = lambda t: t.withColumns({c: F.col(q(c)).cast("string") for c in odd})
    return text(a).unionByName(text(b), allowMissingColumns=True)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """stacked(), each row once."""
    return stacked(a, b).distinct()

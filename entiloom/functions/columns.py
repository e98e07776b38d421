"""Column expressions for identities, paths, safe casts, ratios and durations. All stay inside Spark's codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_LENGTH = 12
#: Fixed value: what Python's str.strip() takes away, of ASCII.
BLANKS = " \t\n\r\x0b\f"
#: Seconds of a duration's unit, and durations that have names.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
NAMED_DURATIONS = {"daily": 86400, "weekly": 604800, "monthly": 30 * 86400}


def q(name: str) -> str:
    """A column name in backticks, for names with dots or blanks."""
    return "`" + name.replace("`", "``") + "`"


def entity_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, ID_LENGTH)


def key_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^:.]+)$", 1)


def file_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^([^:]+):", 1), F.lit(""))


def name_part(path: Column) -> Column:
    """What follows the first colon; the whole path without one."""
    return F.regexp_replace(path, r"^[^:]*:", "")


def alias_of(path: Column) -> Column:
    """The last two segments of the name, or the only one."""
    parts = F.split(name_part(path), r"\.")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(key_of(path))


def parent_path(path: Column) -> Column:
    """The path one level up; null for a top-level name."""
    return F.when(F.instr(name_part(path), ".") > 0, F.regexp_replace(path, r"\.[^.:]*$", ""))


def depth_of(path: Column) -> Column:
    return F.size(F.split(name_part(path), r"\."))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def to_double(col: Column) -> Column:
    return col.try_cast("double")


def to_long(col: Column) -> Column:
    """Whole numbers as they are; other numbers rounded, halves away from zero; the rest null."""
    return F.coalesce(col.try_cast("bigint"), F.round(col.try_cast("double")).try_cast("bigint"))


def to_boolean(col: Column) -> Column:
    return col.try_cast("boolean")


def double_to_long(col: Column) -> Column:
    return F.rint(col).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b with infinities, and NaN for 0 / 0, instead of an error."""
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))
    return F.when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def duration_seconds(text: Column) -> Column:
    """Seconds of texts such as `7 days`, `2 hours` or `weekly`; null for null or blank; other texts raise."""
    clean = F.lower(strip(text))
    amount = F.coalesce(F.regexp_extract(clean, r"^([0-9.]+)", 1).try_cast("double"), F.lit(1.0))
    unit = F.regexp_extract(clean, r"^[0-9.]*\s*([a-z]+?)s?$", 1)
    known = reduce(lambda out, kv: out.when(unit == kv[0], amount * F.lit(float(kv[1]))), UNIT_SECONDS.items(), F.when(F.lit(False), F.lit(0.0)))
    named = reduce(lambda out, kv: out.when(clean == kv[0], F.lit(float(kv[1]))), NAMED_DURATIONS.items(), F.when(clean.isNull() | (clean == ""), F.lit(None).cast("double")))
    return named.otherwise(F.coalesce(known, F.raise_error(F.concat(F.lit("not a duration: "), text)).cast("double")))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin("true", "1", "yes"), F.lit(False))

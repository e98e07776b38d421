"""Derived tables: stripped text, filled times, effort, priorities, impact and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import duration_seconds, q, ratio, strip
from .forest import Hierarchy


def stripped(table: DataFrame, fields: list[str]) -> DataFrame:
    return table.withColumns({f: strip(F.col(q(f))) for f in fields if f in table.columns and dict(table.dtypes)[f] == "string"})


def time_filled(table: DataFrame, field: str, load_time: object) -> DataFrame:
    """table with load_time where its time field is null, in the column's type; a missing column is added."""
    if field not in table.columns:
        return table.withColumn(field, F.lit(load_time))
    return table.withColumn(field, F.coalesce(F.col(q(field)), F.lit(load_time).cast(table.schema[field].dataType)))


def effort_rows(effort: DataFrame) -> DataFrame:
    """entity_id, schedule (blank: null), unit, value as a number; missing schedule or unit columns count as null."""
    have = effort
    for c in ("schedule", "unit"):
        if c not in have.columns:
            have = have.withColumn(c, F.lit(None).cast("string"))
    return have.select("entity_id", F.nullif(F.col("schedule"), F.lit("")).alias("schedule"), "unit", F.col("value").cast("string").try_cast("double").alias("value"))


def times(period: str) -> Column:
    """How often a row's schedule fits in a period: without one, once."""
    return F.coalesce(duration_seconds(F.lit(period)) / duration_seconds(F.col("schedule")), F.lit(1.0))


def effort_total(tree: Hierarchy, effort: DataFrame, period: str = "28 days") -> DataFrame:
    """entity_id, value: effort of an entity and all below it in a period; effort without a schedule counts once, other
    effort as often as its schedule fits."""
    sums = tree.roll_up(effort_rows(effort), ["schedule", "unit"])
    return sums.groupBy("entity_id").agg(F.sum(F.col("value") * times(period)).alias("value"))


def normalized(rows: DataFrame, budget: DataFrame | None, name: str) -> DataFrame:
    """entity_id and the sum of values, each times the rate of its type (1 without one). A type with two rates raises."""
    kind = F.col("type") if "type" in rows.columns else F.lit(name)
    facts = rows.select("entity_id", kind.alias("type"), F.col("value").cast("string").try_cast("double").alias("value"))
    if budget is None:
        return facts.groupBy("entity_id").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias(name))
    rates = budget.groupBy(F.col("value").alias("type")).agg(F.max(F.col("normalized_value_per_unit").cast("double")).alias("rate"), F.count("*").alias("n"))
    twice = rates.filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"several budgets for {[r.type for r in twice]}")
    rated = facts.join(rates, "type", "left")
    return rated.groupBy("entity_id").agg(F.coalesce(F.sum(F.col("value") * F.coalesce("rate", F.lit(1.0))), F.lit(0.0)).alias(name))


def impact_cost(impact: DataFrame, cost: DataFrame, impact_budget: DataFrame | None = None, cost_budget: DataFrame | None = None) -> DataFrame:
    """entity_id, impact, cost, diff, ratio of entities that have either."""
    both = normalized(impact, impact_budget, "impact").join(normalized(cost, cost_budget, "cost"), "entity_id", "full_outer")
    a, b = F.coalesce("impact", F.lit(0.0)), F.coalesce("cost", F.lit(0.0))
    return both.select("entity_id", a.alias("impact"), b.alias("cost"), (a - b).alias("diff"), ratio(a, b).alias("ratio"))

"""Audits: which requirements are met, which entities none explains, what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = "Entity '{}' does not trace to any requirement."


def requirement_coverage(requirement: DataFrame, solution: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """entity_id, solution_eid, solution_status: each requirement with each solution (value_eid names the requirement,
    entity_id is the solution) and its state; nulls where none covers it."""
    solved = solution.select(F.col("value_eid").alias("entity_id"), F.col("entity_id").alias("solution_eid"))
    if status is None:
        solved = solved.withColumn("solution_status", F.lit(None).cast("string"))
    else:
        solved = solved.join(status.select(F.col("entity_id").alias("solution_eid"), F.col("value").alias("solution_status")), "solution_eid", "left")
    return requirement.select("entity_id").distinct().join(solved, "entity_id", "left").select("entity_id", "solution_eid", "solution_status")


def orphans(entities: DataFrame, *explained: DataFrame) -> DataFrame:
    """entity_id of entities in none of the tables; ids are never null, so plain anti joins do."""
    out = entities.select("entity_id").distinct()
    for t in explained:
        out = out.join(t.select("entity_id").filter("entity_id is not null").distinct(), "entity_id", "left_anti")
    return out


def traceability(entities: DataFrame, *explained: DataFrame) -> DataFrame:
    before, after = MESSAGE.split("{}")
    return orphans(entities, *explained).select("entity_id", F.concat(F.lit(before), "entity_id", F.lit(after)).alias("message"))


def todo(table: DataFrame) -> DataFrame:
    value = F.col("value").cast("string") if "value" in table.columns else F.lit("")
    return table.select("entity_id", value.alias("value"))

"""Hierarchies as edge tables: edges of paths and of components, parents that are chosen, requirement trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import entity_id, parent_path
from ..sources.tables import durable
from .forest import Hierarchy, closure, inherited, ordered_trees

__all__ = ["Hierarchy", "closure", "inherited", "ordered_trees"]


def parents_from_paths(spine: DataFrame) -> DataFrame:
    """entity_id, component_index (-1), modifier, parent_eid, is_primary (true) of every nested entity."""
    return path_edges(spine).distinct()


def path_edges(spine: DataFrame) -> DataFrame:
    up = parent_path(F.col("path"))
    rows = spine.filter(F.col("path").isNotNull() & up.isNotNull())
    return rows.select(F.col("value").alias("entity_id"), F.lit(-1).cast("bigint").alias("component_index"), F.lit(None).cast("string").alias("modifier"), entity_id(up).alias("parent_eid"), F.lit(True).alias("is_primary"))


def first_by_key(spine: DataFrame) -> DataFrame:
    """entity_key -> the id of its first entity, by path."""
    return spine.filter("entity_key is not null").groupBy("entity_key").agg(F.min_by("value", "path").alias("parent_eid"))


def parents(spine: DataFrame, explicit: DataFrame | None) -> DataFrame:
    """Edges of the paths and of `parent` components, whose value names an entity's key; unknown keys drop out.
    is_primary is kept where an explicit edge says it, and is false otherwise."""
    if explicit is None or "value" not in explicit.columns:
        return parents_from_paths(spine)
    primary = F.coalesce(F.col("is_primary").cast("string").try_cast("boolean"), F.lit(False)) if "is_primary" in explicit.columns else F.lit(False)
    named = explicit.filter("value is not null").withColumn("_primary", primary).join(first_by_key(spine), explicit["value"] == F.col("entity_key"))
    return path_edges(spine).unionByName(named.select("entity_id", F.col("component_index").cast("bigint"), "modifier", "parent_eid", F.col("_primary").alias("is_primary"))).distinct()


def entity_depth(edges: DataFrame, tree: Hierarchy | None = None) -> DataFrame:
    """entity_id, depth: steps below the nearest root. What no root reaches has none; a hierarchy of cycles is empty."""
    return (tree or Hierarchy(edges)).depth()


def with_self(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """anc, des of pairs and of every id (entity_id) with itself."""
    return pairs.select("anc", "des").unionByName(ids.select(F.col("entity_id").alias("anc"), F.col("entity_id").alias("des")).distinct())


def ancestor_product(pairs: DataFrame, ids: DataFrame, priority: DataFrame) -> DataFrame:
    """entity_id, priority_product over an entity and those that pairs (anc, des) list above it; priority: entity_id, p
    (several: the highest). Hierarchy.ancestor_product() needs no pairs."""
    top = priority.groupBy("entity_id").agg(F.max("p").alias("p"))
    above = with_self(pairs, ids).join(top.withColumnRenamed("entity_id", "anc"), "anc", "left")
    return above.groupBy(F.col("des").alias("entity_id")).agg(F.product(F.coalesce("p", F.lit(1.0))).alias("priority_product"))


def hierarchy_parent(edges: DataFrame) -> DataFrame:
    """entity_id, parent_eid: the only primary parent, else that of the lowest component_index."""
    primary = F.col("is_primary").eqNullSafe(F.lit(True))
    pick = edges.groupBy("entity_id").agg(
        F.count(F.when(primary, 1)).alias("n"), F.max(F.when(primary, F.col("parent_eid"))).alias("one"), F.min(F.struct("component_index", "parent_eid")).alias("first")
    )
    return pick.select("entity_id", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("first.parent_eid")).alias("parent_eid"))


def other_parents(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """edges without exactly one row of each chosen (entity_id, parent_eid): the first by component_index."""
    nth = F.row_number().over(Window.partitionBy("entity_id", "parent_eid").orderBy(F.col("component_index").asc_nulls_last()))
    one = chosen.withColumn("_chosen", F.lit(True))
    rows = edges.withColumn("_nth", nth).join(one, ["entity_id", "parent_eid"], "left")
    return rows.filter("_chosen is null or _nth > 1").select(*edges.columns)


def requirement_rows(edges: DataFrame, spine: DataFrame, requirement: DataFrame, also: object = None) -> DataFrame:
    """root, entity_id, name, depth, place, priority of the trees that requirements make: those of edges whose two ends are
    requirements (or the entity `also`, which then stands below nothing). Children go by priority, the highest first, then
    by path; 0.5 stands for a missing priority."""
    top = requirement.groupBy("entity_id").agg(F.max(F.col("value").cast("string").try_cast("double")).alias("p"))
    if also is not None:
        more = edges.sparkSession.createDataFrame([(also,)], "entity_id string").join(top, "entity_id", "left_anti").withColumn("p", F.lit(None).cast("double"))
        top, edges = top.unionByName(more), edges.filter(F.col("entity_id") != also)
    top = durable(top, "requirements")
    ids = top.select("entity_id")
    inside = edges.join(ids, "entity_id", "left_semi").join(ids.withColumnRenamed("entity_id", "parent_eid"), "parent_eid", "left_semi")
    named = spine.groupBy(F.col("value").alias("entity_id")).agg(F.min_by("entity_key", "path").alias("name"), F.min("path").alias("path"))
    weight = durable(top.join(named, "entity_id", "left").select("entity_id", F.coalesce("p", F.lit(0.5)).alias("weight"), "path", "name"), "weights")
    rows = ordered_trees(inside, weight).withColumnRenamed("weight", "priority")
    return rows.join(weight.select("entity_id", "name"), "entity_id", "left").select("root", "entity_id", "name", "depth", "place", "priority")


def requirement_tree(edges: DataFrame, spine: DataFrame, requirement: DataFrame, key: str) -> dict:
    """Nested {name, priority, children} of the requirements below the entity with this key, the highest priority
    first; 0.5 stands for none. The tree is a result for people: its rows come in depth-first order, a partition at a time,
    and a child is hung on the last entity that is less deep."""
    start = spine.filter(F.col("entity_key") == key).agg(F.min_by("value", "path").alias("id")).first().id
    if start is None:
        raise ValueError(f"no entity has the key {key!r}")
    rows = requirement_rows(edges, spine, requirement, start).filter(F.col("root") == start).orderBy("place")
    open_: list[dict] = []
    for r in rows.toLocalIterator():
        node = {"name": r.name, "priority": r.priority, "children": []}
        del open_[r.depth :]
        if open_:
            open_[-1]["children"].append(node)
        open_.append(node)
    if open_:
        return open_[0]
    alone = requirement.filter(F.col("entity_id") == start).agg(F.max(F.col("value").cast("string").try_cast("double")).alias("p")).first().p
    return {"name": key, "priority": 0.5 if alone is None else alone, "children": []}


def unreachable(edges: DataFrame, ids: DataFrame, root: str) -> DataFrame:
    """Connectivity: ids (entity_id) that the root doesn't reach."""
    return ids.filter(F.col("entity_id") != root).join(Hierarchy(edges).below(root), "entity_id", "left_anti")


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "entity_id string, component_index bigint, modifier string, parent_eid string, is_primary boolean")

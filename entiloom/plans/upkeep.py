"""Derived tables kept up to date: after an update only what lies above or below a change is worked out again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..operators import derive, graph
from ..operators.forest import steps_of
from ..operators.views import stacked
from ..sources.tables import durable
from .registry import Registry

#: Tables that no document holds.
DERIVED = ("entity_depth", "effort_total", "priority_product", "resolved_impact_cost")


def added(old: Registry, new: Registry, name: str) -> DataFrame | None:
    """Rows of a type that the new registry has and the old one lacks; of the old one only the same entities' are read."""
    if name not in new.tables:
        return None
    rows = new.get(name).drop("is_primary")
    if name not in old.tables:
        return rows
    mine = old.get(name).drop("is_primary").join(rows.select("entity_id").distinct(), "entity_id", "left_semi")
    both = stacked(rows, mine)
    names = both.columns
    lean = lambda t: stacked(t, both.limit(0)).select(*[q(c) for c in names])  # noqa: E731  the same columns and types
    return lean(rows).subtract(lean(mine))


def new_steps(old: Registry, new: Registry) -> DataFrame:
    """des, anc: the steps that the old registry lacks. A step that more rows tell is no new one."""
    more = added(old, new, "parent")
    if more is None:
        return new.spark.createDataFrame([], "des string, anc string")
    came = steps_of(more)
    if "parent" not in old.tables:
        return came
    return came.join(steps_of(old.get("parent").join(more.select("entity_id").distinct(), "entity_id", "left_semi")), ["des", "anc"], "left_anti")


def renewed(old: Registry, new: Registry, merged: Registry, period: str = "28 days") -> dict[str, DataFrame] | None:
    """Of each derived table the rows that an update changes, complete for each of their entities. None asks for all to be
    made anew: where budgets change, where a subtree with efforts gets a parent and entities in it have several, and where
    a new edge closes a cycle that no root reaches any more.

    Sums travel up from what was added: an effort, or the total of a subtree that got a parent. Products and depths travel
    down from changed entities, on the part of the hierarchy below them, and start from the old values above that. What
    entities with several parents have from above is worked out from the pairs that the hierarchy lists for them."""
    rates = [added(old, new, n) for n in ("impact_budget", "cost_budget")]
    if any(r is not None and not r.isEmpty() for r in rates):
        return None
    tree = graph.Hierarchy(merged.get("parent"))
    edges = durable(new_steps(old, new).select(F.col("des").alias("entity_id"), F.col("anc").alias("parent_eid")), "new-edges")
    out: dict[str, DataFrame] = {}

    facts = []
    effort = added(old, new, "effort")
    if effort is not None:
        facts.append(derive.effort_rows(effort).select("entity_id", (F.coalesce("value", F.lit(0.0)) * derive.times(period)).alias("value")))
    totals = old.tables.get("effort_total")
    if totals is not None:
        moved = durable(edges.join(totals, "entity_id").select("entity_id", F.col("parent_eid"), "value"), "moved")
        if tree.has_tangled and not knots_at(tree, moved.select("entity_id").distinct()).isEmpty():
            return None  # another way may have led up already, and what came by it counts once
        facts.append(moved.select(F.col("parent_eid").alias("entity_id"), "value"))
    if facts:
        delta = tree.roll_up(facts[0] if len(facts) == 1 else facts[0].unionByName(facts[1]), [])
        before = (totals if totals is not None else delta.limit(0)).select("entity_id", F.col("value").alias("was"))
        out["effort_total"] = delta.join(before, "entity_id", "left").select("entity_id", (F.col("value") + F.coalesce("was", F.lit(0.0))).alias("value"))

    low = changed_below(old, new, tree, edges)
    lone = tree.nodes.filter("not tangled").join(low, "entity_id", "left_semi")
    up = low.select(F.col("entity_id").alias("parent_eid"), F.lit(1).alias("inside"))
    place = durable(lone.join(up, "parent_eid", "left").select("entity_id", "parent_eid", F.col("inside").isNotNull().alias("inside")), "places")
    part = graph.Hierarchy(place.filter("inside").select("entity_id", "parent_eid"))
    edge = place.filter("not inside and parent_eid is not null").select("entity_id", "parent_eid")
    knots = durable(tree.pairs.join(low.withColumnRenamed("entity_id", "des"), "des", "left_semi"), "knots") if tree.has_tangled else None

    def from_edge(table: str, column: str) -> DataFrame:
        """entity_id, was: the old value of the parent of entities whose parent keeps its own."""
        if table not in old.tables:
            return edge.select("entity_id", F.lit(None).cast("double").alias("was")).limit(0)
        return edge.join(old.get(table).select(F.col("entity_id").alias("parent_eid"), F.col(column).cast("double").alias("was")), "parent_eid").select("entity_id", "was")

    steps = place.join(from_edge("entity_depth", "depth"), "entity_id", "left")
    start = steps.select("entity_id", F.when(F.col("parent_eid").isNull(), 0).when(F.col("inside"), 1).otherwise(F.coalesce("was", F.lit(0)) + 1).cast("bigint").alias("v"))
    depth = part.from_above(durable(start, "depths"), lambda a, b: a + b).select("entity_id", F.col("v").cast("int").alias("depth"))
    if knots is not None:
        tops = tree.nodes.filter("depth = 0").select(F.col("entity_id").alias("anc"))
        near = durable(knots.join(tops, "anc", "left_semi").groupBy(F.col("des").alias("entity_id")).agg(F.min("steps").cast("int").alias("depth")), "near")
        if "entity_depth" in old.tables:
            had = old.get("entity_depth").join(low.join(tree.tangled, "entity_id", "left_semi"), "entity_id", "left_semi")
            if not had.join(near, "entity_id", "left_anti").isEmpty():
                return None  # no root reaches it any more, and its row must go
        depth = depth.unionByName(near)
    out["entity_depth"] = depth

    if "requirement" in merged.tables:
        need = merged.get("requirement").select("entity_id", F.col("value").cast("string").try_cast("double").alias("p"))
        known = low.join(merged.get("entity_id").select(F.col("value").alias("entity_id")).distinct(), "entity_id", "left_semi")
        free = low.join(tree.tangled, "entity_id", "left_anti")
        own = need.join(low, "entity_id", "left_semi").groupBy("entity_id").agg(F.max("p").alias("p"))
        base = free.join(own, "entity_id", "left").join(from_edge("priority_product", "priority_product"), "entity_id", "left")
        weights = durable(base.select("entity_id", (F.coalesce("p", F.lit(1.0)) * F.coalesce("was", F.lit(1.0))).alias("p")), "weights")
        product = part.ancestor_product(known.join(free, "entity_id", "left_semi"), weights)
        if knots is not None:
            bound = known.join(tree.tangled, "entity_id", "left_semi")
            above = knots.join(bound.withColumnRenamed("entity_id", "des"), "des", "left_semi")
            asked = need.join(graph.with_self(above, bound).select(F.col("anc").alias("entity_id")).distinct(), "entity_id", "left_semi")
            product = product.unionByName(graph.ancestor_product(above, bound, asked))
        out["priority_product"] = product

    touched = None
    for name in ("impact", "cost"):
        rows = added(old, new, name)
        if rows is not None:
            touched = rows.select("entity_id") if touched is None else touched.unionAll(rows.select("entity_id"))
    if touched is not None:
        touched = touched.distinct()
        out["resolved_impact_cost"] = derive.impact_cost(*[merged.get(n).join(touched, "entity_id", "left_semi") for n in ("impact", "cost")], merged.tables.get("impact_budget"), merged.tables.get("cost_budget"))
    return out


def knots_at(tree: graph.Hierarchy, ids: DataFrame) -> DataFrame:
    """entity_id of the tangled entities among ids and below them."""
    below = tree.pairs.join(ids.withColumnRenamed("entity_id", "anc"), "anc", "left_semi").select(F.col("des").alias("entity_id"))
    return below.unionAll(tree.tangled.join(ids, "entity_id", "left_semi")).distinct()


def changed_below(old: Registry, new: Registry, tree: graph.Hierarchy, edges: DataFrame) -> DataFrame:
    """entity_id of what an update gives another place or requirement, or makes known, and of all below that."""
    ids = new.get("entity_id").select(F.col("value").alias("entity_id"))
    fresh = ids.join(old.get("entity_id").select(F.col("value").alias("entity_id")), "entity_id", "left_anti")
    # a parent gets a depth with its first child, and one that was known by its key only a place of its own
    tops = edges.select(F.col("parent_eid").alias("entity_id"))
    if "entity_depth" in old.tables:
        tops = tops.join(old.get("entity_depth"), "entity_id", "left_anti")
    changed = edges.select("entity_id").unionAll(tops).unionAll(fresh)
    need = added(old, new, "requirement")
    if need is not None:
        changed = changed.unionAll(need.select("entity_id"))
    changed = durable(changed.distinct().withColumn("v", F.lit(True)), "changed")
    marks = tree.nodes.filter("not tangled").select("entity_id").join(changed, "entity_id", "left").select("entity_id", F.coalesce("v", F.lit(False)).alias("v"))
    low = tree.from_above(durable(marks, "marks"), lambda a, b: a | b).filter("v").select("entity_id").unionAll(changed.select("entity_id"))
    if tree.has_tangled:
        low = low.unionAll(knots_at(tree, changed.select("entity_id")))
    return durable(low.distinct(), "below")

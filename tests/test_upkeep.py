"""Derived tables kept up to date by deltas equal those made anew, on trees, several parents and cycles."""

import random

from pyspark.sql import functions as F

from entiloom.operators import graph
from entiloom.plans import upkeep
from entiloom.plans.registrar import with_derived
from entiloom.plans.registry import Registry

ROWS = {
    "entity_id": "value string, path string, entity_key string",
    "parent": "entity_id string, component_index bigint, modifier string, parent_eid string, is_primary boolean",
    "requirement": "entity_id string, component_index bigint, value string",
    "effort": "entity_id string, component_index bigint, value string, schedule string, unit string",
    "impact": "entity_id string, component_index bigint, value string",
    "cost": "entity_id string, component_index bigint, value string",
    "impact_budget": "entity_id string, value string, normalized_value_per_unit double",
}


def registry(spark, rows):
    return Registry(spark, {n: spark.createDataFrame(r, ROWS[n]) for n, r in rows.items() if r or n == "entity_id"})


def facts(r, ids):
    """Powers of two, so that sums and products are exact in any order."""
    pick = lambda: r.choice(ids)
    return {
        "requirement": [(pick(), i, r.choice(["0.5", "2", "0.25", None, "much"])) for i in range(len(ids) // 2)],
        "effort": [(pick(), i, r.choice(["1", "2", "0.5", None]), r.choice([None, "", "1 week"]), r.choice([None, "h"])) for i in range(len(ids) // 2)],
        "impact": [(pick(), i, "4") for i in range(3)],
        "cost": [(pick(), i, "2") for i in range(3)],
    }


def edge(p, c, i=0):
    return (c, i, None, p, False)


def both(a, b):
    return {n: list(dict.fromkeys([*a.get(n, []), *b.get(n, [])])) for n in {*a, *b}}


def plain(table):
    names = sorted(table.columns)
    return sorted(map(str, table.select(*[F.round(c, 9).alias(c) if dict(table.dtypes)[c] == "double" else c for c in names]).collect()))


def check(spark, was, more):
    """Whether deltas were enough; where they are, the rows they give stand for all of their entities."""
    old = registry(spark, was)
    with_derived(old, graph.Hierarchy(old.get("parent")))
    new, merged, whole = registry(spark, more), registry(spark, both(was, more)), registry(spark, both(was, more))
    rows = upkeep.renewed(old, new, merged)
    if rows is None:
        return False
    with_derived(whole, graph.Hierarchy(whole.get("parent")))
    for name in upkeep.DERIVED:
        kept = old.tables.get(name)
        got = rows.get(name)
        if kept is not None and got is not None:
            got = kept.join(got.select("entity_id"), "entity_id", "left_anti").unionByName(got)
        now, want = got if got is not None else kept, whole.tables.get(name)
        assert (plain(now) if now is not None else []) == (plain(want) if want is not None else []), name
    return True


def names(n, start=0):
    return [(f"n{i}", f"f:n{i}", f"n{i}") for i in range(start, n)]


def instance(seed):
    """A forest whose first ten entities have second parents and a cycle, and an update of new entities and facts."""
    r = random.Random(seed)
    types = [edge("n0", "n1"), edge("n0", "n2"), edge("n1", "n3"), edge("n2", "n3"), edge("n3", "n4"), edge("n5", "n6"), edge("n6", "n5")]
    tree = [edge(f"n{r.randrange(10, i)}", f"n{i}") for i in range(11, 40) if r.random() < 0.9]
    ids = [f"n{i}" for i in range(40)]
    was = {"entity_id": names(40), "parent": types + tree, **facts(r, ids)}
    came = [f"n{i}" for i in range(40, 50)]
    grown = [edge(f"n{r.randrange(10, i)}", f"n{i}") for i in range(40, 50) if r.random() < 0.8]
    more = {"entity_id": names(50, 30), "parent": [*tree[:3], edge(tree[0][3], tree[0][0], 7), *grown], **facts(r, [*came, *r.sample(ids, 8)])}
    return was, more


def test_updates_by_deltas(spark):
    assert check(spark, *instance(1))


def test_trees_that_get_a_parent(spark):
    was, _ = instance(7)
    has = {e[0] for e in was["parent"]}
    roots = [f"n{i}" for i in range(10, 40) if f"n{i}" not in has]
    assert len(roots) > 1
    more = {"entity_id": names(41, 40), "parent": [edge("n40", roots[0]), edge("n40", roots[1])], "effort": [(roots[0], 99, "8", None, None)], "requirement": [("n40", 0, "2")]}
    assert check(spark, was, more)


def test_what_deltas_leave_to_a_new_start(spark):
    was = {"entity_id": names(6), "parent": [edge("n0", "n1"), edge("n1", "n2"), edge("n3", "n4")], "effort": [("n2", 0, "1", None, None)], "requirement": [("n0", 0, "2")]}
    assert not check(spark, was, {"entity_id": [], "parent": [edge("n4", "n2")]})  # a second way up for n2's effort
    assert not check(spark, was, {"entity_id": [], "impact_budget": [("n0", "impact", 2.0)]})
    bare = {**was, "effort": []}
    assert not check(spark, bare, {"entity_id": [], "parent": [edge("n2", "n0")]})  # nothing reaches the cycle any more
    assert check(spark, bare, {"entity_id": [], "parent": [edge("n1", "n1"), edge("n4", "n2")]})  # a loop is no step, several parents are

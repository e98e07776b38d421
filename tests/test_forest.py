"""Hierarchies against plain Python: trees, several parents, cycles; deep chains and many nodes."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from entiloom.operators import forest, graph
from entiloom.operators.forest import Hierarchy


def edges(spark, pairs):
    return spark.createDataFrame([(c, i, p) for i, (p, c) in enumerate(pairs)], "entity_id string, component_index bigint, parent_eid string")


def reach(pairs):
    """(anc, des) -> fewest steps."""
    down = collections.defaultdict(set)
    for p, c in pairs:
        if p is not None and c is not None and p != c:
            down[p].add(c)
    out = {}
    for a in list(down):
        front, n, seen = {a}, 0, {a}
        while front:
            front, n = {c for x in front for c in down[x]} - seen, n + 1
            seen |= front
            out |= {(a, c): n for c in front}
    return out


def instance(seed):
    """A forest with a few more edges: second parents, cycles, loops, repeated edges, a null."""
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(i)}", f"n{i}") for i in range(1, 60) if r.random() < 0.9]
    if seed % 3:
        pairs += [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(seed % 3 * 3)] + [pairs[0], ("n5", "n5"), (None, "n3")]
    return pairs


@pytest.mark.parametrize("seed", range(6))
def test_hierarchy_equals_brute_force(spark, seed):
    pairs, r = instance(seed), random.Random(seed + 100)
    ids = [f"n{i}" for i in range(62)]
    table, far = edges(spark, pairs), reach(pairs)
    assert {(x.anc, x.des): x.steps for x in forest.closure(table).collect()} == far
    tree = Hierarchy(table)
    parents = collections.defaultdict(set)
    for p, c in pairs:
        if p is not None and p != c:
            parents[c].add(p)
    tops = {p for ps in parents.values() for p in ps} - parents.keys()
    depth = {t: 0 for t in tops}
    for (a, d), n in far.items():
        if a in tops:
            depth[d] = min(n, depth.get(d, n))
    assert {x.entity_id: x.depth for x in tree.depth().collect()} == depth
    facts = [(r.choice(ids), r.choice(["x", None]), r.choice([1.0, 2.5, None])) for _ in range(150)]
    want = collections.defaultdict(float)
    for e, k, v in facts:
        for a in {a for a in ids if (a, e) in far} | {e}:
            want[a, k] += v or 0.0
    got = tree.roll_up(spark.createDataFrame(facts, "entity_id string, by string, value double"), ["by"]).collect()
    assert {(x.entity_id, x.by): x.value for x in got} == want
    p = [(r.choice(ids), r.choice([0.5, 2.0, None])) for _ in range(40)]
    top = collections.defaultdict(lambda: 1.0)
    for e in {e for e, v in p if v}:
        top[e] = max(v for f, v in p if f == e and v)
    got = tree.ancestor_product(spark.createDataFrame([(i,) for i in ids[:61]], "entity_id string"), spark.createDataFrame(p, "entity_id string, p double")).collect()
    for x in got:
        product = top[x.entity_id]
        for a in ids:
            product *= top[a] if (a, x.entity_id) in far else 1.0
        assert x.priority_product == pytest.approx(product)
    assert len(got) == 61
    root = pairs[0][0]
    assert {x.entity_id for x in tree.below(root).collect()} == {d for a, d in far if a == root and d != root}
    labels = {x.entity_id: x for x in tree.intervals().collect()}
    assert seed % 3 or set(labels) == depth.keys()
    for a, x in labels.items():
        assert {b for b, y in labels.items() if y.root == x.root and x.enter < y.enter <= x.leave} == {b for b in labels if (a, b) in far}


def brute_inherited(field, rows):
    order = collections.defaultdict(dict)
    for i, (p, c) in enumerate(rows):
        if p is not None and p != c:
            order[c].setdefault(p, i)
    own = {}
    for e, i, name, text in field:
        if name and (e, name) not in own or name and own[e, name][0] < i:
            own[e, name] = (i, text)
    out = []
    for e in {x for p, c in rows for x in (p, c) if x} | {f[0] for f in field}:
        found, seen, queue = {}, {e}, collections.deque([(e, ())])
        while queue:
            x, way = queue.popleft()
            for (o, name), (i, text) in own.items():
                if o == x and name not in found:
                    found[name] = (len(way), way, i, text, x)
            for k, p in enumerate(sorted(order[x], key=lambda p: (order[x][p], p)), 1):
                if p not in seen:
                    seen.add(p)
                    queue.append((p, (*way, k)))
        last = max([v[2] for v in found.values() if v[4] == e], default=0)
        out += [(e, v[2], n, v[3]) for n, v in found.items() if v[4] == e]
        rest = sorted((v[0], v[1], v[2], n, v[3]) for n, v in found.items() if v[4] != e)
        out += [(e, last + k, n, text) for k, (*_, n, text) in enumerate(rest, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_inheritance_equals_a_search(spark, seed):
    """Cycles, two parents, equal distances, overrides, repeated names."""
    pairs, r = instance(seed), random.Random(seed)
    field = [(f"n{r.randrange(60)}", k, r.choice(["a", "b", "c", "", None]), f"t{k}") for k in range(25)] + [("alone", 0, "a", "own")]
    table = spark.createDataFrame(field, "entity_id string, component_index bigint, value string, description string")
    got = sorted((x.entity_id, x.component_index, x.value, x.description) for x in forest.inherited(table, edges(spark, pairs)).collect())
    assert got == brute_inherited(field, pairs)


def test_a_chain_of_5000(spark):
    chain = spark.range(5000).select(F.col("id").cast("string").alias("parent_eid"), (F.col("id") + 1).cast("string").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"))
    tree = Hierarchy(chain)
    assert len(tree.levels) == 13 and tree.depth().agg(F.max("depth")).first()[0] == 5000
    facts = tree.nodes.select("entity_id", F.lit(1.0).alias("value"))
    sums = tree.roll_up(facts, []).select(F.col("entity_id").cast("int").alias("i"), "value")
    assert sums.filter("value != 5001 - i").count() == 0 and sums.count() == 5001
    labels = tree.intervals()
    assert labels.filter("enter != cast(entity_id as int) or leave != 5000 or root != '0'").count() == 0
    field = spark.createDataFrame([("0", 3, "unit"), ("2500", 1, "unit")], "entity_id string, component_index bigint, value string")
    rows = forest.inherited(field.withColumn("description", F.col("entity_id")), chain, tree)
    assert {r.description: r.n for r in rows.groupBy("description").agg(F.count("*").alias("n")).collect()} == {"0": 2500, "2500": 2501}
    spine = chain.select("entity_id").union(spark.createDataFrame([("0",)], "entity_id string")).select(F.col("entity_id").alias("value"), F.col("entity_id").alias("path"), F.col("entity_id").alias("entity_key"))
    made = graph.requirement_tree(chain, spine, spine.select(F.col("value").alias("entity_id"), F.lit(0.5).alias("value")), "0")
    n = 0
    while made["children"]:
        (made,) = made["children"]
        n += 1
    assert n == 5000 and made["name"] == "5000"


def test_a_tree_of_a_million(spark):
    """Every entity below the one of a tenth of its number; a root with a third of all children of its own."""
    up = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.floor(F.col("id") / 10)).cast("bigint")
    table = spark.range(1, 1_000_001).select(F.col("id").alias("entity_id"), up.alias("parent_eid"))
    tree = Hierarchy(table)
    assert not tree.has_tangled
    total = tree.roll_up(table.select("entity_id", F.lit(1).cast("bigint").alias("value")), [])
    assert total.filter("entity_id = 0").first().value == 1_000_000
    labels = forest.durable(tree.intervals(), "labels")
    assert labels.agg(F.count_distinct("enter"), F.max("enter"), F.max("leave")).first()[:] == (1_000_001, 1_000_000, 1_000_000)
    both = labels.join(labels.select(F.col("entity_id").alias("parent_eid"), F.col("enter").alias("e"), F.col("leave").alias("l")), "parent_eid")
    assert both.filter("enter <= e or leave > l").count() == 0


def test_trees_of_ways(spark):
    """An entity with two parents stands below both; a cycle is cut where it would come back."""
    pairs = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "c")]
    weight = spark.createDataFrame([("r", 1.0, "r"), ("a", 0.5, "a"), ("b", 0.9, "b"), ("c", 0.5, "c"), ("d", 0.5, "d")], "entity_id string, weight double, path string")
    rows = forest.ordered_trees(edges(spark, pairs), weight).orderBy("place").collect()
    assert [(r.entity_id, r.depth) for r in rows] == [("r", 0), ("b", 1), ("c", 2), ("d", 3), ("a", 1), ("c", 2), ("d", 3)]
    alone = forest.ordered_trees(edges(spark, pairs[:3]), weight).orderBy("place").collect()
    assert [(r.entity_id, r.depth, r.place) for r in alone] == [("r", 0, 0), ("b", 1, 1), ("a", 1, 2), ("c", 2, 3)]


def test_empty_hierarchy(spark):
    tree = Hierarchy(edges(spark, []))
    assert tree.depth().collect() == [] and tree.intervals().collect() == [] and forest.closure(edges(spark, [])).collect() == []
    facts = spark.createDataFrame([("a", 2.0)], "entity_id string, value double")
    assert [tuple(r) for r in tree.roll_up(facts, []).collect()] == [("a", 2.0)]


def test_what_has_arrived_is_not_joined_by_one_task(spark, monkeypatch):
    """Roots and finished ways have no ancestor to look up; as null keys of a join they would meet in one partition."""
    most, write = collections.defaultdict(list), forest.durable

    def seen(df, name="step", by=None):
        if name in ("climb", "held"):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            most[name].append(max(sizes) / sum(sizes))
        return write(df, name, by)

    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(forest, "durable", seen)
        table = edges(spark, [(f"p{i}", f"c{i}") for i in range(400)])
        tree = Hierarchy(table)
        ids = tree.nodes.select("entity_id")
        got = {r.entity_id: r.priority_product for r in tree.ancestor_product(ids, ids.withColumn("p", F.lit(0.5))).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {f"p{i}": 0.5 for i in range(400)} | {f"c{i}": 0.25 for i in range(400)}
    assert most["climb"] and most["held"] and max(most["climb"] + most["held"]) < 0.5


def test_products_of_some_take_no_further_join(spark, monkeypatch):
    """Which entities are asked for is known from the start, and parents travel with the ways upwards."""
    written, write = [], forest.durable
    monkeypatch.setattr(forest, "durable", lambda df, name="step", by=None: written.append(name) or write(df, name, by))
    tree = Hierarchy(edges(spark, [("a", "b"), ("b", "c"), ("b", "d")]))
    assert "nodes" not in written
    assert {tuple(r) for r in tree.nodes.collect()} == {("a", None, 0, False), ("b", "a", 1, False), ("c", "b", 2, False), ("d", "b", 2, False)}
    ids = spark.createDataFrame([("c",), ("d",), ("x",), (None,), ("c",)], "entity_id string")
    half = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("x", 0.25), ("c", None)], "entity_id string, p double")
    out = tree.ancestor_product(ids, half)
    assert sorted(tuple(r) for r in out.collect()) == [("c", 0.25), ("d", 0.25), ("x", 0.25)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    knots = Hierarchy(edges(spark, [("a", "c"), ("b", "c"), ("c", "d")])).ancestor_product(ids, half)
    assert sorted(tuple(r) for r in knots.collect()) == [("c", 0.25), ("d", 0.25), ("x", 0.25)]

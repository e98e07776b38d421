"""Hierarchies by doubling pointers: depths, subtree sums, ancestor products and interval labels in rounds that grow with
the logarithm of the depth, whatever it is.

Most entities have one parent. A level k of a hierarchy leads from an entity to its ancestor 2^k steps above; level k + 1 is
level k followed twice. Sums over subtrees climb the levels (what lies less than 2^k steps below is known; adding what
those exactly 2^k steps below know doubles it), and products over ancestors, depths and the offsets of interval labels
come down the same way. No pair of ancestor and descendant is listed.

Entities with several parents, in or below a cycle, or below any of these, are tangled. What they give to their ancestors
must count once, however many ways lead there; for them alone pairs are listed, by closure().
"""

from __future__ import annotations

from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.tables import durable


def counted(df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, dict]:
    """df made durable, and how many of its rows meet each condition, in one job."""
    seen = Observation()
    out = durable(df.observe(seen, *[F.count(F.when(c, 1)).alias(k) for k, c in what.items()]), name)
    return out, seen.get


def steps_of(edges: DataFrame) -> DataFrame:
    """des, anc: each edge once, without nulls and loops."""
    return edges.select(F.col("entity_id").alias("des"), F.col("parent_eid").alias("anc")).filter("anc is not null and des is not null and anc != des").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """anc, des, steps (fewest) of all pairs that edges (parent_eid, entity_id) connect; no entity reaches itself.

    A round doubles the length of the pairs known: a longer pair is one of exactly the greatest length so far, followed by
    any known one. So cycles end, and rounds grow with the logarithm of the longest shortest way."""
    step, n = counted(steps_of(edges).select("anc", "des", F.lit(1).alias("steps")), "closure", open=F.lit(True))
    parts, far = [step], 1
    while n["open"]:
        known = one_table(parts)
        whole = known.filter(F.col("steps") == far).select("anc", F.col("des").alias("mid"))
        longer = whole.join(known.select(F.col("anc").alias("mid"), "des", "steps"), "mid").filter("anc != des").groupBy("anc", "des").agg((F.min("steps") + far).alias("steps"))
        new, n = counted(longer.join(known.select("anc", "des"), ["anc", "des"], "left_anti"), "closure", open=F.lit(True))
        parts.append(new)
        far *= 2
    return one_table(parts)


def one_table(parts: list[DataFrame]) -> DataFrame:
    """Durable tables of one form read together, so that plans don't grow with their number."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p.durable_path for p in parts])


class Hierarchy:
    """nodes: entity_id, parent_eid (the only parent; null for roots and for entities with several), depth, tangled.
    levels: entity_id, up, the ancestor 2^k steps above by only parents. pairs: anc, des, steps of tangled entities."""

    def __init__(self, edges: DataFrame):
        self.spark = edges.sparkSession
        step = self.steps = durable(steps_of(edges), "steps")
        own = step.groupBy("des").agg(F.count("*").alias("n"), F.min("anc").alias("up"))
        tops = step.select(F.col("anc").alias("des")).distinct().join(step.select("des"), "des", "left_anti")
        some = F.col("n") > 1
        start = own.select(F.col("des").alias("entity_id"), F.when(~some, F.col("up")).alias("up"), some.alias("tangled")).unionByName(tops.select(F.col("des").alias("entity_id"), F.lit(None).cast("string").alias("up"), F.lit(False).alias("tangled")))
        kind = step.schema["anc"].dataType
        up = F.col("up").cast(kind)
        start = start.select("entity_id", up.alias("up"), F.col("up").isNotNull().cast("bigint").alias("depth"), "tangled", up.alias("parent_eid"))
        still = {"open": F.col("up").isNotNull(), "tangled": F.col("tangled")}
        state, n = counted(start, "climb", **still)
        self.levels, before = [], -1
        while n["open"] not in (0, before):
            self.levels.append(state.filter("up is not null").select("entity_id", "up"))
            above = state.select(F.col("entity_id").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("tangled").alias("knot"))
            # what has arrived waits outside of the join: nulls would all be joined by one task
            climbing, arrived = state.filter("up is not null"), state.filter("up is null")
            higher = climbing.join(above, "up", "left").select("entity_id", F.col("far").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("tangled") | F.coalesce("knot", F.lit(False))).alias("tangled"), "parent_eid").unionByName(arrived)
            before, (state, n) = n["open"], counted(higher, "climb", **still)
        # a round that ends no way upwards has only ways into cycles left
        knot = F.col("tangled") | F.col("up").isNotNull()
        self.nodes = state.select("entity_id", "parent_eid", F.when(~knot, F.col("depth")).alias("depth"), knot.alias("tangled"))
        self.has_tangled = bool(n["open"] or n["tangled"])
        self._pairs: DataFrame | None = None
        self._listing = Lock()

    @property
    def tangled(self) -> DataFrame:
        return self.nodes.filter("tangled").select("entity_id")

    @property
    def pairs(self) -> DataFrame:
        """anc, des, steps of all tangled des, listed once. Steps above them are followed as far as their ancestors go."""
        with self._listing:
            if self._pairs is None:
                self._pairs = self._listed()
        return self._pairs

    def _listed(self) -> DataFrame:
        knots = self.tangled.withColumnRenamed("entity_id", "des")
        above = durable(self.steps.join(knots, "des", "left_semi").select(F.col("anc").alias("entity_id")).distinct(), "above")
        for level in self.levels:
            above = durable(above.unionAll(level.join(above, "entity_id", "left_semi").select(F.col("up").alias("entity_id"))).distinct(), "above")
        part = self.steps.join(knots.unionAll(above).distinct(), "des", "left_semi")
        every = closure(part.select(F.col("des").alias("entity_id"), F.col("anc").alias("parent_eid")))
        return durable(every.join(knots, "des", "left_semi").select("anc", "des", "steps"), "tangled-pairs")

    def depth(self) -> DataFrame:
        """entity_id, depth: steps below the nearest root. What no root reaches has none."""
        out = self.nodes.filter("not tangled").select("entity_id", F.col("depth").cast("int").alias("depth"))
        if self.has_tangled:
            tops = self.nodes.filter("depth = 0").select(F.col("entity_id").alias("anc"))
            out = out.unionByName(self.pairs.join(tops, "anc", "left_semi").groupBy(F.col("des").alias("entity_id")).agg(F.min("steps").cast("int").alias("depth")))
        return out

    def roll_up(self, facts: DataFrame, by: list[str], value: str = "value") -> DataFrame:
        """entity_id, by, value: sums of facts (entity_id, by, value) over each entity and all below it, each once; null
        keys stay a group, sums of nulls are 0. Entities outside of the hierarchy keep their own."""
        own = durable(facts.groupBy("entity_id", *by).agg(F.sum(value).alias("v")), "own")
        kind, keys = own.schema["v"].dataType, ["entity_id", *by]
        total = lambda rows: rows.groupBy(*keys).agg(F.sum("v").cast(kind).alias("v"))
        sums = own.join(self.tangled, "entity_id", "left_anti") if self.has_tangled else own
        for level in self.levels:  # each is written, as the next one reads it twice
            sums = durable(total(sums.unionByName(sums.join(level, "entity_id").drop("entity_id").withColumnRenamed("up", "entity_id").select(*keys, "v"))), "sums")
        if self.has_tangled:
            knots = own.join(self.tangled, "entity_id", "left_semi")
            passed = knots.join(self.pairs.select(F.col("des").alias("entity_id"), "anc"), "entity_id").drop("entity_id").withColumnRenamed("anc", "entity_id").select(*keys, "v")
            sums = total(sums.unionByName(knots.select(*keys, "v")).unionByName(passed))
        return sums.select(*keys, F.coalesce("v", F.lit(0.0)).alias("value"))

    def from_above(self, start: DataFrame, join) -> DataFrame:
        """entity_id, v: join (a function of two columns) over the v of an untangled entity and all above it. start:
        entity_id, v of each."""
        held = start
        for level in self.levels:
            upper = held.select(F.col("entity_id").alias("up"), F.col("v").alias("w"))
            rows = held.join(level.join(upper, "up").select("entity_id", "w"), "entity_id", "left")  # no nulls among keys
            held = durable(rows.select("entity_id", F.when(F.col("w").isNull(), F.col("v")).otherwise(join(F.col("v"), F.col("w"))).alias("v")), "held")
        return held

    def ancestor_product(self, ids: DataFrame, priority: DataFrame) -> DataFrame:
        """entity_id, priority_product over an entity and all above it; priority: entity_id, p (several: the highest;
        none or null: 1). Entities outside of the hierarchy have their own."""
        top = priority.groupBy("entity_id").agg(F.max("p").cast("double").alias("p"))
        every = self.nodes.select("entity_id", F.lit(False).alias("asked")).unionAll(ids.select("entity_id", F.lit(True))).filter("entity_id is not null")
        every = every.groupBy("entity_id").agg(F.max("asked").alias("asked"))
        pair = lambda p: F.struct(p.alias("p"), "asked").alias("v")
        own = durable(every.join(top, "entity_id", "left").select("entity_id", pair(F.coalesce("p", F.lit(1.0)))), "own")
        free = own.join(self.tangled, "entity_id", "left_anti") if self.has_tangled else own
        out = self.from_above(free, lambda a, b: F.struct((a["p"] * b["p"]).alias("p"), a["asked"].alias("asked"))).select("entity_id", "v.p", "v.asked")
        if self.has_tangled:
            knots = own.join(self.tangled, "entity_id", "left_semi").select("entity_id", "v.p", "v.asked")
            above = self.pairs.join(own.withColumnRenamed("entity_id", "anc"), "anc").select(F.col("des").alias("entity_id"), "v.p", F.lit(False).alias("asked"))
            out = out.unionByName(above.unionByName(knots).groupBy("entity_id").agg(F.product("p").alias("p"), F.max("asked").alias("asked")))
        return out.filter("asked").select("entity_id", F.col("p").alias("priority_product"))

    def intervals(self, order: DataFrame | None = None) -> DataFrame:
        """entity_id, parent_eid, root, depth, enter, leave of untangled entities.

        enter numbers a root's tree from 0 in depth-first order, leave is the last number below an entity; so an entity
        lies below another one if they have one root and its enter lies in the other's interval. order: entity_id and a
        column `place` by which children go; equal or missing ones go by id."""
        tree = self.nodes.filter("not tangled").select("entity_id", "parent_eid", "depth")
        size = self.roll_up(tree.select("entity_id", F.lit(1).cast("bigint").alias("value")), []).select("entity_id", F.col("value").cast("bigint").alias("size"))
        rows = tree.join(size, "entity_id")
        rows = rows.join(order.select("entity_id", "place"), "entity_id", "left") if order is not None else rows.withColumn("place", F.lit(0))
        rows = durable(rows, "sized")
        before = totals_before(rows.filter("parent_eid is not null"), "parent_eid", ["place", "entity_id"], "size")
        first = rows.filter("parent_eid is null").select("entity_id", F.lit(0).cast("bigint").alias("v"), F.col("entity_id").alias("root"))
        offset = before.select("entity_id", (F.col("before") + 1).alias("v"), F.lit(None).cast(tree.schema["entity_id"].dataType).alias("root")).unionByName(first)
        both = durable(offset.select("entity_id", F.struct("v", "root").alias("v")), "offsets")
        added = self.from_above(both, lambda a, b: F.struct((a["v"] + b["v"]).alias("v"), F.coalesce(b["root"], a["root"]).alias("root")))
        return rows.join(added, "entity_id").select("entity_id", "parent_eid", F.col("v.root").alias("root"), "depth", F.col("v.v").alias("enter"), (F.col("v.v") + F.col("size") - 1).alias("leave"))

    def below(self, root: object) -> DataFrame:
        """entity_id of all below an entity."""
        kind = self.nodes.schema["entity_id"].dataType
        front = self.spark.createDataFrame([(root,)], ["e"]).select(F.col("e").cast(kind).alias("entity_id"))
        marked = self.nodes.filter("not tangled").select("entity_id", (F.col("entity_id") == F.lit(root)).alias("v"))
        out = self.from_above(durable(marked, "marked"), lambda a, b: a | b).filter("v").select("entity_id")
        if self.has_tangled:
            out = out.unionAll(self.pairs.join(front.withColumnRenamed("entity_id", "anc"), "anc", "left_semi").select(F.col("des").alias("entity_id")))
        return out.filter(F.col("entity_id") != F.lit(root))


def totals_before(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """rows with `before`: the sum of value over the rows of its group that come earlier. Rows are sorted in ranges, so a
    group that holds most rows is summed by many tasks; what lies before a range of such a group is joined to it, a row
    for each range's first and last group at most."""
    keys = [F.col(c) for c in (group, *order)]
    ranged = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    ranged = durable(ranged, "ranged")
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(group, "_part").agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = durable(parts.withColumn("_carry", F.sum("_n").over(earlier)).filter("_carry is not null").select(group, "_part", "_carry"), "carried")
    out = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(carried, [group, "_part"], "left")
    return out.withColumn("before", (F.col("_inside") + F.coalesce("_carry", F.lit(0))).cast("bigint")).select(*[f"`{c}`" for c in rows.columns], "before")


def inherited(field: DataFrame, edges: DataFrame, tree: Hierarchy | None = None) -> DataFrame:
    """field with the rows that entities inherit: of each name the nearest definition, equal distances in the order of
    breadth-first search (parents by component_index, then id). Inherited rows are numbered after an entity's own.

    An entity hands on only its winning definition of each name. Along only parents that is a matter of doubling
    pointers; tangled entities take their parents' winners in rounds, of which each moves only what got better. Rows of a
    round are bounded by entities times names, and a cycle ends as ways through it only get longer."""
    tree = tree or Hierarchy(edges)
    one = Window.partitionBy("entity_id", "value").orderBy(F.desc("component_index"))
    own = field.filter("value is not null and value != ''").withColumn("_rn", F.row_number().over(one)).filter("_rn = 1").drop("_rn")
    own = durable(own, "own-fields")
    told = durable(own.select("entity_id", F.col("value").alias("name"), F.lit(0).cast("bigint").alias("far"), F.col("entity_id").alias("anc")), "told")
    for k, level in enumerate(tree.levels):
        lower = told.select(F.col("entity_id").alias("up"), "name", (F.col("far") + (1 << k)).alias("far"), "anc")
        both = told.unionByName(level.join(lower, "up").select("entity_id", "name", "far", "anc"))
        told = durable(both.groupBy("entity_id", "name").agg(F.min(F.struct("far", "anc")).alias("b")).select("entity_id", "name", "b.far", "b.anc"), "told")
    # single parents are each the first of one
    known = told.select("entity_id", "name", F.array_repeat(F.lit(1), F.col("far").cast("int")).alias("way"), "anc")
    if tree.has_tangled:
        known = untangled(known, own, edges, tree)
    best = known.select(F.col("entity_id").alias("des"), "way", "anc", F.col("name").alias("value"))
    rows = best.join(own.withColumnRenamed("entity_id", "anc"), ["anc", "value"])
    mine = F.col("anc") == F.col("des")
    last = F.coalesce(F.max(F.when(mine, F.col("component_index"))).over(Window.partitionBy("des")), F.lit(0))
    place = F.row_number().over(Window.partitionBy("des", mine).orderBy(F.size("way"), "way", "component_index", "value"))
    numbered = rows.withColumn("_last", last).withColumn("_place", place)
    numbered = numbered.withColumn("component_index", F.when(mine, F.col("component_index")).otherwise((F.col("_last") + F.col("_place")).cast("bigint")))
    return numbered.withColumn("entity_id", F.col("des")).select(*field.columns)


def untangled(known: DataFrame, own: DataFrame, edges: DataFrame, tree: Hierarchy) -> DataFrame:
    """The winners (entity_id, name, way, anc) of all entities, from those of the untangled ones (known's others count for
    nothing) and the definitions of the tangled ones."""
    one = edges.filter("parent_eid is not null and entity_id is not null and parent_eid != entity_id").groupBy("entity_id", "parent_eid").agg(F.min("component_index").alias("i"))
    at = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("i").asc_nulls_first(), "parent_eid"))
    knots = tree.tangled
    edge = durable(one.join(knots, "entity_id", "left_semi").select("entity_id", F.col("parent_eid").alias("up"), at.alias("at")), "tangled-edges")
    free = durable(known.join(knots, "entity_id", "left_anti"), "free")
    none = F.array().cast("array<int>")
    defined = own.join(knots, "entity_id", "left_semi").select("entity_id", F.col("value").alias("name"), none.alias("way"), F.col("entity_id").alias("anc"))
    state, moved = durable(defined, "winners"), durable(free.unionByName(defined), "moved")
    rank = F.struct(F.size("way").alias("n"), "way", "anc")
    while True:
        sent = edge.join(moved.withColumnRenamed("entity_id", "up"), "up").select("entity_id", "name", F.concat(F.array("at"), "way").alias("way"), "anc")
        got = sent.groupBy("entity_id", "name").agg(F.min(rank).alias("new"))
        had = state.select("entity_id", "name", rank.alias("old"))
        both = durable(got.join(had, ["entity_id", "name"], "full_outer"), "weighed")
        better = F.col("old").isNull() | (F.col("new") < F.col("old"))
        told = lambda c: both.filter(c).select("entity_id", "name", F.when(F.coalesce(better, F.lit(False)), F.col("new")).otherwise(F.col("old")).alias("b")).select("entity_id", "name", "b.way", "b.anc")  # noqa: B023, E731
        moved, n = counted(told(better), "moved", open=F.lit(True))
        state = durable(told(F.lit(True)), "winners")
        if not n["open"]:
            return free.unionByName(state)


def ordered_trees(edges: DataFrame, weight: DataFrame) -> DataFrame:
    """root, entity_id, depth, place, weight of every tree of edges in depth-first order, the heaviest child first, then by
    path. weight: entity_id, weight, path. place numbers a root's tree from 0.

    An entity with several parents stands below each of them; a way that comes back to itself ends. Without such entities
    places are the interval labels; with them each way is a place of its own, told by the places of its steps."""
    tree = Hierarchy(edges)
    order = weight.select("entity_id", F.struct((-F.col("weight")).alias("w"), "path").alias("place"))
    if not tree.has_tangled:
        labels = tree.intervals(order)
        return labels.join(weight.select("entity_id", "weight"), "entity_id", "left").select("root", "entity_id", "depth", F.col("enter").alias("place"), "weight")
    steps = tree.steps.join(order.withColumnRenamed("entity_id", "des"), "des", "left")
    at = F.row_number().over(Window.partitionBy("anc").orderBy("place", "des"))
    steps = durable(steps.select("anc", "des", at.alias("at")), "steps")
    top = tree.nodes.filter("depth = 0")
    front = durable(top.select(F.col("entity_id").alias("root"), "entity_id", F.array().cast("array<int>").alias("way"), F.array("entity_id").alias("above")), "ways")
    parts, n = [front], {"open": 1}
    while n["open"]:
        down = front.join(steps.withColumnRenamed("anc", "entity_id"), "entity_id").filter(~F.array_contains("above", F.col("des")))
        front, n = counted(down.select("root", F.col("des").alias("entity_id"), F.concat("way", F.array("at")).alias("way"), F.concat("above", F.array("des")).alias("above")), "ways", open=F.lit(True))
        parts.append(front)
    every = one_table(parts).withColumn("n", F.lit(1))
    placed = totals_before(every, "root", ["way"], "n")
    return placed.join(weight.select("entity_id", "weight"), "entity_id", "left").select("root", "entity_id", F.size("way").cast("bigint").alias("depth"), F.col("before").alias("place"), "weight")

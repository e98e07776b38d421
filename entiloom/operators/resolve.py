"""References between entities: by id, by alias, by part of a path; and entities declared to be the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import durable

#: Characters of a reference's head that places in paths are matched by, first and, for longer references, again.
HEAD, LONG_HEAD = 3, 8


def heads(refs: DataFrame, size: int, longest: int, name: str) -> DataFrame:
    """head, n: the first so many characters of references (all of a shorter one), and each length that references with
    this head have, those above `longest` as one more than it."""
    return durable(refs.select(F.left("ref", F.lit(size)).alias("head"), F.least(F.length("ref"), F.lit(longest + 1)).alias("n")).distinct(), name)


def numbered(paths: DataFrame) -> DataFrame:
    """path, eid, num, several: paths (path, eid) with a number for each entity, and whether it has more paths."""
    rows, same = durable(paths.withColumn("num", F.monotonically_increasing_id()), "paths"), Window.partitionBy("eid")
    return durable(rows.select("path", "eid", F.min("num").over(same).alias("num"), (F.count("*").over(same) > 1).alias("several")), "paths-numbered")


def candidates(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """ref, eid, num: stretches of the paths (numbered) that may be a ref (non-empty), each once for an entity. A stretch has
    the head and the length of a ref; whether it is one, an equi-join tells.

    Places of a path are looked up by the heads that start there, and give one stretch for each length that references with
    this head have. So the work follows the paths and the lengths, however many references share a part."""
    refs = refs.select("ref")
    first = heads(refs, HEAD, LONG_HEAD, "heads")
    lengths = [r.n for r in first.select("n").distinct().collect()]  # nine at most
    sizes = F.array(*[F.lit(n) for n in sorted({min(n, HEAD) for n in lengths})]).cast("array<int>")
    long_heads = heads(refs.filter(F.length("ref") > LONG_HEAD), LONG_HEAD, (1 << 31) - 2, "long-heads") if LONG_HEAD + 1 in lengths else None
    tasks = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = F.col("at") + F.col("n") - 1 <= F.length("path")

    def found(some: DataFrame) -> DataFrame:
        starts = some.repartition(tasks).select("path", "eid", "num", F.explode(F.sequence(F.lit(1), F.length("path"))).alias("at")).select("*", F.explode(sizes).alias("size"))
        starts = starts.filter(F.col("at") + F.col("size") - 1 <= F.length("path"))
        places = starts.select("path", "eid", "num", "at", F.substr("path", "at", "size").alias("head"))
        cut = places.join(first.filter(F.col("n") <= LONG_HEAD), "head").filter(fits)
        if long_heads is not None:
            far = places.join(first.filter(F.col("n") > LONG_HEAD), "head").select("path", "eid", "num", "at", F.substr("path", "at", F.lit(LONG_HEAD)).alias("head"))
            cut = cut.unionByName(far.join(long_heads, "head").filter(fits))
        # a path that holds a stretch twice tells it at its first place
        return cut.withColumn("ref", F.substr("path", "at", "n")).filter(F.position("ref", "path") == F.col("at")).select("ref", "eid", "num")

    paths = paths.filter("path != ''")
    return found(paths.filter("not several")).unionAll(found(paths.filter("several")).distinct())


def containing(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """ref, eid of all paths (path, eid) that contain a ref (distinct, non-empty)."""
    return candidates(refs, numbered(paths)).join(refs.select("ref"), "ref", "left_semi").select("ref", "eid")


def counted_inside(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """ref, eid, n_candidates of the refs (distinct, non-empty) that paths (path, eid) contain; eid where there is a single
    one. Stretches are counted before they meet the refs, so a ref that most paths contain is a row like others."""
    places = numbered(paths)
    counts = candidates(refs, places).groupBy("ref").agg(F.count("eid").alias("n_candidates"), F.min("num").alias("num"))
    counts = durable(counts.join(refs.select("ref"), "ref", "left_semi"), "refs-inside")
    one = counts.filter("n_candidates = 1").join(places.select("num", "eid").distinct(), "num").select("ref", "eid", "n_candidates")
    return one.unionByName(counts.filter("n_candidates != 1").select("ref", F.lit(None).cast("string").alias("eid"), "n_candidates"))


def named_in(spine: DataFrame) -> DataFrame:
    """ref, eid, tier of all ids (1) and aliases (2)."""
    named = spine.select(F.col("value").alias("ref"), F.col("value").alias("eid"), F.lit(1).alias("tier"))
    return named.unionAll(spine.filter("alias is not null").select("alias", "value", F.lit(2))).distinct()


def paths_of(spine: DataFrame) -> DataFrame:
    return spine.filter("path is not null").select("path", F.col("value").alias("eid")).distinct()


def matches(refs: DataFrame, spine: DataFrame) -> DataFrame:
    """ref, eid, tier of the first of three searches that has any hit: 1 id, 2 alias, 3 part of the path. Ids and aliases
    are looked up in one equi-join; the search in paths sees only what they leave."""
    asked = refs.filter("ref is not null and ref != ''").select("ref").distinct()
    best = F.min("tier").over(Window.partitionBy("ref"))  # the hits of one name
    found = durable(asked.join(named_in(spine), "ref", "left").withColumn("best", best).filter("tier is null or tier = best").select("ref", "eid", "tier"), "refs-named")
    inside = containing(found.filter("tier is null").select("ref"), paths_of(spine)).withColumn("tier", F.lit(3))
    return found.filter("tier is not null").unionByName(inside)


def resolve(refs: DataFrame, spine: DataFrame) -> DataFrame:
    """ref, eid, n_candidates for each distinct ref (column ref) with a hit; eid where there is a single one. Blank and
    null refs have none. As in matches(), but hits are counted for each name before refs meet them."""
    asked = refs.filter("ref is not null and ref != ''").select("ref").distinct()
    tier = lambda n: F.when(F.col("tier") == n, F.col("eid"))
    names = named_in(spine).groupBy("ref").agg(F.count(tier(1)).alias("ids"), F.count(tier(2)).alias("aliases"), F.min(tier(2)).alias("low"))
    found = durable(asked.join(names, "ref", "left"), "refs-named")
    eid = F.when(F.col("ids") > 0, F.col("ref")).when(F.col("aliases") == 1, F.col("low"))
    named = found.filter("ids is not null").select("ref", eid.alias("eid"), F.when(F.col("ids") > 0, F.lit(1)).otherwise(F.col("aliases")).cast("bigint").alias("n_candidates"))
    return named.unionByName(counted_inside(found.filter("ids is null"), paths_of(spine)))


def references(tables: dict[str, DataFrame], fields: dict[str, list[str]]) -> DataFrame | None:
    """ref: the texts of all reference fields of all tables, so that they are resolved together."""
    out = None
    for name, names in fields.items():
        for f in names:
            refs = tables[name].select(F.col(f"`{f}`").cast("string").alias("ref"))
            out = refs if out is None else out.unionAll(refs)
    return out


def with_resolved(table: DataFrame, fields: list[str], found: DataFrame) -> DataFrame:
    """table with `<field>_eid` for each field, null where the reference is unknown or ambiguous; found: ref, eid."""
    for f in fields:
        hit = found.select(F.col("ref").alias("_ref"), F.col("eid").alias(f"{f}_eid"))
        table = table.drop(f"{f}_eid").join(hit, F.col(f"`{f}`").cast("string") == F.col("_ref"), "left").drop("_ref")
    return table


def same_as_map(same_as: DataFrame, spine: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """owner, target of all same_as rows, chains followed to their end. Raises if a target is unknown or not unique, or
    if a chain comes back to itself."""
    every = spine.select("value", "path", "alias") if existing is None else spine.select("value", "path", "alias").unionByName(existing.select("value", "path", "alias")).distinct()
    named = F.col("target_entity_id") if "target_entity_id" in same_as.columns else F.lit(None).cast("string")
    text = F.col("value").cast("string") if "value" in same_as.columns else F.lit(None).cast("string")
    rows = same_as.select(F.col("entity_id").alias("owner"), F.nullif(named, F.lit("")).alias("exact"), F.nullif(text, F.lit("")).alias("ref")).distinct()
    known = rows.join(every.select(F.col("value").alias("exact")).distinct().withColumn("ok", F.lit(1)), "exact", "left")
    direct = known.filter("exact is not null").select("owner", F.when(F.col("ok") == 1, F.col("exact")).alias("target"))
    asked = rows.filter("exact is null")
    hits = asked.join(matches(asked, every), "ref", "left")
    best = hits.groupBy("owner").agg(F.min("tier").alias("tier"))
    chosen = hits.join(best, "owner").filter(hits["tier"].eqNullSafe(best["tier"])).groupBy("owner")
    other = F.when(F.col("eid") != F.col("owner"), F.col("eid"))
    by_ref = chosen.agg(F.min(other).alias("low"), F.max(other).alias("high")).select("owner", F.when(F.col("low") == F.col("high"), F.col("low")).alias("target"))
    out = durable(direct.unionByName(by_ref), "same-as")
    lost = out.filter("target is null").limit(5).collect()
    if lost:
        raise ValueError(f"same_as of {[r.owner for r in lost]} names no single entity")
    for _ in range(64):
        onward = out.select(F.col("owner").alias("target"), F.col("target").alias("next"))
        step = durable(out.join(onward, "target", "left").select("owner", "target", "next"), "same-as")
        if step.filter("owner = next or owner = target").limit(1).count():
            raise ValueError("same_as declarations form a circle")
        moved = step.filter("next is not null").limit(1).count()
        out = step.select("owner", F.coalesce("next", "target").alias("target"))
        if not moved:
            return out
    raise ValueError("same_as declarations form a circle")


def rebase(table: DataFrame, moved: DataFrame) -> DataFrame:
    """table with owners' rows under their targets' ids."""
    return table.join(moved.withColumnRenamed("owner", "entity_id"), "entity_id", "left").withColumn("entity_id", F.coalesce("target", "entity_id")).select(*table.columns)

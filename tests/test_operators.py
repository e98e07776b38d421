import math

import pytest
from pyspark.sql import functions as F

from entiloom.functions.columns import double_to_long, duration_seconds, ratio
from entiloom.operators import derive, graph, resolve
from entiloom.operators.views import merged


def edges(spark, *rows):
    return spark.createDataFrame([(c, i, p) for i, (p, c) in enumerate(rows)], "entity_id string, component_index bigint, parent_eid string")


def test_closure_ends_on_cycles(spark):
    pairs = {(r.anc, r.des, r.steps) for r in graph.closure(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))).collect()}
    assert ("a", "c", 2) in pairs and ("a", "d", 3) in pairs and not any(x == y for x, y, _ in pairs)
    assert graph.entity_depth(edges(spark, ("a", "b"), ("b", "a"))).collect() == []


def test_requirement_tree(spark):
    e = edges(spark, ("r", "x"), ("r", "y"), ("x", "z"))
    spine = spark.createDataFrame([(i, f"f:{i}", i, i) for i in "rxyz"], "value string, path string, alias string, entity_key string")
    need = spark.createDataFrame([("x", 0.2), ("y", 0.9), ("y", 0.1)], "entity_id string, value double")
    tree = graph.requirement_tree(e, spine, need, "r")
    assert (tree["priority"], [c["name"] for c in tree["children"]]) == (0.5, ["y", "x"])
    with pytest.raises(ValueError):
        graph.requirement_tree(e, spine, need, "nothing")


def test_ratio_and_rounding(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double").select(ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert rows[0].r == math.inf and rows[1].r == -math.inf and math.isnan(rows[2].r) and rows[3].r == 1.5
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,), (-3.7,)], "x double").select(double_to_long(F.col("x"))).collect()] == [2, 4, -4]


def test_durations(spark):
    texts = ["7 days", "weekly", "2 hours", "1.5 days", None, "", "daily"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(duration_seconds(F.col("t"))).collect()]
    assert got == [604800, 604800, 7200, 129600, None, None, 86400]
    with pytest.raises(Exception, match="not a duration"):
        spark.createDataFrame([("often",)], "t string").select(duration_seconds(F.col("t"))).collect()


def test_impact_and_cost_known_answer(spark):
    impact = spark.createDataFrame([("e", "a", 0.75 * 4 + 0.25 * 0.2)], "entity_id string, type string, value double")
    cost = spark.createDataFrame([("e", "h", 1.0), ("e", "d", 40.0), ("z", "h", 0.0)], "entity_id string, type string, value double")
    budget = spark.createDataFrame([("h", 2.0), ("d", 4 / 50)], "value string, normalized_value_per_unit double")
    got = {r.entity_id: r for r in derive.impact_cost(impact, cost, None, budget).collect()}
    assert (got["e"].impact, got["e"].cost, round(got["e"]["diff"], 9)) == (3.05, 5.2, -2.15) and math.isnan(got["z"].ratio)
    with pytest.raises(ValueError):
        derive.impact_cost(impact, cost, None, budget.unionAll(budget))


def test_same_as_chains_and_errors(spark):
    spine = spark.createDataFrame([(i, f"f:{i * 3}", i * 3) for i in "abc"], "value string, path string, alias string")
    rows = lambda *r: spark.createDataFrame(list(r), "entity_id string, value string, target_entity_id string")
    got = {r.owner: r.target for r in resolve.same_as_map(rows(("a", "bbb", None), ("b", None, "c")), spine).collect()}
    assert got == {"a": "c", "b": "c"}
    for bad in (rows(("a", "nothing", None)), rows(("a", "f:", None)), rows(("a", None, "b"), ("b", None, "a")), rows(("a", None, "q"))):
        with pytest.raises(ValueError):
            resolve.same_as_map(bad, spine).collect()


def test_parts_of_paths(spark):
    """Odd texts against plain Python: repeats inside a path, ends, marks, wide characters, long shared heads, several paths."""
    refs = ["a", "aa", "aaa", "b1", "é😀", "😀", "%", "_", "\\", "goals.alpha.x1", "goals.alpha.x12", "goals.alpha", "goals.al", "goals.alp", "nowhere", "goals.beta.x1", "z"]
    spots = [("aaaa", "1"), ("", "2"), ("a", "3"), ("xb", "4"), ("xb1", "4"), ("b1b1", "4"), ("é😀", "5"), ("50%", "6"), ("c\\d_", "7"), ("f:goals.alpha.x12", "8"), ("f:goals.alpha.x1", "9"), ("goals.goals.alpha.x1", "9"), ("f:goals.alp", "10"), ("xb1", "11")]
    asked, paths = spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame(spots, "path string, eid string")
    expected = {r: {e for p, e in spots if r in p} for r in refs}
    assert sorted(tuple(r) for r in resolve.containing(asked, paths).collect()) == sorted((r, e) for r, hits in expected.items() for e in hits)
    spine = paths.select(F.col("eid").alias("value"), "path", F.lit(None).cast("string").alias("alias")).filter("path != ''")
    odd = asked.unionAll(spark.createDataFrame([("",), (None,), ("aa",)], "ref string"))
    got = {r.ref: (r.eid, r.n_candidates) for r in resolve.resolve(odd, spine).collect()}
    assert got == {r: (min(hits) if len(hits) == 1 else None, len(hits)) for r, hits in expected.items() if hits}
    assert resolve.resolve(asked.limit(0), spine).count() == 0


def test_work_of_parts_of_paths_follows_the_paths(spark):
    """Every gram of three characters is shared by hundreds of references and paths; stretches that meet references are few."""
    n = 4000
    refs = spark.range(n).select(F.lpad((F.col("id") * 7919 % 100_000).cast("string"), 5, "1").alias("ref"))
    paths = spark.range(n).select(F.concat(F.lit("item#0"), F.lpad((F.col("id") * 104_729 % 1_000_000).cast("string"), 6, "0")).alias("path"), F.col("id").cast("string").alias("eid"))
    assert resolve.candidates(refs, resolve.numbered(paths)).count() <= 3 * n  # places of five digits in a path


def test_merge_aligns_columns_and_types(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([("1", 2.0), ("1", 2.0)], "k string, w double")
    assert {tuple(r) for r in merged(a, b).collect()} == {("1", "x", None), ("1", None, 2.0)} and merged(a, b).count() == 2

"""The library's operators on star-schema tables, as queries by name, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import BLANKS, depth_of, entity_id, strip
from ..operators import audit, derive, eav, export, graph, resolve, validate, views
from ..operators.validate import FieldRule
from ..sources.tables import durable, read
from .registry import Registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def text(c: str):
    return F.col(c).cast("string")


def coded(letters: str, c: str):
    """Letters and a number, as ids of several tables go in one column."""
    return F.concat(F.lit(letters), text(c))


def cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


# ---- entities: region.nation.customer ------------------------------------------------------------------------------

SPINE = """(SELECT 'world:' || r_name AS path FROM region
 UNION ALL SELECT 'world:' || r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'world:' || r_name || '.' || n_name || '.' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EDGES = """(SELECT r_name AS p, r_name || '.' || n_name AS c FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name || '.' || n_name, r_name || '.' || n_name || '.' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CLOSED = f"""WITH RECURSIVE e AS {EDGES}, closed AS (SELECT p AS anc, c AS des, 1 AS steps FROM e UNION SELECT anc, c, steps + 1 FROM closed JOIN e ON des = p)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    """region, nation, customer names of each customer, joined once."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    region = read(spark, d, "region")
    nation = read(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    world = lambda *c: F.concat(F.lit("world:"), F.concat_ws(".", *c)).alias("path")
    return region.select(world("r_name")).unionAll(nation.select(world("r_name", "n_name"))).unionAll(places(spark, d).select(world("r_name", "n_name", "c_name")))


def named_edges(spark: SparkSession, d: str) -> DataFrame:
    """parent_eid, entity_id by readable names, for results that SQL can show too."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dot = lambda *c: F.concat_ws(".", *c)
    return nation.select(F.col("r_name").alias("parent_eid"), dot("r_name", "n_name").alias("entity_id")).unionAll(
        places(spark, d).select(dot("r_name", "n_name").alias("parent_eid"), dot("r_name", "n_name", "c_name").alias("entity_id"))
    )


@query(f"""SELECT substring(sha256(path), 1, 12) AS value, path, regexp_extract(path, '((?:[^:.]+[.])?[^:.]+)$', 1) AS alias,
 regexp_extract(path, '([^:.]+)$', 1) AS entity_key, 'world' AS filepath FROM {SPINE}""")
def entity_spine(spark, d):
    return eav.spine(paths(spark, d))


@query("""SELECT substring(sha256('parts:' || p_brand || '.part' || p_partkey), 1, 12) AS entity_id, 'part' || p_partkey AS entity_key,
 'parts:' || p_brand || '.part' || p_partkey AS entity_path, 'parts' AS filepath, i AS component_index, t AS component_type, m AS modifier,
 'parts:' || p_brand || '.part' || p_partkey || '.data[' || i || '].' || t || coalesce(' ' || m, '') AS spine_path, f AS field, v AS value
 FROM (SELECT *, cast(0 AS BIGINT) AS i, 'part' AS t, cast(NULL AS VARCHAR) AS m, 'name' AS f, p_name AS v FROM part
 UNION ALL SELECT *, 0, 'part', NULL, 'type', p_type FROM part UNION ALL SELECT *, 1, 'size', 'of', 'value', cast(p_size AS VARCHAR) FROM part)""")
def path_parse_eav(spark, d):
    part = read(spark, d, "part")
    owner = F.concat(F.lit("parts:"), "p_brand", F.lit(".part"), text("p_partkey"), F.lit(".data"))
    pairs = F.explode(F.array(*[F.struct(F.concat(owner, F.lit(p)).alias("path"), text(c).alias("value")) for p, c in (("[0].part.name", "p_name"), ("[0].part.type", "p_type"), ("[1].size of", "p_size"))]))
    return eav.key_value(eav.split_pairs(part.select(pairs.alias("x")).select("x.path", "x.value", F.lit(0).cast("bigint").alias("seq")))).drop("seq")


@query("""SELECT substring(sha256('events:e' || event_id), 1, 12) AS entity_id, cast(0 AS BIGINT) AS component_index, cast(NULL AS VARCHAR) AS modifier,
 event_type AS kind, cast(user_id AS VARCHAR) AS "user" FROM events""")
def eav_pivot(spark, d):
    e = read(spark, d, "events").withColumn("entity_id", entity_id(F.concat(F.lit("events:e"), text("event_id"))))
    kv = e.select("entity_id", F.lit(0).cast("bigint").alias("component_index"), F.lit("event").alias("component_type"), F.lit(None).cast("string").alias("modifier"), F.explode(F.array(F.struct(F.lit("kind").alias("field"), F.col("event_type").alias("value"), F.lit(0).alias("seq")), F.struct(F.lit("user").alias("field"), text("user_id").alias("value"), F.lit(1).alias("seq")))).alias("x"))
    return eav.pivot(kv.select("*", "x.*").drop("x"), "event", ["kind", "user"])


@query("""SELECT cast(c_custkey AS VARCHAR) AS entity_id, cast(0 AS BIGINT) AS component_index, cast(NULL AS VARCHAR) AS modifier, f AS field, v AS value FROM
 (SELECT c_custkey, 'c_name' AS f, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer
 UNION ALL SELECT c_custkey, 'c_nationkey', cast(c_nationkey AS VARCHAR) FROM customer) WHERE v IS NOT NULL""")
def eav_unpivot(spark, d):
    c = read(spark, d, "customer")
    return eav.unpivot(c.select(text("c_custkey").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"), "c_name", "c_mktsegment", "c_nationkey"))


@query("""SELECT event_id, 'k' AS field, props->>'k' AS value FROM events WHERE props->>'k' IS NOT NULL""")
def json_flatten(spark, d):
    return read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))


# ---- views ---------------------------------------------------------------------------------------------------------


def star_registry(spark: SparkSession, d: str) -> Registry:
    customer, orders, nation = read(spark, d, "customer"), read(spark, d, "orders"), read(spark, d, "nation")
    line = read(spark, d, "lineitem")
    key = text("c_custkey").alias("entity_id")
    reg = Registry(spark, {
        "entity_id": customer.select(text("c_custkey").alias("value"), F.col("c_name").alias("path"), F.col("c_name").alias("alias"), F.col("c_name").alias("entity_key")),
        "account": customer.select(key, cents("c_acctbal").alias("cents"), F.col("c_mktsegment").alias("segment")),
        "home": customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(key, F.col("n_name").alias("nation")),
        "order": orders.select(text("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("status")),
        "line": line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(text("o_custkey").alias("entity_id"), F.col("l_orderkey").alias("number"), F.col("l_returnflag").alias("flag")),
    })
    reg.declare("refund", [FieldRule("value", "float")])
    return reg


def plain(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


@query("""SELECT cast(c_custkey AS VARCHAR) AS entity_id, c_name AS entity_id_alias, cast(round(c_acctbal * 100) AS BIGINT) AS account_cents, c_mktsegment AS account_segment,
 n_name AS home_nation, o_orderkey AS order_number, o_orderstatus AS order_status FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey""")
def view_inner_join(spark, d):
    return plain(star_registry(spark, d).view(["account", "home", "order"]))


@query("""SELECT cast(c_custkey AS VARCHAR) AS entity_id, c_name AS entity_id_alias, c_mktsegment AS account_segment, l_orderkey AS line_number, l_returnflag AS line_flag
 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey""")
def view_field_select(spark, d):
    return plain(star_registry(spark, d).view(["account.segment", "line.number", "line.flag"]))


@query("""SELECT cast(c_custkey AS VARCHAR) AS entity_id, c_name AS entity_id_alias, cast(0 AS DOUBLE) AS refund_value FROM customer WHERE false""")
def view_missing_type_empty(spark, d):
    return plain(star_registry(spark, d).view("refund"))


@query("""SELECT cast(user_id AS VARCHAR) AS entity_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def view_current_scd(spark, d):
    e = read(spark, d, "events").select(text("user_id").alias("entity_id"), "event_id", "event_type", "ts")
    return views.current(e, "ts", ["event_id"])


@query("""SELECT cast(user_id AS VARCHAR) AS entity_id, count(*) AS n_versions, count(DISTINCT event_type) AS n_kinds FROM events GROUP BY user_id HAVING count(*) > 1""")
def scd_history_count(spark, d):
    e = read(spark, d, "events").groupBy(text("user_id").alias("entity_id"))
    return e.agg(F.count("*").alias("n_versions"), F.count_distinct("event_type").alias("n_kinds")).filter("n_versions > 1")


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN user_id END, 20240101) AS time FROM events""")
def scd_time_fill(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("time"))
    return derive.time_filled(e, "time", 20240101)


@query("""SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION SELECT s_name, s_nationkey, NULL FROM supplier""")
def merge_union_distinct(spark, d):
    a = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return views.merged(a, read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation UNION SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def merge_idempotent(spark, d):
    n = read(spark, d, "nation")
    return views.merged(n, n)


# ---- audits --------------------------------------------------------------------------------------------------------

COVERAGE = """SELECT cast(o_orderkey AS VARCHAR) AS entity_id, cast(l_suppkey AS VARCHAR) AS solution_eid, CASE WHEN s_acctbal < 0 THEN 'blocked' ELSE 'done' END AS status
 FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey"""


def coverage(spark: SparkSession, d: str) -> DataFrame:
    solution = read(spark, d, "lineitem").select(text("l_orderkey").alias("value_eid"), text("l_suppkey").alias("entity_id")).distinct()
    state = F.when(F.col("s_acctbal") < 0, "blocked").otherwise("done")
    status = read(spark, d, "supplier").select(text("s_suppkey").alias("entity_id"), state.alias("value"))
    return audit.requirement_coverage(read(spark, d, "orders").select(text("o_orderkey").alias("entity_id")), solution, status)


@query(f"SELECT entity_id, solution_eid, CASE WHEN solution_eid IS NOT NULL THEN status END AS solution_status FROM ({COVERAGE})")
def requirement_coverage(spark, d):
    return coverage(spark, d)


@query(f"SELECT entity_id FROM ({COVERAGE}) WHERE solution_eid IS NULL")
def coverage_uncovered(spark, d):
    return coverage(spark, d).filter("solution_eid is null").select("entity_id")


@query("""SELECT cast(doc_id AS VARCHAR) AS entity_id, 'Entity ''' || doc_id || ''' does not trace to any requirement.' AS message FROM documents
 WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id IS NOT NULL)""")
def traceability_orphans(spark, d):
    ids = lambda t, c: read(spark, d, t).select(text(c).alias("entity_id"))
    return audit.traceability(ids("documents", "doc_id"), ids("labels", "doc_id"), ids("conversations", "conv_id"))


@query("SELECT cast(o_orderkey AS VARCHAR) AS entity_id, o_orderpriority AS value FROM orders WHERE o_orderstatus = 'O'")
def todo_audit(spark, d):
    return audit.todo(read(spark, d, "orders").filter("o_orderstatus = 'O'").select(text("o_orderkey").alias("entity_id"), F.col("o_orderpriority").alias("value")))


# ---- hierarchy -----------------------------------------------------------------------------------------------------


@query(f"""SELECT c AS entity_id, length(c) AS width FROM (SELECT DISTINCT c FROM {EDGES}) WHERE c NOT IN (SELECT p FROM {EDGES}) ORDER BY width DESC, c LIMIT 25""")
def leaf_requirements(spark, d):
    e = named_edges(spark, d)
    leaves = e.select("entity_id").distinct().join(e.select(F.col("parent_eid").alias("entity_id")), "entity_id", "left_anti")
    return leaves.withColumn("width", F.length("entity_id").cast("bigint")).orderBy(F.desc("width"), "entity_id").limit(25)


@query(f"""SELECT substring(sha256(path), 1, 12) AS entity_id, cast(-1 AS BIGINT) AS component_index, cast(NULL AS VARCHAR) AS modifier,
 substring(sha256(regexp_replace(path, '[.][^.]*$', '')), 1, 12) AS parent_eid, true AS is_primary FROM {SPINE} WHERE path LIKE '%.%'""")
def parent_from_path(spark, d):
    return graph.parents_from_paths(eav.spine(paths(spark, d)))


@query("""SELECT cast(p_partkey AS VARCHAR) AS entity_id, cast(first AS VARCHAR) AS parent_eid FROM part JOIN (SELECT p_name AS n, min(lpad(cast(p_partkey AS VARCHAR), 12, '0')) AS path FROM part GROUP BY 1) ON n = p_name
 JOIN (SELECT p_partkey AS first, lpad(cast(p_partkey AS VARCHAR), 12, '0') AS fp FROM part) ON fp = path""")
def explicit_parent_first_key(spark, d):
    part = read(spark, d, "part")
    spine = part.select(text("p_partkey").alias("value"), F.lpad(text("p_partkey"), 12, "0").alias("path"), F.col("p_name").alias("entity_key"))
    asked = part.select(text("p_partkey").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"), F.lit(None).cast("string").alias("modifier"), F.col("p_name").alias("value"))
    return graph.parents(spine, asked).select("entity_id", "parent_eid")


@query(f"{CLOSED} SELECT anc, des, min(steps) AS steps FROM closed GROUP BY anc, des")
def hierarchy_closure(spark, d):
    return graph.closure(named_edges(spark, d)).withColumn("steps", F.col("steps").cast("bigint"))


@query(f"""{CLOSED} SELECT des AS entity_id, min(steps) AS depth FROM closed WHERE anc NOT IN (SELECT c FROM e) GROUP BY des UNION ALL SELECT DISTINCT p, 0 FROM e WHERE p NOT IN (SELECT c FROM e)""")
def entity_depth(spark, d):
    return graph.entity_depth(named_edges(spark, d)).withColumn("depth", F.col("depth").cast("bigint"))


FACTS = """(SELECT r_name || '.' || n_name || '.' || c_name AS des, o_orderpriority AS pr, cast(round(o_totalprice * 100) AS BIGINT) AS v
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def order_facts(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").join(places(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.concat_ws(".", "r_name", "n_name", "c_name").alias("entity_id"), F.col("o_orderpriority").alias("schedule"), cents("o_totalprice").cast("double").alias("value"))


@query(f"""{CLOSED} SELECT anc AS entity_id, pr AS schedule, sum(v) AS cents FROM (SELECT anc, des FROM closed UNION SELECT c, c FROM e) JOIN {FACTS} USING (des) GROUP BY 1, 2""")
def effort_rollup(spark, d):
    return graph.Hierarchy(named_edges(spark, d)).roll_up(order_facts(spark, d), ["schedule"]).select("entity_id", "schedule", F.col("value").cast("decimal(38,0)").alias("cents"))


@query(f"""{CLOSED} SELECT anc AS entity_id, nullif(pr, '5-LOW') AS schedule, sum(v) AS cents FROM (SELECT anc, des FROM closed UNION SELECT c, c FROM e) JOIN {FACTS} USING (des) GROUP BY 1, 2""")
def effort_rollup_nulls(spark, d):
    """Facts without a schedule are a group of their own, at every level."""
    facts = order_facts(spark, d).withColumn("schedule", F.nullif("schedule", F.lit("5-LOW")))
    return graph.Hierarchy(named_edges(spark, d)).roll_up(facts, ["schedule"]).select("entity_id", "schedule", F.col("value").cast("decimal(38,0)").alias("cents"))


WEIGHTS = "CASE length({0}) % 4 WHEN 1 THEN 0.9 WHEN 2 THEN 0.2 ELSE 0.5 END"


@query(f"""WITH n AS (SELECT r_name AS r, r_name || '.' || n_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey), nr AS (SELECT r, p, {WEIGHTS.format("p")} AS w, row_number() OVER (PARTITION BY r ORDER BY {WEIGHTS.format("p")} DESC, p) AS i FROM n),
 c AS (SELECT r, p, p || '.' || c_name AS q FROM n JOIN nation x ON n.p LIKE '%.' || x.n_name JOIN customer ON c_nationkey = x.n_nationkey), cr AS (SELECT r, p, q, {WEIGHTS.format("q")} AS w, row_number() OVER (PARTITION BY p ORDER BY {WEIGHTS.format("q")} DESC, q) AS j FROM c),
 t AS (SELECT r AS root, r AS entity_id, 0 AS depth, {WEIGHTS.format("r")} AS priority, 0 AS i, 0 AS j FROM (SELECT DISTINCT r FROM n) UNION ALL SELECT r, p, 1, w, i, 0 FROM nr UNION ALL SELECT cr.r, q, 2, cr.w, i, j FROM cr JOIN nr ON nr.p = cr.p)
 SELECT root, entity_id, upper(entity_id) AS name, cast(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY root ORDER BY i, j) - 1 AS place, cast(priority AS DOUBLE) AS priority FROM t""")
def requirement_trees(spark, d):
    """Every requirement tree in depth-first order, the highest priority first; a missing priority counts as 0.5."""
    e = durable(named_edges(spark, d), "edges")
    ids = e.select("entity_id").unionAll(e.select("parent_eid")).distinct()
    n = F.length("entity_id") % 4
    need = ids.select("entity_id", F.when(n == 1, 0.9).when(n == 2, 0.2).when(n == 3, 0.5).alias("value"))
    spine = ids.select(F.col("entity_id").alias("value"), F.col("entity_id").alias("path"), F.upper("entity_id").alias("entity_key"))
    return graph.requirement_rows(e, spine, need)


@query(f"""{CLOSED} SELECT anc AS entity_id, cast(sum(v * CASE pr WHEN '1-URGENT' THEN 28 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 14 ELSE 1 END) AS DECIMAL(38,0)) AS cents
 FROM (SELECT anc, des FROM closed UNION SELECT c, c FROM e) JOIN {FACTS} USING (des) GROUP BY 1""")
def effort_total_period(spark, d):
    plan = F.when(F.col("schedule") == "1-URGENT", "daily").when(F.col("schedule") == "2-HIGH", "weekly").when(F.col("schedule") == "3-MEDIUM", "2 days")
    effort = order_facts(spark, d).withColumn("schedule", plan)
    total = derive.effort_total(graph.Hierarchy(named_edges(spark, d)), effort.withColumn("value", F.col("value").cast("decimal(20,0)")), "28 days")
    return total.select("entity_id", F.round("value").cast("decimal(38,0)").alias("cents"))


@query(f"""{CLOSED}, pr AS (SELECT DISTINCT c AS id, CASE WHEN length(c) % 3 = 0 THEN 0.5 WHEN length(c) % 3 = 1 THEN 0.25 ELSE 2.0 END AS p FROM e)
 SELECT des AS entity_id, cast(product(coalesce(p, 1.0)) AS DOUBLE) AS priority_product FROM (SELECT anc, des FROM closed UNION SELECT c, c FROM e UNION SELECT p, p FROM e) LEFT JOIN pr ON id = anc GROUP BY des""")
def priority_product(spark, d):
    e = durable(named_edges(spark, d), "edges")
    ids = e.select("entity_id").unionAll(e.select(F.col("parent_eid").alias("entity_id"))).distinct()
    n = F.length("entity_id") % 3
    p = e.select("entity_id", F.when(n == 0, 0.5).when(n == 1, 0.25).otherwise(2.0).alias("p"))
    return graph.Hierarchy(e).ancestor_product(ids, p)


@query("""WITH i AS (SELECT l_orderkey AS k, sum(cast(round(l_quantity) AS BIGINT) * CASE l_returnflag WHEN 'R' THEN 2 ELSE 1 END) AS v FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
 c AS (SELECT l_orderkey AS k, sum(cast(round(l_quantity) AS BIGINT) - 1) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
 SELECT cast(coalesce(i.k, c.k) AS VARCHAR) AS entity_id, coalesce(i.v, 0) AS impact, coalesce(c.v, 0) AS cost, coalesce(i.v, 0) - coalesce(c.v, 0) AS diff,
 CASE WHEN coalesce(c.v, 0) <> 0 THEN cast(floor(coalesce(i.v, 0) * 1000 / c.v) AS BIGINT) WHEN coalesce(i.v, 0) > 0 THEN -1 ELSE -2 END AS thousandths FROM i FULL JOIN c ON i.k = c.k""")
def impact_cost_ratio(spark, d):
    line = read(spark, d, "lineitem").select(text("l_orderkey").alias("entity_id"), F.col("l_returnflag").alias("type"), F.round("l_quantity").alias("value"))
    budget = values(spark, "value string, normalized_value_per_unit double", ("R", 2.0))
    out = derive.impact_cost(line.filter("type <> 'A'"), line.filter("type = 'A'").withColumn("value", F.col("value") - 1), budget)
    whole = [F.col(c).cast("bigint").alias(c) for c in ("impact", "cost", "diff")]
    shown = F.when(F.col("cost") != 0, F.floor(F.col("impact") * 1000 / F.col("cost"))).when(F.col("ratio") == float("inf"), -1).when(F.isnan("ratio"), -2)
    return out.select("entity_id", *whole, shown.cast("bigint").alias("thousandths"))


@query(f"""WITH e AS {EDGES}, f AS (SELECT r_name AS owner, 0 AS idx, 'currency' AS name FROM region UNION ALL SELECT r_name || '.' || n_name, 3, 'tax' FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name || '.' || n_name, 5, 'currency' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0),
 up AS (SELECT id, id AS anc, 0 AS s FROM (SELECT p AS id FROM e UNION SELECT c FROM e) UNION ALL SELECT c, p, 1 FROM e UNION ALL SELECT a.c, b.p, 2 FROM e a JOIN e b ON a.p = b.c),
 near AS (SELECT id, anc, s, idx, name, row_number() OVER (PARTITION BY id, name ORDER BY s) AS rn FROM up JOIN f ON owner = anc), own AS (SELECT owner, max(idx) AS last FROM f GROUP BY owner)
 SELECT id AS entity_id, cast(CASE WHEN s = 0 THEN idx ELSE coalesce(last, 0) + row_number() OVER (PARTITION BY id, s = 0 ORDER BY s, idx) END AS BIGINT) AS component_index, name AS value, anc || '/' || name AS description
 FROM near LEFT JOIN own ON owner = id WHERE rn = 1""")
def field_inheritance(spark, d):
    """Customers inherit the fields of nations and regions, the nearest definition of each; some nations override one."""
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    land = F.concat_ws(".", "r_name", "n_name")

    def rows(df: DataFrame, owner, index: int, name: str) -> DataFrame:
        return df.select(owner.alias("entity_id"), F.lit(index).cast("bigint").alias("component_index"), F.lit(name).alias("value"), F.concat(owner, F.lit("/" + name)).alias("description"))

    field = rows(read(spark, d, "region"), F.col("r_name"), 0, "currency").unionAll(rows(nation, land, 3, "tax")).unionAll(rows(nation.filter("n_nationkey % 3 = 0"), land, 5, "currency"))
    return graph.inherited(field, named_edges(spark, d).withColumn("component_index", F.lit(0).cast("bigint")))


PARENTS = """(SELECT 'p' || p_partkey AS entity_id, cast(p_size % 5 AS BIGINT) AS component_index, p_brand AS parent_eid, p_partkey % 2 = 0 AS pr FROM part
 UNION ALL SELECT 'p' || p_partkey, p_size % 5 + 1, p_type, p_partkey % 3 = 0 FROM part UNION ALL SELECT 'p' || p_partkey, 9, p_brand, false FROM part WHERE p_partkey % 4 = 1)"""
CHOSEN = f"(SELECT entity_id, CASE WHEN count(*) FILTER (pr) = 1 THEN max(CASE WHEN pr THEN parent_eid END) ELSE min_by(parent_eid, component_index) END AS parent_eid FROM {PARENTS} GROUP BY 1)"


def parent_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each part below its brand and its type, some twice below the brand; either, both or none is primary."""
    part, key = read(spark, d, "part"), coded("p", "p_partkey").alias("entity_id")
    row = lambda df, index, parent, primary: df.select(key, index.cast("bigint").alias("component_index"), F.col(parent).alias("parent_eid"), primary.alias("is_primary"))
    place, n = F.col("p_size") % 5, F.col("p_partkey")
    return row(part, place, "p_brand", n % 2 == 0).unionAll(row(part, place + 1, "p_type", n % 3 == 0)).unionAll(row(part.filter("p_partkey % 4 = 1"), F.lit(9), "p_brand", F.lit(False)))


@query(f"SELECT entity_id, parent_eid FROM {CHOSEN}")
def hierarchy_parent_choice(spark, d):
    return graph.hierarchy_parent(parent_rows(spark, d))


@query(f"""SELECT r.entity_id, component_index, r.parent_eid FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, parent_eid ORDER BY component_index) AS nth FROM {PARENTS}) r JOIN {CHOSEN} h ON r.entity_id = h.entity_id
 WHERE r.parent_eid <> h.parent_eid OR nth > 1""")
def non_hierarchy_parents(spark, d):
    rows = parent_rows(spark, d)
    return graph.other_parents(rows, graph.hierarchy_parent(rows)).select("entity_id", "component_index", "parent_eid")


# ---- validation ----------------------------------------------------------------------------------------------------

ALLOWED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def supplier_rows(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    return s.select(text("s_suppkey").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("balance"))


def order_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(text("o_orderkey").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"), F.col("o_orderpriority").alias("priority"))


NULLS = "SELECT cast(s_suppkey AS VARCHAR) AS entity_id, cast(0 AS BIGINT) AS component_index, 'supplier' AS component_type, 'balance' AS field, cast(NULL AS VARCHAR) AS value, 'nullable' AS error_type FROM supplier WHERE s_suppkey % 5 = 0"
RANGES = "SELECT cast(o_orderkey AS VARCHAR) AS entity_id, cast(0 AS BIGINT) AS component_index, 'order' AS component_type, 'priority' AS field, o_orderpriority AS value, 'range' AS error_type FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"
BALANCE, PRIORITY = [FieldRule("balance", "float", nullable=False)], [FieldRule("priority", "str", range=ALLOWED)]


@query(NULLS)
def validate_nullable(spark, d):
    return validate.violations(validate.coerce(supplier_rows(spark, d), BALANCE), "supplier", BALANCE)


@query(RANGES)
def validate_range(spark, d):
    return validate.violations(validate.coerce(order_rows(spark, d), PRIORITY), "order", PRIORITY)


@query(f"{NULLS} UNION ALL {RANGES}")
def invalid_field_union(spark, d):
    return validate_nullable(spark, d).unionByName(validate_range(spark, d))


@query("SELECT cast(p_partkey AS VARCHAR) AS entity_id, CASE WHEN p_size % 4 = 0 THEN 'plain' ELSE p_type END AS kind, coalesce(CASE WHEN p_size % 3 <> 0 THEN cast(p_size AS BIGINT) END, 7) AS size, cast('new' AS VARCHAR) AS state FROM part")
def validate_defaults(spark, d):
    rules = [FieldRule("kind", "str", default="plain"), FieldRule("size", "int", default="7"), FieldRule("state", "str", default="new")]
    rows = read(spark, d, "part").select(text("p_partkey").alias("entity_id"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type")).alias("kind"), F.when(F.col("p_size") % 3 != 0, text("p_size")).alias("size"))
    return validate.coerce(rows, rules)


@query("""SELECT p_partkey AS key, CASE m WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 WHEN 2 THEN -p_size - 1 WHEN 3 THEN p_size * 100 WHEN 6 THEN 1 END AS "int",
 CASE m WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 WHEN 2 THEN -p_size - 0.5 WHEN 3 THEN p_size * 100 WHEN 6 THEN 1 END::DOUBLE AS "float", CASE m WHEN 0 THEN CASE WHEN p_size = 1 THEN true END WHEN 6 THEN true WHEN 7 THEN p_size % 2 = 0 END AS "bool"
 FROM (SELECT *, p_partkey % 9 AS m FROM part)""")
def coerce_try_cast(spark, d):
    """Texts of many forms as whole numbers (halves away from zero), numbers and truth values; null where they are none."""
    size, m = text("p_size"), F.col("p_partkey") % 9
    forms = (size, F.concat(size, F.lit(".5")), F.concat(F.lit("-"), size, F.lit(".5")), F.concat(size, F.lit("e2")), F.lit(""), F.col("p_name"), F.lit("1"), F.when(F.col("p_size") % 2 == 0, "YES").otherwise("f"), F.lit("on"))
    form = F.get(F.array(*forms), m.cast("int"))
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("key"), *[form.alias(c) for c in ("int", "float", "bool")])
    return validate.coerce(rows, [FieldRule(c, c) for c in ("int", "float", "bool")])


@query("SELECT cast(p_partkey AS VARCHAR) AS entity_id, cast(p_size AS DOUBLE) / 8 + 1 AS value FROM part")
def coerce_arithmetic(spark, d):
    rows = read(spark, d, "part").select(text("p_partkey").alias("entity_id"), F.concat(F.lit("("), text("p_size"), F.lit(" / 8) + 1")).alias("value"))
    return validate.coerce(rows, [FieldRule("value", "float")])


# ---- references ----------------------------------------------------------------------------------------------------

REFS = "(SELECT DISTINCT p_name AS ref FROM part UNION SELECT c_name FROM customer UNION SELECT n_name FROM nation UNION SELECT cast(c_custkey AS VARCHAR) FROM customer UNION SELECT 'c' || c_custkey FROM customer UNION SELECT 's' || s_suppkey FROM supplier)"
TARGETS = "(SELECT 'c' || c_custkey AS value, n_name || '.' || c_name AS path, c_name AS alias FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'p' || p_partkey, 'part.' || p_name || p_partkey, p_name FROM part UNION ALL SELECT 'n' || n_nationkey, n_name, n_name FROM nation)"


@query(f"""WITH r AS {REFS}, s AS {TARGETS}, h AS (SELECT ref, value, CASE WHEN ref = value THEN 1 WHEN ref = alias THEN 2 ELSE 3 END AS tier FROM r JOIN s ON ref = value OR ref = alias OR contains(path, ref)),
 b AS (SELECT ref AS r2, min(tier) AS t FROM h GROUP BY 1)
 SELECT ref, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS eid, count(DISTINCT value) AS n_candidates FROM h JOIN b ON r2 = ref AND t = tier GROUP BY ref""")
def resolve_ref_tiers(spark, d):
    customer, nation, part = read(spark, d, "customer"), read(spark, d, "nation"), read(spark, d, "part")
    of = lambda df, c: df.select(F.col(c).cast("string").alias("ref"))
    refs = of(part, "p_name").unionAll(of(customer, "c_name")).unionAll(of(nation, "n_name")).unionAll(of(customer, "c_custkey"))
    refs = refs.unionAll(customer.select(coded("c", "c_custkey").alias("ref"))).unionAll(read(spark, d, "supplier").select(coded("s", "s_suppkey").alias("ref")))
    spine = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), text("c_custkey")).alias("value"), F.concat_ws(".", "n_name", "c_name").alias("path"), F.col("c_name").alias("alias"))
        .unionAll(part.select(F.concat(F.lit("p"), text("p_partkey")), F.concat(F.lit("part."), "p_name", text("p_partkey")), "p_name"))
        .unionAll(nation.select(F.concat(F.lit("n"), text("n_nationkey")), "n_name", "n_name"))
    )
    return resolve.resolve(refs, spine)


@query("SELECT event_id, 'u' || (user_id - user_id % 3) AS entity_id FROM events")
def same_as_rebase(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", F.concat(F.lit("u"), text("user_id")).alias("entity_id"))
    down = F.col("user_id") - 1  # a chain of one or two steps leads to a multiple of three
    u = e.select("user_id").distinct()
    same = u.filter("user_id % 3 <> 0").unionAll(u.filter("user_id % 3 = 2").select(F.col("user_id") - 1)).distinct().select(F.concat(F.lit("u"), text("user_id")).alias("entity_id"), F.concat(F.lit("u"), down.cast("string")).alias("target_entity_id"))
    ids = u.select("user_id").unionAll(u.select(F.col("user_id") - F.col("user_id") % 3)).unionAll(u.filter("user_id % 3 = 2").select(F.col("user_id") - 1)).distinct()
    spine = ids.select(F.concat(F.lit("u"), text("user_id")).alias("value"), F.concat(F.lit("users:u"), text("user_id")).alias("path"), F.concat(F.lit("u"), text("user_id")).alias("alias"))
    return resolve.rebase(e.select("event_id", "entity_id"), resolve.same_as_map(same, spine))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN 's' || s_suppkey ELSE 'n' || s_nationkey END AS entity_id FROM supplier")
def same_as_by_text(spark, d):
    """Suppliers that are said to be their nation, by its alias or by a part of its path; others stay themselves."""
    nation, supplier = read(spark, d, "nation"), read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    owner, whole = coded("s", "s_suppkey").alias("entity_id"), F.concat(F.lit("lands:of."), "n_name", F.lit("!"), coded("x", "n_nationkey"))
    said = F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("of."), "n_name", F.lit("!")))
    same = supplier.filter("s_suppkey % 3 < 2").select(owner, said.alias("value"))
    spine = nation.select(coded("n", "n_nationkey").alias("value"), whole.alias("path"), F.col("n_name").alias("alias"))
    spine = spine.unionByName(supplier.select(coded("s", "s_suppkey").alias("value"), F.concat(F.lit("shops:"), coded("s", "s_suppkey")).alias("path"), coded("s", "s_suppkey").alias("alias")))
    return resolve.rebase(supplier.select("s_suppkey", owner), resolve.same_as_map(same, spine))


@query("SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS text FROM documents")
def strip_text(spark, d):
    padded = F.concat(F.lit(BLANKS), "text", F.lit(BLANKS))
    return read(spark, d, "documents").select("doc_id", strip(padded).alias("text"))


@query("""WITH f AS (SELECT p_brand, bool_or(p_size % 7 = 0) AS derived, bool_or(p_size % 11 = 0) AS skip FROM part GROUP BY p_brand)
 SELECT 'p' || p_partkey AS entity_id, cast(p_size AS BIGINT) AS component_index, p.p_brand AS component_type, cast(NULL AS VARCHAR) AS modifier, derived, skip AS skip_on_export FROM part p JOIN f ON f.p_brand = p.p_brand
 UNION ALL SELECT DISTINCT p_brand, cast(0 AS BIGINT), 'component_type', NULL, false, false FROM part WHERE p_size % 7 = 0 OR p_size % 11 = 0 OR p_size % 13 = 0""")
def component_type_flags(spark, d):
    """Flags of types come from the entities that define them: texts that mean true, false ones don't count."""
    part = read(spark, d, "part")
    row = lambda entity, index, kind, field, value: F.struct(entity.alias("entity_id"), entity.alias("entity_key"), index.cast("bigint").alias("component_index"), kind.alias("component_type"), F.lit(None).cast("string").alias("modifier"), F.lit(field).alias("field"), F.lit(value).alias("value"))
    defines = lambda field, value: row(F.col("p_brand"), F.lit(0), F.lit("component_type"), field, value)
    size = F.col("p_size")
    said = F.array(row(coded("p", "p_partkey"), size, F.col("p_brand"), "value", "1"), F.when(size % 7 == 0, defines("derived", "True")), F.when(size % 11 == 0, defines("skip_on_export", "yes")), F.when(size % 13 == 0, defines("derived", "no")))
    kv = part.select(F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x")).select("x.*")
    return eav.component_types(kv)


@query(f"""{CLOSED}, k AS (SELECT des AS id FROM closed WHERE anc = (SELECT min(r_name) FROM region) UNION SELECT min(r_name) FROM region) SELECT p AS parent_eid, c AS entity_id FROM e WHERE p IN (SELECT id FROM k) AND c IN (SELECT id FROM k)""")
def requirement_tree_edges(spark, d):
    e = durable(named_edges(spark, d), "edges")
    top = read(spark, d, "region").agg(F.min("r_name").alias("anc"))
    inside = graph.closure(e).join(F.broadcast(top), "anc").select(F.col("des").alias("entity_id")).unionAll(top.select("anc"))
    return e.join(inside, "entity_id", "left_semi").join(inside.withColumnRenamed("entity_id", "parent_eid"), "parent_eid", "left_semi").select("parent_eid", "entity_id")


@query("""WITH s AS (SELECT r_name || '.yaml' AS filepath, r_name AS path, 1 AS depth FROM region UNION ALL SELECT r_name || '.yaml', r_name || '.' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name || '.yaml', r_name || '.' || n_name || '.' || c_name, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 SELECT filepath, path, row_number() OVER (PARTITION BY filepath ORDER BY depth, path) AS place FROM s""")
def export_order(spark, d):
    """The order in which the entities of a file are written: parents first, then by path."""
    inside = F.regexp_replace("path", "^world:", "")
    spine = eav.spine(paths(spark, d).select(F.concat(F.substring_index(inside, ".", 1), F.lit(".yaml:"), inside).alias("path")))
    return export.ordered_spine(spine).select("filepath", "path", F.col("place").cast("bigint").alias("place"))


ANY_SQL = """SELECT n_name, r_name, count(*) AS n FROM nation CROSS JOIN region WHERE n_regionkey <> r_regionkey GROUP BY n_name, r_name"""


@query(ANY_SQL)
def sql_escape_hatch(spark, d):
    with Registry(spark, {"nation": read(spark, d, "nation"), "region": read(spark, d, "region")}) as reg:
        return reg.sql(ANY_SQL)


@query("""SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2""")
def version_rate(spark, d):
    """Versions of each entity in tumbling hours."""
    e = read(spark, d, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")

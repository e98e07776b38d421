"""Documents, registry, rules and export as queries: manifests are made from star-schema rows and go the way that files go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eav, export, graph, resolve, validate, views
from ..sources import entity_documents
from ..sources.manifests import csv_spine, csv_tables, flat_documents
from ..sources.tables import durable, read, shared_dir
from .registrar import Registrar
from .registry import Registry, record
from .star import EDGES, SQL, cents, coded, named_edges, places, plain, query, star_registry, text

# ---- documents -----------------------------------------------------------------------------------------------------

PART = "'parts/' || p_partkey || '.yaml:part' || p_partkey"


def part_documents(spark: SparkSession, d: str) -> DataFrame:
    """file_id, kind, text: a YAML document for each part, with all forms that a component may have."""
    lines = [
        F.concat(F.lit("part"), text("p_partkey"), F.lit(":")), F.lit("    data:"),
        F.concat(F.lit("        - part: {name: '"), "p_name", F.lit("', type: '"), "p_type", F.lit("'}")),
        F.concat(F.lit("        - size of: ["), text("p_size"), F.lit(", "), (F.col("p_size") + 1).cast("string"), F.lit("]")),
        F.lit("        - fragile"), F.lit("    label:"),
        F.concat(F.lit("        - note: {front: {by: '"), "p_brand", F.lit("'}, back: {by: }}")), F.lit("    box:"),
    ]
    return read(spark, d, "part").select(F.concat(F.lit("parts/"), text("p_partkey"), F.lit(".yaml")).alias("file_id"), F.lit("yaml").alias("kind"), F.concat_ws("\n", *lines).alias("text"))


def pair_sql(path: str, value: str) -> str:
    return f"SELECT {PART} || {path} AS path, {value} AS value FROM part"


PAIRS = " UNION ALL ".join(pair_sql(p, v) for p, v in (
    ("'.data[0].part.name'", "p_name"), ("'.data[0].part.type'", "p_type"), ("'.data[1].size of'", "cast(p_size AS VARCHAR)"), ("'.data[2].size of'", "cast(p_size + 1 AS VARCHAR)"),
    ("'.data[2].fragile'", "''"), ("'.label[0].note.value'", "'front'"), ("'.label[0].note.by'", "p_brand"), ("'.label[1].note.value'", "'back'"), ("'.label[1].note.by'", "''"),
))


@query(PAIRS)
def document_pairs(spark, d):
    """Nested documents flattened to paths and values: scalars, tags, lists, records, named instances."""
    return flat_documents(part_documents(spark, d)).filter("kind = 'pair'").select("path", "value")


@query(f"SELECT {PART} AS path FROM part UNION ALL SELECT {PART} || '.label' FROM part")
def document_entities(spark, d):
    """Every entity's path, those without components too; a null entity leaves nothing."""
    return flat_documents(part_documents(spark, d)).filter("kind = 'entity'").select("path")


@query(f"""SELECT substring(sha256({PART}), 1, 12) AS entity_id, 'part' || p_partkey AS entity_key, 'parts/' || p_partkey || '.yaml' AS filepath, cast(i AS BIGINT) AS component_index, t AS component_type, m AS modifier, f AS field, v AS value FROM
 (SELECT *, 0 AS i, 'part' AS t, NULL AS m, 'name' AS f, p_name AS v FROM part UNION ALL SELECT *, 0, 'part', NULL, 'type', p_type FROM part UNION ALL SELECT *, 1, 'size', 'of', 'value', cast(p_size AS VARCHAR) FROM part
 UNION ALL SELECT *, 2, 'size', 'of', 'value', cast(p_size + 1 AS VARCHAR) FROM part UNION ALL SELECT *, 2, 'fragile', NULL, 'value', '' FROM part)""")
def document_long_table(spark, d):
    """The long table of entity components, straight from flattened documents."""
    flat = flat_documents(part_documents(spark, d)).filter("kind = 'pair' and owner not like '%.label'")
    return eav.key_value(flat).select("entity_id", "entity_key", "filepath", "component_index", "component_type", "modifier", "field", "value")


def part_registry(spark: SparkSession, d: str) -> Registry:
    flat = durable(flat_documents(part_documents(spark, d)), "flat")
    kv = durable(eav.key_value(flat.filter("kind = 'pair'")), "long")
    tables = {t: eav.pivot(kv, t, fields) for t, fields in eav.fields_by_type(kv).items()}
    return Registry(spark, {"entity_id": eav.spine(flat.filter("kind = 'entity'")), "component_type": eav.component_types(kv), **tables})


@query(f"SELECT substring(sha256({PART}), 1, 12) AS entity_id, cast(i AS BIGINT) AS component_index, 'of' AS modifier, cast(p_size + i - 1 AS VARCHAR) AS value FROM part CROSS JOIN (SELECT unnest([1, 2]) AS i)")
def component_table(spark, d):
    """One type's wide table in a registry assembled from documents."""
    return part_registry(spark, d).get("size")


@query(f"SELECT substring(sha256({PART}), 1, 12) AS entity_id, 'part' || p_partkey AS entity_id_alias, p_name AS part_name, cast(p_size + i AS VARCHAR) AS size_value FROM part CROSS JOIN (SELECT unnest([0, 1]) AS i)")
def view_of_documents(spark, d):
    return plain(part_registry(spark, d).view(["part.name", "size.value"]))


def python_documents(spark: SparkSession, d: str) -> DataFrame:
    """file_id, kind, text: a Python module for each supplier."""
    source = F.concat(
        F.lit('"""Supplier '), "s_name", F.lit('.\n\nComponents\n----------\n- rank: '), text("s_suppkey"), F.lit('\n\nNotes\n-----\nKept.\n"""\n\n__entity__ = {"nation": '), text("s_nationkey"),
        F.lit('}\n\n\nclass Office:\n    """A place."""\n\n    def call(self):\n        """Rings."""\n'),
    )
    return read(spark, d, "supplier").select(F.concat(F.lit("src/s"), text("s_suppkey"), F.lit(".py")).alias("file_id"), F.lit("python").alias("kind"), source.alias("text"))


MODULE = "'src/s' || s_suppkey || '.py:src.s' || s_suppkey"


@query(f"""SELECT {MODULE} || '[0].description' AS path, 'Supplier ' || s_name || '.' || chr(10) || chr(10) || 'Notes' || chr(10) || '-----' || chr(10) || 'Kept.' AS value FROM supplier
 UNION ALL SELECT {MODULE} || '[1].nation', cast(s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT {MODULE} || '[2].rank', cast(s_suppkey AS VARCHAR) FROM supplier
 UNION ALL SELECT {MODULE} || '.Office[0].description', 'A place.' FROM supplier UNION ALL SELECT {MODULE} || '.Office.call[0].description', 'Rings.' FROM supplier""")
def python_pairs(spark, d):
    """Docstrings, their Components sections and metadata dicts of modules, classes and functions."""
    return flat_documents(python_documents(spark, d)).filter("kind = 'pair'").select("path", "value")


@query(f"SELECT {MODULE} AS path FROM supplier UNION ALL SELECT {MODULE} || '.Office' FROM supplier UNION ALL SELECT {MODULE} || '.Office.call' FROM supplier")
def python_entities(spark, d):
    return flat_documents(python_documents(spark, d)).filter("kind = 'entity'").select("path")


@query(f"""{PAIRS.replace("'parts/' || p_partkey || '.yaml", "'parts/' || p_partkey // 100 || '.yaml")} UNION ALL {SQL["python_pairs"]}""")
def documents_from_files(spark, d):
    """YAML and Python documents written to the shared folder by the data source of documents, and read by it again."""
    folder = f"{shared_dir(spark)}/entiloom/documents-{uuid.uuid4().hex}"
    entity_documents.register(spark)
    hundred = F.floor(F.regexp_extract("file_id", "[0-9]+", 0).cast("bigint") / 100)
    parts = part_documents(spark, d).groupBy(F.concat(F.lit("parts/"), hundred.cast("string"), F.lit(".yaml")).alias("file_id")).agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    both = parts.unionByName(python_documents(spark, d).select("file_id", "text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both.repartition(tasks, "file_id").write.format(entity_documents.NAME).mode("append").save(folder)
    files = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(files)
    return spark.read.format(entity_documents.NAME).option("base", folder).load(folder).filter("kind = 'pair'").select("path", "value")


@query("SELECT c_name AS name, cast(c_nationkey AS VARCHAR) AS place, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, 'n' || s_nationkey, NULL FROM supplier")
def type_union_align(spark, d):
    """Tables of one type from two sources: columns by name, differing types as text, no row lost."""
    a = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("segment"))
    return views.stacked(a, read(spark, d, "supplier").select(F.col("s_name").alias("name"), coded("n", "s_nationkey").alias("place")))


@query("SELECT p_partkey AS partkey, p_name || ', \"new\"' AS name, p_retailprice AS price, p_size > 25 AS large, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand FROM part")
def csv_component(spark, d):
    """Rows of several CSV files of one stem, with quotes and commas inside; columns are typed by what all values are."""
    part = read(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("partkey"), F.concat("p_name", F.lit(', "new"')).alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).alias("large"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"))
    folder = f"{shared_dir(spark)}/entiloom/csv-{uuid.uuid4().hex}"
    rows.repartition(3).write.csv(folder, header=True, escape='"')
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path(folder))
    for i, f in enumerate(x.getPath() for x in files.listStatus(path(folder)) if x.getPath().getName().endswith(".csv")):
        files.mkdirs(path(f"{folder}/{i}"))
        files.rename(f, path(f"{folder}/{i}/parts.csv"))
    return csv_tables(spark, folder)["parts_comp"].drop("entity_id", "component_index", "modifier")


# ---- whole manifests -----------------------------------------------------------------------------------------------

TYPES = """shop:
    - component_type
    - field:
        size: {type: float, nullable: false}
        kind: {type: str, range: [a, b], default: a}
        seen: {type: int, default: 7}
"""
SHOP = "substring(sha256('m/' || s_suppkey || '.yaml:s' || s_suppkey), 1, 12)"


def shops(spark: SparkSession, d: str) -> Registry:
    """Documents of suppliers, and a type that they use, through the whole of loading: flattened, checked, derived, merged."""
    kind = F.get(F.array(*map(F.lit, ("a", "b", "c", "''"))), (F.col("s_suppkey") % 4).cast("int"))
    size = F.when(F.col("s_suppkey") % 5 == 0, "'none'").otherwise(F.concat(text("s_nationkey"), F.lit(" / 4")))
    shop = F.concat(F.lit("        - shop: {size: "), size, F.lit(", kind: "), kind, F.lit("}"))
    below = map(F.lit, ("    till:", "        data:", "            - requirement: 0.5", "        drawer:", "            - requirement: 0.25"))
    lines = [F.concat(coded("s", "s_suppkey"), F.lit(":")), F.lit("    data:"), shop, *below]
    docs = read(spark, d, "supplier").select(F.concat(F.lit("m/"), text("s_suppkey"), F.lit(".yaml")).alias("file_id"), F.lit("yaml").alias("kind"), F.concat_ws("\n", *lines).alias("text"))
    user = Registrar(spark)
    user.update(yaml={"types.yaml": TYPES}, raw=docs)
    return user.registry


@query(f"SELECT {SHOP} AS entity_id, cast(0 AS BIGINT) AS component_index, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey / 4.0 END::DOUBLE AS size, CASE s_suppkey % 4 WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'a' END AS kind, cast(7 AS BIGINT) AS seen FROM supplier")
def manifest_components(spark, d):
    """A type's table after loading: sums worked out, texts coerced, defaults filled, rows that break rules kept."""
    return shops(spark, d).get("shop").select("entity_id", "component_index", "size", "kind", "seen")


@query(f"SELECT {SHOP} AS entity_id, 'kind' AS field, 'c' AS value, 'range' AS error_type FROM supplier WHERE s_suppkey % 4 = 2 UNION ALL SELECT {SHOP}, 'size', NULL, 'nullable' FROM supplier WHERE s_suppkey % 5 = 0")
def manifest_violations(spark, d):
    return shops(spark, d).get("invalid_field").filter("component_type = 'shop'").select("entity_id", "field", "value", "error_type")


@query("""SELECT substring(sha256('m/' || s_suppkey || '.yaml:s' || s_suppkey || path), 1, 12) AS entity_id, cast(depth AS BIGINT) AS depth, p AS priority_product FROM supplier, (VALUES ('', 0, 1.0::DOUBLE), ('.till', 1, 0.5), ('.till.drawer', 2, 0.125)) AS v(path, depth, p)""")
def manifest_derived(spark, d):
    """Derived tables of loaded documents: depth below the root, and the product of priorities from it."""
    reg = shops(spark, d)
    mine = reg.get("entity_id").filter("filepath like 'm/%'").select(F.col("value").alias("entity_id"))
    both = reg.get("entity_depth").join(reg.get("priority_product"), "entity_id")
    return both.join(mine, "entity_id", "left_semi").select("entity_id", F.col("depth").cast("bigint").alias("depth"), "priority_product")


@query("SELECT cast(c_custkey AS VARCHAR) AS entity_id, cast(round(c_acctbal * 100) AS BIGINT) AS cents, c_mktsegment AS segment FROM customer")
def registry_round_trip(spark, d):
    """A registry saved as a folder of tables and loaded again."""
    folder = f"{shared_dir(spark)}/entiloom/registry-{uuid.uuid4().hex}"
    star_registry(spark, d).save(folder)
    return Registry.load(spark, folder).get("account")


@query(SQL["view_inner_join"])
def saved_view(spark, d):
    """A view of types that were saved in buckets of entities: its joins move no rows."""
    folder = f"{shared_dir(spark)}/entiloom/store-{uuid.uuid4().hex}"
    star_registry(spark, d).save(folder, buckets=16)
    return plain(Registry.load(spark, folder).view(["account", "home", "order"]))


@query("""SELECT substring(sha256('m/' || s_suppkey || '.yaml:s' || s_suppkey || path), 1, 12) AS entity_id, cast(depth AS BIGINT) AS depth, p * CASE WHEN s_suppkey % 100 = 1 AND depth > 0 THEN 0.5 ELSE 1 END AS priority_product,
 CASE depth WHEN 0 THEN s_nationkey + 2 + CASE s_suppkey % 100 WHEN 1 THEN 20 ELSE 0 END WHEN 1 THEN 2 + CASE s_suppkey % 100 WHEN 1 THEN 20 ELSE 0 END END::DOUBLE AS effort FROM supplier, (VALUES ('', 0, 0.5::DOUBLE), ('.till', 1, 0.5), ('.till.drawer', 2, 0.125)) AS v(path, depth, p)""")
def registry_update(spark, d):
    """Most documents loaded into a folder of snapshots; then the rest, and more about known entities: only buckets that
    change are written, and only what lies above or below a change is derived again."""
    key = text("s_suppkey")
    shop = F.concat(F.lit("s"), key, F.lit(":\n    data:\n        - requirement: 0.5\n        - effort: "), text("s_nationkey"), F.lit("\n    till:\n        data:\n            - effort: 2\n        drawer:\n            - requirement: 0.25\n"))
    more = F.concat(F.lit("u"), key, F.lit(":\n    - same_as: s"), key, F.lit(".till\n    - effort: {value: 5, schedule: weekly}\n    - requirement: 0.5\n"))
    s, named = read(spark, d, "supplier"), lambda text_, folder: (F.concat(F.lit(folder), key, F.lit(".yaml")).alias("file_id"), F.lit("yaml").alias("kind"), text_.alias("text"))
    user = Registrar.open(spark, f"{shared_dir(spark)}/entiloom/kept-{uuid.uuid4().hex}", buckets=16)
    user.update(raw=s.filter("s_suppkey % 100 != 0").select(*named(shop, "m/")))
    user.update(raw=s.filter("s_suppkey % 100 = 0").select(*named(shop, "m/")).unionAll(s.filter("s_suppkey % 100 = 1").select(*named(more, "u/"))))
    mine = user.get("entity_id").filter("filepath like 'm/%'").select(F.col("value").alias("entity_id"))
    effort = user.get("effort_total").withColumnRenamed("value", "effort")
    both = mine.join(user.get("entity_depth"), "entity_id").join(user.get("priority_product"), "entity_id").join(effort, "entity_id", "left")
    return both.select("entity_id", F.col("depth").cast("bigint").alias("depth"), "priority_product", "effort")


@query("SELECT 'rows' AS entity_key, row_number() OVER (ORDER BY p_partkey) - 1 AS component_index, p_partkey AS partkey, p_name || chr(10) || '\"' || p_brand || '\", ' || p_type AS note FROM part")
def csv_rows_in_order(spark, d):
    """Rows of one CSV file with quotes, commas and line ends inside, by their place in the file; its entity comes from the
    spine of files."""
    part = read(spark, d, "part")
    note = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", '), "p_type")
    folder = f"{shared_dir(spark)}/entiloom/csv-{uuid.uuid4().hex}"
    part.select(F.col("p_partkey").alias("partkey"), note.alias("note")).orderBy("partkey").coalesce(1).write.csv(folder, header=True, escape='"')
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path(folder))
    for f in (x.getPath() for x in files.listStatus(path(folder)) if x.getPath().getName().endswith(".csv")):
        files.rename(f, path(f"{folder}/rows.csv"))
    spine = csv_spine(spark, folder).select(F.col("value").alias("entity_id"), "entity_key")
    return csv_tables(spark, folder)["rows_comp"].join(F.broadcast(spine), "entity_id").select("entity_key", "component_index", "partkey", "note")


# ---- registry ------------------------------------------------------------------------------------------------------


def event_registry(spark: SparkSession, d: str) -> Registry:
    """Versions of users' events, with `ts` declared as the type's time field."""
    e = read(spark, d, "events").select(text("user_id").alias("entity_id"), F.col("event_id").alias("component_index"), "event_type", "ts")
    ids = e.select(F.col("entity_id").alias("value"), F.col("entity_id").alias("path"), F.col("entity_id").alias("alias"), F.col("entity_id").alias("entity_key")).distinct()
    kind = spark.createDataFrame([("event", "event", "event", "event")], "value string, path string, alias string, entity_key string")
    field = spark.createDataFrame([("event", 0, "ts", "true")], "entity_id string, component_index bigint, value string, time_dimension string")
    return Registry(spark, {"entity_id": ids.unionByName(kind), "event": e, "field": field})


@query("SELECT cast(user_id AS VARCHAR) AS entity_id, cast(user_id AS VARCHAR) AS entity_id_alias, event_type AS event_event_type, ts AS event_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1")
def view_current_types(spark, d):
    """A view of current versions: the field table says which column orders them."""
    return plain(event_registry(spark, d).view_current("event"))


@query("SELECT DISTINCT 'orders_' || o_orderstatus AS component_type FROM orders")
def dataflow_new_types(spark, d):
    """Types that a user's dataflow adds to a registry."""
    orders = read(spark, d, "orders")

    def by_status(reg: Registry) -> dict[str, DataFrame]:
        states = [r.o_orderstatus for r in orders.select("o_orderstatus").distinct().collect()]  # a handful of codes
        return {f"orders_{s}": orders.filter(F.col("o_orderstatus") == s).select(text("o_orderkey").alias("entity_id")) for s in states}

    user = Registrar(spark, star_registry(spark, d))
    before = set(user.registry.component_types)
    user.load_dataflow(by_status).execute("by_status")
    return spark.createDataFrame([(t,) for t in user.registry.component_types if t not in before], "component_type string")


@query("""WITH c AS (SELECT * FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)) SELECT 'entity_id' AS component_type, count(*) AS n FROM c UNION ALL SELECT 'account', count(*) FROM c
 UNION ALL SELECT 'home', count(*) FROM c JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'order', count(*) FROM c JOIN orders ON o_custkey = c_custkey HAVING count(*) > 0
 UNION ALL SELECT 'line', count(*) FROM c JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey HAVING count(*) > 0""")
def entity_in_all_types(spark, d):
    """One entity, named by its alias, in all types that have rows of it."""
    reg = star_registry(spark, d)
    found = reg.get_entity_id(read(spark, d, "customer").agg(F.min("c_name").alias("n")).first().n)
    out = None
    for name, rows in reg.view_entity(found).items():
        n = rows.agg(F.lit(name).alias("component_type"), F.count("*").alias("n"))
        out = n if out is None else out.unionAll(n)
    return out


@query("SELECT o_orderkey AS number, CASE WHEN o_orderkey % 7 = 0 THEN 'nobody' ELSE c_name END AS buyer, CASE WHEN o_orderkey % 7 <> 0 THEN 'c' || c_custkey END AS buyer_eid FROM orders JOIN customer ON o_custkey = c_custkey")
def reference_columns(spark, d):
    """Reference fields with the ids that they resolve to; unknown references stay, with a null id."""
    customer = read(spark, d, "customer")
    buyer = F.when(F.col("o_orderkey") % 7 == 0, "nobody").otherwise(F.col("c_name")).alias("buyer")
    orders = read(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("number"), buyer)
    spine = customer.select(coded("c", "c_custkey").alias("value"), F.concat(F.lit("customers:"), "c_name").alias("path"), F.col("c_name").alias("alias"))
    found = resolve.resolve(resolve.references({"order": orders}, {"order": ["buyer"]}), spine)
    return resolve.with_resolved(orders, ["buyer"], found)


@query("SELECT c_custkey AS key, c_name AS name, '{\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\"}' AS record FROM customer")
def json_records(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return rows.withColumn("record", record(rows))


# ---- rules ---------------------------------------------------------------------------------------------------------

RULES = """SELECT p_brand AS component_type, p_type AS name, CASE WHEN min(p_size) % 2 = 0 THEN 'int' ELSE 'str' END AS type, min(p_size) % 3 <> 0 AS nullable,
 CASE WHEN min(p_size) % 5 = 0 THEN 'a,b' END AS range FROM part GROUP BY p_brand, p_type"""


@query(RULES)
def compiled_rules(spark, d):
    """Schemas that are kept as rows, compiled: the first definition of a name counts, ranges are parsed from text."""
    size = F.col("p_size")
    field = read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_size").alias("p_size")).select(
        F.col("p_brand").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"), F.col("p_type").alias("value"), F.when(size % 2 == 0, "int").otherwise("str").alias("type"),
        F.when(size % 3 == 0, "False").otherwise("").alias("nullable"), F.lit("").alias("default"), F.when(size % 5 == 0, "['a', 'b']").otherwise("").alias("range"),
    )
    later = field.withColumn("component_index", F.lit(1).cast("bigint")).withColumn("type", F.lit("bool"))  # loses to the first
    spine = field.select(F.col("entity_id").alias("value"), F.concat(F.lit("types:"), "entity_id").alias("path"), F.col("entity_id").alias("entity_key")).distinct()
    rules = validate.compile_rules(field.unionByName(later), spine)
    rows = [(t, r.name, r.type, r.nullable, ",".join(r.range) if r.range else None) for t, rs in rules.items() for r in rs]
    return spark.createDataFrame(rows, "component_type string, name string, type string, nullable boolean, range string")


@query("SELECT count(*) AS n_in, count(*) AS n_out, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS n_broken, count(*) FILTER (o_orderkey % 2 = 1) AS n_null FROM orders")
def rows_preserved(spark, d):
    """Coercion and validation keep every row, those with values that break their rules too."""
    rows = read(spark, d, "orders").select(text("o_orderkey").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 2 == 1, "odd").otherwise(text("o_orderkey")).alias("even"))
    rules = [validate.FieldRule("priority", "str", range=["1-URGENT", "2-HIGH", "3-MEDIUM"]), validate.FieldRule("even", "int")]
    done = validate.coerce(rows, rules)
    broken = validate.violations(done, "order", rules).agg(F.count("*").alias("n_broken"))
    return rows.agg(F.count("*").alias("n_in")).crossJoin(done.agg(F.count("*").alias("n_out"), F.count(F.when(F.col("even").isNull(), 1)).alias("n_null"))).crossJoin(broken)


# ---- export --------------------------------------------------------------------------------------------------------

WHERE = "CASE s_suppkey % 4 WHEN 0 THEN 'builtins.types' WHEN 1 THEN 'src/s' || s_suppkey || '.py' WHEN 2 THEN 'm/s' || s_suppkey || '.yaml' END"


def supplier_spine(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    place = F.when(k % 4 == 0, "builtins.types").when(k % 4 == 1, F.concat(F.lit("src/s"), text("s_suppkey"), F.lit(".py"))).when(k % 4 == 2, F.concat(F.lit("m/s"), text("s_suppkey"), F.lit(".yaml")))
    return read(spark, d, "supplier").select(coded("s", "s_suppkey").alias("value"), F.concat_ws(":", place, coded("s", "s_suppkey")).alias("path"), coded("s", "s_suppkey").alias("entity_key"), place.alias("filepath"))


@query(f"SELECT 's' || s_suppkey AS value, {WHERE} AS filepath FROM supplier WHERE s_suppkey % 4 = 2")
def exportable_entities(spark, d):
    """Entities whose source can be written again: no built-ins, no Python, none without a file."""
    return supplier_spine(spark, d).filter(export.exportable(F.col("filepath"))).select("value", "filepath")


@query("SELECT 's' || s_suppkey AS entity_id, cast(0 AS BIGINT) AS component_index, 'shop of' AS name, 'nation=' || s_nationkey || ';title=' || s_name AS fields FROM supplier WHERE s_suppkey % 4 = 2 UNION ALL SELECT 's' || s_suppkey, 1, 'open', '' FROM supplier WHERE s_suppkey % 4 = 2")
def export_entries(spark, d):
    """Components unpivoted and condensed to named entries; nulls and ids of references are left out, tags have no fields."""
    s = read(spark, d, "supplier")
    shop = s.select(coded("s", "s_suppkey").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"), F.lit("of").alias("modifier"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("string").alias("none"), F.col("s_name").alias("title"), F.lit("x").alias("nation_eid"))
    tag = s.select(coded("s", "s_suppkey").alias("entity_id"), F.lit(1).cast("bigint").alias("component_index"), F.lit(None).cast("string").alias("modifier"), F.lit("").alias("value"))
    out = export.entries({"shop": shop, "open": tag}, supplier_spine(spark, d))
    return out.withColumn("fields", F.array_join(F.transform("fields", lambda x: F.concat(x["field"], F.lit("="), x["value"])), ";"))


@query("""SELECT 'm/s' || s_suppkey || '.yaml:s' || s_suppkey || '[0].shop.nation' AS path, cast(s_nationkey AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 4 = 2 UNION ALL
 SELECT 'm/s' || s_suppkey || '.yaml:s' || s_suppkey || '[0].shop.title', s_name FROM supplier WHERE s_suppkey % 4 = 2""")
def exported_documents(spark, d):
    """Documents written for each file, and read again."""
    shop = read(spark, d, "supplier").select(coded("s", "s_suppkey").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"), F.lit(None).cast("string").alias("modifier"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("title"))
    docs = export.documents(export.lines({"shop": shop}, supplier_spine(spark, d)))
    raw = docs.select(F.col("filepath").alias("file_id"), F.lit("yaml").alias("kind"), "text")
    return flat_documents(raw).filter("kind = 'pair'").select("path", "value")


@query("""WITH k AS (SELECT r_name, n_name, c_name, r_name || '/f:' || r_name || '.' || n_name AS p, cast(round(c_acctbal * 100) AS BIGINT) AS v, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey)
 SELECT p || '.' || c_name || '[0].cents' AS path, cast(v AS VARCHAR) AS value FROM k WHERE c_name IS NOT NULL UNION ALL SELECT p || '.' || c_name || '[1].kept', '' FROM k WHERE v % 2 = 0
 UNION ALL SELECT DISTINCT p || CASE WHEN c_name IS NULL THEN '' ELSE '.data' END || '[0].rank of.value', cast(n_nationkey AS VARCHAR) FROM k UNION ALL SELECT DISTINCT p || CASE WHEN c_name IS NULL THEN '' ELSE '.data' END || '[0].rank of.unit', 'place' FROM k""")
def exported_nested(spark, d):
    """Documents whose entities lie in one another, written and read again: regions are there for their nations only, nations
    have components and customers, and customers values and tags."""
    land = F.concat_ws(".", "r_name", "n_name")
    nation = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    file = F.concat("r_name", F.lit("/f"))
    node = lambda df, path: df.select(path.alias("value"), F.concat(file, F.lit(":"), path).alias("path"), path.alias("entity_key"), file.alias("filepath"))
    whose = F.concat(land, F.lit("."), "c_name")
    customer = places(spark, d)
    spine = node(nation, land).unionAll(node(customer, whose))
    index = lambda i: F.lit(i).cast("bigint").alias("component_index")
    tables = {
        "rank": nation.select(land.alias("entity_id"), index(0), F.lit("of").alias("modifier"), text("n_nationkey").alias("value"), F.lit("place").alias("unit")),
        "cents": customer.select(whose.alias("entity_id"), index(0), F.lit(None).cast("string").alias("modifier"), cents("c_acctbal").alias("value")),
        "kept": customer.filter(cents("c_acctbal") % 2 == 0).select(whose.alias("entity_id"), index(1), F.lit(None).cast("string").alias("modifier"), F.lit("").alias("value")),
    }
    docs = export.documents(export.lines(tables, spine))
    return flat_documents(docs.select(F.col("filepath").alias("file_id"), F.lit("yaml").alias("kind"), "text")).filter("kind = 'pair'").select("path", "value")


@query("""SELECT cast(user_id AS VARCHAR) AS entity_id, event_id AS component_index, f AS field, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events),
 LATERAL (SELECT 'event_type' AS f, event_type AS v UNION ALL SELECT 'worth', cast(user_id % 10 AS VARCHAR)) WHERE rn = 1""")
def export_collapsed(spark, d):
    """What an export that collapses versions writes: the fields of the current ones."""
    e = read(spark, d, "events").select(text("user_id").alias("entity_id"), F.col("event_id").alias("component_index"), "event_type", (F.col("user_id") % 10).alias("worth"), "ts")
    return eav.unpivot(views.current(e, "ts").drop("ts")).drop("modifier")


@query("SELECT DISTINCT p_brand AS component_type FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 37 = 1 AND p_partkey < 200 UNION SELECT p_brand FROM part WHERE p_partkey % 41 = 2 AND p_partkey < 400)")
def export_kept_types(spark, d):
    """Types without those flagged as derived or not to be written."""
    part, key = read(spark, d, "part"), F.col("p_partkey")
    flags = part.select(F.col("p_brand").alias("component_type"), ((key % 37 == 1) & (key < 200)).alias("derived"), ((key % 41 == 2) & (key < 400)).alias("skip_on_export"))
    names = [r.p_brand for r in part.select("p_brand").distinct().collect()]  # names of types
    return spark.createDataFrame([(n,) for n in export.kept_types(flags, names)], "component_type string")


@query("SELECT 's' || s_suppkey AS entity_id, cast(4 AS BIGINT) AS component_index, 'n' || s_nationkey AS parent_eid, 'nation' || s_nationkey AS value FROM supplier WHERE s_suppkey % 4 = 2")
def export_other_parents(spark, d):
    """Parents that the nesting of exported documents doesn't show, under their keys."""
    s = read(spark, d, "supplier")
    row = lambda i, parent: s.select(coded("s", "s_suppkey").alias("entity_id"), F.lit(i).cast("bigint").alias("component_index"), F.lit(None).cast("string").alias("modifier"), parent.alias("parent_eid"), F.lit(False).alias("is_primary"))
    edges = row(-1, F.lit("top")).unionAll(row(4, coded("n", "s_nationkey")))
    nations = read(spark, d, "nation").select(coded("n", "n_nationkey").alias("value"), coded("n", "n_nationkey").alias("path"), coded("nation", "n_nationkey").alias("entity_key"), F.lit("n.yaml").alias("filepath"))
    return export.parents_left(edges, supplier_spine(spark, d).unionByName(nations)).select("entity_id", "component_index", "parent_eid", "value")


@query(f"""WITH RECURSIVE e AS {EDGES}, pr AS (SELECT p AS id, 0.25 AS v FROM e UNION SELECT c, CASE WHEN length(c) % 2 = 0 THEN 0.5 ELSE 0.75 END FROM e), top AS (SELECT id, max(v) AS p FROM pr GROUP BY id)
 SELECT c AS entity_id, cast(top.p AS DOUBLE) * cast(up.p AS DOUBLE) AS product FROM e JOIN top ON top.id = c JOIN top up ON up.id = e.p""")
def highest_priority(spark, d):
    """Of several priorities of an entity the highest counts."""
    e = durable(named_edges(spark, d), "edges")
    half = F.when(F.length("entity_id") % 2 == 0, 0.5).otherwise(0.75)
    several = e.select(F.col("parent_eid").alias("entity_id"), F.lit(0.25).alias("p")).unionAll(e.select("entity_id", half.alias("p")))
    steps = e.select(F.col("parent_eid").alias("anc"), F.col("entity_id").alias("des"))
    return graph.ancestor_product(steps, e.select("entity_id").distinct(), several).withColumnRenamed("priority_product", "product")

"""Parquet tables: reading, writing steps that must outlive an executor, saving and loading whole registries."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, which the optimizer knows: unions leave it out, where a plain empty table brings tasks of its own."""
    return spark.createDataFrame([], schema).filter("false")


def collected(df: DataFrame, *order: str) -> list[Row]:
    """The rows of a table that is as large as a schema, sorted as Spark sorts (nulls first). What is collected anyway
    needs no sampling and no shuffle for its order."""
    return sorted(df.collect(), key=lambda r: [(r[c] is not None, 0 if r[c] is None else r[c]) for c in order])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode, a temporary folder."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="entiloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def durable(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again; its lineage ends there. Gone with the session. by: a
    column of few values that filters will ask for; the files are parted by it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/entiloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    out.durable_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete durable tables that nothing will read again."""
    for t in tables:
        jpath = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.durable_path)
        jpath.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def durable_all(tables: dict[str, DataFrame], at_once: int = 8) -> dict[str, DataFrame]:
    """Several small tables made durable, some at a time: each is a job of few tasks that leaves most cores idle."""
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(tables, pool.map(durable, tables.values(), tables), strict=True))


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


@contextmanager
def jdbc_link(spark: SparkSession, url: str, driver: str | None = None):
    """What a database says of itself, while the driver program is connected to it."""
    if driver:
        spark._jvm.org.apache.spark.util.Utils.classForName(driver, True, True)
    link = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        yield link.getMetaData()
    finally:
        link.close()


def jdbc_tables(spark: SparkSession, url: str, driver: str | None = None, schema: str | None = None) -> list[str]:
    """Names of all tables of a database (of one schema; without it, of all that are not the system's own)."""
    kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
    kinds[0] = "TABLE"
    out = []
    with jdbc_link(spark, url, driver) as told:
        found = told.getTables(None, schema, "%", kinds)
        while found.next():
            out.append((found.getString("TABLE_SCHEM"), found.getString("TABLE_NAME")))
    return sorted(n for s, n in out if schema is not None or not s or not s.upper().startswith(("SYS", "INFORMATION_SCHEMA", "PG_")))


def quoted(spark: SparkSession, url: str, names: list[str], driver: str | None) -> dict[str, str]:
    """Names as the database quotes them, so that their case and their blanks stay."""
    with jdbc_link(spark, url, driver) as told:
        mark = told.getIdentifierQuoteString().strip()
    return {n: f"{mark}{n.replace(mark, mark * 2) if mark else n}{mark}" for n in names}


def load_jdbc(spark: SparkSession, url: str, names: list[str] | None = None, schema: str | None = None, **options: str) -> dict[str, DataFrame]:
    """Tables of a database by name, all of them without names; with partitionColumn and bounds among the options Spark
    reads in parts."""
    driver = options.get("driver")
    names = jdbc_tables(spark, url, driver, schema) if names is None else names
    return {n: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for n, t in quoted(spark, url, names, driver).items()}


def save_jdbc(tables: dict[str, DataFrame], url: str, **options: str) -> None:
    """Every table into a database, overwriting; the driver's jar must be on the class path."""
    for name, df in tables.items():
        (table,) = quoted(df.sparkSession, url, [name], options.get("driver")).values()
        df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("overwrite").save()

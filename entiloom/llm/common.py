"""Helpers shared by the training-data operators: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python task holds at once as numpy arrays.
CHARS_AT_ONCE = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="entiloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def durable(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later jobs neither repeat its work nor depend on
    an executor that may be lost. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/entiloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete durable tables that nothing will read again; whatever was made from them must be durable itself."""
    for t in tables:
        jpath = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.durable_path)
        jpath.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows in an Arrow batch of actions inside, for rows that are large by design."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(col: str | Column = "doc_id") -> Column:
    """crc32 of an id written as text, which deals rows into learning and held-out folds; a null id counts as ''."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name after underscores where df has such a column (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_key(text: str | Column) -> Column:
    """128 bits that stand for a text; a null text counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def row_key(key: str | Column, text: str | Column) -> Column:
    """128 bits that stand for a row's key and text; null is a value of its own for either."""
    key, text = (F.col(c) if isinstance(c, str) else c for c in (key, text))
    told = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(told(key), F.lit("\0"), told(text)).cast("binary")))


def text_pieces(batches: Iterator[pa.RecordBatch], text_col: str, chars: int = CHARS_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with about `chars` characters each, and their texts (null: empty)."""
    for batch in batches:
        texts = [x or "" for x in batch.column(text_col).to_pylist()]
        at = size = 0
        for i, x in enumerate(texts):
            size += len(x)
            if size >= chars:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + list(new.values()), names=[*keep, *new])

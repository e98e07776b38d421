"""Reading manifests: YAML, Python and CSV files, and texts in memory, as DataFrames."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from itertools import islice
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import entity_id, q
from ..functions.documents import flat_rows
from ..operators.views import stacked
from .csv_records import records
from .tables import empty

RAW = "file_id string, kind string, text string"
FLAT = "file_id string, kind string, path string, owner string, spine_path string, index bigint, type string, modifier string, field string, value string, seq bigint"
BUILTIN = Path(__file__).with_name("builtins.yaml")


def as_paths(paths: str | Iterable[str] | None) -> list[str]:
    return [] if not paths else [paths] if isinstance(paths, str) else [str(p) for p in paths]


def file_id(path: Column) -> Column:
    """The path below the working directory, or the whole path elsewhere."""
    here = str(Path.cwd()).rstrip("/") + "/"
    plain = F.regexp_replace(path, r"^file:/+", "/")
    return F.when(plain.startswith(here), F.substring(plain, len(here) + 1, 1 << 20)).otherwise(plain)


def apart(paths: list[str]) -> list[str]:
    """Paths without those named twice or lying below another."""
    plain = list(dict.fromkeys(p.rstrip("/") or "/" for p in paths))
    return [p for p in plain if not any(p != q and p.startswith(q.rstrip("/") + "/") for q in plain)]


def paths_with(spark: SparkSession, paths: list[str], endings: tuple[str, ...]) -> list[str]:
    """The folders among the paths, and the files with one of the endings; a path that isn't there raises."""
    out = []
    for path in apart(paths):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if path.endswith(endings) or jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory():
            out.append(path)
    return out


def found_below(endings: tuple[str, ...]) -> dict[str, str]:
    return {"recursiveFileLookup": "true", "pathGlobFilter": "*{" + ",".join(endings) + "}"}


def read_files(spark: SparkSession, paths: list[str], endings: tuple[str, ...], kind: str) -> DataFrame:
    """file_id, kind, text of the files named, and of all files below the folders named, with one of the endings: one
    scan, no shuffle."""
    where = paths_with(spark, paths, endings)
    if not where:
        return spark.createDataFrame([], RAW)
    texts = spark.read.options(**found_below(endings)).text(where, wholetext=True)
    return texts.select(file_id(F.col("_metadata.file_path")).alias("file_id"), F.lit(kind).alias("kind"), F.col("value").alias("text"))


def raw_documents(spark: SparkSession, paths: str | Iterable[str] | None = None, yaml: dict[str, str] | None = None, python: dict[str, str] | None = None, builtins: bool = True) -> DataFrame:
    """file_id, kind, text. Files win over texts in memory with the same id, Python over YAML; built-ins come along."""
    paths = as_paths(paths)
    files = read_files(spark, paths, (".yaml", ".yml"), "yaml").unionByName(read_files(spark, paths, (".py",), "python"))
    given = {k: (k, "yaml", v) for k, v in (yaml or {}).items()} | {k: (k, "python", v) for k, v in (python or {}).items()}
    if builtins:
        given[f"builtins.{COMPONENTS}"] = (f"builtins.{COMPONENTS}", "yaml", BUILTIN.read_text(encoding="utf-8"))
    rows = spark.createDataFrame(list(given.values()), RAW)
    return files.unionByName(rows.join(files.select("file_id"), "file_id", "left_anti")) if paths else rows


COMPONENTS = "components"


#: Rows that a task hands on at once, however many a document has.
ROWS_AT_ONCE = 10_000


def parsing_tasks(spark: SparkSession) -> int:
    """As many tasks as a shuffle has partitions; where that is more than four for each core, fewer, as long as a task gets
    no more than eight partitions' documents. A task sets its Python worker up for longer than it parses some hundred."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(4 * spark.sparkContext.defaultParallelism, -(-most // 8)))


def flat_documents(raw: DataFrame) -> DataFrame:
    """file_id, kind (entity or pair), path, value, seq: every document flattened on the executors, seq in its order.

    Documents are dealt out first: a table of many small texts lies in few files, but its parsing is long."""

    fields = pa.schema([(name, pa.int64() if kind == "bigint" else pa.string()) for name, kind in (x.split() for x in FLAT.split(","))])

    def run(batches):
        for batch in batches:
            texts = zip(*[batch.column(c).to_pylist() for c in ("file_id", "kind", "text")], strict=True)
            rows = ((doc, *row, i) for doc, kind, text in texts for i, row in enumerate(flat_rows(doc, kind, text or "")))
            while some := list(islice(rows, ROWS_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), fields, strict=True)], schema=fields)

    return raw.repartition(parsing_tasks(raw.sparkSession), "file_id").mapInArrow(run, FLAT)


def csv_headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, tuple[str, ...]], list[str]]:
    """(stem, columns) -> its files. One scan brings the first line of each file; a row for each file is collected."""
    lines = spark.read.options(**found_below((".csv",))).text(paths)
    placed = lines.filter("value != ''").select("value", F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("place"))
    first = placed.groupBy("file").agg(F.min_by("value", "place").alias("line"))
    out: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for r in first.orderBy("file").collect():
        columns = tuple(c.strip() for c in next(csv.reader([r.line.rstrip("\r").removeprefix("\ufeff")])))
        out.setdefault((Path(unquote(r.file)).stem, columns), []).append(unquote(r.file))
    return out


def csv_tables(spark: SparkSession, paths: str | Iterable[str] | None) -> dict[str, DataFrame]:
    """`<stem>_comp` -> rows of the CSV files with that stem: entity_id (of the file), component_index (the row's place),
    modifier (null), and the columns, typed as long, double or boolean where all their values are; dates stay text.
    Files of one stem and header are read together; those of another header add their columns."""
    where = paths_with(spark, as_paths(paths), (".csv",))
    out: dict[str, DataFrame] = {}
    for (stem, columns), files in (csv_headers(spark, where) if where else {}).items():
        rows, key = read_csv(spark, files, columns), f"{stem}_comp"
        out[key] = stacked(out[key], rows) if key in out else rows
    return out


def read_csv(spark: SparkSession, files: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Quoted fields may hold commas, quotes and line ends. Blocks of a file are read by tasks of their own, and rows have
    the numbers that they have in their file (csv_records)."""
    schema = ", ".join(f"{q(c)} string" for c in columns)
    rows = records(spark, files).filter("record > 0")  # the first one names the columns
    found = rows.select(file_id(F.col("file")).alias("_file"), (F.col("record") - 1).alias("_at"), F.from_csv("text", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("_row")).select("_file", "_at", "_row.*")
    values = [F.nullif(F.col(q(c)), F.lit("")) for c in columns]
    kinds = found.agg(*[F.every(v.isNull() | v.try_cast(t).isNotNull()).alias(f"{i}{t}") for i, v in enumerate(values) for t in ("bigint", "double", "boolean")]).first()
    pick = lambda i: next((t for t in ("bigint", "double", "boolean") if kinds[f"{i}{t}"]), "string")
    typed = [v.try_cast(pick(i)).alias(c) for i, (c, v) in enumerate(zip(columns, values, strict=True))]
    return found.select(entity_id(F.col("_file")).alias("entity_id"), F.col("_at").alias("component_index"), F.lit(None).cast("string").alias("modifier"), *typed)


def csv_spine(spark: SparkSession, paths: str | Iterable[str] | None) -> DataFrame:
    """One entity for each CSV file; its id is the hash of the file's id, its path ends in the file's stem."""
    where = paths_with(spark, as_paths(paths), (".csv",))
    if where:
        names = spark.read.format("binaryFile").options(**found_below((".csv",))).load(where).select(file_id(F.col("path")).alias("file_id"))  # contents stay unread
    else:
        names = empty(spark, "file_id string")
    stem = F.regexp_extract("file_id", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return names.select(entity_id(F.col("file_id")).alias("value"), F.concat_ws(":", "file_id", stem).alias("path"), stem.alias("alias"), stem.alias("entity_key"), F.col("file_id").alias("filepath"))

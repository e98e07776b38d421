"""Registries on disk: component tables bucketed and sorted by entity, and snapshots that tell which files are theirs.

    folder/tables/<name>/             files of all snapshots, each of one bucket
    folder/snapshots/<number>.json    of each table its key, columns and the files of that snapshot

All tables have one number of buckets, and Spark knows it, so tables of one store are joined by entity without a shuffle. A
merge reads and writes the buckets that its rows fall into, and a new snapshot names the new files beside the old ones of
all other buckets. Files are never changed; a snapshot that was opened stays readable until expire().
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import q
from ..operators.views import stacked
from .tables import durable

BUCKET = re.compile(r"_(\d{5})\.c\d+")
SPINE = "entity_id"


def key_of(table: str) -> str:
    """The column that holds an entity's id."""
    return "value" if table == SPINE else "entity_id"


class Store:
    """A folder of tables. buckets counts when the folder is made, and is read from it afterwards."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.session = uuid.uuid4().hex[:12]
        known = self.numbers()
        if known:
            self.buckets = self.snapshot(known[-1])["buckets"]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.named: set[str] = set()

    # -- files --------------------------------------------------------------------------------------------------------

    def path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    @property
    def files(self):
        return self.path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def listed(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.listed("snapshots") if re.fullmatch(r"\d+\.json", n))

    def snapshot(self, number: int | None = None) -> dict:
        """The last one without a number; an empty one in a new folder."""
        if number is None:
            known = self.numbers()
            if not known:
                return {"buckets": self.buckets, "tables": {}}
            number = known[-1]
        text = self.spark.sparkContext.wholeTextFiles(self.path("snapshots", f"{number}.json").toString(), 1).collect()[0][1]
        return json.loads(text)

    def commit(self, tables: dict) -> int:
        """Writes the next snapshot under a name of its own and moves it into place; of two writers one fails."""
        known = self.numbers()
        number = known[-1] + 1 if known else 1
        part, final = self.path("snapshots", f".{uuid.uuid4().hex}"), self.path("snapshots", f"{number}.json")
        out = self.files.create(part, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "tables": tables}).encode()))
        out.close()
        if self.files.exists(final) or not self.files.rename(part, final):
            self.files.delete(part, False)
            raise RuntimeError(f"snapshot {number} of {self.folder} was written by another one meanwhile")
        return number

    # -- tables -------------------------------------------------------------------------------------------------------

    @staticmethod
    def plain_name(table: str) -> str:
        """A folder's and a view's name for a type: letters and digits, told apart by a digest."""
        return f"{re.sub('[^a-z0-9]+', '_', table.lower())[:40]}_{hashlib.sha256(table.encode()).hexdigest()[:8]}"

    def bucket(self, key: Column) -> Column:
        """The number of the bucket that Spark puts a key in."""
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def catalogued(self, table: str, schema: StructType) -> str:
        """A name in the session's catalogue for a table's folder, with its buckets."""
        key, where = key_of(table), self.path("tables", self.plain_name(table)).toString()
        name = f"entiloom_{self.session}_{self.plain_name(table)}_{hashlib.sha256(schema.json().encode()).hexdigest()[:8]}"
        if name not in self.named:
            columns = ", ".join(f"{q(f.name)} {f.dataType.simpleString()}" for f in schema)
            self.files.mkdirs(self.path("tables", self.plain_name(table)))
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({q(key)}) SORTED BY ({q(key)}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
            self.named.add(name)
        return name

    def write(self, table: str, rows: DataFrame) -> list[str]:
        """New files of a table, a file for each bucket that has rows."""
        name = self.catalogued(table, rows.schema)
        before = set(self.listed("tables", self.plain_name(table)))
        key = key_of(table)
        rows.repartition(self.buckets, F.col(key)).sortWithinPartitions(key).createOrReplaceTempView(view := f"{name}_rows")
        try:
            self.spark.sql(f"INSERT INTO {name} SELECT * FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)
        return sorted(n for n in set(self.listed("tables", self.plain_name(table))) - before if BUCKET.search(n))

    def read(self, table: str, entry: dict, buckets: set[int] | None = None) -> DataFrame:
        """A table as a snapshot's entry has it, or some buckets of it. Files of other snapshots are not opened."""
        schema = StructType.fromJson(entry["schema"])
        live = [f for f in entry["files"] if buckets is None or int(BUCKET.search(f)[1]) in buckets]
        name = self.catalogued(table, schema)
        if not live:
            return self.spark.createDataFrame([], schema)
        self.spark.catalog.refreshTable(name)
        rows = self.spark.table(name)
        there = [n for n in self.listed("tables", self.plain_name(table)) if BUCKET.search(n)]
        return rows if len(live) == len(there) else rows.filter(F.col("_metadata.file_name").isin(live))

    def entry(self, rows: DataFrame, files: list[str]) -> dict:
        return {"schema": rows.schema.jsonValue(), "files": files}

    # -- what users call ----------------------------------------------------------------------------------------------

    def save(self, tables: dict[str, DataFrame], keep: bool = False) -> int:
        """A snapshot of these tables, and with keep of the last one's other tables."""
        done = dict(self.snapshot()["tables"]) if keep else {}
        with ThreadPoolExecutor(8) as pool:  # most tables are small jobs of few tasks
            for (name, rows), files in zip(tables.items(), pool.map(self.write, tables, tables.values()), strict=True):
                done[name] = self.entry(rows, files)
        return self.commit(done)

    def load(self, number: int | None = None) -> dict[str, DataFrame]:
        return {n: self.read(n, e) for n, e in self.snapshot(number)["tables"].items()}

    def merged(self, done: dict, tables: dict[str, DataFrame], replace: tuple[str, ...] = ()) -> dict:
        """The entries of a snapshot with more rows, each once, from those of another one (done); commit() makes them the
        next snapshot. Only buckets that the rows fall into are read and written. Tables named in replace are given rows
        that stand for all that their entities had. A table whose columns change their type is written whole."""
        done = dict(done)
        for name, rows in tables.items():
            if name not in done:
                done[name] = self.entry(rows, self.write(name, rows.distinct()))
                continue
            key, entry = key_of(name), done[name]
            rows = durable(rows, "merged")
            hit = {r.b for r in rows.select(self.bucket(F.col(key)).alias("b")).distinct().collect()}  # buckets are few
            if not hit:
                continue
            kinds = {f["name"]: f["type"] for f in entry["schema"]["fields"]}
            odd = any(f["name"] in kinds and kinds[f["name"]] != f["type"] for f in rows.schema.jsonValue()["fields"])
            old = self.read(name, entry, None if odd else hit)
            if name in replace:
                old = old.join(rows.select(key).distinct(), key, "left_anti").select(*[q(c) for c in old.columns])
            whole = stacked(old, rows).distinct()
            kept = [] if odd else [f for f in entry["files"] if int(BUCKET.search(f)[1]) not in hit]
            done[name] = self.entry(whole, kept + self.write(name, whole))
        return done

    def merge(self, tables: dict[str, DataFrame], replace: tuple[str, ...] = ()) -> int:
        return self.commit(self.merged(self.snapshot()["tables"], tables, replace))

    def expire(self, keep: int = 1) -> list[str]:
        """Deletes all snapshots but the last ones, and files that none of these has; returns the files' names."""
        last = self.numbers()[-keep:]
        live = {(n, f) for k in last for n, e in self.snapshot(k)["tables"].items() for f in e["files"]}
        gone = []
        for name in {n for k in self.numbers() for n in self.snapshot(k)["tables"]}:
            for f in self.listed("tables", self.plain_name(name)):
                if BUCKET.search(f) and (name, f) not in live:
                    self.files.delete(self.path("tables", self.plain_name(name), f), False)
                    gone.append(f)
        for k in self.numbers()[:-keep]:
            self.files.delete(self.path("snapshots", f"{k}.json"), False)
        return gone

    def close(self) -> None:
        """The names leave the session's catalogue; the folder stays."""
        for name in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.named.clear()

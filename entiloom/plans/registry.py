"""The registry: component types and their tables, with views, merging and storage."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import q
from ..operators import views
from ..operators.resolve import resolve
from ..operators.validate import FieldRule, compile_rules, empty_table
from ..sources.store import Store
from ..sources.tables import empty, load_tables


class Registry:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark, self.tables, self.declared = spark, {}, {}
        self._times: dict[str, str | None] = {}
        self.update(tables or {})

    def update(self, tables: dict[str, DataFrame]) -> None:
        """Replaces whole tables."""
        for name, df in tables.items():
            self.tables[name] = df
            df.createOrReplaceTempView(q(name))
        self._times.clear()

    def declare(self, name: str, rules: list[FieldRule]) -> None:
        """A type without rows: it is known, and empty."""
        self.declared[name] = rules

    @property
    def component_types(self) -> list[str]:
        return sorted(self.tables)

    def known(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name in self.declared:
            return empty_table(self.spark, self.declared[name])
        raise KeyError(name)

    def get(self, name: str) -> DataFrame:
        """The table; for an unknown type an empty one of entity_id and value."""
        try:
            return self.known(name)
        except KeyError:
            return empty(self.spark, "entity_id string, value string")

    def view(self, wanted: str | Iterable[str]) -> DataFrame:
        return views.view(wanted, self.known)

    def view_current(self, wanted: str | Iterable[str]) -> DataFrame:
        return views.view(wanted, self.current)

    def current(self, name: str) -> DataFrame:
        return views.current(self.known(name), self.time_field(name))

    def time_field(self, name: str) -> str | None:
        """The type's field that orders versions; several raise ValueError."""
        if not self._times and {"field", "entity_id"} <= self.tables.keys() and "time_dimension" in self.tables["field"].columns:
            spine = self.tables["entity_id"].select(F.col("value").alias("entity_id"), "entity_key")
            marked = self.tables["field"].filter(F.col("time_dimension").cast("string").try_cast("boolean")).select("entity_id", F.col("value").alias("f"))
            for r in spine.join(F.broadcast(marked), "entity_id").select("entity_key", "f").distinct().collect():  # schema rows
                self._times[r.entity_key] = f"{self._times[r.entity_key]}, {r.f}" if r.entity_key in self._times else r.f
            self._times.setdefault("", None)
        found = self._times.get(name)
        if found and ", " in found:
            raise ValueError(f"{name} has several time fields: {found}")
        return found

    def view_df(self, wanted: str | Iterable[str]):
        return self.view(wanted).toPandas()

    def get_entity_id(self, ref: str) -> str | None:
        """The entity that a reference names, or None if none or several fit."""
        row = resolve(self.spark.createDataFrame([(ref,)], "ref string"), self.get("entity_id")).first()
        return row.eid if row else None

    def view_entity(self, entity_id: str) -> dict[str, DataFrame]:
        """Each type's rows of one entity, of types that have any. The filter reaches every table's scan."""
        out = {}
        for name, t in self.tables.items():
            key = "value" if name == "entity_id" else "entity_id"
            if key in t.columns:
                rows = t.filter(F.col(key) == entity_id)
                if not rows.isEmpty():
                    out[name] = rows
        return out

    def rules(self) -> dict[str, list[FieldRule]]:
        return compile_rules(self.get("field"), self.get("entity_id"))

    def merge(self, other: Registry) -> None:
        self.update({n: views.merged(self.tables[n], t) if n in self.tables else t for n, t in other.tables.items()})
        self.declared |= {n: r for n, r in other.declared.items() if n not in self.tables}

    def sql(self, text: str) -> DataFrame:
        """Plain SQL over the tables, which are views under their names."""
        return self.spark.sql(text)

    def save(self, folder: str, buckets: int | None = None) -> None:
        """The next snapshot of a folder (sources.store), whose tables are joined by entity without a shuffle."""
        Store(self.spark, folder, buckets).save(self.tables)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, snapshot: int | None = None) -> Registry:
        """The last snapshot, or another one that is still there. Types that the schema declares are known, also without
        rows. A folder of plain Parquet tables is read too."""
        store = Store(spark, folder)
        return cls.of(spark, store.load(snapshot) if store.numbers() else load_tables(spark, folder))

    @classmethod
    def of(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> Registry:
        reg = cls(spark, tables)
        if {"field", "entity_id"} <= tables.keys():
            for name, rules in reg.rules().items():
                if name not in tables:
                    reg.declare(name, rules)
        return reg

    def close(self) -> None:
        for name in self.tables:
            self.spark.catalog.dropTempView(name)

    def __enter__(self) -> Registry:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def record(df: DataFrame) -> Column:
    """A row as a JSON text; nulls are left out."""
    return F.to_json(F.struct(*[F.col(q(c)) for c in df.columns]))


def to_records(df: DataFrame) -> Iterator[str]:
    """Rows as JSON texts. As with the others here, the driver holds a partition at a time."""
    return (r.value for r in df.select(record(df).alias("value")).toLocalIterator())


def csv_lines(df: DataFrame) -> Iterator[str]:
    yield csv_line(df.columns)
    for r in df.toLocalIterator():
        yield csv_line(r)


def csv_line(cells: Iterable[object]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(["" if c is None else c for c in cells])
    return out.getvalue()


def to_csv(df: DataFrame) -> str:
    return "".join(csv_lines(df))


def markdown_lines(df: DataFrame) -> Iterator[str]:
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    yield line(df.columns)
    yield "|" + " --- |" * len(df.columns)
    for r in df.toLocalIterator():
        yield line(r)


def to_markdown(df: DataFrame) -> str:
    return "\n".join(markdown_lines(df))

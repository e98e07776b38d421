"""Entity documents as a data source of Spark: `spark.read.format("entity_documents").load(folder)`.

Options: path; form, `flat` (the default: rows of manifests.FLAT) or `text` (file_id, kind, text); base, the folder that file
ids are told from (default: the working directory); bytes, how much a task reads (default 16 MB; a file counts 16 KB more
than it has); settle, the seconds that a stream waits before it takes a file for finished (default 1).

The driver lists names, sizes and times of files, as it does for Spark's own sources; texts are read and flattened by tasks.
Paths are those that pyarrow knows: local and shared folders, s3://, gs:// and hdfs://.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.documents import flat_rows
from .manifests import FLAT, RAW

NAME = "entity_documents"
#: What opening a file costs, as bytes: many small files are more work than their size tells.
OPENING = 16 << 10
KINDS = {".yaml": "yaml", ".yml": "yaml", ".py": "python"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/+", "/", path)))


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: int


class Documents:
    """What batches and streams share: listing a folder, and reading some of its files."""

    def __init__(self, options: dict):
        self.path, self.form = options["path"], options.get("form", "flat")
        self.base = opened(options.get("base") or str(Path.cwd()))[1].rstrip("/") + "/"
        self.most, self.settle = int(options.get("bytes", 16 << 20)), float(options.get("settle", 1))

    def listed(self, after: int = -1, upto: int | None = None) -> list[fs.FileInfo]:
        """Documents in the folder or below it, by name, changed in (after, upto]; a document named itself stands alone."""
        files, where = opened(self.path)
        top = files.get_file_info(where)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [top] if top.type == fs.FileType.File else files.get_file_info(fs.FileSelector(where, recursive=True))
        mine = [f for f in found if f.type == fs.FileType.File and Path(f.path).suffix in KINDS and f.mtime_ns > after and (upto is None or f.mtime_ns <= upto)]
        return sorted(mine, key=lambda f: f.path)

    def grouped(self, found: list[fs.FileInfo]) -> list[Files]:
        """Neighbours by name together, up to a task's bytes; a larger file alone."""
        out, held = [], 0
        for f in found:
            if not out or held + f.size + OPENING > self.most:
                out.append(Files([]))
                held = 0
            out[-1].names.append(f.path)
            held += f.size + OPENING
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = opened(self.path)
        for name in partition.names:
            kind, doc = KINDS[Path(name).suffix], name.removeprefix(self.base)
            with files.open_input_stream(name) as f:
                text = f.read().decode("utf-8", "replace")
            if self.form == "text":
                yield doc, kind, text
                continue
            for at, row in enumerate(flat_rows(doc, kind, text)):
                yield (doc, *row, at)


class Batch(Documents, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.grouped(self.listed())


class Stream(Documents, DataSourceStreamReader):
    """Files come when they are new or changed, by the time of their last change; the offset is the latest such time. A file
    may come again if the newest one is deleted while the stream is down: updates of a registry take rows once."""

    last = 0

    def initialOffset(self) -> dict:
        return {"upto": 0}

    def latestOffset(self) -> dict:
        done = time.time_ns() - int(self.settle * 1e9)
        self.last = max([self.last, *[f.mtime_ns for f in self.listed(self.last, done)]])
        return {"upto": self.last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.grouped(self.listed(start["upto"], end["upto"]))

    def commit(self, end: dict) -> None:
        pass


class Sink(DataSourceWriter):
    """Rows (file_id, text) as files below the folder. A file appears whole, so a task may be tried again."""

    def __init__(self, options: dict, names: list[str]):
        self.path, self.at = options["path"], (names.index("file_id"), names.index("text"))

    def write(self, rows: Iterator) -> Written:
        files, where = opened(self.path)
        n, made = 0, set()
        for row in rows:
            doc, text = row[self.at[0]], row[self.at[1]]
            if not doc or ".." in Path(doc).parts:
                raise ValueError(f"no name of a file below {self.path}: {doc!r}")
            target = f"{where}/{doc.lstrip('/')}"
            folder = target.rpartition("/")[0]
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write((text or "").encode())
            files.move(part, target)
            n += 1
        return Written(n)


class EntityDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RAW if self.options.get("form", "flat") == "text" else FLAT

    def reader(self, schema) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)

    def writer(self, schema, overwrite: bool) -> Sink:
        if overwrite:
            raise ValueError("documents are added, or replaced by name: use the mode append")
        return Sink(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EntityDocuments)

"""Streams of component rows: appended to a table as they come, read back as current versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.views import current
from ..sources.tables import durable


def append_versions(stream: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Writes each micro-batch of versioned rows (entity_id, ..., time) once to a Parquet table. Versions may arrive in
    any order: which is current is decided by their time when read."""
    out = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return out.trigger(**(trigger or {"availableNow": True})).start()


def current_versions(history: DataFrame, time_field: str) -> DataFrame:
    return current(history, time_field)


def update_registry(stream: DataFrame, registrar, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Each micro-batch of (file_id, text) YAML documents becomes an update of the registrar; the driver sees no text."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            registrar.update(raw=durable(batch.select("file_id", F.lit("yaml").alias("kind"), "text"), "documents"), time=number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

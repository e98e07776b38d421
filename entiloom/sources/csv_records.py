"""CSV files of any size, read by many tasks.

A line end inside quotes belongs to its field, so whether it ends a record depends on all quotes before it. Their parity is
a prefix sum: a first scan counts, for each block of a file that a task reads, its quotes and the records that begin in it
if it begins outside of quotes, or inside. Sums over the blocks of a file (a row each) tell where each block stands, and a
second scan cuts the records of each block and numbers them as they stand in the file. A record that runs over a block's
end leaves as parts, which are put together; all others never move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import durable

#: Blocks whose places are sent to all tasks, a row of about 100 bytes each; places of more are joined by a shuffle.
BLOCKS = 100_000


def lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, block, line: a block's lines lie in one task, in order, and only there."""
    text = spark.read.option("lineSep", "\n").text(files)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def stretches(batch: pa.RecordBatch):
    """Slices of a batch that lie in one block."""
    block, file = batch.column("block").to_numpy(), batch.column("file")
    changed = np.flatnonzero((block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) + 1
    ends = [0, *changed.tolist(), len(batch)]
    for a, b in zip(ends, ends[1:], strict=False):
        yield (file[a].as_py(), int(block[a])), batch.slice(a, b - a)


def marks(lines_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the parity of its quotes, and whether it is blank. In a line with an odd number, one that stands inside
    of an unquoted field (5" pipe) opens nothing."""
    quotes = pc.count_substring(lines_, '"').to_numpy(zero_copy_only=False)
    if (quotes & 1).any():
        stray = pc.count_substring_regex(pc.replace_substring(lines_, '""', ""), '[^,"]"[^,"\r]').to_numpy(zero_copy_only=False)
        quotes = np.where(quotes & 1, quotes - stray, 0)
    blank = pc.is_in(lines_, pa.array(["", "\r"], lines_.type)).to_numpy(zero_copy_only=False)
    return (quotes & 1).astype(np.int8), blank


def counts(text: DataFrame) -> DataFrame:
    """file, block, odd (quotes), even_starts, odd_starts: records that begin in the block, if it begins outside of quotes,
    or inside."""

    def run(batches):
        key, now = None, None
        for batch in batches:
            for where, part in stretches(batch):
                if where != key:
                    if key:
                        yield row(key, now)
                    key, now = where, [0, 0, 0]
                parity, blank = marks(part.column("line"))
                before = (now[0] + np.cumsum(parity) - parity) & 1
                now[1] += int(((before == 0) & ~blank).sum())
                now[2] += int(((before == 1) & ~blank).sum())
                now[0] = (now[0] + int(parity.sum())) & 1
        if key:
            yield row(key, now)

    def row(key, now):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([now[2]], pa.int64())], names=["file", "block", "odd", "even_starts", "odd_starts"])

    return text.mapInArrow(run, "file string, block bigint, odd int, even_starts bigint, odd_starts bigint")


def placed(counted: DataFrame) -> DataFrame:
    """file, block, inside (the block begins inside quotes), first (number of the first record that begins in it)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    turned = counted.withColumn("inside", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)).cast("int"))
    starts = F.when(F.col("inside") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    return turned.withColumn("starts", starts).select("file", "block", "inside", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("first"))


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, record (its number in the file, from 0; blank lines have none), text."""
    where = durable(placed(durable(counts(lines(spark, files)), "csv-blocks")), "csv-places")
    text = lines(spark, files)
    if where.count() <= BLOCKS:
        return cut(text.join(F.broadcast(where), ["file", "block"]))
    # lines keep their order inside a block, whatever tasks the join gives them to
    apart = text.withColumn("at", F.monotonically_increasing_id()).join(where, ["file", "block"]).repartition("file", "block")
    return cut(apart.sortWithinPartitions("file", "block", "at"))


def cut(text: DataFrame) -> DataFrame:
    def run(batches):
        key, held = None, []  # held: lines of the record that is open, its number, whether it began in this block
        number, began, parity = 0, False, 0

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=["file", "record", "block", "whole", "text"])

        for batch in batches:
            rows = []
            for where, part in stretches(batch):
                if where != key:
                    if key and held:
                        rows.append((key[0], number, key[1], False, "\n".join(held)))
                    parity, first = part.column("inside")[0].as_py(), part.column("first")[0].as_py()
                    key, held, number, began = where, [], first - 1, False
                odd, blank = marks(part.column("line"))
                for line, o, empty in zip(part.column("line").to_pylist(), odd.tolist(), blank.tolist(), strict=True):
                    if parity == 0:
                        if empty:
                            continue
                        held, began, number = [], True, number + 1
                    held.append(line)
                    parity ^= o
                    if parity == 0:
                        rows.append((key[0], number, key[1], began, "\n".join(held)))
                        held = []
            if rows:
                yield out(rows)
        if key and held:
            yield out([(key[0], number, key[1], False, "\n".join(held))])

    parts = durable(text.select("file", "block", "line", "inside", "first").mapInArrow(run, "file string, record bigint, block bigint, whole boolean, text string"), "csv-records")
    open_ = parts.filter("not whole").groupBy("file", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return parts.filter("whole").select("file", "record", "text").unionByName(open_).withColumn("text", F.regexp_replace("text", "\r$", ""))

"""Hard negatives by distributed radix selection.

Components become whole numbers, so scores (inner products) do too. An anchor's best positives are the best rows of its
own label; each pair of anchor and positive opens a window of scores below the positive's, in which the best rows of
other labels are wanted. Both are the same problem: of many windows the k best rows each.

Every pass reads all rows against a block of anchors (of bounded size, sent to the tasks), multiplies, and counts for each
window how many rows fall in each bucket of the window's current range. Sums over tasks locate the bucket that holds the
k-th row; the next pass refines that bucket by another digit, until a bucket is a single score. Only then rows are
gathered: those at or above the located score, at most k from a task for each window. A task's buckets below its own
k-th row can't hold the k-th of all, so no task sends more than k counts for a window either. Rows are never shuffled,
and no key groups them: a label, a vector or an id that fills a third of the table changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read, release

#: Bits of a digit.
DIGIT = 8
#: Anchors of a block, and components that they have together at most; a single longer vector makes a block of its own.
ANCHORS, COMPONENTS = 1024, 1_000_000
#: Scores that a task holds at once.
CELLS = 2_000_000
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (doubles without a fraction: floor(scale * component)) of rows that have an id, a label and a
    vector of finite components; others take no part. Other columns are dropped."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v"))


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products, rows by anchors, as 64-bit integers; exact, and held at the borders of 64 bits beyond them."""
    bound = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * max(rows.shape[1], 1)
    if bound < 2.0**53:  # every partial sum is a double without loss
        return (rows @ anchors.T).astype(np.int64)
    exact = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    out = exact(rows) @ exact(anchors).T
    return np.array([[min(max(int(c), LEAST), MOST) for c in r] for r in out], np.int64).reshape(len(rows), len(anchors))


@dataclass
class Windows:
    """Of each window its anchor's number, whether rows must bear the anchor's label or another one, and its scores from
    high down to low. start, shift: where the current range begins, counted down from high, and the width of a bucket in
    bits; above: rows before it. done: start is the place of the last row wanted."""

    anchor: np.ndarray
    same: bool
    high: np.ndarray
    low: np.ndarray

    def __post_init__(self):
        self.start = np.zeros(len(self.anchor), np.uint64)
        self.above = np.zeros(len(self.anchor), np.int64)
        widest = max((int(h) - int(w) for h, w in zip(self.high, self.low, strict=True)), default=0)
        self.shift = max(0, max(widest, 0).bit_length() - DIGIT)
        self.all = np.zeros(len(self.anchor), np.bool_)  # fewer than k rows: the whole window is wanted


@dataclass
class Block:
    """Anchors with vectors of one length."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray


def slices(batches: Iterator[pa.RecordBatch], block: Block, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: of those in a window the window's number, the distance from its high score, the row's
    number in the slice, and the slice's ids and labels."""
    dim = block.v.shape[1]
    step = max(1, CELLS // max(1, len(windows.anchor) + dim))
    high, low = windows.high, windows.low
    for batch in batches:
        lists = batch.column("v")
        for at in range(0, len(batch), step):
            part = lists.slice(at, step)
            fits = np.diff(np.asarray(part.offsets)) == dim
            ids, labels = (batch.column(c).slice(at, step).to_numpy()[fits] for c in ("vec_id", "label"))
            flat = part.flatten() if fits.all() else part.filter(pa.array(fits)).flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            s = scores(x, block.v)[:, windows.anchor]
            alike = labels[:, None] == block.labels[windows.anchor][None, :]
            fit = (s <= high) & (s >= low) & (alike == windows.same)
            if windows.same:
                fit &= ids[:, None] != block.ids[windows.anchor][None, :]
            r, w = np.nonzero(fit)
            yield w, high[w].astype(np.uint64) - s[r, w].astype(np.uint64), r, ids, labels


def located(rows: DataFrame, block: Block, windows: Windows, k: int) -> None:
    """Refines the windows' ranges, a digit in each pass, until start is the distance of the k-th row from the high score."""
    while len(windows.anchor):

        def run(batches):
            count = np.zeros((len(windows.anchor), 1 << DIGIT), np.int64)
            for w, p, _, _, _ in slices(batches, block, windows):
                d = (p - windows.start[w]) >> np.uint64(windows.shift)
                keep = (p >= windows.start[w]) & (d < (1 << DIGIT))
                count += np.bincount(w[keep] * (1 << DIGIT) + d[keep].astype(np.int64), minlength=count.size).reshape(count.shape)
            before = np.cumsum(count, 1) - count
            w, d = np.nonzero((count > 0) & (before < k))
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(count[w, d])], names=["w", "d", "n"])

        counts = rows.select("vec_id", "label", "v").mapInArrow(run, "w int, d int, n bigint").groupBy("w", "d").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("w").orderBy("d"))
        last = counts.withColumn("upto", upto).join(left_in(rows.sparkSession, windows, k), "w").filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
        found = np.zeros(len(windows.anchor), np.bool_)
        for r in last.collect():  # a row for each window of a block at most
            found[r.w] = True
            windows.start[r.w] += np.uint64(r.d << windows.shift)
            windows.above[r.w] += r.upto - r.n
        windows.all |= ~found
        if windows.shift == 0:
            return
        windows.shift = max(0, windows.shift - DIGIT)


def left_in(spark: SparkSession, windows: Windows, k: int) -> DataFrame:
    """w, left: how many rows a window still wants from its current range."""
    at = np.flatnonzero(~windows.all)
    return spark.createDataFrame(pa.table({"w": pa.array(at.astype(np.int32)), "left": pa.array(k - windows.above[at])}))


def gathered(rows: DataFrame, block: Block, windows: Windows, k: int) -> DataFrame:
    """w, rank (from 1), vec_id, score of each window's k best rows (all, if fewer): ties to the smaller vec_id."""

    def best(w: np.ndarray, p: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((i, p, w))
        w, p, i = w[order], p[order], i[order]
        first = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.bool_)
        place = np.arange(len(w)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(w) else np.zeros(0, np.int64)
        return w[place < k], p[place < k], i[place < k]

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for w, p, r, ids, _ in slices(batches, block, windows):
            keep = windows.all[w] | (p <= windows.start[w])
            held = best(*(np.concatenate(pair) for pair in zip(held, (w[keep], p[keep], ids[r[keep]]), strict=True)))
        w, p, i = held
        score = (windows.high[w].astype(np.uint64) - p).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(i), pa.array(score)], names=["w", "vec_id", "score"])

    hits = rows.select("vec_id", "label", "v").mapInArrow(run, "w int, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("w", "rank", "vec_id", "score")


def selected(rows: DataFrame, block: Block, windows: Windows, k: int) -> DataFrame:
    located(rows, block, windows, k)
    return gathered(rows, block, windows, k)


def blocks(anchors: DataFrame) -> Iterator[Block]:
    """Anchors (sorted by the length of their vectors) in blocks; the driver holds one at a time."""
    held: list = []
    for r in anchors.toLocalIterator():
        v = np.array(r.v, np.float64)
        if held and (len(held[0][2]) != len(v) or len(held) >= ANCHORS or (len(held) + 1) * len(v) > COMPONENTS):
            yield Block(np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held]).reshape(len(held), -1))
            held = []
        held.append((r.vec_id, r.label, v))
    if held:
        yield Block(np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held]).reshape(len(held), -1))


def negatives_of(rows: DataFrame, longest: float, block: Block, positives: int, k: int, least: int, scale: int) -> DataFrame:
    """The result's rows of one block of anchors. No score of an anchor lies outside its length times the longest one's."""
    far = np.sqrt(np.square(block.v).sum(1)) * longest * (1 + 1e-9) + 1
    high = np.array([int(f) if f < 2.0**62 else MOST for f in far], np.int64)
    near = Windows(np.arange(len(block.ids)), True, high, np.where(high == MOST, LEAST, -high))
    found = selected(rows, block, near, positives).collect()  # so many rows for each anchor of the block
    anchor, positive, score = (np.array([getattr(r, c) for r in found], np.int64) for c in ("w", "vec_id", "score"))
    lowest = np.array([-(-least * int(s) // scale) for s in score], np.int64)
    open_ = np.flatnonzero(lowest <= score)
    pairs = Windows(anchor[open_], False, score[open_], lowest[open_])
    told = pa.table({"w": pa.array(np.arange(len(open_), dtype=np.int32)), "anchor_id": pa.array(block.ids[anchor[open_]].astype(np.int64)), "positive_id": pa.array(positive[open_]), "positive_score": pa.array(score[open_])})
    hits = selected(rows, block, pairs, k)
    named = F.broadcast(rows.sparkSession.createDataFrame(told))  # a block's windows: parameters bound them
    return hits.join(named, "w").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, v, as whole_vectors() gives them; is_anchor: a condition on them. Each anchor's positives are
    its best other rows (another vec_id) of its label; of each positive the best rows of other labels with
    least * positive_score <= of * negative_score <= of * positive_score are returned. Rows count each, also those that
    repeat others; anchors that repeat in all columns count once. Scores compare vectors of the anchor's length only. An
    anchor without positives, and a positive without negatives (always, if its score is below 0), have no rows; neither
    has an empty table."""
    spark = vectors.sparkSession
    rows = durable(vectors.select("vec_id", "label", "v"), "vectors")
    anchors = durable(rows.filter(is_anchor).distinct(), "anchors")
    longest = rows.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("m")).first().m or 0.0
    parts = [durable(negatives_of(rows, longest, b, positives, negatives, least, of), "negatives") for b in blocks(anchors.orderBy(F.size("v"), "vec_id"))]
    release(rows, anchors)
    if not parts:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return spark.read.schema(parts[0].schema).parquet(*[p.durable_path for p in parts])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of embeddings; where vec_id is divisible by 7, the label is moved on by one."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(whole_vectors(rows), F.col("vec_id") % 100 == 0)

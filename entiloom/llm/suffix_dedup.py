"""Removal of long repeated byte strings by bucket-pointer refinement over the whole corpus.

A string of `length` bytes that starts at two places is found as in bucket-pointer refinement of suffixes: places first
share a bucket by a q-gram; buckets are then refined by identifiers of what lies at later offsets, the new
identifiers serve the next round, and places alone in their bucket drop out. Three things make this a Spark job:

* The q-gram of a place need not be its first one. It is the q-gram with the least hash among those inside the place's
  string, a choice that depends on this string only, so neighbouring places share one anchor. They stay together
  as a *run* (anchor, first, last place), about 2 * corpus / length of them, not one row for each byte.
* A bucket is a row group keyed by a 128-bit identifier; every round only counts per key (Spark combines before
  it shuffles) and joins the counts back, so no bucket is ever gathered in one task.
* Runs whose q-gram no other run has drop out first. Runs that agree in all their bytes are settled at once. Where members of a bucket differ, their runs are cut at
  offsets that are the same for all members (64, then 8, then 1 places wide), and the identifier of each piece is made
  of its bucket's and of the bytes that all strings of the piece cover on both sides.

Equal bytes are told by 128 bits of independent hashes: a run's q-gram and its whole, a piece's digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read, release, with_columns
from .stretches import POWERS

LENGTH, Q = 400, 144
WIDTHS = (64, 8, 1)
#: Places handled at once, for memory; pieces of a longer text overlap by a string.
PIECE = 1 << 20
#: Rows that a task turns into Python objects at once.
SLICE = 500
_MIX = 0xD6E8FEB86659FD93


def digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()


def qgram_hashes(raw: np.ndarray, q: int) -> np.ndarray:
    p = POWERS.reach(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p.up[: len(raw)], out=total[1:])
    h = (total[q:] - total[:-q]) * p.down[: len(raw) - q + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def anchors(raw: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place that starts a string of `length` bytes, the place of its least q-gram (the first of equal ones);
    and the hashes of all q-grams."""
    h = qgram_hashes(raw, q)
    w = length - q + 1
    n = len(h)
    pad = -(-n // w) * w
    key = np.full(pad, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (h >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    rows = key.reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64), h


def runs(data: bytes, length: int, q: int) -> list[tuple[int, int, int, int, int]]:
    """(q-gram hash, digest of the run's bytes and offset, anchor, and how far before it the last and first place lie)."""
    out = []
    for base in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[base : base + PIECE + length - 1]
        at, h = anchors(np.frombuffer(part, np.uint8), length, q)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        of = at[first]
        for k, a, s, e in zip(h[of].view(np.int64).tolist(), of.tolist(), first.tolist(), last.tolist(), strict=True):
            full = hashlib.blake2b(part[s : e + length], digest_size=8, salt=(a - s).to_bytes(4, "little")).digest()
            out.append((k, int.from_bytes(full, "little", signed=True), base + a, a - e, a - s))
    return out


def pieces(bucket: bytes, context: bytes, offset: int, lo: int, hi: int, width: int, length: int) -> list[tuple[bytes, bytes, int, int, int, int]]:
    """Cuts the places lo..hi before an anchor (the anchor lies d places after place d) into pieces d // width.
    context starts at place hi before the anchor, which is at `offset`. Each piece: its bucket, the digest of its bytes, lo,
    hi, and its bytes' span in the context."""
    out = []
    for cell in range(lo // width, hi // width + 1):
        a, b = cell * width, cell * width + width - 1  # all places of the cell; every member shares these cuts
        low, high = max(a, lo), min(b, hi)
        core = context[offset - a : offset + length - b] if b < length else b""  # bytes in the strings of all places
        start, end = offset - high, offset - low + length
        out.append((digest(bucket, cell.to_bytes(4, "little"), core), digest(context[start:end], high.to_bytes(4, "little")), low, high, start, end))
    return out


def settle(level: DataFrame, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """level: bucket, full, known, text_key, anchor, lo, hi and perhaps context. First: runs of places whose bytes occur
    twice (known ones have been told before). Second: one member of each content from the buckets that hold several.
    Third: the tables that the second is read from."""
    level = durable(level, name)
    member = F.struct("text_key", "anchor", "lo", "hi", *(["context"] if "context" in level.columns else []))
    times = F.sum(F.when(F.col("known"), 2).otherwise(1))
    stats = durable(level.groupBy("bucket", "full").agg(times.alias("n"), F.min(member).alias("one")), f"{name}-counts")
    mixed = stats.groupBy("bucket").agg(F.count("*").alias("contents")).filter("contents > 1")
    both = level.filter("not known").join(stats.filter("n > 1").select("bucket", "full"), ["bucket", "full"], "left_semi")
    ones = stats.join(mixed.select("bucket"), "bucket", "left_semi").select("bucket", (F.col("n") > 1).alias("known"), "one.*")
    found = both.select("text_key", (F.col("anchor") - F.col("hi")).alias("first"), (F.col("anchor") - F.col("lo")).alias("last"))
    return durable(found, f"{name}-found"), ones, [level, stats]


def repeated_spans(texts: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """text_key, first, last: runs of places in a text whose string of `length` bytes starts elsewhere too.

    texts: text_key binary (16 bytes of a digest), data binary; a row for each text, equal ones as often as they occur."""
    names = ["bucket", "full", "known", "text_key", "anchor", "lo", "hi"]
    w = length - q + 1  # lo and hi are below it; packed with the anchor into one number they shuffle in 8 bytes

    def first_level(batches):
        for batch in batches:
            rows, keys = [], []
            for key, data in zip(batch.column("text_key").to_pylist(), batch.column("data"), strict=True):
                found = runs(data.as_py(), length, q)
                rows += found
                keys += [key] * len(found)
                if len(rows) > 20_000:
                    yield packed(rows, keys)
                    rows, keys = [], []
            if rows:
                yield packed(rows, keys)

    def packed(rows: list[tuple], keys: list[bytes]) -> pa.RecordBatch:
        bucket, full, anchor, lo, hi = (np.array(v, np.int64) for v in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(full), pa.array(keys, pa.binary()), pa.array((anchor * w + lo) * w + hi)], names=["bucket", "full", "text_key", "place"])

    # q-grams of one run end here, before anything but their hash is shuffled; most runs of most corpora do
    every = durable(texts.mapInArrow(first_level, "bucket bigint, full bigint, text_key binary, place bigint"), "runs")
    shared = durable(every.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    places = {"anchor": F.expr(f"place div {w * w}"), "lo": F.expr(f"place div {w} % {w}"), "hi": F.expr(f"place % {w}")}
    found, ones, used = settle(every.join(shared, "bucket", "left_semi").withColumns({"known": F.lit(False), **places}).drop("place"), "shared-runs")
    release(every, shared)
    spans = [found]
    context = F.expr(f"substring(data, cast(anchor - hi + 1 as int), cast(hi - lo + {length} as int))")
    once = ones.withColumn("bucket", F.col("bucket").cast("string").cast("binary"))
    # one row of each text, so that members don't multiply by its copies; copies are combined before the shuffle
    ones = texts.dropDuplicates(["text_key"]).join(once, "text_key").select(*once.columns, context.alias("context"))
    for width in WIDTHS:

        def cut(batches, width=width):
            for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
                out = []
                for r in batch.to_pylist():
                    for bucket, full, lo, hi, a, b in pieces(r["bucket"], r["context"], r["hi"], r["lo"], r["hi"], width, length):
                        out.append((bucket, full, r["known"], r["text_key"], r["anchor"], lo, hi, r["context"][a:b]))
                if out:
                    kinds = [pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*names, "context"])

        level = ones.mapInArrow(cut, "bucket binary, full binary, known boolean, text_key binary, anchor bigint, lo bigint, hi bigint, context binary")
        found, ones, next_used = settle(level, f"pieces-{width}")
        release(*used)  # the new level is written, so disk holds one level at a time
        used = next_used
        spans.append(found)
    release(*used)
    out = spans[0]
    for s in spans[1:]:
        out = out.unionAll(s)
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that no string starting in a span covers, and the maximal removed stretches (start, end)."""
    removed: list[list[int]] = []
    for s, e in sorted(spans):
        if removed and s <= removed[-1][1]:
            removed[-1][1] = max(removed[-1][1], e + length)
        else:
            removed.append([s, e + length])
    at, out = 0, []
    for s, e in removed:
        out.append(data[at:s])
        at = e
    out.append(data[at:])
    return b"".join(out), [(s, e) for s, e in removed]


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, q: int = Q) -> DataFrame:
    """docs without text, then n_bytes, kept (binary), and removed, the cut stretches array<struct<start,end>> in bytes.

    A byte goes if a string of `length` bytes that covers it also starts elsewhere in the input, in any row or this
    one. A null text counts as empty; rows that repeat a text lose all of it if it has `length` bytes. Rows are told
    apart by their text only, so any ids will do; columns of docs named like a new one are dropped; an empty table
    gives an empty result."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    clash = {"n_bytes", "kept", "removed", "text_key", "data", "spans", text}
    keep = [c for c in docs.columns if c not in clash]
    rows = docs.select(*[f"`{c}`" for c in keep], body.alias("data")).withColumn("text_key", F.unhex(F.substring(F.sha2("data", 256), 1, 32)))
    spans = repeated_spans(rows.filter(F.length("data") >= length).select("text_key", "data"), length, q)
    grouped = durable(spans.groupBy("text_key").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")  # of one text

    def cut(batches):
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
            kept, removed = [], []
            data = batch.column("data").to_pylist()
            for x, found in zip(data, batch.column("spans").to_pylist(), strict=True):
                k, r = kept_bytes(x, [(f["first"], f["last"]) for f in found or []], length)
                kept.append(k)
                removed.append([{"start": s, "end": e} for s, e in r])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield with_columns(batch, keep, n_bytes=pa.array(map(len, data), pa.int64()), kept=pa.array(kept, pa.binary()), removed=pa.array(removed, kind))

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_bytes bigint, kept binary, removed array<struct<start:bigint,end:bigint>>"])
    return rows.join(grouped, "text_key", "left").drop("text_key").mapInArrow(cut, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without strings of 400 bytes that start twice."""
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

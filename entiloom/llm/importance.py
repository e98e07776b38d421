r"""Target-distribution importance resampling over hashed word runs.

A vectorised byte-automaton reads texts where Arrow holds them: a lookup table classes (and lower-cases) every byte of a
batch's UTF-8 buffer, differences of the classes and the documents' borders give all words, and table-driven CRCs advance
over all words at once, a byte a step. Longer runs of words go on from the state of the run that is a word shorter.

Two passes over the corpus: the first sums bucket counts, in each task over its part and then in Spark (a row for each
bucket); the second scores each document by its buckets' gains and a noise that its id fixes. The draw takes the highest
scores: a histogram of scores finds the least one that is drawn, and only rows from there up are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import durable, free_name, read, shuffle_partitions

BUCKETS, SEED = 10_000, 2024
#: Bytes of text that a task holds at once as numpy arrays.
BYTES_AT_ONCE = 2_000_000
#: Steps that all words take together; what is left of longer words goes on one by one, from the state reached.
STEPS = 64

_ascii = np.arange(256, dtype=np.uint8)
#: Class of each byte: 0 outside of words, else the byte itself, A-Z lower-cased. Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
CLASS = np.where((_ascii >= 65) & (_ascii <= 90), _ascii + 32, _ascii)
CLASS[[i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122)]] = 0

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)

START = np.uint32(0xFFFFFFFF)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classed bytes, the words' starts and lengths, and each word's document; offsets: where documents begin in data, and
    the end of the last."""
    classed = CLASS[data]
    inside = np.zeros(len(data) + 2, np.bool_)
    inside[1:-1] = classed != 0
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(data))]
    cut = border[inside[border] & inside[border + 1]]  # a word that would run from one document into the next
    begins[cut] = ends[cut] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return classed, starts, stops - starts, np.searchsorted(offsets, starts, "right") - 1


def advance(state: np.ndarray, classed: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of words, all words a byte further in each step."""
    order = np.argsort(-lengths, kind="stable")
    out, at = state[order], starts[order]
    rising = -lengths[order]
    for k in range(min(STEPS, int(lengths.max(initial=0)))):
        n = int(np.searchsorted(rising, -k, "left"))  # words longer than k
        out[:n] = CRC[(out[:n] ^ classed[at[:n] + k]) & 0xFF] ^ (out[:n] >> 8)
    for i in range(int(np.searchsorted(rising, -STEPS, "left"))):
        rest = classed[at[i] + STEPS : at[i] - rising[i]].tobytes()
        out[i] = zlib.crc32(rest, int(~out[i] & START)) ^ 0xFFFFFFFF
    state = np.empty_like(out)
    state[order] = out
    return state


def features(data: np.ndarray, offsets: np.ndarray, least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of least to most words: their document and bucket; and the number of words of each document."""
    classed, starts, lengths, doc = words_of(data, offsets)
    docs, hashed = [], []
    state, n = advance(np.full(len(starts), START), classed, starts, lengths), len(starts)
    for run in range(1, most + 1):
        if run > 1:  # the run that is a word shorter, a space, and the word behind it
            n = max(0, n - 1)
            last = run - 1
            state = CRC[(state[:n] ^ np.uint32(32)) & 0xFF] ^ (state[:n] >> 8)
            state = advance(state, classed, starts[last : last + n], lengths[last : last + n])
        if run >= least:
            whole = doc[:n] == doc[run - 1 : run - 1 + n]
            docs.append(doc[:n][whole])
            hashed.append((~state[whole] & START) % np.uint32(buckets))
    return np.concatenate(docs), np.concatenate(hashed).astype(np.int64), np.bincount(doc, minlength=len(offsets) - 1)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that an Arrow array of texts lies in, and where each text begins and the last one ends."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with about BYTES_AT_ONCE bytes of text each, with bytes and offsets. A null text is empty."""
    for batch in batches:
        texts = batch.column(column)
        texts = texts.fill_null("") if texts.null_count else texts
        data, offsets = utf8(texts)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, "right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def bucket_counts(docs: DataFrame, text: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts in each bucket that has any."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in pieces(batches, text):
            total += np.bincount(features(data, offsets, least, most, buckets)[1], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket floor(1000 * ln of target's share over corpus's share), counts plus one; both are bucket_counts(),
    which have a row for each bucket at most."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, counts in ((s, corpus), (t, target)):
        for r in counts.collect():
            into[r.bucket] = r.n
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text", least: int = 1, most: int = 1) -> DataFrame:
    """docs without text, with n_words, n_features and weight: the floored mean of the gains of a text's features, 0
    without any. The new columns take the place of docs' own ones of these names."""
    new = ("n_words", "n_features", "weight")
    keep = [c for c in docs.columns if c != text and c.lower() not in new]

    def run(batches):
        for batch, data, offsets in pieces(batches, text):
            doc, bucket, words = features(data, offsets, least, most, len(gain))
            n = np.bincount(doc, minlength=len(words))
            ends = np.cumsum(np.concatenate([[0], gain[bucket[np.argsort(doc, kind="stable")]]]))
            total = np.diff(ends[np.concatenate([[0], np.cumsum(n)])])  # sums of whole numbers: exact
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, (words.astype(np.int64), n.astype(np.int64), weight))], names=[*keep, *new])

    schema = StructType([*[docs.schema[c] for c in keep], *[StructField(c, LongType()) for c in new]])
    return docs.select(*[f"`{c}`" for c in keep], text).mapInArrow(run, schema)


def with_score(df: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """df with score: weight plus the floor of 1000 times a Gumbel noise that sha256 of `seed:key` fixes (a null key
    counts as an empty one)."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(told, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return df.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("bigint"))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a column name: 1, 2, 3... over all rows in that order; rows that are equal in it follow one another in any
    order. Spark sorts ranges of rows, each in a task of its own; a row for each range tells where it begins. A last key
    of the row's place splits ties, however many."""
    part, place = free_name(df, "_part"), free_name(df, "_place")
    keys = [*order, F.col(place)]
    rows = df.withColumn(place, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    # the number inside a range, and the range's, are those of the sorted row's position
    rows = durable(rows.withColumn(part, F.shiftright(F.monotonically_increasing_id(), 33)).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part).agg(F.count("*").alias("_n")).select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(name))
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(name) + F.col(place) + 1).select(*[f"`{c}`" for c in df.columns], name)


def drawn(df: DataFrame, percent: int = 10, least_words: int = 20, key: str = "doc_id") -> DataFrame:
    """df (n_words, score) with rank: of the N rows with least_words words or more the floor(percent * N / 100) highest
    scores get 1, 2, 3..., ties to the smaller key (a null one last); null for all others. Repeated rows count each."""
    long = F.col("n_words") >= least_words
    by_score = df.filter(long).groupBy("score").agg(F.count("*").alias("n"))  # scores are bounded, and so are these rows
    rows = sorted(((r.score, r.n) for r in by_score.collect()), reverse=True)
    left = sum(n for _, n in rows) * percent // 100
    lowest, taken = None, 0
    for score, n in rows:
        if taken >= left:
            break
        lowest, taken = score, taken + n
    none = F.lit(None).cast("bigint")
    if lowest is None:
        return df.withColumn("rank", none)
    high = long & (F.col("score") >= lowest)
    ranked = numbered(df.filter(high), [F.desc("score"), F.col(key).asc_nulls_last()], "rank")
    return ranked.withColumn("rank", F.when(F.col("rank") <= left, F.col("rank"))).unionByName(df.filter(~high).withColumn("rank", none))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, key: str = "doc_id", least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight, score, rank of every row of docs (key, text; other columns are dropped), drawn
    towards the texts of target.

    A null text has no words, weight 0 and no rank. Rows that repeat count each. Without a target's words all gains come
    from the corpus alone; an empty corpus gives an empty result."""
    gain = gains(bucket_counts(docs, "text", least, most, buckets), bucket_counts(target, "text", least, most, buckets), buckets)
    scored = durable(with_score(weighted(docs.select(key, "text"), gain, "text", least, most), key, seed), "importance")
    return drawn(scored, percent, least_words, key)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents drawn towards benchmark by their words: a tenth of those with 20 words or more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(docs, read(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")

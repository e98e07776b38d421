"""Quality classifier: random Fourier features of document statistics, ridge regression by summed normal equations,
isotonic calibration.

Statistics of whole texts are standardised and mapped to cos(W x + b), whose inner products approximate a Gaussian
kernel. Each task adds up the normal equations of its labelled rows; Spark sums them entry by entry, and the driver
solves one system whose size depends on `features` alone. Scores of rows kept out of that fit are binned and
made monotone (pool adjacent violators), which gives calibrated probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_crc, read

STATS = (
    "chars words word_mean word_sd word_longest upper lower digit symbol mark other_ascii beyond_ascii blank breaks kinds "
    "top_word new_triples repeated_lines line_mean line_sd capital_words shouted_words symbol_words digit_words entropy "
    "sentence_ends bangs pipes braces"
).split()
BINS = 1024

_KIND = np.full(256, 5, np.int64)  # other ASCII
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), (b"abcdefghijklmnopqrstuvwxyz", 1), (b"0123456789", 2), (b"#*$%&|<>", 3), (b".,;:!?'\"-()", 4), (b" \t\r\v\f", 7), (b"\n", 8)):
    _KIND[np.frombuffer(_chars, np.uint8)] = _kind
_KIND[128:] = 6


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, in the order of STATS; of a text without words, zeros where a share has no base."""
    raw = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(raw, minlength=256)
    kind = np.bincount(_KIND, weights=count, minlength=9) / max(1, len(raw))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    times: dict[str, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    long = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1, np.int64)
    p = count[count > 0] / max(1, len(raw))
    share = lambda test: sum(map(test, times)) / max(1, len(times))
    return [
        np.log1p(len(text)), np.log1p(n), size.mean(), size.std(), np.log1p(size.max()), *kind, len(times) / max(1, n),
        max(times.values(), default=0) / max(1, n), triples / max(1, n - 2), 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(long.mean()), np.log1p(long.std()), share(lambda w: w[0].isupper()), share(lambda w: len(w) > 1 and w.isupper()),
        share(lambda w: not w[-1].isalnum() and w[-1] in "#*$%&|<>!"), share(lambda w: w[0].isdigit()), float(-(p * np.log2(p)).sum()),
        (count[46] + count[33] + count[63]) / max(1, n), count[33] / max(1, n), count[124] / max(1, n), (count[123] + count[125] + count[59]) / max(1, n),
    ]


def statistics_of(text: str) -> Column:
    """The statistics of a text column as array<double>; a null text counts as empty. Only texts go to Python."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(x or "") for x in texts.to_pylist()], pa.list_(pa.float64()))

    return of(F.col(text))


@dataclass
class KernelModel:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    learned: bool = False  # whether any labelled row was there

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.waves + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, x, np.ones((len(x), 1))])  # the statistics themselves too: a linear part beside the kernel

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATS))


def fit(labelled: DataFrame, calibrate: Column, features: int = 160, width: float = 6.0, ridge: float = 1e-3, seed: int = 7) -> KernelModel:
    """labelled: stats array<double>, y double. Rows where `calibrate` holds fit the calibration, the others the ridge.
    Without labelled rows every score is 0.5."""
    d = len(STATS)
    rng = np.random.default_rng(seed)
    model = KernelModel(np.zeros(d), np.ones(d), rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + d + 1), np.array([0.0]), np.array([0.5]))
    labelled = labelled.withColumn("_calibrate", calibrate)
    moments = labelled.agg(F.count("*").alias("n"), *[f(F.get("stats", F.lit(i))).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments.n:
        return model
    model.learned = True
    model.mean = np.array([moments[f"m{i}"] for i in range(d)])
    model.scale = np.maximum([moments[f"s{i}"] for i in range(d)], 1e-6)

    def sums(batches):
        total = np.zeros((features + d + 2,) * 2)
        for b in batches:
            z = np.hstack([model.features(matrix(b.column("stats"))), b.column("y").to_numpy()[:, None]])
            total += z.T @ z
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = labelled.filter("not _calibrate").select("stats", "y").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros((features + d + 2,) * 2)
    for r in cells:  # as many as the parameters make
        gram[r.i, r.j] = gram[r.j, r.i] = r.v
    if not gram[-2, -2]:
        return model
    model.weight = np.linalg.solve(gram[:-1, :-1] + ridge * gram[-2, -2] * np.eye(len(gram) - 1) / 10, gram[:-1, -1])

    def raw(batches):
        for b in batches:
            at = np.clip(np.rint((model.raw(matrix(b.column("stats"))) + 0.5) / 2 * BINS), 0, BINS)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32(), safe=False), b.column("y")], names=["bin", "y"])

    bins = labelled.filter("_calibrate").select("stats", "y").mapInArrow(raw, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    model.edges, model.levels = isotonic([(r.bin / BINS * 2 - 0.5, r.n, r.y) for r in bins]) if bins else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def isotonic(bins: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (score, rows, positive rows) in ascending order: centres and levels of the blocks."""
    blocks: list[list[float]] = []
    for x, n, y in bins:
        blocks.append([x * n, n, y])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([(b[2] + 0.5) / (b[1] + 1) for b in blocks])


def score_of(model: KernelModel, stats: str) -> Column:
    """The score of a column of statistics."""

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(column)), pa.float64())

    return of(F.col(stats))


def mean_labels(labels: DataFrame, col: str) -> DataFrame:
    """doc_id, y: a document's mean label; rows with a null id or label don't count."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col(col).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(col).cast("double")).alias("y"))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id and score in [0, 1] of every row of docs (doc_id, text). Labels (doc_id, quality) are learned where
    `learn`, an expression of doc_id, holds; one in five of those rows calibrates. A null text counts as empty, and
    empty texts are scored by their statistics, which are zeros. Rows that repeat an id keep their own scores; other
    columns are dropped. Without labels every score is 0.5; an empty table gives an empty result."""
    stats = durable(docs.select("doc_id", statistics_of("text").alias("stats")), "quality-stats")
    labelled = durable(stats.filter(learn).join(mean_labels(labels, "quality"), "doc_id"), "quality-labelled")
    model = fit(labelled, F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    return stats.select("doc_id", score_of(model, "stats").alias("score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; the fold crc32(doc_id) mod 4 = 2 is held out, 0.7 and more is good."""
    held = id_crc() % 4 == 2
    out = quality_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

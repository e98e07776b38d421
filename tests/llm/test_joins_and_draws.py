"""Hard negatives, the similarity join and the draw towards a target, against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from entiloom.llm import hard_negatives, importance, near_dups, parity_join
from tests.llm.fixtures import awkward, frame, tables, words
from tests.llm.test_operators import brute_components

VECTORS = "vec_id long, embedding array<float>, label int, v string, score double"


def brute_negatives(rows, anchors, positives=5, k=5):
    fine = [(i, lab, [math.floor(256 * x) for x in e]) for i, e, lab in rows if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for a in {(i, lab, tuple(v)) for i, lab, v in fine if anchors(i)}:
        told = [(clip(sum(x * y for x, y in zip(a[2], v, strict=True))), i, lab) for i, lab, v in fine if len(v) == len(a[2])]
        best = sorted((-s, i) for s, i, lab in told if lab == a[1] and i != a[0])[:positives]
        for s, i in best:
            inside = sorted((-t, j) for t, j, lab in told if lab != a[1] and 80 * -s <= 100 * t <= 100 * -s)[:k]
            out += [(a[0], i, n, j, -s, -t) for n, (t, j) in enumerate(inside, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    """Ties, repeated rows, a vector that fills a third of the table, nulls, components that aren't finite, mixed lengths,
    components whose products don't fit in 64 bits; several blocks of anchors."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    r = random.Random(11)
    rows = [(i, [r.choice((-0.5, 0.25, 0.5, 0.3)) for _ in range(5)], r.randrange(3)) for i in range(120)]
    rows += [(200 + i, [0.5] * 5, i % 3) for i in range(80)] + rows[:6] + [(0, [0.1] * 5, 2), (500, [0.5, 0.25], 0), (510, [0.5, 0.5], 0), (511, [0.75, 0.0], 1), (520, [], 0), (521, [], 0), (522, [], 1)]
    rows += [(530, None, 1), (531, [0.5] * 5, None), (None, [0.5] * 5, 1), (532, [0.5, None, 0.5, 0.5, 0.5], 1), (533, [float("nan")] * 5, 1), (534, [float("inf")] * 5, 1)]
    rows += [(540, [3e38] * 3, 0), (550, [3e38, 1.0, 0.0], 0), (551, [3e38, 0.0, 1.0], 1), (552, [-3e38] * 3, 1), (560, [1e15, 0.0, 3.0], 0), (561, [1e15, 1.0, 3.0], 1)]
    df = spark.createDataFrame([(*x, "mine", 0.5) for x in rows], VECTORS).repartition(5)
    got = found(hard_negatives.hard_negatives(hard_negatives.whole_vectors(df), F.col("vec_id") % 10 == 0))
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and len(got) > 300


def test_hard_negatives_of_nothing(spark, tmp_path):
    q = __spark_entry__.queries()["op11_hard_negatives"]
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert q(spark, str(tmp_path)).collect() == []
    spark.createDataFrame([(1, [0.5], 1, "x", 0.0), (2, [0.5], 2, "x", 0.0)], VECTORS).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    assert q(spark, str(tmp_path)).collect() == []  # no anchor


def test_pairs_within_the_bound_share_a_kept_block():
    rng = np.random.default_rng(12)
    for percent in (85, 80, 60):
        for _ in range(400):
            a = int(rng.integers(2, 400))
            x = np.unique(rng.integers(0, 1 << 63, a, dtype=np.uint64))
            most = parity_join.difference(len(x), len(x), percent)
            out, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
            y = np.unique(np.concatenate([rng.permutation(x)[: max(1, len(x) - out)], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            common = len(np.intersect1d(x, y))
            differ = len(x) + len(y) - 2 * common
            bits = np.unpackbits(parity_join.parity(x).view(np.uint8)) != np.unpackbits(parity_join.parity(y).view(np.uint8))
            assert bits.sum() <= differ
            if 0 < differ and 100 * common >= percent * (len(x) + len(y) - common):
                assert np.intersect1d(parity_join.kept_blocks(x, percent), parity_join.kept_blocks(y, percent)).size


@pytest.mark.parametrize("percent", [85, 70])
def test_join_equals_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(parity_join, "LAST", 8)  # so that squares of classes are used too
    r = random.Random(percent)
    rows = []
    for g in range(6):
        base = words(r.choice((9, 40, 150)), 100 + g).split()
        for _ in range(30):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 20))):
                x[r.randrange(len(x))] = f"new{r.randrange(10**6)}"
            rows.append(" ".join(x[: len(x) - r.randint(0, len(x) // 12)]))
    rows += ["", None, " \n", "One two", "one  TWO", "one two three four", "one two three four five", "x", "X"] + rows[:9]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parity_join.jaccard_join(frame(spark, rows), percent).collect()}
    assert got == brute_components(rows, percent)


def test_rows_that_share_an_id_are_linked_by_their_texts(spark):
    a, b = words(60, 1), words(60, 2)
    rows = [(5, a), (5, b), (3, b), (None, a), (None, words(9, 3)), (2, a), (2, a), (None, None)]
    got = collections.Counter((x.doc_id, x.component_id) for x in parity_join.jaccard_join(frame(spark, rows)).collect())
    assert got == {(5, 2): 1, (5, 3): 1, (3, 3): 1, (None, 2): 1, (None, None): 2, (2, 2): 2}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def runs(x, least, most):
    w = WORD.findall(lower(x))
    return len(w), [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def brute_draw(rows, target, least=1, most=1, percent=10, least_words=20, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, x in rows for f in runs(x, least, most)[1])
    t = collections.Counter(bucket(f) for x in target for f in runs(x, least, most)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, long = [], []
    for k, (i, x) in enumerate(rows):
        n, f = runs(x, least, most)
        weight = sum(map(gain, map(bucket, f))) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if n >= least_words:
            long.append((-score, i is None, i or 0, k))
    for place, (*_, k) in enumerate(sorted(long)[: percent * len(long) // 100], 1):
        out[k][4] = place
    return out


@pytest.mark.parametrize(("least", "most", "percent"), [(1, 1, 10), (1, 3, 50), (2, 2, 100)])
def test_draw_equals_brute_force(spark, least, most, percent):
    rows = [*awkward(), *[(20 + i, words(15 + i % 17, i % 40)) for i in range(300)], (400, "Ünïcode WÖRTER " * 15 + "z" * 300 + " " + "z" * 64), (401, "a\x00b\x7fc d-e")]
    target = [words(50, 9), None, "", "ünïcode " * 30]
    got = importance.resampled(frame(spark, rows).repartition(7), spark.createDataFrame([(x,) for x in target], "text string"), percent, least=least, most=most).collect()
    want = brute_draw(rows, target, least, most, percent)
    plain = lambda x: sorted(map(str, x))
    # rows equal in id and text may change places with each other
    assert plain([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in got) == plain(want)


def test_words_do_not_run_from_text_to_text():
    texts = pa.array(["ab", "cd", "", "e f", "g"])
    data, offsets = importance.utf8(texts)
    doc, bucket, n = importance.features(data, offsets, 1, 2, 10_000)
    assert n.tolist() == [1, 1, 0, 2, 1]
    assert sorted(zip(doc.tolist(), bucket.tolist(), strict=True)) == sorted((d, zlib.crc32(f) % 10_000) for d, f in [(0, b"ab"), (1, b"cd"), (3, b"e"), (3, b"f"), (3, b"e f"), (4, b"g")])
    part, at = importance.utf8(texts.slice(1, 3))
    assert bytes(part) == b"cde f" and at.tolist() == [0, 2, 2, 5]


def test_a_hot_score_is_numbered_in_many_tasks(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), F.lit(7).alias("s"))
    got = importance.numbered(rows, [F.desc("s"), F.col("k")], "rank").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 3001)) and max(r["rank"] for r in got if r.k == 0) == 1500


@pytest.mark.parametrize("name", ["op12_jaccard_join", "op13_importance"])
def test_awkward_and_empty_tables(spark, tmp_path, name):
    q = __spark_entry__.queries()[name]
    rows = awkward()
    got = q(spark, tables(spark, tmp_path / "a", rows, [], [(0, words(40, 9)), (1, None), (1, "")])).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    if name == "op12_jaccard_join":
        least = {r.doc_id: r.component_id for r in got if r.doc_id is not None and r.doc_id != 7}
        assert least == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 8: 8}
    assert q(spark, tables(spark, tmp_path / "e", [])).collect() == []


def test_links_of_no_pairs(spark):
    assert near_dups.components(spark.createDataFrame([], "a binary, b binary")).collect() == []

"""Whole queries, and the pipeline, against plain Python on small tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from entiloom.llm import decontamination, near_dups, pii, quality_kernel, sharding
from tests.llm.fixtures import awkward, frame, tables, words

SMALL = "/root/testdata/sf0.001"
DOCS = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
LABELS = pq.read_table(f"{SMALL}/labels.parquet").to_pylist()


def query(spark, name, folder=SMALL):
    return __spark_entry__.queries()[name](spark, folder).collect()


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.no_padding()
    t.no_truncation()
    return t


def long_hash(value, seed, size):
    """Spark's xxhash64 of one int or long, whose seed is the hash before it."""
    return xxhash.xxh64_intdigest(int(value).to_bytes(size, "little", signed=True), seed & (1 << 64) - 1)


def rendezvous(key, shards):
    def height(i):
        h = long_hash(key, long_hash(i, 42, 4), 8)
        return -1 / math.log(((h >> 11) + 0.5) * 2.0**-53)

    return max(range(shards), key=lambda i: (height(i), -i))


def test_op1_equals_brute_force(spark):
    got = {r.doc_id: r for r in query(spark, "op1_sharding")}
    for d in DOCS:
        raw, r = (d["text"] or "").encode(), got[d["doc_id"]]
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (rendezvous(d["doc_id"], 16), rendezvous(d["doc_id"], 17))
    for s, rows in itertools.groupby(sorted(got.values(), key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert [r.slot for r in rows] == list(range(sum(x.shard == s for x in got.values())))
    (none,) = sharding.assign_shards(spark.createDataFrame([(5, None)], "doc_id long, text string")).collect()
    assert (none["size"], none.text_crc32, none.slot) == (1, 0, 0)


def test_op3_and_op6_equal_the_library(spark):
    lib, other = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    little = lambda ids: np.array(ids, "<u4").tobytes()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    three, six, start = {r.doc_id: r for r in query(spark, "op3_bpe")}, {r.doc_id: r for r in query(spark, "op6_token_files")}, 0
    for d in sorted(DOCS, key=lambda d: d["doc_id"]):
        text = d["text"] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        r = three[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(little(ids)), sha(lib.decode(ids, skip_special_tokens=False).encode()))
        ids = [*other.encode(text, add_special_tokens=False).ids, 2]
        r = six[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(little(ids)))
        start += len(ids)


EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    def luhn(d):
        twice = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
        return sum(twice) % 10 == 0

    digits = lambda m: "".join(c for c in m.group() if c in "0123456789")
    return (
        [(0, *m.span()) for m in EMAIL.finditer(text)] + [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        + [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))] + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    )


def test_op5_base_spans_equal_the_plain_expressions(spark):
    told = {r.doc_id: r for r in query(spark, "op5_pii")}
    for d in DOCS:
        base = plain_spans(d["text"] or "")
        form = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        r = told[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(form.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(form.split(",") if form else []) <= set(spans) and len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone
    r = random.Random(4)
    for _ in range(4000):
        text = "".join(r.choice("a@.-0159+ ()_é%") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["a" * 1_000_000 + " @", "1" * 1_000_000, "a." * 500_000 + "@", "1." * 500_000, "+1" + "(" * 1_000_000, "@" * 1_000_000, "(at)x" * 200_000, "1 " * 500_000, "a@b." * 250_000], ids=lambda t: t[:6])
def test_pii_takes_linear_time(text):
    began = time.process_time()
    pii.extracted(text)
    assert time.process_time() - began < 8


def test_patterns_have_whole_words():
    word = "q" * 500
    assert pii.context(f"the {word} +1 212 555 0100 now", 505, 520) == [hashlib.md5(f"the {word} _".encode()).hexdigest(), hashlib.md5(f"{word} _ now".encode()).hexdigest()]
    assert pii.context("call me" + " " * 300 + "X", 307, 308) == ["call me _"]
    assert pii.candidates("mail joe (at) host (dot) org or 212-555-0199 or 12345", 0, 53) == [(1, 5, 29), (8, 33, 45)] or pii.candidates("mail joe (at) host (dot) org or 212-555-0199 or 12345", 0, 53) == [(1, 5, 28), (8, 32, 44)]


def test_op8_fit_equals_plain_least_squares(spark):
    rng = np.random.default_rng(3)
    d = len(quality_kernel.STATS)
    x = rng.normal(size=(300, d))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "doc_id long, stats array<double>, y double")
    model = quality_kernel.fit(df, F.col("doc_id") % 5 == 0, features=40)
    learn = np.arange(300) % 5 != 0
    z = model.features(x[learn])
    want = np.linalg.solve(z.T @ z + 1e-4 * len(z) * np.eye(z.shape[1]), z.T @ y[learn])
    assert np.allclose(model.weight, want, atol=1e-6) and np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    score = model.score(x[~learn])
    order = np.argsort(model.raw(x[~learn]))
    assert np.all(np.diff(score[order]) >= -1e-12) and ((score > 0.5) == (y[~learn] > 0.5)).mean() > 0.8
    many = quality_kernel.KernelModel(np.zeros(d), np.ones(d), rng.normal(0, 1 / 6, (d, 20_000)), rng.uniform(0, 2 * np.pi, 20_000), np.zeros(1), np.zeros(1), np.zeros(1))
    a, b = np.clip(x[:20], -6, 6), np.clip(x[20:40], -6, 6)
    kernel = np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * 36))
    assert np.abs(many.features(x[:20])[:, :20_000] @ many.features(x[20:40])[:, :20_000].T - kernel).max() < 0.05


def test_op9_base_counts(spark):
    got = {r.doc_id: r for r in query(spark, "op9_quality_rules")}
    for d in DOCS:
        x = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})
        lines = [z for z in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", z)]
        r = got[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), again)
        assert r.base_failed == (len(w) < 50 or 100 * again > 50 * len(w)) and not (r.kept and r.base_failed)


def test_numbers_with_marks_and_names_in_capitals_are_slots(spark):
    item = "In the shop Ann paid 1,250 dollars for three lamps that weigh 3.5 kg each, and BOB Li took twelve more of them home"
    docs = [
        "so: " + item.replace("1,250", "900").replace("three", "seven").replace("3.5", "7").replace("BOB", "ANNA").replace("twelve", "40") + ".",
        item.replace("Ann paid", "Ann Lo paid"), item.replace("lamps", "old lamps for the kitchen, and lamps"), "nothing like it",
    ]
    got = decontamination.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert 0 in {r.doc_id for r in got} and 3 not in {r.doc_id for r in got}
    assert {r.coverage for r in got if r.doc_id == 0} == {1.0}


def test_products_of_many_small_sets_stay_small():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 900, r.integers(1, 6), dtype=np.uint64)) for _ in range(700)]
    got = near_dups.common_counts(sets[:400], sets[400:])
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[400 + j])) for i in range(0, 400, 37) for j in range(0, 300, 29))
    near_dups_cells = near_dups.CELLS
    try:
        near_dups.CELLS = 7000  # ten shingles at a time
        assert np.array_equal(got, near_dups.common_counts(sets[:400], sets[400:]))
    finally:
        near_dups.CELLS = near_dups_cells


CLASH = "doc_id long, text string, text_key string, row_key string, stats string, pii_row string, pii_found string, pii_spans string, _key string, n_chars long"


def clash(spark, rows):
    return spark.createDataFrame([(i, t, "k", "r", "s", "p", "f", "q", "mine", len(t or "")) for i, t in rows], CLASH)


def brute_near(rows, percent=80, width=5):
    """Numbers of the rows that stay: one of each group of linked texts, that of the least (no id, id)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = collections.defaultdict(list)
    for i, s in enumerate(sets):
        groups[("alone", i) if not s else find(i)].append(i)
    return [{rows[i] for i in g} for g in groups.values()]


def test_near_duplicate_stage_keeps_rows_that_share_an_id(spark):
    red, blue, green, long = words(40, 1), words(40, 2), words(40, 3), words(200, 4)
    rows = [(7, red), (7, blue), (8, green), (7, red), (None, blue), (None, words(30, 9)), (None, words(30, 9)), (3, red + " one"), (4, ""), (4, ""), (None, None), (9, long), (2, long.upper()), (1, "x"), (5, "X")]
    got = corpus_pipeline.near_duplicates(spark, clash(spark, rows), SMALL)
    assert got.columns == clash(spark, []).columns
    out = got.collect()
    groups = brute_near(rows)
    assert len(out) == len(groups)
    for g in groups:
        least = min(g, key=lambda r: (r[0] is None, r[0] or 0))
        kept = [(r.doc_id, r.text) for r in out if (r.doc_id, r.text) in g]
        assert {k[0] for k in kept} == {least[0]}
    assert {(r.text_key, r.row_key, r._key) for r in out} == {("k", "r", "mine")}


def test_stages_leave_columns_and_clean_rows_alone(spark, tmp_path):
    rows = [(i, words(60, i)) for i in range(6)] + [(3, None), (None, ""), (4, words(60, 4)), (5, "write to a.b@c.example.org now")]
    folder = tables(spark, tmp_path / "none", rows, [], [(1, words(30, 900))])  # nothing to learn from
    docs = clash(spark, rows)
    for name in ("quality", "decontaminate", "mask_pii"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
        assert out.columns == docs.columns
        want = collections.Counter((i, t if name != "mask_pii" or t is None else t.replace("a.b@c.example.org", "<EMAIL>")) for i, t in rows)
        assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == want
        assert {(r.pii_row, r.pii_found, r.pii_spans, r.stats, r.text_key) for r in out.collect()} == {("p", "f", "q", "s", "k")}
    assert {r.n_chars == len(r.text or "") for r in corpus_pipeline.mask_pii(spark, docs, folder).collect()} == {True}
    tokens = corpus_pipeline.encode(spark, docs, folder).collect()
    lib = library("byte_bpe_50k.json")
    assert collections.Counter(bytes(r.token_ids) for r in tokens) == collections.Counter(np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for _, t in rows)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Labels make long texts of many words good and texts of one word bad; an item leaks into one good row."""
    good = [(100 + i, words(80 + i % 9, 50 + i)) for i in range(60)]
    bad = [(200 + i, " ".join([f"w{i % 7}"] * 80)) for i in range(60)]
    leaked = (300, words(20, 800) + " " + words(30, 801) + " " + words(20, 802))
    rows = [*good, *bad, leaked, (301, good[0][1]), (301, words(90, 998)), (None, words(90, 999)), *awkward()]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    folder = tables(spark, tmp_path / "t", rows, labels, [(1, words(30, 801))])
    out = __spark_entry__.queries()["pipeline"](spark, folder).collect()
    ids = collections.Counter(r.doc_id for r in out)
    assert all(ids[i] == 1 for i, _ in good) and not any(ids[i] for i, _ in bad) and not ids[300]
    assert ids[301] == 1 and ids[None] >= 1


def test_row_keys_tell_null_from_empty(spark):
    from entiloom.llm.common import row_key, text_key

    rows = spark.createDataFrame([(None, None), (None, ""), (1, None), (1, ""), (1, "a")], "doc_id long, text string")
    assert rows.select(row_key("doc_id", "text")).distinct().count() == 5 and rows.select(text_key("text")).distinct().count() == 2


def test_fixture_frame(spark):
    assert frame(spark, awkward()).count() == len(awkward()) and pa.__version__

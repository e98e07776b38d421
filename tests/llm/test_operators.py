import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from entiloom.llm import bpe, decontamination, near_dups, pii, quality_kernel, quality_rules, sharding, suffix_dedup, token_files, toxicity
from tests.llm.fixtures import awkward, frame, tables, words

SMALL = "/root/testdata/sf0.001"
OPS = ["op1_sharding", "op2_suffix_dedup", "op3_bpe", "op4_toxicity", "op5_pii", "op6_token_files", "op7_decontamination", "op8_quality", "op9_quality_rules", "op10_near_dups", "pipeline"]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.no_padding()
    t.no_truncation()
    return t


@pytest.mark.parametrize("name", OPS)
def test_awkward_and_empty_tables(spark, tmp_path, name):
    q = __spark_entry__.queries()[name]
    rows = awkward()
    got = q(spark, tables(spark, tmp_path / "a", rows, [(0, 1, 0), (1, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], [(0, words(40, 9)), (1, None), (1, "")])).collect()
    if name == "op7_decontamination":
        assert got == []
    elif name != "pipeline":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert q(spark, tables(spark, tmp_path / "e", [])).collect() == []


def test_shards_follow_the_key_law(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text é "), (F.col("id") % 7).cast("string")).alias("text"))
    rows = sharding.assign_shards(docs, weights=(1.0,) * 15 + (3.0,)).collect()
    count = collections.Counter(r.shard for r in rows)
    assert set(count) == set(range(16)) and 2 < count[15] / (sum(count.values()) - count[15]) * 15 < 4.5
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and any(r.grown_shard == 16 for r in rows)
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    one = rows[0]
    text = f"text é {one.doc_id % 7}".encode()
    assert (one.size, one.text_crc32) == (len(text) + 1, zlib.crc32(text))


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cut[i : i + length] = True
        spans = int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum())
        out.append((len(b), int(cut.sum()), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut, strict=True) if not c)).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    r = random.Random(5)
    base = "".join(r.choice("ab c") for _ in range(2500))
    texts = ["a" * 1200, "a" * 399, "a" * 400, None, "", base[:900] + "é" + base[900:1500], "abc" * 300]
    for _ in range(25):
        x = list(base[r.randint(0, 800) :][: r.randint(100, 1500)])
        for _ in range(r.randint(0, 5)):
            x[r.randrange(len(x))] = "z"
        texts.append("".join(x))
    got = {x.doc_id: (x.n_bytes, x.n_bytes - len(x.kept), len(x.removed), hashlib.sha256(x.kept).hexdigest()) for x in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 400)


TRICKY = "aab \n\t\r\x1c\x85\xa0 ​́éÉ1²½٣中文'sS’!?😀　﻿\x00\x0bΣσ."


def tricky(n=1500):
    r = random.Random(3)
    return ["".join(r.choice(TRICKY) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", "a" * 99, " " * 50, "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|startoftext|>", "it's 'tis ,'s"]


def test_bpe_equals_the_library():
    path, lib = P.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    mine, texts = bpe.MergeTable(path), tricky()
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new stretches, then known ones
        got = mine.encode(texts)
        assert [x.tolist() for x in got] == want
    assert [mine.decode(x) for x in got] == [lib.decode(x, skip_special_tokens=False) for x in want]
    assert mine.decode(np.array([200, 201, 5])) == lib.decode([200, 201, 5], skip_special_tokens=False)


def test_bpe_decode_of_stored_ids(spark):
    path = P.path("byte_bpe_50k.json")
    docs = frame(spark, awkward())
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text", F.coalesce("text", F.lit("")).alias("was")), path), path)
    assert back.filter("decoded != was").count() == 0


def test_cached_words_equal_the_library():
    lib, texts = library("word_bpe_49k.json"), tricky()
    got = token_files.cache(P.path("word_bpe_49k.json")).encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1)  # a block for each document
    v = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1] * 5)
    control, payload = token_files.pack(v)
    assert token_files.unpack(control, payload, len(v)).tolist() == v.tolist()
    docs = [(i, words(i % 50, i)) for i in (5, 3, 9, 1, 7)] + [(4, None)]
    token_files.write_token_files(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "t"), P.path("word_bpe_49k.json"), 2)
    lib, at = library("word_bpe_49k.json"), 0
    blocks = spark.read.parquet(str(tmp_path / "t" / "blocks"))
    assert blocks.count() > blocks.select("shard").distinct().count() and blocks.filter("begin > 0").count()
    back = token_files.read_token_files(spark, str(tmp_path / "t"))
    moved = [x for x in back._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("\n") if "Exchange" in x]
    assert len(moved) == 3 and sum("BroadcastExchange" in x for x in moved) == 1, moved  # lengths by shard, a row for each; no ids
    got = {r.doc_id: r for r in back.collect()}
    for i, t in sorted(docs):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, list(struct.unpack(f"<{len(ids)}I", got[i].ids))) == (at, ids)
        at += len(ids)


def brute_toxicity(texts, labels, ids, k):
    """Scores and neighbours of all texts from plain dictionaries; the examples are the labelled texts, each once."""
    words_of = lambda t: collections.Counter(re.findall(r"\w+", (t or "").lower()))
    df = collections.Counter(w for t in texts for w in words_of(t))
    n1, n0 = sum(labels.values()), sum(1 - y for y in labels.values())
    share = n1 / (n1 + n0)
    have = {y: collections.Counter(w for i, v in labels.items() if v == y for w in words_of(texts[i])) for y in (0, 1)}

    def weight(w):
        if not have[0][w] and not have[1][w]:
            return 0.05 * math.log((1 + len(texts)) / 2)
        odds = math.log((have[1][w] + 20 * share) / (have[0][w] + 20 * (1 - share)) * (1 - share) / share)
        return max(1e-3, math.log((1 + len(texts)) / (1 + df[w]))) * max(odds**2, 0.05)

    def unit(t):
        x = {w: (1 + math.log(n)) * weight(w) for w, n in words_of(t).items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        return {w: v / norm for w, v in x.items()}

    examples = {i: unit(texts[i]) for i in labels}
    out = []
    for t in texts:
        x = unit(t)
        cos = sorted(((sum(v * e.get(w, 0) for w, v in x.items()), ids[i]) for i, e in examples.items()), reverse=True)
        cos = [(c, i) for c, i in cos if c > 0][:k]
        vote = sum(c * c for c, _ in cos)
        out.append(((sum(c * c for c, i in cos if labels[ids.index(i)]) + 0.05 * share) / (vote + 0.05) if cos else None, cos))
    return out


def test_toxicity_equals_brute_force(spark):
    texts = [words(60, i) + (" vile rotten " + words(20, i + 5000) if i % 2 else "") for i in range(300)] + ["", "unheardof words", "vile", None]
    labels = {i: i % 2 for i in range(240)}
    ids = [7 * i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(ids[i], y) for i, y in labels.items()], "doc_id long, y int"), block=8)
    want = brute_toxicity(texts, labels, ids, 15)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, index, 15, evidence=15).collect()}
    for i, (score, cos) in zip(ids, want, strict=True):
        assert np.allclose(got[i].cosines, [c for c, _ in cos], atol=1e-5)
        if score is not None:
            assert abs(got[i].score - score) < 1e-4
        sure = {j for c, j in cos if not cos or c > cos[-1][0] + 1e-5}  # equal cosines at the end may change places
        assert sure <= set(got[i].neighbours)
    assert min(got[ids[i]].score for i in range(241, 300, 2)) > 0.5 > max(got[ids[i]].score for i in range(240, 300, 2))
    assert got[ids[300]].neighbours == [] and 0 < got[ids[300]].score < 1 and got[ids[303]].score == got[ids[300]].score
    bins = collections.defaultdict(list)  # calibration on rows that taught nothing
    for i in range(240, 300):
        bins[round(got[ids[i]].score, 1)].append((got[ids[i]].score, i % 2))
    assert sum(abs(sum(s - y for s, y in v)) for v in bins.values()) / 60 < 0.15


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_class(spark, label):
    docs = frame(spark, [(i, words(30, i)) for i in range(40)] + [(40, ""), (41, None)])
    index = toxicity.fit(docs, spark.createDataFrame([(i, label) for i in range(20)], "doc_id long, y int"))
    assert {(r.score >= 0.5) for r in toxicity.toxicity_scores(docs, index).filter("doc_id < 40").collect()} == {bool(label)}
    labels = spark.createDataFrame([(i, label, label) for i in range(20)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality_kernel.quality_scores(docs, labels, F.lit(True)).collect())
    assert quality_rules.apply_rules(docs, labels).filter("rule > 0").count() == 0


def test_pii_base_and_bootstrap(spark):
    texts = ["mail a.b@c-d.example.com, ip 10.0.0.256 and 10.0.0.255", "4111 1111 1111 1111 and +1 (017) 555-7713", "1.2.3.4.5 x@y z@w.v.u", None, "+1 2 3", "4111111111111112"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: [(0, 5, 24), (1, 44, 54)], 1: [(2, 0, 19), (3, 24, 41)], 2: [(0, 14, 21), (1, 0, 7)], 3: [], 4: [], 5: []}
    seeds = [(i, f"please call me now +1 (212) 555-{1000 + i} before noon") for i in range(30)]
    new = [(99, "please call me now 212-555-0199 before noon"), (98, "chapter 2000-2010-5 of the book")]
    found = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(seeds + new, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in found[99].spans] == [(3, 19, 31)] and found[98].spans == [] and found[99].base == []
    masked = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(seeds + new, "doc_id long, text string")).collect()}
    assert masked[99] == masked[5] == "please call me now <PHONE> before noon" and masked[98] == new[1][1]


def test_pii_patterns_grow_from_confirmed_ones(spark):
    base = [f"please call me on +1 212 555 {i:04d} today" for i in range(30)]
    first = [f"please call me on 212-555-{i:04d} today" for i in range(100, 110)]
    again = [f"my old pager is 212-555-{i:04d} these days" for i in range(100, 110)]  # a context of no base span
    second = ["my old pager is 212-555-0999 these days", "seen once: 212-555-0999.", "host 10.0.0.1 212-555-0100"]
    free = ["order number 555-123-4567 shipped"]
    texts = base + first + again + second + free
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {texts[r.doc_id]: {texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == 3} for r in rows}
    assert all(got[t] == {t.split(" on ")[1].split(" ")[0]} for t in first)
    assert all(got[t] == {t.split(" is ")[1].split(" ")[0]} for t in again)
    assert [got[t] for t in second] == [{"212-555-0999"}, {"212-555-0999"}, {"212-555-0100"}] and got[free[0]] == set()


def test_templates_catch_new_slots_only_if_consistent(spark):
    item = [(1, "A train leaves Paris at 5 km per hour and Bob waits 30 minutes for the train to reach Rome before noon, says Bob, today in the rain."), (2, "too short"), (3, None)]
    docs = [
        (1, "So. A train leaves London at 7 km per hour and Eve waits 45 minutes for the train to reach Oslo before noon, says Eve, today in the rain. End"),
        (2, "nothing of that kind is here"), (3, None), (4, item[0][1]), (4, item[0][1]),
    ]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (4, 1)] and all(r.agreement == 1 for r in got)


def test_leaks_are_judged_where_a_copy_is_aligned(spark):
    clauses = "Ann buys 5 red apples for 3 dollars each and 7 red apples for 4 dollars each and 9 red apples for 6 dollars each and then goes home"
    pupils = "The class has 30 pupils and nobody of them came late today because the bus was early"
    table = "sums of " + " ".join(map(str, range(10, 40)))
    twice = "walk 40 steps with Bob to the river bank and then walk back 40 steps to the old house again"
    items = [(1, clauses), (2, pupils), (3, table), (4, twice)]
    other = clauses.replace("5 red", "8 red").replace("4 dollars", "3 dollars")
    docs = [
        (1, "see " + clauses + " end"),  # templates that repeat in the item
        (2, "the class has 25 pupils and nobody came. " + pupils + " end"),  # a part before the copy
        (3, "see " + pupils.replace("of them", "of all of them") + " and the class has 31 pupils and nobody of them left"),
        (4, "see " + clauses.replace("each and 7", "each, and also 7") + " end"),  # words put in
        (5, "see " + clauses.replace("Ann buys 5", "Ann buys 8").replace("red", "old") + " end"),  # too few windows
        (6, "start " + " ".join(str(5 + i % 7) for i in range(3000)) + " " + table + " " + " ".join(str(90 - i % 5) for i in range(3000))),
        (7, "see " + other + ". Then see " + clauses),  # another copy first
        (8, "see " + clauses.replace("5 red", "8 red").replace("4 dollars", "2 dollars") + " end"),  # other values, each for one of the item's
        (9, "the class has 30 pupils and nobody"),
        (10, "see " + twice.replace("Bob", "Eve").replace(" 40 steps", " 50 steps", 1)),  # one value stands for two
    ]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (3, 2), (4, 1), (6, 3), (7, 1), (8, 1)]
    assert all(r.agreement == 1 for r in got)


def test_leaks_equal_brute_force_on_plain_words(spark):
    items = [(i, words(30, 700 + i)) for i in range(10)]
    docs = [(i, words(50, i) + " " + (items[i % 10][1] if i % 3 == 0 else " ".join(items[i % 10][1].split()[:20])) + " " + words(50, i + 90)) for i in range(40)]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i % 10) for i in range(0, 40, 3)}


def test_quality_scores_on_held_out_rows(spark):
    good = [(i, words(90, i).capitalize() + ".") for i in range(0, 400, 2)]
    bad = [(i, "### " + " $$$ ".join([words(1, i)] * 60)) for i in range(1, 400, 2)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality_kernel.quality_scores(docs, labels, F.col("doc_id") < 300).filter("doc_id >= 300").collect()
    assert all(0 <= r.score <= 1 and (r.score >= 0.7) == (r.doc_id % 2 == 0) for r in got)


def test_isotonic():
    x, y = quality_kernel.isotonic([(0.1, 10, 1), (0.2, 10, 5), (0.3, 10, 3), (0.4, 10, 9)])
    assert list(x) == [0.1, 0.25, 0.4] and all(np.diff(y) > 0)


def base_counts(x):
    x = x or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [z for z in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", z)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_brute_force(spark):
    texts = [t for _, t in awkward()] + ["a b c a b c", "x x x x", "a\na\n \na", "é #|é", "one two three one two three four"]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [base_counts(t) for t in texts]


def test_rules_are_learned(spark):
    docs = frame(spark, [(i, words(80, i) if i % 2 else " ".join(w + "%%%" for w in words(80, i).split())) for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert quality_rules.apply_rules(docs, labels).filter((F.col("rule") > 0) != (F.col("doc_id") % 2 == 0)).count() <= 2  # cuts are quantiles


def brute_components(rows, percent=80, width=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "LAST", 8)  # so that the blocks of large regions are used too
    r = random.Random(2)
    rows = []
    for g in range(8):
        base = words(150, 100 + g).split()
        for _ in range(25):
            x = list(base)
            for _ in range(r.randint(0, 9)):
                x[r.randrange(len(x))] = f"new{r.randrange(10**6)}"
            rows.append(" ".join(x))
    rows += ["", None, "One two", "one  TWO", "one two three four", "x", "X"]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)], "a binary, b binary")
    assert {bytes(r.root) for r in near_dups.components(links).collect()} == {bytes([0])}


def test_components_of_a_long_chain_of_random_keys(spark):
    r = random.Random(226)
    keys = [r.randbytes(16) for _ in range(1000)]
    links = [(a, b) for a, b in zip(keys, keys[1:], strict=False)] + [(b"\xff" + keys[0], b"\xff" + keys[1])]
    r.shuffle(links)
    got = {bytes(x.key): bytes(x.root) for x in near_dups.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    other = [b"\xff" + keys[0], b"\xff" + keys[1]]
    assert got == {k: min(keys) for k in keys} | {k: min(other) for k in other}


def test_pipeline_stages(spark):
    import corpus_pipeline
    from entiloom.llm.common import durable, read

    docs = read(spark, SMALL, "documents")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, SMALL))
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "near_duplicates":
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            found = brute_components(kept, width=5)
            assert all(found[i][1] == i for i, _ in kept)
    assert sizes[0] > sizes[1] > sizes[2] and sizes[3] == sizes[4]
    out = corpus_pipeline.encode(spark, docs, SMALL).collect()
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in out} == want

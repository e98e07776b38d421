"""The bootstrap of identifiers against plain Python, over several generations."""

import collections
import math
import random

from entiloom.llm import pii
from tests.llm.fixtures import words


def brute_bootstrap(texts):
    """(row, kind, start, end) that plain loops confirm."""
    found = [pii.extracted(t)[1] for t in texts]
    edges = {(m["kind"], m["fits"], m["instance"], p) for ms in found for m in ms for p in m["patterns"]}
    others = {(i, f, p) for k, f, i, p in edges if k < 0}
    chosen = {}
    while True:
        known = {(p, k, i) for k, _, i, p in edges if k >= 0} | {(p, chosen[i], i) for i, _, p in others if i in chosen}
        count = collections.Counter((p, k) for p, k, _ in known)
        usable = {}
        for p in {p for p, _ in count}:
            seeds, kind = max((n, -k) for (q, k), n in count.items() if q == p)
            if seeds >= pii.LEAST_SEEDS and seeds >= pii.LEAST_SHARE * sum(n for (q, _), n in count.items() if q == p):
                usable[p] = (seeds, -kind)
        graph = {(i, p, usable[p][1]) for i, f, p in others if p in usable and f >> usable[p][1] & 1 and chosen.get(i) != usable[p][1]}
        score = dict.fromkeys(((i, k) for i, _, k in graph), 0.0)
        for _ in range(pii.ROUNDS):
            weight = {}
            for p, k in {(p, k) for _, p, k in graph}:
                mine = [score[i, k] for i, q, j in graph if (q, j) == (p, k)]
                weight[p, k] = (usable[p][0] + sum(mine)) / (usable[p][0] + len(mine) + 1)
            score = {(i, k): 1 - math.exp(sum(math.log1p(-min(weight[p, k], 0.999)) for j, p, n in graph if (j, n) == (i, k))) for i, k in score}
        best = {}
        for (i, k), v in score.items():
            if v >= pii.ACCEPT:
                best[i] = max(best.get(i, (0.0, -9)), (v, -k))
        new = {i: -b[1] for i, b in best.items() if i not in chosen}
        if not new:
            return sorted((r, chosen[m["instance"]], m["start"], m["end"]) for r, ms in enumerate(found) for m in ms if m["kind"] < 0 and m["instance"] in chosen)
        chosen |= new


def test_bootstrap_equals_plain_loops(spark):
    r = random.Random(5)
    number = lambda i: f"212-555-{i:04d}"
    texts = [f"{words(3, i)} phone: +1 (212) 555-{1000 + i} {words(2, i + 50)}" for i in range(9)]  # seeds of a label
    texts += [f"{words(3, i)} phone: {number(i)} {words(2, i + 70)}" for i in range(8)]  # confirmed by it
    texts += [f"please ring {number(i)} now" for i in range(8)]  # ... which teaches another context
    texts += [f"please ring {number(100 + i)} now, {words(2, i)}" for i in range(4)]  # ... that confirms more
    texts += [f"order no {number(200 + i)} is late" for i in range(6)] + [f'token = "{r.randrange(16**24):024x}99887766"' for _ in range(8)]
    texts += [f"mail to a{i}@b.example.org today" for i in range(6)] + ["mail to joe (at) host (dot) org today", "mail to eve [at] site [dot] com today"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((x.doc_id, s.kind, s.start, s.end) for x in pii.personal_data(rows).collect() for s in x.spans if (s.kind, s.start, s.end) not in set(pii.base_spans(texts[x.doc_id])))
    want = brute_bootstrap(texts)
    assert got == want
    said = {texts[i][s:e] for i, _, s, e in got}
    assert {number(i) for i in range(8)} | {number(100 + i) for i in range(4)} <= said and not said & {number(200 + i) for i in range(6)}
    assert {"joe (at) host (dot) org", "eve [at] site [dot] com"} <= {x.strip() for x in said}


def test_candidates_are_whole_tokens():
    text = 'token = "ede43f42c939b64057681aa" id 9807915762804490, x12345678 12345678y 12345678'
    assert [text[s:e] for _, s, e in pii.candidates(text, 0, len(text))] == ["9807915762804490", "12345678"]
    assert pii.context("his phone: 1234567", 11, 18) == ["his phone _", "phone : _"] and pii.label("a =  5", 5) == "=" and pii.label("a b 5", 4) == ""

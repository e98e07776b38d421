"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded sample of labelled examples over all their words. A word weighs (1 + ln tf) * idf * pull:
idf comes from all documents, and pull, the squared shrunken log-odds of the label among examples with the word, keeps
words that tell nothing about the label from drowning the few that do (plain idf finds texts on one subject, and
catches a quarter of what this does). No word is left out: those that no example has count in a document's norm.

Batches of documents are scored together. Postings of rarer words are added up for all examples; for frequent words,
block maxima bound what they can add in a block of examples. Blocks are opened in falling order of that bound until none
left can enter a document's k nearest, so the neighbours are exact. They vote with weights that grow with the cosine
and undo the sampling of the classes, and are returned as evidence; documents that share no word with any example get
the rate of such examples.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_crc, read, text_pieces
from .stretches import gather

TERM = re.compile(r"\w+")
#: Examples of each class in the index, neighbours that vote, examples in a block, words kept as dense columns.
EXAMPLES, NEIGHBOURS, BLOCK, DENSE = 3000, 31, 64, 512
#: Labels that stand behind the prior of a word's log-odds; the least pull, and that of words no example has.
SHRINK, LEAST_PULL = 20.0, 0.05
#: Documents and postings that a task handles at once.
BATCH, POSTINGS = 256, 1_000_000


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples by word. starts[t] : starts[t + 1] are word t's postings, in the order of examples; words
    of columns are kept in `dense` (examples, padded to whole blocks, by column) instead."""

    terms: pa.Array
    weight: np.ndarray
    unseen: float  # weight of words that no example has
    starts: np.ndarray
    example: np.ndarray
    value: np.ndarray
    column: np.ndarray  # of each word, -1: in the postings
    dense: np.ndarray
    labels: np.ndarray
    case: np.ndarray  # of each example: how many labelled rows it stands for
    ids: pa.Array  # doc_id of each example
    prior: float
    lone: float  # share of positives among the examples without any word
    block: int = BLOCK

    @functools.cached_property
    def number(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms.to_pylist())}

    @functools.cached_property
    def most(self) -> np.ndarray:
        return self.dense.reshape(-1, self.block, self.dense.shape[1]).max(1).T if len(self.dense) else np.zeros((self.dense.shape[1], 0), np.float32)

    @functools.cached_property
    def places(self) -> np.ndarray:
        return np.arange(len(self.example))

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's number, word, x) of the words in the index; x are parts of unit vectors over all words of a text."""
        doc, term, part = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for d, text in enumerate(texts):
            n = Counter(terms_of(text))
            t = np.fromiter(map(self.number.get, n, repeat(-1)), np.int64, len(n))
            x = (1 + np.log(np.fromiter(n.values(), np.float64, len(n)))) * np.where(t < 0, self.unseen, self.weight[t] if len(self.weight) else 0.0)
            known = t >= 0
            doc.append(np.full(known.sum(), d))
            term.append(t[known])
            part.append(x[known] / max(1e-12, np.sqrt((x * x).sum())))
        return np.concatenate(doc), np.concatenate(term), np.concatenate(part)

    def nearest(self, n: int, doc: np.ndarray, term: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of the k examples with the highest positive cosine of each of n texts, by text, then
        falling cosine; equal ones: the lower number first."""
        wide, blocks = len(self.dense), len(self.dense) // self.block
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if not n or not blocks:
            return none
        rare = self.column[term] < 0
        first, size = self.starts[term[rare]], (self.starts[term[rare] + 1] - self.starts[term[rare]])
        at = gather(self.places, first, size, np.arange(len(first)))
        sums = np.bincount(np.repeat(doc[rare], size) * wide + self.example[at], weights=np.repeat(x[rare], size) * self.value[at], minlength=n * wide).reshape(n, wide)
        often = np.zeros((n, self.dense.shape[1]), np.float32)
        often[doc[~rare], self.column[term[~rare]]] = x[~rare]
        bound = (sums.reshape(n, blocks, self.block).max(2) + often @ self.most) * (1 + 1e-5)
        order = np.argsort(-bound, axis=1, kind="stable")
        least = np.zeros(n)  # a text's k-th cosine so far
        found, begin, step = none, 0, 2
        while begin < blocks:
            d = np.repeat(np.arange(n), min(step, blocks - begin))
            b = order[:, begin : begin + step].ravel()
            begin, step = begin + step, step * 2  # more at a time as the bounds fall
            hope = bound[d, b]
            live = (hope > 0) & (hope >= least[d])
            if not live.any():
                break
            d, b = d[live], b[live]
            by = np.argsort(b, kind="stable")
            parts = [found]
            for same in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
                block, texts = slice(b[same[0]] * self.block, (b[same[0]] + 1) * self.block), d[same]
                cos = sums[texts, block] + often[texts] @ self.dense[block].T
                i, j = np.nonzero((cos > 0) & (cos >= least[texts][:, None]))
                parts.append((texts[i], block.start + j, cos[i, j]))
            text, who, how = (np.concatenate(v) for v in zip(*parts, strict=True))
            best = np.lexsort((who, -how, text))
            text, who, how = text[best], who[best], how[best]
            rank = np.arange(len(text)) - np.searchsorted(text, text)
            full = rank == k - 1
            least[text[full]] = how[full]
            found = text[rank < k], who[rank < k], how[rank < k]
        return found

    def score(self, texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all texts, and their neighbours as nearest() gives them."""
        doc, term, x = self.vectors(texts)
        # as many texts at a time as POSTINGS and BATCH allow
        load = np.bincount(doc, weights=(self.starts[term + 1] - self.starts[term]) if len(term) else None, minlength=len(texts))
        cuts, held, start = [0], 0.0, 0
        for i, w in enumerate(load):
            if i > start and (held + w > POSTINGS or i - start >= BATCH):
                cuts.append(i)
                held, start = 0.0, i
            held += w
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
            lo, hi = np.searchsorted(doc, [a, b])
            text, who, how = self.nearest(b - a, doc[lo:hi] - a, term[lo:hi], x[lo:hi], k)
            parts.append((text + a, who, how))
        text, who, how = (np.concatenate(v) for v in zip(*parts, strict=True))
        vote = self.case[who] * how**2
        all_, toxic = (np.bincount(text, weights=v, minlength=len(texts)) for v in (vote, vote * self.labels[who]))
        return np.where(all_ > 0, (toxic + 0.05 * self.prior) / (all_ + 0.05), self.lone), text, who, how


def no_examples(kind: pa.DataType) -> BlockMaxIndex:
    none, ints = np.zeros(0), np.zeros(0, np.int64)
    return BlockMaxIndex(pa.array([], pa.string()), none, 1.0, np.zeros(1, np.int64), ints, none, ints, np.zeros((0, 1), np.float32), none, none, pa.array([], kind), 0.5, 0.5)


def document_counts(docs: DataFrame, terms: pa.Array) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have each of the terms. A task counts what it reads; Spark adds up."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # the words of a bounded sample

    def run(batches):
        get = {t: i for i, t in enumerate(shared.value.to_pylist())}.get
        n, total = 0, np.zeros(len(shared.value), np.int64)
        for _, texts in text_pieces(batches, "text"):
            n += len(texts)
            ids = [i for x in texts for i in map(get, set(terms_of(x))) if i is not None]
            total += np.bincount(np.array(ids, np.int64), minlength=len(total))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, ids]), pa.array(np.r_[n, total[ids]])], names=["id", "n"])

    counted = docs.select("text").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, known: DataFrame, examples: int = EXAMPLES, block: int = BLOCK) -> BlockMaxIndex:
    """docs: doc_id, text; known: doc_id, y (0 or 1). At most `examples` of each class, those of the lowest hash, enter the
    index with all their words; copies of a text count once. Document frequencies come from all of docs. Without
    labelled rows the index is empty and every score is 0.5."""

    def counted(batches):
        for batch, texts in text_pieces(batches, "text"):
            n = [Counter(terms_of(x)) for x in texts]
            new = [pa.array([list(c) for c in n], pa.list_(pa.string())), pa.array([list(c.values()) for c in n], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("h", "y", "doc_id")] + new, names=["h", "y", "doc_id", "terms", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    once = durable(hashed.drop("text").join(known, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), (F.avg("y") >= 0.5).cast("int").alias("y")), "labelled")
    totals = {r.y: r.n for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pick = functools.reduce(DataFrame.unionAll, [once.filter(F.col("y") == y).orderBy("h").limit(examples) for y in (0, 1)])
    chosen = hashed.join(F.broadcast(pick), ["doc_id", "h"]).select("h", "y", "doc_id", "text").mapInArrow(counted, f"h bigint, y int, doc_id {kind}, terms array<string>, times array<int>")
    kept = durable(chosen, "examples").dropDuplicates(["h"]).orderBy("h").toArrow().combine_chunks()  # at most 2 * examples rows
    y = kept.column("y").to_numpy().astype(np.int64)
    if not len(y):
        return no_examples(kept.schema.field("doc_id").type)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    case = np.array([totals[v] / {0: n0, 1: n1}[v] for v in y.tolist()])
    lists = kept.column("terms").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    terms, term = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    example = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    times = kept.column("times").combine_chunks().flatten().to_numpy()
    n_docs, df = document_counts(docs, terms)
    share = n1 / len(y)
    a, b = (np.bincount(term, weights=(y[example] == v), minlength=len(terms)) for v in (1, 0))
    # a class without examples tells nothing: its odds are left at the prior's
    odds = np.log((a + SHRINK * share + 1e-9) / (b + SHRINK * (1 - share) + 1e-9) * (1 - share + 1e-9) / (share + 1e-9)) if n1 and n0 else np.zeros(len(terms))
    weight = np.log((1 + n_docs) / (1 + df)).clip(1e-3) * np.maximum(odds**2, LEAST_PULL)
    value = (1 + np.log(times)) * weight[term]
    norm = np.sqrt(np.bincount(example, weights=value**2, minlength=len(y)))
    # Like examples lie together, which keeps the block maxima tight: by label, then by the word of the most weight.
    lead = np.full(len(y), -1)
    heavy = np.lexsort((term, value))
    lead[example[heavy]] = term[heavy]
    moved = np.lexsort((np.arange(len(y)), lead, y))
    place = np.empty(len(y), np.int64)
    place[moved] = np.arange(len(y))
    value, example, y, case, norm = value / norm[example], place[example], y[moved], case[moved], norm[moved]
    often = np.argsort(-(a + b), kind="stable")[:DENSE]
    often = often[(a + b)[often] >= block]
    column = np.full(len(terms), -1)
    column[often] = np.arange(len(often))
    dense = np.zeros((-(-len(y) // block) * block, max(1, len(often))), np.float32)
    is_dense = column[term] >= 0
    dense[example[is_dense], column[term[is_dense]]] = value[is_dense]
    term, example, value = term[~is_dense], example[~is_dense], value[~is_dense]
    order = np.lexsort((example, term))
    lone = norm == 0
    prior = float(case @ y / case.sum())
    return BlockMaxIndex(
        terms, weight, LEAST_PULL * float(np.log((1 + n_docs) / 2).clip(1e-3)), np.searchsorted(term[order], np.arange(len(terms) + 1)), example[order].astype(np.int32), value[order].astype(np.float32),
        column.astype(np.int32), dense, y, case, kept.column("doc_id").combine_chunks().take(pa.array(moved)), prior, float((case[lone] @ y[lone] + prior) / (case[lone].sum() + 1)), block,
    )


def toxicity_scores(docs: DataFrame, index: BlockMaxIndex, k: int = NEIGHBOURS, evidence: int = 5) -> DataFrame:
    """doc_id, score in [0, 1], and the evidence: doc_ids of the nearest examples, and their cosines, the nearest first.
    A null text counts as empty and gets the score of texts without words. Each row stands alone; no shuffle. Other
    columns are dropped; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample of fit()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = shared.value
        for batch, texts in text_pieces(batches, "text"):
            score, text, who, how = model.score(texts, k)
            near = np.arange(len(text)) - np.searchsorted(text, text) < evidence
            text, who, how = text[near], who[near], how[near]
            ends = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
            names = pa.ListArray.from_arrays(ends, model.ids.take(pa.array(who)))
            new = [pa.array(score, pa.float64()), names, pa.ListArray.from_arrays(ends, pa.array(how, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new], names=["doc_id", "score", "neighbours", "cosines"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, neighbours array<{kind}>, cosines array<double>")


def mean_toxic(labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, y: the label that most of a document's rows have; rows with a null id or label don't count."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn)
    return known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, with the nearest examples; the fold crc32(doc_id) mod 5 = 0 is held out."""
    held = id_crc() % 5 == 0
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = fit(docs, mean_toxic(read(spark, sf_dir, "labels"), ~held))
    return toxicity_scores(docs, index).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines")

"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct words of a batch lie in one flat array of symbols. In each round every word merges its lowest-ranked pair,
at all places where it occurs; pairs are found by binary search over the sorted keys left * base + right. Words without
a known pair leave the array. Decoding gathers the bytes of all ids of a batch from one flat table.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_pieces, with_columns
from .stretches import Stretches, gather

#: Fixed value: how byte-level BPE of this family cuts a text into words.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeTable:
    """Vocabulary and merges as arrays. path: a tokenizer file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)[order]
        byte_of = {c: b for b, c in enumerate(letters)}
        table = [b""] * self.base
        for word, i in vocab.items():
            table[i] = bytes(byte_of[c] for c in word)
        for word, i in self.special.items():
            table[i] = word.encode()
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.fromiter(map(len, table), np.int64, self.base)
        self.at = np.cumsum(self.size) - self.size
        self.cache = Stretches(self.encode_new, whole=tuple(self.special))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return WORDS.findall(text)
        out: list[str] = []
        for part in self.split.split(text):
            out += [part] if part in self.special else WORDS.findall(part)
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words one after another, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        for i in [i for i, w in enumerate(words) if w in self.special] if self.special else []:
            first, last = np.searchsorted(word, [i, i + 1])
            sym[first] = self.special[words[i]]
            keep = np.ones(len(sym), bool)
            keep[first + 1 : last] = False
            sym, word = sym[keep], word[keep]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            key = sym.astype(np.int64)
            key[:-1] = key[:-1] * self.base + sym[1:]
            key[np.r_[starts[1:], len(sym)] - 1] = -1  # no pair reaches into the next word
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.rank[at], NONE)
            least = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(least < NONE, length)
            if not live.all():
                done.append((word[~live], sym[~live]))
            at, rank, word, sym, least = at[live], rank[live], word[live], sym[live], np.repeat(least, length)[live]
            hit = np.flatnonzero(rank == least)
            if len(hit) > 1 and (close := np.diff(hit) == 1).any():  # of a run like aaa, every other pair from the left
                new = np.r_[True, ~close]
                begin = np.flatnonzero(new)
                hit = hit[(np.arange(len(hit)) - begin[np.cumsum(new) - 1]) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def encode_new(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and how many each has; each distinct word is merged once."""
        known: dict[str, int] = {}
        codes, ends = [], []
        for text in texts:
            codes += [known.setdefault(w, len(known)) for w in self.words(text)]
            ends.append(len(codes))
        ids, size = self.merge(list(known))
        code = np.array(codes, np.int64)
        before = np.r_[0, np.cumsum(size[code])][np.r_[0, ends].astype(np.int64)]
        return gather(ids, np.cumsum(size) - size, size, code), np.diff(before)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.cache.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.flat, self.at, self.size, ids).tobytes().decode("utf-8", "replace")


@functools.lru_cache(4)
def table(path: str) -> MergeTable:
    return MergeTable(path)


def encode(df: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """df's other columns, then n_tokens and token_ids (little-endian unsigned 32-bit integers), and with decoded the
    text that the ids stand for. A null or empty text has no ids; columns of df named like a new one are dropped; an empty
    table gives an empty result. Each row stands alone: no shuffle, and memory is bounded by a slice of texts."""
    keep = [c for c in df.columns if c != text]
    clash = {"n_tokens", "token_ids", *(["decoded"] if decoded else [])}
    keep = [c for c in keep if c not in clash]

    def run(batches):
        bpe = table(path)
        for batch, texts in text_pieces(batches, text):
            ids = bpe.encode(texts)
            new = {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "token_ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())}
            if decoded:
                new["decoded"] = pa.array(map(bpe.decode, ids), pa.string())
            yield with_columns(batch, keep, **new)

    cols = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens bigint", "token_ids binary"]
    return df.select(*[f"`{c}`" for c in keep], f"`{text}`").mapInArrow(run, ", ".join(cols + ["decoded string"] * decoded))


def decode(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """df with `decoded`, the text of the ids in a binary column as encode() writes it (null: empty)."""
    keep = [c for c in df.columns if c != "decoded"]

    def run(batches):
        bpe = table(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(ids).to_pylist()]
            yield with_columns(batch, keep, decoded=pa.array(texts, pa.string()))

    cols = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["decoded string"]
    return df.select(*[f"`{c}`" for c in keep]).mapInArrow(run, ", ".join(cols))


def digests(df: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and with `ids` token_ids; for every row of df (doc_id,
    text; other columns are dropped). A null or empty text has no ids; an empty table gives an empty result."""
    out = encode(df.select("doc_id", "text"), path, decoded=True)
    return out.select("doc_id", "n_tokens", *["token_ids"] * ids, F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded with the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))

"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A table of token files is a folder with two Parquet tables, so that Spark's writers commit them on any store:
`blocks` has rows (shard, block, doc_ids, doc_sizes, control, payload), and `ranks` has rows (rank, id).
An id is written as its rank by falling frequency over the whole corpus, in 1 to 4 little-endian bytes; each control
byte holds the lengths less 1 of four values, two bits each, lowest first. The decoder looks the lengths of four values
up by control byte and reads all values of a block at once.
"""

from __future__ import annotations

import functools
import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read, shared_dir, shuffle_partitions, text_pieces
from .stretches import Stretches

#: Ids in a block, more only if one document has more.
BLOCK_IDS = 200_000
#: Values' lengths by control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """control and payload of unsigned values below 2 ** 32."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    payload = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), payload.tobytes()


def unpack(control: bytes, payload: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(payload + b"\0\0\0", np.uint8)
    at = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for k in range(int(size.max(initial=0))):
        out |= np.where(size > k, raw[np.minimum(at + k, len(raw) - 1)], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


@functools.lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


def parts_letters_from_marks(spec: dict) -> bool:
    """Whether the pre-tokenizer is of the kind that Stretches may cut for: a split by a pattern that has runs of letters
    apart from runs of marks, then bytes."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = next((s["pattern"].get("Regex", "") for s in steps if s["type"] == "Split"), "")
    return [s["type"] for s in steps] == ["Split", "ByteLevel"] and r"\p{L}]+" in pattern and r"[^\s\p{L}\p{N}]+" in pattern


@functools.lru_cache(4)
def cache(path: str) -> Stretches:
    """The library's encoding, called once for each distinct stretch; it stays with the Python worker."""
    library = tokenizer(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    opens = tuple({t[:2] for t in added})
    apart = next((t["content"] for t in spec.get("added_tokens", []) if not t.get("normalized")), None)  # no stretch holds it, so it parts those of one call
    apart_id = library.token_to_id(apart) if apart else None
    if not parts_letters_from_marks(spec):
        opens = ("",)  # nothing is known about where its texts may be cut: all are encoded whole

    def new(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if apart_id is None or any(o in x for x in texts for o in opens):
            ids = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.int32, size.sum()), size
        parts = [np.array(library.encode_batch_fast([apart.join(texts[i : i + 500]) + apart], add_special_tokens=False)[0].ids, np.int32) for i in range(0, len(texts), 500)]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == apart_id)
        return ids[ids != apart_id], np.diff(np.r_[-1, ends]) - 1

    return Stretches(new, fold="Lowercase" in json.dumps(spec.get("normalizer")), whole=opens)


def id_kind(path: str, end_id: int) -> str:
    return "<u2" if max(tokenizer(path).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def encode_library(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a hash of the text, and the ids with end_id after them, as little-endian integers of id_kind()."""
    kind, narrow = df.schema[key].dataType.simpleString(), id_kind(path, end_id)

    def run(batches):
        words = cache(path)
        for batch, texts in text_pieces(batches, text):
            ids = [np.append(x, end_id).astype(narrow).tobytes() for x in words.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_hash"), pa.array(ids, pa.binary())], names=[key, "_hash", "ids"])

    return df.select(key, F.xxhash64(text).alias("_hash"), text).mapInArrow(run, f"`{key}` {kind}, _hash bigint, ids binary")


def frequency_ranks(encoded: DataFrame, narrow: str) -> DataFrame:
    """(id, rank): ids by falling count over the whole corpus, then by id. At most a row for each id of a vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), narrow), minlength=len(total))
            n[: len(total)] += total
            total = n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).cast("long").alias("rank"))


def write_token_files(df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode df's texts (null: only the end id) and write them to folder in ascending order of key, nulls first;
    equal keys lie in the order of a hash of their texts. Range partitions split on both, so rows that share a key do
    not all meet in one task. An empty table gives tables without rows. Other columns are not written."""
    spark = df.sparkSession
    narrow = id_kind(path, end_id)
    encoded = durable(encode_library(df, path, end_id, key, text), "ids")
    frequency_ranks(encoded, narrow).write.mode("overwrite").parquet(f"{folder}/ranks")
    ranks = spark.read.parquet(f"{folder}/ranks").collect()  # bounded by the vocabulary
    rank_of = np.zeros(max([r.id for r in ranks], default=0) + 1, np.uint32)
    for r in ranks:
        rank_of[r.id] = r.rank
    shared = spark.sparkContext.broadcast(rank_of)
    kind = encoded.schema[key].dataType.simpleString()
    ordered = encoded.repartitionByRange(shuffle_partitions(spark), key, "_hash", F.length("ids")).sortWithinPartitions(key, "_hash")

    def run(batches):
        table, shard, block = shared.value, TaskContext.get().partitionId(), 0
        keys, parts, n, begin = [], [], 0, 0

        def out():
            control, payload = pack(table[np.concatenate(parts)])
            row = [[shard], [block], [begin], [keys], [[len(p) for p in parts]], [control], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["shard", "block", "begin", "doc_ids", "doc_sizes", "control", "payload"])

        for batch in batches:
            key_type = batch.schema.field(key).type
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(key_type), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            for k, x in zip(batch.column(key).to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(x.as_py(), narrow)
                if n and n + len(ids) > BLOCK_IDS:
                    yield out()
                    keys, parts, n, block, begin = [], [], 0, block + 1, begin + n
                keys.append(k)
                parts.append(ids)
                n += len(ids)
        if parts:
            yield out()

    blocks = ordered.select(key, "ids").mapInArrow(run, f"shard int, block int, begin bigint, doc_ids array<{kind}>, doc_sizes array<int>, control binary, payload binary")
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it), ids (little-endian unsigned 32-bit integers), from the files."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    rows = spark.read.parquet(f"{folder}/ranks").collect()
    id_of = np.zeros(len(rows) + 1, "<u4")
    for r in rows:
        id_of[r.rank] = r.id
    shared = spark.sparkContext.broadcast(id_of)
    total = F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (  # a row for each file: the number of range partitions bounds it
        blocks.groupBy("shard").agg(F.sum(total).alias("_n")).select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shard_start"))
    )
    # blocks know where they begin in their shard, so ids move nowhere
    located = blocks.join(F.broadcast(shards), "shard").select((F.col("_shard_start") + F.col("begin")).alias("start"), "doc_ids", "doc_sizes", "control", "payload")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        table = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                size = np.array(row["doc_sizes"], np.int64)
                ids = table[unpack(row["control"], row["payload"], int(size.sum()))]
                ends = np.cumsum(size)
                parts = [x.tobytes() for x in np.split(ids, ends[:-1])]
                keys = pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type)
                yield pa.RecordBatch.from_arrays([keys, pa.array(row["start"] + ends - size, pa.int64()), pa.array(parts, pa.binary())], names=[key, "start", "ids"])

    return located.mapInArrow(run, f"`{key}` {kind}, start bigint, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """documents written to token files with the lower-casing word vocabulary, and what is read back from them."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/entiloom/token-files-{uuid.uuid4().hex}"
    write_token_files(read(spark, sf_dir, "documents").select("doc_id", "text"), folder, path or public_tokenizers.path("word_bpe_49k.json"), 2)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = read_token_files(spark, folder)
    return out.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

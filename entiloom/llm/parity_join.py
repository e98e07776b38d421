"""Jaccard similarity join of word shingles by parity sketches.

A parity sketch of a set flips a bit for each element, so the sketches of two sets differ in at most as many bits as the
sets differ in elements. Sets of a similarity differ in few elements for their sizes, which bounds the bits.

Texts with equal sets are one class. Classes are joined in bands of size: of a pair, the larger set names the band, so a
set takes part in its own band and in the next one if a partner may lie there. In a band sketches have m blocks of
256 bits; a pair that may differ in d bits agrees on m - d blocks at least. The pigeonhole goes further than one block: if
each set keeps the d + 1 of its blocks that come first in an order that all sets share, any such pair still shares a
kept one. The order puts blocks with many bits first, since those hardly ever agree by chance; the nearly empty ones, on
which unlike sets would meet, are left out. Joining on kept blocks therefore loses no pair.

Classes that share a block meet its most central class first. Pairs are dropped by a second sketch of fixed size (its
differing bits bound the difference from below), and what is left is verified on full sets. Links become components; a
few rounds more let the most central class outside of a block's largest component meet the others. Where classes that
share a block then still lie in different components, they meet too: pair by pair in small blocks, in squares of bounded
size in large ones, where only pairs leave whose sketches agree. No group is gathered, and every pair that shares a block
has been compared or is joined already.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read, release, row_key, text_pieces
from .near_dups import LAST, components, confirmed, mixed, shingle_set

#: Bits of a block, and of the sketch that pairs are told apart by.
BITS, SKETCH = 256, 1024
#: A band's largest size is so many times the one before, from FIRST_BAND on.
BAND, FIRST_BAND = 1.5, 12
#: Blocks of a band's sketches, as a multiple of those that a pair needs.
SPARE = 1.15
#: Rounds in which a block's most central class meets the others, before the rest meets completely; the most classes on a
#: side of what then meets at once.
ROUNDS, SIDE = 2, 1000
#: Bits of the filter that tells which texts are needed again.
FILTER_BITS = 24

SHIFT = np.uint64(64 - 10)


def difference(a: int, b: int, percent: int) -> int:
    """The most elements that sets of these sizes may differ in at that similarity."""
    return (a + b) * (100 - percent) // (100 + percent)


def bands(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, its number of blocks, the difference to a partner there at most) of the bands that a set of this size takes
    part in."""
    high, k, partner, out = FIRST_BAND, 0, 100 * size // percent, []
    while high < size:
        high, k = int(high * BAND), k + 1
    while True:
        d = difference(size, min(high, partner), percent)
        if d:  # sets without a difference are one class
            out.append((k, int((difference(high, high, percent) + 1) * SPARE) + 1, d))
        if partner <= high:
            return out
        high, k = int(high * BAND), k + 1


def kept_blocks(shingles: np.ndarray, percent: int) -> np.ndarray:
    """64-bit digests of the kept blocks of a set in all its bands; a block's band and place are part of its digest."""
    out = []
    h = mixed(shingles)
    for band, m, d in bands(len(shingles), percent):
        bits = np.sort((h >> np.uint64(32)) * np.uint64(m * BITS) >> np.uint64(32))
        first = np.flatnonzero(np.concatenate([[True], bits[1:] != bits[:-1]]))
        odd = np.diff(np.append(first, len(bits))) & 1 == 1  # a bit that is flipped twice is unset
        bits = bits[first[odd]]
        block = (bits // np.uint64(BITS)).astype(np.int64)
        ones = np.bincount(block, minlength=m)
        ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(bits + np.uint64(1)), dtype=np.uint64)])[np.concatenate([[0], np.cumsum(ones)])]
        digest = mixed((ends[1:] - ends[:-1]) ^ mixed(np.arange(m, dtype=np.uint64) + np.uint64(band << 32)))
        out.append(digest[np.lexsort((digest, -ones))[: d + 1]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The sketch of fixed size."""
    count = np.bincount((mixed(shingles ^ np.uint64(0x5DEECE66D)) >> SHIFT).astype(np.int64), minlength=SKETCH)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row_key, n_shingles, set_key (digest of the set; null if empty) of all rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in text_pieces(batches, "text"):
            sets = [shingle_set(x, width) for x in texts]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "row_key", "n_shingles", "set_key"])

    return docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key binary, n_shingles bigint, set_key binary")


def place(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)


def bit_map(keys: DataFrame) -> np.ndarray:
    """A bit for each hash of a row_key of keys: 2 MB, whatever their number. Texts of other rows needn't be moved."""
    bit = F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")
    words = keys.select(place("row_key").alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b"))
    table = words.toArrow()  # a row for 64 bits at most
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return bits


def from_texts(docs: DataFrame, keys: DataFrame, schema: str, made) -> DataFrame:
    """row_key and what made(texts) gives, of the rows whose row_key is in keys; rows that repeat give one row."""
    bits = bit_map(keys)

    def known(batches):
        flags = np.unpackbits(bits.view(np.uint8), bitorder="little").astype(np.bool_)
        for batch in batches:
            yield batch.filter(pa.array(flags[batch.column("p").to_numpy()]))

    def run(batches):
        for batch, texts in text_pieces(known(batches), "text"):
            new = made(texts)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), *new.values()], names=["row_key", *new])

    key = row_key("doc_id", "text")
    found = docs.select(key.alias("row_key"), "text").select("row_key", "text", place("row_key").alias("p")).mapInArrow(run, f"row_key binary, {schema}")
    one = found.groupBy("row_key").agg(*[F.first(c).alias(c) for c in found.columns[1:]])  # combined before rows are moved
    return one.join(keys, "row_key")


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def sketched(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """set_key, n_shingles, sketch, blocks of the classes that are large enough to differ from another one."""

    def made(texts):
        sets = [shingle_set(x, width) for x in texts]
        return {"sketch": lists([parity(s) for s in sets]), "blocks": lists([kept_blocks(s, percent).view(np.int64) for s in sets])}

    partner = F.floor(100 * F.col("n_shingles") / percent)
    need = classes.filter((F.col("n_shingles") + partner) * (100 - percent) >= 100 + percent).select("row_key", "set_key", "n_shingles")
    return from_texts(docs, need, "sketch array<bigint>, blocks array<bigint>", made)


def full_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """set_key, shingles of classes (set_key, row_key)."""
    made = lambda texts: {"shingles": pa.array([shingle_set(x, width).tobytes() for x in texts], pa.binary())}
    return from_texts(docs, classes, "shingles binary", made).select("set_key", "shingles")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose sketches allow their difference; exact bounds both."""
    told = classes.select("set_key", "n_shingles", "sketch")
    both = pairs.join(told.withColumnsRenamed({"set_key": "a", "n_shingles": "n_a", "sketch": "s_a"}), "a").join(told.withColumnsRenamed({"set_key": "b", "n_shingles": "n_b", "sketch": "s_b"}), "b")
    differ = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
    most = F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))
    return both.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).filter(differ <= most).select("a", "b")


def ordered(x: str | Column, y: str | Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (set_key) with root: that of their component, or the class itself."""
    return rows.join(roots.withColumnRenamed("key", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))


def jaccard_join(docs: DataFrame, percent: int = 85, width: int = 4) -> DataFrame:
    """doc_id, row_key, n_shingles, group, component_id for every row of docs (doc_id, text; others are dropped).

    Rows are linked if 100 * intersection >= percent * union of their sets of word shingles (percent over 50). group is
    one key for all rows that links lead to, whatever their ids; null for texts without words (null, empty), which are
    linked with nothing. component_id is the smallest doc_id of the group (null where the group has none), and a row's
    own doc_id where it has no group. Rows that repeat each count. An empty table gives an empty result."""
    sketch = durable(sets_of(docs, width), "sets-of")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "n_shingles"))
    classes = durable(sketch.filter("set_key is not null").groupBy("set_key").agg(one.alias("one")).select("set_key", "one.doc_id", "one.row_key", "one.n_shingles"), "classes")
    met, known = meetings(docs, classes, width, percent)
    members = durable(met.select("set_key").distinct(), "members-met")
    sets = durable(full_sets(docs, members.join(classes, "set_key").select("set_key", "row_key"), width), "sets")
    roots = joined(met, known, sets, percent)
    of = durable(rooted(classes.select("set_key", "doc_id"), roots), "groups")
    least = durable(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    found = durable(of.drop("doc_id").join(least, "root").withColumnRenamed("root", "group"), "members")
    release(met, known, members, sets, of, least)
    out = sketch.select("doc_id", "row_key", "n_shingles", "set_key").join(found, "set_key", "left")
    return out.select("doc_id", "row_key", "n_shingles", "group", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def meetings(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """block, set_key, n, company of classes that share a kept block: n of them, and a class's n over all its blocks; and
    set_key, n_shingles, sketch of these classes.

    Most blocks are nobody else's, so that blocks travel with eight bytes that stand for a class; classes whose bytes
    happen to be equal only meet more others."""
    all_ = durable(sketched(docs, classes, width, percent), "sketched")
    blocks = all_.select(F.xxhash64("set_key").alias("id"), F.explode("blocks").alias("block"))
    shared = durable(blocks.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    hits = durable(blocks.join(shared, "block"), "hits")
    company = durable(hits.groupBy("id").agg(F.sum("n").alias("company")), "company")
    known = durable(all_.withColumn("id", F.xxhash64("set_key")).join(company, "id").select("id", "set_key", "n_shingles", "sketch", "company"), "known")
    met = durable(hits.join(known.select("id", "set_key", "company"), "id").select("block", "set_key", "n", "company"), "met")
    release(all_, shared, hits, company)
    return met, known


def joined(met: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, root of all classes with a link: components of the links between classes that share a block.

    ROUNDS times each block that holds several components picks the most central class that is not yet in its largest
    one (at first: of all), which meets the others. What is left then meets completely."""
    roots, links, pairs = None, [], []
    for n in range(ROUNDS):
        # where two meet, the first round has compared them
        where = met.withColumn("root", F.col("set_key")) if roots is None else durable(rooted(met.filter("n > 2").select("block", "set_key", "company"), roots), "where")
        hub = centres(where, first=not n)
        rows = where.join(hub, "block").filter("root != hub_root").select(*ordered("set_key", "hub")).distinct()
        fresh = rows if not pairs else rows.join(one_table(pairs), ["a", "b"], "left_anti")
        pairs.append(durable(likely(durable(fresh, "pairs"), known, percent), "likely"))
        links.append(verified(pairs[-1], sets, percent))
        if links[-1].isEmpty():
            break
        roots = components(one_table(links))
    roots = components(one_table(links)) if roots is None else roots
    more = across(met.filter("n > 2").select("block", "set_key", "n"), known, one_table(pairs), roots, sets, percent)
    if not more.isEmpty():
        roots = components(one_table([*links, more]))
    release(*pairs)
    return roots


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that full sets confirm. Sets that no pair asks for stay where they are."""
    asked = durable(pairs.select(F.col("a").alias("set_key")).unionAll(pairs.select("b")).distinct(), "asked")
    some = durable(sets.join(asked, "set_key", "left_semi"), "some-sets")
    out = durable(confirmed(pairs, some, percent), "links")
    release(asked, some)
    return out


def centres(where: DataFrame, first: bool) -> DataFrame:
    """block, hub, hub_root of blocks with several components. The counts of each are combined before they are moved."""
    best = F.max(F.struct("company", "set_key"))
    if first:
        return durable(where.groupBy("block").agg(best.alias("b")).select("block", F.col("b.set_key").alias("hub"), F.col("b.set_key").alias("hub_root")), "centres")
    each = where.groupBy("block", "root").agg(F.count("*").alias("size"), best.alias("b"))
    sides = durable(each, "sides")
    main = durable(sides.groupBy("block").agg(F.max(F.struct("size", "root")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("block", F.col("m.root").alias("main")), "main")
    outside = sides.join(main, "block").filter("root != main")
    return durable(outside.groupBy("block").agg(F.max(F.struct("b.company", "b.set_key", "root")).alias("x")).select("block", F.col("x.set_key").alias("hub"), F.col("x.root").alias("hub_root")), "centres")


def across(met: DataFrame, known: DataFrame, done: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of classes that share a block."""
    where = durable(rooted(met, roots), "where")
    sides = durable(where.groupBy("block", "root").agg(F.count("*").alias("size")), "sides")
    open_ = durable(sides.groupBy("block").agg(F.max(F.struct("size", "root")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("block", F.col("m.root").alias("main")), "open")
    inside = durable(where.join(open_, "block"), "inside")
    small = inside.filter(F.col("n") <= LAST)
    x, y = small.select("block", F.col("set_key").alias("a"), F.col("root").alias("ra")), small.select("block", F.col("set_key").alias("b"), F.col("root").alias("rb"))
    apart = durable(x.join(y, "block").filter("a < b and ra != rb").select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "apart")
    found = squares(inside.filter(F.col("n") > LAST), known, percent).distinct().join(done, ["a", "b"], "left_anti")
    pairs = durable(likely(apart, known, percent).unionByName(found).distinct(), "across")
    out = verified(pairs, sets, percent)
    release(where, sides, open_, inside, apart)
    return out


def squares(rows: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in blocks of many classes, whose sizes and sketches allow a link.

    rows: block, set_key, root, main. The classes outside of a block's largest component meet all of it, a square of at
    most SIDE by SIDE classes at a time; a square is a row of its own key, so one block's squares are spread over tasks."""
    told = durable(rows.join(known.select("set_key", "n_shingles", "sketch"), "set_key").select("block", "root", (F.col("root") != F.col("main")).alias("outside"), "set_key", "n_shingles", "sketch"), "told")
    parts = lambda n: F.greatest(F.ceil(n / SIDE).cast("int"), F.lit(1))
    number = durable(told.groupBy("block").agg(parts(F.count(F.when(F.col("outside"), 1))).alias("n_x"), parts(F.count("*")).alias("n_y")), "numbers")
    dealt = told.join(number, "block")

    def side(side: DataFrame, n: str, key: str, name: str) -> DataFrame:
        part = F.struct("block", F.pmod(F.xxhash64("set_key"), F.col(n)).cast("int").alias("part"))
        return durable(side.select(part.alias(key), F.struct("set_key", "root", "n_shingles", "sketch").alias("r")).groupBy(key).agg(F.collect_list("r").alias(name)), name)

    xs, ys = side(dealt.filter("outside"), "n_x", "x", "xs"), side(dealt, "n_y", "y", "ys")
    each = number.withColumn("i", F.explode(F.expr("sequence(0, n_x - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, n_y - 1)")))
    square = each.select(F.struct("block", F.col("i").alias("part")).alias("x"), F.struct("block", F.col("j").alias("part")).alias("y")).join(xs, "x").join(ys, "y")

    def columns(side: pa.ListScalar) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        v = side.values
        words = v.field("sketch").flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).view(np.uint64)
        return v.field("set_key"), v.field("root").to_numpy(zero_copy_only=False), v.field("n_shingles").to_numpy(), words

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                (ka, ra, na, sa), (kb, rb, nb, sb) = columns(batch.column("xs")[i]), columns(batch.column("ys")[i])
                for at in range(0, len(na), 64):
                    x = slice(at, at + 64)
                    differ = np.zeros((len(na[x]), len(nb)), np.int64)
                    for w in range(sa.shape[1]):
                        differ += np.bitwise_count(sa[x, w][:, None] ^ sb[:, w][None, :])
                    n, m = na[x][:, None], nb[None, :]
                    fit = (differ * (100 + percent) <= (n + m) * (100 - percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (ra[x][:, None] != rb[None, :])
                    p, r = np.nonzero(fit)
                    if len(p):
                        a, b = ka.take(pa.array(p + at)), kb.take(pa.array(r))
                        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    return square.select("xs", "ys").mapInArrow(run, "a binary, b binary").select(*ordered("a", "b"))


def one_table(parts: list[DataFrame]) -> DataFrame:
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p.durable_path for p in parts])


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that links of a similarity of 0.85 or more over 4-word shingles make."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")

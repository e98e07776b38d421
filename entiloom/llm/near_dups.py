"""MinHash near-duplicates with an LSH forest, confirmed on full shingle sets.

Texts with equal shingle sets form one class. A class has a signature of 96 minima, read in 24 orders (order t starts
at value 4t and goes round). Classes that share the first values of an order form a region. Depth adapts: a region of
four values that holds more than 64 classes is split by more values, up to sixteen. In regions of every depth the
most central class (the one with the most company over all its regions) is a candidate for every other; in the last
ones neighbours in sorted order, those of the longest common prefix, are candidates too. Candidates are confirmed on
full sets and joined to components. Then classes that still share a region with another component are compared across:
pair by pair in first regions of 64 at most, and in blocks in larger ones. So no link between two classes
that share a region, and that would join two components, stays unseen.

Groups are handled by aggregates and joins; none is gathered, and n classes of a region make O(n) candidates. Only
what is left of large regions, the classes outside the largest component, meets the whole region, in bounded blocks.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, durable, read, row_key, text_pieces

ORDERS, FIRST = 24, 4
VALUES = ORDERS * FIRST
DEPTHS = (4, 8, 16)
LAST, NEXT = 64, 1
#: Values of an order that travel with a class: enough for all depths and for neighbours in sorted order.
WAY = 32
#: Shingles, and sets, of a block where large regions are compared; one longer set makes a block of its own size.
BLOCK_SHINGLES, BLOCK_SETS = 60_000, 1000
#: Cells of an incidence matrix that a task holds at once.
CELLS = 4_000_000

_rng = np.random.default_rng(96)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    return (h * np.uint64(0x81DADEF4BC2DD44D)) ^ (h >> np.uint64(33))


def shingle_set(text: str, width: int = 4) -> np.ndarray:
    r"""Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, words `[^\x20\x09-\x0D]+`; with fewer words than
    width the whole sequence is one; empty without words."""
    words = text.encode().lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        out = np.minimum(out, ((part * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(1).astype(np.uint32))
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row_key, n_shingles, set_key (digest of the set; null if empty), sig (big-endian values)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, texts in text_pieces(batches, "text"):
            n, keys, sigs = [], [], []
            for x in texts:
                s = shingle_set(x, width)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            new = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *new], names=["doc_id", "row_key", "n_shingles", "set_key", "sig"])

    return docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key binary, n_shingles bigint, set_key binary, sig binary")


def way(values: int) -> Column:
    """The first values of a row's order; a signature twice in a row lets orders go round."""
    return F.expr(f"substring(concat(sig, sig), tree * {4 * FIRST} + 1, {4 * values})")


def forest(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs (a, b) of set keys; and the members (tree, region, set_key) of first regions: of small ones, and of
    those that were split.

    What is counted for a region is written before rows are joined to it, so that both sides of the join are plain
    shuffles and Spark can split a region that holds many of the rows."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("tree")
    rows = classes.select("set_key", "sig", trees).select("set_key", "tree", F.xxhash64(way(DEPTHS[0])).alias("region"))
    shared = durable(rows.groupBy("tree", "region").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    leaves = durable(rows.join(shared, ["tree", "region"]), "leaves")
    central = durable(leaves.groupBy("set_key").agg(F.sum("n").alias("company")), "company")
    sigs = central.join(classes.select("set_key", "sig"), "set_key")
    level = durable(leaves.select("set_key", "tree").join(sigs, "set_key").select("set_key", "tree", "company", way(WAY).alias("way")), "level")
    pairs = []
    for depth, deeper in zip(DEPTHS, [*DEPTHS[1:], None], strict=True):
        level = level.withColumn("region", F.xxhash64(F.substring("way", 1, 4 * depth)))
        hubs = durable(level.groupBy("tree", "region").agg(F.count("*").alias("n"), F.max(F.struct("company", "set_key")).alias("hub")).filter("n > 1").select("tree", "region", "n", F.col("hub.set_key").alias("hub")), "hubs")
        placed = durable(level.join(hubs, ["tree", "region"]), f"regions-{depth}")
        pairs.append(placed.filter("set_key != hub").select(F.least("set_key", "hub").alias("a"), F.greatest("set_key", "hub").alias("b")))
        final = placed.filter(F.col("n") <= LAST)
        order = Window.partitionBy("tree", "region").orderBy("way", "set_key")
        near = final.select("set_key", F.array(*[F.lead("set_key", k).over(order) for k in range(1, NEXT + 1)]).alias("others")).select("set_key", F.explode("others").alias("other")).filter("other is not null")
        pairs.append(near.select(F.least("set_key", "other").alias("a"), F.greatest("set_key", "other").alias("b")))
        if depth == DEPTHS[0]:
            small, dense = final.select("tree", "region", "set_key"), placed.filter(F.col("n") > LAST).select("tree", "region", "set_key")
        level = placed.filter(F.col("n") > LAST).select("set_key", "tree", "company", "way")
    return functools.reduce(DataFrame.unionAll, pairs).distinct(), small, dense


def near_in_size(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets' sizes allow the similarity; exact, as min / max bounds it."""
    n = classes.select("set_key", "n_shingles")
    both = pairs.join(n.withColumnsRenamed({"set_key": "a", "n_shingles": "n_a"}), "a").join(n.withColumnsRenamed({"set_key": "b", "n_shingles": "n_b"}), "b")
    return both.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")


def full_sets(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """set_key, shingles: the full sets of the classes, read again from one text of each."""

    def full(batches):
        for batch, texts in text_pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array([shingle_set(x, width).tobytes() for x in texts], pa.binary())], names=["set_key", "shingles"])

    text = docs.select(row_key("doc_id", "text").alias("row_key"), "text").join(classes.select("row_key", "set_key"), "row_key")
    return text.dropDuplicates(["row_key"]).select("set_key", "text").mapInArrow(full, "set_key binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""
    both = pairs.join(sets.withColumnsRenamed({"set_key": "a", "shingles": "set_a"}), "a").join(sets.withColumnsRenamed({"set_key": "b", "shingles": "set_b"}), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted sets: a sum of products of incidence matrices over some of
    the shared shingles each, so memory is bounded by CELLS and by the pairs."""
    left, right = np.concatenate(xs), np.concatenate(ys)
    shared = np.intersect1d(left, right)
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not len(shared):
        return out.astype(np.int64)
    sides = []
    for flat, sets in ((left, xs), (right, ys)):
        at = np.searchsorted(shared, flat)
        hit = shared[np.minimum(at, len(shared) - 1)] == flat
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]
        by = np.argsort(at, kind="stable")
        sides.append((row[by], at[by], len(sets)))
    step = max(1, CELLS // (len(xs) + len(ys)))
    for begin in range(0, len(shared), step):
        part = []
        for row, at, n in sides:
            lo, hi = np.searchsorted(at, [begin, begin + step])
            m = np.zeros((n, min(step, len(shared) - begin)), np.float32)
            m[row[lo:hi], at[lo:hi] - begin] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return np.rint(out).astype(np.int64)


def dense_links(dense: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that could join components inside regions too large to compare pair by pair.

    dense: tree, region, set_key. Of each such region with several components, the classes outside its largest
    component meet all classes of the region, in blocks of bounded size (BLOCK_SHINGLES and BLOCK_SETS on either side).
    A pair of blocks is a row with keys of its own, so one region's pairs are spread over tasks; only links leave it. So
    every pair that shares a region has been compared or has been joined."""
    where = durable(dense.join(roots.withColumnRenamed("key", "set_key"), "set_key", "left").select("tree", "region", "set_key", F.coalesce("root", "set_key").alias("root")), "dense-roots")
    shares = where.groupBy("tree", "region", "root").agg(F.count("*").alias("n"))
    main = durable(shares.groupBy("tree", "region").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("tree", "region", F.col("top.root").alias("main")), "dense-main")
    mixed = durable(where.join(main, ["tree", "region"]), "dense-mixed")
    rows = durable(mixed.join(sets, "set_key").select("tree", "region", "set_key", "root", "shingles", (F.col("root") != F.col("main")).alias("outside")), "dense")
    weight = F.greatest(F.octet_length("shingles") / 8, F.lit(BLOCK_SHINGLES / BLOCK_SETS))
    blocks = lambda w: F.greatest(F.ceil(F.sum(w) / BLOCK_SHINGLES).cast("int"), F.lit(1))
    number = durable(rows.groupBy("tree", "region").agg(blocks(F.when(F.col("outside"), weight).otherwise(0)).alias("n_x"), blocks(weight).alias("n_y")), "dense-blocks")
    dealt = rows.join(number, ["tree", "region"])

    def gathered(side: DataFrame, n: str, key: str, name: str) -> DataFrame:
        block = F.struct("tree", "region", F.pmod(F.xxhash64("set_key"), F.col(n)).cast("int").alias("block"))
        return durable(side.select(block.alias(key), F.struct("set_key", "root", "shingles").alias("r")).groupBy(key).agg(F.collect_list("r").alias(name)), f"dense-{name}")

    xs, ys = gathered(dealt.filter("outside"), "n_x", "x", "xs"), gathered(dealt, "n_y", "y", "ys")
    each = number.withColumn("i", F.explode(F.expr("sequence(0, n_x - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, n_y - 1)")))
    met = each.select(F.struct("tree", "region", F.col("i").alias("block")).alias("x"), F.struct("tree", "region", F.col("j").alias("block")).alias("y")).join(xs, "x").join(ys, "y")

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):  # one pair of blocks at a time, as each may fill its bound
                xs, ys = batch.column("xs")[i].as_py(), batch.column("ys")[i].as_py()
                if len({r["root"] for r in xs + ys}) < 2:
                    continue
                a, b = ([np.frombuffer(r["shingles"], np.uint64) for r in side] for side in (xs, ys))
                common = common_counts(a, b)
                size = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
                hits = np.argwhere(100 * common >= percent * (size - common))
                out = [(xs[x]["set_key"], ys[y]["set_key"]) for x, y in hits if xs[x]["root"] != ys[y]["root"]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.binary()), pa.array([max(p) for p in out], pa.binary())], names=["a", "b"])

    return met.select("xs", "ys").mapInArrow(run, "a binary, b binary")


def settled(tree: DataFrame) -> DataFrame:
    """key, root of a forest (key, root: a parent no greater than the key): pointers double until nothing changes."""
    while True:
        hop = tree.select(F.col("key").alias("root"), F.col("root").alias("far"))
        new = durable(tree.join(hop, "root").select("key", F.col("far").alias("root"), F.col("root").alias("was")), "trees")
        tree = new.select("key", "root")
        if new.filter("root != was").isEmpty():
            return tree


def components(links: DataFrame) -> DataFrame:
    """key, root: the least key that links lead to, for every key in links (a, b).

    Each round hangs every key under its least neighbour, if that is less, follows the trees to their roots, and links
    roots where edges lead from tree to tree. A key that stays a root without a child has a lesser root for a neighbour
    in the next round, so two rounds halve the roots of a component at least, whatever its shape and the keys' order.
    Rounds go on until no edge is left; each is cut off from the last by a written table."""
    edges = durable(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = None
    while True:
        tree = settled(durable(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("root")), "trees"))
        roots = tree if roots is None else durable(roots.join(tree.select(F.col("key").alias("root"), F.col("root").alias("far")), "root", "left").select("key", F.coalesce("far", "root").alias("root")), "roots")
        ends = edges.join(tree.withColumnsRenamed({"key": "a", "root": "ra"}), "a").join(tree.withColumnsRenamed({"key": "b", "root": "rb"}), "b")
        edges = durable(ends.filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return roots


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 4) -> DataFrame:
    """doc_id, row_key, n_shingles, group, component_id, kept for every row of docs (doc_id, text; others are dropped).

    Rows are linked if 100 * intersection >= percent * union of their sets of word shingles. group is one key for all
    rows that links lead to, whatever their ids; null for texts without words (null, empty), which are linked with
    nothing. component_id is the smallest doc_id of the group, null where the group has none; kept holds for all rows
    that bear it, and for rows of groups without an id. row_key stands for a row's id and text (row_key() in common).
    An empty table gives an empty result."""
    sketch = durable(sketches(docs, width), "sketches")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "n_shingles", "sig"))
    classes = durable(sketch.filter("set_key is not null").groupBy("set_key").agg(one.alias("one")).select("set_key", "one.doc_id", "one.row_key", "one.n_shingles", "one.sig"), "classes")
    pairs, small, dense = forest(classes)
    pairs = durable(near_in_size(pairs, classes, percent), "candidates")
    company = classes.join(small.select("set_key").unionAll(dense.select("set_key")).distinct(), "set_key", "left_semi")
    sets = durable(full_sets(company, docs, width), "sets")
    links = durable(confirmed(pairs, sets, percent), "links")
    roots = components(links)
    where = durable(small.join(roots.withColumnRenamed("key", "set_key"), "set_key", "left").select("tree", "region", "set_key", F.coalesce("root", "set_key").alias("root")), "small-roots")
    split = durable(where.groupBy("tree", "region").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1 and n > 2").select("tree", "region"), "split")
    open_ = durable(where.join(split, ["tree", "region"]), "open-regions")
    x, y = open_.select("tree", "region", F.col("set_key").alias("a"), F.col("root").alias("ra")), open_.select("tree", "region", F.col("set_key").alias("b"), F.col("root").alias("rb"))
    across = x.join(y, ["tree", "region"]).filter("a < b and ra != rb").select("a", "b").distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    found = confirmed(durable(near_in_size(across, classes, percent), "across"), sets, percent)
    with arrow_rows(docs.sparkSession, 8):
        inside = durable(dense_links(dense, roots, sets, percent), "dense-links")
    more = durable(found.unionAll(inside).distinct(), "more-links")
    if not more.isEmpty():
        lead = roots.select(F.col("key"), F.col("root").alias("lead"))
        mapped = durable(more.join(lead.withColumnsRenamed({"key": "a", "lead": "la"}), "a", "left").join(lead.withColumnsRenamed({"key": "b", "lead": "lb"}), "b", "left"), "mapped")
        onward = components(mapped.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))).select(F.col("key").alias("root"), F.col("root").alias("far"))
        every = roots.unionAll(mapped.filter("la is null").select("a", "a")).unionAll(mapped.filter("lb is null").select("b", "b")).distinct()
        roots = every.join(onward, "root", "left").select("key", F.coalesce("far", "root").alias("root"))
    of = durable(classes.select("set_key", "doc_id").join(roots.withColumnRenamed("key", "set_key"), "set_key", "left").select("set_key", "doc_id", F.coalesce("root", "set_key").alias("group")), "groups")
    least = durable(of.groupBy("group").agg(F.min("doc_id").alias("component_id")), "least")
    found = durable(of.drop("doc_id").join(least, "group"), "members")
    out = sketch.select("doc_id", "row_key", "n_shingles", "set_key").join(found, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "row_key", "n_shingles", "group", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a similarity of 0.8 or more over 4-word shingles."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")

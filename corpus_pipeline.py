"""The corpus pipeline: documents scored, deduplicated, decontaminated, cleared of personal data, and encoded.

Each stage takes (spark, docs, sf_dir), returns a DataFrame, and works on all that its predecessor kept. run() writes
each stage's rows as Parquet in the shared folder and reads them again. Stages but the last return all columns of docs,
whatever their names: what a stage adds for itself has a free name. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entiloom.llm import bpe, decontamination, near_dups, pii, quality_kernel
from entiloom.llm.common import durable, free_name, read, row_key, text_key

GOOD = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose quality score is 0.7 or more; all rows if there are no labels of docs to learn from.

    Learns from all labels of the documents it is given. A null text is scored as an empty one. Rows are scored where
    they lie: texts aren't shuffled, and rows that repeat an id or a text are judged each by its own text."""
    stats = free_name(docs, "stats")
    counted = durable(docs.withColumn(stats, quality_kernel.statistics_of("text")), "quality-stats")
    known = quality_kernel.mean_labels(read(spark, sf_dir, "labels"), "quality").select(F.col("doc_id").alias("_id"), "y")
    labelled = counted.select(F.col("doc_id").alias("_id"), F.col(stats).alias("stats")).join(known, "_id")
    model = quality_kernel.fit(durable(labelled, "quality-labelled"), F.pmod(F.xxhash64("_id"), F.lit(5)) == 0)
    if not model.learned:
        return docs
    return counted.filter(quality_kernel.score_of(model, stats) >= GOOD).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (five words, similarity 0.8): that of the smallest id, rows
    without an id last; of rows that bear this id too, that of the least digest of id and text; of rows equal in both,
    any one. Rows without words (null, empty) are duplicates of nothing and stay, all of them."""
    key = free_name(docs, "row_key")
    found = near_dups.near_duplicates(docs.select("doc_id", "text"), percent=80, width=5).filter("group is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    keep = durable(found.groupBy("group").agg(first.alias("one")).select(F.col("one.row_key").alias(key)), "keep")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(worded).withColumn(key, row_key("doc_id", "text")).dropDuplicates([key])  # combined before the shuffle
    return rows.join(keep, key, "left_semi").drop(key).unionByName(docs.filter(~worded))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text a benchmark item leaks into. Null and empty texts stay."""
    key = free_name(docs, "text_key")
    leaks = decontamination.leaks(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark")).select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, text_key("text")).join(durable(leaks, "leaks"), key, "left_anti").drop(key)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by their kind; keeps every row. A null text stays null."""
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every row the token ids (little-endian unsigned 32-bit integers) and their number, with digests of the ids and
    of the text that they decode to. A null or empty text has no ids."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mask_pii", mask_pii), ("encode", encode)]

#: The stages' models and signatures can't be put in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

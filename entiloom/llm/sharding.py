"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

A record goes to the shard with the highest -weight / ln(u), where u in (0, 1) is a hash of the record's key and the
shard's number. The key, the weights and the number of shards decide alone, so one more shard only takes records (its
share of them) and moves none between the old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read, shuffle_partitions


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, minus) of the winning shard; the shard is -minus. Equal scores: the lower number."""
    best = []
    for i, w in enumerate(weights):
        if not w > 0:
            raise ValueError("weights must be positive")
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(i), key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        best.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(-i).alias("minus")))
    return F.array_max(F.array(*best))


def assign_shards(
    df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0
) -> DataFrame:
    """One row for each row of df: key, size, text_crc32, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null text: 1, crc 0); slot numbers a shard's rows from 0 without gaps;
    grown_shard is the shard if one more of weight grown_weight joins. Rows with a null key follow one rule together, as
    any equal keys do; repeated rows get slots of their own. Slots are dealt from sub-buckets (shuffle partitions of
    them in each shard) that ignore the key, so a key with a third of all rows is still spread over tasks.
    An empty table gives an empty result. Other columns of df are dropped.
    """
    buckets = shuffle_partitions(df.sparkSession)
    body = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    one = F.col("_best")
    rows = (
        df.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
        .withColumn("_best", rendezvous(F.col("_key"), weights))
        .withColumn("_new", rendezvous(F.col("_key"), [*weights, grown_weight]))
        .select(
            F.col("_key").alias(key), "size", "text_crc32",
            (-one["minus"]).alias("shard"), (-F.col("_new")["minus"]).alias("grown_shard"),
            F.pmod(F.xxhash64("_key", "text_crc32", F.monotonically_increasing_id()), F.lit(buckets)).cast("int").alias("_bucket"),
        )
    )
    rows = durable(rows, "shards")  # the buckets hold a row's position, which must not change between the two uses
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # a row for each shard and bucket: parameters bound its size
        rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy(key, "text_crc32")
    return (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "_bucket"])
        .select(key, "size", "text_crc32", "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in shards 0 to 15 under the law `key`."""
    out = assign_shards(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

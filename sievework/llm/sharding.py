"""Sharding by a two-pass external shuffle.

Pass one scatters records into memory-sized buckets by seeded hashes; pass two
shuffles each bucket by Fisher-Yates and writes it. A record's shard is the
one with the highest seeded hash of (doc_id, shard), so a further shard takes
rows only into itself and never moves a row between the old ones.

Null text counts as empty, null doc_id is hashed as a key of its own. Rows that
share a doc_id share a shard, and their texts deal them over its buckets; equal
rows stay equal rows, each with its own slot. An empty table gives no rows.
Other columns of the input are left behind.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, text_bytes


def _fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def _shuffle_bucket(seed: int):
    def shuffled(key: tuple, rows: pa.Table) -> pa.Table:
        shard, bucket = (k.as_py() for k in key)
        rows = rows.sort_by([("doc_id", "ascending"), ("text_crc32", "ascending"), ("text", "ascending")])
        order = _fisher_yates(rows.num_rows, np.random.default_rng([seed, shard, bucket]))
        return rows.take(pa.array(order)).append_column("pos", pa.array(np.arange(len(order)), pa.int64()))

    return shuffled


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = 16 << 20) -> tuple[DataFrame, str]:
    """Writes the documents shuffled into shards and returns (rows as written, path).

    Rows: doc_id, text, size, text_crc32, shard, grown_shard, bucket, pos. The
    files of a shard lie in its own shard=N folder. A bucket holds about
    bucket_bytes of text and of 16 bytes a row, whatever the input's size.
    """
    spark = docs.sparkSession
    buckets = max(1, math.ceil(text_bytes(docs, 16) / (shards * bucket_bytes)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draw = lambda s: F.xxhash64(key, s, F.lit(seed))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(draw(s).alias("h"), s.alias("s"))))
    text = F.coalesce("text", F.lit(""))
    bucket = F.pmod(F.xxhash64(key, text, F.lit(seed + 1)), F.lit(buckets)).cast("int")  # the text splits rows that share an id
    scattered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), best.alias("best"), bucket.alias("bucket"))
        .withColumn("shard", F.col("best.s"))
        .withColumn("grown_shard", F.when(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(shards), F.lit(seed)) > F.col("best.h"), F.lit(shards)).otherwise(F.col("best.s")))
        .drop("best")
    )
    schema = "doc_id long, text string, size long, text_crc32 long, bucket int, shard int, grown_shard int, pos long"
    path = fresh_path(spark, "shards")
    (scattered.groupBy("shard", "bucket").applyInArrow(_shuffle_bucket(seed), schema).sortWithinPartitions("shard", "bucket", "pos").write.partitionBy("shard").option("compression", "zstd").parquet(path))
    written = spark.read.schema(schema).parquet(path)
    return written, path


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, _ = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = written.drop("text")
    upto = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("base"))
    return rows.join(base, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("pos")).alias("slot"), "grown_shard")

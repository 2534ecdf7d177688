"""Incremental ingestion of files: each file counts once, and a rerun of a batch replaces what it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_OWN: dict[str, str] = {}


def working_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which executors share; on a local master without one, under one temporary folder an application."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN.setdefault(sc.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-sievework-")
        _OWN[sc.applicationId] = base
    return f"{base.rstrip('/')}/ingest-{uuid.uuid4().hex}"


def ingest(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str, pattern: str = "*.parquet", files_per_batch: int = 4) -> None:
    """Takes all files not yet seen into `target`, a folder a batch, and ends.

    A batch is a folder of its own that is replaced as a whole, so a batch run
    again after a crash leaves the same rows once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums a window and type; works on batches and, with a watermark for late rows, on streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

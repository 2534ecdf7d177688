"""Documents in blocks of a few MB, so that a task can work on many texts as one array."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, pack_planes, squeeze, text_bytes, unpack_planes, unsqueeze

BLOCK = "block long, ids binary, lengths binary, text binary"
#: Stands for a null doc_id, which counts as larger than any other.
NO_ID = np.iinfo(np.int64).max


def _into_blocks(limit: int):
    def blocks(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            text = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            ids = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
            sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
            which = np.cumsum(sizes) // limit
            cuts = [0, *(np.flatnonzero(np.diff(which)) + 1), len(sizes)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    raw = b"".join(text[lo:hi].to_pylist())
                    yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "ids": pa.array([pack_planes(ids[lo:hi])], pa.binary()), "lengths": pa.array([pack_planes(sizes[lo:hi].astype(np.int64))], pa.binary()), "text": pa.array([squeeze(raw)], pa.binary())})
                    number += 1

    return blocks


def block_table(docs: DataFrame, limit: int = 1 << 20) -> tuple[DataFrame, int]:
    """Writes the documents as a table of blocks, bucketed by block so that later joins move only the other side; returns it and the bytes of text."""
    spark = docs.sparkSession
    total = text_bytes(docs)
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (16 << 20))))
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_into_blocks(limit), BLOCK)
    name = f"sievework_{uuid.uuid4().hex}"
    made.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", fresh_path(spark, "blocks")).option("compression", "uncompressed").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay where the plan has found them, its name goes
    return blocks, total


class Block:
    """One row of the table, unpacked."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids = unpack_planes(row["ids"], np.int64)
        self.lengths = unpack_planes(row["lengths"], np.int64)
        self.raw = unsqueeze(row["text"])
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])

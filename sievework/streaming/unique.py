"""A validating writer over a stream of files: bad rows go with a reason, each key is written once however often it comes, also across restarts.

Seen keys are state of the stream (RocksDB where the session asks for it), kept
with the checkpoint. A batch writes one folder, which a batch run again after a
crash replaces. Kept rows name their file, so that `ledger` accounts for every
row read from the files and what was written alone, whatever happened between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE = "_file"


def _blank(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (F.trim(c) == "") if kind == "string" else c.isNull()


def why_not(schema: T.StructType, key: str, required: list[str], either: list[str]) -> Column:
    """Why a row cannot be written: `missing_<field>` for the first required field (the key before others) that is null or empty, `empty_both` where all of `either` are; else null."""
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    out = F.lit(None).cast("string")
    if either:
        whole = F.lit(True)
        for c in either:
            whole = whole & _blank(c, kinds[c])
        out = F.when(whole, "empty_both")
    for c in reversed([key, *(r for r in required if r != key)]):
        out = F.when(_blank(c, kinds[c]), f"missing_{c}").otherwise(out)
    return out


def _files(spark: SparkSession, reader, schema: T.StructType, folder: str, pattern: str) -> DataFrame:
    return reader.schema(schema).option("pathGlobFilter", pattern).parquet(folder).select("*", F.col("_metadata.file_path").alias(_FILE))


def write_unique(
    spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str, key: str, required: list[str], either: list[str] | None = None, pattern: str = "*.parquet", files_per_batch: int = 1, within: tuple[str, str] | None = None,
    after: Callable[[int], None] | None = None,
) -> None:
    """Takes all files not yet seen and ends; good rows of keys not seen before go to `target`, a folder a batch.

    Without `within` every key is remembered for ever. within=(time column, horizon) forgets keys that are older than the horizon; rows that come later
    than that are dropped by the stream, so the horizon is to be longer than any delay. Of rows of one key in one batch any one is kept. `after` is
    called when a batch is written and before it is committed.
    """
    rows = _files(spark, spark.readStream.option("maxFilesPerTrigger", files_per_batch), schema, folder, pattern).where(why_not(schema, key, required, either or []).isNull())
    fresh = rows.withWatermark(*within).dropDuplicatesWithinWatermark([key]) if within else rows.dropDuplicates([key])

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if after is not None:
            after(number)

    fresh.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def written(spark: SparkSession, schema: T.StructType, target: str) -> DataFrame:
    """The rows that were written, with `batch` and their file."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(_FILE, T.StringType())])).option("basePath", target).parquet(f"{target}/batch=*")


def ledger(spark: SparkSession, folder: str, schema: T.StructType, target: str, key: str, required: list[str], either: list[str] | None = None, pattern: str = "*.parquet") -> DataFrame:
    """(file, reason, n): for each file how many rows were `kept`, were a `duplicate` of one kept from it or another file, or had another reason; they add up to its rows."""
    read = _files(spark, spark.read, schema, folder, pattern).groupBy(F.col(_FILE).alias("file"), F.coalesce(why_not(schema, key, required, either or []), F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))
    kept = written(spark, schema, target).groupBy(F.col(_FILE).alias("file")).agg(F.count("*").alias("kept"))
    good = read.where("reason = 'good'").join(kept, "file", "left").select("file", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("duplicate"))
    told = good.select("file", F.explode(F.create_map(F.lit("kept"), "kept", F.lit("duplicate"), "duplicate")).alias("reason", "n"))
    return read.where("reason <> 'good'").unionByName(told).where("n > 0")

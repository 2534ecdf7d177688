"""Token-ID / binary output: flat files of unsigned ids (16 bits where
the vocabulary fits, else 32) with 64-bit document offsets.

Documents are dealt into ranges of doc_id and the text's front, so rows that
share an id are split by text. Each range is sorted, encoded and written as one
flat file of ids, one of the documents' ends inside it and one of the doc_ids,
of which the first n_null stand for null. The number of ids before a range is a prefix sum over the
ranges' totals; with it, a second pass gives every range a file of absolute
64-bit offsets, so that what is written can be read by anybody.
Files are written under a name of the attempt and then listed, so a lost or
repeated task leaves only files that no list names.

Null text counts as empty (its end id remains). Equal doc_ids are kept, in
order of their texts; a null doc_id comes first. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, text_bytes
from .tokenizing import encoder, text_slices

_PART = "part int, name string, n_docs long, n_null long, n_ids long"
#: Characters of the text by which documents of one doc_id are dealt into ranges.
FRONT = 32


def _id_type(tokenizer: str) -> str:
    """Two bytes an id where the whole vocabulary fits, else four."""
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _write_part(path: str, tokenizer: str, end_id: int):
    def written(batches):
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(path)
        where.create_dir(base, recursive=True)
        kind = _id_type(tokenizer)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        n_docs = n_null = n_ids = 0
        with where.open_output_stream(f"{base}/{name}.ids") as ids_out, where.open_output_stream(f"{base}/{name}.ends") as ends_out, where.open_output_stream(f"{base}/{name}.docs") as docs_out:
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
                for lo, hi in text_slices(sizes, 4 << 20):
                    ids, counts = encoder(tokenizer).encode(batch.column("text")[lo:hi])
                    ends = np.cumsum(counts)
                    ids = np.insert(ids, ends, end_id).astype(kind)
                    ends = ends + np.arange(1, len(ends) + 1)
                    ids_out.write(ids.tobytes())
                    ends_out.write((ends + n_ids).astype("<i8").tobytes())
                    docs_out.write(pc.fill_null(batch.column("doc_id")[lo:hi], 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    n_docs, n_null, n_ids = n_docs + len(ends), n_null + batch.column("doc_id")[lo:hi].null_count, n_ids + len(ids)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([n_docs], pa.int64()), "n_null": pa.array([n_null], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return written


def _mapped(where: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store allows it."""
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if where.get_file_info(path).size else np.empty(0, dtype)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _write_offsets(path: str):
    """The absolute 64-bit offsets of each listed part, beside its other files; a repeated task writes the same."""
    def written(batches):
        where, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{base}/{row['name']}"
                made = f"{stem}.{uuid.uuid4().hex}"
                with where.open_output_stream(made) as out:
                    out.write((np.concatenate([[0], _mapped(where, f"{stem}.ends", "<i8")]) + row["base"]).astype("<i8").tobytes())
                where.move(made, f"{stem}.offsets")
            yield batch

    return written


def _read_part(path: str, tokenizer: str):
    def rows(batches):
        kind = _id_type(tokenizer)
        where, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{base}/{row['name']}"
                ids, docs = _mapped(where, f"{stem}.ids", kind), _mapped(where, f"{stem}.docs", "<i8")
                offsets = _mapped(where, f"{stem}.offsets", "<i8")
                for lo in range(0, len(docs), 20_000):
                    hi = min(lo + 20_000, len(docs))
                    starts, inside = offsets[lo : hi + 1], offsets[lo : hi + 1] - row["base"]
                    crc = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(inside, inside[1:], strict=False)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs[lo:hi], pa.int64(), mask=np.arange(lo, hi) < row["n_null"]), "start": pa.array(starts[:-1], pa.int64()), "n_tokens": pa.array(np.diff(starts), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return rows


def write_token_ids(docs: DataFrame, tokenizer: str, end_id: int, part_bytes: int = 16 << 20) -> tuple[DataFrame, str]:
    """Writes the flat files; returns (one row a part: part, name, n_docs, n_null, n_ids, base) and their folder."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(text_bytes(docs, 16) / part_bytes))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id", F.substring("text", 1, FRONT)).sortWithinPartitions("doc_id", "text")
    listed = materialize(ordered.mapInArrow(_write_part(path, tokenizer, end_id), _PART), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = listed.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(2 * spark.sparkContext.defaultParallelism, 1)
    return materialize(placed.repartition(n, "part").mapInArrow(_write_offsets(path), placed.schema), "token-offsets"), path


def read_token_ids(parts: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Maps the files and gives each document's doc_id, start, n_tokens and ids_crc32."""
    n = max(2 * parts.sparkSession.sparkContext.defaultParallelism, 1)
    return parts.repartition(n, "part").mapInArrow(_read_part(path, tokenizer), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    parts, path = write_token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, 1)
    return read_token_ids(parts, path, tokenizer)

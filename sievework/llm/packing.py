"""Cost-balanced packing of documents into sequences of fixed length.

A document's ids and an end id are cut into full pieces of the sequence
length, which are sequences of their own, and a rest. Pieces are dealt into
groups of about `group_bytes` of text, the full ones of a long document one by
one. In a group, the cost of a piece is estimated as
linear * n + quadratic * n^2 (attention grows with the square), and pieces go in
descending cost to the lowest-cost sequence that still has room. A piece that
fits nowhere is cut over the sequences with room, so that only a group's last
free ids are padding. Padding is implied: a sequence's pieces lie gapless from
offset 0.

Null text counts as empty (its end id is packed), null doc_ids and repeated rows
are packed like others. An empty table gives no rows. Other columns of the
input are left behind.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, text_bytes
from .tokenizing import encoder, text_slices

_PIECES = "doc_id long, start long, length int, doc_tokens long, spread long, ids binary"
PACKED = "doc_id long, start long, length int, doc_tokens long, ids binary, sequence int, offset int, grp long"


def _cut(tokenizer: str, end_id: int, length: int):
    def pieces(batches):
        spread = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for lo, hi in text_slices(sizes, 4 << 20):
                ids, counts = encoder(tokenizer).encode(batch.column("text")[lo:hi])
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // length)
                row = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(length, counts[row] - start)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * 4
                spread += hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[lo:hi].take(pa.array(row)), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(counts[row], pa.int64()),
                        pa.array(row + spread, pa.int64()), pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())]),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "spread", "ids"],
                )
            give_back()

    return pieces


def assign(lengths: np.ndarray, room: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Packs pieces of less than `room` ids; returns (piece, from, length, sequence, offset) rows."""
    cost = linear * lengths + quadratic * lengths.astype(float) ** 2
    n = -(-int(lengths.sum()) // room)
    load, left, out = np.zeros(n), np.full(n, room), []
    for piece in np.lexsort((np.arange(len(lengths)), -cost)):
        size, begin = int(lengths[piece]), 0
        fits = np.flatnonzero(left >= size)
        if len(fits):
            to = fits[load[fits].argmin()]
            out.append((piece, 0, size, to, room - left[to]))
            load[to] += cost[piece]
            left[to] -= size
            continue
        while begin < size:
            to = int(left.argmax())
            part = min(int(left[to]), size - begin)
            out.append((piece, begin, part, to, room - left[to]))
            load[to] += linear * part + quadratic * part**2
            left[to] -= part
            begin += part
    return out


def _pack_group(length: int, linear: float, quadratic: float):
    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("spread", "ascending")]).combine_chunks()
        size = rows["length"].to_numpy().astype(np.int64)
        full, rest = np.flatnonzero(size == length), np.flatnonzero(size < length)
        put = np.array(assign(size[rest], length, linear, quadratic), np.int64).reshape(-1, 5)
        piece = np.concatenate([full, rest[put[:, 0]]])
        begin = np.concatenate([np.zeros(len(full), np.int64), put[:, 1]])
        count = np.concatenate([np.full(len(full), length), put[:, 2]])
        last = int(put[:, 3].max()) + 1 if len(put) else 0
        sequence = np.concatenate([last + np.arange(len(full)), put[:, 3]])
        offset = np.concatenate([np.zeros(len(full), np.int64), put[:, 4]])
        taken = rows.take(pa.array(piece))
        ids = [i.as_py()[4 * b : 4 * (b + c)] for i, b, c in zip(taken["ids"], begin, count, strict=True)]
        return pa.table(
            {
                "doc_id": taken["doc_id"], "start": pa.array(taken["start"].to_numpy() + begin, pa.int64()), "length": pa.array(count, pa.int32()), "doc_tokens": taken["doc_tokens"], "ids": pa.array(ids, pa.binary()),
                "sequence": pa.array(sequence, pa.int32()), "offset": pa.array(offset, pa.int32()), "grp": pa.array([key[0].as_py()] * len(piece), pa.int64()),
            }
        )

    return packed


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, group_bytes: int = 4 << 20, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """Packs all documents; one row a piece with its ids (little-endian unsigned 32-bit)."""
    groups = max(1, math.ceil(text_bytes(docs) / group_bytes))
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer, end_id, length), _PIECES)
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "spread", F.when(F.col("length") == length, F.col("start"))), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInArrow(_pack_group(length, linear, quadratic), PACKED)
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "ids", (F.col("grp") * F.lit(1 << 32) + F.col("sequence")).alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

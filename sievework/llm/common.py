"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset on a local master."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-sievework-")
        sc.setCheckpointDir(_OWN[sc.applicationId])
    return _OWN[sc.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sievework/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what the operators of this application have written between their steps; only once their results are written or no longer needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns a Python worker's freed memory to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(docs: DataFrame, row: int = 0) -> int:
    """UTF-8 bytes of all texts and `row` more for each row, null and empty texts included; decides how many buckets the data is dealt into."""
    return docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + row)).head()[0] or 0


_ONE, _MUL = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one (a multiply-shift finaliser)."""
    h = (h ^ (h >> np.uint64(32))) * _MUL
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive symbols, by doubling the hashed length."""
    h, n = symbols.astype(np.uint64) + _ONE, 1
    while n < k:
        step = min(n, k - n)
        if len(h) <= step:
            return np.empty(0, np.uint64)
        h = h[: len(h) - step] * np.uint64(pow(int(_MUL), step, 1 << 64)) + h[step:]
        n += step
    return mix(h)


def sliding(op, values: np.ndarray, w: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over each w consecutive values, by doubling."""
    n, m = 1, values
    total = len(values) - w + 1
    if total <= 0:
        return values[:0]
    while 2 * n <= w:
        m = op(m[:-n], m[n:])
        n *= 2
    return m if n == w else op(m[:total], m[w - n : w - n + total])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = _ONE
    return np.cumprod(out, out=out)


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of symbols[s:e] for each span, from prefix sums of a polynomial modulo 2^64."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    if symbols.dtype == np.uint8:
        sums[1:] = mix(np.arange(256, dtype=np.uint64))[symbols]
    else:
        sums[1:] = mix(symbols.astype(np.uint64))
    sums[1:] *= _powers(int(_MUL), len(symbols) + 1)[:-1]
    np.cumsum(sums, out=sums)
    out = sums[ends] - sums[starts]
    del sums
    out *= _powers(pow(int(_MUL), -1, 1 << 64), len(symbols) + 1)[starts]
    return mix(out + (ends - starts).astype(np.uint64))


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def pack_planes(values: np.ndarray) -> bytes:
    """Compresses an array of integers byte plane by byte plane; small differences leave most planes empty."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes() if len(raw) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_planes(blob: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack_planes(np.diff(values, prepend=values[:1] * 0))


def unpack_sorted(blob: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack_planes(blob, dtype), dtype=dtype)


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)

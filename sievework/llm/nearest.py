"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt into groups of bounded size, and every cell of
the grid (query group x candidate group) is one task's work. There, unit
vectors are quantised to int8; a tile of products gives approximate cosines,
and the norms of what quantisation left out bound their error. Only pairs whose
upper bound reaches the k-th lower bound are computed again from the original
vectors in double precision and enter the query's heap of k. Cells' heaps are
then merged by rank. The result is exact: no pair is dropped that could be
among the k.

Vectors that are null, zero, or hold null or non-finite components take no
part; vectors of another length than the query's are not its candidates. A
query's own row is left out, other rows of its vec_id are not. Ties go to the
smaller vec_id, a null vec_id last. An empty table gives no rows; other columns
of the input are left behind.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

_NO_ID = np.iinfo(np.int64).max
_VALID = "uid long, vec_id long, dim int, query boolean, vector binary"


def _valid(every: int):
    def rows(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists, ids = batch.column("embedding").to_pylist(), batch.column("vec_id").to_pylist()
            out: dict[str, list] = {n: [] for n in ("uid", "vec_id", "dim", "query", "vector")}
            for i, v in zip(ids, lists, strict=True):
                uid += 1
                if not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    for name, value in (("uid", uid), ("vec_id", _NO_ID if i is None else i), ("dim", len(x)), ("query", i is not None and i % every == 0), ("vector", x.tobytes())):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({"uid": pa.array(out["uid"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "dim": pa.array(out["dim"], pa.int32()), "query": pa.array(out["query"], pa.bool_()), "vector": pa.array(out["vector"], pa.binary())})

    return rows


class Quantised:
    """Unit vectors as int8 with a scale, and the norm of what that leaves out."""

    def __init__(self, rows: pa.Table, dim: int):
        self.uids, self.ids = rows["uid"].to_numpy(), rows["vec_id"].to_numpy()
        self.vectors = np.frombuffer(b"".join(rows["vector"].to_pylist()), np.float64).reshape(-1, dim)
        # Scaled by the largest component first, so that no square over- or underflows.
        top = np.abs(self.vectors).max(axis=1, keepdims=True)
        self.scaled = self.vectors / top
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.scaled, self.scaled))
        unit = self.scaled / self.norms[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.missing = np.linalg.norm(unit - self.codes * self.scale[:, None], axis=1) + 1e-9


def search_cell(queries: Quantised, candidates: Quantised, k: int, tile: int = 2048) -> list[list[tuple[float, int, int]]]:
    """For each query the k best (score, -vec_id, uid), from tiles of candidates."""
    heaps: list[list] = [[] for _ in queries.ids]
    # Sums of products of int8 stay exact in float32 up to this length, beyond it in float64.
    kind = np.float32 if queries.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    left = queries.codes.astype(kind)
    for lo in range(0, len(candidates.ids), tile):
        part = slice(lo, lo + tile)
        about = (left @ candidates.codes[part].astype(kind).T).astype(np.float64) * queries.scale[:, None] * candidates.scale[part]
        error = queries.missing[:, None] + (1 + queries.missing[:, None]) * candidates.missing[part]
        about[queries.uids[:, None] == candidates.uids[part]] = -np.inf
        low = about - error
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
        q, c = np.nonzero((about + error >= floor[:, None]) & np.isfinite(about))
        for a in range(0, len(q), 1 << 16):
            qs, cs = q[a : a + (1 << 16)], c[a : a + (1 << 16)] + lo
            exact = np.einsum("ij,ij->i", queries.scaled[qs], candidates.scaled[cs]) / (queries.norms[qs] * candidates.norms[cs])
            for i, s, v, u in zip(qs.tolist(), exact.tolist(), candidates.ids[cs].tolist(), candidates.uids[cs].tolist(), strict=True):
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], (s, -v, u))
                elif (s, -v, u) > heaps[i][0]:
                    heapq.heapreplace(heaps[i], (s, -v, u))
    return heaps


def _cell(k: int):
    def found(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names = {"quid": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        dim = key[0].as_py()
        left = Quantised(queries, dim)
        rows = [(u, i, -v, s) for u, i, heap in zip(left.uids.tolist(), left.ids.tolist(), search_cell(left, Quantised(candidates, dim), k), strict=True) for s, v, _ in heap]
        return pa.table({n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate(names.items())})

    return found


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, group_queries: int = 1024, group_candidates: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose vec_id is divisible by `every`."""
    valid = materialize(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_valid(every), _VALID), "vectors")
    n, n_queries = valid.agg(F.count("*"), F.count_if("query")).head()
    across, down = max(1, math.ceil(n / group_candidates)), max(1, math.ceil(n_queries / group_queries))
    deal = lambda groups: F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int")
    queries = valid.where("query").select("*", deal(down).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))
    candidates = valid.select("*", deal(across).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("q"))
    cells = queries.groupBy("dim", "q", "c").cogroup(candidates.groupBy("dim", "q", "c")).applyInArrow(_cell(k), "quid long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("vec_id") < _NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


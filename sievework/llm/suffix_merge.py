"""Suffix-array dedup: exact repeated byte spans by merging shard Burrows-Wheeler transforms.

Each shard of strings gets its own transform over one to four symbols at once,
from a sort of the shard's rotations. The merge starts from the shards one after
the other and refines the interleave: each pass reads every shard's transform in
its own order through the current interleave and deals the rows stably by the
symbols read, after which rows are in order of that many further symbols: four
or three in most texts, as many as 65,536 numbers tell apart. Suffixes of
different shards are never compared or sorted again. Boundaries that the passes
leave are where the common prefix of neighbouring rows ends, so when the passes
have read the window's width a block of rows is one repeated window.

Null text counts as empty; texts shorter than a window keep all their bytes.
Rows with one doc_id do not remove one another; a null doc_id counts as larger
than all others. Copies of a text all lose to the smallest doc_id. An empty
table gives no rows; other columns of the input are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import NO_ID
from .repeats import Bytes, repeated_windows

SHARD_SYMBOLS = 1 << 18
#: Symbols that a pass of the merge reads at most.
LONGEST_READ = 4


class Rotations:
    """The strings of a shard, each closed by symbol 0 and read round and round."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        size = lengths + 1
        self.begins = np.cumsum(size) - size
        total = int(size.sum())
        self.symbols = np.zeros(total, np.int64)
        inside = np.ones(total, bool)
        inside[self.begins + lengths] = False
        self.symbols[inside] = symbols
        self.owner = np.repeat(np.arange(len(lengths)), size)
        self.begin, self.long = self.begins[self.owner], size[self.owner]

    def ahead(self, d: int) -> np.ndarray:
        """The position d symbols further in the same string; d is less than each string's length, and may be negative."""
        to = np.arange(d, d + len(self.symbols))
        if d < 0:
            return np.where(to < self.begin, to + self.long, to)
        return np.where(to >= self.begin + self.long, to - self.long, to)

    def order(self, depth: int) -> np.ndarray:
        """Positions sorted by their next `depth` symbols at least, by doubling the sorted length."""
        rank, n = self.symbols, 1
        if self.symbols.max(initial=0) < 256:  # bytes: eight at once
            rank = rank.astype(np.uint64)
            while n < 8:
                rank = (rank << np.uint64(8 * n)) | rank[self.ahead(n)]
                n *= 2
        while True:
            order = np.argsort(rank)
            ordered = rank[order]
            dense = np.empty(len(order), np.int64)
            dense[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            if n >= depth or dense.max(initial=0) == len(order) - 1:
                return order
            rank = dense * (len(order) + 1) + dense[self.ahead(n)]
            n *= 2


def ranked(codes: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    """Numbers codes below `base` from 0 without gaps, in their order; returns the numbers and how many there are."""
    there = np.zeros(base, bool)
    there[codes] = True
    rank = np.cumsum(there, dtype=np.int32)
    return (rank - 1)[codes], int(rank[-1])


def reads(preceding: list[np.ndarray], most: int = 1 << 16) -> list[np.ndarray]:
    """What the passes read: of the symbols 1, 2, 3 and 4 places before each row, the numbers of the last 1, 2, ... together, while `most` tell them apart."""
    code, n = ranked(preceding[0], 256)
    out = [code.astype(np.uint16)]
    for symbol in preceding[1:]:
        if n > most:
            break
        code, n = ranked(symbol.astype(np.int32) * n + code, 256 * n)
        if n <= most:
            out.append(code.astype(np.uint16))
    return out


def merge(joined: list[np.ndarray], sizes: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Refines the interleave of transforms of these sizes that lie one after the other; returns the shard of each merged row and the number of its block of equal prefixes.

    The transform joined[d - 1] numbers the d symbols before each row; passes read the longest that there are.
    """
    shards = np.repeat(np.arange(len(sizes), dtype=np.uint8 if len(sizes) <= 256 else np.uint16), sizes)
    block = np.zeros(len(shards), np.int32)
    read = np.empty(len(shards), np.uint16)
    done = 0
    while done < width:
        d = min(len(joined), width - done)
        read[np.argsort(shards, kind="stable")] = joined[d - 1]
        order = np.argsort(read, kind="stable")
        shards, symbol, block = shards[order], read[order], block[order]
        edge = np.zeros(len(order), bool)
        edge[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(edge, dtype=np.int32)
        done += d
    return shards, block


def match_by_merge(symbols: np.ndarray, lengths: np.ndarray, least: np.ndarray, width: int, shard_symbols: int = SHARD_SYMBOLS) -> np.ndarray:
    """For each window of each string, string after string: is it in a string with a smaller `least`?

    The symbols are bytes (0 to 254).
    """
    shard = (np.cumsum(lengths) - lengths) // shard_symbols
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(lengths)]
    ends = np.cumsum(lengths)
    wide = symbols.astype(np.int64) + 1
    preceding, rows = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        some = Rotations(wide[ends[a] - lengths[a] : ends[b - 1]], lengths[a:b])
        order = some.order(width)
        preceding.append([some.symbols[some.ahead(-d)[order]].astype(np.uint8) for d in range(1, min(LONGEST_READ, width) + 1)])
        rows.append((a + some.owner[order], (order - some.begins[some.owner[order]])))
    joined = reads([np.concatenate(p) for p in zip(*preceding, strict=True)])
    shards, block = merge(joined, [len(p[0]) for p in preceding], width)
    order = np.argsort(shards, kind="stable")
    string, place = np.empty(len(block), np.int64), np.empty(len(block), np.int64)
    string[order] = np.concatenate([r[0] for r in rows])
    place[order] = np.concatenate([r[1] for r in rows])
    windows = lengths - width + 1
    whole = place < windows[string]
    string, place, block = string[whole], place[whole], block[whole]
    found = np.zeros(int(windows.sum()), bool)
    if len(block):
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        low = np.repeat(np.minimum.reduceat(least[string], first), np.diff(np.append(first, len(block))))
        found[(np.cumsum(windows) - windows)[string] + place] = low < least[string]
    return found


def _kept_bytes(view, gone: np.ndarray) -> pa.RecordBatch:
    offsets = view.offsets
    total = np.concatenate([[0], np.cumsum(gone)])
    edge = np.zeros(len(gone) + 1, np.int64)
    if len(gone):
        edge[1:-1] = gone[1:] & ~gone[:-1]
        starts = offsets[:-1][np.diff(offsets) > 0]
        edge[starts] = gone[starts]
    runs = np.concatenate([[0], np.cumsum(edge[:-1])])
    left = view.symbols[~gone].tobytes()
    upto = offsets - total[offsets]
    ids = view.block.ids
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(np.diff(total[offsets]), pa.int64()), "n_spans": pa.array(np.diff(runs[offsets]), pa.int64()),
            "kept": pa.array([left[a:b] for a, b in zip(upto, upto[1:], strict=False)], pa.binary()),
        }
    )


def remove_repeated_bytes(docs: DataFrame, width: int = 50, **options) -> DataFrame:
    """Each document's doc_id, n_bytes, n_removed, n_spans and kept bytes, without what a window of a smaller doc_id covers."""
    return repeated_windows(docs, Bytes, match_by_merge, _kept_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", width, **{"k": (width + 1) // 2 - 1, **options})


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

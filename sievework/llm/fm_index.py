"""Substring dedup with a compressed FM-index per shard.

The words of a shard's strings are indexed by a Burrows-Wheeler transform in a
wavelet matrix: bits of the symbols, level by level, packed into 64-bit words
with running counts. Backward search through it extends every streamed string's
match to the left, word by word and all strings at once; where no extension
exists, the match is shortened to the parent interval. That gives matching
statistics, and where they reach the window's width, the interval's smallest
doc_id tells whether an earlier document holds the window.

Null text counts as empty; texts of fewer words than a window keep them all.
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
from .repeats import Words, repeated_windows
from .suffix_merge import Rotations

SHARD_WORDS = 1 << 20


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one packed bit vector a level."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1])
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        every = np.arange(top + 1)
        #: Where each symbol's walk through the levels begins.
        self.begin = self._walk(every, np.zeros_like(every))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.counts[level][word] + np.bitwise_count(self.bits[level][word] & ((np.uint64(1) << low) - np.uint64(1)))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            bit = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            ones = self._ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `at` ones."""
        return self._walk(symbol, at) - self.begin[symbol]


class FMIndex:
    """The index of one shard; rows are suffixes in order of their first `width` symbols."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, least: np.ndarray, width: int, top: int):
        text = Rotations(symbols, lengths)
        order = text.order(width)
        self.width = width
        self.transform = WaveletMatrix(text.symbols[text.ahead(-1)][order], top)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text.symbols, minlength=top + 1))])
        # Common prefixes of neighbouring rows, up to the width.
        prefix, alive, rows = np.zeros(len(order) + 1, np.int16), np.arange(1, len(order)), order.copy()
        following = text.ahead(1)
        for d in range(width):
            step = text.symbols[rows]
            alive = alive[step[alive] == step[alive - 1]]
            prefix[alive] = d + 1
            rows = following[rows]
        prefix[0] = prefix[-1] = -1
        self.prefix = prefix
        whole = (order - text.begins[text.owner[order]]) < (lengths - width + 1)[text.owner[order]]
        docs = np.where(whole, least[text.owner[order]], np.iinfo(np.int64).max)
        first = np.flatnonzero(prefix[:-1] < width)
        size = np.diff(np.append(first, len(order)))
        self.class_begin, self.class_size = np.repeat(first, size), np.repeat(size, size)
        self.class_least = np.repeat(np.minimum.reduceat(docs, first), size)
        # Minima of the common prefixes over 1, 2, 4, ... rows, to find parents.
        self.minima = [prefix]
        while 2 << len(self.minima) <= len(prefix):
            last = self.minima[-1]
            step = 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-step], last[step:]))

    def _extend(self, symbol: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the symbol before those of begin to end - 1: a step of backward search."""
        both = np.concatenate([symbol, symbol])
        out = self.smaller[both] + self.transform.rank(both, np.concatenate([begin, end]))
        return out[: len(symbol)], out[len(symbol) :]

    def _parent(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger interval of rows with a common prefix, and that prefix's length."""
        depth = np.maximum(self.prefix[begin], self.prefix[end]).astype(np.int64)
        for level in reversed(range(len(self.minima))):
            step, low = 1 << level, self.minima[level]
            back = begin - step + 1
            move = (back > 0) & (low[np.maximum(back, 0)] >= depth)
            begin = np.where(move, begin - step, begin)
            ahead = np.minimum(end, len(low) - 1)
            move = (end + step < len(self.prefix)) & (low[ahead] >= depth)
            end = np.where(move, end + step, end)
        return begin, end, depth

    def stream(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each window of the strings, string after string: the smallest doc_id in this shard that holds it."""
        windows = lengths - self.width + 1
        out = np.full(int(windows.sum()), np.iinfo(np.int64).max)
        to, ends = np.cumsum(windows) - windows, np.cumsum(lengths)
        order = np.argsort(-lengths, kind="stable")
        begin, end = np.zeros(len(order), np.int64), np.full(len(order), len(self.prefix) - 1)
        length = np.zeros(len(order), np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = order[: np.searchsorted(-lengths[order], -step, side="left")]
            symbol = symbols[ends[live] - 1 - step]
            b, e, n = begin[live], end[live], length[live]
            lo, hi = self._extend(symbol, b, e)
            open_ = np.flatnonzero((lo >= hi) & (n > 0))
            n = np.where(lo < hi, n + 1, 0)
            while len(open_):  # shorten the match until it can be extended
                b[open_], e[open_], depth = self._parent(b[open_], e[open_])
                some = symbol[open_]
                lo[open_], hi[open_] = self._extend(some, b[open_], e[open_])
                n[open_] = np.where(lo[open_] < hi[open_], depth + 1, 0)
                open_ = open_[(lo[open_] >= hi[open_]) & (depth > 0)]
            none = lo >= hi
            lo, hi = np.where(none, 0, lo), np.where(none, len(self.prefix) - 1, hi)
            full = np.flatnonzero(n >= self.width)
            if len(full):
                row = lo[full]
                out[to[live[full]] + lengths[live[full]] - 1 - step] = self.class_least[row]
                lo[full], hi[full], n[full] = self.class_begin[row], self.class_begin[row] + self.class_size[row], self.width
            begin[live], end[live], length[live] = lo, hi, n
        return out


def match_by_index(symbols: np.ndarray, lengths: np.ndarray, least: np.ndarray, width: int, shard_words: int = SHARD_WORDS) -> np.ndarray:
    """For each window of each string, string after string: is it in a string with a smaller `least`?"""
    _, dense = np.unique(symbols, return_inverse=True)
    dense = dense.astype(np.int64) + 1
    top = int(dense.max(initial=0))
    shard = (np.cumsum(lengths) - lengths) // shard_words
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(lengths)]
    ends = np.cumsum(lengths)
    windows = lengths - width + 1
    low = np.full(int(windows.sum()), np.iinfo(np.int64).max)
    for a, b in zip(cuts, cuts[1:], strict=False):
        index = FMIndex(dense[ends[a] - lengths[a] : ends[b - 1]], lengths[a:b], least[a:b], width, top)
        low = np.minimum(low, index.stream(dense, lengths))
    return low < np.repeat(least, windows)


def _kept_words(view, gone: np.ndarray) -> pa.RecordBatch:
    total = np.concatenate([[0], np.cumsum(gone)])
    offsets, raw = view.offsets, view.block.raw
    kept = [b" ".join([raw[s:e] for s, e in zip(view.starts[a:b][~gone[a:b]].tolist(), view.ends[a:b][~gone[a:b]].tolist(), strict=True)]) for a, b in zip(offsets, offsets[1:], strict=False)]
    ids = view.block.ids
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "n_words": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(np.diff(total[offsets]), pa.int64()), "kept": pa.array(kept, pa.binary())})


def remove_repeated_words(docs: DataFrame, width: int = 50, **options) -> DataFrame:
    """Each document's doc_id, n_words, n_removed and kept words (UTF-8, joined by a space)."""
    return repeated_windows(docs, Words, match_by_index, _kept_words, "doc_id long, n_words long, n_removed long, kept binary", width, **{"k": max(1, width // 4), "symbol_bytes": 6, "bucket_bytes": 3 << 19, **options})


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

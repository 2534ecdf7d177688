"""Windows of symbols that also start in a document with a smaller doc_id.

The symbols are bytes or words; a window is `width` consecutive symbols of one
document. Documents lie in blocks. Of each window, the smallest hash of its
k-symbol parts is its fingerprint (winnowing): equal windows have equal
fingerprints, and neighbouring windows mostly share theirs, so a document
falls into runs of windows with one fingerprint.

1. Each block sends its distinct fingerprints, as sorted and packed lists, to
   their ranges; a range answers each list with bits: is the fingerprint in
   more than one document, and is it in very many different runs?
2. Each load of a few blocks sends the text of its repeated runs, each distinct
   one once, to the fingerprints' buckets. There, equal runs become one string with the
   smallest doc_id that holds it, and a matcher (an FM-index or a merge of
   Burrows-Wheeler transforms) says which windows of a string are also in a
   string with a smaller doc_id. Runs of a fingerprint with very many
   different texts are sent window by window, keyed by the window's own hash,
   so no bucket holds an unbounded group.
3. What is found comes back to each load, which parts it among its blocks.

No step drops, caps or samples anything, and no document goes to one task with
its copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, Block, block_table
from .common import gather_ranges, mix, pack_planes, pack_sorted, sliding, span_hashes, squeeze, unpack_planes, unpack_sorted, unsqueeze, window_hashes


#: Windows of a run; what repeats itself over and over is cut into runs of this length.
LONGEST = 128
#: Blocks that send their runs together; rows between blocks and buckets are fewer by that factor.
LOAD = 8


class Bytes:
    """Symbols are the bytes of a text."""

    def __init__(self, block: Block):
        self.symbols, self.offsets, self.block = block.bytes, block.offsets, block

    @staticmethod
    def unpack(raw: bytes, lengths: np.ndarray) -> np.ndarray:
        return np.frombuffer(raw, np.uint8)

    @staticmethod
    def pack(views: list[Bytes]) -> Callable[[np.ndarray, np.ndarray], bytes]:
        """Packs ranges of the symbols of several views, which count as lying one after the other."""
        symbols = np.concatenate([v.symbols for v in views])
        return lambda starts, lengths: symbols[gather_ranges(starts, lengths)].tobytes()


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last byte of each word: what lies between bytes 0x20 and 0x09 to 0x0D, and never crosses an offset."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends


class Words:
    """Symbols are 64-bit hashes of the words of a text."""

    def __init__(self, block: Block):
        self.starts, self.ends = word_spans(block.bytes, block.offsets)
        self.symbols = span_hashes(block.bytes, self.starts, self.ends)
        self.offsets = np.searchsorted(self.starts, block.offsets)
        self.block = block

    @staticmethod
    def unpack(raw: bytes, lengths: np.ndarray) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8)
        starts, ends = word_spans(data, np.array([0, len(data)]))
        return span_hashes(data, starts, ends)

    @staticmethod
    def pack(views: list[Words]) -> Callable[[np.ndarray, np.ndarray], bytes]:
        """Packs ranges of the words of several views, which count as lying one after the other."""
        raw = np.concatenate([v.block.bytes for v in views])
        base = np.cumsum([0, *(len(v.block.bytes) for v in views)])
        begin = np.concatenate([v.starts + b for v, b in zip(views, base, strict=False)])
        long = np.concatenate([v.ends - v.starts for v in views])

        def packed(starts: np.ndarray, lengths: np.ndarray) -> bytes:
            word = gather_ranges(starts, lengths)
            size = long[word]
            out = np.full(int(size.sum()) + len(word), 32, np.uint8)
            to = np.cumsum(size + 1) - size - 1
            out[gather_ranges(to, size)] = raw[gather_ranges(begin[word], size)]
            return out.tobytes()

        return packed


class Runs:
    """Runs of windows with one fingerprint, of LONGEST windows at most: run r has the windows that start at starts[r] to ends[r] - 1."""

    def __init__(self, view, k: int, width: int):
        symbols, offsets = view.symbols, view.offsets
        lows = sliding(np.minimum, window_hashes(symbols, k), width - k + 1)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(lows)]
        whole = np.arange(len(lows)) + width <= offsets[doc + 1]
        first = np.empty(len(lows), bool)
        if len(lows):
            first[0] = True
            first[1:] = (lows[1:] != lows[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(first & whole)
        last = np.empty(len(lows), bool)
        if len(lows):
            last[-1] = True
            last[:-1] = first[1:] | ~whole[1:]
        size = np.flatnonzero(last & whole) + 1 - starts
        parts = -(-size // LONGEST)
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
        self.starts = np.repeat(starts, parts) + step
        self.ends = self.starts + np.minimum(np.repeat(size, parts) - step, LONGEST)
        # The smallest of many hashes is a small number; scrambled one to one, fingerprints fill ranges and buckets evenly.
        self.prints, self.docs = mix(lows[self.starts]), doc[self.starts]
        self.width = width

    def one_by_one(self, which: np.ndarray, view) -> None:
        """Replaces the runs of a mask by their single windows, keyed by the window's hash."""
        size = (self.ends - self.starts)[which]
        windows = gather_ranges(self.starts[which], size)
        keys = mix(span_hashes(view.symbols, windows, windows + self.width) ^ np.repeat(self.prints[which], size))
        docs = np.repeat(self.docs[which], size)
        self.starts, self.ends = np.concatenate([self.starts[~which], windows]), np.concatenate([self.ends[~which], windows + 1])
        self.prints, self.docs = np.concatenate([self.prints[~which], keys]), np.concatenate([self.docs[~which], docs])

    def texts(self, view) -> np.ndarray:
        return span_hashes(view.symbols, self.starts, self.ends + self.width - 1)


def _range_of(prints: np.ndarray, n: int) -> np.ndarray:
    """Which of n ranges of equal width a 64-bit number lies in; grows with the number."""
    return ((prints >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _send_prints(view_of, k: int, width: int, ranges: int):
    def sent(batches):
        for batch in batches:
            for row in batch.to_pylist():
                view = view_of(block := Block(row))
                runs = Runs(view, k, width)
                text = runs.texts(view)
                order = np.lexsort((text, runs.prints))
                prints, text, docs = runs.prints[order], text[order], block.ids[runs.docs[order]]
                if not len(prints):
                    continue
                first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
                other = np.concatenate([[True], (prints[1:] != prints[:-1]) | (text[1:] != text[:-1])])
                kinds = np.add.reduceat(other.astype(np.int32), first)
                several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
                prints, notes = prints[first], (2 * kinds + several).astype(np.int32)
                at = _range_of(prints, ranges)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(at[cuts[:-1]].astype(np.int64)), "block": pa.array([block.number] * (len(cuts) - 1), pa.int64()),
                        "prints": pa.array([pack_sorted(prints[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                        "notes": pa.array([pack_planes(notes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    }
                )

    return sent


def _answer_prints(many: int):
    def answered(key: tuple, rows: pa.Table) -> pa.Table:
        lists = [unpack_sorted(x) for x in rows["prints"].to_pylist()]
        notes = np.concatenate([unpack_planes(x, np.int32) for x in rows["notes"].to_pylist()])
        order = np.argsort(everything := np.concatenate(lists), kind="stable")
        ordered = everything[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        size = np.diff(np.append(first, len(ordered)))
        repeated = (size > 1) | (np.maximum.reduceat(notes[order] & 1, first) > 0)
        crowded = repeated & (np.add.reduceat((notes[order] >> 1).astype(np.int64), first) > many)
        answer = np.empty(len(order), np.uint8)
        answer[order] = np.repeat(repeated + 2 * crowded.astype(np.uint8), size)
        ends = np.cumsum([len(x) for x in lists])
        return pa.table({"block": rows["block"], "part": rows["part"], "answer": pa.array([squeeze(np.packbits(np.unpackbits(answer[e - len(x) : e, None], axis=1)[:, 6:]).tobytes()) for x, e in zip(lists, ends, strict=True)], pa.binary()), "n": pa.array([len(x) for x in lists], pa.int64())})

    return answered


def _repeated_runs(view_of, k: int, width: int, row: dict):
    """A block's view, and those of its runs whose fingerprint is repeated."""
    view = view_of(Block(row))
    runs = Runs(view, k, width)
    distinct, back = np.unique(runs.prints, return_inverse=True)
    bits = [np.unpackbits(np.frombuffer(unsqueeze(a["answer"]), np.uint8))[: 2 * a["n"]].reshape(-1, 2) for a in sorted(row["answers"], key=lambda a: a["part"])]
    answer = np.concatenate(bits)[back].astype(bool)
    crowded, repeated = answer[:, 0], answer[:, 1]
    for name in ("starts", "ends", "prints", "docs"):
        setattr(runs, name, getattr(runs, name)[repeated])
    if crowded.any():
        runs.one_by_one(crowded[repeated], view)
    return view, runs


def _send_load(load: list, width: int, buckets: int) -> pa.RecordBatch:
    views, all_runs = zip(*load, strict=True)
    pack = type(views[0]).pack(views)
    text = np.concatenate([r.texts(v) for v, r in load])
    order = np.lexsort((text, np.concatenate([r.prints for r in all_runs])))
    of = lambda what: np.concatenate([what(v, r) for v, r in load])[order]
    prints, text, windows, starts, ids = of(lambda v, r: r.prints), text[order], of(lambda v, r: r.ends - r.starts), of(lambda v, r: r.starts - v.offsets[r.docs]), of(lambda v, r: v.block.ids[r.docs])
    # A document is named by its block's place in the load and its own in the block.
    each = [len(r.docs) for r in all_runs]
    docs = of(lambda v, r: r.docs) + (np.repeat(np.arange(len(load)), each)[order] << 32)
    at_symbol = of(lambda v, r: r.starts) + np.repeat(np.cumsum([0, *(len(v.symbols) for v in views[:-1])]), each)[order]
    new = np.concatenate([[True], (prints[1:] != prints[:-1]) | (text[1:] != text[:-1])])
    at = _range_of(prints, buckets)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
    blocks = np.array([v.block.number for v in views], np.int64)
    out: dict[str, list] = {n: [] for n in ("bucket", "load", "blocks", "prints", "windows", "texts", "string", "docs", "starts", "ids")}
    for a, b in zip(cuts, cuts[1:], strict=False):
        mine = np.flatnonzero(new[a:b]) + a
        out["bucket"].append(int(at[a]))
        out["load"].append(int(blocks[0]))
        out["blocks"].append(blocks.tobytes())
        out["prints"].append(pack_sorted(prints[mine]))
        out["windows"].append(pack_planes(windows[mine]))
        out["texts"].append(squeeze(pack(at_symbol[mine], windows[mine] + width - 1)))
        out["string"].append(pack_planes(np.cumsum(new[a:b]) - 1))
        out["docs"].append(pack_planes(docs[a:b]))
        out["starts"].append(pack_planes(starts[a:b]))
        out["ids"].append(pack_planes(ids[a:b]))
    return pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64() if n in ("bucket", "load") else pa.binary()) for n, v in out.items()})


def _send_runs(view_of, k: int, width: int, buckets: int):
    def sent(batches):
        load: list = []
        for batch in batches:
            for row in batch.to_pylist():
                view, runs = _repeated_runs(view_of, k, width, row)
                if len(runs.prints):
                    load.append((view, runs))
                if len(load) == LOAD:
                    yield _send_load(load, width, buckets)
                    load = []
        if load:
            yield _send_load(load, width, buckets)

    return sent


Matcher = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def _match_bucket(view_class, matcher: Matcher, width: int):
    def found(key: tuple, rows: pa.Table) -> pa.Table:
        lists = rows.to_pydict()
        n = rows.num_rows
        prints = np.concatenate([unpack_sorted(x) for x in lists["prints"]])
        each = [unpack_planes(x, np.int64) for x in lists["windows"]]
        windows = np.concatenate(each)
        symbols = np.concatenate([view_class.unpack(unsqueeze(t), w) for t, w in zip(lists["texts"], each, strict=True)])
        lists["texts"] = None
        lengths = windows + width - 1
        ends = np.cumsum(lengths)
        text = span_hashes(symbols, ends - lengths, ends)
        counts = np.array([len(x) for x in each])
        sent_string = [unpack_planes(x, np.int64) for x in lists["string"]]
        string = np.concatenate([s + base for s, base in zip(sent_string, np.cumsum(counts) - counts, strict=True)])
        ids = np.concatenate([unpack_planes(x, np.int64) for x in lists["ids"]])

        order = np.lexsort((text, prints))
        new = np.concatenate([[True], (prints[order][1:] != prints[order][:-1]) | (text[order][1:] != text[order][:-1])])
        same = np.empty(len(order), np.int64)
        same[order] = np.cumsum(new) - 1
        kept = order[new]  # one of each distinct string
        string = same[string]
        least = np.full(len(kept), np.iinfo(np.int64).max)
        np.minimum.at(least, string, ids)
        # Only a fingerprint with several strings can have windows of one string in another.
        group = np.cumsum(np.concatenate([[True], prints[kept][1:] != prints[kept][:-1]])) - 1
        mixed = np.flatnonzero(np.bincount(group)[group] > 1)
        hits = np.zeros(int(windows[kept].sum()), bool)
        upto = np.cumsum(windows[kept])
        if len(mixed):
            pick = kept[mixed]
            got = matcher(symbols[gather_ranges(ends[pick] - lengths[pick], lengths[pick])], lengths[pick], least[mixed], width)
            hits[gather_ranges(upto[mixed] - windows[pick], windows[pick])] = got
        # A holder other than the first has all its windows repeated.
        size = windows[kept][string]
        copy = ids > least[string]
        begins = np.concatenate([unpack_planes(x, np.int64) for x in lists["starts"]])
        docs = np.concatenate([unpack_planes(x, np.int64) for x in lists["docs"]])
        owner = np.repeat(np.arange(n), [len(s) for s in sent_string])
        first = np.flatnonzero(~copy)
        at = gather_ranges(upto[string[first]] - size[first], size[first])
        who = np.repeat(first, size[first])
        place = gather_ranges(begins[first], size[first])
        flag = hits[at]
        turn = np.empty(len(flag), bool)
        if len(flag):
            turn[0] = flag[0]
            turn[1:] = flag[1:] & (~flag[:-1] | (who[1:] != who[:-1]))
        stop = np.empty(len(flag), bool)
        if len(flag):
            stop[-1] = flag[-1]
            stop[:-1] = flag[:-1] & (~flag[1:] | (who[1:] != who[:-1]))
        lo, hi = place[turn], place[stop] + 1
        rows_of = np.concatenate([np.flatnonzero(copy), who[turn]])
        lo, hi = np.concatenate([begins[copy], lo]), np.concatenate([begins[copy] + size[copy], hi])
        order = np.lexsort((lo, docs[rows_of], owner[rows_of]))
        cuts = np.searchsorted(owner[rows_of][order], np.arange(n + 1))
        out = [[pack_planes(x[order[a:b]]) for x in (docs[rows_of], lo, hi - lo)] for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"load": rows["load"], "blocks": rows["blocks"], "docs": pa.array([x[0] for x in out], pa.binary()), "starts": pa.array([x[1] for x in out], pa.binary()), "sizes": pa.array([x[2] for x in out], pa.binary())})

    return found


def _part_load(key: tuple, rows: pa.Table) -> pa.Table:
    """What all buckets found in a load, as one row for each of its blocks."""
    blocks = np.frombuffer(rows["blocks"][0].as_py(), np.int64)
    docs, starts, sizes = (np.concatenate([unpack_planes(x, np.int64) for x in rows[n].to_pylist()]) for n in ("docs", "starts", "sizes"))
    order = np.argsort(docs, kind="stable")
    cuts = np.searchsorted(docs[order] >> 32, np.arange(len(blocks) + 1))
    out = [[pack_planes(x[order[a:b]]) for x in (docs & 0xFFFFFFFF, starts, sizes)] for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"block": pa.array(blocks), **{n: pa.array(x, pa.binary()) for n, x in zip(("docs", "starts", "sizes"), zip(*out, strict=True), strict=True)}})


def covered(view, found: list[dict], width: int) -> np.ndarray:
    """A mask of the symbols that lie in the found windows."""
    depth = np.zeros(len(view.symbols) + 1, np.int64)
    for x in found:
        docs, starts, sizes = (unpack_planes(x[n], np.int64) for n in ("docs", "starts", "sizes"))
        begin = view.offsets[docs] + starts
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + sizes + width - 1, -1)
    return np.cumsum(depth[:-1]) > 0


def repeated_windows(docs: DataFrame, view_class, matcher: Matcher, finish, schema: str, width: int = 50, k: int = 24, many: int = 50_000, bucket_bytes: int = 1 << 20, symbol_bytes: int = 1) -> DataFrame:
    """Runs the steps above; `finish` maps (view, mask of removed symbols) of each block to a record batch of `schema`."""
    blocks, total = block_table(docs)
    buckets = max(1, math.ceil(total / bucket_bytes))
    ranges = max(1, math.ceil(total / symbol_bytes / (8 << 20)))
    answers = (
        blocks.mapInArrow(_send_prints(view_class, k, width, ranges), "part long, block long, prints binary, notes binary")
        .groupBy("part").applyInArrow(_answer_prints(many), "block long, part long, answer binary, n long")
        .groupBy("block").agg(F.collect_list(F.struct("part", "answer", "n")).alias("answers"))
    )
    runs = blocks.join(answers.hint("shuffle_hash"), "block").mapInArrow(_send_runs(view_class, k, width, buckets), "bucket long, load long, blocks binary, prints binary, windows binary, texts binary, string binary, docs binary, starts binary, ids binary")
    found = (
        runs.groupBy("bucket").applyInArrow(_match_bucket(view_class, matcher, width), "load long, blocks binary, docs binary, starts binary, sizes binary")
        .groupBy("load").applyInArrow(_part_load, "block long, docs binary, starts binary, sizes binary")
    )

    def finished(batches):
        for batch in batches:
            for row in batch.to_pylist():
                view = view_class(Block(row))
                yield finish(view, covered(view, [row] if row["docs"] is not None else [], width))

    return blocks.join(found.hint("shuffle_hash"), "block", "left").mapInArrow(finished, schema)


__all__ = ["BLOCK", "Bytes", "Words", "repeated_windows", "word_spans"]

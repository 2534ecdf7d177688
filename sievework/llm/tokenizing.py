"""Token ids of whole texts, encoding each distinct word of a batch once.

A byte-level or word-level BPE never joins bytes across the place before a
space that a non-space follows, so a text's ids are its pieces' ids in a row.
For the same reason new words are encoded many at once: those of a plain
byte-level tokenizer as one text, in which the bytes of the tokens say where
words end, others with a special token between them.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gather_ranges, span_hashes

#: White space of Unicode, which the tokenizers' \s means.
_SPACE = r"\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CUT = re.compile(r"(?= (?=\S))")
_MARK = "\x1f"


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each large string begins and the last ends, and all strings' bytes in a row."""
    if not len(words):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return offsets - offsets[0], np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


class TextEncoder:
    """Encodes arrays of texts with the tokenizer in a file.

    Between batches, at most about `kept` words stay in memory: their ids in one
    array, found by a 64-bit hash of the word with its length, ends and sum
    beside it. Beyond that, the longest unused half goes.
    """

    def __init__(self, path: str, kept: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        # A word tokenizer drops white space, so that any space or line end parts words.
        self.drops_space = '"Removed"' in json.dumps(spec["pre_tokenizer"])
        # A special token between words lets many be encoded as one text, which it parts before anything else.
        self.parting = next(((t["content"], t["id"]) for t in spec["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"])), None)
        #: Bytes of each token, where every token stands for its own bytes of the text and for nothing else.
        self.token_bytes = self._token_bytes(spec)
        self.added_begin = sorted({t["content"][:2] for t in spec["added_tokens"]})
        self.kept, self.batch = kept, 0
        self.ids = np.empty(0, np.uint32)
        #: Of each known word, in order of the hash: hash, check, place in ids, number of ids, last batch that had it.
        self.table = [np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All texts' pieces in a row, and each text's number of pieces."""
        if self.drops_space:
            parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            return parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        odd = pc.or_(pc.match_substring_regex(texts, f" [{_SPACE}]"), pc.or_(pc.ends_with(texts, " "), pc.match_substring(texts, _MARK))).to_numpy(zero_copy_only=False)
        if not odd.any():
            parts = pc.split_pattern(pc.replace_substring(texts, " ", _MARK + " "), _MARK)
            return parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        counts, chunks = np.zeros(len(texts), np.int64), []
        edges = np.flatnonzero(np.diff(odd)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(texts)], strict=True):
            if odd[lo]:
                cut = [_CUT.split(t) for t in texts[lo:hi].to_pylist()]
                counts[lo:hi] = [len(c) for c in cut]
                chunks.append(pa.array([p for c in cut for p in c], pa.large_string()))
            else:
                parts = pc.split_pattern(pc.replace_substring(texts[lo:hi], " ", _MARK + " "), _MARK)
                counts[lo:hi] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
                chunks.append(parts.flatten())
        return pa.concat_arrays([c.cast(pa.large_string()) for c in chunks]), counts

    def _token_bytes(self, spec: dict) -> np.ndarray | None:
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(n) for n in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        if spec["normalizer"] or not plain or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            return None
        if any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]):
            return None
        sizes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            sizes[i] = len(token)  # one character of the byte alphabet a byte
        return sizes

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and each word's number of ids."""
        if self.token_bytes is None:
            return self._encode_parted(words.to_pylist())
        offsets, data = _bytes_of(words)
        padded = np.append(data, np.zeros(2, np.uint8))
        second = padded[offsets[:-1] + 1]
        # In one text they are cut as alone only where a space and a non-space begin the next; bytes C2 and E1 to E3 begin Unicode's spaces.
        alike = (np.diff(offsets) > 1) & (padded[offsets[:-1]] == 32) & (second > 32) & (second != 127) & (second != 0xC2) & ~((second > 0xE0) & (second < 0xE4))
        for begin in self.added_begin:
            alike &= ~pc.match_substring(words, begin).to_numpy(zero_copy_only=False)
        at, rest = np.flatnonzero(alike), np.flatnonzero(~alike)
        joined = self._encode_joined(words.take(pa.array(at)))
        if joined is None:
            return self._encode_parted(words.to_pylist())
        others = self._encode_parted(words.take(pa.array(rest)).to_pylist())
        sizes = np.concatenate([joined[1], others[1]])
        order = np.argsort(np.concatenate([at, rest]), kind="stable")
        return np.concatenate([joined[0], others[0]])[gather_ranges((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]

    def _encode_joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Encodes words, 256 as one text; None if tokens don't end where words do."""
        offsets, data = _bytes_of(words)
        raw, cuts = data.tobytes(), [*offsets[:-1:256].tolist(), len(data)]
        texts = [raw[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
        each = [np.array(e.ids, np.uint32) for lo in range(0, len(texts), 16) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 16], add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, np.uint32), *each])
        ends = np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(ends, offsets[1:])
        if int(ends[-1] if len(ends) else 0) != len(data) or (ends[last] != offsets[1:]).any():
            return None
        return ids, np.diff(last + 1, prepend=0)

    def _encode_parted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        blobs = self._encode_blobs(words)
        return np.frombuffer(b"".join(blobs), np.uint32), np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4

    def _encode_blobs(self, words: list[str]) -> list[bytes]:
        one = lambda w: array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        if not self.parting:
            return [one(w) for w in words]
        token, number = self.parting
        out = [one(w) if token[:2] in w else b"" for w in words]
        plain = [i for i, w in enumerate(words) if token[:2] not in w]
        joined = [plain[lo : lo + 256] for lo in range(0, len(plain), 256)]
        for lo in range(0, len(joined), 16):
            some = joined[lo : lo + 16]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([token.join([words[i] for i in g]) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                cuts = np.flatnonzero(ids == number)
                raw = ids.tobytes()
                for i, a, b in zip(group, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)], strict=True):
                    out[i] = raw[a:b]
        return out

    def _forget(self) -> None:
        """Keeps the words used last, half of what may stay."""
        last = self.table[4]
        keep = np.sort(np.argsort(-last, kind="stable")[: self.kept // 2])
        hashes, checks, starts, sizes, last = (c[keep] for c in self.table)
        self.ids = self.ids[gather_ranges(starts, sizes)]
        self.table = [hashes, checks, np.cumsum(sizes) - sizes, sizes, last]

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in `ids` each word's ids are, and how many; learns what is new."""
        offsets, data = _bytes_of(words)
        lo, hi = offsets[:-1], offsets[1:]
        hashes = span_hashes(data, lo, hi)
        sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
        padded = np.append(data, 0).astype(np.int64)
        checks = (((hi - lo) << 40) + ((sums[hi] - sums[lo]) << 16) + (padded[lo] << 8) + padded[np.maximum(hi - 1, 0)]).astype(np.uint64)
        at = np.minimum(np.searchsorted(self.table[0], hashes), max(len(self.table[0]) - 1, 0))
        hit = (self.table[0][at] == hashes) & (self.table[1][at] == checks) if len(self.table[0]) else np.zeros(len(hashes), bool)
        starts, sizes = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        starts[hit], sizes[hit] = self.table[2][at[hit]], self.table[3][at[hit]]
        self.batch += 1
        self.table[4][at[hit]] = self.batch
        new = np.flatnonzero(~hit)
        if len(new):
            ids, sizes[new] = self._encode_words(words.take(pa.array(new)))
            starts[new] = len(self.ids) + np.cumsum(sizes[new]) - sizes[new]
            self.ids = np.concatenate([self.ids, ids])
            columns = [np.concatenate([old, more]) for old, more in zip(self.table, (hashes[new], checks[new], starts[new], sizes[new], np.full(len(new), self.batch)), strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.table = [c[order] for c in columns]
        return starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row as uint32, and each text's number of ids. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        pieces, counts = self._pieces(texts)
        coded = pieces.dictionary_encode()
        if len(self.table[0]) > self.kept:
            self._forget()
        starts, lens = self._look_up(coded.dictionary.cast(pa.large_string()))
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = lens[index]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(starts[index] - (ends - each), each)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(upto)


@functools.cache
def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker."""
    return TextEncoder(path)


def text_slices(lengths: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text each."""
    which = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(which)) + 1), len(lengths)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo]

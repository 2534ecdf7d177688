"""Rows without a doc_id and rows that share one, in the operators that key nothing by it, against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sievework.llm import fm_index, ngram_join, packing, sharding, suffix_merge, token_ids
from sievework.llm.tokenizing import TextEncoder
from test_contracts import WORD, _components, _repeats, _sha

LAST = float("inf")  # a null doc_id counts as larger than all others


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(90)}" for _ in range(n)]
    passage = fresh(60)
    out = [(None, None), (None, ""), (-(1 << 63), "lowest"), (-5, "below zero"), (4, None), (4, ""), (None, " ".join(fresh(20_000)))]
    for i in range(60):
        text = " ".join(fresh(rng.randint(1, 30)) + passage[rng.randint(0, 8) :] + fresh(rng.randint(1, 30))) if rng.random() < 0.5 else " ".join(fresh(rng.randint(1, 150)))
        out += [(rng.choice([None, None, 7, i]), text)] * rng.choice([1, 1, 2])
        if rng.random() < 0.3:
            out.append((rng.choice([None, i]), text + " end"))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def _named(counter):
    return Counter({tuple(None if x == LAST else x for x in k): n for k, n in counter.items()})


def test_sharding(docs, rows):
    out = sharding.shard_documents(docs, 8, bucket_bytes=600)[0].collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    for i in (None, 7):  # one shard, many buckets
        mine = [r for r in out if r.doc_id == i]
        assert len({(r.shard, r.grown_shard) for r in mine}) == 1 and len({r.bucket for r in mine}) > 5
    again = sharding.shard_documents(docs.repartition(5), 8, bucket_bytes=600)[0].collect()
    assert Counter((r.doc_id, r.text, r.shard, r.bucket, r.pos) for r in again) == Counter((r.doc_id, r.text, r.shard, r.bucket, r.pos) for r in out)


def test_ngram_join(docs, rows):
    got = ngram_join.jaccard_components(docs, 3, (90, 100))
    want = _named(_components([(LAST if i is None else i, t) for i, t in rows], 3, 90, 100))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want


def test_substring_dedup(docs, rows):
    placed = [(LAST if i is None else i, t) for i, t in rows]
    want = _named(Counter((i, len(s), sum(g), _sha(" ".join(x for x, d in zip(s, g, strict=True) if not d).encode())) for i, s, g in _repeats(placed, lambda t: WORD.findall(t or ""), 50)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, _sha(bytes(r.kept))) for r in fm_index.remove_repeated_words(docs).collect()) == want
    assert any(k[0] is None and k[2] for k in want)


def test_suffix_array_dedup(docs, rows):
    want = Counter()
    for i, s, g in _repeats([(LAST if i is None else i, t) for i, t in rows], lambda t: (t or "").encode(), 50):
        spans = sum(a and not b for a, b in zip(g, [False, *g], strict=False))
        want[i, len(s), sum(g), spans, _sha(bytes(x for x, d in zip(s, g, strict=True) if not d))] += 1
    got = suffix_merge.remove_repeated_bytes(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, _sha(bytes(r.kept))) for r in got) == _named(want)


def test_packing(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, want, got = TextEncoder(path).tokenizer, Counter(), Counter()
    for i, t in rows:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    for r in packing.pack_documents(docs, path, length=64, group_bytes=6000).collect():
        got[r.doc_id] += r.length
    assert got == want


@pytest.mark.parametrize("part_bytes", [2000, 1 << 20])
def test_token_ids(docs, rows, part_bytes):
    path = public_tokenizers.path("word_bpe_49k.json")
    parts, folder = token_ids.write_token_ids(docs, path, 1, part_bytes=part_bytes)
    got = sorted(token_ids.read_token_ids(parts, folder, path).collect(), key=lambda r: r.start)
    tokenizer, at = TextEncoder(path).tokenizer, 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)

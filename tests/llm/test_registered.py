"""The registered queries themselves over the smallest given tables: those with SQL against it, the others against brute force."""

import html
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sievework.llm.registry import ORACLES, QUERIES
from sievework.llm.tokenizing import TextEncoder

FOLDER = os.environ.get("SIEVEWORK_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("select doc_id, text, lang from documents order by doc_id").fetchall()


def _rows(spark, name):
    found = [f for n, f in QUERIES.items() if n.startswith(name + "_")]
    return found[0](spark, FOLDER).collect()


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df, want = QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_op1(spark, documents):
    rows = {r.doc_id: r for r in _rows(spark, "op1")}
    assert sorted(rows) == [i for i, *_ in documents]
    slots = defaultdict(list)
    for i, text, _ in documents:
        r, raw = rows[i], (text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key") and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5(spark, documents):
    tokenizer = TextEncoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in documents}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in _rows(spark, "op5"):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == _crc(ids[r.doc_id][r.start : r.start + r.length])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, whole in [*((pieces[i], len(x)) for i, x in ids.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == whole if whole else at <= 1024
    assert len(sequences) <= math.ceil(sum(map(len, ids.values())) / 1024 * 1.02) + 1


def test_op6(spark, documents):
    tokenizer, at = TextEncoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer, 0
    rows = {r.doc_id: r for r in _rows(spark, "op6")}
    assert len(rows) == len(documents)
    for i, text, _ in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), _crc(ids))
        at += len(ids)


def test_op7(spark, documents):
    rows = {r.doc_id: r for r in _rows(spark, "op7")}
    known, right, told = {lang for _, _, lang in documents if lang}, 0, 0
    for i, text, lang in documents:
        r = rows[i]
        blank = not any(c.isalpha() for c in text or "")
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and (r.lang_pred == "und") == blank and (blank or r.lang_pred in known) and 0 <= r.score <= 1
        if r.held_out and lang and not blank:
            right, told = right + (r.lang_pred == lang), told + 1
    assert len(rows) == len(documents) and told > 20 and right >= 0.95 * told


def test_op8(spark, duck):
    table = [(i, np.array(v, float)) for i, v in duck.sql("select vec_id, embedding from embeddings").fetchall() if v and None not in v and np.isfinite(v).all() and any(v)]
    unit, ids = np.array([v / np.linalg.norm(v) for _, v in table]), np.array([i for i, _ in table])
    got = defaultdict(dict)
    for r in _rows(spark, "op8"):
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        scores = unit @ unit[ids == q][0]
        order = sorted((-round(s, 12), i) for s, i in zip(scores, ids, strict=True) if i != q)[:5]
        assert [found[k + 1][0] for k in range(5)] == [i for _, i in order] and [found[k + 1][1] for k in range(5)] == pytest.approx([-s for s, _ in order], abs=1e-12)


def test_op9(spark, duck, documents):
    """Every document that holds an item's words in a row is found; what is found beyond that holds its words with other values."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    texts = {i: f" {' '.join(words(t))} " for i, t, _ in documents}
    want = {(i, k) for k, item in duck.sql("select item_id, text from benchmark").fetchall() if len(words(item)) >= 8 for i, t in texts.items() if f" {' '.join(words(item))} " in t}
    rows = _rows(spark, "op9")
    assert want <= {(r.doc_id, r.item_id) for r in rows} and want
    assert all(0 < r.covered <= r.item_words and 0 <= r.changed <= r.slots for r in rows)


def test_op12(spark, duck):
    want = {}
    for i, page in duck.sql("select page_id, html from pages").fetchall():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", b)).split()) for b in re.split(r"</?(?:p|br|h1)\b[^>]*>", inner[1])] if inner else []
        want[i] = "\n".join(b for b in blocks if b)
    rows = _rows(spark, "op12")
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(want)

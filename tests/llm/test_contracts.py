"""The ten queries against plain brute-force versions, with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import decontamination, fm_index, language_id, line_dedup, nearest, ngram_join, packing, sharding, suffix_merge, token_ids
from sievework.llm.tokenizing import TextEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, places string, row int, block long, hash string, windows string"


def _corpus(seed: int = 1, words: int = 40, letters: str = "abcdefg") -> list[tuple]:
    """Texts with copies, near copies, shared passages, and the odd cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(words * 5)] + ["É1", "naïve", "Ünï", "B"]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = fresh(70), []
    for i in range(70):
        kind = rng.random()
        if kind < 0.2 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.4 and rows and rows[-1][1]:
            w = rows[-1][1].split(" ")
            w[rng.randrange(len(w))] = "new"
            text = " ".join(w)
        elif kind < 0.6:
            text = " ".join(fresh(rng.randint(1, 40)) + passage[rng.randint(0, 10) :] + fresh(rng.randint(0, 40)))
        else:
            text = rng.choice([" ", "  ", "\n"]).join(fresh(rng.randint(1, 200)))
        rows.append((3 * i + 1, text))
    rows += [(0, None), (5, ""), (6, "one"), (9, " \t\n"), (12, "x " * 400), (15, "x " * 300), (18, "a" * 300), (21, "a" * 120), (7, rows[3][1]), (rows[4][0], rows[4][1])]
    rng.shuffle(rows)
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "p", 1, 2, "h", None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return _frame(spark, corpus).cache()


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def _repeats(rows, symbols, width):
    """For each row, a mask of the symbols in windows that also start in a smaller doc_id."""
    first: dict[tuple, int] = {}
    for i, t in rows:
        s = symbols(t)
        for j in range(len(s) - width + 1):
            key = tuple(s[j : j + width])
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        s = symbols(t)
        gone = [False] * len(s)
        for j in range(len(s) - width + 1):
            if first[tuple(s[j : j + width])] < i:
                gone[j : j + width] = [True] * width
        yield i, s, gone


@pytest.mark.parametrize("many", [50_000, 2])
def test_substring_dedup(spark, corpus, docs, many):
    want = Counter((i, len(s), sum(g), _sha(" ".join(x for x, d in zip(s, g, strict=True) if not d).encode())) for i, s, g in _repeats(corpus, lambda t: WORD.findall(t or ""), 50))
    got = fm_index.remove_repeated_words(docs, many=many)
    assert Counter((r.doc_id, r.n_words, r.n_removed, _sha(bytes(r.kept))) for r in got.collect()) == want
    assert any(k[2] for k in want)


@pytest.mark.parametrize("many", [50_000, 2])
def test_suffix_array_dedup(spark, corpus, docs, many):
    want = Counter()
    for i, s, g in _repeats(corpus, lambda t: (t or "").encode(), 50):
        spans = sum(a and not b for a, b in zip(g, [False, *g], strict=False))
        want[i, len(s), sum(g), spans, _sha(bytes(x for x, d in zip(s, g, strict=True) if not d))] += 1
    got = suffix_merge.remove_repeated_bytes(docs, many=many)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, _sha(bytes(r.kept))) for r in got.collect()) == want


@pytest.mark.parametrize("match", [suffix_merge.match_by_merge, fm_index.match_by_index])
def test_matchers_over_several_shards(match):
    rng = np.random.default_rng(3)
    for width in (6, 50):
        for _ in range(15):
            base = [rng.integers(0, 3, rng.integers(width, 4 * width)).astype(np.uint8) for _ in range(4)]
            strings = []
            for _ in range(rng.integers(2, 25)):
                s = base[rng.integers(4)].copy()
                s[rng.integers(len(s))] = rng.integers(0, 3)
                a = rng.integers(0, len(s) - width + 1)
                strings.append(s[a : rng.integers(a + width, len(s) + 1)])
            least, lengths = rng.integers(0, 9, len(strings)), np.array([len(s) for s in strings])
            best: dict[bytes, int] = {}
            windows = [(bytes(s[j : j + width]), x) for s, x in zip(strings, least, strict=True) for j in range(len(s) - width + 1)]
            for w, x in windows:
                best[w] = min(best.get(w, x), x)
            for shard in (3 * width, 10**9):
                assert match(np.concatenate(strings), lengths, least, width, shard).tolist() == [best[w] < x for w, x in windows]


def _components(rows, width, num, den):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("crowd", [32, 1])
@pytest.mark.parametrize(("width", "share"), [(3, (90, 100)), (5, (80, 100)), (2, (50, 100))])
def test_ngram_join(spark, width, share, crowd, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    for seed in (1,) if crowd > 1 else (3,):
        rows = _corpus(seed, words=8, letters="ab")
        got = ngram_join.jaccard_components(_frame(spark, rows), width, share)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == _components(rows, width, *share)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):
        words[i] = f"other{i}"
        rows.append((100 - i, " ".join(words)))
    got = ngram_join.jaccard_components(_frame(spark, rows), 3, (80, 100))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == _components(rows, 3, 80, 100)


@pytest.mark.parametrize("share", [(90, 100), (80, 100)])
def test_a_family_of_near_copies_beside_the_threshold(spark, share):
    """Copies of one text with a few words changed: some are near the text, some near one another only, most near nothing."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = rows[rng.randrange(len(rows))][1].split() if rng.random() < 0.3 else list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(["new", f"own{i}"])
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_components(_frame(spark, rows), 3, share)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == _components(rows, 3, *share)


def test_sharding(spark, corpus, docs):
    out, _ = sharding.shard_documents(docs, 8, bucket_bytes=600)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(corpus)
    for r in rows:
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.grown_shard in (r.shard, 8)
    by_id = {}
    assert all(by_id.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) for r in rows)
    again, _ = sharding.shard_documents(docs.repartition(5), 9, bucket_bytes=600)
    assert all(by_id[r.doc_id][1] == r.shard for r in again.collect())
    for key in {(r.shard, r.bucket) for r in rows}:
        assert sorted(r.pos for r in rows if (r.shard, r.bucket) == key) == list(range(sum((r.shard, r.bucket) == key for r in rows)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_ids_of_whole_texts(name):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "the", "'s", "é", "é", " ", "　", "1", "23", "<|endoftext|>", "<|", "<|startoftext|>", "\x1f", "\x1c", "😀", "日本", "don't", "!!", "\r\n", "İ", "STRASSE", "ß"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(2000)] + [None, ""]
    encoder = TextEncoder(public_tokenizers.path(name), kept=100)
    for lo in range(0, len(texts), 400):
        ids, counts = encoder.encode(pa.array(texts[lo : lo + 400], pa.string()))
        at = 0
        for text, n in zip(texts[lo : lo + 400], counts, strict=True):
            assert ids[at : at + n].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
            at += n


def test_packing(spark, corpus, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, length=64, group_bytes=6000).collect()
    whole = TextEncoder(path)
    want = Counter((i, (*whole.tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in corpus)
    ids = lambda r: tuple(np.frombuffer(r.ids, "<u4").tolist())
    total = Counter()
    for (i, tokens), n in want.items():
        total[i] += n * len(tokens)
    got = Counter()
    for r in rows:
        assert len(ids(r)) == r.length and any(i == r.doc_id and ids(r) == t[r.start : r.start + r.length] for i, t in want)
        got[r.doc_id] += r.length
    assert got == total
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) * 64 - sum(total.values()) < 64 * 8


def test_assignment_takes_the_cheapest_sequence_with_room():
    put = packing.assign(np.array([60, 50, 40, 30, 20]), 100, 1.0, 0.01)
    assert [(p, n, s) for p, _, n, s, _ in put] == [(0, 60, 0), (1, 50, 1), (2, 40, 1), (3, 30, 0), (4, 10, 0), (4, 10, 1)]


def test_assignment_against_a_plain_version():
    """Descending cost, each to the cheapest sequence with room, the first of equal ones; cut over the emptiest ones where none has room."""
    rng = np.random.default_rng(12)
    for _ in range(50):
        lengths, room = rng.integers(1, 100, rng.integers(1, 60)), 100
        cost = lambda n: 1.0 * n + 0.01 * n * n
        n = -(-int(lengths.sum()) // room)
        load, left, want = [0.0] * n, [room] * n, []
        for i in sorted(range(len(lengths)), key=lambda i: (-cost(int(lengths[i])), i)):
            size, begin = int(lengths[i]), 0
            fits = [s for s in range(n) if left[s] >= size]
            while begin < size:
                to = min(fits, key=lambda s: load[s]) if fits else max(range(n), key=lambda s: left[s])
                part = size if fits else min(left[to], size - begin)
                want.append((i, begin, part, to, room - left[to]))
                load[to] += cost(part)
                left[to] -= part
                begin += part
        assert [tuple(int(v) for v in x) for x in packing.assign(lengths, room, 1.0, 0.01)] == want


def test_token_ids(spark, corpus, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    parts, folder = token_ids.write_token_ids(docs, path, 1, part_bytes=2000)
    rows = sorted(token_ids.read_token_ids(parts, folder, path).collect(), key=lambda r: r.start)
    tokenizer, at = TextEncoder(path).tokenizer, 0
    want = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in sorted(corpus, key=lambda r: (r[0], r[1] or ""))]
    for r, (i, ids) in zip(rows, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_line_dedup(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(1, 14)))) for i in range(60)] + [(100, None), (101, ""), (102, "a"), (3, "x\ny\nz")]
    first, want = {}, Counter()
    # Rows of one doc_id with different texts are documents of their own, in the order of their texts' hashes.
    key = {(r.i, r.t): r.h for r in spark.createDataFrame(rows, "i long, t string").select("i", "t", F.xxhash64("t").alias("h")).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        for j in range(len(lines) - 2):
            window = tuple(lines[j : j + 3])
            first[window] = min(first.get(window, (i, key[i, t], j)), (i, key[i, t], j))
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = [False] * len(lines)
        for j in range(len(lines) - 2):
            if (i, key[i, t], j) > first[tuple(lines[j : j + 3])]:
                gone[j : j + 3] = [True] * 3
        kept = [x for x, g in zip(lines, gone, strict=True) if not g]
        if t is None or not any(gone) or kept:
            want[i, None if t is None else "\n".join(kept)] += 1
    got = line_dedup.remove_repeated_lines(_frame(spark, rows))
    assert set(got.columns) == {c.split()[0] for c in SCHEMA.split(", ")}
    out = got.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    assert Counter((r.doc_id, r.text) for r in out) == want


def test_language_id(spark):
    rng = random.Random(7)
    kinds = {"en": "the and with that this have from", "fr": "le une avec dans pour cette être", "ru": "и не что как для это быть"}
    rows = []
    for i in range(400):
        lang = rng.choice(list(kinds))
        rows.append((i, " ".join(rng.choices(kinds[lang].split(), k=20)), lang))
    rows += [(1000, None, "en"), (1001, "123 !!", None), (1002, "", None), (1003, " ".join(["the and with that this"] * 6 + ["и не что как для это"] * 4), None), (None, "avec une", None), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    model = language_id.fit(docs)
    out = language_id.label_languages(docs, model).select("row.*", "held_out", "lang_pred", F.col("score").alias("share"), "spans").collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.lang and r.text:
            assert r.lang_pred == r.lang and r.share == 1.0
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.share, r.spans) == ("und", 0.0, [])
        if r.doc_id == 1003:
            assert [s.lang for s in r.spans] == ["en", "ru"] and r.text[r.spans[1].begin : r.spans[1].end].startswith("и не")
    assert {r.lang_pred for r in language_id.label_languages(docs, None).select("lang_pred").collect()} == {"und"}


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(8)
    offsets = np.cumsum([0, 3, 0, 200, 65, 64, 1])
    scores = rng.normal(size=(offsets[-1], 3)).astype(np.float32) * 3
    got = language_id.viterbi(scores, offsets, 2.0)
    for lo, hi in zip(offsets, offsets[1:], strict=False):
        if hi > lo:
            state = scores[lo].astype(float)
            for s in scores[lo + 1 : hi]:
                state = np.maximum(state, state.max() - 2.0) + s
            labels = got[lo:hi]
            total = sum(scores[lo + i][k] for i, k in enumerate(labels)) - 2.0 * (np.diff(labels) != 0).sum()
            assert abs(total - state.max()) < 1e-3


def test_nearest(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(400)]
    rows += [(500 + i, rows[i][1]) for i in range(60)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1050, []), (1100, [1.0, 2.0]), (1101, [2.0, 4.0]), (None, rows[0][1]), (50, rows[3][1])]
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)), group_queries=4, group_candidates=64).collect()
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    want = Counter()
    for n, (i, v) in enumerate(good):
        if i is not None and i % 50 == 0:
            scores = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), float("inf") if j is None else j, j) for m, (j, w) in enumerate(good) if m != n and len(w) == len(v)]
            for rank, (s, _, j) in enumerate(sorted(scores)[:5], 1):
                want[i, rank, j, -s] += 1
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in out) == want


ITEM = "Anna went with Robert to the market and bought 12 apples for 3 dollars while Robert paid 12 euros more than Anna had"


def test_decontamination(spark):
    other = ITEM.replace("Anna", "Maria").replace("Robert", "Peter").replace("12", "40").replace(" 3 ", " 7 ")
    broken = other.replace("Peter paid", "Carla paid")
    rows = [(1, f"Some words before. {ITEM} and more."), (2, f"x, {other}!"), (3, f"y, {broken}"), (4, "nothing of the kind stands here at all"), (5, None), (6, ""), (7, ITEM.upper()[:30]), (1, f"Some words before. {ITEM} and more."), (8, "a b c d e f short item of nine words stands here g h")]
    items = [(1, "So, " + ITEM), (2, "short item of nine words stands here"), (3, None), (4, "one two"), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("z")).withColumn("hash", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for broadcast in (200_000, 0):
        found = {(r.doc_id, r.item_id): (r.slots > 0, r.changed > 0) for r in decontamination.leaks(docs, bench, broadcast=broadcast).collect()}
        assert found == {(1, 1): (True, False), (2, 1): (True, True), (8, 2): (False, False)}
    kept = decontamination.without_leaks(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7] and kept.columns == docs.columns


def test_empty_tables(spark):
    none = _frame(spark, [])
    byte, word = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
    assert sharding.shard_documents(none)[0].count() == 0
    assert ngram_join.jaccard_components(none).count() == 0
    assert fm_index.remove_repeated_words(none).count() == 0
    assert line_dedup.remove_repeated_lines(none).count() == 0
    assert packing.pack_documents(none, byte).count() == 0
    parts, path = token_ids.write_token_ids(none, word, 1)
    assert token_ids.read_token_ids(parts, path, word).count() == 0
    assert language_id.label_languages(none, language_id.fit(none)).count() == 0
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert decontamination.leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert suffix_merge.remove_repeated_bytes(none).count() == 0

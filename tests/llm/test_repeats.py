"""Work of the two substring operators between blocks and buckets: even, and in few rows."""

import numpy as np
import pyarrow as pa
import pytest
from sievework.llm import repeats, suffix_merge
from sievework.llm.blocks import Block
from sievework.llm.common import pack_planes, squeeze


def _block(number, texts):
    raw = [t.encode() for t in texts]
    ids = np.arange(len(texts)) + 1000 * number
    return {"block": number, "ids": pack_planes(ids), "lengths": pack_planes(np.array([len(t) for t in raw])), "text": squeeze(b"".join(raw))}


def _words(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(n))


@pytest.mark.parametrize(("view_of", "k"), [(repeats.Bytes, 24), (repeats.Words, 12)])
def test_fingerprints_fill_buckets_evenly(view_of, k):
    view = view_of(Block(_block(0, [_words(np.random.default_rng(1), 20_000)])))
    counts = np.bincount(repeats._range_of(repeats.Runs(view, k, 50).prints, 8).astype(int), minlength=8)
    assert counts.max() < 1.5 * counts.mean()


@pytest.mark.parametrize(("view_of", "k"), [(repeats.Bytes, 24), (repeats.Words, 12)])
def test_loads_send_few_rows_and_find_all(view_of, k):
    rng = np.random.default_rng(2)
    common = _words(rng, 900)
    rows = [_block(n, ["", _words(rng, 70) + " " + common, "short", _words(rng, 60)] if n % 5 else [_words(rng, 90)]) for n in range(20)]
    batch = lambda some: pa.RecordBatch.from_pylist(some)
    sent = pa.Table.from_batches(repeats._send_prints(view_of, k, 50, 1)([batch(rows)]))
    answers = repeats._answer_prints(50_000)((pa.scalar(0),), sent).to_pylist()
    for row in rows:
        row["answers"] = [a for a in answers if a["block"] == row["block"]]
    runs = pa.Table.from_batches(repeats._send_runs(view_of, k, 50, 4)([batch(rows[:11]), batch(rows[11:])]))
    assert runs.num_rows <= 4 * (-(-16 // repeats.LOAD))  # one a load and bucket; 16 blocks have the common text

    matcher = lambda symbols, lengths, least, width: np.zeros(int((lengths - width + 1).sum()), bool)  # noqa: E731  (whole equal runs only)
    found = [repeats._match_bucket(view_of, matcher, 50)((pa.scalar(b),), runs.filter(pa.compute.equal(runs["bucket"], b))) for b in sorted(set(runs["bucket"].to_pylist()))]
    found = pa.concat_tables(found)
    back = {}
    for load in set(found["load"].to_pylist()):
        for row in repeats._part_load((pa.scalar(load),), found.filter(pa.compute.equal(found["load"], load))).to_pylist():
            assert row["block"] not in back
            back[row["block"]] = row
    assert sorted(back) == [n for n in range(20) if n % 5]
    for row in rows:
        view = view_of(Block(row))
        gone = repeats.covered(view, [back[row["block"]]] if row["block"] in back else [], 50)
        each = [int(gone[a:b].sum()) for a, b in zip(view.offsets, view.offsets[1:], strict=False)]
        long = len(common) if view_of is repeats.Bytes else 900
        # The first holder keeps all; runs at the borders of the common text differ in their other symbols.
        assert each == [0] * len(each) if row["block"] in (0, 1, 5, 10, 15) else each[0] == each[2] == each[3] == 0 and long - 200 < each[1] <= long


def test_merge_of_any_width_and_of_more_codes_than_a_pass_tells_apart(monkeypatch):
    rng = np.random.default_rng(4)
    for width, letters in ((5, 2), (7, 2), (9, 3), (50, 200)):
        base = rng.integers(0, letters, 6 * width).astype(np.uint8)
        cuts = [(a, a + width + int(rng.integers(0, 2 * width))) for a in rng.integers(0, 3 * width, 30)]
        strings, least = [base[a:b] for a, b in cuts], rng.integers(0, 9, len(cuts))
        windows = [(bytes(s[j : j + width]), x) for s, x in zip(strings, least, strict=True) for j in range(len(s) - width + 1)]
        best = {}
        for w, x in windows:
            best[w] = min(best.get(w, x), x)
        for most in (1 << 16, 300, 5):
            with monkeypatch.context() as m:
                if most < 1 << 16:
                    m.setattr(suffix_merge, "reads", lambda p, of=suffix_merge.reads, most=most: of(p, most))
                got = suffix_merge.match_by_merge(np.concatenate(strings), np.array([len(s) for s in strings]), least, width, 3 * width)
            assert got.tolist() == [best[w] < x for w, x in windows]


def test_a_pass_reads_the_longest_that_it_can_number():
    rng = np.random.default_rng(5)
    preceding = [rng.integers(0, 6, 5000).astype(np.uint8) for _ in range(4)]
    four = suffix_merge.reads(preceding)
    assert len(four) == 4 and len(suffix_merge.reads(preceding, 100)) == 2
    code = sum(p.astype(int) * 6**n for n, p in enumerate(preceding))
    assert (four[3] == np.searchsorted(np.unique(code), code)).all()

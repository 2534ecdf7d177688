"""Rows without an id, rows that share one, and items and passages that the first rules missed."""

from collections import Counter

import corpus_pipeline
from sievework.llm import decontamination, line_dedup

DOCS = "doc_id long, text string"


def test_line_dedup_rows_that_share_an_id(spark):
    passage = "p\nq\nr"
    rows = [(1, passage), (2, "a\nb\nc\nd\n" + passage), (2, "e"), (3, "x\ny\nz"), (3, "k\nl\n" + passage), (None, passage + "\nm\nn"), (None, "f\ng\nh\ni\n" + passage), (None, "s\nt"), (None, None)]
    got = Counter(tuple(r) for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter([(1, passage), (2, "a\nb\nc\nd"), (2, "e"), (3, "x\ny\nz"), (3, "k\nl"), (None, "m\nn"), (None, "f\ng\nh\ni"), (None, "s\nt"), (None, None)])


def test_line_dedup_counts_words_of_short_runs(spark):
    """With words, brute force: a run of lines counts if it has three lines or enough words, or is a whole short text."""
    long, half = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(25))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}"), (3, f"{half}\n{half}\nd"), (4, f"e\n{half}\n{half}\nf"), (5, f"g\n{half}\nh"), (6, "short"), (7, "short"), (8, "x\nshort"), (9, ""), (10, ""), (11, long), (12, "i\nj\nk"), (13, "l\ni\nj\nk"), (14, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs, words=50).collect()}
    assert got == {i: t for i, t in (dict(rows) | {2: "c", 4: "e\nf", 13: "l"}).items() if i not in (7, 11)}
    marked = {r["row"].doc_id: (r.n_lines, r.n_removed) for r in line_dedup._marked(docs, 3, 50).collect()}
    assert marked[4] == (4, 2) and marked[7] == (1, 1) and marked[11] == (1, 1) and marked[13] == (4, 3)
    assert {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs).collect()} == dict(rows) | {13: "l"}


ITEMS = [
    "What is 17 * 23 + 4?", "Compute 12 + 7 - 3 + 45 - 8.", "The cities are Paris, London, Rome, Berlin, Madrid and Vienna.", "Find the sum of 12, 15, 18, 21, 24 and 27.",
    "What is the next number in the series 2, 4, 8, 16, 32?", "Who wrote Hamlet?", "Anna has a red ball and a blue box in town", "short item of seven words stands here",
]


def test_decontamination_finds_copies_of_items_of_numbers_and_names(spark):
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    rows = [(10 * i + k, text) for i, item in enumerate(ITEMS) for k, text in enumerate((item, f"Some text. {item} More text.", f"they asked {item} again"))]
    rows += [(100, "What is 17 + 23 - 4?"), (101, "Compute 12 + 7 - 3 + 45 - 9."), (102, "Find the sum of 12, 15, 18, 21, 24 and 28."), (103, "Who wrote Faust?"), (104, "he said Maria has a red ball and a blue box in town"), (105, None), (106, "")]
    docs = spark.createDataFrame(rows, DOCS)
    for broadcast in (200_000, 0):
        got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench, broadcast=broadcast).collect()}
        assert got == {(10 * i + k, i) for i in range(len(ITEMS)) for k in range(3)} | {(104, 6)}


def test_decontamination_rows_without_ids(spark):
    slotted, plain = "Yesterday Anna gave the old farmer 12 red apples for a very small basket", ITEMS[7]
    bench = spark.createDataFrame([(None, slotted), (None, plain)], "item_id long, text string")
    rows = [(None, f"x {slotted}"), (None, f"y {plain}"), (None, "a clean text"), (None, "another clean text"), (3, "clean"), (3, f"z {plain}"), (4, f"u {slotted}")]
    docs = spark.createDataFrame(rows, DOCS)
    assert Counter(r.doc_id for r in decontamination.leaks(docs, bench).collect()) == Counter([None, None, 3, 4])
    assert Counter(tuple(r) for r in decontamination.without_leaks(docs, bench).collect()) == Counter([rows[2], rows[3], rows[4]])


def test_near_duplicates_rows_without_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("a")), (None, text("a") + " new"), (None, text("b")), (5, text("b")), (None, text("c")), (None, ""), (None, None), (7, text("d")), (8, text("e")), (8, text("d")), (9, text("f")), (9, text("f"))]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    got = Counter((r.doc_id, r.text) for r in out.collect())
    a = [t for i, t in got if t and t.startswith("a0")]
    assert len(a) == 1 and got[None, a[0]] == 1
    assert got - Counter({(None, a[0]): 1}) == Counter([(5, text("b")), (None, text("c")), (None, ""), (None, None), (7, text("d")), (8, text("e")), (9, text("f")), (9, text("f"))])

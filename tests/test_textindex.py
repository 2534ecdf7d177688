"""The stored text index against plain scans, its stems, and what a search reads."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.operators import textindex as T


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("sing", "sing"), ("conflated", "conflat"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"),
        ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("rational", "ration"), ("operator", "oper"), ("hopefulness", "hope"), ("electrical", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"),
        ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("as", "as"), ("x1s", "x1s"), ("", ""),
    ],
)
def test_stems(word, want):
    assert T.stem(word) == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["roast", "roasted", "Roasting", "duck", "ducks", "with", "plum", "plums", "sauce", "Éclair", "eclairs"]
    made = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice([None, "", "duck", "plum sauce"])) for i in range(120)]
    return [*made, (1000, None, None), (1001, "duck " * 30000 + "plum", ""), (None, "duck plum", None)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    T.build(spark.createDataFrame(rows, "id int, title string, note string").repartition(3), "id", {"title": F.col("title"), "note": F.col("note")}, path, buckets=8)
    return path


def _stems(text):
    return [T.stem(w) for w in (text or "").lower().replace("é", "e").split()]


@pytest.mark.parametrize(("query", "fields"), [("duck", None), ("Roast plums", None), ("plum, duck!", ["title"]), ("eclair with duck sauce", None), ("absent duck", None), ("", None)])
def test_match(spark, rows, index, query, fields):
    want, stems = {}, {T.stem(w) for w in query.lower().replace(",", "").replace("!", "").split()}
    for i, title, note in rows:
        held = _stems(title) + ([] if fields else _stems(note))
        if stems and stems <= set(held):
            want[i] = sum(w in stems for w in held)
    assert {r.id: r.hits for r in T.match(spark, index, query, fields, buckets=8).collect()} == want


@pytest.mark.parametrize("query", ["roast duck", "duck duck", "plum sauce", "duck with plum sauce"])
def test_phrase(spark, rows, index, query):
    stems = [T.stem(w) for w in query.split()]
    hits = lambda held: sum(held[i : i + len(stems)] == stems for i in range(len(held)))
    want = {i: n for i, title, note in rows if (n := hits(_stems(title)) + hits(_stems(note)))}
    assert {r.id: r.hits for r in T.match(spark, index, query, phrase=True, buckets=8).collect()} == want


def test_a_search_reads_only_the_buckets_of_its_terms(spark, index):
    asked = T.match(spark, index, "duck plum", buckets=8)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") and "PushedFilters: [In(term" in plan
    buckets = {r[0] for r in T.lookup(spark, index, ["duck", "plum"], buckets=8).select("bucket").distinct().collect()}
    want = {spark.range(1).select(T.bucket_of(F.lit(w), 8)).first()[0] for w in ("duck", "plum")}
    assert buckets == want


def test_a_task_holds_the_postings_of_one_load(spark):
    rng = random.Random(5)
    texts = [rng.choice([None, "", " ".join(rng.choices(["duck", "ducks", "plum", "with"], k=rng.randint(1, 60)))]) for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([i if i % 50 else None for i in range(400)], pa.int32()), "text": pa.array(texts)})
    loads, got = list(T._lists(most=2000)(iter([batch]))), []
    for load in loads:
        held = {i for ids in load["ids"].to_pylist() for i in ids if i is not None}
        assert sum(len(texts[i]) for i in held) <= 2000 + max(len(t or "") for t in texts)
        for term, ids, sizes, gaps in zip(*(load[c].to_pylist() for c in ("term", "ids", "sizes", "gaps"))):
            for i, n in zip(ids, sizes):
                places = [sum(gaps[: k + 1]) for k in range(n)]
                gaps = gaps[n:]
                got += [(term, i, p) for p in places]
    assert len(loads) > 3
    want = [(T.stem(w), i if i % 50 else None, p) for i, t in enumerate(texts) for p, w in enumerate((t or "").split())]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert list(T._lists()(iter([batch.slice(0, 0)]))) == []


def test_stored_rows_are_lists_and_searches_spell_them_out(spark, rows, index):
    assert spark.read.parquet(index).where("term = 'duck'").count() < sum("duck" in _stems(title) for _, title, _ in rows)
    found = {(r.field, r.id): r.positions for r in T.lookup(spark, index, ["duck"], buckets=8).collect()}
    want = {(f, i): [p for p, w in enumerate(_stems(x)) if w == "duck"] for i, title, note in rows for f, x in (("title", title), ("note", note)) if "duck" in _stems(x)}
    assert found == want


@pytest.mark.parametrize("query", ["duck duck", "duck with plum sauce"])
def test_phrases_in_an_index_of_many_loads(spark, rows, tmp_path, query):
    path = str(tmp_path / "i")
    T.build(spark.createDataFrame(rows, "id int, title string, note string").coalesce(1), "id", {"title": F.col("title"), "note": F.col("note")}, path, buckets=4, most=300)
    assert spark.read.parquet(path).where("term = 'duck' and field = 'title'").count() > 5
    stems = [T.stem(w) for w in query.split()]
    hits = lambda held: sum(held[i : i + len(stems)] == stems for i in range(len(held)))
    want = {i: n for i, title, note in rows if (n := hits(_stems(title)) + hits(_stems(note)))}
    assert {r.id: r.hits for r in T.match(spark, path, query, phrase=True, buckets=4).collect()} == want

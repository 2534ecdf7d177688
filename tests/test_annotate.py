"""Dictionary annotation, resolution and markers against plain versions, by the broadcast trie and by the join."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import annotate as A


def _plain_spans(tokens, known):
    out, i = [], 0
    while i < len(tokens):
        n = next((n for n in range(8, 0, -1) if i + n <= len(tokens) and " ".join(tokens[i : i + n]) in known), 0)
        if n:
            key = " ".join(tokens[i : i + n])
            out.append((i, n, key, known[key]))
        i += n or 1
    return out


def _plain_name(tokens, known, dull):
    runs = [(n, i) for n in range(1, 9) for i in range(len(tokens) - n + 1) if " ".join(tokens[i : i + n]) in known and (n > 1 or len(tokens) == 1 or tokens[i] not in dull)]
    if not runs:
        return None
    n, i = max(runs)
    key = " ".join(tokens[i : i + n])
    return key, known[key], "exact" if n == len(tokens) else "part"


@pytest.fixture(scope="module")
def found():
    rng = random.Random(2)
    words = ["red", "hot", "pepper", "sauce", "sea", "salt", "oil"]
    keys = {" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 2, 3, 4, 8, 9]))) for _ in range(60)}
    known = {k: f"tag {i % 7}" for i, k in enumerate(sorted(keys))}
    texts = [" ".join(rng.choices([*words, "and"], k=rng.randint(0, 30))) for _ in range(80)]
    return known, texts


@pytest.mark.parametrize("limit", [A.LIMIT, 0])
def test_spans_and_names(spark, found, limit):
    known, texts = found
    dictionary = spark.createDataFrame([*known.items(), *((k.upper() + "!", t + "z") for k, t in known.items()), (None, "x"), ("gone", None), ("", "y")], "key string, tag string")
    rows = spark.createDataFrame([*enumerate(t.replace(" and ", " & ").title() for t in texts), (1000, None), (1001, ""), (1002, "x " * 40000 + "Hot  PEPPER")], "id int, text string")
    short = {k: t for k, t in known.items() if len(k.split()) <= 8}
    got = {tuple(r) for r in A.annotate(rows, "id", F.col("text"), dictionary, limit=limit).collect()}
    want = {(i, *s) for i, t in enumerate(texts) for s in _plain_spans(t.split(), short)} | {(1002, *s) for s in _plain_spans(["x"] * 40000 + ["hot", "pepper"], short)}
    assert got == want
    names = spark.createDataFrame([(t,) for t in [*texts, *texts[:9]]] + [(None,), ("",)], "name string")
    resolved = A.resolve_names(names, "name", dictionary, dull=("red", "oil"), limit=limit).collect()
    want = {(t, *r) for t in set(texts) if (r := _plain_name(t.split(), short, {"red", "oil"}))}
    assert len(resolved) == len(want) and {tuple(r) for r in resolved} == want


@pytest.mark.parametrize("limit", [A.LIMIT, 0])
def test_names_in_scripts_without_spaces(spark, limit):
    dictionary = spark.createDataFrame([("葱", "scallion"), ("生姜", "ginger"), ("姜", "ginger root"), ("料 酒", "wine"), ("oil", "oil")], "key string, tag string")
    names = spark.createDataFrame([("葱2根",), ("生姜 3片",), ("一勺料酒",), ("oil 葱",), ("姜葱",), ("水",)], "name string")
    got = {tuple(r) for r in A.resolve_names(names, "name", dictionary, limit=limit).collect()}
    assert got == {("葱2根", "葱", "scallion", "inside"), ("生姜 3片", "生姜", "ginger", "inside"), ("一勺料酒", "料酒", "wine", "inside"), ("oil 葱", "oil", "oil", "exact"), ("姜葱", "葱", "scallion", "inside")}


def test_no_rows_and_no_entries(spark):
    rows = spark.createDataFrame([(1, "a b")], "id int, text string")
    none = spark.createDataFrame([], "key string, tag string")
    for limit in (A.LIMIT, 0):
        assert A.annotate(rows, "id", F.col("text"), none, limit=limit).count() == 0
        assert A.resolve_names(rows, "text", none, limit=limit).count() == 0
        assert A.annotate(rows.where("id > 1"), "id", F.col("text"), rows.select(F.col("text").alias("key"), F.lit("t").alias("tag")), limit=limit).count() == 0


def test_first_marker(spark):
    markers = [("thai", "thai"), ("pho", "viet"), ("greek", "greek")]
    rows = spark.createDataFrame([("Pho, Thai style",), ("Greek yogurt with photo",), ("greek greek yogurt",), ("a pho greek-yogurt pho",), ("Indiana",), (None,)], "text string")
    got = [r.m and tuple(r.m) for r in rows.select(A.first_marker(F.col("text"), markers, ("greek yogurt",)).alias("m")).collect()]
    assert got == [("thai", "thai"), None, ("greek", "greek"), ("viet", "pho"), None, None]


def test_missing_mentions(spark):
    dictionary = spark.createDataFrame([("chicken", "chicken"), ("apple", "apple"), ("chilli", "chilli"), ("beef", "beef"), ("rice noodles", "rice_noodles")], "key string, tag string")
    closure = spark.createDataFrame([("chicken", "chicken"), ("thigh", "thigh"), ("thigh", "chicken"), ("apple", "apple"), ("chilli", "chilli"), ("beef", "beef"), ("rice_noodles", "rice_noodles"), ("rice_noodles", "noodles"), ("noodles", "noodles")], "slug string, above string")
    items = [
        (1, "Chicken and Beef", ["2 thighs"], ["thigh"]), (2, "Apple Chilli pie", ["applesauce", "1 chili"], ["sauce"]), (3, "Beef beef", None, None), (4, None, [], []), (5, "Rice noodles", ["udon"], ["noodles"]),
    ]
    got = sorted(tuple(r) for r in A.missing_mentions(spark.createDataFrame(items, "id int, title string, lines array<string>, slugs array<string>"), dictionary, closure).collect())
    assert got == [(1, "beef", "beef"), (3, "beef", "beef"), (3, "beef", "beef")]

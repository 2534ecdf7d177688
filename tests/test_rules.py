"""Diet decisions, quality terms and record operators on small rows."""

import math
import random

import pytest
from pyspark.sql import functions as F
from sievework.operators import diet, records, scoring


def _one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).head().asDict()


def test_item_flags_notes_and_contexts(spark):
    none = F.lit(None).cast("array<string>")
    got = _one(
        spark, known=diet.item_flags(F.array(F.lit("egg")), F.lit("beef")), word=diet.item_flags(none, F.lit("smoked Bacon, sliced")), not_really=diet.item_flags(none, F.lit("vegan butter")), plain=diet.item_flags(none, F.lit("carrot")),
        null=diet.item_flags(none, F.lit(None).cast("string")), alt=diet.written_alternatives(F.lit("chopped; or coconut cream; do not use milk; use tofu instead")), no_alt=diet.written_alternatives(F.lit(None).cast("string")),
        where=diet.contexts(F.lit("Bake the soup")), omit=diet.may_omit(F.lit("Optional, to serve")), keep=diet.may_omit(F.lit(None).cast("string")),
    )
    assert got == {"known": ["egg"], "word": ["meat"], "not_really": [], "plain": [], "null": [], "alt": ["coconut cream", "tofu"], "no_alt": [], "where": ["bake", "soup"], "omit": True, "keep": False}


def test_best_stand_in_and_decision(spark):
    lines = spark.createDataFrame([(1, 1, "butter", ["bake"]), (1, 2, "carrot", []), (2, 1, "bacon", ["soup"]), (3, 1, "butter", ["fry"])], "id int, line int, slug string, fits array<string>")
    closure = spark.createDataFrame([(s, s, 0) for s in ("butter", "bacon", "carrot")] + [("butter", "fat", 1), ("bacon", "meat", 1)], "slug string, above string, depth int")
    swaps = [("butter", "lard", 3, ["meat"], []), ("butter", "butter", 3, [], []), ("butter", "apple sauce", 2, [], ["bake"]), ("fat", "oil", 2, [], []), ("fat", "ghee", 1, [], []), ("meat", "tofu", 3, [], ["raw"])]
    best = diet.best_stand_in(lines, closure, spark.createDataFrame(swaps, "target string, stand_in string, quality int, flags array<string>, only array<string>"), diet.BANNED["vegan"])
    assert sorted(map(tuple, best.collect())) == [(1, 1, "apple sauce"), (3, 1, "oil")]
    rows = [(1, 1, "butter", ["dairy"], [], False), (1, 2, "carrot", [], [], False), (2, 1, "bacon", ["meat"], [], False), (2, 2, "egg", ["egg"], [], True), (4, 1, None, None, [], False), (5, 1, "rice", [], [], False), (6, 1, "ham", ["meat"], [["fish"], []], False), (7, 1, "ham", ["meat"], [["fish"]], False)]
    out = diet.decide(spark.createDataFrame(rows, "id int, line int, slug string, flags array<string>, written array<array<string>>, omit boolean"), best, diet.BANNED["vegan"])
    assert {r.id: (r.status, r.blockers, r.swapped) for r in out.collect()} == {1: ("adaptable", 0, 1), 2: ("no", 1, 1), 4: ("unknown", 0, 0), 5: ("ok", 0, 0), 6: ("adaptable", 0, 1), 7: ("no", 1, 0)}


@pytest.mark.parametrize(("chars", "longest", "steps", "cut", "want"), [(39, 39, 1, False, 0.0), (100, 50, 3, False, 0.1 * 100 / 150), (425, 100, 3, False, 0.5), (380, 380, 1, False, 230 / 550 / 2), (900, 300, 4, False, 1.0), (900, 2600, 4, False, 0.5), (900, 100, 4, True, 0.0)])
def test_method_term(spark, chars, longest, steps, cut, want):
    got = _one(spark, t=scoring.method_term(F.lit(chars), F.lit(longest), F.lit(steps), F.lit(0), F.lit(cut)))["t"]
    assert math.isclose(got, want)


def test_quality_score_and_terms(spark):
    ones = {k: F.lit(1.0) for k in scoring.WEIGHTS}
    got = _one(
        spark, best=scoring.quality_score(ones, F.lit(False), F.lit(False), F.lit(0.9)), worst=scoring.quality_score(ones, F.lit(True), F.lit(True), F.lit(0.5)), less=scoring.quality_score(ones | {"lines": F.lit(0.0)}, F.lit(None), F.lit(None), F.lit(1.0), ("rating", "pop")),
        few=scoring.lines_term(F.lit(3)), six=scoring.lines_term(F.lit(6)), many=scoring.lines_term(F.lit(31)), fresh=scoring.freshness(F.lit(1), F.lit(4), F.lit(1), F.lit(10), F.lit("dessert")), unknown=scoring.freshness(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0), F.lit(0), F.lit("main")),
        sweet=scoring.style_term(F.array(F.lit("marshmallow")), F.lit(0), F.lit(9), F.lit("dessert")), savoury=scoring.style_term(F.array(F.lit("marshmallow")), F.lit(2), F.lit(9), F.lit("main")),
    )
    want = {"best": 1.0, "worst": 0.5 * 0.7 * 0.8, "less": 0.73 / 0.88, "few": 0.0, "six": 0.45, "many": 0.5, "fresh": 0.92, "unknown": 0.5, "sweet": 1.0, "savoury": 0.0}
    assert all(math.isclose(got[k], v, abs_tol=1e-12) for k, v in want.items()), got


def test_running_sums_and_ranks_against_a_sort(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 40))) for i in range(500)] + [(900 + i, 7.0) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v double")
    want = {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in rows), 1)}
    assert {r.id: r.rank for r in records.ranked(df, "v", "id").collect()} == want
    out = {r.v: (r.rank, r["all"]) for r in records.running(df.groupBy("v").count(), "v", weight="count").collect()}
    assert out == {v: (sum(w <= v for _, w in rows), len(rows)) for _, v in rows}
    assert records.ranked(spark.createDataFrame([], "id long, v double"), "v", "id").count() == 0


def test_keys_counters_and_imputed_sums(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (1, None, None), (2, None, "b")], "g int, v double, s string")
    assert sorted(map(tuple, records.with_mean_imputed(df, "g", "v").collect())) == [(1, 4.0, 1), (2, None, 1)]
    assert {r.name: r.n for r in records.counters(df, kind="s").collect()} == {"kind.a": 1, "kind.b": 1, "kind.(none)": 1}
    other = spark.createDataFrame([(2,), (3,)], "g int")
    assert {r.state: r.n for r in records.carried(df.select("g").distinct(), other, "g").collect()} == {"kept": 1, "gone": 1, "new": 1}

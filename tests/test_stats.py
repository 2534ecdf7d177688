"""The incomplete beta function and p-values against integration, folding against Unicode's decomposition, linkage against all pairs."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import search, stats


def _p(r, n, steps=4000):
    """Student's tails by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    df, turn = n - 2, math.atan(abs(r) / math.sqrt(1 - r * r))
    area = lambda top: sum((1 if i in (0, steps) else 4 if i % 2 else 2) * max(math.cos(top * i / steps), 0.0) ** (df - 1) for i in range(steps + 1)) * top
    return 1 - area(turn) / area(math.pi / 2)


def test_p_values(spark):
    rows = [(0.066197, 589), (0.5, 10), (0.9, 5), (-0.2, 40), (0.0, 30), (0.01, 5000), (0.3, 3), (-0.999, 8)]
    df = spark.createDataFrame([*rows, (1.0, 5), (0.3, 2), (None, 9), (0.003, 600_000)], "r double, n long")
    got = [r.p for r in df.select(stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got[: len(rows)] == pytest.approx([_p(r, n) for r, n in rows], abs=1e-9)
    assert got[len(rows) : -1] == [0.0, None, None] and got[-1] == pytest.approx(0.0201367, abs=1e-6)
    got = spark.createDataFrame([(2.0, 3.0, 0.4), (0.5, 0.5, 0.3), (5.0, 1.0, 0.9), (1.0, 1.0, 0.0), (1.0, 1.0, 1.0)], "a double, b double, x double").select(stats.beta_inc(F.col("a"), F.col("b"), F.col("x")).alias("i")).collect()
    assert [r.i for r in got] == pytest.approx([0.5248, 2 / math.pi * math.asin(math.sqrt(0.3)), 0.9**5, 0.0, 1.0], abs=1e-9)


def test_folding_is_the_compatibility_decomposition(spark):
    letters = [chr(p) for p in range(0xC0, 0x2000) if chr(p).isalpha()] + list("ﬁﬂａＢ①²㎏ⅷ") + ["é", "ạ̈", "İ"]

    def plain(ch):
        out = "".join(c for c in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(c)).lower()
        return out if out.isascii() and out.isalnum() else ""

    rows = spark.createDataFrame([(i, f"x{ch}y") for i, ch in enumerate(letters)], "i int, t string").select("i", X.normalise(F.col("t")).alias("n")).collect()
    wrong = [(letters[r.i], r.n) for r in rows if plain(letters[r.i]) and r.n != f"x{plain(letters[r.i])}y"]
    assert not wrong and len(letters) > 3000


@pytest.mark.parametrize(("least", "vetoed"), [(0.5, False), (0.7, True), (0.3, True)])
def test_linkage_is_all_pairs(spark, least, vetoed):
    rng = random.Random(int(least * 10))
    words = ["the", *("abcdefghij")]
    draw = lambda: sorted({"the", *rng.sample(words, rng.randint(1, 5))} if rng.random() < 0.7 else set(rng.sample(words, rng.randint(1, 5))))
    left = [(i, draw(), rng.choice(["plant", "other", None])) for i in range(60)] + [(900, [], "plant"), (901, None, None)]
    right = [(i, draw()) for i in range(50)] + [(900, [])]
    veto, bonus = {"plant": {"a", "b"}}, {"c": 0.05, "d": -0.1}
    want = {}
    for i, x, category in left:
        for m, y in right:
            k = len(set(x or ()) & set(y))
            bad = vetoed and veto.get(category, set()) & set(y) and not veto[category] & set(x or ())
            score = k and (k / len(x) + k / len(y)) / 2 + (sum(bonus.get(t, 0) for t in y) if vetoed else 0)
            if k and not bad and score >= least - 1e-12:
                want[i] = min(want.get(i, (9, 0)), (-round(score, 9), m))
    table = spark.createDataFrame([(c, t) for c, ts in veto.items() for t in ts], "category string, token string") if vetoed else None
    got = search.link_records(spark.createDataFrame(left, "id int, tokens array<string>, category string"), spark.createDataFrame(right, "match int, tokens array<string>"), least, table, bonus if vetoed else None).collect()
    assert {r.id: (-round(r.score, 9), r.match) for r in got} == want

"""The constrained selection against a loop down the scores, over random pools of every kind."""

import itertools
import math
import os
import random

import pytest

from sievework.operators.selection import Rules, constrained_selection
from sievework.plans import QUERIES
from sievework.plans.tables import Tables
from sievework.plans.tagging import document_pool, document_rules

FOLDER = os.environ.get("SIEVEWORK_TESTDATA", "/root/testdata/sf0.001")

SCHEMA = "id int, score double, group string, editorial boolean, capped boolean, cost double, veg boolean, main boolean"


def _pool(seed, n):
    rng = random.Random(seed)
    pick = lambda share: rng.random() < share
    return [(i, rng.choice([None, *map(float, range(12))]), rng.choice(["a", "a", "b", "c", None]), pick(0.05), pick(0.3), rng.choice([None, 1.0, 5.0]), pick(0.2), rng.choice([True, False, None])) for i in range(n)]


def _loop(pool, rules, at={"veg": 6, "main": 7}):
    """Row by row, with sets; the rows' fields as in SCHEMA."""
    order = sorted(pool, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    scores = sorted((r[1] for r in pool if r[1] is not None), reverse=True)
    bar = scores[int((1 - rules.bar) * (len(scores) - 1))] if rules.bar is not None and scores else None
    size = rules.size
    for tries in itertools.count(1):
        why = {r[0]: "editorial" for r in pool if r[3]}
        for g in {r[2] for r in pool} - {None}:
            short = rules.floor - sum(1 for r in pool if r[3] and r[2] == g)
            for r in [r for r in order if r[2] == g and not r[3] and (bar is None or r[1] is not None and r[1] >= bar)][: max(short, 0)]:
                why[r[0]] = "floor"
        first = len(why)
        cap = math.inf if rules.ceiling is None else math.floor(rules.ceiling * size)
        for reason in ("score", "fill"):
            for r in order:
                left = size - len(why)
                capped = sum(1 for x in pool if x[0] in why and x[4])
                if left <= 0 or r[0] in why or r[4] and capped >= cap:
                    continue
                lacking = [math.ceil(s * size) - sum(1 for x in pool if x[0] in why and x[at[k]]) >= left and not r[at[k]] for k, s in rules.mix.items()]
                if reason == "fill" or not any(lacking):
                    why[r[0]] = reason
        cost = lambda rs: sum(r[5] or 0 for r in rs)
        spent = cost(r for r in pool if r[0] in why)
        scored = cost(r for r in pool if why.get(r[0]) in ("score", "fill"))
        if rules.budget is None or spent <= rules.budget or not scored:
            break
        size = max(first, size - math.ceil((spent - rules.budget) / (scored / (len(why) - first))) - 1 - (2**tries if tries > 11 else 0))
    return why


@pytest.mark.parametrize(("seed", "n", "rules"), [
    (1, 200, Rules(size=80, floor=6, mix={"veg": 0.3, "main": 0.4}, ceiling=0.2, bar=0.25)),
    (2, 200, Rules(size=60, floor=20, mix={"veg": 0.9}, ceiling=0.1)),
    (3, 150, Rules(size=100, floor=3, mix={"main": 0.45, "veg": 0.25}, bar=0.25, budget=120.0)),
    (4, 40, Rules(size=90, mix={"veg": 0.5}, ceiling=0.3)),
    (5, 0, Rules(size=5, floor=2, mix={"veg": 0.5}, bar=0.25, budget=3.0)),
])
def test_constrained_selection_is_the_loop(spark, seed, n, rules):
    pool = _pool(seed, n)
    got = constrained_selection(spark.createDataFrame(pool, SCHEMA), rules, parts=5).collect()
    assert {r["id"]: r["reason"] for r in got} == _loop(pool, rules)
    assert len(got) == len({r["id"] for r in got})
    within = None if rules.budget is None else sum(r["cost"] for r in got) <= rules.budget
    assert {r["within_budget"] for r in got} <= {within}


@pytest.mark.parametrize(("budget", "within"), [(40.0, True), (2.0, False), (10_000.0, True)])
def test_the_budget_is_kept_or_said_to_be_exceeded(spark, budget, within):
    """Costs fall with the score, so that a mean cost tells too little of what a smaller size saves."""
    pool = [(i, float(i), "a", i == 0, False, 5.0 if i == 0 else 0.1 + 20.0 / (1 + i), False, False) for i in range(120)]
    got = constrained_selection(spark.createDataFrame(pool, SCHEMA), Rules(size=100, budget=budget), parts=4).collect()
    assert {r["within_budget"] for r in got} == {within} and (sum(r["cost"] for r in got) <= budget) == within


def test_select_constrained_is_the_loop(spark):
    t = Tables(spark, FOLDER)
    pool = [tuple(r) for r in document_pool(t).collect()]
    got = QUERIES["select_constrained"](spark, FOLDER).collect()
    assert {r["id"]: r["reason"] for r in got} == _loop(pool, document_rules(len(pool)), {"short": 6})

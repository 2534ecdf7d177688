"""Closures of any depth, cycles, and the checks of a dimension."""

import random

from sievework.operators import hierarchy

TREE = "slug string, parent string"


def _pairs(edges):
    up = {}
    for s, p in edges:
        if s is not None and p is not None:
            up.setdefault(s, set()).add(p)
    out = {}
    for s in up:
        level, depth = {s}, 0
        while level:
            depth += 1
            level = {p for x in level for p in up.get(x, ())} - {a for (b, a) in out if b == s}
            out |= {(s, p): depth for p in level}
    return {(s, p, d) for (s, p), d in out.items()}


def test_a_chain_of_forty_levels_and_a_cycle(spark):
    rng = random.Random(1)
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    edges = [*chain, ("n40", None), ("a", "b"), ("b", "c"), ("c", "a"), ("under", "a"), ("self", "self"), (None, "n1"), ("n3", "n4"), ("two", "n38"), ("two", "n7")]
    edges += [(f"r{i}", f"r{rng.randrange(i)}") for i in range(1, 60)]
    df = spark.createDataFrame(edges, TREE)
    got = hierarchy.ancestors(df).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == _pairs(edges)
    assert max(r.depth for r in got if r.slug == "n0") == 40
    assert {r.slug for r in hierarchy.cycles(df).collect()} == {"a", "b", "c", "self"}


def test_no_edges(spark):
    assert hierarchy.ancestors(spark.createDataFrame([], TREE)).count() == 0
    assert hierarchy.cycles(spark.createDataFrame([("a", None)], TREE)).count() == 0


def test_dimension(spark):
    rows = [("a", None, 1), ("b", "a", 2), ("b", "a", 3), (None, "a", 4), ("c", "gone", 5), ("d", "e", 6), ("e", "d", 7), ("f", "b", 8), ("g", "d", 9)]
    got = {r.n: r.reason for r in hierarchy.dimension(spark.createDataFrame(rows, TREE + ", n int")).collect()}
    assert got == {1: None, 2: "duplicate_key", 3: "duplicate_key", 4: "no_key", 5: "unknown_parent", 6: "cycle", 7: "cycle", 8: None, 9: None}

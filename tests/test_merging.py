"""Two runs or sources of one thing, with nulls, ties and rows of one side only."""

from pyspark.sql import functions as F

from sievework.operators import merging as M


def test_movement(spark):
    schema = "course string, id int, score double"
    before = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 8.0), ("a", 3, None), ("a", 4, 8.0), ("b", 1, 1.0), (None, 7, 2.0)], schema)
    after = spark.createDataFrame([("a", 2, 9.0), ("a", 1, 9.0), ("a", 5, 1.0), ("a", 3, 5.0), ("c", 1, 1.0)], schema)
    got = {(r.course, r.id): (r.movement, r.place_before, r.place_after, r.rise) for r in M.movement(before, after, "id", "score", "course").collect()}
    assert got == {
        ("a", 1): ("kept", 0, 0, 0.0), ("a", 2): ("kept", 1, 1, 0.0), ("a", 3): ("rose", 3, 2, 0.25), ("a", 4): ("left", 2, None, None), ("a", 5): ("entered", None, 3, None), ("b", 1): ("left", 0, None, None), ("c", 1): ("entered", None, 0, None),
        (None, 7): ("left", 0, None, None),
    }


def test_backfilled(spark):
    rows = spark.createDataFrame([(1, "s", None, "x"), (2, "s", 5, "x"), (3, "s", None, "x"), (None, "s", None, "x")], "id int, source string, n int, version string")
    features = spark.createDataFrame([(1, "s", "v2", 7), (1, "s", "v1", 8), (2, "s", "v2", 9), (3, "t", "v2", 1), (None, "s", "v2", 4)], "id int, source string, version string, n int")
    got = {r.id: (r.n, r.version, r.found) for r in M.backfilled(rows, features, ["id", "source"], "v2", ["n"]).collect()}
    assert got == {1: (7, "x", True), 2: (5, "x", True), 3: (None, "x", False), None: (None, "x", False)}


def test_merged_and_shown(spark):
    row = spark.range(1).select(
        M.merged(F.expr("map('a', 1L, 'b', 2L)"), F.expr("map('b', 3L, 'c', 4L)")).alias("m"), M.merged(F.lit(None).cast("map<string,bigint>"), F.expr("map('x', 1L)")).alias("one"),
        *(M.shown(F.lit("made"), F.lit(g).cast("string"), F.lit(c).cast("double")).alias(n) for n, g, c in (("given", "own", 0.1), ("sure", None, 0.8), ("unsure", None, 0.79), ("unknown", None, None))),
    ).first()
    assert (row.m, row.one) == ({"a": 1, "b": 5, "c": 4}, {"x": 1}) and (row.given, row.sure, row.unsure, row.unknown) == ("own", "made", None, None)


def test_presets(spark):
    flags = spark.createDataFrame([(1, 1, "meat"), (1, 1, "dairy"), (1, 2, None), (2, 1, "dairy"), (2, 2, "dairy"), (3, 1, None)], "id int, line int, flag string")
    presets = spark.createDataFrame([("veg", "meat"), ("vegan", "meat"), ("vegan", "dairy")], "preset string, flag string")
    assert {(r.preset, r.id): r.blockers for r in M.preset_status(flags, presets).collect()} == {("veg", 1): 1, ("veg", 2): 0, ("veg", 3): 0, ("vegan", 1): 1, ("vegan", 2): 2, ("vegan", 3): 0}

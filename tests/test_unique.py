"""The validating stream writer: killed between batches, started again, and accounted for."""

from collections import Counter

import pytest

from sievework.streaming import unique as U

SCHEMA = "id string, title string, items array<string>, steps array<string>, n int"


def _file(spark, path, rows, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("crash_at", [0, 1, 2])
def test_each_id_once_though_it_is_killed(spark, tmp_path, crash_at):
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    good = lambda i, n: (f"id {i}", "t", ["x"], None, n)
    parts = [
        [good(1, 1), good(2, 2), good(2, 3), (None, "t", ["x"], ["y"], 4), ("", "t", ["x"], ["y"], 5)],
        [good(2, 6), good(3, 7), ("id 4", None, ["x"], ["y"], 8), ("id 4", " ", ["x"], ["y"], 9), ("id 5", "t", [], None, 10)],
        [good(1, 11), good(4, 12), good(5, 13), ("id 5", "t", None, ["y"], 14)],
    ]
    for i, rows in enumerate(parts):
        _file(spark, folder, rows, i)
    schema = spark.createDataFrame([], SCHEMA).schema
    args = ("id", ["title"], ["items", "steps"])

    def killed(number):
        if number == crash_at:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        U.write_unique(spark, folder, schema, target, checkpoint, *args, after=killed)
    U.write_unique(spark, folder, schema, target, checkpoint, *args)
    U.write_unique(spark, folder, schema, target, checkpoint, *args)  # nothing new
    assert Counter(r.id for r in U.written(spark, schema, target).collect()) == Counter(f"id {i}" for i in range(1, 6))
    told = U.ledger(spark, folder, schema, target, *args).collect()
    assert Counter({r: sum(x.n for x in told if x.reason == r) for r in {x.reason for x in told}}) == Counter(kept=5, duplicate=4, missing_id=2, missing_title=2, empty_both=1)
    assert sorted(Counter({f: sum(x.n for x in told if x.file == f) for f in {x.file for x in told}}).values()) == [4, 5, 5]
    # A later file: its old keys are known across runs.
    _file(spark, folder, [good(3, 20), good(9, 21)], 3)
    U.write_unique(spark, folder, schema, target, checkpoint, *args)
    assert Counter(r.id for r in U.written(spark, schema, target).collect()) == Counter(f"id {i}" for i in (1, 2, 3, 4, 5, 9))


def test_a_horizon_forgets_old_keys(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    df = lambda rows: spark.createDataFrame(rows, "id string, ts string").selectExpr("id", "cast(ts as timestamp) as ts")
    runs = [[("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00")], [("b", "2024-01-03 00:00:00")], [("c", "2024-01-03 00:01:00"), ("b", "2024-01-03 00:02:00"), ("a", "2024-01-03 00:02:00")]]
    for rows in runs:
        df(rows).coalesce(1).write.mode("append").parquet(folder)
        U.write_unique(spark, folder, df(rows).schema, target, checkpoint, "id", [], within=("ts", "1 hour"))
    assert Counter(r.id for r in U.written(spark, df(runs[0]).schema, target).collect()) == Counter(a=2, b=1, c=1)

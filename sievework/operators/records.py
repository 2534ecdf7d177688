"""Keys, counters and draws over record tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import staged


def running(rows: DataFrame, order: str, *keys: str, weight: str | None = None, by: str | None = None) -> DataFrame:
    """Adds `rank`, the sum of `weight` (else 1 a row) up to each row in order of a number and keys, and `all`, that of all rows; within each value of `by`.

    In two levels: sums inside ranges of (by, number, keys), of which the session's shuffle partitions say how many, and those of the ranges before. No
    task sorts the whole table or a whole group. Null numbers stand last, and so do null keys; a null `by` is a group of its own.
    """
    each = F.col(weight) if weight else F.lit(1)
    place = [F.col(c).asc_nulls_last() for c in (order, *keys)]
    group = F.struct(F.lit(0) if by is None else F.col(by)).alias("_by")
    dealt = staged(rows.withColumn("_by", group).repartitionByRange("_by", *place).withColumn("_range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy("_by", "_range").agg(F.sum(each).alias("_held"))
    upto = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("_by", "_range", F.coalesce(F.sum("_held").over(upto), F.lit(0)).alias("_before"), F.sum("_held").over(Window.partitionBy("_by")).alias("all"))
    inside = F.sum(each).over(Window.partitionBy("_by", "_range").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_inside", inside).join(before, ["_by", "_range"])
    return out.withColumn("rank", F.col("_inside") + F.col("_before")).drop("_by", "_range", "_inside", "_before")


def ranked(rows: DataFrame, order: str, key: str) -> DataFrame:
    """Adds `rank`, from 1, by a number and a unique key."""
    return running(rows, order, key).drop("all")


def bands(rank: Column, n: Column, share: float = 0.05) -> Column:
    """`top`, `middle` or `bottom` for the first, the middle and the last `share` of n ranks (from 1), else null."""
    k = F.floor(n * share)
    start = F.floor((n - k) / 2)
    return F.when(rank <= k, "top").when((rank > start) & (rank <= start + k), "middle").when(rank > n - k, "bottom")


def mismatches(rows: DataFrame, stored: Column, made: Column) -> DataFrame:
    """Adds `reason`: `selection_mismatch` where a row's stored key is not what its record gives, null safe."""
    return rows.withColumn("reason", F.when(~stored.eqNullSafe(made), "selection_mismatch"))


def counters(rows: DataFrame, **columns: str) -> DataFrame:
    """(name, n): one counter `prefix.value` for each value of each column, `prefix.(none)` for nulls; counters of several runs add up by name."""
    names = F.array(*(F.concat(F.lit(f"{prefix}."), F.coalesce(F.col(c).cast("string"), F.lit("(none)"))) for prefix, c in columns.items()))
    return rows.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def with_mean_imputed(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, total, unknown): sums where unknown values count as the mean of the group's known ones; null where nothing is known."""
    out = rows.groupBy(group).agg(F.sum(value).alias("known"), F.count(value).alias("k"), F.count("*").alias("n"))
    return out.select(group, F.when(F.col("k") > 0, F.col("known") / F.col("k") * F.col("n")).alias("total"), (F.col("n") - F.col("k")).alias("unknown"))


def pool_then_rank(rows: DataFrame, rough: list, exact: list, limit: int, least: int = 200) -> DataFrame:
    """The best `limit` rows by the exact order among a pool of max(4 * limit, least) rows that the rough order picks."""
    return rows.orderBy(*rough).limit(max(4 * limit, least)).orderBy(*exact).limit(limit)


def carried(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(state, n): keys of two builds that are kept, gone or new."""
    both = old.select(F.col(key).alias("k"), F.lit(True).alias("a")).join(new.select(F.col(key).alias("k"), F.lit(True).alias("b")), "k", "full")
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("kept")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def selected(rows: DataFrame, wanted: DataFrame, place: list[str], key: str) -> DataFrame:
    """The wanted places (of any number of files) with `reason`: `selection_missing` where no row is read there, `selection_mismatch` where its key differs."""
    read = rows.select(*place, F.col(key).alias("read_key"), F.lit(True).alias("there"))
    reason = F.when(F.col("there").isNull(), "selection_missing").when(~F.col(key).eqNullSafe(F.col("read_key")), "selection_mismatch")
    return wanted.join(read, place, "left").withColumn("reason", reason).drop("there", "read_key")


def caught(function: Callable, kind: str):
    """A vectorised helper of one column that gives (value, error): a row that fails keeps its error's type and message and stops nothing else."""

    def one(x) -> tuple:
        try:
            return function(x), None
        except Exception as e:  # any error of any row is that row's result
            return None, f"{type(e).__name__}: {e}"[:200]

    def each(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in column.astype(object).where(column.notna(), None)], columns=["value", "error"]).astype(object)

    return F.pandas_udf(each, f"value {kind}, error string")

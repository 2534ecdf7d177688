"""Samples and selections that depend on order and keys only, never on chance or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import running


def stride(rows: DataFrame, group: str, order: str, quota: int) -> DataFrame:
    """Every max(1, n // quota)-th row of each group in order, up to the quota."""
    each = Window.partitionBy(group)
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(each) / quota))
    at = F.row_number().over(each.orderBy(order)) - 1
    return rows.withColumn("at", at).withColumn("step", step).where((F.col("at") % F.col("step") == 0) & (F.col("at") < F.col("step") * quota)).drop("at", "step")


def even_ranks(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The rows at ranks (i * n) // k, i = 0 to k - 1, of each group; all rows of smaller groups."""
    each = Window.partitionBy(group)
    n, at = F.count("*").over(each), F.row_number().over(each.orderBy(order)) - 1
    # Rank r is taken if some i has i * n // k = r, so if the steps reach r before r + 1.
    taken = F.ceil(at * k / F.col("n")) * F.col("n") < (at + 1) * k
    return rows.withColumn("n", n).withColumn("take", taken).where("take or n <= %d" % k).drop("n", "take")


def water_level(sizes: DataFrame, budget: int) -> int:
    """The largest equal share so that groups of (size) give budget rows in all; sizes are one row a group."""
    left, shares = budget, sorted(r[0] for r in sizes.select("size").collect())
    for i, size in enumerate(shares):
        if size * (len(shares) - i) > left:
            return left // (len(shares) - i)
        left -= size
    return shares[-1] if shares else 0


def top_per(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each partition before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= n)


def nearest_rank(rows: DataFrame, value: str, q: float) -> DataFrame:
    """The value at index int((1 - q) * (n - 1)) of the descending list: counts of values give it without sorting all rows in one task."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("k"))
    placed = running(counts.withColumn("down", -F.col(value)), "down", weight="k").withColumnsRenamed({"rank": "upto", "all": "n"})
    index = F.floor((F.lit(1) - F.lit(q)) * (F.col("n") - 1))
    return placed.where((F.col("upto") > index) & (F.col("upto") - F.col("k") <= index)).select(F.col(value).alias("value"), "n")

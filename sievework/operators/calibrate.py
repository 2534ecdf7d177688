"""Calibration by hits: the value that most intervals of a class contain, by one sweep over their ends; and zones of trust from a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import running


def most_hit(intervals: DataFrame, group: str = "group") -> DataFrame:
    """(group, value, hits, n) from closed intervals (group, low, high): the smallest value that the most intervals of its group contain.

    A sweep: an interval opens at its low end and closes behind its high end, the running sum of opened and closed ones is the number that contains a
    value, and it is largest at some low end. Ends are summed by value before they are ordered, and the running sums are taken in ranges, so no task
    holds a group. Intervals with a null end or an end before their beginning contain nothing and do not count in n; groups without others are left out.
    """
    good = intervals.where("low <= high")
    ends = F.array(F.struct(F.col("low").cast("double").alias("x"), F.lit(0).alias("side"), F.lit(1).alias("d")), F.struct(F.col("high").cast("double").alias("x"), F.lit(1).alias("side"), F.lit(-1).alias("d")))
    steps = good.select(F.col(group).alias("group"), F.explode(ends).alias("e")).groupBy("group", "e.x", "e.side").agg(F.sum("e.d").alias("d"))
    swept = running(steps, "x", "side", weight="d", by="group").where("side = 0")
    best = swept.groupBy("group").agg(F.min_by(F.struct("x", "rank"), F.struct(-F.col("rank"), "x")).alias("b"))
    sizes = good.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n"))
    return best.join(sizes, F.col("group").eqNullSafe(F.col("_group"))).select(F.col("group").alias(group), F.col("b.x").alias("value"), F.col("b.rank").cast("long").alias("hits"), "n")


def softened(value: Column, prior: Column, zone: float) -> Column:
    """A value as it is within `zone` times the prior, drawn towards the prior by that factor beyond; 1 trusts nothing but far values' direction."""
    return F.when(value > prior * zone, value / zone).when(value * zone < prior, value * zone).otherwise(prior)


def best_zone(rows: DataFrame, zones: list[float], slack: float = 0.02, within: float = 0.25, group: str = "kind") -> DataFrame:
    """(group, zone, hits, best, n) from (group, value, prior, truth): the smallest zone whose hits are nearly the most of the grid's.

    A hit: the softened value is within `within` of the truth, as a share of it. Nearly: fewer by less than `slack` of the rows, at least one. All zones
    are counted in one pass. Rows with a null are no hits.
    """
    hit = lambda z: F.count_if(F.abs(softened(F.col("value"), F.col("prior"), z) - F.col("truth")) <= within * F.abs(F.col("truth")))
    counted = rows.groupBy(group).agg(F.count("*").alias("n"), F.array(*(F.struct(F.lit(z).alias("zone"), hit(z).alias("hits")) for z in sorted(zones))).alias("grid"))
    best = F.array_max(F.transform("grid", lambda g: g.hits))
    near = F.filter("grid", lambda g: g.hits > F.col("best") - F.greatest(F.lit(1.0), F.lit(slack) * F.col("n")))
    return counted.withColumn("best", best).select(group, near[0].zone.alias("zone"), near[0].hits.alias("hits"), "best", "n")


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the mean of the two middle values of each group, from counts of values and running sums in ranges; nulls do not count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("group"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("k"))
    placed = running(counts, "value", weight="k", by="group")
    upto = lambda at: F.min(F.when(F.col("rank") >= at, F.col("value")))
    middle = placed.groupBy("group").agg(upto(F.ceil(F.col("all") / 2)).alias("low"), upto(F.floor(F.col("all") / 2) + 1).alias("high"))
    return middle.select(F.col("group").alias(group), ((F.col("low") + F.col("high")) / 2).alias("median"))

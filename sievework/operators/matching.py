"""Coverage matching: which items can be completed with what one has, and how they rank."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(postings: DataFrame, have: DataFrame) -> DataFrame:
    """(id, matched, core_count, missing) of every item of which at least one core slug is at hand.

    `have` is (slug). One grouping of the posting lists serves both counts, so
    postings are shuffled once, after partial aggregation.
    """
    marked = postings.where("core").join(have.distinct().withColumn("mine", F.lit(1)), "slug", "left")
    counted = marked.groupBy("id").agg(F.count("mine").alias("matched"), F.count("*").alias("core_count"))
    return counted.where("matched > 0").withColumn("missing", F.col("core_count") - F.col("matched"))


def outside_kitchen(tools: DataFrame, allowed: list) -> DataFrame:
    """Ids that need a tool outside `allowed` with no allowed alternative in its group.

    A group is bad if none of its tools is allowed, which one grouping tells:
    no self-join, no correlated subquery.
    """
    return tools.groupBy("id", "grp").agg(F.max(F.col("tool").isin(allowed)).alias("ok")).where("not ok").select("id").distinct()


def uses_only(tools: DataFrame, allowed: list) -> DataFrame:
    """Ids whose tools all lie in `allowed` and that use at least one."""
    return tools.groupBy("id").agg(F.min(F.col("tool").isin(allowed)).alias("all_in")).where("all_in").select("id")


def active(**predicates: Column | None) -> Column:
    """The conjunction of the predicates that are set; an unset filter leaves nothing in the plan."""
    found = F.lit(True)
    for p in predicates.values():
        if p is not None:
            found = found & p
    return found


def rank_order() -> list[Column]:
    return [F.asc("missing"), F.desc(F.col("matched") / F.col("core_count")), F.desc("quality"), F.asc("id")]


def band_columns(matched: Column, total: Column, floor: int = 3, width: float = 0.1) -> dict[str, Column]:
    """Coverage, its band and its floor class; the band is taken in doubles."""
    share = matched.cast("double") / total
    return {"coverage": share, "band": F.floor(share / F.lit(width)).cast("long"), "floor_class": F.least(matched, F.lit(floor)).cast("long")}


def band_order() -> list[Column]:
    """Enough covered first, then the band, plain over adaptable, more covered, better, fewer missing."""
    return [F.desc("floor_class"), F.desc("band"), F.asc(F.col("diet") == "adaptable"), F.desc("matched"), F.desc("quality"), F.asc("missing"), F.asc("id")]


def avoid_verdict(postings: DataFrame, avoid: DataFrame) -> DataFrame:
    """(id, hidden, lower_hits): hidden by any slug of mode `hide`, lowered by each of mode `lower`."""
    hits = postings.join(avoid, "slug")
    return hits.groupBy("id").agg(F.max(F.col("mode") == "hide").alias("hidden"), F.count_if(F.col("mode") == "lower").alias("lower_hits"))


def best_swap(lacking: DataFrame, swaps: DataFrame, have: DataFrame, least: int = 2) -> DataFrame:
    """(slug, swap, quality): for each lacking slug the best stand-in that is at hand: quality first, then the smaller id."""
    usable = swaps.where(F.col("quality") >= least).join(have.select(F.col("slug").alias("swap")), "swap", "left_semi")
    return (
        lacking.select("slug").distinct().join(usable, F.col("slug") == F.col("target"))
        .groupBy("slug").agg(F.min_by(F.struct("swap", "quality"), F.struct(-F.col("quality"), "swap")).alias("best")).select("slug", "best.swap", "best.quality")
    )


def _first_in(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The smallest of ranks[lo:hi] for each pair, lo < hi, from minima over 1, 2, 4, ... neighbours."""
    out, width, low = np.empty(len(lo), ranks.dtype), 1, ranks
    level = np.log2(hi - lo).astype(int)
    for k in range(level.max(initial=-1) + 1):
        here = level == k
        out[here] = np.minimum(low[lo[here]], low[hi[here] - width])
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    return out


def _nearby(by: list[str], steps: tuple[tuple[float, int], ...]):
    def best(rows: pa.Table) -> pa.Table:
        asked, held = rows.filter(pc.is_null(rows["swap"])), rows.filter(pc.is_valid(rows["swap"])).sort_by("value")
        values, a = held["value"].to_numpy(), asked["value"].to_numpy()
        ranks, places = pc.rank(held["swap"]).to_numpy().astype(np.int64) - 1, pc.sort_indices(held["swap"])
        found, quality = np.full(len(a), -1), np.zeros(len(a), np.int32)
        for gap, q in steps:
            # Differences fall and rise with the value, so what is near enough stands together; bounds are moved until the differences themselves say so.
            lo, hi = np.searchsorted(values, a - gap), np.searchsorted(values, a + gap)
            ends = np.concatenate(([-np.inf], values, [np.inf]))  # values[i] is ends[i + 1]
            while (back := a - ends[lo] < gap).any():
                lo = lo - back
            while (on := a - ends[lo + 1] >= gap).any():
                lo = lo + on
            while (on := ends[hi + 1] - a < gap).any():
                hi = hi + on
            while (back := ends[hi] - a >= gap).any():
                hi = hi - back
            new = (quality == 0) & (lo < hi)
            found[new], quality[new] = _first_in(ranks, lo[new], hi[new]), q
        met = pa.array(quality > 0)
        columns = {c: asked[c].filter(met) for c in (*by, "value")}
        return pa.table(columns | {"swap": held["swap"].take(places).take(pa.array(found[quality > 0])), "quality": pa.array(quality[quality > 0])})

    return best


def best_nearby(lacking: DataFrame, at_hand: DataFrame, by: list[str], steps: tuple[tuple[float, int], ...]) -> DataFrame:
    """(slug, swap, quality) from (slug, by, value) of both: for each lacking slug the best of those at hand that equal it in `by`, as best_swap finds it.

    steps: (gap, quality), narrow ones first: the quality of a swap whose value differs by less than `gap`. No lacking slug is at hand. Slugs of like value
    are not paired: of those at hand at one value the smallest counts, values in reach are a stretch of the sorted ones, and the smallest slug of a stretch
    comes from minima over it. Rows that stand together are the different values of one `by` in a bin twice as wide as the widest gap and beside it.
    Nulls, and values that are not finite, stand in for nothing.
    """
    wide = 2 * max(gap for gap, _ in steps)
    finite = (F.abs("value") < float("inf")) & reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in (*by, "slug")))
    asked, bin_ = lacking.where(finite), F.floor(F.col("value") / wide)
    places = asked.select(*by, "value").distinct().withColumn("bin", bin_)
    held = at_hand.where(finite).groupBy(*by, "value").agg(F.min("slug").alias("swap")).withColumn("bin", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)))
    kinds = {c: asked.schema[c].dataType.simpleString() for c in by} | {"value": "double", "swap": at_hand.schema["slug"].dataType.simpleString(), "quality": "int"}
    both = places.withColumn("swap", F.lit(None).cast(kinds["swap"])).unionByName(held)
    best = both.groupBy(*by, "bin").applyInArrow(_nearby(by, steps), ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))
    met = asked.join(best, [*by, "value"])
    return met.groupBy("slug").agg(F.min_by(F.struct("swap", "quality"), F.struct(-F.col("quality"), "swap")).alias("best")).select("slug", "best.swap", "best.quality")


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Of two arrays of distinct values; `empty` is the value for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)

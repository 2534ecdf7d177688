"""Selection under quotas: groups that are owed rows come first, then the best of the rest, under a ceiling a group."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import nearest_rank


def guarded_selection(rows: DataFrame, group: str, size: int, floor: int, ceiling: int) -> DataFrame:
    """Rows of (id, group, score) chosen: each group's best `floor` rows, then the best others up to `size` rows, never over `ceiling` of a group.

    Going down the scores and taking a row unless its group is full, or unless
    what is left must go to groups still short, ends at the same rows: floors
    never depend on other groups, and a row past its group's floor is taken in
    score order while room beside all floors remains. So a rank inside the
    group, kept by Spark's group limit to the ceiling, and one global top-k do it.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "id"))
    ranked = rows.withColumn("nth", rank).where(F.col("nth") <= ceiling)
    owed = ranked.where(F.col("nth") <= floor)
    room = size - owed.count()
    rest = ranked.where(F.col("nth") > floor).orderBy(F.desc("score"), "id").limit(max(room, 0))
    return owed.withColumn("reason", F.lit("floor")).unionByName(rest.withColumn("reason", F.lit("fill")))


@dataclass(frozen=True)
class Rules:
    """What a constrained selection must keep to. The share of a `mix` entry is that of `size`; so is the ceiling of the capped rows."""

    size: int
    floor: int = 0
    mix: dict[str, float] = field(default_factory=dict)  # boolean column -> least share
    ceiling: float | None = None
    bar: float | None = None  # floors take no row below this quantile of all scores
    budget: float | None = None  # most that `cost` may add up to


@dataclass
class _Walk:
    """Where the walk down the scores stands: what is taken, and the stretches (from, to, needed columns, cap reached) it took rows from."""

    taken: int
    capped: int
    meets: dict[str, int]
    stretches: list = field(default_factory=list)


def _beyond(place: tuple | None) -> Column:
    if place is None:
        return F.lit(True)
    down, key = map(F.lit, place)
    return (F.col("down") > down) | (F.col("down") == down) & (F.col("id") > key)


def _within(stretch: tuple) -> Column:
    start, end, needed, full = stretch
    at = _beyond(start) if end is None else _beyond(start) & ~_beyond(end)
    return reduce(lambda a, b: a & b, [F.col(k) for k in needed] + ([~F.col("capped")] if full else []), at)


def _any(stretches: list) -> Column:
    return reduce(lambda a, b: a | b, map(_within, stretches), F.lit(False))


def _descend(open_: DataFrame, walk: _Walk, size: int, cap: int | None, need: dict[str, int]) -> None:
    """Takes rows of `open_` in order until `size` are taken, a stretch at a time.

    While the rows left to take are no more than a mix entry still needs, only rows that meet it are taken, and none that is capped once the cap is
    reached. Both, once so, stay so; thus each stretch ends at the first row after which one more of them holds, and there are at most two more
    stretches than mix entries. Where that row is, counts a range tell (one row a range comes to the driver), then a running count inside one range.
    """
    place = None
    while (left := size - walk.taken) > 0:
        slack = {k: left - (need[k] - walk.meets[k]) for k in need}
        needed = tuple(k for k in need if slack[k] <= 0)
        full = cap is not None and walk.capped >= cap
        rows = open_.where(_within((place, None, needed, full)))
        stops = {"n": left} | {f"not_{k}": slack[k] for k in need if k not in needed}
        counted = {"n": F.lit(1), "c": F.col("capped").cast("int")} | {f"not_{k}": (~F.col(k)).cast("int") for k in need}
        if cap is not None and not full:
            stops["c"] = cap - walk.capped
        before = dict.fromkeys(counted, 0)
        found = None
        for held in sorted(rows.groupBy("range").agg(*(F.sum(v).alias(k) for k, v in counted.items())).collect()):
            if any(before[k] + held[k] >= stops[k] for k in stops):
                found = held["range"]
                break
            before = {k: before[k] + held[k] for k in before}
        end = None
        if found is not None:
            upto = Window.partitionBy("range").orderBy("down", "id").rowsBetween(Window.unboundedPreceding, 0)
            run = rows.where(F.col("range") == found).select("down", "id", *((F.sum(v).over(upto) + before[k]).alias(k) for k, v in counted.items()))
            reached = reduce(lambda a, b: a | b, (F.col(k) >= stops[k] for k in stops))
            last = run.where(reached).orderBy("down", "id").first()
            end, before = (last["down"], last["id"]), last.asDict()
        walk.stretches.append((place, end, needed, full))
        walk.taken += before["n"]
        walk.capped += before["c"]
        walk.meets = {k: walk.meets[k] + before["n"] - before[f"not_{k}"] for k in need}
        if end is None:
            return
        place = end


def constrained_selection(rows: DataFrame, rules: Rules, parts: int = 64) -> DataFrame:
    """(id, reason, score, cost, within_budget) of the rows chosen from (id unique, score, group, editorial, capped, cost, and the boolean columns of `rules.mix`).

    Reasons, in this order: `editorial` rows all; each group's best rows up to its `floor` (editorial ones count), none below the bar; `score`, the best
    of the rest, guarded so that the mix can still be met; `fill`, the best of what the guard passed over, where rows are lacking. The ceiling of
    capped rows holds for the last two. Where the costs add up to more than the budget, smaller sizes are tried until they do not or only editorial
    and floor rows are left, which stay; `within_budget` says which of both it is (null without a budget). Null scores stand last, null groups have no floor, null flags are false, null costs 0. All passes are grouped counts over `parts`
    ranges of the order; no task and no driver list grows with the table beyond one range.
    """
    false = F.lit(False)
    flags = [F.coalesce(F.col(k), false).alias(k) for k in ("editorial", "capped", *rules.mix)]
    down = F.coalesce(-F.col("score").cast("double"), F.lit(float("inf")))
    base = rows.select("id", "score", "group", F.coalesce("cost", F.lit(0)).cast("double").alias("cost"), down.alias("down"), *flags)
    if rules.bar is not None:
        least = nearest_rank(base.where(F.col("down") < float("inf")).withColumn("s", -F.col("down")), "s", rules.bar).first()
        base = base.withColumn("good", F.col("down") <= (-least["value"] if least else 0.0))
    else:
        base = base.withColumn("good", F.lit(True))
    ours = base.where("editorial").groupBy("group").agg(F.count("*").alias("ours"))
    # Only the best `floor` others of a group are ranked past the shuffle: the rank's limit is known beforehand.
    other = base.where(~F.col("editorial") & F.col("good") & F.col("group").isNotNull())
    nth = F.row_number().over(Window.partitionBy("group").orderBy("down", "id"))
    best = other.withColumn("nth", nth).where(F.col("nth") <= rules.floor).join(ours, "group", "left")
    owed = best.where(F.col("nth") <= rules.floor - F.coalesce("ours", F.lit(0))).select("id", F.lit(True).alias("owed"))
    reason = F.when(F.col("editorial"), "editorial").when(F.col("owed"), "floor")
    marked = base.join(owed, "id", "left").withColumn("reason", reason).drop("owed", "good", "group")
    ranged = marked.repartitionByRange(parts, "down", "id").withColumn("range", F.spark_partition_id()).persist()
    kept = ranged.where(F.col("reason").isNotNull())
    start = kept.agg(F.count("*").alias("n"), F.count_if("capped").alias("c"), F.sum("cost").alias("cost"), *(F.count_if(k).alias(k) for k in rules.mix)).first()
    open_, size = ranged.where(F.col("reason").isNull()), rules.size
    tries, within = 0, None
    while True:
        cap = None if rules.ceiling is None else math.floor(rules.ceiling * size)
        need = {k: math.ceil(share * size) for k, share in rules.mix.items()}
        guarded = _Walk(start["n"], start["c"], {k: start[k] for k in rules.mix})
        _descend(open_, guarded, size, cap, need)
        by_score = _any(guarded.stretches)
        fill = _Walk(guarded.taken, guarded.capped, {})
        _descend(open_.where(~by_score), fill, size, cap, {})
        chosen = F.coalesce("reason", F.when(by_score, "score").when(_any(fill.stretches), "fill"))
        out = ranged.select("id", chosen.alias("reason"), "score", "cost").where(F.col("reason").isNotNull())
        if rules.budget is None:
            break
        spent, scored = out.agg(F.sum("cost"), F.sum(F.when(F.col("reason").isin("score", "fill"), F.col("cost")))).first()
        n, within = fill.taken - start["n"], (spent or 0) <= rules.budget
        if within or n == 0 or not scored:
            break
        # What is over the budget in rows of mean cost; from the twelfth try on twice as much more each time, so that the tries end.
        tries += 1
        size = max(start["n"], size - math.ceil((spent - rules.budget) / (scored / n)) - 1 - (2**tries if tries > 11 else 0))
    return out.withColumn("within_budget", F.lit(within).cast("boolean"))

"""Two runs or two sources of one thing: rankings compared, features filled in by version and precedence, maps merged, labels shown by confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import running


def movement(before: DataFrame, after: DataFrame, key: str, score: str, by: str) -> DataFrame:
    """(by, key, movement, place_before, place_after, rise): places from 0 by falling score, then key, inside each value of `by`.

    movement is `entered`, `left`, `rose`, `fell` or `kept`; rise is the percentile (place over the run's size) before minus that after, null for rows of
    one run. Null scores stand last; keys are unique in a run.
    """

    def placed(rows: DataFrame, name: str) -> DataFrame:
        down = rows.select(by, key, (-F.col(score)).alias("down"))
        return running(down, "down", key, by=by).select(by, key, (F.col("rank") - 1).alias(f"place_{name}"), ((F.col("rank") - 1) / F.col("all")).alias(name))

    both = placed(before, "before").join(placed(after, "after"), [by, key], "full")
    rise = F.col("before") - F.col("after")
    kind = F.when(F.col("after").isNull(), "left").when(F.col("before").isNull(), "entered").when(rise > 0, "rose").when(rise < 0, "fell").otherwise("kept")
    return both.select(by, key, kind.alias("movement"), "place_before", "place_after", rise.alias("rise"))


def backfilled(rows: DataFrame, features: DataFrame, key: list[str], version: str, columns: list[str]) -> DataFrame:
    """The rows with the feature columns filled in where they are null and `found`, whether features of this version are there for the row.

    features: the key, `version` and the columns, a key once in a version; other versions do not count. A row's own values go before those filled in.
    Null keys find nothing.
    """
    held = features.where(F.col("version") == version).select(*key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_found"))
    filled = {c: F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in columns}
    return rows.join(held, key, "left").select(*(filled.get(c, F.col(c)) for c in rows.columns), F.coalesce("_found", F.lit(False)).alias("found"))


def merged(left: Column, right: Column) -> Column:
    """One map of numbers of two: values of common keys add up, a null map is empty."""
    none = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(left, none), F.coalesce(right, none), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def shown(label: Column, given: Column, confidence: Column, least: float = 0.8) -> Column:
    """The label to show: a given one always, one that a classifier made from `least` confidence on, else none."""
    return F.coalesce(given, F.when(confidence >= least, label))


def preset_status(flags: DataFrame, presets: DataFrame) -> DataFrame:
    """(preset, id, blockers): for each preset how many of an item's lines (id, line, flag) have one of the flags that the preset (preset, flag) bans.

    Presets are rows that somebody writes by hand, so they go to every task; every item has a row for every preset, with 0 where nothing is banned.
    """
    hits = flags.join(F.broadcast(presets), "flag").select("preset", "id", "line").distinct().groupBy("preset", "id").agg(F.count("*").alias("blockers"))
    every = flags.select("id").distinct().withColumn("preset", F.explode(F.array(*(F.lit(r[0]) for r in presets.select("preset").distinct().collect()))))
    return every.join(hits, ["preset", "id"], "left").select("preset", "id", F.coalesce("blockers", F.lit(0)).alias("blockers"))

"""Trees given as (slug, parent): closures and the expansions of what one has or avoids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import staged


def ancestors(taxonomy: DataFrame) -> DataFrame:
    """(slug, ancestor, depth): everything above a slug at whatever depth, each once, at its smallest depth; a slug on a cycle is above itself.

    Path doubling: with all pairs up to d steps known, those of exactly d steps joined with all give those up to 2 d, each in one way. Rounds are
    written, so there are as many as the depth has binary digits, and a pair that is known already ends a cycle. Null slugs and parents are no edges.
    """
    known = staged(taxonomy.where("slug is not null and parent is not null").select("slug", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "edges")
    reach = 1
    while True:
        first = known.where(F.col("depth") == reach).select("slug", F.col("ancestor").alias("via"))
        then = known.select(F.col("slug").alias("via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        new = first.join(then, "via").groupBy("slug", "ancestor").agg(F.min("depth").alias("depth"))
        new = staged(new.join(known, ["slug", "ancestor"], "left_anti"), "pairs")
        if new.isEmpty():
            return known
        known, reach = known.unionByName(new), 2 * reach


def expand_have(given: DataFrame, taxonomy: DataFrame, staples: DataFrame) -> DataFrame:
    """What `given` (slug) covers: itself, all ancestors, direct children, and the staples; no siblings or grandchildren."""
    up = given.join(ancestors(taxonomy), "slug").select(F.col("ancestor").alias("slug"))
    down = taxonomy.join(given.select(F.col("slug").alias("parent")), "parent", "left_semi").select("slug")
    return given.select("slug").unionByName(up).unionByName(down).unionByName(staples.select("slug")).distinct()


def expand_avoid(given: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(slug, mode): given slugs and their direct children; of several modes the strictest (`hide` over `lower`)."""
    down = taxonomy.join(given.withColumnRenamed("slug", "parent"), "parent").select("slug", "mode")
    return given.select("slug", "mode").unionByName(down).groupBy("slug").agg(F.min("mode").alias("mode"))


def cycles(taxonomy: DataFrame) -> DataFrame:
    """Slugs that reach themselves."""
    return ancestors(taxonomy).where("slug = ancestor").select("slug")


def dimension(rows: DataFrame, key: str = "slug", parent: str = "parent") -> DataFrame:
    """The rows of a dimension with `reason` why one cannot be loaded: `no_key`, `duplicate_key` (all rows of the key), `unknown_parent`, `cycle`; null for good rows."""
    many = rows.groupBy(key).agg(F.count("*").alias("_many"))
    known = rows.where(F.col(key).isNotNull()).select(F.col(key).alias(parent), F.lit(True).alias("_known")).distinct()
    round_ = cycles(rows.select(F.col(key).alias("slug"), F.col(parent).alias("parent"))).select(F.col("slug").alias(key), F.lit(True).alias("_round"))
    met = rows.join(many, key, "left").join(known, parent, "left").join(round_, key, "left")
    reason = (
        F.when(F.col(key).isNull(), "no_key").when(F.col("_many") > 1, "duplicate_key").when(F.col(parent).isNotNull() & F.col("_known").isNull(), "unknown_parent").when(F.col("_round"), "cycle")
    )
    return met.select(*rows.columns, reason.alias("reason"))

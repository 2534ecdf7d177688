"""Mentions in sentences: spans of a vocabulary's entries, alternatives among neighbours, senses carried from one sentence to the next, and counts of vessels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .annotate import annotate

_KINDS = ("thing", "either", "cue", "open")


def mentions(rows: DataFrame, ident: str, sentences: str, vocabulary: DataFrame) -> DataFrame:
    """(id, sentence, at, end, key, kind, name, grp): what each sentence names, as spans of words.

    vocabulary: (key, kind, name) with kinds `thing` (names something), `either` (words that part alternatives, such as "or a"), `cue` (tells in which
    sense later open names are meant) and `open` (a name whose sense is told by the last cue before it in the record, its own name where there is none).
    Things that touch an `either` on both its sides are alternatives: they share `grp`, which counts groups in a sentence from 0; every other thing is a
    group of its own. Null and empty sentences name nothing; longest entries count.
    """
    known = vocabulary.select("key", F.concat_ws("|", "kind", "name").alias("tag"))
    texts = rows.select(F.col(ident).alias("id"), F.posexplode(sentences).alias("sentence", "text")).select(F.struct("id", "sentence").alias("place"), "text")
    hits = annotate(texts, "place", F.col("text"), known)
    hits = hits.select("place.id", "place.sentence", "at", (F.col("at") + F.col("n")).alias("end"), "key", F.substring_index("tag", "|", 1).alias("kind"), F.substring_index("tag", "|", -1).alias("name"))
    told = Window.partitionBy("id").orderBy("sentence", "at").rowsBetween(Window.unboundedPreceding, -1)
    cue = F.last(F.when(F.col("kind") == "cue", F.col("name")), ignorenulls=True).over(told)
    hits = hits.withColumn("cue", cue).withColumn("name", F.when(F.col("kind") == "open", F.coalesce("cue", "name")).otherwise(F.col("name")))
    order = Window.partitionBy("id", "sentence").orderBy("at")
    thing = F.col("kind").isin("thing", "open")
    before, two = (F.lag(F.struct("kind", "at", "end"), k).over(order) for k in (1, 2))
    hits = hits.withColumn("one", before).withColumn("two", two)
    joined = thing & (F.col("one.kind") == "either") & (F.col("one.end") == F.col("at")) & F.col("two.kind").isin("thing", "open") & (F.col("two.end") == F.col("one.at"))
    things = hits.withColumn("joined", F.coalesce(joined, F.lit(False))).where(thing)
    group = F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return things.select("id", "sentence", "at", "end", "key", "kind", "name", group.cast("int").alias("grp"))


def needed(found: DataFrame) -> DataFrame:
    """(id, sentence, grp, names): each group of alternatives once, names distinct and in order."""
    return found.groupBy("id", "sentence", "grp").agg(F.array_sort(F.collect_set("name")).alias("names"))


def without_tools(found: DataFrame, have: DataFrame) -> DataFrame:
    """(id, lacking): how many groups of a record hold nothing that is at hand (name)."""
    met = found.join(have.select("name", F.lit(True).alias("held")).distinct(), "name", "left")
    groups = met.groupBy("id", "sentence", "grp").agg(F.count("held").alias("held"))
    return groups.groupBy("id").agg(F.count_if(F.col("held") == 0).alias("lacking"))


def vessels(found: DataFrame, kinds: DataFrame, more: DataFrame) -> DataFrame:
    """(id, vessels): how many different vessels a record needs.

    kinds: (name, family); a name that is its own family is generic. Specific names count once each; a generic one counts only where no specific one of
    its family is named, since it then means that one. more: (id, sentence, at) of words for another one of a kind ("a second ..."): a mention that
    begins right behind adds a vessel. Names without a family are no vessels.
    """
    named = found.join(kinds, "name")
    family = named.groupBy("id", "family").agg(F.count_distinct(F.when(F.col("name") != F.col("family"), F.col("name"))).alias("specific"))
    base = family.groupBy("id").agg(F.sum(F.greatest("specific", F.lit(1))).alias("base"))
    extra = named.join(more.select("id", "sentence", (F.col("at") + 1).alias("at")).distinct(), ["id", "sentence", "at"], "left_semi").groupBy("id").agg(F.count("*").alias("extra"))
    return base.join(extra, "id", "left").select("id", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("vessels"))

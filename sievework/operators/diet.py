"""Diet decisions: which lines of an item offend a preset, what could stand in for them, and what the item is then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .annotate import annotate

# The flags that each preset bans.
BANNED = {"vegetarian": ("meat", "fish"), "vegan": ("meat", "fish", "dairy", "egg", "honey"), "gluten_free": ("gluten",), "no_nuts": ("nuts",)}
# Words that name a flag where no entry of the taxonomy does, words that take it back, and words that allow a line to be left out.
WORDS = {"meat": "beef|pork|chicken|lamb|bacon|ham|turkey|meat", "fish": "fish|salmon|tuna|shrimp|prawns?|anchov(?:y|ies)", "dairy": "milk|cheese|butter|cream|yogurt", "egg": "eggs?", "gluten": "flour|bread|pasta", "nuts": "nuts?|almonds?|walnuts?", "honey": "honey"}
NOT_REALLY = "vegan|vegetarian|meatless|plant[- ]based|dairy[- ]free|gluten[- ]free|(?:coconut|almond|oat|soy) (?:milk|cream|yogurt)"
OMIT = r"\b(?:optional|omit|leave out|if (?:you )?(?:like|want|desired)|to serve|for garnish)\b"
NEGATED = r"\b(?:not|never|don't|do not|no)\b"
# Dishes that a stand-in may be made for, by words of title and steps.
CONTEXTS = {"bake": "bake|cake|bread|cookies?|muffins?", "fry": "fry|fried|saute", "raw": "salad|raw|dip", "soup": "soup|stew|broth", "sauce": "sauce|gravy|dressing"}


def word(text: Column, words: str) -> Column:
    return F.coalesce(F.lower(text).rlike(rf"(?<![\p{{L}}\d])(?:{words})(?![\p{{L}}\d])"), F.lit(False))


def item_flags(known: Column, name: Column) -> Column:
    """The taxonomy's flags of an entry; where it has none, those that words of the name tell, unless another word takes them back."""
    told = F.array_compact(F.array(*(F.when(word(name, w), F.lit(flag)) for flag, w in WORDS.items())))
    return F.coalesce(known, F.when(word(name, NOT_REALLY), F.array().cast("array<string>")).otherwise(told))


def written_alternatives(note: Column) -> Column:
    """The stand-ins that a note names: `or x`, `use x instead`, part by part; a negated part names none."""
    parts = F.filter(F.split(F.coalesce(F.lower(note), F.lit("")), ";"), lambda p: ~p.rlike(NEGATED))
    named = F.transform(parts, lambda p: F.trim(F.regexp_extract(p, r"(?:\bor|\buse|\bsubstitute)\s+([\p{L} -]+?)(?:\s+instead)?\s*$", 1)))
    return F.filter(named, lambda x: x != "")


def contexts(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(word(text, w), F.lit(name)) for name, w in CONTEXTS.items())))


def may_omit(note: Column) -> Column:
    return F.coalesce(F.lower(note).rlike(OMIT), F.lit(False))


def best_stand_in(lines: DataFrame, closure: DataFrame, stand_ins: DataFrame, banned: tuple[str, ...]) -> DataFrame:
    """(id, line, stand_in): of the substitutions for a line's entry or an entry above it the best that is allowed.

    lines: (id, line, slug, fits array); closure: (slug, above, depth), each slug above itself at depth 0; stand_ins: (target, stand_in, quality,
    flags array, only array). It needs quality 2, none of the banned flags, one of its contexts where it names some, and must not be the entry itself;
    order: quality, depth, whether it names contexts, name.
    """
    found = lines.join(closure, "slug").join(stand_ins, F.col("above") == F.col("target"))
    fit = (F.size("only") == 0) | F.arrays_overlap("only", "fits")
    allowed = (F.col("quality") >= 2) & ~F.arrays_overlap("flags", F.array(*map(F.lit, banned))) & fit & (F.col("stand_in") != F.col("slug"))
    order = F.struct(-F.col("quality"), "depth", (F.size("only") == 0).alias("plain"), "stand_in")
    return found.where(allowed).groupBy("id", "line").agg(F.min_by("stand_in", order).alias("stand_in"))


def decide(lines: DataFrame, swaps: DataFrame, banned: tuple[str, ...]) -> DataFrame:
    """(id, status, blockers, swapped): lines are (id, line, slug, flags array, written array of flag arrays, omit); swaps (id, line, stand_in).

    A line that offends is met by a written alternative that does not, else by a stand-in, else by being left out. An item is `unknown` if no line of
    it can be read, `no` if a line is not met, `adaptable` if one had to be, else `ok`.
    """
    ban = F.array(*map(F.lit, banned))
    offends = F.coalesce(F.arrays_overlap("flags", ban), F.lit(False))
    written = F.exists("written", lambda f: ~F.arrays_overlap(f, ban))
    met = F.coalesce(written, F.lit(False)) | F.col("stand_in").isNotNull() | F.col("omit")
    rows = lines.join(swaps, ["id", "line"], "left").select("id", "slug", (offends & ~met).alias("blocked"), (offends & met).alias("swapped"))
    out = rows.groupBy("id").agg(F.count_if("blocked").alias("blockers"), F.count_if("swapped").alias("swapped"), F.count("slug").alias("read"))
    status = F.when(F.col("read") == 0, "unknown").when(F.col("blockers") > 0, "no").when(F.col("swapped") > 0, "adaptable").otherwise("ok")
    return out.select("id", status.alias("status"), "blockers", "swapped")


def unlisted(rows: DataFrame, ident: str, items: str, steps: str, vocabulary: DataFrame, reach: int = 3) -> DataFrame:
    """(ident, slug): foods that a sentence of the steps puts in and no item names; null arrays are empty.

    vocabulary: (key, kind, slug) with kinds `adding` (what puts something in), `aside` (what makes a sentence speak of something else) and `food`. A
    food is put in where the entry before it in its sentence is an adding one at most `reach` words away. Since the longest entries count, products of
    a food (its broth) are told from it by entries of their own.
    """
    known = vocabulary.select("key", F.concat_ws(":", "kind", F.coalesce("slug", F.lit(""))).alias("tag"))
    none = F.array().cast("array<string>")
    texts = rows.select(F.col(ident).alias("id"), F.posexplode(F.flatten(F.transform(F.coalesce(steps, none), lambda s: F.split(F.coalesce(s, F.lit("")), r"(?<=[.!?])\s+")))).alias("at", "sentence"))
    texts = texts.select(F.struct("id", F.col("at").alias("sentence_at")).alias("place"), "sentence")
    hits = annotate(texts, "place", F.col("sentence"), known).select("place", "at", "n", F.substring_index("tag", ":", 1).alias("kind"), F.substring_index("tag", ":", -1).alias("slug"))
    order, whole = Window.partitionBy("place").orderBy("at"), Window.partitionBy("place")
    before = F.lag(F.struct("kind", (F.col("at") + F.col("n")).alias("end"))).over(order)
    told = hits.withColumn("before", before).withColumn("aside", F.max(F.col("kind") == "aside").over(whole))
    put = told.where("kind = 'food' and not aside and before.kind = 'adding'").where(F.col("at") - F.col("before.end") <= reach)
    lines = rows.select(F.col(ident).alias("id"), F.posexplode(F.coalesce(items, none)).alias("at", "line")).select(F.struct("id", F.col("at").alias("line_at")).alias("place"), "line")
    named = annotate(lines, "place", F.col("line"), known).select("place.id", F.substring_index("tag", ":", -1).alias("slug"))
    return put.select("place.id", "slug").distinct().join(named, ["id", "slug"], "left_anti").select(F.col("id").alias(ident), "slug")

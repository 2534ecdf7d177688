"""What a record's steps, yield, title and items tell of its equipment, servings and course. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tagging import TOOLS, VESSELS, has_word
from .text import normalise, sentences, words

# Sentence classes, words for heat, and actions that imply a device that no sentence names.
SKIPPED = r"\b(?:optional|skip this|if desired)\b"
OTHERWISE = r"\b(?:alternatively|or use|instead of|as an alternative)\b"
LACKING = r"\b(?:don't have|do not have|without an?|no) (?:oven|grill|blender|microwave|slow cooker|mixer)\b"
HEAT = "bake[ds]?|boil(?:ed|s)?|fry|fried|roast(?:ed|s)?|simmer(?:ed|s)?|grill(?:ed|s)?|toast(?:ed|s)?|heat(?:ed|s)?|oven|stove|microwave|steam(?:ed|s)?|saute"
IMPLIED = (("oven", r"\b(?:bake|roast) (?:for|until|at)\b|\b\d{3} ?(?:degrees|°)"), ("hob", r"\bbring to (?:a|the) boil\b|\bover (?:low|medium|high) heat\b"), ("blender", r"\bpuree\b|\buntil smooth\b"))
# Pieces a person eats of counted yields, and a serving in cups.
PER_SERVING = {"cookies": 2, "muffins": 1, "rolls": 1, "pancakes": 3, "slices": 1, "sandwiches": 1, "pieces": 2, "tacos": 2}
CUPS_A_SERVING = 1.0
# Words that say nothing of a course, what ends a title's head phrase, and names of courses.
NOISE = ("easy", "best", "quick", "simple", "homemade", "classic", "perfect", "my", "the", "a", "recipe")
HEAD_END = r"(?i)\s+(?:with|in|on|from|for|by|and served)\s+|[,(:–]| - "
COURSES = (("dessert", "cake|pie|cookies?|brownies?|ice cream|pudding|tart"), ("drink", "smoothie|cocktail|tea|coffee|lemonade|punch"), ("soup", "soup|stew|chowder|broth"), ("salad", "salad|slaw"), ("bread", "bread|rolls?|buns?|loaf"), ("sauce", "sauce|dressing|dip|gravy"), ("breakfast", "pancakes?|waffles?|omelette|granola"), ("side", "fries|mash|pilaf"))


def steps_status(steps: Column, least: int = 8) -> Column:
    """`no_steps`, `too_short` (under `least` words) or `ok`."""
    n = F.size(words(normalise(F.array_join(steps, " "))))
    return F.when(F.coalesce(F.size(steps), F.lit(0)) < 1, "no_steps").when(n < least, "too_short").otherwise("ok")


def sentence_class(sentence: Column) -> Column:
    """`lacking`, `alternative`, `skip` or `plain`: only plain sentences make a device necessary."""
    low = F.lower(sentence)
    return F.when(low.rlike(LACKING), "lacking").when(low.rlike(OTHERWISE), "alternative").when(low.rlike(SKIPPED), "skip").otherwise("plain")


def devices(text: Column) -> Column:
    """The devices that plain sentences name; where none does, those that their actions imply."""
    plain = F.filter(sentences(text), lambda s: sentence_class(s) == "plain")

    def found(rules, test) -> Column:
        holds = lambda w: F.exists(plain, lambda s: test(s, w))
        return F.array_compact(F.array(*(F.when(holds(w), F.lit(n)) for n, w in rules)))

    told = found(TOOLS, has_word)
    return F.when(F.size(told) > 0, told).otherwise(found(IMPLIED, lambda s, w: F.lower(s).rlike(w)))


def no_cook(text: Column) -> Column:
    return ~has_word(text, HEAT)


def vessel_kinds(text: Column) -> Column:
    """The distinct vessels of a text: a general word (`pot`, `pan`, `dish`) merges with a special one that ends or holds it."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({VESSELS}|pan|dish)s?\b"), F.lit(1)))
    special = lambda v: F.exists(found, lambda o: (o != v) & o.contains(v))
    return F.filter(found, lambda v: ~(v.isin("pot", "pan", "dish") & special(v)))


def sheet_pan_meal(text: Column, course: Column) -> Column:
    """One vessel, a flat one, an oven, and a course that is a meal."""
    kinds = vessel_kinds(text)
    return (F.size(kinds) == 1) & F.get(kinds, F.lit(0)).isin("sheet pan", "baking tray") & F.array_contains(devices(text), "oven") & course.isin("main", "side")


def counted_yield(text: Column) -> Column:
    """Servings of a yield such as `24 cookies`, by pieces a serving; null for others."""
    low = F.lower(text)
    out = F.lit(None).cast("double")
    for piece, each in PER_SERVING.items():
        stem = piece[:-2] if piece.endswith("hes") else piece[:-1]
        n = F.nullif(F.regexp_extract(low, rf"(\d{{1,4}})(?:\s*-\s*\d+)?\s+(?:[a-z]+ )?{stem}(?:e?s)?\b", 1), F.lit("")).cast("double")
        out = F.coalesce(out, F.when(n.isNotNull(), F.greatest(F.lit(1.0), F.floor(n / each + 0.5).cast("double"))))
    return out


def volume_yield(text: Column) -> Column:
    """Servings of a yield in cups, quarts, pints, litres or millilitres."""
    low = F.lower(text)
    out = F.lit(None).cast("double")
    for unit, cups in (("cups?", 1.0), ("quarts?|qt", 4.0), ("pints?", 2.0), ("lit(?:er|re)s?|l", 4.2), ("ml", 0.0042)):
        n = F.nullif(F.regexp_extract(low, rf"(\d+(?:\.\d+)?)\s*(?:{unit})\b", 1), F.lit("")).cast("double")
        out = F.coalesce(out, F.when(n.isNotNull(), F.greatest(F.lit(1.0), F.floor(n * cups / CUPS_A_SERVING + 0.5).cast("double"))))
    return out


def portions(lines: Column) -> Column:
    """The largest count of whole portions (`4 chicken breasts`) among the lines."""
    found = F.transform(lines, lambda x: F.nullif(F.regexp_extract(F.lower(x), r"^\s*(\d{1,2})\s+(?:[a-z]+ ){0,3}(?:breasts?|fillets?|steaks?|chops?|burger buns|tortillas)\b", 1), F.lit("")).cast("double"))
    return F.array_max(F.array_compact(found))


def servings(tiers: list[tuple[str, Column]], prior: Column, spread: float = 2.0) -> Column:
    """(servings, tier): the first tier that knows; one beyond `spread` times the course's prior is drawn back by that factor; 1 to 100."""
    value = F.coalesce(*(v.cast("double") for _, v in tiers), prior.cast("double"))
    tier = F.coalesce(*(F.when(v.isNotNull(), F.lit(n)) for n, v in tiers), F.lit("prior"))
    drawn = F.when(value > prior * spread, value / spread).when(value < prior / spread, value * spread).otherwise(value)
    return F.struct(F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.floor(drawn + 0.5).cast("double"))).alias("servings"), tier.alias("tier"))


def by_amount(total: Column, each: Column) -> Column:
    """Servings from an item's energy or mass and what a serving of its course has."""
    return F.when((total > 0) & (each > 0), total / each)


def head_phrase(title: Column) -> Column:
    """A title up to what introduces an addition, without words that say nothing."""
    head = F.get(F.split(F.coalesce(title, F.lit("")), HEAD_END), F.lit(0))
    return F.array_join(F.filter(words(normalise(head)), lambda w: ~w.isin(*NOISE)), " ")


def course_by_name(text: Column) -> Column:
    """The course whose name stands last in a phrase; the longer name of equal places."""
    low = F.lower(text)
    at = [F.struct(F.length(F.regexp_extract(low, rf"^(.*)\b(?:{w})\b", 1)).alias("at"), F.lit(n).alias("course"), low.rlike(rf"\b(?:{w})\b").alias("there")) for n, w in COURSES]
    return F.array_max(F.transform(F.filter(F.array(*at), lambda x: x.there), lambda x: F.struct(x["at"].alias("at"), x["course"].alias("course")))).course


def course_by_maps(labels: Column, maps: dict[str, tuple[int, str]]) -> Column:
    """Of the labels that a map knows the course of the smallest priority."""
    held = F.create_map(*(F.lit(v) for k, (p, c) in maps.items() for v in (k, f"{p:04d}{c}")))
    return F.substring(F.array_min(F.array_compact(F.transform(labels, lambda x: held[F.lower(x)]))), 5, 100)


def course_by_items(protein: Column, sweet: Column, savoury: Column, alcohol: Column, items: Column) -> Column:
    """The course that counts of kinds of items suggest where no name tells it."""
    return F.when((alcohol > 0) & (items <= 6), "drink").when((sweet >= 2) & (protein == 0) & (savoury == 0), "dessert").when(protein > 0, "main").when(savoury > 0, "side")


def title_mentions(title: Column, slugs: Column, known: Column) -> Column:
    """Entries (of `known`) that a title names by their first five letters and no item has: the core that a record lacks."""
    stem = lambda x: F.substring(x, 1, 5)
    held = F.transform(F.flatten(F.transform(slugs, lambda s: F.split(normalise(s), " "))), stem)
    named = F.transform(words(normalise(title)), stem)
    return F.filter(known, lambda k: F.array_contains(named, stem(k)) & ~F.array_contains(held, stem(k)))


def annotate(tokens: Column, entries: Column, longest: int = 8) -> Column:
    """(at, gram): entries in a list of tokens from left to right, at each place the longest, none overlapping."""
    gram = lambda i, n: F.array_join(F.slice(tokens, i, n), " ")

    def longest_at(i: Column) -> Column:
        fits = F.transform(F.sequence(F.lit(longest), F.lit(1), F.lit(-1)), lambda n: F.when((i + n - 1 <= F.size(tokens)) & F.array_contains(entries, gram(i, n)), n))
        return F.coalesce(F.get(F.array_compact(fits), F.lit(0)), F.lit(0))

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<at:int,gram:string>>").alias("found"))

    def step(held: Column, i: Column) -> Column:
        n = longest_at(i)
        taken = (i >= held["next"]) & (n > 0)
        return F.struct(F.when(taken, i + n).otherwise(held["next"]).alias("next"), F.when(taken, F.concat(held["found"], F.array(F.struct((i - 1).alias("at"), gram(i, n).alias("gram"))))).otherwise(held["found"]).alias("found"))

    return F.when(F.size(tokens) > 0, F.aggregate(F.sequence(F.lit(1), F.size(tokens)), start, step)["found"]).otherwise(start["found"])

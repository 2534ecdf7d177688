"""Tags read from sentences: tools with alternatives, vessels, times, servings. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sentences

# Tools and the words that name them.
TOOLS = (("oven", "oven|bake[ds]?|roast(?:ed|s)?"), ("hob", "hob|stove|simmer(?:ed|s)?|boil(?:ed|s)?|fry"), ("grill", "grill(?:ed|s)?|broil(?:ed|s)?"), ("blender", "blender|blend(?:ed|s)?"), ("microwave", "microwaved?"), ("slow cooker", "slow cooker|crock-?pot"))
# Vessels.
VESSELS = "saucepan|skillet|frying pan|pot|wok|casserole|baking dish|baking tray|sheet pan|bowl"
# What marks a sentence as skippable, and passive time.
SKIP = r"\b(optional|if you (?:don't|do not) have|or skip)\b"
PASSIVE = r"\b(chill|rest|marinate|soak|refrigerate|overnight|leave|rise|cool)"


def has_word(text: Column, words: str) -> Column:
    return F.lower(text).rlike(rf"(?<![\p{{L}}\d])(?:{words})(?![\p{{L}}\d])")


def tools_needed(text: Column) -> Column:
    """(tool, grp) of every sentence that is not skippable: tools joined by `or` in one sentence share its group, the others stand alone."""
    kept = F.filter(sentences(text), lambda s: ~F.lower(s).rlike(SKIP))

    def of(sentence: Column, at: Column) -> Column:
        found = F.array_compact(F.array(*(F.when(has_word(sentence, words), F.lit(name)) for name, words in TOOLS)))
        either = (F.size(found) > 1) & has_word(sentence, "or")
        return F.transform(found, lambda t, i: F.struct(t.alias("tool"), F.when(either, at * 100).otherwise(at * 100 + i).alias("grp")))

    return F.array_distinct(F.flatten(F.transform(kept, of)))


def vessels(text: Column) -> Column:
    """The distinct vessels a text names; one of them makes it a one-pot text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({VESSELS})s?\b"), F.lit(1)))


def minutes_in(text: Column, unit: str, factor: int) -> Column:
    """All durations of one unit in a text, as minutes; of a range the upper end."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?:\d+\s*(?:-|to)\s*)?(\d+)\s*(?:{unit})\b"), F.lit(1))
    return F.transform(found, lambda x: F.try_to_number(x, F.lit("999999")).cast("int") * factor)


def estimated_times(text: Column) -> Column:
    """(active, passive) minutes summed over sentences; passive where the sentence waits."""
    all_minutes = lambda s: F.aggregate(F.concat(minutes_in(s, "minutes?|mins?", 1), minutes_in(s, "hours?|hrs?", 60)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    add = lambda wanted: F.aggregate(F.filter(sentences(text), lambda s: F.lower(s).rlike(PASSIVE) == F.lit(wanted)), F.lit(0), lambda a, s: a + all_minutes(s))
    return F.struct(add(False).alias("active"), add(True).alias("passive"))


def total_minutes(total: Column, prep: Column, cook: Column, text: Column, cap: int = 2880) -> Column:
    """(minutes, origin): the source's total, else prep and cook, else what the text says, else whichever part is there; none beyond the cap."""
    said = estimated_times(text)
    est = F.when(said["active"] + said["passive"] > 0, said["active"] + said["passive"])
    part = F.coalesce(prep, cook)
    value = F.coalesce(total, prep + cook, est, part)
    origin = F.when(total.isNotNull(), "total").when((prep + cook).isNotNull(), "parts").when(est.isNotNull(), "text").when(part.isNotNull(), "part")
    good = (value > 0) & (value <= cap)
    return F.struct(F.when(good, value).alias("minutes"), F.when(good, origin).alias("origin"))


def head_count(yield_text: Column) -> Column:
    """People from a yield such as `Serves 4-6`: the low end, at most 100."""
    n = F.coalesce(F.nullif(F.regexp_extract(F.lower(yield_text), r"(?:serves|feeds|for|servings?:?)\s*(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(F.lower(yield_text), r"(\d+)(?:\s*(?:-|to)\s*\d+)?\s*(?:servings?|people|persons?|portions?)", 1), F.lit("")))
    value = F.try_to_number(n, F.lit("999999")).cast("int")
    return F.when((value >= 1) & (value <= 100), value)


def pan_area(text: Column) -> Column:
    """Square centimetres of the first pan size: `9x13 inch` or `20 cm round`."""
    scale = lambda unit: F.when(unit.startswith("in"), 2.54).otherwise(1.0)
    num = lambda c: F.nullif(c, F.lit("")).cast("double")
    rect, round_ = r"(\d+(?:\.\d+)?)\s*(?:x|by)\s*(\d+(?:\.\d+)?)[\s-]*(inch|in|cm)", r"(\d+(?:\.\d+)?)[\s-]*(inch|in|cm)[\s-]*round"
    low = F.lower(text)
    area = num(F.regexp_extract(low, rect, 1)) * num(F.regexp_extract(low, rect, 2)) * F.pow(scale(F.regexp_extract(low, rect, 3)), F.lit(2))
    disc = F.pi() * F.pow(num(F.regexp_extract(low, round_, 1)) * scale(F.regexp_extract(low, round_, 2)) / 2, F.lit(2))
    return F.coalesce(area, disc)

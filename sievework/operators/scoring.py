"""Quality terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shrunk_mean(total: Column, n: Column, prior: float, weight: float) -> Column:
    """The mean pulled to a prior that weighs as `weight` votes."""
    return (F.lit(prior) * weight + F.coalesce(total, F.lit(0.0))) / (F.coalesce(n, F.lit(0)) + weight)


def popularity(count: Column, full: int = 20) -> Column:
    return F.least(F.lit(1.0), F.log1p(count.cast("double")) / F.log1p(F.lit(float(full))))


def ramp(value: Column, *points: tuple[float, float]) -> Column:
    """Linear between (value, score) points, flat outside."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(value < x1, F.lit(float(y0)) + (value - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(value <= points[0][0], F.lit(float(points[0][1]))).otherwise(out)


def weighted(terms: dict[str, tuple[float, Column]]) -> Column:
    total = sum(w for w, _ in terms.values())
    out = F.lit(0.0)
    for w, term in terms.values():
        out = out + F.lit(w / total) * term
    return out


def longest_suffix(host: Column, priors: dict[str, float], default: float) -> Column:
    """The prior of the longest domain in `priors` that the host is, or lies under."""
    out = F.lit(default)
    for domain in sorted(priors, key=len):
        out = F.when((host == domain) | host.endswith("." + domain), F.lit(priors[domain])).otherwise(out)
    return out


# The weight of each quality term, and what multiplies a score that has a defect.
WEIGHTS = {"domain": 0.18, "lines": 0.15, "method": 0.17, "fresh": 0.10, "style": 0.10, "parse": 0.06, "qty": 0.05, "time": 0.02, "rating": 0.07, "pop": 0.05, "extras": 0.05}
MISSING_CORE, TRUNCATED, UNPARSED, READABLE = 0.5, 0.7, 0.8, 0.6
# Scores of short lists by their number of lines, and courses that are sweet or may be creamy.
SHORT_LISTS = {4: 0.15, 5: 0.3, 6: 0.45, 7: 0.65, 8: 0.85}
SWEET = ("dessert", "baking", "snack", "drink", "breakfast")
CREAMY = ("dessert", "baking", "drink", "breakfast")


def clip(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def lines_term(n: Column) -> Column:
    """Few lines say little, very many are no plain record."""
    out = F.when(n < min(SHORT_LISTS), 0.0)
    for k, score in SHORT_LISTS.items():
        out = out.when(n == k, score)
    return out.when(n <= 20, 1.0).when(n <= 30, 0.8).otherwise(0.5)


def method_term(chars: Column, longest: Column, steps: Column, fragments: Column, truncated: Column) -> Column:
    """A method's length from 150 characters (0) to 700 (1); a sliver below, half for walls of text and for short single steps."""
    slope = F.when(chars < 150, F.lit(0.1) * chars / F.lit(150.0)).otherwise(clip((chars - 150) / F.lit(550.0)))
    single = (F.coalesce(steps, F.lit(0)) - F.coalesce(fragments, F.lit(0)) <= 1) & (chars < 400)
    return F.when(F.coalesce(truncated, F.lit(False)) | (chars < 40), 0.0).when((longest > 2500) | (chars > 8000), 0.5).otherwise(F.when(single, slope * 0.5).otherwise(slope))


def freshness(fresh: Column, counted: Column, shortcuts: Column, lines: Column, course: Column) -> Column:
    """The share of fresh items against what is full for the course, less a penalty for shortcut lines, 0 at least; 0.5 where nothing is known."""
    share = F.coalesce(F.try_divide(fresh.cast("double"), counted.cast("double")), F.lit(0.0))
    base = F.when(course.isin(*SWEET), F.lit(0.5) + F.lit(0.5) * F.least(F.lit(1.0), share / F.lit(0.25))).otherwise(F.least(F.lit(1.0), share / F.lit(0.6)))
    less = F.when(lines > 0, F.lit(0.8) * F.least(F.lit(1.0), F.coalesce(shortcuts, F.lit(0)) / lines.cast("double"))).otherwise(0.0)
    return F.when(counted.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), base - less))


def style_term(markers: Column, rich: Column, lines: Column, course: Column) -> Column:
    """1 less 0.5 a marker: sweet markers do not count in sweet courses, a rich base does outside the creamy ones."""
    own = F.size(F.filter(F.coalesce(markers, F.array().cast("array<string>")), lambda m: (m != "marshmallow") | ~F.coalesce(course.isin(*SWEET), F.lit(True))))
    base = ~F.coalesce(course.isin(*CREAMY), F.lit(False)) & ((rich >= 2) | ((rich >= 1) & (lines > 0) & (lines <= 4)))
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.5) * (own + F.coalesce(base, F.lit(False)).cast("int")))


def quality_score(terms: dict[str, Column], missing_core: Column, truncated: Column, readable: Column, without: tuple[str, ...] = ()) -> Column:
    """The weighted mean of the terms, times a factor for each defect."""
    held = {k: w for k, w in WEIGHTS.items() if k not in without}
    total = F.lit(0.0)
    for name, weight in held.items():
        total = total + F.lit(weight) * terms[name]
    out = total / F.lit(sum(held.values()))
    for holds, factor in ((missing_core, MISSING_CORE), (truncated, TRUNCATED), (readable < READABLE, UNPARSED)):
        out = out * F.when(F.coalesce(holds, F.lit(False)), factor).otherwise(1.0)
    return out

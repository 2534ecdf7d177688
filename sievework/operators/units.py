"""Quantities: units and their dimensions, conversion, rounding for shops and for print."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit, dimension, factor to the base unit (ml, g, piece).
UNITS = (
    ("ml", "volume", 1.0), ("l", "volume", 1000.0), ("tsp", "volume", 4.92892), ("tbsp", "volume", 14.7868), ("cup", "volume", 236.588), ("fl oz", "volume", 29.5735),
    ("g", "mass", 1.0), ("kg", "mass", 1000.0), ("oz", "mass", 28.3495), ("lb", "mass", 453.592), ("piece", "count", 1.0), ("dozen", "count", 12.0),
)
# Fractions that amounts are printed with.
FRACTIONS = ((0.0, ""), (0.125, "1/8"), (0.25, "1/4"), (1 / 3, "1/3"), (0.375, "3/8"), (0.5, "1/2"), (0.625, "5/8"), (2 / 3, "2/3"), (0.75, "3/4"), (0.875, "7/8"), (1.0, "1"))


def factor(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, _, f in UNITS:
        out = F.when(unit == name, F.lit(f)).otherwise(out)
    return out


def dimension(unit: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind, _ in UNITS:
        out = F.when(unit == name, F.lit(kind)).otherwise(out)
    return out


def grams(qty: Column, unit: Column, density: Column, each_g: Column) -> Column:
    """Mass is direct, volume needs a density, pieces a weight each; null where that is unknown."""
    base = qty * factor(unit)
    kind = dimension(unit)
    return F.when(kind == "mass", base).when(kind == "volume", base * density).when(kind == "count", base * each_g)


def shop_count(amount: Column, package: Column, slack: float = 0.05) -> Column:
    """Packages to buy: up to the next whole one, but a small overhang does not open another."""
    return F.greatest(F.lit(1), F.ceil(amount / package - F.lit(slack))).cast("long")


def step_up(g: Column) -> Column:
    """Grams rounded up to steps of 10 below 100, 50 below 1000, and 100 beyond."""
    step = F.when(g < 100, 10).when(g < 1000, 50).otherwise(100)
    return (F.ceil(g / step) * step).cast("long")


def as_fraction(value: Column) -> Column:
    """Whole part and nearest of the printed fractions: 1.5 is `1 1/2`; ties go to the smaller."""
    whole = F.floor(value)
    rest = value - whole
    best, label = F.lit(9.0), F.lit("")
    for x, name in FRACTIONS:
        gap = F.abs(rest - F.lit(x))
        label = F.when(gap < best, F.lit(name)).otherwise(label)
        best = F.least(best, gap)
    up = whole + F.when(label == "1", 1).otherwise(0)
    text = F.concat_ws(" ", F.when(up > 0, up.cast("string")), F.when(~label.isin("", "1"), label))
    return F.when(text == "", F.lit("0")).otherwise(text)


def soften(value: Column, prior: Column, zone: float) -> Column:
    """The prior where the value lies within a factor `zone` of it; else the value, moved towards it by that factor."""
    return F.when(value > prior * zone, value / zone).when(value < prior / zone, value * zone).otherwise(prior)

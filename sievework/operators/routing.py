"""Routing records: every row is kept or has one audited reason, and both add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that holds, or null; a check that is null does not hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def flags(*checks: tuple[str, Column]) -> Column:
    """All names of checks that hold, in order."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in checks)))


def ledger(routed: DataFrame, source: str, order: str, example: str) -> DataFrame:
    """(source, reason, n, example): how many rows each reason took, with the first example."""
    return routed.where("reason is not null").groupBy(source, "reason").agg(F.count("*").alias("n"), F.min_by(example, order).alias("example"))


def mark_duplicates(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds `nth`: 1 for the first row of each key in order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def coerce(value: Column, allowed: list[str]) -> Column:
    """The value, or null where it is not an allowed one."""
    return F.when(value.isin(allowed), value)

"""Sinks: several tables from one derived frame, JSON lines, and checks of what was written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tables(derived: DataFrame, tables: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> None:
    """Writes the derived rows once, then each table as a selection of them; a table's folder is replaced as a whole."""
    derived.write.mode("overwrite").parquet(f"{path}/_derived")
    rows = derived.sparkSession.read.schema(derived.schema).parquet(f"{path}/_derived")
    for name, select in tables.items():
        select(rows).write.mode("overwrite").parquet(f"{path}/{name}")


def write_json_lines(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "true")
    (writer.partitionBy(by) if by else writer).json(path)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def out_of_list(value: Column, allowed: list[str]) -> Column:
    return value.isNotNull() & ~value.isin(allowed)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df in the shared folder and reads it back: what several steps read is made once and survives lost executors."""
    from ..streaming.ingest import working_dir

    path = f"{working_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

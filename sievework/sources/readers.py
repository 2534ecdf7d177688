"""Readers of raw records: every line is kept with its source and order, and what cannot be read has a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A raw record; optional fields may be left out of a line.
RAW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "source", "source_url", "title")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("ingredients", "steps")]
    + [T.StructField(n, T.StringType()) for n in ("cuisine_label", "category")]
    + [T.StructField("rating", T.DoubleType()), T.StructField("rating_count", T.LongType())]
    + [T.StructField(n, T.IntegerType()) for n in ("total_time_min", "prep_time_min", "cook_time_min")]
    + [T.StructField(n, T.StringType()) for n in ("yield_text", "image_url")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("video_url", T.StringType())]
)


def source_of(path: Column) -> Column:
    """The folder that holds the file."""
    return F.element_at(F.split(path, "/"), -2)


def read_records(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """(source, file, line_id, raw, record, bad): JSON lines, of which malformed ones stay as `bad`.

    line_id grows with the lines of a file; ids are neither dense nor equal
    across runs with other splits, so only their order means anything.
    """
    checked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    parsed = lines.where(F.trim("raw") != "").withColumn("record", F.from_json("raw", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.select(source_of(F.col("file")).alias("source"), "file", F.monotonically_increasing_id().alias("line_id"), "raw", F.col("record").dropFields("_bad").alias("record"), (F.col("record").isNull() | F.col("record._bad").isNotNull()).alias("bad"))


def read_csv(spark: SparkSession, path: str, schema: str, arrays: list[str], sep: str = ",") -> DataFrame:
    """CSV or TSV with a header and quoted line ends; the columns in `arrays` hold JSON arrays of strings."""
    rows = spark.read.schema(schema).csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True)
    return rows.withColumns({c: F.from_json(c, "array<string>") for c in arrays})


def vector_literal(text: Column) -> Column:
    r"""`c("a", "b")` as an array; `NA` and empty are an empty one; without quotes, commas part the items."""
    quoted = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = F.filter(F.transform(F.split(F.regexp_replace(text, r"^c\(|\)$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | F.trim(text).isin("", "NA", "character(0)"), empty).when(F.size(quoted) > 0, F.transform(quoted, lambda x: F.regexp_replace(x, r'\\(.)', "$1"))).otherwise(plain)


def wide_pairs(row: str, names: list[str], values: list[str]) -> Column:
    """Numbered columns (name1, value1, name2, ...) as an array of `value name`, without empty names."""
    pairs = F.array(*(F.struct(F.trim(F.coalesce(v, F.lit(""))).alias("v"), F.trim(F.coalesce(n, F.lit(""))).alias("n")) for n, v in zip(names, values, strict=True)))
    return F.transform(F.filter(pairs, lambda p: p.n != ""), lambda p: F.trim(F.concat_ws(" ", p.v, p.n))).alias(row)


def zip_equal(first: Column, second: Column) -> Column:
    """`first second` item by item where both are equally long, else `second`."""
    return F.when(F.size(first) == F.size(second), F.zip_with(first, second, lambda a, b: F.trim(F.concat_ws(" ", a, b)))).otherwise(second)


def json_ld(html: Column, kind: str = "Recipe") -> Column:
    """The first object of a type in a page's JSON-LD blocks, as JSON text; lists and `@graph` are looked into, broken blocks passed over."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type=["\']?application/ld\+json["\']?[^>]*>(.*?)</script>'), F.lit(1))

    def objects(block: Column) -> Column:
        value = F.try_parse_json(block)
        text = F.when(value.isNotNull(), block)
        several = F.from_json(F.coalesce(F.get_json_object(text, "$['@graph']"), F.when(F.ltrim(text).startswith("["), text)), "array<string>")
        return F.coalesce(several, F.when(text.isNotNull(), F.array(text)), F.array().cast("array<string>"))

    type_of = lambda o: F.coalesce(F.get_json_object(o, "$['@type']"), F.lit(""))
    found = F.filter(F.flatten(F.transform(blocks, objects)), lambda o: (type_of(o) == kind) | type_of(o).contains(f'"{kind}"'))
    return F.get(found, F.lit(0))

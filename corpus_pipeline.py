"""A corpus from raw documents: language ID, line dedup, near-duplicate join, decontamination, packing.

Every stage works on all that the one before has kept, and its decisions take
effect: what it rejects or cuts is gone for the next. All stages but the last
return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import materialize
from sievework.llm.decontamination import without_leaks
from sievework.llm.language_id import fit, label_languages
from sievework.llm.line_dedup import remove_repeated_lines
from sievework.llm.ngram_join import jaccard_components
from sievework.llm.packing import pack_documents

#: The least share of a text's letters that its main language must have.
MAIN_SHARE = 0.4
#: The least words of a repeated run of one or two lines that is deleted.
RUN_WORDS = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts without a main language; fills in a missing lang."""
    labelled = label_languages(docs, fit(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= MAIN_SHARE))
    filled = {"lang": F.coalesce("row.lang", "lang_pred")}
    return labelled.select(*(filled.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines that stood before: three lines or more, RUN_WORDS words or more, or a whole short text; texts of which nothing is left go."""
    return remove_repeated_lines(docs, words=RUN_WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of documents that share 0.8 of their five-word shingles: that of the smallest doc_id, null last.

    Copies of one text under one doc_id stay together; of equal texts without a doc_id one stays. Texts without words all stay.
    """
    rows = jaccard_components(docs, 5, (80, 100), keyed=True)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "own")
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(place).alias("first")).select("first.doc_id", "first.own", F.lit(True).alias("linked"))
    kept = first.unionByName(rows.where("comp is null").select("doc_id", "own", F.lit(False).alias("linked")).distinct())
    kept = kept.select(F.col("doc_id").alias("kept"), "own", "linked")
    same = docs.doc_id.eqNullSafe(kept.kept) & (F.xxhash64(docs.text) == kept.own)
    if docs.where("doc_id is null").isEmpty():
        return docs.join(kept, same, "left_semi")
    named = docs.join(kept.where("kept is not null or not linked"), same, "left_semi")
    unnamed = docs.join(kept.where("kept is null and linked"), same, "left_semi")
    return named.unionByName(unnamed.dropDuplicates(["text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, plainly or with other names and numbers."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 ids; one row a piece."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Language ID fits a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

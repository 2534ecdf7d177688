"""A stored full-text index: lists of the rows that hold a folded, stemmed term, with its positions there, in folders by a hash of the term.

Lists are made and stored for a load of texts at a time, so a task holds one load. It is built once and searched many times: a search reads only its terms' folders
(partition pruning), and in them only the row groups that hold the terms, since
files are sorted by term. A term of very many rows is dealt over several files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

BUCKETS, SPREAD = 64, 4
# Bytes of texts whose postings a task makes at once, and words whose stems it remembers.
LOAD, KNOWN = 1 << 24, 200_000
# The suffix rules of steps 2 to 4 of Porter's stemmer (Program, 1980).
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_SOUNDS = re.compile(r"c*(v+c+)*v*")


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; a y after a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    """How many times a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str], least: int) -> str:
    for n in range(min(len(word), 7), 0, -1):
        if (end := word[-n:]) in rules:
            return word[:-n] + rules[end] if _measure(word[:-n]) > least else word
    return word


def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of two letters and less, and words with other signs than a to z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif word.endswith("ed"):
        cut = word[:-2]
    elif word.endswith("ing"):
        cut = word[:-3]
    if cut is not None and "v" in _shape(cut):
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2, 0), _STEP3, 0)
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            if _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
                word = word[: -len(end)]
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or m == 1 and not _short(word[:-1]) else word
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _loads(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts, none empty, of like bytes: `most` and one text at most."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    if len(ends):
        n = -(-int(ends[-1]) // most)
        cuts = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, n + 1) // n) + 1).tolist()
        yield from zip([0, *cuts[:-1]], cuts)


def _lists(most: int = LOAD):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}  # words are stemmed once
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.not_equal(batch.column("text"), ""), False))
            for at, end in _loads(batch.column("text"), most):
                ids, held = batch.column("id").slice(at, end - at), pc.split_pattern(batch.column("text").slice(at, end - at), " ")
                sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words = held.flatten().dictionary_encode()
                if len(known) > KNOWN:
                    known.clear()
                stems = pa.array([known[w] if w in known else known.setdefault(w, stem(w)) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key = stems.indices.to_numpy().astype(np.int64)[words.indices.to_numpy()] * len(sizes) + np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(key, kind="stable")
                key = key[order]
                place = place[order]
                begun = np.flatnonzero(np.diff(key, prepend=-1))  # a posting: a term in a text
                gaps = np.diff(place, prepend=0)
                gaps[begun] = place[begun]
                term, row = np.divmod(key[begun], len(sizes))
                group = np.flatnonzero(np.diff(term, prepend=-1))  # a list: a term in the load
                cuts, ends = np.append(group, len(begun)), np.append(begun, len(key))
                made = [stems.dictionary.take(pa.array(term[group])), _grouped(cuts, ids.take(pa.array(row))), _grouped(cuts, pa.array(np.diff(ends), pa.int32())), _grouped(ends[cuts], pa.array(gaps, pa.int32()))]
                yield pa.RecordBatch.from_arrays(made, ["term", "ids", "sizes", "gaps"])

    return of


def _grouped(cuts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def lists(rows: DataFrame, ident: str, fields: dict[str, Column], most: int = LOAD) -> DataFrame:
    """(term, field, ids, sizes, gaps): in which rows the stems of each field's words stand, how often, and where; null and empty fields have none.

    A list holds the rows of one load of texts. Its gaps are, row after row, the first place of the term and the steps to the next ones.
    """
    schema = f"term string, ids array<{rows.schema[ident].dataType.simpleString()}>, sizes array<int>, gaps array<int>"
    made = [rows.select(F.col(ident).alias("id"), X.normalise(text).alias("text")).mapInArrow(_lists(most), schema).select("term", F.lit(name).alias("field"), "ids", "sizes", "gaps") for name, text in fields.items()]
    return reduce(DataFrame.unionByName, made)


def _spelled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            ids, sizes, gaps = (one.column(c).flatten() for c in ("ids", "sizes", "gaps"))
            ends, sums = np.cumsum(sizes.to_numpy(), dtype=np.int64), np.append(0, np.cumsum(gaps.to_numpy(), dtype=np.int64))
            starts = np.append(0, ends)
            positions = sums[1:] - np.repeat(sums[starts[:-1]], sizes.to_numpy())
            same = [one.column(c).take(pa.array(np.zeros(len(ids), np.int64))) for c in ("bucket", "term", "field")]
            yield pa.RecordBatch.from_arrays([*same, ids, _grouped(starts, pa.array(positions, pa.int32()))], ["bucket", "term", "field", "id", "positions"])


def postings(listed: DataFrame) -> DataFrame:
    """(bucket, term, field, id, positions) of stored lists."""
    kind = listed.schema["ids"].dataType.elementType.simpleString()
    return listed.select("bucket", "term", "field", "ids", "sizes", "gaps").mapInArrow(_spelled_out, f"bucket int, term string, field string, id {kind}, positions array<int>")


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(rows: DataFrame, ident: str, fields: dict[str, Column], path: str, buckets: int = BUCKETS, most: int = LOAD) -> None:
    """Writes the index of the rows' fields under `path`, a folder a bucket, from loads of `most` bytes of text."""
    made = lists(rows, ident, fields, most).withColumn("bucket", bucket_of(F.col("term"), buckets))
    dealt = made.repartition(buckets * SPREAD, "bucket", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(SPREAD)))
    dealt.sortWithinPartitions("bucket", "term", "field").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, words: list[str], fields: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The postings of some stems, from their buckets alone."""
    stems = sorted({stem(w) for w in words})
    index = spark.read.parquet(path).where(F.col("bucket").isin(*(bucket_of(F.lit(s), buckets) for s in stems)) & F.col("term").isin(*stems))
    return postings(index.where(F.col("field").isin(*fields)) if fields else index)


def match(spark: SparkSession, path: str, query: str, fields: list[str] | None = None, phrase: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """(id, hits) of the rows in which every word of the query stands, by stem, in any of the fields; with `phrase`, one after the other in one field.

    hits counts all places of the words, or the places of the phrase. A query without words matches nothing.
    """
    words = [w for w in re.split(r"[^a-z0-9]+", query.lower()) if w]
    found = lookup(spark, path, words or [""], fields, buckets)
    if not phrase:
        told = found.groupBy("id").agg(F.count_distinct("term").alias("terms"), F.sum(F.size("positions")).alias("hits"))
        return told.where(F.col("terms") == len({stem(w) for w in words})).select("id", "hits")
    places = F.array(*(F.lit(stem(w)) for w in words))
    at = F.filter(F.transform(F.sequence(F.lit(0), F.size(places) - 1), lambda i: F.when(F.get(places, i) == F.col("term"), i)), lambda i: i.isNotNull())
    starts = found.select("id", "field", F.explode(at).alias("i"), "positions").select("id", "field", "i", F.explode("positions").alias("p"))
    whole = starts.groupBy("id", "field", (F.col("p") - F.col("i")).alias("start")).agg(F.count("*").alias("held")).where(F.col("held") == len(words))
    return whole.groupBy("id").agg(F.count("*").alias("hits"))

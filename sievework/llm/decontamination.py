"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become templates: names (a capitalised word inside a sentence), numbers
and units after numbers turn into typed placeholders, punctuation into spaces,
letters into lower case. Windows of template words are hashed and joined with
the benchmark's windows. Matched windows of one document and item that lie on
one diagonal cover words of the item; enough covered words make a leak, if the
slots agree: wherever the item has one value, the document must have one value
and the other way round. A question that was asked anew with other names and
numbers is caught, a text that only has its shape is not.

The benchmark's windows are broadcast while there are at most `broadcast` of
them, and beyond that joined by a shuffle. Items shorter than a window are one
window of their own length. An item of up to `enough` words, all of which must
be covered, has a second template for places inside a sentence, where its first
word can be a name.

Template windows of which less than half are literal words are not used, nor
are templates of fewer than `least` words. Items that have such windows or so
few words are also looked for exactly: all their words in a row, with the same
names, numbers, and signs between numbers.

Null and empty texts match nothing. Rows with the same doc_id and text count as
one document, rows of one doc_id with different texts as several; every row
without a doc_id, or item without an item_id, is one of its own unless its text
is the same, too. Empty tables give no rows. Other columns of the inputs are
left behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# Private-use characters that stand for a name, a number, a unit, and before a slot's value.
NAME, NUMBER, UNIT, VALUE = "\ue000", "\ue001", "\ue002", "\ue003"
# Units that may follow a number.
UNITS = "%|kg|g|mg|lb|oz|km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|in|l|ml|h|hours?|min(?:utes?)?|s|sec(?:onds?)?|days?|weeks?|years?|dollars?|euros?|usd|eur|percent"

WINDOW, LEAST, ENOUGH = 8, 5, 13


def template(text: Column, slots: bool = False) -> Column:
    """The text with placeholders; with slots, each placeholder is followed by its value."""
    kept = (lambda group: f"{VALUE}${group}") if slots else (lambda group: "")
    number = r"(\d+(?:[.,:/]\d+)*)"
    text = F.regexp_replace(text, r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", NAME + kept(1))
    text = F.regexp_replace(text, r"[\p{Punct}&&[^%]](?!\d)|(?<!\d)[\p{Punct}&&[^%]]", " ")
    text = F.regexp_replace(text, rf"(?i)(?<![\d\p{{L}}]){number}\s?({UNITS})(?![\p{{L}}\d])", f" {NUMBER}{kept(1)} {UNIT}{kept(2)} ")
    return F.lower(F.regexp_replace(text, rf"(?<!{VALUE}){number}(?![\d.,:/]*\d)" if not slots else rf"(?<![{VALUE}\d.,:/]){number}", f" {NUMBER}{kept(1)} "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def exact(text: Column) -> Column:
    """The text in lower case without punctuation, but with the signs between numbers as words."""
    sign = r"\-+*/=<>\^"
    text = F.regexp_replace(text, rf"(?<=\d)\s?([{sign}])\s?(?=\d)", " $1 ")
    text = F.regexp_replace(text, rf"(?<!\d )[{sign}]|[{sign}](?! \d)", " ")
    return F.lower(F.regexp_replace(text, rf"[\p{{Punct}}&&[^%{sign}]](?!\d)|(?<!\d)[\p{{Punct}}&&[^%{sign}]]", " "))


def row_key(ident: str) -> Column:
    """A row's own key: a hash of its id, null or not, and its text."""
    return F.xxhash64(F.col(ident).isNull(), ident, "text")


def _windows(rows: DataFrame, ident: list[str], sizes: list[int], alias: str) -> DataFrame:
    """(ident, size, at, hash) of every window of each size; `rows` has the columns of ident and the words' hashes in h."""

    def of(n: int) -> DataFrame:
        hashed = F.transform(F.sequence(F.lit(1), F.size("h") - n + 1), lambda i: F.xxhash64(F.slice("h", i, n)))
        return rows.where(F.size("h") >= n).select(*ident, F.lit(n).alias("size"), F.posexplode(hashed).alias(f"{alias}at", "hash"))

    return reduce(DataFrame.unionByName, map(of, sizes))


def _placeholder(word: Column) -> Column:
    return word.startswith(NAME) | word.startswith(NUMBER) | word.startswith(UNIT)


def _covered(texts: DataFrame, own: DataFrame, sizes: list[int], broadcast: int) -> DataFrame:
    """The places of each item that a document's windows cover on one diagonal."""
    if own.count() <= broadcast:
        own = F.broadcast(own)
    key = ["doc_id", "row", "item", "variant", "item_words"]
    hits = _windows(texts, ["doc_id", "row"], sizes, "d").join(own, ["hash", "size"]).select(*key, "size", "iat", (F.col("dat") - F.col("iat")).alias("shift")).distinct()
    spans = F.array_distinct(F.flatten(F.collect_list(F.sequence("iat", F.col("iat") + F.col("size") - 1))))
    return hits.groupBy(*key, "shift").agg(spans.alias("places"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, least: int, enough: int, broadcast: int) -> DataFrame:
    """Every leak with the keys of its row and item."""
    docs = docs.where("text is not null").select("doc_id", "text", row_key("doc_id").alias("row"))
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    size_of = F.least(F.size("words"), F.lit(window))
    literal = lambda at, n: F.size(F.filter(F.slice("words", at, n), lambda w: ~_placeholder(w)))
    own_sizes = lambda rows: sorted(r[0] for r in rows.select(size_of.alias("n")).distinct().collect())
    own_windows = lambda rows, sizes: _windows(rows.select("item", "variant", F.size("words").alias("item_words"), "words", hashes("words").alias("h")), ["item", "variant", "item_words", "words"], sizes, "i").where(F.col("size") == size_of)

    bench = benchmark.where("text is not null").select("item_id", "text", row_key("item_id").alias("item")).dropDuplicates(["item"])
    both = bench.select("item", "text", words(template(F.col("text"))).alias("words"), words(template(F.col("text"), True)).alias("slots"), F.lit(0).alias("variant"))
    # Inside a sentence: after a lower-case word, which is taken off again.
    after = F.concat(F.lit("a "), F.ltrim("text"))
    rest = lambda w: F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
    inside = bench.select("item", "text", rest(words(template(after))).alias("words"), rest(words(template(after, True))).alias("slots"), F.lit(1).alias("variant"))
    inside = inside.join(both.select("item", F.col("words").alias("first")), "item").where((F.col("words") != F.col("first")) & (F.size("words") <= enough)).drop("first")
    items = both.unionByName(inside).where(F.size("words") >= least)
    sizes = own_sizes(items)
    own = own_windows(items, sizes or [window]).where(2 * literal(F.col("iat") + 1, F.col("size")) >= F.col("size")).select("item", "variant", "item_words", "size", "iat", "hash")
    texts = docs.select("doc_id", "row", hashes(words(template(F.col("text")))).alias("h"))
    runs = materialize(_covered(texts, own, sizes or [window], broadcast).where(F.size("places") >= F.least("item_words", F.lit(enough))), "runs")  # both kinds of items read it
    # Slots: only items that have any need the documents' values.
    valued = items.where(F.exists("words", _placeholder)).select("item", "variant", F.col("slots").alias("item_slots"))
    said = ("doc_id", "row", "item", "item_words")
    plain = runs.join(valued, ["item", "variant"], "left_anti").select(*said, F.size("places").alias("covered"), F.lit(0).alias("slots"), F.lit(0).alias("changed"))
    open_ = runs.join(valued, ["item", "variant"])
    hit = open_.select("row").distinct()
    hit = F.broadcast(hit) if hit.count() <= broadcast else hit
    doc_words = docs.join(hit, "row", "left_semi").dropDuplicates(["row"]).select("row", words(template(F.col("text"), True)).alias("doc_slots"))
    paired = open_.join(doc_words, "row").select(
        *said, "shift", F.size("places").alias("covered"),
        F.filter(F.transform("places", lambda p: F.struct(F.get("item_slots", p).alias("a"), F.get("doc_slots", p + F.col("shift")).alias("b"))), lambda s: s.a.contains(VALUE)).alias("pairs"),
    )
    size = lambda c: F.size(F.array_distinct(F.transform("pairs", c)))
    agree = (size(lambda s: s.a) == size(lambda s: s)) & (size(lambda s: s.b) == size(lambda s: s))
    every = plain.unionByName(paired.where(agree).select(*said, "covered", F.size("pairs").alias("slots"), F.size(F.filter("pairs", lambda s: s.a != s.b)).alias("changed")))
    # Exactly: items of which the templates leave something out.
    sparse = F.exists(F.sequence(F.lit(1), F.size("words") - size_of + 1), lambda i: 2 * literal(i, size_of) < size_of)
    left = both.where(F.size("words") > 0).where((F.size("words") < least) | sparse)
    slots = F.size(F.filter("words", _placeholder))
    left = left.select("item", slots.alias("variant"), words(exact(F.col("text"))).alias("words")).where(F.size("words") > 0)
    if sizes := own_sizes(left):
        own = own_windows(left, sizes).select("item", "variant", "item_words", "size", "iat", "hash")
        texts = docs.select("doc_id", "row", hashes(words(exact(F.col("text")))).alias("h"))
        whole = _covered(texts, own, sizes, broadcast).where(F.size("places") == F.col("item_words"))
        every = every.unionByName(whole.select(*said, F.size("places").alias("covered"), F.col("variant").alias("slots"), F.lit(0).alias("changed")))
    return every.join(bench.select("item", "item_id"), "item")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, enough: int = ENOUGH, broadcast: int = 200_000) -> DataFrame:
    """(doc_id, item_id, covered, item_words, slots, changed): every document that holds an item, plainly or re-parameterised."""
    found = _found(docs, benchmark, window, least, enough, broadcast)
    # Ids name documents and items; without an id, each row or item is one of its own.
    unnamed = [F.when(F.col(i).isNull(), F.col(k)).alias(f"{k}_own") for i, k in (("doc_id", "row"), ("item_id", "item"))]
    rows = found.groupBy("doc_id", "item_id", *unnamed).agg(F.max("covered").cast("long").alias("covered"), F.max("item_words").cast("long").alias("item_words"), F.max("slots").cast("long").alias("slots"), F.min("changed").cast("long").alias("changed"))
    return rows.select("doc_id", "item_id", "covered", "item_words", "slots", "changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, enough: int = ENOUGH, broadcast: int = 200_000) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    found = _found(docs, benchmark, window, least, enough, broadcast).select(F.col("row").alias("leaky")).distinct()
    found = materialize(found, "leaky")
    found = F.broadcast(found) if found.count() <= broadcast else found
    return docs.join(found, row_key("doc_id") == found.leaky, "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

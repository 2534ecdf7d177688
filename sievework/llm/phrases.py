"""Collocations by partitioned phrase mining.

Texts become shards of one language and bounded size: word codes in the order
of the text and where pieces break. Each shard is mined completely: at its
share of the language's words, a phrase that is frequent in all of them reaches
its share of the support in one shard at least. A shard reports what reaches
that lowered support, rounded up, with its counts. The union of the reports,
less what cannot reach the support even if every other shard was just short of
reporting it, are the candidates, and a second count takes them from the shards
that did not report them. A shard whose lowered support is 1 has reported all
it has, so nothing is left to count there; with many shards that is all of them,
and what prunes is the order of the levels: a phrase of k words is looked for
only where both its phrases of k - 1 words are frequent.

Words have numbers by language, phrases of a level too, and a phrase's key is
the number of its first k - 1 words with that of its last word, so counts are
exact: no hash stands for a word. Frequent words and phrases return to the
shards that hold them, grouped by shard, never to all tasks.

Null text counts as empty, a null lang as `und`. Repeated rows count as often
as they stand. Very long texts are shards of their own. No rows give no rows.
Columns other than lang and text take no part.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, give_back, materialize, pack_planes, squeeze, unpack_planes, unsqueeze
from .merkle import ranked

SHARD = "shard long, lang string, n_words long, codes binary, joined binary, vocab array<string>, counts array<long>"
#: A-Z to small letters, what parts pieces to a line feed, tabs to blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


#: Parts of a language whose best phrases are taken before the last ranking.
PARTS = 64


def _tokenised(raw: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word codes, whether a word and the next stand in one piece, and the words by code."""
    b = np.frombuffer(raw.translate(_TABLE), np.uint8)
    inside = (b != 32) & (b != 10)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    piece = np.cumsum(b == 10, dtype=np.int32)[starts]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b[inside])]).dictionary_encode()
    return words.indices.to_numpy(), piece[:-1] == piece[1:], words.dictionary.cast(pa.large_string())


def _into_shards(limit: int):
    def shards(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang):
            nonlocal number
            codes, joined, vocab = _tokenised(b"\n".join(held.pop(lang)))
            sizes.pop(lang)
            if len(codes):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([number], pa.int64()), "lang": pa.array([lang], pa.string()), "n_words": pa.array([len(codes)], pa.int64()), "codes": pa.array([pack_planes(codes.astype(np.int32))], pa.binary()),
                    "joined": pa.array([squeeze(np.packbits(joined).tobytes())], pa.binary()), "vocab": pa.array([vocab.to_pylist()], pa.list_(pa.string())), "counts": pa.array([np.bincount(codes)], pa.list_(pa.int64())),
                })
                number += 1

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), pc.fill_null(batch.column("text").cast(pa.large_binary()), b""), strict=True):
                raw = text.as_py()
                held.setdefault(lang, []).append(raw)
                sizes[lang] = sizes.get(lang, 0) + len(raw) + 1
                if sizes[lang] >= limit:
                    yield from flush(lang)
                elif sum(sizes.values()) >= 4 * limit:
                    yield from flush(max(sizes, key=sizes.get))
        for lang in sorted(held):
            yield from flush(lang)
        give_back()

    return shards


def shard_table(docs: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """Writes the texts as shards of about `limit` bytes of one language, bucketed by shard so that later joins move only the other side."""
    spark = docs.sparkSession
    made = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(_into_shards(limit), SHARD)
    name, buckets = f"sievework_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.repartition(buckets, "shard").write.bucketBy(buckets, "shard").option("path", fresh_path(spark, "shards")).option("compression", "zstd").saveAsTable(name)
    shards = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay where the plan has found them, its name goes
    return shards


def _numbers(codes: np.ndarray, joined: np.ndarray, known: dict[int, tuple[np.ndarray, np.ndarray]], level: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the phrases of `level` words at each position, and whether the phrases of one word less on both its sides are known."""
    keys, numbers = known[1]
    table = np.full(codes.max() + 1, -1, np.int64)
    table[keys] = numbers
    word = table[codes]
    phrase = word
    for k in range(2, level + 1):
        n = len(codes) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, bool)
        whole = joined[:n].copy()
        for d in range(1, k - 1):
            whole &= joined[d : d + n]
        ok = whole & (phrase[:n] >= 0) & (phrase[1 : n + 1] >= 0)
        key = (phrase[:n] << 32) | word[k - 1 : k - 1 + n]
        if k == level:
            return key, ok
        keys, numbers = known.get(k, (np.empty(0, np.int64),) * 2)
        order = np.argsort(keys)
        keys, numbers = keys[order], numbers[order]
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        phrase = np.where(ok & (keys[at] == key), numbers[at], -1) if len(keys) else np.full(n, -1, np.int64)
    raise ValueError(level)


_FOUND = pa.schema([("shard", pa.int64()), ("key", pa.int64()), ("cnt", pa.int64()), ("need", pa.int64()), ("slack", pa.int64())])


def _mine(level: int, reported: bool):
    """Counts of a shard's phrases of `level` words: those that reach its lowered support, or the others."""
    def mined(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        row = left.slice(0, 1).to_pylist()[0]
        codes, joined = unpack_planes(row["codes"], np.int32), np.unpackbits(np.frombuffer(unsqueeze(row["joined"]), np.uint8))[: row["n_words"] - 1].astype(bool)
        kind, keys, numbers = (right.column(c).to_numpy() for c in ("kind", "key", "id"))
        known = {int(k): (keys[kind == k], numbers[kind == k]) for k in np.unique(kind)}
        if 1 not in known:
            return _FOUND.empty_table()
        key, ok = _numbers(codes, joined, known, level)
        found, counts = np.unique(key[ok], return_counts=True)
        need, slack = row["need"], row["slack"]
        pick = counts >= need if reported else counts < need
        found, counts = found[pick], counts[pick]
        out = pa.table([pa.array(np.full(len(found), row["shard"])), pa.array(found), pa.array(counts.astype(np.int64)), pa.array(np.full(len(found), need)), pa.array(np.full(len(found), slack))], schema=_FOUND)
        give_back()
        return out

    return mined


def _ids(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df with a dense number `id` from 0; keys hold 32 bits of it."""
    return ranked(df.withColumn("tree", F.lit(0)), "tree", order, label).drop("tree", "n").withColumnRenamed("rank", "id").where(F.when(F.col("id") < F.lit(1 << 32), True).otherwise(F.raise_error(F.lit("more than 2^32 frequent phrases of one length"))))


def frequent_phrases(docs: DataFrame, support: int = 10, longest: int = 3, shard_bytes: int = 4 << 20) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1, 2, ... words, and the words of each language (lang, n).

    A table's rows: id, lang, words, a, fronts and backs (counts of its first and of
    its last 1, 2, ... words), front and back (numbers of the phrases without
    the last and without the first word).
    """
    shards = shard_table(docs, shard_bytes)
    totals = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    need = F.greatest(F.ceil(F.lit(support) * F.col("n_words") / F.col("n")), F.lit(1)).cast("long")
    needs = shards.select("shard", "lang", "n_words").join(totals, "lang").withColumn("need", need)
    slack = needs.groupBy("lang").agg(F.sum(F.col("need") - 1).alias("slack"))
    needs = materialize(needs.join(slack, "lang").select("shard", "need", "slack"), "needs")
    partial = bool(needs.agg(F.max("need")).head()[0] not in (None, 1))
    work = shards.select("shard", "n_words", "codes", "joined").join(needs, "shard")

    held = shards.select("shard", "lang", F.posexplode(F.arrays_zip("vocab", "counts")).alias("code", "w")).select("shard", "lang", F.col("code").cast("long").alias("key"), F.col("w.vocab").alias("word"), F.col("w.counts").alias("cnt"))
    words = held.groupBy("lang", "word").agg(F.sum("cnt").alias("a")).where(F.col("a") >= support)
    words = materialize(_ids(words, ["lang", "word"], "words"), "words")
    known = materialize(held.join(words, ["lang", "word"]).select("shard", F.lit(1).alias("kind"), "key", "id"), "known")
    none = F.lit(0).cast("long")  # the phrase of no words
    levels = [words.select("id", "lang", F.array("word").alias("words"), "a", F.array("a").alias("fronts"), F.array("a").alias("backs"), none.alias("front"), none.alias("back"), F.col("id").alias("last"))]
    for k in range(2, longest + 1):
        def mine(reported, known=known, k=k):
            return work.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_mine(k, reported), "shard long, key long, cnt long, need long, slack long")

        found = materialize(mine(True), f"found{k}")
        seen = found.groupBy("key").agg(F.sum("cnt").alias("a"), (F.first("slack") - F.sum(F.col("need") - 1)).alias("most"))
        if partial:  # some shards have not reported all they have
            candidates = materialize(seen.where(F.col("a") + F.col("most") >= support).select("key"), f"candidates{k}")
            found = found.unionByName(materialize(mine(False).join(candidates, "key", "left_semi"), f"rest{k}"))
            seen = found.groupBy("key").agg(F.sum("cnt").alias("a"))
        frequent = materialize(_ids(seen.where(F.col("a") >= support).select("key", "a"), ["key"], f"frequent{k}"), f"frequent{k}")
        if k < longest:
            known = known.unionByName(materialize(found.join(frequent, "key").select("shard", F.lit(k).alias("kind"), "key", "id"), f"known{k}"))
        levels.append(materialize(_described(frequent, levels, k), f"phrases{k}"))
    return levels, totals


def _described(frequent: DataFrame, levels: list[DataFrame], k: int) -> DataFrame:
    """The phrases of k words with their words and the counts of their parts, from the tables of the levels below."""
    split = frequent.select("id", "a", F.shiftrightunsigned("key", 32).alias("front"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("last"))
    front = levels[-1].select(F.col("id").alias("front"), "lang", "words", "fronts", F.col("back").alias("inner"))
    back = levels[-1].select(F.col("id").alias("back"), F.col("front").alias("inner"), "last", F.col("words").alias("rest"), "backs")
    grown = lambda c: F.concat(F.col(c), F.array("a")).alias(c)
    return split.join(front, "front").join(back, ["inner", "last"]).select("id", "lang", F.concat(F.slice("words", 1, 1), "rest").alias("words"), "a", grown("fronts"), grown("backs"), "front", "back", "last")


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right)).cast("long")


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, inside: int = 50, top: int = 2000, shard_bytes: int = 4 << 20) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase scores by its worst cut; one that stands inside a longer frequent
    phrase of at least `inside` hundredths of its count is dropped. The last ranking
    of a language sees the best `top` of each of its PARTS parts only.
    """
    levels, totals = frequent_phrases(docs, support, longest, shard_bytes)
    kept = []
    for k in range(2, longest + 1):
        phrases = levels[k - 1]
        if k < longest:
            longer = levels[k].select(F.explode(F.array("front", "back")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longer"))
            phrases = phrases.join(longer, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
        cuts = [F.struct(_score(F.col("a"), F.col("fronts")[i - 1], F.col("backs")[k - i - 1]).alias("score"), F.lit(i).alias("k"), F.col("fronts")[i - 1].alias("l"), F.col("backs")[k - i - 1].alias("r")) for i in range(1, k)]
        kept.append(phrases.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.array_min(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    order = (F.desc("score"), F.desc("a"), "phrase")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))  # so that no task ranks a whole language
    near = dealt.withColumn("near", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("near") <= top).drop("near", "part")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))

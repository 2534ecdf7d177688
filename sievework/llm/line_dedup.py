"""Line dedup by winnowing over line hashes.

A window is `lines` consecutive lines of one document. The smallest line hash
of a window, the last of equal ones, is selected as its fingerprint; equal
windows select the same line, and neighbouring windows mostly share theirs, so
about two lines of `lines` + 1 are fingerprints. Positions are joined on their
fingerprints, and those that have a partner are extended line by line both ways
to the windows that selected them. Where such a window also stands at an
earlier place (smaller doc_id, or earlier in the document) it is a repeat; the
repeats of a document join to whole runs, whose lines are deleted. The first
place of a run always stays.

With `words`, shorter runs count as well: one line or up to `lines` - 1 lines
of together so many words, and a whole text of fewer than `lines` lines that
has a word and equals another whole text.

Lines are what a line feed parts, compared exactly. Null text stays null and
has no lines; texts of fewer lines than a window stay as they are. Rows with
the same doc_id and text count as one document, so repeated rows do not delete
each other; rows of one doc_id with different texts are documents of their own,
in the order of their texts' hashes, and so are rows without a doc_id, which
stand last. An empty table gives no rows. Other columns stay,
whatever their names; where the text changes, an integer n_chars follows it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

_LAST = (1 << 63) - 1


def _own() -> list:
    """A row's place in the order of documents and its own key: rows that agree in both have the same text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("own")]


def repeated_places(docs: DataFrame, lines: int = 3, words: int | None = None) -> DataFrame:
    """(doc, own, places): the windows that repeat an earlier place, each as its first line, from 0, times lines + 1, plus its number of lines."""
    split = F.split("text", "\n")
    hashed = docs.select(*_own(), F.transform(split, lambda x: F.xxhash64(x)).alias("h"), *([F.transform(split, _n_words).alias("w")] if words else []))
    place = lambda i, n: ((i - 1) * (lines + 1) + n).cast("long").alias("at")

    def starts(n, held=None):
        found = F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: i <= F.size("h") - n + 1)
        return found if held is None else F.filter(found, held)

    def short(n, whole):
        """Windows of n < lines lines: of enough words, or a whole text; the key tells the kinds apart."""
        many = lambda i: F.aggregate(F.slice("w", i, n), F.lit(0), lambda a, x: a + x)
        held = (lambda i: (F.size("h") == n) & (many(i) > 0)) if whole else (lambda i: many(i) >= words)
        return F.transform(starts(n, held), lambda i: F.struct(place(i, F.lit(n)), F.xxhash64(F.slice("h", i, n)).alias("print"), F.lit(-n if whole else n).cast("long").alias("key")))

    # Fingerprints: the positions that windows select, each with the windows that selected it.
    held = hashed.where(F.size("h") >= lines).select("doc", "own", "h", F.transform(starts(lines), lambda i: i + lines - F.array_position(F.reverse(F.slice("h", i, lines)), F.array_min(F.slice("h", i, lines)))).alias("pick"))
    around = lambda p: F.filter(F.sequence(F.greatest(p - lines + 1, F.lit(1)), F.least(p, F.size("pick").cast("long"))), lambda i: F.get("pick", i.cast("int") - 1) == p)
    of = lambda p: F.transform(around(p), lambda i: F.struct(place(i, lines), F.xxhash64(F.slice("h", i.cast("int"), lines)).alias("key")))
    prints = held.select("doc", "own", F.explode(F.transform(F.array_distinct("pick"), lambda p: F.struct(F.get("h", p.cast("int") - 1).alias("print"), of(p).alias("windows")))).alias("p")).select("doc", "own", "p.*")
    spot = F.struct("doc", "own", F.col("windows")[0].at.alias("at"))
    joined = prints.groupBy("print").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("print")
    windows = prints.join(joined, "print", "left_semi").select("doc", "own", "print", F.explode("windows").alias("w")).select("doc", "own", "w.at", "print", "w.key")
    if words:
        brief = F.concat(*(short(n, whole) for n in range(1, lines) for whole in (False, True)))
        windows = windows.unionByName(hashed.select("doc", "own", F.explode(brief).alias("w")).select("doc", "own", "w.*"))
    windows = materialize(windows, "windows")  # read twice
    key = ["print", "key"]
    first = windows.groupBy(*key).agg(F.min(F.struct("doc", "own", "at")).alias("first"), F.max(F.struct("doc", "own", "at")).alias("last")).where("first <> last").drop("last")
    later = windows.join(first, key).where(F.struct("doc", "own", "at") > F.col("first"))
    return later.groupBy("doc", "own").agg(F.collect_set("at").alias("places"))


def _n_words(line):
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def _without(lines: int):
    def kept(text: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(text, places, strict=True):
            if p is not None and t is not None:
                rows = t.split("\n")
                gone = np.zeros(len(rows), bool)
                first, n = np.divmod(np.asarray(p), lines + 1)
                for d in range(lines):
                    gone[first[n > d] + d] = True
                t = "\n".join(r for r, g in zip(rows, gone, strict=True) if not g)
            out.append(t)
        return pd.Series(out, dtype=object)

    return kept


def _marked(docs: DataFrame, lines: int, words: int | None = None) -> DataFrame:
    """The rows with their struct in `row`, the text without repeats, and the numbers of lines before and after."""
    found = repeated_places(docs, lines, words)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_own())
    joined = rows.join(found, ["doc", "own"], "left")
    clean = F.pandas_udf(_without(lines), "string")
    first = lambda p: F.floor(p / (lines + 1)).cast("int")
    lines_of = lambda p: F.sequence(first(p), first(p) + p % (lines + 1) - 1)
    gone = F.size(F.array_distinct(F.flatten(F.transform("places", lines_of))))
    return joined.select(
        "row", F.when(F.col("places").isNull(), F.col("row.text")).otherwise(clean("row.text", "places")).alias("kept"),
        F.coalesce(F.size(F.split("row.text", "\n")).cast("long"), F.lit(0)).alias("n_lines"), F.coalesce(gone.cast("long"), F.lit(0)).alias("n_removed"),
    )


def remove_repeated_lines(docs: DataFrame, lines: int = 3, words: int | None = None) -> DataFrame:
    """The documents without repeated runs of lines; those of which nothing stays are gone."""
    rows = _marked(docs, lines, words).where("n_removed = 0 or n_removed < n_lines")
    fixed = {"text": F.col("kept")}
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        fixed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return rows.select(*(fixed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3)
    return rows.select(F.col("row.doc_id").alias("doc_id"), F.greatest("n_lines", F.lit(0)).alias("n_lines"), "n_removed", F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"))


OP4_SQL = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents where text is not null
), windows as (
  select *, lead(line, 1) over d as second, lead(line, 2) over d as third from lines window d as (partition by doc_id order by i)
), judged as (
  select doc_id, i, line, case when third is null then 0 else (row_number() over (partition by line, second, third order by doc_id, i) > 1)::int end as repeat
  from windows
), marked as (
  select *, max(repeat) over (partition by doc_id order by i rows between 2 preceding and current row) as gone from judged
)
select d.doc_id, count(m.i) as n_lines, coalesce(sum(m.gone), 0)::bigint as n_removed,
  md5(coalesce(string_agg(m.line, chr(10) order by m.i) filter (where m.gone = 0), '')) as kept_md5
from documents d left join marked m on m.doc_id = d.doc_id group by d.doc_id
"""

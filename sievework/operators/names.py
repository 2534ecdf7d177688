"""Names with alternatives, and what the rest of a line makes of an entry: candidates and rules as rows that are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .annotate import entries

_EITHER = r"(?i)\s+or\s+|\s*/\s*(?=\p{L})"


def _candidates(name: Column) -> Column:
    """(at, phrase): each alternative completed by what may be the last one's end, the longest first, then as it stands."""
    parts = F.transform(F.split(name, _EITHER), lambda p: F.trim(p))
    tail = F.filter(F.split(F.element_at(parts, -1), r"\s+"), lambda w: w != "")

    def of(part: Column, i: Column) -> Column:
        short = (i < F.size(parts) - 1) & (F.size(F.split(part, r"\s+")) <= F.size(tail))
        ends = F.when(short & (F.size(tail) > 1), F.transform(F.sequence(F.lit(2), F.size(tail)), lambda k: F.concat_ws(" ", part, F.array_join(F.slice(tail, k, F.size(tail)), " "))))
        return F.concat(F.coalesce(ends, F.array().cast("array<string>")), F.array(part))

    return F.flatten(F.transform(parts, of))


def alternatives(names: DataFrame, name: str, dictionary: DataFrame) -> DataFrame:
    """(name, slug, note) of each distinct name: the first candidate that the dictionary (key, tag) knows, and the alternatives beside the first as a note.

    "chicken or vegetable broth" is chicken broth, with the note "vegetable broth". No slug where none is known.
    """
    rows = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    asked = rows.select("name", F.posexplode(_candidates(F.col("name"))).alias("at", "phrase")).withColumn("key", X.normalise(F.col("phrase")))
    found = asked.join(entries(dictionary).where("not unspaced"), "key").groupBy("name").agg(F.min_by("tag", "at").alias("slug"))
    others = F.slice(F.split("name", _EITHER), 2, F.size(F.split("name", _EITHER)))
    return rows.join(found, "name", "left").select("name", "slug", F.nullif(F.array_join(others, " or "), F.lit("")).alias("note"))


def by_context(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """The lines (line, slug, name, unit, flags array) with `slug` as the first fitting rule makes it.

    rules: (subject, cue, becomes, rank). A rule's subject is `slug:x` or `flag:x`, its cue `word:x` (a word of the name, folded) or `unit:x`; the
    smallest rank counts. A table of rules is what a user writes by hand, so it goes to every task.
    """
    none = F.array().cast("array<string>")
    tagged = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(f"{kind}:"), x))
    subjects = F.concat(F.array(F.concat(F.lit("slug:"), "slug")), tagged("flag", F.coalesce("flags", none)))
    cues = F.concat(tagged("word", F.coalesce(X.words(X.normalise(F.col("name"))), none)), F.coalesce(F.array(F.concat(F.lit("unit:"), "unit")), none))
    asked = lines.where("slug is not null").select("line", F.explode(F.array_distinct(subjects)).alias("subject"), cues.alias("cues")).select("line", "subject", F.explode(F.array_distinct("cues")).alias("cue"))
    made = asked.join(F.broadcast(rules), ["subject", "cue"]).groupBy("line").agg(F.min_by("becomes", "rank").alias("made"))
    return lines.join(made, "line", "left").withColumn("slug", F.coalesce("made", "slug")).drop("made")

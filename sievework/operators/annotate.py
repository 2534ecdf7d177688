"""Dictionary annotation: spans of known phrases in texts, names resolved to entries, and marker search.

A dictionary is a table (key, tag). Keys are folded as texts are (`text.normalise`);
keys in scripts without spaces stay as they are, and serve for resolving only. Of
equal keys the smallest tag counts. Up to `limit` entries, a trie of tokens is
built once and broadcast; a larger dictionary stays a table, and the grams of the
texts are joined with it. Both ways give the same rows.

Null and empty texts have no spans; a null key or tag is no entry.
"""

from __future__ import annotations

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: The most entries that are broadcast.
LIMIT = 200_000
SPANS = "array<struct<at:int,n:int,key:string,tag:string>>"
#: Scripts whose words no spaces part.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
_END = ""  # no token is empty


def entries(dictionary: DataFrame, longest: int = 8) -> DataFrame:
    """(key, tag, unspaced) with folded keys of at most `longest` words, each once."""
    unspaced = F.col("key").rlike(UNSPACED)
    folded = F.when(unspaced, F.regexp_replace(F.lower("key"), r"\s+", "")).otherwise(X.normalise(F.col("key")))
    rows = dictionary.select(folded.alias("key"), F.col("tag").cast("string").alias("tag"), unspaced.alias("unspaced")).where("key <> '' and tag is not null")
    short = F.col("unspaced") | (F.size(F.split("key", " ")) <= longest)
    return rows.where(short).groupBy("key", "unspaced").agg(F.min("tag").alias("tag"))


def _trie(rows: list) -> dict:
    """Nested dicts by token; a key's tag lies under the empty token where it ends."""
    root: dict = {}
    for key, tag in rows:
        at = root
        for token in key.split(" "):
            at = at.setdefault(token, {})
        at[_END] = tag
    return root


def _small(known: DataFrame, limit: int) -> list | None:
    """The entries if they are at most `limit`, else none."""
    rows = known.select("key", "tag").limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def _longest(tokens: list[str], i: int, trie: dict) -> tuple[int, str | None]:
    n, tag, at = 0, None, trie
    for j in range(i, len(tokens)):
        at = at.get(tokens[j])
        if at is None:
            break
        if _END in at:
            n, tag = j - i + 1, at[_END]
    return n, tag


def spans_in(tokens: list[str], trie: dict) -> list[tuple[int, int, str, str]]:
    """(at, n, key, tag) from left to right, at each place the longest, none overlapping."""
    out, i = [], 0
    while i < len(tokens):
        n, tag = _longest(tokens, i, trie) if tokens[i] in trie else (0, None)
        if n:
            out.append((i, n, " ".join(tokens[i : i + n]), tag))
        i += n or 1
    return out


def _spans(shared: Broadcast):
    def each(texts: pd.Series) -> pd.Series:
        trie = shared.value
        return pd.Series([[{"at": a, "n": n, "key": k, "tag": t} for a, n, k, t in spans_in(x.split(" "), trie)] if x else [] for x in texts], dtype=object)

    return F.pandas_udf(each, SPANS)


def _hits(rows: DataFrame, ident: str, tokens: Column, known: DataFrame, longest: int) -> DataFrame:
    """(ident, at, n, key, tag): every place of every entry, by a join of the texts' grams with the entries."""
    words = rows.select(ident, tokens.alias("words"))  # a column of its own: lambdas would compute it once a word

    def of(n: int) -> Column:
        found = F.transform(X.ngrams(F.col("words"), n), lambda g: F.struct(g["at"].alias("at"), F.lit(n).alias("n"), g["gram"].alias("key")))
        return F.coalesce(found, F.array().cast("array<struct<at:int,n:int,key:string>>"))

    grams = F.concat(*(of(n) for n in range(1, longest + 1)))
    return words.select(ident, F.inline(grams)).join(known.where("not unspaced").select("key", "tag"), "key").select(ident, "at", "n", "key", "tag")


def annotate(rows: DataFrame, ident: str, text: Column, dictionary: DataFrame, longest: int = 8, limit: int = LIMIT) -> DataFrame:
    """(ident, at, n, key, tag): the spans of a text's entries, from left to right the longest, none overlapping; `at` counts words from 0. Idents are unique."""
    known = entries(dictionary, longest)
    small = _small(known.where("not unspaced"), limit)
    folded = X.normalise(text)
    if small is not None:
        trie = rows.sparkSession.sparkContext.broadcast(_trie(small))
        return rows.select(ident, F.inline(_spans(trie)(folded)))
    hits = _hits(rows, ident, X.words(folded), known, longest)
    best = hits.groupBy(ident, "at").agg(F.max_by(F.struct("at", "n", "key", "tag"), "n").alias("hit"))
    ordered = best.groupBy(ident).agg(F.array_sort(F.collect_list("hit")).alias("hits"))  # at most one a word of one text
    start = F.struct(F.lit(0).alias("next"), F.array().cast(SPANS).alias("found"))
    taken = F.aggregate("hits", start, lambda s, h: F.when(h["at"] >= s["next"], F.struct((h["at"] + h["n"]).alias("next"), F.concat(s["found"], F.array(h)).alias("found"))).otherwise(s))
    return ordered.select(ident, F.inline(taken["found"]))


def _resolver(shared: Broadcast, dull: frozenset[str]):
    def one(name: str, raw: str):
        trie, sizes = shared.value
        tokens = name.split(" ") if name else []
        best = (0, 0, None)
        for i in range(len(tokens)):
            at = trie
            for j in range(i, len(tokens)):
                at = at.get(tokens[j])
                if at is None:
                    break
                whole = i == 0 and j == len(tokens) - 1
                if _END in at and (whole or j > i or tokens[i] not in dull):
                    best = max(best, (j - i + 1, i, at[_END]), key=lambda b: b[:2])
        if best[0]:
            n, i, tag = best
            return {"key": " ".join(tokens[i : i + n]), "tag": tag, "how": "exact" if n == len(tokens) else "part"}
        for size, keys in sizes:
            for i in range(len(raw) - size, -1, -1):
                if raw[i : i + size] in keys:
                    return {"key": raw[i : i + size], "tag": keys[raw[i : i + size]], "how": "inside"}
        return None

    def each(names: pd.Series, raws: pd.Series) -> pd.DataFrame:
        found = [one(n, r or "") or {} for n, r in zip(names, raws, strict=True)]
        return pd.DataFrame([(f.get("key"), f.get("tag"), f.get("how")) for f in found], columns=["key", "tag", "how"]).astype(object)

    return F.pandas_udf(each, "key string, tag string, how string")


def resolve_names(names: DataFrame, name: str, dictionary: DataFrame, longest: int = 8, dull: tuple[str, ...] = (), limit: int = LIMIT) -> DataFrame:
    """(name, key, tag, how) for each distinct name that an entry is found in.

    The name as a whole (`exact`), else its longest run of words, the rightmost of
    equal ones (`part`; a single `dull` word is none), else, in scripts without
    spaces, the longest entry inside it, again the rightmost (`inside`).
    """
    known = entries(dictionary, longest)
    rows = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    folded, raw = X.normalise(F.col("name")), F.when(F.col("name").rlike(UNSPACED), F.regexp_replace(F.lower("name"), r"\s+", ""))
    small, inside = _small(known.where("not unspaced"), limit), _small(known.where("unspaced"), limit)
    if small is not None and inside is not None:
        sizes: dict[int, dict] = {}
        for key, tag in inside:
            sizes.setdefault(len(key), {})[key] = tag
        shared = rows.sparkSession.sparkContext.broadcast((_trie(small), sorted(sizes.items(), reverse=True)))
        return rows.select("name", _resolver(shared, frozenset(dull))(folded, raw).alias("r")).select("name", "r.*").where("key is not null")
    hits = _hits(rows.withColumn("size", F.size(X.words(folded))), "name", X.words(folded), known, longest)
    sizes = rows.select("name", F.size(X.words(folded)).alias("size"))
    hits = hits.join(sizes, "name").where((F.col("n") > 1) | (F.col("size") == 1) | ~F.col("key").isin(*dull)) if dull else hits.join(sizes, "name")
    how = F.when(F.col("n") == F.col("size"), "exact").otherwise("part")
    spaced = hits.groupBy("name").agg(F.max_by(F.struct("key", "tag", how.alias("how")), F.struct("n", "at")).alias("r")).select("name", "r.*")
    left = rows.join(spaced, "name", "left_anti").select("name", raw.alias("raw")).where("raw is not null")
    size = known.where("unspaced").agg(F.max(F.length("key")).alias("most"))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("raw")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.col("most"), F.length("raw") - i + 1)), lambda n: F.struct(n.alias("n"), i.alias("at"), F.substr("raw", i, n).alias("key")))))
    found = left.crossJoin(F.broadcast(size)).where("most > 0").select("name", F.inline(pieces)).join(known.where("unspaced").select("key", "tag"), "key")  # one row of one number
    inside = found.groupBy("name").agg(F.max_by(F.struct("key", "tag", F.lit("inside").alias("how")), F.struct("n", "at")).alias("r")).select("name", "r.*")
    return spaced.unionByName(inside)


def first_marker(text: Column, markers: list[tuple[str, str]], blanked: tuple[str, ...] = ()) -> Column:
    """(label, marker) of the first of `markers` (marker, label), in the list's order, that a text has as whole words, after the phrases of `blanked` are taken out; null without one."""
    fold = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    held = fold(X.normalise(text))
    for phrase in blanked:
        held = F.replace(held, fold(X.normalise(F.lit(phrase))), F.lit(" | "))  # what stands on both sides stays apart
    told = F.coalesce(*(F.when(F.contains(held, fold(X.normalise(F.lit(m)))), F.struct(F.lit(label).alias("label"), F.lit(m).alias("marker"))) for m, label in markers))
    return told


def missing_mentions(items: DataFrame, dictionary: DataFrame, closure: DataFrame, longest: int = 4) -> DataFrame:
    """(id, key, tag): entries that an item's title mentions and none of its lines carries.

    items: (id, title, lines array, slugs array); closure: (slug, above), each slug
    above itself. A mention is carried by a line whose slug has an ancestor of it
    (then both lie in one tree), or by a word of a line that shares the first five
    letters of one of its words, a doubled l counted once.
    """
    stem = lambda w: F.substring(F.replace(w, F.lit("ll"), F.lit("l")), 1, 5)
    stems = lambda c: F.array_distinct(F.transform(X.words(X.normalise(c)), stem))
    told = annotate(items.select("id", "title"), "id", F.col("title"), dictionary, longest).select("id", "at", "key", "tag")
    above = closure.select(F.col("slug").alias("tag"), "above")
    trees = items.select("id", F.explode(F.array_distinct(F.coalesce("slugs", F.array().cast("array<string>")))).alias("tag")).join(above, "tag").select("id", "above").distinct()
    related = told.join(above, "tag").join(trees, ["id", "above"], "left_semi").select("id", "at").distinct()
    words = items.select("id", stems(F.concat_ws(" ", "lines")).alias("held"))
    rest = told.join(related, ["id", "at"], "left_anti").join(words, "id").where(~F.arrays_overlap(stems(F.col("key")), F.col("held")))
    return rest.select("id", "key", "tag")

"""Inverted index and term matching, lexicon tags and record linkage by shared tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def inverted_index(rows: DataFrame, ident: str, text: Column) -> DataFrame:
    """(term, ident, tf) with folded, singular terms."""
    terms = F.transform(X.words(X.normalise(text)), X.singular)
    return rows.select(ident, F.explode(terms).alias("term")).groupBy("term", ident).agg(F.count("*").alias("tf"))


def match_all(index: DataFrame, ident: str, terms: list[str]) -> DataFrame:
    """(ident, hits): the rows that hold every term."""
    return index.where(F.col("term").isin(terms)).groupBy(ident).agg(F.count("*").alias("found"), F.sum("tf").alias("hits")).where(F.col("found") == len(set(terms))).select(ident, "hits")


def match_terms(rows: DataFrame, ident: str, text: Column, terms: list[str]) -> DataFrame:
    """(ident, hits) of the rows whose folded, singular words hold every term, without an index and without a shuffle; idents are unique."""
    written = {t + end for t in terms for end in ("", "s", "es")} | {t[:-1] + "ies" for t in terms if t.endswith("y")}  # what may become a term
    words = rows.select(ident, F.split(X.normalise(text), " ").alias("words"))
    near = words.select(ident, F.filter("words", lambda w: w.isin(*written)).alias("near"))
    held = near.select(ident, F.filter(F.transform("near", X.singular), lambda w: w.isin(*terms)).alias("held"))
    return held.where(F.size(F.array_distinct("held")) == len(set(terms))).select(ident, F.size("held").cast("long").alias("hits"))


def lexicon_tag(rows: DataFrame, ident: str, text: Column, lexicon: DataFrame, longest: int = 3) -> DataFrame:
    """(ident, tag, gram): the longest entry of (gram, tag) in the text, the rightmost of equals."""
    tokens = X.words(X.normalise(text))
    grams = F.flatten(F.array_compact(F.array(*(F.transform(X.ngrams(tokens, n), lambda g: F.struct(g["at"].alias("at"), g["gram"].alias("gram"))) for n in range(1, longest + 1)))))
    found = rows.select(ident, F.inline(grams)).join(F.broadcast(lexicon), "gram")
    return found.groupBy(ident).agg(F.max_by(F.struct("tag", "gram"), F.struct(F.size(F.split("gram", " ")), "at")).alias("best")).select(ident, "best.tag", "best.gram")


def _least_shared(n: Column, m: Column, need: float) -> Column:
    """How many tokens records of n and m tokens share at least if the mean of recall and precision is `need`."""
    return F.greatest(F.lit(1), F.ceil(F.lit(2 * need) * n * m / (n + m) - F.lit(1e-9))).cast("int")


def link_records(left: DataFrame, right: DataFrame, least: float = 0.5, veto: DataFrame | None = None, bonus: dict[str, float] | None = None) -> DataFrame:
    """(id, match, score) from (id, tokens[, category]) and (match, tokens), tokens distinct: the best match of each record, of equal scores the smallest.

    The score is the mean of recall and precision plus the `bonus` of the match's tokens. veto: (category, token): a match that has such a token is none
    for a record of the category that has none of them itself; it and `bonus` are written by hand and small. Candidates share a token of their
    prefixes: with tokens ordered from rare to common, two records of n and m tokens that share k must share one of the first n - k + 1 and m - k + 1, so
    a common token meets only records that are too short to do without it.
    """
    gains = bonus or {}
    need = max(least - sum(g for g in gains.values() if g > 0), 0.0)
    common = left.select(F.explode("tokens").alias("token")).unionByName(right.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("df"))

    def ordered(rows: DataFrame, ident: str) -> DataFrame:
        each = rows.select(ident, F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(common, "token")
        return each.groupBy(ident, "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("rare")).select(ident, "size", F.posexplode("rare").alias("at", "t")).select(ident, "size", "at", "t.token")

    sizes = right.select(F.size("tokens").alias("m")).where("m > 0").distinct()
    a = ordered(left, "id").withColumnRenamed("size", "n").withColumnRenamed("at", "p")
    a = a.join(F.broadcast(sizes), F.col("p") <= F.col("n") - _least_shared(F.col("n"), F.col("m"), need))  # a row for each length of text
    b = ordered(right, "match").withColumnRenamed("size", "m").withColumnRenamed("at", "q")
    pairs = a.join(b, ["token", "m"]).where(F.col("q") <= F.col("m") - _least_shared(F.col("n"), F.col("m"), need)).select("id", "match").distinct()
    own = left.select("id", F.col("tokens").alias("x"), *(["category"] if veto is not None else []))
    met = pairs.join(own, "id").join(right.select("match", F.col("tokens").alias("y")), "match")
    if veto is not None:
        told = veto.groupBy("category").agg(F.collect_set("token").alias("vetoed"))
        met = met.join(F.broadcast(told), "category", "left")
        met = met.where(F.coalesce(~F.arrays_overlap("y", "vetoed") | F.arrays_overlap("x", "vetoed"), F.lit(True)))
    shared = F.size(F.array_intersect("x", "y"))
    score = (shared / F.size("x") + shared / F.size("y")) / 2
    for token, gain in gains.items():
        score = score + F.when(F.array_contains("y", token), F.lit(gain)).otherwise(F.lit(0.0))
    scored = met.select("id", "match", score.alias("score")).where(F.col("score") >= least)
    return scored.groupBy("id").agg(F.min_by(F.struct("match", "score"), F.struct(-F.col("score"), "match")).alias("best")).select("id", "best.match", "best.score")

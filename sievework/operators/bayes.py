"""Naive Bayes over binary token presence, trained and scored as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def train(tokens: DataFrame, labels: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(label, token, loglik) and (label, logprior, logmiss) from (id, token), distinct, and (id, label); multinomial over presence with smoothing."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    counts = tokens.join(labels, "id").groupBy("label", "token").agg(F.count("*").alias("k"))
    width = counts.select("token").distinct().agg(F.count("*").alias("v"), F.lit(1).alias("one"))
    totals = counts.groupBy("label").agg(F.sum("k").alias("t"))
    n_all = labels.agg(F.count("*").alias("all"), F.lit(1).alias("one"))
    base = sizes.join(totals, "label").withColumn("one", F.lit(1)).join(F.broadcast(width), "one").join(F.broadcast(n_all), "one")
    priors = base.select("label", F.log(F.col("n") / F.col("all")).alias("logprior"), F.log(F.lit(alpha) / (F.col("t") + alpha * F.col("v"))).alias("logmiss"), (F.col("t") + alpha * F.col("v")).alias("mass"))
    logs = counts.join(F.broadcast(priors), "label").select("label", "token", F.log((F.col("k") + alpha) / F.col("mass")).alias("loglik"))
    return logs, priors.select("label", "logprior", "logmiss")


def score(tokens: DataFrame, logs: DataFrame, priors: DataFrame) -> DataFrame:
    """(id, label, posterior): a known token that a label never had counts as missing there; labels are few and broadcast."""
    known = logs.select("token").distinct()
    seen = tokens.join(known, "token", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    gains = tokens.join(logs, "token").groupBy("id", "label").agg(F.sum("loglik").alias("s"), F.count("*").alias("k"))
    labels = priors.agg(F.collect_list(F.struct("label", "logprior", "logmiss")).alias("all")).withColumn("one", F.lit(1))
    every = seen.withColumn("one", F.lit(1)).join(F.broadcast(labels), "one").select("id", "n", F.inline("all"))
    total = every.join(gains, ["id", "label"], "left").select("id", "label", (F.col("logprior") + F.coalesce("s", F.lit(0.0)) + (F.col("n") - F.coalesce("k", F.lit(0))) * F.col("logmiss")).alias("s"))
    each = Window.partitionBy("id")
    top = total.withColumn("top", F.max("s").over(each))
    return top.withColumn("z", F.sum(F.exp(F.col("s") - F.col("top"))).over(each)).select("id", "label", (F.exp(F.col("s") - F.col("top")) / F.col("z")).alias("posterior"))


def predict(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, label, posterior): the best label, or `unknown` under the threshold."""
    best = scores.groupBy("id").agg(F.max_by(F.struct("label", "posterior"), F.struct("posterior", "label")).alias("b"))
    return best.select("id", F.when(F.col("b.posterior") >= threshold, F.col("b.label")).otherwise("unknown").alias("label"), F.col("b.posterior").alias("posterior"))

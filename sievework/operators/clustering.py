"""Leader clustering inside a blocking key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import staged


def _lead(share: float):
    def clustered(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("score", "descending"), ("id", "ascending")])
        sets = rows["members"].combine_chunks()
        words, sizes = sets.flatten().dictionary_encode(null_encoding="encode"), pc.fill_null(sets.value_lengths(), 0).to_numpy(zero_copy_only=False)
        codes, kinds = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
        rare = np.empty(kinds, np.int64)
        rare[np.argsort(np.bincount(codes, minlength=kinds), kind="stable")] = np.arange(kinds)
        members = np.unique(np.repeat(np.arange(len(sizes)), sizes) * kinds + rare[codes])  # of each row, from rare to common
        sizes = np.bincount(members // kinds, minlength=len(sizes))
        ends, members = np.cumsum(sizes), members % kinds
        # Sets that are similar share `least` members at least, so one of the rarest of each; what is no leader is not looked for.
        least = np.ceil(share * sizes).astype(np.int64)
        fronts = sizes - np.maximum(least, 1) + 1
        near: dict[int, list[int]] = {}
        held, leader, empty = np.zeros(kinds, bool), np.arange(len(sizes)), None
        for i, (end, size, front) in enumerate(zip(ends.tolist(), sizes.tolist(), fronts.tolist())):
            if not size:
                empty = leader[i] = i if empty is None else empty
                continue
            own = members[end - size : end]
            rarest = own[:front].tolist()
            met = np.array(sorted({j for w in rarest for j in near.get(w, ())}), np.int64)
            met = met[np.minimum(size, sizes[met]) >= share * np.maximum(size, sizes[met])]
            held[own] = True
            for j in met.tolist():
                both = np.count_nonzero(held[members[ends[j] - sizes[j] : ends[j]]])
                if both >= share * (size + sizes[j] - both):
                    leader[i] = j
                    break
            else:
                for w in rarest:
                    near.setdefault(w, []).append(i)
            held[own] = False
        return pa.table({"id": rows["id"], "leader": rows["id"].take(pa.array(leader))})

    return clustered


def leader_clusters(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """(id, leader, size) from (id, title, score, members): best first, a row joins the first leader of its title that is similar enough.

    Empty titles never cluster, nor do titles that stand alone: neither goes to
    Python. Equal sets of one title are one row there, with the best id
    standing for all, so copies do not swell a group. A row is compared with the
    leaders that have one of its rarest members among theirs; share is over 0.
    """
    rows = rows.withColumn("members", F.sort_array("members")).withColumn("own", F.md5(F.array_join("members", "\n", "\0")))
    rows = staged(rows, "titled")  # texts are read and folded once
    open_ = rows.where("title <> ''")
    head = F.max_by("id", F.struct("score", -F.col("id")))
    kinds = open_.groupBy("title", "own").agg(head.alias("head"))
    several = kinds.groupBy("title").count().where("count > 1").select("title")
    # Members are dealt once, by title.
    met = open_.join(several, "title", "left_semi").groupBy("title", "own").agg(head.alias("id"), F.max("score").alias("score"), F.first("members").alias("members"))
    led = met.groupBy("title").applyInArrow(_lead(share), "id long, leader long")
    heads = open_.select("id", "title", "own").join(kinds, ["title", "own"]).select("id", "head")
    placed = heads.join(led.withColumnRenamed("id", "head"), "head", "left").select("id", F.coalesce("leader", "head").alias("leader"))
    placed = placed.unionByName(rows.where("title = ''").select("id", F.col("id").alias("leader")))
    placed = staged(placed, "placed")
    return placed.join(placed.groupBy("leader").agg(F.count("*").alias("size")), "leader").select("id", "leader", "size")

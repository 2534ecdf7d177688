"""N-gram Jaccard self-join with adaptive multi-match prefixes, down to components.

A document is the set of its distinct word shingles. Documents with equal sets
form a class, and only classes are compared. Shingles stand in one global
order of three tiers. A share of all shingles, drawn by hash, comes first, the
rarest leading: classes send all of these, and their ranges count them. Other
shingles follow by hash, and those that the corpus repeats much come last, by
their count; of these two tiers a class sends only what its prefix needs.

A class's prefix is the front of its ordered set. If two sets reach the
threshold, prefixes that leave out all but `need - m` shingles share m of them,
so a class whose short prefix would meet many candidates takes a longer one
(m up to `most`) and asks for m shared shingles. A pair is verified only with
the smaller m of the two shared, with fitting sizes, if what lies beyond the
prefixes can still make up the missing overlap, and if counts of shingles by
hash bin leave room for it.

A group of near copies does not become all its pairs. Classes of shingles that
more than CROWD classes sent get a leader, the one whose prefix is most shared,
and are written as what they lack of the leader's set and what they have beyond
it. Two classes of one leader overlap by the leader's size, less what either
lacks, plus the differences that they share. So those that reach the threshold
with the leader are one component, and any other pair that reaches it must
share a number of differences that sizes tell; it is found by a prefix join on
these. Prefixes of shingles then only pair classes of different leaders and
components, all of them.

Null or empty text has an empty set and is linked with nothing. Equal texts are
one class. Rows with equal doc_ids are kept; a null doc_id is a component of
its own where its set is empty and otherwise takes part without naming one. An
empty table gives no rows; other columns of the input are left behind.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gather_ranges, give_back, materialize, mix, pack_planes, pack_sorted, span_hashes, text_bytes, unpack_planes, unpack_sorted
from .components import components
from .repeats import word_spans
from .tokenizing import text_slices

#: Shares of all shingles from which a shingle's count is kept; bounds the broadcast to 1 / FREQUENT entries.
FREQUENT = 2e-6
#: Shingles that a task counts at a time, and the count from which it reports one.
COUNTED, REPORTED = 2_000_000, 3
#: The share of shingles in the first tier, in prefixes; and how many of them a range holds.
FRONT, RANGE = 2.5, 500_000
#: Classes of a shingle from which they are compared by their differences from a leader.
CROWD = 32
#: Bins of a set's counts at most, as a power of two.
BINS = 12
_NO_ID = np.iinfo(np.int64).max


class Sets:
    """The shingle sets of some texts, as one array of hashes sorted within each text."""

    def __init__(self, texts: pa.Array, width: int):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
        raw = raw + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
        offsets = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        starts, ends = word_spans(raw, offsets)
        words = span_hashes(raw, starts, ends)
        upto = np.searchsorted(starts, offsets)
        n_words = np.diff(upto)
        n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
        begin = gather_ranges(upto[:-1], n)
        hashes = span_hashes(words, begin, begin + np.repeat(np.minimum(n_words, width), n))
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = hashes[new], owner[new]
        self.size = np.bincount(self.owner, minlength=len(n))
        self.ends = np.cumsum(self.size)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.hashes))])
        ends = np.concatenate([[0], self.ends])
        #: A set's class: a hash of the sum of its scrambled members.
        self.classes = mix(total[ends[1:]] - total[ends[:-1]] + self.size.astype(np.uint64)).view(np.int64)

    def bins(self) -> list[bytes]:
        """How many members lie in each bin of hashes, about four a bin; 255 stands for that many and more."""
        bits = np.clip(np.ceil(np.log2(np.maximum(self.size, 1) / 4)), 2, BINS).astype(np.int64)
        width = 1 << bits
        base = np.cumsum(width) - width
        at = base[self.owner] + (self.hashes >> (64 - bits[self.owner]).astype(np.uint64)).astype(np.int64)
        counts = np.minimum(np.bincount(at, minlength=int(width.sum())), 255).astype(np.uint8).tobytes()
        return [counts[b : b + w] for b, w in zip(base.tolist(), width.tolist(), strict=True)]


def _sets_of(batches, width: int, *columns: str):
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        for lo, hi in text_slices(sizes, 2 << 20):
            yield Sets(batch.column("text")[lo:hi], width), *(batch.column(c)[lo:hi] for c in columns)
        give_back()


_SURVEY = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("bins", pa.binary()), ("shingle", pa.int64()), ("often", pa.int64())])


def _survey(width: int):
    """Each row's set size, class and counts by bin, and the shingles that are frequent among the COUNTED at hand, with their counts."""

    def batch(**some) -> pa.RecordBatch:
        rows = len(next(iter(some.values())))
        return pa.RecordBatch.from_arrays([pa.array(some[f.name], f.type) if f.name in some else pa.nulls(rows, f.type) for f in _SURVEY], schema=_SURVEY)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        shingle, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= REPORTED
        return batch(shingle=shingle[keep].view(np.int64), often=n[keep])

    def rows(batches):
        held, n = [], 0
        for sets, doc_id, own in _sets_of(batches, width, "doc_id", "own"):
            yield batch(doc_id=doc_id, own=own, n=sets.size, cls=sets.classes, bins=sets.bins())
            held.append(sets.hashes)
            n += len(sets.hashes)
            if n >= COUNTED:
                yield counted(held)
                held, n = [], 0
        if held:
            yield counted(held)

    return rows


def need(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The least overlap of a set of n with any set that reaches the threshold."""
    return -(-n * share[0] // share[1])


def _fronts(width: int, share: tuple[int, int], most: int, ranges: int, front: int, often):
    """Packed by range: the first tier of each class, and what the longest prefix needs of the other two with its place in the order.

    A place in the first tier is not known yet and stands as -1. Shingles of the last tier have their count in `heat`, else 0.
    """

    def rows(batches):
        frequent, counts = often.value
        for (sets,) in _sets_of(batches, width):
            _, first = np.unique(sets.classes, return_index=True)  # copies send one prefix
            keep = np.zeros(len(sets.size), bool)
            keep[first] = True
            inside = keep[sets.owner]
            hashes, owner = sets.hashes[inside], sets.owner[inside]
            at = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
            heat = np.where(frequent[at] == hashes, counts[at], 0) if len(frequent) else np.zeros(len(hashes), np.int64)
            tier = np.where(heat > 0, 2, (hashes > np.uint64(front)).astype(np.int64))
            order = np.lexsort((hashes, heat, tier, owner))
            hashes, owner, heat, tier = hashes[order], owner[order], heat[order], tier[order]
            size = np.bincount(owner, minlength=len(keep))
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            n_front = np.bincount(owner, tier == 0, len(keep)).astype(np.int64)
            send = (tier == 0) | (place < (size - need(size, share) + most)[owner])
            hashes, owner, heat, place = hashes[send], owner[send], heat[send], np.where(tier == 0, -1, place)[send]
            part = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.lexsort((hashes, part))
            hashes, owner, part, heat, place = hashes[order], owner[order], part[order], heat[order], place[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            out: dict[str, list] = {n: [] for n in ("part", "shingles", "who", "place", "heat", "classes", "sizes", "fronts")}
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    docs, who = np.unique(owner[a:b], return_inverse=True)
                    packed = (int(part[a]), pack_sorted(hashes[a:b]), pack_planes(who.astype(np.int32)), pack_planes(place[a:b].astype(np.int32)), pack_planes(heat[a:b].astype(np.int64)), sets.classes[docs].tobytes(), pack_planes(size[docs].astype(np.int64)), pack_planes(n_front[docs]))
                    for name, value in zip(out, packed, strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64() if n == "part" else pa.binary()) for n, v in out.items()})

    return rows


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    """The postings of shingles that several classes sent, with the number of classes."""
    lists = rows.to_pydict()
    parts = [
        (unpack_sorted(s), unpack_planes(w, np.int32), unpack_planes(p, np.int32), unpack_planes(h, np.int64), np.frombuffer(c, np.int64), unpack_planes(n, np.int64), unpack_planes(f, np.int64))
        for s, w, p, h, c, n, f in zip(*(lists[x] for x in ("shingles", "who", "place", "heat", "classes", "sizes", "fronts")), strict=True)
    ]
    shingle, place, heat = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
    cls, size, front = (np.concatenate([p[i][p[1]] for p in parts]) for i in (4, 5, 6))
    order = np.lexsort((cls, shingle))
    same = shingle[order][1:] == shingle[order][:-1]
    order = order[np.concatenate([[True], ~same | (cls[order][1:] != cls[order][:-1])])]
    first = np.concatenate([[True], shingle[order][1:] != shingle[order][:-1]])
    group = np.cumsum(first) - 1
    kinds = np.bincount(group)[group]
    order, kinds = order[kinds > 1], kinds[kinds > 1]
    return pa.table({"shingle": pa.array(shingle[order].view(np.int64)), "cls": pa.array(cls[order]), "n": pa.array(size[order]), "front": pa.array(front[order]), "place": pa.array(place[order].astype(np.int64)), "heat": pa.array(np.maximum(heat[order], kinds))})


def _chosen(share: tuple[int, int], most: int):
    """The prefixes of the classes of a portion: places in the first tier come from its counts, and each class takes the m that costs least."""

    def rows(key: tuple, table: pa.Table) -> pa.Table:
        shingle, cls, n, front, place, heat = (table[c].to_numpy() for c in ("shingle", "cls", "n", "front", "place", "heat"))
        order = np.lexsort((shingle, heat, place >= 0, cls))
        shingle, cls, n, front, place, heat = (x[order] for x in (shingle, cls, n, front, place, heat))
        new = np.concatenate([[True], cls[1:] != cls[:-1]])
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        early = place < 0
        shared = np.add.reduceat(early.astype(np.int64), at)
        # What no other class has leads the first tier.
        place = np.where(early, front - shared[group] + np.arange(len(cls)) - at[group], place)
        least = need(n, share)
        free = n - least
        read = np.bincount(group, np.where(place <= free, heat, 0), len(at))
        best, matches = read + read, np.ones(len(at), np.int64)
        for m in range(2, most + 1):
            # Posting entries read for m = 1, and what each further m adds to that and saves in verified pairs.
            cost = np.bincount(group, np.where(place < free + m, heat, 0), len(at)) + read / m**2
            better = (cost < best) & (least[at] >= m)
            best, matches = np.where(better, cost, best), np.where(better, m, matches)
        m = matches[group]
        inside = place < free + m
        return pa.table({"shingle": pa.array(shingle[inside]), "cls": pa.array(cls[inside]), "n": pa.array(n[inside]), "m": pa.array(m[inside]), "warm": pa.array(np.bincount(group, np.where(inside, heat, 0), len(at)).astype(np.int64)[group[inside]])})

    return rows


def _members(width: int):
    def rows(batches):
        for (sets,) in _sets_of(batches, width):
            values = pa.array(sets.hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sets.classes), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sets.ends]), pa.int32()), values)], names=["cls", "members"])

    return rows


def _room(x: bytes, y: bytes) -> float:
    """How many members two sets can share at most by their counts in bins."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    b = np.minimum(b.reshape(len(a), -1).sum(axis=1), 255)
    low = np.minimum(a, b)
    return math.inf if low.max() == 255 else int(low.sum())


def _bounded(share: tuple[int, int]):
    def rows(batches):
        for batch in batches:
            room = np.array([_room(a, b) for a, b in zip(batch.column("x_bins").to_pylist(), batch.column("y_bins").to_pylist(), strict=True)])
            total = batch.column("xn").to_numpy() + batch.column("yn").to_numpy()
            mask = pa.array(room * (share[0] + share[1]) >= share[0] * total, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("x", "y", "xn", "yn")], names=["x", "y", "xn", "yn"])

    return rows


def _small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """Asks for a broadcast of a written table of a few numbers a row while it has at most `limit` rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


class Corpus:
    """The classes of a corpus, and how pairs of them are verified."""

    def __init__(self, docs: DataFrame, members: DataFrame, width: int, share: tuple[int, int]):
        self.docs, self.members, self.width, self.share = docs, members, width, share

    def postings(self, most: int, often) -> DataFrame:
        """The prefixes of all classes, of shingles that several classes have sent."""
        front = min(1.0, FRONT * (1 - self.share[0] / self.share[1]))
        size = text_bytes(self.docs)
        ranges = max(1, math.ceil(size * front / 6 / RANGE))
        sent = self.docs.select("text").mapInArrow(_fronts(self.width, self.share, most, ranges, min(int(front * 2**64), 2**64 - 1), often), "part long, shingles binary, who binary, place binary, heat binary, classes binary, sizes binary, fronts binary")
        shared = sent.groupBy("part").applyInArrow(_shared, "shingle long, cls long, n long, front long, place long, heat long")
        dealt = shared.withColumn("portion", F.pmod("cls", F.lit(ranges)))
        return materialize(dealt.groupBy("portion").applyInArrow(_chosen(self.share, most), "shingle long, cls long, n long, m long, warm long"), "postings")

    def sets(self, pick: DataFrame) -> DataFrame:
        """The members of the classes in pick, as a written table."""
        first = self.members.join(pick, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "own")).alias("first"))
        wanted = _small(materialize(first.select("first.*").distinct(), "wanted"))
        held = self.docs.select("text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "own").join(wanted, ["doc_id", "own"], "left_semi")
        return materialize(held.select("text").mapInArrow(_members(self.width), "cls long, members array<long>").dropDuplicates(["cls"]), "sets")

    def links(self, pairs: DataFrame, bins: DataFrame) -> DataFrame:
        """Of pairs (x, y, xn, yn) of classes those that reach the threshold, as a written table."""
        of = lambda side: bins.select(F.col("cls").alias(side), F.col("bins").alias(f"{side}_bins"))
        near = materialize(pairs.select("x", "y", "xn", "yn").join(of("x"), "x").join(of("y"), "y").mapInArrow(_bounded(self.share), "x long, y long, xn long, yn long"), "pairs")
        sets = self.sets(near.select(F.col("x").alias("cls")).union(near.select("y")).distinct())
        side = lambda s: sets.select(F.col("cls").alias(s), F.col("members").alias(f"{s}_members"))
        both = F.size(F.array_intersect("x_members", "y_members"))
        found = near.join(side("x"), "x").join(side("y"), "y").where(self.share[1] * both >= self.share[0] * (F.col("xn") + F.col("yn") - both))
        return materialize(found.select("x", "y"), "links")

    def differences(self, groups: DataFrame) -> DataFrame:
        """Each class (cls, n, grp, grp_n) with its differences from the leader grp, as a written table.

        Two classes of a leader reach the threshold if `unit` times the differences that they share is at least the sum of their `owed`;
        the leader owes `least`.
        """
        a, b = self.share
        sets = self.sets(groups.select("cls"))
        lead = sets.select(F.col("cls").alias("grp"), F.col("members").alias("led"))
        lacks, more = F.array_except("led", "members"), F.array_except("members", "led")
        rows = groups.join(sets, "cls").join(lead, "grp").select("cls", "n", "grp", "grp_n", F.size(lacks).alias("lacks"), F.concat(F.transform(lacks, F.bitwise_not), more).alias("marks"))
        owed = 2 * a * F.col("n") - (a + b) * F.col("grp_n") + 2 * (a + b) * F.col("lacks")
        rows = rows.select("cls", "n", "grp", F.lit(2 * (a + b)).alias("unit"), owed.alias("owed"), ((a - b) * F.col("grp_n")).alias("least"), F.size("marks").alias("all"), "marks")
        return materialize(rows.withColumn("far", F.col("owed") + F.col("least") > 0), "differences")


def _groups(crowded: DataFrame) -> DataFrame:
    """A leader for each class of crowded shingles: of the shingles' leaders the one whose prefix is most shared."""
    lead = crowded.groupBy("shingle").agg(F.max(F.struct("warm", "cls", "n")).alias("lead"))
    led = crowded.join(lead, "shingle").groupBy("cls", "n").agg(F.max("lead").alias("lead"))
    return materialize(led.select("cls", "n", F.col("lead.cls").alias("grp"), F.col("lead.n").alias("grp_n")), "groups")


def _by_differences(held: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs of one leader, at least one of them far from it, that may reach the threshold: by a prefix join on their differences."""
    marks = held.select("cls", "n", "grp", "unit", "owed", "least", "all", "far", F.explode("marks").alias("mark"))
    counts = marks.groupBy("grp", "mark").agg(F.count("*").alias("heat")).where("heat > 1")
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.coalesce("heat", F.lit(1)), "mark"))
    # A far class has any other for a partner, a near one only far ones, which owe more than -least.
    shared = F.when(F.col("far"), F.ceil((F.col("owed") + F.col("least")) / F.col("unit"))).otherwise(F.floor((F.col("owed") - F.col("least")) / F.col("unit")) + 1)
    placed = marks.join(counts, ["grp", "mark"], "left").withColumn("place", rank).where((F.col("heat") > 1) & (F.col("place") + shared <= F.col("all") + 1))
    side = lambda s: placed.select("grp", "mark", "unit", *(F.col(c).alias(f"{s}{c}") for c in ("cls", "n", "owed", "all", "far", "place")))
    both = F.ceil((F.col("xowed") + F.col("yowed")) / F.col("unit"))
    reach = lambda s: F.col(f"{s}place") + both <= F.col(f"{s}all") + 1
    found = side("x").join(side("y").drop("unit"), ["grp", "mark"]).where("xfar and xcls <> ycls and (not yfar or xcls < ycls)").where(_fits(share)).where(reach("x") & reach("y"))
    return found.select(F.col("xcls").alias("x"), F.col("ycls").alias("y"), "xn", "yn").distinct()


def _opened(postings: DataFrame, label: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """The postings of shingles that stand in several components and under several leaders."""
    named = postings.withColumn("comp", F.col("cls")).withColumn("grp", F.col("cls"))
    if label is not None:
        named = postings.join(label, postings.cls == label.node, "left").join(groups.select("cls", "grp"), "cls", "left").select(*postings.columns, F.coalesce("label", "cls").alias("comp"), F.coalesce("grp", "cls").alias("grp"))
    several = named.groupBy("shingle").agg(F.count("*").alias("k"), *(f(c).alias(f"{c}_{n}") for c in ("comp", "grp") for n, f in (("min", F.min), ("max", F.max))))
    return materialize(named.join(several.where("comp_min <> comp_max and grp_min <> grp_max").select("shingle", "k"), "shingle"), "open")


def _fits(share: tuple[int, int]) -> F.Column:
    return share[1] * F.least("xn", "yn") >= share[0] * F.greatest("xn", "yn")


def jaccard_components(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), most: int = 4, keyed: bool = False) -> DataFrame:
    """Every row's doc_id, n_shingles and component_id: the smallest doc_id that links of Jaccard similarity share[0] / share[1] or more reach.

    With keyed, each row's doc_id, own, n_shingles and comp instead: own is a hash of its text, comp names its component, null for an empty set.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("own"))
    survey = materialize(docs.mapInArrow(_survey(width), "doc_id long, own long, n long, cls long, bins binary, shingle long, often long"), "survey")
    members = survey.where("cls is not null").select("doc_id", "own", "n", "cls")
    total = members.agg(F.sum("n")).head()[0] or 0
    found = survey.where("shingle is not null").groupBy("shingle").agg(F.sum("often").alias("n")).where(F.col("n") >= max(2, FREQUENT * total)).toArrow()
    frequent = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    often = spark.sparkContext.broadcast((frequent[order], found["n"].to_numpy()[order]))
    corpus = Corpus(docs, members, width, share)
    open_ = _opened(corpus.postings(most, often))
    often.unpersist()
    bins = materialize(survey.where("n > 0").select("cls", "bins").join(open_.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "bins")

    near, label = None, None
    crowded = open_.where(F.col("k") > CROWD)
    if not crowded.isEmpty():
        groups = _groups(crowded)
        held = corpus.differences(groups)
        near = held.where("not far and cls <> grp").select(F.col("grp").alias("x"), F.col("cls").alias("y")).unionByName(corpus.links(_by_differences(held, share), bins))
        label = _small(components(near))
        open_ = _opened(open_.drop("comp", "grp", "k"), label, _small(groups))

    side = lambda s: open_.select("shingle", *(F.col(c).alias(f"{s}{c}") for c in ("cls", "n", "m", "comp", "grp")))
    beyond = lambda s: F.ceil(F.lit(share[0]) * F.col(f"{s}n") / share[1]) - F.col(f"{s}m")  # noqa: E731  of a set outside its prefix
    pairs = (
        side("x").join(side("y"), "shingle").where("xcls < ycls and xcomp <> ycomp and xgrp <> ygrp").where(_fits(share))
        .groupBy(F.col("xcls").alias("x"), F.col("ycls").alias("y")).agg(F.count("*").alias("shared"), *(F.first(c).alias(c) for c in ("xn", "yn", "xm", "ym")))
        .where(F.col("shared") >= F.least("xm", "ym"))
        .where((F.col("shared") + F.greatest(beyond("x"), beyond("y"))) * (share[0] + share[1]) >= share[0] * (F.col("xn") + F.col("yn")))
    )
    far = corpus.links(pairs, bins)
    if near is None or not far.isEmpty():
        label = components(far if near is None else near.unionByName(far))

    comp = members.where("n > 0").join(label, members.cls == label.node, "left").select("doc_id", "own", "n", F.coalesce("label", "cls").alias("comp"))
    if keyed:
        return comp.unionByName(members.where("n = 0").select("doc_id", "own", "n", F.lit(None).cast("long").alias("comp"))).withColumnRenamed("n", "n_shingles")
    least = comp.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = comp.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, share=(90, 100))

"""A Merkle manifest of a dataset, with a proof for every row.

The rows of a source are the leaves of one tree, in the order of doc_id; three
neighbouring nodes make one of the next level, and the trees' roots, in the
order of their sources, make one more tree. Every node is labelled with the
interval of leaf ranks that it covers. Ranks come from range partitions and
prefix sums of their counts, so no task holds a source. Three levels at a time
are folded in blocks of 27 neighbours. Going down again, a block meets what
lies above it by its bucket (the block of the next levels that covers it, whose
interval contains its own), and a node's siblings are what its parent's interval
covers besides its own: those that end before it, and those that begin after it.

A null field is told from an empty one. Rows without a source make a tree of
their own, the first; rows without a doc_id are the first leaves of their tree and
are never tampered with. Rows that share a doc_id stand in the order of their
hashes; equal rows are leaves of their own. A source of one row has that leaf as
its root, one source its root as the root of all. No rows give no rows. Columns
beyond those of the leaf take no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels folded at once, and how many leaves a block of them covers.
BAND = 3
WIDE = 3**BAND
#: Powers of three that a 64-bit count can exceed.
_POWERS = [3**i for i in range(40)]

Bands = list[DataFrame]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """The hash of a row's fields; `changed` replaces some of them."""
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def ranked(df: DataFrame, tree: str, order: list[str], label: str) -> DataFrame:
    """df with each row's rank in its tree, from 0, and the tree's size n: ranges of all rows are counted, and a range's first rank is a prefix sum."""
    ranged = df.repartitionByRange(tree, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, label)
    counts = ranged.groupBy(tree, "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(tree, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"), F.sum("_rows").over(Window.partitionBy(tree)).alias("n"))
    place = F.row_number().over(Window.partitionBy(tree, "_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(counts, [tree, "_part"]).withColumn("rank", F.col("_base") + F.col("_place") - 1).drop("_part", "_place", "_base", "_rows")


def _folded(nodes: Column) -> Column:
    """The parents of a block's nodes."""
    def parent(i):
        kids = F.slice(nodes, i * 3 + 1, F.lit(3))
        return F.struct(kids[0].lo.alias("lo"), F.element_at(kids, -1).hi.alias("hi"), F.sha2(F.array_join(F.transform(kids, lambda k: k.digest), ""), 256).alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 3).cast("int")), parent)


def build(leaves: DataFrame, label: str) -> tuple[Bands, DataFrame]:
    """From leaves (tree, rank, n, digest, data): the bands of blocks from the leaves up, and the root (tree, lo, hi, digest) of each tree.

    A block has its interval lo to hi, its `bucket`, its nodes of every level (level0 to level3) and how many levels of them are in use.
    """
    most = leaves.agg(F.max("n")).head()[0]
    height = F.size(F.filter(F.array(*(F.lit(p) for p in _POWERS)), lambda p: p < F.col("n")))
    nodes = leaves.select("tree", height.alias("height"), F.struct(F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "data").alias("node"))
    bands: Bands = []
    for b in range(max(1, math.ceil(sum(p < (most or 0) for p in _POWERS) / BAND))):
        bucket = F.floor(F.col("node.lo") / F.lit(WIDE ** (b + 1))) if b < 12 else F.lit(0)
        bare = F.struct("node.lo", "node.hi", "node.digest")
        blocks = nodes.groupBy("tree", "height", bucket.cast("long").alias("bucket")).agg(F.array_sort(F.collect_list("node" if b == 0 else bare)).alias("level0"))
        blocks = blocks.withColumn("levels", F.least(F.lit(BAND), F.greatest(F.lit(0), F.col("height") - BAND * b)))
        blocks = blocks.withColumn("lo", F.col("level0")[0].lo).withColumn("hi", F.element_at("level0", -1).hi)
        plain = F.transform("level0", lambda k: F.struct(k.lo.alias("lo"), k.hi.alias("hi"), k.digest.alias("digest")))
        for i in range(BAND):
            last = plain if i == 0 else F.col(f"level{i}")
            blocks = blocks.withColumn(f"level{i + 1}", F.when(F.col("levels") > i, _folded(F.col(f"level{i}"))).otherwise(last))
        bands.append(materialize(blocks, f"{label}-band{b}"))
        nodes = bands[-1].select("tree", "height", F.col(f"level{BAND}")[0].alias("node"))
    return bands, nodes.select("tree", "node.*")


def _within(part: Column, whole: Column) -> Column:
    return (part.lo >= whole.lo) & (part.hi <= whole.hi)


def _step(level: int, node: Column) -> Column:
    """What stands beside a node's ancestor of a level in their parent's interval: before it and after it."""
    parent = F.filter(f"level{level + 1}", lambda p: _within(node, p))[0]
    digests = lambda test: F.array_join(F.transform(F.filter(f"level{level}", test), lambda k: k.digest), "")
    before, after = lambda k: _within(k, parent) & (k.hi <= node.lo), lambda k: _within(k, parent) & (k.lo >= node.hi)
    return F.struct(digests(before).alias("left"), digests(after).alias("right"))


def paths(bands: Bands, roots: DataFrame) -> DataFrame:
    """The leaves (tree, node, carry, path): a step for each level up to the tree's root, then the path that `roots` (tree, lo, hi, carry, path) has for that root."""
    above = roots
    for b in range(len(bands) - 1, -1, -1):
        bucket = F.floor(F.col("lo") / F.lit(WIDE ** (b + 1))) if b < 12 else F.lit(0)
        up = above.select("tree", bucket.cast("long").alias("bucket"), F.struct("lo", "hi").alias("cover"), "carry", F.col("path").alias("rest"))
        met = bands[b].join(up, ["tree", "bucket"]).where((F.col("lo") >= F.col("cover.lo")) & (F.col("hi") <= F.col("cover.hi")))

        def with_steps(node):
            steps = (F.when(F.col("levels") > i, F.array(_step(i, node))).otherwise(F.array().cast("array<struct<left:string,right:string>>")) for i in range(BAND))
            return F.struct(node.alias("node"), F.concat(*steps).alias("steps"))

        below = met.select("tree", "carry", "rest", F.explode(F.transform("level0", with_steps)).alias("x"))
        below = below.select("tree", F.col("x.node").alias("node"), "carry", F.concat("x.steps", "rest").alias("path"))
        above = below.select("tree", "node.lo", "node.hi", "carry", "path")
    return below


def manifest(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, leaf, checked (the hash to check), subroot, root and its path to the root.

    `docs` may carry a column `checked` of hashes to fold instead of the leaves.
    """
    keep = docs.select(*FIELDS, *(["checked"] if "checked" in docs.columns else []))
    tree = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = keep.select(tree.alias("tree"), F.col("doc_id"), leaf_hash().alias("digest"), (F.col("checked") if "checked" in keep.columns else F.lit(None).cast("string")).alias("checked"))
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")  # ties are equal rows, whose order changes nothing
    leaves = ranked(rows, "tree", ["doc_id", "digest", "tie"], "ranges").withColumn("data", F.struct("doc_id", F.coalesce("checked", "digest").alias("checked")))
    bands, subroots = build(leaves, "leaves")
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "lo", "hi", "digest")
    tops = ranked(tops, "tree", ["source"], "tops").withColumn("data", F.struct("source", "lo", "hi"))
    bands_above, root = build(tops, "tops")
    root = root.select("tree", "lo", "hi", F.struct(F.col("digest").alias("root")).alias("carry"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    over = paths(bands_above, root).select(F.col("node.data.source").alias("tree"), "node.data.lo", "node.data.hi", F.struct("carry.root", F.col("node.digest").alias("subroot")).alias("carry"), "path")
    return paths(bands, over).select("node.data.doc_id", F.col("node.digest").alias("leaf"), "node.data.checked", "carry.subroot", "carry.root", "path")


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s.left, digest, s.right), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_hash(text=F.replace("text", F.lit("\n"), F.lit(""))))
    rows = manifest(docs.withColumn("checked", tampered)).withColumn("folded_root", fold(F.col("checked"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Main text of pages by wrapper induction.

Every page becomes a reduced DOM tree (`dom.py`). The distinct trees of a host
are aligned by simple tree matching and united, some dozens at a time until one
tree is left, the host's template; each distinct tree is then aligned with it,
so that a node of a page is a slot of its host. Over all pages of the host a
slot has its mass (characters, and those in links) and its texts. A text is
constant where it stands in one slot of most of the host's pages; pages with
the same longest block count once, so copies of an article make nothing
constant. Constant text is template, varying slots are content or furniture:
the slots in article or main elements, or else below the deepest node that
holds most of the unlinked mass, without those whose tag, class, id or role
names a menu, header, footer, sidebar, notice, advert, form or comments, and
without lists of links. Where more than half of a page's content would be
constant, it is kept: that is a host of copies, not a template.

Blocks are parted by block elements and line breaks. Headings of a header
within the article stay. Null and empty html, and pages without content, give an
empty text. Pages without a host in their url are a host of their own. Repeated
rows stay; a page's result depends on its html and on its host's pages only.
Columns other than page_id, url and html take no part.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize
from .dom import Node, Page, mapping, nodes, read, union, written

#: Distinct trees united in one group.
GROUP = 32
#: A text is constant in so many different pages at least, and in this share of a host's.
LEAST_PAGES, SHARE = 10, 0.7
#: The share of unlinked mass that the main node must hold, and of linked mass that makes a list of links.
MAIN, LINKED = 0.75, 0.8

_TAGS = frozenset("head nav header footer aside form button select option label fieldset dialog menu search noscript template object svg canvas video audio map".split())
_ROLES = frozenset("role-" + r for r in "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_HEADERS = frozenset("header masthead".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside widget widgets related recommended recommendations share sharing social newsletter subscribe subscription signup login footer header masthead topbar comment comments commentlist respond reply "
    "replies disqus pagination pager toolbar skip copyright form".split()
)
_BEGINNINGS = ("sidebar", "advert", "comment", "cookie", "newsletter", "breadcrumb", "footer", "navbar", "sponsor", "popup", "banner", "masthead")
#: What an article element must be named to be none.
_NO_ARTICLE = frozenset("comment comments reply replies related teaser promo ad ads advert sponsored".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_PAGE = "page_id long, url string, host string, shape string, tree string, print long, blocks array<struct<node:int,hash:long,links:int,text:string>>"
_PAGE_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("shape", pa.string()), ("tree", pa.string()), ("print", pa.int64()), ("blocks", pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("links", pa.int32()), ("text", pa.string())])))])


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _row(page_id, url, host, html) -> dict:
    page = Page(html or "")
    node = {b: i for i, x in enumerate(nodes(page.tree)) for b in x.blocks}
    tree = written(page.tree)
    hashes = [_hash(t) for t in page.texts]
    longest = max(range(len(hashes)), key=lambda i: (len(page.texts[i]), -i), default=None)
    blocks = [{"node": node[i], "hash": h, "links": n, "text": t} for i, (h, n, t) in enumerate(zip(hashes, page.links, page.texts, strict=True))]
    return {"page_id": page_id, "url": url, "host": host, "shape": hashlib.md5(tree.encode()).hexdigest(), "tree": tree, "print": 0 if longest is None else hashes[longest], "blocks": blocks}


def _parsed(batches):
    for batch in batches:
        rows, size = [], 0
        for page_id, url, host, html in zip(*(batch.column(c) for c in ("page_id", "url", "host", "html")), strict=True):
            rows.append(_row(page_id.as_py(), url.as_py(), host.as_py(), html.as_py()))
            size += sum(len(b["text"]) + 40 for b in rows[-1]["blocks"]) + len(rows[-1]["tree"])
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=_PAGE_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_PAGE_ARROW)
    give_back()


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _united(key: tuple, rows: pa.Table) -> pa.Table:
    trees = sorted(rows.column("tree").to_pylist())
    whole = read(trees[0])
    for t in trees[1:]:
        whole = union(whole, read(t))
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "tree": pa.array([written(_bare(whole))], pa.string())})


def _bare(tree: Node) -> Node:
    for x in nodes(tree):
        x.blocks = []
    return tree


def templates(trees: DataFrame) -> DataFrame:
    """(host, template) from distinct (host, tree): united in groups until each host has one."""
    while True:
        counts = trees.groupBy("host").agg(F.count("*").alias("many"))
        if (counts.agg(F.max("many")).head()[0] or 0) <= 1:
            return trees.select("host", F.col("tree").alias("template"))
        group = F.pmod(F.xxhash64("tree"), F.ceil(F.col("many") / GROUP)).alias("group")
        dealt = trees.join(counts, "host").select("host", "tree", group)
        trees = materialize(dealt.groupBy("host", "group").applyInArrow(_united, "host string, tree string").distinct(), "templates")


def _aligned(batches):
    for batch in batches:
        maps = [mapping(read(t), read(w)) for t, w in zip(batch.column("tree").to_pylist(), batch.column("template").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), batch.column("tree"), pa.array(maps, pa.list_(pa.int32()))], names=["host", "shape", "tree", "slots"])


def _named(label: str) -> tuple[bool, bool]:
    """Whether a label names furniture, and whether it is a header, whose headings may belong to an article."""
    tag, *names = label.split(".")
    header = tag == "header" or bool(_HEADERS & set(names))
    bad = tag in _TAGS or any(n in _NAMES or n in _ROLES or n.startswith(_BEGINNINGS) for n in names)
    return bad, header


def content_nodes(tree: Node, mass: list[int], linked: list[int]) -> list[bool]:
    """Which nodes of a page's tree, in order, are content, from the mass and the linked mass of their own blocks over the host."""
    order = nodes(tree)
    number = {id(x): i for i, x in enumerate(order)}
    total, links = list(mass), list(linked)
    for x in reversed(order):
        for k in x.kids:
            total[number[id(x)]] += total[number[id(k)]]
            links[number[id(x)]] += links[number[id(k)]]

    def furniture(x: Node) -> bool:
        return x.label.split(".")[0] not in ("html", "body", "article", "main") and _named(x.label)[0]

    def plain(x: Node) -> int:
        """Unlinked mass below x outside of furniture."""
        return 0 if furniture(x) else mass[number[id(x)]] - linked[number[id(x)]] + sum(plain(k) for k in x.kids)

    def articles(x: Node, kind) -> list[Node]:
        tag, *names = x.label.split(".")
        if kind(tag, names) and not _NO_ARTICLE & set(names):
            return [x]
        return [] if furniture(x) or kind(tag, names) else [y for k in x.kids for y in articles(k, kind)]

    held = plain(tree)
    mains = []
    for kind in (lambda tag, names: tag == "article", lambda tag, names: tag == "main" or "role-main" in names):
        found = articles(tree, kind)
        sizes = [plain(x) for x in found]
        if found and sum(sizes) >= (1 - MAIN) * held:
            mains = [x for x, n in zip(found, sizes, strict=True) if 5 * n >= max(sizes)]
            break
    if not mains:
        main = tree
        while kids := [k for k in main.kids if plain(k) >= MAIN * held and plain(k)]:
            main = kids[0]
        mains = [main]
    keep = [False] * len(order)

    def mark(x: Node, top: bool, headings: bool) -> None:
        i, tag = number[id(x)], x.label.split(".")[0]
        bad, header = (False, False) if top else _named(x.label)
        if bad and not header:
            return
        headings = headings or bad
        if not top and tag not in _HEADINGS and tag != "p" and total[i] and links[i] >= LINKED * total[i]:
            return
        keep[i] = not headings or tag in _HEADINGS
        for k in x.kids:
            mark(k, False, headings)

    for x in mains:
        mark(x, True, False)
    return keep


def _decided(batches):
    for batch in batches:
        keeps, consts = [], []
        for tree, slots, stats in zip(*(batch.column(c).to_pylist() for c in ("tree", "slots", "stats")), strict=True):
            known = {s["slot"]: s for s in stats or ()}
            of = [known.get(s) for s in slots]
            keep = content_nodes(read(tree), [s["mass"] if s else 0 for s in of], [s["linked"] if s else 0 for s in of])
            keeps.append(keep)
            consts.append(sorted({h for s, k in zip(of, keep, strict=True) if s and k for h in s["constant"]}))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(keeps, pa.list_(pa.bool_())), pa.array(consts, pa.list_(pa.int64()))], names=["host", "shape", "keep", "constant"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("host", host_of(F.col("url")))
    parsed = materialize(rows.mapInArrow(_parsed, _PAGE), "pages")
    shapes = materialize(parsed.select("host", "shape", "tree").distinct(), "shapes")
    aligned = shapes.join(templates(shapes.select("host", "tree")), "host").mapInArrow(_aligned, "host string, shape string, tree string, slots array<int>")
    aligned = materialize(aligned, "aligned")

    blocks = parsed.select("host", "shape", "print", F.explode("blocks").alias("b")).select("host", "shape", "print", F.col("b.node").alias("node"), F.col("b.hash").alias("hash"), F.length("b.text").cast("long").alias("chars"), F.col("b.links").alias("links"))
    texts = materialize(blocks.groupBy("host", "shape", "node", "hash", "print").agg(F.sum("chars").alias("mass"), F.sum("links").alias("linked")), "texts")
    slot_of = aligned.select("host", "shape", F.posexplode("slots").alias("node", "slot"))
    texts = texts.join(slot_of, ["host", "shape", "node"])
    prints = parsed.groupBy("host").agg(F.count_distinct("print").alias("prints"))
    seen = texts.groupBy("host", "slot", "hash").agg(F.count_distinct("print").alias("pages"), F.sum("mass").alias("mass"), F.sum("linked").alias("linked"))
    common = (F.col("pages") >= F.lit(SHARE) * F.col("prints")) & (F.col("prints") >= LEAST_PAGES)
    slots = seen.join(prints, "host").groupBy("host", "slot").agg(F.sum("mass").alias("mass"), F.sum("linked").alias("linked"), F.collect_list(F.when(common, F.col("hash"))).alias("constant"))
    stats = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "mass", "linked", "constant")).alias("stats"))
    decided = aligned.join(stats, "host", "left").mapInArrow(_decided, "host string, shape string, keep array<boolean>, constant array<long>")
    decided = materialize(decided, "decided")

    met = parsed.select("page_id", "url", "host", "shape", "blocks").join(decided, ["host", "shape"])
    content = F.filter("blocks", lambda b: F.get("keep", b.node))
    varying = F.filter("content", lambda b: ~F.array_contains("constant", b.hash))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, b: n + F.length(b.text))
    met = met.select("page_id", "url", "constant", content.alias("content")).select("page_id", "url", "content", varying.alias("varying"))
    kept = F.when(2 * chars("varying") >= chars("content"), F.col("varying")).otherwise(F.col("content"))
    text = F.array_join(F.transform(kept, lambda b: b.text), "\n")
    return met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

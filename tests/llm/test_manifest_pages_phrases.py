"""Manifest, phrases and main text against plain versions, with nulls, ties, repeats, odd texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from sievework.llm import dom, merkle, phrases, wrapper

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int, shard int, id string, key int"


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _runs(digests):
    """Digests of a tree's levels, and each leaf's siblings level by level as (left, right)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = i // 3 * 3
            paths[leaf].append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        level = [_h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def _manifest(rows):
    by_source = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = _h(*map(_field, (doc_id, source, lang, n_chars, text)))
        odd = doc_id is None or zlib.crc32(str(doc_id).encode()) % 2
        by_source[source].append((doc_id is not None, doc_id or 0, leaf, leaf if odd else _h(*map(_field, (doc_id, source, lang, n_chars, None if text is None else text.replace("\n", ""))))))
    trees = sorted(by_source.items(), key=lambda x: (x[0] is not None, (x[0] or "").encode()))
    made = []
    for _, leaves in trees:
        leaves.sort()
        made.append(_runs([x[2] for x in leaves]))
    root, above = _runs([r for r, _ in made])
    out = Counter()
    for (_, leaves), (subroot, paths), over in zip(trees, made, above, strict=True):
        for (named, doc_id, leaf, checked), path in zip(leaves, paths, strict=True):
            digest, whole = checked, path + over
            for left, right in whole:
                digest = _h(left, digest, right)
            out[doc_id if named else None, leaf, subroot, root, _h(*(a + b for a, b in whole)), digest, digest == root] += 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 28, 200])
def test_manifest(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "", "-", "a", "é", "web", "web", "web"]), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "a\nb", "x\n", "äöü", "y" * 5000 + "\n"])) for i in rng.sample(range(-50, 5000), n)]
    if n > 100:
        rows += [rows[0], rows[0], (None, None, None, None, None), (None, "web", "en", 1, "z\n"), (rows[1][0], rows[1][1], "other", None, "t"), (2**63 - 1, "web", None, None, "\n"), (-(2**63), "web", None, None, "\n")]
    spark.createDataFrame([(*r, "clash", 1, 2, "i", 3) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == _manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def _phrases(rows, support, longest, inside, top):
    n, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {x: a for x, a in counts.items() if a >= support}
    by_lang = defaultdict(list)
    for (lang, p), a in found.items():
        if len(p) < 2:
            continue
        longer = [b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= inside * a for b in longer):
            continue
        score, k = min((1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        by_lang[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


@pytest.mark.parametrize(("shard_bytes", "longest", "support"), [(1 << 20, 3, 10), (600, 3, 10), (4000, 4, 5), (1, 3, 10)])
def test_phrases(spark, shard_bytes, longest, support):
    rng = random.Random(shard_bytes)
    vocabulary = ["The", "the", "a", "B", "é", "É", "wör", "x\x1cy", "q\x00", "of it", "hot", "dog", "dogs"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r\n"]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "de", None, "und", "rare"]), text(rng.randint(0, 120))) for _ in range(70)] + [("en", None), ("en", ""), (None, "...,"), ("fr", "a b a b"), ("en", "new york city " * 300), ("en", "w"), ("rare", "q q q q q q q q q q q q")]
    rows += [rows[3]] * 4
    df = spark.createDataFrame([(i, None, lang, None, t, "clash", 1, 2, "i", 3) for i, (lang, t) in enumerate(rows)], DOCS).repartition(3)
    got = phrases.collocations(df, support=support, longest=longest, top=25, shard_bytes=shard_bytes).collect()
    assert len(got) == len({(r.lang, r.phrase) for r in got}) and {tuple(r) for r in got} == _phrases(rows, support, longest, 50, 25)


def test_phrases_that_every_shard_is_just_short_of(spark):
    """Two shards hold five of ten places each, a third one none: the second count must find what a report lacks."""
    rows = [("en", "one two. " * 9 + "filler words " * 60), ("en", "one two. " * 1 + "other stuff " * 60), ("en", "more of that " * 40)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(1)
    got = {r.phrase: r.a for r in phrases.collocations(df, shard_bytes=1).collect()}
    assert got["one two"] == 10


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0


PAGES = "page_id long, url string, html string, host string, node int, text string, template string"


def _texts(spark, pages):
    df = spark.createDataFrame([(*p, "clash", 1, "t", "x") for p in pages], PAGES).repartition(3)
    rows = wrapper.extract_main_text(df).collect()
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(pages)
    return {r.page_id: r.text for r in rows}


def _body(i, n=4):
    rng = random.Random(i)
    return [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(8, 30))) + "." for _ in range(n)]


def test_main_text_of_templates(spark):
    pages, want = [], {}
    for i in range(30):
        paras = _body(i, 2 + i % 5)
        inner = "".join(f"<p>{p}</p>" for p in paras)
        nav = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in _body(i + 900, 1)[0].split()[: 3 + i % 4]) + "</ul></nav>"
        side = f'<aside><h3>More</h3><p>{_body(i + 500, 1)[0]}</p></aside>'
        comments = "".join(f'<article class="comment"><p>{p}</p></article>' for p in _body(i + 700, 3))
        pages.append((i, f"https://a.example/{i}", f"<html><head><title>t</title></head><body><header><h1>Site</h1></header>{nav}<div class=cookie-notice>We use cookies on this site. Accept?</div><article><header><h1>Title {i} &amp; more</h1><p>by X</p></header>{inner}<p>Read all of our stories every day on this page.</p><form><label>Mail</label></form></article>{side}<section id=comments>{comments}</section><footer>&copy; a</footer></body></html>"))
        want[i] = "\n".join([f"Title {i} & more", *paras])
        # A host without article elements: the heaviest unlinked slot is the content.
        pages.append((100 + i, f"http://B.example:80/{i}", f"<body><div class='top'><a href=/>Home</a> <a href=/x>All posts</a></div><div class=wrap><div class=left><ul>{''.join(f'<li><a href=/{k}>link {w}</a>' for k, w in enumerate(_body(i + 300, 1)[0].split()[:6]))}</ul></div><div class=text>{inner}</div></div><div>Powered by nothing</div></body>"))
        want[100 + i] = "\n".join(paras)
    assert _texts(spark, pages) == want


def test_main_text_of_copies_is_kept(spark):
    paras = _body(1, 6)
    pages = [(i, "http://c.example/x", "<body><article>" + "".join(f"<p>{p}" for p in [*paras[:i % 6], paras[i % 6] + f" word{i}", *paras[i % 6 + 1 :]]) + "</article>") for i in range(40)]
    assert _texts(spark, pages) == {i: "\n".join([*paras[: i % 6], paras[i % 6] + f" word{i}", *paras[i % 6 + 1 :]]) for i in range(40)}


def test_main_text_of_odd_pages(spark):
    deep = "<div>" * 3000 + "far down" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>para {i} of a very long page</p>" for i in range(20000))
    pages = [
        (1, None, None), (2, "x", ""), (3, "http://d.example", "plain text &lt;b&gt; 3 < 4"), (4, "http://e.example/", deep), (5, "http://f.example/", long), (None, "", "<p>a</p><p>b"),
        (7, "http://g.example", "<article><p>one<script>var a='</p>';</script> two<!-- <p>no --><b>bo</b>ld&nbsp;&eacute;&#233;&amp<style>p{}</style></p><div hidden>no</div><textarea>no</textarea>x<br>y</article"),
        (8, "http://g.example", "<article><p title='a>b' class=x>in</p><p title=\"open>text</p></article>"), (9, "http://h.example", "<nav>menu</nav>"), (10, "http://i.example", "<article>cut off &am"), (10, "http://i.example", "<article>cut off &am"),
        (11, "http://j.example", "<body><script>never closed <p>no</p>"), (12, "http://İ.example", "<P>İ<SCRIPT>no</SCRIPT>yes</P>"),
    ]
    df = spark.createDataFrame([(*p, "clash", 1, "t", "x") for p in pages], PAGES)
    rows = wrapper.extract_main_text(df).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.page_id].append(r.text)
    assert got[1] == got[2] == got[9] == got[11] == [""] and got[None] == ["a\nb"] and got[4] == ["far down"] and got[10] == ["cut off &am"] * 2
    assert got[3] == ["plain text <b> 3 < 4"] and got[5][0].count("\n") == 19999 and got[12] == ["İyes"]
    assert got[7] == ["one twobold éé&\nx\ny"] and got[8][0].startswith("in")
    empty = spark.createDataFrame([], PAGES)
    assert wrapper.extract_main_text(empty).count() == 0


def test_tree_matching_against_a_plain_version():
    def plain(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain(x, y))
        return 1 + best[-1][-1]

    rng = random.Random(3)

    def tree(depth):
        return dom.Node(rng.choice("ab") if depth < 3 else "r", [tree(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [], [])

    for _ in range(200):
        a, b = tree(3), tree(3)
        assert dom.matched(a, b) == plain(a, b) == dom.matched(b, a)
        whole = dom.union(a, b)
        assert whole.size == a.size + b.size - dom.matched(a, b) and dom.written(dom.read(dom.written(whole))) == dom.written(whole)
        assert sum(x >= 0 for x in dom.mapping(a, whole)) >= dom.matched(a, whole) - 1


@pytest.mark.parametrize("seed", range(2))
def test_many_trees_of_a_host_become_one(spark, seed):
    rng = random.Random(seed)
    trees = ["0 html\n1 body\n" + "\n".join(f"2 div.{''.join(rng.choices('abcde', k=2))}" for _ in range(rng.randint(1, 5))) for _ in range(150)]
    df = spark.createDataFrame([("h", t) for t in set(trees)] + [("one", trees[0])], "host string, tree string")
    out = {r.host: r.template for r in wrapper.templates(df).collect()}
    assert set(out) == {"h", "one"} and out["one"] == trees[0]
    whole = dom.read(out["h"])
    assert all(min(dom.mapping(dom.read(t), whole)[:2]) >= 0 for t in trees)
    assert wrapper.templates(df).agg(F.count("*")).head()[0] == 2

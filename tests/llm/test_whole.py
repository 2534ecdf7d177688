"""The pipeline stage by stage, decontamination against a plain version, and held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sievework.llm import decontamination as D
from sievework.llm import language_id
from sievework.llm.tokenizing import TextEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string"
TESTDATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(TESTDATA / "documents.parquet"))
    out = language_id.label_languages(docs, language_id.fit(docs)).where("held_out and row.lang is not null and lang_pred <> 'und'")
    right, n = out.agg(F.count_if(F.col("lang_pred") == F.col("row.lang")), F.count("*")).head()
    assert n > 100 and right >= 0.97 * n, (right, n)


def test_rows_of_one_id_train_under_their_own_label(spark):
    rows = [(1, f"the house and the garden number {'abcdefghij'[i % 10]}", "en") for i in range(40)] + [(1, f"la maison et le jardin dans {'abcdefghij'[i % 10]}", "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert zlib.crc32(b"1") % 5
    out = language_id.label_languages(docs, language_id.fit(docs)).select("row.lang", "lang_pred").collect()
    assert all(r.lang == r.lang_pred for r in out)


PUNCT = re.escape("!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _template(text):
    """(words with placeholders, words with their values), re-told with Python's own expressions."""
    import regex

    def of(slots):
        keep = (lambda m, g=1: D.VALUE + m[g]) if slots else (lambda m, g=1: "")
        number = r"(\d+(?:[.,:/]\d+)*)"
        x = regex.sub(r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", lambda m: D.NAME + keep(m), text)
        x = regex.sub(rf"[{PUNCT}](?!\d)|(?<!\d)[{PUNCT}]", " ", x)
        x = regex.sub(rf"(?i)(?<![\d\p{{L}}]){number}\s?({D.UNITS})(?![\p{{L}}\d])", lambda m: f" {D.NUMBER}{keep(m)} {D.UNIT}{keep(m, 2)} ", x)
        tail = r"(?<!%s)%s(?![\d.,:/]*\d)" % (D.VALUE, number) if not slots else r"(?<![%s\d.,:/])%s" % (D.VALUE, number)
        return [w for w in re.split(r"[\x20\x09-\x0D]+", regex.sub(tail, lambda m: f" {D.NUMBER}{keep(m)} ", x).lower()) if w]

    return of(False), of(True)


def _leaks(docs, bench, window=8, least=5, enough=13):
    held = lambda w: any(w.startswith(p) for p in (D.NAME, D.NUMBER, D.UNIT))
    found = set()
    for item, text in bench:
        shapes = [_template(text)]
        inside = tuple(x[1:] for x in _template("a " + text.lstrip()))
        if inside[0] != shapes[0][0] and len(inside[0]) <= enough:
            shapes.append(inside)
        for plain, valued in shapes:
            n = min(len(plain), window)
            if len(plain) < least:
                continue
            own = {i: tuple(plain[i : i + n]) for i in range(len(plain) - n + 1) if 2 * sum(not held(w) for w in plain[i : i + n]) >= n}
            for doc, body in docs:
                words, values = _template(body)
                covered = {}
                for (i, w), j in itertools.product(own.items(), range(len(words) - n + 1)):
                    if tuple(words[j : j + n]) == w:
                        covered.setdefault(j - i, set()).update(range(i, i + n))
                for shift, places in covered.items():
                    pairs = {(valued[p], values[p + shift]) for p in places if D.VALUE in valued[p]}
                    if len(places) >= min(len(plain), enough) and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                        found.add((doc, item))
    return found


def test_decontamination_against_a_plain_version(spark):
    """Items long enough and with enough literal words, so that the template rule alone decides."""
    rng = random.Random(4)
    names, verbs = ["Anna", "Robert", "Maria", "Peter", "Clara"], ["gave", "sold", "lent", "showed", "sent"]

    def item():
        parts = []
        for _ in range(rng.randint(1, 3)):
            a, b = rng.sample(names, 2)
            parts.append(f"then {a} {rng.choice(verbs)} {rng.randint(2, 40)} {rng.choice(['kg', 'apples', 'coins'])} to {b} near the old {rng.choice(['mill', 'bridge', 'market'])}")
        return " and ".join(parts)

    bench = [(i, item()) for i in range(12)]
    docs = []
    for k in range(60):
        text = rng.choice(bench)[1]
        if rng.random() < 0.6:  # other names and numbers, now and then inconsistently
            turn = dict(zip(names, rng.sample(names, len(names)), strict=True))
            text = re.sub("|".join(names), lambda m, t=turn: t[m[0]] if rng.random() < 0.9 else "Clara", text)
            text = re.sub(r"\d+", lambda m: str(int(m[0]) + 50), text)
        if rng.random() < 0.3:
            text = text.replace("near the", "by the", 1)
        docs.append((k, f"so {text} at last" if rng.random() < 0.5 else text))
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    want = _leaks(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and 10 < len({d for d, _ in want}) < 60


def _folder(spark, tmp_path, rows, bench):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(5)
    english = [f"{a}{b}" for a in ("hou", "gar", "win", "ri", "fo", "wa") for b in ("se", "den", "ter", "ver", "rest", "ll", "nd", "st")]
    text = lambda n: " ".join(rng.choice(english) for _ in range(n))
    item = "the miller carried nine sacks of barley over the narrow bridge before sunrise on the first day"
    passage = "\n".join(text(12) for _ in range(4))
    body = [text(120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(body)]
    rows += [(100, body[0]), (101, body[1].replace(" ", "  ")), (102, body[2] + " added"), (103, f"{text(40)} {item} {text(40)}"), (104, passage + "\n" + text(30)), (105, text(30) + "\n" + passage), (106, "12345 !!"), (107, None), (108, ""), (None, text(60)), (None, text(60)), (3, text(80)), (109, text(30000))]
    rows = [(i, t, None if k % 3 else "en", "s", None if t is None else len(t), "clash", "clash") for k, (i, t) in enumerate(rows)]
    folder = _folder(spark, tmp_path, rows, [(1, item), (None, "an item of other words that no document holds anywhere")])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        rows_now = docs.collect()
        seen[name] = Counter((r.doc_id, r.text) for r in rows_now) if name != "packing" else rows_now
        docs = spark.createDataFrame(rows_now, docs.schema)
        assert name == "packing" or docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    start = Counter((r[0], r[1]) for r in rows)
    assert start - seen["language_id"] == Counter([(106, "12345 !!"), (107, None), (108, "")]) and not seen["language_id"] - start
    # Lines: the later full copy and the passage of four lines go where they stand later.
    later = rows[[r[0] for r in rows].index(105)][1].split("\n")[0]
    want = seen["language_id"] - Counter([(100, body[0]), (105, f"{later}\n{passage}")]) + Counter([(105, later)])
    assert seen["line_dedup"] == want
    # Words: the copy with other spaces and the near copy go, all else stays.
    assert seen["line_dedup"] - seen["near_duplicates"] == Counter([(101, body[1].replace(" ", "  ")), (102, body[2] + " added")])
    assert seen["near_duplicates"] - seen["decontamination"] == Counter({k: n for k, n in seen["near_duplicates"].items() if k[0] == 103})
    tokenizer = TextEncoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    total = Counter()
    for (i, t), n in seen["decontamination"].items():
        total[i] += n * (len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)
    packed = Counter()
    for r in seen["packing"]:
        packed[r.doc_id] += r.length
    assert packed == total
    assert corpus_pipeline.run(spark, folder).count() == len(seen["packing"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = _folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0

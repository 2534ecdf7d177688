"""Operators on small frames whose results are known."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.functions.lines import parse
from sievework.operators import hierarchy, routing, sampling, scoring, units
from sievework.operators.clustering import _lead, leader_clusters
from sievework.operators.matching import best_nearby, coverage, jaccard, outside_kitchen
from sievework.operators.selection import guarded_selection
from sievework.plans.curation import QUERIES, _titled
from sievework.plans.tables import Tables
from sievework.sources import readers, sinks
from sievework.streaming.ingest import ingest

FOLDER = "/root/testdata/sf0.001"


def test_coverage_counts_core_only(spark):
    posts = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (2, "c", True)], "id int, slug string, core boolean")
    have = spark.createDataFrame([("a",), ("a",), ("c",)], "slug string")
    assert {tuple(r) for r in coverage(posts, have).collect()} == {(1, 1, 2, 1), (2, 1, 1, 0)}


def test_an_alternative_in_the_group_saves_a_tool(spark):
    tools = spark.createDataFrame([(1, 9, 0), (1, 2, 0), (2, 9, 0), (2, 2, 1)], "id int, tool int, grp int")
    assert [r.id for r in outside_kitchen(tools, [2]).collect()] == [2]


def test_hierarchy_covers_ancestors_and_children_but_no_siblings(spark):
    tree = spark.createDataFrame([("root", None), ("mid", "root"), ("leaf", "mid"), ("twin", "mid"), ("bud", "leaf")], "slug string, parent string")
    given, none = spark.createDataFrame([("leaf",)], "slug string"), spark.createDataFrame([], "slug string")
    assert {r.slug for r in hierarchy.expand_have(given, tree, none).collect()} == {"leaf", "mid", "root", "bud"}
    assert hierarchy.cycles(tree).count() == 0


def test_routing_takes_the_first_reason_and_adds_up(spark):
    rows = spark.createDataFrame([(1, "s", None), (2, "s", ""), (3, "s", "x")], "id int, source string, text string")
    routed = rows.withColumn("reason", routing.first_reason(("none", F.col("text").isNull()), ("empty", F.coalesce("text", F.lit("")) == "")))
    ledger = {r.reason: r.n for r in routing.ledger(routed, "source", "id", "id").collect()}
    assert ledger == {"none": 1, "empty": 1} and routed.where("reason is null").count() == 1


def test_jaccard_of_empty_sets_is_a_parameter(spark):
    row = spark.sql("select array() as a, array() as b, array(1, 2) as c, array(2, 3) as d")
    r = row.select(jaccard(F.col("a"), F.col("b"), 1.0).alias("x"), jaccard(F.col("a"), F.col("b"), 0.0).alias("y"), jaccard(F.col("c"), F.col("d"), 0.0).alias("z")).head()
    assert (r.x, r.y, round(r.z, 4)) == (1.0, 0.0, 0.3333)


def test_best_nearby_matches_all_pairs(spark):
    rng = random.Random(6)
    values = [None, float("nan"), float("inf"), -0.0, 0.1 + 0.2, 1e300, *(900 + i / 10 for i in range(420)), *(1e-3 * i for i in range(20)), *(-i / 10 for i in range(300))]
    made = lambda slugs: [(i, rng.choice(["x", "y", None]), rng.choice(values)) for i in slugs]
    lacking, at_hand = made([*range(0, 900, 2), 4, 4, None]), made([*range(1, 500, 2), 7, 7, None])
    want = {}
    for i, g, v in lacking:
        near = [(next(q for gap, q in ((10, 3), (20, 2)) if abs(v - w) < gap), j) for j, h, w in at_hand if None not in (i, j, g, v, w) and g == h and abs(v - w) < 20]
        if near:
            q, j = min(near, key=lambda x: (-x[0], x[1]))
            want[i] = min(want.get(i, (j, q)), (j, q), key=lambda x: (-x[1], x[0]))
    frame = lambda rows: spark.createDataFrame(rows, "slug long, g string, value double").repartition(3)
    got = best_nearby(frame(lacking), frame(at_hand), ["g"], ((10, 3), (20, 2))).collect()
    assert {r.slug: (r.swap, r.quality) for r in got} == want and len(got) == len(want) > 200
    assert best_nearby(frame(lacking), frame([]), ["g"], ((10, 3),)).count() == 0


def test_best_nearby_makes_no_pairs(spark):
    rows = lambda odd: spark.range(400_000).where(f"id % 2 = {odd}").select(F.col("id").alias("slug"), F.lit("x").alias("g"), (F.col("id") % 1000 / 10).alias("value"))
    got = best_nearby(rows(0), rows(1), ["g"], ((10, 3), (20, 2)))  # 15 billion pairs are near enough
    assert got.agg(F.count("*"), F.min("swap"), F.max("quality")).first()[:] == (200_000, 1, 3)


def test_leader_clusters_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["", "a", "b"]), float(rng.randint(0, 5)), sorted(set(rng.choices("pqrstu", k=rng.randint(0, 5))))) for i in range(80)]
    got = {r.id: r.leader for r in leader_clusters(spark.createDataFrame(rows, "id long, title string, score double, members array<string>")).collect()}
    want = {}
    for title in ("a", "b"):
        leaders = []
        for i, _, _, s in sorted((r for r in rows if r[1] == title), key=lambda r: (-r[2], r[0])):
            s = set(s)
            for j, t in leaders:
                if (len(s & t) / len(s | t) if s | t else 1.0) >= 0.8:
                    want[i] = j
                    break
            else:
                leaders.append((i, s))
                want[i] = i
    want |= {r[0]: r[0] for r in rows if r[1] == ""}
    assert got == want


@pytest.mark.parametrize(("share", "size", "words"), [(0.8, 9, 12), (0.5, 30, 60), (0.8, 60, 64), (1.0, 3, 5), (0.05, 4, 40)])
def test_leaders_of_a_title_match_comparing_with_every_leader(share, size, words):
    rng = random.Random(size)
    rows = [(i, float(rng.randint(0, 9)), [None if w == 0 else f"w{w}" for w in rng.sample(range(words), rng.randint(0, size))]) for i in range(400)]
    rows += [(1000, 5.0, None), (1001, 5.0, ["w1", "w1", "w2"])]
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "score": [r[1] for r in rows], "members": pa.array([r[2] for r in rows], pa.list_(pa.string()))})
    leaders, want = [], {}
    for i, _, members in sorted(rows, key=lambda r: (-r[1], r[0])):
        s = frozenset(members or ())
        want[i] = next((j for j, t in leaders if min(len(s), len(t)) >= share * max(len(s), len(t)) and len(s & t) >= share * len(s | t)), i)
        if want[i] == i:
            leaders.append((i, s))
    got = _lead(share)((), table)
    assert dict(zip(got["id"].to_pylist(), got["leader"].to_pylist())) == want


def test_many_leaders_of_one_title_are_not_all_compared():
    rng = random.Random(3)
    members = [[f"w{w}" for w in rng.sample(range(20_000), 40)] for _ in range(20_000)]
    table = pa.table({"id": pa.array(range(20_000), pa.int64()), "score": [0.0] * 20_000, "members": members})
    began = time.process_time()
    assert len(set(_lead(0.8)((), table)["leader"].to_pylist())) == 20_000
    assert time.process_time() - began < 60  # 200 million pairs take several times that


def test_leader_clusters_over_the_documents(spark):
    docs = _titled(Tables(spark, FOLDER)).collect()
    assert QUERIES["dedupe_normalised_title"](spark, FOLDER).count() == len(docs)


def test_guarded_selection_matches_the_greedy_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaab" "c"), rng.randint(0, 30)) for i in range(120)]
    got = {r.id for r in guarded_selection(spark.createDataFrame(rows, "id int, lang string, score int"), "lang", 40, 5, 20).collect()}
    taken, count = set(), {}
    ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
    sizes = {g: sum(r[1] == g for r in rows) for g in "abc"}
    for i, g, _ in ordered:
        left = 40 - len(taken)
        owed = {h: max(min(5, sizes[h]) - count.get(h, 0), 0) for h in sizes}
        if left <= 0 or count.get(g, 0) >= 20 or (owed[g] == 0 and sum(owed.values()) >= left):
            continue
        taken.add(i)
        count[g] = count.get(g, 0) + 1
    assert got == taken


def test_samples(spark):
    rows = spark.range(100).select(F.lit("s").alias("g"), F.col("id"))
    assert [r.id for r in sampling.stride(rows, "g", "id", 7).orderBy("id").collect()] == [0, 14, 28, 42, 56, 70, 84]
    assert [r.id for r in sampling.even_ranks(rows, "g", "id", 3).orderBy("id").collect()] == [0, 33, 66]
    assert sampling.water_level(spark.createDataFrame([(3,), (50,), (60,)], "size int"), 63) == 30
    assert sampling.nearest_rank(rows, "id", 0.25).head().value == 99 - int(0.75 * 99)


def test_scores(spark):
    r = spark.range(1).select(scoring.shrunk_mean(F.lit(10.0), F.lit(2), 4.6, 5).alias("m"), scoring.popularity(F.lit(25)).alias("p"), scoring.ramp(F.lit(250), (0, 0.0), (500, 1.0)).alias("r")).head()
    assert (round(r.m, 6), round(r.p, 6), r.r) == (round(33 / 7, 6), 1.0, 0.5)


def test_units(spark):
    row = spark.range(1).select(units.grams(F.lit(2.0), F.lit("cup"), F.lit(0.5), F.lit(None).cast("double")).alias("g"), units.shop_count(F.lit(1020.0), F.lit(500)).alias("n"), units.as_fraction(F.lit(1.5)).alias("f"), units.as_fraction(F.lit(1.99)).alias("u"), units.step_up(F.lit(101.0)).alias("s")).head()
    assert (round(row.g, 3), row.n, row.f, row.u, row.s) == (236.588, 2, "1 1/2", "2", 150)


def test_amount_lines():
    told = {"qty": 1.5, "qty_max": None, "unit": "cup", "name": "flour", "prep": "sifted", "optional": False}
    assert parse("1 1/2 cups flour, sifted") == told | dict.fromkeys(("pack_qty", "pack_max", "pack_unit", "size", "note"))
    assert parse("2-3 tbsp oil (optional)")["qty_max"] == 3.0
    assert parse("½ lb. of beef")["qty"] == 0.5 and parse("½ lb. of beef")["name"] == "beef"
    assert parse("salt to taste")["qty"] is None and parse("salt to taste")["optional"]
    assert parse("For the sauce:")["name"] is None and parse(None)["name"] is None and parse("1/0 cup x")["qty"] is None


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    assert one(X.normalise(F.lit("Crème Brûlée & Mike's  Pie!"))) == "creme brulee and mikes pie"
    assert one(F.transform(F.split(F.lit("berries boxes glass cups"), " "), X.singular)) == ["berry", "box", "glass", "cup"]
    assert one(X.host(F.lit("HTTPS://www.Example.org:80/x?y"))) == "example.org"
    assert one(X.iso_minutes(F.lit("PT1H30M"))) == 90 and one(X.iso_minutes(F.lit("PT0M"))) is None
    assert one(X.html_to_text(F.lit("<p>a&amp;b<br>c</p><script>x</script>"))) == "a&b\nc"


def test_readers_and_sinks(spark, tmp_path):
    folder = tmp_path / "mine"
    folder.mkdir()
    (folder / "recipes.jsonl").write_text(json.dumps({"id": "1", "title": "t", "steps": ["s"]}) + "\nnot json\n\n" + json.dumps({"id": "2", "ingredients": ["a", "b"]}) + "\n")
    rows = readers.read_records(spark, f"{tmp_path}/*/recipes.jsonl").orderBy("line_id").collect()
    assert [(r.source, r.bad, r.record and r.record.id) for r in rows] == [("mine", False, "1"), ("mine", True, None), ("mine", False, "2")]
    (tmp_path / "x.csv").write_text('id,names\n1,"[""a"", ""b, c""]"\n')
    assert readers.read_csv(spark, str(tmp_path / "x.csv"), "id int, names string", ["names"]).head().names == ["a", "b, c"]
    lit = lambda s: spark.range(1).select(readers.vector_literal(F.lit(s)).alias("x")).head().x
    assert lit('c("a", "b \\"c\\"")') == ["a", 'b "c"'] and lit("NA") == [] and lit("c(1, 2)") == ["1", "2"]
    page = '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph": [{"@type": "Page"}, {"@type": "Recipe", "name": "n"}]}</script>'
    found = spark.range(1).select(readers.json_ld(F.lit(page)).alias("x")).head().x
    assert json.loads(found)["name"] == "n"
    docs = spark.createDataFrame([(1, 2), (2, 9)], "id int, parent int")
    sinks.write_tables(docs, {"a": lambda d: d.select("id"), "b": lambda d: d.where("id = 2")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/b")).count() == 1
    assert [r.id for r in sinks.orphans(docs, "parent", docs, "id").collect()] == [2]


def test_a_second_run_takes_in_only_new_files(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    spark.range(5).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    ingest(spark, src, schema, out, log)
    ingest(spark, src, schema, out, log)
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(src)
    ingest(spark, src, schema, out, log)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_amounts_added_and_alternatives():
    assert abs(parse("1 cup plus 2 tbsp milk")["qty"] - (1 + 2 * 14.7868 / 236.588)) < 1e-9 and parse("1 cup plus 2 tbsp milk")["name"] == "milk"
    assert parse("1 cup plus 2 g milk")["qty"] == 1.0
    told = {"qty": 2.0, "qty_max": None, "unit": None, "name": "red apples", "prep": "cored", "optional": False, "note": "or green apples"}
    assert parse("2 red or green apples, cored") == told | dict.fromkeys(("pack_qty", "pack_max", "pack_unit", "size"))
    assert parse("butter or oil")["name"] == "butter"


def test_imported_content(spark):
    from sievework.functions.imports import flatten_steps, from_text, imported, parse_content

    sections = [{"@type": "HowToSection", "name": "Base", "itemListElement": [{"@type": "HowToStep", "text": "Mix."}, "Rest."]}, "Bake."]
    assert flatten_steps(sections) == ["Base", "Mix.", "Rest.", "Bake."] and flatten_steps(sections, False) == ["Mix.", "Rest.", "Bake."]
    ld = "<p>x</p><script type='application/ld+json'>" + json.dumps([{"@type": ["Recipe"], "name": "Pie", "recipeIngredient": ["1 egg"], "recipeInstructions": "Mix.\nBake."}]) + "</script>"
    assert parse_content(ld) == {"title": "Pie", "ingredients": ["1 egg"], "steps": ["Mix.", "Bake."], "origin": "json-ld"}
    micro = '<div itemscope itemtype="http://schema.org/Recipe"><h1 itemprop="name">Pie</h1><div itemprop="author" itemscope itemtype="Person"><b itemprop="name">Ann</b></div><li itemprop="recipeIngredient">1 <i>egg</i></li></div>'
    assert parse_content(micro) == {"title": "Pie", "ingredients": ["1 egg"], "steps": [], "origin": "microdata"}
    assert from_text("Pie\nIngredients:\n1 egg\nMethod\nMix.")["steps"] == ["Mix."]
    assert from_text("Pie\n2 eggs\n1 cup flour\nMix all of it well.")["ingredients"] == ["2 eggs", "1 cup flour"]
    rows = spark.createDataFrame([(ld,), (None,), ("",), ("<p>none</p>",)], "c string").select(imported(F.col("c")).alias("r")).collect()
    assert [r.r.origin for r in rows] == ["json-ld", None, None, None]

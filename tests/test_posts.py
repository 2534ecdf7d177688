"""Posts, Markdown records, videos, step-only items, post rules, kept errors and selected lines."""

from pyspark.sql import functions as F

from sievework.functions import posts, text
from sievework.operators import diet, records
from sievework.operators import names as names_of


def _one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


FORM = posts.Section(r"(?i)ingredients(?:\s+for\s+([^:]+))?\s*:", r"(?i)^(?:posted by|view the complete recipe|share to)", elsewhere=r"(?i)allrecipes\.com")


def test_section(spark):
    html = "<style>p{}</style><p>Hi!</p><p>Ingredients for 4 Big\nPies:</p>2 cups\nflour<br>1 egg<br/>--<br>- Mix &amp; bake.<br>* Cool</div>Posted by X<br>3 lies"
    got = _one(spark, posts.section(F.col("h"), FORM), h=html)
    assert tuple(got) == ("4 Big Pies", ["2 cups flour", "1 egg"], ["Mix & bake.", "Cool"], None)
    bare = _one(spark, posts.section(F.col("h"), FORM), h="INGREDIENTS : <br>salt<br>View the complete recipe.<br>pepper")
    assert tuple(bare) == ("", ["salt"], [], None)
    footer = _one(spark, posts.section(F.col("h"), FORM), h="So: ingredients: salt<br>oil<br><div>Share to X</div><div>Share to Y</div>")
    assert tuple(footer) == ("", ["salt", "oil"], [], None)
    reasons = [_one(spark, posts.section(F.col("h"), FORM), h=h)["reason"] for h in ("", None, 'see <a href="http://Allrecipes.com/x">it</a>', "Ingredients:<br>- only a step", "Ingredients:")]
    assert reasons == ["no_section", "no_section", "elsewhere", "empty_section", "empty_section"]


def test_markdown_record(spark):
    text = "# A Dish \n\n## 食材\n### main\n| 食材 | 用量 | 备注 |\n|---|---|---|\n| 鸡蛋 | 2个 | |\n|  | 1 | x |\n| 盐 | 少许 | y |\nnot a row\n## Notes\n| no | 1 | |\n- no\n## 做法\n1. beat\n2) fry\n- \n* eat\nnot listed"
    got = _one(spark, posts.markdown_record(F.col("t"), F.col("n")), t=text, n="f.md")
    assert (got["title"], got["ingredients"], got["steps"]) == ("A Dish", ["2个 鸡蛋", "少许 盐"], ["beat", "fry", "eat"])
    assert _one(spark, posts.markdown_record(F.col("t"), F.col("n")), t="## 做法\n- x", n="a.b.md")["title"] == "a.b"
    assert [_one(spark, posts.markdown_record(F.col("t"), F.col("n")), t=t, n="f.md") for t in ("", None, "# only a title")] == [None] * 3


def test_video_url(spark):
    url = lambda h, p=None: _one(spark, posts.video_url(F.col("h"), F.col("p")), h=h, p=p)
    assert url('<a href="vimeo.com/12345"></a><embed src="//www.youtube.com/v/abcdefghijk&x">') == "https://www.youtube.com/watch?v=abcdefghijk"
    assert url('<iframe src="https://player.vimeo.com/video/987654">') == "https://vimeo.com/987654"
    assert (url("<object data=x>", "http://p"), url("plain", "http://p"), url(None, "http://p")) == ("http://p", None, None)
    key = lambda f: _one(spark, posts.post_key(F.col("f")), f=f)
    assert (key("/a/2007_02_some_name.json"), key("x.json")) == ("2007/02/some_name", None)


def test_unlisted_items(spark):
    foods = {"chicken": "chicken", "chickens": "chicken", "bacon": "bacon", "beef": "beef", "beef broth": "broth", "chicken broth": "broth", "ham": "ham", "pork": "pork", "shrimp": "shrimp"}
    words = [(k, "food", v) for k, v in foods.items()] + [(k, "adding", None) for k in ("add", "stir in", "brown", "cook")] + [(k, "aside", None) for k in ("serve with", "optional", "or")]
    vocabulary = spark.createDataFrame(words, "key string, kind string, slug string")
    rows = [
        (1, ["2 eggs"], ["Add the diced chicken. Serve with bacon.", "Stir in beef broth."]),
        (2, ["1 lb chickens"], ["Add chicken and fry."]),
        (3, ["chicken broth"], ["Add chicken; optional: add ham", "Brown the pork or beef. Cook shrimp"]),
        (4, None, None), (5, [], ["Add what is left of the ham", "Add the good ham. Ham", None]),
    ]
    df = spark.createDataFrame(rows, "id int, ingredients array<string>, steps array<string>")
    assert {tuple(r) for r in diet.unlisted(df, "id", "ingredients", "steps", vocabulary).collect()} == {(1, "chicken"), (1, "broth"), (3, "shrimp"), (5, "ham")}
    assert diet.unlisted(df.where("id = 4"), "id", "ingredients", "steps", vocabulary).count() == 0


def test_alternatives(spark):
    known = spark.createDataFrame([("chicken broth", "chicken_broth"), ("vegetable broth", "vegetable_broth"), ("butter", "butter"), ("olive oil", "olive_oil"), ("red apple", "apple")], "key string, tag string")
    names = ["chicken or vegetable broth", "butter / olive oil", "lard or olive oil", "butter", "stone", "", "corn or lard or olive oil", "Red or green apple"]
    got = {r.name: (r.slug, r.note) for r in names_of.alternatives(spark.createDataFrame([(n,) for n in [*names, "butter", None]], "x string"), "x", known).collect()}
    assert got == {
        "chicken or vegetable broth": ("chicken_broth", "vegetable broth"), "butter / olive oil": ("butter", "olive oil"), "lard or olive oil": ("olive_oil", "olive oil"), "butter": ("butter", None),
        "stone": (None, None), "": (None, None), "corn or lard or olive oil": ("olive_oil", "lard or olive oil"), "Red or green apple": ("apple", "green apple"),
    }


def test_context_rules(spark):
    rules = spark.createDataFrame([("slug:coriander", "word:fresh", "cilantro", 1), ("slug:coriander", "unit:bunch", "cilantro", 2), ("slug:tuna", "unit:can", "canned_tuna", 1), ("flag:meat", "word:vegan", "meatless", 1), ("slug:tuna", "word:vegan", "never", 9)], "subject string, cue string, becomes string, rank int")
    lines = [(1, "coriander", "Fresh coriander", None, None), (2, "coriander", "coriander", "bunch", []), (3, "coriander", "ground coriander", "tsp", []), (4, "tuna", "tuna", "can", ["fish"]), (5, "ground_beef", "vegan ground beef", "lb", ["meat"]), (6, None, "vegan x", "can", ["meat"]), (7, "tuna", "vegan tuna", None, ["meat"]), (8, "salt", None, None, None)]
    got = {r.line: r.slug for r in names_of.by_context(spark.createDataFrame(lines, "line int, slug string, name string, unit string, flags array<string>"), rules).collect()}
    assert got == {1: "cilantro", 2: "cilantro", 3: "coriander", 4: "canned_tuna", 5: "meatless", 6: None, 7: "meatless", 8: "salt"}


def test_errors_are_kept(spark):
    def half(x: int) -> int:
        return 10 // x

    rows = spark.createDataFrame([(5,), (0,), (None,)], "x int")
    got = {r["x"]: (r["r"]["value"], r["r"]["error"]) for r in rows.select("x", records.caught(half, "int")("x").alias("r")).collect()}
    assert got[5] == (2, None) and got[0][0] is None and got[0][1].startswith("ZeroDivisionError: ") and got[None][1].startswith("TypeError: ")


def test_selected_lines(spark):
    read = spark.createDataFrame([("s", "f1", 0, "a"), ("s", "f1", 1, "b"), ("s", "f2", 0, "c"), ("s", "f2", 5, None)], "source string, file string, line_id long, key string")
    want = spark.createDataFrame([("s", "f1", 1, "b"), ("s", "f2", 0, "z"), ("s", "f2", 5, "n"), ("s", "f9", 9, "q")], "source string, file string, line_id long, key string")
    got = {(r["file"], r["line_id"], r["reason"]) for r in records.selected(read, want, ["source", "file", "line_id"], "key").collect()}
    assert got == {("f1", 1, None), ("f2", 0, "selection_mismatch"), ("f2", 5, "selection_mismatch"), ("f9", 9, "selection_missing")}


def test_unescape(spark):
    got = lambda t: _one(spark, text.unescape(F.col("t")), t=t)
    assert got("a &amp; b &copy;&#39;&#x1F600;&eacute;&frac12;") == "a & b ©'\U0001f600é½"
    assert got("&amp;lt; & &x; &bogus; &#0; &#xD800; R&D; &lt") == "&lt; & &x; &bogus; &#0; &#xD800; R&D; &lt"
    assert (got(""), got(None), got("&nbsp;&")) == ("", None, " &")

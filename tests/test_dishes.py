"""Equipment, servings, courses and annotations on small texts."""

from pyspark.sql import functions as F
from sievework.functions import dishes as D


def _get(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).head().asDict()


def test_equipment(spark):
    L = F.lit
    got = _get(
        spark, none=D.steps_status(F.array().cast("array<string>")), null=D.steps_status(F.lit(None).cast("array<string>")), short=D.steps_status(F.array(L("Mix."))), ok=D.steps_status(F.array(L("Mix all of it well and then bake it for an hour."))),
        lack=D.sentence_class(L("If you don't have oven, wait")), alt=D.sentence_class(L("Alternatively, grill it")), skip=D.sentence_class(L("Optional: toast it")), plain=D.sentence_class(L("Bake it")),
        named=D.devices(L("Bake it in the oven. Alternatively, grill it.")), implied=D.devices(L("Cook it over low heat. Puree until smooth.")), nothing=D.devices(L("Mix and eat.")), raw=D.no_cook(L("Mix and eat.")), hot=D.no_cook(L("Toast it.")),
        kinds=D.vessel_kinds(L("Heat the frying pan. Put the pan aside; fill the bowl.")), sheet=D.sheet_pan_meal(L("Put it on a baking tray. Bake it in the oven."), L("main")), two=D.sheet_pan_meal(L("Mix in a bowl, bake on a baking tray."), L("main")),
    )
    want = {"none": "no_steps", "null": "no_steps", "short": "too_short", "ok": "ok", "lack": "lacking", "alt": "alternative", "skip": "skip", "plain": "plain", "named": ["oven"], "implied": ["hob", "blender"], "nothing": [], "raw": True, "hot": False, "kinds": ["frying pan", "bowl"], "sheet": True, "two": False}
    assert got == want


def test_servings(spark):
    L = F.lit
    none = F.lit(None).cast("double")
    got = _get(
        spark, cookies=D.counted_yield(L("Makes 24 small cookies")), sandwich=D.counted_yield(L("3 sandwiches")), other=D.counted_yield(L("a lot")), cups=D.volume_yield(L("about 6 cups")), litre=D.volume_yield(L("2 l")), no=D.volume_yield(L("12 pieces")),
        portion=D.portions(F.array(L("4 boneless chicken breasts"), L("2 fillets"), L("salt"))), by=D.by_amount(L(3000.0), L(600.0)), zero=D.by_amount(L(0.0), L(600.0)),
        first=D.servings([("head", none), ("count", L(6.0)), ("volume", L(9.0))], L(4.0)), drawn=D.servings([("mass", L(20.0))], L(4.0)), prior=D.servings([("mass", none)], L(4.0)),
    )
    assert [got[k] for k in ("cookies", "sandwich", "other", "cups", "litre", "no", "portion", "by", "zero")] == [12.0, 3.0, None, 6.0, 8.0, None, 4.0, 5.0, None]
    assert [tuple(got[k]) for k in ("first", "drawn", "prior")] == [(6.0, "count"), (10.0, "mass"), (4.0, "prior")]


def test_courses(spark):
    L = F.lit
    maps = {"sweets": (2, "dessert"), "starter": (1, "soup")}
    got = _get(
        spark, head=D.head_phrase(L("The Best Easy Chicken Soup with Bread Rolls")), cut=D.head_phrase(L("Apple Pie (quick)")), null=D.head_phrase(F.lit(None).cast("string")), name=D.course_by_name(L("bread pudding")), last=D.course_by_name(L("pudding bread")), no=D.course_by_name(L("chicken")),
        mapped=D.course_by_maps(F.array(L("Sweets"), L("Starter"), L("x")), maps), unmapped=D.course_by_maps(F.array(L("x")), maps), main=D.course_by_items(L(1), L(2), L(0), L(0), L(9)), sweet=D.course_by_items(L(0), L(2), L(0), L(0), L(9)), drink=D.course_by_items(L(0), L(1), L(0), L(1), L(3)),
    )
    assert got == {"head": "chicken soup", "cut": "apple pie", "null": "", "name": "dessert", "last": "bread", "no": None, "mapped": "soup", "unmapped": None, "main": "main", "sweet": "dessert", "drink": "drink"}


def test_annotation_and_mentions(spark):
    words = lambda t: F.array(*map(F.lit, t.split()))
    entries = F.array(*map(F.lit, ("red pepper", "pepper", "red", "pepper sauce", "sea salt")))
    got = _get(
        spark, found=D.annotate(words("hot red pepper sauce and sea salt pepper"), entries), empty=D.annotate(F.array().cast("array<string>"), entries),
        lacks=D.title_mentions(F.lit("Chicken and potatoes"), F.array(F.lit("potato"), F.lit("sea salt")), F.array(F.lit("chicken"), F.lit("potato"), F.lit("beef"))),
    )
    assert [tuple(x) for x in got["found"]] == [(1, "red pepper"), (5, "sea salt"), (7, "pepper")] and got["empty"] == [] and got["lacks"] == ["chicken"]

"""Queries of keys, counters, draws, scores, diets and bands with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dishes
from ..operators import diet, records, scoring
from .tables import Tables

QUERIES, SQLS = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__], SQLS[f.__name__] = f, sql
        return f

    return register


@query("""with r as (select case when l_extendedprice is distinct from l_quantity * p_retailprice then 'selection_mismatch' end as reason from lineitem join part on p_partkey = l_partkey)
select coalesce(reason, 'kept') as reason, count(*) as n from r group by 1""")
def selection_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose stored price is not what quantity and part give."""
    t = Tables(spark, folder)
    rows = t.read("lineitem").join(t.read("part"), F.col("l_partkey") == F.col("p_partkey"))
    marked = records.mismatches(rows, F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))
    return marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'O')
select case when a.k is null then 'new' when b.k is null then 'gone' else 'kept' end as state, count(*) as n from a full join b on a.k = b.k group by 1""")
def rebuilt_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of the finished orders against those of the open ones: kept, gone and new keys."""
    orders = Tables(spark, folder).read("orders").select("o_custkey", "o_orderstatus")
    of = lambda status: orders.where(F.col("o_orderstatus") == status).select("o_custkey").distinct()
    return records.carried(of("F"), of("O"), "o_custkey")


@query("select o_orderkey as key, 1000000 + row_number() over (order by o_totalprice, o_orderkey) as id from orders")
def dense_surrogate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Gapless ids in order of price, by two-level ranks."""
    return records.ranked(Tables(spark, folder).read("orders"), "o_totalprice", "o_orderkey").select(F.col("o_orderkey").alias("key"), (F.col("rank") + 1_000_000).alias("id"))


_BANDS = """with r as (select c_custkey as id, c_mktsegment as stratum, row_number() over (order by c_acctbal, c_custkey) as rank, count(*) over () as n from customer), k as (select *, floor(n * 0.05::double)::bigint as k from r),
b as (select id, stratum, rank, case when rank <= k then 'top' when rank > (n - k) // 2 and rank <= (n - k) // 2 + k then 'middle' when rank > n - k then 'bottom' end as band from k)"""


def _banded(t: Tables) -> DataFrame:
    rows = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"), "c_acctbal")
    return records.ranked(rows, "c_acctbal", "id").select("id", "stratum", "rank", records.bands(F.col("rank"), F.lit(rows.count())).alias("band"))


@query(_BANDS + " select id, rank, band from b where band is not null")
def ranked_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The first, middle and last five hundredths of a ranking."""
    return _banded(Tables(spark, folder)).where("band is not null").select("id", "rank", "band")


@query(_BANDS + ", d as (select id, band, stratum, row_number() over (partition by band, stratum order by md5('blind' || id), id) as nth from b where band is not null) select id, band, stratum from d where nth <= 3")
def stratified_blind_draw(spark: SparkSession, folder: str) -> DataFrame:
    """Three rows of each band and stratum, drawn by a seeded hash."""
    from pyspark.sql import Window

    draw = F.row_number().over(Window.partitionBy("band", "stratum").orderBy(F.md5(F.concat(F.lit("blind"), F.col("id").cast("string"))), "id"))
    return _banded(Tables(spark, folder)).where("band is not null").withColumn("nth", draw).where("nth <= 3").select("id", "band", "stratum")


@query("""with x as (select 'status.' || coalesce(nullif(o_orderstatus, 'P'), '(none)') as name from orders union all select 'priority.' || o_orderpriority from orders union all select 'status.' || coalesce(l_linestatus, '(none)') from lineitem)
select name, count(*) as n from x group by 1""")
def counters_of_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Named counters of two runs, added by name."""
    t = Tables(spark, folder)
    first = records.counters(t.read("orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.col("o_orderpriority").alias("p")), status="s", priority="p")
    second = records.counters(t.read("lineitem"), status="l_linestatus")
    return first.unionByName(second).groupBy("name").agg(F.sum("n").alias("n"))


@query("""with g as (select l_orderkey as id, case when p_size % 3 <> 0 then l_quantity * p_size end as mass from lineitem join part on p_partkey = l_partkey)
select id, case when count(mass) > 0 then floor(sum(mass) / count(mass)::double * count(*) * 100 + 0.5::double) / 100 end as total, count(*) - count(mass) as unknown from g group by 1""")
def mass_with_mean_imputed(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = t.read("lineitem").join(t.read("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.when(F.col("p_size") % 3 != 0, F.col("l_quantity") * F.col("p_size")).alias("mass"))
    return records.with_mean_imputed(rows, "id", "mass").select("id", (F.floor(F.col("total") * 100 + F.lit(0.5)) / 100).alias("total"), "unknown")


@query("""with a as (select p_partkey as slug, case when p_brand = 'Brand#1' then 'hide' else 'lower' end as mode from part where p_brand in ('Brand#1', 'Brand#2', 'Brand#3')), h as (select l_orderkey as id, max(mode = 'hide') as hidden from lineitem join a on l_partkey = slug group by 1)
select slug, mode, count(distinct l_orderkey) as hits, count(distinct l_orderkey) filter (where hidden) as hidden from lineitem join a on l_partkey = slug join h on id = l_orderkey group by 1, 2""")
def hidden_tally(spark: SparkSession, folder: str) -> DataFrame:
    """For each avoided part: how many orders it is in, and how many of these are hidden by it or another one."""
    t = Tables(spark, folder)
    avoided = t.read("part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select(F.col("p_partkey").alias("slug"), F.when(F.col("p_brand") == "Brand#1", "hide").otherwise("lower").alias("mode"))
    hits = t.postings().select("id", "slug").join(avoided, "slug")
    hidden = hits.groupBy("id").agg(F.bool_or(F.col("mode") == "hide").alias("gone"))
    return hits.join(hidden, "id").groupBy("slug", "mode").agg(F.count("*").alias("hits"), F.count_if("gone").alias("hidden"))


@query("select l_orderkey as id, string_agg(distinct p_type, ',' order by p_type) as flags, count(distinct p_type) as n from lineitem join part on p_partkey = l_partkey group by 1")
def union_of_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The flags of an item are those of all its components."""
    t = Tables(spark, folder)
    flags = t.postings().join(t.read("part"), F.col("slug") == F.col("p_partkey")).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("p_type"))))).alias("f"))
    return flags.select("id", F.array_join("f", ",").alias("flags"), F.size("f").cast("long").alias("n"))


@query("select c_custkey as id, c_name as name, null::double as price, c_acctbal as balance from customer union all select p_partkey, p_name, p_retailprice, null from part")
def rebuild_and_carry_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of an older schema carried into a newer one: columns that either lacks are null."""
    t = Tables(spark, folder)
    old = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return new.unionByName(old, allowMissingColumns=True).select("id", "name", "price", "balance")


@query("select doc_id, len(list_filter(string_split(text, chr(10)), lambda l: len(string_split(l, ' ')) > 1 and string_split(l, ' ')[1] = string_split(l, ' ')[-1])) as echoes from documents")
def echoed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that end with the word they begin with, by a named back-reference."""
    echoes = F.size(F.filter(F.split("text", "\n"), lambda line: line.rlike("^(?<a>[^ ]*) (?:.* )?\\k<a>$")))
    return Tables(spark, folder).read("documents").select("doc_id", echoes.cast("long").alias("echoes"))


@query("""with p as (select * from (select o_orderkey as id, o_totalprice as quality from orders order by o_totalprice desc, o_orderkey limit 200)), c as (select id, count(distinct l_partkey) as covered from p left join lineitem on l_orderkey = id group by 1)
select id, covered from p join c using (id) order by covered desc, quality desc, id limit 50""")
def pool_then_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """A pool of 200 by price, re-ranked by what they cover; only the pool's lines are counted."""
    t = Tables(spark, folder)
    pool = t.items().orderBy(F.desc("quality"), "id").limit(200)
    covered = t.postings().join(F.broadcast(pool.select("id")), "id", "left_semi").groupBy("id").agg(F.count("*").alias("covered"))
    rows = pool.join(covered, "id", "left").select("id", "quality", F.coalesce("covered", F.lit(0)).alias("covered"))
    return records.pool_then_rank(rows, [F.desc("quality"), "id"], [F.desc("covered"), F.desc("quality"), "id"], 50).select("id", "covered")


@query("select o_orderkey as id from orders where o_totalprice >= 1000 order by md5('pick' || o_orderkey), o_orderkey limit 1")
def pick_above_floor(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).items().where("quality >= 1000").orderBy(F.md5(F.concat(F.lit("pick"), F.col("id").cast("string"))), "id").limit(1).select("id")


@query(
    """with i as (select case when o_orderstatus = 'P' then null else dayofyear(o_orderdate) end as m from orders) select case when m is null then 'unknown' when m <= 30 then 'quick' when m <= 90 then 'medium' when m <= 180 then 'long' else 'very long' end as band, count(*) as n from i group by 1"""
)
def time_bands(spark: SparkSession, folder: str) -> DataFrame:
    m = F.col("minutes")
    band = F.when(m.isNull(), "unknown").when(m <= 30, "quick").when(m <= 90, "medium").when(m <= 180, "long").otherwise("very long")
    return Tables(spark, folder).items().groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("select lang, count(*) as n, sum(900 + length(text) * 2 + 45 * len(string_split(text, chr(10))))::bigint as bytes from documents group by 1")
def size_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """What a selection would take: a base, something a character and something a line."""
    size = 900 + F.length("text") * 2 + 45 * F.size(F.split("text", "\n"))
    return Tables(spark, folder).read("documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"))


@query("""select page_id, try_cast(nullif(regexp_extract(url, '/([0-9]+)([/?#]|$)', 1), '') as bigint) as number, regexp_matches(lower(html), 'captcha|are you a robot|enable javascript and cookies') as challenge,
len(list_filter(string_split(html, chr(10)), lambda l: trim(l) <> '')) as lines from pages""")
def page_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The number in a page's address, whether it is a bot challenge, and its lines that are not blank."""
    number = F.try_to_number(F.nullif(F.regexp_extract("url", "/([0-9]+)([/?#]|$)", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    challenge = F.lower("html").rlike("captcha|are you a robot|enable javascript and cookies")
    return Tables(spark, folder).read("pages").select("page_id", number.alias("number"), challenge.alias("challenge"), F.size(F.filter(F.split("html", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("lines"))


@query("select 'nation' as kind, n_nationkey as key, to_json({'name': n_name, 'region': n_regionkey}) as body from nation union all select 'customer', c_custkey, to_json({'name': c_name, 'nation': c_nationkey}) from customer")
def backup_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of different schemas as one table of JSON bodies; one row a row, so no body grows with the data."""
    t = Tables(spark, folder)
    a = t.read("nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("key"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("body"))
    b = t.read("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("body"))
    return a.unionByName(b)


_LINES = """with l as (select l_orderkey as id, count(*) as n, count(*) filter (where p_type = 'ECONOMY') as fresh, count(*) filter (where p_type <> 'PROMO') as counted, count(*) filter (where l_tax >= 0.07::double) as short, count(*) filter (where p_brand = 'Brand#3') as rich,
max(l_quantity) * 60 as longest, sum(l_quantity) * 20 as chars, count(*) filter (where l_returnflag <> 'R') / count(*)::double as resolved, count(*) filter (where p_size % 5 <> 0) / count(*)::double as qty from lineitem join part on p_partkey = l_partkey group by 1),
i as (select *, case o_orderpriority when '1-URGENT' then 'dessert' when '2-HIGH' then 'baking' when '3-MEDIUM' then 'main' when '5-LOW' then 'side' end as course, o_orderstatus = 'P' as trunc from l join orders on o_orderkey = id)"""
_CLIP = "greatest(0::double, least(1::double, {}))"
_TERMS = f"""t as (select *, case when n < 4 then 0 when n = 4 then 0.15 when n = 5 then 0.3 when n = 6 then 0.45 when n = 7 then 0.65 when n = 8 then 0.85 when n <= 20 then 1 when n <= 30 then 0.8 else 0.5 end::double as t_lines,
case when trunc or chars < 40 then 0::double when longest > 2500 or chars > 8000 then 0.5::double else (case when chars < 150 then 0.1::double * chars / 150 else {_CLIP.format("(chars - 150) / 550::double")} end) * (case when n <= 1 and chars < 400 then 0.5 else 1 end)::double end as t_method,
case when course in ('dessert', 'baking') then 0.5::double + 0.5::double * least(1::double, coalesce(fresh / nullif(counted, 0)::double, 0::double) / 0.25::double) else least(1::double, coalesce(fresh / nullif(counted, 0)::double, 0::double) / 0.6::double) end as f0,
0.8::double * least(1::double, short / n::double) as f1,
1::double - 0.5::double * (coalesce(course not in ('dessert', 'baking'), true) and (rich >= 2 or (rich >= 1 and n <= 4)))::int as t_style from i)"""


@query(
    "".join((_LINES, ", ", _TERMS))
    + f""" select id, floor((0.15::double * t_lines + 0.17::double * t_method + 0.10::double * greatest(0::double, f0 - f1) + 0.10::double * greatest(0::double, t_style) + 0.06::double * {_CLIP.format("(resolved - 0.5::double) / 0.5::double")} + 0.05::double * qty) / 0.63::double
 * case when trunc then 0.7 else 1 end::double * case when resolved < 0.6::double then 0.8 else 1 end::double * 10000 + 0.5::double) / 10000 as score from t"""
)
def content_score(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score from content alone: lines, method, freshness, style, readable lines and amounts, with its factors for defects."""
    t, c = Tables(spark, folder), F.col
    rows = t.read("lineitem").join(t.read("part"), c("l_partkey") == c("p_partkey")).groupBy(c("l_orderkey").alias("id")).agg(
        F.count("*").alias("n"), F.count_if(c("p_type") == "ECONOMY").alias("fresh"), F.count_if(c("p_type") != "PROMO").alias("counted"), F.count_if(c("l_tax") >= 0.07).alias("short"), F.count_if(c("p_brand") == "Brand#3").alias("rich"),
        (F.max("l_quantity") * 60).alias("longest"), (F.sum("l_quantity") * 20).alias("chars"), (F.count_if(c("l_returnflag") != "R") / F.count("*")).alias("resolved"), (F.count_if(c("p_size") % 5 != 0) / F.count("*")).alias("qty"),
    )
    course = F.when(c("o_orderpriority") == "1-URGENT", "dessert").when(c("o_orderpriority") == "2-HIGH", "baking").when(c("o_orderpriority") == "3-MEDIUM", "main").when(c("o_orderpriority") == "5-LOW", "side")
    rows = rows.join(t.read("orders"), c("id") == c("o_orderkey")).withColumn("course", course).withColumn("trunc", c("o_orderstatus") == "P")
    nothing = F.lit(None).cast("array<string>")
    terms = {
        "lines": scoring.lines_term(c("n")), "method": scoring.method_term(c("chars"), c("longest"), c("n"), F.lit(0), c("trunc")), "fresh": scoring.freshness(c("fresh"), c("counted"), c("short"), c("n"), c("course")),
        "style": scoring.style_term(nothing, c("rich"), c("n"), c("course")), "parse": scoring.clip((c("resolved") - 0.5) / F.lit(0.5)), "qty": c("qty"),
    }
    score = scoring.quality_score(terms, F.lit(False), c("trunc"), c("resolved"), ("domain", "time", "rating", "pop", "extras"))
    return rows.select("id", (F.floor(score * 10000 + F.lit(0.5)) / 10000).alias("score"))


@query("""with p as (select p_partkey as slug, case when p_size = 1 then null when p_type = 'PROMO' then ['meat'] when p_brand in ('Brand#5', 'Brand#6') then ['dairy'] else []::varchar[] end as flags, p_brand as above from part),
s as (select p_brand as target, p_partkey as stand_in, p_size % 4 as quality, p_type, p_size from part),
best as (select target, stand_in from (select *, row_number() over (partition by target order by quality desc, p_size % 2, stand_in) as k from s where quality >= 2 and p_type <> 'PROMO' and target not in ('Brand#5', 'Brand#6') and p_size % 2 = 0) where k = 1),
l as (select l_orderkey as id, l_linenumber as line, slug, coalesce(len(list_intersect(flags, ['meat', 'dairy'])) > 0, false) as offends, stand_in, l_returnflag = 'A' as omit, flags from lineitem join p on slug = l_partkey left join best on target = above),
r as (select id, count(*) filter (where offends and stand_in is null and not omit) as blockers, count(*) filter (where offends and not (stand_in is null and not omit)) as swapped, count(flags) as read from l group by 1)
select id, case when read = 0 then 'unknown' when blockers > 0 then 'no' when swapped > 0 then 'adaptable' else 'ok' end as status, blockers, swapped from r""")
def diet_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that offend are met by a stand-in of their brand, or may be left out where they were returned; parts of size 1 cannot be read."""
    t, c = Tables(spark, folder), F.col
    part = t.read("part")
    none = F.array().cast("array<string>")
    flags = F.when(c("p_size") == 1, F.lit(None)).when(c("p_type") == "PROMO", F.array(F.lit("meat"))).when(c("p_brand").isin("Brand#5", "Brand#6"), F.array(F.lit("dairy"))).otherwise(none)
    known = part.select(c("p_partkey").alias("slug"), flags.alias("flags"))
    closure = part.select(c("p_partkey").alias("slug"), c("p_brand").alias("above"))
    own = F.when(c("p_type") == "PROMO", F.array(F.lit("meat"))).when(c("p_brand").isin("Brand#5", "Brand#6"), F.array(F.lit("dairy"))).otherwise(none)
    only = F.when(c("p_size") % 2 == 0, none).otherwise(F.array(F.lit("never")))
    stand_ins = part.select(c("p_brand").alias("target"), c("p_partkey").cast("string").alias("stand_in"), (c("p_size") % 4).alias("quality"), own.alias("flags"), only.alias("only"))
    # A brand's parts share their stand-ins, so the best is found once a brand.
    brands = part.select(c("p_brand").alias("id"), F.lit(0).alias("line"), c("p_brand").alias("slug"), F.array(F.lit("any")).alias("fits")).distinct()
    best = diet.best_stand_in(brands, brands.select("slug", c("slug").alias("above"), F.lit(0).alias("depth")), stand_ins, ("meat", "dairy")).select(c("id").alias("above"), "stand_in")
    line = t.read("lineitem")
    lines = line.select(c("l_orderkey").alias("id"), F.xxhash64(*line.columns).alias("line"), c("l_partkey").alias("slug"), (c("l_returnflag") == "A").alias("omit")).join(known, "slug", "left")
    swaps = lines.select("id", "line", "slug").join(closure, "slug").join(best, "above").select("id", "line", "stand_in").distinct()
    rows = lines.select("id", "line", F.when(c("flags").isNotNull(), c("slug")).alias("slug"), "flags", F.array().cast("array<array<string>>").alias("written"), "omit")
    return diet.decide(rows, swaps, ("meat", "dairy"))


@query("""with f as (select l_orderkey as id, count(*) filter (where p_type = 'PROMO') as protein, count(*) filter (where p_type = 'SMALL') as sweet, count(*) filter (where p_type = 'ECONOMY') as savoury, count(*) filter (where p_brand = 'Brand#9') as alcohol, count(*) as items from lineitem join part on p_partkey = l_partkey group by 1)
select id, case when alcohol > 0 and items <= 6 then 'drink' when sweet >= 2 and protein = 0 and savoury = 0 then 'dessert' when protein > 0 then 'main' when savoury > 0 then 'side' end as course from f""")
def course_from_items(spark: SparkSession, folder: str) -> DataFrame:
    """The course that an item's parts suggest."""
    t, c = Tables(spark, folder), F.col
    kinds = {"protein": c("p_type") == "PROMO", "sweet": c("p_type") == "SMALL", "savoury": c("p_type") == "ECONOMY", "alcohol": c("p_brand") == "Brand#9"}
    rows = t.read("lineitem").join(t.read("part"), c("l_partkey") == c("p_partkey")).groupBy(c("l_orderkey").alias("id")).agg(*(F.count_if(holds).alias(n) for n, holds in kinds.items()), F.count("*").alias("items"))
    return rows.select("id", dishes.course_by_items(*(c(n) for n in (*kinds, "items"))).alias("course"))


@query("""with m as (select l_orderkey as id, sum(case when p_size % 3 <> 0 then l_quantity * p_size end) as mass from lineitem join part on p_partkey = l_partkey group by 1), v as (select id, case when mass > 0 then mass / 150.0::double end as v from m),
d as (select id, v, case when v > 8 then v / 2 when v < 2 then v * 2 else coalesce(v, 4) end as drawn from v)
select id, greatest(1::double, least(100::double, floor(drawn + 0.5::double))) as servings, case when v is not null then 'mass' else 'prior' end as tier from d""")
def servings_by_mass(spark: SparkSession, folder: str) -> DataFrame:
    """Servings from the mass that could be read, drawn towards four; four where nothing could."""
    t, c = Tables(spark, folder), F.col
    rows = t.read("lineitem").join(t.read("part"), c("l_partkey") == c("p_partkey")).groupBy(c("l_orderkey").alias("id")).agg(F.sum(F.when(c("p_size") % 3 != 0, c("l_quantity") * c("p_size"))).alias("mass"))
    told = dishes.servings([("mass", dishes.by_amount(c("mass"), F.lit(150.0)))], F.lit(4.0))
    return rows.select("id", told.alias("s")).select("id", "s.servings", "s.tier")


@query("""with w as (select doc_id, len(list_filter(string_split(regexp_replace(translate(lower(regexp_replace(replace(text, '&', ' and '), '[''’]', '', 'g')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) as n from documents)
select doc_id, case when n < 8 then 'too_short' else 'ok' end as status from w""")
def steps_status(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a text's lines say enough to follow."""
    return Tables(spark, folder).read("documents").select("doc_id", dishes.steps_status(F.split("text", "\n")).alias("status"))

"""Queries of the curation family with their SQL: routing, texts, sampling, scores, clusters, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.records import running
from ..operators import routing as R
from ..operators import sampling as S
from ..operators import scoring as Q
from ..operators.clustering import leader_clusters
from ..operators.matching import jaccard
from .tables import Tables

QUERIES, SQLS = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__], SQLS[f.__name__] = f, sql
        return f

    return register


_REASON = """case when doc_id is null then 'no_id' when text is null or trim(text) = '' then 'no_text' when lang not in ('en', 'fr', 'de') then 'excluded_lang'
 when n_chars < 100 then 'too_short' when n_chars > 15000 then 'too_long' end"""


def _routed(t: Tables) -> DataFrame:
    checks = (("no_id", F.col("doc_id").isNull()), ("no_text", F.col("text").isNull() | (F.trim("text") == "")), ("excluded_lang", ~F.col("lang").isin("en", "fr", "de")), ("too_short", F.col("n_chars") < 100), ("too_long", F.col("n_chars") > 15000))
    return t.read("documents").withColumn("reason", R.first_reason(*checks))


@query(f"select doc_id, {_REASON} as reason from documents")
def drop_reason_router(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(Tables(spark, folder)).select("doc_id", "reason")


@query(f"with r as (select *, {_REASON} as reason from documents), t as (select source, count(*) as selected, count(*) filter (where reason is null) as written from r group by source) select r.source, reason, count(*) as n, min(doc_id) as example, any_value(selected) as selected, any_value(written) as written from r join t using (source) where reason is not null group by r.source, reason")
def drop_ledger_conservation(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger beside the totals of its source: selected = written + dropped."""
    routed = _routed(Tables(spark, folder))
    totals = routed.groupBy("source").agg(F.count("*").alias("selected"), F.count_if(F.col("reason").isNull()).alias("written"))
    return R.ledger(routed, "source", "doc_id", "doc_id").join(totals, "source")


@query("select source, count(*) filter (where lang is not null and lang not in ('en', 'fr')) as coerced, count(*) filter (where lang in ('en', 'fr')) as kept from documents group by source")
def enum_coercion_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).read("documents").withColumn("value", R.coerce(F.col("lang"), ["en", "fr"]))
    return rows.groupBy("source").agg(F.count_if(F.col("lang").isNotNull() & F.col("value").isNull()).alias("coerced"), F.count("value").alias("kept"))


_FLAGS = "list_filter([case when regexp_matches(text, 'https?://|www[.]') then 'link' end, case when regexp_matches(text, '!!|[$][$][$]|###') then 'shouting' end, case when regexp_matches(text, '[0-9]{16}') then 'long_number' end, case when regexp_matches(text, '(?i)licensed under|license, version') then 'license' end], lambda x: x is not null)"


def _junk() -> F.Column:
    text = F.col("text")
    return R.flags(("link", text.rlike("https?://|www[.]")), ("shouting", text.rlike("!!|[$][$][$]|###")), ("long_number", text.rlike("[0-9]{16}")), ("license", text.rlike("(?i)licensed under|license, version")))


@query(f"select flag, count(*) as n from (select unnest({_FLAGS}) as flag from documents) group by flag")
def junk_flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).read("documents").select(F.explode(_junk()).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"select doc_id, case when list_contains(f, 'license') then 'license' when list_contains(f, 'shouting') then 'shouting' end as hard from (select doc_id, {_FLAGS} as f from documents)")
def hard_flag_precedence(spark: SparkSession, folder: str) -> DataFrame:
    hard = F.array(F.lit("license"), F.lit("shouting"))
    return Tables(spark, folder).read("documents").select("doc_id", F.get(F.array_intersect(hard, _junk()), F.lit(0)).alias("hard"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), h as (select doc_id, trim(line) as line from l)
select doc_id, count(*) as n_lines, count(*) filter (where length(line) >= 5 and length(line) % 2 = 1 and substr(line, (length(line) + 1) // 2, 1) = ' ' and left(line, (length(line) - 1) // 2) = right(line, (length(line) - 1) // 2)) as repeated from h group by doc_id""")
def repeated_line_detector(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are one half, a space, and the half again."""
    half = lambda x: ((F.length(x) - 1) / 2).cast("int")
    twice = lambda x: (F.length(x) >= 5) & (F.length(x) % 2 == 1) & (F.substring(x, half(x) + 1, F.lit(1)) == " ") & (F.left(x, half(x)) == F.right(x, half(x)))
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    return Tables(spark, folder).read("documents").where("text is not null").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, twice)).cast("long").alias("repeated"))


_TEXT = r"""regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"""
_TEXT = rf"regexp_replace(regexp_replace(regexp_replace({_TEXT}, '[\r\n]+', ' ', 'g'), '<br */?>|</div>|</p>', chr(10), 'g'), '<[^>]*>', '', 'g')"
_NAMES = ", ".join(f"'{name}': '{plain.replace(chr(39), chr(39) * 2)}'" for name, plain in X.ENTITIES.items())
_REF = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);', 1)"
_POINT = f"case when regexp_matches({_REF}, '^#[xX]') then ('0x' || substr({_REF}, 3))::int when starts_with({_REF}, '#') then substr({_REF}, 2)::int end"
_CHAR = f"case when ({_POINT}) between 1 and 55295 or ({_POINT}) between 57344 and 1114111 then chr({_POINT}) end"
_TEXT = f"""array_to_string(list_transform(string_split({_TEXT}, '&'), lambda p, i: case when i = 1 then p
 else coalesce(coalesce(map {{{_NAMES}}}[{_REF}], {_CHAR}) || substr(p, length({_REF}) + 2), '&' || p) end), '')"""
_TEXT = rf"trim(regexp_replace(regexp_replace({_TEXT}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ' || chr(10))"


@query(f"select page_id, length(t) as n_chars, md5(t) as text_md5 from (select page_id, {_TEXT} as t from pages)")
def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    text = X.html_to_text(F.col("html"))
    return Tables(spark, folder).read("pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^(www2?|m)\.', '')"


@query(f"select host, n, case when host = 'example.org' or host like '%.example.org' then 0.9 when host = 'example.com' or host like '%.example.com' then 0.6 else 0.3 end::double as prior from (select {_HOST} as host, count(*) as n from pages group by 1)")
def url_domain_prior(spark: SparkSession, folder: str) -> DataFrame:
    hosts = Tables(spark, folder).read("pages").groupBy(X.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return hosts.withColumn("prior", Q.longest_suffix(F.col("host"), {"example.com": 0.6, "example.org": 0.9}, 0.3))


@query("with o as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as r, greatest(1, count(*) over (partition by source) // 7) as step from documents) select source, doc_id from o where r % step = 0 and r < step * 7")
def stride_sample(spark: SparkSession, folder: str) -> DataFrame:
    return S.stride(Tables(spark, folder).read("documents").select("source", "doc_id"), "source", "doc_id", 7)


@query("with o as (select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 as r, count(*) over (partition by lang) as n from documents), k as (select lang, n, unnest(range(40)) * n // 40 as r from (select distinct lang, n from o)) select lang, doc_id from o where n <= 40 or (lang, r) in (select lang, r from k)")
def even_rank_sample(spark: SparkSession, folder: str) -> DataFrame:
    return S.even_ranks(Tables(spark, folder).read("documents").select("lang", "doc_id"), "lang", "doc_id", 40)


@query("""with c as (select lang, count(*) as n from documents group by lang), s as (select *, row_number() over (order by n, lang) as i, count(*) over () as k, coalesce(sum(n) over (order by n, lang rows between unbounded preceding and 1 preceding), 0) as before from c),
lvl as (select coalesce(min(case when n * (k - i + 1) > 500 - before then (500 - before) // (k - i + 1) end), max(n)) as level from (select * from s order by i) where true),
f as (select level from (select first((500 - before) // (k - i + 1) order by i) as level from s where n * (k - i + 1) > 500 - before))
select lang, count(*) as taken from (select lang, row_number() over (partition by lang order by doc_id) as r from documents) where r <= coalesce((select level from f), (select max(n) from c)) group by lang""")
def quota_sample_equal_share(spark: SparkSession, folder: str) -> DataFrame:
    rows = Tables(spark, folder).read("documents").select("lang", "doc_id")
    level = S.water_level(rows.groupBy("lang").agg(F.count("*").alias("size")), 500)
    return S.top_per(rows, ["lang"], [F.asc("doc_id")], level).groupBy("lang").agg(F.count("*").alias("taken"))


_NORM = f"trim(regexp_replace(regexp_replace(regexp_replace(replace(translate(lower(string_split(text, chr(10))[1]), '{X.LATIN}', '{X.LATIN_PLAIN}'), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"


def _titled(t: Tables) -> DataFrame:
    title = X.normalise(F.get(F.split("text", "\n"), F.lit(0)))
    members = F.array_distinct(X.words(X.normalise(F.col("text"))))
    return t.read("documents").where("text is not null").select(F.col("doc_id").alias("id"), title.alias("title"), F.col("n_chars").cast("double").alias("score"), members.alias("members"))


@query(None)
def dedupe_normalised_title(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies under one normalised title; order matters, so a brute-force test checks it."""
    return leader_clusters(_titled(Tables(spark, folder)))


@query(f"select title, count(*) as n, min(doc_id) as first from (select doc_id, {_NORM} as title from documents where text is not null) where title <> '' group by title having count(*) > 1")
def title_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _titled(Tables(spark, folder)).where("title <> ''").groupBy("title").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


@query("""with v as (select l_orderkey as id, list(distinct l_partkey) as s, min(l_suppkey) as block from lineitem group by 1)
select a.id as a, b.id as b, round(len(list_intersect(a.s, b.s))::double / len(list_distinct(list_concat(a.s, b.s))), 6) as score from v a join v b on a.block = b.block and a.id < b.id
where len(list_intersect(a.s, b.s)) > 0""")
def jaccard_pairs_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of one block that share a slug: joined on both, so pairs that share nothing never arise."""
    lines = Tables(spark, folder).read("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("slug"), F.col("l_suppkey").alias("supp"))
    sets = lines.groupBy("id").agg(F.collect_set("slug").alias("s"), F.min("supp").alias("block"))
    flat = sets.select("id", "block", F.explode("s").alias("slug"), F.size("s").alias("n"))
    other = flat.select(F.col("id").alias("b"), "block", "slug", F.col("n").alias("bn"))
    both = flat.withColumnRenamed("id", "a").join(other, ["block", "slug"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("bn").alias("bn"))
    return both.select("a", "b", F.round(F.col("k") / (F.col("n") + F.col("bn") - F.col("k")), 6).alias("score"))


@query("""select doc_id, round((0.4 * case when n_chars <= 0 then 0 when n_chars < 500 then n_chars / 500.0 when n_chars < 5000 then 1 when n_chars < 20000 then 1 - (n_chars - 5000) * (0.8 / 15000) else 0.2 end
 + 0.4 * coalesce(l.quality, 0.5) + 0.2 * case lang when 'en' then 1 when 'fr' then 0.8 else 0.5 end) * case when coalesce(toxic, 0) = 1 then 0.1 else 1 end, 3)::double as score
from documents left join labels l using (doc_id)""")
def quality_score_terms(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = t.read("documents").select("doc_id", "n_chars", "lang").join(t.read("labels"), "doc_id", "left")
    terms = {
        "length": (0.4, Q.ramp(F.col("n_chars"), (0, 0.0), (500, 1.0), (5000, 1.0), (20000, 0.2))), "label": (0.4, F.coalesce(F.col("quality").cast("double"), F.lit(0.5))),
        "lang": (0.2, F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "fr", 0.8).otherwise(0.5)),
    }
    factor = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0.1).otherwise(1.0)
    return rows.select("doc_id", F.round(Q.weighted(terms) * factor, 3).alias("score"))


@query("select user_id, count(*) as n_reviews, count(*) filter (where stars > 0) as n_rated, round(avg(stars) filter (where stars > 0), 4) as mean, round((4.6 * 5 + coalesce(sum(stars) filter (where stars > 0), 0)) / (count(*) filter (where stars > 0) + 5), 6) as shrunk from (select user_id, floor(value)::bigint % 6 as stars from events) group by user_id")
def bayes_rating(spark: SparkSession, folder: str) -> DataFrame:
    """A rating of 0 is a review without stars: it counts, but not in the mean."""
    stars = Tables(spark, folder).read("events").select("user_id", (F.floor("value") % 6).alias("stars"))
    rated = F.when(F.col("stars") > 0, F.col("stars"))
    out = stars.groupBy("user_id").agg(F.count("*").alias("n_reviews"), F.count(rated).alias("n_rated"), F.avg(rated).alias("avg"), F.sum(rated).alias("total"))
    return out.select("user_id", "n_reviews", "n_rated", F.round("avg", 4).alias("mean"), F.round(Q.shrunk_mean(F.col("total").cast("double"), F.col("n_rated"), 4.6, 5), 6).alias("shrunk"))


@query("select user_id, round(least(1, ln(1 + count(*)) / ln(21)), 6) as term from events where event_type = 'purchase' group by user_id")
def popularity_term(spark: SparkSession, folder: str) -> DataFrame:
    counts = Tables(spark, folder).read("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.round(Q.popularity(F.col("n")), 6).alias("term"))


@query("""with s as (select doc_id, lang, n_chars as score from documents), b as (select score as bar from (select score, row_number() over (order by score desc) - 1 as r, count(*) over () as n from s) where r = floor(0.75::double * (n - 1)) )
select lang, doc_id, n::int as n from (select s.*, row_number() over (partition by lang order by score desc, doc_id) as n from s where score >= (select bar from b)) where n <= 30""")
def select_floor_quota(spark: SparkSession, folder: str) -> DataFrame:
    """The floor of each language: its best rows above the bar, up to a quota."""
    rows = Tables(spark, folder).read("documents").select("doc_id", "lang", F.col("n_chars").alias("score"))
    bar = S.nearest_rank(rows, "score", 0.25).select(F.col("value").alias("bar"), F.lit(1).alias("one"))
    good = rows.withColumn("one", F.lit(1)).join(F.broadcast(bar), "one").where("score >= bar")
    return S.top_per(good, ["lang"], [F.desc("score"), F.asc("doc_id")], 30).select("lang", "doc_id", F.col("nth").alias("n"))


@query("select o_orderpriority as course, o_totalprice as value from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc) - 1 as r, count(*) over (partition by o_orderpriority) as n from orders) where r = floor((1 - 0.9::double) * (n - 1))")
def nearest_rank_quantile(spark: SparkSession, folder: str) -> DataFrame:
    each = Window.partitionBy("course")
    rows = Tables(spark, folder).read("orders").select(F.col("o_orderpriority").alias("course"), F.col("o_totalprice").alias("value"))
    placed = rows.withColumn("r", F.row_number().over(each.orderBy(F.desc("value"))) - 1).withColumn("n", F.count("*").over(each))
    return placed.where(F.col("r") == F.floor((F.lit(1) - F.lit(0.9)) * (F.col("n") - 1))).select("course", "value")


@query("""with r as (select avg(a) over (partition by x) as rx, avg(b) over (partition by y) as ry from (select n_chars as x, quality as y, row_number() over (order by n_chars) as a, row_number() over (order by quality) as b from documents join labels using (doc_id)))
select round(corr(rx, ry), 6) as rho, count(*) as n from r""")
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    """Average ranks come from counts of values and two-level running sums, so no task sorts all of them."""
    t = Tables(spark, folder)
    rows = t.read("documents").select("doc_id", F.col("n_chars").alias("x")).join(t.read("labels").select("doc_id", F.col("quality").alias("y")), "doc_id")

    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count("*").alias("k"))
        return running(counts, c, weight="k").select(c, (F.col("rank") - (F.col("k") - 1) / 2).alias(f"r{c}"))

    return rows.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.round(F.corr("rx", "ry"), 6).alias("rho"), F.count("*").alias("n"))


@query("""with r as (select o_totalprice as v, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as i, count(*) over () as n from orders)
select case when i < n // 3 then 'top' when i >= n - n // 3 then 'bottom' else 'middle' end as band, count(*) as size, round(avg(v), 2) as mean from r group by 1""")
def tertile_band_means(spark: SparkSession, folder: str) -> DataFrame:
    """Thirds of sizes t, n - 2t and t of a ranking in two levels."""
    rows = Tables(spark, folder).read("orders").select("o_orderkey", F.col("o_totalprice").alias("v"), (-F.col("o_totalprice")).alias("down"))
    placed = running(rows, "down", "o_orderkey").select("v", (F.col("rank") - 1).alias("i"), F.col("all").alias("n"))
    third = F.floor(F.col("n") / 3)
    band = F.when(F.col("i") < third, "top").when(F.col("i") >= F.col("n") - third, "bottom").otherwise("middle")
    return placed.groupBy(band.alias("band")).agg(F.count("*").alias("size"), F.round(F.avg("v"), 2).alias("mean"))


@query("""with p as (select quality = 1 as truth, n_chars > 1500 as pred from documents join labels using (doc_id))
select count(*) filter (where truth and pred) as tp, count(*) filter (where not truth and pred) as fp, count(*) filter (where truth and not pred) as fn, count(*) filter (where not truth and not pred) as tn,
 round(count(*) filter (where truth and pred) / nullif(count(*) filter (where pred), 0)::double, 6) as precision, round(count(*) filter (where truth and pred) / nullif(count(*) filter (where truth), 0)::double, 6) as recall from p""")
def confusion_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = t.read("documents").select("doc_id", (F.col("n_chars") > 1500).alias("pred")).join(t.read("labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id")
    cell = lambda truth, pred: F.count_if((F.col("truth") == truth) & (F.col("pred") == pred))
    out = rows.agg(cell(True, True).alias("tp"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(False, False).alias("tn"))
    return out.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


@query("""with c as (select lang, source, doc_id, row_number() over (partition by lang order by (source <> 'src0'), doc_id) as n from documents), cap as (select 5 * min(k) as cap from (select count(*) as k from documents where source = 'src1' group by lang))
select lang, doc_id from c where n <= (select cap from cap)""")
def class_cap(spark: SparkSession, folder: str) -> DataFrame:
    """No class has more than five times the smallest one's gold rows; the others are trimmed first."""
    docs = Tables(spark, folder).read("documents").select("lang", "source", "doc_id")
    cap = docs.where("source = 'src1'").groupBy("lang").count().agg((5 * F.min("count")).alias("cap"), F.lit(1).alias("one"))
    n = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("source") != "src0", "doc_id"))
    return docs.withColumn("n", n).withColumn("one", F.lit(1)).join(F.broadcast(cap), "one").where("n <= cap").select("lang", "doc_id")


@query("select doc_id, (n >= 15 and (r - 1) % 5 = 0) as test, md5(doc_id::varchar) as key, list_contains(['1','3','5','7','9','b','d','f'], right(md5(doc_id::varchar), 1)) as odd from (select doc_id, row_number() over (partition by lang order by doc_id) as r, count(*) over (partition by lang) as n from documents)")
def deterministic_split(spark: SparkSession, folder: str) -> DataFrame:
    each = Window.partitionBy("lang")
    rows = Tables(spark, folder).read("documents").select("doc_id", F.row_number().over(each.orderBy("doc_id")).alias("r"), F.count("*").over(each).alias("n"))
    key = F.md5(F.col("doc_id").cast("string"))
    return rows.select("doc_id", ((F.col("n") >= 15) & ((F.col("r") - 1) % 5 == 0)).alias("test"), key.alias("key"), F.right(key, F.lit(1)).isin(*"13579bdf").alias("odd"))

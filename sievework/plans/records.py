"""Queries of record handling and model evaluation with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tagging as G
from ..operators.calibrate import medians
from ..operators.routing import mark_duplicates
from .tables import Tables

QUERIES, SQLS = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__], SQLS[f.__name__] = f, sql
        return f

    return register


@query("select source, count(*) filter (where nth = 1) as kept, count(*) filter (where nth > 1) as duplicate_id, min(doc_id) filter (where nth > 1) as example from (select *, row_number() over (partition by md5(text) order by source, doc_id) as nth from documents) group by source")
def first_row_of_a_key_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = mark_duplicates(Tables(spark, folder).read("documents").select("source", "doc_id", F.md5("text").alias("key")), ["key"], ["source", "doc_id"])
    again = F.col("nth") > 1
    return rows.groupBy("source").agg(F.count_if(~again).alias("kept"), F.count_if(again).alias("duplicate_id"), F.min(F.when(again, F.col("doc_id"))).alias("example"))


@query("""with refs as (select event_id, event_id % 4 as kind, user_id as ref from events) select event_id, coalesce(c_name, s_name, p_name) as name, case when coalesce(c_name, s_name, p_name) is null then 'unresolved' else ['customer', 'supplier', 'part'][kind + 1] end as origin
from refs left join customer on kind = 0 and c_custkey = ref left join supplier on kind = 1 and s_suppkey = ref left join part on kind = 2 and p_partkey = ref""")
def resolve_references(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    refs = t.read("events").select("event_id", (F.col("event_id") % 4).alias("kind"), F.col("user_id").alias("ref"))
    named = lambda table, key, name, kind, alias: t.read(table).select(F.col(key).alias("ref"), F.lit(kind).cast("long").alias("kind"), F.col(name).alias(alias))
    every = refs.join(named("customer", "c_custkey", "c_name", 0, "c"), ["ref", "kind"], "left").join(named("supplier", "s_suppkey", "s_name", 1, "s"), ["ref", "kind"], "left").join(named("part", "p_partkey", "p_name", 2, "p"), ["ref", "kind"], "left")
    origin = F.when(F.col("c").isNotNull(), "customer").when(F.col("s").isNotNull(), "supplier").when(F.col("p").isNotNull(), "part").otherwise("unresolved")
    return every.select("event_id", F.coalesce("c", "s", "p").alias("name"), origin.alias("origin"))


@query("with r as (select source, doc_id, row_number() over (partition by source order by md5('draw' || doc_id), doc_id) as n from documents) select source, doc_id from r where n <= 5")
def seeded_draw_per_source(spark: SparkSession, folder: str) -> DataFrame:
    """A draw that a seed and the key decide, the same on every run and partitioning."""
    rows = Tables(spark, folder).read("documents").select("source", "doc_id")
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("draw"), F.col("doc_id").cast("string"))), "doc_id"))
    return rows.withColumn("n", n).where("n <= 5").select("source", "doc_id")


@query("""with s as (select n_chars / 3000.0::double as score, quality = 1 as truth from documents join labels using (doc_id)), t as (select unnest(range(1, 20)) * 0.05::double as threshold)
select round(threshold, 2) as threshold, count(*) filter (where score >= threshold) as taken, round(coalesce(count(*) filter (where score >= threshold and truth) / nullif(count(*) filter (where score >= threshold), 0)::double, 0), 6) as precision from t, s group by threshold""")
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Counts at every threshold from one pass: rows fall into steps, and steps are summed from above."""
    t = Tables(spark, folder)
    rows = t.read("documents").select("doc_id", (F.col("n_chars") / 3000.0).alias("score")).join(t.read("labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id")
    steps = F.array(*(F.lit(i * 0.05) for i in range(1, 20)))
    step = F.size(F.filter(steps, lambda x: F.col("score") >= x))
    counts = rows.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.count_if("truth").alias("k"))
    grid = spark.range(1, 20).select(F.col("id").cast("int").alias("at"))
    above = grid.join(F.broadcast(counts), F.col("step") >= F.col("at"), "left").groupBy("at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("taken"), F.sum("k").alias("k"))
    return above.select(F.round(F.col("at") * 0.05, 2).alias("threshold"), "taken", F.round(F.coalesce(F.try_divide("k", "taken"), F.lit(0.0)), 6).alias("precision"))


@query("""with m as (select o_orderpriority as course, median(o_totalprice) as prior from orders where o_orderkey % 2 = 0 group by 1)
select course, any_value(prior) as prior, count(*) as n, count(*) filter (where o_totalprice between prior * 0.5 and prior * 1.5) as hits from orders join m on course = o_orderpriority where o_orderkey % 2 = 1 group by course""")
def calibrated_priors(spark: SparkSession, folder: str) -> DataFrame:
    """Medians fitted on one half, hits counted on the other."""
    rows = Tables(spark, folder).items().select("id", "course", "quality")
    prior = medians(rows.where("id % 2 = 0"), "course", "quality").withColumnRenamed("median", "prior")
    held = rows.where("id % 2 = 1").join(F.broadcast(prior), "course")
    return held.groupBy("course").agg(F.first("prior").alias("prior"), F.count("*").alias("n"), F.count_if(F.col("quality").between(F.col("prior") * 0.5, F.col("prior") * 1.5)).alias("hits"))


@query("""with r as (select o_orderkey as id, row_number() over (order by o_totalprice desc, o_orderkey) as a from orders where o_orderpriority = '1-URGENT'), s as (select o_orderkey as id, row_number() over (order by o_totalprice desc, o_orderkey) as b from orders where o_orderpriority = '1-URGENT' and o_orderstatus <> 'F')
select id, case when b is null then 'left' when b < a then 'up' else 'kept' end as movement, a - b as places from r left join s using (id)""")
def ranking_movement(spark: SparkSession, folder: str) -> DataFrame:
    """Places before and after, of one class; ranks stay inside it."""
    urgent = Tables(spark, folder).items().where("course = '1-URGENT'")
    rank = lambda name: F.row_number().over(Window.partitionBy("course").orderBy(F.desc("quality"), "id")).cast("long").alias(name)
    both = urgent.select("id", rank("a")).join(urgent.where("diet <> 'ok'").select("id", rank("b")), "id", "left")
    return both.select("id", F.when(F.col("b").isNull(), "left").when(F.col("b") < F.col("a"), "up").otherwise("kept").alias("movement"), (F.col("a") - F.col("b")).alias("places"))


@query("""with t as (select doc_id, len(regexp_extract_all(lower(text), '(^|[^a-z0-9])(the|der)([^a-z0-9]|$)')) > 0 as a, regexp_matches(lower(text), '(^|[^a-z0-9])(of|und)([^a-z0-9]|$)') as b from documents) select a, b, count(*) as n from t group by 1, 2""")
def tag_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    word = lambda w: F.lower("text").rlike(f"(^|[^a-z0-9])({w})([^a-z0-9]|$)")
    return Tables(spark, folder).read("documents").groupBy(word("the|der").alias("a"), word("of|und").alias("b")).agg(F.count("*").alias("n"))


@query("""select o_orderkey as id, case when o_orderkey % 5 = 0 then (o_orderkey % 90)::int else null end as total,
 case when o_orderkey % 5 = 0 and o_orderkey % 90 > 0 then (o_orderkey % 90)::int when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 0 then 25 + (o_orderkey % 40)::int else 10 + (o_orderkey % 40)::int end as minutes,
 case when o_orderkey % 5 = 0 and o_orderkey % 90 > 0 then 'total' when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 0 then 'parts' else 'text' end as origin from orders""")
def time_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """The source's total, then prep and cook, then what a sentence says, built from the orders' keys."""
    k = F.col("o_orderkey")
    rows = Tables(spark, folder).read("orders").select(
        k.alias("id"), F.when(k % 5 == 0, (k % 90).cast("int")).alias("total"), F.when(k % 3 == 0, F.lit(25)).alias("prep"), F.when(k % 3 == 0, (k % 40).cast("int")).alias("cook"),
        F.concat(F.lit("Fry for 5-10 minutes. Leave to rest for "), (k % 40).cast("string"), F.lit(" minutes.")).alias("text"),
    )
    told = G.total_minutes(F.col("total"), F.col("prep"), F.col("cook"), F.col("text"))
    return rows.select("id", "total", told.alias("t")).select("id", "total", "t.minutes", "t.origin")


@query("select p_partkey as slug, case when p_size <= 40 then p_size::int end as people from part")
def head_counts(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    text = F.when(size > 40, F.lit("a lot")).when(size % 2 == 0, F.concat(F.lit("Serves "), size.cast("string"), F.lit("-99"))).otherwise(F.concat(size.cast("string"), F.lit(" to 99 people")))
    return Tables(spark, folder).read("part").select(F.col("p_partkey").alias("slug"), G.head_count(text).alias("people"))


@query("select o_orderkey as id, (o_orderkey % 3 = 0) as oven, (o_orderkey % 3 = 0)::int + 1 as groups from orders")
def tools_in_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Tools from sentences: an either/or is one group, a skippable sentence none."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Fry or grill for "), (k % 7 + 1).cast("string"), F.lit(" minutes. "), F.when(k % 3 == 0, F.lit("Bake it.")).otherwise(F.lit("Optional: bake it.")))
    rows = Tables(spark, folder).read("orders").select(k.alias("id"), G.tools_needed(text).alias("t"))
    return rows.select("id", F.exists("t", lambda x: x.tool == "oven").alias("oven"), F.size(F.array_distinct(F.transform("t", lambda x: x.grp))).alias("groups"))

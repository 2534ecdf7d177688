"""Queries of two runs or sources of one thing, presets as rows and checked dimensions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy
from ..operators import merging as M
from .tables import SQL, Tables

QUERIES, SQLS = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__], SQLS[f.__name__] = f, sql
        return f

    return register


@query("""with a as (select o_orderpriority as course, o_orderkey as id, row_number() over w - 1 as p, count(*) over (partition by o_orderpriority) as n from orders where o_orderkey % 5 <> 0 window w as (partition by o_orderpriority order by o_totalprice desc, o_orderkey)),
b as (select o_orderpriority as course, o_orderkey as id, row_number() over w - 1 as p, count(*) over (partition by o_orderpriority) as n from orders where o_orderstatus <> 'F' window w as (partition by o_orderpriority order by o_totalprice desc, o_orderkey)),
m as (select coalesce(a.course, b.course) as course, coalesce(a.id, b.id) as id, a.p as place_before, b.p as place_after, a.p / a.n::double - b.p / b.n::double as rise from a full join b on a.id = b.id)
select course, id, case when place_after is null then 'left' when place_before is null then 'entered' when rise > 0 then 'rose' when rise < 0 then 'fell' else 'kept' end as movement, place_before, place_after, round(rise, 6) as rise from m""")
def rankings_compared(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over all classes of orders: who came, went, rose and fell, and by how much of the ranking."""
    items = Tables(spark, folder).read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("course"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    out = M.movement(items.where("id % 5 <> 0"), items.where("o_orderstatus <> 'F'"), "id", "score", "course")
    return out.withColumn("rise", F.round("rise", 6))


@query("""with f as (select doc_id, source, case when doc_id % 3 = 0 then 'v1' else 'v2' end as version, length(text)::bigint as made from documents where doc_id % 4 <> 0),
r as (select doc_id, source, case when doc_id % 2 = 0 then n_chars end as n_chars from documents)
select r.source, count(*) as n, count(f.made) as found, count(*) filter (where coalesce(r.n_chars, f.made) is null) as missing, sum(coalesce(r.n_chars, f.made))::bigint as chars from r left join f on f.doc_id = r.doc_id and f.source = r.source and version = 'v2' group by 1""")
def backfilled_by_version(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of documents: a row's own before those of the second version of the features, and what is missing counted."""
    docs, c = Tables(spark, folder).read("documents"), F.col
    features = docs.where("doc_id % 4 <> 0").select("doc_id", "source", F.when(c("doc_id") % 3 == 0, "v1").otherwise("v2").alias("version"), F.length("text").cast("long").alias("n_chars"))
    rows = docs.select("doc_id", "source", F.when(c("doc_id") % 2 == 0, c("n_chars")).alias("n_chars"))
    out = M.backfilled(rows, features, ["doc_id", "source"], "v2", ["n_chars"])
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count_if("found").alias("found"), F.count_if(c("n_chars").isNull()).alias("missing"), F.sum("n_chars").alias("chars"))


@query("""with e as (select o_custkey as owner, 'status ' || o_orderstatus as k from orders union all select o_custkey, 'status ' || l_linestatus from lineitem join orders on o_orderkey = l_orderkey) select owner, k, count(*) as n from e group by 1, 2""")
def merged_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's counts of orders and of lines by status: two maps made apart, then merged."""
    t, c = Tables(spark, folder), F.col
    orders = t.read("orders")

    def counted(rows: DataFrame, name: str) -> DataFrame:
        pairs = rows.groupBy("owner", "k").agg(F.count("*").alias("n"))
        return pairs.groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias(name))

    a = counted(orders.select(c("o_custkey").alias("owner"), F.concat(F.lit("status "), "o_orderstatus").alias("k")), "a")
    lines = t.read("lineitem").join(orders, c("o_orderkey") == c("l_orderkey"))
    b = counted(lines.select(c("o_custkey").alias("owner"), F.concat(F.lit("status "), "l_linestatus").alias("k")), "b")
    return a.join(b, "owner", "full").select("owner", F.explode(M.merged(c("a"), c("b"))).alias("k", "n"))


@query("""with d as (select doc_id, lang, nullif(source, 'src0') as given, (n_chars % 100) / 100::double as confidence from documents) select doc_id, coalesce(given, case when confidence >= 0.8::double then lang end) as label from d""")
def labels_shown(spark: SparkSession, folder: str) -> DataFrame:
    """The given label of a document, else a made one where it is sure enough."""
    docs = Tables(spark, folder).read("documents")
    return docs.select("doc_id", M.shown(F.col("lang"), F.nullif(F.col("source"), F.lit("src0")), (F.col("n_chars") % 100) / 100).alias("label"))


_BANS = [("no rings", "ring"), ("no rings", "widget"), ("no bolts", "bolt"), ("nothing hot", "hot"), ("never", "absent")]


@query(f"""with p(preset, flag) as (values {", ".join(map(str, _BANS))}), f as (select distinct l_orderkey as id, l_linenumber as line, unnest(string_split(p_name, ' ')) as flag from lineitem join part on p_partkey = l_partkey),
h as (select preset, id, count(distinct line) as blockers from f join p using (flag) group by 1, 2), e as (select preset, id from (select distinct preset from p), (select distinct id from f))
select preset, id, coalesce(blockers, 0) as blockers from e left join h using (preset, id)""")
def presets_as_rows(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of each order each preset bans."""
    t = Tables(spark, folder)
    lines = t.read("lineitem").join(t.read("part"), F.col("p_partkey") == F.col("l_partkey"))
    flags = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.explode(F.split("p_name", " ")).alias("flag"))
    return M.preset_status(flags, spark.createDataFrame(_BANS, "preset string, flag string"))


@query(SQL + """, rows as (select slug, parent from taxonomy union all select 'part 1', 'x' union all select 'loop a', 'loop b' union all select 'loop b', 'loop a' union all select null, 'loop a' union all select 'lost', 'nowhere')
select r.slug, case when r.slug is null then 'no_key' when count(*) over (partition by r.slug) > 1 then 'duplicate_key' when parent is not null and parent not in (select slug from rows where slug is not null) then 'unknown_parent' when r.slug like 'loop %' then 'cycle' end as reason from rows r""")
def dimension_checked(spark: SparkSession, folder: str) -> DataFrame:
    """The tree of parts with five bad rows added, and why a row cannot be loaded."""
    bad = [("part 1", "x"), ("loop a", "loop b"), ("loop b", "loop a"), (None, "loop a"), ("lost", "nowhere")]
    rows = Tables(spark, folder).taxonomy().unionByName(spark.createDataFrame(bad, "slug string, parent string"))
    return hierarchy.dimension(rows).select("slug", "reason")

"""Queries of dictionary annotation, name resolution, markers, amount lines, trees and the stored text index, over the tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import text as X
from ..operators import annotate as A
from ..operators import hierarchy, textindex
from ..streaming.ingest import working_dir
from .tables import Tables

QUERIES, SQLS = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__], SQLS[f.__name__] = f, sql
        return f

    return register


def folded_sql(c: str) -> str:
    """`text.normalise` in the check's SQL."""
    return f"trim(regexp_replace(regexp_replace(regexp_replace(replace(translate(lower({c}), '{X.LATIN}', '{X.LATIN_PLAIN}'), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"


#: The first two to eight words of each benchmark item, as the check's SQL.
_ENTRIES = f"""entries as (
  select key, min(tag) as tag from (select array_to_string(string_split({folded_sql("text")}, ' ')[1:2 + item_id % 7], ' ') as key, 'item ' || item_id as tag from benchmark) where key <> '' group by key
)"""


def item_openings(t: Tables) -> DataFrame:
    """(key, tag): the first two to eight words of each benchmark item name it."""
    opening = F.slice(X.words(X.normalise(F.col("text"))), F.lit(1), (2 + F.col("item_id") % 7).cast("int"))
    return t.read("benchmark").select(F.array_join(opening, " ").alias("key"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("tag"))


def _grams_sql(ident: str) -> str:
    """Grams (ident, size, at, n, key) of one to eight words of `words` (ident, w)."""
    ahead = ", ".join(f"lead(word, {k}) over d as w{k}" for k in range(1, 8))
    keys = ", ".join(" || ' ' || ".join(["word", *(f"w{k}" for k in range(1, n))]) for n in range(1, 9))
    return f"""places as (select {ident}, len(w) as size, unnest(w) as word, generate_subscripts(w, 1) as i from words), ahead as (select *, {ahead} from places window d as (partition by {ident} order by i)),
grams as (select {ident}, size, i - 1 as at, unnest(range(1, 9)) as n, unnest([{keys}]) as key from ahead)"""



@query(f"""with recursive {_ENTRIES}, words as (select doc_id, string_split({folded_sql("text")}, ' ') as w from documents),
{_grams_sql("doc_id")},
hits as (select doc_id, g.at, max(n) as n, arg_max(key, n) as key, arg_max(tag, n) as tag from grams g join entries using (key) group by 1, 2),
next as (select h.*, f.at as after from (select x.*, x.at + x.n as free from hits x) h asof left join hits f on f.doc_id = h.doc_id and f.at >= h.free),
walk as (select n.* from next n where n.at = (select min(h.at) from hits h where h.doc_id = n.doc_id) union all select n.* from walk w join next n on n.doc_id = w.doc_id and n.at = w.after)
select w.doc_id, w.at::bigint as at, w.n::bigint as n, key, tag from walk w""")
def annotated_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where documents name benchmark items: from left to right the longest openings."""
    t = Tables(spark, folder)
    found = A.annotate(t.read("documents"), "doc_id", F.col("text"), item_openings(t))
    return found.select("doc_id", F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"), "key", "tag")


@query(f"""with {_ENTRIES}, lines as (select distinct line from (select unnest(string_split(text, chr(10))) as line from documents)), words as (select line, string_split({folded_sql("line")}, ' ') as w from lines),
{_grams_sql("line")},
hits as (select line, size, n, g.at, key, tag from grams g join entries using (key))
select line, key, tag, case when n = size then 'exact' else 'part' end as how from hits qualify row_number() over (partition by line order by n desc, hits.at desc) = 1""")
def resolved_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct line of the documents as the benchmark item that it names: as a whole, else by its longest, rightmost part."""
    t = Tables(spark, folder)
    lines = t.read("documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return A.resolve_names(lines, "line", item_openings(t)).withColumnRenamed("name", "line")


# Markers of licences in the order in which they count, and a phrase that names one but does not make it the text's own.
_MARKERS = [("licensed under cc by nc", "non-commercial"), ("general public license", "copyleft"), ("apache license", "permissive"), ("license", "other"), ("licensed", "other")]
_BLANKED = ("apache license version 2 0",)


@query(f"""with folded as (select doc_id, ' ' || {folded_sql("text")} || ' ' as x from documents), blank as (select doc_id, replace(x, ' {_BLANKED[0]} ', ' | ') as x from folded),
told as (select doc_id, case {" ".join(f"when contains(x, ' {m} ') then {i}" for i, (m, _) in enumerate(_MARKERS))} end as i from blank)
select doc_id, case i {" ".join(f"when {i} then '{label}'" for i, (_, label) in enumerate(_MARKERS))} end as label, case i {" ".join(f"when {i} then '{m}'" for i, (m, _) in enumerate(_MARKERS))} end as marker from told where i is not null""")
def licence_markers(spark: SparkSession, folder: str) -> DataFrame:
    """The first marker of a licence in each document, whole words, one phrase blanked."""
    marker = A.first_marker(F.col("text"), _MARKERS, _BLANKED).alias("m")
    return Tables(spark, folder).read("documents").select("doc_id", marker).where("m is not null").select("doc_id", "m.label", "m.marker")


@query(None)
def document_line_parts(spark: SparkSession, folder: str) -> DataFrame:
    """What the amount grammar reads in each distinct line of the documents; a state machine, so without SQL."""
    lines = Tables(spark, folder).read("documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.select("line", L.parse_line(F.col("line")).alias("p")).select("line", "p.*")


@query("""with recursive up(slug, ancestor, depth) as (
  select c_custkey, c_custkey // 2, 1 from customer where c_custkey > 0 union all select slug, ancestor // 2, depth + 1 from up where ancestor > 0
) select slug, count(*) as ancestors, max(depth)::int as depth, sum(ancestor)::bigint as total from up where ancestor in (select c_custkey from customer) group by slug""")
def closure_of_any_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's ancestors in the tree in which half a key is the parent: as deep as a key has binary digits."""
    tree = Tables(spark, folder).read("customer").where("c_custkey > 0").select(F.col("c_custkey").alias("slug"), F.floor(F.col("c_custkey") / 2).alias("parent"))
    return hierarchy.ancestors(tree).groupBy("slug").agg(F.count("*").alias("ancestors"), F.max("depth").alias("depth"), F.sum("ancestor").alias("total"))



def _forms(word: str) -> str:
    """The words of the tables that have a short word's stem."""
    return "(" + ", ".join(f"'{word}{end}'" for end in ("", "s", "ed", "eds", "ing", "ings")) + ")"


def _text_index(spark: SparkSession, folder: str) -> str:
    """Builds the index of the documents' texts and sources; where it lies."""
    path = f"{working_dir(spark)}/text-index"
    textindex.build(Tables(spark, folder).read("documents"), "doc_id", {"text": F.col("text"), "source": F.col("source")}, path)
    return path


_WORDS = f"words as (select doc_id, string_split({folded_sql('text')}, ' ') as w from documents)"


@query(f"""with {_WORDS}, n as (select doc_id, len(list_filter(w, lambda x: x in {_forms("und")}))::bigint as a, len(list_filter(w, lambda x: x in {_forms("mit")}))::bigint as b from words)
select doc_id, a + b as hits from n where a > 0 and b > 0""")
def text_index_match(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold two words by stem, from the buckets of these words alone."""
    return textindex.match(spark, _text_index(spark, folder), "mit UND", ["text"]).withColumnRenamed("id", "doc_id")


@query(f"""with {_WORDS}, n as (select doc_id, len(list_filter(list_zip(w, w[2:]), lambda x: x[1] in {_forms("de")} and coalesce(x[2], '') in {_forms("la")}))::bigint as hits from words) select doc_id, hits from n where hits > 0""")
def text_index_phrase(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with two words, by stem, one after the other, from their positions."""
    return textindex.match(spark, _text_index(spark, folder), "de la", ["text"], phrase=True).withColumnRenamed("id", "doc_id")

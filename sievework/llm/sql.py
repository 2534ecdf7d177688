"""SQL (DuckDB) that gives the same rows as some of this subpackage's queries, in the plainest way."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP2 = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) as w from documents
), sets as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end)) as s from words
), sizes as (
  select doc_id, count(*) as n from sets group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)
), both_ways as (
  select a, b from links union all select b, a from links
), reach(a, b) as (
  select a, b from both_ways union select r.a, l.b from reach r join both_ways l on l.a = r.b
)
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, least(d.doc_id, coalesce(min(b), d.doc_id)) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join reach r on r.a = d.doc_id group by d.doc_id
"""

OP3 = rf"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w from documents
), places as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, len(w) as n, w from words
), windows as (
  select doc_id, i, n, word, case when i + 49 <= n then md5(array_to_string(w[i:i + 49], ' ')) end as h from places
), firsts as (
  select h, min(doc_id) as first from windows where h is not null group by h
), marked as (
  select doc_id, i, n, word, max(case when first < doc_id then 1 else 0 end) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from windows left join firsts using (h)
), kept as (
  select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by i) filter (where gone = 0) as text from marked group by doc_id
)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from documents d left join kept k using (doc_id)
"""

OP10 = """
with texts as (
  select doc_id, hex(encode(coalesce(text, ''))) as x from documents
), pieces as (
  select doc_id, n, c, substr(x, 2 * c + 1, 2098) as y from (select doc_id, x, len(x) // 2 as n, unnest(range(0, len(x) // 2, 1000)) as c from texts)
), windows as (
  select doc_id, c + i as i, substr(y, 2 * i - 1, 2) as b, case when c + i + 49 <= n then md5(substr(y, 2 * i - 1, 100)) end as h from (select *, unnest(range(1, least(1000, n - c) + 1)) as i from pieces)
), firsts as (
  select h, min(doc_id) as first from windows where h is not null group by h
), marked as (
  select doc_id, i, b, max(case when first < doc_id then 1 else 0 end) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from windows left join firsts using (h)
), turned as (
  select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by i), 0) = 0 as turn from marked
), kept as (
  select doc_id, count(*) as n_bytes, sum(gone)::bigint as n_removed, count(*) filter (where turn) as n_spans, string_agg(b, '' order by i) filter (where gone = 0) as x from turned group by doc_id
)
select d.doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k.x, ''))) as kept_sha256 from documents d left join kept k using (doc_id)
"""

_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"


def _crc_is_even() -> str:
    """Whether crc32 of doc_id's digits is even; a byte at a time, eight shifts a byte."""
    step = "xor(s, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: xor(v >> 1, 3988292384 * (v & 1)))[1]"
    return f"(list_reduce([4294967295::bigint] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint), lambda s, b: {step}) & 1) = 1"


OP11 = f"""
with recursive leaves as (
  select doc_id, source, {_LEAF.format(text="text")} as leaf, case when {_crc_is_even()} then {_LEAF.format(text="replace(text, chr(10), '')")} else {_LEAF.format(text="text")} end as checked from documents
), ordered as (
  select *, coalesce('1' || source, '0') as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from leaves
), up(tree, level, i, digest, n) as (
  select tree, 0, i, leaf, n from ordered
  union all
  select tree, level + 1, i // 3, sha256(string_agg(digest, '' order by i)), any_value((n + 2) // 3) from up where n > 1 group by tree, level, i // 3
), subroots as (
  select tree, digest, row_number() over (order by tree) - 1 as i, count(*) over () as n from up where n = 1
), over_up(level, i, digest, n) as (
  select 0, i, digest, n from subroots
  union all
  select level + 1, i // 3, sha256(string_agg(digest, '' order by i)), any_value((n + 2) // 3) from over_up where n > 1 group by level, i // 3
), families as (
  select tree, level, i // 3 as p, list(digest order by i) as kids from up where n > 1 group by all
  union all
  select '', level, i // 3 as p, list(digest order by i) as kids from over_up where n > 1 group by all
), walk(rid, tree, level, i, proof, digest) as (
  select row_number() over (), tree, 0, i, '', checked from ordered
  union all
  select rid, tree, w.level + 1, w.i // 3, proof || array_to_string(kids[1:w.i % 3], '') || array_to_string(kids[w.i % 3 + 2:], ''), sha256(array_to_string(kids[1:w.i % 3], '') || digest || array_to_string(kids[w.i % 3 + 2:], ''))
  from walk w join families f using (tree) where f.level = w.level and f.p = w.i // 3
), tops(rid, tree, level, i, proof, digest) as (
  select w.rid, w.tree, 0, s.i, w.proof, w.digest from (select rid, tree, arg_max(proof, level) as proof, arg_max(digest, level) as digest from walk group by rid, tree) w join subroots s using (tree)
  union all
  select rid, w.tree, w.level + 1, w.i // 3, proof || array_to_string(kids[1:w.i % 3], '') || array_to_string(kids[w.i % 3 + 2:], ''), sha256(array_to_string(kids[1:w.i % 3], '') || digest || array_to_string(kids[w.i % 3 + 2:], ''))
  from tops w join families f on f.tree = '' where f.level = w.level and f.p = w.i // 3
), ends as (
  select rid, arg_max(proof, level) as proof, arg_max(digest, level) as digest from tops group by rid
)
select o.doc_id, o.leaf, s.digest as subroot, r.digest as root, sha256(e.proof) as proof_sha256, e.digest as folded_root, e.digest = r.digest as verified
from (select *, row_number() over () as rid from ordered) o join ends e using (rid) join subroots s using (tree), (select digest from over_up where n = 1) r
"""

OP13 = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), sizes as (
  select lang, sum(len(w))::bigint as n from words group by lang
), grams as (
  select lang, 1 as k, unnest(w) as p from words
  union all
  select lang, 2 as k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as p from words
  union all
  select lang, 3 as k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as p from words
), counts as (
  select lang, k, p, count(*) as a from grams group by all having count(*) >= 10
), candidates as (
  select *, string_split(p, ' ') as w from counts where k > 1
), halves as (
  select lang, k, p, a, 1 as cut, w[1] as front, array_to_string(w[2:], ' ') as back from candidates
  union all
  select lang, k, p, a, 2 as cut, w[1] || ' ' || w[2] as front, w[3] as back from candidates where k = 3
), cuts as (
  select h.*, f.a as l, r.a as r, (1000000::hugeint * h.a * h.a) // (f.a::hugeint * r.a) as score
  from halves h join counts f on f.lang = h.lang and f.p = h.front join counts r on r.lang = h.lang and r.p = h.back
), worst as (
  select * from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1
), parts as (
  select lang, w[1] || ' ' || w[2] as p, a from candidates where k = 3 union all select lang, w[2] || ' ' || w[3] as p, a from candidates where k = 3
), longer as (
  select lang, p, max(a) as longer from parts group by lang, p
), kept as (
  select lang, w.p as phrase, w.a, l, r, score::bigint as score from worst w left join longer o using (lang, p) where longer is null or 100 * longer < 50 * w.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join sizes using (lang) qualify rank <= 2000
"""

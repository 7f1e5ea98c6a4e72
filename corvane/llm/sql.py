"""DuckDB forms of those queries that SQL can express."""

KEY = "translate(lower(trim({0})), '- ', '__')"

P1 = """
with recursive
links as (select id a, merged_into b from concepts where merged_into <> id and merged_into in (select id from concepts)),
ends as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from ends union select r.a, e.b from reach r join ends e on e.a = r.b),
member as (select a id, least(a, min(b)) group_id from reach group by a),
m as (
  select c.*, member.group_id, s.source_list listed, s.trust_rank,
    (coalesce(regexp_matches(wiki_extract, '\\S'), false)::int + coalesce(regexp_matches(one_liner, '\\S'), false)::int
     + coalesce(regexp_matches(aha_explanation, '\\S'), false)::int + coalesce(regexp_matches(canonical_example, '\\S'), false)::int) texts
  from member join concepts c using (id)
  left join sources s on s.source_list = translate(lower(trim(c.source_list)), '- ', '__'))
select group_id,
  first(id order by texts desc, enriched_at desc nulls last, id) survivor_id,
  coalesce(first(listed order by trust_rank nulls last), '') source_list,
  first(id order by enriched_at desc nulls last, id) filter (surprise_score between 1 and 10) score_from{0}
from m group by group_id
"""
BEST = ",\n  first({0} order by trust_rank nulls last, enriched_at desc nulls last, id) filter (regexp_matches({0}, '\\S')) {0}"
SURVIVORS = P1.format(
    ",\n  first(surprise_score order by enriched_at desc nulls last, id) filter (surprise_score between 1 and 10) surprise_score"
    + "".join(BEST.format(c) for c in ("wiki_extract", "one_liner", "aha_explanation", "canonical_example"))
)

P3 = """
with r as (
  select s.source_list, s.keep_percent, c.surprise_score score
  from concepts c join sources s on s.source_list = translate(lower(trim(c.source_list)), '- ', '__')
  where c.surprise_score between 1 and 10),
n as (select source_list, count(*) total from r group by 1),
k as (
  select n.source_list, g.v::int cutoff, count(*) filter (r.score >= g.v) kept, any_value(n.total) total, any_value(r.keep_percent) p
  from n join r using (source_list) cross join range(1, 11) g(v) group by 1, 2)
select source_list, max(cutoff) cutoff, min(kept) kept{0} from k where 100 * kept >= p * total group by 1
"""

UNIT = """
raw as (
  select id, list_transform(embedding, lambda x: x::double) e from concepts
  where dropped = 0 and embedding_model = 'notion-embed-2' and len(embedding) = 128
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 128
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from raw)"""

P2 = f"""
with {UNIT},
s as (select a.id, b.id neighbour_id, round(list_dot_product(a.e, b.e), 6) similarity from u a join u b on a.id <> b.id)
select {{0}} from s
qualify row_number() over (partition by id order by similarity desc, neighbour_id) <= 5
"""

P5 = f"""
with recursive {UNIT},
l as materialized (select a.id, b.id o from u a join u b on list_dot_product(a.e, b.e) >= 0.7),
n as (select id, min(o) g, count(*) n, list(o order by o) around from l group by id),
good as (select g from n group by g having count(distinct around) = 1 and count(*) = any_value(n) and count(*) >= 12)
select g cluster_id, id concept_id from n where g in (select g from good)
"""

NORMAL = "regexp_extract_all(lower(regexp_replace({0}, '<[^>]*>', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"

P6 = f"""
with
i as (select item_id, {NORMAL.format("item_text")} w from eval_items),
d as (select doc_id, {NORMAL.format("text")} w from documents),
ig as (select distinct item_id, array_to_string(w[k:k + 11], ' ') g from i, unnest(range(1, len(w) - 10)) t(k) where len(w) >= 12),
dg as (select doc_id, array_to_string(w[k:k + 11], ' ') g from d, unnest(range(1, len(w) - 10)) t(k) where len(w) >= 12)
select distinct doc_id, item_id from dg join ig using (g)
"""

CLOSE = "case when abs(length({0}) - length({1})) <= 2 then levenshtein({0}, {1}) else 9 end"
# every window of twelve item words that has six words in runs of three in common is held against the document's words
# there by edit distance, then made as long as the edits allow
P6_EDITED = f"""
with
i as (select item_id, {NORMAL.format("item_text")} w from eval_items),
d as (select doc_id, {NORMAL.format("text")} w from documents),
ig as (select item_id, k, array_to_string(w[k:k + 2], ' ') g from i, unnest(range(1, len(w) - 1)) t(k) where len(w) >= 12),
dg as (select doc_id, j, array_to_string(w[j:j + 2], ' ') g from d, unnest(range(1, len(w) - 1)) t(j) where len(w) >= 10),
h as materialized (select doc_id, item_id, k, j - k s from dg join ig using (g)),
-- words of an item in a run of three in common, and where a window of twelve has six of them
cov as materialized (select distinct doc_id, item_id, k + o w, s from h, unnest([0, 1, 2]) t(o)),
near as materialized (
  select a.doc_id, a.item_id, a.w, a.s from cov a join cov b on a.doc_id = b.doc_id and a.item_id = b.item_id and b.w between a.w and a.w + 11 and abs(a.s - b.s) <= 4
  group by all having count(distinct b.w) >= 6),
-- starts: windows of twelve item words within two edits of whole words of the document
st as (select distinct doc_id, item_id, w - f a, w - f + s + e b from near, unnest(range(0, 12)) t(f), unnest(range(-4, 5)) u(e)),
st2 as materialized (
  select doc_id, item_id, a, b from st join cov using (doc_id, item_id) where cov.w between a and a + 11 and abs(cov.s - b + a) <= 2 group by all having count(distinct cov.w) >= 6),
s12 as materialized (
  select distinct doc_id, item_id, a, b from st2 join i using (item_id) join d using (doc_id), unnest(range(9, 14)) t(m)
  where a >= 1 and b >= 1 and a + 11 <= len(i.w) and b + m <= len(d.w)
    and {CLOSE.format("array_to_string(i.w[a:a + 11], ' ')", "array_to_string(d.w[b:b + m], ' ')")} <= 2),
runs as materialized (
  select doc_id, item_id, n, min({CLOSE.format("array_to_string(i.w[a:a + n - 1], ' ')", "array_to_string(d.w[b:b + n - 1 + e], ' ')")}) v
  from s12 join i using (item_id) join d using (doc_id), unnest(range(12, len(i.w) - a + 2)) t(n), unnest(range(-2, 3)) u(e)
  where b + n - 1 + e <= len(d.w) group by all),
best as materialized (select doc_id, item_id, max((n, -v)) m from runs where v <= 2 group by all),
-- the longest run of words in common: each three in common joined to the next ones on its diagonal
isl as (select doc_id, item_id, s, k - row_number() over (partition by doc_id, item_id, s order by k) g from (select distinct doc_id, item_id, s, k from h)),
ex as (select doc_id, item_id, max(n) + 2 exact from (select doc_id, item_id, s, g, count(*) n from isl group by all) group by all)
select doc_id, item_id, m[1]::int words, (-m[2])::int edits, exact >= 12 verbatim from best join ex using (doc_id, item_id)
"""

P4 = """
with recursive
t as (
  select id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(wiki_extract, '') || ' ' || coalesce(aha_explanation, '')), '[\\p{L}\\p{N}]+') w
  from concepts),
g as (select distinct id, array_to_string(w[k:k + 2], ' ') s from t, unnest(range(1, len(w) - 1)) r(k) where len(w) >= 20),
n as (select id, count(*) n from g group by 1),
o as (select a.id a, b.id b, count(*) c from g a join g b on a.s = b.s and a.id < b.id group by 1, 2),
l as (select a, b from o join n x on x.id = a join n y on y.id = b where 2 * c >= x.n + y.n - c),
e as (select a, b from l union select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b)
select least(a, min(b)) group_id, a concept_id from r group by a
"""

SQL = {
    "p4_found": P4,
    "p6_found": P6,
    "p6_leaks": P6_EDITED,
    "p2_found": P2.format("id concept_id, neighbour_id"),
    "p2_neighbours": P2.format("id, neighbour_id, similarity"),
    "p5_found": P5,
    "p1_found": P1.format(""),
    "p1_survivors": SURVIVORS,
    "p8_rejoined": "select doc_id, md5(text) digest from documents where text is not null",
    "p3_found": P3.format(""),
    "p3_cutoffs": P3.format(", any_value(total) total"),
}

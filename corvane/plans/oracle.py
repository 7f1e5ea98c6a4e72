"""DuckDB forms of the core's queries, over the same tables as views."""

from __future__ import annotations

from corvane.operators.build import AFFECTS, DOMAINS, FORMS, LABELS
from corvane.operators.cluster import STOPWORDS

KEPT = """kept as (
  select id, slug, title, source_list source, wiki_url, coalesce(one_liner, '') one_liner, coalesce(aha_explanation, '') aha,
    coalesce(canonical_example, '') example, coalesce("domain", []) "domain", coalesce(nullif(form, ''), 'concept') form,
    coalesce(affect, []) affect, coalesce(nullif(obscurity, 0), 3) obscurity, coalesce(nullif(surprise_score, 0), 5) surprise
  from concepts where dropped = 0 and enriched_at is not null)"""
SLIM = "id, slug, title, one_liner, array_to_string(\"domain\", ',') \"domain\", form, array_to_string(affect, ',') affect, obscurity, surprise"
UNIT = """raw as (
  select id, list_transform(embedding, lambda x: x::double) e from concepts
  where dropped = 0 and embedding_model = 'notion-embed-2' and len(embedding) = 128
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 128
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from raw)"""
SEEDS = f"{KEPT}, {UNIT}, seed as (select id, e, row_number() over (order by id) n from u where id in (select id from kept))"
EDGES = f"""{KEPT},
e1 as (
  select src_id src, dst_id dst, kind, arg_min(weight, id) weight from edges
  where src_id is not null and dst_id is not null and kind is not null and weight is not null group by all),
e as (select * from e1 where src in (select id from kept) and dst in (select id from kept))"""
HUB = "hub as (select src id from e group by 1 order by count(*) desc, 1 limit 1)"
ADJ = """adj as (
  select a, b, max(weight) weight, array_to_string(list_sort(list(distinct kind)), ',') kinds
  from (select src a, dst b, weight, kind from e union all select dst, src, weight, kind from e) where a <> b group by 1, 2)"""
PAIR = "pair as (select src a, dst b from e where kind = 'semantic_near' and src <> dst order by 1, 2 limit 1)"
EVENTS = """ev as (
  select distinct coalesce(user_key, '') user_key, slug, signal, reacted_at, received_at from reactions
  where slug is not null and signal is not null and reacted_at is not null)"""
SIGNALS = f"""{EVENTS},
sig as (
  select user_key, slug, signal, reacted_at "at" from ev where signal in ('knew', 'didnt', 'mind_blown', 'clear')
  qualify row_number() over (partition by user_key, slug order by reacted_at desc, received_at desc nulls last, signal desc) = 1)"""
REPLAY = """st as (
  select user_key, slug, max(case when signal = '{1}' then (reacted_at, received_at, 1) end) gone from ev where signal in ('{0}', '{1}') group by 1, 2),
rep as (
  select ev.user_key, ev.slug, min(reacted_at) created_at from ev join st using (user_key, slug)
  where signal = '{0}' and (gone is null or (reacted_at, received_at, 0) > gone) group by 1, 2)"""
KEY = "translate(lower(trim({0})), '- ', '__')"
QUOTES = """q as (
  select concept_id, text, min(id) id, arg_min(rank, id) rank, arg_min(source, id) source from quotes
  where concept_id is not null and text is not null group by 1, 2)"""
STATS = "select {0} from concepts"
FACET = "select '{0}' facet, {0}::varchar value, count(*) n from kept where {0} is not null group by 2"
MULTI = "select '{0}' facet, v value, count(*) n from (select unnest(list_distinct({0})) v from kept) where v is not null group by 2"


def _search(words: list[str], fuzzy: float) -> str:
    parts = []
    for w in words:
        n, most = len(w), round(fuzzy * len(w))
        close = f"case when t = '{w}' then 1.0::double when starts_with(t, '{w}') then 0.375::double * {n}.0 / ({n}.0 + 0.3::double * (length(t) - {n}))"
        if most > 0:
            close += f" when levenshtein(t, '{w}') <= {most} then 0.45::double * {n}.0 / ({n}.0 + levenshtein(t, '{w}'))"
        parts.append(f"select id, field, boost, len, t, '{w}' term, {close} else 0 end c from tok")
    return f"""{KEPT},
doc as (
  select id, field, boost, list_filter(string_split_regex(lower(x), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '') ts
  from (select id, 'title' field, 3.0::double boost, coalesce(title, '') x from kept union all select id, 'one_liner', 2.0, one_liner from kept union all select id, 'aha', 1.0, aha from kept)),
stat as (select field, avg(len(ts)) av, count(*) docs from doc group by 1),
tok as (select id, field, boost, len(ts) len, unnest(ts) t from doc),
hit as ({' union all '.join(parts)}),
tf as (select id, field, boost, len, term, t, c, count(*) tf from hit where c > 0 group by all),
df as (select field, term, t, count(*) df from tf group by all),
hits as (
  select id, round(sum(boost * c * ln(1 + (docs - df + 0.5::double) / (df + 0.5::double))
    * (0.5::double + tf * 2.2::double / (tf + 1.2::double * (1 - 0.7::double + 0.7::double * len / av)))), 6) score
  from tf join df using (field, term, t) join stat using (field) group by id)"""


IMUL = "(({0} % 65536) * {1} + (({0} // 65536 * {1}) % 65536) * 65536) % 4294967296"
PHRASE = r"""ph as (
  select id, text, w, list_transform(range(1, len(w) - 4), lambda i: list_sum(list_transform(w[i:i + 5], lambda x: case when length(x) > 3 then length(x) else 0 end))) s
  from (select id, text, regexp_extract_all(text, '\b[0-9A-Za-z_''-]+\b') w from quotes where text is not null)),
phrase as (select id, text, case when len(w) >= 7 then array_to_string(w[list_position(s, list_max(s)):list_position(s, list_max(s)) + 5], ' ') end phrase, case when len(w) between 4 and 6 then array_to_string(w, ' ') end short from ph)"""
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)



def _labels(kind: str) -> str:
    return "{" + ", ".join(f"'{k}': '{v}'" for k, v in LABELS[kind].items()) + "}"


def _clean(c: str) -> str:
    for pattern, by, flags in (
        ("<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "", "gis"), (r"<\s*br\s*/?\s*>", " ", "gi"), *[(r"\{\{[^{}]*\}\}", "", "gs")] * 3,
        (r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", r"\1", "g"), (r"\[(?:https?:)?//\S+ ([^\]]*)\]", r"\1", "g"), ("''{2,}", "", "g"), ("<[^>]+>", "", "g"), (r"\s+", " ", "g"),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{by}', '{flags}')"
    return f"trim({c})"


def _hashed(rows: str) -> str:
    """(id, b, v) of the offline embedder's vectors, of 64 numbers, for (id, t), each of length 1."""
    return f"""(select id, b, v / sqrt(sum(v * v) over (partition by id)) v from (
      select id, ('0x' || left(md5(w), 8))::bigint % 64 b, sum(case when ('0x' || substr(md5(w), 9, 1))::int < 8 then 1 else -1 end)::double v
      from (select id, unnest(list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '')) w from {rows}) group by 1, 2) where v <> 0)"""


def _layers(n: int) -> str:
    """The cheapest path to every node by 0 to n edges."""
    out = ["l0 as (select a n, {'c': 0.0::double, 'p': [a]} m from ends)"]
    for k in range(1, n + 1):
        out.append(f"l{k} as (select c.b n, min({{'c': m.c + c.s, 'p': list_append(m.p, c.b)}}) m from l{k - 1} join c on c.a = l{k - 1}.n where not list_contains(m.p, c.b) group by 1)")
    return ",\n".join(out) + ",\nbest as (select m.c c, m.p p from (" + " union all ".join(f"from l{k}" for k in range(n + 1)) + ") where n = (select b from ends) order by m.c, m.p limit 1)"


def _mmr(picks: int) -> str:
    """The greedy picks as got (rank, id, mmr, relevance)."""
    return f"""{SEEDS},
pool as materialized (select u.id, u.e, list_dot_product(u.e, s.e) r, row_number() over (order by round(list_dot_product(u.e, s.e), 6) desc, u.id) o from u, seed s where s.n = 1 qualify o <= 80),
sim as materialized (select a.o i, b.o j, list_dot_product(a.e, b.e) s from pool a, pool b),
pick(k, picks, best) as (
  select 0, []::bigint[], {{'v': 0.0::double, 'o': 0::bigint}}
  union all
  select k + 1, list_append(picks, -b.o), {{'v': b.v, 'o': -b.o}} from (
    select k, picks, max({{'v': 0.5 * r - 0.5 * greatest(0, coalesce(near, 0)), 'o': -o}}) b from (
      select k, picks, pool.o, pool.r, max(s) near from pick join pool on not list_contains(picks, pool.o) left join sim on i = pool.o and list_contains(picks, j) where k < {picks} group by all) group by k, picks)),
got as (select k::int rank, pool.id, round(best.v, 6) mmr, round(pool.r, 6) relevance from pick join pool on pool.o = best.o where k > 0)"""


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


ORACLE = {
    "semantic_topk": f"with {SEEDS}, top as (select u.id, round(list_dot_product(u.e, s.e), 6) score from u, seed s where s.n = 1 order by 2 desc, 1 limit 15) select {SLIM}, score from top join kept using (id)",
    "semantic_filtered": f"with {SEEDS}, top as (select u.id, round(list_dot_product(u.e, s.e), 6) score from u, seed s where s.n = 1 order by 2 desc, 1 limit 120) select {SLIM}, score from top join kept using (id) where surprise >= 6 and obscurity <= 3 order by score desc, id limit 15",
    "text_then_vector": f"with {_search(['paradox'], 0.2)}, {UNIT}, one as (select id, e from hits join u using (id) order by score desc, id limit 1) select u.id, round(list_dot_product(u.e, one.e), 6) score from u, one where u.id <> one.id order by 2 desc, 1 limit 20",
    "bridge": f"with {SEEDS}, s as (select u.id, round(list_dot_product(u.e, a.e), 6) sim_a, round(list_dot_product(u.e, b.e), 6) sim_b from u, seed a, seed b where a.n = 1 and b.n = 2 and u.id not in (a.id, b.id)) select id, round(2 * least(sim_a, sim_b), 6) score, sim_a, sim_b from s order by 2 desc, 1 limit 10",
    "triangulate": f"with {SEEDS}, m as (select i, avg(v) v from (select unnest(e) v, generate_subscripts(e, 1) i from seed where n <= 3) group by i), c0 as (select list(v order by i) e from m), c as (select list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from c0), top as (select u.id, round(list_dot_product(u.e, c.e), 6) score from u, c order by 2 desc, 1 limit 13) select id, score from top where id not in (select id from seed where n <= 3) order by score desc, id limit 10",
    "analogy": f"with {SEEDS} select u.id, round(list_dot_product(u.e, s.e), 6) score from u join kept k using (id), seed s where s.n = 1 and u.id <> s.id and list_contains(k.\"domain\", 'biology') order by 2 desc, 1 limit 10",
    "favorites_similar": f"with {SEEDS}, {EVENTS}, {REPLAY.format('favorite', 'unfavorite')}, who as (select user_key from rep group by 1 order by count(*) desc, 1 limit 1), f as (select kept.id from rep join who using (user_key) join kept using (slug)), m as (select i, avg(v) v from (select unnest(e) v, generate_subscripts(e, 1) i from u join f using (id)) group by i), c0 as (select list(v order by i) e from m), c as (select list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from c0), top as (select u.id, round(list_dot_product(u.e, c.e), 6) score from u, c order by 2 desc, 1 limit (12 + (select count(*) from f))) select id, score from top where id not in (select id from f) order by score desc, id limit 12",
    "knn_edges": f"with {UNIT}, s as (select a.id src, b.id dst, round(list_dot_product(a.e, b.e), 6) weight from u a join u b on a.id <> b.id and a.id % 20 = 0), t as (select * from s qualify row_number() over (partition by src order by weight desc, dst) <= 8) select * from t where weight > 0",
    "dedup_pairs": f"with {UNIT}, s as (select a.id src, b.id dst, round(list_dot_product(a.e, b.e), 6) weight from u a join u b on a.id <> b.id and a.id % 20 = 0), t as (select * from s qualify row_number() over (partition by src order by weight desc, dst) <= 8) select * from t where weight >= 0.92 and src < dst",
    "facet_counts": f"with {KEPT} " + " union all ".join(FACET.format(k) for k in ("form", "source", "obscurity", "surprise")),
    "facet_multi": f"with {KEPT} " + " union all ".join(MULTI.format(k) for k in ("domain", "affect")),
    "filter_sort_page": f"with {KEPT} select {SLIM} from kept where obscurity between 2 and 5 and surprise >= 5 and list_contains(\"domain\", 'logic') order by kept.surprise desc, id limit 20 offset 5",
    "filter_title_page": f"with {KEPT} select id, title from kept where form = 'law' order by icu_sort_key(title, 'und'), id limit 25 offset 10",
    "filter_multiselect": f"with {KEPT} select id, slug, title, form from kept where list_has_any(\"domain\", ['biology', 'logic', 'ethics']) and form in ('law', 'game', 'effect', 'bias') and contains(lower(concat_ws(' ', title, one_liner)), 'the')",
    "concept_lookup": f"with {KEPT} select {SLIM}, source, wiki_url, aha, example from kept where slug = (select min(slug) from kept)",
    "unknown_slugs": f"with {KEPT} select distinct slug from reactions where slug is not null and slug not in (select slug from kept)",
    "edge_kind_counts": "select kind, count(*) n from edges group by 1",
    "surprise_histogram": "select surprise_score, count(*) n from concepts where enriched_at is not null group by 1",
    "quotes_by_source": "select source, count(*) n from quotes group by 1",
    "corpus_stats": "select count(*) total, count(enriched_at) enriched, count(*) filter (dropped = 1) dropped, count(embedding) embedded, count(*) filter (wiki_extract <> '') with_extract from concepts",
    "top_domains": "select d \"domain\", count(*) n from (select unnest(\"domain\") d from concepts where dropped = 0) where d is not null group by 1 order by 2 desc, 1 limit 12",
    "edges_kept": f"with {EDGES} select src, dst, kind, weight from e",
    "neighbors": f"with {EDGES}, {HUB} select dst, weight from e where src = (select id from hub) and kind = 'semantic_near' order by weight desc, dst limit 10",
    "adjacency": f"with {EDGES}, {ADJ} select * from adj",
    "shortest_path": f"""with {EDGES}, {ADJ}, c as (select a, b, greatest(0.001::double, 1 - weight) s from adj), ends as (select min(a) a, max(b) b from adj),
{_layers(6)},
st as (select unnest(p) node, generate_subscripts(p, 1) - 1 step, p, c from best)
select st.step::int step, node, adj.weight, kinds, round(c, 6) "cost" from st left join adj on st.step > 0 and adj.a = p[st.step] and adj.b = node""",
    "explain_pair": f"""with {EDGES}, {PAIR}, {UNIT}, n as (select dst from e, pair where src in (a, b) group by dst having count(distinct src) = 2)
select (select round(list_dot_product(x.e, y.e), 6) from u x, u y where x.id = a and y.id = b) cosine,
 (select count(*) from e where src = a and dst = b) edges_ab, (select count(*) from e where src = b and dst = a) edges_ba,
 array_to_string(list_filter(list_distinct(ka."domain"), lambda x: list_contains(kb."domain", x)), ',') shared_domain,
 array_to_string(list_filter(list_distinct(ka.affect), lambda x: list_contains(kb.affect, x)), ',') shared_affect,
 ka.form = kb.form same_form, ka.source = kb.source same_source, (select count(*) from n) shared_neighbors
from pair join kept ka on ka.id = a join kept kb on kb.id = b""",
    "shared_neighbors": f"with {EDGES}, {PAIR} select dst, array_to_string(list_sort(list(distinct kind)), ',') kinds from e, pair where src in (a, b) group by dst having count(distinct src) = 2",
    "ego_graph": f"""with {EDGES}, {HUB}, s as (select src, dst, weight from e where kind = 'semantic_near' and src <> dst),
m as (select id from hub union select dst from s, hub where src = id union select src from s, hub where dst = id)
select least(src, dst) a, greatest(src, dst) b, first(weight order by (src <> (select id from hub))::int, src) weight from s where src in (from m) and dst in (from m) group by 1, 2""",
    "concept_page": f"""with {EDGES}, {HUB}, r as (
select 'prerequisite' role, kind, src other, weight from e, hub where dst = id and kind = 'prerequisite_of'
union all select 'related', kind, dst, weight from e, hub where src = id and kind <> 'semantic_dedup')
select *, row_number() over (partition by role, kind order by weight desc, other)::int rank from r qualify rank <= 6""",
    "nested_edges": f"with {EDGES} select src, kind, (row_number() over (partition by src, kind order by weight desc, dst) - 1)::int place, dst, weight from e",
    "cluster_list": f"with {KEPT}, r as (select id c, \"size\", unnest(representatives) id, generate_subscripts(representatives, 1) - 1 place from clusters), m as (select c, \"size\", id, min(place)::int place from r where id is not null group by 1, 2, 3) select c \"cluster\", \"size\", place, id, slug from m join kept using (id)",
    "concept_cluster": f"with {KEPT}, r as (select id c, unnest(representatives) id from clusters) select id, slug, min(c) \"cluster\" from r join kept using (id) group by 1, 2",
    "top_terms": f"""with {KEPT}, x as (select {KEY.format('source')} c, id, concat_ws(' ', title, one_liner) t from kept where source is not null),
w as (select c, unnest(list_filter(regexp_extract_all(lower(t), '[a-zA-Z][a-zA-Z''-]+'), lambda y: length(y) > 2 and y not in ({STOP}))) term from x),
n as (select c, term, count(*) n from w group by 1, 2), g as (select term, sum(n)::bigint g from n group by 1), m as (select c, count(*) m from x group by 1),
s as (select c, term, round((n / m) * ln(1 + (n / m) / (g / (select count(*) from x))), 6) score from n join g using (term) join m using (c) where n >= 2)
select c "cluster", term, score, row_number() over (partition by c order by score desc, term)::int rank from s qualify rank <= 6""",
    "weighted_sample": f"with {KEPT}, w as (select id, slug, pow(1 + surprise, 1.0::double) * pow(1 + obscurity, 0.5::double) w, (('0x' || substr(md5(id || ':0'), 1, 8))::bigint + 0.5::double) / 4294967296.0::double u from kept) select id, slug, round(ln(u) / w, 9) \"key\" from w where w > 0 order by ln(u) / w desc, id limit 25",
    "random_near_anchor": f"with {SEEDS}, pool as (select u.id, round(list_dot_product(u.e, s.e), 6) score from u, seed s where s.n = 1 order by 2 desc, 1 limit 201), w as (select id, slug, pow(1 + surprise, 1.0::double) * pow(1 + obscurity, 0.5::double) w, (('0x' || substr(md5(id || ':3'), 1, 8))::bigint + 0.5::double) / 4294967296.0::double u from kept where surprise >= 4 and id in (select id from pool) and id <> (select id from seed where n = 1)) select id, slug from w where w > 0 order by ln(u) / w desc, id limit 10",
    "daily_picks": f"""with {KEPT}, {SIGNALS}, fresh as (select * from kept where slug not in (select slug from sig)),
p as (select id, slug, surprise, coalesce("domain"[1], '_') domain1, row_number() over (order by id) n from (select * from fresh union all select * from kept where not exists (from fresh))),
a as (select *, (20260131 + 1831565813 * n) % 4294967296 a from p),
b as (select *, {IMUL.format('xor(a, a >> 15)', '(a | 1)')} t from a),
c as (select *, xor((t + {IMUL.format('xor(t, t >> 7)', '(t | 61)')}) % 4294967296, t) t2 from b),
s as (select id, slug, domain1, round(surprise + 6 * (xor(t2, t2 >> 14) / 4294967296.0::double), 6) score from c),
r as (select * from s qualify row_number() over (partition by domain1 order by score desc, id) <= 2)
select * from r order by score desc, id limit 8""",
    "favorites_list": f"with {EVENTS}, {REPLAY.format('favorite', 'unfavorite')} select user_key, slug, created_at from rep",
    "dismissed_known": f"with {KEPT}, {EVENTS}, {REPLAY.format('dismissed', 'undismissed')} select id, slug, user_key, created_at from rep join kept using (slug)",
    "signal_state": f"with {SIGNALS} select * from sig where signal <> 'clear'",
    "signal_counts": f"with {SIGNALS} select signal, count(*) n from sig where signal <> 'clear' group by 1",
    "counts_by_day": f"with {SIGNALS} select (\"at\" at time zone 'UTC')::date \"day\", count(*) n from sig where signal <> 'clear' group by 1",
    "recent_mind_blown": f"with {KEPT}, {SIGNALS} select slug, title, user_key, \"at\" from sig join kept using (slug) where signal = 'mind_blown' order by \"at\" desc, slug, user_key limit 8",
    "reaction_history": f"with {KEPT}, {SIGNALS} select slug, user_key, signal, \"at\", title from sig left join kept using (slug) where signal <> 'clear'",
    "quotes_by_concept": f"with {KEPT}, {QUOTES} select q.concept_id, slug, rank, q.id, text, q.source from q join kept on kept.id = q.concept_id",
    "quotes_waterfall": f"with {QUOTES}, p as (select *, list_position(['wikiquote', 'llm_verified'], source) prio from q), b as (select * from p where prio > 0 qualify prio = min(prio) over (partition by concept_id)) select concept_id, (row_number() over (partition by concept_id order by rank nulls first, id) - 1)::int place, text, source from b qualify place < 3",
    "concepts_lacking_quotes": f"with {KEPT} select id, slug from kept where id not in (select concept_id from quotes where concept_id is not null)",
    "quote_checks": rf"""with {PHRASE}, s as (select id, text, phrase, trim(regexp_replace(regexp_replace(text, '^[''"“”‘’]+', ''), '[''"“”‘’]+$', '')) x from phrase)
select id, length(x) between 20 and 600 and contains(x, ' ') and not regexp_matches(lower(x), '^(see also|main article|external links|further reading)') and length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) >= length(x) * 0.5 ok, phrase from s""",
    "verified_quotes": rf"""with {PHRASE}, ev as (select (source <> 'wikiquote')::int site_order, id::varchar page_title, lower(text) body from quotes where text is not null and source is not null)
select id, (first(site_order order by site_order, page_title)) site_order, first(page_title order by site_order, page_title) page_title from phrase join ev on contains(body, lower(coalesce(phrase, short))) group by id""",
    "text_search": f"with {_search(['crowd', 'paradx'], 0.15)} select id, score from hits order by score desc, id limit 40",
    "text_search_filtered": f"with {_search(['expectation', 'of', 'the', 'crowd'], 0.15)} select id, title, score from hits join kept using (id) where surprise >= 6 order by score desc, id limit 15",
    "slugs": r"select id, regexp_replace(lower(trim(regexp_replace(regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g'), '[^\w\s-]', '', 'g'))), '[-\s]+', '-', 'g') made from concepts where title is not null",
    "content_hashes": "select id, left(sha256(coalesce(title, '') || chr(31) || coalesce(wiki_extract, '') || chr(31)), 16) hash from concepts",
    "embedding_texts": "select id, md5(concat_ws(chr(10), nullif(title, ''), nullif(one_liner, ''), nullif(aha_explanation, ''))) digest, least(length(coalesce(wiki_extract, '')), 501)::int shown from concepts",
    "link_titles": r"with t as (select id, wiki_url, replace(url_decode(replace(split_part(substr(wiki_url, length('https://wiki.example/page/') + 1), '#', 1), '+', '%2B')), '_', ' ') t from concepts where wiki_url is not null) select id, case when starts_with(wiki_url, 'https://wiki.example/page/') and t <> '' and not regexp_matches(t, '^(?i)(List|Outline|Index) of\b') then t end title from t",
    "enrichment_valid": rf"""select id, coalesce(length(trim(regexp_replace(one_liner, '\s+', ' ', 'g'))) <= 180
  and length(aha_explanation) between 60 and 900 and length(canonical_example) between 10 and 600
  and len("domain") between 1 and 3 and len(list_filter("domain", lambda x: x is null or x not in ({_quoted(DOMAINS)}))) = 0
  and form in ({_quoted(FORMS)})
  and len(affect) between 1 and 3 and len(list_filter(affect, lambda x: x is null or x not in ({_quoted(AFFECTS)}))) = 0
  and obscurity between 1 and 5 and surprise_score between 1 and 10
  and coalesce(len(try_cast(prerequisites_raw as json)::varchar[]), 0) <= 5, false) valid from concepts""",
    "to_embed": "select id from concepts where dropped = 0 and enriched_at is not null and (embedding is null or embedding_model is distinct from 'notion-embed-2')",
    "to_enrich": "select id from concepts where enriched_at is null",
    "advisor_replies": f"with {KEPT} select case when id % 3 = 0 then 'About' || chr(10) || slug end framing, slug, 'w' why, title from kept where slug is not null and id % 3 <> 1",
    "insert_new_quotes": "with h as (select concept_id, text, min(id) id from quotes where source = 'wikiquote' and concept_id is not null and text is not null group by 1, 2), n as (select concept_id, text, min(id) id from quotes where source = 'llm_verified' and concept_id is not null and text is not null group by 1, 2) select * from h union all select n.* from n anti join h using (concept_id, text)",
    "updated_concepts": "with r as (select distinct unnest(representatives) id from clusters) select id, case when id in (select id from r where id is not null) then coalesce(upper(title), title) else title end title, form from concepts",
    "latest_cache": "select slug \"key\", max(reacted_at) created_at, first(signal order by reacted_at desc, signal desc) \"value\" from reactions where slug is not null and reacted_at is not null and signal is not null group by 1",
}
ORACLE["cache_split"] = f"""with v as ({ORACLE['enrichment_valid']}),
c as (select content_hash, first(v.valid order by id) ok from concepts join v using (id) where content_hash is not null group by 1)
select id, case when ok then 'hit' else 'miss' end state from concepts join c using (content_hash)"""

ORACLE["link_extract"] = f"""with l as (select t.id, t.title, (t.title is not null)::int p from ({ORACLE['link_titles']}) t)
select id, 0 as position, title, 'x' anchor from l where p = 1
union all select id, p, 'Nested ' || id, 'n' from l
union all select id, p + 1, 'Row ' || id, 'r' from l"""
MEANS = f"""rep as (select distinct c, id from (select id c, unnest(representatives) id from clusters)),
cm as (select c, i, sum(v) v from (select c, unnest(e) v, generate_subscripts(e, 1) i from rep join u using (id)) group by 1, 2),
cl as (select c, list(v order by i) e from cm group by 1),
cu as (select c, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from cl)"""
ORACLE |= {
    "prereq_resolve": f"""with {KEPT}, t as {_hashed("(select id, title t from kept where trim(title) <> '')")},
own as (select distinct id, trim(unnest(try_cast(prerequisites_raw as json)::varchar[])) phrase from concepts where id % 20 = 0 and id in (select id from kept)),
ph as {_hashed("(select distinct phrase id, phrase t from own where phrase <> '')")},
s as (select ph.id phrase, t.id src, round(sum(ph.v * t.v), 6) s from ph join t using (b) group by 1, 2),
r as (select own.id dst, phrase, src, s from own join s using (phrase) where src <> own.id qualify row_number() over (partition by own.id, phrase order by s desc, src) = 1)
select src, dst, first(s order by phrase) weight, min(phrase) phrase from r where s >= 0.5 group by 1, 2""",
    "facet_labels": f"with {KEPT} " + " union all ".join(
        f"select distinct '{k}' kind, v as value, coalesce(map {_labels(k)}[v], v) as label from (select {e} v from kept) where v is not null"
        for k, e in {"form": "form", "domain": 'unnest("domain")', "affect": "unnest(affect)", "source": KEY.format("source")}.items()),
    "filter_totals": f"with {KEPT} select {SLIM}, total from (select *, count(*) over () total from kept where surprise >= 4) kept order by kept.obscurity desc, id limit 20 offset 20",
    "surface_filter": f"with {KEPT} select {SLIM}, total from (select *, count(*) over () total from kept where list_contains(\"domain\", 'logic')) kept order by icu_sort_key(title, 'und'), id limit 12 offset 3",
    "surface_dismissed": f"""with {KEPT}, {EVENTS}, {REPLAY.format('dismissed', 'undismissed')}, own as (select user_key, id, slug, created_at from rep join kept using (slug)),
top as (select user_key from own group by 1 order by count(*) desc, 1 limit 1) select id, slug, created_at dismissed_at from own join top using (user_key)""",
    "json_round_trip": f"with {KEPT} select {SLIM} from kept",
    "low_surprise": "select id, coalesce(surprise_score < 4, false)::int dropped, case when surprise_score < 4 then 'low_surprise' end drop_reason from concepts where enriched_at is not null",
    "matrix_round_trip": f"with {UNIT} select id, round(e[1], 4) \"first\" from u",
    "attributions": "select id, concat_ws(', ', nullif(attribution, ''), nullif(source, '')) line from quotes",
    "cluster_sizes": "select count(*) clusters, min(\"size\") least, max(\"size\") most, avg(\"size\") mean from clusters where \"size\" is not null",
    "cluster_members": f"""with {KEPT}, m as (select distinct c, id from (select id c, unnest(representatives) id from clusters) where id in (select id from kept)),
top as (select c from m group by 1 order by count(*) desc, 1 limit 1)
select id, slug, surprise, total from (select kept.*, count(*) over () total from kept join m using (id) join top using (c)) k order by k.surprise desc, id limit 4 offset 1""",
    "cluster_table": f"""with {UNIT}, {MEANS},
a as (select u.id, c, round(list_dot_product(u.e, cu.e), 6) s from u, cu qualify row_number() over (partition by u.id order by list_dot_product(u.e, cu.e) desc, c) = 1),
r as (select *, row_number() over (partition by c order by s desc, id) n from a)
select c "cluster", count(*) "size", array_to_string(list(id order by n) filter (n <= 6), ',') representatives from r group by 1""",
    "replaced_edges": """with e as (select * from edges where src_id is not null and dst_id is not null and kind is not null),
old as (select src_id, dst_id, kind, source from e where source is distinct from 'semantic-knn'),
made as (select distinct dst_id src_id, src_id dst_id, kind, 'semantic-knn' source from e where source is not null)
select *, count(*) n from (from old union all select * from made m where not exists (select 1 from old o where o.src_id = m.src_id and o.dst_id = m.dst_id and o.kind = m.kind)) group by all""",
    "signals_round_trip": f"with {SIGNALS} select user_key, slug, signal, date_trunc('millisecond', \"at\") \"at\" from sig where signal <> 'clear'",
    "clean_texts": f"select id, {_clean('wiki_extract')} as \"text\" from concepts where wiki_extract is not null",
    "wikitext_quotes": rf"""with a as (
  select concept_id, id, {_clean(r"regexp_replace(text, '[\r\n]+', ' ', 'g')")} t, coalesce({_clean('attribution')}, '') as by_ from quotes where text is not null and concept_id is not null),
b as (select *, by_ = '' and regexp_matches(t, '^(.*?\S)\s+[—–-]{{1,2}}\s+(\S.*)$') dashed from a),
c as (select concept_id, id, case when dashed then regexp_extract(t, '^(.*?\S)\s+[—–-]{{1,2}}\s+(\S.*)$', 1) else t end t, case when dashed then trim(regexp_extract(t, '^(.*?\S)\s+[—–-]{{1,2}}\s+(\S.*)$', 2)) else by_ end by_ from b),
s as (select concept_id, id, by_, trim(regexp_replace(regexp_replace(t, '^[''"“”‘’]+', ''), '[''"“”‘’]+$', '')) x from c),
f as (select * from s where length(x) between 20 and 600 and contains(x, ' ') and not regexp_matches(lower(x), '^(see also|main article|external links|further reading)') and length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) >= length(x) * 0.5
  qualify row_number() over (partition by concept_id, x order by id) = 1)
select concept_id, (row_number() over (partition by concept_id order by id) - 1)::int place, x as "text", by_ attribution from f qualify place < 8""",
    "semantic_mmr": f"with recursive {_mmr(10)} select * from got",
    "surface_mmr": f"with recursive {_mmr(20)} select * from got where id in (select id from kept where surprise >= 6) order by rank limit 5",
    "kmeans_rounds": f"""with {SEEDS}, c0 as (select n - 1 c, e from seed where n <= 8),""" + "".join(f"""
a{k} as (select u.id, u.e, c, list_dot_product(u.e, c{k}.e) s from u, c{k} qualify row_number() over (partition by u.id order by list_dot_product(u.e, c{k}.e) desc, c) = 1),
s{k} as (select c, i, sum(v) v from (select c, unnest(e) v, generate_subscripts(e, 1) i from a{k}) group by 1, 2),
m{k} as (select c, list(v order by i) e from s{k} group by 1),
c{k + 1} as (select c, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from m{k}),""" for k in (0, 1)) + """
z as (select u.id, c, list_dot_product(u.e, c2.e) s from u, c2 qualify row_number() over (partition by u.id order by list_dot_product(u.e, c2.e) desc, c) = 1)
select id, c::int "cluster", round(s, 6) score from z""",
}

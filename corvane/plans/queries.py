"""The core's queries over the tables of a folder, each with its whole tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import extract, text
from corvane.functions.exprs import clean_key
from corvane.operators import build, cluster, facets, graph, reactions, sampling, textsearch, vectors
from corvane.operators.facets import Filters
from corvane.plans import views
from corvane.plans.engine import Corpus
from corvane.sources import providers, sinks
from corvane.sources.durable import scratch
from corvane.sources.tables import table

MODEL, DIM = "notion-embed-2", 128
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


class T:
    """The views of a folder, read once a query."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.t = spark, partial(table, spark, d)
        self.concepts, self.log = self.t("concepts"), self.t("reactions")
        self.kept = views.kept(self.concepts)
        self.vectors = views.vectorised(self.concepts, MODEL, DIM)
        self.edges = views.edges_kept(self.t("edges"), self.concepts)

    def seeds(self, n: int) -> tuple[list[int], object]:
        """The n smallest kept ids with a valid vector, and their vectors."""
        ids = [r.id for r in self.vectors.join(self.kept.select("id"), "id", "left_semi").select("id").orderBy("id").limit(8 * n).collect()]
        got, q = vectors.fetch(self.vectors, ids, DIM)
        return got[:n], q[:n]

    def hub(self) -> int:
        r = self.edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()
        return r.src if r else -1


def flat(df: DataFrame, *lists: str) -> DataFrame:
    """Lists as strings, to compare them in any engine."""
    return df.withColumns({c: F.array_join(c, ",") for c in lists})


# Vector search


@query
def semantic_topk(spark, d):
    t = T(spark, d)
    _, q = t.seeds(1)
    return flat(vectors.semantic(facets.slim(t.kept), t.vectors, q[0], DIM, 15, digits=6), "domain", "affect")


@query
def semantic_filtered(spark, d):
    t = T(spark, d)
    _, q = t.seeds(1)
    return flat(vectors.semantic(facets.slim(t.kept), t.vectors, q[0], DIM, 15, Filters(surprise_min=6, obscurity_max=3), digits=6), "domain", "affect")


@query
def semantic_mmr(spark, d):
    t = T(spark, d)
    _, q = t.seeds(1)
    return vectors.mmr(t.vectors, q[0], DIM, 10, 0.5)


@query
def text_then_vector(spark, d):
    """The best text hit's vector neighbours: what a client without an embedder offers."""
    t = T(spark, d)
    best = textsearch.search(t.kept, "paradox", 0.2).join(t.vectors.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(1).collect()
    ids, q = vectors.fetch(t.vectors, [r.id for r in best], DIM)
    if not ids:
        return spark.createDataFrame([], "id long, score double")
    return vectors.top_k(t.vectors.where(F.col("id") != ids[0]), q[0], DIM, 20)


@query
def bridge(spark, d):
    t = T(spark, d)
    (a, b), _ = t.seeds(2)
    return vectors.bridge(t.vectors, a, b, DIM, 10)


@query
def triangulate(spark, d):
    t = T(spark, d)
    ids, _ = t.seeds(3)
    return vectors.triangulate(t.vectors, ids, DIM, 10)


@query
def analogy(spark, d):
    t = T(spark, d)
    (a,), _ = t.seeds(1)
    return vectors.analogy(t.kept, t.vectors, a, DIM, 10, domain="biology")


@query
def favorites_similar(spark, d):
    """Concepts like all favorites of the user who has most."""
    t = T(spark, d)
    fav = reactions.favorites(t.log)
    top = fav.groupBy("user_key").count().orderBy(F.desc("count"), "user_key").limit(1)
    ids = [r.id for r in fav.join(top, "user_key", "left_semi").join(t.kept.select("id", "slug"), "slug").select("id").orderBy("id").collect()]
    return vectors.triangulate(t.vectors, ids, DIM, 12)


def _every_20th(t: T) -> DataFrame:
    return t.vectors.where("id % 20 = 0")


@query
def knn_edges(spark, d):
    t = T(spark, d)
    return vectors.knn_edges(_every_20th(t), t.vectors, DIM)


@query
def dedup_pairs(spark, d):
    t = T(spark, d)
    return vectors.dedup_pairs(_every_20th(t), t.vectors, DIM).drop("note")


@query
def prereq_resolve(spark, d):
    """Prerequisite phrases of the concepts in the query set, by an offline embedder of titles and phrases."""
    t, e = T(spark, d), providers.HashEmbedder(64)
    titles = providers.embed(t.kept.where("trim(title) <> ''").select("id", F.col("title").alias("text")), e)
    raw = t.concepts.where("id % 20 = 0").join(t.kept.select("id"), "id", "left_semi").select("id", F.explode(build.string_list(F.col("prerequisites_raw"))).alias("phrase"))
    raw = raw.select(F.col("id").alias("owner"), F.trim("phrase").alias("phrase")).where("phrase <> ''").distinct()
    vec = providers.embed(raw.select("phrase").distinct().select(F.xxhash64("phrase").alias("id"), F.col("phrase").alias("text")), e).withColumnRenamed("id", "h")
    phrases = raw.withColumn("h", F.xxhash64("phrase")).join(vec, "h").select(F.xxhash64("owner", "phrase").alias("id"), "owner", "phrase", "embedding")
    return vectors.resolve_phrases(phrases, titles, 64, 0.5)


@query
def matrix_round_trip(spark, d):
    """Vectors written as a packed matrix and read again: their first number."""
    t = T(spark, d)
    path = scratch(spark, "matrix")
    sinks.write_matrix(t.vectors.where(valid_vector(F.col("embedding"))), path)
    return sinks.read_matrix(spark, path).select("id", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


def valid_vector(c):
    """All numbers finite, one not zero."""
    return F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(c, lambda x: x != 0)


# Facets


@query
def facet_counts(spark, d):
    return facets.counts(T(spark, d).kept, ["form", "source", "obscurity", "surprise"], [])


@query
def facet_multi(spark, d):
    return facets.counts(T(spark, d).kept, [], ["domain", "affect"])


@query
def filter_sort_page(spark, d):
    k = facets.apply(T(spark, d).kept, Filters(obscurity_min=2, obscurity_max=5, surprise_min=5, domain="logic"))
    return flat(facets.slim(facets.page(k, "surprise", 5, 20)), "domain", "affect")


@query
def filter_title_page(spark, d):
    return facets.page(facets.apply(T(spark, d).kept, Filters(form="law")), "title", 10, 25).select("id", "title")


@query
def filter_totals(spark, d):
    """The second page, the least obscure last, with the number of all."""
    return flat(facets.page_with_total(facets.slim(facets.apply(T(spark, d).kept, Filters(surprise_min=4))), "obscurity_desc", 20, 20), "domain", "affect")


@query
def surface_filter(spark, d):
    return flat(Corpus(spark, d, MODEL, DIM).filter_with_total(Filters(domain="logic"), "title", 12, 3), "domain", "affect")


@query
def surface_mmr(spark, d):
    """Diverse hits that pass a filter, which comes last."""
    _, q = T(spark, d).seeds(1)
    return Corpus(spark, d, MODEL, DIM).semantic(q[0], 5, Filters(surprise_min=6), mmr=True).select("rank", "id", "mmr", "relevance")


@query
def surface_dismissed(spark, d):
    """What the user with the most dismissed concepts has dismissed."""
    t = T(spark, d)
    n = reactions.replay(t.log, "dismissed", "undismissed").where("present").join(t.kept.select("slug"), "slug").groupBy("user_key").count()
    top = n.orderBy(F.desc("count"), "user_key").first()
    return Corpus(spark, d, MODEL, DIM).dismissed(top.user_key if top else "").select("id", "slug", "dismissed_at")


@query
def json_round_trip(spark, d):
    """Short forms written as JSON and read again."""
    path, slim = scratch(spark, "json"), facets.slim(T(spark, d).kept)
    sinks.write_json(slim, path)
    return flat(sinks.read_json(spark, path, slim.schema), "domain", "affect")


@query
def low_surprise(spark, d):
    """What the drop rule makes of each enriched concept."""
    c = T(spark, d).concepts.where("enriched_at is not null").select("id", "surprise_score")
    return build.dropped(c).select("id", "dropped", "drop_reason")


@query
def filter_multiselect(spark, d):
    k = facets.multi_select(T(spark, d).kept, "the", domain=["biology", "logic", "ethics"], form=["law", "game", "effect", "bias"], affect=[])
    return k.select("id", "slug", "title", "form")


@query
def concept_lookup(spark, d):
    t = T(spark, d)
    slug = t.kept.agg(F.min("slug")).first()[0]
    return flat(t.kept.where(F.col("slug") == slug), "domain", "affect")


@query
def unknown_slugs(spark, d):
    t = T(spark, d)
    asked = t.log.select("slug").where("slug is not null").distinct()
    return asked.join(t.kept.select("slug"), "slug", "left_anti")


@query
def edge_kind_counts(spark, d):
    return T(spark, d).t("edges").groupBy("kind").agg(F.count("*").alias("n"))


@query
def surprise_histogram(spark, d):
    return T(spark, d).concepts.where("enriched_at is not null").groupBy("surprise_score").agg(F.count("*").alias("n"))


@query
def quotes_by_source(spark, d):
    return T(spark, d).t("quotes").groupBy("source").agg(F.count("*").alias("n"))


@query
def corpus_stats(spark, d):
    c = T(spark, d).concepts
    n = F.count_if
    return c.agg(F.count("*").alias("total"), n(F.col("enriched_at").isNotNull()).alias("enriched"), n(F.col("dropped") == 1).alias("dropped"), n(F.col("embedding").isNotNull()).alias("embedded"), n(F.col("wiki_extract").isNotNull() & (F.col("wiki_extract") != "")).alias("with_extract"))


@query
def top_domains(spark, d):
    c = T(spark, d).concepts.where("dropped = 0").select(F.explode("domain").alias("domain")).where("domain is not null")
    return c.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(12)


# Graph


@query
def edges_kept(spark, d):
    return T(spark, d).edges.select("src", "dst", "kind", "weight")


@query
def neighbors(spark, d):
    t = T(spark, d)
    return graph.neighbors(t.edges, t.hub(), "semantic_near", 10)


@query
def adjacency(spark, d):
    return flat(graph.adjacency(T(spark, d).edges), "kinds")


@query
def shortest_path(spark, d):
    t = T(spark, d)
    ends = graph.adjacency(t.edges).agg(F.min("a").alias("a"), F.max("b").alias("b")).first()
    return graph.shortest_path(t.edges, ends.a, ends.b, 6)


def _pair(t: T):
    r = t.edges.where("kind = 'semantic_near' and src <> dst").agg(F.min(F.struct("src", "dst")).alias("p")).first().p
    return r.src, r.dst


@query
def explain_pair(spark, d):
    t = T(spark, d)
    a, b = _pair(t)
    ids, q = vectors.fetch(t.vectors, [a, b], DIM)
    return graph.explain(t.kept, t.edges, a, b, float(round(q[0] @ q[1], 6)) if len(ids) == 2 else None)


@query
def shared_neighbors(spark, d):
    t = T(spark, d)
    return graph.shared_neighbors(t.edges, *_pair(t))


@query
def ego_graph(spark, d):
    t = T(spark, d)
    return graph.ego_graph(t.edges, t.kept.select("id"), t.hub())


@query
def concept_page(spark, d):
    t = T(spark, d)
    return graph.concept_page(t.edges, t.hub())


@query
def nested_edges(spark, d):
    """The nested export, unnested again."""
    n = build.nested_edges(T(spark, d).edges)
    return n.select("src", F.explode("kinds").alias("kind", "l")).select("src", "kind", F.posexplode("l").alias("place", "e")).select("src", "kind", "place", F.col("e.id").alias("dst"), F.col("e.w").alias("weight"))


@query
def replaced_edges(spark, d):
    """Edges after a rebuild of one source, out of the links that another one has turned round."""
    e = T(spark, d).t("edges").where("src_id is not null and dst_id is not null and kind is not null")
    made = e.where("source is not null").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "kind", F.lit("semantic-knn").alias("source"), F.lit(0.5).alias("weight"), F.lit(None).cast("string").alias("note"))
    return build.replaced_edges(e, made, ["semantic-knn"]).groupBy("src_id", "dst_id", "kind", "source").agg(F.count("*").alias("n"))


# Clusters


@query
def cluster_list(spark, d):
    t = T(spark, d)
    m = cluster.given_members(t.t("clusters"))
    return m.join(t.kept.select("id", "slug"), "id").join(t.t("clusters").select(F.col("id").alias("cluster"), "size"), "cluster").select("cluster", "size", "place", "id", "slug")


@query
def cluster_members(spark, d):
    """The members of the largest stored cluster by surprise, with their number."""
    t = T(spark, d)
    top = cluster.given_members(t.t("clusters")).join(t.kept.select("id"), "id", "left_semi").groupBy("cluster").count().orderBy(F.desc("count"), "cluster").first()
    return Corpus(spark, d, MODEL, DIM).cluster_members(top.cluster if top else 0, k=4, offset=1).select("id", "slug", "surprise", "total")


@query
def cluster_sizes(spark, d):
    return cluster.size_stats(T(spark, d).t("clusters"))


@query
def concept_cluster(spark, d):
    t = T(spark, d)
    return cluster.given_members(t.t("clusters")).join(t.kept.select("id", "slug"), "id").groupBy("id", "slug").agg(F.min("cluster").alias("cluster"))


@query
def top_terms(spark, d):
    k = T(spark, d).kept.select(clean_key("source").alias("cluster"), "id", F.concat_ws(" ", "title", "one_liner").alias("text")).where("cluster is not null")
    return cluster.top_terms(k)


@query
def cluster_table(spark, d):
    """Every vector in the stored cluster it is closest to: sizes and representatives."""
    t = T(spark, d)
    ids, means = cluster.given_centers(t.t("clusters"), t.vectors, DIM)
    assigned = cluster.assign(t.vectors, means, DIM)
    names = F.array(*[F.lit(i).cast("long") for i in ids or [0]])
    return flat(cluster.cluster_table(assigned.withColumn("cluster", names[F.col("cluster")])), "representatives")


@query
def kmeans_rounds(spark, d):
    """Two rounds from the first eight vectors as centres."""
    t = T(spark, d)
    _, q = t.seeds(8)
    return cluster.kmeans(t.vectors, DIM, iters=2, centers=q)[0]


@query
def kmeans_clusters(spark, d):
    """Clusters made anew from the vectors: sizes and representatives."""
    assigned, _ = cluster.kmeans(T(spark, d).vectors, DIM)
    return cluster.cluster_table(assigned)


# Sampling


@query
def weighted_sample(spark, d):
    return sampling.weighted_sample(T(spark, d).kept, 25).select("id", "slug", F.round("key", 9).alias("key"))


@query
def random_near_anchor(spark, d):
    """A sample of concepts of some surprise among the 200 nearest to an anchor."""
    t = T(spark, d)
    (a,), q = t.seeds(1)
    pool = vectors.top_k(t.vectors, q[0], DIM, 201).where(F.col("id") != a).select("id")
    k = facets.apply(t.kept, Filters(surprise_min=4)).join(pool, "id", "left_semi")
    return sampling.weighted_sample(k, 10, seed=3).select("id", "slug")


@query
def daily_picks(spark, d):
    t = T(spark, d)
    return sampling.daily_picks(t.kept, reactions.signals(t.log).select("slug"), 20260131, 8)


# Reactions


@query
def favorites_list(spark, d):
    return reactions.favorites(T(spark, d).log)


@query
def dismissed_known(spark, d):
    t = T(spark, d)
    return reactions.replay(t.log, "dismissed", "undismissed").where("present").join(t.kept.select("slug", "id"), "slug").select("id", "slug", "user_key", "created_at")


@query
def signal_state(spark, d):
    return reactions.signals(T(spark, d).log)


@query
def signal_counts(spark, d):
    return reactions.signal_counts(T(spark, d).log)


@query
def counts_by_day(spark, d):
    return reactions.counts_by_day(T(spark, d).log)


@query
def recent_mind_blown(spark, d):
    t = T(spark, d)
    return reactions.recent(t.log, t.kept, "mind_blown")


@query
def reaction_history(spark, d):
    t = T(spark, d)
    return reactions.history(t.log, t.kept)


@query
def signals_round_trip(spark, d):
    """Signals exported as JSON, one object a user, and imported again."""
    return sinks.import_signals(sinks.export_signals(reactions.signals(T(spark, d).log)))


# Quotes


@query
def quotes_by_concept(spark, d):
    t = T(spark, d)
    return views.quotes_once(t.t("quotes")).join(t.kept.select(F.col("id").alias("concept_id"), "slug"), "concept_id").select("concept_id", "slug", "rank", "id", "text", "source")


@query
def quotes_waterfall(spark, d):
    return build.quotes_waterfall(views.quotes_once(T(spark, d).t("quotes")))


@query
def concepts_lacking_quotes(spark, d):
    t = T(spark, d)
    return build.lacking(t.kept.select("id", "slug"), t.t("quotes"))


@query
def attributions(spark, d):
    return T(spark, d).t("quotes").select("id", text.attribution(F.col("attribution"), F.col("source")).alias("line"))


@query
def quote_checks(spark, d):
    q = T(spark, d).t("quotes").where("text is not null")
    s = text.strip_outer_quotes(F.col("text"))
    return q.select("id", text.looks_like_quote(s).alias("ok"), text.distinctive_phrase(F.col("text")).alias("phrase"))


@query
def verified_quotes(spark, d):
    """Quotes whose distinctive phrase, or all words of a short one, are found in a quote's text, read as evidence
    pages."""
    q = T(spark, d).t("quotes").where("text is not null")
    evidence = q.select((F.col("source") != "wikiquote").cast("int").alias("site_order"), F.col("id").cast("string").alias("page_title"), F.col("text").alias("body"))
    return build.verified_quotes(q.select("id", "text"), evidence.where("site_order is not null"), text.search_phrase(F.col("text")))


# Text


@query
def text_search(spark, d):
    return textsearch.search(T(spark, d).kept, "crowd paradx").orderBy(F.desc("score"), "id").limit(40)


@query
def text_search_filtered(spark, d):
    """Filters come before the cap."""
    t = T(spark, d)
    hits = textsearch.search(t.kept, "expectation of the crowd")
    return facets.apply(t.kept, Filters(surprise_min=6)).join(hits, "id").select("id", "title", "score").orderBy(F.desc("score"), "id").limit(15)


@query
def slugs(spark, d):
    return T(spark, d).concepts.where("title is not null").select("id", text.slugify(F.col("title")).alias("made"))


@query
def content_hashes(spark, d):
    return T(spark, d).concepts.select("id", text.content_hash(F.col("title"), F.col("wiki_extract")).alias("hash"))


@query
def embedding_texts(spark, d):
    return T(spark, d).concepts.select("id", F.md5(text.embedding_text(F.col("title"), F.col("one_liner"), F.col("aha_explanation"))).alias("digest"), F.length(text.truncated(F.coalesce("wiki_extract", F.lit("")), 500)).alias("shown"))


@query
def link_titles(spark, d):
    return T(spark, d).concepts.where("wiki_url is not null").select("id", extract.href_title(F.col("wiki_url"), "https://wiki.example/page/").alias("title"))


@query
def link_extract(spark, d):
    """Entries of pages put together from the concepts: a list item with a nested one, a table and a skipped section."""
    c = T(spark, d).concepts.where("wiki_url is not null")
    base = "https://wiki.example/page/"
    html = F.concat(
        F.lit('<div class="mw-parser-output"><h2>Entries</h2><ul><li><a href="'), F.replace("wiki_url", F.lit('"'), F.lit("%22")),
        F.lit(f'">x</a><ul><li><b><a href="{base}Nested_'), F.col("id").cast("string"), F.lit('">n</a></b></li></ul></li></ul><div class="mw-heading mw-heading3"><h3>Table</h3></div>'),
        F.lit(f'<table class="wikitable"><tr><th>Name</th><th>Of</th></tr><tr><td><a href="{base}Row_'), F.col("id").cast("string"),
        F.lit(f'#part">r</a></td><td><a href="{base}Other">o</a></td></tr></table><div class="mw-heading mw-heading2"><h2>See also[edit]</h2></div><ul><li><a href="{base}Nothing">y</a></li></ul></div>'),
    )
    return extract.entries(c.select("id", html.alias("html")), prefix=base).select("id", "position", "title", "anchor")


@query
def clean_texts(spark, d):
    """Extracts as plain text, markup removed."""
    return T(spark, d).concepts.where("wiki_extract is not null").select("id", text.clean_wikitext(F.col("wiki_extract")).alias("text"))


@query
def wikitext_quotes(spark, d):
    """Quotes out of pages put together from the quotes of a concept: bullets, some with attributions."""
    q = T(spark, d).t("quotes").where("text is not null and concept_id is not null")
    line = F.concat(F.lit("* "), F.regexp_replace("text", r"[\r\n]+", " "), F.when(F.col("attribution").rlike(r"\S"), F.concat(F.lit("\n** "), "attribution")).otherwise(""))
    page = q.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("l"))
    page = page.select("concept_id", F.concat(F.lit("== Quotes ==\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("page"))
    return page.select("concept_id", F.posexplode(text.quotes_of(F.col("page"))).alias("place", "q")).select("concept_id", "place", "q.text", "q.attribution")


@query
def facet_labels(spark, d):
    k, out = T(spark, d).kept, None
    values = {"form": F.array("form"), "domain": F.col("domain"), "affect": F.col("affect"), "source": F.array(clean_key("source"))}
    for kind, v in values.items():
        one = k.select(F.explode(v).alias("value")).where("value is not null").distinct().select(F.lit(kind).alias("kind"), "value", build.label(kind, F.col("value")).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def advisor_replies(spark, d):
    """Picks parsed out of replies put together from the concepts, joined to those that exist: whole replies, ones with
    broken picks, and ones without framing, by turns."""
    t = T(spark, d)
    picks = F.concat(F.lit('<picks> [{"slug": "'), F.col("slug"), F.lit('", "why": "w"},\n {"slug": "no-such", "why": "x"}] </picks> bye'))
    framing = F.concat(F.lit("Well. <framing> About\n"), F.col("slug"), F.lit(" </framing>"))
    turn = F.pmod("id", F.lit(3))
    reply = F.when(turn == 0, F.concat(framing, picks)).when(turn == 1, F.concat(framing, F.lit('<picks>[{"slug": </picks>'))).otherwise(picks)
    framing, picks = build.parse_final(reply)
    r = t.kept.select(framing.alias("framing"), F.explode(picks).alias("p")).select("framing", F.col("p.slug").alias("slug"), F.col("p.why").alias("why"))
    return r.join(t.kept.select("slug", "title"), "slug")


# Building


@query
def to_embed(spark, d):
    return build.to_embed(T(spark, d).concepts, MODEL).select("id")


@query
def to_enrich(spark, d):
    return build.to_enrich(T(spark, d).concepts).select("id")


@query
def enrichment_valid(spark, d):
    return build.valid(T(spark, d).concepts).select("id", "valid")


@query
def cache_split(spark, d):
    """Hits and misses of unenriched rows against a cache of enriched ones, by content hash."""
    c = T(spark, d).concepts
    cache = build.first_wins(build.valid(c).where("content_hash is not null").select("content_hash", "id", "form", "valid"), ["content_hash"], "id").select("content_hash", "form", "valid")
    hit, miss = build.cache_split(c.where("content_hash is not null").select("id", "content_hash"), cache, "content_hash")
    return hit.select("id", F.lit("hit").alias("state")).unionByName(miss.select("id", F.lit("miss").alias("state")))


@query
def insert_new_quotes(spark, d):
    """Quotes of the second source added to those of the first, where text and concept are new."""
    q = T(spark, d).t("quotes").where("concept_id is not null and text is not null").select("id", "concept_id", "text", "source")
    have = build.first_wins(q.where("source = 'wikiquote'"), ["concept_id", "text"], "id").select("concept_id", "text", "id")
    return build.insert_new(have, q.where("source = 'llm_verified'").select("concept_id", "text", "id"), ["concept_id", "text"], "id")


@query
def updated_concepts(spark, d):
    """Concepts with the representatives' title changed, and '' changing nothing."""
    t = T(spark, d)
    reps = cluster.given_members(t.t("clusters")).select("id").distinct()
    new = t.concepts.join(reps, "id", "left_semi").select("id", F.upper("title").alias("title"), F.lit("").alias("form"))
    return build.update_by_id(t.concepts.select("id", "title", "form"), new)


@query
def latest_cache(spark, d):
    """The last event of each slug, as a keyed table in which the last write wins."""
    e = T(spark, d).log.where("slug is not null and reacted_at is not null and signal is not null").select(F.col("slug").alias("key"), F.col("signal").alias("value"), F.col("reacted_at").alias("created_at"))
    return build.put_latest(e.limit(0), e)

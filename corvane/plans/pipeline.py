"""The batch build: each stage takes tables and gives one, may be run again, and only does what is new.

scrape -> enrich -> embed -> edges -> cluster -> quotes -> export; services are providers (``sources/providers.py``).
"""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import extract, text
from corvane.operators import build, cluster, facets, vectors
from corvane.plans import views
from corvane.sources import providers, sinks
from corvane.sources.durable import durable

ENRICHED = "one_liner string, aha_explanation string, canonical_example string, domain array<string>, form string, affect array<string>, obscurity int, prerequisites_raw string, surprise_score int"
#: Sources of edges that are made here and replaced as a whole.
MADE = ["semantic-knn", "semantic-dedup", "prereq-resolve"]


class Enricher(Protocol):
    def enrich(self, title: str, extract: str) -> dict: ...


def scrape(existing: DataFrame, pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """``existing`` (slug, title, source_list) and the new entries of ``pages`` (source_list, priority, html) and
    ``seeds`` (source_list, priority, title); of equal slugs the first by priority, then place, then title."""
    p = pages.select(F.concat_ws("\x1f", "source_list", F.col("priority").cast("string")).alias("key"), "html")
    e = extract.entries(p, key="key").select(F.split_part("key", F.lit("\x1f"), F.lit(1)).alias("source_list"), F.split_part("key", F.lit("\x1f"), F.lit(2)).cast("int").alias("priority"), F.col("position"), "title")
    rows = e.unionByName(seeds.select("source_list", "priority", F.lit(0).alias("position"), "title"))
    rows = rows.where("title is not null").withColumn("slug", text.slugify(F.col("title"))).where("slug <> ''")
    return build.insert_new(existing.select("slug", "title", "source_list"), rows.select("slug", F.struct("priority", "position", "title").alias("at"), "title", "source_list"), ["slug"], "at")


def enrich(todo: DataFrame, cache: DataFrame, enricher: Enricher) -> DataFrame:
    """(id, key, enriched columns, valid, cached, dropped, drop_reason) of ``todo`` (id, title, wiki_extract): out of
    ``cache`` (key, the enriched columns) where it has a valid row for what would be sent, else from the enricher, once
    a row. Rows of a low surprise score are marked as dropped."""
    t = todo.withColumn("sent", text.truncated(F.coalesce("wiki_extract", F.lit("")), 3500)).withColumn("key", text.content_hash(F.col("title"), F.col("sent")))
    hit, miss = build.cache_split(t, build.valid(cache), "key")
    names = [c.split(" ")[0] for c in ENRICHED.split(", ")]

    def ask(batches):
        for b in batches:
            rows = []
            for title, sent in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                try:
                    rows.append(enricher.enrich(title, sent))
                except Exception:  # noqa: BLE001 - comes up again in the next run
                    rows.append({})
            cols = [pa.array([r.get(n) for r in rows], k) for n, k in zip(names, (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["id", "key", *names])

    new = build.valid(miss.select("id", "key", "title", "sent").mapInArrow(ask, "id long, key string, " + ENRICHED)).withColumn("cached", F.lit(False))
    old = hit.select("id", "key", *names).withColumns({"valid": F.lit(True), "cached": F.lit(True)})
    return build.dropped(new.unionByName(old))


def embed(concepts: DataFrame, embedder: providers.Embedder, model: str) -> DataFrame:
    """(id, embedding) of the kept concepts without a vector of the model."""
    t = build.to_embed(concepts, model).select("id", text.embedding_text(F.col("title"), F.col("one_liner"), F.col("aha_explanation")).alias("text"))
    return providers.embed(t, embedder)


def edges(existing: DataFrame, concepts: DataFrame, dim: int, embedder: providers.Embedder, k: int = 8, near: float = 0.92, prerequisite: float = 0.72) -> DataFrame:
    """Edges with the made ones rebuilt for all vectors: k nearest, near-duplicates, resolved prerequisites."""
    v = views.vectorised(concepts, dim=dim)
    near_ = durable(vectors.knn_edges(v, v, dim, k), "near")  # both kinds of edges come from one search
    knn = near_.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("semantic_near").alias("kind"), F.lit(MADE[0]).alias("source"), "weight", F.lit(None).cast("string").alias("note"))
    dup = vectors.duplicates(near_, near).select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("semantic_dedup").alias("kind"), F.lit(MADE[1]).alias("source"), "weight", "note")
    raw = views.kept(concepts).select("id").join(concepts.select("id", F.explode(build.string_list(F.col("prerequisites_raw"))).alias("phrase")), "id")
    raw = raw.select("id", F.trim("phrase").alias("phrase")).where("phrase <> ''").distinct()
    once = raw.select("phrase").distinct().select(F.xxhash64("phrase").alias("id"), F.col("phrase").alias("text"))
    vec = providers.embed(once, embedder).withColumnRenamed("id", "h")
    phrases = raw.withColumn("h", F.xxhash64("phrase")).join(vec, "h").select(F.xxhash64("id", "phrase").alias("pid"), F.col("id").alias("owner"), "phrase", "embedding").withColumnRenamed("pid", "id")
    pre = vectors.resolve_phrases(phrases, v, dim, prerequisite).select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("prerequisite_of").alias("kind"), F.lit(MADE[2]).alias("source"), "weight", F.col("phrase").alias("note"))
    return build.replaced_edges(existing, knn.unionByName(dup).unionByName(pre), MADE)


def clusters(concepts: DataFrame, dim: int, k: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """((cluster, size, representatives, top_terms), (id, cluster)) of all vectors."""
    assigned, _ = cluster.kmeans(views.vectorised(concepts, dim=dim), dim, k, seed=seed)
    t = concepts.select("id", F.concat_ws(" ", "title", "one_liner").alias("text")).join(assigned.select("id", "cluster"), "id")
    terms = cluster.top_terms(t).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("top_terms"))
    return cluster.cluster_table(assigned).join(terms, "cluster", "left"), assigned.select("id", "cluster")


QUOTED = ["concept_id", "text", "attribution", "source", "rank"]


def quotes(existing: DataFrame, concepts: DataFrame, pages: providers.Pages, cap: int = 3) -> DataFrame:
    """``existing`` (concept_id, text, attribution, source, rank) and up to ``cap`` quotes of each kept concept
    that has none, from the pages of its title."""
    todo = build.lacking(views.kept(concepts).select("id", "title"), existing).where("title is not null")

    def fetch(batches):
        for b in batches:
            got = [(i, page[1]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (page := pages.wikitext(t))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([p for _, p in got], pa.string())], names=["concept_id", "page"])

    found = todo.mapInArrow(fetch, "concept_id long, page string").select("concept_id", F.posexplode(text.quotes_of(F.col("page"), cap)).alias("rank", "q"))
    new = found.select("concept_id", "q.text", "q.attribution", F.lit("wikiquote").alias("source"), "rank")
    return existing.select(*QUOTED).unionByName(new)


def suggested_quotes(existing: DataFrame, concepts: DataFrame, suggestions: DataFrame, evidence: DataFrame, cache: DataFrame, least: int = 20, cap: int = 3) -> tuple[DataFrame, DataFrame]:
    """(``existing`` with up to ``cap`` verified ones of ``suggestions`` for each kept concept that has none, the cache
    for the next run). ``suggestions``: (concept_id, place, text, author, work), such as a model makes; texts under
    ``least`` characters don't count. A suggestion counts once its phrase is found in ``evidence`` (site_order,
    page_title, body); ``cache`` (key, site_order, page_title) remembers what was found, and what was not."""
    todo = build.lacking(views.kept(concepts).select("id"), existing).withColumnRenamed("id", "concept_id")
    s = suggestions.where(F.length("text") >= least).join(todo, "concept_id", "left_semi")
    s = s.withColumn("key", F.sha2("text", 256))
    cache = durable(build.checked_quotes(s.select(F.col("key").alias("id"), "text"), cache, evidence, text.search_phrase(F.col("text"))), "checked")
    hit = s.join(cache.where("page_title is not null").select("key"), "key", "left_semi")
    # one row a text of a concept, then the first by place
    once = hit.groupBy("concept_id", "text").agg(F.min(F.struct("place", text.attribution(F.col("author"), F.col("work")).alias("attribution"))).alias("f"))
    rank = (F.row_number().over(Window.partitionBy("concept_id").orderBy("f.place", "text")) - 1).alias("rank")
    new = once.select("concept_id", "text", "f.attribution", F.lit("llm_verified").alias("source"), rank).where(F.col("rank") < cap)
    return existing.select(*QUOTED).unionByName(new), cache


def export(concepts: DataFrame, edge_table: DataFrame, quote_table: DataFrame, folder: str, dim: int, cluster_table: DataFrame | None = None, assigned: DataFrame | None = None) -> None:
    """The serving tables: concepts, vectors and what is known of them, nested edges, tags, quotes by concept, search
    documents, and clusters with their members if given."""
    k = views.kept(concepts)
    sinks.write_json(k, f"{folder}/concepts")
    sinks.write_matrix(views.vectorised(concepts, dim=dim).join(k.select("id"), "id", "left_semi"), f"{folder}/embeddings")
    meta = views.vectorised(concepts.where(F.col("enriched_at").isNotNull()), dim=dim).agg(F.count("*").alias("rows"), F.lit(dim).alias("dim"))
    model = concepts.where((F.col("dropped") == 0) & F.col("embedding").isNotNull()).agg(F.max("embedding_model").alias("model"))
    sinks.write_json(meta.crossJoin(model), f"{folder}/embeddings_meta")  # one row each
    if cluster_table is not None:
        sinks.write_json(cluster_table, f"{folder}/clusters")
    if assigned is not None:
        sinks.write_json(assigned.join(k.select("id"), "id", "left_semi"), f"{folder}/assignments")
    sinks.write_json(build.nested_edges(views.edges_kept(edge_table, concepts)), f"{folder}/edges")
    sinks.write_json(facets.counts(k, ["form", "source", "obscurity", "surprise"], ["domain", "affect"]), f"{folder}/tags")
    q = quote_table.join(k.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    per = q.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "attribution", "source"))).alias("quotes"))
    sinks.write_json(per, f"{folder}/quotes")
    sinks.write_json(k.select("id", "slug", "title", "one_liner", "aha"), f"{folder}/search")


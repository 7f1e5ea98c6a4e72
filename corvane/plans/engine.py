"""One object over a folder of tables, with the bounds and defaults of the query surface.

Numbers are floored and clamped to their bounds. Unknown slugs raise ``NotFound``, missing or bad arguments
``BadRequest``. Every method but ``react`` returns a DataFrame.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import cluster, facets, graph, reactions, sampling, textsearch, vectors
from corvane.operators.facets import Filters, clamp_int
from corvane.plans import views
from corvane.sources import sinks
from corvane.sources.providers import Embedder
from corvane.sources.tables import table


class NotFound(LookupError):
    pass


class BadRequest(ValueError):
    pass


class Corpus:
    def __init__(self, spark: SparkSession, folder: str, model: str, dim: int, embedder: Embedder | None = None):
        self.spark, self.folder, self.dim, self.embedder = spark, folder, dim, embedder
        concepts = table(spark, folder, "concepts")
        self.kept = views.kept(concepts)
        self.vectors = views.vectorised(concepts, model, dim)
        self.edges = views.edges_kept(table(spark, folder, "edges"), concepts)
        self.quotes_ = self._optional("quotes", "id long, concept_id long, text string, attribution string, source string, source_url string, rank int")
        self.clusters_ = self._optional("clusters", "id long, size int, representatives array<long>, top_terms array<string>")
        self.log = self._optional("reactions", "user_key string, slug string, signal string, reacted_at timestamp, received_at timestamp")

    def _optional(self, name: str, schema: str) -> DataFrame:
        try:
            return table(self.spark, self.folder, name)
        except Exception:  # noqa: BLE001 - an absent table reads as an empty one
            return self.spark.createDataFrame([], schema)

    def _id(self, slug: str) -> int:
        r = self.kept.where(F.col("slug") == slug).select("id").first()
        if r is None:
            raise NotFound(f"no concept {slug!r}")
        return r.id

    def _ids(self, slugs: list[str]) -> list[int]:
        found = {r.slug: r.id for r in self.kept.where(F.col("slug").isin(*slugs)).select("slug", "id").collect()}
        if missing := [s for s in slugs if s not in found]:
            raise NotFound(f"no concepts {missing}")
        return [found[s] for s in slugs]

    def _show(self, hits: DataFrame, *more: str) -> DataFrame:
        """Short forms of hits (id, ...), absent concepts left out. Hits are a top-k, at most 500 rows."""
        return facets.slim(self.kept).join(F.broadcast(hits), "id").select(*facets.SLIM, *more)

    def concept(self, slug: str) -> DataFrame:
        self._id(slug)
        return self.kept.where(F.col("slug") == slug)

    def search(self, q: str, k=None, filters: Filters | None = None) -> DataFrame:
        hits = textsearch.search(self.kept, q)
        return facets.slim(facets.apply(self.kept, filters or Filters())).join(hits, "id").orderBy(F.desc("score"), "id").limit(clamp_int(k, 15, 1, 80))

    def semantic(self, q, k=None, filters: Filters | None = None, mmr: bool = False, lam=None) -> DataFrame:
        """``q``: a text, if there is an embedder, or a vector. With ``mmr`` the best max(8k, 80) are ranked for
        diversity, k of them or 4k if there are filters, which come last."""
        if isinstance(q, str):
            if self.embedder is None:
                raise BadRequest("a text needs an embedder")
            q = self.embedder.embed([q])[0]
        v = np.asarray(q, dtype=float)
        if v.shape != (self.dim,) or not np.isfinite(v).all():
            raise BadRequest(f"a vector of {self.dim} numbers is needed")
        v, k, f = v / (np.linalg.norm(v) or 1), clamp_int(k, 15, 1, 80), filters or Filters()
        if not mmr:
            return vectors.semantic(facets.slim(self.kept), self.vectors, v, self.dim, k, f)
        lam = 0.5 if lam is None else min(1.0, max(0.0, float(lam)))
        ranked = vectors.mmr(self.vectors, v, self.dim, k * (4 if f.any else 1), lam, max(8 * k, 80))
        return facets.apply(self._show(ranked, "rank", "mmr", "relevance"), f).orderBy("rank").limit(k)

    def filter(self, filters: Filters, by: str = "surprise", k=None, offset=None) -> DataFrame:
        return facets.slim(facets.page(facets.apply(self.kept, filters), by, clamp_int(offset, 0, 0, 10_000), clamp_int(k, 40, 1, 200)))

    def filter_with_total(self, filters: Filters, by: str = "surprise", k=None, offset=None) -> DataFrame:
        """As ``filter``, with how many concepts there are in all as ``total``."""
        return facets.page_with_total(facets.slim(facets.apply(self.kept, filters)), by, clamp_int(offset, 0, 0, 10_000), clamp_int(k, 40, 1, 200))

    def facets(self) -> DataFrame:
        return facets.counts(self.kept, ["form", "source", "obscurity", "surprise"], ["domain", "affect"])

    def neighbors(self, slug: str, kind: str = "semantic_near", k=None, filters: Filters | None = None) -> DataFrame:
        e = self.edges.where((F.col("src") == self._id(slug)) & (F.col("kind") == (kind if kind in graph.KINDS else "semantic_near")))
        hits = facets.slim(facets.apply(self.kept, filters or Filters())).join(e.select(F.col("dst").alias("id"), "weight"), "id")
        return hits.orderBy(F.desc("weight"), "id").limit(clamp_int(k, 10, 1, 50))

    def bridge(self, a: str, b: str, k=None) -> DataFrame:
        x, y = self._ids([a, b])
        return self._show(vectors.bridge(self.vectors, x, y, self.dim, clamp_int(k, 10, 1, 50)), "score", "sim_a", "sim_b")

    def triangulate(self, slugs: list[str], k=None) -> DataFrame:
        if len(slugs) < 2:
            raise BadRequest("two slugs at least")
        return self._show(vectors.triangulate(self.vectors, self._ids(slugs), self.dim, clamp_int(k, 10, 1, 50)), "score")

    def analogy(self, slug: str, domain: str | None = None, form: str | None = None, k=None) -> DataFrame:
        if not domain and not form:
            raise BadRequest("a domain or a form is needed")
        return self._show(vectors.analogy(self.kept, self.vectors, self._id(slug), self.dim, clamp_int(k, 10, 1, 50), domain or None, form or None), "score")

    def path(self, a: str, b: str, max_hops=None, kinds: list[str] | None = None) -> DataFrame:
        if bad := [x for x in kinds or [] if x not in graph.KINDS]:
            raise BadRequest(f"unknown kinds {bad}")
        x, y = self._ids([a, b]) if a != b else self._ids([a]) * 2
        return graph.shortest_path(self.edges, x, y, clamp_int(max_hops, 6, 1, 12), kinds)

    def random(self, k=None, filters: Filters | None = None, anchor: str | None = None, anchor_pool=None, surprise_temp: float = 1.0, obscurity_temp: float = 0.5, seed: int = 0) -> DataFrame:
        pool = facets.apply(self.kept, filters or Filters())
        if anchor:
            seed_id = self._id(anchor)
            _, q = vectors.fetch(self.vectors, [seed_id], self.dim)
            if len(q):
                near = vectors.top_k(self.vectors, q[0], self.dim, clamp_int(anchor_pool, 200, 10, 1000) + 1).where(F.col("id") != seed_id).select("id")
                pool = pool.join(F.broadcast(near), "id", "left_semi")  # at most 1,001 ids
        total = pool.agg(F.count("*").alias("total"))
        picked = facets.slim(sampling.weighted_sample(pool, clamp_int(k, 10, 1, 100), surprise_temp, obscurity_temp, seed))
        return picked.crossJoin(F.broadcast(total))  # one row: how many could be drawn

    def explain(self, a: str, b: str) -> DataFrame:
        x, y = self._ids([a, b])
        got, q = vectors.fetch(self.vectors, [x, y], self.dim)
        return graph.explain(self.kept, self.edges, x, y, float(round(q[0] @ q[1], 6)) if len(got) == 2 else None)

    def shared_neighbors(self, a: str, b: str, k: int = 25) -> DataFrame:
        x, y = self._ids([a, b])
        return graph.shared_neighbors(self.edges, x, y).orderBy("dst").limit(k)

    def ego_graph(self, slug: str) -> DataFrame:
        return graph.ego_graph(self.edges, self.kept.select("id"), self._id(slug))

    def clusters(self) -> DataFrame:
        m = cluster.given_members(self.clusters_).join(self.kept.select("id", "slug", "title"), "id")
        reps = m.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "id", "slug", "title"))).alias("representatives"))
        c = self.clusters_.select(F.col("id").alias("cluster"), "size", "top_terms")
        return c.join(reps, "cluster", "left").orderBy(F.desc("size"), "cluster")

    def _cluster(self, cluster_id: int) -> DataFrame:
        c = self.clusters_.where(F.col("id") == cluster_id)
        if c.isEmpty():
            raise NotFound(f"no cluster {cluster_id}")
        return c

    def cluster(self, cluster_id: int) -> DataFrame:
        """One row (cluster, size, top_terms, representatives)."""
        self._cluster(cluster_id)
        return self.clusters().where(F.col("cluster") == cluster_id)

    def cluster_members(self, cluster_id: int, assigned: DataFrame | None = None, filters: Filters | None = None, by: str = "surprise", k=None, offset=None) -> DataFrame:
        """A page of a cluster's members, with ``total``: those of ``assigned`` (id, cluster), as a build of clusters
        gives it, or the representatives of the stored cluster."""
        own = self._cluster(cluster_id) if assigned is None else assigned
        own = cluster.given_members(own) if assigned is None else own.where(F.col("cluster") == cluster_id)
        own = facets.slim(facets.apply(self.kept, filters or Filters())).join(own.select("id"), "id", "left_semi")
        return facets.page_with_total(own, by, clamp_int(offset, 0, 0, 1_000_000), clamp_int(k, 50, 1, 500))

    def concept_cluster(self, slug: str, assigned: DataFrame | None = None) -> DataFrame:
        """The cluster of a concept as ``cluster`` gives it, no rows if it is in none. By ``assigned`` (id, cluster), or
        by the stored representatives."""
        own = cluster.given_members(self.clusters_) if assigned is None else assigned
        r = own.where(F.col("id") == self._id(slug)).agg(F.min("cluster")).first()[0]
        return self.clusters().where(F.col("cluster") == (-1 if r is None else r))

    def page(self, slug: str) -> DataFrame:
        """What a concept's page shows of its edges: prerequisites and related concepts by kind."""
        hits = graph.concept_page(self.edges, self._id(slug)).withColumnRenamed("other", "id")
        return hits.join(self.kept.select("id", "slug", "title"), "id")

    def quotes(self, slug: str) -> DataFrame:
        return views.quotes_once(self.quotes_).where(F.col("concept_id") == self._id(slug)).orderBy("rank", "id")

    def dismissed(self, user: str) -> DataFrame:
        """The user's dismissed concepts, newest first: short forms and ``dismissed_at``."""
        own = reactions.replay(self.log, "dismissed", "undismissed").where("present").where(F.col("user_key") == user)
        shown = facets.slim(self.kept).join(own.select("slug", F.col("created_at").alias("dismissed_at")), "slug")
        return shown.select(*facets.SLIM, "dismissed_at").orderBy(F.desc("dismissed_at"), "id")

    def react(self, log: reactions.ReactionLog, user: str, slug: str, kind: str, on: bool = True):
        """Adds or removes a favorite or dismissed concept: when it was added, or whether it was there."""
        if kind not in log.PAIRS:
            raise BadRequest(f"unknown kind {kind!r}")
        if not on:
            return log.remove(user, slug, kind)
        self._id(slug)
        return log.add(user, slug, kind)

    def advice(self, folder: str, k=None) -> DataFrame:
        """The log of advice, newest first, with the picks that exist: (id, ts, situation, framing, slug, why, title)."""
        log = sinks.read_log(self.spark, folder).limit(clamp_int(k, 20, 1, 200))
        picks = log.select("id", "ts", "situation", "framing", F.posexplode("picks").alias("place", "p")).select("id", "ts", "situation", "framing", "place", "p.slug", "p.why")
        return picks.join(self.kept.select("slug", "title"), "slug").orderBy(F.desc("ts"), "id", "place").drop("place")

    def favorites(self, user: str, k=None) -> DataFrame:
        """The user's favorites, newest first, then up to k similar concepts: (part, id, slug, at, score)."""
        own = reactions.favorites(self.log).where(F.col("user_key") == user).join(self.kept.select("id", "slug"), "slug")
        first = own.select(F.lit("favorite").alias("part"), "id", "slug", F.col("created_at").alias("at"), F.lit(None).cast("double").alias("score")).orderBy(F.desc("at"), "id")
        n = clamp_int(k, 12, 0, 50)
        if not n:
            return first
        ids = [r.id for r in own.select("id").orderBy("id").collect()]  # one user's favorites
        near = vectors.triangulate(self.vectors, ids, self.dim, n).join(self.kept.select("id", "slug"), "id")
        return first.unionByName(near.select(F.lit("similar").alias("part"), "id", "slug", F.lit(None).cast("timestamp").alias("at"), "score"))

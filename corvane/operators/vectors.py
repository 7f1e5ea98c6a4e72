"""Exact vector retrieval: a stated set of query vectors against all rows, scored in Arrow blocks.

Up to BLOCK query vectors are broadcast and the rows stay where they are read. More of them are cut into blocks, as the
rows are, and each two blocks meet in a task of a shuffle, so neither the driver nor a task holds more for more
queries. Each task keeps its own best per query.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import parse, unit
from corvane.operators.facets import Filters, apply

#: Query vectors that are broadcast, and held by a task, at most.
BLOCK = 4096
#: Rows that meet a block of queries in one task, about.
ROWS = 200_000
#: Rows held against them at once; at most 8,192.
STEP = 1024


def fetch(vectors: DataFrame, ids: list[int], dim: int) -> tuple[list[int], np.ndarray]:
    """The valid unit vectors of a few ids, in the order asked for; absent ones are left out."""
    t = vectors.where(F.col("id").isin(*ids)).toArrow() if ids else None
    if t is None or not t.num_rows:
        return [], np.zeros((0, dim))
    got, x = parse(t.column("id"), t.column("embedding"), dim)
    at = {int(i): k for k, i in enumerate(got)}
    order = [i for i in ids if i in at]
    return order, unit(x[[at[i] for i in order]]) if order else np.zeros((0, dim))


def scores(vectors: DataFrame, q: np.ndarray, dim: int) -> DataFrame:
    """(id, s: array<double>): every valid row's similarity to each query vector, rounded to 6 decimals."""

    def run(batches):
        for b in batches:
            ids, x = parse(b.column(0), b.column(1), dim)
            s = np.round(unit(x) @ q.T, 6)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(s), pa.list_(pa.float64()))], names=["id", "s"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, s array<double>")


def top_k(vectors: DataFrame, q: np.ndarray, dim: int, k: int) -> DataFrame:
    """(id, score) of the k rows most similar to one vector; ties to the smaller id."""
    return scores(vectors, q[None, :], dim).select("id", F.col("s")[0].alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _against(queries: DataFrame, vectors: DataFrame, dim: int, score) -> DataFrame:
    """(src, dst, score) rows made by ``score``(query ids, query vectors, batches of (ids, vectors)) in each task."""
    spark, schema = vectors.sparkSession, "src long, dst long, score double"

    def out(qid, q, batches):
        for src, dst, s in score(qid, q, batches):
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(s)], names=["src", "dst", "score"])

    n = queries.count()
    if n <= BLOCK:
        t = queries.select("id", "embedding").toArrow()  # at most BLOCK rows
        qid, q = parse(t.column("id"), t.column("embedding"), dim) if n else (np.zeros(0, np.int64), np.zeros((0, dim)))
        sent = spark.sparkContext.broadcast((qid, unit(q)))

        def scan(batches):
            if len(sent.value[0]):
                yield from out(*sent.value, (parse(b.column(0), b.column(1), dim) for b in batches))

        return vectors.select("id", "embedding").mapInArrow(scan, schema)

    a = -(-n // BLOCK)
    b = max(-(-vectors.count() // ROWS), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // a))
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = queries.select(block(a).alias("a"), every(b).alias("b"), F.lit(0).alias("role"), "id", "embedding")
    right = vectors.select(every(a).alias("a"), block(b).alias("b"), F.lit(1).alias("role"), "id", "embedding")
    both = left.unionByName(right).select((F.col("a") * b + F.col("b")).alias("task"), "role", "id", "embedding")

    def meet(batches):
        ids, rows, rest = [], [], iter(batches)
        held: list = []
        for batch in rest:  # queries come first
            role = batch.column(1).to_numpy()
            k = int(np.searchsorted(role, 1))
            i, x = parse(batch.column(2).slice(0, k), batch.column(3).slice(0, k), dim)
            ids.append(i)
            rows.append(x)
            if k < len(role):
                held.append(batch.slice(k))
                break

        def others():
            for batch in chain(held, rest):
                yield parse(batch.column(2), batch.column(3), dim)

        if ids and held:
            yield from out(np.concatenate(ids), unit(np.concatenate(rows)), others())

    return both.repartitionById(a * b, F.col("task")).sortWithinPartitions("task", "role").mapInArrow(meet, schema)


def nearest(queries: DataFrame, vectors: DataFrame, dim: int, k: int, keep_self: bool = False) -> DataFrame:
    """(src, dst, score): the k rows of ``vectors`` most similar to each of ``queries``, exactly; ties to the
    smaller id; a row isn't its own neighbour unless ``keep_self``. Needs no more than k rows to exist. Rows with a
    null, NaN or infinite number and all-zero ones take no part on either side."""

    def best(qid, q, batches):
        best_s, best_i = np.full((len(qid), 0), -9.0), np.zeros((len(qid), 0), np.int64)
        for ids, x in batches:
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for a in range(0, len(ids), STEP):
                i = np.broadcast_to(ids[a : a + STEP], (len(qid), len(ids[a : a + STEP])))
                s = np.round(q @ unit(x[a : a + STEP]).T, 6)
                if not keep_self:
                    s[qid[:, None] == i] = -9.0
                if s.shape[1] > k:  # the k best by similarity, then by id, as one number
                    key = (np.rint(s * 1e6).astype(np.int64) << 13) - np.arange(s.shape[1])
                    top = np.argpartition(-key, k - 1, axis=1)[:, :k]
                    s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                best_s, best_i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, i], axis=1)
                order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
        r, c = np.nonzero(best_s > -9.0)
        yield qid[r], best_i[r, c], best_s[r, c]

    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return _against(queries, vectors, dim, best).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_edges(queries: DataFrame, vectors: DataFrame, dim: int, k: int = 8) -> DataFrame:
    """(src, dst, weight): directed edges to the k nearest rows with a similarity above 0."""
    return nearest(queries, vectors, dim, k).where("score > 0").select("src", "dst", F.col("score").alias("weight"))


def similar_pairs(queries: DataFrame, vectors: DataFrame, dim: int, least: float) -> DataFrame:
    """(src, dst, weight): all pairs of one of ``queries`` and another row that are at least ``least`` similar, each
    once, src having the smaller id."""

    def pairs(qid, q, batches):
        for ids, x in batches:
            for a in range(0, len(ids), STEP):
                i, s = ids[a : a + STEP], np.round(q @ unit(x[a : a + STEP]).T, 6)
                r, c = np.nonzero((s >= least) & (qid[:, None] != i))
                yield np.minimum(qid[r], i[c]), np.maximum(qid[r], i[c]), s[r, c]

    return _against(queries, vectors, dim, pairs).groupBy("src", "dst").agg(F.max("score").alias("weight"))


def duplicates(edges: DataFrame, least: float = 0.92) -> DataFrame:
    """(src, dst, weight, note) of those ``edges`` of nearest rows that are at least ``least`` similar and point to the
    larger id."""
    e = edges.where((F.col("src") < F.col("dst")) & (F.col("weight") >= least)).select("src", "dst", "weight")
    return e.withColumn("note", F.concat(F.lit("cosine="), F.format_string("%.3f", "weight")))


def dedup_pairs(queries: DataFrame, vectors: DataFrame, dim: int, least: float = 0.92, k: int = 8, mode: str = "topk") -> DataFrame:
    """(src, dst, weight, note): pairs at least ``least`` similar where dst is among src's k nearest and
    has the larger id; in mode "all_pairs" all such pairs with a row of ``queries``, whatever their ranks."""
    if mode not in ("topk", "all_pairs"):
        raise ValueError(mode)
    return duplicates(similar_pairs(queries, vectors, dim, least) if mode == "all_pairs" else knn_edges(queries, vectors, dim, k), least)


def resolve_phrases(phrases: DataFrame, vectors: DataFrame, dim: int, least: float = 0.72) -> DataFrame:
    """``phrases`` (id, owner, phrase, embedding) -> (src, dst, weight, phrase): the row that a phrase means,
    as a prerequisite of its owner. The best match, or the second best if that is the owner, if it is at
    least ``least`` similar. Of several phrases for one edge the first in order is kept."""
    best = nearest(phrases, vectors, dim, 2, keep_self=True).join(phrases.select(F.col("id").alias("src"), "owner", "phrase"), "src").where("dst <> owner")
    one = best.groupBy("src", "owner", "phrase").agg(F.min(F.struct("rank", "dst", "score")).alias("b")).where(F.col("b.score") >= least)
    return one.groupBy(F.col("b.dst").alias("src"), F.col("owner").alias("dst")).agg(F.min(F.struct("phrase", "b.score")).alias("f")).select("src", "dst", F.col("f.score").alias("weight"), F.col("f.phrase"))


def semantic(concepts: DataFrame, vectors: DataFrame, q: np.ndarray, dim: int, k: int, filters: Filters | None = None, digits: int = 4) -> DataFrame:
    """(slim columns of ``concepts``, score): the k best. With filters, those of the best min(N, 8k) that
    pass, so there may be fewer: the filter is applied after the top-k."""
    f = filters or Filters()
    pool = top_k(vectors, q, dim, 8 * k if f.any else k)
    hits = apply(concepts.join(F.broadcast(pool), "id"), f)
    return hits.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "id").limit(k)


def mmr(vectors: DataFrame, q: np.ndarray, dim: int, k: int, lam: float = 0.5, pool: int | None = None) -> DataFrame:
    """(rank, id, mmr, relevance): greedy picks by lam * relevance - (1 - lam) * max(0, similarity to the
    picks so far), from the ``pool`` (8k) most similar rows. Ties keep the earlier candidate. The pool is
    bounded by k, so the sequential part runs on it alone."""
    spark = vectors.sparkSession
    best = top_k(vectors, q, dim, pool or 8 * k).join(vectors, "id").toArrow()
    schema = "rank int, id long, mmr double, relevance double"
    if not best.num_rows:
        return spark.createDataFrame([], schema)
    ids, x = parse(best.column("id"), best.column("embedding"), dim)
    rel = dict(zip(best.column("id").to_pylist(), best.column("score").to_pylist()))
    order = sorted(range(len(ids)), key=lambda i: (-rel[ids[i]], ids[i]))
    x, ids = unit(x)[order], ids[order]
    r = x @ q
    near, left, rows = np.zeros(len(ids)), np.ones(len(ids), dtype=bool), []
    for rank in range(min(k, len(ids))):
        value = np.where(left, lam * r - (1 - lam) * near, -np.inf)
        i = int(value.argmax())
        rows.append((rank + 1, int(ids[i]), float(round(value[i], 6)), float(round(r[i], 6))))
        left[i] = False
        near = np.maximum(near, x @ x[i])
    return spark.createDataFrame(rows, schema)


def bridge(vectors: DataFrame, a: int, b: int, dim: int, k: int) -> DataFrame:
    """(id, score, sim_a, sim_b): rows close to both seeds, by twice the smaller similarity; seeds are left
    out; without one of them there are no rows."""
    got, q = fetch(vectors, [a, b], dim)
    if len({a, b}) != len(set(got)) or len(got) < len([a, b]):
        return vectors.sparkSession.createDataFrame([], "id long, score double, sim_a double, sim_b double")
    s = scores(vectors, q, dim).select("id", F.col("s")[0].alias("sim_a"), F.col("s")[1].alias("sim_b")).where(~F.col("id").isin(a, b))
    return s.withColumn("score", F.round(2 * F.least("sim_a", "sim_b"), 6)).orderBy(F.desc("score"), "id").limit(k).select("id", "score", "sim_a", "sim_b")


def centroid(q: np.ndarray) -> np.ndarray:
    m = q.mean(axis=0)
    n = np.linalg.norm(m)
    return m / n if n else m


def triangulate(vectors: DataFrame, seeds: list[int], dim: int, k: int) -> DataFrame:
    """(id, score): rows closest to the mean of the seeds' vectors. The best k + len(seeds) are taken and seeds
    dropped from them. A seed given twice counts twice. No seed with a vector: no rows."""
    got, q = fetch(vectors, list(dict.fromkeys(seeds)), dim)
    if not got:
        return vectors.sparkSession.createDataFrame([], "id long, score double")
    at = {i: k_ for k_, i in enumerate(got)}
    q = q[[at[i] for i in seeds if i in at]]
    return top_k(vectors, centroid(q), dim, k + len(seeds)).where(~F.col("id").isin(*seeds)).orderBy(F.desc("score"), "id").limit(k)


def analogy(concepts: DataFrame, vectors: DataFrame, seed: int, dim: int, k: int, domain: str | None = None, form: str | None = None) -> DataFrame:
    """(id, score): the concepts of a domain or form most like the seed, which is left out. The filter comes
    first."""
    if domain is None and form is None:
        raise ValueError("a domain or a form is needed")
    _, q = fetch(vectors, [seed], dim)
    if not len(q):
        return vectors.sparkSession.createDataFrame([], "id long, score double")
    pool = apply(concepts, Filters(domain=domain, form=form)).where(F.col("id") != seed).select("id")
    return top_k(vectors.join(pool, "id", "left_semi"), q[0], dim, k)

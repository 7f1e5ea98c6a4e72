"""Problem 5: parallel pivot correlation clustering of vectors by a similarity threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import lists
from corvane.llm.lists import Covering
from corvane.operators.skew import join_skewed
from corvane.sources.durable import durable, release

THRESHOLD = 0.7
QUERY_TILE, CANDIDATE_TILE, PIECES = 512, 4096, 5
NEAR = 4e-6


def _pieces(ids: np.ndarray) -> np.ndarray:
    """A 60-bit hash of each id in five 12-bit numbers, so that float32 sums over a tile are exact."""
    h = lists.mix64(ids, 2)
    return np.stack([(h >> np.uint64(12 * p)) & np.uint64(0xFFF) for p in range(PIECES)], axis=1).astype(np.float32)


def _rank(ids: np.ndarray) -> np.ndarray:
    """The order of pivots: a hash of the id, as a non-negative long."""
    return (lists.mix64(ids, 3) >> np.uint64(1)).astype(np.int64)


def _tiles(x64, x, cand, quer, threshold):
    """(query rows, candidate rows, similarities, similar or not) of a unit, tile by tile. Similarities
    too near the threshold for single precision are computed again in double. Tiles without a similar pair are left out."""
    for a in range(0, len(quer), QUERY_TILE):
        q = quer[a : a + QUERY_TILE]
        for b in range(0, len(cand), CANDIDATE_TILE):
            c = cand[b : b + CANDIDATE_TILE]
            s = x[q] @ x[c].T
            if s.max(initial=-2) < threshold - NEAR:
                continue
            hit = s >= threshold - NEAR
            i, j = np.divmod(np.flatnonzero(hit & (s < threshold + NEAR)), len(c))
            if len(i):
                hit[i, j] = np.einsum("ij,ij->i", x64(q[i]), x64(c[j])) >= threshold
            yield q, c, s, hit


def _passes(index: lists.Index, made: list[DataFrame], rows) -> DataFrame:
    """All that ``rows`` gives for the stretches of parts of ``index``. Of several each is written, and its shuffle
    dropped, before the next begins; the tables are added to ``made``."""
    if len(index.passes) == 1:
        return rows(index.passes[0])
    out = None
    for within in index.passes:
        made.append(durable(rows(within), "pass", drop_shuffles=True))
        out = made[-1] if out is None else out.unionByName(made[-1])
    return out


def neighbourhoods(vectors: DataFrame, index: lists.Index, threshold: float) -> DataFrame:
    """(id, n, pivot, pivot_rank, h0..h4): of each row's closed neighbourhood its size, its member first in
    hash order and the sum of its members' hashes. Links are summed where they are found and never
    leave the task, so a cluster of m rows costs m rows of output, not m * m. ``index`` is planned by a
    ``Covering`` of the threshold, so no link is missed: of two lists, or two blocks of one, the rows of one probe the other, not the
    reverse, and such a link counts for both ends. ``vectors``: as placed. A durable table."""
    names = ["id", "n", "pivot", "pivot_rank", *[f"h{p}" for p in range(PIECES)]]

    def run(batches):
        part = lists.read_part(batches, index.dim)
        if part is None:
            return
        x, ranks, pieces = lists.unit(part.x), _rank(part.ids), _pieces(part.ids)
        cell = lists.cells(part.ids, part.home, index)
        ones = np.concatenate([np.ones((len(x), 1), np.float32), pieces], axis=1)
        sums, best = np.zeros((len(x), 1 + PIECES), np.int64), np.full(len(x), -1)

        def add(rows, others, hit):
            some = hit.any(axis=1)
            if not some.any():
                return
            rows, hit = rows[some], hit[some]
            sums[rows] += (hit.astype(np.float32) @ ones[others]).astype(np.int64)
            first, own = others[hit.argmax(axis=1)], rows
            better = (best[own] < 0) | (ranks[first] < ranks[best[own]])
            best[own[better]] = first[better]

        for cand, quer in part.units:
            cand, quer = (r[np.argsort(ranks[r], kind="stable")] for r in (cand, quer))
            for q, c, _, hit in _tiles(lambda r: lists.unit64(part.x[r]), x, cand, quer, threshold):
                add(q, c, hit)
                back = cell[q] != cell[c[0]]
                if back.any():
                    add(c, q[back], hit[back].T)
        got = np.flatnonzero(best >= 0)
        cols = [part.ids[got], sums[got, 0], part.ids[best[got]], ranks[best[got]], *sums[got, 1:].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)

    def rows(within):
        return lists.sent(vectors, index, True, True, within).repartitionById(within[1] - within[0], F.col("part")).mapInArrow(run, ", ".join(f"{n} long" for n in names))

    made: list[DataFrame] = []
    best = F.min(F.struct("pivot_rank", "pivot"))
    around = _passes(index, made, rows).groupBy("id").agg(F.sum("n").alias("n"), best["pivot"].alias("pivot"), best["pivot_rank"].alias("pivot_rank"), *[F.sum(f"h{p}").alias(f"h{p}") for p in range(PIECES)])
    around = durable(around, "around", drop_shuffles=True)
    release(*made)
    return around


def _to_pivots(vectors: DataFrame, pivots: DataFrame, centroids, dim: int, threshold: float, closest: bool) -> DataFrame:
    """(id, pivot): each of ``vectors`` with the similar one of ``pivots`` that is closest, or first in hash
    order; rows without a similar pivot are left out. Both as placed. A durable table."""
    # pivots are fewer, so they go to the lists of the others
    index = lists.plan(vectors, pivots, centroids, dim, Covering(threshold, everyone=True))

    def run(batches):
        part = lists.read_part(batches, dim)
        if part is None:
            return
        x, ranks = lists.unit(part.x), _rank(part.ids)
        score, best = np.full(len(x), -np.inf), np.full(len(x), -1)
        for row, piv in part.units:
            piv = piv[np.argsort(ranks[piv], kind="stable")]
            for q, c, s, hit in _tiles(lambda r: lists.unit64(part.x[r]), x, piv, row, threshold):
                some = hit.any(axis=1)
                s, hit, own = s[some], hit[some], q[some]
                j = np.where(hit, np.round(s, 6), -2).argmax(axis=1) if closest else hit.argmax(axis=1)
                value = np.round(s[np.arange(len(j)), j], 6).astype(float) if closest else -ranks[c[j]].astype(float)
                better = value > score[own]
                score[own[better]], best[own[better]] = value[better], c[j[better]]
        got = np.flatnonzero(best >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(part.ids[got]), pa.array(score[got]), pa.array(ranks[best[got]]), pa.array(part.ids[best[got]])], names=["id", "score", "pivot_rank", "pivot"])

    def rows(within):
        both = lists.sent(vectors, index, True, False, within).unionByName(lists.sent(pivots, index, False, True, within))
        return both.repartitionById(within[1] - within[0], F.col("part")).mapInArrow(run, "id long, score double, pivot_rank long, pivot long")

    made: list[DataFrame] = []
    found = _passes(index, made, rows).groupBy("id").agg(F.max(F.struct("score", -F.col("pivot_rank"), "pivot"))["pivot"].alias("pivot"))
    found = durable(found, "to_pivots", drop_shuffles=True)
    release(*made)
    return found


def pivot_clusters(vectors: DataFrame, dim: int, threshold: float = THRESHOLD, reassign: bool = True) -> tuple[DataFrame, DataFrame]:
    """((id, pivot), neighbourhoods): every row of ``vectors`` (id, embedding) in one cluster.

    Rounds: among the rows left, those that come first in hash order in their own neighbourhood are
    pivots; a pivot absorbs its similar rows, one similar to several going to the first in hash order.
    No two pivots of a round are similar, so rounds are few: their number grows with the logarithm of
    the rows. Then every row is reassigned to the closest pivot of all. A row with no similar one is its
    own cluster. Rows with a null, NaN or infinite number, all-zero ones and those without an id take no part; an
    empty table gives no rows; ids have to be unique. Other columns are ignored.
    """
    vectors = vectors.select("id", "embedding").where("id is not null")
    centroids = lists.fit(vectors, dim)
    centroids, placed, made = lists.place(vectors, centroids, dim, Covering(threshold))
    left, done, first = placed, None, None
    while True:
        around = neighbourhoods(left, lists.plan(left, None, centroids, dim, Covering(threshold)), threshold)
        first = first or around
        pivots = around.where("id = pivot").select("pivot")
        direct = join_skewed(around.select("id", "pivot"), pivots, "pivot", "left_semi").select("id", "pivot")
        direct = durable(direct, "direct", drop_shuffles=True)
        made += [direct] if around is first else [direct, around]
        done = direct if done is None else done.unionByName(direct)
        rest = durable(around.select("id").join(direct, "id", "left_anti"), "rest", drop_shuffles=True)
        made.append(rest)
        if rest.isEmpty():
            break
        others = durable(left.join(rest, "id", "left_semi"), "others", drop_shuffles=True)
        chosen = durable(left.join(pivots.select(F.col("pivot").alias("id")), "id", "left_semi"), "chosen", drop_shuffles=True)
        absorbed = _to_pivots(others, chosen, centroids, dim, threshold, closest=False)
        release(chosen, left if left is not placed else None)
        done = done.unionByName(absorbed)
        still = durable(rest.join(absorbed, "id", "left_anti"), "left", drop_shuffles=True)
        made += [absorbed, still, others]
        if still.isEmpty():
            break
        left = durable(others.join(still, "id", "left_semi"), "left", drop_shuffles=True)
        made.append(left)
        release(others)
    done = durable(done, "pivots")
    if reassign:
        first_done = done
        pivots = durable(placed.join(done.select(F.col("pivot").alias("id")).distinct(), "id", "left_semi"), "chosen", drop_shuffles=True)
        done = _to_pivots(placed, pivots, centroids, dim, threshold, closest=True)
        release(first_done, pivots)
    release(*made)
    return done, first


def isolated_cliques(members: DataFrame, around: DataFrame, least: int) -> DataFrame:
    """(cluster_id, concept_id) of the clusters of at least ``least`` rows, any two of which are similar and
    none of which has a similar row outside: every member's neighbourhood must be the cluster. That is
    tested by its size and the sum of its hashes, which differ for different sets but for a chance of
    2^-60 each."""
    m = members.join(around.drop("pivot", "pivot_rank"), "id").join(
        # the hash of a row itself, summed over the cluster, is what each neighbourhood must have
        _own_hashes(members), "id")
    same = F.min("n") == F.max("n")
    for p in range(PIECES):
        same = same & (F.min(f"h{p}") == F.max(f"h{p}")) & (F.min(f"h{p}") == F.sum(f"o{p}"))
    good = m.groupBy("pivot").agg(F.count("*").alias("size"), F.min("id").alias("cluster_id"), (same & (F.min("n") == F.count("*"))).alias("clique")).where(F.col("clique") & (F.col("size") >= least))
    return join_skewed(members, good.select("pivot", "cluster_id"), "pivot").select("cluster_id", F.col("id").alias("concept_id"))


def _own_hashes(members: DataFrame) -> DataFrame:
    names = ["id", *[f"o{p}" for p in range(PIECES)]]

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(c)) for c in _pieces(ids).astype(np.int64).T]], names=names)

    return members.select("id").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def describe(members: DataFrame, vectors: DataFrame, dim: int, typical: int = 6, least: int = 1) -> DataFrame:
    """(cluster_id, size, medoid, representatives) of each cluster of ``least`` rows or more: its smallest id, its
    rows, the row most similar to the mean of its unit rows, and the ``typical`` most similar ones, ties to the
    smaller id.

    Means are summed by cluster in each task before the shuffle; members are then scored against their
    mean, joined as by ``join_skewed``, and the best are kept in each task first."""
    names = ["pivot", "n", "least", "total"]

    def sums(batches):
        acc: dict[int, list] = {}
        for b in batches:
            p, (ids, x) = b.column(0).to_numpy(), (b.column(1).to_numpy(), np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim))
            u = lists.unit64(x)
            order = np.argsort(p, kind="stable")
            key, start = np.unique(p[order], return_index=True)
            for k, t, n, i in zip(key, np.add.reduceat(u[order], start, axis=0), np.diff([*start, len(p)]), np.minimum.reduceat(ids[order], start)):
                a = acc.setdefault(int(k), [0, int(i), np.zeros(dim)])
                a[0] += int(n)
                a[1] = min(a[1], int(i))
                a[2] = a[2] + t
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int64()), pa.array([a[0] for a in acc.values()], pa.int64()), pa.array([a[1] for a in acc.values()], pa.int64()), pa.array([a[2].tolist() for a in acc.values()], pa.list_(pa.float64()))], names=names)

    if least > 1:  # rows left to themselves are many and need no means
        big = members.groupBy("pivot").count().where(F.col("count") >= least).select("pivot")
        members = durable(join_skewed(members, big, "pivot", "left_semi").select("id", "pivot"), "big")
    own = vectors.join(members, "id").select("pivot", "id", "embedding")
    parts = own.mapInArrow(sums, "pivot long, n long, least long, total array<double>")
    each = parts.select("pivot", "n", "least", F.posexplode("total").alias("d", "t")).groupBy("pivot", "d").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.min("least").alias("least"))
    means = each.groupBy("pivot").agg(F.first("n").alias("size"), F.first("least").alias("cluster_id"), F.transform(F.array_sort(F.collect_list(F.struct("d", "t"))), lambda e: e["t"]).alias("mean"))
    means = durable(means, "means")

    def score(batches):
        for b in batches:
            x = np.asarray(b.column("embedding").flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)
            m = b.column("mean").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            s = np.einsum("ij,ij->i", lists.unit64(x), lists.unit64(m)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("id"), pa.array(np.round(s, 6))], names=["pivot", "id", "s"])

    scored = join_skewed(own, means.select("pivot", "mean"), "pivot").select("pivot", "id", "embedding", "mean").mapInArrow(score, "pivot long, id long, s double")
    salted = Window.partitionBy("pivot", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.desc("s"), "id")
    best = scored.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= typical)
    final = best.withColumn("r", F.row_number().over(Window.partitionBy("pivot").orderBy(F.desc("s"), "id"))).where(F.col("r") <= typical)
    reps = final.groupBy("pivot").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda e: e["id"]).alias("representatives"))
    return means.select("pivot", "cluster_id", "size").join(reps, "pivot").select("pivot", "cluster_id", "size", F.col("representatives")[0].alias("medoid"), "representatives")

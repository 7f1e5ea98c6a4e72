"""Problem 2: the most similar vectors of every vector, by an adaptive dimension scan."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import lists
from corvane.llm.lists import Probing
from corvane.operators.skew import join_skewed
from corvane.sources.durable import durable, release

#: Lists probed: within 0.2 of the nearest centroid, 32 at most, but as many as hold 16 rows. This is where
#: accuracy is given up; measured recall: see the README.
PROBING = Probing(delta=0.2, floor=2.0, most=32, least=16)
#: The exact way: every list, and no candidate is abandoned.
EXACT = Probing(delta=9.0, floor=-2.0, most=None)
#: Dimensions known after each column block, as parts of all.
COLUMN_BLOCKS = (0.125, 0.25, 0.5, 1.0)
#: The test's constant: a candidate is abandoned if its distance, estimated from the first d of D rotated
#: dimensions, is over (1 + EPSILON / sqrt(d)) times the distance to beat.
EPSILON = 2.1
QUERY_TILE, CANDIDATE_TILE, SPARE, SPARSE = 256, 4096, 8, 0.05
#: Copies in the sample by which a vector counts as hot.
CROWD = 8
NONE = -(1 << 62)  # no candidate yet; can be negated, unlike the least long


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, which spreads any vector evenly over its dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


class Best:
    """The m best candidates so far of each query: similarity in millionths, ties to the smaller row."""

    def __init__(self, queries: int, m: int):
        self.m = m
        self.key = np.full((queries, m), NONE)

    def floor(self, q: np.ndarray) -> np.ndarray:
        """The similarity to beat, a millionth below the m-th best; -2 if there aren't m yet."""
        worst = self.key[q].min(axis=1)
        return np.where(worst == NONE, -2.0, (worst >> 32) / 1e6 - 2e-6).astype(np.float32)

    def add(self, q: np.ndarray, c: np.ndarray, sim: np.ndarray) -> None:
        if not len(q):
            return
        key = (np.rint(sim.astype(np.float64) * 1e6).astype(np.int64) << 32) + (0x7FFFFFFF - c)
        order = np.lexsort((-key, q))
        q, key = q[order], key[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(start, np.diff([*start, len(q)]))
        top = rank < self.m
        own = q[start]
        new = np.full((len(own), self.m), NONE)
        new[(np.repeat(np.arange(len(own)), np.diff([*start, len(q)])))[top], rank[top]] = key[top]
        both = np.concatenate([self.key[own], new], axis=1)
        self.key[own] = -np.partition(-both, self.m - 1, axis=1)[:, : self.m]

    def rows(self) -> np.ndarray:
        return np.where(self.key == NONE, -1, 0x7FFFFFFF - (self.key & 0xFFFFFFFF))


def scan(x: np.ndarray, norms: list[np.ndarray], edges: list[int], cand: np.ndarray, quer: np.ndarray, best: Best, epsilon: float = EPSILON) -> None:
    """One list's candidates against the queries that probe it. ``x``: rotated unit rows, ``norms``: their
    squared length over the dimensions before each edge. Tiles go through the column blocks; after each,
    the test drops pairs that can hardly reach the query's best. Once few pairs of a tile are left they
    are finished one by one, and a tile without any is left at once."""
    dim = x.shape[1]
    for a in range(0, len(quer), QUERY_TILE):
        q = quer[a : a + QUERY_TILE]
        for b in range(0, len(cand), CANDIDATE_TILE):
            c = cand[b : b + CANDIDATE_TILE]
            floor = best.floor(q)
            reach = np.sqrt(np.maximum(2 - 2 * floor, 0))
            dot, begin, pairs = np.zeros((len(q), len(c)), np.float32), 0, None
            for k, end in enumerate(edges):
                if pairs is None:
                    dot += x[q, begin:end] @ x[c, begin:end].T
                    if end == dim:
                        break
                    near = norms[k][q][:, None] + norms[k][c][None, :] - 2 * dot
                    bound = (reach * (1 + epsilon / end**0.5)) ** 2 * (end / dim)
                    keep = near <= bound[:, None]
                    left = np.count_nonzero(keep)
                    if left <= SPARSE * keep.size:
                        i, j = np.nonzero(keep)
                        pairs, s = (i, j), dot[i, j]
                else:
                    i, j = pairs
                    s = s + np.einsum("ij,ij->i", x[q[i], begin:end], x[c[j], begin:end])
                    if end < dim and len(i):
                        near = norms[k][q[i]] + norms[k][c[j]] - 2 * s
                        keep = near <= ((reach * (1 + epsilon / end**0.5)) ** 2 * (end / dim))[i]
                        pairs, s = (i[keep], j[keep]), s[keep]
                begin = end
            if pairs is None:
                if (floor < -1).any() and len(c) > best.m:
                    floor = np.maximum(floor, -np.partition(-dot, best.m, axis=1)[:, best.m] - 2e-6)
                i, j = np.nonzero(dot >= floor[:, None])
                s = dot[i, j]
            else:
                i, j = pairs
            ok = q[i] != c[j]  # rows, so a repeated id is a row of its own
            best.add(q[i][ok], c[j][ok], s[ok])


def part_neighbours(part: lists.Part, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, similarity) of a part: the k best in double precision, of k + SPARE kept by the
    scan. A query's own list comes first, so that it meets the others with a distance to beat."""
    order = np.argsort(part.ids, kind="stable")  # rows in order of id, so that ties go to the smaller id
    inv = np.empty_like(order)
    inv[order] = np.arange(len(order))
    ids, raw = part.ids[order], part.x[order]
    dim = raw.shape[1]
    x = lists.unit(raw) @ rotation(dim)
    edges = sorted({max(1, int(dim * f)) for f in COLUMN_BLOCKS})
    norms = [np.einsum("ij,ij->i", x[:, :e], x[:, :e]) for e in edges]
    best = Best(len(ids), k + SPARE)
    units = [(np.sort(inv[c]), np.sort(inv[q])) for c, q in part.units]
    for own in (True, False):
        for c, q in units:
            here = np.isin(q, c, assume_unique=True) == own
            if here.any():
                scan(x, norms, edges, c, q[here], best, epsilon)
    found = best.rows()
    q, slot = np.nonzero(found >= 0)
    c = found[q, slot]
    exact = np.empty(len(q))
    for a in range(0, len(q), 65536):
        s = slice(a, a + 65536)
        exact[s] = np.einsum("ij,ij->i", lists.unit64(raw[q[s]]), lists.unit64(raw[c[s]]))
    exact = np.round(exact, 6)
    o = np.lexsort((c, -exact, q))
    q, c, exact = q[o], c[o], exact[o]
    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
    top = rank < k
    return ids[q[top]], ids[c[top]], exact[top]


def nearest(vectors: DataFrame, dim: int, k: int = 5, probing: Probing = PROBING) -> DataFrame:
    """(id, neighbour_id, similarity): the k most similar other rows of each row of ``vectors`` (id,
    embedding of ``dim`` floats), by cosine rounded to 6 decimals, ties to the smaller id.

    Every row is indexed and is a query; the loss comes only from lists not probed and candidates wrongly
    abandoned; with ``probing=EXACT`` there is none, at the cost of all pairs. Vectors with many copies are found
    in a sample; of their copies, told by hashes, those beyond k + 1 take the neighbours of the first, so a hot group
    of copies costs what k + 1 rows cost. Smaller groups of copies are searched like other rows. Rows with a null, NaN or infinite
    number, all-zero ones and those without an id take no part; copies of a vector are neighbours like any other;
    a row that repeats an id is a neighbour of the other, so ids should be unique; with under k + 1 rows there
    are fewer neighbours; an empty table gives no rows. Other columns are ignored.
    """
    vectors = vectors.select("id", "embedding").where("id is not null")
    n = vectors.count()
    some = lists.sample(vectors, dim, n)
    # a vector with many copies has several in the sample; of how many rows, the sample's size tells
    hot = durable(some.groupBy(F.xxhash64("embedding").alias("h")).count().where(F.col("count") >= CROWD).select("h"), "hot")
    if hot.isEmpty():
        return _nearest(vectors, n, some, dim, k, probing)
    release(some)
    # a second hash tells the copies from what only shares the first
    keyed = vectors.withColumn("h", F.xxhash64("embedding")).join(F.broadcast(hot), "h", "left_semi")  # a part of the sample
    keyed = keyed.select("id", F.concat_ws("_", "h", F.xxhash64("embedding", F.lit(1))).alias("k"))
    big = durable(keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > k + 1), "copies")
    # of more copies than can be anyone's neighbours only those of smallest id go on; the rest have the
    # neighbours of the first one, and the first one
    copies = join_skewed(keyed, big.select("k"), "k", "left_semi")
    by_id = Window.partitionBy("k").orderBy("id")
    stay = durable(copies.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).select("id"), "stay")
    rest = durable(copies.join(stay, "id", "left_anti").select("id", "k"), "rest")
    found = durable(_nearest(vectors.join(rest, "id", "left_anti"), None, None, dim, k, probing), "found")
    own = big.select("k", F.col("first").alias("id"))
    entry = lambda s, i: F.struct((-s).alias("s"), i.alias("i"))
    near = found.join(own, "id").select("k", entry(F.col("similarity"), F.col("neighbour_id")).alias("e"))
    near = near.unionByName(found.join(own, "id").select("k", entry(F.lit(1.0), F.col("id")).alias("e")).distinct())
    near = near.groupBy("k").agg(F.slice(F.array_sort(F.collect_list("e")), 1, k).alias("l"))  # k + 1 entries each
    more = join_skewed(rest, near, "k").select("id", F.explode("l").alias("e"))
    return found.unionByName(more.select("id", F.col("e.i").alias("neighbour_id"), (-F.col("e.s")).alias("similarity")))


def _nearest(vectors: DataFrame, n: int | None, some: DataFrame | None, dim: int, k: int, probing: Probing) -> DataFrame:
    epsilon = np.inf if probing == EXACT else EPSILON
    probing = replace(probing, least=max(probing.least, k + SPARE + 1))
    index = lists.plan(vectors, None, lists.fit(vectors, dim, n, some), dim, probing)

    def run(batches):
        part = lists.read_part(batches, dim)
        if part is not None:
            q, c, s = part_neighbours(part, k, epsilon)
            for a in range(0, len(q), 50000):
                yield pa.RecordBatch.from_arrays([pa.array(z[a : a + 50000]) for z in (q, c, s)], names=["id", "neighbour_id", "similarity"])

    found = lists.route(vectors, index, True, True).mapInArrow(run, "id long, neighbour_id long, similarity double")
    first = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank")

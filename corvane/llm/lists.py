"""An inverted-list index over vectors: fitting, planning and routing. Shared by problems 2 and 5.

There are 2 sqrt(n) lists for n rows. They are fitted in the executors on SAMPLE_PER_LIST sample rows a list, level
by level: rows of a centroid with too many of them are fitted again by themselves, up to FAN centroids from at most
FAN * SAMPLE_PER_LIST rows at a time, so no task is larger for more rows. Only centroids come to the driver: at most
CENTROID_BYTES, which is reached at 7e10 rows of 128 numbers (35 TB); from there on lists grow with the rows. Every
row is indexed. Lists hold natural clusters: centroids closer than ``MERGE`` are merged, since in many dimensions
the rows of one dense cluster have no finer structure that a search could use.

Work is planned in units: a block of at most BLOCK candidates of one list against at most SPLIT of the
queries that probe it, so a list with a third of all rows becomes many units. Units are packed into
parts, similar lists together; a vector is sent once to each part that needs it. A part is one task and
holds at most BLOCK + SPLIT vectors, or PART of several small units. Where the vectors to be sent are many times
the rows, as a row probes more lists the more there are, parts are dealt with in several passes, none of which sends
over PASS times the rows; so what lies on disk at a time is in proportion to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.durable import durable, release

SAMPLE_PER_LIST, FAN, MERGE, ROUNDS = 32, 128, 0.85, 4
CENTROID_BYTES = 1 << 28
BLOCK, SPLIT, PART = 16384, 65536, 50000
#: Vectors sent in a pass: so many times the rows, but not under PASS_LEAST. Rows by which probes are counted.
PASS, PASS_LEAST, COUNTED = 2, 1 << 18, 100_000
#: Similarities of rows to centroids held at once by a task.
TILE = 4_000_000


def model_vectors(concepts: DataFrame, model: str, dim: int) -> DataFrame:
    """(id, embedding) of kept concepts embedded by ``model`` in ``dim`` numbers. Rows with a null, NaN or
    infinite number and all-zero ones pass here and are dropped by ``parse``."""
    return concepts.where((F.col("dropped") == 0) & (F.col("embedding_model") == model) & (F.size("embedding") == dim)).select("id", "embedding")


def parse(ids: pa.Array, vectors: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and finite, non-zero float32 rows of an Arrow batch; vectors are lists of numbers or their bytes."""
    if pa.types.is_binary(vectors.type):
        return ids.to_numpy(), _floats(vectors, dim)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    i = ids.to_numpy(zero_copy_only=False)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return i[ok], x[ok]


def unit64(x: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64)
    d /= np.abs(d).max(axis=1, keepdims=True, initial=1e-300)
    return d / np.sqrt((d * d).sum(axis=1, keepdims=True))


def unit(x: np.ndarray) -> np.ndarray:
    return unit64(x).astype(np.float32)


def mix64(i: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of integers (the SplitMix64 finaliser)."""
    z = i.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fit_centroids(x: np.ndarray, lists: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, their rows) of unit rows: distance-weighted seeding, a few spherical k-means rounds, then
    merging. At most ``lists``."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = 1 - x @ x[chosen[0]]
    for _ in range(min(lists, len(x)) - 1):
        p = np.maximum(far, 0)
        if p.sum() <= 1e-6:
            break
        chosen.append(int(rng.choice(len(x), p=p / p.sum())))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    c = x[chosen]
    weight = np.ones(len(c))
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        _, start = np.unique(own[order], return_index=True)
        total = np.add.reduceat(x[order], start, axis=0)
        norm = np.linalg.norm(total, axis=1)
        ok = norm > 1e-6
        c, weight = total[ok] / norm[ok, None], np.diff([*start, len(x)])[ok]
    return merged(c, weight)


def merged(c: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids with those closer than MERGE to a heavier one added to it, in the order of ``c``."""
    free, out = np.ones(len(c), dtype=bool), {}
    for i in np.argsort(-weight, kind="stable"):
        if free[i]:
            group = (c @ c[i] >= MERGE) & free
            group[i] = True
            free &= ~group
            v = (c[group] * weight[group, None]).sum(axis=0)
            out[i] = (v / np.linalg.norm(v), weight[group].sum())
    at = sorted(out)
    return np.asarray([out[i][0] for i in at], dtype=np.float32).reshape(len(at), c.shape[1]), np.asarray([out[i][1] for i in at], dtype=float)


@dataclass
class Probing:
    """Which lists a row probes besides its own: those whose centroid is within ``delta`` of the best or at
    least ``floor`` similar, at most ``most`` of them, nearest first (None: all of them). If these hold under
    ``least`` rows, further ones, nearest first, until they hold as many."""

    delta: float
    floor: float
    most: int | None
    least: int = 0

    def __call__(self, sim: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        mask = (sim >= sim.max(axis=1, keepdims=True) - self.delta) | (sim >= self.floor)
        if self.most is not None and self.most < sim.shape[1]:
            many = np.flatnonzero(mask.sum(axis=1) > self.most)
            if len(many):
                kth = -np.partition(-sim[many], self.most - 1, axis=1)[:, self.most - 1]
                mask[many] &= sim[many] >= kth[:, None]
        if n is not None and self.least:
            poor = np.flatnonzero(mask @ n < min(self.least, n.sum()))
            order = np.argsort(-sim[poor], axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            more = np.zeros((len(poor), sim.shape[1]), dtype=bool)
            np.put_along_axis(more, order, before < self.least, axis=1)
            mask[poor] |= more
        return mask

    def lists(self, k: int) -> int:
        return k

    def home(self, sim: np.ndarray) -> np.ndarray:
        return sim.argmax(axis=1)


@dataclass
class Covering:
    """Finds every row at least ``threshold`` similar, of rows that ``place`` has put into lists. A row within
    ``tight`` of its nearest centroid is in that one's list, any other in one more list of loose rows, after the
    others. A row similar to a member of a list is, by the triangle inequality of angles, within arccos threshold +
    arccos of the list's least similar member of its centroid, so a row probes all such lists; of two lists only the
    rows of the one of fewer rows probe the other, and those of the loose list all others, and so do the rows of one of
    two blocks of a list, so who counts has to count a query from another of the ``cells`` for its candidates, too. The
    loose list is probed by loose rows. With ``everyone``,
    which is for queries that aren't the candidates, all rows probe all lists in reach and the loose one."""

    threshold: float
    everyone: bool = False
    tight: float = 0.9
    #: by list, the loose one last: the similarity to its centroid from which it is probed, and its place by rows
    floors: np.ndarray | None = None
    rank: np.ndarray | None = None

    def lists(self, k: int) -> int:
        return k + 1

    def home(self, sim: np.ndarray) -> np.ndarray:
        return np.where(sim.max(axis=1) >= self.tight, sim.argmax(axis=1), sim.shape[1])

    def fitted(self, n: np.ndarray, least: np.ndarray) -> Covering:
        """For lists of ``n`` rows, the least similar of which are ``least`` similar to the centroid."""
        # more than single precision is off, there and here
        widest = np.arccos(self.threshold) + np.arccos(np.clip(least.astype(np.float64) - 1e-5, -1, 1))
        rank = np.empty(len(n), np.int64)
        rank[np.argsort(n, kind="stable")] = np.arange(len(n))
        rank[-1] = -1
        return replace(self, floors=np.cos(np.minimum(widest, np.pi)) - 1e-4, rank=rank)

    def probes(self, x: np.ndarray, home: np.ndarray, centroids: np.ndarray, lists: np.ndarray):
        """(rows, lists, which of the rows probe which of the lists), some rows at a time, of unit rows ``x`` with
        their own lists and of ``lists``, ascending."""
        near = lists[lists < len(centroids)]
        near = near[np.argsort(self.rank[near], kind="stable")]
        c, at = centroids[near], self.rank[near]
        own = np.where(self.everyone, -1, self.rank[home])
        order, a = np.argsort(own, kind="stable"), 0
        while a < len(x) and len(near):
            begin = int(np.searchsorted(at, own[order[a]]))  # lists of fewer rows aren't probed
            rows = order[a : a + max(1, min(2048, TILE // max(1, len(near) - begin)))]
            mask = x[rows] @ c[begin:].T >= self.floors[near[begin:]]
            mask &= own[rows][:, None] <= at[begin:]
            yield rows, near[begin:], mask
            a += len(rows)
        if len(lists) and lists[-1] == len(centroids):
            rows = np.arange(len(x)) if self.everyone else np.flatnonzero(home == len(centroids))
            yield rows, lists[-1:], np.ones((len(rows), 1), dtype=bool)


def place(vectors: DataFrame, centroids: Broadcast, dim: int, covering: Covering) -> tuple[Broadcast, DataFrame, list[DataFrame]]:
    """(centroids, rows, what to release in the end). Rows: (id, v, home, near) of the usable ``vectors``, each with its
    list for ``covering`` and its similarity to that one's centroid; durable, as a row's list must be the same in all
    that follows. If more than a block of them are loose, which are rows of groups too small for the sample, further
    centroids are fitted on these alone, eight times as many for their number."""
    first = _placed(vectors.select("id", "embedding"), centroids, dim, covering, 0)
    c = centroids.value
    loose = first.where(F.col("home") == len(c)).select("id", F.col("v").alias("embedding"))
    n = loose.count()
    if n <= BLOCK:
        return centroids, first, [first]
    more = fit(loose, dim, n, many=8).value
    both = vectors.sparkSession.sparkContext.broadcast(np.concatenate([c, more]))
    second = _placed(loose, vectors.sparkSession.sparkContext.broadcast(more), dim, covering, len(c))
    return both, first.where(F.col("home") < len(c)).unionByName(second), [first, second]


def _placed(vectors: DataFrame, centroids: Broadcast, dim: int, covering: Covering, begin: int) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, x = parse(b.column(0), b.column(1), dim)
            for a, sim in tiles(unit(x), centroids.value):
                here = slice(a, a + len(sim))
                yield pa.RecordBatch.from_arrays([pa.array(ids[here]), _binary(x[here]), pa.array((begin + covering.home(sim)).astype(np.int32)), pa.array(sim.max(axis=1).astype(np.float32))], names=["id", "v", "home", "near"])

    return durable(vectors.mapInArrow(run, "id long, v binary, home int, near float"), "placed")


def _binary(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _floats(v, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.to_pylist()), dtype=np.float32).reshape(-1, dim)


def tiles(x: np.ndarray, centroids: np.ndarray):
    """(first row, similarities to all centroids) of unit rows, some rows at a time."""
    step = max(1, TILE // len(centroids))
    for a in range(0, len(x), step):
        yield a, x[a : a + step] @ centroids.T


@dataclass
class Index:
    #: broadcast
    centroids: Broadcast
    dim: int
    probing: Probing | Covering
    #: by list: its rows, its blocks, its splits, and its first unit; by unit: its part
    rows: np.ndarray
    blocks: np.ndarray
    splits: np.ndarray
    first: np.ndarray
    part: np.ndarray
    parts: int
    #: stretches of parts, each dealt with in one go
    passes: list[tuple[int, int]]


def lists_for(n: int, dim: int, many: int = 1) -> int:
    return int(max(1, min(2 * many * n**0.5, CENTROID_BYTES // (4 * dim))))


def sample(vectors: DataFrame, dim: int, n: int, seed: int = 7, many: int = 1) -> DataFrame:
    """About SAMPLE_PER_LIST rows a list of the ``n`` rows of ``vectors``, chosen by a hash of id; a durable table."""
    mod = 1 << 40
    keep = int(mod * min(1.0, SAMPLE_PER_LIST * lists_for(n, dim, many) / max(n, 1)))
    return durable(vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(mod)) < keep).select("id", "embedding"), "sample")


def fit(vectors: DataFrame, dim: int, n: int | None = None, some: DataFrame | None = None, seed: int = 7, many: int = 1) -> Broadcast:
    """Broadcast centroids for the ``n`` rows of ``vectors`` (id, embedding), fitted on their ``sample`` or on ``some``,
    one made before, which is dropped; similar ones lie near each other. ``many`` times as many as usual. One centroid of no meaning if there are no
    rows."""
    spark = vectors.sparkSession
    n = vectors.count() if n is None else n
    lists, most = lists_for(n, dim, many), FAN * SAMPLE_PER_LIST
    some = sample(vectors, dim, n, seed, many) if some is None else some
    # by centroid: its vector, the sample rows it stands for, and whether these are to be fitted apart
    c, rows, open_ = np.eye(1, dim, dtype=np.float32), np.array([float(SAMPLE_PER_LIST * lists)]), np.array([True])
    while open_.any():
        at, share = spark.sparkContext.broadcast(c), most / np.maximum(rows, 1)

        def own(batches, at=at, share=share, open_=open_):
            for b in batches:
                ids, x = parse(b.column(0), b.column(1), dim)
                u = unit(x)
                for a, sim in tiles(u, at.value):
                    group = sim.argmax(axis=1)
                    here = u[a : a + len(sim)]
                    drawn = mix64(ids[a : a + len(sim)], 4).astype(np.float64) / 2**64 < share[group]
                    take = np.flatnonzero(open_[group] & drawn)
                    yield pa.RecordBatch.from_arrays([pa.array(group[take].astype(np.int32)), pa.array(ids[a : a + len(sim)][take]), pa.array([here[t].tobytes() for t in take], pa.binary())], names=["g", "id", "v"])

        def split(batches, rows=rows):
            got = [b for b in batches if b.num_rows]
            if got:
                t = pa.Table.from_batches(got)
                g, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
                x = np.frombuffer(b"".join(t.column(2).to_pylist()), np.float32).reshape(-1, dim)
                for k in np.unique(g):
                    r = np.flatnonzero(g == k)
                    r = r[np.argsort(ids[r], kind="stable")]
                    new, w = fit_centroids(x[r], max(1, min(FAN, round(rows[k] / SAMPLE_PER_LIST))), seed)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), k, np.int32)), pa.array(w / w.sum()), pa.array([z.tobytes() for z in new], pa.binary())], names=["g", "w", "v"])

        tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(open_.sum())))
        drawn = some.mapInArrow(own, "g int, id long, v binary").repartition(tasks, "g")
        t = drawn.mapInArrow(split, "g int, w double, v binary").toArrow()
        at.unpersist()
        g, w = t.column("g").to_numpy(), t.column("w").to_numpy()
        new = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(-1, dim)
        stay = np.flatnonzero(~open_)
        place = np.concatenate([stay, g])  # new ones take the place of the old, so that similar ones stay together
        order = np.argsort(place, kind="stable")
        # a fan was too small for its rows: what it gave is fitted again, unless it came out alone, as one dense cluster
        again = (rows[g] > most) & (rows[g] * w >= 2 * SAMPLE_PER_LIST) & (np.bincount(g, minlength=len(c))[g] > 1)
        c, rows, open_ = np.concatenate([c[stay], new])[order], np.concatenate([rows[stay], rows[g] * w])[order], np.concatenate([np.zeros(len(stay), bool), again])[order]
    release(some)
    c, _ = merged(c, rows) if len(c) else (np.eye(1, dim, dtype=np.float32), None)
    return spark.sparkContext.broadcast(c)


def _walk(centroids: np.ndarray, step: int = 2048) -> list[int]:
    """All lists, each followed by the most similar one left of its stretch, so that similar lists meet in a part."""
    order, at = [], centroids[0]
    for a in range(0, len(centroids), step):
        c = centroids[a : a + step]
        left = np.ones(len(c), dtype=bool)
        for _ in range(len(c)):
            k = int(np.where(left, c @ at, -2).argmax())
            left[k] = False
            order.append(a + k)
            at = c[k]
    return order


def plan(candidates: DataFrame, queries: DataFrame | None, centroids: Broadcast, dim: int, probing: Probing | Covering) -> Index:
    """Counts candidates and probes by list (one row a list comes back) and packs the units.
    ``queries`` None: the candidates are the queries. For a ``Covering`` both are rows that ``place`` has put into lists."""
    k = probing.lists(len(centroids.value))

    def counts(as_candidates: bool, as_queries: bool):
        def run(batches):
            n, q = np.zeros(k, np.int64), np.zeros(k, np.int64)
            for b in batches:
                _, x = parse(b.column(0), b.column(1), dim)
                for _, sim in tiles(unit(x), centroids.value):
                    n += as_candidates * np.bincount(probing.home(sim), minlength=k)
                    q += as_queries * probing(sim).sum(axis=0)
            some = np.flatnonzero(n + q)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(q[some])], names=["list", "n", "q"])

        return run

    schema = "list long, n long, q long"
    if isinstance(probing, Covering):
        by = candidates.groupBy("home").agg(F.count("*").alias("n"), F.min("near").alias("least")).toPandas().set_index("home").reindex(range(k))
        n = by.n.fillna(0).to_numpy(np.int64)
        probing, lists = probing.fitted(n, by.least.fillna(1).to_numpy()), np.flatnonzero(n)
        rows = int(n.sum()) if queries is None else queries.count()
        step = max(1, min(16, rows // COUNTED))  # the plan needs no exact numbers

        def probes(batches):
            q = np.zeros(k, np.int64)
            for b in batches:
                for _, which, mask in probing.probes(unit(_floats(b.column(0), dim)), b.column(1).to_numpy(), centroids.value, lists):
                    q[which] += mask.sum(axis=0)
            some = np.flatnonzero(q)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(some * 0), pa.array(q[some])], names=["list", "n", "q"])

        some = (candidates if queries is None else queries).where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("v", "home")
        got = some.mapInArrow(probes, schema).groupBy("list").agg(F.sum("q").alias("q")).toPandas().set_index("list").reindex(range(k)).fillna(0)
        q = got.q.to_numpy(np.int64) * step
    else:
        c = candidates.select("id", "embedding").mapInArrow(counts(True, queries is None), schema)
        if queries is not None:
            c = c.unionByName(queries.select("id", "embedding").mapInArrow(counts(False, True), schema))
        got = c.groupBy("list").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).toPandas().set_index("list").reindex(range(k)).fillna(0)
        n, q, rows = got.n.to_numpy(np.int64), got.q.to_numpy(np.int64).copy(), None
    q[n == 0] = 0  # no query goes where no candidate is
    blocks, splits = np.maximum(1, -(-n // BLOCK)), np.maximum(1, -(-q // SPLIT))
    first = np.concatenate([[0], np.cumsum(blocks * splits)[:-1]])
    goes = np.ones(k)  # the part of its list's blocks that a query goes to
    if isinstance(probing, Covering) and not probing.everyone:
        goes[-1] = (blocks[-1] + 1) / (2 * blocks[-1])
    held = n / blocks + goes * q / splits
    cost = (n / blocks) * (goes * q / splits) + 50 * held
    order = _walk(centroids.value)
    order.extend(range(len(order), k))
    conf = candidates.sparkSession.conf
    want = max(int(conf.get("spark.sql.shuffle.partitions")), int(held.dot(blocks * splits) // 20000))
    share = cost.dot(blocks * splits) / want
    part, p, cost_now, rows_now = np.zeros(int((blocks * splits).sum()), np.int64), 0, 0.0, 0.0
    most = None if rows is None else max(PASS * max(rows, int(n.sum())), PASS_LEAST)
    begin, sent, passes = 0, 0.0, []
    for lst in order:
        for u in range(first[lst], first[lst] + blocks[lst] * splits[lst]):
            if rows_now and (cost_now + cost[lst] > 1.2 * share or rows_now + held[lst] > PART):
                sent += rows_now
                p, cost_now, rows_now = p + 1, 0.0, 0.0
                if most and sent + held[lst] > most:
                    passes.append((begin, p))
                    begin, sent = p, 0.0
            part[u] = p
            cost_now, rows_now = cost_now + cost[lst], rows_now + held[lst]
    passes.append((begin, p + 1))
    return Index(centroids, dim, probing, n, blocks, splits, first, part, p + 1, passes)


def _expand(rows: np.ndarray, lists: np.ndarray, fixed: np.ndarray, index: Index, by_block: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, unit): a candidate has a fixed block and goes to all splits, a query the reverse."""
    times = index.splits[lists] if by_block else index.blocks[lists]
    r, at = np.repeat(rows, times), np.repeat(np.arange(len(rows)), times)
    k = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
    lst = lists[at]
    block, split = (fixed[at], k) if by_block else (k, fixed[at])
    return r, index.first[lst] + block * index.splits[lst] + split


def route(vectors: DataFrame, index: Index, candidates: bool, queries: bool) -> DataFrame:
    """What ``sent`` gives, partitioned by part."""
    return sent(vectors, index, candidates, queries).repartitionById(index.parts, F.col("part"))


def sent(vectors: DataFrame, index: Index, candidates: bool, queries: bool, within: tuple[int, int] | None = None) -> DataFrame:
    """(part, id, v, home, as_candidate, as_query): each vector once for each part, with the units in which
    it is a candidate and those in which it is a query. ``within``: of the parts of this stretch, numbered from 0."""
    schema = "part int, id long, v binary, home int, as_candidate array<int>, as_query array<int>"
    lo, hi = within or (0, index.parts)
    here = (index.part >= lo) & (index.part < hi)
    # lists with rows of which a unit lies in the stretch
    lists = np.flatnonzero((np.add.reduceat(here, index.first) > 0) & (index.rows > 0))

    def run(batches):
        for b in batches:
            ids, x = parse(b.column(0), b.column(1), index.dim)
            for a, sim in tiles(unit(x), index.centroids.value):
                r, lst = np.nonzero(index.probing(sim, index.rows) & (index.rows > 0)) if queries else (None, None)
                yield from send(ids[a : a + len(sim)], x[a : a + len(sim)], index.probing.home(sim), r, lst)

    def run_placed(batches):
        for b in batches:
            ids, x, home = b.column(0).to_numpy(), _floats(b.column(1), index.dim), b.column(2).to_numpy()
            if not queries:
                yield from send(ids, x, home, None, None)
                continue
            r, lst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, which, mask in index.probing.probes(unit(x), home, index.centroids.value, lists):
                i, j = np.nonzero(mask)
                r, lst = [*r, rows[i]], [*lst, which[j]]
            yield from send(ids, x, home, np.concatenate(r), np.concatenate(lst))

    def send(ids, x, home, r, lst):
        h = mix64(ids, 1) >> np.uint64(1)
        row, unt, role = [], [], []
        if queries:
            r, u = _expand(r, lst, (h[r] % index.splits[lst].astype(np.uint64)).astype(np.int64), index, False)
            if isinstance(index.probing, Covering) and not index.probing.everyone:
                # of two blocks of its own list the rows of one go to the other
                lst = np.searchsorted(index.first, u, "right") - 1
                m, block, own = index.blocks[lst], (u - index.first[lst]) // index.splits[lst], (h[r] % index.blocks[home[r]].astype(np.uint64)).astype(np.int64)
                ahead = 2 * ((block - own) % m)
                keep = (lst != home[r]) | (ahead < m) | ((ahead == m) & (own < block))
                r, u = r[keep], u[keep]
            row, unt, role = [r], [u], [np.ones(len(r), np.int8)]
        if candidates:
            r, u = _expand(np.arange(len(ids)), home, (h % index.blocks[home].astype(np.uint64)).astype(np.int64), index, True)
            row, unt, role = [*row, r], [*unt, u], [*role, np.zeros(len(r), np.int8)]
        row, unt, role = map(np.concatenate, (row, unt, role))
        if within:
            keep = here[unt]
            row, unt, role = row[keep], unt[keep], role[keep]
        if not len(row):
            return
        part = index.part[unt]
        order = np.lexsort((unt, role, part, row))
        row, unt, role, part = row[order], unt[order].astype(np.int32), role[order], part[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        both = []
        for k in (0, 1):
            at = role == k
            offsets = np.concatenate([[0], np.cumsum(np.bincount(group[at], minlength=len(start)))]).astype(np.int32)
            both.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(unt[at])))
        for k in range(0, len(start), 8192):
            s = start[k : k + 8192]
            yield pa.RecordBatch.from_arrays([pa.array((part[s] - lo).astype(np.int32)), pa.array(ids[row[s]]), _binary(x[row[s]]), pa.array(home[row[s]].astype(np.int32)), *[z.slice(k, len(s)) for z in both]], names=["part", "id", "v", "home", "as_candidate", "as_query"])

    if isinstance(index.probing, Covering):
        return vectors.select("id", "v", "home").mapInArrow(run_placed, schema)
    return vectors.select("id", "embedding").mapInArrow(run, schema)


def cells(ids: np.ndarray, home: np.ndarray, index: Index) -> np.ndarray:
    """The block of its list that each row is a candidate in, by a number that no other block has."""
    own = ((mix64(ids, 1) >> np.uint64(1)) % index.blocks[home].astype(np.uint64)).astype(np.int64)
    return (np.cumsum(index.blocks) - index.blocks)[home] + own


@dataclass
class Part:
    """What one task holds."""

    ids: np.ndarray
    x: np.ndarray
    #: the list that each row is in
    home: np.ndarray
    #: by unit: rows that are its candidates, rows that are its queries
    units: list[tuple[np.ndarray, np.ndarray]]


def read_part(batches, dim: int) -> Part | None:
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    ids = t.column("id").to_numpy()
    x = _floats(t.column("v"), dim)
    both = []
    for name in ("as_candidate", "as_query"):
        a = t.column(name).combine_chunks()
        row = np.repeat(np.arange(len(ids)), a.value_lengths().to_numpy(zero_copy_only=False))
        unt = a.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids[row], unt))
        both.append((row[order], unt[order]))
    units = []
    (cr, cu), (qr, qu) = both
    for u in np.intersect1d(cu, qu):
        units.append((cr[np.searchsorted(cu, u) : np.searchsorted(cu, u, "right")], qr[np.searchsorted(qu, u) : np.searchsorted(qu, u, "right")]))
    return Part(ids, x, t.column("home").to_numpy(), units)

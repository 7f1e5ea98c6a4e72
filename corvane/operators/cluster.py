"""Spherical k-means, cluster tables and distinctive terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import mix64, parse, unit

#: Words that never count as terms.
STOPWORDS = """
the a an of in on at to for and or but is are was were be been being as by with that this it its from into than then
so if not no do does did have has had can will would could should may might we you i they he she his her their our
your my one two three four five six seven eight nine ten more less most least such very much also other another some
any all each every many few thing things way ways kind type form concept term idea person people make makes made use
used using call called calls see seen say said says find found give given gives set sets get gets got
""".split()
#: Fixed value: what a term looks like; it must have more than two characters.
TERM = r"[a-zA-Z][a-zA-Z'-]+"
#: Draws of candidates for the first centres, each of as many rows as there are centres.
DRAWS = 4


def _rows(t: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, dim)


def _draw(vectors: DataFrame, dim: int, have: np.ndarray, m: int, seed: int) -> np.ndarray:
    """m unit rows drawn without replacement, their distance to the nearest of ``have`` being their weight (all
    alike if there are none): those with the least -ln(u) / weight, u a hash of the id. Each task keeps its m least,
    then the least of all are taken, so one pass draws from every row."""
    known = vectors.sparkSession.sparkContext.broadcast(have)

    def run(batches):
        key, ids, rows = np.zeros(0), np.zeros(0, np.int64), np.zeros((0, dim))
        for b in batches:
            i, x = parse(b.column(0), b.column(1), dim)
            u = unit(x)
            weight = 1 - (u @ known.value.T).max(axis=1) if len(known.value) else np.ones(len(u))
            luck = (mix64(i, seed).astype(np.float64) + 1) / 2.0**64
            key = np.concatenate([key, np.where(weight > 1e-9, -np.log(luck) / np.maximum(weight, 1e-9), np.inf)])
            ids, rows = np.concatenate([ids, i]), np.concatenate([rows, u])
            best = np.lexsort((ids, key))[:m]
            key, ids, rows = key[best], ids[best], rows[best]
        far = np.isfinite(key)
        yield pa.RecordBatch.from_arrays([pa.array(key[far]), pa.array(ids[far]), pa.array([r.tobytes() for r in rows[far]], pa.binary())], names=["key", "id", "v"])

    got = vectors.select("id", "embedding").mapInArrow(run, "key double, id long, v binary")
    return _rows(got.orderBy("key", "id").limit(m).toArrow(), dim)


def first_centers(vectors: DataFrame, dim: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(k centres, all candidates): DRAWS x k candidates are drawn in the executors; of these, weighed by the rows they
    are nearest to, one after the other with the most weight times distance to the taken ones is taken. Once all
    candidates coincide with taken ones, the heaviest is repeated."""
    have = np.zeros((0, dim))
    for d in range(DRAWS):
        have = np.concatenate([have, _draw(vectors, dim, have, k, seed + d)])
    if not len(have):
        return have, have
    weight = np.zeros(len(have))
    for r in assign(vectors, have, dim).groupBy("cluster").count().collect():  # one row a candidate
        weight[r.cluster] = r["count"]
    far, taken = np.full(len(have), 2.0), []
    while len(taken) < k:
        taken.append(int(np.argmax((weight + 1e-3) * np.where(far > 1e-9, far, 0))))
        far = np.minimum(far, 1 - have @ have[taken[-1]])
    return have[taken], have


def kmeans(vectors: DataFrame, dim: int, k: int | None = None, iters: int = 30, seed: int = 7, centers: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, score), centres): spherical k-means over the valid rows. k defaults to max(8, round(sqrt(N / 2))).

    Starts from ``centers``, if given, else from drawn ones. Every row is assigned in each round; rows are summed by
    centre in each task, these sums in a shuffle of k rows a task, and k x dim numbers come back, which
    grows with the square root of the rows. Rounds end when no row changes its cluster. An empty cluster starts
    again from a candidate. With no valid row there are no clusters.
    """
    spark = vectors.sparkSession
    if k is None and centers is None:
        k = max(8, round((valid_rows(vectors, dim) / 2) ** 0.5))
    c, spare = (unit(np.asarray(centers, float)),) * 2 if centers is not None else first_centers(vectors, dim, k, seed)
    k = len(c)
    if not k:
        return spark.createDataFrame([], "id long, cluster int, score double"), np.zeros((0, dim))
    last = None
    for turn in range(iters):
        at = spark.sparkContext.broadcast(c)

        def sums(batches, at=at):
            total, size, check = np.zeros((k, dim)), np.zeros(k, np.int64), np.uint64(0)
            for b in batches:
                i, x = parse(b.column(0), b.column(1), dim)
                u = unit(x)
                label = (u @ at.value.T).argmax(axis=1) if len(u) else np.zeros(0, np.int64)
                order = np.argsort(label, kind="stable")
                own, start = np.unique(label[order], return_index=True)
                if len(own):
                    total[own] += np.add.reduceat(u[order], start, axis=0)
                size += np.bincount(label, minlength=k)
                check ^= np.bitwise_xor.reduce(mix64(mix64(i) + label.astype(np.uint64), 1), initial=np.uint64(0))
            yield _sums(np.flatnonzero(size), total, size, check)

        def add(batches):
            total, size, check = {}, {}, np.uint64(0)
            for b in batches:
                for c_, n, x, v in zip(*(b.column(j).to_pylist() for j in range(4))):
                    size[c_] = size.get(c_, 0) + n
                    total[c_] = total.get(c_, 0) + np.frombuffer(v)
                    check ^= np.uint64(x & (2**64 - 1))
            got = sorted(size)
            if got:
                yield _sums(np.asarray(got), np.stack([total[j] for j in got]), np.asarray([size[j] for j in got]), check, whole=False)

        def _sums(own, total, size, check, whole=True):
            rows = (total[own], size[own]) if whole else (total, size)
            marks = np.zeros(len(own), np.uint64)
            marks[:1] = check
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(rows[1].astype(np.int64)), pa.array(marks.view(np.int64)), pa.array([t.tobytes() for t in rows[0]], pa.binary())], names=["c", "n", "x", "v"])

        schema = "c int, n long, x long, v binary"
        t = vectors.select("id", "embedding").mapInArrow(sums, schema).repartition("c").mapInArrow(add, schema).toArrow()
        at.unpersist()
        check = int(np.bitwise_xor.reduce(t.column("x").to_numpy(), initial=0))
        if check == last:
            break
        last, new = check, spare[(np.arange(k) * 7919 + turn) % len(spare)]
        new[t.column("c").to_numpy()] = _rows(t, dim)
        c = unit(new)
    return assign(vectors, c, dim), c


def valid_rows(vectors: DataFrame, dim: int) -> int:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(parse(b.column(0), b.column(1), dim)[0])], pa.int64())], names=["n"])

    return vectors.select("id", "embedding").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def given_centers(clusters: DataFrame, vectors: DataFrame, dim: int) -> tuple[list[int], np.ndarray]:
    """(cluster ids, unit means of their representatives' unit vectors) of a table of clusters, without those of
    which no representative has a vector: a few rows a cluster come to the driver."""
    t = given_members(clusters).select("cluster", "id").join(vectors.select("id", "embedding"), "id").toArrow()
    if not t.num_rows:
        return [], np.zeros((0, dim))
    ids, x = parse(t.column("id"), t.column("embedding"), dim)
    u = dict(zip(ids.tolist(), unit(x)))
    sums: dict[int, np.ndarray] = {}
    for c, i in zip(t.column("cluster").to_pylist(), t.column("id").to_pylist()):
        if i in u:
            sums[c] = sums.get(c, 0) + u[i]
    return sorted(sums), unit(np.stack([sums[c] for c in sorted(sums)])) if sums else np.zeros((0, dim))


def assign(vectors: DataFrame, centers: np.ndarray, dim: int) -> DataFrame:
    """(id, cluster, score): the most similar centre of each row, ties to the first."""

    centers = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        for b in batches:
            ids, x = parse(b.column(0), b.column(1), dim)
            s = unit(x) @ centers.value.T
            label = s.argmax(axis=1) if len(ids) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label.astype(np.int32)), pa.array(np.round(s[np.arange(len(ids)), label], 6))], names=["id", "cluster", "score"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, cluster int, score double")


def terms(texts: DataFrame) -> DataFrame:
    """``texts`` (cluster, id, text) -> (cluster, term, n): occurrences of terms, stop words left out."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
    return texts.select("cluster", F.explode(words).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("n"))


def top_terms(texts: DataFrame, top: int = 6) -> DataFrame:
    """(cluster, term, score, rank): the terms that occur at least twice in a cluster with the highest
    r * ln(1 + r / g), r and g being occurrences per text in the cluster and in all. Ties by term. Counts
    are made once by (cluster, term) on the map side; what follows is no larger than the vocabulary."""
    n = terms(texts)
    size = texts.groupBy("cluster").agg(F.count("*").alias("members"))
    all_ = texts.agg(F.count("*").alias("total"))
    g = n.groupBy("term").agg(F.sum("n").alias("g"))
    s = n.where("n >= 2").join(g, "term").join(size, "cluster").join(F.broadcast(all_))  # one row
    r = F.col("n") / F.col("members")
    s = s.select("cluster", "term", F.round(r * F.ln(1 + r / (F.col("g") / F.col("total"))), 6).alias("score"))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "term")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def cluster_table(assigned: DataFrame, typical: int = 6) -> DataFrame:
    """``assigned`` (id, cluster, score) -> (cluster, size, representatives): the ``typical`` rows closest to
    their centre, ties by id. Empty clusters don't occur."""
    size = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "id")
    reps = assigned.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda e: e["id"]).alias("representatives"))
    return size.join(reps, "cluster")


def size_stats(clusters: DataFrame) -> DataFrame:
    """(clusters, least, most, mean) of the sizes in a table of clusters."""
    return clusters.where("size is not null").agg(F.count("*").alias("clusters"), F.min("size").alias("least"), F.max("size").alias("most"), F.avg("size").alias("mean"))


def given_members(clusters: DataFrame) -> DataFrame:
    """(cluster, id, place) of the representatives listed by a table of clusters, each once, in order."""
    reps = clusters.select(F.col("id").alias("cluster"), F.posexplode("representatives").alias("place", "rep")).where("rep is not null")
    return reps.groupBy("cluster", F.col("rep").alias("id")).agg(F.min("place").alias("place"))

"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.durable import durable, release

#: A node with more than 1/HEAVY of the edge ends is heavy; there are at most HEAVY of those.
HEAVY = 64


def _with_min(ends: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Every (u, v) with u's least neighbour or u itself as m, and (u, m). Heavy nodes, at most HEAVY by the
    pigeonhole principle, are joined by broadcast, so that a hub is spread over all tasks. The minima are one
    aggregation with the same columns at each use, so its shuffle is made once."""
    mins = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    many = max(count // HEAVY, 1000)
    heavy = F.broadcast(mins.where(F.col("n") > many).select(F.col("u").alias("hu"), F.col("m").alias("hm"), F.col("n").alias("hn")))
    marked = ends.join(heavy, F.col("u") == F.col("hu"), "left")
    light = marked.where("hu is null").select("u", "v").join(mins, "u").where(F.col("n") <= many).select("u", "v", "m")
    return marked.where("hn > 0").select("u", "v", F.col("hm").alias("m")).unionByName(light), mins.where("n > 0").select("u", "m")


def _progress(edges: DataFrame) -> tuple[int, int]:
    """(edges, nodes that point to two others or are pointed to while pointing on). Without the latter every
    component is one star around its least node."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    each = ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return each.agg(F.coalesce(F.sum("out"), F.lit(0)), F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))).first()


def _finish(edges: DataFrame) -> DataFrame:
    """(node, component) of a few edges, in one task."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, z = sorted((root(u), root(v)))
                parent[z] = a
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 60, finish: int = 0) -> DataFrame:
    """``edges``: its first two columns are the ends (bigint). Returns (node, component), component
    being the smallest node reached; one row per node that has an edge to another one.

    Nulls and self-loops link nothing; repeated edges count once; direction is ignored; an empty
    input gives no rows. Ids are read as bigint. Needs O(log n) rounds, each cut by a durable table. Raises if it hasn't
    converged after ``max_rounds``. Once no more than ``finish`` edges (16 bytes each) are left, one task ends the
    work by union-find; by default the rounds go on to the end.
    """
    a, b = edges.columns[:2]
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    e = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur = durable(e, "cc")
    for _ in range(max_rounds):
        n, open_ = _progress(cur)
        if not open_:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        if n <= finish:
            return _finish(cur)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _with_min(both, 2 * n)
        step = durable(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small star: every edge already points from the larger to the smaller end
        small, m2 = _with_min(step, n)
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m2.select("u", F.col("m").alias("v")))
        nxt = durable(nxt.where("u <> v").distinct(), "cc")
        release(cur, step)
        cur = nxt
    raise RuntimeError(f"no convergence after {max_rounds} rounds")

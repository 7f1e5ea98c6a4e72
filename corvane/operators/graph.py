"""Queries over the typed, weighted edges (src, dst, kind, weight), read as undirected where said."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.durable import durable

#: The kinds of edge.
KINDS = ("semantic_near", "semantic_dedup", "prerequisite_of", "specializes", "contrasts_with", "example_of", "same_phenomenon_different_frame")
LEAST_COST = 0.001


def neighbors(edges: DataFrame, node: int, kind: str = "semantic_near", k: int = 10) -> DataFrame:
    """(dst, weight) of a node's outgoing edges of a kind, heaviest first, ties by id. An unknown kind reads
    as ``semantic_near``."""
    kind = kind if kind in KINDS else "semantic_near"
    return edges.where((F.col("src") == node) & (F.col("kind") == kind)).select("dst", "weight").orderBy(F.desc("weight"), "dst").limit(k)


def adjacency(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(a, b, weight, kinds): both directions of every edge, the largest weight and the sorted kinds."""
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    e = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight", "kind").where("a <> b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "kind"))
    return both.groupBy("a", "b").agg(F.max("weight").alias("weight"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def shortest_path(edges: DataFrame, start: int, goal: int, max_hops: int = 6, kinds: list[str] | None = None) -> DataFrame:
    """(step, node, weight, kinds, cost): the cheapest path of at most ``max_hops`` edges, an edge costing
    max(0.001, 1 - weight); ties go to the path of smaller ids. No rows if there is none. start = goal is
    a path of one node, in the graph or not.

    Each layer relaxes the frontier over the adjacency and keeps one path per node, unless an earlier
    layer reached the node as cheaply, so a layer has at most one row a node and the work is linear in the
    edges for each hop. Once the goal is reached, only paths that are cheaper so far go on. Layers are durable tables,
    so none is computed twice.
    """
    spark = edges.sparkSession
    full = durable(adjacency(edges, kinds), "adjacency")
    adj = full.withColumn("step", F.greatest(F.lit(LEAST_COST), 1 - F.col("weight"))).select("a", "b", "step")
    layer = spark.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0.0).alias("cost"), F.array(F.lit(start).cast("long")).alias("path"))
    done = layer
    reached = None
    for _ in range(max_hops if start != goal else 0):
        going = layer if reached is None else layer.where((F.col("cost") < reached) & (F.col("node") != goal))
        new = going.join(adj, F.col("node") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("node"), F.struct((F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("b")).alias("path")).alias("m"))
        if reached is not None:
            new = new.where(F.col("m.cost") <= reached)
        # the new paths and what is known meet in one aggregation
        both = new.withColumn("known", F.lit(None).cast("double")).unionByName(done.select("node", F.lit(None).cast("struct<cost:double,path:array<bigint>>").alias("m"), F.col("cost").alias("known")))
        best = both.groupBy("node").agg(F.min("m").alias("m"), F.min("known").alias("known"))
        layer = durable(best.where("m is not null and (known is null or m.cost < known)").select("node", "m.*"), "layer")
        n, at_goal = layer.agg(F.count("*"), F.min(F.when(F.col("node") == goal, F.col("cost")))).first()
        if not n:
            break
        reached = at_goal if reached is None or (at_goal is not None and at_goal < reached) else reached
        done = done.unionByName(layer)
    best = done.where(F.col("node") == goal).orderBy("cost", "path").limit(1)
    steps = best.select(F.posexplode("path").alias("step", "node"), "path", "cost")
    steps = steps.select("step", "node", F.when(F.col("step") > 0, F.try_element_at("path", F.col("step"))).alias("before"), F.round("cost", 6).alias("cost"))
    return steps.join(full, (F.col("before") == F.col("a")) & (F.col("node") == F.col("b")), "left").select("step", "node", F.col("weight"), F.array_join("kinds", ",").alias("kinds"), "cost")


def direct_edges(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(src, dst, kind, weight) between two nodes, either way."""
    return edges.where(((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))).select("src", "dst", "kind", "weight")


def shared_neighbors(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(dst, kinds): nodes that both point at, with the union of the kinds, each once."""
    out = edges.where(F.col("src").isin(a, b)).groupBy("dst").agg(F.countDistinct("src").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return out.where("n = 2").select("dst", F.array_join("kinds", ",").alias("kinds"))


def explain(concepts: DataFrame, edges: DataFrame, a: int, b: int, cosine: float | None) -> DataFrame:
    """One row on how two concepts relate: cosine (null without both vectors), edges either way, shared
    domains and affects in a's order, same form and source, shared outgoing neighbours."""
    x = concepts.where(F.col("id") == a).alias("x")
    y = concepts.where(F.col("id") == b).alias("y")
    direct = direct_edges(edges, a, b).agg(F.count_if(F.col("src") == a).alias("edges_ab"), F.count_if(F.col("src") == b).alias("edges_ba"))
    shared = shared_neighbors(edges, a, b).agg(F.count("*").alias("shared_neighbors"))
    return x.join(y).join(direct).join(shared).select(  # one row each
        F.lit(cosine).cast("double").alias("cosine"), "edges_ab", "edges_ba",
        F.array_join(F.array_intersect("x.domain", "y.domain"), ",").alias("shared_domain"),
        F.array_join(F.array_intersect("x.affect", "y.affect"), ",").alias("shared_affect"),
        (F.col("x.form") == F.col("y.form")).alias("same_form"), (F.col("x.source") == F.col("y.source")).alias("same_source"), "shared_neighbors")


def ego_graph(edges: DataFrame, ids: DataFrame, center: int, kind: str = "semantic_near", default: float = 0.4) -> DataFrame:
    """(a, b, weight), a < b: links among a node and its neighbours by ``kind``, in or out. A link of the
    center has the outgoing weight, or the incoming one where there is no other; links between neighbours
    that of the smaller source's edge first. A null weight reads as ``default``. Neighbours outside
    ``ids`` are left out."""
    e = edges.where(F.col("kind") == kind).select("src", "dst", F.coalesce("weight", F.lit(default)).alias("weight")).where("src <> dst")
    own = e.where((F.col("src") == center) | (F.col("dst") == center))
    near = own.select(F.when(F.col("src") == center, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct().join(ids, "id", "left_semi")
    members = near.unionByName(near.sparkSession.range(1).select(F.lit(center).cast("long").alias("id")))
    inner = e.join(members.withColumnRenamed("id", "src"), "src", "left_semi").join(members.withColumnRenamed("id", "dst"), "dst", "left_semi")
    link = inner.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") != center).cast("int").alias("later"), "src", "weight")
    return link.groupBy("a", "b").agg(F.min(F.struct("later", "src", "weight"))["weight"].alias("weight"))


def concept_page(edges: DataFrame, node: int, cap: int = 6) -> DataFrame:
    """(role, kind, other, weight, rank): what points to the node as its prerequisite, and its outgoing edges
    by kind but for near-duplicates, at most ``cap`` each, heaviest first."""
    pre = edges.where((F.col("dst") == node) & (F.col("kind") == "prerequisite_of")).select(F.lit("prerequisite").alias("role"), "kind", F.col("src").alias("other"), "weight")
    out = edges.where((F.col("src") == node) & (F.col("kind") != "semantic_dedup")).select(F.lit("related").alias("role"), "kind", F.col("dst").alias("other"), "weight")
    w = Window.partitionBy("role", "kind").orderBy(F.desc("weight"), "other")
    return pre.unionByName(out).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)

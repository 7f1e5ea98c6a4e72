import random

from corvane.operators.components import connected_components
from corvane.operators.skew import join_skewed


def expected(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in parent}


def run(spark, edges):
    """All in rounds, and with the last edges in one task."""
    out = []
    for finish in (0, 50):
        rows = connected_components(spark.createDataFrame(edges, "a long, b long"), finish=finish).collect()
        assert len(rows) == len({r.node for r in rows})
        out.append({r.node: r.component for r in rows})
    assert out[0] == out[1]
    return out[0]


def test_chain_star_nulls_loops_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 7), (7, None), (0, 1), (1, 0), (-9, 3000)]
    assert run(spark, edges) == expected(edges)


def test_random_graph(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    assert run(spark, edges) == expected(edges)


def test_empty(spark):
    assert run(spark, []) == {}


def test_hot_key_is_joined_whole(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(2, 0), (None, 1), (3, 5)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, w string")
    assert join_skewed(left, right, "k").count() == 3001
    assert join_skewed(left, right, "k", "left_anti").count() == 2
    assert join_skewed(left, right, "k", "left").where("w is null").count() == 2

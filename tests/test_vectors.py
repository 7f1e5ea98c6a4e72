import math

import numpy as np
import pytest

from corvane.operators import vectors as V
from corvane.operators.cluster import assign, given_centers, kmeans, valid_rows
from corvane.operators.facets import Filters
from corvane.plans import views

TINY = [(1, [1.0, 0.0], "philosophy", "concept"), (2, [0.95, 0.31], "philosophy", "concept"), (3, [0.0, 1.0], "biology", "phenomenon"), (4, [0.31, 0.95], "biology", "concept"), (5, [-1.0, 0.0], "sociology", "principle")]


@pytest.fixture(scope="module")
def vec(spark):
    bad = [(6, None), (7, [1.0]), (8, [float("nan"), 1.0]), (9, [0.0, 0.0]), (10, [math.inf, 0.0])]
    return spark.createDataFrame([(i, v) for i, v, _, _ in TINY] + bad, "id long, embedding array<float>").cache()


@pytest.fixture(scope="module")
def kept(concepts):
    return views.kept(concepts([{"id": i, "slug": str(i), "title": str(i), "domain": [d], "form": f} for i, _, d, f in TINY]))


def ids(df):
    return [r[0] for r in df.collect()]


E1 = np.array([1.0, 0.0])


def test_top_k_skips_malformed_vectors(vec):
    assert ids(V.top_k(vec, E1, 2, 9)) == [1, 2, 4, 3, 5]


@pytest.mark.parametrize("block", [4096, 20])
def test_nearest_matches_brute_force(spark, monkeypatch, block):
    """Queries broadcast, and in blocks by a shuffle."""
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "ROWS", 30)
    r = np.random.default_rng(1)
    x = r.standard_normal((90, 6)).astype(np.float32)
    x[40:44] = x[3]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(5)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(90) for j in np.lexsort((np.arange(90), -s[i]))[:5]}
    assert {(a.src, a.dst) for a in V.nearest(df, df, 6, 5).collect()} == want


def test_nearest_with_fewer_rows_than_k(vec):
    assert V.nearest(vec, vec, 2, 8).count() == 20
    assert V.nearest(vec.limit(0), vec, 2, 8).count() == 0
    assert V.nearest(vec, vec.limit(0), 2, 8).count() == 0


def test_edges_and_duplicates(vec):
    e = V.knn_edges(vec, vec, 2).collect()
    assert all(r.weight > 0 and r.src != r.dst for r in e)
    assert [(r.src, r.dst, r.note) for r in V.dedup_pairs(vec, vec, 2, 0.9).orderBy("src").collect()] == [(1, 2, "cosine=0.951"), (3, 4, "cosine=0.951")]


def test_mmr(vec):
    assert [r.id for r in V.mmr(vec, E1, 2, 3, 1.0).collect()] == [1, 2, 4]
    two = [r.id for r in V.mmr(vec, E1, 2, 2, 0.0).collect()]
    assert two[0] == 1 and two[1] != 2
    assert V.mmr(vec.limit(0), E1, 2, 3).count() == 0


def test_bridge_is_symmetric_and_leaves_seeds_out(vec):
    a, b = V.bridge(vec, 1, 3, 2, 5), V.bridge(vec, 3, 1, 2, 5)
    assert ids(a) == ids(b) and not {1, 3} & set(ids(a)) and ids(a)[0] != 5
    assert V.bridge(vec, 1, 99, 2, 5).count() == 0


def test_triangulate(vec):
    assert ids(V.triangulate(vec, [1, 3], 2, 5))[-1] == 5
    assert V.triangulate(vec, [77], 2, 5).count() == 0
    assert V.triangulate(vec, [], 2, 5).count() == 0


def test_analogy(vec, kept):
    assert ids(V.analogy(kept, vec, 1, 2, 5, domain="biology")) == [4, 3]
    assert ids(V.analogy(kept, vec, 1, 2, 5, form="phenomenon")) == [3]
    assert V.analogy(kept, vec, 99, 2, 5, form="concept").count() == 0
    with pytest.raises(ValueError):
        V.analogy(kept, vec, 1, 2, 5)


def test_semantic_filters_after_the_top_k(vec, kept):
    assert [r.id for r in V.semantic(kept, vec, E1, 2, 5, Filters(domain="biology")).collect()] == [4, 3]
    assert [r.id for r in V.semantic(kept, vec, E1, 2, 2).collect()] == [1, 2]


def test_phrases(spark, vec):
    p = spark.createDataFrame([(100, 1, "own", [1.0, 0.0]), (101, 5, "far", [0.7, 0.72]), (102, 3, "b", [1.0, 0.1]), (103, 3, "a", [1.0, 0.0])], "id long, owner long, phrase string, embedding array<float>")
    got = {(r.src, r.dst): r.phrase for r in V.resolve_phrases(p, vec, 2, 0.85).collect()}
    assert got == {(2, 1): "own", (4, 5): "far", (1, 3): "a"}
    assert (4, 5) not in {(r.src, r.dst) for r in V.resolve_phrases(p, vec, 2, 0.9).collect()}


def test_kmeans_recovers_blobs(spark):
    r = np.random.default_rng(0)
    x = np.repeat(np.eye(3), 20, axis=0) + r.normal(0, 0.05, (60, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(3)
    got, c = kmeans(df, 3, k=3)
    label = {r.id: r.cluster for r in got.collect()}
    assert len({label[i] for i in range(20)}) == len({label[i] for i in range(20, 40)}) == 1 and len(set(label.values())) == 3
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
    assert {r.id: r.cluster for r in kmeans(df, 3, k=3)[0].collect()} == label


def test_kmeans_survives_more_clusters_than_rows_and_no_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "id long, embedding array<float>")
    got, c = kmeans(df, 2, k=8)
    assert got.count() == 5 and c.shape == (8, 2)
    assert kmeans(df.limit(0), 2)[0].count() == 0
    assert assign(df, np.eye(2), 2).where("cluster = 0").count() == 5


def test_kmeans_from_given_centres_and_without_malformed_rows(spark):
    x = [[1.0, 0.1], [1.0, -0.1], [0.1, 1.0], [-0.2, 1.0], [float("nan"), 1.0], [0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(x)) + [(9, None), (10, [1.0])], "id long, embedding array<float>")
    assert valid_rows(df, 2) == 4
    got, c = kmeans(df, 2, centers=np.array([[2.0, 1.0], [1.0, 2.0]]))
    assert {r.id: r.cluster for r in got.collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    assert np.allclose(c[0], [1, 0]) and c.shape == (2, 2)
    same, _ = kmeans(df, 2, centers=np.array([[2.0, 1.0], [1.0, 2.0]]), iters=0)
    assert same.count() == 4
    table = spark.createDataFrame([(7, [0, 1, None, 99]), (3, []), (5, [2])], "id long, representatives array<long>")
    ids, means = given_centers(table, df, 2)
    assert ids == [5, 7] and np.allclose(means[1], [1, 0])
    assert given_centers(table.limit(0), df, 2)[0] == []


@pytest.mark.parametrize("block", [4096, 5])
def test_all_pairs_beyond_the_top_k(spark, monkeypatch, block):
    """12 near-copies: a row has more of them than k."""
    monkeypatch.setattr(V, "BLOCK", block)
    x = np.eye(8)[0] + 0.02 * np.random.default_rng(2).normal(size=(12, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, np.eye(8)[1].tolist())]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    pairs = lambda q: {(r.src, r.dst) for r in V.dedup_pairs(q, df, 8, mode="all_pairs").collect()}
    assert pairs(df) == {(a, b) for a in range(12) for b in range(a + 1, 12)}
    assert pairs(df.where("id = 5")) == {(min(a, 5), max(a, 5)) for a in range(12) if a != 5}

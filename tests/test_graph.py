import pytest

from corvane.operators import graph
from corvane.plans import views

N, P = "semantic_near", "prerequisite_of"


@pytest.fixture(scope="module")
def path(spark):
    return spark.createDataFrame([(1, 2, N, 0.9), (2, 3, N, 0.8), (3, 4, N, 0.7), (3, 5, P, 0.6)], "src long, dst long, kind string, weight double").cache()


def nodes(df):
    return [r.node for r in df.orderBy("step").collect()]


def test_shortest_path(path):
    assert nodes(graph.shortest_path(path, 1, 4)) == [1, 2, 3, 4]
    assert nodes(graph.shortest_path(path, 4, 1)) == [4, 3, 2, 1]
    assert nodes(graph.shortest_path(path, 1, 4, max_hops=2)) == []
    assert nodes(graph.shortest_path(path, 1, 4, kinds=[P])) == []
    assert nodes(graph.shortest_path(path, 3, 5, kinds=[P])) == [3, 5]
    assert nodes(graph.shortest_path(path, 99, 99)) == [99]


def test_hop_cap_is_exact(spark):
    e = spark.createDataFrame([(1, 2, N, 0.5), (1, 3, N, 0.9), (3, 2, N, 0.9), (2, 4, N, 0.9)], "src long, dst long, kind string, weight double")
    r = graph.shortest_path(e, 1, 4, max_hops=2).orderBy("step").collect()
    assert [x.node for x in r] == [1, 2, 4] and r[0].cost == pytest.approx(0.6)


def test_adjacency_takes_the_largest_weight_and_all_kinds(spark):
    e = spark.createDataFrame([(1, 2, N, 0.5), (2, 1, P, 0.8), (3, 3, N, 1.0)], "src long, dst long, kind string, weight double")
    assert sorted((r.a, r.b, r.weight, tuple(r.kinds)) for r in graph.adjacency(e).collect()) == [(1, 2, 0.8, (P, N)), (2, 1, 0.8, (P, N))]


def test_explain(spark, concepts):
    k = views.kept(concepts([{"id": 1, "domain": ["p", "q"], "form": "law"}, {"id": 3, "domain": ["q", "p"], "form": "law", "source_list": "s"}]))
    e = spark.createDataFrame([(1, 3, N, 0.5), (1, 2, N, 0.9), (3, 2, "contrasts_with", 0.9), (3, 2, N, 0.9)], "src long, dst long, kind string, weight double")
    r = graph.explain(k, e, 1, 3, None).first()
    assert (r.cosine, r.edges_ab, r.edges_ba, r.shared_domain, r.same_form, r.same_source, r.shared_neighbors) == (None, 1, 0, "p,q", True, None, 1)
    assert [(x.dst, x.kinds) for x in graph.shared_neighbors(e, 1, 3).collect()] == [(2, "contrasts_with,semantic_near")]


def test_ego_graph(spark, path):
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    e = spark.createDataFrame([(1, 2, N, 0.5), (2, 1, N, 0.9), (3, 1, N, 0.7), (3, 2, N, None), (9, 1, N, 0.3)], "src long, dst long, kind string, weight double")
    assert sorted((r.a, r.b, r.weight) for r in graph.ego_graph(e, ids, 1).collect()) == [(1, 2, 0.5), (1, 3, 0.7), (2, 3, 0.4)]


def test_neighbors_and_page(path):
    assert [r.dst for r in graph.neighbors(path, 3, "no such kind").collect()] == [4]
    assert {(r.role, r.kind, r.other) for r in graph.concept_page(path, 5).collect()} == {("prerequisite", P, 3)}


def test_edges_once_keeps_the_first(spark):
    e = spark.createDataFrame([(2, 1, 2, N, "s", 0.9, None), (1, 1, 2, N, "s", 0.4, "x"), (3, 1, 2, N, "s", None, None), (4, None, 2, N, "s", 1.0, None)], "id long, src_id long, dst_id long, kind string, source string, weight double, note string")
    assert [(r.src, r.weight) for r in views.edges_once(e).collect()] == [(1, 0.4)]
    assert views.edges_once(e.limit(0)).count() == 0

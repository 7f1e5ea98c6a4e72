import pytest

from corvane.operators.facets import Filters
from corvane.operators.reactions import ReactionLog
from corvane.plans.engine import BadRequest, Corpus, NotFound
from corvane.sources import sinks
from corvane.sources.providers import HashEmbedder


@pytest.fixture(scope="module")
def corpus(spark, concepts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    tiny = [("alpha", [1.0, 0.0], "philosophy", "concept", 5), ("alpha-prime", [0.95, 0.31], "philosophy", "concept", 7), ("beta", [0.0, 1.0], "biology", "phenomenon", 3), ("beta-prime", [0.31, 0.95], "biology", "concept", 9), ("anti-alpha", [-1.0, 0.0], "sociology", "principle", 4)]
    concepts([{"id": i + 1, "slug": s, "title": s.replace("-", " "), "embedding": v, "domain": [m], "form": f, "surprise_score": p, "obscurity": 2} for i, (s, v, m, f, p) in enumerate(tiny)]).write.parquet(f"{d}/concepts.parquet")
    spark.createDataFrame([(1, 1, 2, "semantic_near", "x", 0.9, None), (2, 2, 3, "semantic_near", "x", 0.8, None)], "id long, src_id long, dst_id long, kind string, source string, weight double, note string").write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame([(4, 9, [1, 2, 2, 77, None], ["a"]), (5, 2, [4], []), (6, 0, [], None)], "id long, size int, representatives array<long>, top_terms array<string>").write.parquet(f"{d}/clusters.parquet")
    return Corpus(spark, d, "m", 2, HashEmbedder(2))


def slugs(df):
    return [r.slug for r in df.collect()]


def test_queries(corpus):
    assert slugs(corpus.semantic([1, 0], 2)) == ["alpha", "alpha-prime"]
    assert slugs(corpus.semantic([1, 0], 3, mmr=True, lam=1)) == ["alpha", "alpha-prime", "beta-prime"]
    assert slugs(corpus.filter(Filters(domain="biology"))) == ["beta-prime", "beta"]
    assert set(slugs(corpus.search("alpha"))) == {"alpha", "alpha-prime", "anti-alpha"}
    assert slugs(corpus.neighbors("alpha")) == ["alpha-prime"]
    assert [r.node for r in corpus.path("alpha", "beta").orderBy("step").collect()] == [1, 2, 3]
    assert slugs(corpus.analogy("alpha", form="phenomenon")) == ["beta"]
    assert slugs(corpus.random(50)) and corpus.facets().count() > 0
    assert corpus.explain("alpha", "beta").first().cosine == 0.0
    assert corpus.quotes("alpha").count() == corpus.dismissed("u").count() == 0  # absent tables


def test_totals_and_clusters(spark, corpus):
    got = corpus.filter_with_total(Filters(form="concept"), "title", 2).collect()
    assert [(r.slug, r.total) for r in got] == [("alpha", 3), ("alpha-prime", 3)]
    assert {r.total for r in corpus.random(2, Filters(domain="biology")).collect()} == {2}
    assert [(r.slug, r.total) for r in corpus.cluster_members(4, k=1).collect()] == [("alpha-prime", 2)]
    assert slugs(corpus.cluster_members(4, filters=Filters(form="concept"), by="title")) == ["alpha", "alpha-prime"]
    made = spark.createDataFrame([(3, 4), (5, 4)], "id long, cluster long")
    assert slugs(corpus.cluster_members(4, made)) == ["anti-alpha", "beta"]
    assert [len(r.representatives) for r in corpus.cluster(4).collect()] == [2]
    assert [r.cluster for r in corpus.concept_cluster("beta-prime").collect()] == [5] and corpus.concept_cluster("anti-alpha").count() == 0
    assert [r.cluster for r in corpus.concept_cluster("anti-alpha", made).collect()] == [4]
    assert [(r.role, r.slug) for r in corpus.page("alpha").collect()] == [("related", "alpha-prime")]
    assert slugs(corpus.search("alpha", filters=Filters(source="none"))) == []


def test_reactions_and_advice(spark, corpus, tmp_path):
    log = ReactionLog(spark, str(tmp_path / "log"))
    first = corpus.react(log, "u", "beta", "dismissed")
    assert corpus.react(log, "u", "beta", "dismissed") == first and corpus.react(log, "u", "beta", "dismissed", on=False) is True
    with pytest.raises(NotFound):
        corpus.react(log, "u", "no", "favorite")
    with pytest.raises(BadRequest):
        corpus.react(log, "u", "beta", "knew")
    for t in (1, 2):
        sinks.append_log(spark, str(tmp_path / "advice"), {"id": f"r{t}", "ts": t, "framing": "f", "picks": [("beta", "w"), ("no", "x")]})
    assert [(r.id, r.slug) for r in corpus.advice(str(tmp_path / "advice")).collect()] == [("r2", "beta"), ("r1", "beta")]


def test_errors(corpus):
    for call in (lambda: corpus.concept("no"), lambda: corpus.cluster(99), lambda: corpus.cluster_members(99), lambda: corpus.triangulate(["alpha", "no"])):
        with pytest.raises(NotFound):
            call()
    for call in (lambda: corpus.triangulate(["alpha"]), lambda: corpus.analogy("alpha"), lambda: corpus.path("alpha", "beta", kinds=["?"]), lambda: corpus.semantic([1.0])):
        with pytest.raises(BadRequest):
            call()

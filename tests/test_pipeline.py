from corvane.operators import build
from corvane.plans import pipeline, views
from corvane.sources.providers import FolderPages, HashEmbedder


def enricher():
    class Enricher:  # in a function, so that it is sent by value
        def enrich(self, title, extract):
            if title == "Bad":
                raise OSError("down")
            return {"one_liner": f"about {title}", "aha_explanation": "x" * 80, "canonical_example": "y" * 20, "domain": ["logic"], "form": "law", "affect": ["neutral"], "obscurity": 2, "prerequisites_raw": "[]", "surprise_score": 6}

    return Enricher()


def test_scrape(spark):
    old = spark.createDataFrame([("a", "A", "x")], "slug string, title string, source_list string")
    pages = spark.createDataFrame([("p", 1, '<ul><li><a href="/wiki/A">a</a></li><li><a href="/wiki/B_c">b</a></li></ul>'), ("q", 0, '<ul><li><a href="/wiki/B-c">b</a></li></ul>')], "source_list string, priority int, html string")
    seeds = spark.createDataFrame([("s", 9, "New one"), ("s", 9, "B c"), ("s", 9, None)], "source_list string, priority int, title string")
    got = {(r.slug, r.source_list) for r in pipeline.scrape(old, pages, seeds).collect()}
    assert got == {("a", "x"), ("b-c", "q"), ("new-one", "s")}


def test_enrich_uses_the_cache(spark):
    todo = spark.createDataFrame([(1, "A", None), (2, "Bad", "t"), (3, "C", "z" * 5000)], "id long, title string, wiki_extract string")
    empty = spark.createDataFrame([], "key string, " + pipeline.ENRICHED)
    first = pipeline.enrich(todo, empty, enricher()).cache()
    assert {r.id: (r.valid, r.cached) for r in first.collect()} == {1: (True, False), 2: (False, False), 3: (True, False)}
    again = pipeline.enrich(todo, first.where("valid").select(*empty.columns), enricher())
    assert {r.id: (r.valid, r.cached) for r in again.collect()} == {1: (True, True), 2: (False, False), 3: (True, True)}


def test_embed_edges_clusters_quotes_export(spark, concepts, tmp_path):
    e = HashEmbedder(16)
    words = ["crowd law", "crowd rule", "map theory", "map theory", "quiet mirror"]
    rows = [{"id": i + 1, "slug": f"s{i}", "title": t, "one_liner": t, "prerequisites_raw": '["map theory", " ", "quiet mirror"]' if i == 0 else "[broken"} for i, t in enumerate(words)]
    c = concepts(rows, embedding_model=None)
    v = pipeline.embed(c, e, "m")
    assert v.count() == 5
    c = concepts([r | {"embedding": x.embedding} for r, x in zip(rows, v.orderBy("id").collect())])
    assert pipeline.embed(c, e, "m").count() == 0
    old = spark.createDataFrame([(1, 2, "contrasts_with", "llm", 1.0, None), (4, 5, "semantic_near", "semantic-knn", 0.1, None)], "src_id long, dst_id long, kind string, source string, weight double, note string")
    made = pipeline.edges(old, c, 16, e).cache()
    got = {(r.src_id, r.dst_id, r.kind) for r in made.collect()}
    assert (1, 2, "contrasts_with") in got and (3, 4, "semantic_dedup") in got and (3, 4, "semantic_near") in got and (3, 1, "prerequisite_of") in got and (5, 1, "prerequisite_of") in got
    assert {(r.src_id, r.dst_id, r.kind) for r in pipeline.edges(made, c, 16, e).collect()} == got
    table, assigned = pipeline.clusters(c, 16, k=3)
    assert assigned.count() == 5 and sum(r["size"] for r in table.collect()) == 5
    none = spark.createDataFrame([(2, "t", None, "wikiquote", 0)], "concept_id long, text string, attribution string, source string, rank int")
    q = pipeline.quotes(none, c, FolderPages(wikitext={"crowd law": "* A quote of sufficient length.\n** By Me", "crowd rule": "* Another quote of some length."}))
    assert {(r.concept_id, r.text) for r in q.collect()} == {(2, "t"), (1, "A quote of sufficient length.")}
    with_id = made.selectExpr("row_number() over (order by src_id, dst_id, kind) as id", "*")
    pipeline.export(c, with_id, q, str(tmp_path), 16, table, assigned)
    assert spark.read.json(str(tmp_path / "embeddings_meta")).select("rows", "dim", "model").first() == (5, 16, "m")
    assert spark.read.json(str(tmp_path / "clusters")).count() == table.count() and spark.read.json(str(tmp_path / "assignments")).count() == 5
    assert spark.read.json(str(tmp_path / "concepts")).count() == views.kept(c).count() == 5
    assert spark.read.parquet(str(tmp_path / "embeddings")).count() == 5


def test_suggested_quotes_are_verified_once(spark, concepts):
    c = concepts([{"id": i, "slug": f"s{i}", "title": f"t{i}"} for i in (1, 2, 3)])
    have = spark.createDataFrame([(3, "q", None, "wikiquote", 0)], "concept_id long, text string, attribution string, source string, rank int")
    good, bad = "The crowd remembers what the ferryman forgets at dusk", "Nobody has ever written this sentence down anywhere"
    s = spark.createDataFrame([(1, 1, good, "A", "B"), (1, 0, bad, "A", None), (1, 2, good, "X", ""), (2, 0, "too short", "A", "B"), (3, 0, good, "A", "B"), (2, 1, None, None, None)], "concept_id long, place int, text string, author string, work string")
    e = spark.createDataFrame([(1, "P", f"He said: {good}."), (0, "N", None)], "site_order int, page_title string, body string")
    none = spark.createDataFrame([], "key string, site_order int, page_title string")
    got, cache = pipeline.suggested_quotes(have, c, s, e, none)
    assert sorted(tuple(r) for r in got.where("source = 'llm_verified'").collect()) == [(1, good, "A, B", "llm_verified", 0)]
    assert {r.page_title for r in cache.collect()} == {"P", None}
    again, same = pipeline.suggested_quotes(have, c, s, e.limit(0), cache)  # nothing is looked for a second time
    assert again.count() == got.count() and same.count() == 2


def test_drop_rule(spark):
    df = spark.createDataFrame([(1, 3), (2, 4), (3, None)], "id long, surprise_score int")
    assert [(r.dropped, r.drop_reason) for r in build.dropped(df).orderBy("id").collect()] == [(1, "low_surprise"), (0, None), (0, None)]

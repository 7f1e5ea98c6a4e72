import pytest

from corvane.operators import build, facets
from corvane.operators.facets import Filters
from corvane.plans import views


@pytest.fixture(scope="module")
def kept(concepts):
    return views.kept(
        concepts([
            {"id": 1, "slug": "a", "title": "A", "source_list": "wiki", "domain": ["x", "y", "x"], "form": "law", "affect": ["calm"], "obscurity": 2, "surprise_score": 7},
            {"id": 2, "slug": "b", "title": "B", "source_list": "wiki", "domain": ["y"], "form": "", "affect": None, "obscurity": 0, "surprise_score": None, "one_liner": "the Crowd"},
            {"id": 3, "slug": "c", "title": None, "source_list": "manual", "domain": None, "form": "law", "affect": [None, "calm"], "obscurity": 4, "surprise_score": 9},
            {"id": 4, "slug": "d", "title": "D", "dropped": 1},
            {"id": 5, "slug": "e", "title": "E", "enriched_at": None},
        ])
    ).cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_defaults(kept):
    b = kept.where("id = 2").first()
    assert (b.form, b.obscurity, b.surprise, b.affect, b.aha) == ("concept", 3, 5, [], "")
    assert sorted(ids(kept)) == [1, 2, 3]


@pytest.mark.parametrize(("f", "want"), [
    (Filters(), [1, 2, 3]), (Filters(form="law"), [1, 3]), (Filters(source="wiki"), [1, 2]), (Filters(domain="y"), [1, 2]),
    (Filters(affect="calm"), [1, 3]), (Filters(obscurity_min=3), [2, 3]), (Filters(obscurity_max=3), [1, 2]), (Filters(surprise_min=7, surprise_max=7), [1]),
    (Filters(form="law", source="manual"), [3]), (Filters(domain="none"), []),
])
def test_filters(kept, f, want):
    assert sorted(ids(facets.apply(kept, f))) == want


def test_parse_and_clamp():
    f = Filters.parse({"form": "", "domain": "x", "obscurity_min": "abc", "surprise_max": "7"})
    assert f == Filters(domain="x", surprise_max=7)
    assert [facets.clamp_int(v, 15, 1, 80) for v in (None, "", "x", "0", "12.9", 500, float("nan"), float("inf"))] == [15, 15, 15, 1, 12, 80, 15, 15]


def test_order_page_and_ties(kept):
    assert ids(facets.sort(kept, "surprise")) == [3, 1, 2]
    assert ids(facets.sort(kept, "obscurity")) == [1, 2, 3]
    assert ids(facets.sort(kept, "obscurity_desc")) == [3, 2, 1]
    assert ids(facets.page(kept, "surprise", 1, 1)) == [1]
    assert ids(facets.page(kept, "surprise", 9, 5)) == []


def test_multi_select(kept):
    assert sorted(ids(facets.multi_select(kept, "", domain=["x", "y"], form=["law"]))) == [1]
    assert ids(facets.multi_select(kept, "CROWD", domain=[])) == [2]


def test_counts(kept):
    got = {(r.facet, r.value): r.n for r in facets.counts(kept, ["form", "surprise"], ["domain", "affect"]).collect()}
    assert got == {("form", "law"): 2, ("form", "concept"): 1, ("surprise", "7"): 1, ("surprise", "5"): 1, ("surprise", "9"): 1, ("domain", "x"): 1, ("domain", "y"): 2, ("affect", "calm"): 2}


def test_empty_table(concepts):
    k = views.kept(concepts([]))
    assert facets.counts(k, ["form"], ["domain"]).count() == 0
    assert facets.page(k, "title", 0, 5).count() == 0


def test_extra_columns_with_clashing_names(concepts):
    from pyspark.sql import functions as F

    c = concepts([{"id": 1, "slug": "a", "form": "law"}]).withColumns({"source": F.lit("?"), "surprise": F.lit(0), "facet": F.lit(1), "n": F.lit(2)})
    assert facets.counts(views.kept(c), ["form", "surprise"], []).count() == 2


def test_titles_sort_as_in_a_dictionary(spark):
    df = spark.createDataFrame([(1, "Zoo"), (2, "apple"), (3, "Äpfel"), (4, "Banana"), (5, "banana"), (6, None)], "id long, title string")
    assert [r.id for r in facets.sort(df, "title").collect()] == [6, 3, 2, 5, 4, 1]
    assert [(r.id, r.total) for r in facets.page_with_total(df, "title", 1, 2).collect()] == [(3, 6), (2, 6)]


def test_labels_by_kind(spark):
    df = spark.createDataFrame([("effect",), ("effects",), ("new_one",), (None,)], "v string")
    both = [df.select(build.label(k, df.v).alias("x")).collect() for k in ("form", "source")]
    assert [[r.x for r in b] for b in both] == [["Named effect", "effects", "new_one", None], ["effect", "Named effects", "new_one", None]]

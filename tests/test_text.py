import pytest
from pyspark.sql import functions as F

from corvane.functions import extract, text
from corvane.operators import build, cluster, sampling, textsearch
from corvane.plans import views


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_slugs(spark):
    assert col(spark, ["Müller's  Law – (1900)", " A_b--C ", "", None, "日本"], text.slugify) == ["mullers-law-1900", "a_b-c", "", None, ""]


def test_hash(spark):
    import hashlib

    want = hashlib.sha256(b"a\x1f\x1f").hexdigest()[:16]
    assert col(spark, ["a", None], lambda c: text.content_hash(c, F.lit(None).cast("string"))) == [want, hashlib.sha256(b"\x1f\x1f").hexdigest()[:16]]


def test_phrase(spark):
    got = col(spark, ["one two three four five six", "a b c d extraordinary circumstances demand e f g", None], text.distinctive_phrase)
    assert got == [None, "b c d extraordinary circumstances demand", None]


@pytest.mark.parametrize(("raw", "want"), [
    ("a<ref>x</ref> b", "a b"), ("a<br/>b", "a b"), ("[[X|y]] and [[Z]]", "y and Z"), ("'''bold''' ''it''", "bold it"), ("{{t|{{u}}}}rest", "rest"), ("<i>q</i>  r", "q r"), ("", ""), (None, None),
    ("x {{a|{b}|{{c}} {{d|{{e}}}}}} y", "x y"), ("a {{open b", "a {{open b"), ("a }} b {{c}}", "a }} b"), ("[//x.example/y name] z", "name z"), ("a<ref name=k/> b", "a b"),
])
def test_clean(spark, raw, want):
    assert col(spark, [raw], text.clean_wikitext) == [want]


def test_quotes(spark):
    page = "== Q ==\n* ''It is a long enough first quote.''\n** [[A B]]\r\n** ''Book''\n* Short\n* See also: something else entirely\n*** stray\n* A second quote with a dash here — C. Author\n* \"It is a long enough first quote.\"\n"
    two = [("It is a long enough first quote.", "A B — Book"), ("A second quote with a dash here", "C. Author")]
    got = col(spark, [page, "", None, "no bullets at all", "text\n  * Indented, and long enough to count - By - Me"], text.quotes_of)
    assert [[tuple(q) for q in x] for x in got] == [two, [], [], [], [("Indented, and long enough to count", "By - Me")]]
    assert [tuple(q) for q in col(spark, [page], lambda c: text.quotes_of(c, 1))[0]] == two[:1]


def test_attribution(spark):
    df = spark.createDataFrame([("A", "B"), ("", "B"), ("A", None), (None, "")], "a string, s string")
    assert [r.x for r in df.select(text.attribution(F.col("a"), F.col("s")).alias("x")).collect()] == ["A, B", "B", "A", ""]


def test_looks_like_quote(spark):
    got = col(spark, ["This is surely a quote.", "short one", "See also the other long page", "1234567 8901234567890 12345", None], text.looks_like_quote)
    assert got == [True, False, False, False, None]


HTML = """<div class="mw-parser-output"><div><div class="navbox"><ul><li><a href="/wiki/Nav">n</a></li></ul></div></div>
<ul><li><a href="/wiki/First_entry#x">one</a> <a href="/wiki/Not_this">no</a><ul><li><a href="/wiki/Nested">in</a></li></ul></li><li><a href="/wiki/List_of_x">l</a></li>
<li><a class="external" href="/wiki/Ext">e</a></li><li><a href="/wiki/Help:Me">h</a></li></ul>
<table class="wikitable"><tr><th>H</th></tr><tr><td><a href="/wiki/C%2B%2B">c</a></td><td><a href="/wiki/Second_cell">s</a></td></tr></table>
<div class="mw-heading mw-heading2"><h2>See also</h2></div><ul><li><a href="/wiki/Skipped">s</a></li></ul>
<div class="mw-heading mw-heading2"><h2>More[edit]</h2></div><ul><li><a href="/wiki/First_entry">again</a></li><li><a href="/wiki/Last">z</a></li></ul></div>"""


def test_entries(spark):
    assert extract.extract_entries(HTML) == [("First entry", "one"), ("Nested", "in"), ("C++", "c"), ("Last", "z")]
    assert extract.extract_entries(HTML, skip=("More",)) == [("First entry", "one"), ("Nested", "in"), ("C++", "c")]
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "id long, html string")
    assert [(r.id, r.position, r.title) for r in extract.entries(df).collect()][-1] == (1, 3, "Last")


def test_href(spark):
    got = col(spark, ["/wiki/A_b+c%20d#e", "/wiki/Talk:X", "/x/y", "/wiki/", None, "/wiki/Index_of_z", "/wiki/%zz"], extract.href_title)
    assert got[:6] == ["A b+c d", None, None, None, None, None]


def test_terms(spark):
    df = spark.createDataFrame([("a", 1, "Crowd crowd the theory"), ("a", 2, "crowd theory, crowd's"), ("b", 3, "theory of maps maps"), ("b", 4, None)], "cluster string, id long, text string")
    got = {(r.cluster, r.rank): r.term for r in cluster.top_terms(df).collect()}
    assert got == {("a", 1): "crowd", ("a", 2): "theory", ("b", 1): "maps"}


def test_search(concepts):
    k = views.kept(concepts([
        {"id": 1, "title": "Crowd paradox", "one_liner": "x"}, {"id": 2, "title": "Other", "one_liner": "a crowd"}, {"id": 3, "title": "Crowding", "aha_explanation": "y"}, {"id": 4, "title": None}, {"id": 5, "title": "Crowe"},
    ]))
    hits = {r.id: r.score for r in textsearch.search(k, "crowd").collect()}
    assert set(hits) == {1, 2, 3, 5} and hits[1] > hits[2] and hits[1] > hits[3]
    assert textsearch.search(k, " ?! ").count() == 0


def test_sample_prefers_weight_and_is_repeatable(spark):
    df = spark.createDataFrame([(i, 9 if i % 2 else 1, 3) for i in range(400)], "id long, surprise int, obscurity int")
    a = [r.id for r in sampling.weighted_sample(df, 100).collect()]
    assert a == [r.id for r in sampling.weighted_sample(df, 100).collect()] and len(set(a)) == 100
    assert sum(i % 2 for i in a) > 60
    assert sampling.weighted_sample(df, 10, surprise_temp=0, obscurity_temp=0).count() == 10


def test_position_is_global(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "id long").repartition(6)
    assert all(r.id == r.position for r in sampling.with_position(df, "id").collect())


def test_nth_uniform_is_mulberry(spark):
    def draws(seed, n):
        out, a = [], seed
        imul = lambda x, y: (x * y) & 0xFFFFFFFF
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = imul(a ^ (a >> 15), 1 | a)
            t = ((t + imul(t ^ (t >> 7), 61 | t)) & 0xFFFFFFFF) ^ t
            out.append((t ^ (t >> 14)) / 4294967296)
        return out

    got = [r.x for r in spark.range(50).select("id", sampling.nth_uniform(20260131, F.col("id")).alias("x")).orderBy("id").collect()]
    assert got == pytest.approx(draws(20260131, 50), abs=1e-12)


def test_daily_picks(spark, concepts):
    k = views.kept(concepts([{"id": i, "slug": f"s{i}", "domain": ["a"] if i < 6 else [], "surprise_score": 5} for i in range(1, 10)]))
    seen = spark.createDataFrame([("s1",), (None,)], "slug string")
    got = sampling.daily_picks(k, seen, 7, 4).collect()
    assert len(got) == 4 and sum(r.domain1 == "a" for r in got) == 2 and all(r.slug != "s1" for r in got)
    assert sampling.daily_picks(k, k.select("slug"), 7, 4).count() == 4


def test_build_steps(spark, concepts):
    rows = spark.createDataFrame([("k", 2, "new"), ("k", 1, "old"), ("j", 1, "x")], "key string, created_at int, value string")
    assert {(r.key, r.value) for r in build.put_latest(rows.limit(0), rows).collect()} == {("k", "new"), ("j", "x")}
    assert {(r.key, r.value) for r in build.first_wins(rows, ["key"], "created_at").collect()} == {("k", "old"), ("j", "x")}
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id long, s string, n int")
    new = spark.createDataFrame([(1, "", 5), (2, "c", None)], "id long, s string, n int")
    assert sorted(map(tuple, build.update_by_id(old, new).collect())) == [(1, "a", 5), (2, "c", None)]
    assert build.update_by_id(old, new.limit(0)).count() == 2


def test_what_is_to_be_enriched(spark):
    df = spark.createDataFrame([(3, None), (1, None), (2, "2026-01-01")], "id long, enriched_at string")
    todo = lambda **k: [r.id for r in build.to_enrich(df, **k).orderBy("id").collect()]
    assert todo() == [1, 3] and todo(limit=1) == [1] and todo(force=True) == [1, 2, 3] and todo(force=True, limit=2) == [1, 2] and todo(limit=0) == []


def test_aliases(spark):
    t = spark.createDataFrame([("a b",), ("c",), ("gone",)], "title string")
    norm = spark.createDataFrame([("a b", "A b")], "from string, to string")
    red = spark.createDataFrame([("c", "D"), ("A b", "X"), ("X", "D")], "from string, to string")
    pages = spark.createDataFrame([("D", 7)], "page_title string, pageid int")
    assert sorted((r.title, r.pageid) for r in build.resolve_aliases(t, norm, red, pages).collect()) == [("a b", 7), ("c", 7)]


def test_final_reply(spark):
    good = 'x <framing> F </framing>\n<picks> [{"slug": "a", "why": "b"}] </picks>'
    df = spark.createDataFrame([(good,), ("nothing",), (None,)], "t string")
    f, p = build.parse_final(F.col("t"))
    got = df.select(f.alias("f"), p.alias("p")).collect()
    assert (got[0].f, got[0].p[0].slug) == ("F", "a") and got[1].f is None and not got[1].p and got[2].p is None


def test_waterfall(spark):
    q = spark.createDataFrame([(1, 9, "llm_verified", "a", 0), (2, 9, "wikiquote", "b", 1), (3, 9, "wikiquote", "c", 0), (4, 8, "llm_verified", "d", None), (5, 7, "other", "e", 0)], "id long, concept_id long, source string, text string, rank int")
    assert sorted((r.concept_id, r.place, r.text) for r in build.quotes_waterfall(q).collect()) == [(8, 0, "d"), (9, 0, "c"), (9, 1, "b")]


def test_verified_quotes_of_few_words_and_within_words(spark):
    q = spark.createDataFrame([(1, "Mirrors keep no faces"), (2, "too short now"), (3, "of all the ways it was paradox"), (4, "__ __ __ __"), (5, "one two three four five six")], "id long, text string")
    pages = [(1, "b", "They say mirrors keep no faces."), (0, "c", "too short now, of all the ways it was paradoxes"), (1, "a", "Mirrors keep no faces, __ __ __ __"), (1, "d", "none two three four five sixty")]
    e = spark.createDataFrame(pages, "site_order int, page_title string, body string")
    got = {(r.id, r.site_order, r.page_title) for r in build.verified_quotes(q, e, text.search_phrase(F.col("text"))).collect()}
    assert got == {(1, 1, "a"), (3, 0, "c"), (4, 1, "a"), (5, 1, "d")}

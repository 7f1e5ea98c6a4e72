import datetime as dt

import pytest

from corvane.operators import reactions
from corvane.sources import providers, seeds, sinks
from corvane.streaming import reactions as streaming


def at(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("u", "a", "favorite", 1, 1), ("u", "a", "favorite", 3, 3), ("u", "b", "favorite", 1, 1), ("u", "b", "unfavorite", 2, 2), ("u", "b", "favorite", 5, 5),
        ("u", "c", "favorite", 4, 4), ("u", "c", "unfavorite", 6, 6), (None, "a", "favorite", 2, 2), ("u", "a", "knew", 1, 9), ("u", "a", "didnt", 2, 2), ("u", "a", "didnt", 2, 2),
        ("v", "a", "knew", 1, 1), ("v", "a", "clear", 2, 2), ("u", None, "knew", 1, 1), ("u", "b", None, 1, 1), ("w", "b", "mind_blown", 30, 30),
    ]
    return spark.createDataFrame([(u, s, g, at(x), at(y)) for u, s, g, x, y in rows], streaming.SCHEMA).cache()


def test_favorites_keep_the_first_time_since_removal(log):
    got = {(r.user_key, r.slug): r.created_at for r in reactions.favorites(log).collect()}
    assert got == {("u", "a"): at(1), ("u", "b"): at(5), ("", "a"): at(2)}


def test_signals(log):
    got = {(r.user_key, r.slug): r.signal for r in reactions.signals(log).collect()}
    assert got == {("u", "a"): "didnt", ("w", "b"): "mind_blown"}
    assert {r.signal: r.n for r in reactions.signal_counts(log).collect()} == {"didnt": 1, "mind_blown": 1}
    assert {str(r.day): r.n for r in reactions.counts_by_day(log).collect()} == {"2026-01-01": 1, "2026-01-02": 1}


def test_views_and_empty_log(spark, log):
    c = spark.createDataFrame([("b", "B")], "slug string, title string")
    assert [r.title for r in reactions.recent(log, c, "mind_blown").collect()] == ["B"]
    assert {r.slug: r.title for r in reactions.history(log, c).collect()} == {"a": None, "b": "B"}
    assert reactions.favorites(log.limit(0)).count() == reactions.signals(log.limit(0)).count() == 0


def test_signal_maps_go_round(spark, log):
    s = reactions.signals(log)
    back = sinks.import_signals(sinks.export_signals(s))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s.collect()))
    assert sinks.import_signals(spark.createDataFrame([("u", "{broken")], "user_key string, json string")).count() == 0


def test_stream_equals_batch(spark, log, tmp_path):
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streaming.read(spark, str(tmp_path / "in"))
    streaming.run_to_table(streaming.latest_signals(s), "latest", "complete")
    got = {(r.user_key, r.slug): r.signal for r in spark.table("latest").where("signal <> 'clear'").collect()}
    assert got == {("u", "a"): "didnt", ("w", "b"): "mind_blown"}
    streaming.run_to_table(streaming.deduplicated(streaming.read(spark, str(tmp_path / "in"))), "once", "append")
    assert spark.table("once").where("signal = 'didnt'").count() == 1


def test_matrix_and_log_go_round(spark, tmp_path):
    v = spark.createDataFrame([(2, [3.0, 4.0]), (1, None)], "id long, embedding array<float>")
    sinks.write_matrix(v, str(tmp_path / "m"))
    assert {r.id: r.embedding for r in sinks.read_matrix(spark, str(tmp_path / "m")).collect()} == {2: pytest.approx([0.6, 0.8]), 1: None}
    p = str(tmp_path / "log")
    for t in (1, 3, 2):
        sinks.append_log(spark, p, {"id": str(t), "ts": t, "picks": [("a", "b")]})
    (tmp_path / "log" / "part-9.json").write_text("{broken\n")
    assert [r.ts for r in sinks.read_log(spark, p).collect()] == [3, 2, 1]
    assert sinks.unpack_floats(b"\x00\x00\x80\x3f" * 4, [5, 6], 2) == [(5, [1.0, 1.0]), (6, [1.0, 1.0])]


def test_writes(spark, tmp_path):
    """Adding again keeps the first time; removing tells whether it was there; the two kinds don't mix."""
    log = reactions.ReactionLog(spark, str(tmp_path / "writes"))
    assert log.list("u").count() == 0 and not log.remove("u", "a")
    first = log.add("u", "a", at=at(1))
    assert log.add("u", "a", at=at(2)) == first and log.contains("u", "a") and not log.contains("v", "a") and not log.contains("u", "a", "dismissed")
    log.add("u", "b", at=at(3))
    assert [r.slug for r in log.list("u").collect()] == ["b", "a"]
    assert log.remove("u", "a", at=at(4)) and not log.remove("u", "a", at=at(5)) and not log.contains("u", "a")
    assert log.add("u", "a", at=at(6)) > first and [r.slug for r in log.list("u").collect()] == ["a", "b"]
    log.signal("u", "a", "knew", at(7))
    log.signal("u", "b", "didnt", at(7))
    log.signal("u", "b", None, at(8))
    assert [(r.slug, r.signal) for r in reactions.signals(log.read()).collect()] == [("a", "knew")]
    with pytest.raises(ValueError):
        log.signal("u", "a", "favorite")


def test_polite_calls():
    waits, now, tries = [], [0.0], []

    def sleep(s):
        waits.append(round(s, 3))
        now[0] += s

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError("down")
        return x

    p = providers.Polite("test", sleep=sleep, clock=lambda: now[0])
    assert p(flaky, 5) == 5 and waits == [1.0, 2.0]
    assert p(flaky, 6) == 6 and waits[2:] == [0.1]

    def down(_):
        raise OSError("down")

    with pytest.raises(OSError):
        p(down, 1)
    assert waits[3:] == [0.1, 1.0, 2.0, 4.0]
    with pytest.raises(LookupError):
        p({}.__getitem__, 1)


def test_summaries_follow_aliases(spark):
    def provider():
        class Wiki:  # in a function, so that it is sent by value
            def summaries(self, titles):
                assert len(titles) <= 2
                if "down" in titles:
                    raise OSError("down")
                return {"normalized": [(t, t.capitalize()) for t in titles if t == "a"], "redirects": [("A", "B"), ("B", "C")] if "a" in titles else [], "pages": [(t, 1, "x", "u") for t in (["C"] if "a" in titles else []) + [t for t in titles if t == "D"]]}

        return Wiki()

    t = spark.createDataFrame([("a",), ("D",), ("gone",), (None,), ("D",)], "title string").coalesce(1)
    got = {(r.title, r.page_title) for r in providers.fetch_summaries(t, provider(), 2).collect()}
    assert got == {("a", "C"), ("D", "D")}
    quick = providers.Polite(spacing=0, wait=0)
    assert providers.fetch_summaries(spark.createDataFrame([("down",)], "title string"), provider(), 2, quick).count() == 0


def test_seed_pages(spark):
    assert seeds.seed_pages(spark).count() == 11 and seeds.seed_pages(spark).select("source_list").distinct().count() == 11
    assert [tuple(r) for r in seeds.curated(spark, {"x": ["T", " "], "y": []}).collect()] == [("x", 11, "T")]


def test_providers(spark):
    t = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    assert providers.embed(t, providers.HashEmbedder(8)).count() == 2
    pages = providers.FolderPages(html={"A": "<p>"}, wikitext={"T": "x"}, redirects={"R": "T"})
    assert pages.wikitext("R") == ("T", "x") and pages.wikitext("Z") is None
    spark.dataSource.register(providers.page_source(pages))
    got = {r.title: (r.html, r.error is None) for r in spark.read.format("corpus_pages").option("pages", "A|B").load().collect()}
    assert got == {"A": ("<p>", True), "B": (None, False)}

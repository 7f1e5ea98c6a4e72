"""The operators for training data against brute force on small fixtures, with hard cases."""

import datetime as dt
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import cutoffs, leaks, lists, mixing, neardup, neighbours, simclusters, splitting, survivorship, tokens
from corvane.sources.durable import durable

V = "id long, embedding array<float>"


def groups_of(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(root(x), x) for x in parent}


# 1. survivors


def test_survivors(spark, concepts):
    day = lambda n: dt.datetime(2026, 1, n)
    c = concepts([
        {"id": 1, "source_list": " A-b ", "wiki_extract": "x", "one_liner": " \n", "surprise_score": 99, "enriched_at": day(5)},
        {"id": 2, "merged_into": 1, "source_list": "c", "wiki_extract": "y", "one_liner": "z", "surprise_score": 3, "enriched_at": None},
        {"id": 3, "merged_into": 2, "source_list": "none", "wiki_extract": "w", "one_liner": "v", "surprise_score": 4, "enriched_at": day(1)},
        {"id": 4, "merged_into": 4}, {"id": 5, "merged_into": 77}, {"id": 6, "merged_into": 7, "surprise_score": 5}, {"id": 7, "merged_into": 6},
        {"id": 8, "merged_into": 9, "surprise_score": None}, {"id": 9},
    ]).withColumns({"known": F.lit(1), "key": F.lit("k"), "group_id": F.lit(3)})
    s = spark.createDataFrame([("a_b", "A", 2, 50), ("c", "C", 1, 50)], "source_list string, list_name string, trust_rank int, keep_percent int")
    got = {r.group_id: r for r in survivorship.merge_survivors(c, s).collect()}
    assert set(got) == {1, 6, 8}
    assert (got[1].survivor_id, got[1].source_list, got[1].score_from, got[1].surprise_score) == (3, "c", 3, 4)
    assert (got[1].wiki_extract, got[1].one_liner, got[1].aha_explanation) == ("y", "z", None)
    assert (got[6].survivor_id, got[6].source_list, got[6].score_from) == (6, "", 6)
    assert got[8].score_from is None
    assert survivorship.merge_survivors(c.limit(0), s).count() == 0


# 3. cutoffs


@pytest.mark.parametrize("levels", [None, 3])
def test_cutoffs(spark, levels):
    r = random.Random(5)
    rows = [(r.choice("abc"), r.choice([1, 2, 2, 2, 7, 40, 63])) for _ in range(400)] + [("d", 9)] * 50 + [(None, 3), ("a", None), ("a", -5), ("a", 900)]
    df = spark.createDataFrame(rows, "source string, score int")
    rest = spark.createDataFrame(rows[100:], "source string, score int")
    first = spark.createDataFrame(rows[:100], "source string, score int")
    tree = cutoffs.DyadicTree(spark, lo=0, bits=6, levels=levels)
    tree.add_batch(first.limit(7), "one")
    for part, name in ((first, "one"), (rest, "two"), (rest, "two"), (df.limit(0), "none")):  # retried batches count once
        tree.add_batch(part, name)
    again = cutoffs.DyadicTree(spark, lo=0, bits=6, levels=levels, path=tree.path)
    both = first.withColumn("batch", F.lit("one"))
    again.add_batches(both)
    assert again.nodes().where("level = 0").agg(F.sum("n")).first()[0] == 450
    tree = again
    targets = spark.createDataFrame([("a", 30), ("b", 100), ("c", 1), ("d", 50), ("empty", 40)], "source string, percent int")
    got = {x.source: (x.cutoff, x.kept) for x in tree.cutoffs(targets, df).collect()}
    want = {}
    for s, p in (("a", 30), ("b", 100), ("c", 1), ("d", 50)):
        v = [x for k, x in rows if k == s and x is not None and 0 <= x < 64]
        cut = max(x for x in range(64) if 100 * sum(y >= x for y in v) >= p * len(v))
        want[s] = (cut, sum(y >= cut for y in v))
    assert got == want


# 2. and 5. vectors


def blobs(seed=0):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((14, 24))
    x = np.concatenate([c + 0.35 * r.standard_normal((n, 24)) for c, n in zip(centers, [150, 60, 30, 20, 13, 12, 11, 8, 7, 7, 6, 6, 3, 1])]).astype(np.float32)
    x[5:25] = x[4]  # exact copies
    return np.arange(len(x)) * 3 + 11, x * r.uniform(0.3, 3, (len(x), 1)).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    ids, x = blobs()
    bad = [(1, [0.0] * 24), (2, [float("nan")] + [1.0] * 23), (4, [float("inf")] * 24), (5, [None] + [1.0] * 23)]
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + bad, V).repartition(5).cache()


def cosines():
    ids, x = blobs()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    return ids, u @ u.T


def test_neighbours(vectors, monkeypatch):
    monkeypatch.setattr(lists, "BLOCK", 40)
    monkeypatch.setattr(lists, "SPLIT", 50)
    ids, s = cosines()
    s = np.round(s, 6)
    np.fill_diagonal(s, -9)
    want = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -s[i]))[:5]}
    got = [(r.id, r.neighbour_id) for r in neighbours.nearest(vectors, 24, 5).collect()]
    assert len(got) == len(set(got)) and len(set(got) & want) >= 0.97 * len(want)
    copies = {int(i) for i in ids[4:25]}
    assert all({b for a, b in got if a == i} == set(sorted(copies - {i})[:5]) for i in copies)


def test_exact_neighbours(vectors, monkeypatch):
    """Every list and no abandoned candidate, whatever the lists; fitted in levels, as small fans ask for."""
    monkeypatch.setattr(lists, "FAN", 4)
    monkeypatch.setattr(lists, "SAMPLE_PER_LIST", 8)
    monkeypatch.setattr(lists, "TILE", 300)
    ids, s = cosines()
    s = np.round(s, 6)
    np.fill_diagonal(s, -9)
    want = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -s[i]))[:5]}
    assert {(r.id, r.neighbour_id) for r in neighbours.nearest(vectors, 24, 5, neighbours.EXACT).collect()} == want
    assert 8 < len(lists.fit(vectors, 24).value) <= 1.5 * 2 * len(ids) ** 0.5


def test_lists_grow_with_the_root_of_the_rows(spark, monkeypatch):
    """Random rows form no clusters that merge, so all lists asked for come out, past the first fan."""
    monkeypatch.setattr(lists, "FAN", 32)
    x = np.random.default_rng(4).standard_normal((8000, 48)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], V).repartition(4)
    c = lists.fit(df, 48).value
    assert 1.2 * 2 * 8000**0.5 > len(c) > 0.8 * 2 * 8000**0.5 > lists.FAN and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], V)
    assert neighbours.nearest(few, 2, 5).count() == 6
    assert neighbours.nearest(few.limit(0), 2, 5).count() == 0
    assert neighbours.nearest(few.limit(1), 2, 5).count() == 0
    odd = few.unionByName(spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.1])], V)).withColumns({"part": F.lit(1), "v": F.lit("x"), "k": F.lit(2)})
    assert {r.id for r in neighbours.nearest(odd, 2, 2).collect()} == {1, 2, 3}
    assert {r.id for r in simclusters.pivot_clusters(odd.dropDuplicates(["id"]), 2)[0].collect()} == {1, 2, 3}


def test_pivot_clusters(vectors):
    ids, s = cosines()
    members, around = simclusters.pivot_clusters(vectors, 24)
    pivot = {r.id: r.pivot for r in members.collect()}
    at = {int(i): k for k, i in enumerate(ids)}
    assert set(pivot) == set(at)
    assert all(s[at[i], at[p]] >= 0.7 - 1e-6 for i, p in pivot.items())
    pivots = sorted({at[p] for p in pivot.values()})
    assert all(s[a, b] < 0.7 for a in pivots for b in pivots if a != b)
    assert all(s[at[i], at[p]] >= max(s[at[i], q] for q in pivots) - 1e-6 for i, p in pivot.items())
    near = s >= 0.7
    want = set()
    for i in range(len(ids)):
        c = np.flatnonzero(near[i])
        if len(c) >= 12 and all((near[j] == near[i]).all() for j in c):
            want.add((int(ids[c[0]]), int(ids[i])))
    got = {(r.cluster_id, r.concept_id) for r in simclusters.isolated_cliques(members, around, 12).collect()}
    assert got == want
    d = {r.cluster_id: r for r in simclusters.describe(members, vectors, 24).collect()}
    sizes = Counter(pivot.values())
    assert sorted(r["size"] for r in d.values()) == sorted(sizes.values())
    assert sorted(map(tuple, simclusters.describe(members, vectors, 24, least=12).collect())) == sorted(tuple(r) for r in d.values() if r["size"] >= 12)
    assert all(len(r.representatives) == min(6, r["size"]) and r.medoid == r.representatives[0] for r in d.values())


def test_pivot_clusters_when_neighbours_are_taken(spark):
    """A chain, in which an absorbed row is the first neighbour of another one: rounds go on."""
    a = np.deg2rad(np.arange(0, 360, 20))
    df = spark.createDataFrame([(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(a)], V)
    pivot = {r.id: r.pivot for r in simclusters.pivot_clusters(df, 2)[0].collect()}
    assert len(pivot) == 18
    p = sorted(set(pivot.values()))
    assert all(np.cos(a[x] - a[y]) < 0.7 for x in p for y in p if x != y)
    empty = simclusters.pivot_clusters(df.limit(0), 2)
    assert empty[0].count() == 0 and simclusters.isolated_cliques(*empty, 2).count() == 0


def test_disk_of_clusters_grows_with_the_rows(spark, monkeypatch):
    """Rows in many small blocks, which all meet: no stage shuffles more than a few times the rows, no shuffle file
    stays, and no link is lost between blocks, lists or passes."""
    for name, value in (("BLOCK", 64), ("SPLIT", 128), ("PART", 200), ("PASS_LEAST", 1), ("COUNTED", 300)):
        monkeypatch.setattr(lists, name, value, raising=False)
    r = np.random.default_rng(8)
    rows = np.concatenate([r.normal(size=(600, 64)), np.repeat(r.normal(size=(80, 64)), 8, axis=0) + 0.3 * r.normal(size=(640, 64))])
    x = np.concatenate([rows, r.normal(size=64) + 0.1 * r.normal(size=(150, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], V).repartition(3)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    before = stages()
    members, around = simclusters.pivot_clusters(df, 64)
    most = max(v for k, v in stages().items() if k not in before)
    assert most < 4 * x.nbytes
    u = lists.unit64(x)
    near = u @ u.T >= 0.7
    assert {r.id: r.n for r in around.collect()} == dict(enumerate(near.sum(axis=1).tolist()))
    rank = simclusters._rank(np.arange(len(x)))
    assert {r.id: r.pivot for r in around.collect()} == {i: int(min(np.flatnonzero(near[i]), key=lambda j: rank[j])) for i in range(len(x))}
    pivot = {r.id: r.pivot for r in members.collect()}
    pivots, s = sorted(set(pivot.values())), u @ u.T
    assert set(pivot) == set(range(len(x))) and all(s[i, p] >= max(s[i, q] for q in pivots) - 1e-6 for i, p in pivot.items())
    had = files()
    durable(df.groupBy("id").count(), drop_shuffles=True)
    time.sleep(1)
    assert files() <= had


def test_links_are_found_from_both_ends(spark, monkeypatch):
    """A row between two far groups is linked to a row of each; whatever the centroids, no link is missed."""
    r = np.random.default_rng(3)
    axis = np.eye(24)
    rows = [axis[g] + 0.02 * r.normal(size=24) for g in (0, 1) for _ in range(14)]
    rows[0], rows[14] = axis[0], axis[1]
    rows += [axis[0] + axis[1]]
    rows += [axis[2] + axis[k] * w for k in range(3, 20) for w in (0.5, 0.9, -1.1)]
    x = np.asarray(rows, np.float32)
    u = lists.unit64(x)
    near = u @ u.T >= 0.7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], V).repartition(3)
    monkeypatch.setattr(lists, "fit", lambda *_: spark.sparkContext.broadcast(np.eye(3, 24, dtype=np.float32)))
    members, around = simclusters.pivot_clusters(df, 24)
    assert {r.id: r.n for r in around.collect()} == dict(enumerate(near.sum(axis=1).tolist()))
    assert near[28, 0] and near[28, 14] and simclusters.isolated_cliques(members, around, 12).count() == 0
    pivot = {r.id: r.pivot for r in members.collect()}
    pivots = sorted(set(pivot.values()))
    s = u @ u.T
    assert not near[np.ix_(pivots, pivots)][~np.eye(len(pivots), dtype=bool)].any()
    assert all(s[i, p] >= max(s[i, q] for q in pivots) - 1e-6 for i, p in pivot.items())


# 4. near-duplicates


def jaccard_groups(texts, k, t, least):
    sets = {}
    for i, x in texts:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if len(w) >= least:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return groups_of((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12)


@pytest.mark.parametrize(("k", "t", "seed", "stars", "block"), [(3, 0.5, 1, True, 8192), (5, 0.8, 2, True, 20), (2, 0.5, 3, False, 8192), (3, 0.5, 4, False, 15), (2, 0.5, 5, None, 15)])
def test_near_duplicates(spark, monkeypatch, k, t, seed, stars, block):
    """With and without stars, with token lists whole and cut into blocks."""
    monkeypatch.setattr(neardup, "LIST_BLOCK", block)
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts, n = [], 0

    def add(w):
        nonlocal n
        n += 7
        texts.append((n, " ".join(w)))

    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randrange(18, 90))]
        add(base)
        for edits in (1, 3, 6, 9, 12):
            w = list(base)
            for _ in range(edits):
                j = r.randrange(len(w))
                w[j : j + 1] = r.choice([[], [r.choice(vocab)], [w[j], r.choice(vocab)]])
            add(w)
    hot = [r.choice(vocab) for _ in range(60)]
    for _ in range(60):  # copies, and many variants of one text
        add(hot)
        w = list(hot)
        for _ in range(4):
            w[r.randrange(60)] = r.choice(vocab)
        add(w)
    add([r.choice(vocab) for _ in range(5000)])
    texts += [(2, None), (3, ""), (4, " \n"), (5, "only a few words"), (6, "Häuser! ÄPFEL, 2½ " * 12), (8, "häuser äpfel 2½ " * 12)]
    df = spark.createDataFrame(texts, "id long, text string").withColumns({"rep": F.lit(1), "comp": F.lit(2), "size": F.lit(3)}).repartition(4)
    got = {(x.group_id, x.id) for x in neardup.near_duplicates(df, k, t, 20, stars).collect()}
    assert got == jaccard_groups(texts, k, t, 20)


def test_a_hot_token_is_spread_over_buckets():
    """30,000 records share the token; its blocks meet each other once, evenly over the buckets, and no pair is lost."""
    ids = np.arange(30_000) * 20
    h = np.full(len(ids), 12345, np.uint64)
    at, bucket, tok, side = neardup._placed(h, ids, np.full(len(ids), 30_000), 100_003)
    places = Counter(zip(bucket.tolist(), tok.tolist()))
    blocks = -(-30_000 // neardup.LIST_BLOCK)
    assert len(places) == blocks * (blocks + 1) // 2 and max(places.values()) < 2.1 * sorted(places.values())[len(places) // 2]
    two = (tok & 1).astype(bool)
    pairs = sum(n * (n - 1) // 2 for k, n in Counter(tok[~two].tolist()).items()) + sum(Counter(tok[two & (side == 0)].tolist())[k] * n for k, n in Counter(tok[two & (side == 1)].tolist()).items())
    assert pairs == 30_000 * 29_999 // 2


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert neardup.near_duplicates(df, 3, 0.5, 20).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string"), 3, 0.5, 20).count() == 0


# 6. leaks


def shared_runs(docs, items, n=12):
    norm = lambda t: re.findall(r"[^\W_]+", re.sub("<[^>]*>", " ", t or "").lower())
    grams = lambda t: {tuple(w[j : j + n]) for w in [norm(t)] for j in range(len(w) - n + 1)}
    d, i = {k: grams(t) for k, t in docs}, {k: grams(t) for k, t in items}
    return {(a, b) for a in d for b in i if d[a] & i[b]}


def test_leaks(spark, monkeypatch):
    r = random.Random(4)
    vocab = ["the", "of", "a", "crane", "löwe", "x1", "paradox", "mirror", "in", "guards", "日本", "notebook", "was", "slow"]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(r.randrange(12, 50)))) for i in range(30)] + [(90, None), (91, "too short"), (92, "")]
    docs = [(1000, None), (1001, ""), (1002, " ".join(text(30000)))]
    for d in range(120):
        w = text(r.randrange(0, 80))
        src = items[r.randrange(30)][1].split()
        cut = r.randrange(0, max(1, len(src) - 12))
        part = src[cut : cut + r.choice([11, 12, 13, 30])]
        docs.append((d, " ".join(w) + r.choice([" ", " <b>", "\n- "]) + r.choice([", ", " "]).join(part).upper() + r.choice([" ", ". ", "y "]) + " ".join(text(20))))
    df = spark.createDataFrame(docs + docs[5:9], "doc_id long, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, item_text string")
    got = leaks.leaked(df, it).collect()
    assert len(got) == len({(x.doc_id, x.item_id) for x in got})
    assert {(x.doc_id, x.item_id) for x in got if x.exact_words >= 12} == shared_runs(docs, items)
    assert leaks.leaked(df.limit(0), it).count() == 0
    assert leaks.leaked(df, it.limit(0)).count() == 0
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 300)
    assert sorted(map(tuple, leaks.leaked(df, it).collect())) == sorted(map(tuple, got))
    assert leaks.leaked(df, it.where("item_id > 89")).count() == 0


def test_leaks_with_edits_and_in_blocks(spark, monkeypatch):
    item = "after nine days the keeper has marked only sixty of the promised ropes while another still claims boredom"
    docs = [(1, "x " + item.replace("keeper", "keepr")), (2, item.replace("promised", "pr0mised").replace("sixty", "sixtyy")), (3, item.replace("keeper has marked only", "gardener had painted all")), (4, "unrelated")]
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 60)
    got = {x.doc_id: (x.words, x.edits) for x in leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, "some other item with quite a few words of its own to be cut into blocks")], "item_id long, item_text string")).collect()}
    assert got[1] == (18, 1) and got[2] == (18, 2) and 4 not in got


def runs_with_edits(doc, item, n, edits):
    """(words, edits) of the longest run of at least n item words that whole words of the document match within the edits."""
    w, best = item.split(), (0, 0)
    starts = [j == 0 or doc[j - 1] == " " for j in range(len(doc))] + [False]
    for a in range(len(w)):
        row, done = [0 if s else 99 for s in starts], 0
        text = " ".join(w[a:])
        for i, ch in enumerate(text, 1):
            new = [row[0] + 1]
            for j in range(1, len(doc) + 1):
                new.append(min(row[j - 1] + (ch != doc[j - 1]), row[j] + 1, new[-1] + 1))
            row = new
            if i == len(text) or text[i] == " ":
                done += 1
                e = min(v for j, v in enumerate(row) if j == len(doc) or doc[j] == " ")
                if done >= n and e <= edits:
                    best = max(best, (done, -e))
    return best


def test_leaks_of_short_words(spark):
    """The edits may leave only seven exact characters in a row."""
    item = "a b c d e f g h i j k l"
    docs = ["x " + item[:8] + "z" + item[9:15] + "y" + item[16:], item, "a b c", "zz " + item.replace("e", "").replace("  ", " ") + " q", " ".join(item.replace(" ", "")[::-1])]
    got = {x.doc_id: (x.words, -x.edits) for x in leaks.leaked(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, item_text string")).collect()}
    assert got == {k: v for k, t in enumerate(docs) if (v := runs_with_edits(t, item, 12, 2))[0]} and {0, 1, 3} <= set(got)


@pytest.mark.parametrize("block", [4_000_000, 90])
def test_leaks_with_edits_anywhere(spark, monkeypatch, block):
    """Items broadcast, and in blocks by a shuffle."""
    monkeypatch.setattr(leaks, "ITEM_BLOCK", block)
    r = random.Random(6)
    item = "after nine days the keeper has marked only sixty of the promised"
    more = item + " ropes while another still claims boredom or worse"
    docs = ["x aftr nine" + item[10:] + " y", item[:-1] + " then", "so " + item.replace("promised", "promixed") + " it was", "a b fter nine" + item[10:-2] + "d gone", "xx after nine days"]
    for _ in range(60):
        w = more.split()
        a = r.randrange(0, 8)
        t = list(" ".join(w[a : a + r.choice([11, 12, 12, 13, 14])]))
        for _ in range(r.randrange(0, 4)):
            at = r.choice([r.randrange(len(t)), r.randrange(3), len(t) - 1 - r.randrange(3)])
            t[at : at + 1] = r.choice([[], ["z"], [t[at], "q"]])
        docs.append(" ".join(["u vv", "".join(t).strip(), "k mm"]))
    docs = [" ".join(d.split()) for d in docs]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(x.doc_id, x.item_id): (x.words, -x.edits) for x in leaks.leaked(df, spark.createDataFrame([(1, item), (2, more)], "item_id long, item_text string")).collect()}
    want = {(d, k): v for d, t in enumerate(docs) for k, i in ((1, item), (2, more)) if (v := runs_with_edits(t, i, 12, 2))[0]}
    assert {(0, 1), (1, 1), (2, 1), (3, 1)} <= set(want)
    assert got == want


# 7. mixing


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello, world"), (2, None), (3, ""), (4, "日本 <|endoftext|>")], "id long, text string")
    got = {r.id: r.tokens for r in tokens.with_token_counts(df).collect()}
    enc = tokens.encoder()
    assert got == {1: len(enc.encode_ordinary("Hello, world")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("日本 <|endoftext|>"))}


def test_mix(spark):
    r = random.Random(9)
    rows = []
    for i in range(3000):
        s = r.choice(["big", "Big ", "mid-size", "small", None]) if i % 3 else "big"
        rows.append((i, "word " * r.randrange(0, 40), r.choice(["en", "EN", "de-DE", None, "xx"]), s, r.choice(["article", "chat", None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, doc_kind string").withColumn("known", F.lit(1))
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid_size", 0.3, 5), ("small", 0.3, 1), ("gone", 0.0, 3)], "source string, target_share double, max_uses int")
    plan = {x.source: x for x in mixing.mix_plan(docs, targets).collect()}
    total = sum(max(0, len(tokens.encoder().encode_ordinary(x[1]))) for x in rows)
    assert plan["small"].short and not plan["big"].short and not plan["mid_size"].short and not plan["gone"].short
    assert plan["big"].expected_tokens == pytest.approx(0.4 * total, rel=1e-6)
    assert plan["mid_size"].expected_tokens == pytest.approx(0.3 * total, rel=1e-6)
    assert plan["small"].expected_tokens == pytest.approx(plan["small"].tokens, rel=1e-6)
    assert all(p.max_expected_uses <= p.max_uses + 1e-9 for p in plan.values())
    rep = {x.source: x for x in mixing.mix_report(docs, targets).collect()}
    assert all(rep[s].max_row_uses <= plan[s].max_uses for s in rep)
    for x in ("big", "mid_size", "small"):
        assert rep[x].tokens == pytest.approx(plan[x].expected_tokens, rel=0.01)
    shares = {"lang": {"de": 0.5, "zz": 0.1}, "topic": {"chat": 0.6}}
    table = mixing.cells(mixing.token_sizes(docs), targets).toPandas()
    loose = targets.toPandas().assign(max_uses=50)
    fit, wide = mixing.rake(table, loose, shares)
    got = fit.assign(t=fit.uses * fit.tokens)
    assert got.groupby("topic").t.sum()["chat"] / got.t.sum() == pytest.approx(0.6, abs=0.01) and got.groupby("lang").t.sum()["de"] / got.t.sum() == pytest.approx(0.5, abs=0.06)
    assert not wide.short.any() and len(mixing.levels(docs, most=2)["lang"]) == 2
    assert sum(x.share for x in rep.values()) == pytest.approx(1)
    assert sorted(map(tuple, mixing.mix_uses(docs, targets).collect())) == sorted(map(tuple, mixing.mix_uses(docs.repartition(7), targets).collect()))
    holes = targets.unionByName(spark.createDataFrame([(None, 0.5, 1), ("void", None, None)], targets.schema))
    assert {x.source: x.short for x in mixing.mix_plan(docs, holes).collect()} == {s: p.short for s, p in plan.items()} | {"void": False}
    empty = mixing.mix_report(docs.limit(0), targets).collect()
    assert len(empty) == 4 and all(x.tokens == 0 and x.share == 0 for x in empty)


# 8. splitting


def test_doubled_cuts_are_the_greedy_ones():
    r = random.Random(2)
    for _ in range(50):
        n = r.randrange(2, 60)
        succ = np.array([min(n - 1, i + r.randrange(1, 6)) for i in range(n)])
        want, i = {0}, 0
        while succ[i] != i:
            i = int(succ[i])
            want.add(i)
        assert set(np.flatnonzero(splitting.doubled_cuts(succ, np.array([0])))) == want


def test_split(spark):
    r = random.Random(6)
    word = lambda: r.choice(["alpha", "Beta", "crane", "ÖL", "鍵は", "😀", "x-1", "  ", "don't"])
    layouts = ["\n\n", ". ", "\n", " ", "\r\n", "\nAsker: ", "", "。", "\n# Head\n"]
    docs = [(i, "".join(word() + (r.choice(["", " "])) + (sep if r.random() < 0.2 else " " if sep else "") for _ in range(n))) for i, (sep, n) in enumerate((s, n) for s in layouts for n in (50, 900, 2500))]
    docs += [(100, None), (101, ""), (102, "a" * 9000), (103, "\n" * 7000), (104, "word " * 1500), (105, "word" + " word" * 1499), (106, "日" * 4000), (107, "😀" * 3000), (108, " " * 20000 + "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"piece": F.lit(1), "tokens": F.lit(2)}).repartition(4)
    enc = tokens.encoder()
    got = defaultdict(list)
    for x in splitting.split_texts(df).orderBy("doc_id", "piece").collect():
        got[x.doc_id].append(x)
    text = dict(docs)
    assert set(got) == {i for i, t in docs if t and len(enc.encode_ordinary(t)) > 1500}
    for i, pieces in got.items():
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.tokens == len(enc.encode_ordinary(p.text)) <= 1500 for p in pieces)
        whole, end = text[i], 0
        own = np.cumsum([0, *tokens.token_bytes()[enc.encode_ordinary(whole)]])
        raw = whole.encode()
        for k, p in enumerate(pieces):  # each begins with the last 100 tokens of the one before
            b = p.text.encode()
            if k:
                cut = int(np.searchsorted(own, end))
                start = int(own[cut - 100])
                while raw[start] & 0xC0 == 0x80:
                    start -= 1
                    start = int(own[np.searchsorted(own, start, "right") - 1])
                assert raw[start : start + len(b)] == b, (i, k)
                end = start + len(b)
            else:
                assert raw.startswith(b)
                end = len(b)
        assert end == len(raw)


def test_natural_boundaries_are_used(spark):
    para = " ".join(["word"] * 180) + ".\n\n"
    df = spark.createDataFrame([(1, para * 20)], "doc_id long, text string")
    pieces = splitting.split_texts(df).orderBy("piece").collect()
    assert all(p.text.endswith("\n\n") for p in pieces)
    assert splitting.split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, limit=100, overlap=60)

"""Problem 6: held-out test items in a corpus, by the q-gram lemma."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.exprs import words_text

Q, WORDS, EDITS = 8, 12, 2
#: Characters of items held by a task at once and broadcast; more items are cut into blocks of this size, which meet
#: the documents in a shuffle.
ITEM_BLOCK = 4_000_000
#: Characters of documents taken at once.
TEXT_BLOCK = 3_000_000
FILTER_BITS = MARK_BITS = 22
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def normal(c):
    """Tags replaced by a blank, then the lower-cased words joined by single blanks."""
    return words_text(F.regexp_replace(c, "<[^>]*>", " "))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def qgram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters from each position, by doubling: of 1, 2, 4, ... characters, put together to q."""
    h, size, out, done = c.astype(np.uint64) * np.uint64(_ODD[0]), 1, None, 0
    for k in range(1, q.bit_length() + 1):
        if q & size:
            part = h[done : len(h) if done + size == q or not done else None]
            out = h if out is None else out[: len(part)] * np.uint64(_ODD[(k + 1) % 4]) + (part[: len(out)] ^ (part[: len(out)] >> np.uint64(27)))
            done += size
        if done == q:
            break
        h = (h[:-size] * np.uint64(_ODD[k % 4])) + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
    return out


class Lines:
    """Texts of words end to end after separators, with what an alignment asks of them at any position."""

    def __init__(self, t: np.ndarray, h: np.ndarray, q: int):
        #: ``h``: a hash of the q characters from each position
        self.t, self.h, self.q = t, h, q
        edge = (t == 32) | (t == 10)
        self.edge, self.sep, at = edge, np.flatnonzero(t == 10), np.arange(len(t), dtype=np.int32)
        before = np.concatenate([[True], edge[:-1]])
        self.blanks = np.concatenate([np.zeros(1, np.int32), np.cumsum(t == 32, dtype=np.int32)])
        #: the last end of a word not after, and the first begin of one not before, a position
        self.end = np.maximum.accumulate(np.where(edge & ~before, at, np.int32(-1)))
        self.begin = np.minimum.accumulate(np.where(~edge & before, at, np.int32(len(t)))[::-1])[::-1]

    def room(self, p: np.ndarray, step: int) -> np.ndarray:
        """Characters from position p to the separator in a direction."""
        return self.sep[np.searchsorted(self.sep, p)] - p if step > 0 else p - 1 - self.sep[np.searchsorted(self.sep, p) - 1]


class Grams:
    """Positions by hash."""

    def __init__(self, h: np.ndarray, pos: np.ndarray):
        order = np.argsort(h[pos], kind="stable")
        self.at = pos[order].astype(np.int32)
        self.hashes, first = np.unique(h[self.at], return_index=True)
        self.first = np.append(first, len(pos))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``h`` occur, as which entries)."""
        k = np.searchsorted(self.hashes, h)
        k[k == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[k] == h)
        return hit, k[hit]

    def expand(self, pos: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each position with each one of its entry."""
        times = self.first[k + 1] - self.first[k]
        p = np.repeat(pos.astype(np.int32), times)
        return p, self.at[np.repeat(self.first[k], times) + np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times)]


def _longer(h: np.ndarray, q: int, size: int) -> np.ndarray:
    """Hashes of the ``size`` >= q characters from each position, from those of the first q and the last, and of those
    every q characters between."""
    out = h[: len(h) + q - size].copy()
    for at in sorted({*range(q, size - q, q), size - q} - {0}):
        z = h[at : at + len(out)]
        out = out * np.uint64(_ODD[3]) + (z ^ (z >> np.uint64(31)))
    return out


def seed_length(least, edits: int):
    """e edits leave e + 1 exact stretches of a run, of which one has this many characters."""
    return np.maximum(1, (least - edits) // (edits + 1))


@dataclass
class Items:
    """The items of a block: their texts end to end, each after a separator, and their q-grams by hash."""

    ids: np.ndarray
    text: Lines
    #: by position of the text, the item
    own: np.ndarray
    q: int
    #: by item: least characters of a run of the words asked for; q-grams a region must share
    least: np.ndarray
    need: np.ndarray
    grams: Grams
    #: a run within the edit budget has an exact stretch of this many characters
    seed_size: int
    seeds: Grams
    #: by the highest bits of a hash: whether some q-gram, or some seed, has them
    filter: np.ndarray
    seed_filter: np.ndarray


def index_items(rows: list[tuple[int, str]], words: int, edits: int) -> Items | None:
    """None if no item has enough words. The q-gram lemma: a run of w characters that agrees up to ``edits``
    edits shares at least w - q + 1 - edits * q q-grams, on diagonals at most ``edits`` apart. q is Q, or less if the
    shortest run asked for may have no Q exact characters in a row."""
    ids, texts, least = [], [], []
    for i, t in rows:
        w = t.split(" ")
        if len(w) < words:
            continue
        size = np.concatenate([[0], np.cumsum([len(x) + 1 for x in w])])
        ids.append(i)
        texts.append(t)
        least.append(int((size[words:] - size[:-words]).min()) - 1)
    if not ids:
        return None
    least = np.asarray(least)
    size = int(seed_length(least.min(), edits))
    q = min(Q, size)
    need = np.maximum(least - q + 1 - edits * q, 1)
    text = codes("\n" + "\n".join(texts) + "\n" * Q)
    own = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    own = np.concatenate([own[:1], own, np.full(Q, own[-1])])[: len(text)]
    h = qgram_hashes(text, q)
    both = []
    for g, n in ((h, q), (_longer(h, q, size), size)):
        inside = np.convolve(text == 10, np.ones(n, np.int64))[n - 1 : n - 1 + len(g)] == 0  # none over a separator
        both.append(Grams(g, np.flatnonzero(inside)))
    tables = [np.zeros(1 << FILTER_BITS, dtype=bool) for _ in both]
    for table, grams in zip(tables, both):
        table[_slot(grams.hashes)] = True
    return Items(np.asarray(ids), Lines(text, h, q), own, q, least, need, both[0], size, both[1], *tables)


def _slot(h: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _ends(doc: Lines, text: Lines, x: np.ndarray, y: np.ndarray, step: int, edits: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(edits, document positions, item positions, which are valid) for each number of edits and diagonal: how far an
    alignment that goes from doc[x], text[y] in the direction ``step`` comes within the edits, back to where a
    word of both ends. Cells within e edits are, on each diagonal, all those up to the furthest (distances
    don't fall along a diagonal), so a band of 2 * edits + 1 furthest cells is the whole alignment."""
    rx, ry = doc.room(x, step), text.room(y, step)
    none, q = np.full(len(x), -(1 << 40)), doc.q
    o, far = (-1, -q) if step < 0 else (0, 0)
    last, out = {}, []

    def back(t, p):  # to an edge of a word
        return t.end[p] if step > 0 else t.begin[np.minimum(p, len(t.t) - 1)]

    for e in range(edits + 1):
        row = {}
        for d in range(-e, e + 1):  # n characters of the item against n + d of the document
            n = np.zeros(len(x), np.int64) if e == 0 else np.maximum(np.maximum(last.get(d, none) + 1, last.get(d + 1, none) + 1), last.get(d - 1, none))
            top = np.minimum(ry, rx - d)
            n = np.minimum(n, top)
            n[n < max(0, -d)] = none[0]
            live = np.flatnonzero((n >= 0) & (n + q <= top))
            while len(live):  # q characters at a time by their hashes, then one at a time
                same = doc.h[x[live] + step * (n[live] + d) + far] == text.h[y[live] + step * n[live] + far]
                live = live[same]
                n[live] += q
                live = live[n[live] + q <= top[live]]
            live = np.flatnonzero((n >= 0) & (n < top))
            while len(live):
                same = doc.t[x[live] + step * (n[live] + d) + o] == text.t[y[live] + step * n[live] + o]
                live = live[same]
                n[live] += 1
                live = live[n[live] < top[live]]
            row[d] = n
            m = n.copy()
            live = np.flatnonzero(m >= max(0, -d))
            while len(live):  # from word to word of the one or the other, until both end there
                one = step * (back(doc, x[live] + step * (m[live] + d)) - x[live]) - d
                two = step * (back(text, y[live] + step * m[live]) - y[live])
                m[live] = np.minimum(one, two)
                live = live[(one != two) & (m[live] >= max(0, -d))]
            good = m >= max(0, -d)
            m[~good] = 0
            out.append((e, x + step * np.where(good, m + d, 0), y + step * m, good))
        last = row
    return out


def _best_run(doc: Lines, text: Lines, a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of the item in the longest run that goes through an exact stretch and is within the budget, its
    edits). To the right of any cell of the stretch an alignment costs what it does from the stretch's start,
    to the left what it does from its end, so the two sides are aligned apart and any split of the budget
    is tried; both have to meet in the stretch."""
    words, spent = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    right, left = _ends(doc, text, a, ia, 1, edits), _ends(doc, text, b, ib, -1, edits)
    for e1, u, e, ok1 in right:
        for e2, t, s, ok2 in left:
            if e1 + e2 <= edits:
                meet = np.maximum(np.maximum(s - ia, t - a), 0) <= np.minimum(np.minimum(e - ia, u - a), ib - ia)
                n = np.where(ok1 & ok2 & meet & (e > s), text.blanks[e] - text.blanks[s] + 1, 0)
                better = (n > words) | ((n == words) & (e1 + e2 < spent))
                words[better], spent[better] = n[better], e1 + e2
    return words, spent


def _whole_words(text: Lines, other: Lines, a: np.ndarray, b: np.ndarray, oa: np.ndarray, ob: np.ndarray) -> np.ndarray:
    """Words that lie wholly in text[a:b] and end there in ``other`` too, where the stretch is [oa, ob)."""
    left = text.edge[a - 1] & other.edge[oa - 1]
    right = text.edge[b] & other.edge[ob]
    inner = text.blanks[b] - text.blanks[a]  # parts between blanks, less one
    first, last = text.edge[a], text.edge[b - 1]  # the stretch itself begins or ends with a blank: no part word there
    return np.maximum(0, inner + 1 - np.where(first | ~left, 1, 0) - np.where(last | ~right, 1, 0))


def _mark(item: np.ndarray, band: np.ndarray) -> np.ndarray:
    """A slot for an item and a band of diagonals. A diagonal of an item lies in one place of the documents, so position
    needs no slot of its own. What shares a slot by chance is looked at in vain, nothing is lost."""
    key = item.astype(np.uint32) * np.uint32(0x9E3779B1) + band.astype(np.uint32) * np.uint32(0x85EBCA77)
    return ((key ^ (key >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - MARK_BITS)).astype(np.int32)


def find(doc: np.ndarray, items: Items, words: int, edits: int):
    """Matches in ``doc``, documents end to end after separators: (position, item, words in the longest
    exact run, words in the best run with up to ``edits`` edits, its edits)."""
    q, text = items.q, items.text.t
    h = qgram_hashes(doc, q)
    # a region has an exact stretch of seed_size: only q-grams near one, of its item and diagonals, go on
    longer = _longer(h, q, items.seed_size)
    seed = np.flatnonzero(items.seed_filter[_slot(longer)])
    hit, k = items.seeds.find(longer[seed])
    sp, si = items.seeds.expand(seed[hit], k)
    if not len(sp):
        return
    window, need = int(items.least.max()) + edits - q + 1, int(items.need.min())
    block = window + q
    near = np.zeros(len(doc) // block + 3, dtype=bool)
    marked = np.zeros(1 << MARK_BITS, dtype=bool)
    s_item = items.own[si]
    for side in (-1, 0, 1):
        near[sp // block + 1 + side] = True
    for e in (-edits, edits):
        marked[_mark(s_item, (sp - si + e) >> 4)] = True
    maybe = np.flatnonzero(np.repeat(near[1:], block)[: len(h)] & items.filter[_slot(h)])
    hit, at = items.grams.find(h[maybe])
    pos = maybe[hit]
    # no region of any item can be where too few q-grams of all items are near
    far = np.searchsorted(pos, pos + window, "left")
    dense = far - np.arange(len(pos)) >= need
    cover = np.zeros(len(pos) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(dense), 1)
    np.add.at(cover, far[dense], -1)
    some = np.cumsum(cover[:-1]) > 0
    p, i = items.grams.expand(pos[some], at[some])
    item = items.own[i]
    diag = p - i
    some = np.flatnonzero(marked[_mark(item, diag >> 4)])
    p, i, item, diag = p[some], i[some], item[some], diag[some]
    # overlapping bands, each 2 * (edits + 1) diagonals wide: a region's q-grams all lie in one, which has enough of them
    some = np.zeros(len(p), dtype=bool)
    for shift in (0, edits + 1):
        slot = _mark(item, (diag + shift) // (2 * (edits + 1)))
        some |= np.bincount(slot, minlength=1 << MARK_BITS)[slot] >= items.need[item]
    p, i, item, diag = p[some], i[some], item[some], diag[some]
    if not len(p):
        return
    ok = np.zeros(len(p), dtype=bool)
    for shift in (0, edits + 1):
        band = (diag + shift) // (2 * (edits + 1))
        order = np.argsort(item.astype(np.int64) * (int(band.max()) - int(band.min()) + 1) + (band - band.min()), kind="stable")  # p ascends already
        sp, sb, si = p[order], band[order], item[order]
        new = np.concatenate([[True], (sp[1:] != sp[:-1]) | (sb[1:] != sb[:-1]) | (si[1:] != si[:-1])])
        lead = np.flatnonzero(new)  # one position counts once in a band
        up, ub, ui = sp[lead], sb[lead], si[lead]
        end = np.arange(len(lead)) + items.need[ui] - 1
        inside = end < len(lead)
        e = np.minimum(end, len(lead) - 1)
        good = inside & (ub[e] == ub) & (ui[e] == ui) & (up[e] - up <= items.least[ui] + edits - q)
        cover = np.zeros(len(lead) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(good), 1)
        np.add.at(cover, e[good] + 1, -1)
        ok[order] |= (np.cumsum(cover[:-1]) > 0)[np.cumsum(new) - 1]
    p, i, item, diag = p[ok], i[ok], item[ok], diag[ok]
    if not len(p):
        return
    order = np.lexsort((p, diag, item))
    p, i, item, diag = p[order], i[order], item[order], diag[order]
    begin = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (diag[1:] != diag[:-1]) | (item[1:] != item[:-1])]))
    end = np.append(begin[1:], len(p)) - 1
    a, b, item = p[begin], p[end] + q, item[begin]  # exact stretches of the document
    ia, ib = i[begin], i[end] + q
    for step in (-1, 1):  # to their full length
        live = np.arange(len(a))
        while len(live):
            x, y = (a[live] - 1, ia[live] - 1) if step < 0 else (b[live], ib[live])
            same = (doc[x] == text[y]) & (doc[x] != 10)
            live = live[same]
            if step < 0:
                a[live] -= 1
                ia[live] -= 1
            else:
                b[live] += 1
                ib[live] += 1
    a, b, ia, ib, item = (z for z in np.unique(np.stack([a, b, ia, ib, item]), axis=1))
    lines = Lines(doc, h, q)
    exact = _whole_words(lines, items.text, a, b, ia, ib)
    # a run within the edits has a long stretch, from which it is found; shorter ones only tell exact words
    w, spent = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    long = np.flatnonzero(b - a >= seed_length(items.least[item], edits))
    w[long], spent[long] = _best_run(lines, items.text, a[long], b[long], ia[long], ib[long], edits)
    pair = item.astype(np.int64) * (len(lines.sep) + 1) + np.searchsorted(lines.sep, a)
    for k in np.flatnonzero(np.isin(pair, pair[(w >= words) | (exact >= words)])):
        yield int(a[k]), int(items.ids[item[k]]), int(exact[k]), int(w[k]), int(spent[k])


def _matches(ids: np.ndarray, t: list[str], index: Items, words: int, edits: int) -> pa.RecordBatch:
    """The matches of normal texts, a bounded number of characters at a time."""
    size = np.cumsum([len(x) + 1 for x in t])
    cut = [0, *(np.flatnonzero(np.diff(size // TEXT_BLOCK)) + 1), len(t)]
    found = []
    for a, z in zip(cut, cut[1:]):
        if a == z:
            continue
        doc = codes("\n" + "\n".join(t[a:z]) + "\n" * Q)
        start = np.cumsum([1, *[len(x) + 1 for x in t[a:z]]])
        for p, item, exact, w, e in find(doc, index, words, edits):
            found.append((int(ids[a + np.searchsorted(start, p, "right") - 1]), item, exact, w, e))
    cols = list(zip(*found)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=NAMES)


NAMES = ["doc_id", "item_id", "exact_words", "words", "edits"]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


def _in_scan(docs: DataFrame, texts: DataFrame, words: int, edits: int) -> DataFrame:
    """Matches with items of at most ITEM_BLOCK characters, which are broadcast; documents stay where they are read."""
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(index_items(sorted((r.i, r.t) for r in texts.collect()), words, edits))

    def run(batches):
        for b in batches:
            if index.value is not None:
                yield _matches(b.column(0).to_numpy(), b.column(1).to_pylist(), index.value, words, edits)

    return docs.mapInArrow(run, SCHEMA)


def _in_shuffle(docs: DataFrame, texts: DataFrame, words: int, edits: int, blocks: int, size: int) -> DataFrame:
    """Matches with any number of items. One scan of the documents keeps those that hold a seed of any item, by a
    filter of 16 bits a character of the items, 2^27 at most (16 MB), made in the executors; only they are
    sent, to each block of items. A block is held by as many tasks as there are partitions for it."""
    spark = docs.sparkSession

    def shortest(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                index = index_items([(0, t) for t in b.column(1).slice(k, 1000).to_pylist()], words, edits)
                yield pa.RecordBatch.from_arrays([pa.array([] if index is None else [int(index.least.min())], pa.int64())], names=["n"])

    least = texts.select("i", "t").mapInArrow(shortest, "n long").agg(F.min("n")).first()[0]
    if least is None:
        return spark.createDataFrame([], SCHEMA)
    seed = int(seed_length(least, edits))
    q, bits = min(Q, seed), min(27, int(16 * size).bit_length())

    def seeds(t: list[str]) -> np.ndarray:
        c = codes("\n" + "\n".join(t) + "\n" * Q)
        h = _longer(qgram_hashes(c, q), q, seed)
        return _slot(h[np.convolve(c == 10, np.ones(seed, np.int64))[seed - 1 : seed - 1 + len(h)] == 0], bits)

    def marks(batches):
        for b in batches:
            s = np.unique(seeds(b.column(1).to_pylist()))
            word, start = np.unique(s // 32, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.int64(1) << (s % 32), start) if len(s) else s)], names=["w", "v"])

    got = texts.select("i", "t").mapInArrow(marks, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    table = np.zeros((1 << max(bits, 5)) // 32, np.uint32)
    table[got.column("w").to_numpy()] = got.column("v").to_numpy().astype(np.uint32)
    table = spark.sparkContext.broadcast(table)

    def thin(batches):
        for b in batches:
            keep = []
            for t in b.column(1).to_pylist():
                s = seeds([t]) if len(t) >= seed else np.zeros(0, np.int64)
                keep.append(bool(((table.value[s // 32] >> (s % 32).astype(np.uint32)) & 1).any()))
            yield b.filter(pa.array(keep, pa.bool_()))

    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits = -(-parts // blocks)
    item_block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    own = texts.select(item_block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).alias("role"), F.col("i").alias("d"), "t")
    some = docs.mapInArrow(thin, "d long, t string")
    all_ = some.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("d"), F.lit(splits)).cast("int").alias("split"), F.lit(1).alias("role"), "d", "t")
    both = own.unionByName(all_).withColumn("part", F.col("block") * splits + F.col("split")).select("part", "role", "d", "t")

    def run(batches):
        items, index, done = [], None, False
        for b in batches:
            for role in (0, 1):
                part = b.filter(pa.array(b.column(1).to_numpy() == role))
                if not part.num_rows:
                    continue
                if role == 0:
                    items += zip(part.column(2).to_pylist(), part.column(3).to_pylist())
                    continue
                if not done:
                    index, done = index_items(sorted(items), words, edits), True
                if index is not None:
                    yield _matches(part.column(2).to_numpy(), part.column(3).to_pylist(), index, words, edits)

    return both.repartitionById(blocks * splits, F.col("part")).sortWithinPartitions("part", "role").mapInArrow(run, SCHEMA)


def leaked(documents: DataFrame, items: DataFrame, words: int = WORDS, edits: int = EDITS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id, exact_words, words, edits): documents that hold at least ``words`` consecutive words
    of an item, exactly or with up to ``edits`` character edits (inserted, deleted or changed).

    exact_words: the longest run of words in common, if it has at least ``words``, else of those near the match; words
    and edits: of the longest stretch within the edit budget, in words of the item. Every character of every text is looked at. Null and empty texts and items of
    under ``words`` words match nothing; equal items are each reported; repeated rows of a document count once.
    Items of at most ITEM_BLOCK characters are broadcast and only matches are shuffled; more of them are taken in
    blocks by a hash of their id, which the documents that hold a piece of any item meet in a shuffle. Either
    way the documents are read once.
    """
    texts = items.select(F.col(item_id).cast("long").alias("i"), normal(F.col(item_text)).alias("t")).where(F.col("i").isNotNull())
    size = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    docs = documents.select(F.col(doc_id).cast("long").alias("d"), normal(F.col(text)).alias("t")).where(F.col("d").isNotNull())
    blocks = -(-size // ITEM_BLOCK)
    out = _in_scan(docs, texts, words, edits) if blocks <= 1 else _in_shuffle(docs, texts, words, edits, blocks, size)
    best = F.max(F.struct("words", (-F.col("edits")).alias("kept")))
    return out.groupBy("doc_id", "item_id").agg(F.max("exact_words").cast("int").alias("exact_words"), best["words"].cast("int").alias("words"), (-best["kept"]).cast("int").alias("edits"))

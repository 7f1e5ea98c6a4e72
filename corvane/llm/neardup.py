"""Problem 4: groups of near-duplicate texts, by prefix filters under several global token orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.exprs import words_text
from corvane.llm.leaks import codes
from corvane.llm.lists import mix64
from corvane.operators.components import connected_components
from corvane.operators.skew import join_skewed
from corvane.sources.durable import durable, release

#: Token orders; a pair has to share a prefix token under each.
ORDERS = 3
#: Sets of three hash orders; records that agree in the first tokens of all three are held against one of them.
STARS = 8
#: Records that may share their first tokens before stars are made.
CROWD = 64
#: Counters of the token frequency sketch. Its size doesn't depend on the corpus. It only ranks tokens, so
#: tokens that share a counter cost time, never a result.
SKETCH = 1 << 20
#: Words of 64 bits in a record's parity bitmap.
PARITY = 6
#: Tokens held by a task at once.
BUCKET = 1_000_000
#: Records of a token's list that are paired in one place. A longer list is cut into blocks of about as many, and each
#: two blocks meet in a bucket of their own, so no token is one task's work.
LIST_BLOCK = 8192
#: Tokens of pairs verified at once.
VERIFIED = 2_000_000
HASH_BYTES = 6
_ENTRY = np.dtype([("t", "<u4"), ("s", "u1"), ("p", "<u2", (ORDERS,))])


def shingles(texts: list[str], words: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, hash) of the distinct runs of ``words`` words, sorted by record and hash, and which records
    have at least ``least`` words. Texts are words joined by single blanks. Hashes have 48 bits."""
    c = codes("\n".join(texts) + "\n")
    end = np.flatnonzero((c == 32) | (c == 10))
    start = np.concatenate([[0], end[:-1] + 1])
    length = end - start
    power = np.cumprod(np.full(int(length.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    offset = np.arange(len(c)) - np.repeat(start, length + 1)
    value = mix64(c) * power[offset]
    value[end] = 0
    word = mix64(np.add.reduceat(value, start)) if len(start) else np.zeros(0, np.uint64)
    record = np.cumsum(c[end] == 10) - (c[end] == 10)
    count = np.bincount(record[length > 0], minlength=len(texts))
    ok = np.arange(len(word)) + words <= len(word)
    h, same = np.zeros(len(word), np.uint64), ok.copy()
    for k in range(words):
        at = np.minimum(np.arange(len(word)) + k, max(len(word) - 1, 0))
        same &= record[at] == record
        h += word[at] * np.uint64((0xC2B2AE3D27D4EB4F * (2 * k + 1)) & (2**64 - 1))
    same &= count[record] >= least
    h = mix64(h[same], 5) >> np.uint64(64 - 8 * HASH_BYTES)
    r = record[same]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
    return r[new], h[new], count >= least


def _pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :HASH_BYTES] = b
    return out.view("<u8").ravel()


def shingle_sets(texts: DataFrame, words: int, least: int) -> DataFrame:
    """(id, size, s): the packed shingle set of each of ``texts`` (id, t) with at least ``least`` words."""
    names = ["id", "size", "s"]

    def run(batches):
        for b in _slices(batches, 1000):
            r, h, _ = shingles(b.column(1).to_pylist(), words, least)
            own, begin = np.unique(r, return_index=True)
            sizes = np.diff([*begin, len(r)])
            raw = _pack(h)
            cut = [*(begin * HASH_BYTES), len(raw)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(sizes, pa.int32()), pa.array([raw[a:z] for a, z in zip(cut, cut[1:])], pa.binary())], names=names)

    return texts.select("id", "t").mapInArrow(run, "id long, size int, s binary")


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """How many records hold a token of each counter. Each task sums its own counters; a shuffle of at most
    4 MB a task adds them up; 4 MB come back, however large the corpus."""
    width = 1024

    def count(batches):
        n = np.zeros(SKETCH, np.int64)
        for b in batches:
            h = _unpack(b"".join(b.column(0).to_pylist()))
            n += np.bincount((mix64(h, 9) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        yield _slots(np.arange(SKETCH // width), n.reshape(-1, width))

    def _slots(slot, n):
        return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(list(n), pa.list_(pa.int64()))], names=["slot", "n"])

    def add(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            n = b.column(1).flatten().to_numpy().reshape(-1, width)
            for k, s in enumerate(b.column(0).to_pylist()):
                acc[s] = acc[s] + n[k] if s in acc else n[k].copy()
        if acc:
            yield _slots(np.asarray(list(acc)), np.stack(list(acc.values())))

    rows = sets.select("s").mapInArrow(count, "slot int, n array<long>").repartition("slot").mapInArrow(add, "slot int, n array<long>").toArrow()
    out = np.zeros((SKETCH // width, width), np.int64)
    if rows.num_rows:
        out[rows.column("slot").to_numpy()] = rows.column("n").combine_chunks().flatten().to_numpy().reshape(-1, width)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def positions(h: np.ndarray, begin: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """For each token of each record (records lie end to end from ``begin``) its place in the record under
    every order. All orders put rarer tokens first, by the power of two of their frequency, and differ in
    the order within a power; each is one order of all tokens, the same in every record."""
    rare = np.log2(np.maximum(sketch[(mix64(h, 9) % np.uint64(SKETCH)).astype(np.int64)], 1)).astype(np.uint64)
    size = np.diff([*begin, len(h)])
    place = np.arange(len(h)) - np.repeat(begin, size)
    out = np.empty((ORDERS, len(h)), np.int32)
    for a in range(0, len(begin), 1 << 14):  # record, power and 45 bits of the hash in one number to sort by
        z = min(a + (1 << 14), len(begin))
        part = slice(begin[a], begin[z] if z < len(begin) else len(h))
        head = (np.repeat(np.arange(z - a, dtype=np.uint64), size[a:z]) << np.uint64(50)) | (rare[part] << np.uint64(45))
        for k in range(ORDERS):
            # stable: equal bits keep the order of the tokens' own hashes, which is the same in every record
            order = np.argsort(head | (mix64(h[part], 20 + k) >> np.uint64(19)), kind="stable")
            out[k, part][order] = place[part]
    return out


def parity(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A bitmap a record in which bit b says whether an odd number of its tokens have the value b. Two of
    them differ in at most as many bits as their sets differ in tokens."""
    bit = (mix64(h, 30) % np.uint64(64 * PARITY)).astype(np.int64)
    out = np.zeros((len(begin), PARITY), np.uint64)
    for w in range(PARITY):
        v = np.where(bit // 64 == w, np.uint64(1) << (bit % 64).astype(np.uint64), np.uint64(0))
        out[:, w] = np.bitwise_xor.reduceat(v, begin) if len(h) else 0
    return out


class Bounds:
    """What a similarity of at least t asks of two sets of a and b tokens."""

    def __init__(self, t: float):
        self.t = t

    def overlap(self, a, b):
        return np.ceil(self.t / (1 + self.t) * (a + b) - 1e-9)

    def differ(self, a, b):
        return np.floor((1 - self.t) / (1 + self.t) * (a + b) + 1e-9)

    def prefix(self, n):
        """Tokens of the longest prefix that any partner needs."""
        return (n - np.ceil(self.t * n - 1e-9) + 1).astype(np.int64)


def _slices(batches, rows: int = 2000):
    """Batches small enough that a task's arrays stay small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _read(b: pa.RecordBatch):
    size = b.column("size").to_numpy().astype(np.int64)
    return size, np.concatenate([[0], np.cumsum(size)[:-1]]), _unpack(b"".join(b.column("s").to_pylist()))


def head_rows(sets: DataFrame, stars: int = STARS) -> DataFrame:
    """(head, id): each record under its first tokens of three orders by hash, for ``stars`` sets of orders."""

    def run(batches):
        for b in _slices(batches):
            _, begin, h = _read(b)
            ids = b.column("id").to_numpy()
            for k in range(stars):
                first, second, third = (np.minimum.reduceat(mix64(h, 50 + 3 * k + j), begin) for j in range(3))
                head = mix64(first ^ mix64(second, 1) ^ mix64(third, 2), 90 + k).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(ids)], names=["head", "id"])

    return sets.mapInArrow(run, "head long, id long")


def _star_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each record with the one of smallest id under the same head: at most STARS pairs a record,
    however many share a head."""
    first = rows.groupBy("head").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("head", "a")
    return join_skewed(rows, first, "head").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def _placed(h: np.ndarray, ids: np.ndarray, n: np.ndarray, buckets: int, block: int = LIST_BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which entry, bucket, token, side): where each token of a record is paired. ``n``: about how many records hold
    it. The entries of a token with B > 1 blocks go to the places (i, j), i <= j, of their own block and each one;
    in a place of two blocks side tells which, else it is 0. The lowest bit of a token marks places of two
    blocks."""
    blocks = np.maximum(1, -(-n // block))
    own = (mix64(ids, 41) % blocks.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(h)), blocks)
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    i, j, two = np.minimum(own[at], other), np.maximum(own[at], other), own[at] != other
    mixed = mix64(h[at] + mix64(i * (1 << 31) + j, 42) * (blocks[at] > 1), 40)
    token = ((mixed & np.uint64(0xFFFFFFFE)) | two).astype(np.uint32)
    return at, ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), token, (two & (own[at] == j)).astype(np.uint8)


def token_rows(sets: DataFrame, sketch, buckets: int, bounds: Bounds) -> DataFrame:
    """(bucket, id, comp, size, bits, tokens): a record's prefix tokens of any order, once for each bucket of
    the token's hash, as entries of the token, its side (see ``_placed``) and 16 bits of each place."""
    names, block = ["bucket", "id", "comp", "size", "bits", "tokens"], LIST_BLOCK

    def run(batches):
        for b in _slices(batches):
            size, begin, h = _read(b)
            pos, bits = positions(h, begin, sketch.value), parity(h, begin)
            rec = np.repeat(np.arange(len(size)), size)
            use = np.flatnonzero(pos.min(axis=0) < bounds.prefix(size)[rec])
            n = sketch.value[(mix64(h[use], 9) % np.uint64(SKETCH)).astype(np.int64)]
            at, bucket, tok, side = _placed(h[use], b.column("id").to_numpy()[rec[use]], n, buckets, block)
            r = rec[use][at]
            order = np.lexsort((bucket, r))
            bucket, tok, side, r, p = bucket[order], tok[order], side[order], r[order], pos[:, use[at[order]]]
            start = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (r[1:] != r[:-1])]))
            entry = np.empty(len(tok), dtype=_ENTRY)
            entry["t"], entry["s"], entry["p"] = tok, side, np.minimum(p, 65535).T
            raw, width = entry.tobytes(), _ENTRY.itemsize
            cut = [*(start * width), len(raw)]
            own = r[start]
            mine = [x.tobytes() for x in bits]
            for k in range(0, len(start), 8192):
                o, c = own[k : k + 8192], cut[k : k + 8193]
                arrays = [pa.array(bucket[start[k : k + 8192]]), b.column("id").take(pa.array(o)), b.column("comp").take(pa.array(o)), pa.array(size[o].astype(np.int32)), pa.array([mine[i] for i in o], pa.binary()), pa.array([raw[a:z] for a, z in zip(c, c[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return sets.mapInArrow(run, "bucket int, id long, comp long, size int, bits binary, tokens binary")


def _partners(tok: np.ndarray, side: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, hole, width, n): the entries, sorted by token, side and component, with which each one is paired: n
    from ``first`` on, without ``width`` from ``hole`` on. In places of one block those of later components, in
    places of two those of the other side, but for the own component."""
    new_tok = np.concatenate([[True], tok[1:] != tok[:-1]])
    new_side = new_tok | np.concatenate([[True], side[1:] != side[:-1]])
    new_comp = new_side | np.concatenate([[True], comp[1:] != comp[:-1]])
    after = lambda new: np.append(np.flatnonzero(new)[1:], len(tok))[np.cumsum(new) - 1]
    end, other = after(new_tok), after(new_side)
    two, front = (tok & 1).astype(bool), side == 0
    first = np.where(two, np.where(front, other, end), after(new_comp))
    hole, width = np.full(len(tok), len(tok)), np.zeros(len(tok), np.int64)
    f, g = np.flatnonzero(two & front), np.flatnonzero(two & ~front)
    if len(f) and len(g):
        place = np.unique(comp, return_inverse=True)[1]
        key = (np.cumsum(new_tok) - 1) * (int(place.max()) + 1) + place
        a, z = np.searchsorted(key[g], key[f], "left"), np.searchsorted(key[g], key[f], "right")
        hole[f], width[f] = np.where(z > a, g[np.minimum(a, len(g) - 1)], len(tok)), z - a
    return first, hole, width, np.maximum(end - first, 0) - width


def bucket_pairs(t: pa.Table, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, orders) of a bucket: pairs of records of different components that share a token, with the
    orders under which it lies in both prefixes, one bit each. Pairs whose sizes or bitmaps rule the
    similarity out are left. Lists are walked in steps that take all tokens at once; records of one
    component under a token are never paired with each other."""
    ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
    size = t.column("size").to_numpy().astype(np.int64)
    bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, PARITY)
    raw = t.column("tokens").to_pylist()
    entry = np.frombuffer(b"".join(raw), dtype=_ENTRY)
    row = np.repeat(np.arange(len(ids)), [len(x) // _ENTRY.itemsize for x in raw])
    # only tokens with two records at least
    _, inverse, n = np.unique(entry["t"], return_inverse=True, return_counts=True)
    keep = n[inverse] > 1
    tok, side, pos, row = entry["t"][keep], entry["s"][keep], entry["p"][keep].astype(np.int64), row[keep]
    order = np.lexsort((row, comp[row], side, tok))
    tok, side, pos, row = tok[order], side[order], pos[order], row[order]
    if not len(tok):
        return (np.zeros(0, np.int64),) * 3
    first, hole, width, n = _partners(tok, side, comp[row])
    live = np.flatnonzero(n > 0)
    sizes = size[row]
    found: list[np.ndarray] = []
    pending = 0

    def fold():
        nonlocal found, pending
        if len(found) > 0:
            all_ = np.concatenate(found, axis=1)
            key, inv = np.unique(all_[0] * len(ids) + all_[1], return_inverse=True)
            mask = np.zeros(len(key), np.int64)
            np.bitwise_or.at(mask, inv, all_[2])
            found = [np.stack([key // len(ids), key % len(ids), mask])]
            pending = 0

    step = 0
    while len(live):
        for part in range(0, len(live), 1 << 18):
            i = live[part : part + (1 << 18)]
            j = first[i] + step
            j = np.where(j >= hole[i], j + width[i], j)
            a, b = sizes[i], sizes[j]
            total = a + b
            need = np.ceil(bounds.t / (1 + bounds.t) * total - 1e-9).astype(np.int64)
            mask = np.zeros(len(i), np.int64)
            for k in range(ORDERS):
                mask |= ((pos[i, k] <= a - need) & (pos[j, k] <= b - need)).astype(np.int64) << k
            ok = (mask > 0) & (np.minimum(a, b) >= bounds.t * np.maximum(a, b) - 1e-9)
            i, j, mask, total = i[ok], j[ok], mask[ok], total[ok]
            apart = np.bitwise_count(bits[row[i]] ^ bits[row[j]]).sum(axis=1)
            ok = apart <= np.floor((1 - bounds.t) / (1 + bounds.t) * total + 1e-9)
            if ok.any():
                x, y = row[i[ok]], row[j[ok]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y), mask[ok]]))
                pending += int(ok.sum())
                if pending > 2_000_000:
                    fold()
        step += 1
        live = live[n[live] > step]
    fold()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    x, y, mask = found[0]
    return np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), mask


def candidate_pairs(sets: DataFrame, sketch, buckets: int, bounds: Bounds) -> DataFrame:
    """(a, b): pairs of records of different components that share a prefix token under every order.
    ``sets`` has also comp."""
    names = ["a", "b", "orders"]

    def run(batches):
        held, bucket = [], None

        def close():
            a, b, m = bucket_pairs(pa.Table.from_batches(held), bounds)
            for k in range(0, len(a), 50000):
                yield pa.RecordBatch.from_arrays([pa.array(z[k : k + 50000]) for z in (a, b, m)], names=names)

        for batch in batches:
            own = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)] if len(own) else [0]
            for a, z in zip(cut, cut[1:]):
                if held and own[a] != bucket:
                    yield from close()
                    held = []
                bucket = own[a]
                held.append(batch.slice(a, z - a))
        if held:
            yield from close()

    rows = token_rows(sets, sketch, buckets, bounds).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    pairs = rows.mapInArrow(run, "a long, b long, orders long")
    return pairs.groupBy("a", "b").agg(F.bit_or("orders").alias("orders")).where(F.col("orders") == (1 << ORDERS) - 1).select("a", "b")


def _bloom(ids: DataFrame, words: int = 1 << 18) -> np.ndarray:
    """Which of 64 * ``words`` bits some id sets: 2 MB, however many ids. It only thins out what is shuffled."""
    bit = F.pmod(F.xxhash64("id"), F.lit(64 * words))
    got = ids.select((bit / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {64 * words}) % 64 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(words, np.int64)
    if got.num_rows:
        out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out


def common_tokens(a: list[bytes], na: np.ndarray, b: list[bytes], nb: np.ndarray) -> np.ndarray:
    """How many tokens the two sets of each pair share: both sides' codes of (pair, token) are sorted together, where
    equal neighbours are shared tokens. At most 65,536 pairs, as a token has 48 bits."""
    pair = np.arange(len(a), dtype=np.uint64) << np.uint64(48)
    both = np.concatenate([np.repeat(pair, na) | _unpack(b"".join(a)), np.repeat(pair, nb) | _unpack(b"".join(b))])
    both.sort(kind="stable")
    shared = both[1:][both[1:] == both[:-1]]
    return np.bincount((shared >> np.uint64(48)).astype(np.int64), minlength=len(a))


def verified(pairs: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """(a, b) of ``pairs`` whose sets have at least t of their union in common, from the whole sets."""
    spark = pairs.sparkSession
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    bits = spark.sparkContext.broadcast(_bloom(ids))

    def thin(batches):
        for b in batches:
            h = b.column(3).to_numpy()
            keep = (bits.value[h // 64] >> (h % 64)) & 1 == 1
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep)) for k in range(3)], names=["id", "size", "s"])

    few = sets.select("id", "size", "s", F.pmod(F.xxhash64("id"), F.lit(64 << 18)).alias("h")).mapInArrow(thin, "id long, size int, s binary")
    # a star's centre may be in a third of the pairs
    left = join_skewed(pairs, few.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("s").alias("sa")), "a")
    both = left.join(few.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("s").alias("sb")), "b")

    def test(batches):
        for b in batches:
            size = np.cumsum(b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy())
            cut = [0, *(np.flatnonzero(np.diff(size // VERIFIED)) + 1), b.num_rows]
            for k, z in zip(cut, cut[1:]):
                part = b.slice(k, z - k)
                na, nb = (part.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
                common = common_tokens(part.column("sa").to_pylist(), na, part.column("sb").to_pylist(), nb)
                keep = pa.array(common >= bounds.t * (na + nb - common) - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(test, "a long, b long")


def near_duplicates(texts: DataFrame, words: int = 5, similarity: float = 0.8, least: int = 20, stars: bool | None = None) -> DataFrame:
    """(group_id, id) of the records of ``texts`` (id, text) in groups of two or more linked, directly or
    through others, by a Jaccard similarity of at least ``similarity`` between their sets of ``words``-word
    runs. group_id: the smallest id of the group.

    1. Equal texts fall together to the one of smallest id by a hash; from there only that one goes on.
    2. Stars: the filter of step 3 with prefixes of one token. Records whose first tokens agree under three orders
       at once, for STARS sets of orders, are held against the one of smallest id. This joins most of a large
       group with a number of pairs linear in its size. Groups come out the same with and without stars, so they
       are made only if more than CROWD records agree under the first three orders, or if ``stars`` is true.
    3. Prefix tokens of any order go to buckets by their hash; in a bucket, records of different
       components that share a token become candidates if sizes and parity bitmaps allow; a pair is kept if
       its shared tokens cover all orders. No pair of records that could be similar is left out, and no
       list is capped; long lists are cut into blocks that meet in different tasks.
    4. Candidates are verified on the whole sets; components are joined.

    Texts of under ``least`` words, null and empty ones take no part. Repeated ids count once. Texts may have
    any length. Other columns are ignored. An empty table gives no rows.
    """
    spark, bounds = texts.sparkSession, Bounds(similarity)
    words_of = texts.select(F.col("id").cast("long").alias("id"), words_text(F.col("text")).alias("t")).where(F.col("id").isNotNull() & (F.length("t") > 0))
    # texts are read and cut into words once
    base = durable(words_of.select("id", "t", F.xxhash64("t").alias("k1"), F.xxhash64("t", F.lit(1)).alias("k2")), "words")
    hashed = base.select("id", "k1", "k2")
    reps = hashed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = durable(reps, "reps")
    copies = durable(_twins(hashed, reps.where("n > 1")), "copies")
    sets = durable(shingle_sets(base.join(reps.select(F.col("rep").alias("id")), "id", "left_semi"), words, least), "sets")
    release(base, reps)
    tokens = sets.agg(F.sum("size")).first()[0] or 0
    sketch = spark.sparkContext.broadcast(frequency_sketch(sets))
    links, with_comp = None, sets.withColumn("comp", F.col("id"))
    if stars is None:
        stars = (head_rows(sets, 1).groupBy("head").count().agg(F.max("count")).first()[0] or 0) > CROWD
    if stars:
        heads = durable(head_rows(sets), "heads")
        near = durable(_star_pairs(heads), "stars")
        links = durable(verified(near, sets, bounds), "links")
        release(heads, near)
        comp = durable(connected_components(links), "comp")
        known = comp.select(F.col("node").alias("id"), F.col("component").alias("comp"))
        with_comp = sets.join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens * 6 // (10 * BUCKET)))
    pairs = durable(candidate_pairs(with_comp, sketch, buckets, bounds), "pairs")
    more = durable(verified(pairs, sets, bounds), "more")
    release(pairs)
    all_comp = durable(connected_components(links.unionByName(more) if stars else more), "all")
    if stars:
        release(links, comp)
    release(more)
    members = all_comp.select(F.col("node").alias("id"), F.col("component").alias("group_id"))
    # copies of records that take part: of one text's copies all or none have enough words
    twins = copies.join(sets.select(F.col("id").alias("rep")), "rep", "left_semi")
    twins = twins.join(members.select(F.col("id").alias("rep"), "group_id"), "rep", "left").select("id", F.coalesce("group_id", "rep").alias("group_id"))
    return members.unionByName(twins).select("group_id", "id").distinct()


def _twins(hashed: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, rep) of the records whose text occurs more than once; a text may be that of a third of them."""
    key = F.xxhash64("k1", "k2").alias("k")
    return join_skewed(hashed.select("id", key), reps.select("rep", key), "k").select("id", "rep")

"""Problem 8: cutting oversized texts at natural boundaries by pointer doubling."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import VOCABULARY, encoder, token_bytes

LIMIT, OVERLAP = 1500, 100
#: Natural boundaries by strength; the cut lies before the match's end. Blank lines and headings first,
#: then turns, lines, sentences, blanks.
BOUNDARIES = (
    (5, re.compile(r"\n[ \t]*\n\s*|\n(?=#{1,6} )")),
    (4, re.compile(r"\n(?=[^\s:\n][^:\n]{0,40}: )")),
    (3, re.compile(r"\n")),
    (2, re.compile(r"[.!?;][\"')\]]*\s+|[。！？]")),
    (1, re.compile(r"\s(?=\S)")),
)
#: A blank at which the vocabulary's split pattern begins a word, see ``_count``.
BLANK = re.compile(r"[A-Za-z0-9] (?=[A-Za-z])")
#: A weaker boundary is taken over a stronger one only if that one would leave a piece under this part
#: of the room.
LEAST_FILL = 0.5


def boundaries(text: str, token_ends: np.ndarray, char_bytes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(token positions a cut may lie at, their strength). ``token_ends``: byte offset after each token.
    Positions at which a character ends have at least strength 0, so a legal cut is hardly ever far."""
    n = len(token_ends)
    starts = np.concatenate([[0], token_ends])
    at = lambda chars: chars if char_bytes is None else char_bytes[chars]
    strength = np.full(n + 1, -1, dtype=np.int8)
    if char_bytes is None:
        strength[:] = 0
    else:
        whole = np.zeros(int(starts[-1]) + 1, dtype=bool)
        whole[char_bytes] = True
        strength[whole[starts]] = 0
    for s, pattern in reversed(BOUNDARIES):
        # a blank goes with the word after it, as in the vocabulary; other boundaries end the piece
        ends = np.fromiter((m.start() if s == 1 else m.end() for m in pattern.finditer(text)), dtype=np.int64)
        if not len(ends):
            continue
        pos = np.searchsorted(starts, at(ends), side="right") - 1  # the last token edge not past it
        strength[pos[strength[pos] >= 0]] = s
    strength[0] = strength[n] = 6
    pos = np.flatnonzero(strength >= 0)
    return pos, strength[pos]


def successors(pos: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """For every boundary, as the start of new content, the index of the farthest boundary at which its
    piece may end: at most ``limit`` tokens with the overlap repeated. Among the boundaries in reach of
    the strongest class that fills LEAST_FILL of the room, the farthest; the last boundary if in reach."""
    n = len(pos)
    room = limit - np.minimum(pos, overlap)
    far = np.searchsorted(pos, pos + room, side="right") - 1
    far = np.maximum(far, np.minimum(np.arange(n) + 1, n - 1))
    low = pos + (room * LEAST_FILL).astype(np.int64)
    succ = far.copy()
    undecided = far < n - 1
    for s in range(5, 0, -1):
        idx = np.flatnonzero(strength >= s)
        k = np.searchsorted(idx, far, side="right") - 1
        best = idx[np.maximum(k, 0)]
        take = undecided & (pos[best] >= low) & (best > np.arange(n))
        succ[take] = best[take]
        undecided &= ~take
    return succ


def doubled_cuts(succ: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks every boundary that the greedy cut passes, from the starts in ``first``. The table of
    successors is squared until no start moves: after k rounds all cuts within 2^k steps are marked, so a
    text with c pieces needs log2(c) rounds, all texts of a batch at once."""
    reached = np.zeros(len(succ), dtype=bool)
    reached[first] = True
    jump = succ
    while True:
        new = reached.copy()
        new[jump[np.flatnonzero(reached)]] = True
        nxt = jump[jump]
        if (nxt == jump).all() and (new == reached).all():
            return reached
        reached, jump = new, nxt


def _count(text: str, a: int, z: int, own: np.ndarray, char_bytes: np.ndarray | None, enc) -> int:
    """Tokens of text[a:z] encoded by itself. ``own``: byte offset after each token of the whole text.

    The vocabulary's split pattern has a word begin at a blank between two letters or digits whatever comes before, and
    words are encoded one by one. So between the first and the last such blank of the part its tokens are those of
    the whole text, and only its two ends are encoded."""
    first = BLANK.search(text, a, z)
    if first is None:
        return len(enc.encode_ordinary(text[a:z]))
    x = y = first.start() + 1
    for m in BLANK.finditer(text, max(x, z - 300), z):
        y = m.start() + 1
    inner = np.searchsorted(own, (x, y) if char_bytes is None else char_bytes[[x, y]], side="right")
    return len(enc.encode_ordinary(text[a:x])) + int(inner[1] - inner[0]) + len(enc.encode_ordinary(text[y:z]))


def _cut_batch(ids, texts, limit, overlap, enc, lengths):
    """(id, piece, tokens, repeated, text) of a batch's oversized texts. All boundaries of the batch form one
    successor table, with offsets; pieces that count more than ``limit`` when encoded alone, as white
    space at an edge may, are cut again with that much less room. Where that would take over half of the room, bytes
    are counted instead of tokens: no piece has more tokens than bytes."""
    todo = []
    for i, t in zip(ids, texts):
        tok = np.asarray(enc.encode_ordinary(t), dtype=np.int64)
        if len(tok) > limit:
            own = np.cumsum(lengths[tok])
            todo.append((i, t, t.encode(), own, 0, own))
    while todo:
        tables, starts, base = [], [], 0
        for _, t, raw, ends, slack, _ in todo:
            chars = None
            if len(raw) != len(t):
                b = np.frombuffer(raw, dtype=np.uint8)
                chars = np.concatenate([np.flatnonzero((b & 0xC0) != 0x80), [len(raw)]])
            pos, strength = boundaries(t, ends, chars)
            succ = successors(pos, strength, limit - slack, overlap) + base
            tables.append((pos, succ, chars))
            starts.append(base)
            base += len(pos)
        marked = doubled_cuts(np.concatenate([s for _, s, _ in tables]), np.asarray(starts))
        again = []
        for (i, t, raw, ends, slack, own), (pos, _, chars), base in zip(todo, tables, starts):
            cuts = pos[marked[base : base + len(pos)]]
            edge = np.concatenate([[0], ends])
            whole = set(pos.tolist())
            pieces = []
            for k in range(len(cuts) - 1):
                a = max(0, int(cuts[k]) - overlap) if k else 0
                while a not in whole:  # inside a character: begin a little earlier, still within the limit below
                    a -= 1
                at = np.array([edge[a], edge[cuts[k]], edge[cuts[k + 1]]])
                x, y, z = (at if chars is None else np.searchsorted(chars, at)).tolist()
                pieces.append((i, k, _count(t, x, z, own, chars, enc), y - x, t[x:z]))
            most = max(p[2] for p in pieces)
            if most > limit and slack + most - limit < limit // 2:
                again.append((i, t, raw, ends, slack + most - limit, own))
            elif most > limit:
                again.append((i, t, raw, np.arange(1, len(raw) + 1), 8, own))
            else:
                yield from pieces
        todo = again


def split_texts(documents: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece, tokens, repeated, text): the pieces of every text of more than ``limit`` tokens, in order from 0;
    repeated: the characters at the beginning that the piece before has, too.

    A piece has at most ``limit`` tokens, ends at the strongest boundary that fills half of its room and,
    after the first, begins with the last ``overlap`` tokens of the one before (a few more where that
    would cut a character), as the whole text is encoded: encoded by themselves they may count one or two
    tokens more or less. Without the repeated tokens the pieces give the text byte for byte. Texts
    within the limit, null and empty ones give no rows; repeated rows are each cut. A text is cut where
    it is read, without a shuffle. One of at most ``limit`` bytes can't have more tokens, as a token has a
    byte at least, and isn't encoded.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half of the limit")
    d = documents.select(F.col(id_col), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    schema = f"`{id_col}` {dict(documents.dtypes)[id_col]}, piece int, tokens int, repeated int, text string"

    def cut(batches):
        enc, lengths = encoder(vocabulary), token_bytes(vocabulary)
        types = [None, pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            types[0] = b.schema.field(0).type
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                rows = list(_cut_batch(part.column(0).to_pylist(), part.column(1).to_pylist(), limit, overlap, enc, lengths))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[id_col, "piece", "tokens", "repeated", "text"])

    return d.mapInArrow(cut, schema)

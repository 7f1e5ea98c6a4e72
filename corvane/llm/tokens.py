"""Token counts and offsets with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every node; a parameter, as it is never copied into the repository.
VOCABULARY = os.environ.get("CORVANE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public split pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """The encoder of a worker process, loaded once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str = VOCABULARY) -> np.ndarray:
    """Length in bytes of each token id."""
    enc = encoder(path)
    out = np.zeros(enc.n_vocab, dtype=np.int64)
    for b, i in enc._mergeable_ranks.items():
        out[i] = len(b)
    return out


def with_token_counts(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text``, with its token count (bigint); null text counts 0. Whole texts are
    counted, in Arrow batches, next to where they are read: no shuffle."""
    keep = [c for c in df.columns if c != text]
    schema = df.select(*keep, F.lit(0).cast("bigint").alias(out)).schema

    def count(batches):
        enc = encoder(vocabulary)
        for b in batches:
            texts = b.column(b.schema.get_field_index("\x00text"))
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), n], names=[*keep, out])

    return df.select(*keep, F.col(text).alias("\x00text")).mapInArrow(count, schema)

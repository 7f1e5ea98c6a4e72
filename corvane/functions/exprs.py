"""Column helpers shared by the operators. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_key(c: Column | str) -> Column:
    """Trimmed, lower-cased, every ``-`` and blank read as ``_``. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.lower(F.trim(c)), "- ", "__")


def has_text(c: Column | str) -> Column:
    """Neither null nor only white space."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & c.rlike(r"\S")


def words_text(c: Column) -> Column:
    """The text's words (unbroken runs of letters and digits, lower-cased) joined by single blanks.
    Null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and seed only, so that reruns and lost executors
    give the same draw."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))

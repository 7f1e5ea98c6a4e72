"""Text functions: slugs, hashes, quotes and phrases."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def slugify(c: Column) -> Column:
    """Compatibility-decomposed, reduced to ASCII, everything but letters, digits, '_', blanks and '-' removed,
    trimmed, lower-cased, runs of blanks and '-' as one '-'. Null stays null. Only texts beyond ASCII need
    Python."""
    plain = F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.pandas_udf(_ascii, "string")(c))
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(plain, r"[^\w\s-]", ""), r"^\s+|\s+$", "")), r"[-\s]+", "-")


def content_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the sha-256 of the parts, each followed by the unit separator; null as ''."""
    each = [x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\x1f"))]
    return F.substring(F.sha2(F.concat(*each), 256), 1, 16)


def embedding_text(*parts: Column) -> Column:
    """The parts that aren't null or empty, by lines."""
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def truncated(c: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def strip_outer_quotes(c: Column) -> Column:
    q = "'\"“”‘’"
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"^[{q}]+", ""), f"[{q}]+$", ""))


#: How bullets that aren't quotes begin.
META = ("see also", "main article", "external links", "further reading")


def looks_like_quote(c: Column) -> Column:
    """20 to 600 characters, a blank, none of META at the beginning, letters for at least half."""
    n, letters = F.length(c), F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    meta = F.lit(False)
    for m in META:
        meta = meta | F.startswith(F.lower(c), F.lit(m))
    return n.between(20, 600) & F.contains(c, F.lit(" ")) & ~meta & (letters >= n * 0.5)


def distinctive_phrase(c: Column, n: int = 6) -> Column:
    """Of all windows of n words the first with the most letters in words of over three letters; null for a text
    of n words or fewer. Words are runs of letters, digits, '_', ''' and '-' that begin and end at a word edge."""
    words = F.regexp_extract_all(c, F.lit(r"\b[\w'-]+\b"), F.lit(0))
    weight = F.transform(words, lambda w: F.when(F.length(w) > 3, F.length(w)).otherwise(0))

    def score(i):
        return F.struct(F.aggregate(F.slice(weight, i, n), F.lit(0), lambda a, b: a + b).alias("s"), (-i).alias("at"))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), score))
    return F.when(F.size(words) >= n + 1, F.array_join(F.slice(words, -best["at"], n), " "))


def search_phrase(c: Column, n: int = 6, least: int = 4) -> Column:
    """The distinctive phrase, or all words of a text of ``least`` to n words; null for fewer."""
    words = F.regexp_extract_all(c, F.lit(r"\b[\w'-]+\b"), F.lit(0))
    return F.coalesce(distinctive_phrase(c, n), F.when(F.size(words).between(least, n), F.array_join(words, " ")))


def attribution(author: Column, source: Column) -> Column:
    return F.concat_ws(", ", F.nullif(author, F.lit("")), F.nullif(source, F.lit("")))


# Wikitext and quotes, as column expressions

_TEMPLATE = r"(?s)\{\{(?:(?!\{\{|\}\}).)*+\}\}"


def _without_templates(c: Column) -> Column:
    """Innermost templates are removed as often as they are nested; an unclosed one stays. Texts without any aren't
    looked at."""
    marks = F.regexp_extract_all(c, F.lit(r"\{\{|\}\}"), F.lit(0))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(acc, mark):
        now = F.when(mark == "{{", acc["open"] + 1).otherwise(F.greatest(acc["open"] - 1, F.lit(0)))
        return F.struct(now.alias("open"), F.greatest(acc["most"], now).alias("most"))

    depth = F.aggregate(marks, start, step, lambda acc: acc["most"])
    clean = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), c, lambda acc, _: F.regexp_replace(acc, _TEMPLATE, ""))
    return F.when(F.contains(c, F.lit("{{")), clean).otherwise(c)


def clean_wikitext(c: Column) -> Column:
    """Plain text: references removed, line breaks as blanks, templates and markup removed, links as their text,
    tags removed, white space collapsed. Null stays null."""
    for pattern, by in ((r"(?is)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", ""), (r"(?i)<\s*br\s*/?\s*>", " ")):
        c = F.regexp_replace(c, pattern, by)
    c = _without_templates(c)
    for pattern, by in ((r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", "$1"), (r"\[(?:https?:)?//\S+ ([^\]]*)\]", "$1"), (r"'{2,}", ""), (r"<[^>]+>", ""), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def _blocks(page: Column) -> Column:
    """Bullets of one '*', each with the lines of several '*' right after it, as they stand."""
    return F.regexp_extract_all(F.regexp_replace(page, r"\r\n?", "\n"), F.lit(r"(?m)^[ \t]*\*(?!\*)[^\n]*(?:\n[ \t]*\*\*[^\n]*)*"), F.lit(0))


def quotes_of(page: Column, most: int = 8) -> Column:
    """The quotes in a page, an array of (text, attribution): bullets that look like one, with what is under them as
    their attribution, else what follows a first dash. Each text once, ``most`` at most. Null and empty pages
    have none."""

    def quote(block):
        lines = F.transform(F.split(block, "\n"), lambda line: clean_wikitext(F.regexp_replace(line, r"^[ \t]*\*+", "")))
        under = F.array_join(F.filter(F.slice(lines, 2, 10_000), lambda line: line != ""), " — ")
        dashed = r"^(.*?\S)\s+[—–-]{1,2}\s+(\S.*)$"
        split = (under == "") & lines[0].rlike(dashed)
        text = F.when(split, F.regexp_extract(lines[0], dashed, 1)).otherwise(lines[0])
        return F.struct(strip_outer_quotes(text).alias("text"), F.when(split, F.trim(F.regexp_extract(lines[0], dashed, 2))).otherwise(under).alias("attribution"))

    found = F.filter(F.transform(_blocks(page), quote), lambda q: looks_like_quote(q["text"]))
    texts = F.transform(found, lambda q: q["text"])
    once = F.filter(found, lambda q, i: F.array_position(texts, q["text"]) == i + 1)
    return F.coalesce(F.slice(once, 1, most), F.array().cast("array<struct<text:string,attribution:string>>"))

"""Filters, sorting, paging and counts over the kept concepts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.plans.views import SLIM


@dataclass
class Filters:
    """A concept passes if it meets all that are set; None is no condition. Ranges include their ends."""

    form: str | None = None
    source: str | None = None
    domain: str | None = None
    affect: str | None = None
    obscurity_min: int | None = None
    obscurity_max: int | None = None
    surprise_min: int | None = None
    surprise_max: int | None = None

    @staticmethod
    def parse(params: dict[str, str | None]) -> Filters:
        """From request parameters: empty and, for numbers, non-numeric values are no condition."""

        def number(k):
            try:
                return int(float(params.get(k) or ""))
            except (ValueError, OverflowError):
                return None

        text = {k: params.get(k) or None for k in ("form", "source", "domain", "affect")}
        return Filters(**text, **{f"{k}_{e}": number(f"{k}_{e}") for k in ("obscurity", "surprise") for e in ("min", "max")})

    @property
    def any(self) -> bool:
        return any(v is not None for v in vars(self).values())

    def condition(self) -> Column:
        c = []
        for k in ("form", "source"):
            if getattr(self, k) is not None:
                c.append(F.col(k) == getattr(self, k))
        for k in ("domain", "affect"):
            if getattr(self, k) is not None:
                c.append(F.array_contains(k, getattr(self, k)))
        for k in ("obscurity", "surprise"):
            if (v := getattr(self, f"{k}_min")) is not None:
                c.append(F.col(k) >= v)
            if (v := getattr(self, f"{k}_max")) is not None:
                c.append(F.col(k) <= v)
        return reduce(Column.__and__, c, F.lit(True))


def apply(df: DataFrame, f: Filters) -> DataFrame:
    return df.where(f.condition()) if f.any else df


def multi_select(df: DataFrame, text: str = "", **facets: list) -> DataFrame:
    """Any of the values within a facet, all facets together, and a lower-case substring of title or
    one-liner. An empty facet or text is no condition."""
    c = F.lit(True)
    for k, values in facets.items():
        if values:
            c = c & (F.arrays_overlap(k, F.array(*map(F.lit, values))) if k in ("domain", "affect") else F.col(k).isin(*values))
    if text:
        c = c & F.contains(F.lower(F.concat_ws(" ", "title", "one_liner")), F.lit(text.lower()))
    return df.where(c)


ORDERS = {
    "surprise": [F.desc, "surprise"],
    "obscurity": [F.asc, "obscurity"],
    "obscurity_desc": [F.desc, "obscurity"],
    "title": [F.asc, "title"],
}


def sort(df: DataFrame, by: str) -> DataFrame:
    """By surprise (high first), obscurity (low first; ``obscurity_desc`` for the other way) or title, as dictionaries
    order words whatever their case and accents (Unicode collation); ties by id. An unknown name sorts by id."""
    way, col = ORDERS.get(by, [F.asc, "id"])
    key = F.collate(F.col(col), "UNICODE") if col == "title" else F.col(col)
    return df.orderBy(way(key), "id") if col != "id" else df.orderBy("id")


def page(df: DataFrame, by: str, offset: int, limit: int) -> DataFrame:
    """One page in order; Spark plans it as a top-(offset + limit), not a full sort."""
    return sort(df, by).offset(max(0, offset)).limit(max(0, limit))


def page_with_total(df: DataFrame, by: str, offset: int, limit: int) -> DataFrame:
    """One page in order with ``total``, how many rows there are in all, in every row. An empty page has no rows, so
    no total; ``df.count()`` gives it."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, by, offset, limit).crossJoin(F.broadcast(total))  # one row


def clamp_int(v, default: int, low: int, high: int) -> int:
    """Floored and clamped; the default for null, '' and what is no finite number."""
    import math

    try:
        x = float(v)
    except (TypeError, ValueError):
        return default
    return default if not math.isfinite(x) else max(low, min(high, math.floor(x)))


def counts(df: DataFrame, scalar: list[str], multi: list[str]) -> DataFrame:
    """(facet, value, n) of the scalar facets and of each distinct value in the list facets, from one scan:
    every row is exploded to its facet values and counted on the map side."""
    pairs = [F.array(F.struct(F.lit(k).alias("facet"), F.col(k).cast("string").alias("value"))) for k in scalar]
    for name in multi:
        facet = F.lit(name).alias("facet")
        pairs.append(F.transform(F.array_distinct(name), lambda v: F.struct(facet, v.alias("value"))))  # noqa: B023 - built at once
    return df.select(F.explode(F.concat(*pairs)).alias("p")).where("p.value is not null").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def slim(df: DataFrame) -> DataFrame:
    return df.select(*SLIM)

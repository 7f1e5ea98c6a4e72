"""The typed views that nearly every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the short form of a concept.
SLIM = ["id", "slug", "title", "one_liner", "domain", "form", "affect", "obscurity", "surprise"]


def kept(concepts: DataFrame) -> DataFrame:
    """Concepts that are enriched and not dropped, with the export defaults: null text as '', null or empty
    form as 'concept', null or 0 obscurity as 3, null or 0 surprise as 5, null lists as empty."""
    empty = F.array().cast("array<string>")
    return concepts.where((F.col("dropped") == 0) & F.col("enriched_at").isNotNull()).select(
        "id", "slug", "title", F.col("source_list").alias("source"), F.col("wiki_url"),
        *[F.coalesce(a, F.lit("")).alias(b) for a, b in (("one_liner", "one_liner"), ("aha_explanation", "aha"), ("canonical_example", "example"))],
        F.coalesce("domain", empty).alias("domain"),
        F.coalesce(F.nullif("form", F.lit("")), F.lit("concept")).alias("form"),
        F.coalesce("affect", empty).alias("affect"),
        F.coalesce(F.nullif("obscurity", F.lit(0)), F.lit(3)).alias("obscurity"),
        F.coalesce(F.nullif("surprise_score", F.lit(0)), F.lit(5)).alias("surprise"),
    )


def vectorised(concepts: DataFrame, model: str | None = None, dim: int | None = None) -> DataFrame:
    """(id, embedding) of concepts with a vector that aren't dropped; of one model and size if given."""
    v = concepts.where("dropped = 0 and embedding is not null")
    if model is not None:
        v = v.where(F.col("embedding_model") == model)
    if dim is not None:
        v = v.where(F.size("embedding") == dim)
    return v.select("id", "embedding")


def edges_once(edges: DataFrame) -> DataFrame:
    """Edges with the first row, by id, of each (src_id, dst_id, kind). Rows without an end, kind or weight
    don't count. Combined on the map side, so a hub needs no more than its distinct edges."""
    e = edges.where("src_id is not null and dst_id is not null and kind is not null and weight is not null")
    return e.groupBy("src_id", "dst_id", "kind").agg(F.min(F.struct("id", "weight", "note", "source")).alias("e")).select(
        F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind", F.col("e.weight").alias("weight"), F.col("e.note").alias("note"), F.col("e.source").alias("source"))


def edges_kept(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges whose two ends are kept. A hub's rows are split by adaptive skew handling in the joins."""
    ids = kept(concepts).select("id")
    e = edges_once(edges)
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def quotes_once(quotes: DataFrame) -> DataFrame:
    """Quotes with the first row, by id, of each (concept_id, text)."""
    q = quotes.where("concept_id is not null and text is not null")
    first = F.min(F.struct("id", "rank", "attribution", "source", "source_url"))
    return q.groupBy("concept_id", "text").agg(first.alias("q")).select("concept_id", "text", "q.*")

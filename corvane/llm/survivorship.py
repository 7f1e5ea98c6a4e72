"""Problem 1: one surviving record per group of duplicates, chosen field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.exprs import clean_key, has_text
from corvane.operators.components import connected_components
from corvane.sources.durable import durable

TEXTS = ("wiki_extract", "one_liner", "aha_explanation", "canonical_example")


def merge_groups(records: DataFrame, id_col: str = "id", pointer: str = "merged_into") -> DataFrame:
    """(id, group_id) of the records linked by ``pointer``, directly or through others, direction
    ignored. A null pointer, one to the row itself or to an absent id links nothing."""
    ids = records.select(F.col(id_col).alias("known")).where("known is not null")
    links = records.select(F.col(id_col).alias("a"), F.col(pointer).alias("b")).where("a <> b")
    links = links.join(ids, F.col("b") == F.col("known"), "left_semi")
    return connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def survivors(records: DataFrame, key: str, ranks: Mapping[str, tuple[Column, Sequence[Column]]]) -> DataFrame:
    """One row per group in ``key``. ``ranks`` maps an attribute to (its value, what it is ranked by,
    highest first); the value counts only where the first ranking entry is true.

    One aggregation takes, for each attribute, the maximum of a struct (usable, ranking..., value),
    so the groups are combined on the map side before the shuffle and a group of any size is held as
    one buffer. A null ranking entry is the lowest. An attribute without a usable value is null.
    """
    aggs = []
    for name, (value, order) in ranks.items():
        best = F.max(F.struct(*[o.alias(f"r{i}") for i, o in enumerate(order)], value.alias("value")))
        aggs.append(F.when(best["r0"], best["value"]).alias(name))
    return records.groupBy(key).agg(*aggs)


def merge_survivors(concepts: DataFrame, sources: DataFrame) -> DataFrame:
    """One merged record per group of concepts tied together by ``merged_into``.

    Columns: group_id, survivor_id, source_list, score_from, surprise_score and each text
    from its best member. survivor_id: most non-blank texts, then latest ``enriched_at`` (null
    oldest), then smallest id. source_list: the listed clean key with the smallest trust_rank, ''
    if none is listed. score_from: the member with a score in 1..10 and latest ``enriched_at``, then
    smallest id; null if there is none. A text: the non-blank one of the most trusted list, then the
    latest, then of the smallest id; null if all are blank. An empty table gives no rows; columns of
    ``concepts`` other than those used are ignored, so clashing names do no harm.
    """
    groups = durable(merge_groups(concepts), "groups")
    trust = sources.select(F.col("source_list").alias("listed"), F.col("trust_rank"))
    members = (
        concepts.select("id", "source_list", "enriched_at", "surprise_score", *TEXTS)
        .join(groups, "id")
        .withColumn("key", clean_key("source_list"))
        .join(trust, F.col("key") == F.col("listed"), "left")
    )
    when, first = F.col("enriched_at"), -F.col("id")
    full = sum((F.when(has_text(t), 1).otherwise(0) for t in TEXTS), F.lit(0))
    rank = -F.col("trust_rank")
    scored = F.coalesce(F.col("surprise_score").between(1, 10), F.lit(False))
    ranks = {
        "survivor_id": (F.col("id"), [F.lit(True), full, when, first]),
        "source_list": (F.col("listed"), [F.col("listed").isNotNull(), rank]),
        "score_from": (F.col("id"), [scored, when, first]),
        "surprise_score": (F.col("surprise_score"), [scored, when, first]),
    } | {t: (F.col(t), [has_text(t), rank, when, first]) for t in TEXTS}
    out = survivors(members, "group_id", ranks)
    return out.withColumn("source_list", F.coalesce("source_list", F.lit("")))

"""The pN_ queries, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.exprs import clean_key
from corvane.llm import cutoffs, leaks, lists, mixing, neardup, neighbours, simclusters, splitting, survivorship
from corvane.operators import cluster
from corvane.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_survivors(spark, d).select("group_id", "survivor_id", "source_list", "score_from")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.merge_survivors(table(spark, d, "concepts"), table(spark, d, "sources"))


MODEL, DIM = "notion-embed-2", 128


def _usable(spark: SparkSession, d: str) -> DataFrame:
    return lists.model_vectors(table(spark, d, "concepts"), MODEL, DIM)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_neighbours(spark, d).select(F.col("id").alias("concept_id"), "neighbour_id")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(_usable(spark, d), DIM, k=5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    fields = [F.coalesce(c, F.lit("")) for c in ("title", "wiki_extract", "aha_explanation")]
    texts = table(spark, d, "concepts").select("id", F.concat_ws(" ", *fields).alias("text"))
    return neardup.near_duplicates(texts, words=3, similarity=0.5, least=20).select("group_id", F.col("id").alias("concept_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, around = simclusters.pivot_clusters(_usable(spark, d), DIM)
    return simclusters.isolated_cliques(members, around, least=12)


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of at least 12 with size, representatives and top terms; the rest stays outside."""
    vectors, concepts = _usable(spark, d), table(spark, d, "concepts")
    members, _ = simclusters.pivot_clusters(vectors, DIM)
    texts = concepts.select("id", F.concat_ws(" ", "title", "one_liner").alias("text")).join(members, "id").select(F.col("pivot").alias("cluster"), "id", "text")
    terms = cluster.top_terms(texts).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("top_terms"))
    found = simclusters.describe(members, vectors, DIM, least=12)
    return found.join(terms.withColumnRenamed("cluster", "pivot"), "pivot", "left").drop("pivot")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_cutoffs(spark, d).select("source_list", "cutoff", "kept")


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """The tree gets a batch for each year of enrichment; its leaves hold four scores each, refined in the end."""
    year = F.coalesce(F.year("enriched_at").cast("string"), F.lit("none"))
    records = table(spark, d, "concepts").select(year.alias("batch"), clean_key("source_list").alias("source"), F.col("surprise_score").alias("score")).where("score between 1 and 10")
    tree = cutoffs.DyadicTree(spark, lo=1, bits=4, levels=2)
    tree.add_batches(records)
    targets = table(spark, d, "sources").select(F.col("source_list").alias("source"), F.col("keep_percent").alias("percent"))
    return tree.cutoffs(targets, records).withColumnRenamed("source", "source_list")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).where("verbatim").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """With the words of the longest run within the edits, its edits, and whether as many words as asked for are the
    same."""
    found = leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id", "words", "edits", (F.col("exact_words") >= leaks.WORDS).alias("verbatim"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_plan(spark, d).where("short").select("source")


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_plan(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pieces(spark, d).where("piece = 0").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "documents"))


def p8_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, digest) of every text: of oversized ones put together again from their pieces, without what repeats."""
    documents = table(spark, d, "documents")
    pieces = splitting.split_texts(documents).select("doc_id", "piece", F.expr("substring(text, repeated + 1)").alias("new"))
    whole = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "new"))), lambda p: p["new"]), "").alias("text"))
    rest = documents.select("doc_id", "text").where("text is not null").join(whole.select("doc_id"), "doc_id", "left_anti")
    return whole.unionByName(rest).select("doc_id", F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p2_found, p2_neighbours, p3_found, p3_cutoffs, p4_found, p5_found, p5_clusters, p6_found, p6_leaks, p7_found, p7_plan, p7_mix, p8_found, p8_pieces, p8_rejoined)}

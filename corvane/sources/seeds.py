"""The list pages that a corpus starts from. Curated lists are a table of the user's own (see ``pipeline.scrape``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: List page, key of its list, name, and form of its entries.
PAGES = [
    ("List of cognitive biases", "cognitive_biases", "Cognitive biases", "bias"),
    ("List of fallacies", "fallacies", "Fallacies", "fallacy"),
    ("List of paradoxes", "paradoxes", "Paradoxes", "paradox"),
    ("List of thought experiments", "thought_experiments", "Thought experiments", "thought_experiment"),
    ("List of effects", "effects", "Named effects", "effect"),
    ("List of eponymous laws", "eponymous_laws", "Eponymous laws", "law"),
    ("List of narrative techniques", "narrative_techniques", "Narrative techniques", "device"),
    ("List of stock characters", "stock_characters", "Stock characters", "archetype"),
    ("List of software anti-patterns", "anti_patterns", "Software anti-patterns", "anti_pattern"),
    ("List of games in game theory", "game_theory_games", "Game theory games", "game"),
    ("Glossary of rhetorical terms", "rhetorical_terms", "Rhetorical terms", "device"),
]


def seed_pages(spark: SparkSession) -> DataFrame:
    """(page, source_list, name, default_form, priority) of PAGES."""
    return spark.createDataFrame([(*row, i) for i, row in enumerate(PAGES)], "page string, source_list string, name string, default_form string, priority int")


def curated(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """(source_list, priority, title) of curated lists by key, after those of PAGES; blank titles are left out."""
    rows = [(key, len(PAGES) + i, title) for i, (key, titles) in enumerate(lists.items()) for title in titles]
    return spark.createDataFrame(rows, "source_list string, priority int, title string").where(F.trim("title") != "")

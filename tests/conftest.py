import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


CONCEPTS = (
    "id long, slug string, title string, source_list string, wiki_url string, wiki_extract string, one_liner string, aha_explanation string, "
    "canonical_example string, domain array<string>, form string, affect array<string>, obscurity int, prerequisites_raw string, surprise_score int, "
    "enriched_at timestamp, dropped int, merged_into long, embedding array<float>, embedding_model string"
)


@pytest.fixture(scope="session")
def concepts(spark):
    """Makes a table of concepts out of dicts; what isn't given is null, but for a kept concept's marks."""
    import datetime

    names = [x.split(" ")[0] for x in CONCEPTS.split(", ")]

    def make(rows, **more):
        base = {"dropped": 0, "enriched_at": datetime.datetime(2026, 1, 1), "embedding_model": "m"}
        data = [tuple((base | more | r).get(n) for n in names) for r in rows]
        return spark.createDataFrame(data, CONCEPTS)

    return make

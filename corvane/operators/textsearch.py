"""Full-text search over title, one-liner and explanation.

Score of a document: the sum over query terms, fields and matching tokens of
boost * closeness * idf * (DELTA + tf * (K + 1) / (tf + K * (1 - B + B * length / average length))), BM25+ with the
constants below. A token matches exactly (closeness 1), as a longer word with the term as its beginning, or by
an edit distance of at most ``fuzzy`` times the term's length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, B, DELTA = 1.2, 0.7, 0.5
PREFIX, FUZZY = 0.375, 0.45
BOOST = {"title": 3.0, "one_liner": 2.0, "aha": 1.0}


def query_terms(q: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", q.lower())))


def search(concepts: DataFrame, q: str, fuzzy: float = 0.15) -> DataFrame:
    """(id, score) of all concepts with a matching token. Filters are to be applied to this before any cap.

    One pass finds the matching tokens next to the scan; only those are shuffled. Field lengths need a
    second, aggregating pass. Null texts are empty; a query without words matches nothing."""
    spark = concepts.sparkSession
    words = query_terms(q)
    if not words:
        return spark.createDataFrame([], "id long, score double")
    fields = [F.struct(F.lit(f).alias("field"), F.lit(b).alias("boost"), F.filter(F.split(F.lower(F.coalesce(f, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "").alias("tokens")) for f, b in BOOST.items()]
    docs = concepts.select("id", F.explode(F.array(*fields)).alias("f")).select("id", "f.*").withColumn("len", F.size("tokens"))
    stats = docs.groupBy("field").agg(F.avg("len").alias("avg"), F.count("*").alias("docs"))

    def closeness(t, w):
        d = F.levenshtein(t, F.lit(w))
        n = float(len(w))
        return (
            F.when(t == w, 1.0)
            .when(F.startswith(t, F.lit(w)), PREFIX * n / (n + 0.3 * (F.length(t) - len(w))))
            .when((F.lit(round(fuzzy * len(w))) > 0) & (d <= round(fuzzy * len(w))), FUZZY * n / (n + d))
            .otherwise(0.0)
        )

    tokens = docs.select("id", "field", "boost", "len", F.explode("tokens").alias("token"))
    matches = F.array(*[F.struct(F.lit(w).alias("term"), closeness(F.col("token"), w).alias("close")) for w in words])
    hits = tokens.select("*", F.explode(F.filter(matches, lambda m: m["close"] > 0)).alias("m")).select("id", "field", "boost", "len", "token", "m.*")
    tf = hits.groupBy("id", "field", "boost", "len", "term", "token", "close").agg(F.count("*").alias("tf"))
    df = tf.groupBy("field", "term", "token").agg(F.count("*").alias("df"))
    s = tf.join(df, ["field", "term", "token"]).join(stats, "field")
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = DELTA + F.col("tf") * (K + 1) / (F.col("tf") + K * (1 - B + B * F.col("len") / F.col("avg")))
    return s.groupBy("id").agg(F.round(F.sum(F.col("boost") * F.col("close") * idf * part), 6).alias("score"))

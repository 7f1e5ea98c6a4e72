"""Reactions as a stream (an extension: the log is append-only). The same views as in batch, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.reactions import SCHEMA, SIGNALS
from corvane.sources.durable import scratch


def read(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_trigger: int = 16) -> DataFrame:
    """The parquet files of a folder as they come in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Each event once; the state keeps events for as long as repeats may be late."""
    s = stream.where("slug is not null and signal is not null and reacted_at is not null")
    return s.withColumn("user_key", F.coalesce("user_key", F.lit(""))).withWatermark("received_at", late).dropDuplicatesWithinWatermark(["user_key", "slug", "signal", "reacted_at"])


def per_window(stream: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(day, signal, n) events by window of arrival; a window is final once the watermark has passed it."""
    s = stream.where("signal is not null and received_at is not null").withWatermark("received_at", late)
    return s.groupBy(F.window("received_at", width).alias("w"), "signal").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "signal", "n")


def latest_signals(stream: DataFrame) -> DataFrame:
    """(user_key, slug, signal, at): the running last signal, for output mode 'complete' or 'update'."""
    s = stream.where(F.col("signal").isin(*SIGNALS, "clear") & F.col("slug").isNotNull() & F.col("reacted_at").isNotNull())
    last = s.groupBy(F.coalesce("user_key", F.lit("")).alias("user_key"), "slug").agg(F.max(F.struct("reacted_at", "received_at", "signal")).alias("l"))
    return last.select("user_key", "slug", F.col("l.signal").alias("signal"), F.col("l.reacted_at").alias("at"))


def run_to_table(df: DataFrame, name: str, mode: str) -> StreamingQuery:
    """Runs what is there to the end into an in-memory table; for tests and small views."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", scratch(df.sparkSession, f"stream-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q

"""States and views from the append-only log of reactions (user_key, slug, signal, reacted_at, received_at).

Exact repeats of an event count once. Events without slug, signal or time are ignored. Events are ordered by when
they happened, then by when they came in, then by signal, so that late rows find their place.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "user_key string, slug string, signal string, reacted_at timestamp, received_at timestamp"
SIGNALS = ("knew", "didnt", "mind_blown")


def events(log: DataFrame) -> DataFrame:
    """The usable events, each once. A null user reads as '' (the anonymous one)."""
    e = log.where("slug is not null and signal is not null and reacted_at is not null")
    return e.select(F.coalesce("user_key", F.lit("")).alias("user_key"), "slug", "signal", "reacted_at", "received_at").distinct()


def replay(log: DataFrame, add: str, remove: str) -> DataFrame:
    """(user_key, slug, created_at, present): a slug is present if its last event is an addition; created_at is
    the first addition since the last removal. Adding again changes nothing.

    Two aggregations combined on the map side, so a hot slug is no single task's work: its last removal, then
    the first addition after it."""
    e = events(log).where(F.col("signal").isin(add, remove))
    at = F.struct("reacted_at", "received_at", (F.col("signal") == remove).cast("int").alias("off"))
    gone = e.groupBy("user_key", "slug").agg(F.max(F.when(F.col("signal") == remove, at)).alias("gone"))
    back = e.where(F.col("signal") == add).join(gone, ["user_key", "slug"]).where(F.col("gone").isNull() | (at > F.col("gone")))
    first = back.groupBy("user_key", "slug").agg(F.min("reacted_at").alias("created_at"))
    return gone.join(first, ["user_key", "slug"], "left").select("user_key", "slug", "created_at", F.col("created_at").isNotNull().alias("present"))


class ReactionLog:
    """Writes to the append-only log in a folder, which may lie on any file system Spark can reach. A state is what
    the log replays to, so writes from several places need no lock: adding again changes nothing, and of several
    additions at once the first time counts."""

    PAIRS = {"favorite": "unfavorite", "dismissed": "undismissed"}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.folder)
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], SCHEMA)

    def _append(self, user: str, slug: str, signal: str, at) -> None:
        now = datetime.now(timezone.utc) if at is None else at
        self.spark.createDataFrame([(user, slug, signal, now, now)], SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def _of(self, user: str, slug: str, kind: str):
        own = self.read().where((F.coalesce("user_key", F.lit("")) == user) & (F.col("slug") == slug))
        return replay(own, kind, self.PAIRS[kind]).where("present").first()

    def add(self, user: str, slug: str, kind: str = "favorite", at=None):
        """When the slug was added; it stays at the first time if it is there already."""
        if self._of(user, slug, kind) is None:
            self._append(user, slug, kind, at)
        return self._of(user, slug, kind).created_at

    def remove(self, user: str, slug: str, kind: str = "favorite", at=None) -> bool:
        """Whether it was there."""
        if self._of(user, slug, kind) is None:
            return False
        self._append(user, slug, self.PAIRS[kind], at)
        return True

    def contains(self, user: str, slug: str, kind: str = "favorite") -> bool:
        return self._of(user, slug, kind) is not None

    def signal(self, user: str, slug: str, signal: str | None, at=None) -> None:
        """Sets the user's signal on a slug; None clears it."""
        if signal is not None and signal not in SIGNALS:
            raise ValueError(f"unknown signal {signal!r}")
        self._append(user, slug, signal or "clear", at)

    def list(self, user: str, kind: str = "favorite") -> DataFrame:
        """(slug, created_at), newest first."""
        own = self.read().where(F.coalesce("user_key", F.lit("")) == user)
        return replay(own, kind, self.PAIRS[kind]).where("present").select("slug", "created_at").orderBy(F.desc("created_at"), "slug")


def favorites(log: DataFrame) -> DataFrame:
    return replay(log, "favorite", "unfavorite").where("present").drop("present")


def signals(log: DataFrame) -> DataFrame:
    """(user_key, slug, signal, at): the last signal of each user on each slug; 'clear' deletes it."""
    e = events(log).where(F.col("signal").isin(*SIGNALS, "clear"))
    last = e.groupBy("user_key", "slug").agg(F.max(F.struct("reacted_at", "received_at", "signal")).alias("l"))
    return last.where("l.signal <> 'clear'").select("user_key", "slug", F.col("l.signal").alias("signal"), F.col("l.reacted_at").alias("at"))


def signal_counts(log: DataFrame) -> DataFrame:
    return signals(log).groupBy("signal").agg(F.count("*").alias("n"))


def counts_by_day(log: DataFrame) -> DataFrame:
    """(day, n): current signals by UTC day (the session's time zone must be UTC)."""
    return signals(log).groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n"))


def recent(log: DataFrame, concepts: DataFrame, signal: str, k: int = 8) -> DataFrame:
    """(slug, title, user_key, at): the latest current signals of a kind on known concepts, newest first."""
    s = signals(log).where(F.col("signal") == signal)
    return s.join(concepts.select("slug", "title"), "slug").orderBy(F.desc("at"), "slug", "user_key").limit(k).select("slug", "title", "user_key", "at")


def history(log: DataFrame, concepts: DataFrame, signal: str | None = None) -> DataFrame:
    """(slug, user_key, signal, at, title): all current signals, with a null title for unknown slugs."""
    s = signals(log)
    s = s.where(F.col("signal") == signal) if signal else s
    return s.join(concepts.select("slug", "title"), "slug", "left").select("slug", "user_key", "signal", "at", "title")

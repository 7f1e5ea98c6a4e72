"""Problem 3: score cutoffs per source from a persistent dyadic count tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.sources.durable import scratch


class DyadicTree:
    """Counts of integer-coded scores by (source, level, node), kept as a parquet table.

    A score s in lo..lo + 2^bits - 1 has the code s - lo. Level 0 is the root, level ``levels`` the
    leaves, each of 2^(bits - levels) codes; node k of a level covers an equal, aligned range. Each
    batch has an id and is a partition of the table: adding one never reads the others, adding it again, as a
    retried job does, takes its old place, and nodes are summed when read. A tree opened on the same ``path`` goes
    on where the last one stopped. A batch is aggregated before the shuffle to at most (sources x 2^levels) rows a
    task, however many records one source has.
    """

    def __init__(self, spark: SparkSession, lo: int, bits: int, levels: int | None = None, path: str | None = None):
        self.spark, self.lo, self.bits = spark, lo, bits
        self.levels = bits if levels is None else min(levels, bits)
        self.path = path or scratch(spark, "tree")

    def leaf(self, score):
        return F.shiftright((score - F.lit(self.lo)).cast("long"), self.bits - self.levels)

    def _nodes_of(self, records: DataFrame, *keys: str) -> DataFrame:
        counts = self._usable(records, *keys).groupBy(*keys, "source", self.leaf(F.col("score")).alias("leaf")).agg(F.count("*").alias("n"))
        nodes = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(self.levels)))).select(*keys, "source", "level", F.expr(f"shiftright(leaf, {self.levels} - level)").alias("node"), "n")
        return nodes.groupBy(*keys, "source", "level", "node").agg(F.sum("n").alias("n"))

    def add_batch(self, records: DataFrame, batch: str) -> None:
        """``records`` (source, score) as the batch of that id; rows with a null or with a score out of range don't
        count."""
        self._nodes_of(records).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def add_batches(self, records: DataFrame) -> None:
        """``records`` (batch, source, score): several batches in one pass, each in its place."""
        self._nodes_of(records, "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def _usable(self, records: DataFrame, *keys: str) -> DataFrame:
        return records.select(*keys, "source", "score").where(F.col("source").isNotNull() & F.col("score").between(self.lo, self.lo + (1 << self.bits) - 1))

    def nodes(self) -> DataFrame:
        schema = "source string, level int, node long, n long, batch string"
        return self.spark.read.schema(schema).parquet(self.path).groupBy("source", "level", "node").agg(F.sum("n").alias("n"))

    def descend(self, targets: DataFrame) -> DataFrame:
        """``targets`` (source, percent). For each source with a record: the leaf in which the count of
        records from the top reaches percent of all, the count above it and the total.

        One step a level: to the right child if the records there and above reach the target, else to
        the left one, the right child's records then lying above."""
        nodes = self.nodes()
        at = nodes.where("level = 0").join(targets, "source").select("source", "percent", F.col("n").alias("total"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("above"))
        for level in range(1, self.levels + 1):
            right = nodes.where(F.col("level") == level).select("source", F.expr("shiftright(node, 1)").alias("node"), F.col("n").alias("rn"), F.col("node").alias("child")).where("child % 2 = 1")
            step = at.join(right, ["source", "node"], "left").withColumn("rn", F.coalesce("rn", F.lit(0)))
            there = 100 * (F.col("above") + F.col("rn")) >= F.col("percent") * F.col("total")
            at = step.select("source", "percent", "total", (F.col("node") * 2 + there.cast("long")).alias("node"), F.when(there, F.col("above")).otherwise(F.col("above") + F.col("rn")).alias("above"))
        return at

    def cutoffs(self, targets: DataFrame, records: DataFrame) -> DataFrame:
        """(source, cutoff, kept, total): the largest score with 100 * (records scoring at least it) >=
        percent * (records). ``records``: all rows added so far; only those in a source's target leaf
        are counted again, by distinct score."""
        leaf = self.descend(targets)
        if self.levels == self.bits:  # a leaf is one score
            own = self.nodes().where(F.col("level") == self.levels).select("source", "node", "n")
            done = leaf.join(own, ["source", "node"], "left")
            return done.select("source", (F.col("node") + self.lo).cast("int").alias("cutoff"), (F.col("above") + F.coalesce("n", F.lit(0))).alias("kept"), "total")
        own = self._usable(records).withColumn("node", self.leaf(F.col("score"))).join(leaf, ["source", "node"]).groupBy("source", "score").agg(F.count("*").alias("n"), F.first("above").alias("above"), F.first("total").alias("total"), F.first("percent").alias("percent"))
        up = F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("score")))
        reached = own.withColumn("kept", F.col("above") + up).where(F.expr("100 * kept >= percent * total"))
        return reached.groupBy("source").agg(F.max(F.struct("score", "kept", "total")).alias("b")).select("source", F.col("b.score").cast("int").alias("cutoff"), F.col("b.kept").alias("kept"), F.col("b.total").alias("total"))


"""Weighted sampling and daily picks, both reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.durable import durable


def md5_uniform(c: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the md5 of the value and seed, equal in any engine."""
    h = F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double")
    return (h + 0.5) / 4294967296.0


def weighted_sample(df: DataFrame, k: int, surprise_temp: float = 1.0, obscurity_temp: float = 0.5, seed: int = 0) -> DataFrame:
    """k rows without replacement, by (1 + surprise)^st * (1 + obscurity)^ot: the k largest u^(1/w), compared as
    ln(u) / w. Rows of weight 0 or less are never drawn. A top-k, so no task holds more than k rows."""
    w = F.pow(1 + F.col("surprise"), F.lit(surprise_temp)) * F.pow(1 + F.col("obscurity"), F.lit(obscurity_temp))
    return df.withColumn("w", w).where("w > 0").withColumn("key", F.ln(md5_uniform(F.col("id"), seed)) / F.col("w")).orderBy(F.desc("key"), "id").limit(k).drop("w")


def with_position(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``position``, from 0, in the order of a column without ties. Ranges are numbered in parallel
    and moved by the sizes of those before; only these sizes, one a partition, come to the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = sorted(ranged.groupBy("_range").count().collect())
    total, rows = 0, []
    for part, n in sizes:
        rows.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(rows, "_range int, _offset long"))
    w = Window.partitionBy("_range").orderBy(order)
    return ranged.join(offsets, "_range").withColumn("position", F.row_number().over(w) - 1 + F.col("_offset")).drop("_range", "_offset")


def _imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without leaving 64 bits."""
    return F.pmod(F.pmod(a, F.lit(65536)) * b + F.pmod(F.floor(a / 65536) * b, F.lit(65536)) * 65536, F.lit(1 << 32))


def nth_uniform(seed: int, n: Column) -> Column:
    """The n-th draw, from 0, of the public mulberry32 generator, whose state is its seed plus a multiple of a
    constant, so that draws need no order of evaluation."""
    a = F.pmod(F.lit(seed % (1 << 32)) + F.lit(0x6D2B79F5) * (n + 1), F.lit(1 << 32))
    x = lambda p, q: p.bitwiseXOR(q)
    t = _imul(x(a, F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = x(F.pmod(t + _imul(x(t, F.shiftright(t, 7)), t.bitwiseOR(F.lit(61))), F.lit(1 << 32)), t)
    return x(t, F.shiftright(t, 14)).cast("double") / 4294967296.0


def daily_picks(concepts: DataFrame, seen_slugs: DataFrame, seed: int, count: int = 4) -> DataFrame:
    """(id, slug, domain1, score): concepts not seen yet (all, if none is left), scored by surprise + 6 * draw
    in order of id, at most two of a leading domain, the ``count`` best; ties by id."""
    fresh = concepts.join(seen_slugs.select("slug").where("slug is not null").distinct(), "slug", "left_anti")
    pool = fresh if not fresh.isEmpty() else concepts
    scored = with_position(pool.select("id", "slug", "surprise", F.coalesce(F.try_element_at("domain", F.lit(1)), F.lit("_")).alias("domain1")), "id")
    scored = scored.withColumn("score", F.round(F.col("surprise") + 6 * nth_uniform(seed, F.col("position").cast("long")), 6))
    w = Window.partitionBy("domain1").orderBy(F.desc("score"), "id")
    return scored.withColumn("r", F.row_number().over(w)).where("r <= 2").orderBy(F.desc("score"), "id").limit(count).select("id", "slug", "domain1", "score")

"""Export formats and logs: JSON tables, packed float32 matrices, JSON lines and signal maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in parallel, without null fields."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON table of a known schema; unreadable lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_matrix(vectors: DataFrame, folder: str) -> None:
    """Packed float32 unit rows as (id, v: binary) in parallel: each row carries its id, so no order has to hold. A null
    vector stays null."""

    def run(batches):
        for b in batches:
            e = b.column(1)
            size = e.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            own = np.repeat(np.arange(len(e)), size)
            norm = np.sqrt(np.bincount(own, x * x, minlength=len(e)))
            raw = (x / np.where(norm > 0, norm, 1)[own]).astype("<f4").tobytes()
            cut = np.concatenate([[0], np.cumsum(4 * size)])
            rows = [raw[i:j] if ok else None for i, j, ok in zip(cut, cut[1:], e.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["id", "v"])

    vectors.select("id", "embedding").mapInArrow(run, "id long, v binary").write.mode("overwrite").parquet(folder)


def read_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """(id, embedding) of a packed matrix."""

    def run(batches):
        for b in batches:
            v = b.column(1)
            size = [0 if r is None else len(r) // 4 for r in v.to_pylist()]
            values = pa.array(np.frombuffer(b"".join(r for r in v.to_pylist() if r is not None), "<f4"), pa.float32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values, mask=v.is_null())
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "embedding"])

    return spark.read.parquet(folder).select("id", "v").mapInArrow(run, "id long, embedding array<float>")


def unpack_floats(raw: bytes, ids: list[int], dim: int) -> list[tuple[int, list[float]]]:
    """The rows of a packed matrix file whose row i belongs to ids[i]."""
    return list(zip(ids, np.frombuffer(raw, "<f4").reshape(-1, dim).tolist())) if ids else []


LOG = "id string, ts long, situation string, model string, framing string, picks array<struct<slug:string,why:string>>"


def append_log(spark: SparkSession, folder: str, row: dict, schema: str = LOG) -> None:
    """One entry of a log, a folder of JSON lines on any file system Spark can reach."""
    names = [f.name for f in StructType.fromDDL(schema)]
    spark.createDataFrame([tuple(row.get(n) for n in names)], schema).coalesce(1).write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str, schema: str = LOG) -> DataFrame:
    """A log newest first; broken lines are skipped."""
    return read_json(spark, folder, schema).where("ts is not null").orderBy(F.desc("ts"))


def export_signals(signals: DataFrame) -> DataFrame:
    """(user_key, json) of {slug: {signal, at}} with at in milliseconds, one object a user."""
    entry = F.struct("slug", F.struct("signal", F.unix_millis("at").alias("at")).alias("v"))
    return signals.groupBy("user_key").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def import_signals(df: DataFrame) -> DataFrame:
    """(user_key, slug, signal, at) from ``df`` (user_key, json); broken JSON gives no rows."""
    m = F.from_json("json", "map<string, struct<signal:string, at:bigint>>")
    return df.select("user_key", F.explode(m).alias("slug", "v")).where("v is not null").select("user_key", "slug", F.col("v.signal").alias("signal"), F.timestamp_millis("v.at").alias("at"))

"""Tables written to the shared checkpoint folder, to cut lineage.

A written table survives the loss of any executor and is compressed and column-pruned when read
again, unlike the serialised rows of ``DataFrame.checkpoint``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and
    the master is local (tests). On a cluster an unset folder is an error, as executors don't share
    a machine-local one."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local["):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _own_dirs[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there is removed at exit."""
    path = f"{checkpoint_root(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame, name: str = "t", drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a read of it. Removed by ``release`` or at exit.
    ``drop_shuffles``: the shuffle files of the write are removed as soon as it ends, not when the driver happens to
    collect its garbage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEAN_UP, None)
    if drop_shuffles:
        spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(_CLEAN_UP, before) if before is not None else spark.conf.unset(_CLEAN_UP)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete durable tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_corvane_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone; a left-over table does no harm
        pass


@atexit.register
def _clean_up() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)

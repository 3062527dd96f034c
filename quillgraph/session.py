"""Session settings and the few physical helpers every operator shares.

* ``read_table`` reads one parquet table of a scale folder.
* ``materialize`` cuts lineage with a parquet table in the shared folder that the
  cluster names in ``spark.checkpoint.dir``; a machine-local folder is used only
  in local mode with that setting absent, as in tests; a cluster without it is an error.
* ``broadcast_if_small`` broadcasts a side only after its size was checked; a
  larger side stays an ordinary join input, so AQE picks the join.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a dimension table counts as small.
SMALL_ROWS = 20_000
#: Bytes up to which a side counts as small, whatever its rows.
SMALL_BYTES = 64 << 20

#: Setting by which Spark deletes the shuffle files of a query that has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "quillgraph") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    parallel = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QG_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, from ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", _own_dirs[app])
        atexit.register(_remove, _own_dirs[app])
    return _own_dirs[app]


def _remove(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, label: str = "step", codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and read it back: short lineage that survives a lost executor.

    The shuffle files of the write go when it ends; else they stay until the driver collects its garbage, which may be never.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    kept = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if kept is None else spark.conf.set(SHUFFLE_CLEANUP, kept)
    out = spark.read.schema(_nullable(df.schema)).parquet(path)
    out._qg_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` once nothing reads it any more."""
    path = getattr(df, "_qg_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``size`` bytes; reads no more than that many rows.

    Rows of fixed width are measured by their schema, others by their values written out.
    """
    if all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) for f in df.schema.fields):
        most = min(rows, size // (8 * max(1, len(df.columns))))
        return df.limit(most + 1).count() <= most
    measured = df.limit(rows + 1).select(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("_n"))
    got = measured.agg(F.count("*").alias("n"), F.coalesce(F.sum("_n"), F.lit(0)).alias("b")).first()
    return got["n"] <= rows and got["b"] <= size


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    return F.broadcast(df) if is_small(df, rows, size) else df


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)

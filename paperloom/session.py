"""Session settings shared by tests, bench and queries."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", app: str = "paperloom") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own in the one that all executors share, spark.checkpoint.dir; it is deleted at the end.

    Where that is unset, a temporary folder serves a local session; on a cluster it is an error, as executors would write to their own disks.
    """
    context = spark.sparkContext
    path = getattr(context, "_paperloom_dir", None)
    if not path:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
            context.setCheckpointDir(base)
        path = f"{base.rstrip('/')}/paperloom-{uuid.uuid4().hex}"
        context._paperloom_dir = path
        atexit.register(_discard, spark, path)
    return path


def _discard(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001, S110  the session has gone first
        pass


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made(spark: SparkSession, path: str) -> str:
    """A folder that is there, empty if it is new."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return path


def parts_of(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

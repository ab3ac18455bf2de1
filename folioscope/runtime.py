"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FOLIOSCOPE_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent (tests, a laptop) a temporary folder is made; that is refused
    on anything but a local master, since executors elsewhere could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = getattr(spark.sparkContext, "_folioscope_dir", None)
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    held = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    spark.sparkContext._folioscope_dir = held
    return held


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the lineage ends in the shared folder, so lost executors cost nothing."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=eager)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/folioscope/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back (columnar, prunable, splittable)."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote for df; nothing may read it any more."""
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written)
    hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's own estimate of a frame's size in bytes (after pushed projections)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_broadcast(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """broadcast() behind a size check; beyond the bound the planner keeps its shuffled join."""
    return F.broadcast(df) if scan_bytes(df) <= max_bytes else df


def default_slices(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


class Shared:
    """A broadcast object, pickled by value so that executors need no copy of this package."""

    def __init__(self, spark: SparkSession, obj: object):
        from pyspark import cloudpickle

        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(obj))

    def get(self) -> object:
        from pyspark import cloudpickle

        return cloudpickle.loads(self.held.value)

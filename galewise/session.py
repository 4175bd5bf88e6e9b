"""Session settings and the shared folder that jobs use to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "galewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; ``conf`` overrides them.

    Adaptive execution sizes the shuffles and splits the partitions of hot join keys.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.optimizer.windowGroupLimitThreshold": "16384",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, because a
    machine-local folder would be lost with its executor on a cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="galewise-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors, and its known size lets Spark
    choose a broadcast join only where the table really is small.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of what has been written.

    Spark removes them once the driver's JVM has collected the plans; a job of many steps would hold all of them till then.
    """
    for _ in range(2):  # the plan that ran last is let go only some moments after its job, and then takes a second collection
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)


_ONCE: dict[tuple, list[tuple[str, object]]] = {}


def stored_once(spark: SparkSession, label: str, source: str, make: Callable[[], list[DataFrame]]) -> list[DataFrame]:
    """The tables that ``make`` derives from the file or folder ``source``, written at the first call of an application and read after that.

    A source that has changed since (by its time or length) is derived anew.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(source)
    state = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, shared_dir(spark), label, source, state.getModificationTime(), state.getLen())
    if key not in _ONCE:
        made = []
        for df in make():
            place = scratch_path(spark, label)
            df.write.parquet(place)
            made.append((place, df.schema))
        _ONCE[key] = made
        free_shuffles(spark)
    return [spark.read.schema(schema).parquet(place) for place, schema in _ONCE[key]]


class Versions:
    """Named tables of an iterating job in the shared folder, newest version only.

    A table's old version is removed once the new one is completely written, so the
    folder holds one copy of each table however many steps a job takes.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, scratch_path(spark, label)
        self._count: dict[str, int] = {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        version = self._count.get(name, 0) + 1
        path = f"{self.root}/{name}-{version}"
        df.write.parquet(path)
        self._count[name] = version
        if version > 1:
            remove_path(self.spark, f"{self.root}/{name}-{version - 1}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove the newest version, if there is one."""
        if name in self._count:
            remove_path(self.spark, f"{self.root}/{name}-{self._count[name]}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete files that this library has written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

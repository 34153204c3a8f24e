"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. In local mode only, a temporary folder is set where none is."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = sc._jsc.sc().getCheckpointDir()
        found = java.get() if java.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def stored(df: DataFrame, label: str, by: tuple[int, list[str]] | None = None) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again, so that lineage ends there and lost executors cost no recomputation.

    The table goes with the Scratch block that it stands in, else when the driver's JVM ends. by: (partitions, columns) to range-sort by
    first.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{uuid.uuid4().hex}/{label}"
    if by:
        df = df.repartitionByRange(by[0], *by[1]).sortWithinPartitions(*by[1])
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place.getParent())
    out = spark.read.schema(df.schema).parquet(path)
    out.corvane_table = path
    if open_ := getattr(_LOCAL, "open", None):
        open_[-1].append(out.corvane_table)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stored() table."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def give_back(spark: SparkSession) -> None:
    """Has executors collect their garbage, so that heap which earlier stages filled and no longer use goes back to the machine. To be called before tasks whose Python
    workers need the memory. Best effort: the tasks go to whichever executors are free, two for each core."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


class Scratch:
    """A block whose thread's stored() tables go at its end, all but those that keep() names, which pass to the block around it; shuffle files that nothing
    refers to go too."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.kept, self.tables = spark, set(), []

    def __enter__(self) -> Scratch:
        if not hasattr(_LOCAL, "open"):
            _LOCAL.open = []
        _LOCAL.open.append(self.tables)
        return self

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {t.corvane_table for t in tables}

    def __exit__(self, failed, *_) -> None:
        _LOCAL.open.pop()
        for t in self.tables:
            if t not in self.kept:
                remove(self.spark, t)
            elif _LOCAL.open:
                _LOCAL.open[-1].append(t)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # the driver's cleaner removes shuffles once their plans are collected


#: The lists of tables of the Scratch blocks that are open in a thread.
_LOCAL = threading.local()

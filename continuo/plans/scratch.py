"""Tables that cut a plan's lineage, in the folder that driver and executors share, deleted once no plan reads them."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_lock = threading.Lock()
_held: list[tuple] = []  # (the JVM's weak reference to a table's file index, path)


def folder(spark: SparkSession) -> str | None:
    """The folder of spark.checkpoint.dir, None where the session has none."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or ""
    return at.rstrip("/") or None


def cut(df: DataFrame) -> DataFrame:
    """What df holds now, read back from a table, which a lost executor doesn't take along; df itself without a folder.

    Further plans start from the table instead of working df out again in each of their branches.
    """
    spark = df.sparkSession
    sweep(spark)
    at = folder(spark)
    if at is None:
        return df
    path = f"{at}/cut-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    with _lock:
        _held.append((spark._jvm.java.lang.ref.WeakReference(index), path))
    return out


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that the JVM has collected the last plan of."""
    with _lock:
        gone = [entry for entry in _held if entry[0].get() is None]
        for entry in gone:
            _held.remove(entry)
    for _, path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

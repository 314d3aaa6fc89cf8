"""Shared folder, temporary tables and small helpers of the training-data operators.

A temporary table lives as long as any plan that reads it: it is deleted once the JVM has collected the last one
(as Spark does with checkpoints), so results never lose rows under a caller's hands and no caller has to free them.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from continuo.plans.session import steady

#: An Arrow batch that goes to Python holds about so many bytes at most (one row at least).
BATCH_BYTES = 4 << 20
#: Rows of keys that are broadcast at most; as hashed relations such rows take 60 to 270 bytes each.
BROADCAST_KEYS = 200_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_lock = threading.Lock()
_own_dir: str | None = None
_tables: list[tuple] = []  # (weak JVM reference to a table's file index, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all runs in one process, a folder of our own.

    A folder of one machine would lose rows on a cluster, so there the setting is required.
    """
    global _own_dir
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if at:
        return at.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    with _lock:
        if _own_dir is None:
            _own_dir = "file://" + tempfile.mkdtemp(prefix="continuo-shared-")
    return _own_dir


def _jvm_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    at = _jvm_path(spark, path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session stay below BATCH_BYTES from now on."""
    steady(spark)
    now = spark.conf.get(_BATCH_CONF).rstrip("bB")
    if not now.isdecimal() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder, where a lost executor loses nothing."""
    spark = df.sparkSession
    sweep(spark)
    bound_batches(spark)
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    with _lock:
        _tables.append((spark._jvm.java.lang.ref.WeakReference(index), path))
    return out


def sweep(spark: SparkSession) -> None:
    """Deletes the temporary tables that no plan refers to any more."""
    with _lock:
        gone = [(ref, path) for ref, path in _tables if ref.get() is None]
        for entry in gone:
            _tables.remove(entry)
    for _, path in gone:
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    at = _jvm_path(spark, path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checked_broadcast(df: DataFrame, rows: int, max_rows: int = BROADCAST_KEYS) -> DataFrame:
    """Broadcast hint only where a count has shown that df is small; else the join shuffles."""
    return F.broadcast(df) if rows <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def frame(rows: list[tuple], names: list[str], *nullable: str):
    """A pandas frame of rows; the columns ``nullable`` are 64-bit integers, and stay so beside nulls."""
    import pandas as pd

    columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(names, ())
    return pd.DataFrame({c: pd.array(list(x), dtype="Int64") if c in nullable else list(x) for c, x in columns.items()})


def give_back() -> None:
    """Returns what a Python worker has freed to the system; workers live on between stages, beside each other."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def unbatched(batches, sizes: int = (1 << 18) - 1):
    """Slices of Arrow batches of about ``sizes`` bytes of the column ``text`` (one row at least).

    The text has 32-bit offsets in them, whatever string type the session sends.
    """
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index("text")
        if batch.schema.field(at).type != pa.string():
            batch = batch.set_column(at, "text", batch.column(at).cast(pa.string()))
        text = batch.column(at)
        ends = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < len(text):
            to = int(np.searchsorted(ends, int(ends[at]) + sizes, "right")) - 1
            to = min(max(to, at + 1), len(text))
            yield batch.slice(at, to - at)
            at = to
    batch = text = ends = None
    give_back()

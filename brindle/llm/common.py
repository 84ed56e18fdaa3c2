"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules["brindle.llm"])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a new one where it is unset, which only a session in one process may leave so."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str, keep: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex[:12]}"
    path = f"{root}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    if keep is None:
        delete_at_exit(spark, root)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, root: str) -> None:
    """Delete a folder when its session's JVM ends, however that comes about."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for root in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)


PROCESS_CACHE = "_brindle_process_cache"


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, whichever task runs in it."""
    holder = sys.modules.setdefault(PROCESS_CACHE, type(sys)(PROCESS_CACHE))
    return holder.__dict__.setdefault(name, {})


def lean(batches, keep: tuple[str, ...] = ()) -> Iterator:
    """The batches of a Python task. Caches that other operators left in the worker go first; freed memory goes back to the system at the end.

    Spark's workers outlive their tasks, and each would hold the most that any task of any operator had, beside the JVM.
    """
    import pyarrow as pa

    holder = sys.modules.get(PROCESS_CACHE)
    for name, held in vars(holder).items() if holder else ():
        if isinstance(held, dict) and name not in keep:
            held.clear()
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)


def slices(batches, column: str, limit: int = 4 << 20):
    """Cut Arrow batches into pieces of at most limit bytes in the column; a longer value comes alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

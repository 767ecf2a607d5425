"""Tables written between steps, in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the session names. Without one, a local folder is set where the master is local; on a cluster,
    where each executor would write to a disk of its own, ValueError is raised."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="storyloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Bytes of an Arrow batch of texts, and Spark's own default of that setting.
BATCH_BYTES, DEFAULT_BYTES = 4 << 20, "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes where that bound is at its default; operators on whole texts call this first.

    A batch lies in both the JVM and the Python worker, in several copies; 64 MB of it, twice a task, would be most of a
    small executor's memory. A bound that the user has set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; at its end the worker, which waits for other tasks, gives Arrow's free memory back."""
    yield from batches
    pa.default_memory_pool().release_unused()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the program ends."""
    path = f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage is cut and lost executors don't matter."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark._jsc.sc().isStopped():
                return
            discard(spark, path)
        except Exception:  # the session's JVM has ended: its folder is the cluster's to clean
            return

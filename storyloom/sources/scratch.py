"""Lineage cuts for iterative plans, and tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder. Without one, a local folder is set where the master is local; on a cluster ValueError is raised."""
    if not (root := spark.sparkContext.getCheckpointDir()):
        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not folder and not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="storyloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch of texts, and Spark's own default of that setting.
BATCH_BYTES, DEFAULT_BYTES = 4 << 20, "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes where that bound is at its default; a bound that the user has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the session's shared folder (``shared_root``)."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, and the planner knows the size. A checkpoint keeps the estimates of its plan, which multiply in loops of joins."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

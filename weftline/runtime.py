"""Session helpers: shared scratch tables and sizes that are checked before use."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex

#: Text batches handed to Python stay small, however long the rows are.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a temporary one, removed at exit,
    if all tasks run in this process; on a cluster that is an error, as executors could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Remove every table that materialize() wrote to the session's shared folder; results not yet read are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/weftline/{_RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost
    executors cost no recomputation of what stands before it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/weftline/{_RUN}/{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    for key, value in ARROW_BATCH.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

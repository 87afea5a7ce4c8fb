"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query go as it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    On a cluster the folder must be set, since executors share no local disk. A local
    session without one gets a scratch folder that goes when the program ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage_folder(spark: SparkSession) -> str:
    """Where this application keeps its stage tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}"


def settle(df: DataFrame, lean: bool = False) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    Later stages and retries then see the same rows, columns are pruned on reading,
    and the file sizes tell the planner which sides are small. A ``lean`` one spares the disk: it is
    packed closer, and the shuffle files of the write go as it ends, not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/settled-{uuid.uuid4().hex}"
    with _releasing(spark) if lean else nullcontext():
        df.write.parquet(path, compression="zstd" if lean else None)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _releasing(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def clear_stages(spark: SparkSession) -> None:
    """Delete the stage tables of this application; frames that read them are void then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

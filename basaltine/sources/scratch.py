"""Tables written between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="basaltine-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is used once and goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage, so that a lost executor costs one step, and it forgets how the rows were partitioned,
    so that a later join shuffles both sides and can split its hot keys. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, "saved")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``new_folder`` that nothing will read again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _forget() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended before
            forget(spark, path)

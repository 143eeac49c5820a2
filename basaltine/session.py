"""Session settings that the tests, the benchmark and local use share."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings for one machine. A cluster sets its own number of shuffle partitions and its own memory.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, **more: str) -> SparkSession:
    """A local session with ``cores`` threads; ``more`` adds or replaces settings."""
    conf = LOCAL | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions)} | more
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

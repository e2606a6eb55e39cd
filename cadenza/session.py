"""Session construction and the engine settings that its plans rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold for every session this package creates.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "cadenza") -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

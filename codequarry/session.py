"""Session settings for the workloads of this library."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that hold at any scale; partition counts are left to AQE, which
# coalesces shuffle partitions and splits skewed ones at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, name: str = "codequarry", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(cores))
               .config("spark.ui.enabled", "false"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session

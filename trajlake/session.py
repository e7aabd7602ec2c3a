"""Session settings the operators rely on."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Adaptive execution turns measured-small join sides into broadcasts and splits skewed join
#: partitions, so no operator in this package carries a broadcast hint.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "trajlake") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    # Local tables are small: keep their shuffles spread over the cores (a cluster keeps the defaults).
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.driver.memory", os.environ.get("TRAJLAKE_DRIVER_MEMORY", "8g"))
               .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
               .config("spark.sql.shuffle.partitions", str(partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

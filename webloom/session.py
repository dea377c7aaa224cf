"""Local sessions for tests, benchmarks and scripts; a cluster brings its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on a local master, a temporary one is set.

    On a cluster it has to be set: executors on other machines could not read a folder of the driver's.
    """
    if not (at := spark.conf.get(CHECKPOINT, None)):
        if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT} has to name a folder that all machines share")
        at = tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set(CHECKPOINT, at)
    return at.rstrip("/")


def local_session(cores: int | str = 4, memory: str = "8g", app: str = "webloom") -> SparkSession:
    n = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

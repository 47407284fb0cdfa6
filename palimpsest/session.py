"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Rows of an Arrow batch: whole texts are long, and a batch stands in the executor's and its Python worker's memory at once.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package (the repository's folder joins their path) and keep Arrow batches small."""
    if int(spark.conf.get(BATCH_KEY, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def local_session(app: str = "palimpsest", cores: int | str = 8, memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that tests and the benchmark share."""
    built = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    spark = built.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ready(spark)

"""Session settings that the library relies on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def on_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it is installed at the same place as on the driver."""
    env = spark.sparkContext.environment
    home = str(Path(__file__).resolve().parent.parent)
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), home) if x)
    return spark

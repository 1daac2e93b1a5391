"""Sinks: rollup upserts by partition, CSV lines, event rows, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_rollup(rollup: DataFrame, path: str, bucket_s: float = 60.0) -> None:
    """Replaces the days that rollup has rows of; writing the same rows twice leaves them once."""
    day = F.date_format(F.timestamp_seconds(F.col("bucket") * bucket_s), "yyyy-MM-dd")
    rollup.withColumn("day", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def prune_days(spark: SparkSession, path: str, first_day: str) -> list[str]:
    """Drops whole days before first_day; returns their names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("day=") and name[4:] < first_day:
            fs.delete(s.getPath(), True)
            gone.append(name[4:])
    return sorted(gone)


def gates_text(gates: Column) -> Column:
    return F.array_join(F.transform(gates, lambda x: x.cast("string")), "|")


def frame_lines(frames: DataFrame) -> DataFrame:
    return frames.select(F.concat_ws(",", F.format_string("%.3f", "ts"), F.format_string("%.3f", "ts_mono"), gates_text(F.col("move")), gates_text(F.col("still")), F.col("distance_cm").cast("string"), F.col("device_occ").cast("int").cast("string")).alias("value"))


def state_lines(states: DataFrame) -> DataFrame:
    four = lambda c: F.format_string("%.4f", c)
    return states.select(F.concat_ws(",", F.format_string("%.3f", "ts"), four("score"), four("confidence"), F.col("occupied").cast("int").cast("string"), gates_text(F.col("active_gates"))).alias("value"))


def parse_time(text: Column) -> Column:
    """Epoch seconds from a number or an ISO-8601 time; one without zone is UTC (the session's zone must be)."""
    return F.coalesce(F.expr(f"try_cast({_name(text)} as double)"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def _name(c: Column) -> str:
    return c._jc.toString()

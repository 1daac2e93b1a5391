"""Frames, samples and spans from event tables.

A sample is one energy of one gate and channel; a frame has all gates of both
channels as arrays. The events table has one number a row; ``samples`` takes it
as it is, ``frames`` derives nine energies a channel from it by whole-number
arithmetic, so that any engine builds the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.plans.config import GATES
from gatelens.session import on_workers

FRAME = T.StructType([
    T.StructField("sensor", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("ts_mono", T.DoubleType()),
    T.StructField("move", T.ArrayType(T.IntegerType())),
    T.StructField("still", T.ArrayType(T.IntegerType())),
    T.StructField("distance_cm", T.IntegerType()),
    T.StructField("device_occ", T.BooleanType()),
])


def seconds(ts: Column) -> Column:
    """Epoch seconds as a double; a time without zone is UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sensor, ts, gate, chan, energy)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("sensor"),
        seconds(F.col("ts")).alias("ts"),
        (F.col("user_id") % GATES).cast("int").alias("gate"),
        (F.col("event_id") % 2).cast("int").alias("chan"),
        F.get_json_object("props", "$.k").cast("int").alias("energy"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sensor, ts, move, still, distance_cm, device_occ): nine energies a channel from each event."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    gates = F.array(*(F.lit(i) for i in range(GATES)))
    move = F.transform(gates, lambda i: ((F.col("k") + 13 * F.col("user_id") + 7 * i * i + F.col("event_id")) % 101).cast("int"))
    still = F.transform(gates, lambda i: ((3 * F.col("k") + F.col("user_id") + 11 * i) % 101).cast("int"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("sensor"),
        seconds(F.col("ts")).alias("ts"),
        move.alias("move"),
        still.alias("still"),
        ((F.col("k") * 7) % 700).cast("int").alias("distance_cm"),
        (F.col("event_id") % 2 == 1).alias("device_occ"),
    )


def spans(spark: SparkSession, sf_dir: str, mark: int = 42, length_s: float = 7200.0) -> DataFrame:
    """(name, sensor, start, end): a sample of the marking energy opens a ground-truth span."""
    s = samples(spark, sf_dir).where(F.col("energy") == mark)
    return s.select(F.concat(F.lit("span"), F.col("id")).alias("name"), "sensor", F.col("ts").alias("start"), (F.col("ts") + length_s).alias("end"))


def scan(df: DataFrame, sensor: str, start: float, end: float) -> DataFrame:
    """One sensor's rows of [start, end) in time order; both conditions reach the scan."""
    return df.where((F.col("sensor") == sensor) & (F.col("ts") >= start) & (F.col("ts") < end)).orderBy("ts")


#: The same tables as DuckDB sees them, for the SQL forms of the queries.
SQL_SAMPLES = "s as (select event_id as id, event_type as sensor, epoch(ts) as ts, (user_id % 9)::int as gate, (event_id % 2)::int as chan, json_extract_string(props, '$.k')::int as energy from events)"
SQL_FRAMES = (
    "e as (select *, json_extract_string(props, '$.k')::int as k from events), "
    "f as (select event_id as id, event_type as sensor, epoch(ts) as ts, "
    "list_transform(range(0, 9), lambda i: ((k + 13 * user_id + 7 * i * i + event_id) % 101)::int) as move, "
    "list_transform(range(0, 9), lambda i: ((3 * k + user_id + 11 * i) % 101)::int) as still, "
    "((k * 7) % 700)::int as distance_cm, event_id % 2 = 1 as device_occ from e)"
)
SQL_SPANS = "sp as (select 'span' || id as name, sensor, ts as start, ts + 7200.0 as \"end\" from s where energy = 42)"

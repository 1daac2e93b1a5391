"""Structured Streaming forms: rollups, bursts, the detector, throttling."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatelens.operators.automaton import Sensor
from gatelens.operators.replay import STATE, typed
from gatelens.plans.config import Config

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """(id, sensor, time, gate, chan, energy) from Parquet files as they come, so many a batch: Spark waits where a queue would drop."""
    e = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("sensor"), F.col("ts").cast("timestamp").alias("time"), (F.col("user_id") % 9).cast("int").alias("gate"),
        (F.col("event_id") % 2).cast("int").alias("chan"), F.get_json_object("props", "$.k").cast("int").alias("energy"),
    )


def rollup(samples: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling rollups, given out once the watermark has passed a window's end."""
    g = samples.withWatermark("time", late).groupBy(F.window("time", width), "sensor", "gate", "chan")
    return g.agg(F.percentile("energy", 0.5).alias("q50"), F.percentile("energy", 0.9).alias("q90"), F.max("energy").alias("qmax"), F.count("energy").alias("n"))


def bursts(samples: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows a sensor; only sessions that the watermark has closed come out."""
    g = samples.withWatermark("time", late).groupBy(F.session_window("time", gap), "sensor")
    return g.agg(F.max("energy").alias("peak"), F.count("*").alias("n"))


def detector(frames: DataFrame, config: Config) -> DataFrame:
    """The batch detector's rows from a stream of frames: the same object steps, kept as state a sensor.

    Frames of one batch are sorted; a frame older than the sensor's last one is stepped too and changes no timing, as in replay.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sensor = pickle.loads(state.get[0]) if state.exists else Sensor(config)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
        out = [{"sensor": key[0]} | sensor.step(r.ts, r.ts_mono, r.move, r.still, r.device_occ)[0] for r in rows.itertuples(index=False)]
        state.update((pickle.dumps(sensor),))
        yield typed(out, STATE)

    return frames.groupBy("sensor").applyInPandasWithState(run, STATE, "state binary", "append", GroupStateTimeout.NoTimeout)


def throttled(states: DataFrame, least_s: float) -> DataFrame:
    """At most one row a sensor in so many seconds, except where occupancy turns."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, was = state.get if state.exists else (-1e18, False)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        keep = []
        for r in rows.itertuples(index=False):
            if r.occupied != was or r.ts - last >= least_s:
                keep.append((key[0], r.ts, r.occupied, r.score))
                last, was = r.ts, r.occupied
        state.update((float(last), bool(was)))
        yield pd.DataFrame(keep, columns=["sensor", "ts", "occupied", "score"])

    return states.groupBy("sensor").applyInPandasWithState(run, "sensor string, ts double, occupied boolean, score double", "last double, was boolean", "append", GroupStateTimeout.NoTimeout)


def decoded(chunks: DataFrame) -> DataFrame:
    """Engineering reports from a stream of byte pieces (sensor, ts, id, data); what is left of a frame waits as state."""
    from gatelens.sources.wire import Cutter, report

    schema = "sensor string, ts double, id long, ts_mono double, move array<int>, still array<int>, distance_cm int, device_occ boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cutter, n = Cutter(), 0
        if state.exists:
            cutter.held, n = bytes(state.get[0]), state.get[1]
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable").itertuples(index=False):
            for kind, payload in cutter.feed(bytes(r.data)):
                if kind == "report" and (got := report(payload)):
                    out.append((key[0], r.ts, n, r.ts, got["move"], got["still"], got["distance_cm"], got["device_occ"]))
                    n += 1
        state.update((cutter.held, n))
        yield pd.DataFrame(out, columns=["sensor", "ts", "id", "ts_mono", "move", "still", "distance_cm", "device_occ"])

    return chunks.groupBy("sensor").applyInPandasWithState(run, schema, "held binary, n long", "append", GroupStateTimeout.NoTimeout)


def appended(df: DataFrame, path: str, checkpoint: str, every: str | None = "1 second"):
    """Appends a stream to Parquet, a commit a trigger; without an interval what is there now. Returns the running query."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()

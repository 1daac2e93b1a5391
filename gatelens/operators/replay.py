"""Ordered folds over partitions: rows of a sensor stay together, in time order, and pass by in batches.

Only the sensors' states are held, however long a stream is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.plans.config import Config

from .automaton import Sensor
from .learned import RunLengths

STATE = (
    "sensor string, ts double, occupied boolean, confidence double, score double, active_gates array<int>, rejection string, "
    "leading_gate int, anchored boolean, frozen boolean, baseline_ready boolean, gate_classes string, boundary_gate int, retention_max double, owned array<int>"
)
EPISODE = (
    "sensor string, scope string, gate int, t0 double, t1 double, peak double, lo int, hi int, centroid double, velocity double, "
    "still_frac double, active_frac double, result string, leading_gate int"
)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def ordered(df: DataFrame, *keys: str, by: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """All rows of a key in one partition, in order: the only shuffle of a fold.

    The number of partitions is given: few bytes are much work here, so small
    ones are not to be put together.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *by)


def typed(rows: list[dict], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names(schema))
    for c in ("gate", "lo", "hi", "leading_gate", "boundary_gate"):
        if c in out:
            out[c] = out[c].astype("Int32")
    return out


def replay(frames: DataFrame, config: Config, emit: str = "states") -> DataFrame:
    """The detector over every sensor's frames: a row a frame, or the closed episodes, or the turns of occupancy.

    frames: (sensor, ts, id, move, still, device_occ) and, where a process may
    have restarted, ts_mono. Frames of equal time go by id.
    """
    if emit not in ("states", "episodes", "transitions"):
        raise ValueError(f"can't emit {emit!r}")
    if "ts_mono" not in frames.columns:
        frames = frames.withColumn("ts_mono", F.col("ts"))
    rows = ordered(frames.select("sensor", "ts", "id", "ts_mono", "move", "still", "device_occ"), "sensor")
    schema = EPISODE if emit == "episodes" else STATE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, sensor, was = None, None, False
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.sensor != name:
                    if sensor is not None and emit == "episodes":
                        out += [{"sensor": name} | e for e in sensor._close_all()]
                    name, sensor, was = r.sensor, Sensor(config), False
                state, closed = sensor.step(r.ts, r.ts_mono, r.move, r.still, r.device_occ)
                if emit == "episodes":
                    out += [{"sensor": name} | e for e in closed]
                elif emit == "states" or state["occupied"] != was:
                    out.append({"sensor": name} | state)
                was = state["occupied"]
            yield typed(out, schema)
        if sensor is not None and emit == "episodes":
            yield typed([{"sensor": name} | e for e in sensor._close_all()], schema)

    return rows.mapInPandas(run, schema)


def fold(df: DataFrame, keys: tuple[str, ...], make: Callable, step: Callable, schema: str, by: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Any ordered recurrence: make() gives a key's state, step(state, row) the columns of an output row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (key := tuple(getattr(r, k) for k in keys)) != name:
                    name, state = key, make()
                out.append(step(state, r))
            yield pd.DataFrame(out, columns=names(schema))

    return ordered(df, *keys, by=by).mapInPandas(run, schema)


def fold_times(df: DataFrame, keys: tuple[str, ...], make: Callable, steps: Callable, schema: str) -> DataFrame:
    """A fold where a key's rows of equal ts are taken together: steps(state, rows) gives a tuple of columns a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, held = None, None, []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                if held and (key != name or r.ts != held[0].ts):
                    out += steps(state, held)
                    held = []
                if key != name:
                    name, state = key, make()
                held.append(r)
            yield pd.DataFrame(out, columns=names(schema))
        if held:
            yield pd.DataFrame(steps(state, held), columns=names(schema))

    return ordered(df, *keys).mapInPandas(run, schema)


def fold_blocks(df: DataFrame, keys: tuple[str, ...], make: Callable, many: Callable, schema: str) -> DataFrame:
    """A fold over blocks of a key's rows, where those of equal ts lie in one block: many(state, table) gives arrays, a column each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, held = None, None, []

        def give(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = many(state, pa.Table.from_batches(rows).combine_chunks())
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, from_pandas=True) for x in columns], names=names(schema))

        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            cuts = [k for k, (x, y) in enumerate(pairwise(rows), 1) if x != y]
            for a, b in pairwise([0, *cuts, len(rows)]):
                if not b:
                    continue
                if rows[a] != name:
                    if held:
                        yield give(held)
                    name, state, held = rows[a], make(), []
                ts = batch.column("ts").slice(a, b - a).to_numpy(zero_copy_only=False)
                other = np.flatnonzero(ts != ts[-1])
                cut = min(int(other[-1]) + 1, b - a - 1) if len(other) else 0  # rows of the last time may go on
                if held and (cut or held[-1].column("ts")[-1].as_py() != ts[0]):
                    if cut:
                        held.append(batch.slice(a, cut))
                    yield give(held)
                    held = []
                elif cut:
                    yield give([batch.slice(a, cut)])
                held.append(batch.slice(a + cut, b - a - cut))
        if held:
            yield give(held)

    return ordered(df, *keys).mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row of numbers a list, all of one length; what is null is no number."""
    flat = column.combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def ema(df: DataFrame, value: str, tau_s: float, *keys: str, block: float = 500.0) -> DataFrame:
    """(id, ema): s += (1 - exp(-dt / tau)) * (value - s); the first value as it is, repeated times change nothing.

    It is linear, so no fold: a row adds the step from the value before, which
    has decayed by exp(-age / tau) later on. Sums of steps times exp(ts / tau)
    are windows; they are kept within blocks of so many time constants, so that
    no factor grows without bound, and a block begins with the sum that the ones
    before it leave.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    x = F.col(value).cast("double")
    age = (F.col("ts") - F.min("ts").over(Window.partitionBy(*keys))) / tau_s
    rows = df.select(*keys, "ts", "id", x.alias("x"), age.alias("age"))
    rows = rows.withColumns({"block": F.floor(F.col("age") / block), "was": F.lag("ts").over(w), "n": F.row_number().over(w)})
    # a row of a repeated time gives nothing; any other one pulls towards its value over the time since the row before
    pull = F.when(F.col("n") == 1, F.col("x")).when(F.col("ts") > F.col("was"), (1 - F.exp(-(F.col("ts") - F.col("was")) / tau_s)) * F.col("x")).otherwise(0.0)
    part = F.col("age") - F.col("block") * block
    rows = rows.withColumn("grown", pull * F.exp(part)).withColumn("part", part)
    ends = rows.groupBy(*keys, "block").agg((F.sum("grown") * F.exp(-F.lit(block))).alias("left"))
    # what two blocks ago left has decayed to nothing by the end of the last one
    carried = ends.select(*keys, (F.col("block") + 1).alias("block"), "left")
    sums = F.sum("grown").over(Window.partitionBy(*keys, "block").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("sum", sums).join(carried, [*keys, "block"], "left")
    return rows.select("id", ((F.col("sum") + F.coalesce("left", F.lit(0.0))) * F.exp(-F.col("part"))).alias("ema"))


def changepoints(df: DataFrame, values: str, floor: list[float], spread: list[float], *keys: str) -> DataFrame:
    """(id, short, ago): of an array column's joint changepoints, the probability of a run of few rows and, where it rises over one half, how many rows ago the run began."""
    f, d = np.array(floor), np.array(spread)

    def step(s: RunLengths, r) -> tuple:
        ago = s.step(np.asarray(getattr(r, values), float), f, d)
        return r.id, s.mass, -1 if ago is None else ago

    return fold(df, keys, RunLengths, step, "id long, short double, ago long")


def hold_grid(df: DataFrame, step_s: float, *keys: str) -> DataFrame:
    """(keys, tick, ...): each row held on a regular grid until the next one, from the key's first row on."""
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    first = F.min("ts").over(Window.partitionBy(*keys))
    # ticks lie strictly before the next row
    rows = df.withColumns({"__a": F.ceil((F.col("ts") - first) / step_s), "__b": F.ceil((F.lead("ts").over(w) - first) / step_s) - 1})
    return rows.where(F.col("__b") >= F.col("__a")).withColumn("tick", F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")

"""Gaps and islands: transitions, runs, sessions, blocks, hold timers, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_by(*keys: str, by: tuple[str, ...] = ("ts", "id")):
    return Window.partitionBy(*keys).orderBy(*by)


def transitions(df: DataFrame, flag: str, *keys: str, by: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """The rows where the flag differs from the row before; before the first one it is false."""
    w = order_by(*keys, by=by)
    return df.withColumn("__was", F.lag(flag, 1, False).over(w)).where(F.col(flag) != F.col("__was")).drop("__was")


def occupied_runs(df: DataFrame, flag: str, horizon: Column, *keys: str, by: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """(keys, start, end): from each turn to true to the next turn to false, or to the horizon."""
    turns = transitions(df, flag, *keys, by=by)
    w = order_by(*keys, by=by)
    turns = turns.withColumn("end", F.lead("ts").over(w))
    return turns.where(F.col(flag)).select(*keys, F.col("ts").alias("start"), F.coalesce("end", horizon).alias("end"))


def islands(df: DataFrame, breaks: Column, *keys: str, by: tuple[str, ...] = ("ts", "id"), name: str = "island") -> DataFrame:
    """df with a number that grows by one wherever breaks holds."""
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(order_by(*keys, by=by)))


def gap_over(seconds: float, *keys: str, by: tuple[str, ...] = ("ts", "id")) -> Column:
    """Whether more than that many seconds lie since the row before: a gap of exactly that many joins."""
    return F.col("ts") - F.lag("ts").over(order_by(*keys, by=by)) > seconds


def gap_from(seconds: float, *keys: str, by: tuple[str, ...] = ("ts", "id")) -> Column:
    """As gap_over, but a gap of exactly that many seconds breaks."""
    return F.col("ts") - F.lag("ts").over(order_by(*keys, by=by)) >= seconds


def sessions(df: DataFrame, gap_s: float, *keys: str) -> DataFrame:
    """df with a session number; sessions go on while gaps are at most gap_s."""
    return islands(df, gap_over(gap_s, *keys), *keys, name="session")


def bursts(df: DataFrame, gap_s: float, level: str, *keys: str) -> DataFrame:
    """(keys, session, start, end, peak, n) of the runs of rows with gaps of at most gap_s."""
    return sessions(df, gap_s, *keys).groupBy(*keys, "session").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.max(level).alias("peak"), F.count("*").alias("n")
    )


def blocks(df: DataFrame, gap_s: float, least_s: float, least_n: int, *keys: str) -> DataFrame:
    """Sessions that last long enough or have enough rows."""
    s = sessions(df, gap_s, *keys).groupBy(*keys, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return s.where((F.col("end") - F.col("start") >= least_s) | (F.col("n") >= least_n))


def flag_runs(df: DataFrame, flag: str, *keys: str, gap_s: float | None = None, by: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """(keys, flag, run, start, end, n): runs of equal flags, broken too by gaps over gap_s."""
    w = order_by(*keys, by=by)
    breaks = F.col(flag) != F.lag(flag).over(w)
    if gap_s is not None:
        breaks = breaks | gap_over(gap_s, *keys, by=by)
    return islands(df, breaks, *keys, by=by, name="run").groupBy(*keys, flag, "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


def longest_runs(df: DataFrame, flag: str, *keys: str, gap_s: float | None = None) -> DataFrame:
    """(keys, flag, longest): the longest run's seconds of each kind."""
    return flag_runs(df, flag, *keys, gap_s=gap_s).groupBy(*keys, flag).agg(F.max(F.col("end") - F.col("start")).alias("longest"))


def held(df: DataFrame, flag: str, hold_s: float, *keys: str, name: str = "held") -> DataFrame:
    """df with whether the flag held now or at most hold_s ago."""
    w = order_by(*keys).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(flag), F.col("ts")), ignorenulls=True).over(w)
    return df.withColumn(name, F.coalesce(F.col("ts") - last <= hold_s, F.lit(False)))


def confirmed(df: DataFrame, flag: str, rows: int, within_s: float, *keys: str, name: str = "confirmed") -> DataFrame:
    """df with whether the last rows all had the flag and lie within so many seconds."""
    w = order_by(*keys)
    last = w.rowsBetween(1 - rows, 0)
    every = (F.min(F.col(flag).cast("int")).over(last) == 1) & (F.count("*").over(last) == rows)
    return df.withColumn(name, every & F.coalesce(F.col("ts") - F.lag("ts", rows - 1).over(w) <= within_s, F.lit(False)))


def micros(ts: str = "ts") -> Column:
    """Whole microseconds, for window ranges."""
    return F.round(F.col(ts) * 1e6).cast("long")


def count_within(seconds: float, *keys: str) -> Column:
    """Rows of the last so many seconds, bounds included."""
    return F.count("*").over(Window.partitionBy(*keys).orderBy(micros()).rangeBetween(-round(seconds * 1e6), 0))


def episodes(df: DataFrame, value: str, on: float, off: float, gap_s: float, stall_s: float, *keys: str) -> DataFrame:
    """(keys, episode, t0, t1, peak, n): hysteresis sessions.

    A session opens at a value of at least on. It goes on while rows of at least
    off come with less than gap_s between them and no two rows of any kind are
    more than stall_s apart. It ends at its last row of at least off.
    """
    rows = islands(df.where(F.col(value).isNotNull()), gap_over(stall_s, *keys), *keys, name="stretch")
    alive = rows.where(F.col(value) >= off)
    breaks = (F.col("stretch") != F.lag("stretch").over(order_by(*keys))) | gap_from(gap_s, *keys)
    alive = islands(alive, breaks, *keys, name="episode")
    w = order_by(*keys, "episode").rowsBetween(Window.unboundedPreceding, 0)
    # rows before the first strong one of a candidate don't belong to it
    opened = alive.withColumn("open", F.max((F.col(value) >= on).cast("int")).over(w)).where("open = 1")
    return opened.groupBy(*keys, "episode").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.max(value).alias("peak"), F.count("*").alias("n"))


def run_summary(df: DataFrame, flag: str, *keys: str) -> DataFrame:
    """(keys, t0, t1, peak, lo, hi, still_frac) of the occupied runs of rows with score, lo, hi and still."""
    w = order_by(*keys)
    runs = islands(df, F.col(flag) != F.lag(flag).over(w), *keys, name="run").where(F.col(flag))
    return runs.groupBy(*keys, "run").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.max("score").alias("peak"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.avg(F.col("still").cast("double")).alias("still_frac")
    )


#: Results of an episode that no entry followed, the first that applies.
REJECTIONS = ("coherence", "leading_edge", "arrival", "energy_floor", "hysteresis")


def result_label(entered: Column, ever_active: Column, reasons: Column) -> Column:
    out = F.when(entered, "entered").when(~ever_active, "rejected_coherence")
    for reason in REJECTIONS[1:-1]:
        out = out.when(F.array_contains(reasons, "rejected_" + reason), "rejected_" + reason)
    return out.otherwise("rejected_hysteresis")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those of equal keys; of several new ones the one of the greatest seq."""
    last = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc("seq"))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__new", "__k")

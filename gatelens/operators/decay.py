"""Exponential decay in closed form: sums and maxima of half-life weights, without a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight(age_s: Column, half_life_s: float) -> Column:
    """Half for every half-life; times that run backwards don't bring anything back."""
    return F.pow(F.lit(0.5), F.greatest(age_s, F.lit(0.0)) / half_life_s)


def decayed_count(events: DataFrame, now: Column, half_life_s: float, *keys: str, name: str = "count") -> DataFrame:
    """(keys, count) as of now."""
    return events.groupBy(*keys).agg(F.sum(weight(now - F.col("ts"), half_life_s)).alias(name))


def decayed_peak(df: DataFrame, value: str, half_life_s: float, *keys: str, name: str = "peak") -> DataFrame:
    """df with the greatest value so far, each halved for every half-life since.

    log2(value) + ts / half_life grows for a value that wins later, so a running
    maximum finds the winner; zeros never win.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(F.when(F.col(value) > 0, F.log2(value) + F.col("ts") / half_life_s)).over(w)
    return df.withColumn(name, F.coalesce(F.pow(F.lit(2.0), top - F.col("ts") / half_life_s), F.lit(0.0)))


def ever(df: DataFrame, condition: Column, *keys: str, name: str = "ever") -> DataFrame:
    """df with whether the condition has held up to now."""
    w = Window.partitionBy(*keys).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.bool_or(condition).over(w), F.lit(False)))


def dwell_class(sustained: Column, brief: Column, stale_s: Column, half_life_s: float) -> Column:
    """in_room on sustained evidence; bleed on many brief visits without any for a half-life; else null."""
    return F.when(sustained >= 1, "in_room").when((brief >= 20) & (sustained < 0.5) & (F.coalesce(stale_s, F.lit(1e18)) > half_life_s), "bleed")


def portal_class(lead: Column, dead: Column) -> Column:
    return F.when((lead >= 5) & (lead >= 0.3 * (lead + dead)), "portal")


def by_precedence(sustained: Column, portal: Column, bleed: Column, stale: Column) -> Column:
    """The class of the first rule that applies: sustained, portal, bleed, a stale in-room, unknown."""
    return F.when(sustained, "in_room").when(portal, "portal").when(bleed, "bleed").when(stale, "in_room").otherwise("unknown")


def effective_class(evidence: Column, gate: Column, cap: Column | None, boundary: Column | None) -> Column:
    """A manual cap goes before a learned boundary, that before the evidence."""
    out = evidence
    if boundary is not None:
        out = F.when(boundary.isNotNull() & (gate >= boundary), "out").otherwise(out)
    return out if cap is None else F.when(cap.isNotNull() & (gate > cap), "out").otherwise(out)


def theil_sen(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, slope, top): the median of all pairs' slopes, and the greatest residual as intercept. Points are few a key."""
    a = points.select(*keys, F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = points.select(*keys, F.col(x).alias("x2"), F.col(y).alias("y2"))
    slope = a.join(b, list(keys)).where("x1 < x2").groupBy(*keys).agg(F.percentile((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")), 0.5).alias("slope"))
    return points.join(slope, list(keys)).groupBy(*keys, "slope").agg(F.max(F.col(y) - F.col("slope") * F.col(x)).alias("top"))


def boundary_gate(profile: DataFrame, level: str, cut: float, *keys: str, least: int = 2) -> DataFrame:
    """(keys, boundary): the smallest gate from least on from which all evaluated levels are under the cut."""
    w = Window.partitionBy(*keys).orderBy(F.desc("gate"))
    rest = profile.withColumns({"top": F.max(level).over(w), "seen": F.count(level).over(w)})
    ok = (F.col("gate") >= least) & (F.col("seen") > 0) & (F.col("top") < cut)
    return rest.groupBy(*keys).agg(F.min(F.when(ok, F.col("gate"))).alias("boundary"))


def confirmed_candidate(evaluations: DataFrame, candidate: str, times: int, *keys: str) -> DataFrame:
    """Evaluations (keys, at, candidate) where it has been the same, and not null, so many times in a row."""
    w = Window.partitionBy(*keys).orderBy("at")
    change = F.coalesce(~F.col(candidate).eqNullSafe(F.lag(candidate).over(w)), F.lit(True)).cast("int")
    e = evaluations.withColumn("__run", F.sum(change).over(w))
    e = e.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__run").orderBy("at")))
    return e.where(F.col(candidate).isNotNull() & (F.col("__n") >= times)).drop("__run", "__n")

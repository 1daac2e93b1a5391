"""Time buckets: rollups, closing rules, rolling baselines, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("sensor", "chan", "gate")


def bucket_of(ts: Column, bucket_s: float) -> Column:
    return F.floor(ts / bucket_s).cast("long")


def rollup(samples: DataFrame, bucket_s: float = 60.0) -> DataFrame:
    """(sensor, bucket, gate, chan) -> q50, q90, qmax, n; quantiles are exact, with linear interpolation."""
    keyed = samples.withColumn("bucket", bucket_of(F.col("ts"), bucket_s))
    return keyed.groupBy("sensor", "bucket", "gate", "chan").agg(
        F.percentile("energy", 0.5).alias("q50"),
        F.percentile("energy", 0.9).alias("q90"),
        F.max("energy").cast("double").alias("qmax"),
        F.count("energy").alias("n"),
    )


def rollup_since(samples: DataFrame, done: DataFrame, now: float, bucket_s: float = 60.0) -> DataFrame:
    """The rollup of each sensor's buckets after the last one done and before that of now."""
    last = done.groupBy("sensor").agg(F.max("bucket").alias("last"))
    todo = samples.withColumn("b", bucket_of(F.col("ts"), bucket_s)).join(last, "sensor", "left")
    todo = todo.where((F.col("b") > F.coalesce("last", F.lit(-(2**62)))) & (F.col("b") < int(now // bucket_s)))
    return rollup(todo.drop("b", "last"), bucket_s)


def retained(rows: DataFrame, cutoff: float, ts: str = "ts") -> DataFrame:
    """What a retention delete leaves: rows not before the cutoff."""
    return rows.where(F.col(ts) >= cutoff)


def closed(samples: DataFrame, bucket_s: float) -> DataFrame:
    """(sensor, bucket, ordinal): buckets that closed, numbered in order.

    A bucket closes when the sensor's next sample is in the bucket after it; one
    that a gap follows is discarded, and the last is still open.
    """
    seen = samples.select("sensor", bucket_of(F.col("ts"), bucket_s).alias("bucket")).distinct()
    order = Window.partitionBy("sensor").orderBy("bucket")
    kept = seen.withColumn("next", F.lead("bucket").over(order)).where(F.col("next") - F.col("bucket") == 1)
    return kept.select("sensor", "bucket", F.row_number().over(order).cast("long").alias("ordinal"))


def closed_levels(samples: DataFrame, bucket_s: float) -> DataFrame:
    """(sensor, chan, gate, bucket, ordinal, med, tail): median and q90 - q50 of each cell's closed buckets."""
    rolled = rollup(samples, bucket_s).join(closed(samples, bucket_s), ["sensor", "bucket"])
    return rolled.select(*CELL, "bucket", "ordinal", F.col("q50").alias("med"), F.greatest(F.lit(0.0), F.col("q90") - F.col("q50")).alias("tail"))


def rolling_baseline(levels: DataFrame, buckets: int, min_mad: float = 1.0) -> DataFrame:
    """levels with floor and spread: the lower quartiles over the cell's last buckets, the spread not under min_mad."""
    w = Window.partitionBy(*CELL).orderBy("bucket").rowsBetween(1 - buckets, 0)
    floor = F.percentile("med", 0.25).over(w)
    spread = F.greatest(F.percentile("tail", 0.25).over(w), F.lit(min_mad), F.lit(1e-6))
    return levels.withColumns({"floor": floor, "spread": spread})


def histogram(samples: DataFrame, *keys: str) -> DataFrame:
    """(keys, energy, n)."""
    return samples.groupBy(*(keys or CELL), "energy").agg(F.count("*").alias("n"))


def histogram_map(samples: DataFrame, *keys: str) -> DataFrame:
    """(keys, bins): energy -> count as a map."""
    keys = keys or CELL
    return histogram(samples, *keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("energy", "n")))).alias("bins"))


def dominant_mode(hist: DataFrame, *keys: str) -> DataFrame:
    """The energy with the greatest count, the lowest of equals."""
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("energy")))
    return hist.groupBy(*(keys or CELL)).agg(best.alias("best")).select(*(keys or CELL), F.col("best.energy").alias("mode"), (-F.col("best.m")).alias("mass"))


def weighted_median_mid(hist: DataFrame, *keys: str) -> DataFrame:
    """The mean of the two middle ranks."""
    return hist.groupBy(*(keys or CELL)).agg(F.percentile("energy", 0.5, F.col("n")).alias("median"))


def cumulative(hist: DataFrame, keys: tuple[str, ...], value: str, weight: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return hist.withColumns({"cum": F.sum(weight).over(w.orderBy(value)), "all": F.sum(weight).over(w)})


def weighted_quantile(hist: DataFrame, q: float, keys: tuple[str, ...] = CELL, value: str = "energy", weight: str = "n") -> DataFrame:
    """The least value whose cumulative weight reaches q of the total."""
    reached = cumulative(hist, keys, value, weight).where(F.col("cum") >= q * F.col("all"))
    return reached.groupBy(*keys).agg(F.min(value).alias("value"))


def mode_spread(hist: DataFrame, keys: tuple[str, ...] = CELL, reach: int = 6, min_mad: float = 1.0) -> DataFrame:
    """(keys, mode, spread): the weighted median distance from the mode of energies within reach of it."""
    modes = dominant_mode(hist, *keys)
    near = hist.join(modes, list(keys)).withColumn("away", F.abs(F.col("energy") - F.col("mode"))).where(F.col("away") <= reach)
    near = near.groupBy(*keys, "mode", "away").agg(F.sum("n").alias("n"))
    mad = weighted_quantile(near, 0.5, (*keys, "mode"), "away")
    return mad.select(*keys, "mode", F.greatest(F.col("value").cast("double"), F.lit(min_mad)).alias("spread"))


def rolling_histogram(samples: DataFrame, bucket_s: float, buckets: int) -> DataFrame:
    """(cell, ordinal, energy, n): counts over each closed bucket and those before it, as many as buckets.

    Each count is added at its own ordinal and taken away buckets later, so the
    window costs two rows a count, whatever its length.
    """
    known = closed(samples, bucket_s)
    counts = samples.withColumn("bucket", bucket_of(F.col("ts"), bucket_s)).join(known, ["sensor", "bucket"])
    counts = counts.groupBy(*CELL, "ordinal", "energy").agg(F.count("*").alias("n"))
    last = known.groupBy("sensor").agg(F.max("ordinal").alias("last"))
    change = counts.unionByName(counts.select(*CELL, (F.col("ordinal") + buckets).alias("ordinal"), "energy", (-F.col("n")).alias("n")))
    change = change.join(last, "sensor").where(F.col("ordinal") <= F.col("last")).groupBy(*CELL, "energy", "ordinal").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*CELL, "energy").orderBy("ordinal")
    return change.select(*CELL, "energy", "ordinal", F.sum("n").over(w).alias("n"))


def recurring_peak(hist: DataFrame, keys: tuple[str, ...] = CELL, width: int = 2, least_mass: float = 3.0) -> DataFrame:
    """(keys, level): the median within the lowest bin that is a local maximum of enough mass, else the dominant bin."""
    bins = hist.withColumn("bin", F.floor(F.col("energy") / width).cast("int")).groupBy(*keys, "bin").agg(F.sum("n").alias("mass"))
    w = Window.partitionBy(*keys).orderBy("bin")
    beside = lambda f, d: F.when(f("bin").over(w) == F.col("bin") + d, f("mass").over(w)).otherwise(0)
    bins = bins.withColumn("top", (F.col("mass") > beside(F.lag, -1)) & (F.col("mass") >= beside(F.lead, 1)) & (F.col("mass") >= least_mass))
    chosen = bins.groupBy(*keys).agg(F.min(F.when(F.col("top"), F.col("bin"))).alias("low"), F.min(F.struct((-F.col("mass")).alias("m"), "bin")).alias("best"))
    chosen = chosen.select(*keys, F.coalesce("low", "best.bin").alias("bin"))
    inside = hist.withColumn("bin", F.floor(F.col("energy") / width).cast("int")).join(chosen, [*keys, "bin"])
    return inside.groupBy(*keys).agg(F.percentile("energy", 0.5, F.col("n")).alias("level"))


def observed_seconds(samples: DataFrame, most: float) -> DataFrame:
    """(sensor, observed): the time between samples, a gap counting for at most that many seconds."""
    w = Window.partitionBy("sensor").orderBy("ts", "id")
    step = F.least(F.greatest(F.col("ts") - F.lag("ts").over(w), F.lit(0.0)), F.lit(most))
    return samples.select("sensor", step.alias("step")).groupBy("sensor").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("observed"))


def three_class_split(hist: DataFrame, keys: tuple[str, ...] = ("sensor",), top: int = 100) -> DataFrame:
    """(keys, lower, upper): the cuts of 0..top into three classes with the greatest variance between them.

    Equal variances go to the lowest cuts. Pairs of cuts are bounded by top, not by the data.
    """
    bins = hist.groupBy(*keys, "energy").agg(F.sum("n").cast("double").alias("w"))
    grid = hist.select(*keys).distinct().withColumn("energy", F.explode(F.sequence(F.lit(0), F.lit(top))))
    w = Window.partitionBy(*keys).orderBy("energy")
    cum = grid.join(bins, [*keys, "energy"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    cum = cum.select(*keys, "energy", F.sum("w").over(w).alias("n"), F.sum(F.col("w") * F.col("energy")).over(w).alias("m"))
    every = cum.groupBy(*keys).agg(F.max("n").alias("all_n"), F.max("m").alias("all_m"))
    low = cum.select(*keys, F.col("energy").alias("lower"), F.col("n").alias("n1"), F.col("m").alias("m1"))
    high = cum.select(*keys, F.col("energy").alias("upper"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    pairs = low.join(high, list(keys)).where("lower < upper and upper < " + str(top)).join(every, list(keys))
    part = lambda n, m: F.when(n > 0, m * m / n).otherwise(0.0)
    between = part(F.col("n1"), F.col("m1")) + part(F.col("n2") - F.col("n1"), F.col("m2") - F.col("m1")) + part(F.col("all_n") - F.col("n2"), F.col("all_m") - F.col("m2"))
    best = F.min(F.struct((-F.round(between, 6)).alias("b"), "lower", "upper"))
    return pairs.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.lower", "best.upper")

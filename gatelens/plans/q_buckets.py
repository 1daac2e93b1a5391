"""Queries on buckets, baselines and histograms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatelens.functions import arrays as A
from gatelens.operators import buckets as B
from gatelens.sources.tables import SQL_FRAMES, SQL_SAMPLES, frames, samples, scan

from .registry import query, r6

HOUR, DAY = 3600.0, 86_400.0
T0 = 1_704_067_200.0


@query("src1_frame_scan", SQL_SAMPLES, sql=f"select id, sensor, ts, energy from s where sensor = 'click' and ts >= {T0 + DAY} and ts < {T0 + 8 * DAY}")
def src1(spark, d):
    return scan(samples(spark, d), "click", T0 + DAY, T0 + 8 * DAY).select("id", "sensor", "ts", "energy")


@query("src3_sensors", SQL_SAMPLES, sql="select distinct sensor from s order by sensor")
def src3(spark, d):
    return samples(spark, d).select("sensor").distinct().orderBy("sensor")


ROLL = "r as (select sensor, floor(ts / 3600)::bigint as bucket, gate, chan, quantile_cont(energy, 0.5) as q50, quantile_cont(energy, 0.9) as q90, max(energy)::double as qmax, count(energy) as n from s group by all)"


@query("agg2_rollup", SQL_SAMPLES, ROLL, sql="select sensor, bucket, gate, chan, round(q50, 6) as q50, round(q90, 6) as q90, qmax, n from r")
def agg2(spark, d):
    r = B.rollup(samples(spark, d), HOUR)
    return r.select("sensor", "bucket", "gate", "chan", r6(F.col("q50"), "q50"), r6(F.col("q90"), "q90"), "qmax", "n")


@query("agg1_quantiles", SQL_SAMPLES, sql="select sensor, gate, chan, round(quantile_cont(energy, 0.25), 6) as q25, round(quantile_cont(energy, 0.5), 6) as q50, round(quantile_cont(energy, 0.9), 6) as q90 from s group by all")
def agg1(spark, d):
    got = samples(spark, d).groupBy("sensor", "gate", "chan").agg(F.percentile("energy", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("q"))
    return got.select("sensor", "gate", "chan", *(r6(F.col("q")[i], n) for i, n in enumerate(("q25", "q50", "q90"))))


@query("agg3_rollup_increment", SQL_SAMPLES, ROLL, "l as (select sensor, max(bucket) as last from r where bucket < 473400 group by sensor)", "m as (select max(ts) as now from s)", sql="select sensor, bucket, gate, chan, n, qmax from r left join l using (sensor) where bucket > coalesce(last, -1) and bucket < (select floor(now / 3600) from m)")
def agg3(spark, d):
    s = samples(spark, d)
    done = B.rollup(s.where(F.col("ts") < 473_400 * HOUR), HOUR)
    now = s.agg(F.max("ts")).first()[0]
    return B.rollup_since(s, done, now, HOUR).select("sensor", "bucket", "gate", "chan", "n", "qmax")


@query("agg4_retention", SQL_SAMPLES, sql="select sensor, count(*) as n, min(ts) as first from s where ts >= (select max(ts) - 7 * 86400.0 from s) group by sensor")
def agg4(spark, d):
    s = samples(spark, d)
    cutoff = s.agg(F.max("ts")).first()[0] - 7 * DAY
    return B.retained(s, cutoff).groupBy("sensor").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


CLOSED = "b0 as (select distinct sensor, floor(ts / 3600)::bigint as bucket from s), b1 as (select *, lead(bucket) over (partition by sensor order by bucket) as nxt from b0), c as (select sensor, bucket, row_number() over (partition by sensor order by bucket) as ordinal from b1 where nxt - bucket = 1)"


@query("win1_closed_buckets", SQL_SAMPLES, CLOSED, sql="select * from c")
def win1(spark, d):
    return B.closed(samples(spark, d), HOUR)


LEVELS = "lv as (select sensor, chan, gate, bucket, ordinal, q50 as med, greatest(0.0, q90 - q50) as tail from r join c using (sensor, bucket))"


@query("agg5_6_bucket_levels", SQL_SAMPLES, ROLL, CLOSED, LEVELS, sql="select sensor, chan, gate, bucket, ordinal, round(med, 6) as med, round(tail, 6) as tail from lv")
def agg56(spark, d):
    x = B.closed_levels(samples(spark, d), HOUR)
    return x.select("sensor", "chan", "gate", "bucket", "ordinal", r6(F.col("med"), "med"), r6(F.col("tail"), "tail"))


BASE = "bl as (select *, quantile_cont(med, 0.25) over w as floor, greatest(quantile_cont(tail, 0.25) over w, 1.0, 1e-6) as spread from lv window w as (partition by sensor, chan, gate order by bucket rows between 23 preceding and current row))"


@query("win2_4_rolling_baseline", SQL_SAMPLES, ROLL, CLOSED, LEVELS, BASE, sql='select sensor, chan, gate, bucket, round(floor, 6) as "floor", round(spread, 6) as spread from bl')
def win24(spark, d):
    x = B.rolling_baseline(B.closed_levels(samples(spark, d), HOUR), 24)
    return x.select("sensor", "chan", "gate", "bucket", r6(F.col("floor"), "floor"), r6(F.col("spread"), "spread"))


@query(
    "prj1_residuals", SQL_SAMPLES, ROLL, CLOSED, LEVELS, BASE,
    "v as (select sensor, chan, gate, bucket, floor, spread, lead(bucket) over (partition by sensor, chan, gate order by bucket) as until from bl)",
    sql="select s.id, s.sensor, s.chan, s.gate, round((energy - floor) / spread, 6) as residual from s join v on s.sensor = v.sensor and s.chan = v.chan and s.gate = v.gate and floor(s.ts / 3600) > v.bucket and (until is null or floor(s.ts / 3600) <= until)",
)
def prj1(spark, d):
    """Every sample against the baseline of the buckets closed before its own."""
    s = samples(spark, d).withColumn("b", B.bucket_of(F.col("ts"), HOUR))
    base = B.rolling_baseline(B.closed_levels(s, HOUR), 24).select(*B.CELL, (F.col("bucket") + 1).alias("b"), "floor", "spread")
    # the latest baseline at or before the sample's bucket: one ordered pass over both
    both = s.select(*B.CELL, "b", "id", "energy", F.lit(1).alias("side"), F.lit(None).cast("double").alias("floor"), F.lit(None).cast("double").alias("spread"))
    both = both.unionByName(base.select(*B.CELL, "b", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("energy"), F.lit(0).alias("side"), "floor", "spread"))
    w = Window.partitionBy(*B.CELL).orderBy("b", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"floor": F.last("floor", True).over(w), "spread": F.last("spread", True).over(w)})
    return both.where("side = 1 and floor is not null").select("id", "sensor", "chan", "gate", r6((F.col("energy") - F.col("floor")) / F.col("spread"), "residual"))


@query("agg7_ceiling_levels", SQL_FRAMES, "c0 as (select sensor, floor(ts / 3600)::bigint as bucket, quantile_cont(list_max(move), 0.9) as level from f group by all)", sql="select sensor, bucket, round(level, 6) as level, round(max(level) over (partition by sensor order by bucket rows between 23 preceding and current row), 6) as ceiling from c0")
def agg7_13(spark, d):
    x = frames(spark, d).groupBy("sensor", B.bucket_of(F.col("ts"), HOUR).alias("bucket")).agg(F.percentile(F.array_max("move"), 0.9).alias("level"))
    w = Window.partitionBy("sensor").orderBy("bucket").rowsBetween(-23, 0)
    return x.select("sensor", "bucket", r6(F.col("level"), "level"), r6(F.max("level").over(w), "ceiling"))


HIST = "h as (select sensor, chan, gate, energy, count(*) as n from s group by all)"


@query("agg8_histogram", SQL_SAMPLES, HIST, sql="select sensor, chan, gate, string_agg(energy || ':' || n, ',' order by energy) as bins from h group by all")
def agg8(spark, d):
    m = B.histogram_map(samples(spark, d))
    text = F.array_join(F.transform(F.map_entries("bins"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return m.select("sensor", "chan", "gate", text.alias("bins"))


MODES = "m as (select sensor, chan, gate, energy as mode, n as mass from h qualify row_number() over (partition by sensor, chan, gate order by n desc, energy) = 1)"


@query("agg9_dominant_mode", SQL_SAMPLES, HIST, MODES, sql="select * from m")
def agg9(spark, d):
    return B.dominant_mode(B.histogram(samples(spark, d)))


CUM = "cu as (select *, sum(n) over (partition by sensor, chan, gate order by energy) as cum, sum(n) over (partition by sensor, chan, gate) as tot from h)"


@query("agg10_weighted_medians", SQL_SAMPLES, HIST, CUM, "a as (select sensor, chan, gate, quantile_cont(energy, 0.5) as mid from s group by all)", "b as (select sensor, chan, gate, min(energy) as low from cu where cum * 2 >= tot group by all)", sql="select sensor, chan, gate, round(mid, 6) as mid, low from a join b using (sensor, chan, gate)")
def agg10(spark, d):
    h = B.histogram(samples(spark, d))
    low = B.weighted_quantile(h, 0.5).withColumnRenamed("value", "low")
    return B.weighted_median_mid(h).join(low, list(B.CELL)).select(*B.CELL, r6(F.col("median"), "mid"), "low")


@query(
    "agg11_mode_spread", SQL_SAMPLES, HIST, MODES,
    "n1 as (select sensor, chan, gate, mode, abs(energy - mode) as away, sum(n) as n from h join m using (sensor, chan, gate) where abs(energy - mode) <= 6 group by all)",
    "n2 as (select *, sum(n) over (partition by sensor, chan, gate order by away) as cum, sum(n) over (partition by sensor, chan, gate) as tot from n1)",
    sql="select sensor, chan, gate, mode, greatest(min(away)::double, 1.0) as spread from n2 where cum * 2 >= tot group by all",
)
def agg11(spark, d):
    return B.mode_spread(B.histogram(samples(spark, d)))


@query("agg12_decayed_quantile", SQL_SAMPLES, "t as (select max(ts) as now from s)", "w as (select sensor, energy, round(sum(pow(0.5, (now - ts) / 604800.0)), 9) as n from s, t group by all)", "cu as (select *, round(sum(n) over (partition by sensor order by energy), 6) as cum, round(sum(n) over (partition by sensor), 6) as tot from w)", sql="select sensor, min(energy) as value from cu where cum >= 0.9 * tot group by sensor")
def agg12(spark, d):
    s = samples(spark, d)
    now = s.agg(F.max("ts").alias("now"))
    weighted = s.crossJoin(F.broadcast(now)).groupBy("sensor", "energy").agg(F.round(F.sum(F.pow(F.lit(0.5), (F.col("now") - F.col("ts")) / 604_800.0)), 9).alias("n"))  # now: one row
    cum = B.cumulative(weighted, ("sensor",), "energy", "n")
    return cum.where(F.round("cum", 6) >= 0.9 * F.round("all", 6)).groupBy("sensor").agg(F.min("energy").alias("value"))


@query(
    "agg14_three_class_split", SQL_SAMPLES,
    "hh as (select sensor, energy, count(*)::double as w from s group by all)",
    "g as (select sensor, unnest(range(0, 101))::int as energy from (select distinct sensor from s))",
    "cu as (select sensor, energy, sum(coalesce(w, 0)) over o as n, sum(coalesce(w, 0) * energy) over o as m from g left join hh using (sensor, energy) window o as (partition by sensor order by energy))",
    "al as (select sensor, max(n) as an, max(m) as am from cu group by sensor)",
    "p as (select sensor, a.energy as lower, b.energy as upper, round(case when a.n > 0 then a.m * a.m / a.n else 0 end + case when b.n - a.n > 0 then (b.m - a.m) * (b.m - a.m) / (b.n - a.n) else 0 end + case when an - b.n > 0 then (am - b.m) * (am - b.m) / (an - b.n) else 0 end, 6) as v from cu a join cu b using (sensor) join al using (sensor) where a.energy < b.energy and b.energy < 100)",
    sql="select sensor, lower, upper from p qualify row_number() over (partition by sensor order by v desc, lower, upper) = 1",
)
def agg14(spark, d):
    return B.three_class_split(B.histogram(samples(spark, d)))


@query(
    "win5_rolling_histogram", SQL_SAMPLES, CLOSED,
    "x as (select sensor, chan, gate, ordinal, energy, count(*) as n from s join c on s.sensor = c.sensor and floor(s.ts / 3600) = c.bucket group by s.sensor, chan, gate, ordinal, energy)".replace("select sensor", "select s.sensor as sensor"),
    "la as (select sensor, max(ordinal) as last from c group by sensor)",
    "y as (select * from x union all select sensor, chan, gate, ordinal + 24, energy, -n from x)",
    "z as (select sensor, chan, gate, energy, ordinal, sum(n) as n from y join la using (sensor) where ordinal <= last group by all)",
    sql="select sensor, chan, gate, energy, ordinal, (sum(n) over (partition by sensor, chan, gate, energy order by ordinal))::bigint as n from z",
)
def win5(spark, d):
    return B.rolling_histogram(samples(spark, d), HOUR, 24)


@query(
    "rec11_recurring_peak", SQL_SAMPLES, HIST,
    "bi as (select sensor, chan, gate, (energy // 2)::int as bin, sum(n) as mass from h group by all)",
    "bj as (select *, mass > coalesce(case when lag(bin) over o = bin - 1 then lag(mass) over o end, 0) and mass >= coalesce(case when lead(bin) over o = bin + 1 then lead(mass) over o end, 0) and mass >= 3 as top from bi window o as (partition by sensor, chan, gate order by bin))",
    "ch as (select sensor, chan, gate, coalesce(min(bin) filter (where top), arg_min(bin, (-mass, bin))) as bin from bj group by all)",
    sql="select sensor, chan, gate, round(quantile_cont(energy, 0.5), 6) as level from s join ch using (sensor, chan, gate) where energy // 2 = bin group by all",
)
def rec11(spark, d):
    x = B.recurring_peak(B.histogram(samples(spark, d)))
    return x.select(*B.CELL, r6(F.col("level"), "level"))


@query("rec12_observed_time", SQL_SAMPLES, "x as (select sensor, least(greatest(ts - lag(ts) over (partition by sensor order by ts, id), 0.0), 3600.0) as step from s)", sql="select sensor, round(coalesce(sum(step), 0), 3) as observed from x group by sensor")
def rec12(spark, d):
    return B.observed_seconds(samples(spark, d), HOUR).select("sensor", F.round("observed", 3).alias("observed"))


@query("win26_mean_downsample", SQL_SAMPLES, sql="select sensor, chan, floor(ts / 21600)::bigint as bucket, round(avg(energy), 6) as mean, count(*) as n from s group by all")
def win26(spark, d):
    return samples(spark, d).groupBy("sensor", "chan", B.bucket_of(F.col("ts"), 21_600.0).alias("bucket")).agg(r6(F.avg("energy"), "mean"), F.count("*").alias("n"))


@query("agg27_window_summaries", SQL_SAMPLES, sql="select sensor, floor(ts / 86400)::bigint as bucket, round(avg(energy), 6) as mean, round(quantile_cont(energy, 0.95), 6) as p95, round(stddev_pop(energy), 6) as sd, round(avg((energy >= 99)::int), 6) as saturated, round(sum(energy * gate) / nullif(sum(energy), 0)::double, 6) as centroid from s group by all")
def agg27(spark, d):
    g = samples(spark, d).groupBy("sensor", B.bucket_of(F.col("ts"), DAY).alias("bucket"))
    centroid = F.sum(F.col("energy") * F.col("gate")) / F.nullif(F.sum("energy"), F.lit(0)).cast("double")
    return g.agg(r6(F.avg("energy"), "mean"), r6(F.percentile("energy", 0.95), "p95"), r6(F.stddev_pop("energy"), "sd"), r6(F.avg((F.col("energy") >= 99).cast("int")), "saturated"), r6(centroid, "centroid"))


@query("agg18_totals_rollup", SQL_SAMPLES, sql="select sensor, chan, count(*) as n, sum(energy)::bigint as energy from s group by rollup(sensor, chan)")
def agg18(spark, d):
    return samples(spark, d).rollup("sensor", "chan").agg(F.count("*").alias("n"), F.sum("energy").alias("energy"))


@query("agg40_band_percentiles", SQL_FRAMES, "x as (select sensor, case when list_max(move) < 60 then 'low' when list_max(move) < 90 then 'mid' else 'high' end as band, list_max(move) / greatest(list_max(move) + list_max(still), 1)::double as share from f)", sql="select sensor, band, round(quantile_cont(share, 0.1), 6) as p10, round(quantile_cont(share, 0.5), 6) as p50, round(quantile_cont(share, 0.9), 6) as p90 from x group by all")
def agg40(spark, d):
    m, s = F.array_max("move"), F.array_max("still")
    x = frames(spark, d).select("sensor", F.when(m < 60, "low").when(m < 90, "mid").otherwise("high").alias("band"), (m / F.greatest(m + s, F.lit(1))).alias("share"))
    x = x.groupBy("sensor", "band").agg(F.percentile("share", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    return x.select("sensor", "band", *(r6(F.col("p")[i], n) for i, n in enumerate(("p10", "p50", "p90"))))

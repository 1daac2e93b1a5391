"""Queries on runs, sessions and episodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatelens.operators import islands as I
from gatelens.sources.tables import SQL_FRAMES, SQL_SAMPLES, frames, samples

from .registry import query, r6

FLAG = "g as (select *, energy >= 40 as hot from s)"
TURN = "t0 as (select *, lag(hot, 1, false) over (partition by sensor order by ts, id) as was from g), t as (select * from t0 where hot <> was)"


def flagged(spark, d):
    return samples(spark, d).withColumn("hot", F.col("energy") >= 40)


@query("win16_transitions", SQL_SAMPLES, FLAG, TURN, sql="select id, sensor, ts, hot from t")
def win16(spark, d):
    return I.transitions(flagged(spark, d), "hot", "sensor").select("id", "sensor", "ts", "hot")


RUNS = "ru as (select sensor, hot, ts as start, coalesce(lead(ts) over (partition by sensor order by ts, id), (select max(ts) from s)) as \"end\" from t)"


@query("win17_occupied_runs", SQL_SAMPLES, FLAG, TURN, RUNS, sql='select sensor, start, "end" from ru where hot')
def win17(spark, d):
    s = flagged(spark, d)
    horizon = F.lit(s.agg(F.max("ts")).first()[0])
    return I.occupied_runs(s, "hot", horizon, "sensor")


SESS = "sx as (select *, ts - lag(ts) over (partition by sensor order by ts, id) > 1800 as br from s), ss as (select *, count(*) filter (where coalesce(br, true)) over (partition by sensor order by ts, id) as session from sx)"


@query("rec6_bursts", SQL_SAMPLES, SESS, sql='select sensor, session, min(ts) as start, max(ts) as "end", max(energy) as peak, count(*) as n from ss group by all')
def rec6(spark, d):
    return I.bursts(samples(spark, d), 1800.0, "energy", "sensor")


@query("win21_blocks", SQL_SAMPLES, SESS, sql='select sensor, session, min(ts) as start, max(ts) as "end", count(*) as n from ss group by all having max(ts) - min(ts) >= 3600 or count(*) >= 5')
def win21(spark, d):
    return I.blocks(samples(spark, d), 1800.0, 3600.0, 5, "sensor")


FR = "fr0 as (select *, hot <> lag(hot) over (partition by sensor order by ts, id) or ts - lag(ts) over (partition by sensor order by ts, id) > 7200 as br from g), fr as (select sensor, hot, run, min(ts) as start, max(ts) as \"end\", count(*) as n from (select *, count(*) filter (where coalesce(br, true)) over (partition by sensor order by ts, id) as run from fr0) group by all)"


@query("agg41_run_statistics", SQL_SAMPLES, FLAG, FR, sql='select sensor, hot, count(*) as runs, sum(n)::bigint as n, round(max("end" - start), 3) as longest from fr group by all')
def agg41(spark, d):
    r = I.flag_runs(flagged(spark, d), "hot", "sensor", gap_s=7200.0)
    return r.groupBy("sensor", "hot").agg(F.count("*").alias("runs"), F.sum("n").alias("n"), F.round(F.max(F.col("end") - F.col("start")), 3).alias("longest"))


@query("win18_longest_runs", SQL_SAMPLES, FLAG, FR, sql='select sensor, hot, round(max("end" - start), 3) as longest from fr group by all')
def win18(spark, d):
    return I.longest_runs(flagged(spark, d), "hot", "sensor", gap_s=7200.0).withColumn("longest", F.round("longest", 3))


@query("win19_hold_timer", SQL_SAMPLES, FLAG, sql="select id, sensor, coalesce(ts - max(case when hot then ts end) over (partition by sensor order by ts, id rows unbounded preceding) <= 1800, false) as held from g")
def win19(spark, d):
    return I.held(flagged(spark, d), "hot", 1800.0, "sensor").select("id", "sensor", "held")


@query("win20_confirmation", SQL_SAMPLES, FLAG, sql="select id, sensor, (bool_and(hot) over w and count(*) over w = 3 and coalesce(ts - lag(ts, 2) over (partition by sensor order by ts, id) <= 7200, false)) as confirmed from g window w as (partition by sensor order by ts, id rows between 2 preceding and current row)")
def win20(spark, d):
    return I.confirmed(flagged(spark, d), "hot", 3, 7200.0, "sensor").select("id", "sensor", "confirmed")


@query("win7_trailing_count", SQL_SAMPLES, sql="select id, sensor, count(*) over (partition by sensor order by ts range between 7200 preceding and current row) as n from s")
def win7(spark, d):
    return samples(spark, d).select("id", "sensor", I.count_within(7200.0, "sensor").alias("n"))


@query("win6_trailing_median", SQL_SAMPLES, "x as (select a.id, a.sensor, a.gate, quantile_cont(b.energy, 0.5) as m from s a join s b on a.sensor = b.sensor and a.gate = b.gate and b.ts <= a.ts and b.ts > a.ts - 21600 group by all)", sql="select id, sensor, gate, round(m, 6) as median from x")
def win6(spark, d):
    """The window is open at its start: samples exactly six hours old are out."""
    w = Window.partitionBy("sensor", "gate").orderBy(I.micros()).rangeBetween(-21_600_000_000 + 1, 0)
    return samples(spark, d).select("id", "sensor", "gate", r6(F.percentile("energy", 0.5).over(w), "median"))


@query("win8_trailing_mean", SQL_SAMPLES, sql="select id, sensor, round(avg(energy) over (partition by sensor order by ts range between 3600 preceding and current row), 6) as mean from s")
def win8(spark, d):
    w = Window.partitionBy("sensor").orderBy(I.micros()).rangeBetween(-3_600_000_000, 0)
    return samples(spark, d).select("id", "sensor", r6(F.avg("energy").over(w), "mean"))


@query("win9_centred_max", SQL_SAMPLES, "x as (select id, sensor, ts, max(energy) over w as peak, max(ts) over w - min(ts) over w as span from s window w as (partition by sensor order by ts, id rows between 2 preceding and 2 following))", sql="select id, sensor, case when span <= 14400 then peak end as peak from x")
def win9(spark, d):
    w = I.order_by("sensor").rowsBetween(-2, 2)
    span = F.max("ts").over(w) - F.min("ts").over(w)
    return samples(spark, d).select("id", "sensor", F.when(span <= 14_400, F.max("energy").over(w)).alias("peak"))


@query("win10_cell_centred_median", SQL_SAMPLES, "c as (select sensor, floor(ts / 7200)::bigint as cell, quantile_cont(gate, 0.5) as mid from s where energy >= 50 group by all)", sql="select sensor, cell, round(quantile_cont(mid, 0.5) over (partition by sensor order by cell rows between 1 preceding and 1 following), 6) as path from c")
def win10(spark, d):
    c = samples(spark, d).where("energy >= 50").groupBy("sensor", F.floor(F.col("ts") / 7200).cast("long").alias("cell")).agg(F.percentile("gate", 0.5).alias("mid"))
    w = Window.partitionBy("sensor").orderBy("cell").rowsBetween(-1, 1)
    return c.select("sensor", "cell", r6(F.percentile("mid", 0.5).over(w), "path"))


EPI = "k0 as (select *, ts - lag(ts) over (partition by sensor, gate order by ts, id) > 43200 as br from s), k1 as (select *, count(*) filter (where coalesce(br, true)) over (partition by sensor, gate order by ts, id) as stretch from k0), k2 as (select *, stretch <> lag(stretch) over o or ts - lag(ts) over o >= 14400 as br2 from k1 where energy >= 30 window o as (partition by sensor, gate order by ts, id)), k3 as (select *, count(*) filter (where coalesce(br2, true)) over (partition by sensor, gate order by ts, id) as episode from k2), k4 as (select *, bool_or(energy >= 60) over (partition by sensor, gate, episode order by ts, id rows unbounded preceding) as open from k3), ep as (select sensor, gate, episode, min(ts) as t0, max(ts) as t1, max(energy) as peak, count(*) as n from k4 where open group by all)"


def episode_rows(spark, d):
    return I.episodes(samples(spark, d), "energy", 60, 30, 14_400.0, 43_200.0, "sensor", "gate")


@query("epi1_gate_episodes", SQL_SAMPLES, EPI, sql="select * from ep")
def epi1(spark, d):
    return episode_rows(spark, d)


@query("epi2_detection_episodes", SQL_SAMPLES, EPI, "m0 as (select *, max(t1) over (partition by sensor order by t0, gate, episode rows between unbounded preceding and 1 preceding) as reach from ep)", "m1 as (select *, count(*) filter (where coalesce(t0 > reach, true)) over (partition by sensor order by t0, gate, episode) as det from m0)", sql="select sensor, det, min(t0) as t0, max(t1) as t1, max(peak) as peak, min(gate) as lo, max(gate) as hi, count(*) as episodes from m1 group by all")
def epi2(spark, d):
    """Unions of gate episodes that overlap in time."""
    by = ("t0", "gate", "episode")
    e = episode_rows(spark, d)
    reach = F.max("t1").over(I.order_by("sensor", by=by).rowsBetween(Window.unboundedPreceding, -1))
    e = I.islands(e.withColumn("reach", reach), F.col("t0") > F.col("reach"), "sensor", by=by, name="det")
    return e.groupBy("sensor", "det").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("peak").alias("peak"), F.min("gate").alias("lo"), F.max("gate").alias("hi"), F.count("*").alias("episodes"))


@query("epi3_stall_breaks", SQL_SAMPLES, "x as (select sensor, ts, id, ts - lag(ts) over (partition by sensor order by ts, id) as gap from s)", sql="select sensor, count(*) filter (where gap > 10800) as stalls, round(max(gap), 3) as longest from x group by sensor")
def epi3(spark, d):
    gap = F.col("ts") - F.lag("ts").over(I.order_by("sensor"))
    return samples(spark, d).withColumn("gap", gap).groupBy("sensor").agg(F.count_if(F.col("gap") > 10_800).alias("stalls"), F.round(F.max("gap"), 3).alias("longest"))


@query("epi4_accumulators", SQL_SAMPLES, SESS, "y as (select *, least(greatest(ts - lag(ts) over (partition by sensor, session order by ts, id), 0), 900) as step from ss)", sql="select sensor, session, max(energy) as peak, round(coalesce(sum(step), 0), 3) as observed, round(coalesce(sum(step) filter (where energy >= 50), 0), 3) as active, round(coalesce(sum(step) filter (where chan = 1), 0), 3) as still, bool_or(energy >= 90) as saw_strong, min(gate) as nearest from y group by all")
def epi4(spark, d):
    s = I.sessions(samples(spark, d), 1800.0, "sensor")
    step = F.least(F.greatest(F.col("ts") - F.lag("ts").over(I.order_by("sensor", "session")), F.lit(0.0)), F.lit(900.0))
    s = s.withColumn("step", step)
    part = lambda c, n: F.round(F.coalesce(F.sum(F.when(c, F.col("step"))), F.lit(0.0)), 3).alias(n)
    return s.groupBy("sensor", "session").agg(
        F.max("energy").alias("peak"), part(F.lit(True), "observed"), part(F.col("energy") >= 50, "active"), part(F.col("chan") == 1, "still"), F.bool_or(F.col("energy") >= 90).alias("saw_strong"), F.min("gate").alias("nearest")
    )


@query("epi6_run_summary", SQL_FRAMES, "q as (select *, list_max(move) >= 85 as occ, list_max(move)::double as score, list_position(move, list_max(move)) - 1 as lo, 8 - (list_position(list_reverse(move), list_max(move)) - 1) as hi, list_max(still) > list_max(move) as st from f)", "q1 as (select *, count(*) filter (where coalesce(br, true)) over (partition by sensor order by ts, id) as run from (select *, occ <> lag(occ) over (partition by sensor order by ts, id) as br from q))", sql="select sensor, run, min(ts) as t0, max(ts) as t1, max(score) as peak, min(lo)::int as lo, max(hi)::int as hi, round(avg(st::int), 6) as still_frac from q1 where occ group by sensor, run")
def epi6(spark, d):
    top = F.array_max("move")
    q = frames(spark, d).withColumns({"occ": top >= 85, "score": top.cast("double"), "lo": (F.array_position("move", top) - 1).cast("int"), "hi": (9 - F.array_position(F.reverse("move"), top)).cast("int"), "still": F.array_max("still") > top})
    x = I.run_summary(q, "occ", "sensor")
    return x.withColumn("still_frac", F.round("still_frac", 6))


@query("epi7_result_labels", SQL_SAMPLES, SESS, "z as (select sensor, session, max(energy) as peak, bool_or(gate >= 2) as act, list(distinct case chan when 0 then 'rejected_arrival' else 'rejected_energy_floor' end) as why, count(*) as n from ss group by all)", sql="select sensor, session, case when peak >= 95 then 'entered' when not act then 'rejected_coherence' when n >= 4 then 'rejected_hysteresis' when list_contains(why, 'rejected_arrival') then 'rejected_arrival' when list_contains(why, 'rejected_energy_floor') then 'rejected_energy_floor' else 'rejected_hysteresis' end as result from z")
def epi7(spark, d):
    s = I.sessions(samples(spark, d), 1800.0, "sensor")
    why = F.when(F.col("chan") == 0, "rejected_arrival").otherwise("rejected_energy_floor")
    z = s.groupBy("sensor", "session").agg(F.max("energy").alias("peak"), F.bool_or(F.col("gate") >= 2).alias("act"), F.collect_set(why).alias("why"), F.count("*").alias("n"))
    z = z.withColumn("why", F.when(F.col("n") >= 4, F.array(F.lit("rejected_hysteresis"))).otherwise(F.col("why")))
    return z.select("sensor", "session", I.result_label(F.col("peak") >= 95, F.col("act"), F.col("why")).alias("result"))


@query("epi9_research_episodes", SQL_SAMPLES, "n0 as (select *, ts - lag(ts) over (partition by sensor order by ts, id) > 7200 as br from s where energy >= 60)", "n1 as (select *, count(*) filter (where coalesce(br, true)) over (partition by sensor order by ts, id) as ep from n0)", sql="select sensor, ep, min(ts) as t0, max(ts) as t1, case when bool_or(gate <= 1) then 'near' when bool_or(gate >= 7) then 'far' else 'orphan' end as kind from n1 group by all")
def epi9(spark, d):
    e = I.islands(samples(spark, d).where("energy >= 60"), I.gap_over(7200.0, "sensor"), "sensor", name="ep")
    kind = F.when(F.bool_or(F.col("gate") <= 1), "near").when(F.bool_or(F.col("gate") >= 7), "far").otherwise("orphan")
    return e.groupBy("sensor", "ep").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), kind.alias("kind"))


@query("epi8_local_tracks", SQL_SAMPLES, SESS, sql="select sensor, session, min(ts) as t0, max(ts) as t1, arg_min(gate, (ts, id)) as entry_gate, arg_max(gate, (ts, id)) as exit_gate from ss group by all having max(ts) - min(ts) >= 600")
def epi8(spark, d):
    s = I.sessions(samples(spark, d), 1800.0, "sensor")
    t = s.groupBy("sensor", "session").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min_by("gate", F.struct("ts", "id")).alias("entry_gate"), F.max_by("gate", F.struct("ts", "id")).alias("exit_gate"))
    return t.where(F.col("t1") - F.col("t0") >= 600)


@query("win28_dense_runs", SQL_SAMPLES, "c as (select sensor, floor(ts / 3600)::bigint as cell, avg(gate) as mid from s where energy >= 50 group by all)", "r0 as (select *, count(*) filter (where coalesce(br, true)) over (partition by sensor order by cell) as run from (select *, cell - lag(cell) over (partition by sensor order by cell) > 3 as br from c))", "r1 as (select *, lead(cell) over (partition by sensor, run order by cell) as nc, lead(mid) over (partition by sensor, run order by cell) as nm from r0)", sql="select sensor, run, cell + k as cell, round(case when nc is null then mid else mid + (nm - mid) * k / (nc - cell) end, 6) as mid from r1, lateral (select unnest(range(0, coalesce(nc - cell, 1))) as k)")
def win28(spark, d):
    """Cells at most three apart make a run; those missing between are filled linearly."""
    c = samples(spark, d).where("energy >= 50").groupBy("sensor", F.floor(F.col("ts") / 3600).cast("long").alias("cell")).agg(F.avg("gate").alias("mid"))
    w = Window.partitionBy("sensor").orderBy("cell")
    r = I.islands(c, F.col("cell") - F.lag("cell").over(w) > 3, "sensor", by=("cell",), name="run")
    w = Window.partitionBy("sensor", "run").orderBy("cell")
    r = r.withColumns({"nc": F.lead("cell").over(w), "nm": F.lead("mid").over(w)})
    r = r.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("nc") - F.col("cell"), F.lit(1)) - 1)))
    mid = F.when(F.col("nc").isNull(), F.col("mid")).otherwise(F.col("mid") + (F.col("nm") - F.col("mid")) * F.col("k") / (F.col("nc") - F.col("cell")))
    return r.select("sensor", "run", (F.col("cell") + F.col("k")).alias("cell"), r6(mid, "mid"))


@query("win27_sliding_samples", SQL_SAMPLES, "n as (select *, row_number() over (partition by sensor order by ts, id) - 1 as i from s)", "w as (select sensor, ts, energy, unnest(range(greatest(0, floor((i - 20) / 5)::bigint + 1), i // 5 + 1)) as win from n)", "a as (select sensor, win, count(*) as n, round(avg(energy), 6) as mean, quantile_cont(energy, 0.5) as med, max(ts) - min(ts) as span from w group by all)", sql="select sensor, win, mean from a where n = 20 and med >= 8 and span <= 86400")
def win27(spark, d):
    n = samples(spark, d).withColumn("i", F.row_number().over(I.order_by("sensor")) - 1)
    first = F.greatest(F.lit(0), F.floor((F.col("i") - 20) / 5) + 1)
    w = n.withColumn("win", F.explode(F.sequence(first, F.floor(F.col("i") / 5))))
    a = w.groupBy("sensor", "win").agg(F.count("*").alias("n"), r6(F.avg("energy"), "mean"), F.percentile("energy", 0.5).alias("med"), (F.max("ts") - F.min("ts")).alias("span"))
    return a.where("n = 20 and med >= 8 and span <= 86400").select("sensor", "win", "mean")


@query("win24_complete_windows", SQL_SAMPLES, "d0 as (select *, floor(ts / 86400)::bigint as win, ts - lag(ts) over (partition by sensor, floor(ts / 86400) order by ts, id) as gap from s)", sql="select sensor, win, count(*) as n from d0 group by all having min(ts) - win * 86400 <= 3600 and (win + 1) * 86400 - max(ts) <= 3600 and max(gap) <= 7200")
def win24(spark, d):
    x = samples(spark, d).withColumn("win", F.floor(F.col("ts") / 86_400).cast("long"))
    x = x.withColumn("gap", F.col("ts") - F.lag("ts").over(I.order_by("sensor", "win")))
    g = x.groupBy("sensor", "win").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.max("gap").alias("gap"))
    return g.where("a - win * 86400 <= 3600 and (win + 1) * 86400 - b <= 3600 and gap <= 7200").select("sensor", "win", "n")


@query("win25_correlation", SQL_SAMPLES, sql="select sensor, gate, round(coalesce(case when isnan(corr(energy, ts)) then 0 else corr(energy, ts) end, 0), 6) as r from s group by all")
def win25(spark, d):
    r = F.corr("energy", "ts")
    return samples(spark, d).groupBy("sensor", "gate").agg(r6(F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0)), "r"))


@query("snk9_upsert", SQL_SAMPLES, "u as (select sensor, gate, energy, id as seq, chan as isnew from s)", sql="select sensor, gate, energy, seq from u qualify row_number() over (partition by sensor, gate order by isnew desc, seq desc) = 1")
def snk9(spark, d):
    u = samples(spark, d).withColumn("seq", F.col("id"))
    of = lambda chan: u.where(F.col("chan") == chan).select("sensor", "gate", "energy", "seq")
    return I.upsert(of(0), of(1), "sensor", "gate")


@query("agg37_occupied_fraction", SQL_SAMPLES, FLAG, sql="select sensor, round(avg(hot::int), 6) as share, min(ts) filter (where hot and ts >= 1704672000) as first_on, min(ts) filter (where not hot and ts >= 1704672000) as first_off from g group by sensor")
def agg37(spark, d):
    after = F.col("ts") >= 1_704_672_000
    g = flagged(spark, d).groupBy("sensor")
    return g.agg(r6(F.avg(F.col("hot").cast("int")), "share"), F.min(F.when(F.col("hot") & after, F.col("ts"))).alias("first_on"), F.min(F.when(~F.col("hot") & after, F.col("ts"))).alias("first_off"))

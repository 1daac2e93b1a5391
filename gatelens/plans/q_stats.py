"""Queries on decay, classes and offline statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatelens.operators import decay as D
from gatelens.operators import islands as I
from gatelens.operators import stats as S
from gatelens.sources.tables import SQL_SAMPLES, samples, table

from .registry import query, r6

WEEK = 604_800.0
NOW = "t as (select max(ts) as now from s)"


def now(s):
    return F.lit(s.agg(F.max("ts")).first()[0])


@query("rec8_decayed_counts", SQL_SAMPLES, NOW, sql="select sensor, gate, round(sum(pow(0.5, (now - ts) / 604800.0)), 6) as n from s, t where energy >= 50 group by all")
def rec8(spark, d):
    s = samples(spark, d)
    return D.decayed_count(s.where("energy >= 50"), now(s), WEEK, "sensor", "gate", name="n").withColumn("n", F.round("n", 6))


@query("rec9_decayed_bins", SQL_SAMPLES, NOW, "b as (select sensor, gate, energy, sum(pow(0.5, (now - ts) / 86400.0)) as w from s, t group by all)", sql="select sensor, gate, energy, round(w, 9) as w from b where w >= 1e-3")
def rec9(spark, d):
    s = samples(spark, d)
    return D.decayed_count(s, now(s), 86_400.0, "sensor", "gate", "energy", name="w").where("w >= 1e-3").withColumn("w", F.round("w", 9))


@query("rec4_decayed_peak", SQL_SAMPLES, sql="select id, round(coalesce(pow(2, max(case when energy > 0 then log2(energy) + ts / 604800.0 end) over (partition by sensor, gate order by ts, id rows unbounded preceding) - ts / 604800.0), 0), 4) as peak from s")
def rec4(spark, d):
    return D.decayed_peak(samples(spark, d), "energy", WEEK, "sensor", "gate").select("id", F.round("peak", 4).alias("peak"))


@query("rec5_capable_gates", SQL_SAMPLES, sql="select id, bool_or(chan = 1 and energy > 95) over (partition by sensor, gate order by ts, id rows unbounded preceding) as capable from s")
def rec5(spark, d):
    hit = (F.col("chan") == 1) & (F.col("energy") > 95)
    return D.ever(samples(spark, d), hit, "sensor", "gate", name="capable").select("id", "capable")


EP = "e0 as (select *, ts - lag(ts) over (partition by sensor, gate order by ts, id) > 7200 as br from s where energy >= 40), e1 as (select *, count(*) filter (where coalesce(br, true)) over (partition by sensor, gate order by ts, id) as ep from e0), ep as (select sensor, gate, ep, min(ts) as t0, max(ts) as t1, count(*) as n from e1 group by all)"


def gate_episodes(spark, d):
    e = I.islands(samples(spark, d).where("energy >= 40"), I.gap_over(7200.0, "sensor", "gate"), "sensor", "gate", name="ep")
    return e.groupBy("sensor", "gate", "ep").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"))


@query("cls1_2_dwell_counts", SQL_SAMPLES, NOW, EP, sql="select sensor, gate, round(coalesce(sum(pow(0.5, (now - t1) / 604800.0)) filter (where t1 - t0 >= 3600), 0), 6) as sustained, round(coalesce(sum(pow(0.5, (now - t1) / 604800.0)) filter (where t1 - t0 <= 600), 0), 6) as brief from ep, t group by all")
def cls12(spark, d):
    return dwell(spark, d).select("sensor", "gate", r6(F.col("sustained"), "sustained"), r6(F.col("brief"), "brief"))


def dwell(spark, d):
    end = now(samples(spark, d))
    length, w = F.col("t1") - F.col("t0"), D.weight(end - F.col("t1"), WEEK)
    of = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    return gate_episodes(spark, d).groupBy("sensor", "gate").agg(
        of(length >= 3600).alias("sustained"), of(length <= 600).alias("brief"), (end - F.max(F.when(length >= 3600, F.col("t1")))).alias("stale_s"), F.count_if(F.col("n") == 1).alias("single"), F.count("*").alias("n")
    )


CLS = "dw as (select sensor, gate, coalesce(sum(pow(0.5, (now - t1) / 604800.0)) filter (where t1 - t0 >= 3600), 0) as sus, coalesce(sum(pow(0.5, (now - t1) / 604800.0)) filter (where t1 - t0 <= 600), 0) as bri, max(now) - max(t1) filter (where t1 - t0 >= 3600) as stale, count(*) filter (where n = 1) as single, count(*) as n from ep, t group by all)"


@query("cls3_6_gate_classes", SQL_SAMPLES, NOW, EP, CLS, sql="select sensor, gate, case when gate > 7 then 'out' when sus >= 8 then 'in_room' when single >= 5 and single >= 0.3 * n then 'portal' when bri >= 20 and sus < 0.5 and coalesce(stale, 1e18) > 604800 then 'bleed' when sus >= 1 then 'in_room' else 'unknown' end as class from dw")
def cls36(spark, d):
    g = dwell(spark, d)
    portal = D.portal_class(F.col("single"), F.col("n") - F.col("single")).isNotNull()
    bleed = D.dwell_class(F.col("sustained"), F.col("brief"), F.col("stale_s"), WEEK) == "bleed"
    kind = D.by_precedence(F.col("sustained") >= 8, portal, F.coalesce(bleed, F.lit(False)), F.col("sustained") >= 1)
    return g.select("sensor", "gate", D.effective_class(kind, F.col("gate"), F.lit(7), None).alias("class"))


PROF = "pr as (select sensor, gate, ln(1.0 + gate) as x, ln(avg(energy) + 1 + gate) as y from s where energy >= 30 group by sensor, gate)"


def profile(spark, d):
    p = samples(spark, d).where("energy >= 30").groupBy("sensor", "gate").agg(F.avg("energy").alias("m"))
    return p.select("sensor", "gate", F.ln(1.0 + F.col("gate")).alias("x"), F.ln(F.col("m") + 1 + F.col("gate")).alias("y"))


TS = "sl as (select a.sensor, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) as slope from pr a join pr b on a.sensor = b.sensor and a.x < b.x group by a.sensor), fi as (select pr.sensor, slope, max(y - slope * x) as top from pr join sl using (sensor) group by all)"


@query("agg15_theil_sen", SQL_SAMPLES, PROF, TS, sql="select sensor, round(slope, 6) as slope, round(top, 6) as top from fi")
def agg15(spark, d):
    return D.theil_sen(profile(spark, d), "x", "y", "sensor").select("sensor", r6(F.col("slope"), "slope"), r6(F.col("top"), "top"))


COMP = "co as (select pr.sensor, pr.gate, round(exp(y - (top + slope * x)), 6) as level from pr join fi using (sensor))"


@query("agg16_compensated_profile", SQL_SAMPLES, PROF, TS, COMP, sql="select * from co")
def agg16(spark, d):
    return compensated(spark, d)


def compensated(spark, d):
    p = profile(spark, d)
    f = D.theil_sen(p, "x", "y", "sensor")
    return p.join(f, "sensor").select("sensor", "gate", r6(F.exp(F.col("y") - (F.col("top") + F.col("slope") * F.col("x"))), "level"))


@query("cls8_boundary", SQL_SAMPLES, PROF, TS, COMP, "su as (select *, max(level) over (partition by sensor order by gate desc) as top from co)", sql="select sensor, min(gate) filter (where gate >= 2 and top < 0.995)::int as boundary from su group by sensor")
def cls8(spark, d):
    return D.boundary_gate(compensated(spark, d), "level", 0.995, "sensor")


@query("cls9_confirmed_boundary", SQL_SAMPLES, "ev as (select sensor, day, max(c) % 4 as cand from (select sensor, floor(ts / 86400)::bigint as day, gate // 3 as third, count(*) as c from s group by all) group by all)", "r as (select *, count(*) filter (where cand is distinct from was) over (partition by sensor order by day) as run from (select *, lag(cand) over (partition by sensor order by day) as was from ev))", sql="select sensor, day as \"at\", cand from (select *, row_number() over (partition by sensor, run order by day) as n from r) where n >= 2")
def cls9(spark, d):
    """A candidate counts once the same one has come twice in a row."""
    s = samples(spark, d).withColumn("at", F.floor(F.col("ts") / 86_400).cast("long"))
    c = s.groupBy("sensor", "at", F.floor(F.col("gate") / 3).alias("third")).agg(F.count("*").alias("c"))
    e = c.groupBy("sensor", "at").agg((F.max("c") % 4).alias("cand"))
    return D.confirmed_candidate(e, "cand", 2, "sensor").select("sensor", "at", "cand")


LAB = "lb as (select sensor, gate, chan as label, energy from s)"


@query("agg19_auc", SQL_SAMPLES, "b as (select sensor, energy, count(*) filter (where chan = 1) as p, count(*) filter (where chan = 0) as q from s group by all)", "c as (select *, sum(q) over (partition by sensor order by energy) - q as below from b)", sql="select sensor, sum(p)::bigint as n1, sum(q)::bigint as n0, round(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)), 6) as auc from c group by sensor")
def agg19(spark, d):
    return S.auc(samples(spark, d), "chan", "energy", "sensor").select("sensor", "n1", "n0", r6(F.col("auc"), "auc"))


@query("agg20_cohens_d", SQL_SAMPLES, "m as (select sensor, avg(energy) filter (where chan = 1) as m1, avg(energy) filter (where chan = 0) as m0, var_samp(energy) filter (where chan = 1) as v1, var_samp(energy) filter (where chan = 0) as v0, count(*) filter (where chan = 1) as n1, count(*) filter (where chan = 0) as n0 from s group by sensor)", sql="select sensor, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) as d from m")
def agg20(spark, d):
    return S.cohens_d(samples(spark, d), "chan", "energy", "sensor").select("sensor", r6(F.col("d"), "d"))


SH = "sh as (select sensor, gate, a / (sum(a) over (partition by sensor)) as p, b / (sum(b) over (partition by sensor)) as q from (select sensor, gate, count(*) filter (where chan = 1) as a, count(*) filter (where chan = 0) as b from s group by all))"


@query("agg21_overlap_coefficient", SQL_SAMPLES, SH, sql="select sensor, round(sum(least(p, q)), 6) as overlap from sh group by sensor")
def agg21(spark, d):
    return S.overlap_coefficient(samples(spark, d), "chan", "gate", "sensor").select("sensor", r6(F.col("overlap"), "overlap"))


@query("agg22_jensen_shannon", SQL_SAMPLES, SH, sql="select sensor, round(sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2, 6) as jsd from sh group by sensor")
def agg22(spark, d):
    return S.jensen_shannon(samples(spark, d), "chan", "gate", "sensor").select("sensor", r6(F.col("jsd"), "jsd"))


@query("agg23_top_mass_band", SQL_SAMPLES, "m as (select sensor, gate, sum(energy) as mass from s group by all)", "c as (select *, sum(mass) over (partition by sensor order by mass desc, gate) as cum, sum(mass) over (partition by sensor) as tot from m)", sql="select sensor, gate from c where cum - mass < 0.6 * tot")
def agg23(spark, d):
    return S.top_mass(samples(spark, d), "energy", 0.6, "sensor")


@query("agg25_best_threshold", SQL_SAMPLES, "c as (select distinct unnest(quantile_cont(energy, [x / 400.0 for x in range(0, 401)])) as cut from s)", "g as (select cut, count(*) filter (where chan = 1 and energy >= cut) as tp, count(*) filter (where chan = 0 and energy >= cut) as fp from c, s group by cut)", "n as (select count(*) filter (where chan = 1) as n1, count(*) filter (where chan = 0) as n0 from s)", sql="select cut, round(tp / n1 - fp / n0, 9) as gain from g, n order by gain desc, cut desc limit 1")
def agg25(spark, d):
    return S.best_threshold(samples(spark, d), "chan", "energy")


@query("agg26_fade_statistics", SQL_SAMPLES, "m as (select sensor, quantile_cont(energy, 0.5) as med, quantile_cont(energy, 0.05) as lo, quantile_cont(energy, 0.95) as hi from s group by sensor)", "l as (select *, lag(energy) over (partition by sensor order by ts, id) as was from s)", sql="select sensor, round(stddev_pop(energy) / avg(energy), 6) as cv, round(avg((energy < 0.3 * med)::int), 6) as below30, round(avg((energy < 0.5 * med)::int), 6) as below50, round(avg((energy < 0.7 * med)::int), 6) as below70, round(kurtosis_pop(energy), 6) as kurtosis, round(max(energy) / max(med), 6) as peak_ratio, round(10 * log10((max(hi) + 1) / (max(lo) + 1)), 6) as range_db, round(corr(energy, was), 6) as ac1, round(avg(abs(energy - was)), 6) as mean_step from l join m using (sensor) group by sensor")
def agg26(spark, d):
    f = S.fade(samples(spark, d), "energy", "sensor")
    return f.select("sensor", *(r6(F.col(c), c) for c in f.columns if c not in ("sensor", "skew")))


@query("agg35_confusion_sweep", SQL_SAMPLES, "c as (select unnest([10.0, 30.0, 50.0, 70.0, 90.0])::double as cut)", sql="select cut, count(*) filter (where energy >= cut and chan = 1) as tp, count(*) filter (where energy < cut and chan = 1) as fn, count(*) filter (where energy >= cut and chan = 0) as fp, count(*) filter (where energy < cut and chan = 0) as tn, round(avg(((energy >= cut) = (chan = 1))::int), 6) as accuracy from s, c group by cut")
def agg35(spark, d):
    return S.confusion(samples(spark, d), "chan", "energy", [10, 30, 50, 70, 90]).withColumn("accuracy", F.round("accuracy", 6))


@query("agg33_discriminant", SQL_SAMPLES, "z as (select avg(energy) as ma, stddev_pop(energy) as sa, avg(gate) as mb, stddev_pop(gate) as sb from s)", "y as (select chan, (energy - ma) / sa as a, (gate - mb) / sb as b from s, z)", "g as (select avg(a) filter (where chan = 1) - avg(a) filter (where chan = 0) as da, avg(b) filter (where chan = 1) - avg(b) filter (where chan = 0) as db, (var_samp(a) filter (where chan = 1) + var_samp(a) filter (where chan = 0)) / 2 + 1e-6 as aa, (var_samp(b) filter (where chan = 1) + var_samp(b) filter (where chan = 0)) / 2 + 1e-6 as bb, (covar_samp(a, b) filter (where chan = 1) + covar_samp(a, b) filter (where chan = 0)) / 2 as ab from y)", sql="select round((bb * da - ab * db) / (aa * bb - ab * ab), 6) as wa, round((aa * db - ab * da) / (aa * bb - ab * ab), 6) as wb from g")
def agg33(spark, d):
    w = S.discriminant(samples(spark, d), "chan", "energy", "gate")
    return w.select(r6(F.col("wa"), "wa"), r6(F.col("wb"), "wb"))


@query("agg34_event_scores", SQL_SAMPLES, "w as (select sensor, floor(ts / 86400)::bigint as day, gate, avg(energy) as m, quantile_cont(energy, 0.5) as med from s group by all)", sql="select sensor, day, round(arg_max(med, (m, -gate)), 6) as score from w group by all")
def agg34(spark, d):
    w = samples(spark, d).groupBy("sensor", F.floor(F.col("ts") / 86_400).cast("long").alias("day"), "gate").agg(F.avg("energy").alias("m"), F.percentile("energy", 0.5).alias("med"))
    return w.groupBy("sensor", "day").agg(r6(F.max_by("med", F.struct("m", -F.col("gate"))), "score"))


@query("agg28_ridge_normal_equations", SQL_SAMPLES, sql="select round(sum(gate), 3) as g0_1, round(sum(gate * gate), 3) as g1_1, round(sum(gate * energy), 3) as t1, round(sum(energy), 3) as t0, count(*) as n from s")
def agg28(spark, d):
    g = S.gram(samples(spark, d), ["gate"], "energy")
    return g.select(*(F.round(c, 3).alias(c) for c in ("g0_1", "g1_1", "t1", "t0")), "n")


@query("agg36_ridge_rank_score")
def agg36(spark, d):
    s = samples(spark, d).withColumns({"hour": F.floor(F.col("ts") / 3600) % 24})
    w = S.ridge(s, ["energy", "gate", "hour"], "chan")
    return S.auc(S.linear_score(s, ["energy", "gate", "hour"], w), "chan", "score", "sensor")


@query("agg39_travel_histograms", SQL_SAMPLES, "m as (select sensor, ts, id, gate, lag(gate) over (partition by sensor order by ts, id) as was, lag(ts) over (partition by sensor order by ts, id) as wts from s)", "e as (select sensor, least(gate, was) + k as g, gate > was as outward from m, lateral (select unnest(range(0, abs(gate - was))) as k) where ts - wts <= 900)", sql="select sensor, g::int as gate, count(*) filter (where outward) as outward, count(*) filter (where not outward) as inward from e group by all")
def agg39(spark, d):
    w = I.order_by("sensor")
    m = samples(spark, d).withColumns({"was": F.lag("gate").over(w), "gap": F.col("ts") - F.lag("ts").over(w)}).where("gap <= 900 and gate <> was")
    e = m.withColumn("g", F.explode(F.sequence(F.least("gate", "was"), F.greatest("gate", "was") - 1)))
    return e.groupBy("sensor", F.col("g").alias("gate")).agg(F.count_if(F.col("gate") > F.col("was")).alias("outward"), F.count_if(F.col("gate") < F.col("was")).alias("inward"))


@query("spc11_transition_counts", SQL_SAMPLES, NOW, "m as (select sensor, gate, lag(gate) over (partition by sensor order by ts, id) as was, pow(0.5, (now - ts) / 604800.0) as w from s, t)", "c as (select sensor, was, gate, sum(w) as w from m where was is not null group by all)", sql="select sensor, was, gate, round((w + 1) / (sum(w) over (partition by sensor, was) + 9), 6) as p from c")
def spc11(spark, d):
    s = samples(spark, d)
    m = s.withColumns({"was": F.lag("gate").over(I.order_by("sensor")), "w": D.weight(now(s) - F.col("ts"), WEEK)}).where("was is not null")
    c = m.groupBy("sensor", "was", "gate").agg(F.sum("w").alias("w"))
    return c.select("sensor", "was", "gate", r6((F.col("w") + 1) / (F.sum("w").over(Window.partitionBy("sensor", "was")) + 9), "p"))


@query("spc9_latest_labels", SQL_SAMPLES, "l as (select sensor, gate, id, ts, energy // 25 as label from s)", sql="select sensor, gate, arg_max(label, (ts, id))::int as label, count(*) as versions from l group by all")
def spc9(spark, d):
    l = samples(spark, d).withColumn("label", F.floor(F.col("energy") / 25).cast("int"))
    return l.groupBy("sensor", "gate").agg(F.max_by("label", F.struct("ts", "id")).alias("label"), F.count("*").alias("versions"))


@query("spc10_episode_features", SQL_SAMPLES, EP, "x as (select e1.*, lag(gate) over (partition by sensor, gate, ep order by ts, id) as pg from e1)", sql="select sensor, gate, ep, round(max(ts) - min(ts), 3) as duration, round(coalesce(var_pop(energy) / nullif(avg(energy), 0), 0), 6) as burstiness, max(energy) < 60 as low_profile from x group by all")
def spc10(spark, d):
    e = I.islands(samples(spark, d).where("energy >= 40"), I.gap_over(7200.0, "sensor", "gate"), "sensor", "gate", name="ep")
    return e.groupBy("sensor", "gate", "ep").agg(F.round(F.max("ts") - F.min("ts"), 3).alias("duration"), r6(F.coalesce(F.var_pop("energy") / F.nullif(F.avg("energy"), F.lit(0.0)), F.lit(0.0)), "burstiness"), (F.max("energy") < 60).alias("low_profile"))


@query("spc3_count_conservation", SQL_SAMPLES, sql="select sensor, tick, conf from (select sensor, floor(ts / 3600)::bigint as tick, max(energy) as conf from s group by all) qualify row_number() over (partition by tick order by conf desc, sensor) <= 2")
def spc3(spark, d):
    """Of each tick's sensors the two most confident stay."""
    t = samples(spark, d).groupBy("sensor", F.floor(F.col("ts") / 3600).cast("long").alias("tick")).agg(F.max("energy").alias("conf"))
    k = F.row_number().over(Window.partitionBy("tick").orderBy(F.desc("conf"), "sensor"))
    return t.withColumn("k", k).where("k <= 2").select("sensor", "tick", "conf")


@query("vec_embedding_profiles", sql="select label, count(*) as n, round(avg(list_avg(embedding)), 5) as mean, round(max(list_max(embedding))::double, 5) as top from embeddings group by label")
def vec_embeddings(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(mean), 5).alias("mean"), F.round(F.max(F.array_max("v")), 5).alias("top"))

"""Queries on research folds, the house layer and exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from gatelens.operators import house as H
from gatelens.operators import intervals as V
from gatelens.operators import islands as I
from gatelens.operators import learned as L
from gatelens.operators import models as M
from gatelens.operators import replay as R
from gatelens.operators import research as X
from gatelens.sources.tables import SQL_FRAMES, SQL_SAMPLES, SQL_SPANS, frames, samples, spans

from . import sql_folds as Q
from .q_intervals import EP, HAND, HOUSE, TR, handoffs, tracks
from .registry import query, r6

FLOOR, SPREAD = np.full(9, 30.0), np.full(9, 10.0)


#: A day of events stands for a second of frames.
DAY = 86_400.0


def hold(make):
    def run(spark, d):
        def step(h, r) -> tuple:
            holds, value = h.step(r.ts / DAY, np.asarray(r.move, float), np.asarray(r.still, float))
            return r.id, bool(holds), float(value)

        def steps(h, rows) -> list[tuple]:
            got = h.steps(rows[0].ts / DAY, [(np.asarray(r.move, float), np.asarray(r.still, float)) for r in rows])
            return [(r.id, bool(holds), float(value)) for r, (holds, value) in zip(rows, got, strict=True)]

        def many(h, t) -> tuple:
            return t["id"].combine_chunks(), *h.many(t["ts"].to_numpy() / DAY, R.matrix(t["move"]), R.matrix(t["still"]))

        rows, schema, h = frames(spark, d).select("sensor", "ts", "id", "move", "still"), "id long, holding boolean, value double", make()
        if isinstance(h, X.Hold) and h.crowd is not None:
            held = R.fold_blocks(rows, ("sensor",), make, many, schema)
        else:
            held = R.fold_times(rows, ("sensor",), make, steps, schema) if isinstance(h, X.Hold) else R.fold(rows, ("sensor",), make, step, schema)
        return held.withColumn("value", r6(F.col("value"), "value"))

    return run


for name, (ctes, select), make in (
    ("rec20_footprint_hysteresis", Q.footprint("projection", 0.6, 0.4), lambda: X.Footprint("projection", 0.6, 0.4)),
    ("rec20_footprint_shape", Q.footprint("shape", 0.75, 0.75), lambda: X.Footprint("shape", 0.75)),
    ("rec20_footprint_amplitude", Q.footprint("amplitude", 0.4, 0.4), lambda: X.Footprint("amplitude", 0.4)),
    ("rec21_strength_confirmation", Q.guarded(True), lambda: X.Hold(FLOOR, SPREAD, X.GuardedAnchor(confirmed=True))),
    ("rec22_gate_band_hold", Q.BAND, lambda: X.BandHold(FLOOR, SPREAD)),
    ("rec23_entry_change_hold", Q.CHANGE, lambda: X.ChangeHold(FLOOR, SPREAD)),
    ("rec24_continuity_hold", Q.CONTINUITY, lambda: X.ContinuityHold(FLOOR, SPREAD)),
    ("rec25_settled_shape_hold", Q.settled(3.0, 6.0, 3), lambda: X.SettledHold(FLOOR, SPREAD, rows=3, settling=(3.0, 6.0))),
    ("rec26_kurtosis_hold", Q.FLAT, lambda: X.KurtosisHold(FLOOR, SPREAD, 1.8, 1.0)),
    ("win13_prototype_bank", Q.bank(False, 0.5, 4, 3.0), lambda: X.ShapeBank(FLOOR, SPREAD, 0.5, 4, 3.0)),
    ("rec27_contrastive_bank", Q.bank(True, 0.2, 4, 3.0), lambda: X.ShapeBank(FLOOR, SPREAD, 0.2, 4, 3.0, True)),
    ("rec28_two_gate_anchor", Q.guarded(False), lambda: X.Hold(FLOOR, SPREAD, X.GuardedAnchor(gates=2))),
):
    query(name, *ctes, sql=select)(hold(make))


def ratio(signed: bool, reset_s: float):
    def run(spark, d):
        def step(s: dict, r) -> tuple:
            f = s.setdefault("f", X.Ratio(signed, reset_s))
            dt, s["t"] = r.ts - s.get("t", r.ts), r.ts
            return r.id, f.step(r.ts, dt / 600.0, float(r.energy), r.gate >= 7)

        return R.fold(samples(spark, d).select("sensor", "ts", "id", "energy", "gate"), ("sensor",), dict, step, "id long, ratio double").withColumn("ratio", r6(F.col("ratio"), "ratio"))

    return run


for name, signed, reset_s in (("rec17_reset_ratio", True, 3600.0), ("rec18_unsigned_ratio", False, 0.0), ("rec29_fast_slow_pair", True, 0.0)):
    ctes, select = Q.ratio(signed, reset_s)
    query(name, *ctes, sql=select)(ratio(signed, reset_s))


@query("win15_coupled_changes")
def win15(spark, d):
    """Correlation of both channels' steps, weighted to the present; the median over gates. The grid is of an hour, the horizon of two days."""
    def step(c: X.CoupledChanges, r) -> tuple:
        got = c.step(r.ts / DAY, np.asarray(r.move, float), np.asarray(r.still, float))
        return r.id, None if got is None else round(got, 6)

    rows = frames(spark, d).select("sensor", "ts", "id", "move", "still")
    return R.fold(rows, ("sensor",), lambda: X.CoupledChanges(1 / 24, 2.0, 1.0), step, "id long, coupling double")


@query("rec7_arrival_bar")
def rec7(spark, d):
    def step(s: dict, r) -> tuple:
        bar = s.setdefault("b", L.ArrivalBar(30 * 1440.0))
        got = bar.observe(r.ts / 60.0, np.asarray(r.move, float), np.full(9, 90.0))
        return r.id, None if got is None else float(got), int(bar.counts.sum())

    return R.fold(frames(spark, d).select("sensor", "ts", "id", "move"), ("sensor",), dict, step, "id long, bar double, bursts long")


@query("rec10_recurring_refresh")
def rec10(spark, d):
    from .config import Config

    def step(s: dict, r) -> tuple:
        if not s:
            s |= {"h": L.Histograms(9, Config(bucket_s=3600.0, baseline_window_s=86_400.0)), "at": -1e18, "f": np.zeros(9)}
        s["h"].add(r.ts, np.asarray(r.still, float))
        if r.ts - s["at"] >= 7200.0:
            s["f"], s["at"] = s["h"].recurring(5 * 3600.0), r.ts
        return r.id, float(s["f"].mean())

    return R.fold(frames(spark, d).select("sensor", "ts", "id", "still"), ("sensor",), dict, step, "id long, floor double")


@query("agg30_envelopes")
def agg30(spark, d):
    """Of each sensor and day, how many frames lie outside the envelope of the day's own profiles."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["move"].to_numpy()).astype(float)
        if len(x) < 12:
            return pd.DataFrame([(pdf.sensor.iloc[0], pdf.day.iloc[0], len(x), 0)], columns=["sensor", "day", "n", "outside"])
        centre, inverse, bound = M.envelope(x)
        far = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre) > bound
        return pd.DataFrame([(pdf.sensor.iloc[0], pdf.day.iloc[0], len(x), int(far.sum()))], columns=["sensor", "day", "n", "outside"])

    f = frames(spark, d).select("sensor", F.floor(F.col("ts") / 86_400).cast("long").alias("day"), "move")
    return f.groupBy("sensor", "day").applyInPandas(run, "sensor string, day long, n long, outside long")


@query("win22_suppressed_peaks", *Q.PEAKS[0], sql=Q.PEAKS[1])
def win22(spark, d):
    """Local peaks of a sensor's centred rolling maximum, moved to the raw maximum near by, strongest first, none within two hours of a stronger one.

    Groups are cut where candidates lie that far apart.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        keep = M.suppressed_peaks(pdf.ts.to_numpy(), pdf.energy.to_numpy(float), 7200.0)
        return pdf.iloc[keep][["id", "sensor", "energy"]]

    by_time = Window.partitionBy("sensor").orderBy(I.micros())
    near = by_time.rangeBetween(-900_000_000, 900_000_000)
    s = samples(spark, d).withColumns({"top": F.max("energy").over(by_time.rangeBetween(-900_000_000, 900_000_000)), "raw": F.max(F.struct("energy", (-F.col("ts")).alias("t"), (-F.col("id")).alias("i"))).over(near)})
    w = I.order_by("sensor")
    s = s.withColumns({"p": F.lag("top").over(w), "n": F.lead("top").over(w), "g1": F.col("ts") - F.lag("ts").over(w), "g2": F.lead("ts").over(w) - F.col("ts")})
    s = s.where("top >= p and top >= n and top >= 18 and g1 <= 3600 and g2 <= 3600")
    s = s.select("sensor", (-F.col("raw.i")).alias("id"), (-F.col("raw.t")).alias("ts"), F.col("raw.energy").alias("energy")).distinct()
    s = I.islands(s, I.gap_from(7200.0, "sensor"), "sensor", name="group")
    return s.groupBy("sensor", "group").applyInPandas(run, "id long, sensor string, energy int")


PK = "pk as (select id, sensor, ts, energy from (select *, lag(energy) over w as p, lead(energy) over w as n from s window w as (partition by sensor order by ts, id)) where energy > p and energy >= n and energy >= 90)"


@query("win29_burst_response", SQL_SAMPLES, PK, sql="select pk.id, round(avg(s.energy) filter (where s.ts < pk.ts), 6) as before, round(avg(s.energy) filter (where s.ts > pk.ts), 6) as after, count(*) as n from pk join s on s.sensor = pk.sensor and s.ts between pk.ts - 3600 and pk.ts + 3600 group by pk.id")
def win29(spark, d):
    """Mean level before and after each strong local peak."""
    w = I.order_by("sensor")
    s = samples(spark, d)
    p = s.withColumns({"p": F.lag("energy").over(w), "n": F.lead("energy").over(w)}).where("energy > p and energy >= n and energy >= 90")
    p = p.select("sensor", F.col("id").alias("peak"), F.col("ts").alias("at"), (F.col("ts") - 3600).alias("start"), (F.col("ts") + 3600).alias("end"))
    j = V.points_in(s.select("sensor", "ts", "energy"), p, 7200.0, "sensor")
    mean = lambda c, n: r6(F.avg(F.when(c, F.col("energy"))), n)
    return j.groupBy(F.col("peak").alias("id")).agg(mean(F.col("ts") < F.col("at"), "before"), mean(F.col("ts") > F.col("at"), "after"), F.count("*").alias("n"))


@query("flt4_scopes", SQL_SAMPLES, sql="select case when gate = 4 then 'detection' else 'gate' end as scope, count(*) as n from s group by all")
def flt4(spark, d):
    scope = F.when(F.col("gate") == 4, "detection").otherwise("gate")
    return samples(spark, d).groupBy(scope.alias("scope")).agg(F.count("*").alias("n"))


@query("snk8_fixture_export", SQL_FRAMES, SQL_SAMPLES, SQL_SPANS, sql="select f.sensor, count(*) as frames, min(list_aggregate(list_transform(move, lambda x: lpad(upper(format('{:x}', x)), 2, '0')), 'string_agg', '')) as first_hex, (select count(*) from sp where sp.sensor = f.sensor) as spans from f group by f.sensor")
def snk8(spark, d):
    """Each sensor's frames as hexadecimal gate arrays, with its spans counted."""
    from gatelens.functions.arrays import gates_to_bytes

    f = frames(spark, d).groupBy("sensor").agg(F.count("*").alias("frames"), F.min(F.hex(gates_to_bytes(F.col("move")))).alias("first_hex"))
    n = spans(spark, d).groupBy("sensor").agg(F.count("*").alias("spans"))
    return f.join(n, "sensor", "left").select("sensor", "frames", "first_hex", F.coalesce("spans", F.lit(0)).alias("spans"))


@query(
    "spc2_coupled_belief", SQL_SAMPLES, EP, TR, HAND, "b as (select sensor, avg(energy) / 100 as p from s group by sensor), h as (select s1, s2, count(*) / 1000.0 as w from ho group by all), o as (select s1 as sensor, sum(w) as gone from h group by s1), i as (select s2 as sensor, sum(w) as got from h group by s2)",
    "k as (select sensor, p * (1 - least(coalesce(gone, 0), 1)) as kept, least(coalesce(got, 0), 1) as got from b left join o using (sensor) left join i using (sensor))",
    sql="select sensor as room, round(kept + (1 - kept) * got, 6) as belief from k",
)
def spc2(spark, d):
    b = samples(spark, d).groupBy(F.col("sensor").alias("room")).agg((F.avg("energy") / 100).alias("belief"))
    h = handoffs(spark, d).groupBy("s1", "s2").agg((F.count("*") / 1000).alias("weight"))
    return H.coupled_belief(b, h).select("room", r6(F.col("belief"), "belief"))


@query(
    "spc5_reach", "recursive " + SQL_SAMPLES, EP, TR, HAND, "h as materialized (select s1, s2 from ho group by all having count(*) >= 25)", "n as (select count(distinct sensor) as n from s)",
    "r as (select distinct sensor as node, 0 as hops from s where sensor = 'click' union select s2, hops + 1 from r join h on s1 = node, n where hops < n)",
    sql="select node, min(hops)::int as hops from r group by node",
)
def spc5(spark, d):
    """Sensors that are reached from one over pairs with enough handoffs."""
    h = handoffs(spark, d).groupBy(F.col("s1").alias("a"), F.col("s2").alias("b")).agg(F.count("*").alias("h")).where("h >= 25")
    first = samples(spark, d).where("sensor = 'click'").select(F.col("sensor").alias("node")).distinct()
    return H.reachable(h, first)


@query(
    "spc13_continuity", SQL_SAMPLES, EP, TR, "t as (select *, max(t1) over (order by t0, sensor, ep rows between unbounded preceding and 1 preceding) as reach from tr)",
    sql="select 'home' as house, count(*) filter (where coalesce(t0 > reach + 600, true)) over (order by t0, sensor, ep) as chain, sensor, ep as track, t0, t1 from t",
)
def spc13(spark, d):
    return H.continuity(tracks(spark, d).withColumn("house", F.lit(HOUSE)), 600.0, "house")


@query("spc12_episode_classifier")
def spc12(spark, d):
    """Boosted trees over episode features; the label is whether the episode lasts."""
    e = I.islands(samples(spark, d).where("energy >= 40"), I.gap_over(7200.0, "sensor", "gate"), "sensor", "gate", name="ep")
    e = e.groupBy("sensor", "gate", "ep").agg(F.avg("energy").alias("mean"), F.max("energy").cast("double").alias("peak"), F.count("*").cast("double").alias("n"), (F.max("ts") - F.min("ts")).alias("length"))
    e = e.withColumns({"label": (F.col("length") >= 3600).cast("double"), "g": F.col("gate").cast("double")})
    model = H.boosted_trees(e, ["mean", "peak", "n", "g"], "label")
    return model.transform(e).select("sensor", "gate", "ep", "label", "prediction")


@query("cls10_deferred_boundary", *Q.BOUNDARY[0], sql=Q.BOUNDARY[1])
def cls10(spark, d):
    """A boundary that waits once while an episode beyond it is open, from each day's farthest quiet gate."""
    def step(s: dict, r) -> tuple:
        s.setdefault("now", None)
        if r.target == s["now"]:
            s["waited"] = False
        elif r.busy and not s.get("waited"):
            s["waited"] = True
        else:
            s["now"], s["waited"] = r.target, False
        return r.sensor, int(r.id), -1 if s["now"] is None else int(s["now"])

    day = samples(spark, d).groupBy("sensor", F.floor(F.col("ts") / 86_400).cast("long").alias("id")).agg((F.max(F.when(F.col("energy") >= 97, F.col("gate"))) + 1).alias("target"), (F.sum(F.when(F.col("gate") == 8, F.col("energy"))) > 600).alias("busy"))
    day = day.withColumn("ts", F.col("id").cast("double")).na.fill({"target": 9, "busy": False})
    return R.fold(day, ("sensor",), dict, step, "sensor string, day long, boundary int")

"""Queries with order-dependent state, models a group, and the wire."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from gatelens.operators import islands as I
from gatelens.operators import models as M
from gatelens.operators import replay as R
from gatelens.operators import snapshot as S
from gatelens.operators.automaton import Anchor, Arming, Retention, Sensor
from gatelens.sources import sinks, wire
from gatelens.sources.tables import SQL_FRAMES, SQL_SAMPLES, frames, samples

from . import sql_folds as Q
from .config import Config, configured
from .registry import query, r6
from .stages import ALL_STAGES, chosen, order, plan, sweep

#: The events are minutes apart where a radar's frames are tenths of a second: time constants grow alike.
SCALED = {"k": 7.0, "bucket_s": 3600.0, "baseline_window_s": 86_400.0, "support_tau_s": 1200.0, "hold_s": 3600.0, "episode_stall_s": 14_400.0, "tick_s": 600.0, "lead_gate_max": -1}
#: A row a frame of the detector with these settings, in SQL.
DETECTOR = Q.detector((30.0,), SCALED["k"])
SIMPLE = ("quantile_floor", "tail_spread", "run_score", "lone_gate_suppression", "energy_floor", "score_hold")
SETTINGS = configured(stages=SIMPLE, **SCALED)


@query(
    "rec1_support_ema", "recursive " + SQL_SAMPLES,
    "n as (select sensor, id, ts, energy, row_number() over (partition by sensor order by ts, id) as n from s)",
    "r as (select sensor, id, ts, n, energy::double as ema from n where n = 1 union all select n.sensor, n.id, n.ts, n.n, r.ema + (case when n.ts > r.ts then 1 - exp(-(n.ts - r.ts) / 3600.0) else 0 end) * (n.energy - r.ema) from r join n on n.sensor = r.sensor and n.n = r.n + 1)",
    sql="select id, round(ema, 6) as ema from r",
)
def rec1(spark, d):
    return R.ema(samples(spark, d), "energy", 3600.0, "sensor").withColumn("ema", F.round("ema", 6))


@query("rec16_hold_grid", SQL_SAMPLES, "x as (select *, min(ts) over (partition by sensor) as a, lead(ts) over (partition by sensor order by ts, id) as nx from s)", sql="select id, count(*) as ticks, min(k) as tick from (select id, unnest(range(ceil((ts - a) / 600)::bigint, ceil((nx - a) / 600)::bigint)) as k from x where nx is not null) group by id")
def rec16(spark, d):
    g = R.hold_grid(samples(spark, d), 600.0, "sensor")
    return g.groupBy("id").agg(F.count("*").alias("ticks"), F.min("tick").alias("tick"))


@query("occ1_detector_states", *DETECTOR, sql="select sensor, ts, occupied, case when ready then round(1 / (1 + exp(-(4 / 3.0) * (score - 3))), 6) else 0.5 end as confidence, round(score, 6) as score, active as active_gates, frozen, rejection from o")
def occ1(spark, d):
    return plan(frames(spark, d), SIMPLE, **SCALED).select("sensor", "ts", "occupied", r6(F.col("confidence"), "confidence"), r6(F.col("score"), "score"), "active_gates", "frozen", "rejection")


@query("epi5_detector_episodes")
def epi5(spark, d):
    return plan(frames(spark, d), SIMPLE, "episodes", **SCALED)


@query("snk5_detector_transitions", *DETECTOR, sql="select sensor, ts, occupied, round(score, 6) as score from (select *, lag(occupied, 1, false) over (partition by sensor order by n) as was from o) where occupied <> was")
def snk5(spark, d):
    return plan(frames(spark, d), SIMPLE, "transitions", **SCALED).select("sensor", "ts", "occupied", r6(F.col("score"), "score"))


#: The middle of the tables' month.
MIDDLE = 1_705_363_200.0
STATES = "select sensor, ts, occupied, round(score, 6) as score from o"


def stepped(spark, d, between):
    """The detector where something happens to a sensor's state between two frames: between(sensor, last time, this time) gives the state to go on with."""
    def run(batches):
        name, sensor, was = None, None, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.sensor != name:
                    name, sensor, was = r.sensor, Sensor(SETTINGS), None
                sensor, was = between(sensor, was, r.ts), r.ts
                state = sensor.step(r.ts, r.ts, r.move, r.still, r.device_occ)[0]
                out.append((name, r.ts, state["occupied"], state["score"]))
            yield pd.DataFrame(out, columns=["sensor", "ts", "occupied", "score"])

    rows = R.ordered(frames(spark, d).select("sensor", "ts", "id", "move", "still", "device_occ"), "sensor")
    return rows.mapInPandas(run, "sensor string, ts double, occupied boolean, score double").withColumn("score", r6(F.col("score"), "score"))


@query("snk12_restored_states", *DETECTOR, sql=STATES)
def snk12(spark, d):
    """Saved as bytes and restored between all frames: nothing that is learned gets lost."""
    return stepped(spark, d, lambda s, was, now: S.restore(S.save(s), s.c))


@query("pln7_reconfigured_states", *Q.detector((30.0,), SCALED["k"], later=(MIDDLE, 150.0)), sql=STATES)
def pln7(spark, d):
    """Another energy floor from the middle on, with everything learned as it was."""
    return stepped(spark, d, lambda s, was, now: S.reconfigured(s, configured(s.c, energy_floor=150.0)) if now >= MIDDLE and s.c.energy_floor != 150.0 else s)


@query("pln9_reset_states", *Q.detector((30.0,), SCALED["k"], source=f"(select * replace (sensor || (ts >= {MIDDLE})::varchar as sensor) from f) as f"), sql="select regexp_replace(sensor, '(true|false)$', '') as sensor, ts, occupied, round(score, 6) as score from o")
def pln9(spark, d):
    """All learning forgotten in the middle: from there on as a new sensor."""
    return stepped(spark, d, lambda s, was, now: Sensor(s.c) if was is not None and was < MIDDLE <= now else s)


#: Stage lists and what the planner makes of them, worked out by hand.
LISTS = (
    ("tail_spread", "run_score", "lone_gate_suppression", "quantile_floor"),
    ("score_hold", "ownership", "run_score", "mode_spread", "recurring_floor"),
    ("quantile_floor", "tail_spread", "retention_hold"),
    ("run_score", "quantile_floor"),
    ("quantile_floor", "tail_spread", "nonsense"),
    ("histogram_floor", "quantile_floor", "mode_spread", "tail_spread", "arrival", "move_ceiling"),
)
PLANNED = (
    "tail_spread,lone_gate_suppression,quantile_floor,run_score", "ownership,run_score,recurring_floor,score_hold,mode_spread", "refused: retention", "refused: spread",
    "refused: nonsense", "histogram_floor,quantile_floor,mode_spread,tail_spread,move_ceiling,arrival",
)


@query("pln1_5_planned_stages", sql="select * from (values " + ", ".join(f"({k}, '{p}', {f})" for k, (p, f) in enumerate(zip(PLANNED, ("'quantile_floor'", "'recurring_floor'", "'quantile_floor'", "'quantile_floor'", "'quantile_floor'", "'histogram_floor'"), strict=True))) + ") as t(list, planned, floor)")
def pln15(spark, d):
    """Stages in an order that gives each one what it needs, lists that are refused with what is wrong, and the floor that counts, the first listed."""
    def planned(names: tuple[str, ...]) -> str:
        try:
            return ",".join(s.name for s in order(names))
        except ValueError as e:
            return "refused: " + str(e).split("'")[-2]

    rows = [(k, planned(names), chosen(names, "floor")) for k, names in enumerate(LISTS)]
    return spark.createDataFrame(rows, "list int, planned string, floor string")


@query("pln8_accepted_settings", SQL_SAMPLES, "v as (select distinct energy from s)", sql="select energy, energy / 8.0 between 1 and 10 as k, energy / 4.0 between 0.5 and 20 as enter_score, energy - 10 between -1 and 8 as lead_gate_max from v")
def pln8(spark, d):
    """Which values of three settings are accepted."""
    def accepted(**setting) -> bool:
        try:
            return bool(configured(**setting))
        except ValueError:
            return False

    def run(batches):
        for b in batches:
            rows = [(int(e), accepted(k=e / 8), accepted(enter_score=e / 4), accepted(lead_gate_max=int(e) - 10)) for e in b["energy"]]
            yield pd.DataFrame(rows, columns=["energy", "k", "enter_score", "lead_gate_max"])

    return samples(spark, d).select("energy").distinct().mapInPandas(run, "energy int, k boolean, enter_score boolean, lead_gate_max boolean")


@query("prj13_derived_settings", SQL_SAMPLES, "v as (select distinct energy from s where energy > 0)", sql="select energy, energy / 8.0 * 0.5 as gate_on, energy / 8.0 * 0.25 as gate_off, greatest(1, round_even(3600.0 / energy, 0))::int as window_buckets, energy * 86400.0 as stats_half_life_s from v")
def prj13(spark, d):
    """Thresholds that follow from settings."""
    def run(batches):
        for b in batches:
            of = [(int(e), Config(k=e / 8, baseline_window_s=3600.0, bucket_s=float(e), stats_half_life_days=float(e))) for e in b["energy"]]
            yield pd.DataFrame([(e, c.gate_on, c.gate_off, c.window_buckets, c.stats_half_life_s) for e, c in of], columns=["energy", "gate_on", "gate_off", "window_buckets", "stats_half_life_s"])

    return samples(spark, d).where("energy > 0").select("energy").distinct().mapInPandas(run, "energy int, gate_on double, gate_off double, window_buckets int, stats_half_life_s double")


@query("pln_all_stages")
def pln_all(spark, d):
    return plan(frames(spark, d), ALL_STAGES, **SCALED).select("sensor", "ts", "occupied", "owned", "retention_max", "anchored")


@query("pln_default_stages")
def pln_default(spark, d):
    return plan(frames(spark, d), **SCALED).select("sensor", "ts", "occupied", "gate_classes", "boundary_gate", "anchored")


@query("rel_releases")
def releases(spark, d):
    stages = (*SIMPLE[:-1], "motion_anchor", "in_room_gates", "nearest_gate_release", "changepoint_release")
    return plan(frames(spark, d), stages, "transitions", **SCALED).select("sensor", "ts", "occupied")


@query("pln6_sweep", *Q.detector((0.0, 30.0, 150.0), SCALED["k"]), sql="select least as energy_floor, sensor, count(*) filter (where occupied) as entries from (select *, lag(occupied, 1, false) over (partition by sensor, least order by n) as was from o) where occupied <> was group by all")
def pln6(spark, d):
    grid = [{"stages": SIMPLE, **SCALED, "energy_floor": e} for e in (0.0, 30.0, 150.0)]
    s = sweep(frames(spark, d), grid)
    least = F.regexp_extract("settings", r"'energy_floor', ([0-9.]+)", 1).cast("double")
    return s.groupBy(least.alias("energy_floor"), "sensor").agg(F.count_if("occupied").alias("entries"))


@query("snk4_state_lines", *DETECTOR, sql="select concat_ws(',', round(ts::decimal(20, 6), 3)::varchar, printf('%.4f', score), printf('%.4f', case when ready then 1 / (1 + exp(-(4 / 3.0) * (score - 3))) else 0.5 end), occupied::int::varchar, coalesce(list_aggregate(active, 'string_agg', '|'), '')) as value from o")
def snk4(spark, d):
    return sinks.state_lines(plan(frames(spark, d), SIMPLE, **SCALED))


@query("rec2_3_retention", *Q.RETENTION[0], sql=Q.RETENTION[1])
def rec23(spark, d):
    import numpy as np

    def step(s: dict, r) -> tuple:
        s.setdefault("r", Retention())
        s["r"].observe(None if "t" not in s else (r.ts - s["t"]) / 600.0, np.asarray(r.still, float))
        s["t"] = r.ts
        return r.id, s["r"].level(), s["r"].holds()

    return R.fold(frames(spark, d).select("sensor", "ts", "id", "still"), ("sensor",), dict, step, "id long, peak double, blocking boolean").withColumn("peak", r6(F.col("peak"), "peak"))


@query("rec13_motion_anchor", *Q.ANCHOR[0], sql=Q.ANCHOR[1])
def rec13(spark, d):
    import numpy as np

    floor, spread = np.full(9, 30.0), np.full(9, 10.0)

    def step(a: Anchor, r) -> tuple:
        got = a.observe(r.ts / 86_400.0, np.asarray(r.move, float), np.asarray(r.still, float), floor, spread)
        return r.id, bool(got), float(a.score)

    return R.fold(frames(spark, d).select("sensor", "ts", "id", "move", "still"), ("sensor",), lambda: Anchor(40.0), step, "id long, anchored boolean, score double").withColumn("score", r6(F.col("score"), "score"))


@query("arm1_crossing", *Q.ARMING[0], sql=Q.ARMING[1])
def arm1(spark, d):
    """A room that is owned throughout; an hour of events stands for a second."""
    def step(a: Arming, r) -> tuple:
        a.see(r.ts / 3600.0, r.gate, True)
        return r.id, a.step(r.ts / 3600.0), a.recent(r.ts / 3600.0)

    return R.fold(samples(spark, d).select("sensor", "ts", "id", "gate"), ("sensor",), Arming, step, "id long, armed boolean, near boolean")


@query("rec15_changepoints")
def rec15(spark, d):
    """Joint changepoints of each sensor's still gates from the third on."""
    f = frames(spark, d).select("sensor", "ts", "id", F.slice("still", 3, 7).alias("still"))
    return R.changepoints(f, "still", [30.0] * 7, [10.0] * 7, "sensor")


@query("src7_wire_decode", SQL_FRAMES, sql="select sensor, ts, move, still, distance_cm, device_occ from f")
def src7(spark, d):
    """Frames encoded as reports, cut into pieces that don't match them, and decoded again."""
    def encode(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                data = wire.encode_report(int(r.device_occ), 0, 0, 0, 0, int(r.distance_cm), list(r.move), list(r.still))
                rows += [(r.sensor, r.ts, 2 * r.id, b"\x00" + data[:11]), (r.sensor, r.ts, 2 * r.id + 1, data[11:])]
            yield pd.DataFrame(rows, columns=["sensor", "ts", "id", "data"])

    chunks = frames(spark, d).mapInPandas(encode, "sensor string, ts double, id long, data binary")
    return wire.decode_stream(chunks).drop("id")


@query("src8_commands", SQL_SAMPLES, sql="select id, 'fdfcfbfa' || '0400' || '6100' || lpad(lower(format('{:x}', gate)), 2, '0') || lpad(lower(format('{:x}', energy)), 2, '0') || '04030201' as command from s")
def src8(spark, d):
    data = F.unhex(F.concat(F.lpad(F.hex(F.col("gate").cast("long")), 2, "0"), F.lpad(F.hex(F.col("energy").cast("long")), 2, "0")))
    return samples(spark, d).select("id", F.lower(F.hex(wire.command_column(0x61, data))).alias("command"))


@query("src9_time_parameters", SQL_SAMPLES, sql="select id, ts as epoch, floor(ts)::bigint as iso from s")
def src9(spark, d):
    """The same times given as a number and as ISO-8601 text."""
    s = samples(spark, d).select("id", F.col("ts").cast("string").alias("a"), F.date_format(F.timestamp_seconds(F.floor("ts")), "yyyy-MM-dd'T'HH:mm:ss").alias("b"))
    return s.select("id", sinks.parse_time(F.col("a")).alias("epoch"), sinks.parse_time(F.col("b")).cast("long").alias("iso"))


@query("agg29_32_group_models")
def models(spark, d):
    """Mode estimators and factor errors of each sensor's daily gate profiles; a group is one day's few rows."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["move"].to_numpy()).astype(float)
        flat = x.ravel()
        counts = np.bincount(flat.astype(int), minlength=101)
        return pd.DataFrame([{
            "sensor": pdf["sensor"].iloc[0], "day": pdf["day"].iloc[0], "hist_mode": int(counts.argmax()), "kde_mode": M.kde_mode(counts),
            "mix_low": M.two_mixture_low(flat), "nmf_error": M.nmf(x, 2, 60, 1)[2], "hmm_share": float(M.two_state_hmm(x.max(axis=1), 8)[1].mean()),
        }])

    f = frames(spark, d).withColumn("day", F.floor(F.col("ts") / 86_400).cast("long"))
    return f.select("sensor", "day", "move").groupBy("sensor", "day").applyInPandas(run, "sensor string, day long, hist_mode int, kde_mode int, mix_low double, nmf_error double, hmm_share double")


@query("win11_regimes", SQL_SAMPLES, "x as (select id, sensor, quantile_cont(energy, 0.5) over (partition by sensor order by ts, id rows between 50 preceding and 6 preceding) as pre, quantile_cont(energy, 0.5) over (partition by sensor order by ts, id rows between current row and 29 following) as post from s)", sql="select id, round(pre, 6) as pre, round(post, 6) as post, pre - post >= greatest(3.0, 0.5 * pre) as lost from x where pre is not null")
def win11(spark, d):
    w = I.order_by("sensor")
    x = samples(spark, d).select("id", F.percentile("energy", 0.5).over(w.rowsBetween(-50, -6)).alias("pre"), F.percentile("energy", 0.5).over(w.rowsBetween(0, 29)).alias("post"))
    x = x.where("pre is not null")
    return x.select("id", r6(F.col("pre"), "pre"), r6(F.col("post"), "post"), (F.col("pre") - F.col("post") >= F.greatest(F.lit(3.0), 0.5 * F.col("pre"))).alias("lost"))


@query("win12_window_review", SQL_FRAMES, "m as (select id, sensor, ts, list_avg(move) as mu, move from f)", "k as (select id, sensor, ts, list_avg(list_transform(move, lambda x: pow(x - mu, 4))) / nullif(pow(list_avg(list_transform(move, lambda x: (x - mu) * (x - mu))), 2), 0) as kurt from m)", sql="select id, round(quantile_cont(kurt, 0.25) over (partition by sensor order by ts, id rows between 19 preceding and current row), 5) as review from k")
def win12(spark, d):
    from gatelens.functions import arrays as A

    k = frames(spark, d).select("id", "sensor", "ts", A.moments(F.col("move"))[2].alias("kurt"))
    w = I.order_by("sensor").rowsBetween(-19, 0)
    return k.select("id", F.round(F.percentile("kurt", 0.25).over(w), 5).alias("review"))


@query("win22_peaks", SQL_SAMPLES, "x as (select *, lag(energy) over w as p, lead(energy) over w as n, ts - lag(ts) over w as g1, lead(ts) over w - ts as g2 from s window w as (partition by sensor order by ts, id))", sql="select id, sensor, energy from x where energy > p and energy >= n and energy >= 18 and g1 <= 3600 and g2 <= 3600")
def win22(spark, d):
    w = I.order_by("sensor")
    x = samples(spark, d).withColumns({"p": F.lag("energy").over(w), "n": F.lead("energy").over(w), "g1": F.col("ts") - F.lag("ts").over(w), "g2": F.lead("ts").over(w) - F.col("ts")})
    return x.where("energy > p and energy >= n and energy >= 18 and g1 <= 3600 and g2 <= 3600").select("id", "sensor", "energy")


@query("agg38_conditioned_histograms", SQL_SAMPLES, "c as (select distinct sensor, floor(ts / 3600)::bigint as cell, gate from s where energy >= 60)", "o as (select c.* from c where not exists (select 1 from c b where b.sensor = c.sensor and b.cell between c.cell - 2 and c.cell - 1))", sql="select sensor, gate, count(*) as origins from o group by all")
def agg38(spark, d):
    """Where activity begins: cells with none in the two cells before."""
    c = samples(spark, d).where("energy >= 60").select("sensor", F.floor(F.col("ts") / 3600).cast("long").alias("cell"), "gate").distinct()
    cells = c.select("sensor", "cell").distinct()
    before = cells.withColumn("cell", F.explode(F.array(F.col("cell") + 1, F.col("cell") + 2))).distinct()
    return c.join(before, ["sensor", "cell"], "left_anti").groupBy("sensor", "gate").agg(F.count("*").alias("origins"))


@query("agg42_onset_classes", SQL_SAMPLES, "b0 as (select *, ts - lag(ts) over (partition by sensor order by ts, id) > 3600 as br from s where energy >= 40)", "b1 as (select *, count(*) filter (where coalesce(br, true)) over (partition by sensor order by ts, id) as ep from b0)", "e as (select sensor, ep, min(ts) as t0, max(ts) as t1 from b1 group by all)", sql="select b1.sensor, b1.ep, min(gate) filter (where ts - t0 <= 600)::int as lead_10m, min(gate) filter (where ts - t0 <= 3600)::int as lead_1h, case when max(t1) - max(t0) >= 7200 then 'confirmed' when max(t1) - max(t0) < 600 then 'fizzled' else 'ambiguous' end as kind from b1 join e using (sensor, ep) group by b1.sensor, b1.ep")
def agg42(spark, d):
    b = I.islands(samples(spark, d).where("energy >= 40"), I.gap_over(3600.0, "sensor"), "sensor", name="ep")
    t0 = F.min("ts").over(Window.partitionBy("sensor", "ep"))
    b = b.withColumn("since", F.col("ts") - t0)
    length = F.max("since")
    kind = F.when(length >= 7200, "confirmed").when(length < 600, "fizzled").otherwise("ambiguous")
    return b.groupBy("sensor", "ep").agg(F.min(F.when(F.col("since") <= 600, F.col("gate"))).alias("lead_10m"), F.min(F.when(F.col("since") <= 3600, F.col("gate"))).alias("lead_1h"), kind.alias("kind"))


@query("jon15_matched_pairs", *Q.PAIRS[0], sql=Q.PAIRS[1])
def jon15(spark, d):
    """One-to-one pairs of strong rows of both channels a sensor and gate."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.chan == k].sort_values(["energy", "ts", "id"]) for k in (0, 1))
        got = M.greedy_pairs(list(zip(a.energy, a.ts, strict=True)), list(zip(b.energy, b.ts, strict=True)))
        return pd.DataFrame([(int(a.id.iloc[i]), int(b.id.iloc[j])) for i, j in got], columns=["a", "b"])

    return samples(spark, d).where("energy >= 40").groupBy("sensor", "gate").applyInPandas(run, "a long, b long")


@query("rec19_30_marches")
def marches(spark, d):
    """Zig-zag turns, the legs between them and marches along each sensor's path of hourly cells; a gap of over three cells breaks a track."""
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        path, cells = pdf.mid.to_numpy(float), pdf.cell.to_numpy()
        turns = M.turning_points(path)
        rows = [(pdf.sensor.iloc[0], "turn", int(cells[k]), int(cells[k]), 0.0) for k in turns]
        rows += [(pdf.sensor.iloc[0], "leg", a, b, m) for a, b, m in M.legs(cells, path, turns)]
        rows += [(pdf.sensor.iloc[0], "march", a, b, m) for a, b, m in M.marches(cells, np.asarray(path))]
        return pd.DataFrame(rows, columns=["sensor", "kind", "start", "end", "displacement"])

    c = samples(spark, d).where("energy >= 50").groupBy("sensor", F.floor(F.col("ts") / 3600).cast("long").alias("cell")).agg(F.avg("gate").alias("mid"))
    c = I.islands(c, F.col("cell") - F.lag("cell").over(I.order_by("sensor", by=("cell",))) > 3, "sensor", by=("cell",), name="track")
    return c.groupBy("sensor", "track").applyInPandas(run, "sensor string, kind string, start long, end long, displacement double")


@query("spc1_room_belief", *Q.BELIEF[0], sql=Q.BELIEF[1])
def spc1(spark, d):
    def step(s: dict, r) -> tuple:
        s["p"] = M.belief(s.get("p", 0.0), r.ts - s.get("t", r.ts), r.energy / 100.0, 0.3, 7200.0)
        s["t"] = r.ts
        return r.id, s["p"]

    return R.fold(samples(spark, d).select("sensor", "ts", "id", "energy"), ("sensor",), dict, step, "id long, belief double").withColumn("belief", r6(F.col("belief"), "belief"))


@query("spc6_7_evidence", SQL_SAMPLES, "w as (select id, sensor, ts, chan, gate, energy, max(energy) over (partition by sensor order by ts range between 3600 preceding and current row) - min(energy) over (partition by sensor order by ts range between 3600 preceding and current row) as rise from s)", sql="select id, case when chan = 0 and gate <= 1 and energy >= 80 then 'door' when chan = 1 and energy >= 80 then 'bed' when rise <= 10 then 'co2_flat' when rise >= 60 then 'co2_rise' else 'none' end as evidence from w")
def spc67(spark, d):
    w = Window.partitionBy("sensor").orderBy(I.micros()).rangeBetween(-3_600_000_000, 0)
    rise = F.max("energy").over(w) - F.min("energy").over(w)
    s = samples(spark, d).withColumn("rise", rise)
    kind = F.when((F.col("chan") == 0) & (F.col("gate") <= 1) & (F.col("energy") >= 80), "door").when((F.col("chan") == 1) & (F.col("energy") >= 80), "bed")
    return s.select("id", kind.when(F.col("rise") <= 10, "co2_flat").when(F.col("rise") >= 60, "co2_rise").otherwise("none").alias("evidence"))

"""Queries that join on time."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gatelens.operators import intervals as V
from gatelens.operators import islands as I
from gatelens.sources.tables import SQL_FRAMES, SQL_SAMPLES, SQL_SPANS, frames, samples, spans

from .registry import query, r6

BIN = 7200.0
FLAG = "g as (select *, energy >= 70 as hot from s)"
RUNS = "t0 as (select *, lag(hot, 1, false) over (partition by sensor order by ts, id) as was from g), t as (select * from t0 where hot <> was), ru0 as (select sensor, hot, ts as start, coalesce(lead(ts) over (partition by sensor order by ts, id), (select max(ts) from s)) as stop from t), ru as (select sensor, start, stop from ru0 where hot)"


def runs(spark, d):
    s = samples(spark, d).withColumn("hot", F.col("energy") >= 70)
    return I.occupied_runs(s, "hot", F.lit(s.agg(F.max("ts")).first()[0]), "sensor")


@query("jon1_overlap", SQL_SAMPLES, SQL_SPANS, FLAG, RUNS, sql='select ru.sensor, count(*) as pairs, round(sum(least(stop, "end") - greatest(ru.start, sp.start)), 3) as overlap from ru join sp on ru.sensor = sp.sensor and ru.start < sp."end" and sp.start < stop group by ru.sensor')
def jon1(spark, d):
    left = runs(spark, d).withColumnsRenamed({"start": "l_start", "end": "l_end"})
    right = spans(spark, d).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    p = V.overlap_pairs(left, right, BIN, "sensor")
    return p.groupBy("sensor").agg(F.count("*").alias("pairs"), F.round(F.sum("overlap"), 3).alias("overlap"))


@query("jon2_first_entry", SQL_SAMPLES, SQL_SPANS, "p as (select * from s where energy >= 70)", sql='select name, sp.sensor, start, min(p.ts) as first, min(p.ts) - any_value(start) as latency from sp left join p on p.sensor = sp.sensor and p.ts >= start and p.ts <= "end" group by all')
def jon2(spark, d):
    hot = samples(spark, d).where("energy >= 70").select("sensor", "ts")
    return V.first_in_span(hot, spans(spark, d), BIN, "sensor").select("name", "sensor", "start", "first", "latency")


@query("jon3_false_entries", SQL_SAMPLES, SQL_SPANS, sql='select id, sensor, ts from s where energy >= 90 and not exists (select 1 from sp where sp.sensor = s.sensor and s.ts between start and "end")')
def jon3(spark, d):
    hot = samples(spark, d).where("energy >= 90").select("id", "sensor", "ts")
    return V.points_outside(hot, spans(spark, d), BIN, "sensor")


@query("jon4_frame_class", SQL_SAMPLES, SQL_SPANS, sql='select s.id, name from s join sp on s.sensor = sp.sensor and s.ts >= start and s.ts < "end"')
def jon4(spark, d):
    return V.points_in(samples(spark, d).select("id", "sensor", "ts"), spans(spark, d), BIN, "sensor", closed=False).select("id", "name")


MOVED = "a as (select * from s where chan = 0), b as (select * from s where chan = 1)"


@query("jon5_nearest", SQL_SAMPLES, MOVED, "x as (select a.id, b.energy, row_number() over (partition by a.id order by abs(a.ts - b.ts), b.ts, b.id desc) as k from a join b on a.sensor = b.sensor and abs(a.ts - b.ts) <= 900)", sql="select a.id, x.energy as match from a left join x on a.id = x.id and k = 1")
def jon5(spark, d):
    s = samples(spark, d)
    a = s.where("chan = 0").select("sensor", "ts", "id")
    return V.nearest(a, s.where("chan = 1"), "energy", 900.0, "sensor").select("id", "match")


@query("jon6_lagged_asof", SQL_SAMPLES, MOVED, "bb as (select sensor, ts as bts, id as bid, energy as be from b)", sql="select a.id, arg_max(be, (bts, bid)) as match from a left join bb on a.sensor = bb.sensor and bts <= a.ts - 3600 and bts > a.ts - 864000 group by a.id")
def jon6(spark, d):
    s = samples(spark, d)
    a = s.where("chan = 0").select("sensor", "ts", "id")
    return V.asof(a, s.where("chan = 1"), "energy", "sensor", lag_s=3600.0).select("id", "match")


@query("jon7_state_at", SQL_SAMPLES, "st as (select sensor, ts, id, case when energy >= 50 then 'on' else 'off' end as state from s where chan = 1)", sql="select s.id, (select arg_max(state, (st.ts, st.id)) from st where st.sensor = s.sensor and st.ts <= s.ts) as match from s")
def jon7(spark, d):
    s = samples(spark, d)
    states = s.where("chan = 1").select("sensor", "ts", "id", F.when(F.col("energy") >= 50, "on").otherwise("off").alias("state"))
    return V.asof(s.select("sensor", "ts", "id"), states, "state", "sensor").select("id", "match")


FA = "a as (select *, row_number() over (partition by sensor order by ts, id) as n from f where not device_occ), b as (select *, row_number() over (partition by sensor order by ts, id) as n from f where device_occ)"


@query("jon8_stream_mix", SQL_FRAMES, FA, sql="select a.sensor, a.n, list_sum(list_transform(list_zip(a.move, b.move), lambda z: greatest(z[1], z[2])))::bigint as mass_max, list_sum(list_transform(list_zip(a.move, b.move), lambda z: least(100, z[1] + z[2])))::bigint as mass_sum from a join b using (sensor, n)")
def jon8(spark, d):
    f = frames(spark, d).select("id", "sensor", "ts", "move", "device_occ")
    m = V.aligned(f.where("not device_occ"), f.where("device_occ"), "sensor")
    sum_ = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return m.select("sensor", F.col("n").cast("long").alias("n"), sum_(F.zip_with("l_move", "r_move", lambda x, y: F.greatest(x, y))).alias("mass_max"), sum_(F.zip_with("l_move", "r_move", lambda x, y: F.least(F.lit(100), x + y))).alias("mass_sum"))


@query("set2_overlay_tiled", SQL_FRAMES, "b as (select *, row_number() over (partition by sensor order by ts, id) as n from f)", "tile as (select move as tm, row_number() over (order by ts, id) as k from f where sensor = 'click' order by k limit 10)", sql="select sensor, n, list_sum(list_transform(list_zip(move, tm), lambda z: greatest(z[1], z[2])))::bigint as mass from b join tile on (n - 1) % 10 + 1 = k")
def set2(spark, d):
    """The first ten frames of one sensor, repeated, laid over every sensor's stream."""
    f = frames(spark, d)
    b = f.withColumn("n", F.row_number().over(I.order_by("sensor")).cast("long"))
    tile = f.where("sensor = 'click'").orderBy("ts", "id").limit(10)  # a tile of ten frames is the feature
    tile = tile.select(F.col("move").alias("tm"), F.row_number().over(Window.partitionBy("sensor").orderBy("ts", "id")).alias("k"))
    mass = F.aggregate(F.zip_with("move", "tm", lambda x, y: F.greatest(x, y)), F.lit(0).cast("long"), lambda x, y: x + y)
    return b.join(F.broadcast(tile), (F.col("n") - 1) % 10 + 1 == F.col("k")).select("sensor", "n", mass.alias("mass"))


@query("set1_tile_continue", SQL_SAMPLES, "x as (select sensor, ts, id, energy from s), m as (select sensor, max(ts) - min(ts) + 1 as span from x group by sensor)", sql="select sensor, ts + span * k as ts, energy, k from x join m using (sensor), (select unnest(range(0, 3)) as k)")
def set1(spark, d):
    x = samples(spark, d)
    m = x.groupBy("sensor").agg((F.max("ts") - F.min("ts") + 1).alias("span"))
    x = x.join(m, "sensor").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2))))
    return x.select("sensor", (F.col("ts") + F.col("span") * F.col("k")).alias("ts"), "energy", "k")


@query("set3_splice", SQL_FRAMES, FA, sql="select a.sensor, a.n, list_max(list_transform(list_zip(a.move, coalesce(b.move, [0, 0, 0, 0, 0, 0, 0, 0, 0])), lambda z: greatest(z[1], z[2]))) as top from a left join b on a.sensor = b.sensor and a.n = b.n + 100 and b.n <= 50")
def set3(spark, d):
    f = frames(spark, d)
    n = F.row_number().over(I.order_by("sensor")).cast("long")
    base = f.where("not device_occ").withColumn("n", n).select("sensor", "n", "move")
    short = f.where("device_occ").withColumn("n", n + 100).where("n <= 150").select("sensor", "n", F.col("move").alias("other"))
    j = base.join(short, ["sensor", "n"], "left")
    return j.select("sensor", "n", F.array_max(F.when(F.col("other").isNull(), F.col("move")).otherwise(F.zip_with("move", "other", lambda x, y: F.greatest(x, y)))).alias("top"))


@query("set4_gate_union", SQL_SAMPLES, sql="select sensor, floor(ts / 86400)::bigint as day, list_sort(list(distinct gate)) as gates from s where energy >= 95 group by all")
def set4(spark, d):
    return samples(spark, d).where("energy >= 95").groupBy("sensor", F.floor(F.col("ts") / 86_400).cast("long").alias("day")).agg(F.array_sort(F.collect_set("gate")).alias("gates"))


EP = "e0 as (select *, ts - lag(ts) over (partition by sensor, gate order by ts, id) > 3600 as br from s where energy >= 40), e1 as (select *, count(*) filter (where coalesce(br, true)) over (partition by sensor, gate order by ts, id) as ep from e0), ep as (select sensor, gate, ep, min(ts) as t0, max(ts) as t1 from e1 group by all)"


def gate_episodes(spark, d):
    e = I.islands(samples(spark, d).where("energy >= 40"), I.gap_over(3600.0, "sensor", "gate"), "sensor", "gate", name="ep")
    return e.groupBy("sensor", "gate", "ep").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))


@query("jon9_brief_outcome", SQL_SAMPLES, EP, "br as (select * from ep where t1 - t0 <= 600), su as (select * from ep where t1 - t0 >= 3600)", sql="select br.sensor, br.gate, br.ep, case when exists (select 1 from su where su.sensor = br.sensor and su.gate <> br.gate and abs(su.t0 - br.t1) <= 1800) then 'leading' else 'dead_end' end as outcome from br")
def jon9(spark, d):
    """Whether a sustained episode of another gate starts close to a brief one's end."""
    e = gate_episodes(spark, d)
    brief = e.where(F.col("t1") - F.col("t0") <= 600)
    near = brief.select("sensor", F.col("gate").alias("g"), F.col("ep").alias("e"), (F.col("t1") - 1800).alias("start"), (F.col("t1") + 1800).alias("end"))
    long = e.where(F.col("t1") - F.col("t0") >= 3600).select("sensor", "gate", F.col("t0").alias("ts"))
    hit = V.points_in(long, near, BIN, "sensor").where("gate <> g").select("sensor", F.col("g").alias("gate"), F.col("e").alias("ep"), F.lit(True).alias("hit")).distinct()
    return brief.join(hit, ["sensor", "gate", "ep"], "left").select("sensor", "gate", "ep", F.when(F.col("hit"), "leading").otherwise("dead_end").alias("outcome"))


TR = "tr as (select sensor, ep, min(t0) as t0, max(t1) as t1, min(gate) as lo, max(gate) as hi from (select *, count(*) filter (where coalesce(t0 > reach, true)) over (partition by sensor order by t0, gate, e0) as ep from (select sensor, gate, ep as e0, t0, t1, max(t1) over (partition by sensor order by t0, gate, ep rows between unbounded preceding and 1 preceding) as reach from ep)) group by all)"


def tracks(spark, d):
    by = ("t0", "gate", "ep")
    e = gate_episodes(spark, d)
    e = e.withColumn("reach", F.max("t1").over(I.order_by("sensor", by=by).rowsBetween(Window.unboundedPreceding, -1)))
    e = I.islands(e, F.col("t0") > F.col("reach"), "sensor", by=by, name="track")
    return e.groupBy("sensor", "track").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("gate").alias("lo"), F.max("gate").alias("hi"))


#: The sensors of one house hand over to each other; the given tables are of one house.
HOUSE = "home"
HAND = "ho as (select a.sensor as s1, b.sensor as s2, a.ep as a, b.ep as b, b.t0 - a.t1 as wait from tr a join tr b on a.sensor <> b.sensor and b.t0 - a.t1 between 0 and 120)"


def handoffs(spark, d, house=HOUSE):
    """Tracks of other sensors of the same house that begin soon after one ends; house is a name, or an expression on the tracks."""
    t = tracks(spark, d).withColumn("house", house if isinstance(house, Column) else F.lit(house))
    a = t.select("house", F.col("sensor").alias("s1"), F.col("track").alias("a"), F.col("t1").alias("start"), (F.col("t1") + 120).alias("end"))
    b = t.select("house", F.col("sensor").alias("s2"), F.col("track").alias("b"), F.col("t0").alias("ts"))
    return V.points_in(b, a, BIN, "house").where("s1 <> s2").select("s1", "s2", "a", "b", (F.col("ts") - F.col("start")).alias("wait"))


@query("jon10_handoffs", SQL_SAMPLES, EP, TR, HAND, sql="select s1, s2, a, b, round(wait, 3) as wait from ho")
def jon10(spark, d):
    return handoffs(spark, d).withColumn("wait", F.round("wait", 3))


@query("jon11_adjacency_lift", SQL_SAMPLES, EP, TR, HAND, "n as (select sensor, count(*) as n from tr group by sensor), sp as (select max(t1) - min(t0) as span from tr), h as (select s1, s2, count(*) as h from ho group by all)", sql="select s1, s2, h, round(h / (n1.n * n2.n * 120 / span), 6) as lift, h >= 25 and h >= 3 * (n1.n * n2.n * 120 / span) as adjacent from h join n n1 on n1.sensor = s1 join n n2 on n2.sensor = s2, sp")
def jon11(spark, d):
    """Handoffs of a pair of sensors against those that independent tracks would make; adjacent: 25 of them and three times as many."""
    t = tracks(spark, d)
    n = t.groupBy("sensor").agg(F.count("*").alias("n"))
    span = t.agg((F.max("t1") - F.min("t0")).alias("span"))
    h = handoffs(spark, d).groupBy("s1", "s2").agg(F.count("*").alias("h"))
    h = h.join(n.select(F.col("sensor").alias("s1"), F.col("n").alias("n1")), "s1").join(n.select(F.col("sensor").alias("s2"), F.col("n").alias("n2")), "s2")
    h = h.crossJoin(F.broadcast(span)).withColumn("e", F.col("n1") * F.col("n2") * 120 / F.col("span"))  # span: one row
    return h.select("s1", "s2", "h", r6(F.col("h") / F.col("e"), "lift"), ((F.col("h") >= 25) & (F.col("h") >= 3 * F.col("e"))).alias("adjacent"))


@query(
    "jon12_ghost_pairs", SQL_SAMPLES, EP, "n as (select sensor, gate, count(*) as n, sum(t1 - t0) as len from ep group by all), sp as (select max(t1) - min(t0) as span from ep)",
    "j as (select a.sensor as s1, a.gate as g1, b.sensor as s2, b.gate as g2, count(*) as n from ep a join ep b on a.sensor < b.sensor and a.t0 < b.t1 and b.t0 < a.t1 group by all having count(*) >= 3)",
    "l as (select j.*, j.n / ((a.len * b.n + b.len * a.n) / span) as lift from j join n a on a.sensor = s1 and a.gate = g1 join n b on b.sensor = s2 and b.gate = g2, sp)",
    sql="select s1, g1, s2, g2, n, round(lift, 6) as lift, n >= 25 and lift >= 3 as ghost from l",
)
def jon12(spark, d, house=HOUSE):
    """Gates of two sensors that are active together, against chance: episodes of given lengths thrown anywhere; ghost: 25 times and three times as often."""
    e = gate_episodes(spark, d).withColumn("house", house if isinstance(house, Column) else F.lit(house))
    a = e.select("house", F.col("sensor").alias("s1"), F.col("gate").alias("g1"), F.col("t0").alias("l_start"), F.col("t1").alias("l_end"))
    b = e.select("house", F.col("sensor").alias("s2"), F.col("gate").alias("g2"), F.col("t0").alias("r_start"), F.col("t1").alias("r_end"))
    j = V.overlap_pairs(a, b, BIN, "house").where("s1 < s2").groupBy("s1", "g1", "s2", "g2").agg(F.count("*").alias("n")).where("n >= 3")
    n = e.groupBy("sensor", "gate").agg(F.count("*").alias("k"), F.sum(F.col("t1") - F.col("t0")).alias("len"))
    for i in "12":
        j = j.join(n.select(F.col("sensor").alias(f"s{i}"), F.col("gate").alias(f"g{i}"), F.col("k").alias(f"k{i}"), F.col("len").alias(f"len{i}")), [f"s{i}", f"g{i}"])
    j = j.crossJoin(F.broadcast(e.agg((F.max("t1") - F.min("t0")).alias("span"))))  # one row
    lift = F.col("n") / ((F.col("len1") * F.col("k2") + F.col("len2") * F.col("k1")) / F.col("span"))
    return j.select("s1", "g1", "s2", "g2", "n", r6(lift, "lift"), ((F.col("n") >= 25) & (lift >= 3)).alias("ghost"))


@query("jon13_near_within", SQL_SAMPLES, EP, "nr as (select sensor, ts from s where gate <= 1 and energy >= 40)", sql="select ep.sensor, ep.gate, ep.ep, case when exists (select 1 from nr where nr.sensor = ep.sensor and nr.ts between t0 - 900 and t1 + 900) then 'owned' else 'orphan' end as kind from ep")
def jon13(spark, d):
    e = gate_episodes(spark, d).withColumn("name", F.concat_ws("|", "sensor", "gate", "ep"))
    wide = e.withColumns({"start": F.col("t0") - 900, "end": F.col("t1") + 900})
    near = samples(spark, d).where("gate <= 1 and energy >= 40").select("sensor", "ts")
    owned = V.spans_hit(wide, near, BIN, "sensor").select("name", F.lit("owned").alias("kind"))
    return e.join(owned, "name", "left").select("sensor", "gate", "ep", F.coalesce("kind", F.lit("orphan")).alias("kind"))


@query("agg24_bleed_pressure", SQL_SAMPLES, EP, "nr as (select sensor, ts from s where gate <= 1 and energy >= 40), k as (select ep.sensor, t1 - t0 as len, exists (select 1 from nr where nr.sensor = ep.sensor and nr.ts between t0 - 900 and t1 + 900) as owned from ep)", sql="select sensor, round(sum(len) filter (where not owned), 3) as orphan_s, round(sum(len) filter (where owned), 3) as owned_s, round(coalesce(sum(len) filter (where not owned), 0) / nullif(sum(len) filter (where owned), 0), 6) as pressure from k group by sensor")
def agg24(spark, d):
    k = jon13(spark, d).join(gate_episodes(spark, d), ["sensor", "gate", "ep"]).withColumn("len", F.col("t1") - F.col("t0"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("len")))
    return k.groupBy("sensor").agg(F.round(of("orphan"), 3).alias("orphan_s"), F.round(of("owned"), 3).alias("owned_s"), r6(F.coalesce(of("orphan"), F.lit(0.0)) / F.nullif(of("owned"), F.lit(0.0)), "pressure"))


@query("jon14_span_coverage", SQL_SAMPLES, SQL_SPANS, FLAG, RUNS, sql='select name from sp where exists (select 1 from ru where ru.sensor = sp.sensor and ru.start < sp."end" and stop > sp.start - 60)')
def jon14(spark, d):
    left = runs(spark, d).withColumnsRenamed({"start": "l_start", "end": "l_end"})
    right = spans(spark, d).select("name", "sensor", (F.col("start") - 60).alias("r_start"), F.col("end").alias("r_end"))
    return V.overlap_pairs(left, right, BIN, "sensor").select("name").distinct()


@query("jon16_event_context", SQL_SAMPLES, "ev as (select id as event, sensor, ts as t from s where energy = 99)", sql="select event, count(*) as n, max(energy) as peak from ev join s on ev.sensor = s.sensor and s.ts between t - 3600 and t group by event")
def jon16(spark, d):
    s = samples(spark, d)
    ev = s.where("energy = 99").select(F.col("id").alias("event"), "sensor", (F.col("ts") - 3600).alias("start"), F.col("ts").alias("end"))
    return V.points_in(s.select("sensor", "ts", "energy"), ev, BIN, "sensor").groupBy("event").agg(F.count("*").alias("n"), F.max("energy").alias("peak"))


@query(
    "agg17_timeline_score", SQL_SAMPLES, SQL_SPANS, FLAG, RUNS,
    'en as (select ru.sensor, ru.start as at, count(name) as k from ru left join sp on sp.sensor = ru.sensor and ru.start between sp.start and sp."end" group by all)',
    'de as (select sp.sensor, name, min(ru.start) - sp.start as lat from sp join ru on sp.sensor = ru.sensor and ru.start between sp.start and sp."end" group by sp.sensor, name, sp.start)',
    'ov as (select ru.sensor, sum(least(stop, "end") - greatest(ru.start, sp.start)) as o from ru join sp on ru.sensor = sp.sensor and ru.start < sp."end" and sp.start < stop group by ru.sensor)',
    'a as (select sensor, count(*) as entries, sum(stop - start) as rs from ru group by sensor)', 'b as (select sensor, count(*) as n, sum("end" - start) as ss from sp group by sensor)',
    "j as (select sensor, coalesce(entries, 0) as entries, coalesce(rs, 0) as rs, coalesce(n, 0) as n, coalesce(ss, 0) as ss, coalesce(o, 0) as o from a full join b using (sensor) left join ov using (sensor))",
    sql="select sensor, entries, (select count(*) from en where en.sensor = j.sensor and k = 0) as false_entries, (select count(*) from de where de.sensor = j.sensor) as spans_detected, n - (select count(*) from de where de.sensor = j.sensor) as spans_missed, round(coalesce((select sum(lat) from de where de.sensor = j.sensor), 0), 3) as latency, round(o, 3) as overlap_s, round(rs - o, 3) as false_s, round(ss - o, 3) as missed_s from j",
)
def agg17(spark, d):
    x = V.timeline_score(runs(spark, d), spans(spark, d), BIN, "sensor")
    return x.withColumns({c: F.round(c, 3) for c in ("latency", "overlap_s", "false_s", "missed_s")})


@query("src5_label_spans", SQL_SAMPLES, "l as (select sensor, ts, id, case gate % 3 when 0 then 'seated' when 1 then 'walk' else 'empty' end as label from s where energy >= 95), x as (select *, coalesce(lead(ts) over (partition by sensor order by ts, id), (select max(ts) from s)) - 300 as stop from l)", sql='select sensor, label, ts as start, stop as "end" from x where stop - ts > 480')
def src5(spark, d):
    s = samples(spark, d)
    label = F.when(F.col("gate") % 3 == 0, "seated").when(F.col("gate") % 3 == 1, "walk").otherwise("empty")
    events = s.where("energy >= 95").withColumn("label", label)
    return V.label_spans(events, F.lit(s.agg(F.max("ts")).first()[0]), 300.0, 480.0, "sensor")


@query("src4_ground_truth", SQL_SAMPLES, SQL_SPANS, sql="select name, start, \"end\" from sp where sensor = 'view'")
def src4(spark, d):
    return spans(spark, d).where("sensor = 'view'").select("name", "start", "end")


@query("spc8_vacant_windows", SQL_SAMPLES, SQL_SPANS, 'q as (select ts, sum(d) as d from (select start as ts, 1 as d from sp union all select "end", -1 from sp) group by ts), w as (select ts as start, lead(ts) over (order by ts) as "end", sum(d) over (order by ts) as depth from q)', sql='select start, "end" from w where depth = 0 and "end" is not null')
def spc8(spark, d):
    """Times that no sensor's span covers."""
    every = spans(spark, d).withColumn("house", F.lit(1))
    return V.coverage(every, "start", "end", "house").where("depth = 0").select("start", "end")


@query("win23_resample_linear", SQL_SAMPLES, "c as (select sensor, floor(ts / 3600)::bigint as cell, avg(energy) as v from s group by all), n as (select *, lead(cell) over (partition by sensor order by cell) as nc, lead(v) over (partition by sensor order by cell) as nv from c)", sql="select sensor, (cell + k) * 3600 as t, round(v + (nv - v) * k / (nc - cell), 6) as v from n, lateral (select unnest(range(0, nc - cell)) as k) where nc is not null")
def win23(spark, d):
    c = samples(spark, d).groupBy("sensor", F.floor(F.col("ts") / 3600).cast("long").alias("cell")).agg(F.avg("energy").alias("v"))
    w = Window.partitionBy("sensor").orderBy("cell")
    n = c.withColumns({"nc": F.lead("cell").over(w), "nv": F.lead("v").over(w)}).where("nc is not null")
    n = n.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nc") - F.col("cell") - 1)))
    return n.select("sensor", ((F.col("cell") + F.col("k")) * 3600).alias("t"), r6(F.col("v") + (F.col("nv") - F.col("v")) * F.col("k") / (F.col("nc") - F.col("cell")), "v"))

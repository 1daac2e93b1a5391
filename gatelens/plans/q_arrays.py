"""Queries on gate arrays: residuals, centroids, runs, masks, shapes, formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatelens.functions import arrays as A
from gatelens.operators import islands as I
from gatelens.sources.tables import SQL_FRAMES, frames

from .config import Config
from .registry import query, r6

P = (
    "r as (select *, list_transform(move, lambda x: (x - 50) / 10.0) as rm, list_transform(still, lambda x: (x - 50) / 10.0) as rs from f), "
    "p as (select *, list_transform(range(1, 10), lambda i: greatest(0.0, rm[i], rs[i])::double) as peak from r), "
    "q as (select *, list_filter(range(0, 9), lambda i: peak[i + 1] >= 3) as act from p)"
)


def peaked(spark, d):
    f = frames(spark, d)
    floor, spread = F.array(*[F.lit(50.0)] * 9), F.array(*[F.lit(10.0)] * 9)
    f = f.withColumns({"rm": A.residual(F.col("move"), floor, spread), "rs": A.residual(F.col("still"), floor, spread)})
    f = f.withColumn("peak", A.peaks(F.col("rm"), F.col("rs")))
    return f.withColumn("act", A.active(F.col("peak"), 3.0))


#: Every gate's level over the last three frames, in units of the bar's; whole numbers are added, so that engines agree.
SUPPORT = (
    "sm as (select *, list_transform(range(1, 10), lambda i: greatest(move[i], still[i], 50) - 50) as over_ from q)",
    "su as (select *, [" + ", ".join(f"sum(over_[{i}]) over w / 30.0::double" for i in range(1, 10)) + "] as sup from sm window w as (partition by sensor order by ts, id rows between 2 preceding and current row))",
)


def supported(spark, d):
    w = I.order_by("sensor").rowsBetween(-2, 0)
    over = lambda i: F.greatest(F.get("move", i), F.get("still", i), F.lit(50)) - 50
    return peaked(spark, d).withColumn("sup", F.array(*(F.sum(over(F.lit(i))).over(w) / F.lit(30.0) for i in range(9))))


@query("prj2_peaks", SQL_FRAMES, P, sql="select id, round(list_sum(rm), 6) as move_sum, round(list_sum(rs), 6) as still_sum, round(list_sum(peak), 6) as peak_sum, len(act)::int as active from q")
def prj2(spark, d):
    return peaked(spark, d).select("id", r6(A.total(F.col("rm")), "move_sum"), r6(A.total(F.col("rs")), "still_sum"), r6(A.total(F.col("peak")), "peak_sum"), F.size("act").alias("active"))


@query("prj3_confidence", SQL_FRAMES, P, sql="select id, round(1 / (1 + exp(-(4 / 3.0) * (list_max(peak) - 3.0))), 6) as confidence from q")
def prj3(spark, d):
    return peaked(spark, d).select("id", r6(A.confidence(F.array_max("peak"), Config().enter_score), "confidence"))


@query("prj4_centroid_span", SQL_FRAMES, P, "u as (select id, unnest(act) as g, peak from q)", "c as (select id, sum(g * peak[g + 1]) / sum(peak[g + 1]) as m, sum(g * g * peak[g + 1]) / sum(peak[g + 1]) as m2 from u group by id)", sql="select id, round(coalesce(m, 0), 6) as centroid, round(coalesce(sqrt(greatest(m2 - m * m, 0)), 0), 6) as span from q left join c using (id)")
def prj4(spark, d):
    mean, span = A.centroid_span(F.col("peak"), F.col("act"))
    return peaked(spark, d).select("id", r6(mean, "centroid"), r6(span, "span"))


@query("prj5_supported_centroid", SQL_FRAMES, P, "u as (select id, unnest(list_filter(range(0, 9), lambda i: still[i + 1] >= 60 and peak[i + 1] > 0)) as g, peak from q)", "c as (select id, sum(g * peak[g + 1]) / sum(peak[g + 1]) as m from u group by id)", sql="select id, round(m, 6) as centroid from q left join c using (id)")
def prj5(spark, d):
    return peaked(spark, d).select("id", r6(A.supported_centroid(F.col("peak"), F.col("still"), 60), "centroid"))


@query("prj6_9_edge_and_range", SQL_FRAMES, P, sql="select id, case when list_min(act) <= 1 then 'near' when list_max(act) >= 6 then 'far' else 'none' end as edge, case when len(act) = 0 then 'clear' when list_min(act) = list_max(act) then list_min(act)::varchar else list_min(act) || '–' || list_max(act) end as gates from q")
def prj69(spark, d):
    return peaked(spark, d).select("id", A.edge_band(F.col("act"), 6).alias("edge"), A.range_label(F.col("act")).alias("gates"))


@query("prj7_features", SQL_FRAMES, P, sql="select id, sensor, round(coalesce(list_sum(list_transform(act, lambda i: greatest(rm[i + 1], 0))), 0), 6) as mass_move, round(coalesce(list_sum(list_transform(act, lambda i: greatest(rs[i + 1], 0))), 0), 6) as mass_still, case when len(act) > 0 then 'learned' else 'passthrough' end as mode from q")
def prj7_10(spark, d):
    mass = lambda r: F.aggregate("act", F.lit(0.0), lambda a, i: a + F.greatest(F.get(F.col(r), i), F.lit(0.0)))
    return peaked(spark, d).select("id", "sensor", r6(mass("rm"), "mass_move"), r6(mass("rs"), "mass_still"), F.when(F.size("act") > 0, "learned").otherwise("passthrough").alias("mode"))


@query("prj8_distance", SQL_FRAMES, P, sql="select id, round(case when device_occ and len(act) > 0 then 0.75 * list_sum(list_transform(act, lambda i: i * peak[i + 1])) / list_sum(list_transform(act, lambda i: peak[i + 1])) else distance_cm / 100.0 end, 6) as metres from q")
def prj8(spark, d):
    mean, _ = A.centroid_span(F.col("peak"), F.col("act"))
    return peaked(spark, d).select("id", r6(A.distance_m(F.col("device_occ"), F.col("act"), mean, F.col("distance_cm")), "metres"))


K = "k as (select *, list_transform(move, lambda x: case when x >= 80 then 'in_room' when x >= 60 then 'portal' when x >= 40 then 'bleed' when x >= 20 then 'unknown' else 'out' end) as cls from f)"


def classed(spark, d):
    of = lambda x: F.when(x >= 80, "in_room").when(x >= 60, "portal").when(x >= 40, "bleed").when(x >= 20, "unknown").otherwise("out")
    return frames(spark, d).withColumn("cls", F.transform("move", of))


@query("prj11_12_class_letters", SQL_FRAMES, K, sql="select id, list_aggregate(list_transform(cls, lambda c: case c when 'in_room' then 'I' when 'portal' then 'P' when 'bleed' then 'B' when 'out' then 'O' else 'U' end), 'string_agg', '') as letters, list_max(list_filter(range(0, 9), lambda i: cls[i + 1] = 'in_room'))::int as last_in_room from k")
def prj11(spark, d):
    return classed(spark, d).select("id", A.class_letters(F.col("cls")).alias("letters"), A.last_in_room(F.col("cls")).alias("last_in_room"))


@query("flt2_exclusion_mask", SQL_FRAMES, K, sql="select id, list_filter(range(0, 9), lambda i: cls[i + 1] in ('bleed', 'out') or i > 7) as barred from k")
def flt2(spark, d):
    barred = F.filter(A.index(), lambda i: F.get(F.col("cls"), i).isin("bleed", "out") | (i > 7))
    return classed(spark, d).select("id", F.transform(barred, lambda i: i.cast("long")).alias("barred"))


RUN = (
    "u as (select id, g, peak[g + 1] as v, {bar} as barred from q, (select unnest(range(0, 9)) as g)), "
    "h as (select *, g - row_number() over (partition by id order by g) as isl from u where v >= 3 and not barred), "
    "ru as (select id, isl, sum(v) / 3 as score, min(g) as lo, max(g) as hi from h group by id, isl), "
    "ok as (select ru.* from ru where {lone}), "
    "be as (select * from ok qualify row_number() over (partition by id order by score desc, lo) = 1)"
)
RUN_OUT = "select q.id, round(coalesce(score, 0), 6) as score, lo::int as lo, hi::int as hi from q left join be using (id)"


@query("scr1_strongest_run", SQL_FRAMES, P, RUN.format(bar="false", lone="true"), sql=RUN_OUT)
def scr1(spark, d):
    f = peaked(spark, d).withColumn("run", A.best_run(F.col("peak"), 3.0))
    return f.select("id", r6(F.col("run.score"), "score"), "run.lo", "run.hi")


BAR = "(peak[g + 1] >= 4.5)"


@query("scr1_masked_run", SQL_FRAMES, P, RUN.format(bar=BAR, lone="true"), sql=RUN_OUT)
def scr1m(spark, d):
    f = peaked(spark, d).withColumn("run", A.best_run(F.col("peak"), 3.0, F.transform("peak", lambda x: x >= 4.5)))
    return f.select("id", r6(F.col("run.score"), "score"), "run.lo", "run.hi")


@query("flt3_lone_gates", SQL_FRAMES, P, *SUPPORT, RUN.format(bar="false", lone="lo < hi or exists (select 1 from su where su.id = ru.id and (lo > 0 and sup[lo] >= 1.5 or lo < 8 and sup[lo + 2] >= 1.5))"), sql=RUN_OUT)
def flt3(spark, d):
    f = supported(spark, d).withColumn("run", A.best_run(F.col("peak"), 3.0, neighbour=1.5, support=F.col("sup")))
    return f.select("id", r6(F.col("run.score"), "score"), "run.lo", "run.hi")


LEAD = "ld as (select *, list_min(list_filter(range(0, 9), lambda i: rm[i + 1] >= 3 and (i = 0 or rm[i] < 3) and (coalesce(rm[i + 2] >= 3, false) or (i > 0 and sup[i] >= 1.5) or coalesce(sup[i + 2] >= 1.5, false)))) as lead, len(act) > 0 or list_max(sup) >= 1.5 as on_ from su)"


@query("scr2_leading_gate", SQL_FRAMES, P, *SUPPORT, LEAD, sql="select id, lead::int as lead from ld")
def scr2(spark, d):
    return supported(spark, d).select("id", A.leading_gate(F.col("rm"), 3.0, F.col("sup")).alias("lead"))


@query("scr4_raw_and_suppressed_leads", SQL_FRAMES, P, *SUPPORT, LEAD, sql="select id, list_min(list_filter(range(0, 9), lambda i: rm[i + 1] >= 3))::int as raw, lead::int as suppressed, coalesce(lead > list_min(list_filter(range(0, 9), lambda i: rm[i + 1] >= 3)), false) as moved from ld")
def scr4(spark, d):
    """The nearest gate over the bar, as it is and without lone gates, and whether that makes it a farther one."""
    raw = F.array_min(F.filter(A.index(), lambda i: F.get("rm", i) >= 3.0))
    f = supported(spark, d).select("id", raw.alias("raw"), A.leading_gate(F.col("rm"), 3.0, F.col("sup")).alias("suppressed"))
    return f.withColumn("moved", F.coalesce(F.col("suppressed") > F.col("raw"), F.lit(False)))


def activity(spark, d):
    """Frames with the leading gate, and a number that changes where activity, an active gate or one with support, begins or ends."""
    f = supported(spark, d).withColumn("lead", A.leading_gate(F.col("rm"), 3.0, F.col("sup")))
    f = f.withColumn("on", (F.size("act") > 0) | (F.array_max("sup") >= 1.5))
    return I.islands(f, F.col("on") != F.lag("on").over(I.order_by("sensor")), "sensor", name="run")


ACTIVITY = "a1 as (select *, count(*) filter (where coalesce(br, true)) over (partition by sensor order by ts, id) as run from (select *, on_ <> lag(on_) over (partition by sensor order by ts, id) as br from ld))"
SO_FAR = "over (partition by sensor, run order by ts, id rows unbounded preceding)"


@query("scr3_sticky_edge", SQL_FRAMES, P, *SUPPORT, LEAD, ACTIVITY, sql=f"select id, case when on_ then min(lead) {SO_FAR} end::int as edge from a1")
def scr3_ent3(spark, d):
    """The nearest leading gate since activity began; it is forgotten when activity ends."""
    w = I.order_by("sensor", "run").rowsBetween(Window.unboundedPreceding, 0)
    return activity(spark, d).select("id", F.when(F.col("on"), F.min("lead").over(w)).alias("edge"))


@query("flt5_balance", SQL_FRAMES, sql="select id, len(list_filter(range(2, 9), lambda i: move[i + 1] >= 40 and move[i + 1] / greatest(move[i + 1] + still[i + 1], 1)::double >= 1 / 3.0)) > 0 as balanced from f")
def flt5(spark, d):
    return frames(spark, d).select("id", A.balanced(F.col("move"), F.col("still"), Config().anchor_bar).alias("balanced"))


@query("flt6_balance_grid", SQL_FRAMES, "g as (select unnest([20, 40, 60]) as bar), h as (select unnest([0.25, 0.5, 0.75]) as share)", sql="select bar, share, count(*) filter (where len(list_filter(range(0, 9), lambda i: move[i + 1] >= bar and move[i + 1] / greatest(move[i + 1] + still[i + 1], 1)::double >= share)) > 0) as n from f, g, h group by bar, share")
def flt6(spark, d):
    f = frames(spark, d).withColumn("bar", F.explode(F.array(*map(F.lit, (20, 40, 60))))).withColumn("share", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75)))))
    return f.groupBy("bar", "share").agg(F.count_if(A.balanced(F.col("move"), F.col("still"), F.col("bar"), F.col("share"), 0)).alias("n"))


@query("flt1_key_range", SQL_FRAMES, sql="select sensor, count(*) as n from f where sensor in ('click', 'view') and ts >= 1704500000 and ts < 1705500000 group by sensor")
def flt1(spark, d):
    f = frames(spark, d).where(F.col("sensor").isin("click", "view") & (F.col("ts") >= 1_704_500_000) & (F.col("ts") < 1_705_500_000))
    return f.groupBy("sensor").agg(F.count("*").alias("n"))


@query("vec_shape_statistics", SQL_FRAMES, "m as (select id, list_sum(move) as s, list_avg(move) as mu, move from f), n as (select *, list_avg(list_transform(move, lambda x: (x - mu) * (x - mu))) as var, list_avg(list_transform(move, lambda x: (x - mu) * (x - mu) * (x - mu) * (x - mu))) as m4 from m)", sql="select id, round(mu, 6) as mean, round(sqrt(var), 6) as sd, round(m4 / nullif(var * var, 0), 6) as kurtosis, round(list_sum(list_transform(move, lambda x: case when x > 0 then -(x / s) * ln(x / s) else 0 end)), 6) as entropy, len(list_filter(range(1, 10), lambda i: (i = 1 or move[i] > move[i - 1]) and (i = 9 or move[i] >= move[i + 1])))::int as peaks from n")
def vec(spark, d):
    mean, sd, kurt = A.moments(F.col("move"))
    return frames(spark, d).select("id", r6(mean, "mean"), r6(sd, "sd"), r6(kurt, "kurtosis"), r6(A.entropy(F.col("move")), "entropy"), A.peak_count(F.col("move")).alias("peaks"))


@query("vec_cosine_previous", SQL_FRAMES, "a as (select id, move, lag(move) over (partition by sensor order by ts, id) as was from f)", sql="select id, round(list_dot_product(move::double[], was::double[]) / nullif(sqrt(list_dot_product(move::double[], move::double[])) * sqrt(list_dot_product(was::double[], was::double[])), 0), 6) as cosine from a where was is not null")
def vec_cos(spark, d):
    a = frames(spark, d).withColumn("was", F.lag("move").over(I.order_by("sensor"))).where("was is not null")
    return a.select("id", r6(A.cosine(F.col("move"), F.col("was")), "cosine"))


@query("win14_shape_path", SQL_FRAMES, "a as (select id, sensor, ts, move, lag(move) over w as was, lag(ts) over w as wts from f window w as (partition by sensor order by ts, id))", sql="select sensor, floor(ts / 86400)::bigint as day, round(avg(sqrt(list_sum(list_transform(range(1, 10), lambda i: (move[i] - was[i]) * (move[i] - was[i]))))), 6) as path from a where ts - wts <= 3600 group by all")
def win14(spark, d):
    w = I.order_by("sensor")
    a = frames(spark, d).withColumns({"was": F.lag("move").over(w), "gap": F.col("ts") - F.lag("ts").over(w)}).where("gap <= 3600")
    step = F.sqrt(A.total(F.zip_with("move", "was", lambda x, y: ((x - y) * (x - y)).cast("double"))))
    return a.groupBy("sensor", F.floor(F.col("ts") / 86_400).cast("long").alias("day")).agg(r6(F.avg(step), "path"))


@query("vec_profile_statistics", SQL_FRAMES, "m as (select id, move, list_sum(move)::double as s, list_max(move) as top from f)", sql="select id, s::bigint as mass, round(list_sum(move[1:3]) / nullif(s, 0), 6) as near_frac, round(list_sum(move[7:9]) / nullif(s, 0), 6) as deep_frac, (list_position(move, top) - 1)::int as peak_gate, len(list_filter(move, lambda x: x * 2 >= top))::int as half_gates, round(list_sum(list_transform(range(1, 10), lambda i: (i - 1) * move[i])) / nullif(s, 0), 6) as centroid from m")
def vec_profile(spark, d):
    m = frames(spark, d).withColumns({"s": A.total(F.col("move")), "top": F.array_max("move")})
    part = lambda a, n: A.total(F.slice("move", a, n)) / F.nullif(F.col("s"), F.lit(0.0))
    centre = A.total(F.transform("move", lambda x, i: (x * i).cast("double"))) / F.nullif(F.col("s"), F.lit(0.0))
    return m.select("id", F.col("s").cast("long").alias("mass"), r6(part(1, 3), "near_frac"), r6(part(7, 3), "deep_frac"), (F.array_position("move", F.col("top")) - 1).cast("int").alias("peak_gate"), F.size(F.filter("move", lambda x: x * 2 >= F.col("top"))).alias("half_gates"), r6(centre, "centroid"))


@query("src7_blob_round_trip", SQL_FRAMES, sql="select id, list_aggregate(list_transform(move, lambda x: lpad(lower(format('{:x}', x)), 2, '0')), 'string_agg', '') as hex, move from f")
def src7_blob(spark, d):
    f = frames(spark, d).withColumn("blob", A.gates_to_bytes(F.col("move")))
    return f.select("id", F.lower(F.hex("blob")).alias("hex"), A.bytes_to_gates(F.col("blob")).alias("move"))


@query("snk3_frame_lines", SQL_FRAMES, sql="select id, printf('%.3f', floor(ts * 1000) / 1000) || ',' || list_aggregate(list_transform(move, lambda x: x::varchar), 'string_agg', '|') || ',' || list_aggregate(list_transform(still, lambda x: x::varchar), 'string_agg', '|') || ',' || distance_cm || ',' || device_occ::int as line from f")
def snk3(spark, d):
    gates = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    line = F.concat_ws(",", F.format_string("%.3f", F.floor(F.col("ts") * 1000) / 1000), gates("move"), gates("still"), F.col("distance_cm").cast("string"), F.col("device_occ").cast("int").cast("string"))
    return frames(spark, d).select("id", line.alias("line"))


@query("snk7_timeline_json", SQL_FRAMES, P, sql="select id, '{\"sensor\":\"' || sensor || '\",\"kind\":\"' || case when list_max(move) >= 85 then 'occupied' else 'vacant' end || '\",\"active_gates\":[' || coalesce(list_aggregate(list_transform(act, lambda x: x::varchar), 'string_agg', ','), '') || ']}' as row from q")
def snk7(spark, d):
    kind = F.when(F.array_max("move") >= 85, "occupied").otherwise("vacant")
    return peaked(spark, d).select("id", F.to_json(F.struct("sensor", kind.alias("kind"), F.col("act").alias("active_gates"))).alias("row"))


@query("snk11_event_stream", SQL_FRAMES, P, "ev as (select id, sensor, ts, 'occupied' as kind from f where list_max(move) >= 98 union all select id, sensor, ts, 'boundary' from f where list_max(still) <= 60 union all select id, sensor, ts, 'device' from f where device_occ and distance_cm > 650)", sql="select id, sensor, kind from ev")
def snk11(spark, d):
    f = frames(spark, d)
    of = lambda cond, kind: f.where(cond).select("id", "sensor", F.lit(kind).alias("kind"))
    return of(F.array_max("move") >= 98, "occupied").unionByName(of(F.array_max("still") <= 60, "boundary")).unionByName(of(F.col("device_occ") & (F.col("distance_cm") > 650), "device"))


@query(
    "ent1_energy_floor", SQL_FRAMES, P, *SUPPORT, LEAD, ACTIVITY, "c as (select *, coalesce(list_max(list_transform(act, lambda i: move[i + 1] + still[i + 1])), 0) as both_ from a1)",
    sql=f"select id, max(both_) {SO_FAR} >= 150 as passes from c where on_",
)
def ent1(spark, d):
    """While activity goes on, whether the greatest energy of both channels at an active gate has reached the floor so far."""
    both = F.array_max(F.transform("act", lambda i: F.get("move", i) + F.get("still", i)))
    w = I.order_by("sensor", "run").rowsBetween(Window.unboundedPreceding, 0)
    f = activity(spark, d).withColumn("both", F.coalesce(both, F.lit(0)))
    return f.withColumn("passes", F.max("both").over(w) >= 150).where("on").select("id", "passes")


@query(
    "ent2_arrival", SQL_FRAMES, P, *SUPPORT, LEAD, ACTIVITY,
    "c as (select *, coalesce(list_max(list_transform(act, lambda i: move[i + 1])), 0) as top, max(list_max(move)) over (partition by sensor order by ts, id rows between 50 preceding and 1 preceding) as ceil from a1)",
    sql=f"select id, ceil is null or (count(*) filter (where top >= 0.95 * ceil) {SO_FAR}) >= 1 as passes from c where on_",
)
def ent2(spark, d):
    """While activity goes on, whether motion at an active gate has come near the ceiling so far; without a ceiling everything passes."""
    w0 = I.order_by("sensor").rowsBetween(-50, -1)
    top = F.coalesce(F.array_max(F.transform("act", lambda i: F.get("move", i))), F.lit(0))
    f = activity(spark, d).withColumns({"top": top, "ceil": F.max(F.array_max("move")).over(w0)})
    w = I.order_by("sensor", "run").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.count_if(F.col("top") >= 0.95 * F.col("ceil")).over(w) >= 1
    return f.withColumn("passes", F.col("ceil").isNull() | seen).where("on").select("id", "passes")


@query("occ2_passthrough", SQL_FRAMES, "b as (select *, dense_rank() over (partition by sensor order by floor(ts / 3600)) - 1 as done from f)", sql="select id, case when done < 5 then device_occ else list_max(move) >= 85 end as occupied, case when done < 5 then 0.5 else round(1 / (1 + exp(-0.1 * (list_max(move) - 85))), 6) end as confidence from b")
def occ2(spark, d):
    """Until five buckets have closed the device's own bit stands, with confidence one half."""
    f = frames(spark, d).withColumn("done", F.dense_rank().over(Window.partitionBy("sensor").orderBy(F.floor(F.col("ts") / 3600))) - 1)
    top = F.array_max("move")
    ready = F.col("done") >= 5
    return f.select("id", F.when(ready, top >= 85).otherwise(F.col("device_occ")).alias("occupied"), F.when(ready, F.round(1 / (1 + F.exp(-0.1 * (top - 85))), 6)).otherwise(0.5).alias("confidence"))


@query("occ4_rebase_epochs", SQL_FRAMES, "m as (select id, sensor, ts, ts - 864000.0 * floor(ts / 864000) as mono from f)", sql="select id, sensor, count(*) filter (where mono < was) over (partition by sensor order by ts, id) as epoch from (select *, lag(mono) over (partition by sensor order by ts, id) as was from m)")
def occ4(spark, d):
    """Process restarts, seen as a clock that ran backwards."""
    m = frames(spark, d).withColumn("mono", F.col("ts") - 864_000.0 * F.floor(F.col("ts") / 864_000))
    m = m.withColumn("was", F.lag("mono").over(I.order_by("sensor")))
    return m.select("id", "sensor", F.count_if(F.col("mono") < F.col("was")).over(I.order_by("sensor")).alias("epoch"))

"""SQL for ordered folds, as recursive common table expressions that go from row to row of a sensor.

They say the same as the folds in another form and are meant for small tables:
DuckDB goes through them a row a step.
"""

from __future__ import annotations

from gatelens.sources.tables import SQL_FRAMES, SQL_SAMPLES

R = "recursive "
#: Rows numbered by sensor, with the time since the row before.
ROWS = "x as materialized (select *, row_number() over (partition by sensor order by ts, id) as n, coalesce(ts - lag(ts) over (partition by sensor order by ts, id), 0) as dt from {0})"
NEXT = "from r join x on x.sensor = r.sensor and x.n = r.n + 1"


def step(name: str, first: str, then: str) -> str:
    return f"{name} as ({first} union all {then})"


def each(body: str, n: int = 9) -> str:
    return f"list_transform(range(1, {n + 1}), lambda i: {body})"


def gain(tau: float, dt: str = "least(greatest(x.dt / 600, 0), 2)") -> str:
    return f"(1 - exp(-{dt} / {tau:.1f}))"


# -- slow and fast means, beliefs ------------------------------------------------------------------


def ratio(signed: bool, reset_s: float) -> tuple[tuple[str, ...], str]:
    clamp = f"case when x.gate >= 7 and {reset_s} > 0 then x.ts + {reset_s} else r.clamp end"
    first = f"select sensor, n, id, ts, energy::double as fast, energy::double as slow, energy::double as was, 0.0::double as noise, case when gate >= 7 and {reset_s} > 0 then ts + {reset_s} else -1e300::double end as clamp from x where n = 1"
    then = f"select x.sensor, x.n, x.id, x.ts, r.fast + {gain(2)} * (x.energy - r.fast), r.slow + {gain(60)} * (x.energy - r.slow), x.energy::double, r.noise + {gain(10)} * (abs(x.energy - r.was) - r.noise), {clamp} {NEXT}"
    rise = "(fast - slow) / greatest(noise, 0.1)"
    return (R + SQL_SAMPLES, ROWS.format("s"), step("r", first, then)), f"select id, round(case when ts < clamp then 0 else {rise if signed else f'abs({rise})'} end, 6) as ratio from r"


BELIEF = (
    (
        R + SQL_SAMPLES, ROWS.format("s"),
        step("r", "select sensor, n, id, energy / 100.0 * 0.3::double as p from x where n = 1", f"select x.sensor, x.n, x.id, r.p * exp(-greatest(x.dt, 0) / 7200.0) + (1 - r.p * exp(-greatest(x.dt, 0) / 7200.0)) * (x.energy / 100.0) * 0.3 {NEXT}"),
    ),
    "select id, round(p, 6) as belief from r",
)


# -- retention, anchor, arming ---------------------------------------------------------------------


def _retention() -> tuple[tuple[str, ...], str]:
    noise = each(f"r.noise[i] + {gain(10)} * (least(abs(x.still[i] - r.was[i]), 4 * r.noise[i] + 0.5) - r.noise[i])")
    mean = lambda c, tau: each(f"r.{c}[i] + {gain(tau)} * (x.still[i] - r.{c}[i])")
    first = "select sensor, n, id, list_transform(still, lambda v: v::double) as fast, list_transform(still, lambda v: v::double) as slow, list_transform(still, lambda v: v::double) as was, list_transform(still, lambda v: 0.3::double) as noise, list_transform(still, lambda v: 0.0::double) as peak, false as latch from x where n = 1"
    moved = f"m as (select x.sensor, x.n, x.id, {mean('fast', 2)} as fast, {mean('slow', 60)} as slow, list_transform(x.still, lambda v: v::double) as was, {noise} as noise, r.peak as old, r.latch, exp(-least(greatest(x.dt / 600, 0), 2) / 90.0) as keep {NEXT})"
    peaks = f"p as (select *, {each('greatest(old[i] * keep, greatest((fast[i] - slow[i]) / greatest(noise[i], 0.1), 0))')} as peak from m)"
    then = f"select * from (with {moved}, {peaks} select sensor, n, id, fast, slow, was, noise, peak, list_max(peak) >= 20 or (latch and list_max(peak) >= 10) from p)"
    return (R + SQL_FRAMES, ROWS.format("f"), step("r", first, then)), "select id, round(list_max(peak), 6) as peak, latch as blocking from r"


RETENTION = _retention()


def _anchor() -> tuple[tuple[str, ...], str]:
    seven = lambda body: each(body, 7)
    norm = lambda c: f"list_sum(list_transform({c}, lambda v: v * v))"
    now = seven("greatest(still[i + 2] - 30, 0) / 10.0")
    made = (
        f"y as materialized (select *, {now} as now, list_max(move[3:9])::double as top from x)",
        f"z as materialized (select *, {seven('now[i] * (move[i + 2] / greatest(top, 1))')} as made, "
        "len(list_filter(range(3, 10), lambda i: move[i] >= 40 and move[i] / greatest(move[i] + still[i], 1)::double >= 1 / 3.0)) > 0 as balanced from y)",
    )
    kept = "case when z.n > 1 and not z.dt / 86400 between 0 and 0.55 then null else r.template end"
    strong = f"(z.top >= 40 and {norm('z.made')} >= 1)"
    grown = f"g as (select z.sensor, z.n, z.id, z.now, case when kept is null then (case when {strong} and z.balanced then z.made end) when {strong} and {norm('z.made')} > {norm('kept')} then z.made else kept end as template from (select z, {kept} as kept from r join z on z.sensor = r.sensor and z.n = r.n + 1) as k(z, kept))"
    scored = f"h as (select *, coalesce(list_sum(list_transform(range(1, 8), lambda i: now[i] * template[i])) / {norm('template')}, 0) as score from g)"
    shown = "select sensor, n, id, case when score >= 0.4 then template end as template, case when score >= 0.4 then score else 0 end as score from h"
    first = f"select * from (with g as (select sensor, n, id, now, case when {strong} and balanced then made end as template from z where n = 1), {scored} {shown})"
    then = f"select * from (with {grown}, {scored} {shown})"
    return (R + SQL_FRAMES, ROWS.format("f"), *made, step("r", first, then)), "select id, template is not null as anchored, round(score, 6) as score from r"


ANCHOR = _anchor()


def _arming() -> tuple[tuple[str, ...], str]:
    """An hour stands for a second; near gates are the first two, as by default."""
    near = "list_filter(case when x.gate <= 1 then list_append(r.near, x.t) else r.near end, lambda t: x.t - t <= 20)"
    last = "case when x.gate <= 1 then x.t else r.last end"
    seen = f"v as (select x.sensor, x.n, x.id, x.t, {near} as near, {last} as last, r.armed, r.quiet from (select 1) join r on true join (select *, ts / 3600.0 as t from x) as x on x.sensor = r.sensor and x.n = r.n + 1)"
    becomes = "not armed and not quiet and (last is null or t - last >= 10)"
    then = f"select * from (with {seen} select sensor, n, id, t, case when {becomes} then [] else near end, last, armed or (quiet and len(near) >= 20), quiet or ({becomes}) from v)"
    first = "select sensor, n, id, ts / 3600.0 as t, case when gate <= 1 then [ts / 3600.0] else [] end::double[] as near, case when gate <= 1 then ts / 3600.0 end as last, false as armed, gate > 1 as quiet from x where n = 1"
    return (R + SQL_SAMPLES, ROWS.format("s"), step("r", first, then)), "select id, armed, coalesce(t - last <= 60, false) as near from r"


ARMING = _arming()


# -- greedy choices --------------------------------------------------------------------------------


def _pairs() -> tuple[tuple[str, ...], str]:
    rows = "c as materialized (select sensor, gate, chan, id, ts, energy, row_number() over (partition by sensor, gate, chan order by energy, ts, id) as n from s where energy >= 40)"
    free = "fr as (select sensor, gate, list({'e': energy, 'ts': ts, 'id': id}) as free from c where chan = 1 group by all)"
    best = "list_sort(list_transform(list_filter(r.free, lambda y: abs(y.e - c.energy) <= greatest(5, 0.2 * c.energy)), lambda y: {'d': abs(y.e - c.energy), 'e': y.e, 'ts': y.ts, 'id': y.id}))[1].id"
    first = "select sensor, gate, 0::bigint as n, null::bigint as a, null::bigint as b, free from fr"
    then = f"select sensor, gate, n, a, b, list_filter(free, lambda y: y.id is distinct from b) from (select r.sensor, r.gate, c.n, c.id as a, {best} as b, r.free from r join c on c.sensor = r.sensor and c.gate = r.gate and c.chan = 0 and c.n = r.n + 1)"
    return (R + SQL_SAMPLES, rows, free, step("r", first, then)), "select a, b from r where b is not null"


PAIRS = _pairs()

PEAKS = (
    (
        R + SQL_SAMPLES,
        "m0 as (select *, max(energy) over (partition by sensor order by ts range between 900 preceding and 900 following) as top, max({'e': energy, 't': -ts, 'i': -id}) over (partition by sensor order by ts range between 900 preceding and 900 following) as raw from s)",
        "m1 as (select *, lag(top) over w as p, lead(top) over w as nx, ts - lag(ts) over w as g1, lead(ts) over w - ts as g2 from m0 window w as (partition by sensor order by ts, id))",
        "k as (select distinct -raw.i as id, sensor, -raw.t as ts, raw.e as energy from m1 where top >= p and top >= nx and top >= 18 and g1 <= 3600 and g2 <= 3600)",
        "o as materialized (select *, row_number() over (partition by sensor order by energy desc, ts, id) as n from k)",
        step("r", "select sensor, n, id, energy, [ts] as taken, true as stays from o where n = 1", "select sensor, n, id, energy, case when stays then list_append(taken, ts) else taken end, stays from (select o.sensor, o.n, o.id, o.energy, o.ts, r.taken, len(list_filter(r.taken, lambda t: abs(t - o.ts) < 7200)) = 0 as stays from r join o on o.sensor = r.sensor and o.n = r.n + 1)"),
    ),
    "select id, sensor, energy from r where stays",
)

BOUNDARY = (
    (
        R + SQL_SAMPLES,
        "d as (select sensor, floor(ts / 86400)::bigint as day, coalesce(max(gate) filter (where energy >= 97) + 1, 9) as target, coalesce(sum(energy) filter (where gate = 8) > 600, false) as busy from s group by all)",
        "x as materialized (select *, row_number() over (partition by sensor order by day) as n from d)",
        step(
            "r",
            "select sensor, n, day, case when busy then null else target end as now, busy as waited from x where n = 1",
            f"select x.sensor, x.n, x.day, case when x.target is not distinct from r.now then r.now when x.busy and not r.waited then r.now else x.target end, case when x.target is not distinct from r.now then false else x.busy and not r.waited end {NEXT}",
        ),
    ),
    "select sensor, day, coalesce(now, -1)::int as boundary from r",
)


# -- the detector with the windowed floor, the run score, the energy floor and the score hold --------


def quantile(values: str, q: float) -> str:
    """Of a list, linear between the two nearest values: the lower one and a part of the difference, in this order of operations."""
    at = f"({q} * (len(l) - 1))"
    low, high = f"l[floor({at})::bigint + 1]", f"l[least(floor({at})::bigint + 2, len(l))]"
    return f"list_transform([list_sort({values})], lambda l: {low} + ({high} - {low}) * ({at} - floor({at})))[1]"


def detector(floors: tuple[float, ...] = (30.0,), k: float = 3.0, source: str = "f", later: tuple[float, float] | None = None) -> tuple[str, ...]:
    """(sensor, least, n, ts, ready, score, active, occupied, rejection, frozen) as table o: a row a frame and energy floor (least).

    Other settings are those of the registered plans: buckets of an hour
    in a window of a day, five of them at least. later: a time from which on
    another energy floor holds.
    """
    floor = "least" if later is None else f"(case when ts >= {later[0]} then {later[1]} else least end)"
    hold, stall, freeze = 3600.0, 14_400.0, 60.0
    gate = "x.sup[i]"
    was = "(r.open[i] and not x.stalled)"
    quiet = f"case when {gate} >= {k / 4} then null else coalesce(r.quiet[i], x.ts) end"
    still_open = f"({gate} >= {k / 4} or not (x.ts - x.before > {hold} or x.ts - coalesce(r.quiet[i], x.ts) >= {hold}))"
    opened = each(f"case when {was} then {still_open} else {gate} >= {k / 2} end")
    quieted = each(f"case when {was} then {quiet} end")
    fresh = "case when r.occ or not (len(x.active) > 0 or list_bool_or(r.open)) then 0 else r.cand end"
    cand = f"case when len(x.active) > 0 then greatest({fresh}, x.comb) else {fresh} end"
    named = f"w as (select x.*, r.least, r.occ as was, r.deadline as due, r.until as thaw, {opened} as opened, {quieted} as quieted, {cand} as cand {NEXT})"
    judged = f"j as (select *, case when not was and len(active) > 0 and {floor} > 0 and cand < {floor} then 'rejected_energy_floor' end as rejection from w)"
    held = f"h as (select *, was and score < 1.5 and due is not null and ts >= due as ends from j)"
    after = f"case when was then not ends else score >= 3 and rejection is null end"
    due = f"case when not was or ends or score >= 1.5 then null else coalesce(due, ts + {hold}) end"
    go_on = f"select sensor, least, n, ts, true as ready, score, active, {after} as occ, {due} as deadline, case when ends then ts + {freeze} else thaw end as until, cand, opened as open, quieted as quiet, rejection from h"
    passing = "select x.sensor, r.least, x.n, x.ts, false, 0.0, [], x.device_occ, null, null, 0.0, r.open, r.quiet, null " + NEXT
    none = "[false, false, false, false, false, false, false, false, false]"
    nulls = "[null, null, null, null, null, null, null, null, null]::double[]"
    return (
        R + SQL_FRAMES,
        "a as materialized (select *, floor(ts / 3600)::bigint as b, row_number() over (partition by sensor order by ts, id) as n, lag(ts) over (partition by sensor order by ts, id) as before, lag(floor(ts / 3600)::bigint) over (partition by sensor order by ts, id) as pb from " + source + ")",
        "e1 as (select sensor, b, ch, list_concat(move, still)[ch] as v from a, (select unnest(range(1, 19)) as ch))",
        "e2 as (select sensor, b, ch, list(v::double) as vs from e1 group by all)",
        f"bl as (select sensor, b, ch, {quantile('vs', 0.5)} as m, greatest({quantile('vs', 0.9)} - {quantile('vs', 0.5)}, 0) as t from e2)",
        "kb as (select *, row_number() over (partition by sensor order by b) as j from (select distinct sensor, b, lead(b) over (partition by sensor order by b) as nb from (select distinct sensor, b from a)) where nb = b + 1)",
        "lw as (select kb.sensor, kb.j, bl.ch, list(m) over w as ms, list(t) over w as ts from kb join bl using (sensor, b) window w as (partition by kb.sensor, bl.ch order by kb.j rows between 23 preceding and current row))",
        f"lv as (select sensor, j, ch, {quantile('ms', 0.25)} as floor, greatest({quantile('ts', 0.25)}, 1.0) as spread from lw)",
        "la as materialized (select sensor, j, list(floor order by ch) as floors, list(spread order by ch) as spreads from lv group by all)",
        "c as materialized (select a.*, coalesce((select count(*) from kb where kb.sensor = a.sensor and kb.b < a.pb), 0) as done from a)",
        f"q as materialized (select c.*, done >= 5 as ready, {each('greatest(0, (move[i] - floors[i]) / spreads[i], (still[i] - floors[i + 9]) / spreads[i + 9])')} as peaks from c left join la on la.sensor = c.sensor and la.j = c.done)",
        step("s1", "select sensor, n, case when ready then peaks else list_transform(range(1, 10), lambda i: 0.0::double) end as sup from q where n = 1", f"select q.sensor, q.n, {each('s1.sup[i] + (1 - exp(-(q.ts - q.before) / 1200.0)) * (case when q.ready then q.peaks[i] else 0 end - s1.sup[i])')} from s1 join q on q.sensor = s1.sensor and q.n = s1.n + 1"),
        "u as (select q.sensor, q.n, g, q.peaks[g + 1] as v, s1.sup from q join s1 using (sensor, n), (select unnest(range(0, 9)) as g) where q.ready)",
        f"hot as (select *, g - row_number() over (partition by sensor, n order by g) as isl from u where v >= {k})",
        f"ru as (select sensor, n, isl, sum(v) / {k} as score, min(g) as lo, max(g) as hi, any_value(sup) as sup from hot group by sensor, n, isl)",
        f"be as (select * from ru where lo < hi or coalesce(sup[lo], 0) >= {k / 2} and lo > 0 or coalesce(sup[lo + 2], 0) >= {k / 2} qualify row_number() over (partition by sensor, n order by score desc, lo) = 1)",
        f"x as materialized (select q.sensor, q.n, q.ts, q.before, q.ready, q.device_occ, s1.sup, q.ts - q.before > {stall} and lag(q.ready) over (partition by q.sensor order by q.n) as stalled, coalesce(be.score, 0) as score, case when be.lo is null then [] else range(be.lo, be.hi + 1) end as active, list_max(list_transform(range(coalesce(be.lo, 0) + 1, coalesce(be.hi, -1) + 2), lambda i: (q.move[i] + q.still[i])::double)) as comb from q join s1 using (sensor, n) left join be using (sensor, n))",
        step(
            "r",
            f"select sensor, least, n, ts, ready, 0.0::double as score, []::bigint[] as active, device_occ as occ, null::double as deadline, null::double as until, 0.0::double as cand, {none} as open, {nulls} as quiet, null::varchar as rejection from x, (select unnest({[float(x) for x in floors]}) as least) where n = 1",
            f"select * from (with {named}, {judged}, {held} {go_on} where ready union all {passing} where not x.ready)",
        ),
        "o as (select *, occ as occupied, ready and (occ or coalesce(ts < until, false)) as frozen from r)",
    )


# -- research holds: floors of 30, spreads of 10, and a day of events for a second of frames ----------

SEVEN = "(select unnest(range(1, 8)) as g)"
#: Frames with the seven watched gates as lists, their residuals, balanced gates and the runs of frames without a gap.
WATCHED = (
    "y0 as materialized (select *, ts / 86400.0 as t, move[3:9] as m7, still[3:9] as s7, list_transform(range(1, 8), lambda i: greatest(still[i + 2] - 30, 0) / 10.0) as now, list_max(move[3:9])::double as top, list_filter(range(1, 8), lambda i: move[i + 2] >= 40 and move[i + 2] / greatest(move[i + 2] + still[i + 2], 1)::double >= 1 / 3.0) as bal, row_number() over (partition by sensor order by ts, id) as n from f)",
    "y1 as materialized (select *, coalesce(t - lag(t) over (partition by sensor order by n), 0) as gap from y0)",
    "y as materialized (select *, count(*) filter (where gap > 0.55) over (partition by sensor order by n) as seg, list_transform(range(1, 8), lambda i: now[i] * (m7[i] / greatest(top, 1))) as made from y1)",
)
NORM = "list_sum(list_transform({0}, lambda v: v * v))".format
DOT = "list_sum(list_transform(range(1, 8), lambda i: {0}[i] * {1}[i]))".format
FOUND = "y.top >= 40 and list_sum(list_transform(y.made, lambda v: v * v)) >= 1"


def anchored(may: str = "true", run: bool = False) -> tuple[str, ...]:
    """Table an: y with the template after each frame (null where it isn't anchored) and the score; may: what a first footprint needs besides."""
    def shown(source: str) -> str:
        score = f"coalesce({DOT('now', 'tmpl')} / {NORM('tmpl')}, 0)"
        return f"select sensor, n, case when score >= 0.4 then tmpl end as template, case when score >= 0.4 then score else 0 end as score, case when score >= 0.4 then 0 else run end as run from (select *, {score} as score from {source})"

    living = "(r.template is not null and y.gap <= 0.55)"
    counted = f"case when {living} or y.top < 40 then 0 when y.gap > 0.55 then 1 else r.run + 1 end" if run else "0"
    founded = f"case when {FOUND} and len(y.bal) > 0 and ({may}) then y.made end"
    first = shown(f"(select sensor, n, now, {founded} as tmpl, run from (select *, (top >= 40)::int as run from y where n = 1) as y)")
    grown = f"case when living then (case when {FOUND} and {NORM('y.made')} > {NORM('old')} then y.made else old end) else {founded} end"
    inner = f"(select y.sensor, y.n, y.now, {grown} as tmpl, run from (select y as y, r.template as old, {living} as living, {counted} as run from r join y on y.sensor = r.sensor and y.n = r.n + 1) as k(y, old, living, run))"
    return step("a", first, shown(inner).replace("from r join", "from a as r join")), "an as materialized (select y.*, a.template, a.score from y join a using (sensor, n))"


CONFIRMED = "y.top >= 80 and run >= 1 or y.top >= 60 and run >= 2 or y.top >= 40 and run >= 3"
CORROBORATED = (
    "w as (select sensor, n, len(list_distinct(flatten(list(bal) over (partition by sensor order by t range between 0.3 preceding and current row)))) as gates from y1)",
    "y as materialized (select y1.*, 0 as seg, list_transform(range(1, 8), lambda i: now[i] * (m7[i] / greatest(top, 1))) as made, w.gates from y1 join w using (sensor, n))",
)
SHOWN = "select id, template is not null as holding, round(score, 6) as value from an"


def guarded(confirmed: bool) -> tuple[tuple[str, ...], str]:
    if confirmed:
        return (R + SQL_FRAMES, *WATCHED, *anchored(CONFIRMED, True)), SHOWN
    return (R + SQL_FRAMES, *WATCHED[:2], *CORROBORATED, *anchored("y.gates >= 2")), SHOWN


def _fold(name_first: str, then: str) -> tuple[str, ...]:
    return (step("r", name_first, then),)


X = "from r join x on x.sensor = r.sensor and x.n = r.n + 1"


def footprint(form: str, on: float, off: float) -> tuple[tuple[str, ...], str]:
    """The first form: the ground is a slow mean that stands still while there is a footprint."""
    excess = "list_transform(range(1, 8), lambda i: greatest(s7[i] - ground[i], 0))"
    made = "list_transform(range(1, 8), lambda i: ex[i] * (m7[i] / greatest(top, 1)))"

    def rest(source: str) -> str:
        grown = f"case when top >= 40 and {NORM('made')} >= 1 and (ref is null or {NORM('made')} > {NORM('ref')}) then made else ref end"
        value = {"projection": f"{DOT('ex', 'ref2')} / {NORM('ref2')}", "shape": f"case when {NORM('ex')} > 0 then {DOT('ex', 'ref2')} / (sqrt({NORM('ex')}) * sqrt({NORM('ref2')})) else 0 end", "amplitude": f"sqrt({NORM('ex')}) / sqrt({NORM('ref2')})"}[form]
        active = f"value >= case when was then {off} else {on} end" if form == "projection" else f"sqrt({NORM('ex')}) >= 1 and value >= {on}"
        kept = "case when active then ref2 end" if form == "projection" else "ref2"
        ground = "list_transform(range(1, 8), lambda i: ground[i] + (1 - exp(-gap / 15.0)) * (s7[i] - ground[i]))"
        return (
            f"select sensor, n, id, case when ref3 is null then {ground} else ground end as ground, ref3 as ref, active, value from (select *, {kept} as ref3 from "
            f"(select *, ref2 is not null and ({active}) as active from (select *, coalesce({value}, 0) as value from (select *, {grown} as ref2 from (select *, {made} as made from (select *, {excess} as ex from {source}))))))"
        )

    first = rest("(select sensor, n, id, s7, m7, top, gap, list_transform(s7, lambda v: v::double) as ground, null::double[] as ref, false as was from x where n = 1)")
    then = rest(f"(select x.sensor, x.n, x.id, x.s7, x.m7, x.top, x.gap, case when x.gap > 0.55 then list_transform(x.s7, lambda v: v::double) else r.ground end as ground, case when x.gap <= 0.55 then r.ref end as ref, r.active as was {X})")
    return (R + SQL_FRAMES, *WATCHED, "x as materialized (select * from y)", step("r", first, then)), "select id, active as holding, round(value, 6) as value from r"


MASKED = "coalesce(list_sum(list_transform(range(1, 8), lambda i: case when {1}[i] then {0}[i] else 0 end)), 0)".format
STRONGEST = "list_transform({0}, lambda v: v >= 0.2 * list_max({0}))".format


def _band() -> tuple[tuple[str, ...], str]:
    wide = "list_transform(range(1, 8), lambda i: core[i] or coalesce(i > 1 and core[i - 1], false) or coalesce(core[i + 1], false))"
    x = f"x as materialized (select *, case when template is not null and len(bal) > 0 then {wide} end as fresh from (select *, {STRONGEST('template')} as core from an))"

    def rest(source: str) -> str:
        stays = "band is not null and share >= 0.4"
        begins = f"not ({stays}) and fresh is not null and {MASKED('now', 'fresh')} > 0"
        return f"select sensor, n, id, case when {stays} then band when {begins} then fresh end as band, case when {stays} then whole when {begins} then {MASKED('now', 'fresh')} end as whole, case when {stays} then share when {begins} then 1 else 0 end::double as value from (select *, {MASKED('now', 'band')} / whole as share from {source})"

    first = rest("(select *, null::boolean[] as band, null::double as whole from x where n = 1)")
    then = rest(f"(select x.*, case when x.gap <= 0.55 then r.band end as band, r.whole {X})")
    return (R + SQL_FRAMES, *WATCHED, *anchored(), x, step("r", first, then)), "select id, band is not null as holding, round(value, 6) as value from r"


BAND = _band()
#: The median of the frames half to two and a half seconds before, without a gap since.
BEFORE = (
    "b0 as (select an.sensor, an.n, g, quantile_cont(s7[g], 0.5) over (partition by an.sensor, seg, g order by t range between 2.5 preceding and 0.5 preceding) as base from an, " + SEVEN + ")",
    "b1 as (select sensor, n, list(base order by g) as base from b0 where base is not null group by all)",
    "x as materialized (select an.*, b1.base as base0 from an left join b1 using (sensor, n))",
)
GAIN = "list_transform(range(1, 8), lambda i: greatest(s7[i] - {0}[i], 0))".format


def _change() -> tuple[tuple[str, ...], str]:
    def rest(source: str) -> str:
        stays = "band is not null and share >= 0.4"
        begins = f"not ({stays}) and template is not null and len(bal) > 0 and base0 is not null and list_max({GAIN('base0')}) > 0"
        shown = f"case when {stays} then share when {begins} then 1 else coalesce(share, 0) end"
        return f"select sensor, n, id, case when {stays} then band when {begins} then {STRONGEST(GAIN('base0'))} end as band, case when {stays} then base when {begins} then base0 end as base, case when {stays} then whole when {begins} then {MASKED(GAIN('base0'), STRONGEST(GAIN('base0')))} end as whole, {shown}::double as value from (select *, {MASKED(GAIN('base'), 'band')} / whole as share from {source})"

    first = rest("(select *, null::boolean[] as band, null::double[] as base, null::double as whole from x where n = 1)")
    then = rest(f"(select x.*, case when x.gap <= 0.55 then r.band end as band, r.base, case when x.gap <= 0.55 then r.whole end as whole {X})")
    return (R + SQL_FRAMES, *WATCHED, *anchored(), *BEFORE, step("r", first, then)), "select id, band is not null as holding, round(value, 6) as value from r"


CHANGE = _change()


def _continuity() -> tuple[tuple[str, ...], str]:
    window = "v as materialized (select x.*, list(s7) over (partition by sensor, seg order by t range between 3 preceding and current row) as rows_ from x)"
    low = "list_transform(range(1, 8), lambda i: " + quantile("list_transform(rows_, lambda s: greatest(s[i] - base[i], 0)::double)", 0.2) + ")"

    def rest(source: str) -> str:
        begins = f"band is null and template is not null and len(bal) > 0 and base0 is not null and list_max({GAIN('base0')}) > 0"
        share = f"{MASKED('list_transform(range(1, 8), lambda i: least(low[i], gain[i]))', 'band')} / {MASKED('gain', 'band')}"
        return (
            f"select sensor, n, id, case when {begins} then {STRONGEST(GAIN('base0'))} else band end as band, case when {begins} then base0 else base end as base, case when {begins} then {GAIN('base0')} else gain end as gain, case when {begins} then t else began end as began, "
            f"case when {begins} then true when band is null then false when t - began < 3 then true else share >= 0.4 end as holding, case when band is null or t - began < 3 then 0 else share end::double as value from (select *, {share} as share from (select *, {low} as low from {source}))"
        )

    first = rest("(select *, null::boolean[] as band, null::double[] as base, null::double[] as gain, null::double as began from v where n = 1)")
    then = rest(f"(select x.*, case when x.gap <= 0.55 then r.band end as band, r.base, r.gain, r.began {X.replace('join x', 'join v as x')})")
    return (R + SQL_FRAMES, *WATCHED, *anchored(), *BEFORE, window, step("r", first, then)), "select id, holding, round(value, 6) as value from r"


CONTINUITY = _continuity()


def settled(begin: float, end: float, rows: int) -> tuple[tuple[str, ...], str]:
    middle = "list_transform(range(1, 8), lambda i: " + quantile("list_transform(training, lambda s: s[i]::double)", 0.5) + ")"

    def rest(source: str) -> str:
        gained = f"select *, {GAIN('base')} as gain, t - began as age from {source}"
        trained = f"select * replace (case when age >= {begin} and age < {end} then list_append(training, gain) else training end as training) from ({gained})"
        due = f"age >= {end} and shape is null and len(training) >= {rows}"
        taken = f"select * exclude (shape, training), case when {due} then (case when sqrt({NORM(middle)}) >= 1 then {middle} end) else shape end as shape, case when {due} then [] else training end as training from ({trained})"
        cosine = f"{DOT('gain', 'shape')} / greatest(sqrt({NORM('gain')}) * sqrt({NORM('shape')}), 1e-9)"
        ripe = f"began is not null and age >= {end} and shape is not null"
        begins = "began is null and template is not null and base0 is not null"
        return (
            f"select sensor, n, id, case when {begins} then t else began end as began, case when {begins} then base0 else base end as base, training, shape, "
            f"case when {ripe} then {cosine} >= 0.9 and sqrt({NORM('gain')}) >= 0.2 * sqrt({NORM('shape')}) else template is not null end as holding, case when {ripe} then {cosine} else 0 end::double as value from ({taken})"
        )

    first = rest("(select *, null::double as began, null::double[] as base, []::double[][] as training, null::double[] as shape from x where n = 1)")
    then = rest(f"(select x.*, case when x.gap <= 0.55 then r.began end as began, case when x.gap <= 0.55 then r.base end as base, case when x.gap <= 0.55 then r.training else [] end as training, case when x.gap <= 0.55 then r.shape end as shape {X})")
    before = tuple(c.replace("partition by an.sensor, seg, g", "partition by an.sensor, g") for c in BEFORE)  # the history outlives a gap
    return (R + SQL_FRAMES, *WATCHED, *anchored(), *before, step("r", first, then)), "select id, holding, round(value, 6) as value from r"


CENTRED = "list_transform(s7, lambda v: v - list_avg(s7))"
FLAT = (
    (
        R + SQL_FRAMES, *WATCHED, *anchored(),
        f"k0 as (select *, list_avg(list_transform({CENTRED}, lambda v: v * v)) as var, list_avg(list_transform({CENTRED}, lambda v: v * v * v * v)) as fourth from an)",
        "k1 as (select *, case when sqrt(var) > 1e-9 then fourth / (var * var) end as k from k0)",
        "k2 as (select *, list(k) over w as ks, min(t) over w as first_ from k1 where k is not null window w as (partition by sensor order by t range between 1 preceding and current row))",
    ),
    "select an.id, case when k2.k is null or an.t - first_ < 0.9 then an.template is not null else an.template is not null or list_median(ks) <= 1.8 end as holding, round(case when k2.k is null then 0 when an.t - first_ < 0.9 then k2.k else list_median(ks) end, 6) as value from an left join k2 using (sensor, n)",
)


def bank(contrast: bool, level: float, size: int, window: float) -> tuple[tuple[str, ...], str]:
    """Which prototypes there are doesn't depend on the reviews, so joins do; only the anchor is a recursion."""
    shape = f"p as materialized (select *, case when sqrt(var) > 1e-9 then list_transform(s7, lambda v: (v - list_avg(s7)) / sqrt(var)) else [0, 0, 0, 0, 0, 0, 0]::double[] end as prof, lag(template) over (partition by sensor order by n) as old from (select *, list_avg(list_transform({CENTRED}, lambda v: v * v)) as var from an))"
    before = (
        "e0 as (select p.sensor, p.n, g, median(prof[g]) over w as base, count(*) over w as k from p, " + SEVEN + " window w as (partition by p.sensor, g order by t range between 2.5 preceding and 0.3 preceding))",
        "e1 as (select sensor, n, list(base order by g) as base from e0 where k >= 3 group by all)",
    )
    changed = "c as (select p.sensor, p.n, p.t, " + ("e1.base from p join e1 using (sensor, n)" if contrast else "[0, 0, 0, 0, 0, 0, 0]::double[] as base from p") + " where template is not null and len(bal) > 0 and template is distinct from old)"
    entered = "d as materialized (select c.sensor, c.n as born, c.base, p.n as n from (select *, t + 2 as due from c) as c asof join (select sensor, t, n from p) as p on p.sensor = c.sensor and c.due <= p.t)"
    made = f"q0 as (select d.sensor, d.born, d.n, d.base, list_transform(range(1, 8), lambda i: p.prof[i] - d.base[i]) as change from d join p using (sensor, n))"
    kept = f"q as materialized (select *, row_number() over (partition by sensor order by born) as k from q0 where {NORM('change') if contrast else '1'} >= 0.05)"
    known = "h as materialized (select p.sensor, p.n, p.t, max(q.k) as k from p join q on q.sensor = p.sensor and q.n <= p.n group by all)"
    banked = f"b as materialized (select h.sensor, h.n, h.t, list({{'c': q.change, 'b': q.base}}) as bank from h join q on q.sensor = h.sensor and q.k between h.k - {size - 1} and h.k group by all)"
    like = "list_sum(list_transform(range(1, 8), lambda i: (p.prof[i] - z.b[i]) * z.c[i])) / " + (NORM("z.c") if contrast else "7")
    best = f"m as (select b.sensor, b.n, list_max(list_transform(bank, lambda z: {like})) as likeness from b join p on p.sensor = b.sensor and p.t <= b.t and p.t >= b.t - {window})"
    ctes = (shape, *(before if contrast else ()), changed, entered, made, kept, known, banked, best, "v as (select sensor, n, median(likeness) as value from m group by all)")
    return (R + SQL_FRAMES, *WATCHED, *anchored(), *ctes), f"select id, coalesce(value >= {level}, false) as holding, round(coalesce(value, 0), 6) as value from an left join v using (sensor, n)"

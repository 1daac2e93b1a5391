"""Every registered query against DuckDB where it has SQL, and against plain Python over the collected rows where not."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from gatelens.operators.automaton import Sensor
from gatelens.plans import catalog, q_folds
from gatelens.plans.config import Config, configured
from gatelens.plans.stages import ALL_STAGES
from gatelens.sources.tables import frames, samples

DAY = 86_400.0


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, oracle, rows, name):
    assert rows(catalog.QUERIES[name](spark, SMALL)) == oracle(catalog.SQL[name])


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """The events three times over with other keys: every time of a sensor has three frames."""
    import duckdb

    folder = tmp_path_factory.mktemp("tied")
    duckdb.sql(f"copy (select event_id + k * 10000000 as event_id, user_id + k * 1000003 as user_id, e.* exclude (event_id, user_id) from '{SMALL}/events.parquet' e, range(3) t(k)) to '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["rec23_entry_change_hold", "rec24_continuity_hold", "rec25_settled_shape_hold", "rec26_kurtosis_hold", "rec28_two_gate_anchor", "snk12_restored_states"])
def test_frames_of_one_time(spark, oracle, rows, tied, name):
    assert rows(catalog.QUERIES[name](spark, tied)) == oracle(catalog.SQL[name], tied)


@pytest.fixture(scope="module")
def by_sensor(spark):
    """The frames, by sensor and in order."""
    out = defaultdict(list)
    for r in sorted(frames(spark, SMALL).collect(), key=lambda r: (r.sensor, r.ts, r.id)):
        out[r.sensor].append(r)
    return out


@pytest.fixture(scope="module")
def sample_rows(spark):
    return sorted(samples(spark, SMALL).collect(), key=lambda r: (r.sensor, r.ts, r.id))


def got(spark, name):
    return catalog.QUERIES[name](spark, SMALL).collect()


def close(a, b):
    assert Counter(k for k, _ in a) == Counter(k for k, _ in b)
    for (k, x), (_, y) in zip(sorted(a, key=lambda r: r[0]), sorted(b, key=lambda r: r[0]), strict=True):
        assert x == pytest.approx(y, abs=1e-5), k


# -- the detector's other plans: each sensor stepped by itself ---------------------------------------


def stepped(by_sensor, settings, emit="states"):
    for name, rows in by_sensor.items():
        s, was = Sensor(configured(**{**q_folds.SCALED, **settings})), False
        for r in rows:
            state, closed = s.step(r.ts, r.ts, r.move, r.still, r.device_occ)
            if emit == "episodes":
                yield from ((name, e) for e in closed)
            elif emit == "states" or state["occupied"] != was:
                yield name, state
            was = state["occupied"]
        if emit == "episodes":
            yield from ((name, e) for e in s._close_all())


def test_plans_with_other_stages(spark, by_sensor):
    want = [((n, s["ts"]), (s["occupied"], s["anchored"], tuple(s["owned"]), round(s["retention_max"], 6))) for n, s in stepped(by_sensor, {"stages": ALL_STAGES})]
    assert sorted(((r.sensor, r.ts), (r.occupied, r.anchored, tuple(r.owned), round(r.retention_max, 6))) for r in got(spark, "pln_all_stages")) == sorted(want)
    want = [((n, s["ts"]), (s["occupied"], s["gate_classes"], s["boundary_gate"], s["anchored"])) for n, s in stepped(by_sensor, {})]
    assert sorted((((r.sensor, r.ts), (r.occupied, r.gate_classes, r.boundary_gate, r.anchored)) for r in got(spark, "pln_default_stages")), key=str) == sorted(want, key=str)
    stages = (*q_folds.SIMPLE[:-1], "motion_anchor", "in_room_gates", "nearest_gate_release", "changepoint_release")
    want = [(n, s["ts"], s["occupied"]) for n, s in stepped(by_sensor, {"stages": stages}, "transitions")]
    assert sorted(map(tuple, got(spark, "rel_releases"))) == sorted(want)


def test_gate_episodes_by_plain_islands(spark, by_sensor):
    """Gate episodes from nothing but the smoothed peaks: runs of a gate, each with its own sums."""
    result = [r for r in got(spark, "epi5_detector_episodes") if r.scope == "gate"]
    c = Config(stages=q_folds.SIMPLE, **{k: v for k, v in q_folds.SCALED.items() if k != "stages"})
    want = []
    for name, rows in by_sensor.items():
        s, support, was, open_ = Sensor(c), np.zeros(9), None, {}
        for r in rows:
            ready = s.baseline.ready
            if ready:
                residual = (np.array([*r.move, *r.still]) - s.baseline.floor) / s.baseline.spread
                peaks = np.maximum(0, np.maximum(residual[:9], residual[9:]))
                support = support + (1 - math.exp(-(r.ts - before) / c.support_tau_s)) * (peaks - support)
            before = r.ts
            state, _ = s.step(r.ts, r.ts, r.move, r.still, r.device_occ)
            if not ready:
                continue
            if was is not None and r.ts - was > c.episode_stall_s:
                want += [(name, e) for e in open_.values()]
                open_ = {}
            for g in range(9):
                e = open_.get(g)
                if e is None and support[g] >= c.k / 2:
                    e = open_[g] = {"gate": g, "t0": r.ts, "last": r.ts, "quiet": None, "peak": 0.0, "on": 0.0, "still": 0.0, "entered": False}
                if e is None:
                    continue
                gone, e["last"] = r.ts - e["last"], r.ts
                if support[g] >= c.k / 4:
                    e["quiet"], e["t1"] = None, r.ts
                    e["peak"] = max(e["peak"], peaks[g])
                    e["on"] += min(gone, c.hold_s)
                    e["still"] += min(gone, c.hold_s) if residual[9 + g] > residual[g] else 0
                    e["entered"] |= state["occupied"]
                else:
                    e["quiet"] = e["quiet"] or r.ts
                    if gone > c.hold_s or r.ts - e["quiet"] >= c.hold_s:
                        want.append((name, open_.pop(g)))
            was = r.ts
        want += [(name, e) for e in open_.values()]
    assert len(want) > 50
    close(
        [((r.sensor, r.gate, r.t0), (r.t1, r.peak, r.still_frac, r.active_frac, float(r.result == "entered"))) for r in result],
        [((n, e["gate"], e["t0"]), (e["t1"], e["peak"], e["still"] / e["on"] if e["on"] else 0, min(1, e["on"] / (e["t1"] - e["t0"])) if e["t1"] > e["t0"] else 1, float(e["entered"]))) for n, e in want],
    )


# -- folds ------------------------------------------------------------------------------------------


def test_arrival_bar_by_double_loops(spark, by_sensor):
    want = []
    for rows in by_sensor.values():
        weights, counts, bar, age, last, burst = [0.0] * 101, [0] * 101, None, 0.0, None, None
        for r in rows:
            t, move = r.ts / 60, r.move[2:]
            if last is not None and 0 < t - last <= 5:
                age += t - last
            last = t
            if burst and t - burst[1] > 1:
                weights = [w * math.exp(-age / (30 * 1440)) for w in weights]
                weights[burst[0]] += 1
                counts[burst[0]] += 1
                age, best, cut = 0.0, -1.0, None
                some = [v for v in range(101) if weights[v]]
                for low in some:  # a cut matters only where there is weight
                    for high in (v for v in some if low < v < some[-1]):
                        parts = [range(low + 1), range(low + 1, high + 1), range(high + 1, 101)]
                        value = sum(sum(weights[v] * v for v in p) ** 2 / sum(weights[v] for v in p) for p in parts)
                        if value > best + 1e-9:
                            best, cut = value, high
                if cut is not None and sum(counts[cut + 1 :]) >= 20:
                    bar = cut + 1.0
                burst = None
            if max(move) > 90:
                burst = (max(burst[0], max(move)) if burst else max(move), t)
        want.append((rows[0].sensor, bar, sum(counts)))
    end = {rows[-1].id: rows[0].sensor for rows in by_sensor.values()}
    assert sorted((end[r.id], r.bar, r.bursts) for r in got(spark, "rec7_arrival_bar") if r.id in end) == sorted(want) and any(b for _, b, _ in want)


def test_recurring_floor_from_scratch(spark, by_sensor):
    c, want = Config(bucket_s=3600.0, baseline_window_s=DAY), []
    for rows in by_sensor.values():
        floor, at = [0.0] * 9, -math.inf
        for n, r in enumerate(rows):
            if r.ts - at >= 7200:
                at, floor = r.ts, []
                seen = sum(min(max(b.ts - a.ts, 0), c.bucket_s) for a, b in zip(rows[: n + 1], rows[1 : n + 1], strict=False))
                rate = (n + 1) / max(seen, 1.0)  # the operator alone never closes a bucket
                for g in range(9):
                    values = sorted(x.still[g] for x in rows[: n + 1])
                    mass = Counter(v // 2 for v in values)
                    tops = [b for b in sorted(mass) if mass[b] > mass[b - 1] and mass[b] >= mass[b + 1] and mass[b] >= max(5 * 3600 * rate, 1)]
                    chosen = tops[0] if tops else min(mass, key=lambda b: (-mass[b], b))
                    floor.append(float(np.median([v for v in values if v // 2 == chosen])))
            want.append((r.id, float(np.mean(floor))))
    close([(r.id, r.floor) for r in got(spark, "rec10_recurring_refresh")], want)


def test_changepoints_by_a_plain_recursion(spark, by_sensor):
    from test_detector import plain_run_lengths

    name, rows = next(iter(by_sensor.items()))
    want = plain_run_lengths([r.still[2:] for r in rows[:90]], [30.0] * 7, [10.0] * 7, 0.1 / 120, 600, 20)
    first = {r.id: (m, -1 if ago is None else ago) for r, (m, ago) in zip(rows, want, strict=False)}
    result = {r.id: (r.short, r.ago) for r in got(spark, "rec15_changepoints") if r.id in first}
    assert all(result[k] == pytest.approx(first[k], abs=1e-9) for k in first)


def test_coupling_by_a_plain_loop(spark, by_sensor):
    from test_research import plain_coupling

    result = {r.id: r.coupling for r in got(spark, "win15_coupled_changes")}
    compared = 0
    for rows in by_sensor.values():
        for n in range(20, 110, 10):
            want = plain_coupling([(r.ts / DAY, [*r.move[2:], *r.still[2:]]) for r in rows[:n]], 1 / 24, 2.0, 1.0)
            assert result[rows[n - 1].id] == (None if want is None else pytest.approx(want, abs=1e-5))
            compared += want is not None
    assert compared > 20 and sum(v is not None for v in result.values()) > 300 and all(v is None or -1 <= v <= 1 for v in result.values())


def test_paths_turns_legs_and_marches(spark, sample_rows):
    cells = defaultdict(list)
    for r in sample_rows:
        if r.energy >= 50:
            cells[r.sensor, math.floor(r.ts / 3600)].append(r.gate)
    tracks, last = [], {}
    for (sensor, cell), g in sorted(cells.items()):
        if sensor not in last or cell - last[sensor] > 3:
            tracks.append((sensor, []))
        last[sensor] = cell
        tracks[-1][1].append((cell, sum(g) / len(g)))
    want = Counter()
    for sensor, path in tracks:
        # the zig-zag from its rule: an extreme is a turn once the path has come back by 0.9 from it
        turns, top, way = [0], 0, 0
        for i in range(1, len(path)):
            d = path[i][1] - path[top][1]
            if d and way in (0, math.copysign(1, d)):
                way, top = math.copysign(1, d), i
            elif abs(d) >= 0.9:
                turns.append(top)
                way, top = -way, i
        turns += [top] * (top != turns[-1])
        want.update((sensor, "turn", path[k][0], path[k][0], 0.0) for k in turns)
        for a, b in zip(turns, turns[1:], strict=False):
            (c0, x0), (c1, x1) = path[a], path[b]
            if abs(x1 - x0) >= 1.8 and c1 - c0 >= 2 and 0.075 <= abs(x1 - x0) / (c1 - c0) <= 1.5:
                want[sensor, "leg", c0, c1, round(x1 - x0, 6)] += 1
        i = 0
        while i < len(path):
            found = []
            for j in range(i + 2, min(len(path), i + 120)):
                move, total = path[j][1] - path[i][1], sum(abs(path[k + 1][1] - path[k][1]) for k in range(i, j))
                if abs(move) >= 1.8:
                    found.append((-move * move / total, j))
            if not found:
                i += 1
                continue
            best = min(found)
            j = next(j for w, j in found if w <= best[0] + 1e-12)
            want[sensor, "march", path[i][0], path[j][0], round(path[j][1] - path[i][1], 6)] += 1
            i = j
    result = Counter((r.sensor, r.kind, r.start, r.end, round(r.displacement, 6)) for r in got(spark, "rec19_30_marches"))
    assert result == want and {k for _, k, *_ in want} == {"turn", "leg", "march"}


# -- models a group ---------------------------------------------------------------------------------


def days(by_sensor):
    out = defaultdict(list)
    for name, rows in by_sensor.items():
        for r in rows:
            out[name, math.floor(r.ts / DAY)].append(r.move)
    return out


def test_group_models_by_plain_forms(spark, by_sensor):
    result = {(r.sensor, r.day): r for r in got(spark, "agg29_32_group_models")}
    groups = days(by_sensor)
    assert set(result) == set(groups)
    for key in sorted(groups)[:12]:
        x, r = groups[key], result[key]
        flat = [v for row in x for v in row]
        counts = Counter(flat)
        assert r.hist_mode == min(counts, key=lambda v: (-counts[v], v))
        density = [sum(n * math.exp(-((v - u) ** 2) / 8) for u, n in counts.items()) for v in range(101)]
        assert density[r.kde_mode] == pytest.approx(max(density))
        # two Gaussians by expectation and maximisation, value by value
        m, var, p = list(np.quantile(flat, (0.25, 0.75))), [max(float(np.var(flat)), 1e-3)] * 2, [0.5, 0.5]
        for _ in range(50):
            w = [[p[k] * math.exp(-((v - m[k]) ** 2) / (2 * var[k])) / math.sqrt(var[k]) for k in (0, 1)] for v in flat]
            w = [[a / (a + b), b / (a + b)] for a, b in w]
            n = [sum(q[k] for q in w) for k in (0, 1)]
            m = [sum(q[k] * v for q, v in zip(w, flat, strict=True)) / n[k] for k in (0, 1)]
            var = [max(sum(q[k] * (v - m[k]) ** 2 for q, v in zip(w, flat, strict=True)) / n[k], 1e-3) for k in (0, 1)]
            p = [a / len(flat) for a in n]
        assert r.mix_low == pytest.approx(min(m), abs=1e-4)
        # two factors are no worse than the best single one and no better than the best two without signs
        s = np.linalg.svd(np.array(x, float), compute_uv=False)
        assert (s[2:] ** 2).sum() - 1e-6 <= r.nmf_error <= (s[1:] ** 2).sum() * 1.2 + 1e-6
        assert 0 <= r.hmm_share <= 1


def test_envelopes_by_solving(spark, by_sensor):
    want = []
    for (sensor, day), rows in days(by_sensor).items():
        x, outside = np.array(rows, float), 0
        if len(x) >= 12:
            away = x - np.median(x, axis=0)
            cov = np.cov(x.T) + 1e-3 * np.eye(9)
            d = np.array([a @ np.linalg.solve(cov, a) for a in away])
            outside = int((d > 1.5 * np.quantile(d, 0.95)).sum())
        want.append((sensor, day, len(x), outside))
    assert sorted(map(tuple, got(spark, "agg30_envelopes"))) == sorted(want)


def test_ridge_score_ranks_by_pairs(spark, sample_rows):
    """The ridge solution by its normal equations, and the AUC by comparing every pair."""
    from gatelens.operators import stats

    s = samples(spark, SMALL).selectExpr("*", "floor(ts / 3600) % 24 as hour")
    names = ["energy", "gate", "hour"]
    w = stats.ridge(s, names, "chan")
    scored = defaultdict(lambda: ([], []))
    for r in stats.linear_score(s, names, w).select("sensor", "chan", "score").collect():
        scored[r.sensor][r.chan].append(r.score)
    result = {r.sensor: r for r in got(spark, "agg36_ridge_rank_score")}
    for sensor, (zero, one) in scored.items():
        auc = sum((b > a) + 0.5 * (b == a) for a in zero for b in one) / (len(zero) * len(one))
        assert next(v for k, v in result[sensor].asDict().items() if k not in ("sensor", "n0", "n1") and isinstance(v, float)) == pytest.approx(auc, abs=1e-6)
    assert len(result) == len(scored)


def test_episode_classifier_beats_the_majority(spark, sample_rows):
    result, want, last = got(spark, "spc12_episode_classifier"), Counter(), {}
    for r in sample_rows:
        if r.energy >= 40:
            key = r.sensor, r.gate
            if key not in last or r.ts - last[key][0] > 7200:
                last[key] = [r.ts, r.ts, last[key][2] + 1 if key in last else 1]
            last[key][0] = r.ts
            want[(*key, last[key][2])] = float(r.ts - last[key][1] >= 3600)
    assert {(r.sensor, r.gate, r.ep): r.label for r in result} == dict(want)
    right, share = sum(r.label == r.prediction for r in result), sum(r.label for r in result) / len(result)
    assert right / len(result) >= max(share, 1 - share)


def test_every_query_is_held_by_rows(spark):
    held = {"agg29_32_group_models", "agg30_envelopes", "agg36_ridge_rank_score", "epi5_detector_episodes", "pln_all_stages", "pln_default_stages", "rec10_recurring_refresh", "rec15_changepoints", "rec19_30_marches", "rec7_arrival_bar", "rel_releases", "spc12_episode_classifier", "win15_coupled_changes"}
    assert set(catalog.QUERIES) - set(catalog.SQL) == held


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_samples_scan_prunes_columns(spark):
    plan = catalog.QUERIES["agg2_rollup"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema:")[1].split("\n")[0]

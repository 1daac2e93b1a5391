"""Hand-worked vectors: rollups, scores, anchors, stages, the wire, recordings, sinks."""

import numpy as np
import pytest
from gatelens.functions import arrays as A
from gatelens.operators import buckets, decay, house, intervals, islands, learned, models, replay, snapshot
from gatelens.operators.automaton import Sensor
from gatelens.plans.config import Config, configured
from gatelens.plans.stages import ALL_STAGES, Stage, chosen, order
from gatelens.sources import recordings, sinks, wire
from pyspark.sql import functions as F


def samples(spark, rows):
    return spark.createDataFrame(rows, "id long, sensor string, ts double, gate int, chan int, energy int")


def test_rollup_quantiles(spark):
    df = samples(spark, [(i, "a", 60.0 + i, 0, 0, e) for i, e in enumerate((10, 20, 30, 40, 50))])
    r = buckets.rollup(df).collect()
    assert [(x.bucket, x.q50, x.q90, x.qmax, x.n) for x in r] == [(1, 30.0, 46.0, 50.0, 5)]


def test_buckets_close_only_in_sequence(spark):
    df = samples(spark, [(i, "a", t, 0, 0, 1) for i, t in enumerate((0.0, 61.0, 122.0, 300.0, 361.0))])
    assert [r.bucket for r in buckets.closed(df, 60.0).orderBy("bucket").collect()] == [0, 1, 5]


def test_mode_ties_go_low(spark):
    df = samples(spark, [(i, "a", float(i), 0, 0, e) for i, e in enumerate((7, 7, 3, 3, 9))])
    assert buckets.dominant_mode(buckets.histogram(df)).first().mode == 3


def test_timeline_score(spark):
    runs = spark.createDataFrame([("a", 100.0, 160.0), ("a", 400.0, 410.0)], "sensor string, start double, end double")
    spans = spark.createDataFrame([("x", "a", 90.0, 200.0), ("y", "a", 600.0, 700.0)], "name string, sensor string, start double, end double")
    r = intervals.timeline_score(runs, spans, 50.0, "sensor").first()
    assert (r.entries, r.false_entries, r.spans_detected, r.spans_missed, r.latency, r.overlap_s, r.false_s, r.missed_s) == (2, 1, 1, 1, 10.0, 60.0, 10.0, 150.0)


def test_open_run_ends_at_horizon(spark):
    df = spark.createDataFrame([(1, "a", 100.0, True), (2, "a", 200.0, True)], "id long, sensor string, ts double, occ boolean")
    assert [(r.start, r.end) for r in islands.occupied_runs(df, "occ", F.lit(300.0), "sensor").collect()] == [(100.0, 300.0)]


def test_burst_gap_is_inclusive_and_episode_gap_is_not(spark):
    df = samples(spark, [(i, "a", t, 3, 0, 50) for i, t in enumerate((0.0, 1.0, 2.5))])
    assert islands.bursts(df, 1.0, "energy", "sensor").count() == 2
    assert islands.episodes(df, "energy", 40, 20, 1.0, 10.0, "sensor").count() == 3
    assert islands.episodes(df, "energy", 40, 20, 1.6, 10.0, "sensor").count() == 1


def test_asof_takes_the_last_before(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 1.0)], "id long, sensor string, ts double")
    right = spark.createDataFrame([(9, "a", 2.0, 7), (8, "a", 5.0, 8)], "id long, sensor string, ts double, v int")
    got = {r.id: r.match for r in intervals.asof(left, right, "v", "sensor").collect()}
    assert got == {1: 8, 2: None}


def test_runs_on_arrays(spark):
    peak = [0.0, 4.0, 4.0, 0.0, 8.0, 0.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(peak,)], "p array<double>")
    run = lambda **k: tuple(df.select(A.best_run(F.col("p"), 3.0, **k).alias("r")).first().r)
    assert run() == (8.0 / 3, 1, 2)  # the nearest of equal runs
    assert run(neighbour=1.5) == (8.0 / 3, 1, 2)
    assert run(excluded=F.array(*(F.lit(i in (1, 2)) for i in range(9)))) == (8.0 / 3, 4, 4)


def test_blob_round_trip(spark):
    df = spark.createDataFrame([(bytearray(range(95, 104)),)], "b binary")
    assert df.select(A.bytes_to_gates(F.col("b")).alias("g")).first().g == list(range(95, 104))


def test_boundary(spark):
    rows = [("a", g, 0.95 if g <= 3 else 0.3) for g in range(9)]
    p = spark.createDataFrame(rows, "sensor string, gate int, level double")
    assert decay.boundary_gate(p, "level", 0.45, "sensor").first().boundary == 4


def frames(n, raised=range(0), start=1.7e9):
    for i in range(n):
        noise = [5 + ((i * 7 + g * 13) % 5 - 2) * 0.5 for g in range(9)]
        yield start + i * 0.1, [x + (40 if g in (3, 4, 5) and i in raised else 0) for g, x in enumerate(noise)], noise


CONFIG = Config(k=3.0, bucket_s=1.0, baseline_window_s=60.0, lead_gate_max=-1, stages=("quantile_floor", "tail_spread", "run_score", "lone_gate_suppression", "energy_floor", "score_hold"))


def test_detector_enters_on_the_first_strong_frame_and_leaves_after_the_hold():
    s, rows = Sensor(CONFIG), []
    for ts, move, still in frames(800, range(300, 320)):
        rows.append(s.step(ts, ts, move, still, False)[0])
    on = [i for i, r in enumerate(rows) if r["occupied"]]
    assert on[0] == 300 and rows[300]["active_gates"] == [3, 4, 5]
    assert 30.0 <= (on[-1] - 319) * 0.1 < 40.0
    assert rows[0]["confidence"] == 0.5 and not rows[0]["baseline_ready"]


def test_detector_is_causal():
    a, b = Sensor(CONFIG), Sensor(CONFIG)
    x = [a.step(t, t, m, s, False)[0] for t, m, s in frames(330, range(300, 320))]
    y = [b.step(t, t, m, s, False)[0] for t, m, s in frames(310, range(300, 320))]
    assert x[:310] == y


def test_clock_restart_restarts_the_hold():
    s = Sensor(CONFIG)
    for ts, move, still in frames(400, range(300, 320)):
        s.step(ts, ts, move, still, False)
    assert s.occupied
    ts += 0.1
    s.step(ts, 5.0, [5.0] * 9, [5.0] * 9, False)  # the other clock starts anew
    assert s.occupied and (s.deadline is None or s.deadline == 5.0 + CONFIG.hold_s)


def test_replay_agrees_with_a_plain_loop(spark):
    rows = [("a", i, t, m, s, False) for i, (t, m, s) in enumerate(frames(400, range(300, 320)))]
    df = spark.createDataFrame(rows, "sensor string, id long, ts double, move array<double>, still array<double>, device_occ boolean").repartition(3)
    got = [(r.ts, r.occupied, r.score) for r in replay.replay(df, CONFIG).orderBy("ts").collect()]
    s = Sensor(CONFIG)
    want = [s.step(t, t, m, st, False)[0] for t, m, st in frames(400, range(300, 320))]
    assert got == [(w["ts"], w["occupied"], w["score"]) for w in want]


def test_stages():
    assert [s.name for s in order(("tail_spread", "run_score", "lone_gate_suppression", "quantile_floor"))] == ["tail_spread", "lone_gate_suppression", "quantile_floor", "run_score"]
    loop = {n: Stage(n, r, requires=(o,)) for n, r, o in (("a", "floor", "b"), ("b", "spread", "a"))}
    with pytest.raises(ValueError, match="each other"):
        order(("a", "b"), loop)
    assert chosen(("histogram_floor", "quantile_floor"), "floor") == "histogram_floor"
    order(ALL_STAGES)
    for bad, word in ((("nonsense",), "nonsense"), (("run_score",), "floor"), (("quantile_floor", "tail_spread", "retention_hold"), "retention")):
        with pytest.raises(ValueError, match=word):
            order(bad)
    with pytest.raises(ValueError, match="hold_s"):
        configured(hold_s=-1.0)
    with pytest.raises(ValueError, match="unheard"):
        configured(unheard=1)


def test_wire_resynchronises():
    move, still = list(range(10, 19)), list(range(50, 59))
    one = wire.encode_report(3, 120, 88, 90, 77, 130, move, still, 66, 1)
    c = wire.Cutter()
    data = b"junk" + one[:7] + one[7:] + wire.REPORT + b"\xff\xff" + one + wire.command(0xFF)
    got = [p for i in range(0, len(data), 5) for p in c.feed(data[i : i + 5])]
    assert [k for k, _ in got] == ["report", "report", "reply"]
    r = wire.report(got[0][1])
    assert (r["status"], r["moving_cm"], r["still_cm"], r["distance_cm"], r["moving_energy"], r["still_energy"]) == (3, 120, 90, 130, 88, 77)
    assert (r["move"], r["still"], r["photo"], r["out"]) == (move, still, 66, 1)


def test_recordings(spark, tmp_path):
    path = str(tmp_path / "r.db")
    rows = [(s, float(t), float(t), range(9), range(9, 18), 100 + t, t % 2) for s in ("b", "a") for t in range(5)]
    recordings.write_recording(path, rows)
    got = recordings.read_recording(spark, path, start="1", end="4").orderBy("sensor", "ts").collect()
    assert [(r.sensor, r.ts) for r in got] == [(s, float(t)) for s in ("a", "b") for t in (1, 2, 3)]
    assert got[0].move == list(range(9)) and got[0].still == list(range(9, 18))
    assert recordings.schema_version(path) == 4
    old = str(tmp_path / "old.db")
    recordings.write_recording(old, [], version=1)
    with pytest.raises(ValueError, match="older"):
        recordings.schema_version(old)
    assert "leading_gate" in recordings.migrated(spark.range(1)).columns


def test_rollup_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "rollup")
    df = samples(spark, [(i, "a", 86_400.0 * (i % 3) + i, 0, 0, i) for i in range(30)])
    for _ in range(2):
        sinks.write_rollup(buckets.rollup(df), path)
    assert spark.read.parquet(path).count() == buckets.rollup(df).count()
    assert sinks.prune_days(spark, path, "1970-01-02") == ["1970-01-01"]


def test_models():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(6, 1, 200)])
    post, path = models.two_state_hmm(x)
    assert path[:180].mean() < 0.05 and path[220:].mean() > 0.95 and post[300] > 0.9
    assert abs(models.two_mixture_low(x)) < 0.5
    w, h, error = models.nmf(np.outer([1.0, 2, 3], [1.0, 1, 2]), 1)
    assert error < 1e-3
    assert models.greedy_pairs([(50.0, 0.0), (20.0, 1.0)], [(22.0, 0.0), (90.0, 0.0), (48.0, 0.0)]) == [(1, 0), (0, 2)]
    assert models.suppressed_peaks(np.array([0.0, 1.0, 5.0]), np.array([1.0, 2.0, 1.0])) == [1, 2]
    assert models.turning_points(np.array([0.0, 2, 4, 2, 0, 3])) == [0, 2, 4, 5]


def test_saved_state_does_not_grow_with_the_open_bucket():
    sizes, rng = [], np.random.default_rng(1)
    for n in (50, 500):
        s = Sensor(CONFIG)
        for k in range(n):
            s.step(k * CONFIG.bucket_s / 1000, k * CONFIG.bucket_s / 1000, rng.integers(0, 101, 9), rng.integers(0, 101, 9), False)
        sizes.append(len(snapshot.save(s)))
    assert sizes[1] < sizes[0] + 200


def test_parts_that_were_not_used_are_saved_as_they_came():
    s = Sensor(CONFIG)
    s.nearest.median[:], s.arming.quiet, s.bar.age = 7.0, True, 3.5
    for _ in range(3):
        s = snapshot.restore(snapshot.save(s), CONFIG)
    assert set(s.kept) == set(Sensor.PARTS) and "nearest" not in vars(s)
    assert (s.nearest.median == 7.0).all() and s.arming.quiet and s.bar.age == 3.5 and "nearest" in vars(s)
    s.nearest.median[0] = 8.0
    assert snapshot.restore(snapshot.save(s), CONFIG).nearest.median[0] == 8.0
    with pytest.raises(AttributeError, match="nothing"):
        _ = s.nothing


def test_open_bucket_keeps_energies_that_are_not_whole():
    from gatelens.operators.automaton import GATES, Baseline, quantile

    rng, b = np.random.default_rng(2), Baseline(CONFIG)
    rows = np.concatenate([rng.integers(0, 101, (40, 2 * GATES)).astype(float), rng.uniform(-5, 140, (25, 2 * GATES))])
    for r in rows:
        b.add(0.0, r)
    b.add(CONFIG.bucket_s, rows[0])
    middle = quantile(rows, 0.5)
    assert (b.levels[0][: 2 * GATES] == middle).all() and (b.levels[0][2 * GATES : -1] == np.maximum(quantile(rows, 0.9) - middle, 0)).all()
    assert b.ceiling == quantile(rows[:, :GATES].max(axis=1)[:, None], 0.9)[0]


def test_snapshot_goes_on_where_it_was():
    whole, first = Sensor(CONFIG), Sensor(CONFIG)
    want = [whole.step(t, t, m, s, False)[0] for t, m, s in frames(400, range(300, 320))]
    rows = list(frames(400, range(300, 320)))
    for t, m, s in rows[:310]:
        first.step(t, t, m, s, False)
    second = snapshot.restore(snapshot.save(first), CONFIG)
    assert [second.step(t, t, m, s, False)[0] for t, m, s in rows[310:]] == want[310:]
    other = snapshot.restore(snapshot.save(first), configured(CONFIG, baseline_window_s=120.0))
    assert not other.baseline.ready  # another window: learned anew
    assert snapshot.reconfigured(second, configured(CONFIG, enter_score=9.0)).baseline.ready


def test_three_classes():
    w = np.zeros(101)
    w[[5, 6, 40, 41, 90, 91]] = 10
    low, high = learned.three_classes(w)
    assert 6 <= low < 40 and 41 <= high < 90


def test_arrival_bar_needs_enough_bursts():
    bar = learned.ArrivalBar(1e9)
    got = None
    for i in range(90):
        move = np.zeros(9)
        move[4] = (20, 50, 90)[i % 3]
        bar.observe(i * 10.0, move, np.full(9, 10.0))
        got = bar.observe(i * 10.0 + 5.0, np.zeros(9), np.full(9, 10.0))
    assert 50 < got <= 90


def test_classes_follow_evidence():
    g = learned.GateClasses(configured(stages=ALL_STAGES))
    e = lambda gate, t0, t1: {"scope": "gate", "gate": gate, "t0": t0, "t1": t1, "active_frac": 1.0, "raw": np.full(9, 50.0)}
    g.closed(e(3, 0.0, 100.0))
    for i in range(8):
        t = 1000.0 * (i + 1)
        g.closed(e(1, t, t + 5))
        g.closed(e(4, t + 7, t + 100))
        g.tick(t + 200, {})
    assert g.kind[1] == "portal" and g.kind[4] == "in_room" and g.kind[8] == "unknown"


def test_boundary_is_confirmed_by_three_evaluations():
    g = learned.GateClasses(Config())
    for day in range(4):
        for k in range(12):
            for gate in range(9):
                t = day * 86_400.0 + k * 7000.0 + gate
                g.closed({"scope": "gate", "gate": gate, "t0": t - 5, "t1": t, "active_frac": 1.0, "raw": np.full(9, 90.0 if gate <= 3 else 22.0)})
        g.tick((day + 1) * 86_400.0, {8: 0.0} if day < 3 else {})
        assert (g.boundary is None) == (day < 3)  # on the third day a gate beyond it is open: it waits
    assert g.boundary == 3


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    got = house.reachable(edges, spark.createDataFrame([("a",)], "node string"))
    assert {(r.node, r.hops) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_greedy_operators_do_not_stop_at_midnight(spark, monkeypatch):
    from gatelens.plans import q_folds, q_research

    def given(rows):
        df = spark.createDataFrame([("a", 86_400.0 + t, k, e, g, c) for k, (t, e, g, c) in enumerate(rows)], "sensor string, ts double, id long, energy int, gate int, chan int")
        for module in (q_folds, q_research):
            monkeypatch.setattr(module, "samples", lambda *_: df)

    given([(-1200.0, 10, 0, 0), (-600.0, 50, 0, 0), (-300.0, 10, 0, 0), (600.0, 60, 0, 0), (900.0, 10, 0, 0)])
    assert [r.id for r in q_research.win22(spark, "").collect()] == [3]
    given([(-60.0, 50, 1, 0), (60.0, 52, 1, 1)])
    assert [tuple(r) for r in q_folds.jon15(spark, "").collect()] == [(0, 1)]
    given([(3600.0 * k, 60, g, 0) for k, g in ((-2, 1), (-1, 2), (0, 3), (1, 4), (5, 5), (6, 6))])
    got = {(r.kind, r.start - 24, r.end - 24) for r in q_folds.marches(spark, "").collect()}
    assert got == {("turn", -2, -2), ("turn", 1, 1), ("leg", -2, 1), ("march", -2, 1), ("turn", 5, 5), ("turn", 6, 6)}


def test_fast_greedy_steps_equal_plain_ones():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = ([(float(x), float(t)) for x, t in rng.integers(0, (60, 5), (n, 2))] for n in rng.integers(0, 30, 2))
        used, want = set(), []
        for i in sorted(range(len(a)), key=lambda k: a[k]):
            near = min((j for j in range(len(b)) if j not in used and abs(b[j][0] - a[i][0]) <= max(5.0, 0.2 * a[i][0])), key=lambda j: (abs(b[j][0] - a[i][0]), b[j]), default=None)
            if near is not None:
                used.add(near)
                want.append((i, near))
        assert models.greedy_pairs(a, b) == want
        times, heights, taken = rng.integers(0, 99, 30).astype(float), rng.integers(0, 9, 30).astype(float), []
        for k in np.lexsort((times, -heights)):
            if all(abs(times[k] - times[j]) >= 4 for j in taken):
                taken.append(int(k))
        assert models.suppressed_peaks(times, heights, 4) == sorted(taken)

"""Research holds and estimators on hand-made streams, and against plain loops."""

import math
import random

import numpy as np
import pytest
from gatelens.operators import research as X

FLOOR, SPREAD = np.full(9, 10.0), np.full(9, 2.0)
QUIET, SEATED, OTHER = (np.array(x, float) for x in ([10] * 9, [10, 10, 12, 40, 60, 40, 12, 10, 10], [10, 10, 50, 12, 10, 10, 12, 40, 50]))
STILL, WALK = np.zeros(9), np.array([0, 0, 0, 70, 70, 70, 0, 0, 0], float)


def play(h, *parts, step=0.1):
    """parts: (seconds, move, still); the results of every frame."""
    ts, out = getattr(h, "now", 0.0), []
    for seconds, move, still in parts:
        for _ in range(round(seconds / step)):
            ts = round(ts + step, 6)
            out.append(h.step(ts, move, still))
    h.now = ts
    return out


def test_footprint_comes_on_and_stays_by_two_levels():
    f = X.Footprint("projection", 0.6, 0.3)
    assert not any(h for h, _ in play(f, (2, STILL, QUIET), (2, STILL, SEATED * 0 + 12)))
    out = play(f, (0.1, WALK, SEATED), (3, STILL, SEATED))
    assert all(h for h, _ in out) and out[0][1] == pytest.approx(1.0)
    ground = f.ground.copy()
    half = QUIET + 0.45 * (SEATED - QUIET)
    assert all(h for h, _ in play(f, (2, STILL, half)))  # under the level to come on, over the one to stay
    assert (f.ground == ground).all()  # the mean stands still meanwhile
    out = play(f, (3, STILL, QUIET + 0.2 * (SEATED - QUIET)))
    assert not any(h for h, _ in out) and f.ref is None
    f.step(f.now + 1.0, STILL, SEATED)  # a gap: whatever is there is the ground
    assert (f.ground == SEATED[2:]).all()


def test_footprint_forms_by_hand():
    shape, size = X.Footprint("shape", 0.75), X.Footprint("amplitude", 0.4)
    for f in (shape, size):
        play(f, (1, STILL, QUIET), (0.1, WALK, SEATED))
    ref = (SEATED - QUIET)[2:] * (WALK[2:] / 70)
    now = (SEATED - QUIET)[2:] * 0.5
    assert play(shape, (0.1, STILL, QUIET + 0.5 * (SEATED - QUIET)))[0] == (True, pytest.approx(now @ ref / np.linalg.norm(now) / np.linalg.norm(ref)))
    assert play(size, (0.1, STILL, QUIET + 0.5 * (SEATED - QUIET)))[0] == (True, pytest.approx(np.linalg.norm(now) / np.linalg.norm(ref)))
    assert not play(shape, (0.1, STILL, OTHER))[0][0] and shape.ref is not None and play(shape, (0.1, STILL, SEATED))[0][0]
    assert not play(size, (0.1, STILL, QUIET))[0][0] and play(size, (0.1, STILL, OTHER))[0][0]
    with pytest.raises(ValueError, match="nothing"):
        X.Footprint("nothing")


def test_weak_motion_is_confirmed_by_more_frames():
    for strength, need in ((85, 1), (65, 2), (45, 3)):
        h = X.Hold(FLOOR, SPREAD, X.GuardedAnchor(confirmed=True))
        out = [a for a, _ in play(h, (0.5, np.where(WALK > 0, strength, 0), SEATED))]
        assert out.index(True) == need - 1
        assert all(a for a, _ in play(h, (1, STILL, SEATED)))  # once there, it stays as any anchor
    h = X.Hold(FLOOR, SPREAD, X.GuardedAnchor(confirmed=True))
    weak = np.where(WALK > 0, 45, 0)
    assert not any(a for _ in range(5) for a, _ in play(h, (0.2, weak, SEATED), (0.1, STILL, SEATED)))


def test_two_gates_within_a_moment_found_an_anchor():
    one = lambda g: np.where(np.arange(9) == g, 70.0, 0.0)
    make = lambda: X.Hold(FLOOR, SPREAD, X.GuardedAnchor(gates=2))
    assert not any(a for a, _ in play(make(), (2, one(4), SEATED)))
    assert [a for a, _ in play(make(), (0.1, one(3), SEATED), (0.1, STILL, SEATED), (0.1, one(4), SEATED))] == [False, False, True]
    assert not any(a for a, _ in play(make(), (0.1, one(3), SEATED), (0.4, STILL, SEATED), (0.1, one(4), SEATED)))


def test_band_allows_drift_by_a_gate():
    h = X.BandHold(FLOOR, SPREAD)
    assert not any(a for a, _ in play(h, (1, STILL, SEATED)))  # stillness alone founds nothing
    assert all(a for a, _ in play(h, (0.1, WALK, SEATED), (2, STILL, np.roll(SEATED, 1))))
    whole = (SEATED - QUIET)[2:].sum() / 2 - 0  # gates three to five and one more on either side: all but the last two
    assert h.whole == pytest.approx((SEATED - QUIET)[2:7].sum() / 2) and whole >= h.whole
    assert play(h, (0.1, STILL, QUIET + 0.5 * (SEATED - QUIET)))[0][1] == pytest.approx(0.5)
    assert not any(a for a, _ in play(h, (1, STILL, OTHER)))


def test_change_is_measured_against_just_before_the_entry():
    room = np.array([10, 10, 30, 10, 10, 10, 10, 30, 30], float)  # a steady source that isn't the person
    h = X.ChangeHold(FLOOR, SPREAD)
    play(h, (3, STILL, room))
    out = play(h, (0.1, WALK, np.maximum(room, SEATED)), (2, STILL, np.maximum(room, SEATED)))
    assert all(a for a, _ in out) and (h.base == room[2:]).all() and h.whole == (30 + 50 + 30)
    out = play(h, (0.1, STILL, room + 0.45 * (np.maximum(room, SEATED) - room)), (0.1, STILL, room))
    assert out[0] == (True, pytest.approx(0.45)) and out[1] == (False, 0.0)
    late = X.ChangeHold(FLOOR, SPREAD)
    assert not any(a for a, _ in play(late, (0.3, WALK, SEATED)))  # nothing is known from before


def test_continuity_takes_a_low_percentile():
    h = X.ContinuityHold(FLOOR, SPREAD)
    play(h, (3, STILL, QUIET), (0.1, WALK, SEATED))
    assert all(a for a, _ in play(h, (2.8, STILL, QUIET)))  # the first seconds hold by themselves
    assert not play(h, (1, STILL, QUIET))[-1][0]
    assert play(h, (3.5, STILL, SEATED))[-1] == (True, pytest.approx(1.0))  # and it comes back
    flicker = X.ContinuityHold(FLOOR, SPREAD)
    play(flicker, (3, STILL, QUIET), (0.1, WALK, SEATED))
    for _ in range(12):
        last = play(flicker, (0.2, STILL, SEATED), (0.2, STILL, QUIET))[-1]
    assert not last[0]  # half of the time isn't continuous


def test_settled_shape_takes_over_after_a_minute():
    h = X.SettledHold(FLOOR, SPREAD)
    play(h, (3, STILL, QUIET), (0.1, WALK, SEATED), (59, STILL, SEATED))
    assert h.settled is None and h.began is not None
    out = play(h, (3, STILL, SEATED))
    assert all(a for a, _ in out) and np.allclose(h.settled, (SEATED - QUIET)[2:]) and out[-1][1] == pytest.approx(1.0)
    assert play(h, (0.1, STILL, QUIET + 0.25 * (SEATED - QUIET)))[0][0] and not play(h, (0.1, STILL, QUIET + 0.15 * (SEATED - QUIET)))[0][0]
    assert not play(h, (0.1, STILL, OTHER))[0][0] and play(h, (0.1, STILL, SEATED))[0][0]


def test_kurtosis_by_hand_and_over_a_window():
    x = np.array([1, 2, 3, 4, 5, 6, 7], float)
    assert X.kurtosis(x) == pytest.approx(sum((v - 4) ** 4 for v in x) / 7 / 4**2) and X.kurtosis(x * 0) is None
    spike = np.where(np.arange(9) == 4, 60.0, 10.0)
    flat = np.array([10, 10, 10, 20, 30, 40, 30, 20, 10], float)
    h = X.KurtosisHold(FLOOR, SPREAD, 3.0)
    assert play(h, (0.1, STILL, flat))[0][0] and not play(h, (0.1, STILL, spike))[0][0] and not play(h, (0.1, STILL, QUIET))[0][0]
    h = X.KurtosisHold(FLOOR, SPREAD, 3.0, 1.0)
    out = [a for a, _ in play(h, (1.5, STILL, flat))]
    assert out.index(True) == 9 and all(out[9:])
    out = [a for a, _ in play(h, (1.0, STILL, spike))]
    assert out[0] and not out[-1] and out == sorted(out, reverse=True)


def test_bank_keeps_the_shape_two_seconds_later():
    h = X.ShapeBank(FLOOR, SPREAD, 0.9, 4, 3.0)
    play(h, (3, STILL, QUIET), (0.1, WALK, SEATED))
    assert not h.bank and len(h.pending) == 1
    play(h, (1.8, STILL, SEATED))
    assert not h.bank
    assert play(h, (5, STILL, SEATED))[-1] == (True, pytest.approx(1.0)) and len(h.bank) == 1
    assert np.allclose(h.bank[0][1], X.standard(SEATED[2:]))
    out = play(h, (5, STILL, OTHER))
    assert not out[-1][0] and out[-1][1] == pytest.approx(np.corrcoef(OTHER[2:], SEATED[2:])[0, 1])
    assert out[5][0]  # most of the window still looks like the person


def test_contrast_asks_for_the_change_that_motion_brought():
    room = np.array([10, 10, 50, 10, 10, 10, 10, 10, 30], float)
    both = np.maximum(room, SEATED)
    h = X.ShapeBank(FLOOR, SPREAD, 0.5, 4, 3.0, True)
    play(h, (3, STILL, room), (0.1, WALK, both), (4, STILL, both))
    assert len(h.bank) == 1 and play(h, (4, STILL, both))[-1] == (True, pytest.approx(1.0))
    assert play(h, (4, STILL, room))[-1] == (False, pytest.approx(0.0))


def plain_coupling(rows, grid, horizon, tau):
    """All grid points first, then sums point by point, for the last one."""
    start, end, points, q, n = rows[0][0], rows[-1][0], [], rows[0][0], 0
    while q <= end + 1e-9:
        k = next((k for k in range(1, len(rows)) if rows[k - 1][0] <= q + 1e-12 <= rows[k][0] + 1e-9 and rows[k][0] - rows[k - 1][0] <= 0.55), None)
        if k is None:
            points.append(None)
        else:
            (a, x), (b, y) = rows[k - 1], rows[k]
            points.append([u + (v - u) * (q - a) / (b - a) for u, v in zip(x, y, strict=True)])
        n += 1
        q = start + n * grid
    last, most = len(points) - 1, round(horizon / grid)
    if last < most or points[last] is None or points[last - 1] is None:
        return None
    idx = [i for i in range(max(1, last - most), last + 1) if points[i] is not None and points[i - 1] is not None]
    if len(idx) < 10:
        return None
    out = []
    for g in range(7):
        w = [math.exp(-(last - i) * grid / tau) for i in idx]
        a, b = ([points[i][c] - points[i - 1][c] for i in idx] for c in (g, g + 7))
        mean = lambda v: sum(x * y for x, y in zip(w, v, strict=True)) / sum(w)  # noqa: E731, B023
        sa, sb = (math.sqrt(mean([(x - mean(v)) ** 2 for x in v])) for v in (a, b))
        if sa >= 0.5 and sb >= 0.5:
            out.append(mean([(x - mean(a)) * (y - mean(b)) for x, y in zip(a, b, strict=True)]) / (sa * sb))
    return float(np.median(out)) if out else None


def test_coupling_equals_a_plain_loop():
    r = random.Random(3)
    c, rows, ts, values = X.CoupledChanges(0.1, 2.0, 1.0), [], 0.0, 0
    for k in range(120):
        ts = round(ts + (0.9 if k == 60 else r.choice((0.05, 0.1, 0.13))), 6) if k else 0.0
        move = np.array([r.uniform(0, 30) for _ in range(9)])
        still = move * 0.5 + np.array([r.uniform(0, 20) for _ in range(9)])
        rows.append((ts, [*move[2:], *still[2:]]))
        got, want = c.step(ts, move, still), plain_coupling(rows, 0.1, 2.0, 1.0) if k else None
        assert (got is None) == (want is None) and (got is None or got == pytest.approx(want, abs=1e-9)), k
        values += got is not None
    assert values > 40


# -- long windows: many frames in each, held against loops over all of them ---------------------------


def crowded(n, step, seed=5):
    """Frames of few distinct profiles, some of equal times; one gap."""
    r, ts, out = random.Random(seed), 0.0, []
    for k in range(n):
        ts += 1.0 if k == n // 2 else r.choice((0.0, step, step))
        c = r.randrange(101)
        out.append((ts, np.array([(c * 7 + 13 * i) % 101 for i in range(9)], float), np.array([(3 * c + 11 * i) % 101 for i in range(9)], float)))
    return out


def grouped(h, stream):
    """A hold's results where frames of equal times come together."""
    out, k = [], 0
    while k < len(stream):
        same = [x for x in stream[k : k + 50] if x[0] == stream[k][0]]
        out += h.steps(same[0][0], [x[1:] for x in same])
        k += len(same)
    return out


HOLDS = {
    "rec23": lambda: X.ChangeHold(FLOOR, SPREAD),
    "rec24": lambda: X.ContinuityHold(FLOOR, SPREAD),
    "rec25": lambda: X.SettledHold(FLOOR, SPREAD, rows=3, settling=(3.0, 6.0)),
    "win13": lambda: X.ShapeBank(FLOOR, SPREAD, 0.5, 4, 3.0),
    "rec27": lambda: X.ShapeBank(FLOOR, SPREAD, 0.2, 4, 3.0, True),
    "rec26": lambda: X.KurtosisHold(FLOOR, SPREAD, 1.8, 1.0),
    "rec28": lambda: X.Hold(FLOOR, SPREAD, X.GuardedAnchor(gates=2)),
}


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_a_frame_costs_no_more_where_windows_hold_more(name):
    """Function calls and places of distinct profiles, not seconds: the same for ten times the frames a second."""
    import cProfile
    import pstats

    def cost(n, step):
        h, stream, p = HOLDS[name](), crowded(n, step), cProfile.Profile()
        stream = [(t - 1.0 if k >= n // 2 else t, *x) for k, (t, *x) in enumerate(stream)]
        grouped(h, stream[: n - 300])
        p.enable()
        grouped(h, stream[n - 300 :])
        p.disable()
        return pstats.Stats(p).total_calls, h

    few, _ = cost(1500, 0.01)
    many, h = cost(15000, 0.001)
    assert many < 1.5 * few
    for w in (h.entry, getattr(h, "lately", h.entry), getattr(h, "review", h.entry)):
        assert len(w.profiles) <= 101 + X.Profiles.EMPTY and (w.profiles.n == 0 or w.profiles.n == len(w.inside))


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_loops_over_their_frames(seed):
    r, w, frames, ts = random.Random(seed), X.Window(2.5, 0.5), [], 0.0
    for k in range(600):
        ts = ts - 0.7 if k == 400 else ts + r.choice((0.0, 0.01, 0.05))
        x = np.array([r.randrange(5 if seed else 90) for _ in range(3)], float)
        frames.append((ts, x))
        w.add(ts, x.tobytes(), x)
        got, want = w.move(ts), [x for t, x in frames if ts - 2.5 <= t <= ts - 0.5]
        if k < 400:
            assert got.n == len(want) and (not want or (got.median() == np.median(want, axis=0)).all())
    assert got.n and ts > 2.5


def test_continuity_percentile_equals_a_loop():
    h, stream = X.ContinuityHold(FLOOR, SPREAD), crowded(900, 0.01)
    results, seen = grouped(h, stream), 0
    for k in (500, 700, 899):
        h = X.ContinuityHold(FLOOR, SPREAD)
        grouped(h, stream[: k + 1])
        if h.band is not None:
            since = stream[450][0] if k >= 450 else 0.0
            rows = np.array([s[2:] for t, _, s in stream[: k + 1] if max(since, stream[k][0] - 3.0) <= t])
            assert h.low(stream[k][0]) == pytest.approx(np.quantile(np.maximum(rows - h.base, 0.0), 0.2, axis=0))
            seen += 1
    assert seen and len(results) == len(stream)


def test_two_gates_counts_equal_a_loop():
    g, stream = X.GuardedAnchor(gates=2), crowded(400, 0.01)
    for k, (ts, m, s) in enumerate(stream):
        g.observe(ts, m, s, FLOOR, SPREAD)
        lit = np.sum([X.balanced(a, b) for t, a, b in stream[: k + 1] if t >= ts - 0.3], axis=0)
        assert (g.lit == lit).all()


# -- many times at once: the same as frame by frame ---------------------------------------------------

BLOCKS = ("rec25", "rec27", "win13")


def blocks(h, stream, size):
    """A hold's results where it takes blocks of about that many frames; a time's frames are in one block."""
    out, a = [], 0
    while a < len(stream):
        b = min(a + size, len(stream))
        while b < len(stream) and stream[b][0] == stream[b - 1][0]:
            b += 1
        holding, value = h.many(*(np.array(x) for x in zip(*stream[a:b], strict=True)))
        out += zip(holding.tolist(), value.tolist(), strict=True)
        a = b
    return out


def assert_same(got, want):
    assert len(got) == len(want) and [h for h, _ in got] == [h for h, _ in want]
    assert [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-9, nan_ok=True)


@pytest.mark.parametrize("size", (1, 37, 400, 5000))
@pytest.mark.parametrize("name", BLOCKS)
def test_blocks_equal_frames(name, size):
    for stream in (crowded(2500, 0.01), crowded(900, 0.2, 7)):
        one, many = HOLDS[name](), HOLDS[name]()
        want = grouped(one, stream)
        assert_same(blocks(many, stream, size), want)
        assert any(h for h, _ in want) and any(v for _, v in want) and many.crowd is not None
        assert len(many.crowd.ts) <= size + 3 * 200 + 50


@pytest.mark.parametrize("name", BLOCKS)
def test_blocks_equal_frames_of_unlike_profiles_and_with_odd_ones(name, monkeypatch):
    r = np.random.default_rng(3)
    stream = [(0.02 * (k // 2) + (k > 500) * 0.8, r.integers(0, 101, 9) * 1.0, r.uniform(0, 100, 9)) for k in range(1200)]
    monkeypatch.setattr(X.Crowd, "CELLS", 3000)  # a few windows at a time
    assert_same(blocks(HOLDS[name](), stream, 300), grouped(HOLDS[name](), stream))
    odd = [(t, m * np.nan if k % 7 == 0 else m, s * np.nan if k % 11 == 0 else s) for k, (t, m, s) in enumerate(stream)]
    assert_same(blocks(HOLDS[name](), odd, 300), grouped(HOLDS[name](), odd))
    back = stream[:700] + [(t - 3.0, m, s) for t, m, s in stream[700:]]  # goes on frame by frame
    many = HOLDS[name]()
    assert_same(blocks(many, back, 300), grouped(HOLDS[name](), back))
    assert many.crowd is None


@pytest.mark.parametrize("name", BLOCKS)
def test_a_frame_of_a_block_costs_few_calls(name):
    import cProfile
    import pstats

    h, stream, p = HOLDS[name](), [(0.001 * k, m, s) for k, (_, m, s) in enumerate(crowded(8000, 0.01))], cProfile.Profile()
    blocks(h, stream[:4000], 4000)
    p.enable()
    h.many(*(np.array(x) for x in zip(*stream[4000:], strict=True)))
    p.disable()
    assert pstats.Stats(p).total_calls < 15 * 4000  # frame by frame: over 100 a frame


def test_fold_blocks_cuts_between_times(spark):
    from gatelens.operators import replay as R

    rows = [(k, s, float(k // n), [k, None]) for s, n in (("a", 7), ("b", 1), (None, 10**6)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, sensor string, ts double, x array<int>").repartition(4)

    def many(state, t):
        x, ts = R.matrix(t["x"]), t["ts"].to_numpy()
        before = state.get("last", -1.0)
        state["last"] = float(ts[-1])
        assert ts[0] > before and x.shape == (len(ts), 2) and np.isnan(x[:, 1]).all()
        return t["id"].combine_chunks(), x[:, 0], np.where(ts > 3, np.nan, state.setdefault("n", 0) + np.arange(len(ts)))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = R.fold_blocks(df, ("sensor",), dict, many, "id long, x double, n double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.id for r in got) == sorted(k for k, *_ in rows) and all(r.x == r.id for r in got) and {r.n for r in got if r.id > 59} == set()
    assert any(r.n is None for r in got)

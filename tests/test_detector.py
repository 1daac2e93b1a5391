"""The detector against hand-made streams: entries, holds, ownership, anchors, releases, episodes, and what is learned."""

import math
import random

import numpy as np
import pytest
from gatelens.operators import learned
from gatelens.operators.automaton import Anchor, Arming, NearestGate, Retention, Sensor
from gatelens.plans.config import Config, configured
from gatelens.plans.stages import ALL_STAGES

QUANTILE = ("quantile_floor", "tail_spread", "run_score", "lone_gate_suppression", "energy_floor", "score_hold")
FLOORS = {"bucket_s": 1.0, "baseline_window_s": 60.0, "lead_gate_max": -1, "stages": QUANTILE}
OWNED = ("quantile_floor", "tail_spread", "move_ceiling", "run_score", "lone_gate_suppression", "leading_edge", "retention", "ownership", "crossing_arming", "score_hold", "attributed_hold", "retention_hold")


class Room:
    """Frames of quiet gates with noise, some of them raised, fed to one sensor."""

    def __init__(self, sensor, seed=5, noise=1.0, start=1.7e9):
        self.sensor, self.random, self.noise, self.ts = sensor, random.Random(seed), noise, start

    def sample(self, more):
        return max(0, min(100, round(5 + more + self.random.gauss(0, self.noise))))

    def run(self, seconds, move=None, still=None, step=0.1, spikes=None, device=False):
        out = []
        for _ in range(round(seconds / step)):
            m = [self.sample((move or {}).get(g, 0) + (spikes[g][1] if spikes and g in spikes and self.random.random() < spikes[g][0] else 0)) for g in range(9)]
            s = [self.sample((still or {}).get(g, 0)) for g in range(9)]
            out.append(self.sensor.step(self.ts, self.ts, m, s, device))
            self.ts += step
        return out


def room(noise=1.0, **changes):
    made = Room(Sensor(configured(**{**FLOORS, **changes})), noise=noise)
    made.run(10.0)
    assert made.sensor.baseline.ready
    return made


def rows(out):
    return [r for r, _ in out]


def episodes(out, scope):
    return [e for _, closed in out for e in closed if e["scope"] == scope]


def test_score_is_of_this_frames_peaks():
    """One frame with three gates 25 over the floor scores at once, not as its average with quieter ones rises."""
    s = Sensor(configured(**FLOORS))
    for k in range(300):
        s.step(k * 0.1, k * 0.1, [5] * 9, [5] * 9, False)
    row = s.step(30.0, 30.0, [5] * 3 + [30] * 3 + [5] * 3, [5] * 9, False)[0]
    assert row["score"] == pytest.approx(3 * 25 / 4.5) and row["occupied"] and row["active_gates"] == [3, 4, 5]


def test_stuck_gate_is_no_presence():
    out = rows(room().run(30.0, move={0: 55}))
    assert not any(r["occupied"] or r["score"] or r["active_gates"] for r in out)


def test_lone_spikes_never_enter():
    r = room()
    for k in range(600):
        row = rows(r.run(0.1, move={4: 25} if k % 10 == 0 else None))[0]
        assert not row["occupied"] and row["score"] < 3.0 and row["confidence"] < 0.5


def test_body_enters_on_the_first_frame():
    first = rows(room().run(1.0, move={3: 40, 4: 40, 5: 40}))[0]
    assert first["occupied"] and first["active_gates"] == [3, 4, 5] and first["confidence"] > 0.5 and first["frozen"]


def test_hold_is_left_only_after_a_whole_quiet_span():
    r, body = room(), {3: 40, 4: 40, 5: 40}
    assert rows(r.run(1.0, move=body))[-1]["occupied"]
    assert all(x["occupied"] for x in rows(r.run(20.0)))
    assert all(x["occupied"] for x in rows(r.run(1.0, move=body)))
    assert all(x["occupied"] for x in rows(r.run(20.0)))  # the count began anew
    out = rows(r.run(15.0))
    assert [x["occupied"] for x in out] == sorted((x["occupied"] for x in out), reverse=True) and not out[-1]["occupied"]
    off = next(k for k, x in enumerate(out) if not x["occupied"])
    assert out[off]["frozen"] and abs(off - 100) <= 3
    out = rows(r.run(70.0))  # frozen as long as the setting says after the end
    assert out[0]["frozen"] and not out[-1]["frozen"]
    assert abs(sum(x["frozen"] for x in out) + 150 - off - 600) <= 1


def test_frames_that_are_missing_end_no_hold():
    r = room()
    r.run(1.0, move={3: 40, 4: 40, 5: 40})
    r.ts += 600.0
    out = rows(r.run(40.0))
    assert all(x["occupied"] for x in out[:295]) and not out[-1]["occupied"]


def test_weak_energy_is_refused_and_says_why():
    r = room(noise=0.3, energy_floor=60.0, enter_score=1.0)
    out = r.run(3.0, move={3: 20, 4: 20}) + r.run(60.0)
    assert not any(x["occupied"] for x in rows(out)) and any(x["rejection"] == "rejected_energy_floor" for x in rows(out))
    assert {e["result"] for e in episodes(out, "detection") if e["peak"] > 10} == {"rejected_energy_floor"}


def test_energy_counts_over_all_of_the_activity():
    """A strong moment stays with the candidate while any gate's episode is open."""
    r = room(noise=0.3, energy_floor=60.0, enter_score=20.0, k=10.0)
    r.run(0.3, move={3: 70, 4: 70})
    assert r.sensor.candidate > 60 or r.sensor.occupied
    held = r.sensor.candidate
    r.run(2.0)
    assert r.sensor.candidate == held and r.sensor.gates
    r.run(60.0)
    assert r.sensor.candidate == 0.0 and not r.sensor.gates


def test_arrival_needs_motion_near_the_ceiling():
    stages = ("quantile_floor", "tail_spread", "move_ceiling", "run_score", "lone_gate_suppression", "arrival", "score_hold")
    r = Room(Sensor(configured(**{**FLOORS, "stages": stages, "arrival_frac": 0.55, "arrival_min_frames": 2})))
    for _ in range(8):
        r.run(2.0, move={4: 80, 5: 80})
        r.run(3.0)
    r.run(40.0)
    assert r.sensor.baseline.ready and r.sensor.baseline.ceiling > 70 and not r.sensor.occupied
    out = rows(r.run(2.0, move={6: 25, 7: 25}))
    assert not any(x["occupied"] for x in out) and out[-1]["rejection"] == "rejected_arrival"
    r.run(40.0)
    out = rows(r.run(1.0, move={6: 80, 7: 80}))
    assert [x["occupied"] for x in out[:3]] == [False, True, True]


def test_the_leading_edge_decides():
    for edge, band, enters in ((1, (0, 1, 2), True), (1, (5, 6, 7), False), (5, (5, 6, 7), True), (-1, (5, 6, 7), True)):
        r = room(noise=0.3, lead_gate_max=edge, stages=(*QUANTILE, "leading_edge"))
        out = r.run(2.0, move=dict.fromkeys(band, 50))
        assert rows(out)[-1]["leading_gate"] == band[0] and rows(out)[-1]["occupied"] == enters
        if not enters:
            out += r.run(60.0)
            assert {e["result"] for e in episodes(out, "detection")} == {"rejected_leading_edge"}


def test_a_lone_spike_near_by_does_not_lead():
    r = room(noise=0.5, lead_gate_max=1, stages=(*QUANTILE, "leading_edge"))
    out = rows(r.run(3.0, move=dict.fromkeys((5, 6, 7), 50), spikes={0: (0.3, 50)}))
    assert not any(x["occupied"] for x in out) and {x["leading_gate"] for x in out} == {5}


def test_ownership_is_earned_at_the_near_gates_only():
    r = room(noise=0.5, lead_gate_max=1, stages=OWNED)
    out = rows(r.run(2.0, move=dict.fromkeys((0, 1, 2), 50)))
    assert out[-1]["owned"][:3] == [0, 1, 2] and not r.sensor.arming.armed
    r = room(noise=0.5, lead_gate_max=-1, stages=OWNED)
    out = rows(r.run(2.0, move=dict.fromkeys((4, 5, 6), 50)))
    assert out[-1]["occupied"] and r.sensor.owned is None
    assert not rows(r.run(40.0))[-1]["occupied"]


def test_owned_room_is_held_by_its_own_evidence():
    r = room(noise=0.5, lead_gate_max=1, stages=OWNED, retention_off=0.0, baseline_window_s=600.0)
    r.run(400.0)
    r.run(2.0, move=dict.fromkeys((0, 1, 2), 50))
    out = rows(r.run(50.0, move=dict.fromkeys((6, 7, 8), 50)))  # near gates were active within the grace
    assert all(x["occupied"] for x in out)
    out = rows(r.run(60.0, move=dict.fromkeys((6, 7, 8), 50)))
    off = [k for k, x in enumerate(out) if not x["occupied"]]
    assert min(x["score"] for x in out) > 3 and off and abs(off[0] - 400) <= 3  # 60 s of grace, 30 s of hold


def walk(a, ts, n, gate):
    for _ in range(n):
        a.see(ts, gate, True)
        a.step(ts)
        ts += 0.1
    return ts


def test_arming_wants_quiet_first():
    c = Config(lead_gate_max=1)
    a = Arming(c)
    ts = walk(a, 0.0, 3 * c.cross_n, 0)
    assert not a.armed
    ts = walk(a, ts + c.quiet_s, 1, None)
    assert a.quiet and not a.armed
    ts = walk(a, ts, c.cross_n - 1, 1)
    assert not a.armed
    ts = walk(a, ts, 1, 1)
    assert a.armed and a.recent(ts) and not a.recent(ts + c.grace_s + 1)
    a.reset()
    assert not a.armed and a.last_near is not None
    b = Arming(Config(lead_gate_max=3))
    b.see(0.0, 3, False)
    assert b.last_near == 0.0 and not b.near  # of an unowned room nothing is a crossing


def settle(r, ts, seconds, seat):
    for _ in range(round(seconds / 0.1)):
        r.observe(0.1, np.where(np.arange(9) == 4, seat, 10.0).astype(float))
    return ts + seconds


def test_retention_reads_presence_not_departure():
    r = Retention(Config(tau_peak=0.0))
    settle(r, 0, 30.0, 10)
    assert r.peak[4] == 0 and r.noise[4] > 0
    settle(r, 0, 10.0, 40)
    assert r.peak[4] >= 20
    settle(r, 0, 60.0, 40)
    settle(r, 0, 10.0, 10)
    assert r.peak[4] == 0


def test_retention_has_one_latch_over_the_owned_gates():
    r = Retention(Config(tau_peak=1.0))
    settle(r, 0, 30.0, 10)
    settle(r, 0, 5.0, 40)
    assert not r.holds({0, 1}) and r.holds({4}) and r.latched
    r.peak[:] = 15.0
    assert r.holds({0}) and r.holds({4})  # between the levels it stays as it was
    r.peak[:] = 9.0
    assert not r.holds({4}) and not r.holds({0})
    r.peak[:] = 15.0
    assert not r.holds({4})
    off = Retention(Config(retention_off=0.0))
    off.peak[:] = 99.0
    assert not off.holds()


def test_retention_by_hand():
    """Three frames, every sum by hand."""
    r = Retention()
    r.observe(None, np.full(9, 10.0))
    r.observe(0.5, np.full(9, 12.0))
    a, b, n = (1 - math.exp(-0.5 / t) for t in (2.0, 60.0, 10.0))
    noise = 0.3 + n * (min(2.0, 4 * 0.3 + 0.5) - 0.3)
    assert r.noise[0] == pytest.approx(noise) and r.peak[0] == pytest.approx(2 * (a - b) / noise)
    peak = r.peak[0]
    r.observe(9.0, np.full(9, 0.0))  # steps are at most two seconds
    assert r.peak[0] == pytest.approx(peak * math.exp(-2.0 / 90.0))


FLOOR, SPREAD = np.full(9, 10.0), np.full(9, 2.0)


def gates(v, near=0.0):
    return np.array([near, near] + [v] * 7, float)


def test_anchor_keeps_a_quiet_footprint():
    a = Anchor(40.0)
    assert not a.observe(0.0, gates(39.9), gates(30), FLOOR, SPREAD) and not a.admitted
    assert a.observe(0.1, gates(60), gates(30), FLOOR, SPREAD) and a.score == pytest.approx(1) and a.admitted
    assert a.observe(0.2, gates(0), gates(30), FLOOR, SPREAD) and a.score == pytest.approx(1) and not a.admitted
    assert not a.observe(0.3, gates(0), gates(10), FLOOR, SPREAD) and a.template is None


def test_anchor_is_forgotten_over_a_gap_and_when_time_goes_back():
    a = Anchor(40.0)
    assert a.observe(1.0, gates(60), gates(30), FLOOR, SPREAD)
    assert not a.observe(1.56, gates(0), gates(30), FLOOR, SPREAD)
    assert a.observe(2.0, gates(60), gates(30), FLOOR, SPREAD)
    assert not a.observe(1.9, gates(0), gates(30), FLOOR, SPREAD)


def test_anchor_says_no_on_unusable_input_and_keeps_what_it_has():
    a = Anchor(40.0)
    assert a.observe(0.0, gates(60), gates(30), FLOOR, SPREAD)
    assert not a.observe(0.1, gates(60), gates(30), FLOOR, np.zeros(9)) and a.template is not None
    assert not a.observe(0.1, gates(math.nan), gates(30), FLOOR, SPREAD)
    assert a.observe(0.2, gates(0), gates(30), FLOOR, SPREAD)


def test_only_balanced_motion_founds_an_anchor_and_any_strong_motion_grows_it():
    a = Anchor(40.0)
    assert not a.observe(0.0, gates(0, near=100.0), gates(30), FLOOR, SPREAD)
    assert not a.observe(0.1, gates(45), gates(100), FLOOR, SPREAD)  # motion is under a third of its gate
    assert a.observe(0.2, gates(45), gates(50), FLOOR, SPREAD)
    small = a.template @ a.template
    assert a.observe(0.3, gates(45), gates(100), FLOOR, SPREAD) and not a.admitted and a.template @ a.template > small
    weak = Anchor(40.0)
    assert not weak.observe(0.0, gates(60), gates(10.5), FLOOR, SPREAD)  # a footprint smaller than one
    assert weak.template is None


def test_nearest_gate_goes_dark():
    n = NearestGate(2.0)
    floor, spread = np.full(9, 5.0), np.ones(9)

    def feed(ts, level, watched=3, admitted=False):
        n.observe(ts, np.where(np.arange(9) == 3, level, 5.0).astype(float))
        return n.releases(ts, floor, spread, watched, admitted)

    n.observe(0.0, np.full(9, 60.0))
    n.enter(0.0, floor, spread)
    assert n.lit.all() and n.plateau[3] == 60.0
    assert not any(feed(0.1 * k, 60.0) for k in range(1, 60))
    out = [feed(6.0 + 0.1 * k, 5.0) for k in range(80)]
    first = out.index(True)  # the median falls half a window later, then two seconds of darkness
    assert 44 <= first <= 48 and all(out[first:])
    assert not feed(14.1, 5.0, admitted=True) and not feed(14.2, 5.0) and n.since == 14.2
    assert not feed(14.3, 5.0, watched=None) and n.since is None


def plain_run_lengths(rows, floor, spread, hazard, longest, recent):
    """Adams and MacKay's recursion, run by run, with the last run taking in all longer ones."""
    runs, out, above = [], [], False  # of each run: probability, and kappa, alpha, and a mean and beta a series

    def density(x, mu, beta, kappa, alpha):
        s2, nu = beta * (kappa + 1) / (alpha * kappa), 2 * alpha
        return math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi * s2) * (1 + (x - mu) ** 2 / (nu * s2)) ** (-(nu + 1) / 2)

    for n, x in enumerate(rows):
        prior = (1.0, 0.01, 1.0, list(floor), [d * d for d in spread])
        found = []
        for k, (p, kappa, alpha, mu, beta) in enumerate([prior, *runs]):
            like = math.prod(density(v, m, b, kappa, alpha) for v, m, b in zip(x, mu, beta))
            new_mu = [(kappa * m + v) / (kappa + 1) for v, m in zip(x, mu)]
            new_beta = [b + kappa * (v - m) ** 2 / (2 * (kappa + 1)) for v, m, b in zip(x, mu, beta)]
            found.append([(hazard if k == 0 else p * (1 - hazard)) * like, kappa + 1, alpha + 0.5, new_mu, new_beta])
        for extra in found[longest:]:
            found[longest - 1][0] += extra[0]
        found = found[:longest]
        total = sum(f[0] for f in found)
        runs = [(f[0] / total, *f[1:]) for f in found]
        mass = sum(r[0] for r in runs[:recent])
        ago = max(range(min(recent, len(runs))), key=lambda k: runs[k][0])
        out.append((mass, ago if mass > 0.5 and not above and n >= recent else None))
        above = mass > 0.5
    return out


def test_run_lengths_equal_a_plain_loop():
    r = random.Random(4)
    rows = [[r.gauss(20 if k < 60 else 40 if k < 100 else 25, 2), r.gauss(10 if k < 60 else 30, 3), r.gauss(5, 1)] for k in range(150)]
    floor, spread = [5.0, 8.0, 5.0], [2.0, 3.0, 1.0]
    c = learned.RunLengths(0.1 / 120, longest=30, recent=8)
    got = [(c.step(np.array(x), np.array(floor), np.array(spread)), c.mass) for x in rows]
    want = plain_run_lengths(rows, floor, spread, 0.1 / 120, 30, 8)
    assert [a for a, _ in got] == [a for _, a in want]
    assert np.allclose([m for _, m in got], [m for m, _ in want], atol=1e-9)
    assert [k - a for k, (a, _) in enumerate(got) if a is not None][:2] == [60, 100]


def release(frames, moved=(), hold_s=5.0):
    """When a visit that began at zero is left; frames are (seconds, still level of gates 3 and 4)."""
    c, ts, rnd = learned.ChangepointRelease(hold_s), 0.0, random.Random(9)
    floor, spread = np.full(9, 5.0), np.ones(9)
    c.observe(0.0, np.full(9, 5.0), floor, spread, False, True)
    c.enter(0.0)
    for seconds, a, b in frames:
        for _ in range(round(seconds / 0.1)):
            ts += 0.1
            still = np.array([5, 5, 5, a, b, 5, 5, 5, 5]) + np.array([rnd.choice((-1, 0, 1)) for _ in range(9)])
            c.observe(ts, still.astype(float), floor, spread, any(lo <= ts < hi for lo, hi in moved), True)
            if c.releases(ts):
                return ts
    return None


def test_release_when_all_carrying_gates_go_dark():
    left = release([(20, 50, 40), (20, 5, 5)])
    assert left is not None and 24.5 <= left <= 26.5
    assert release([(20, 50, 40), (20, 5, 40)]) is None  # one of them still carries
    assert release([(20, 50, 40), (20, 48, 39)]) is None
    assert release([(3, 50, 40), (20, 5, 5)]) is None  # too soon after the entry
    assert release([(20, 50, 40), (3.5, 5, 5), (20, 50, 40)], hold_s=10.0) is None  # it rose again
    assert release([(20, 50, 40), (20, 5, 5)], moved=[(18.5, 19.5)]) is None  # the motion's own change
    assert release([(20, 50, 40), (20, 5, 5)], moved=[(24, 24.3)]) is None  # someone moves while it is armed


def test_long_gaps_are_stepped_whole():
    c = learned.ChangepointRelease(5.0)
    floor, spread = np.full(9, 5.0), np.ones(9)
    c.observe(0.0, np.full(9, 5.0), floor, spread, False, True)
    c.observe(100.0, np.full(9, 5.0), floor, spread, False, True)
    assert c.runs.seen == c.next == 1000


def test_baseline_learns_while_it_fills_and_the_device_decides():
    s = Sensor(configured(**{**FLOORS, "stages": (*QUANTILE, "motion_anchor", "in_room_gates", "nearest_gate_release")}))
    r = Room(s)
    out = rows(r.run(3.0, move={3: 95}, device=True))
    assert all(x["occupied"] and x["confidence"] == 0.5 and not x["baseline_ready"] for x in out)
    assert s.in_room.now(r.ts)[3] >= 90 and s.watched is None  # no still floor yet
    r.run(10.0)
    r.run(2.0, still={3: 50})
    assert s.watched == 3


def test_noise_moves_the_floor_and_occupancy_ends():
    r = Room(Sensor(configured(**{**FLOORS, "baseline_window_s": 300.0, "bucket_s": 10.0})))
    r.run(120.0)
    noisy, spikes = {0: 12, 1: 12}, {0: (0.12, 8), 1: (0.12, 8)}
    assert any(x["occupied"] for x in rows(r.run(30.0, move=noisy, spikes=spikes)))
    out = rows(r.run(600.0, move=noisy, spikes=spikes))
    assert not any(x["occupied"] for x in out[-1200:]) and r.sensor.baseline.floor[0] > 13
    assert rows(r.run(2.0, move={**noisy, 4: 50, 5: 50, 6: 50}, spikes=spikes))[-1]["occupied"]


def test_detection_episode_by_hand():
    """Frames a second apart, so that support follows the peaks by 1 - 1/e; all sums by hand."""
    s = Sensor(configured(**{**FLOORS, "gap_close_s": 3.0, "hold_s": 2.0}))
    for k in range(300):
        s.step(k * 0.1, k * 0.1, [5] * 9, [5] * 9, False)
    out, ts = [], 29.9
    for move, still in (({3: 50, 4: 20}, {}), ({3: 50, 4: 50}, {}), ({}, {4: 30}), ({}, {}), *[({}, {})] * 14):
        ts += 1.0
        out.append(s.step(ts, ts, [5 + move.get(g, 0) for g in range(9)], [5 + still.get(g, 0) for g in range(9)], False))
    d = episodes(out, "detection")[0]
    assert d["result"] == "entered" and (d["lo"], d["hi"], d["t0"]) == (3, 4, pytest.approx(30.9))
    assert d["peak"] == 50.0 and d["raw"].tolist() == [0, 0, 0, 55, 55, 0, 0, 0, 0] and d["leading_gate"] == 3
    gate = {e["gate"]: e for e in episodes(out, "gate")}
    assert set(gate) == {3, 4} and gate[4]["centroid"] == 4.0 and gate[3]["velocity"] == 0.0
    a, up = 1 - math.exp(-1), {3: [50, 50, 0], 4: [20, 50, 30]}
    level, seen = {3: 0.0, 4: 0.0}, {3: [], 4: []}
    for k in range(17):
        for g in (3, 4):
            level[g] += a * ((up[g][k] if k < 3 else 0) - level[g])
            seen[g].append(level[g])
    for g in (3, 4):
        last = max(k for k in range(17) if seen[g][k] >= 4.5 / 4)
        assert gate[g]["t1"] == pytest.approx(30.9 + last) and gate[g]["active_frac"] == pytest.approx(1.0)
        assert gate[g]["still_frac"] == pytest.approx((1 / last) if g == 4 else 0.0)


def test_portal_waits_for_what_a_brief_episode_led_to():
    g = learned.GateClasses(configured(stages=ALL_STAGES))
    e = lambda gate, t0, t1: {"scope": "gate", "gate": gate, "t0": t0, "t1": t1, "active_frac": 1.0, "raw": np.full(9, 50.0)}
    g.closed(e(1, 0.0, 5.0))
    g.tick(9.0, {})
    assert len(g.pending) == 1  # its window isn't over
    g.tick(8000.0, {4: 7.0})
    assert len(g.pending) == 1 and not g.dead[1].n  # gate 4 has been open since then, however long
    g.closed(e(4, 7.0, 9000.0))
    g.tick(9001.0, {})
    assert not g.pending and g.lead[1].n == 1.0 and not g.starts
    g.closed(e(1, 9100.0, 9105.0))
    g.tick(9111.0, {})
    assert g.dead[1].n == 1.0


def test_excluded_gates_neither_score_nor_support():
    r = room(noise=0.3, max_gate=4, stages=(*QUANTILE, "gate_exclusion"))
    assert not any(x["occupied"] for x in rows(r.run(3.0, move={5: 50, 6: 50})))
    assert not any(x["occupied"] for x in rows(r.run(3.0, move={4: 50, 5: 50})))  # gate 4 alone, its only neighbour barred
    r.run(40.0)
    assert rows(r.run(1.0, move={3: 50, 4: 50}))[-1]["occupied"]
    out = rows(r.run(60.0, move={6: 50, 7: 50}))
    assert all(x["occupied"] for x in out) and out[-1]["gate_classes"] == "UUUUUOOOO"

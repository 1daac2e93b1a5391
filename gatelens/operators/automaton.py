"""The per-sensor state: everything whose next value needs the last one.

One object a sensor, one call a frame. Batch replay and streaming run the same
object, so equal frames and settings give equal rows. No clock is read; all
times are the frames' own.
"""

from __future__ import annotations

import math
from array import array
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from gatelens.plans.config import GATES, Config
from gatelens.plans.stage_order import order

from .learned import LEVELS, ArrivalBar, ChangepointRelease, GateClasses, Histograms, InRoom, Kept

GATE = np.arange(GATES)
#: What a bucket counts, both channels of each gate and the highest motion, as the places of their first level.
COUNTED = range(0, (2 * GATES + 1) * LEVELS, LEVELS)
WHOLE = {float(k): k for k in range(LEVELS)}
#: The letter of each gate class.
LETTERS = {"in_room": "I", "portal": "P", "bleed": "B", "unknown": "U", "out": "O"}


def quantile(rows: np.ndarray, q: float) -> np.ndarray:
    """Each column's quantile, linear between the two nearest values."""
    ordered = np.sort(rows, axis=0)
    at = q * (len(rows) - 1)
    low, high = ordered[int(at)], ordered[min(int(at) + 1, len(rows) - 1)]
    return low + (high - low) * (at - int(at))


class Baseline:
    """Floor, spread and ceiling of each gate and channel, by the listed stages.

    Floors: the lower quartile of the last closed buckets' medians, the most
    frequent energy, or the lowest recurring one. Spreads: the lower quartile of
    the buckets' upper tails, or the distance from the mode. The open bucket
    counts whole energies, so that its size doesn't hang on its frames; rows of
    any others are kept.
    """

    REFRESH = 5.0

    def __init__(self, config: Config):
        self.c = config
        first = lambda *names: next((n for n in config.stages if n in names), names[0])
        self.floor_by = first("quantile_floor", "histogram_floor", "recurring_floor")
        self.spread_by = first("tail_spread", "mode_spread")
        self.open: int | None = None
        self._clear()
        self.levels = np.zeros((0, 4 * GATES + 1))  # a row a closed bucket: middles, tails, the ceiling
        self.hist = Histograms(2 * GATES, config) if (self.floor_by, self.spread_by) != ("quantile_floor", "tail_spread") else None
        self.floor, self.spread = np.zeros(2 * GATES), np.ones(2 * GATES)
        self.ceiling, self.refreshed = 0.0, -math.inf
        self.trusted = False  # whether floors are more than a first value

    @property
    def ready(self) -> bool:
        return len(self.levels) >= self.c.min_buckets

    def add(self, ts: float, energies: np.ndarray) -> None:
        at = math.floor(ts / self.c.bucket_s)
        if self.open is not None and at != self.open:
            keep = at <= self.open + 1  # the next one, or time went back; after a gap the bucket is dropped
            if self.hist:
                self.hist.close(keep)
            if keep:
                self._close()
            self._clear()
        self.open = at
        self._count(energies)
        if self.hist:
            self.hist.add(ts, energies)
            if self.floor_by == "recurring_floor" and self.hist.observed >= self.c.mode_min_s and ts - self.refreshed >= self.REFRESH:
                self.floor, self.refreshed, self.trusted = self.hist.recurring(self.c.mode_min_s), ts, True

    def _clear(self) -> None:
        self.counts, self.others = array("i", bytes(4 * len(COUNTED) * LEVELS)), []

    def _count(self, energies: np.ndarray) -> None:
        row = energies.tolist()
        at = [WHOLE.get(x) for x in row]
        if None in at:
            self.others.append(np.append(energies, energies[:GATES].max()))
            return
        at.append(max(at[:GATES]))
        for first, level in zip(COUNTED, at, strict=True):
            self.counts[first + level] += 1

    def _close(self) -> None:
        counts = np.frombuffer(self.counts, np.int32).reshape(len(COUNTED), LEVELS)
        rows = np.stack([np.repeat(np.arange(LEVELS, dtype=float), n) for n in counts], axis=1)
        rows = np.concatenate([rows, *(x[None] for x in self.others)])
        middle, high = quantile(rows, 0.5), quantile(rows, 0.9)
        closed = np.concatenate([middle[:-1], np.maximum(high - middle, 0.0)[:-1], high[-1:]])
        self.levels = np.concatenate([self.levels, closed[None]])[-self.c.window_buckets :]
        least = max(self.c.min_mad, 1e-6)
        self.ceiling = float(self.levels[:, -1].max())
        modes = self.hist.modes() if self.hist else None
        if self.floor_by == "quantile_floor":
            self.floor, self.trusted = quantile(self.levels[:, : 2 * GATES], 0.25), True
        elif self.floor_by == "histogram_floor" and self.hist.observed >= self.c.mode_min_s:
            self.floor, self.trusted = modes, True
        if self.spread_by == "tail_spread":
            self.spread = np.maximum(quantile(self.levels[:, 2 * GATES : -1], 0.25), least)
        else:
            self.spread = self.hist.spreads(modes, least, int(self.c.mode_band))


class Retention:
    """A signed fast-over-slow rise of each still channel, in units of its own noise, with a decaying peak.

    One latch over the gates asked for: it holds from the upper level on until
    the peak falls under the lower one.
    """

    NOISE, FIRST, LEAST, LONGEST = 10.0, 0.3, 0.1, 2.0

    def __init__(self, config: Config | None = None):
        c = config or Config()
        self.on, self.off, self.taus = c.retention_on, c.retention_off, (c.tau_fast, c.tau_slow, c.tau_peak)
        self.fast = self.slow = None
        self.noise, self.peak = np.full(GATES, self.FIRST), np.zeros(GATES)
        self.latched = False
        self.last: np.ndarray | None = None

    def observe(self, dt: float | None, still: np.ndarray) -> None:
        if self.fast is None:
            self.fast, self.slow, self.last = still.copy(), still.copy(), still
            return
        step = self.LONGEST if dt is None else min(max(dt, 0.0), self.LONGEST)
        mix = lambda tau: 1.0 - math.exp(-step / tau) if tau > 0 else 1.0
        self.noise += mix(self.NOISE) * (np.minimum(np.abs(still - self.last), 4 * self.noise + 0.5) - self.noise)
        self.fast += mix(self.taus[0]) * (still - self.fast)
        self.slow += mix(self.taus[1]) * (still - self.slow)
        rise = (self.fast - self.slow) / np.maximum(self.noise, self.LEAST)
        self.peak = np.maximum(self.peak * (1.0 - mix(self.taus[2])), np.maximum(rise, 0.0))
        self.last = still

    def level(self, gates: set[int] | None = None) -> float:
        """The highest peak over the gates, or over all."""
        return float(self.peak[sorted(gates)].max() if gates else self.peak.max())

    def holds(self, gates: set[int] | None = None) -> bool:
        if self.off <= 0:
            return False
        level = self.level(gates)
        self.latched = level >= self.on or (self.latched and level >= self.off)
        return self.latched


class Anchor:
    """The still footprint that motion left; anchored while the present one still projects on it.

    Only motion that is strong beside the still channel of its own gate can
    found a footprint; a living one also grows by other strong motion. admitted
    says whether this frame alone could have founded one.
    """

    GAP, KEEP, SHARE, FIRST = 0.55, 0.4, 1 / 3, 2

    def __init__(self, bar: float):
        self.bar, self.template, self.last, self.score, self.admitted = bar, None, None, 0.0, False

    def observe(self, ts: float, move: np.ndarray, still: np.ndarray, floor: np.ndarray, spread: np.ndarray) -> bool:
        m, s, f, d = (x[self.FIRST :] for x in (move, still, floor, spread))
        self.admitted = False
        if not all(np.isfinite(x).all() for x in (m, s, f, d, ts)) or (d <= 0).any():
            return False
        if self.last is not None and not 0 <= ts - self.last <= self.GAP:
            self.template = None
        self.last = ts
        now = np.maximum(s - f, 0.0) / d
        top = float(m.max())
        new = now * (m / max(top, 1.0))
        strong = top >= self.bar and float(new @ new) >= 1.0
        balanced = bool(((m >= self.bar) & (m / np.maximum(m + s, 1.0) >= self.SHARE)).any())
        self.admitted = strong and balanced
        if self.admitted if self.template is None else strong and new @ new > self.template @ self.template:
            self.template = new
        self.score = 0.0 if self.template is None else float(now @ self.template / (self.template @ self.template))
        if self.score < self.KEEP:
            self.template, self.score = None, 0.0
        return self.template is not None

    def observe_many(self, ts: np.ndarray, move: np.ndarray, still: np.ndarray, floor: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """observe of every frame in turn: what each gives, and the footprint after it. Only what hangs on the frame before goes frame by frame."""
        m, s, f, d = (x[..., self.FIRST :] for x in (move, still, floor, spread))
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            fine = np.isfinite(ts) & np.isfinite(m).all(axis=1) & np.isfinite(s).all(axis=1) & bool(np.isfinite(f).all() and np.isfinite(d).all() and (d > 0).all())
            now, top = np.maximum(s - f, 0.0) / d, m.max(axis=1)
            new = now * (m / np.maximum(top, 1.0)[:, None])
            size = np.vecdot(new, new)
            strong = (top >= self.bar) & (size >= 1.0)
            admitted = strong & ((m >= self.bar) & (m / np.maximum(m + s, 1.0) >= self.SHARE)).any(axis=1)
        held, templates, whole = [], [], None if self.template is None else self.template @ self.template
        template, last, score, may = self.template, self.last, self.score, self.admitted
        for at, ok, may, big, z, x, y in zip(ts.tolist(), fine.tolist(), admitted.tolist(), strong.tolist(), size.tolist(), now, new, strict=True):  # noqa: B007
            if ok:
                if last is not None and not 0 <= at - last <= self.GAP:
                    template = None
                last = at
                if may if template is None else big and z > whole:
                    template, whole = y.copy(), z
                score = 0.0 if template is None else float(x @ template / whole)
                if score < self.KEEP:
                    template, score = None, 0.0
            held.append(ok and template is not None)
            templates.append(template)
        self.template, self.last, self.score, self.admitted = template, last, score, may and ok if held else may
        return np.array(held, bool), templates


class Arming:
    """An owned room: quiet at the near gates for a while, then many near frames in a short time, as on the way out."""

    WITHIN = 20.0

    def __init__(self, config: Config | None = None):
        c = config or Config()
        self.quiet_s, self.count, self.grace_s, self.most = c.quiet_s, c.cross_n, c.grace_s, c.lead_gate_max
        self.last_near: float | None = None
        self.reset()

    def reset(self) -> None:
        self.armed, self.quiet, self.near = False, False, deque()

    def rebase(self) -> None:
        self.last_near = None
        self.near.clear()

    def see(self, ts: float, lead: int | None, owned: bool) -> None:
        """A frame whose activity leads at that gate."""
        if lead is not None and lead <= self.most:
            self.last_near = ts
            if owned:
                self.near.append(ts)
        while self.near and ts - self.near[0] > self.WITHIN:
            self.near.popleft()

    def step(self, ts: float) -> bool:
        """A frame of an owned room."""
        if not self.armed and self.quiet:
            self.armed = len(self.near) >= self.count
        elif not self.armed and (self.last_near is None or ts - self.last_near >= self.quiet_s):
            self.quiet = True
            self.near.clear()
        return self.armed

    def recent(self, ts: float) -> bool:
        return self.last_near is not None and ts - self.last_near <= self.grace_s


class NearestGate:
    """Release when the watched gate's trailing median has long been far under its plateau of this visit.

    Medians are of raw still energy over all frames; plateaus decay and, like
    the marks of gates that were ever lit, are a visit's own.
    """

    MEDIAN_S, HALF_LIFE, LIT = 5.0, 600.0, 3.0

    def __init__(self, hold_s: float, lost: float = 0.2):
        self.hold_s, self.lost = hold_s, lost
        self.median, self.plateau, self.lit = np.zeros(GATES), np.zeros(GATES), np.zeros(GATES, bool)
        self.recent: deque = deque()
        self.since = self.last = None

    def rebase(self) -> None:
        self.recent.clear()
        self.since = self.last = None

    def observe(self, ts: float, still: np.ndarray) -> None:
        self.recent.append((ts, still))
        while self.recent[0][0] <= ts - self.MEDIAN_S:
            self.recent.popleft()
        self.median = np.median([x for _, x in self.recent], axis=0)

    def enter(self, ts: float, floor: np.ndarray, spread: np.ndarray) -> None:
        self.plateau, self.lit = self.median.copy(), self.median > floor + self.LIT * spread
        self.since, self.last = None, ts

    def releases(self, ts: float, floor: np.ndarray, spread: np.ndarray, watched: int | None, admitted: bool) -> bool:
        decay = 1.0 if self.last is None else 2.0 ** (-(ts - self.last) / self.HALF_LIFE)
        self.last = ts
        self.plateau = np.maximum(self.plateau * decay, self.median)
        self.lit |= self.median > floor + self.LIT * spread
        dark = watched is not None and self.lit[watched] and not admitted and self.median[watched] / max(self.plateau[watched], 1e-9) < self.lost
        if not dark:
            self.since = None
            return False
        self.since = ts if self.since is None else self.since
        return ts - self.since >= self.hold_s


@dataclass
class Episode:
    """What gathers over one gate's activity, or (gate None) over the activity of any gate."""

    scope: str
    gate: int | None
    t0: float
    t1: float
    lo: int
    hi: int
    seen: float
    quiet: float | None = None
    peak: float = 0.0
    active_s: float = 0.0
    still_s: float = 0.0
    moment: float = 0.0
    first: float | None = None
    latest: float = 0.0
    entered: bool = False
    saw_active: bool = False
    lead: int | None = None
    reasons: set = field(default_factory=set)
    raw: np.ndarray = field(default_factory=lambda: np.zeros(GATES))

    def gather(self, step: float, peak: float, still: bool, active: bool, occupied: bool, verdict: str | None, lead: int | None) -> None:
        self.active_s += step
        self.still_s += step if still else 0.0
        self.peak = max(self.peak, peak)
        self.saw_active |= active
        self.entered |= occupied
        if verdict is not None:
            self.reasons.add(verdict)
        if lead is not None:
            self.lead = lead if self.lead is None else min(self.lead, lead)

    def result(self) -> str:
        if self.entered:
            return "entered"
        if not self.saw_active:
            return "rejected_coherence"
        for reason in ("leading_edge", "arrival", "energy_floor"):
            if "rejected_" + reason in self.reasons:
                return "rejected_" + reason
        return "rejected_hysteresis"

    def row(self) -> dict:
        span = self.t1 - self.t0
        if self.gate is not None:
            centre, velocity = float(self.gate), 0.0
        else:
            centre = self.moment / self.active_s if self.active_s > 0 else self.latest
            velocity = (self.latest - (self.latest if self.first is None else self.first)) / span if span > 0 else 0.0
        return {
            "scope": self.scope, "gate": self.gate, "t0": self.t0, "t1": self.t1, "peak": self.peak, "lo": self.lo, "hi": self.hi,
            "centroid": centre, "velocity": velocity, "still_frac": self.still_s / self.active_s if self.active_s > 0 else 0.0,
            "active_frac": min(self.active_s / span, 1.0) if span > 0 else 1.0, "result": self.result(), "leading_gate": self.lead, "raw": self.raw,
        }


def filters(config: Config) -> list[str]:
    """The entry filters in the order that they are asked in."""
    return [s.name for s in order(config.stages) if s.role == "entry_filter"]


class Sensor(Kept):
    """All state of one sensor; step() takes a frame and returns what it shows then."""

    PARTS = ("retention", "anchor", "arming", "nearest", "change", "in_room", "bar")

    def __init__(self, config: Config):
        self.c = config
        self.on, self.filters = set(config.stages), filters(config)
        self.baseline = Baseline(config)
        self.retention, self.anchor, self.arming = Retention(config), Anchor(config.anchor_bar), Arming(config)
        self.nearest, self.change = NearestGate(config.hold_s, config.release_fraction), ChangepointRelease(config.hold_s, config.tick_s, config.changepoint_hazard_s)
        self.in_room, self.bar = InRoom(config.in_room_half_life_s), ArrivalBar(config.baseline_window_s)
        self.classes = GateClasses(config)
        self.support = np.zeros(GATES)
        self.mono: float | None = None
        self.ts: float | None = None
        self.occupied, self.measured = False, False
        self.deadline: float | None = None
        self.freeze: float | None = None
        self.edge: int | None = None
        self.watched: int | None = None
        self.candidate, self.arrivals = 0.0, 0
        self.owned: set[int] | None = None
        self.gates: dict[int, Episode] = {}
        self.detection: Episode | None = None
        self.awaiting_quiet = False

    # -- pieces of a step ------------------------------------------------------

    def _credible(self, run: list[int], barred: np.ndarray) -> bool:
        """Several gates, or one with a neighbour that has half the bar for some time; a barred one lends nothing."""
        if len(run) > 1 or "lone_gate_suppression" not in self.on:
            return True
        beside = (run[0] - 1, run[0] + 1)
        return any(0 <= g < GATES and not barred[g] and self.support[g] >= self.c.k / 2 for g in beside)

    def _runs(self, level: np.ndarray, barred: np.ndarray) -> list[list[int]]:
        """The credible runs of gates over the bar, the nearest first."""
        runs, run = [], []
        for g in range(GATES + 1):
            if g < GATES and level[g] >= self.c.k and not barred[g]:
                run.append(g)
            elif run:
                if self._credible(run, barred):
                    runs.append(run)
                run = []
        return runs

    def _score(self, peaks: np.ndarray, barred: np.ndarray) -> tuple[float, tuple[int, ...]]:
        """The strongest run's peaks in units of the bar, and its gates; the nearest of equal ones."""
        best, gates = 0.0, ()
        for run in self._runs(peaks, barred):
            score = sum(float(peaks[g]) for g in run) / self.c.k
            if score > best:
                best, gates = score, tuple(run)
        return best, gates

    def _barred(self) -> np.ndarray:
        if "gate_exclusion" not in self.on:
            return np.zeros(GATES, bool)
        barred = np.array([k == "bleed" for k in self.classes.kind]) if "dwell_class" in self.on else np.zeros(GATES, bool)
        return barred | self._outside()

    def _outside(self) -> np.ndarray:
        """Gates beyond the cap that is set, or beyond the boundary that is learned."""
        c, out = self.c, np.zeros(GATES, bool)
        if "gate_exclusion" in self.on and c.max_gate is not None:
            out |= GATE > c.max_gate
        if "energy_ceiling" in self.on and c.ceiling_enabled and self.classes.boundary is not None:
            out |= GATE > self.classes.boundary
        return out

    def _verdict(self, anchored: bool) -> str | None:
        c = self.c
        rejects = {
            "energy_floor": c.energy_floor > 0 and self.candidate < c.energy_floor,
            "arrival": c.arrival_frac > 0 and len(self.baseline.levels) > 0 and self.arrivals < c.arrival_min_frames,
            "leading_edge": c.lead_gate_max >= 0 and (self.edge is None or self.edge > c.lead_gate_max),
            "motion_anchor": not anchored,
        }
        return next(("rejected_" + s for s in self.filters if rejects[s]), None)

    def _holds(self, score: float, mono: float) -> bool:
        unowned, strong = self.owned is None, score >= self.c.exit_score
        holds = {
            "score_hold": unowned and strong,
            "attributed_hold": not unowned and strong and self.arming.recent(mono),
            "retention_hold": not unowned and not self.arming.armed and self.retention.holds(self.owned),
        }
        return any(holds[s] for s in holds if s in self.on)

    def _enter_releases(self, mono: float) -> None:
        floor, spread = self.baseline.floor[GATES:], self.baseline.spread[GATES:]
        self.nearest.enter(mono, floor, spread)
        self.change.enter(mono)

    def _released(self, mono: float) -> bool:
        """Every listed release is stepped, whatever another one says."""
        floor, spread = self.baseline.floor[GATES:], self.baseline.spread[GATES:]
        said = []
        if "nearest_gate_release" in self.on:
            said.append(self.nearest.releases(mono, floor, spread, self.watched, self.anchor.admitted))
        if "changepoint_release" in self.on:
            said.append(self.change.releases(mono))
        return any(said)

    def _restart_presence(self) -> None:
        self.arming.reset()
        self.retention.latched = False

    def _advance(self, mono: float, score: float, active: tuple[int, ...], verdict: str | None) -> None:
        c = self.c
        if not self.occupied:
            if score >= c.enter_score and verdict is None:
                self.occupied, self.deadline = True, None
                if "ownership" in self.on and c.lead_gate_max >= 0 and self.edge is not None and self.edge <= c.lead_gate_max:
                    self.owned = set(active)
                    self._restart_presence()
                self._enter_releases(mono)
            return
        if self.owned is not None:
            self.owned |= set(active)
            if "crossing_arming" in self.on:
                self.arming.step(mono)
        over = False
        if self._holds(score, mono):
            self.deadline = None
        elif self.deadline is None:
            self.deadline = mono + c.hold_s
        else:
            over = mono >= self.deadline
        if over or self._released(mono):
            self.occupied, self.deadline, self.owned, self.freeze = False, None, None, mono + c.freeze_hold_s
            self._restart_presence()

    def _episodes(self, ts: float, peaks: np.ndarray, rm: np.ndarray, rs: np.ndarray, move: np.ndarray, active: tuple[int, ...], verdict: str | None) -> list[dict]:
        c, out, gap = self.c, [], self.c.episode_gap_s
        if self.occupied:
            self.awaiting_quiet = False
        if self.ts is not None and ts - self.ts > c.episode_stall_s:
            out += self._close_all()
        raised = False
        for g in range(GATES):
            e, level = self.gates.get(g), self.support[g]
            if e is None:
                if level < c.gate_on:
                    continue
                e = self.gates[g] = Episode("gate", g, ts, ts, g, g, ts)
                self._widen(ts, g)
            step, stalled = min(max(ts - e.seen, 0.0), gap), ts - e.seen > gap
            e.seen = ts
            if level >= c.gate_off:
                raised, e.quiet, e.t1 = True, None, ts
                e.raw[g] = max(e.raw[g], move[g])
                e.gather(step, float(peaks[g]), rs[g] > rm[g], g in active, self.occupied, verdict, self.edge)
                self._widen(ts, g)
                continue
            e.quiet = ts if e.quiet is None else e.quiet
            if stalled or ts - e.quiet >= gap:
                out.append(self.gates.pop(g).row())
        if raised and self.detection is not None:
            self._gather(self.detection, ts, gap, peaks, rm, rs, move, active, verdict)
        if not self.gates:
            self.awaiting_quiet = False
        d = self.detection
        if d is not None and (not self.gates or (d.entered and not self.occupied)):
            out.append(d.row())
            # what is left of the gates after an occupancy is the way out, no activity of its own
            self.detection, self.awaiting_quiet = None, bool(self.gates)
        return out

    def _widen(self, ts: float, g: int) -> None:
        d = self.detection
        if d is None:
            if not self.awaiting_quiet:
                self.detection = Episode("detection", None, ts, ts, g, g, ts, latest=float(g))
            return
        d.lo, d.hi, d.t1 = min(d.lo, g), max(d.hi, g), max(d.t1, ts)

    def _gather(self, d: Episode, ts: float, gap: float, peaks: np.ndarray, rm: np.ndarray, rs: np.ndarray, move: np.ndarray, active: tuple[int, ...], verdict: str | None) -> None:
        step = min(max(ts - d.seen, 0.0), gap)
        d.seen = ts
        strong = self.support >= self.c.gate_on
        d.raw = np.where(strong, np.maximum(d.raw, move), d.raw)
        mass = np.where(strong, peaks, 0.0)
        if mass.sum() > 0:
            d.latest = float(mass @ GATE / mass.sum())
            d.first = d.latest if d.first is None else d.first
        d.moment += d.latest * step
        still = np.maximum(rs, 0.0).sum() > np.maximum(rm, 0.0).sum()
        d.gather(step, float(peaks.max()), bool(still), bool(active), self.occupied, verdict, self.edge)

    def _close_all(self) -> list[dict]:
        out = [self.gates[g].row() for g in sorted(self.gates)] + ([self.detection.row()] if self.detection else [])
        self.gates, self.detection, self.awaiting_quiet = {}, None, False
        return out

    def _learn(self, ts: float, move: np.ndarray, still: np.ndarray) -> None:
        """The frame goes into all that is learned, whatever the detector says; it counts from the next frame on."""
        b = self.baseline
        b.add(ts, np.concatenate([move, still]))
        if "in_room_gates" in self.on:
            self.in_room.observe(ts, move, still, b.floor[GATES:], b.spread[GATES:], b.trusted)
            self.watched = self.in_room.watched(ts)
        if "arrival_bar" in self.on:
            self.bar.observe(ts, move, b.floor[:GATES] + self.c.k * b.spread[:GATES] if b.ready else None)
            self.anchor.bar = self.c.anchor_bar if self.bar.bar is None else self.bar.bar

    # -- the step --------------------------------------------------------------

    def step(self, ts: float, mono: float, move, still, device_occ: bool) -> tuple[dict, list[dict]]:
        """The row after this frame and the episodes that closed with it."""
        c = self.c
        move, still = np.asarray(move, float), np.asarray(still, float)
        dt, restarted = None if self.mono is None else mono - self.mono, False
        if dt is not None and dt < 0:  # the process restarted: what was timed by the old clock starts over
            restarted = True
            self.deadline = None if self.deadline is None else mono + c.hold_s
            self.freeze = None if self.freeze is None else mono + c.freeze_hold_s
            for part in (self.arming, self.nearest, self.change):
                part.rebase()
        alpha = 1.0 if dt is None or c.support_tau_s <= 0 else 1.0 - math.exp(-max(dt, 0.0) / c.support_tau_s)
        if "retention" in self.on:
            self.retention.observe(None if restarted else dt, still)
        self.mono = mono
        if not self.baseline.ready:
            self.support -= alpha * self.support
            self.occupied, self.measured, self.deadline, self.freeze = bool(device_occ), False, None, None
            self._learn(ts, move, still)
            return self._row(ts, 0.0, (), 0.5, None, False, False), []
        residual = (np.concatenate([move, still]) - self.baseline.floor) / self.baseline.spread
        rm, rs = residual[:GATES], residual[GATES:]
        peaks = np.maximum(0.0, np.maximum(rm, rs))
        self.support += alpha * (peaks - self.support)
        free, scored = np.zeros(GATES, bool), "run_score" in self.on
        score, active = self._score(peaks, free if self.occupied else self._barred()) if scored else (0.0, ())
        activity = bool(active or self.gates)
        lead = next((run[0] for run in self._runs(rm, free)), None) if scored else None
        if not activity:
            self.edge = None
        if lead is not None:
            self.edge = lead if self.edge is None else min(self.edge, lead)
        if self.occupied or not activity:
            self.candidate, self.arrivals = 0.0, 0
        if active:
            g = list(active)
            self.candidate = max(self.candidate, float((move + still)[g].max()))
            self.arrivals += int(move[g].max() >= c.arrival_frac * self.baseline.ceiling)
        floor, spread = self.baseline.floor[GATES:], self.baseline.spread[GATES:]
        anchored = "motion_anchor" in self.on and self.anchor.observe(mono, move, still, floor, spread)
        if "nearest_gate_release" in self.on:
            self.nearest.observe(mono, still)
        if "changepoint_release" in self.on:
            self.change.observe(mono, still, floor, spread, self.anchor.admitted, self.occupied)
        if "crossing_arming" in self.on:
            self.arming.see(mono, lead, self.owned is not None)
        if not self.measured and self.occupied:  # a carried-over occupancy had no entry
            self._enter_releases(mono)
        self.measured = True
        verdict = self._verdict(anchored) if not self.occupied and active else None
        self._advance(mono, score, active, verdict)
        closed = self._episodes(ts, peaks, rm, rs, move, active, verdict)
        for e in closed:
            self.classes.closed(e)
        self.classes.tick(ts, {g: e.t0 for g, e in self.gates.items()})
        frozen = self.occupied or (self.freeze is not None and mono < self.freeze)
        self._learn(ts, move, still)
        self.ts = ts
        slope = 4.0 / c.enter_score if c.enter_score > 0 else 4.0
        confidence = 1.0 / (1.0 + math.exp(-max(min(slope * (score - c.enter_score), 700.0), -700.0)))
        return self._row(ts, score, active, confidence, verdict, anchored, frozen), closed

    def _row(self, ts: float, score: float, active: tuple[int, ...], confidence: float, verdict: str | None, anchored: bool, frozen: bool) -> dict:
        kinds = ["out" if o else k if "dwell_class" in self.on else "unknown" for k, o in zip(self.classes.kind, self._outside(), strict=True)]
        return {
            "ts": ts, "occupied": self.occupied, "confidence": confidence, "score": score, "active_gates": list(active),
            "rejection": verdict, "leading_gate": self.edge if self.measured else None, "anchored": anchored, "frozen": frozen,
            "baseline_ready": self.measured, "gate_classes": "".join(LETTERS[k] for k in kinds),
            "boundary_gate": self.classes.boundary if "energy_ceiling" in self.on else None,
            "retention_max": self.retention.level(self.owned) if "retention" in self.on else 0.0, "owned": sorted(self.owned) if self.owned else [],
        }

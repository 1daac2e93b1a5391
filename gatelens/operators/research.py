"""Holds and estimators from offline research, as steps for ordered folds. None is a default.

All look at the still channel of the watched gates, from the third on. A gap
between frames, or time that goes back, makes them forget what they refer to.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from itertools import pairwise

import numpy as np

from gatelens.plans.config import GATES

from .automaton import Anchor

FIRST = 2
GAP = 0.55
#: Seconds before a frame that count as before an entry.
BEFORE = (0.5, 2.5)
SHARE = 0.2


def balanced(move: np.ndarray, still: np.ndarray, bar: float = 40.0, share: float = 1 / 3) -> np.ndarray:
    """Gates from the first watched one on whose motion reaches the bar and is enough of the whole."""
    m, s = move[..., FIRST:], still[..., FIRST:]
    return (m >= bar) & (m / np.maximum(m + s, 1) >= share)


def kurtosis(x: np.ndarray) -> float | None:
    """The fourth standardised moment; None of a flat profile."""
    d = x - x.mean()
    var = float((d**2).mean())
    return float((d**4).mean()) / var**2 if math.sqrt(var) > 1e-9 else None


def standard(x: np.ndarray) -> np.ndarray:
    """Mean zero and variance one; zeros of a flat profile."""
    sd = float(x.std())
    return (x - x.mean()) / sd if sd > 1e-9 else np.zeros(len(x))


def standards(rows: np.ndarray) -> np.ndarray:
    """standard of every row."""
    sd = rows.std(axis=1, keepdims=True)
    varies = sd > 1e-9
    return np.where(varies, (rows - rows.mean(axis=1, keepdims=True)) / np.where(varies, sd, 1.0), 0.0)


class Profiles:
    """How often each distinct profile occurs. What is asked costs by the distinct ones, however many frames there are."""

    EMPTY = 64  # so many places may be empty, or half of all, before they are given up

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.values, self.counts = np.empty((0, 0)), np.zeros(0, np.int64)
        self.n = self.empty = 0
        self.order: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.places)

    def add(self, key: bytes, value: np.ndarray, times: int = 1) -> None:
        """Once more, or so many times, the profile of that key; equal keys have equal values."""
        at = self.places.get(key)
        if at is None:
            if self.empty > max(self.EMPTY, len(self.places) // 2):
                self._give_up()
            at = self.places[key] = len(self.places)
            if at == len(self.counts):
                self.values = np.concatenate([self.values.reshape(at, len(value)), np.zeros((at + 8, len(value)))])
                self.counts = np.concatenate([self.counts, np.zeros(at + 8, np.int64)])
            self.values[at], self.order = value, None
        elif not self.counts[at]:
            self.empty -= 1
        self.counts[at] += times
        self.n += times

    def remove(self, key: bytes) -> None:
        at = self.places[key]
        self.counts[at] -= 1
        self.n -= 1
        self.empty += not self.counts[at]

    def _give_up(self) -> None:
        keep = np.flatnonzero(self.counts[: len(self.places)])
        held = set(keep.tolist())
        self.places = {k: i for i, k in enumerate(k for k, at in self.places.items() if at in held)}
        self.values, self.counts, self.empty, self.order = self.values[keep], self.counts[keep], 0, None

    def ranks(self, *ks: int) -> list[np.ndarray]:
        """Each column's values of these ranks, from zero on."""
        d = len(self.places)
        if self.order is None:
            self.order = np.argsort(self.values[:d], axis=0)
            self.sorted = np.take_along_axis(self.values[:d], self.order, axis=0)
        cum, columns = np.cumsum(self.counts[self.order], axis=0), np.arange(self.values.shape[1])
        return [self.sorted[(cum <= k).sum(axis=0), columns] for k in ks]

    def median(self) -> np.ndarray:
        low, high = self.ranks((self.n - 1) // 2, self.n // 2)
        return (low + high) / 2


class Window:
    """The frames from some time before the present to a later one, as counts of their distinct profiles."""

    def __init__(self, begin: float, end: float = 0.0):
        self.begin, self.end, self.profiles = begin, end, Profiles()
        self.clear()

    def clear(self) -> None:
        self.waiting: deque = deque()
        self.inside: deque = deque()
        self.now = -math.inf
        self.profiles.clear()

    def add(self, ts: float, key: bytes, value: np.ndarray) -> None:
        self.waiting.append((ts, key, value))
        if len(self.waiting) > 1 and ts < self.waiting[-2][0]:
            self.waiting = deque(sorted(self.waiting, key=lambda x: x[0]))

    def move(self, ts: float) -> Profiles:
        """What lies in the window at that time."""
        if ts < self.now:  # time goes back: what was in it may not be there yet
            self.waiting = deque(sorted([*self.inside, *self.waiting], key=lambda x: x[0]))
            self.inside.clear()
            self.profiles.clear()
        self.now = ts
        while self.waiting and self.waiting[0][0] <= ts - self.end:
            frame = self.waiting.popleft()
            self.inside.append(frame)
            self.profiles.add(*frame[1:])
        while self.inside and self.inside[0][0] < ts - self.begin:
            self.profiles.remove(self.inside.popleft()[1])
        return self.profiles


class Crowd:
    """The frames of the last seconds as numbers of their distinct profiles, for windows that many frames ask for at once."""

    CELLS = 1 << 20  # so many counts are held at a time

    def __init__(self, seconds: float):
        self.seconds, self.ts, self.codes, self.rows = seconds, np.zeros(0), np.zeros(0, np.int64), np.zeros((0, GATES - FIRST))

    def add(self, ts: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Takes frames in order of time, none before those it has, and gives their numbers; what no window of theirs reaches is left out."""
        keep = int(np.searchsorted(self.ts, ts[0] - self.seconds))
        used, old = np.unique(self.codes[keep:], return_inverse=True)
        every = np.concatenate([self.rows[used], now])
        _, first, numbers = np.unique(every.view(f"V{every.itemsize * every.shape[1]}")[:, 0], return_index=True, return_inverse=True)
        self.rows, self.ts = every[first], np.concatenate([self.ts[keep:], ts])
        self.codes = np.concatenate([numbers[old], numbers[len(used) :]])
        return self.codes[len(old) :]

    def span(self, at: np.ndarray, begin: float, end: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The first frame of each time's window, and the one after its last."""
        return np.searchsorted(self.ts, at - begin), np.searchsorted(self.ts, at - end, side="right")

    def parts(self, n: int) -> list[tuple[int, int]]:
        """n windows in parts whose counts can be held."""
        size = max(1, self.CELLS // len(self.rows))
        return [(a, min(a + size, n)) for a in range(0, n, size)]

    def counts(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How often each distinct profile occurs in each window; these come in order."""
        shape = len(low), len(self.rows)
        frames = np.arange(low[0], high[-1])
        codes, come, go = self.codes[frames], np.searchsorted(high, frames, side="right"), np.searchsorted(low, frames, side="right")
        left = go < len(low)
        change = np.bincount(come * shape[1] + codes, minlength=shape[0] * shape[1]) - np.bincount(go[left] * shape[1] + codes[left], minlength=shape[0] * shape[1])
        return np.cumsum(change.reshape(shape), axis=0)

    def medians(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each window, which has frames, each column's median; values has a row a distinct profile."""
        out, order = np.empty((len(low), values.shape[1])), np.argsort(values, axis=0)
        for a, b in self.parts(len(low)):
            counts, n = self.counts(low[a:b], high[a:b]), (high - low)[a:b]
            for c in range(values.shape[1]):
                out[a:b, c] = middles(np.broadcast_to(values[order[:, c], c], counts.shape), counts[:, order[:, c]], n)
        return out


def middles(values: np.ndarray, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The median of each row's n values, which are in order and occur so often."""
    cum, rows = np.cumsum(counts, axis=1), np.arange(len(values))
    low, high = (values[rows, (cum <= k[:, None]).sum(axis=1)] for k in ((n - 1) // 2, n // 2))
    return (low + high) / 2


class Footprint:
    """The first form of the anchored footprint: an excess over a slow mean, which stands still while a footprint lives.

    projection: the least-squares share of the footprint that is left, with one
    level to come on and another to stay; a footprint that is lost is forgotten.
    shape and amplitude: the angle to the footprint, or the excess' size against
    it, and some size at least; the footprint stays until a gap.
    """

    FORMS = ("projection", "shape", "amplitude")

    def __init__(self, form: str = "projection", on: float = 0.4, off: float = 0.4, tau: float = 15.0, bar: float = 40.0, guard: float = 1.0):
        if form not in self.FORMS:
            raise ValueError(f"no footprint form named {form!r}")
        self.form, self.on, self.off, self.tau, self.bar, self.guard = form, on, off, tau, bar, guard
        self.ground = self.ref = self.last = None
        self.active = False

    def step(self, ts: float, move: np.ndarray, still: np.ndarray) -> tuple[bool, float]:
        m, s = move[FIRST:], still[FIRST:]
        dt = 0.0 if self.last is None else max(0.0, ts - self.last)
        self.last = ts
        if self.ground is None or dt > GAP:
            self.ground, self.ref = s.copy(), None
        excess = np.maximum(s - self.ground, 0.0)
        new = excess * (m / max(float(m.max()), 1.0))
        if m.max() >= self.bar and new @ new >= 1.0 and (self.ref is None or new @ new > self.ref @ self.ref):
            self.ref = new
        value, was, self.active = 0.0, self.active, False
        if self.ref is not None:
            size, whole = float(np.linalg.norm(excess)), float(np.linalg.norm(self.ref))
            if self.form == "projection":
                value = float(excess @ self.ref / (self.ref @ self.ref))
                self.active = value >= (self.off if was else self.on)
                self.ref = self.ref if self.active else None
            else:
                shape = float(excess @ self.ref) / (size * whole) if size > 0 else 0.0
                value = shape if self.form == "shape" else size / whole
                self.active = size >= self.guard and value >= self.on
        if self.ref is None:
            self.ground = self.ground + (1 - math.exp(-dt / self.tau)) * (s - self.ground)
        return self.active, value


class GuardedAnchor(Anchor):
    """An anchor whose first footprint needs more than strong balanced motion.

    confirmed: frames in a row at the bar, fewer the stronger the motion is.
    gates: that many different balanced gates within some time.
    """

    STRONG = ((80.0, 1), (60.0, 2), (40.0, 3))

    def __init__(self, bar: float = 40.0, confirmed: bool = False, gates: int = 1, within: float = 0.3):
        super().__init__(bar)
        self.confirmed, self.need, self.within = confirmed, gates, within
        self.run, self.seen, self.lit, self.ahead = 0, deque(), np.zeros(GATES - FIRST, int), 0

    def meet(self, ts: float, frames: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """All frames of one time, before each is observed: they corroborate each other."""
        self.ahead = len(frames)
        for move, still in frames:
            self._see(ts, move, still)

    def _see(self, ts: float, move: np.ndarray, still: np.ndarray) -> None:
        if self.need < 2:
            return
        self.seen.append((ts, balanced(move, still)))
        self.lit += self.seen[-1][1]
        while self.seen[0][0] < ts - self.within:
            self.lit -= self.seen.popleft()[1]

    def observe(self, ts: float, move: np.ndarray, still: np.ndarray, floor: np.ndarray, spread: np.ndarray) -> bool:
        if self.ahead:
            self.ahead -= 1
        else:
            self._see(ts, move, still)
        steady = self.last is None or 0 <= ts - self.last <= self.GAP
        living = self.template is not None and steady
        top = float(move[FIRST:].max())
        self.run = 0 if living or top < self.STRONG[-1][0] else (self.run + 1 if steady else 1)
        may = not self.confirmed or any(top >= bar and self.run >= n for bar, n in self.STRONG)
        may &= self.need < 2 or np.count_nonzero(self.lit) >= self.need
        bar = self.bar
        self.bar = bar if living or may else math.inf
        got = super().observe(ts, move, still, floor, spread)
        self.bar = bar
        self.run = 0 if got else self.run
        return got


class Hold:
    """Something that goes on holding after the anchor has let it begin; step gives whether it holds, and a value.

    Windows of time are counted as frames come and go, not gone over anew. All
    frames of one time are in them before any of these is judged. A hold that
    has a crowd can take many times at once, until a frame comes by itself.
    """

    crowd: Crowd | None = None

    def __init__(self, floor: np.ndarray, spread: np.ndarray, anchor: Anchor | None = None):
        self.floor, self.spread, self.anchor = floor, spread, anchor or Anchor(40.0)
        self.last: float | None = None
        self.entry = Window(BEFORE[1], BEFORE[0])
        self.forget()

    def forget(self) -> None:
        """What a gap makes it lose."""

    def step(self, ts: float, move: np.ndarray, still: np.ndarray) -> tuple[bool, float]:
        return self.steps(ts, [(move, still)])[0]

    def steps(self, ts: float, frames: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[bool, float]]:
        """The results of all frames of one time."""
        if self.crowd is not None:
            self.scatter()
        if self.last is not None and not 0 <= ts - self.last <= GAP:
            self.forget()
        self.last = ts
        if isinstance(self.anchor, GuardedAnchor):
            self.anchor.meet(ts, frames)
        for _, still in frames:
            self.arrive(ts, still[FIRST:])
        out = []
        for move, still in frames:
            anchored = self.anchor.observe(ts, move, still, self.floor, self.spread)
            out.append(self.update(ts, still[FIRST:], anchored, bool(balanced(move, still).any())))
        return out

    def many(self, ts: np.ndarray, move: np.ndarray, still: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """steps of every time in turn; a time's frames all come in one call."""
        if not len(ts):
            return np.zeros(0, bool), np.zeros(0)
        if self.crowd is not None and type(self.anchor) is Anchor and np.isfinite(ts).all() and (np.diff(ts, prepend=ts[0] if self.last is None else self.last) >= 0).all():
            anchored, templates = self.anchor.observe_many(ts, move, still, self.floor, self.spread)
            got = self.update_many(ts, self.crowd.add(ts, still[:, FIRST:]), anchored, templates, balanced(move, still).any(axis=1))
            self.last = float(ts[-1])
            return got
        cuts = [0, *(np.flatnonzero(ts[1:] != ts[:-1]) + 1).tolist(), len(ts)]
        out = [x for a, b in pairwise(cuts) for x in self.steps(float(ts[a]), list(zip(move[a:b], still[a:b], strict=True)))]
        return np.array([h for h, _ in out], bool), np.array([v for _, v in out], float)

    def update_many(self, ts: np.ndarray, codes: np.ndarray, anchored: np.ndarray, templates: list, moving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What update gives of each frame; codes are their profiles' numbers in the crowd."""
        raise NotImplementedError

    def scatter(self) -> None:
        """Puts the crowd's frames into the windows that go frame by frame."""
        crowd, self.crowd = self.crowd, None
        for ts, code in zip(crowd.ts.tolist(), crowd.codes.tolist(), strict=True):
            self.arrive(ts, crowd.rows[code])

    def arrive(self, ts: float, now: np.ndarray) -> None:
        """A frame enters what windows there are."""

    def update(self, ts: float, now: np.ndarray, anchored: bool, moving: bool) -> tuple[bool, float]:
        return anchored, self.anchor.score

    def before(self, ts: float) -> np.ndarray | None:
        """The median of the frames just before, or None."""
        found = self.entry.move(ts)
        return found.median() if found.n else None


class BandHold(Hold):
    """Residuals within the anchor's band of gates, widened by a gate, keep a share of their sum at the beginning."""

    HALO, KEEP = 1, 0.4

    def forget(self) -> None:
        self.band = None

    def update(self, ts, now, anchored, moving):
        residual = np.maximum((now - self.floor[FIRST:]) / self.spread[FIRST:], 0.0)
        if self.band is not None:
            share = float(residual[self.band].sum()) / self.whole
            if share >= self.KEEP:
                return True, share
            self.band = None
        if not (anchored and moving):
            return False, 0.0
        band = self.anchor.template >= SHARE * self.anchor.template.max()
        for _ in range(self.HALO):
            band = band | np.append(False, band[:-1]) | np.append(band[1:], False)
        whole = float(residual[band].sum())
        if whole <= 0:
            return False, 0.0
        self.band, self.whole = band, whole
        return True, 1.0


class ChangeHold(Hold):
    """The raw excess over the time before the entry keeps a share of what it was at the entry."""

    KEEP = 0.4

    def forget(self) -> None:
        self.entry.clear()
        self.band = None

    def arrive(self, ts, now):
        self.entry.add(ts, now.tobytes(), now)
        self.entry.move(ts)

    def update(self, ts, now, anchored, moving):
        share = 0.0
        if self.band is not None:
            share = float(np.maximum(now - self.base, 0.0)[self.band].sum()) / self.whole
            if share >= self.KEEP:
                return True, share
            self.band = None
        if anchored and moving and (base := self.before(ts)) is not None:
            gain = np.maximum(now - base, 0.0)
            if gain.max() > 0:
                self.base, self.band = base, gain >= SHARE * gain.max()
                self.whole, share = float(gain[self.band].sum()), 1.0
        return self.band is not None, share


class ContinuityHold(Hold):
    """A low percentile, over some seconds, of each gate's excess over the time before the entry, against that at the entry."""

    KEEP, WINDOW, LOW = 0.4, 3.0, 0.2

    def __init__(self, floor, spread, anchor: Anchor | None = None):
        self.lately = Window(self.WINDOW)
        super().__init__(floor, spread, anchor)

    def forget(self) -> None:
        self.entry.clear()
        self.lately.clear()
        self.band = None

    def arrive(self, ts, now):
        for window in (self.entry, self.lately):
            window.add(ts, now.tobytes(), now)
            window.move(ts)

    def low(self, ts: float) -> np.ndarray:
        """The percentile, linear between two frames' excesses; these are in the order of the energies."""
        found = self.lately.move(ts)
        at = self.LOW * (found.n - 1)
        a, b = (np.maximum(x - self.base, 0.0) for x in found.ranks(int(at), min(int(at) + 1, found.n - 1)))
        part = at - int(at)
        return a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part)

    def update(self, ts, now, anchored, moving):
        if self.band is not None:
            if ts - self.began < self.WINDOW:
                return True, 0.0
            share = float(np.minimum(self.low(ts)[self.band], self.gain[self.band]).sum() / self.gain[self.band].sum())
            return share >= self.KEEP, share
        if not (anchored and moving) or (base := self.before(ts)) is None:
            return False, 0.0
        gain = np.maximum(now - base, 0.0)
        if gain.max() <= 0:
            return False, 0.0
        self.base, self.gain, self.band, self.began = base, gain, gain >= SHARE * gain.max(), ts
        return True, 0.0


class SettledHold(Hold):
    """After a while, the angle to the footprint that settled between half a minute and a minute, and some of its size.

    Until there is such a footprint the anchor decides.
    """

    LEAST = 1.0

    def __init__(self, floor, spread, angle: float = 0.9, size: float = 0.2, rows: int = 100, settling: tuple[float, float] = (30.0, 60.0)):
        self.angle, self.size, self.rows, self.settling = angle, size, rows, settling
        self.crowd = Crowd(BEFORE[1])
        super().__init__(floor, spread)

    def forget(self) -> None:
        self.began, self.base, self.training, self.settled = None, None, Profiles(), None

    def arrive(self, ts, now):
        self.entry.add(ts, now.tobytes(), now)
        self.entry.move(ts)

    def update(self, ts, now, anchored, moving):
        if self.began is None:
            if anchored and (base := self.before(ts)) is not None:
                self.began, self.base = ts, base
            return anchored, 0.0
        age, gain = ts - self.began, np.maximum(now - self.base, 0.0)
        if self.settling[0] <= age < self.settling[1]:
            self.training.add(now.tobytes(), gain)
        if age >= self.settling[1]:
            self.settle()
        if age < self.settling[1] or self.settled is None:
            return anchored, 0.0
        size, whole = float(np.linalg.norm(gain)), float(np.linalg.norm(self.settled))
        cosine = float(gain @ self.settled) / max(size * whole, 1e-9)
        return cosine >= self.angle and size >= self.size * whole, cosine

    def settle(self) -> None:
        if self.settled is None and self.training.n >= self.rows:
            middle = self.training.median()
            self.settled = middle if np.linalg.norm(middle) >= self.LEAST else None
            self.training.clear()

    def update_many(self, ts, codes, anchored, templates, moving):
        value, holding = np.zeros(len(ts)), anchored.copy()
        gaps = set(np.flatnonzero(np.diff(ts, prepend=ts[0] if self.last is None else self.last) > GAP).tolist())
        for a, b in pairwise(sorted({0, *gaps, len(ts)})):
            if a in gaps:
                self.forget()
            if self.began is None:
                low, high = self.crowd.span(ts[a:b], *BEFORE[::-1])
                begins = np.flatnonzero(anchored[a:b] & (high > low))
                if not len(begins):
                    continue
                k = begins[0]
                before = np.sort(self.crowd.rows[self.crowd.codes[low[k] : high[k]]], axis=0)
                self.began, self.base = float(ts[a + k]), (before[(len(before) - 1) // 2] + before[len(before) // 2]) / 2
                a += k + 1
            used, of = np.unique(codes[a:b], return_inverse=True)
            age, gain = ts[a:b] - self.began, np.maximum(self.crowd.rows[used] - self.base, 0.0)
            learns, ripe = (self.settling[0] <= age) & (age < self.settling[1]), age >= self.settling[1]
            for k, times in zip(*np.unique(of[learns], return_counts=True), strict=True):
                self.training.add(self.crowd.rows[used[k]].tobytes(), gain[k], int(times))
            if ripe.any():
                self.settle()
            if self.settled is not None:
                size, whole = np.sqrt(np.vecdot(gain, gain)), float(np.linalg.norm(self.settled))
                cosine = np.vecdot(gain, self.settled) / np.maximum(size * whole, 1e-9)
                holds = (cosine >= self.angle) & (size >= self.size * whole)
                holding[a:b][ripe], value[a:b][ripe] = holds[of[ripe]], cosine[of[ripe]]
        return holding, value


class KurtosisHold(Hold):
    """Beside the anchor, a profile as flat as a person's: its kurtosis, or its median over a window that is full, is low."""

    def __init__(self, floor, spread, most: float = 4.0, window: float = 0.0):
        self.most, self.window = most, window
        self.recent: deque = deque()
        self.ordered: list[float] = []
        self.arrived: deque = deque()  # of the frames that are still to be judged
        super().__init__(floor, spread)

    def arrive(self, ts, now):
        k = kurtosis(now)
        self.arrived.append(k)
        if k is not None:
            self.recent.append((ts, k))
            insort(self.ordered, k)
        while self.recent and self.recent[0][0] < ts - self.window:
            del self.ordered[bisect_left(self.ordered, self.recent.popleft()[1])]

    def update(self, ts, now, anchored, moving):
        k = self.arrived.popleft()
        if k is None:
            return anchored, 0.0
        if self.window and ts - self.recent[0][0] < 0.9 * self.window:
            return anchored, k
        n = len(self.ordered)
        middle = (self.ordered[(n - 1) // 2] + self.ordered[n // 2]) / 2
        return anchored or middle <= self.most, middle


class ShapeBank(Hold):
    """Profiles some seconds after each change of the footprint are kept; a window is reviewed by its best likeness to any of them.

    Likeness is Pearson's correlation, of each profile of the window with the
    most alike prototype; the window's median must reach the level. With
    contrast, the prototype is the change from before the motion to after it,
    and likeness is how much of that change the profile shows.
    """

    DELAY, LEAST = 2.0, 0.05

    def __init__(self, floor, spread, level: float, size: int = 64, window: float = 30.0, contrast: bool = False):
        self.level, self.contrast = level, contrast
        self.bank: deque = deque(maxlen=size)
        self.pending: deque = deque()
        self.template: np.ndarray | None = None
        self.review, self.earlier = Window(window), Window(BEFORE[1], 0.3)
        self.known: np.ndarray | None = None
        self.order: np.ndarray | None = None
        self.crowd = Crowd(max(window, BEFORE[1]))
        super().__init__(floor, spread)

    def arrive(self, ts, now):
        key, profile = now.tobytes(), standard(now)
        for window in (self.review, self.earlier) if self.contrast else (self.review,):
            window.add(ts, key, profile)
            window.move(ts)

    def update(self, ts, now, anchored, moving):
        new = self.anchor.template
        if moving and new is not None and (self.template is None or new is not self.template and not np.array_equal(new, self.template)):
            before = self.earlier.move(ts) if self.contrast else None
            if before is None or before.n >= 3:
                self.pending.append((ts + self.DELAY, before and before.median()))
        self.template = new
        while self.pending and self.pending[0][0] <= ts:
            base = self.pending.popleft()[1]
            change = standard(now) - (0.0 if base is None else base)
            if not self.contrast or change @ change >= self.LEAST:
                self.bank.append((0.0 if base is None else base, change, float(change @ change) if self.contrast else float(len(change))))
                self.order = None
        if not len(self.bank):
            return False, 0.0
        value = self._median(self.review.move(ts))
        return value >= self.level, value

    def update_many(self, ts, codes, anchored, templates, moving):
        profiles, known = standards(self.crowd.rows), len(self.bank)
        at, bases = ts[self._changes(templates, moving)], None
        if self.contrast:
            low, high = self.crowd.span(at, BEFORE[1], 0.3)
            enough = high - low >= 3
            at, bases = at[enough], self.crowd.medians(profiles, low[enough], high[enough])
        self.pending.extend(zip((at + self.DELAY).tolist(), [None] * len(at) if bases is None else bases, strict=True))
        due = []
        while self.pending and self.pending[0][0] <= ts[-1]:
            due.append(self.pending.popleft())
        entered = np.searchsorted(ts, [t for t, _ in due])
        shape = profiles[codes[entered]]
        base = np.array([b for _, b in due]).reshape(shape.shape) if self.contrast else np.zeros_like(shape)
        change = shape - base
        size = np.vecdot(change, change) if self.contrast else np.full(len(due), float(profiles.shape[1]))
        taken = size >= self.LEAST if self.contrast else np.ones(len(due), bool)
        was, most = [(b + np.zeros(shape.shape[1]), c, n) for b, c, n in self.bank], self.bank.maxlen
        base, change, size = (np.concatenate([np.array([x[i] for x in was]).reshape(known, *new.shape[1:]), new[taken]]) for i, new in enumerate((base, change, size)))
        self.bank.extend(zip(base[known:][-most:], change[known:][-most:], size[known:][-most:].tolist(), strict=True))
        self.order = None
        if not len(size):
            return np.zeros(len(ts), bool), np.zeros(len(ts))
        reach = known + np.searchsorted(entered[taken], np.arange(len(ts)), side="right")
        value = np.where(reach > 0, self._medians(ts, profiles, (base, change, size), reach), 0.0)
        return (reach > 0) & (value >= self.level), value

    def _changes(self, templates: list, moving: np.ndarray) -> list[int]:
        """The moving frames that have another footprint than the frame before."""
        found, was = [], self.template
        for k, (new, moves) in enumerate(zip(templates, moving.tolist(), strict=True)):
            if moves and new is not None and new is not was:
                found.append((k, new, np.full(len(new), np.nan) if was is None else was))
            was = new
        self.template = was
        if not found:
            return []
        other = (np.array([new for _, new, _ in found]) != np.array([was for _, _, was in found])).any(axis=1)
        return [k for (k, *_), differs in zip(found, other.tolist(), strict=True) if differs]

    def _medians(self, ts: np.ndarray, profiles: np.ndarray, bank: tuple[np.ndarray, ...], reach: np.ndarray) -> np.ndarray:
        """_median at each of these times, where so many of the bank's profiles had come; bank has their bases, changes and sizes."""
        new = np.append(True, (ts[1:] != ts[:-1]) | (reach[1:] != reach[:-1]))
        low, high = self.crowd.span(ts[new], self.review.begin)
        (base, change, size), out = bank, np.empty(len(low))
        level = np.vecdot(base, change)[:, None]
        for a, b in self.crowd.parts(len(low)):
            banks, of = np.unique(reach[new][a:b], return_inverse=True)
            best = np.full((len(banks), len(profiles)), -np.inf)
            for back in range(1, min(self.bank.maxlen, len(size)) + 1):
                k = np.maximum(banks - back, 0)
                like = (change[k] @ profiles.T - level[k]) / size[k, None]
                best = np.where((banks >= back)[:, None], np.maximum(best, like), best)
            order = np.argsort(best, axis=1)
            best, counts = np.take_along_axis(best, order, axis=1), self.crowd.counts(low[a:b], high[a:b])
            out[a:b] = middles(best[of], np.take_along_axis(counts, order[of], axis=1), (high - low)[a:b])
        return out[np.cumsum(new) - 1]

    def _median(self, frames: Profiles) -> float:
        """The median over the window's frames of each one's best likeness, which distinct profiles and the bank decide."""
        if self.order is None or self.known is not frames.order or frames.order is None:
            if frames.order is None:
                frames.ranks()
            rows = frames.values[: len(frames)]
            best = np.max([(rows - base) @ change / size for base, change, size in self.bank], axis=0)
            self.order, self.known = np.argsort(best), frames.order
            self.best = best[self.order]
        cum = np.cumsum(frames.counts[self.order])
        low, high = self.best[np.searchsorted(cum, [(frames.n - 1) // 2, frames.n // 2], side="right")]
        return float((low + high) / 2)


class Ratio:
    """Slow and fast means of a level over its frame-to-frame noise: signed, unsigned, or set back where the far side is crossed."""

    def __init__(self, signed: bool = True, reset_s: float = 0.0, fast: float = 2.0, slow: float = 60.0, noise: float = 10.0):
        self.signed, self.reset_s, self.taus = signed, reset_s, (fast, slow, noise)
        self.fast = self.slow = self.last = None
        self.noise, self.clamped = 0.0, -math.inf

    def step(self, ts: float, dt: float, x: float, crossing: bool = False) -> float:
        if self.fast is None:
            self.fast = self.slow = self.last = x
        a, b, c = (1 - math.exp(-min(max(dt, 0.0), 2.0) / t) for t in self.taus)
        self.noise += c * (abs(x - self.last) - self.noise)
        self.fast += a * (x - self.fast)
        self.slow += b * (x - self.slow)
        self.last = x
        if crossing and self.reset_s:
            self.clamped = ts + self.reset_s
        r = (self.fast - self.slow) / max(self.noise, 0.1)
        return 0.0 if ts < self.clamped else (r if self.signed else abs(r))


class CoupledChanges:
    """Correlation of motion's and the still channel's steps on a regular grid, weighted to the present, the median over gates.

    Frames are interpolated onto the grid; a gap leaves its points out. A gate
    counts if both its steps vary enough. There is no value before the horizon
    has passed, nor where too few points lie in it.
    """

    LEAST = 10

    def __init__(self, grid: float = 0.1, horizon: float = 5.0, tau: float = 2.0, vary: tuple[float, float] = (0.5, 0.5)):
        self.grid, self.points, self.tau, self.vary = grid, round(horizon / grid), tau, vary
        self.steps: deque = deque(maxlen=self.points + 1)  # of grid points: number, steps of both channels or None
        self.next, self.start, self.last, self.point = 0, None, None, None

    def step(self, ts: float, move: np.ndarray, still: np.ndarray) -> float | None:
        """The value at the last grid point up to this frame."""
        now = np.concatenate([move[FIRST:], still[FIRST:]])
        if self.start is None:
            self.start, self.last = ts, (ts, now)
        (t0, x0), self.last = self.last, (ts, now)
        while self.start + self.next * self.grid <= ts + 1e-9:
            q, point = self.start + self.next * self.grid, None
            if ts > t0 and ts - t0 <= GAP:
                point = x0 + (now - x0) * ((q - t0) / (ts - t0))
            elif ts == t0 == q:
                point = now
            self.steps.append(None if point is None or self.point is None else point - self.point)
            self.point = point
            self.next += 1
        return self.value()

    def value(self) -> float | None:
        if self.next <= self.points or not self.steps or self.steps[-1] is None:
            return None
        ages = np.array([k for k, x in enumerate(reversed(self.steps)) if x is not None])
        if len(ages) < self.LEAST:
            return None
        x = np.array([s for s in reversed(self.steps) if s is not None])
        w = np.exp(-ages * self.grid / self.tau)
        w /= w.sum()
        x = x - w @ x
        var, n = w @ (x * x), GATES - FIRST
        a, b = np.sqrt(var[:n]), np.sqrt(var[n:])
        ok = (a >= self.vary[0]) & (b >= self.vary[1])
        return float(np.median((w @ (x[:, :n] * x[:, n:]))[ok] / (a * b)[ok])) if ok.any() else None

"""Small models in numpy for grouped data: mixtures, hidden states, factors, envelopes."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def nmf(x: np.ndarray, rank: int, steps: int = 200, seeds: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Multiplicative updates from several starts; the factors with the least squared error."""
    best = None
    for seed in range(seeds):
        rng = np.random.default_rng(seed)
        w, h = rng.random((x.shape[0], rank)) + 0.1, rng.random((rank, x.shape[1])) + 0.1
        for _ in range(steps):
            h *= (w.T @ x) / (w.T @ w @ h + 1e-9)
            w *= (x @ h.T) / (w @ h @ h.T + 1e-9)
        error = float(((x - w @ h) ** 2).sum())
        if best is None or error < best[2]:
            best = w, h, error
    return best


def two_state_hmm(x: np.ndarray, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Baum-Welch for two Gaussian states, the higher mean second; posteriors of the second and the Viterbi path."""
    low, high = np.quantile(x, (0.25, 0.75))
    mean, var = np.array([low, max(high, low + 1e-6)]), np.full(2, max(x.var(), 1e-6))
    move, start = np.array([[0.99, 0.01], [0.01, 0.99]]), np.array([0.5, 0.5])

    def density() -> np.ndarray:
        return np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300

    def passes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, c, z = np.empty_like(b), np.empty_like(b), np.empty(len(b))
        for t in range(len(b)):
            a[t] = (start if t == 0 else a[t - 1] @ move) * b[t]
            z[t] = a[t].sum()
            a[t] /= z[t]
        c[-1] = 1
        for t in range(len(b) - 2, -1, -1):
            c[t] = move @ (b[t + 1] * c[t + 1]) / z[t + 1]
        return a, c, z

    for _ in range(steps):
        b = density()
        a, c, z = passes(b)
        g = a * c
        pair = (a[:-1, :, None] * move * (b[1:] * c[1:] / z[1:, None])[:, None, :]).sum(axis=0)
        move = pair / pair.sum(axis=1, keepdims=True)
        start = g[0] / g[0].sum()
        mean = (g * x[:, None]).sum(axis=0) / g.sum(axis=0)
        var = np.maximum((g * (x[:, None] - mean) ** 2).sum(axis=0) / g.sum(axis=0), 1e-6)
    b = density()
    a, c, _ = passes(b)
    post = (a * c) / (a * c).sum(axis=1, keepdims=True)
    score, back = np.log(start) + np.log(b[0]), np.zeros((len(x), 2), int)
    for t in range(1, len(x)):
        step = score[:, None] + np.log(move + 1e-300)
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + np.log(b[t])
    path = np.empty(len(x), int)
    path[-1] = score.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    up = int(mean.argmax())
    return post[:, up], (path == up).astype(int)


def two_mixture_low(x: np.ndarray, steps: int = 50) -> float:
    """The lower mean of two Gaussians fitted by expectation and maximisation."""
    m, v, p = np.quantile(x, (0.25, 0.75)).astype(float), np.full(2, max(x.var(), 1e-3)), np.array([0.5, 0.5])
    for _ in range(steps):
        r = p * np.exp(-0.5 * (x[:, None] - m) ** 2 / v) / np.sqrt(v) + 1e-300
        r /= r.sum(axis=1, keepdims=True)
        n = r.sum(axis=0)
        m, p = (r * x[:, None]).sum(axis=0) / n, n / len(x)
        v = np.maximum((r * (x[:, None] - m) ** 2).sum(axis=0) / n, 1e-3)
    return float(m.min())


def kde_mode(counts: np.ndarray, width: float = 2.0) -> int:
    """The value with the greatest kernel density, from counts of 0..len-1."""
    grid = np.arange(len(counts))
    return int((np.exp(-0.5 * ((grid[:, None] - grid) / width) ** 2) @ counts).argmax())


def envelope(x: np.ndarray, ridge: float = 1e-3, margin: float = 1.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Median centre, inverse covariance and the bound, margin times the 95th percentile of the squared distances."""
    centre = np.median(x, axis=0)
    inverse = np.linalg.inv(np.cov(x, rowvar=False) + ridge * np.eye(x.shape[1]))
    d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
    return centre, inverse, float(margin * np.quantile(d, 0.95))


def greedy_pairs(a: list[tuple[float, float]], b: list[tuple[float, float]], least: float = 5.0, share: float = 0.2) -> list[tuple[int, int]]:
    """(strength, time) rows of a, strongest last, each with the nearest unused row of b within the band; at most once each."""
    out, waiting = [], {}
    for j in sorted(range(len(b)), key=lambda k: (b[k], k), reverse=True):
        waiting.setdefault(b[j][0], []).append(j)  # the earliest last
    strengths = sorted(waiting)
    for i in sorted(range(len(a)), key=lambda k: a[k]):
        band, at = max(least, share * a[i][0]), bisect_left(strengths, a[i][0])
        near = min(strengths[max(at - 1, 0) : at + 1], key=lambda x: (abs(x - a[i][0]), x), default=None)
        if near is not None and abs(near - a[i][0]) <= band:
            out.append((i, waiting[near].pop()))
            if not waiting[near]:
                strengths.remove(near)
    return out


def suppressed_peaks(times: np.ndarray, heights: np.ndarray, apart_s: float = 2.5) -> list[int]:
    """Peaks strongest first, none within apart_s of one taken before."""
    taken, at = [], []  # at: the times taken, sorted
    for k in np.lexsort((times, -heights)):
        i = bisect_left(at, times[k])
        if all(abs(times[k] - t) >= apart_s for t in at[max(i - 1, 0) : i + 1]):
            at.insert(i, times[k])
            taken.append(int(k))
    return sorted(taken)


def turning_points(x: np.ndarray, least: float = 0.9) -> list[int]:
    """Zig-zag extremes: a turn counts once the path has come back by least from the extreme."""
    out, top, way = [0], 0, 0
    for i in range(1, len(x)):
        if way >= 0 and x[i] > x[top] or way <= 0 and x[i] < x[top]:
            way = way or (1 if x[i] > x[top] else -1)
            top = i
        elif way and abs(x[i] - x[top]) >= least:
            out.append(top)
            top, way = i, -way
    return [*out, top] if top != out[-1] else out


def legs(cells: np.ndarray, path: np.ndarray, turns: list[int], net: float = 1.8, least: int = 2, slow: float = 0.075, fast: float = 1.5) -> list[tuple[int, int, float]]:
    """Start, end and displacement of the stretches between turns that go far enough, last long enough and are neither too slow nor too fast, in gates a cell."""
    out = []
    for a, b in zip(turns, turns[1:], strict=False):
        move, length = float(path[b] - path[a]), int(cells[b] - cells[a])
        if abs(move) >= net and length >= least and slow <= abs(move) / length <= fast:
            out.append((int(cells[a]), int(cells[b]), move))
    return out


def marches(cells: np.ndarray, path: np.ndarray, net: float = 1.8, least: int = 2, most: int = 120) -> list[tuple[int, int, float]]:
    """Non-overlapping stretches from left to right with the most displacement times monotonicity: start, end, displacement."""
    out, i = [], 0
    while i < len(path) - 1:
        best = None
        steps = np.abs(np.diff(path[i : i + most]))
        total = np.cumsum(steps)
        for j in range(i + least, min(len(path), i + most)):
            move = path[j] - path[i]
            if abs(move) >= net and total[j - i - 1] > 0:
                worth = abs(move) * abs(move) / total[j - i - 1]
                if best is None or worth > best[0]:
                    best = worth, j, float(move)
        if best is None:
            i += 1
        else:
            out.append((int(cells[i]), int(cells[best[1]]), best[2]))
            i = best[1]
    return out


def belief(p: float, dt: float, quality: float, weight: float, tau: float) -> float:
    """A room's belief after a decay and one piece of evidence: p += (1 - p) * q * w."""
    p *= float(np.exp(-max(dt, 0.0) / tau))
    return p + (1.0 - p) * quality * weight

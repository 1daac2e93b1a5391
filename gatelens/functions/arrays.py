"""Functions on arrays over gates, as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.plans.config import GATE_METRES, GATES

INDEX = list(range(GATES))


def index() -> Column:
    return F.array(*(F.lit(i) for i in INDEX))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def residual(energy: Column, floor: Column, spread: Column) -> Column:
    """(energy - floor) / spread, gate by gate, signed."""
    lifted = F.zip_with(energy, floor, lambda e, f: e - f)
    return F.zip_with(lifted, spread, lambda d, s: d / s)


def peaks(move: Column, still: Column) -> Column:
    """The greater of both residuals and zero, gate by gate."""
    return F.zip_with(move, still, lambda m, s: F.greatest(F.lit(0.0), m, s))


def confidence(score: Column, enter: float) -> Column:
    """Logistic in the score around the entry threshold."""
    slope = 4.0 / enter if enter > 0 else 4.0
    return 1.0 / (1.0 + F.exp(-slope * (score - enter)))


def active(peak: Column, k: float) -> Column:
    """Gates whose peak reaches k."""
    return F.filter(index(), lambda i: F.get(peak, i) >= k)


def centroid_span(peak: Column, gates: Column) -> tuple[Column, Column]:
    """Peak-weighted mean and standard deviation of the gates; both zero without gates."""
    mass = F.aggregate(gates, F.lit(0.0), lambda a, i: a + F.get(peak, i))
    mean = F.aggregate(gates, F.lit(0.0), lambda a, i: a + i * F.get(peak, i)) / mass
    square = F.aggregate(gates, F.lit(0.0), lambda a, i: a + i * i * F.get(peak, i)) / mass
    some = (F.size(gates) > 0) & (mass > 0)
    return F.when(some, mean).otherwise(0.0), F.when(some, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).otherwise(0.0)


def supported_centroid(peak: Column, support: Column, on: float) -> Column:
    """Peak-weighted mean of the gates with support; null without any."""
    gates = F.filter(index(), lambda i: (F.get(support, i) >= on) & (F.get(peak, i) > 0))
    mean, _ = centroid_span(peak, gates)
    return F.when(F.size(gates) > 0, mean)


def edge_band(gates: Column, last_in_room: Column | int) -> Column:
    """near, far or none, by the nearest and the farthest active gate."""
    return F.when(F.array_min(gates) <= 1, "near").when(F.array_max(gates) >= last_in_room, "far").otherwise("none")


def range_label(gates: Column) -> Column:
    """clear, one gate, or the lowest and highest with a dash."""
    low, high = F.array_min(gates), F.array_max(gates)
    return F.when(F.size(gates) == 0, "clear").when(low == high, low.cast("string")).otherwise(F.concat_ws("–", low.cast("string"), high.cast("string")))


def distance_m(ready: Column, gates: Column, centroid: Column, device_cm: Column) -> Column:
    return F.when(ready & (F.size(gates) > 0), centroid * GATE_METRES).otherwise(device_cm / 100.0)


#: The letter of each gate class.
LETTERS = {"in_room": "I", "portal": "P", "bleed": "B", "unknown": "U", "out": "O"}


def class_letters(classes: Column) -> Column:
    letter = F.lit("U")
    table = F.create_map(*(F.lit(x) for kv in LETTERS.items() for x in kv))
    return F.array_join(F.transform(classes, lambda c: F.coalesce(table[c], letter)), "")


def last_in_room(classes: Column) -> Column:
    return F.array_max(F.filter(index(), lambda i: F.get(classes, i) == "in_room"))


def allowed(excluded: Column | None) -> Column:
    return F.array(*(F.lit(False) for _ in INDEX)) if excluded is None else excluded


def best_run(peak: Column, k: float, excluded: Column | None = None, neighbour: float | None = None, support: Column | None = None) -> Column:
    """Struct (score, lo, hi) of the strongest run of gates at or above k.

    A run's score is its peaks' sum over k; the nearest of equally strong runs
    wins. excluded gates break runs. With neighbour, a run of one gate counts
    only if a gate beside it that isn't excluded has that much support, a level
    smoothed over time, or the peak itself where none is given. Without a run
    the score is zero and lo and hi are null.
    """
    barred, level = allowed(excluded), peak if support is None else support
    zero, none = F.lit(0.0), F.lit(None).cast("int")
    start = F.struct(zero.alias("sum"), F.lit(-1).alias("from"), zero.alias("score"), none.alias("lo"), none.alias("hi"))

    def step(a: Column, i: Column) -> Column:
        inside = F.coalesce((F.get(peak, i) >= k) & ~F.get(barred, i), F.lit(False))
        last = a["from"] == i - 1
        ok = a["sum"] / k > a["score"]
        if neighbour is not None:
            beside = lambda j: F.coalesce((F.get(level, j) >= neighbour) & ~F.get(barred, j), F.lit(False))
            ok = ok & (~last | beside(i - 2) | beside(i))
        won = (a["from"] >= 0) & ~inside & ok
        return F.struct(
            F.when(inside, a["sum"] + F.get(peak, i)).otherwise(0.0).alias("sum"),
            F.when(inside, F.when(a["from"] >= 0, a["from"]).otherwise(i)).otherwise(-1).alias("from"),
            F.when(won, a["sum"] / k).otherwise(a["score"]).alias("score"),
            F.when(won, a["from"]).otherwise(a["lo"]).alias("lo"),
            F.when(won, i - 1).otherwise(a["hi"]).alias("hi"),
        )

    gates = F.array(*(F.lit(i) for i in range(GATES + 1)))
    return F.aggregate(gates, start, step, lambda a: F.struct(a["score"], a["lo"], a["hi"]))


def leading_gate(move_residual: Column, k: float, support: Column) -> Column:
    """The first gate of the first run of signed motion residuals at or above k that is longer than one gate or has a neighbour whose support is half of k."""
    strong = lambda i: F.coalesce(F.get(move_residual, i) >= k, F.lit(False))
    half = lambda i: F.coalesce(F.get(support, i) >= k * 0.5, F.lit(False))
    return F.array_min(F.filter(index(), lambda i: strong(i) & ~strong(i - 1) & (strong(i + 1) | half(i - 1) | half(i + 1))))


def balanced(move: Column, still: Column, bar: float, share: float = 1 / 3, first: int = 2) -> Column:
    """Whether motion reaches the bar and is enough of the gate's energy at any gate from first on."""
    gates = F.filter(index(), lambda i: i >= first)
    part = lambda i: F.get(move, i) / F.greatest(F.get(move, i) + F.get(still, i), F.lit(1))
    return F.exists(gates, lambda i: (F.get(move, i) >= bar) & (part(i) >= share))


def cosine(a: Column, b: Column) -> Column:
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x)))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def moments(values: Column) -> tuple[Column, Column, Column]:
    """Mean, population standard deviation and population kurtosis of an array."""
    n = F.size(values)
    mean = total(values) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    fourth = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean) * (x - mean) * (x - mean)) / n
    return mean, F.sqrt(var), fourth / F.nullif(var * var, F.lit(0.0))


def entropy(values: Column) -> Column:
    """Shannon entropy, in nats, of an array of masses; zero without mass."""
    mass = total(values)
    h = F.aggregate(values, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / mass * F.ln(x / mass)).otherwise(0.0))
    return F.when(mass > 0, h).otherwise(0.0)


def peak_count(values: Column) -> Column:
    """Local maxima: above the gate before and at least as high as the gate after."""
    at = lambda i: F.coalesce(F.get(values, i).cast("double"), F.lit(-1.0))
    return F.size(F.filter(index(), lambda i: (at(i) > at(i - 1)) & (at(i) >= at(i + 1))))


def bytes_to_gates(blob: Column) -> Column:
    """Nine bytes as whole numbers."""
    return F.transform(F.array(*(F.lit(i + 1) for i in INDEX)), lambda i: F.conv(F.hex(F.substring(blob, i, F.lit(1))), 16, 10).cast("int"))


def gates_to_bytes(gates: Column) -> Column:
    return F.unhex(F.array_join(F.transform(gates, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))

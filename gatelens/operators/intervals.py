"""Joins on time: overlap, containment, nearest and as-of, and scoring against ground truth.

Range conditions get an equality to hash on: both sides are dealt to time bins,
an interval to every bin that it touches, and a pair is taken only in the bin
where the later of its starts lies, so that it comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned(df: DataFrame, start: Column, end: Column, bin_s: float, name: str = "__bin") -> DataFrame:
    first, last = (F.floor(x / bin_s).cast("long") for x in (start, end))
    return df.withColumn(name, F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_pairs(left: DataFrame, right: DataFrame, bin_s: float, *keys: str) -> DataFrame:
    """Pairs of (keys, l_start, l_end, ...) and (keys, r_start, r_end, ...) that share more than a point."""
    a = binned(left, F.col("l_start"), F.col("l_end"), bin_s)
    b = binned(right, F.col("r_start"), F.col("r_end"), bin_s)
    at = F.floor(F.greatest("l_start", "r_start") / bin_s).cast("long")
    pairs = a.join(b, [*keys, "__bin"]).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("__bin") == at))
    return pairs.withColumn("overlap", F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).drop("__bin")


def points_in(points: DataFrame, spans: DataFrame, bin_s: float, *keys: str, closed: bool = True) -> DataFrame:
    """Points (keys, ts, ...) with every span (keys, start, end, ...) that holds them; the end counts if closed."""
    p = points.withColumn("__bin", F.floor(F.col("ts") / bin_s).cast("long"))
    s = binned(spans, F.col("start"), F.col("end"), bin_s)
    inside = (F.col("ts") >= F.col("start")) & ((F.col("ts") <= F.col("end")) if closed else (F.col("ts") < F.col("end")))
    return p.join(s, [*keys, "__bin"]).where(inside).drop("__bin")


def points_outside(points: DataFrame, spans: DataFrame, bin_s: float, *keys: str, id_col: str = "id") -> DataFrame:
    """The points that no span holds."""
    return points.join(points_in(points, spans, bin_s, *keys).select(id_col).distinct(), id_col, "left_anti")


def spans_hit(spans: DataFrame, points: DataFrame, bin_s: float, *keys: str, name: str = "name", how: str = "left_semi") -> DataFrame:
    """The spans that hold a point, or with left_anti those that hold none."""
    return spans.join(points_in(points, spans, bin_s, *keys).select(name).distinct(), name, how)


def first_in_span(points: DataFrame, spans: DataFrame, bin_s: float, *keys: str, name: str = "name") -> DataFrame:
    """Every span with its first point and the latency from the span's start; nulls where there is none."""
    first = points_in(points, spans, bin_s, *keys).groupBy(name).agg(F.min("ts").alias("first"))
    return spans.join(first, name, "left").withColumn("latency", F.col("first") - F.col("start"))


def asof(left: DataFrame, right: DataFrame, value: str, *keys: str, lag_s: float = 0.0, most_s: float | None = None) -> DataFrame:
    """left (keys, ts, id) with right's (keys, ts, id) last value at or before ts - lag_s, and its time.

    One ordered pass over both sides together; nothing multiplies. With most_s a
    value older than that is null.
    """
    a = left.withColumns({"__side": F.lit(1), "__at": F.col("ts") - lag_s, "__v": F.lit(None), "__t": F.lit(None).cast("double")})
    a = a.withColumn("__v", F.col("__v").cast(dict(right.dtypes)[value]))
    b = right.select(*keys, "id", F.lit(0).alias("__side"), F.col("ts").alias("__at"), F.col(value).alias("__v"), F.col("ts").alias("__t"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    last = F.last(F.when(F.col("__side") == 0, F.struct(F.col("__v").alias("v"), F.col("__t").alias("t"))), True).over(w)
    both = both.withColumn("__m", last).where("__side = 1")
    ok = F.lit(True) if most_s is None else F.col("__at") - F.col("__m.t") <= most_s
    return both.withColumns({"match": F.when(ok, F.col("__m.v")), "match_ts": F.when(ok, F.col("__m.t"))}).select(*left.columns, "match", "match_ts")


def nearest(left: DataFrame, right: DataFrame, value: str, most_s: float, *keys: str) -> DataFrame:
    """left with right's value nearest in time, the earlier of equally near ones, within most_s."""
    back = asof(left, right, value, *keys).withColumnRenamed("match", "b").withColumnRenamed("match_ts", "bt")
    flip = lambda d: d.withColumn("ts", -F.col("ts"))
    ahead = asof(flip(left), flip(right), value, *keys).select("id", F.col("match").alias("a"), (-F.col("match_ts")).alias("at"))
    both = back.join(ahead, "id")
    gap_b, gap_a = F.col("ts") - F.col("bt"), F.col("at") - F.col("ts")
    use_b = gap_b.isNotNull() & (gap_a.isNull() | (gap_b <= gap_a))
    found = F.when(use_b & (gap_b <= most_s), F.col("b")).when(~use_b & (gap_a <= most_s), F.col("a"))
    return both.withColumn("match", found).select(*left.columns, "match")


def label_spans(labels: DataFrame, last: Column, tail_s: float, least_s: float, *keys: str) -> DataFrame:
    """Label events as spans up to the next event, the tail cut off, short ones dropped."""
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    spans = labels.withColumn("end", F.coalesce(F.lead("ts").over(w), last) - tail_s)
    return spans.where(F.col("end") - F.col("ts") > least_s).select(*keys, "label", F.col("ts").alias("start"), "end")


def timeline_score(runs: DataFrame, spans: DataFrame, bin_s: float, *keys: str) -> DataFrame:
    """(keys, entries, false_entries, spans_detected, spans_missed, latency, overlap_s, false_s, missed_s).

    runs: (keys, start, end); a run's start is an entry. false_s and missed_s
    are what runs and spans have beside their overlap.
    """
    entries = runs.select(*keys, F.col("start").alias("ts"), F.col("end").alias("stop"), F.monotonically_increasing_id().alias("id"))
    inside = points_in(entries, spans, bin_s, *keys)
    hits = inside.select(*keys, "id").distinct().groupBy(*keys).agg(F.count("*").alias("hits"))
    found = inside.groupBy(*keys, "name", "start").agg(F.min("ts").alias("first"))
    found = found.groupBy(*keys).agg(F.count("*").alias("spans_detected"), F.sum(F.col("first") - F.col("start")).alias("latency"))
    pairs = overlap_pairs(runs.withColumnsRenamed({"start": "l_start", "end": "l_end"}), spans.withColumnsRenamed({"start": "r_start", "end": "r_end"}), bin_s, *keys)
    over = pairs.groupBy(*keys).agg(F.sum("overlap").alias("overlap_s"))
    a = runs.groupBy(*keys).agg(F.count("*").alias("entries"), F.sum(F.col("end") - F.col("start")).alias("run_s"))
    b = spans.groupBy(*keys).agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("span_s"))
    out = a.join(b, list(keys), "full")
    for part in (hits, found, over):
        out = out.join(part, list(keys), "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        *keys, z("entries").alias("entries"), (z("entries") - z("hits")).alias("false_entries"), z("spans_detected").alias("spans_detected"),
        (z("spans") - z("spans_detected")).alias("spans_missed"), z("latency").alias("latency"), z("overlap_s").alias("overlap_s"),
        (z("run_s") - z("overlap_s")).alias("false_s"), (z("span_s") - z("overlap_s")).alias("missed_s"),
    )


def coverage(spans: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """(keys, start, end, depth): a sweep over interval bounds; depth is how many intervals hold each piece."""
    turns = spans.select(*keys, F.col(start).alias("ts"), F.lit(1).alias("d")).unionByName(spans.select(*keys, F.col(end).alias("ts"), F.lit(-1).alias("d")))
    turns = turns.groupBy(*keys, "ts").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("ts")
    turns = turns.select(*keys, F.col("ts").alias("start"), F.lead("ts").over(w).alias("end"), F.sum("d").over(w).alias("depth"))
    return turns.where(F.col("end").isNotNull())


def aligned(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows of both sides of equal number in time order, as l_ and r_ columns."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "id"))
    a = left.withColumn("n", number).select(*keys, "n", *(F.col(c).alias("l_" + c) for c in left.columns if c not in keys))
    b = right.withColumn("n", number).select(*keys, "n", *(F.col(c).alias("r_" + c) for c in right.columns if c not in keys))
    return a.join(b, [*keys, "n"])

"""Offline statistics: separability, divergence, fade shape, discriminants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """(keys, n1, n0, auc): Mann-Whitney with mid-ranks, from counts by distinct score, so ties and hot scores are cheap."""
    by = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    w = Window.partitionBy(*keys).orderBy(score)
    by = by.withColumn("below", F.sum("q").over(w) - F.col("q"))
    g = by.groupBy(*keys).agg(F.sum("p").alias("n1"), F.sum("q").alias("n0"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)).alias("u"))
    return g.select(*keys, "n1", "n0", (F.col("u") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0))).alias("auc"))


def cohens_d(df: DataFrame, label: str, value: str, *keys: str) -> DataFrame:
    of = lambda f, k: f(F.when(F.col(label) == k, F.col(value)))
    g = df.groupBy(*keys).agg(of(F.avg, 1).alias("m1"), of(F.avg, 0).alias("m0"), of(F.var_samp, 1).alias("v1"), of(F.var_samp, 0).alias("v0"), of(F.count, 1).alias("n1"), of(F.count, 0).alias("n0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return g.select(*keys, ((F.col("m1") - F.col("m0")) / F.nullif(pooled, F.lit(0.0))).alias("d"))


def shares(df: DataFrame, label: str, bin_col: str, *keys: str) -> DataFrame:
    """(keys, bin, p, q): both labels' shares of each bin."""
    g = df.groupBy(*keys, bin_col).agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b"))
    w = Window.partitionBy(*keys)
    return g.select(*keys, bin_col, (F.col("a") / F.sum("a").over(w)).alias("p"), (F.col("b") / F.sum("b").over(w)).alias("q"))


def overlap_coefficient(df: DataFrame, label: str, bin_col: str, *keys: str) -> DataFrame:
    return shares(df, label, bin_col, *keys).groupBy(*keys).agg(F.sum(F.least("p", "q")).alias("overlap"))


def jensen_shannon(df: DataFrame, label: str, bin_col: str, *keys: str) -> DataFrame:
    """(keys, jsd) in nats."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return shares(df, label, bin_col, *keys).groupBy(*keys).agg((F.sum(part(F.col("p")) + part(F.col("q"))) / 2).alias("jsd"))


def top_mass(df: DataFrame, value: str, share: float, *keys: str, by: str = "gate") -> DataFrame:
    """(keys, by): the heaviest members until their mass reaches the share; ties go to the lower member."""
    g = df.groupBy(*keys, by).agg(F.sum(value).alias("mass"))
    w = Window.partitionBy(*keys)
    g = g.withColumns({"cum": F.sum("mass").over(w.orderBy(F.desc("mass"), by)), "all": F.sum("mass").over(w)})
    return g.where(F.col("cum") - F.col("mass") < share * F.col("all")).select(*keys, by)


def best_threshold(df: DataFrame, label: str, score: str, cuts: int = 400) -> DataFrame:
    """(cut, gain): the percentile cut with the greatest true less false positive rate, the higher of equals."""
    points = F.array(*(F.lit(i / cuts) for i in range(cuts + 1)))
    grid = df.agg(F.array_sort(F.array_distinct(F.percentile(score, points))).alias("grid"))
    by = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    # each score goes to the highest cut that it reaches; what is left is a row a cut
    at = by.crossJoin(F.broadcast(grid)).withColumn("k", F.size(F.filter("grid", lambda c: c <= F.col("s"))))
    at = at.groupBy("k", "grid").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    w = Window.partitionBy("grid").orderBy(F.desc("k"))
    up = at.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("q").over(w)})
    all_ = by.agg(F.sum("p").alias("n1"), F.sum("q").alias("n0"))
    up = up.where("k > 0").crossJoin(F.broadcast(all_)).withColumn("cut", F.get("grid", F.col("k") - 1))  # one row
    gain = F.round(F.col("tp") / F.col("n1") - F.col("fp") / F.col("n0"), 9)
    best = up.agg(F.max(F.struct(gain.alias("gain"), "cut")).alias("b"))
    return best.select("b.cut", "b.gain")


def confusion(df: DataFrame, label: str, score: str, cuts: list[float]) -> DataFrame:
    """(cut, tp, fn, fp, tn, accuracy) for each of a few cuts, in one pass."""
    rows = df.withColumn("cut", F.explode(F.array(*(F.lit(float(c)) for c in cuts))))
    hit, true = F.col(score) >= F.col("cut"), F.col(label) == 1
    g = rows.groupBy("cut").agg(F.count_if(hit & true).alias("tp"), F.count_if(~hit & true).alias("fn"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & ~true).alias("tn"))
    return g.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def fade(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Shape of a level over time: cv, shares below parts of the median, skew, kurtosis, entropy, peak over median, decibel range, lag-1 correlation, mean step."""
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    v = F.col(value).cast("double")
    rows = df.withColumns({"__v": v, "__was": F.lag(v).over(w)})
    med = rows.groupBy(*keys).agg(F.percentile("__v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p"))
    rows = rows.join(med, list(keys))
    below = lambda part, n: F.avg((F.col("__v") < part * F.col("p")[1]).cast("int")).alias(n)
    out = rows.groupBy(*keys).agg(
        (F.stddev_pop("__v") / F.nullif(F.avg("__v"), F.lit(0.0))).alias("cv"), below(0.3, "below30"), below(0.5, "below50"), below(0.7, "below70"),
        F.skewness("__v").alias("skew"), F.kurtosis("__v").alias("kurtosis"),
        (F.max("__v") / F.nullif(F.max(F.col("p")[1]), F.lit(0.0))).alias("peak_ratio"),
        (10 * F.log10((F.max(F.col("p")[2]) + 1) / (F.max(F.col("p")[0]) + 1))).alias("range_db"),
        F.coalesce(F.corr("__v", "__was"), F.lit(0.0)).alias("ac1"), F.avg(F.abs(F.col("__v") - F.col("__was"))).alias("mean_step"),
    )
    return out


def gram(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """One row: all sums of products of the columns (with a constant) and the target; the size doesn't depend on the rows."""
    names = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    t = F.col(target).cast("double")
    sums = [F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    return df.agg(*sums, *(F.sum(a * t).alias(f"t{i}") for i, a in enumerate(names)), F.count("*").alias("n"))


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their median, over 1.4826 times their median absolute deviation (one where that is zero)."""
    med = df.agg(*(F.percentile(c, 0.5).alias(c) for c in columns)).first()
    df = df.withColumns({c: F.col(c).cast("double") - med[c] for c in columns})
    mad = df.agg(*(F.percentile(F.abs(c), 0.5).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c) / ((1.4826 * mad[c]) or 1.0) for c in columns})


def ridge(df: DataFrame, columns: list[str], target: str, penalty: float = 2.0, constant_penalty: float = 0.01) -> list[float]:
    """Intercept and weights of a ridge fit on robustly scaled columns; the normal equations are one aggregate."""
    import numpy as np

    row = gram(robust_scale(df, columns), columns, target).first()
    k = len(columns) + 1
    a = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.solve(a + np.diag([constant_penalty] + [penalty] * (k - 1)), np.array([row[f"t{i}"] for i in range(k)])).tolist()


def linear_score(df: DataFrame, columns: list[str], weights: list[float], name: str = "score") -> DataFrame:
    scaled = robust_scale(df, columns)
    out: Column = F.lit(weights[0])
    for c, w in zip(columns, weights[1:], strict=True):
        out = out + F.col(c) * w
    return scaled.withColumn(name, out)


def discriminant(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """(wa, wb): Fisher's direction of two z-scored features, pooled covariance with a small ridge."""
    z = df.agg(*(f(c).alias(n + c) for c in (a, b) for f, n in ((F.avg, "m_"), (F.stddev_pop, "s_")))).first()
    df = df.withColumns({c: (F.col(c) - z["m_" + c]) / (z["s_" + c] or 1.0) for c in (a, b)})
    of = lambda f, k, *c: f(*(F.when(F.col(label) == k, F.col(x)) for x in c))
    g = df.agg(
        (of(F.avg, 1, a) - of(F.avg, 0, a)).alias("da"), (of(F.avg, 1, b) - of(F.avg, 0, b)).alias("db"),
        ((of(F.var_samp, 1, a) + of(F.var_samp, 0, a)) / 2 + 1e-6).alias("aa"), ((of(F.var_samp, 1, b) + of(F.var_samp, 0, b)) / 2 + 1e-6).alias("bb"),
        ((of(F.covar_samp, 1, a, b) + of(F.covar_samp, 0, a, b)) / 2).alias("ab"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return g.select(((F.col("bb") * F.col("da") - F.col("ab") * F.col("db")) / det).alias("wa"), ((F.col("aa") * F.col("db") - F.col("ab") * F.col("da")) / det).alias("wb"))

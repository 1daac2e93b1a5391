"""The layer above single sensors: reach over the adjacency graph, couplings, continuity. Experimental."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reachable(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops): nodes reached from the sources (node) over edges (a, b), in at most so many hops where most is given.

    Breadth first by joins until nothing new is reached; nodes are rooms or
    sensors, a house's few, so that rounds are few too.
    """
    seen = sources.select("node", F.lit(0).alias("hops")).distinct()
    frontier, k = seen, 0
    while k != most:
        k += 1
        step = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(k).alias("hops"))
        if most is None and frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.groupBy("node").agg(F.min("hops").alias("hops"))


def coupled_belief(belief: DataFrame, handoffs: DataFrame) -> DataFrame:
    """(room, belief): a handoff takes from the room left what it gives to the room entered, in the share of its weight."""
    out = handoffs.groupBy(F.col("s1").alias("room")).agg(F.sum("weight").alias("out"))
    into = handoffs.groupBy(F.col("s2").alias("room")).agg(F.sum("weight").alias("into"))
    b = belief.join(out, "room", "left").join(into, "room", "left")
    gone = F.least(F.coalesce("out", F.lit(0.0)), F.lit(1.0))
    got = F.least(F.coalesce("into", F.lit(0.0)), F.lit(1.0))
    kept = F.col("belief") * (1 - gone)
    return b.select("room", (kept + (1 - kept) * got).alias("belief"))


def continuity(tracks: DataFrame, wait_s: float, *keys: str, slice_s: float = 86_400.0) -> DataFrame:
    """(keys, chain, sensor, track, t0, t1): tracks of any sensors in one chain while the next begins at most wait_s after all before end.

    Chains are found within slices of time, after the latest end and the number
    of chains of all earlier slices; only one row a slice passes through a window
    over a whole key.
    """
    by = ("t0", "sensor", "track")
    t = tracks.withColumn("slice", F.floor(F.col("t0") / slice_s))
    inner = Window.partitionBy(*keys, "slice").orderBy(*by)
    outer = Window.partitionBy(*(keys or (F.lit(1),))).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, value: Column, over, name: str) -> DataFrame:
        each = df.groupBy(*keys, "slice").agg(value.alias("v")).withColumn(name, over(F.col("v")).over(outer)).drop("v")
        return df.join(each, [*keys, "slice"])

    t = carried(t, F.max("t1"), F.max, "before")
    reach = F.greatest("before", F.max("t1").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("new", F.coalesce(F.col("t0") > reach + wait_s, F.lit(True)).cast("int"))
    t = carried(t, F.sum("new"), F.sum, "chains")
    return t.select(*keys, (F.coalesce("chains", F.lit(0)) + F.sum("new").over(inner)).alias("chain"), "sensor", "track", "t0", "t1")


def boosted_trees(df: DataFrame, features: list[str], label: str, depth: int = 3, rounds: int = 10):
    """A gradient-boosted classifier of episodes, fitted where the rows are; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[assemble, GBTClassifier(labelCol=label, maxDepth=depth, maxIter=rounds, seed=1)]).fit(df)

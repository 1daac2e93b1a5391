"""The stage planner: a query is an ordered list of stage names with settings, refused by name if it can't run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gatelens.operators.replay import replay

from .config import Config, configured
from .stage_order import ALL_STAGES, STAGES, Stage, chosen, order

__all__ = ["ALL_STAGES", "STAGES", "Stage", "chosen", "order", "plan", "sweep"]


def plan(frames: DataFrame, stages: tuple[str, ...] | None = None, emit: str = "states", **settings) -> DataFrame:
    """Checks the stages and settings and returns the detector's rows: all order-dependent stages in one fold, one shuffle."""
    config = configured(Config(), **settings)
    if stages is not None:
        config = configured(config, stages=tuple(stages))
    order(config.stages)
    return replay(frames, config, emit)


def sweep(frames: DataFrame, grid: list[dict], emit: str = "transitions") -> DataFrame:
    """The same plan under several settings, one column telling them apart."""
    from functools import reduce

    from pyspark.sql import functions as F

    parts = [plan(frames, emit=emit, **g).withColumn("settings", F.lit(str(sorted(g.items())))) for g in grid]
    return reduce(DataFrame.unionByName, parts)

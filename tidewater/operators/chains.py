"""Nearest joins over option chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deltabucket(chain: DataFrame, id_col: str, delta: str, targets: list[float]) -> DataFrame:
    """For each target the nearest contract: target, delta, gap; a tie goes to the smaller id.

    One pass with partial aggregation: every target is an aggregate of its own,
    so nothing is joined.
    """
    best = [F.min_by(F.struct(F.col(delta).alias("delta"), F.abs(F.col(delta) - t).alias("gap")), F.struct(F.abs(F.col(delta) - t), F.col(id_col))).alias(f"t{k}") for k, t in enumerate(targets)]
    row = chain.filter(F.col(delta).isNotNull()).agg(*best)
    return row.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"t{k}.delta").alias("delta"), F.col(f"t{k}.gap").alias("gap")) for k, t in enumerate(targets)])))

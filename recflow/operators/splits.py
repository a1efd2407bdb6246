"""Folds and validation splits that keep a group's rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import unit_hash
from .ranking import global_rank


def k_folds(df: DataFrame, group: Column, folds: int, seed: str = "42") -> DataFrame:
    """``df`` with ``fold``: groups in hashed order, dealt in turn, so folds differ by one group at most.

    Groups are ranked within 4096 hash buckets whose sizes are cumulated, never sorted in one task.
    """
    named = df.withColumn("_g", group.cast("string"))
    groups = named.select("_g").distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), "_g")))
    groups = groups.withColumn("_b", F.substring("_h", 1, 3))
    ranked = global_rank(groups, ["_b asc", "_h asc", "_g asc"])
    dealt = ranked.select(F.col("_g").alias("_k"), (F.col("rank") % folds).cast("int").alias("fold"))
    return named.join(dealt, F.col("_g").eqNullSafe(F.col("_k"))).drop("_g", "_k")


def validation_split(df: DataFrame, group: Column, ratio: float, seed: str = "42") -> DataFrame:
    """``df`` with ``is_validation``: a share of the groups by hash."""
    return df.withColumn("is_validation", unit_hash(F.lit(seed), group.cast("string")) < ratio)

"""Candidates out of two pools, fused, without what the listener has heard, cut to 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking
from ..sources.tables import table

#: Pools in order of precedence, and the candidates of the popularity pool.
CANDIDATES, POPULAR = ("bm25", "popular"), 100


def eval_pairs(pairs: DataFrame) -> DataFrame:
    """Rows of the evaluation splits."""
    return pairs.where(F.col("split") != "train")


def pool_rankings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(rankings keyed by pair_id, evaluation pairs); seen tracks are gone before ranks are given."""
    pairs = table(spark, d, "train_pairs")
    queries = eval_pairs(pairs).select("pair_id", "seen", "bm25_top_tids")
    text = ranking.from_array(queries, "bm25_top_tids", "bm25", 0, ["pair_id"]).groupBy("pair_id", "pool", "pool_ord", "track_id").agg(F.min("rank").alias("rank"))
    # At most POPULAR rows, so every query can have them.
    top = ranking.top_popular(pairs.where("split = 'train'"), POPULAR)
    listed = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "track_id"))), lambda x: x["track_id"]).alias("top"))
    popular = ranking.from_array(queries.select("pair_id").crossJoin(F.broadcast(listed)), "top", "popular", 1, ["pair_id"])
    both = text.unionByName(popular.select(text.columns))
    return ranking.unseen(both, queries, keys=["pair_id"]).withColumn("score", 1.0 / (F.col("rank") + 1)), queries


def recommend(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    """``pair_id, track_id, score, rank``"""
    rankings, _ = pool_rankings(spark, d)
    top = ranking.top_n(ranking.rrf(rankings, ["pair_id"]), n, ["pair_id"])
    return top.select("pair_id", "track_id", F.round("score", 9).alias("score"), "rank")

"""Micro cases whose answers were worked out by hand."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from recflow.operators import evaluation, features, postprocess, ranking


def _rankings(spark, lists):
    rows = [("q", p, i, t, r, 1.0 / (r + 1)) for i, (p, ts) in enumerate(lists) for r, t in enumerate(ts)]
    return spark.createDataFrame(rows, "q string, pool string, pool_ord int, track_id string, rank int, score double")


def test_rrf_ties_go_to_the_first_seen(spark):
    fused = ranking.top_n(ranking.rrf(_rankings(spark, [("a", ["x", "y"]), ("b", ["y", "x"])]), ["q"]), 5, ["q"]).orderBy("rank").collect()
    assert [r["track_id"] for r in fused] == ["x", "y"]
    assert all(abs(r["score"] - (1 / 61 + 1 / 62)) < 1e-11 for r in fused)


def test_rrf_counts_a_repeated_track_twice(spark):
    fused = ranking.rrf(_rankings(spark, [("a", ["x", "x"])]), ["q"]).collect()
    assert abs(fused[0]["score"] - (1 / 61 + 1 / 62)) < 1e-11


def test_rbc(spark):
    got = {r["track_id"]: r["score"] for r in ranking.rbc(_rankings(spark, [("a", ["x", "y"])]), ["q"]).collect()}
    assert got == {"x": 1.0, "y": 0.9}


def test_unseen_leaves_enough_for_n(spark):
    queries = spark.createDataFrame([("q", ["a", "c"])], "q string, seen array<string>")
    kept = ranking.unseen(_rankings(spark, [("p", list("abcde"))]), queries, keys=["q"]).orderBy("rank").limit(2).collect()
    assert [r["track_id"] for r in kept] == ["b", "d"]


def test_weighted_fuse_extremes(spark):
    original, model = _rankings(spark, [("o", ["a", "b"])]), _rankings(spark, [("m", ["b", "a"])])
    order = lambda w: [r["track_id"] for r in ranking.weighted_fuse(original, model, w, ["q"]).orderBy("rank").collect()]
    assert order(0.0) == ["b", "a"]
    assert order(1.0) == ["a", "b"]


def test_fold_mean_is_over_folds_that_returned_the_track(spark):
    rows = [("q", "t_fold0", 0, "x", 0, 1.0), ("q", "t_fold1", 0, "x", 1, 0.5), ("q", "t_all", 0, "y", 0, 0.25)]
    df = spark.createDataFrame(rows, "q string, pool string, pool_ord int, track_id string, rank int, score double")
    got = {r["track_id"]: (r["pool"], r["score"], r["n_folds"]) for r in ranking.fold_mean(df, ["q"]).collect()}
    assert got == {"x": ("t", 0.75, 2), "y": ("t", 0.25, 1)}


def test_metrics(spark):
    predictions = _rankings(spark, [("p", ["p", "q", "r"])])
    truth = spark.createDataFrame([("q", "r"), ("none", "z")], "q string, track_id string")
    at10 = {r["q"]: r for r in evaluation.per_query(predictions, truth, 10, ["q"]).collect()}
    assert abs(at10["q"]["ndcg"] - 1 / math.log2(4)) < 1e-9
    assert at10["q"]["recall"] == 1.0 and abs(at10["q"]["mrr"] - 1 / 3) < 1e-9
    assert at10["none"]["ndcg"] == at10["none"]["recall"] == at10["none"]["mrr"] == 0.0
    at2 = {r["q"]: r for r in evaluation.per_query(predictions, truth, 2, ["q"]).collect()}
    assert at2["q"]["ndcg"] == 0.0


def test_recall_variants(spark):
    predictions = _rankings(spark, [("p", ["a", "x"])])
    truth = spark.createDataFrame([("q", t) for t in "abc"], "q string, track_id string")
    r = evaluation.per_query(predictions, truth, 2, ["q"]).collect()[0]
    assert (r["recall_capped"], round(r["recall"], 6)) == (0.5, round(1 / 3, 6))


def test_distinct_bigrams(spark):
    got = evaluation.distinct_bigrams(spark.createDataFrame([("a b a b",), (None,), ("",), ("one",)], "t string"), "t").collect()[0]
    assert (got["n_distinct"], got["n_total"], got["distinct2"]) == (2, 3, round(2 / 3, 6))
    empty = evaluation.distinct_bigrams(spark.createDataFrame([], "t string"), "t").collect()[0]
    assert (empty["n_total"], empty["distinct2"]) == (0, 0.0)


def test_min_rank_puts_nulls_last(spark):
    rows = [("g", i, s) for i, s in enumerate([3.0, None, 3.0, 1.0, None])]
    got = features.min_rank(spark.createDataFrame(rows, "g string, i int, s double"), ["g"], "s", "p").orderBy("i").collect()
    assert [r["p"] for r in got] == [1, 4, 1, 3, 4]


def test_rank_buckets(spark):
    df = spark.createDataFrame([(1,), (3,), (10,), (None,), (101,), (0,)], "r int")
    assert [x["b"] for x in df.select(features.rank_bucket(F.col("r")).alias("b")).collect()] == ["r1", "r2_3", "r4_10", "missing", "r101p", "missing"]


def test_expert_features(spark):
    df = spark.createDataFrame([("x", 1, None, 5), ("y", None, None, None)], "t string, rank_a int, rank_b int, rank_c int")
    got = {r["t"]: r for r in features.expert_features(df, ["a", "b", "c"]).collect()}
    x, y = got["x"], got["y"]
    assert (x["hits"], x["rank_min"], x["rank_mean"], x["rank_std"], x["rank_span"], x["best_pool"]) == (2, 1, 3.0, 2.828427, 4, "a")
    assert (y["hits"], y["rank_min"], y["rank_std"], y["best_pool"]) == (0, None, 0.0, "<none>")


def test_target_encoding_leaves_the_own_fold_out(spark):
    rows = [("k", 1, 0), ("k", 0, 1), ("k", 0, 1), ("z", 1, 1)]
    got = features.target_encode(spark.createDataFrame(rows, "k string, y int, fold int"), "k", "y", "fold", alpha=2.0).collect()
    te = {(r["k"], r["fold"]): r["te_k"] for r in got}
    assert abs(te["k", 0] - (0 + 2 * (1 / 3)) / (2 + 2)) < 1e-9
    assert abs(te["k", 1] - (1 + 2 * 1.0) / (1 + 2)) < 1e-9
    assert abs(te["z", 1] - 1.0) < 1e-9


def test_diversify_keeps_the_head_and_spreads_the_rest(spark):
    pool = [f"t{i:02d}" for i in range(30)]
    rows = [(q, o, t, r) for o, q in enumerate(["a", "b"]) for r, t in enumerate(pool)]
    got = postprocess.diversify(spark.createDataFrame(rows, "query string, ord bigint, track_id string, rank int"), protect=5, keep=10, window=20).orderBy("query", "rank").collect()
    a, b = ([r["track_id"] for r in got if r["query"] == q] for q in "ab")
    assert a == pool[:10]
    assert b[:5] == pool[:5] and b != a and sorted(b) == b


def test_diversify_counts_use_over_all_queries(spark):
    rows = [(f"q{o:06d}", o, f"t{i}", i) for o in (0, 1, 19_999, 20_000, 40_000, 115_000) for i in range(10)]
    df = spark.createDataFrame(rows, "query string, ord bigint, track_id string, rank int")
    near = df.withColumn("ord", F.dense_rank().over(Window.orderBy("ord")).cast("bigint") - 1)
    picks = lambda d: sorted((r["query"], r["rank"], r["track_id"]) for r in postprocess.diversify(d, protect=1, keep=4, window=9).collect())
    assert picks(df) == picks(near)


def test_violations(spark):
    rows = [("s", 1, [f"t{i}" for i in range(21)]), ("s", 2, ["t1", "t1"]), ("s", 3, ["zz", None]), ("s", 4, None)]
    catalog = spark.createDataFrame([(f"t{i}",) for i in range(30)], "track_id string")
    got = {r["rule"]: r["n"] for r in postprocess.violations(spark.createDataFrame(rows, "session_id string, turn_number int, predicted_track_ids array<string>"), catalog).collect()}
    assert got == {"too_long": 1, "repeated": 1, "blank_id": 1, "unknown_track": 1, "no_list": 1, "no_response": 4, "missing_field": 2, "extra_field": 0}

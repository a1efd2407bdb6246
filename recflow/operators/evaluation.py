"""Ranking metrics.  Predictions: keys, track_id, rank (from 0); truth: keys, track_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import QUERY


def gain(rank: Column) -> Column:
    """Discounted gain of a hit at a rank from 0."""
    return F.lit(1.0) / F.log2(rank + 2)


def ideal_gain(n: int) -> list[float]:
    from math import log2

    out, total = [0.0], 0.0
    for i in range(n):
        total += 1 / log2(i + 2)
        out.append(total)
    return out


def per_query(predictions: DataFrame, truth: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """``keys, n_truth, hits, recall, recall_capped, ndcg, mrr`` at k, for every query with truth.

    recall divides by all true tracks, recall_capped by at most k of them; queries without predictions score 0.
    """
    keys = keys or QUERY
    t = truth.select(*keys, "track_id").distinct()
    size = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_truth"))
    hits = predictions.where(F.col("rank") < k).join(t, [*keys, "track_id"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.sum(gain(F.col("rank")).cast("decimal(20,15)")).cast("double").alias("dcg"), F.min("rank").alias("best"))
    ideal = F.get(F.array(*(F.lit(x) for x in ideal_gain(k))), F.least(F.col("n_truth"), F.lit(k)).cast("int"))
    n = F.coalesce("hits", F.lit(0))
    return size.join(hits, keys, "left").select(
        *keys,
        "n_truth",
        n.alias("hits"),
        (n / F.col("n_truth")).alias("recall"),
        (n / F.least("n_truth", F.lit(k))).alias("recall_capped"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(F.lit(1.0) / (F.col("best") + 1), F.lit(0.0)).alias("mrr"),
    )


def by_strata(scores: DataFrame, sets: list[list[str]], digits: int = 6) -> DataFrame:
    """Means over grouping sets of strata columns; a column outside a set is null."""
    columns = sorted({c for s in sets for c in s})
    means = [F.round(F.avg(m), digits).alias(m) for m in ("recall", "recall_capped", "ndcg", "mrr")]
    # Counted once: a grouping id tells the sets apart where strata are null themselves.
    return scores.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count(F.lit(1)).alias("n_queries"), *means)


#: Cuts of the report's nDCG and recall, and the strata that it names (fixed values).
NDCG_AT, RECALL_AT = (1, 10, 20), (20, 100)
NAMED = {"split": ("warm", "cold"), "specificity": ("HH", "HL", "LH", "LL"), "category": tuple("ABCDEFGHIJK")}


def labels_of(by: list[str], filters: dict[str, str] | None = None, turns: bool = False) -> Column:
    """The strata of a prediction as an array of labels: ``overall`` and its value of each column in ``by``, each also per turn
    (``T1``, ``warm/T1``).  With ``filters`` (values of strata columns) only their common stratum, ``warm+HH+A``."""
    if filters:
        inside = None
        for column, value in filters.items():
            inside = F.col(column) == value if inside is None else inside & (F.col(column) == value)
        names = F.array_compact(F.array(F.when(inside, F.lit("+".join(filters.values())))))
    else:
        names = F.array_compact(F.array(F.lit("overall"), *(F.when(F.col(c).isin(*NAMED[c]), F.col(c)) for c in by)))
    if not turns:
        return names
    turn = F.concat(F.lit("T"), F.col("turn_number").cast("string"))
    return F.concat(names, F.transform(names, lambda x: F.when(x == "overall", turn).otherwise(F.concat(x, F.lit("/"), turn))))


def report(predictions: DataFrame, truth: DataFrame, labels: Column, n_catalog: int | Column, digits: int = 6) -> DataFrame:
    """``label, ndcg_1, ..., recall_100, catalog_div, lexical_div, matched, max_pred_len`` of each stratum.

    ``predictions``: session_id, turn_number, predicted_track_ids, predicted_response and the columns of ``labels``; ``truth``: session_id,
    turn_number, truth, one row each.  Predictions without truth count for max_pred_len only; strata without any do not come out.
    """
    rows = predictions.withColumn("label", F.explode(labels)).join(truth, ["session_id", "turn_number"], "left")
    at = F.array_position(F.coalesce("predicted_track_ids", F.array().cast("array<string>")), F.col("truth"))
    matched = F.col("truth").isNotNull()
    mean = lambda value: F.coalesce(F.round(F.avg(F.when(matched, value)), digits), F.lit(0.0))
    hit = lambda k: (at > 0) & (at <= k)
    ranked = rows.groupBy("label").agg(
        *(mean(F.when(hit(k), 1 / F.log2(at.cast("double") + 1)).otherwise(0.0)).alias(f"ndcg_{k}") for k in NDCG_AT),
        *(mean(F.when(hit(k), 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in RECALL_AT),
        F.sum(matched.cast("long")).alias("matched"),
        F.max(F.size("predicted_track_ids")).alias("max_pred_len"),
    )
    kept = rows.where(matched)
    shown = kept.select("label", F.explode("predicted_track_ids").alias("t")).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("_shown"))
    w = F.filter(F.split(F.lower(F.coalesce("predicted_response", F.lit(""))), r"\s+"), lambda x: x != "")
    spoken = kept.select("label", w.alias("w")).where(F.size("w") > 1)
    pairs = spoken.select("label", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))).alias("p"))
    spoken = pairs.groupBy("label", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg((F.count(F.lit(1)) / F.sum("n")).alias("_lexical"))
    share = lambda c: F.coalesce(F.round(c, digits), F.lit(0.0))
    return ranked.join(shown, "label", "left").join(spoken, "label", "left").select(
        *[c for c in ranked.columns if c not in ("matched", "max_pred_len")], share(F.col("_shown") / n_catalog).alias("catalog_div"), share(F.col("_lexical")).alias("lexical_div"), "matched", "max_pred_len"
    )


def catalog_diversity(predictions: DataFrame, catalog: DataFrame) -> DataFrame:
    shown = predictions.agg(F.countDistinct("track_id").alias("n_shown"))
    size = catalog.agg(F.countDistinct("track_id").alias("n_catalog"))
    return shown.crossJoin(F.broadcast(size)).withColumn("diversity", F.round(F.col("n_shown") / F.col("n_catalog"), 6))


def distinct_bigrams(texts: DataFrame, column: str) -> DataFrame:
    """``n_distinct, n_total, distinct2`` of neighbouring words in lower case, over all texts."""
    w = F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"\s+"), lambda x: x != "")
    words = texts.select(w.alias("w")).where(F.size("w") > 1)
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))).alias("p"))
    counts = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total")).withColumn("distinct2", F.coalesce(F.round(F.try_divide("n_distinct", "n_total"), 6), F.lit(0.0)))

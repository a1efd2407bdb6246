"""Choosing rows: fallback layers, coverage, neighbours with scores, caps, samples, and consistency of several runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import unit_hash
from .history import cosine

ALPHA = 0.6


def turn_position(turn: Column) -> Column:
    """``first`` up to turn 1, ``final`` from turn 8 on, else ``mid``."""
    return F.when(turn <= 1, "first").when(turn >= 8, "final").otherwise("mid")


def coverage_key(row: dict[str, Column], by: str) -> Column:
    """The bucket of a demo by specificity, category, turn position, the first two or all three (``all``)."""
    columns = {"specificity": ["specificity"], "category": ["category"], "turn": ["turn"], "specificity_category": ["specificity", "category"], "all": ["specificity", "category", "turn"]}[by]
    return F.concat_ws("|", *(F.coalesce(row[c], F.lit("unknown")) for c in columns))


def fallback(wanted: DataFrame, demos: DataFrame, layers: list[list[str]], n: int, key: str, ident: str, score: str) -> DataFrame:
    """``key, ident, level, place``: up to n demos per wanted row, layer by layer (columns that must agree), best score first, none twice.

    Rows that agree in all columns of all layers want the same demos, and a layer's bucket offers its n best only, so a wanted
    row meets n demos a layer, whatever the sizes.  An empty layer offers the best of all.
    """
    columns = sorted({c for layer in layers for c in layer})
    kinds = wanted.select(*columns).distinct()
    found = None
    for level, layer in enumerate(layers):
        best = Window.partitionBy(*layer).orderBy(F.desc(score), ident) if layer else Window.orderBy(F.desc(score), ident)
        offer = demos if layer else demos.orderBy(F.desc(score), ident).limit(n)
        offer = offer.withColumn("_i", F.row_number().over(best)).where(F.col("_i") <= n).select(*layer, ident, score)
        part = kinds.join(offer, layer) if layer else kinds.crossJoin(F.broadcast(offer))
        part = part.select(*columns, ident, score, F.lit(level).alias("level"))
        found = part if found is None else found.unionByName(part)
    once = found.groupBy(*columns, ident).agg(F.min("level").alias("level"), F.max(score).alias(score))
    order = Window.partitionBy(*columns).orderBy("level", F.desc(score), ident)
    chosen = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    same = None
    for c in columns:
        test = wanted[c].eqNullSafe(chosen[c])
        same = test if same is None else same & test
    return wanted.join(chosen, same).select(wanted[key], chosen[ident], chosen["level"], chosen["place"])


def min_max(rows: DataFrame, score: str, name: str, by: list[str] | None = None) -> DataFrame:
    """``rows`` with the score between 0 and 1 over all rows (or each group); a constant score is 0."""
    span = rows.groupBy(*(by or [])).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    both = rows.join(F.broadcast(span), by) if by else rows.crossJoin(F.broadcast(span))
    return both.withColumn(name, F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def blend(found: DataFrame, sim: str, score: str, bonus: Column, k: int, by: str, ident: str, alpha: float = ALPHA, digits: int = 6) -> DataFrame:
    """The k best of each query's neighbours by ``alpha * sim + (1 - alpha) * score + bonus``."""
    total = F.round(alpha * F.col(sim) + (1 - alpha) * F.col(score) + bonus, digits)
    order = Window.partitionBy(by).orderBy(F.desc("blended"), ident)
    return found.withColumn("blended", total).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def covering(rows: DataFrame, bucket: str, score: str, ident: str, n: int, least: int) -> DataFrame:
    """``rows`` of a choice of n with ``pass``: first up to ``least`` of each bucket, larger buckets first, then the best of the rest."""
    sizes = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_size"))
    best = Window.partitionBy(bucket).orderBy(F.desc(score), ident)
    # Only the n best of a bucket can be chosen, so the final order is over n rows a bucket.
    few = rows.withColumn("_i", F.row_number().over(best)).where(F.col("_i") <= n).join(sizes, bucket)
    first = F.col("_i") <= least
    ordered = few.orderBy(F.when(first, 0).otherwise(1), F.when(first, -F.col("_size")), F.when(first, F.col(bucket)), F.desc(score), ident).limit(n)
    return ordered.withColumn("pass", F.when(first, 1).otherwise(2)).drop("_i", "_size")


def largest_groups(rows: DataFrame, by: list[str], group: str, order: str, n: int, other: str = "discovery") -> DataFrame:
    """``rows`` with ``kept_group``: the n largest groups of each query (of equal ones that of the smaller name), all else is ``other``."""
    sizes = rows.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "_o", group))
    kept = sizes.withColumn("_r", rank).select(*by, group, (F.col("_r") <= n).alias("_kept"))
    return rows.join(kept, [*by, group]).withColumn("kept_group", F.when(F.col("_kept"), F.col(group)).otherwise(F.lit(other))).drop("_kept")


def sample(rows: DataFrame, n: int, *key: Column, seed: str = "42") -> DataFrame:
    """n rows in hashed order, equal on every run."""
    return rows.orderBy(unit_hash(F.lit(seed), *key), *key).limit(n)


def consistent(runs: list[DataFrame], keys: list[str]) -> DataFrame:
    """``run, missing, extra``: keys that a run lacks, or has beyond those of the first run; all 0 if they can be joined."""
    first, out = runs[0].select(*keys).distinct(), None
    for i, run in enumerate(runs[1:], 1):
        own = run.select(*keys).distinct()
        part = first.join(own, keys, "left_anti").agg(F.lit(i).alias("run"), F.count(F.lit(1)).alias("missing")).crossJoin(F.broadcast(own.join(first, keys, "left_anti").agg(F.count(F.lit(1)).alias("extra"))))
        out = part if out is None else out.unionByName(part)
    return out


def score_summary(rows: DataFrame, scores: list[str], digits: int = 6) -> DataFrame:
    """``score, mean, n, histogram``: mean of each score and how often each rounded value occurs."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("x")) for s in scores))).alias("e")).select("e.*").where(F.col("x").isNotNull())
    per = each.groupBy("score", F.bround("x").cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "n"))), lambda v: F.concat(v["value"].cast("string"), F.lit(":"), v["n"].cast("string"))), "|")
    return per.groupBy("score").agg(F.round(F.sum("s") / F.sum("n"), digits).alias("mean"), F.sum("n").alias("n"), text.alias("histogram"))


def nearest_pool(truth: DataFrame, vectors: DataFrame, key: str, n: int, digits: int = 6) -> DataFrame:
    """``key, place, track_id``: the true tracks of each query, then the nearest to its first one, each once, n in all.

    ``truth``: key, place, track_id; neighbours come from ``dense_top_k`` over the distinct first tracks.
    """
    from .ranking import dense_top_k

    first = truth.where(F.col("place") == 0).select(key, F.col("track_id").alias("_first"))
    wanted = vectors.join(first.select(F.col("_first").alias("track_id")).distinct(), "track_id", "left_semi")
    near = dense_top_k(wanted, vectors, n + 1, "track_id", "vector").select(F.col("query_id").alias("_first"), "track_id", F.col("rank").alias("r"))
    rows = truth.select(key, "track_id", F.lit(0).alias("part"), "place").unionByName(first.join(near, "_first").select(key, "track_id", F.lit(1).alias("part"), F.col("r").alias("place")))
    once = rows.groupBy(key, "track_id").agg(F.min(F.struct("part", "place")).alias("at"))
    order = Window.partitionBy(key).orderBy("at", "track_id")
    return once.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < n).select(key, "place", "track_id")


def intents(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, by: str, query_least: float, prior_least: float, pair_least: float, digits: int = 6) -> DataFrame:
    """``by, track_id, intent``: why each candidate is there: near the query, near something heard before, in a group of near candidates, else discovery.

    ``candidates``: by, track_id (a top list); ``queries``: by, vector, seen.  Groups of two or more are candidates with a near other one.
    """
    c = candidates.join(vectors.withColumnRenamed("vector", "_v"), "track_id", "left")
    to_query = F.round(cosine(F.col("_v"), F.col("vector")), digits)
    c = c.join(queries.select(by, "vector"), by, "left").withColumn("_q", F.coalesce(to_query >= query_least, F.lit(False))).drop("vector")
    heard = queries.select(by, F.explode("seen").alias("_t")).join(vectors.select(F.col("track_id").alias("_t"), F.col("vector").alias("_w")), "_t")
    near = c.join(heard, by).where(F.round(cosine(F.col("_v"), F.col("_w")), digits) >= prior_least).select(by, "track_id").distinct().withColumn("_p", F.lit(True))
    other = c.select(by, F.col("track_id").alias("_t"), F.col("_v").alias("_w"))
    tied = c.join(other, by).where((F.col("track_id") != F.col("_t")) & (F.round(cosine(F.col("_v"), F.col("_w")), digits) >= pair_least)).select(by, "track_id").distinct().withColumn("_g", F.lit(True))
    named = c.join(near, [by, "track_id"], "left").join(tied, [by, "track_id"], "left")
    return named.select(by, "track_id", F.when(F.col("_q"), "query").when(F.col("_p"), "taste").when(F.col("_g"), "group").otherwise("discovery").alias("intent"))

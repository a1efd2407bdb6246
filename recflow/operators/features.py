"""Features for reranking: ranks and scores per pool, agreement of pools, target encoding, hard negatives."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import DIGITS, QUERY, RRF_K, top_n
from .ranking import numbered as place


def fused_features(rankings: DataFrame, pools: list[str], n: int, keys: list[str] | None = None) -> DataFrame:
    """The n best tracks of each query by reciprocal rank fusion, with ``score, rank`` (from 0) and ``rank_<pool>`` (from 1)
    and ``score_<pool>`` of every pool, null where missing.  Fusion and features are one aggregation over the rankings."""
    keys = keys or QUERY
    value = (1.0 / (RRF_K + F.col("rank") + 1)).cast("decimal(20,15)")
    wide = rankings.groupBy(*keys, "track_id").agg(
        F.round(F.sum(value).cast("double"), DIGITS).alias("score"),
        F.min(F.struct("pool_ord", "rank")).alias("first"),
        *(F.min(F.when(F.col("pool") == p, F.col("rank") + 1)).alias(f"rank_{p}") for p in pools),
        *(F.max(F.when(F.col("pool") == p, F.col("score"))).alias(f"score_{p}") for p in pools),
    )
    return top_n(wide, n, keys)


def expert_features(features: DataFrame, pools: list[str]) -> DataFrame:
    """Agreement of pools: ``hits, rank_min, rank_mean, rank_std`` (sample, 0 where undefined)``, rank_span, best_pool`` and,
    of each two pools in order, ``rank_gap_<first>__<second>``, null unless both hold the track."""
    ranks = F.array_compact(F.array(*(F.col(f"rank_{p}") for p in pools)))
    n = F.size("_r")
    mean = F.aggregate("_r", F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate("_r", F.lit(0.0), lambda a, x: a + (x - F.col("rank_mean")) * (x - F.col("rank_mean")))
    best = F.coalesce(*(F.when(F.col(f"rank_{p}") == F.array_min("_r"), F.lit(p)) for p in pools), F.lit("<none>"))
    return (
        features.withColumn("_r", ranks)
        .withColumn("hits", n)
        .withColumn("rank_min", F.array_min("_r"))
        .withColumn("rank_mean", F.when(n > 0, mean))
        .withColumn("rank_std", F.round(F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(0.0), 6))
        .withColumn("rank_span", F.coalesce(F.array_max("_r") - F.array_min("_r"), F.lit(0)))
        .withColumn("rank_mean", F.round("rank_mean", 6))
        .withColumn("best_pool", best)
        .withColumns({f"rank_gap_{a}__{b}": F.col(f"rank_{a}") - F.col(f"rank_{b}") for a, b in combinations(pools, 2)})
        .drop("_r")
    )


def min_rank(df: DataFrame, group: list[str], score: str, name: str) -> DataFrame:
    """Rank by falling score; equal scores share the least rank, missing ones come last."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last())))


def rank_bucket(rank: Column) -> Column:
    return (
        F.when(rank.isNull() | (rank <= 0), "missing").when(rank <= 1, "r1").when(rank <= 3, "r2_3").when(rank <= 10, "r4_10")
        .when(rank <= 20, "r11_20").when(rank <= 50, "r21_50").when(rank <= 100, "r51_100").otherwise("r101p")
    )


def encoding_table(df: DataFrame, key: str, label: str, fold: str, alpha: float = 50.0, digits: int = 9) -> DataFrame:
    """``key, fold, te, n``: the smoothed mean label of the key over the other folds, (sum + alpha * mean) / (n + alpha).

    Sums per key and fold are small; a row's own fold is taken out by subtraction, so nothing is joined per fold.
    """
    per = df.groupBy(key, fold).agg(F.sum(F.col(label).cast("long")).alias("_y"), F.count(F.lit(1)).alias("n"))
    by_key, everything = Window.partitionBy(key), Window.partitionBy()
    folds = per.groupBy(fold).agg(F.sum("_y").alias("_fy"), F.sum("n").alias("_fn"))
    folds = folds.select(fold, ((F.sum("_fy").over(everything) - F.col("_fy")) / (F.sum("_fn").over(everything) - F.col("_fn"))).alias("_mean"))
    out = per.withColumn("_ky", F.sum("_y").over(by_key) - F.col("_y")).withColumn("_kn", F.sum("n").over(by_key) - F.col("n")).join(F.broadcast(folds), fold)
    te = (F.col("_ky") + alpha * F.col("_mean")) / (F.col("_kn") + alpha)
    return out.select(key, fold, F.round(te, digits).alias("te"), "n")


def target_encode(df: DataFrame, key: str, label: str, fold: str, alpha: float = 50.0, digits: int = 9) -> DataFrame:
    """``df`` with ``te_<key>`` of ``encoding_table``."""
    maps = encoding_table(df, key, label, fold, alpha, digits).select(F.col(key).alias("_key"), F.col(fold).alias("_fold"), F.col("te").alias(f"te_{key}"))
    return df.join(maps, F.col(key).eqNullSafe(F.col("_key")) & (F.col(fold) == F.col("_fold")), "left").drop("_key", "_fold")


def encoding_state(df: DataFrame, key: str, label: str, alpha: float = 50.0, digits: int = 9) -> DataFrame:
    """``key, te``: the encoding fitted on all rows, for rows of other tables; keys not in it get the mean label."""
    total = df.agg(F.avg(F.col(label).cast("double")).alias("_mean"))
    sums = df.groupBy(key).agg(F.sum(F.col(label).cast("long")).alias("_y"), F.count(F.lit(1)).alias("_n"))
    return sums.crossJoin(F.broadcast(total)).select(key, F.round((F.col("_y") + alpha * F.col("_mean")) / (F.col("_n") + alpha), digits).alias("te"))


#: Ways to draw hard negatives with their weights, by specificity of the request (fixed values).
NEGATIVE_SHARES = {
    "HH": (("bm25-topk", 0.3), ("same-album", 0.3), ("same-artist", 0.3), ("same-tag", 0.1)),
    "HL": (("bm25-topk", 0.3), ("same-tag", 0.4), ("same-pop-bucket", 0.2), ("same-album", 0.1)),
    "LH": (("bm25-topk", 0.3), ("same-artist", 0.3), ("same-album", 0.2), ("same-tag", 0.2)),
    "LL": (("off", 1.0),),
}


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: equal on every engine."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / 4294967296.0


def bm25_negatives(pairs: DataFrame, k: int, seed: str = "42") -> DataFrame:
    """``pair_id, track_id, slot``: k candidates of each pair's text search that are neither its track nor seen, in hashed order."""
    rows = pairs.select("pair_id", F.col("track_id").alias("positive"), F.coalesce("seen", F.array().cast("array<string>")).alias("seen"), F.explode(F.array_distinct("bm25_top_tids")).alias("track_id"))
    free = rows.where(F.col("track_id").isNotNull() & ~F.col("track_id").eqNullSafe(F.col("positive")) & ~F.coalesce(F.array_contains("seen", F.col("track_id")), F.lit(False)))
    order = Window.partitionBy("pair_id").orderBy(unit_hash(F.lit(seed), F.col("pair_id").cast("string"), F.col("track_id")), "track_id")
    return free.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= k).select("pair_id", "track_id", "slot")


def same_key_negatives(pairs: DataFrame, catalog: DataFrame, key: Column, k: int, seed: str = "42") -> DataFrame:
    """``pair_id, track_id, slot``: k tracks with the same key (artist, album, popularity bucket) as the positive."""
    tracks = catalog.select("track_id", key.alias("key")).where(F.col("key").isNotNull())
    own = pairs.select("pair_id", "track_id").join(tracks, "track_id")
    return keyed_negatives(own, tracks, "key", k, seed)


def keyed_negatives(own: DataFrame, tracks: DataFrame, key: str, k: int, seed: str = "42") -> DataFrame:
    """``pair_id, track_id, slot``: k tracks of the key of each pair.  ``own``: pair_id, track_id, key; ``tracks``: track_id, key.

    Keys can hold any number of tracks, so a pair is not joined with all of them: the tracks of a key are
    numbered in hashed order, and a pair takes the k + 1 numbers that follow its own hash.
    """
    sizes = tracks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), "track_id"))
    order = [unit_hash(F.lit(seed), F.col("track_id")), F.col("track_id")]
    numbered = place(tracks, [key], F.substring(digest, 1, 3), order, "i").withColumn("i", F.col("i") - 1)
    own = own.withColumnRenamed("track_id", "positive").join(sizes, key)
    ident = F.col("pair_id").cast("string")
    start = F.floor(unit_hash(F.lit(seed), ident) * F.col("n")).cast("int")
    wanted = own.withColumn("step", F.explode(F.sequence(F.lit(0), F.least(F.col("n") - 1, F.lit(k)).cast("int")))).withColumn("i", F.pmod(start + F.col("step"), F.col("n")).cast("int"))
    found = wanted.join(numbered, [key, "i"]).where(F.col("track_id") != F.col("positive"))
    return found.withColumn("slot", F.row_number().over(Window.partitionBy("pair_id").orderBy("step"))).where(F.col("slot") <= k).select("pair_id", "track_id", "slot")


def negative_mixture(pairs: DataFrame, tracks: DataFrame, k: int, seed: str = "42", shares: dict | None = None) -> DataFrame:
    """``pair_id, slot, way, track_id``: up to k negatives of each pair, drawn in ways that depend on its specificity.

    Each slot draws a way by weight (from a hash of pair and slot) and takes that way's next track; a way without one
    gives way to the others by falling weight.  ``pairs``: pair_id, track_id, specificity, seen, bm25_top_tids, track_artist,
    track_album, track_top_tags, track_pop_bucket; ``tracks``: track_id, artist, album, tags, bucket.  Each way offers at most
    2 k + 2 numbered tracks a pair (see ``same_key_negatives``), so no pair meets all tracks of a key.
    """
    shares = shares or NEGATIVE_SHARES
    offer = 2 * k + 2
    ids = pairs.select("pair_id", "track_id", "specificity", "seen", "bm25_top_tids", "track_top_tags")
    keyed = tracks.select("track_id", "artist", "album", "bucket")
    by = {name: same_key_negatives(ids, keyed, F.col(c), offer, seed) for name, c in (("same-artist", "artist"), ("same-album", "album"), ("same-pop-bucket", "bucket"))}
    by["bm25-topk"] = bm25_negatives(ids, offer, seed)
    # Of a positive's tags each offers its numbered tracks; the first offer of a track counts.
    tagged = tracks.select("track_id", F.explode(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("tag"))
    named = ids.select("pair_id", "track_id", F.posexplode(F.slice("track_top_tags", 1, 3)).alias("_t", "tag")).select(F.concat_ws("|", "pair_id", "_t").alias("pair_id"), "track_id", "tag")
    of_tags = keyed_negatives(named, tagged, "tag", offer, seed).select(F.split_part("pair_id", F.lit("|"), F.lit(1)).cast(dict(ids.dtypes)["pair_id"]).alias("pair_id"), "track_id", (F.split_part("pair_id", F.lit("|"), F.lit(2)).cast("int") * offer + F.col("slot")).alias("slot"))
    by["same-tag"] = of_tags.groupBy("pair_id", "track_id").agg(F.min("slot").alias("slot"))
    offers = None
    for name, part in by.items():
        part = part.select("pair_id", F.lit(name).alias("way"), "track_id", "slot")
        offers = part if offers is None else offers.unionByName(part)
    free = offers.join(ids.select("pair_id", F.coalesce("seen", F.array().cast("array<string>")).alias("_seen"), "specificity", F.col("track_id").alias("_own")), "pair_id")
    free = free.where(~F.coalesce(F.array_contains("_seen", F.col("track_id")), F.lit(False)) & (F.col("track_id") != F.col("_own")))
    listed = free.groupBy("pair_id", "specificity").agg(F.array_sort(F.collect_list(F.struct("way", "slot", "track_id"))).alias("offers"))
    plan = F.create_map(*(x for spec, ways in shares.items() for x in (F.lit(spec), F.array(*(F.struct(F.lit(w).alias("way"), F.lit(float(p)).alias("p")) for w, p in ways)))))
    listed = listed.withColumn("ways", F.filter(F.coalesce(F.try_element_at(plan, F.upper(F.trim("specificity"))), F.array().cast("array<struct<way:string,p:double>>")), lambda x: x["way"] != "off")).where(F.size("ways") > 0)
    total = F.aggregate("ways", F.lit(0.0), lambda a, x: a + x["p"])
    falling = F.transform(F.array_sort(F.transform("ways", lambda x, i: F.struct((-x["p"]).alias("m"), i.alias("i"), x["way"].alias("way")))), lambda x: x["way"])

    def next_pick(picks: Column, slot: Column) -> Column:
        """The first free offer of the way that the slot draws, else of the others in order; none or one, as an array."""
        at = unit_hash(F.lit(seed), F.col("pair_id").cast("string"), slot.cast("string")) * F.col("_total")
        passed = lambda acc, x: F.struct((acc["c"] + x["p"]).alias("c"), F.when(acc["way"].isNull() & (at < acc["c"] + x["p"]), x["way"]).otherwise(acc["way"]).alias("way"))
        drawn = F.aggregate("ways", F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("string").alias("way")), passed)["way"]
        order = F.array_distinct(F.concat(F.array(F.coalesce(drawn, F.get("ways", F.size("ways") - 1)["way"])), F.col("_falling")))
        free = F.filter("offers", lambda o: ~F.exists(picks, lambda p: p["track_id"] == o["track_id"]))
        first = F.slice(F.flatten(F.transform(order, lambda w: F.slice(F.filter(free, lambda o: o["way"] == w), 1, 1))), 1, 1)
        return F.transform(first, lambda o: F.struct(slot.alias("slot"), o["way"].alias("way"), o["track_id"].alias("track_id")))

    none = F.array().cast("array<struct<slot:int,way:string,track_id:string>>")
    listed = listed.withColumn("_total", total).withColumn("_falling", falling)
    picks = F.aggregate(F.sequence(F.lit(1), F.lit(k)), none, lambda picks, slot: F.concat(picks, next_pick(picks, slot)))
    return listed.select("pair_id", F.explode(picks).alias("p")).select("pair_id", "p.*")

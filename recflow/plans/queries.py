"""The registered queries of the core operators and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cues
from ..functions import text as tx
from ..operators import evaluation, features, history, postprocess, quality, ranking, retrieval, slicing, splits
from ..sources.tables import catalog, table
from .recommend import CANDIDATES, eval_pairs, pool_rankings, recommend

Spark = SparkSession


def q_turn_slices(s: Spark, d: str) -> DataFrame:
    t = slicing.turn_slices(table(s, d, "messages"))
    return t.select("session_id", "turn_number", "query", F.array_join("tracks", "|").alias("tracks"), "n_history", F.array_join("seen", "|").alias("seen"))


def q_last_turns(s: Spark, d: str) -> DataFrame:
    return slicing.last_turn_slices(table(s, d, "messages"))


def q_strata(s: Spark, d: str) -> DataFrame:
    return slicing.normalised_strata(table(s, d, "sessions"))


def q_popularity(s: Spark, d: str) -> DataFrame:
    return ranking.popularity(table(s, d, "train_pairs", "split", "track_id").where("split = 'train'"))


def q_popular_top20(s: Spark, d: str) -> DataFrame:
    return ranking.top_popular(table(s, d, "train_pairs", "split", "track_id").where("split = 'train'"), 20)


def q_seen_filter(s: Spark, d: str) -> DataFrame:
    pairs = eval_pairs(table(s, d, "train_pairs"))
    kept = ranking.unseen(ranking.from_array(pairs, "bm25_top_tids", "bm25", 0, ["pair_id"]), pairs, keys=["pair_id"])
    order = Window.partitionBy("pair_id").orderBy("rank")
    return kept.withColumn("place", F.row_number().over(order) - 1).where("place < 10").select("pair_id", "track_id", "place")


def _fused(s: Spark, d: str, how) -> DataFrame:
    rankings, _ = pool_rankings(s, d)
    return ranking.top_n(how(rankings, ["pair_id"]), 20, ["pair_id"]).select("pair_id", "track_id", F.round("score", 9).alias("score"), "rank")


def q_recommend(s: Spark, d: str) -> DataFrame:
    return recommend(s, d)


def _scores(s: Spark, d: str) -> DataFrame:
    pairs = eval_pairs(table(s, d, "train_pairs"))
    scores = evaluation.per_query(recommend(s, d), pairs.select("pair_id", "track_id"), 20, ["pair_id"])
    return scores.join(pairs.select("pair_id", "split", F.col("turn_number").cast("double").alias("turn_number"), F.coalesce(F.upper(F.trim("specificity")), F.lit("unknown")).alias("specificity")), "pair_id")


def q_eval_strata(s: Spark, d: str) -> DataFrame:
    return evaluation.by_strata(_scores(s, d), [[], ["split"], ["turn_number"], ["specificity"], ["turn_number", "specificity"]])


def q_eval_per_query(s: Spark, d: str) -> DataFrame:
    return _scores(s, d).select("pair_id", "n_truth", "hits", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))


def q_catalog_diversity(s: Spark, d: str) -> DataFrame:
    return evaluation.catalog_diversity(recommend(s, d), table(s, d, "tracks", "track_id"))


def q_lexical_diversity(s: Spark, d: str) -> DataFrame:
    m = slicing.distinct_messages(table(s, d, "messages"))
    return evaluation.distinct_bigrams(m.where("speaker = 'assistant'"), "content")


def q_tag_freq(s: Spark, d: str) -> DataFrame:
    tags = catalog(table(s, d, "tracks")).select(F.explode(tx.clean_tags(F.col("tag_list"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def q_track_features(s: Spark, d: str) -> DataFrame:
    t = catalog(table(s, d, "tracks"))
    c = F.col
    return t.select(
        "track_id", tx.first_filled(c("track_name")).alias("title"), tx.year(c("release_date")).alias("year"), tx.decade(c("release_date")).alias("decade"),
        tx.decade_phrase(c("release_date")).alias("era"), tx.popularity_round(c("popularity")).cast("double").alias("popularity"), tx.popularity_bucket(c("popularity")).alias("bucket"),
        tx.popularity_phrase(c("popularity")).alias("phrase"), F.array_join(tx.clean_tags(c("tag_list")), "|").alias("tags"), F.array_join(tx.search_tags(c("tag_list")), "|").alias("search_tags"),
    )


def q_track_text(s: Spark, d: str) -> DataFrame:
    t = catalog(table(s, d, "tracks"))
    doc = tx.track_text(*(F.col(c) for c in ("track_name", "artist_name", "album_name", "release_date", "popularity", "tag_list")))
    return t.select("track_id", doc.alias("doc")).withColumn("doc_hash", tx.hash16(F.col("doc")))


def q_quality_flags(s: Spark, d: str) -> DataFrame:
    return quality.flags(table(s, d, "track_crawl")).select("crawl_id", F.array_join("flags", "|").alias("flags"), "ok")


def q_flag_counts(s: Spark, d: str) -> DataFrame:
    return quality.flag_counts(quality.flags(table(s, d, "track_crawl")))


def q_crawl_coverage(s: Spark, d: str) -> DataFrame:
    return quality.coverage(table(s, d, "track_crawl"))


def q_crawl_sources(s: Spark, d: str) -> DataFrame:
    return quality.source_counts(table(s, d, "track_crawl", "sources"))


def q_duplicate_lyrics(s: Spark, d: str) -> DataFrame:
    return quality.duplicate_texts(table(s, d, "track_crawl", "track_id", "lyrics"))


def q_latest_crawl(s: Spark, d: str) -> DataFrame:
    from ..sources.tables import latest_per_key

    return latest_per_key(table(s, d, "track_crawl", "track_id", "crawl_id", "tempo", "fetched_at"), ["track_id"], [F.col("fetched_at"), F.col("crawl_id")])


def q_request_pairs(s: Spark, d: str) -> DataFrame:
    return history.request_pairs(table(s, d, "messages"))


def q_user_profiles(s: Spark, d: str) -> DataFrame:
    return history.user_profiles(table(s, d, "messages"), table(s, d, "sessions", "session_id", "user_id", "session_date"))


def q_prior_sessions(s: Spark, d: str) -> DataFrame:
    return history.prior_sessions(table(s, d, "sessions", "session_id", "user_id", "session_date"))


def q_view_before_purchase(s: Spark, d: str) -> DataFrame:
    return history.last_before(table(s, d, "events"), "purchase", "view")


def _features(s: Spark, d: str) -> DataFrame:
    rankings, _ = pool_rankings(s, d)
    wide = features.fused_features(rankings, list(CANDIDATES), 20, ["pair_id"])
    pairs = eval_pairs(table(s, d, "train_pairs"))
    return wide.join(pairs.select("pair_id", F.col("track_id").alias("truth"), "session_id", "specificity"), "pair_id").withColumn("label", (F.col("track_id") == F.col("truth")).cast("int"))


def q_expert_features(s: Spark, d: str) -> DataFrame:
    f = features.expert_features(_features(s, d), list(CANDIDATES))
    return f.select("pair_id", "track_id", *(F.col(f"rank_{p}").cast("double").alias(f"rank_{p}") for p in CANDIDATES), "hits", "rank_min", "rank_mean", "rank_std", "rank_span", "best_pool", F.col("rank_gap_bm25__popular").cast("double").alias("rank_gap"), "label")


def q_target_encoding(s: Spark, d: str) -> DataFrame:
    f = _features(s, d).withColumn("bucket", features.rank_bucket(F.col("rank_bm25")))
    folded = splits.k_folds(f, F.lower(F.regexp_replace("session_id", "-", "")), 5)
    return features.encoding_table(folded, "bucket", "label", "fold")


def q_min_rank(s: Spark, d: str) -> DataFrame:
    t = catalog(table(s, d, "tracks")).select("track_id", tx.first_filled(F.col("artist_name")).alias("artist"), "popularity")
    return features.min_rank(t, ["artist"], "popularity", "place")


def q_group_folds(s: Spark, d: str) -> DataFrame:
    rows = table(s, d, "train_pairs", "pair_id", "session_id")
    return splits.k_folds(rows, F.lower(F.regexp_replace("session_id", "-", "")), 5).select("pair_id", "fold")


def q_bm25_negatives(s: Spark, d: str) -> DataFrame:
    return features.bm25_negatives(table(s, d, "train_pairs", "pair_id", "split", "track_id", "seen", "bm25_top_tids").where("split = 'train'"), 4)


def q_artist_negatives(s: Spark, d: str) -> DataFrame:
    pairs = table(s, d, "train_pairs", "pair_id", "split", "track_id").where("split = 'train'")
    return features.same_key_negatives(pairs, catalog(table(s, d, "tracks")), tx.first_filled(F.col("artist_name")), 4)


def q_dense_top10(s: Spark, d: str) -> DataFrame:
    v = table(s, d, "embeddings", "vec_id", "embedding")
    return ranking.dense_top_k(v.where("vec_id % 100 = 0"), v, 10, "vec_id", "embedding")


def q_bm25_search(s: Spark, d: str) -> DataFrame:
    t = catalog(table(s, d, "tracks"))
    doc = tx.track_text(*(F.col(c) for c in ("track_name", "artist_name", "album_name", "release_date", "popularity", "tag_list")))
    queries = table(s, d, "train_pairs", "pair_id", "query")
    return retrieval.search(queries, t.select("track_id", doc.alias("doc")), 10, "pair_id", "query", "track_id", "doc")


def q_weighted_fuse(s: Spark, d: str) -> DataFrame:
    rankings, _ = pool_rankings(s, d)
    fused = ranking.top_n(ranking.rrf(rankings, ["pair_id"]), 20, ["pair_id"])
    return ranking.weighted_fuse(fused, rankings.where("pool = 'popular'"), 0.5, ["pair_id"])


def q_fold_mean(s: Spark, d: str) -> DataFrame:
    rankings, _ = pool_rankings(s, d)
    folded = rankings.withColumn("pool", F.concat(F.lit("tower_fold"), (F.col("rank") % 3).cast("string")))
    return ranking.fold_mean(folded, ["pair_id"])


def q_violations(s: Spark, d: str) -> DataFrame:
    r = recommend(s, d).groupBy("pair_id").agg(F.collect_list("track_id").alias("predicted_track_ids"))
    r = r.select(F.col("pair_id").cast("string").alias("session_id"), F.lit("").alias("user_id"), F.lit(1).alias("turn_number"), "predicted_track_ids", F.when(F.col("pair_id") % 2 == 0, "").alias("predicted_response"), F.lit(0).alias("more"))
    return postprocess.violations(r, table(s, d, "tracks", "track_id"))


def q_diversified(s: Spark, d: str) -> DataFrame:
    rankings, _ = pool_rankings(s, d)
    r = ranking.top_n(ranking.rrf(rankings, ["pair_id"]), 80, ["pair_id"])
    return postprocess.diversify(r.select(F.col("pair_id").cast("string").alias("query"), F.col("pair_id").alias("ord"), "track_id", "rank"))


def q_round_robin(s: Spark, d: str) -> DataFrame:
    rows = table(s, d, "train_pairs", "pair_id", "specificity").withColumn("stratum", F.coalesce("specificity", F.lit("")))
    return postprocess.round_robin(rows, "stratum", "pair_id").select("pair_id", "stratum", "turn")


def q_era_cues(s: Spark, d: str) -> DataFrame:
    return table(s, d, "train_pairs", "pair_id", "query").select("pair_id", F.array_join(cues.eras(F.col("query")), "|").alias("eras"))


def q_cited_titles(s: Spark, d: str) -> DataFrame:
    m = slicing.distinct_messages(table(s, d, "messages")).where("speaker = 'assistant'")
    titles = m.select(F.explode(cues.quoted_titles(F.col("content"))).alias("title"))
    return titles.groupBy(cues.title_key(F.col("title")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("spellings"))


def q_profile_keys(s: Spark, d: str) -> DataFrame:
    p = table(s, d, "sessions", "user_profile").where("user_profile IS NOT NULL")
    return p.groupBy(cues.profile_key(F.col("user_profile")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def q_overused_words(s: Spark, d: str) -> DataFrame:
    m = slicing.distinct_messages(table(s, d, "messages")).where("speaker = 'assistant'")
    kept = F.filter(tx.words(F.col("content")), lambda x: (F.length(x) >= 4) & x.rlike("^[a-z]+$") & ~x.isin(*tx.STOP_WORDS))
    counts = m.select(F.explode(F.array_distinct(kept)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n >= 5").orderBy(F.desc("n"), "word").limit(25)


def q_overused_bigrams(s: Spark, d: str) -> DataFrame:
    m = slicing.distinct_messages(table(s, d, "messages")).where("speaker = 'assistant'")
    kept = F.filter(tx.words(F.col("content")), lambda x: (F.length(x) >= 4) & x.rlike("^[a-z]+$") & ~x.isin(*tx.STOP_WORDS))
    w = m.select(kept.alias("w")).where(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    counts = w.select(F.explode(F.array_distinct(pairs)).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n >= 3").orderBy(F.desc("n"), "bigram").limit(25)


def q_artist_overview(s: Spark, d: str) -> DataFrame:
    t = catalog(table(s, d, "tracks")).select(tx.first_filled(F.col("artist_name")).alias("artist"), tx.year(F.col("release_date")).cast("int").alias("year"))
    g = t.groupBy("artist").agg(F.count(F.lit(1)).alias("n_tracks"), F.min("year").alias("y0"), F.max("year").alias("y1"), F.array_sort(F.collect_list("year")).alias("ys"))
    # The upper median, not an interpolated one.
    upper = F.get("ys", F.floor(F.size("ys") / 2).cast("int"))
    return g.select("artist", "n_tracks", F.col("y0").cast("double").alias("first_year"), F.col("y1").cast("double").alias("last_year"), upper.cast("double").alias("median_year"))


def q_goal_progress_tail(s: Spark, d: str) -> DataFrame:
    p = table(s, d, "sessions", "session_id", "goal_progress_assessments").select("session_id", F.explode("goal_progress_assessments").alias("g")).select("session_id", "g.turn_number", "g.assessment").distinct()
    last = Window.partitionBy("session_id").orderBy(F.desc("turn_number"), F.desc_nulls_last("assessment"))
    return p.withColumn("i", F.row_number().over(last)).where("i <= 3 AND trim(assessment) <> ''").select("session_id", "turn_number", "assessment")


def q_query_groups(s: Spark, d: str) -> DataFrame:
    p = table(s, d, "train_pairs", "pair_id", "session_id", "query", "doc_text").withColumn("q", F.trim("query")).where("q <> '' AND trim(doc_text) <> ''")
    return p.groupBy("q").agg(F.countDistinct("doc_text").alias("n_docs"), F.countDistinct(F.lower(F.regexp_replace("session_id", "-", ""))).alias("n_sessions"), F.min("pair_id").alias("first_pair")).where("n_docs > 1")


def q_log_frequency(s: Spark, d: str) -> DataFrame:
    c = table(s, d, "train_pairs", "split", "track_id").where("split = 'train' AND track_id IS NOT NULL").groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    totals = c.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("ids"))
    return c.crossJoin(F.broadcast(totals)).select("track_id", F.round(F.log((F.col("n") + 1) / (F.col("all") + F.col("ids"))), 9).alias("log_q"))


def q_bucket_negatives(s: Spark, d: str) -> DataFrame:
    pairs = table(s, d, "train_pairs", "pair_id", "split", "track_id").where("split = 'train'")
    return features.same_key_negatives(pairs, catalog(table(s, d, "tracks")), tx.popularity_bucket(F.col("popularity")), 4)


def q_match_flags(s: Spark, d: str) -> DataFrame:
    return quality.match_flags(table(s, d, "track_crawl")).select("crawl_id", F.array_join("flags", "|").alias("flags"))


def q_composed_queries(s: Spark, d: str) -> DataFrame:
    """Request texts with a line for each earlier track, in order of play."""
    t = slicing.turn_slices(table(s, d, "messages")).select("session_id", "turn_number", "query", F.posexplode_outer("seen").alias("i", "track_id"))
    c = catalog(table(s, d, "tracks"))
    line = F.concat(F.lit("title: "), F.lower(F.coalesce(tx.first_filled(F.col("track_name")), F.lit("unknown"))), F.lit(", artist: "), F.lower(F.coalesce(tx.first_filled(F.col("artist_name")), F.lit("unknown"))))
    lines = t.join(c.select("track_id", line.alias("line")), "track_id", "left")
    g = lines.groupBy("session_id", "turn_number").agg(F.min("query").alias("query"), F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("i", "line")))).alias("ls"))
    text = F.concat_ws("\n", F.transform("ls", lambda x: x["line"]), F.lower("query"))
    return g.select("session_id", "turn_number", F.size("ls").alias("n_lines"), tx.hash16(text).alias("text_hash"), cues.token_estimate(text).alias("tokens"))


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
QUERIES["rrf_fusion"] = lambda s, d: _fused(s, d, ranking.rrf)
QUERIES["rbc_fusion"] = lambda s, d: _fused(s, d, ranking.rbc)
QUERIES["recommend_top20"] = QUERIES.pop("recommend")

from .more import MORE  # noqa: E402
from .more_oracles import MORE_ORACLES  # noqa: E402
from .oracles import ORACLES  # noqa: E402

QUERIES |= MORE
ORACLES = ORACLES | MORE_ORACLES

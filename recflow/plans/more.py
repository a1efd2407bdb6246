"""Further registered queries: compositions, reports, pools, histories, negatives, citations, selections and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compose, cues
from ..functions import text as tx
from ..operators import citations, evaluation, features, history, pools, postprocess, priors, quality, ranking, selection, slicing, splits
from ..sources import tables
from ..sources.tables import catalog, latest_per_key, table
from .recommend import eval_pairs, pool_rankings, recommend

Spark = SparkSession
TRACK = ("track_name", "artist_name", "album_name", "release_date", "popularity", "tag_list")
CRAWL = ("mb_tags", "label", "country", "tempo", "music_key")
BUDGET = 90


def _tracks(s: Spark, d: str) -> DataFrame:
    return catalog(table(s, d, "tracks"))


def _crawl(s: Spark, d: str) -> DataFrame:
    return latest_per_key(table(s, d, "track_crawl"), ["track_id"], [F.col("fetched_at"), F.col("crawl_id")])


def _vectors(s: Spark, d: str, kind: str | None = None, size: int | None = None, by_track: bool = False) -> DataFrame:
    """``vector_type, track_id, vector``: usable vectors, one a track; of different ones the least.  ``by_track``: already placed for joins by track."""
    v = table(s, d, "track_vectors").where(F.col("track_id").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0))
    if kind:
        v = v.where(F.col("vector_type") == kind)
    if size:
        v = v.where(F.size("vector") == size)
    if by_track:
        v = v.repartition("track_id")
    return v.groupBy("vector_type", "track_id").agg(F.min("vector").alias("vector"))


def _replies(s: Spark, d: str) -> DataFrame:
    return slicing.turns(table(s, d, "messages")).where("reply IS NOT NULL").select("session_id", "turn_number", "reply", "query")


def _key(column: str = "session_id"):
    return F.lower(F.regexp_replace(column, "-", ""))


# Texts


def kept_tags(s: Spark, d: str) -> DataFrame:
    t = compose.with_tag_counts(_tracks(s, d))
    tags = lambda **how: F.array_join(tx.kept_tags(F.col("tag_list"), F.col("tag_counts"), **how), "|")
    return t.select("track_id", tags().alias("tags"), tags(least=2, most=15, dedup=False).alias("doc_tags"), tags(most=3, by_frequency=True).alias("top_tags"))


def track_prose(s: Spark, d: str) -> DataFrame:
    t = compose.with_tag_counts(_tracks(s, d)).join(_crawl(s, d).select("track_id", *CRAWL), "track_id", "left")
    tags = tx.kept_tags(F.col("tag_list"), F.col("tag_counts"), least=2, most=15, dedup=False)
    return t.select("track_id", compose.track_prose({c: F.col(c) for c in (*TRACK, *CRAWL)}, tags).alias("doc"))


def goal_cues(s: Spark, d: str) -> DataFrame:
    g = table(s, d, "sessions", "session_id", "conversation_goal").groupBy("session_id").agg(F.max("conversation_goal.category").alias("c"), F.max("conversation_goal.specificity").alias("s"), F.max("conversation_goal.listener_goal").alias("g"))
    return g.select(
        "session_id", F.array_join(cues.eras(F.col("g")), "|").alias("eras"), cues.first_cue(F.col("g"), cues.POPULARITY_CUES).alias("popularity"), cues.first_cue(F.col("g"), cues.TIME_CUES).alias("time"),
        cues.goal_phrase(F.col("c"), F.col("s")).alias("phrase"), cues.category_words(F.col("c")).alias("category"),
        compose.goal_line(F.struct(F.col("c").alias("category"), F.col("s").alias("specificity"), F.col("g").alias("listener_goal"))).alias("line"),
    )


def _heard(s: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """(turns with a query; session, turn, number and id of each track heard in earlier turns)"""
    t = slicing.turns(table(s, d, "messages"))
    plays = t.select("session_id", F.col("turn_number").alias("_t"), F.posexplode("tracks").alias("i", "track_id"))
    asked = t.where("query IS NOT NULL").select("session_id", "turn_number", "query")
    earlier = asked.select("session_id", "turn_number").join(plays, "session_id").where(F.col("_t") < F.col("turn_number"))
    return asked, earlier


def query_texts(s: Spark, d: str) -> DataFrame:
    t = compose.with_tag_counts(_tracks(s, d))
    t = t.select("track_id", compose.listen_line({c: F.col(c) for c in TRACK}).alias("line"), tx.decade(F.col("release_date")).alias("decade"), tx.popularity_round(F.col("popularity")).alias("pop"), tx.kept_tags(F.col("tag_list"), F.col("tag_counts")).alias("tags"))
    asked, earlier = _heard(s, d)
    one = earlier.join(t, "track_id").groupBy("session_id", "turn_number").agg(F.array_sort(F.collect_list(F.struct("_t", "i", "line", "decade", "pop", "tags"))).alias("h"))
    field = lambda name: F.filter(F.transform("h", lambda x: x[name]), lambda x: x.isNotNull())
    goals = goal_cues(s, d)
    q = asked.join(one, ["session_id", "turn_number"], "left").join(goals, "session_id", "left")
    empty = F.array().cast("array<string>")
    q = q.select(
        "session_id", "turn_number", F.col("query").alias("wish"), F.coalesce(F.filter(F.transform(F.slice(F.reverse("h"), 1, 5), lambda x: x["line"]), lambda x: x.isNotNull()), empty).alias("recent"),
        F.col("phrase").alias("goal"), compose.span(field("decade")).alias("era"), tx.popularity_phrase(compose.upper_median(field("pop")).cast("double")).alias("popularity"), F.coalesce(F.slice(F.array_distinct(F.flatten(field("tags"))), 1, 10), empty).alias("tags"),
        F.filter(F.split(F.coalesce("eras", F.lit("")), r"\|"), lambda x: x != "").alias("goal_eras"), F.col("popularity").alias("goal_popularity"), F.col("time").alias("goal_time"), "category",
    )
    text = compose.query_text({c: F.col(c) for c in q.columns}, BUDGET)
    return q.select("session_id", "turn_number", text.alias("text"), cues.token_estimate(text).alias("tokens"))


def recommended_lists(s: Spark, d: str) -> DataFrame:
    """The recommended tracks of each evaluation pair as numbered lines."""
    t = compose.with_tag_counts(_tracks(s, d))
    tags = tx.clean_tags(F.col("tag_list"))
    rows = recommend(s, d, 5).join(t, "track_id")
    line = compose.recommended_line(F.col("rank") + 1, {c: F.col(c) for c in TRACK}, tags)
    return rows.select("pair_id", "rank", line.alias("line")).groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def crawl_segments(s: Spark, d: str) -> DataFrame:
    c = _crawl(s, d)
    return c.select("track_id", compose.lyric_hook(F.col("lyrics")).alias("hook"), tx.tempo_phrase(F.col("tempo")).alias("pace"), F.array_join(F.coalesce("mb_tags", F.array().cast("array<string>")), ", ").alias("listed"), F.size(compose.split_list(F.array_join("mb_tags", ","))).alias("n_listed"))


def profile_lines(s: Spark, d: str) -> DataFrame:
    p = table(s, d, "sessions", "session_id", "user_profile").groupBy("session_id").agg(F.min("user_profile").alias("p"))
    return p.where("p IS NOT NULL").select("session_id", compose.profile_line(F.col("p")).alias("line"), cues.profile_prompt(F.col("p")).alias("prompt"))


def chat_tails(s: Spark, d: str) -> DataFrame:
    """The last ten messages of each session as lines, music by title."""
    m = slicing.distinct_messages(table(s, d, "messages")).where("speaker IS NOT NULL AND content IS NOT NULL")
    last = Window.partitionBy("session_id").orderBy(F.desc("turn_number"), F.desc("msg_id"))
    m = m.withColumn("i", F.row_number().over(last)).where("i <= 10")
    names = _tracks(s, d).select(F.col("track_id").alias("content"), tx.first_filled(F.col("track_name")).alias("title"))
    lines = m.join(names, "content", "left").select("session_id", "i", F.concat(F.col("speaker"), F.lit(": "), F.when(F.col("speaker") == "music", F.coalesce("title", "content")).otherwise(F.col("content"))).alias("line"))
    return lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), tx.hash16(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("i")).alias("i"), "line"))), lambda x: x["line"]), "\n")).alias("digest"))


def event_scores(s: Spark, d: str) -> DataFrame:
    """Scores out of JSON texts, clamped to 1 to 5, per event type."""
    e = table(s, d, "events", "event_type", "props")
    k = cues.clamp_score(cues.json_object(F.col("props"), "k string")["k"])
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.round(F.avg(cues.judge_mean(k, F.lit(3))), 6).alias("mean"))


# Evaluation


def _predictions(s: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    """(predictions by session and turn with their strata; truth), a turn of several pairs by its first."""
    pairs = eval_pairs(table(s, d, "train_pairs")).where("session_id IS NOT NULL AND turn_number IS NOT NULL")
    first = pairs.groupBy(_key().alias("session_id"), "turn_number").agg(F.min(F.struct("pair_id", "track_id")).alias("x")).select("session_id", "turn_number", "x.pair_id", F.col("x.track_id").alias("truth"))
    lists = recommend(s, d).groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "track_id"))), lambda x: x["track_id"]).alias("predicted_track_ids"))
    replies = slicing.turns(table(s, d, "messages")).select(_key().alias("session_id"), "turn_number", F.col("reply").alias("predicted_response"))
    strata = slicing.normalised_strata(table(s, d, "sessions")).withColumn("session_id", _key())
    rows = first.join(lists, "pair_id").join(replies, ["session_id", "turn_number"], "left").join(strata, "session_id", "left")
    truth = first.where("truth IS NOT NULL AND pair_id % 7 <> 0").select("session_id", "turn_number", "truth")
    return rows.select("session_id", "turn_number", "predicted_track_ids", "predicted_response", "split", "specificity", "category"), truth


def _report(s: Spark, d: str, labels) -> DataFrame:
    predictions, truth = _predictions(s, d)
    n = table(s, d, "tracks", "track_id").agg(F.countDistinct("track_id").alias("n")).collect()[0]["n"]
    return evaluation.report(predictions, truth, labels, n)


def eval_report(s: Spark, d: str) -> DataFrame:
    return _report(s, d, evaluation.labels_of(["split", "specificity", "category"], turns=True))


def eval_filtered(s: Spark, d: str) -> DataFrame:
    return _report(s, d, evaluation.labels_of([], {"split": "warm", "specificity": "HH"}, turns=True))


def retrieval_summary(s: Spark, d: str) -> DataFrame:
    """Several true tracks a turn: recall over all and over at most k of them, nDCG, by turn, specificity, category."""
    pairs = eval_pairs(table(s, d, "train_pairs")).where("session_id IS NOT NULL AND turn_number IS NOT NULL AND track_id IS NOT NULL")
    keyed = pairs.select(_key().alias("session_id"), "turn_number", "pair_id", "track_id")
    first = keyed.groupBy("session_id", "turn_number").agg(F.min("pair_id").alias("pair_id"))
    lists = recommend(s, d).join(first, "pair_id").select("session_id", "turn_number", "track_id", "rank")
    strata = slicing.normalised_strata(table(s, d, "sessions")).select(_key().alias("session_id"), "specificity", "category")
    scores = evaluation.per_query(lists, keyed, 20).join(strata, "session_id", "left").withColumn("turn_number", F.col("turn_number").cast("double"))
    return evaluation.by_strata(scores, [[], ["turn_number"], ["specificity"], ["category"], ["turn_number", "specificity"]])


# Pools


def _context(s: Spark, d: str, every: bool = False) -> pools.Context:
    """What pools read, with one pair in a hundred as queries or ``every`` pair."""
    p = table(s, d, "train_pairs")
    queries = (p if every else p.where("pair_id % 100 = 0")).select(F.col("pair_id").alias("query_id"), "query", F.coalesce("seen", F.array().cast("array<string>")).alias("seen"), F.upper(F.trim("specificity")).alias("specificity"))
    return pools.Context(queries, _tracks(s, d), _crawl(s, d), _vectors(s, d), p.where("split = 'train'").select("track_id"))


def _pool(name: str, n: int = 20, every: bool = False):
    return lambda s, d: pools.pool(name)(_context(s, d, every), n)


def pool_weighted(s: Spark, d: str) -> DataFrame:
    return pools.ensemble(_context(s, d, every=True), 20, ("bm25_music_only", "popular"), "rbc", {"popular": 0.5})


def pool_reranked(s: Spark, d: str) -> DataFrame:
    return pools.reranked(_context(s, d), 20, ("bm25_music_only", "popular"), "agreement")


def predict_routed(s: Spark, d: str) -> DataFrame:
    """Queries that heard nothing go to the popular pool if they are specific, the others to the fused pools."""
    return pools.predict(_context(s, d, every=True), ["bm25_music_only", "popular"], top_k=10, n=20, first_pool="popular", first_specificity=("HH", "HL"))


def predict_rewritten(s: Spark, d: str) -> DataFrame:
    """A rewritten text for one of two pools: the first words of the query."""
    c = _context(s, d)
    rewrites = c.queries.where("query_id % 200 = 0").select("query_id", F.substring("query", 1, 40).alias("rewritten"))
    return pools.predict(c, ["bm25_music_only", "bm25_simple"], top_k=10, n=20, rewrites=rewrites, rewritten_pools=("bm25_music_only",))


# Histories


def _targets(s: Spark, d: str) -> DataFrame:
    return history.session_dates(table(s, d, "sessions", "session_id", "user_id", "session_date")).select(F.col("session_id").alias("target"), "user_id", F.col("session_date").alias("target_date"))


def _histories(s: Spark, d: str, said: bool = True) -> DataFrame:
    return history.histories(table(s, d, "messages"), table(s, d, "sessions", "session_id", "user_id", "session_date"), said)


def histories(s: Spark, d: str) -> DataFrame:
    return _histories(s, d)


def history_records(s: Spark, d: str) -> DataFrame:
    r = history.history_records(_histories(s, d))
    flat = F.flatten(F.transform("sessions", lambda x: F.transform(x["pairs"], lambda p: p["track_id"])))
    return r.select("user_id", "n_sessions", "n_turns", tx.hash16(F.array_join(flat, "|")).alias("tracks"))


def user_lookup(s: Spark, d: str) -> DataFrame:
    return history.profiles(_histories(s, d), table(s, d, "sessions")).select("user_id", F.col("profile.age_group").alias("age_group"), "n_sessions", "n_turns")


def history_before(s: Spark, d: str) -> DataFrame:
    return history.before(_histories(s, d), _targets(s, d)).groupBy("target").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("session_id").alias("n_sessions"))


def history_same_day(s: Spark, d: str) -> DataFrame:
    return history.before(_histories(s, d), _targets(s, d), strict=False).groupBy("target").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("session_id").alias("n_sessions"))


def first_pairs(s: Spark, d: str) -> DataFrame:
    """The first five earlier pairs of each session in which the listener says a word."""
    return history.pairs_before(_histories(s, d), _targets(s, d), history.holds("Song"), 5).select("target", "n", "track_id", tx.hash16(F.col("utterance")).alias("said"))


def latest_pairs(s: Spark, d: str) -> DataFrame:
    return history.pairs_before(_histories(s, d), _targets(s, d), None, 3, latest=True).select("target", "n", "track_id")


def _plays(s: Spark, d: str) -> DataFrame:
    return slicing.distinct_messages(table(s, d, "messages")).where("speaker = 'music' AND content IS NOT NULL")


def scored_pairs(s: Spark, d: str) -> DataFrame:
    """The five earlier pairs of each session whose tracks are nearest to the first track played in it."""
    first = _plays(s, d).groupBy("session_id").agg(F.min(F.struct("turn_number", "msg_id", "content"))["content"].alias("track_id"))
    wanted = first.select(F.col("session_id").alias("target"), "track_id")
    v = _vectors(s, d, "cf-bpr", 128, by_track=True).select("track_id", "vector")
    scored = priors.scored_before(_histories(s, d, said=False), _targets(s, d), wanted, v, 0.05, 5)
    return scored.select("target", "n", "track_id", "sim", cues.similarity_label(F.col("sim")).alias("label"))


def relevant_priors(s: Spark, d: str) -> DataFrame:
    candidates = _plays(s, d).select(F.col("session_id").alias("target"), F.col("content").alias("candidate"))
    signals = [(_vectors(s, d, kind, size, by_track=True).select("track_id", "vector"), least) for kind, size, least in (("cf-bpr", 128, 0.3), (pools.VECTOR_POOLS["qemb_metadata"], 1024, 0.55))]
    return priors.relevant_before(_histories(s, d, said=False), _targets(s, d), candidates, signals)


# Negatives and features


def negative_mixture(s: Spark, d: str) -> DataFrame:
    pairs = table(s, d, "train_pairs").where("split = 'train'")
    t = _tracks(s, d)
    t = t.select("track_id", tx.first_filled(F.col("artist_name")).alias("artist"), tx.first_filled(F.col("album_name")).alias("album"), F.slice(tx.clean_tags(F.col("tag_list")), 1, 3).alias("tags"), tx.popularity_bucket(F.col("popularity")).alias("bucket"))
    return features.negative_mixture(pairs, t, 4)


def oof_features(s: Spark, d: str) -> DataFrame:
    """Per turn and fold: groups, candidates, largest group and the share of groups that hold the true track."""
    rankings, _ = pool_rankings(s, d)
    wide = features.fused_features(rankings, ["bm25", "popular"], 20, ["pair_id"])
    pairs = eval_pairs(table(s, d, "train_pairs")).select("pair_id", F.col("track_id").alias("truth"), "session_id", "turn_number")
    rows = wide.join(splits.k_folds(pairs, _key(), 5), "pair_id").withColumn("label", (F.col("track_id") == F.col("truth")).cast("int"))
    per = rows.groupBy("pair_id", "turn_number", "fold").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("label", F.lit(0))).alias("hit"))
    return per.groupBy("turn_number", "fold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"), F.round(F.avg("hit"), 6).alias("coverage"))


def ce_ranks(s: Spark, d: str) -> DataFrame:
    """Scores of a second model (a hash stands in for it) for part of the candidates, their mean and spread over folds, ranks with the rest last, and the candidates sorted again."""
    top = recommend(s, d)
    h = lambda i: features.unit_hash(F.lit(f"ce{i}"), F.col("pair_id").cast("string"), F.col("track_id"))
    scores = top.where(h(9) < 0.7).select("pair_id", "track_id", *(F.round(h(i), 6).alias(f"f{i}") for i in range(3)))
    mean = F.round((F.col("f0") + F.col("f1") + F.col("f2")) / 3, 6)
    spread = F.round(F.sqrt(((F.col("f0") - mean) ** 2 + (F.col("f1") - mean) ** 2 + (F.col("f2") - mean) ** 2) / 2), 4)
    rows = features.min_rank(top.join(scores, ["pair_id", "track_id"], "left").withColumn("ce_mean", mean).withColumn("ce_std", spread), ["pair_id"], "ce_mean", "ce_rank")
    again = pools.resorted(rows.withColumnRenamed("pair_id", "query_id"), "ce_mean", 10)
    return again.select(F.col("query_id").alias("pair_id"), "track_id", "ce_mean", "ce_std", "ce_rank", "rank")


def encoding_state(s: Spark, d: str) -> DataFrame:
    rankings, _ = pool_rankings(s, d)
    wide = features.fused_features(rankings, ["bm25", "popular"], 20, ["pair_id"])
    pairs = eval_pairs(table(s, d, "train_pairs")).select("pair_id", F.col("track_id").alias("truth"))
    rows = wide.join(pairs, "pair_id").withColumn("label", F.coalesce((F.col("track_id") == F.col("truth")).cast("int"), F.lit(0))).withColumn("bucket", features.rank_bucket(F.col("rank_popular")))
    return features.encoding_state(rows, "bucket", "label")


def validation_split(s: Spark, d: str) -> DataFrame:
    return splits.validation_split(table(s, d, "train_pairs", "pair_id", "session_id"), _key(), 0.2).select("pair_id", F.coalesce("is_validation", F.lit(False)).alias("is_validation"))


# Citations


def _offered(s: Spark, d: str) -> DataFrame:
    """Titles on offer to a turn: the tracks of its session up to it, in order."""
    m = slicing.distinct_messages(table(s, d, "messages")).where("speaker = 'music' AND content IS NOT NULL")
    plays = m.groupBy("session_id", F.col("content").alias("track_id")).agg(F.min(F.struct("turn_number", "msg_id")).alias("at"))
    plays = plays.withColumn("idx", F.row_number().over(Window.partitionBy("session_id").orderBy("at")))
    t = _tracks(s, d).select("track_id", tx.first_filled(F.col("track_name")).alias("pool_title"), tx.first_filled(F.col("artist_name")).alias("artist"), tx.first_filled(F.col("album_name")).alias("album"), tx.year(F.col("release_date")).alias("year"))
    return plays.join(t.where("pool_title IS NOT NULL"), "track_id").select("session_id", "idx", "pool_title", "artist", "album", "year")


def cited_tracks(s: Spark, d: str) -> DataFrame:
    """Titles cited in replies that are on offer under the same key, in canonical form."""
    titles = citations.cited(_replies(s, d), ["session_id", "turn_number"], "reply")
    hits = citations.exact_matches(titles, _offered(s, d), ["session_id"])
    return hits.select("session_id", "turn_number", "place", "idx", citations.canonical(F.col("pool_title"), F.col("artist")).alias("canonical"))


def _resolved(s: Spark, d: str) -> DataFrame:
    r = _replies(s, d)
    ident = ["session_id", "turn_number"]
    turns = r.select(*ident)
    offered = turns.join(_offered(s, d), "session_id")
    named = citations.cited(r, ident, "query").select(*ident, F.col("title").alias("protected_title"))
    return citations.resolve(citations.cited(r, ident, "reply"), offered, ident, named)


def citation_states(s: Spark, d: str) -> DataFrame:
    return _resolved(s, d).groupBy("how").agg(F.count(F.lit(1)).alias("n"))


def repaired_replies(s: Spark, d: str) -> DataFrame:
    return citations.repair(_replies(s, d).select("session_id", "turn_number", "reply"), _resolved(s, d), ["session_id", "turn_number"], "reply")


def track_anchors(s: Spark, d: str) -> DataFrame:
    return citations.anchors(_offered(s, d).where("artist IS NOT NULL"), ["session_id"])


def match_checks(s: Spark, d: str) -> DataFrame:
    """Parts of the match flags that need no similarity: seconds apart, way of search, names that are surely alike."""
    t = quality.match_tests(table(s, d, "track_crawl"))
    return t.select("crawl_id", F.round("apart", 3).alias("apart"), "fuzzy", (F.col("title") == 1).alias("title_alike"), (F.col("artist") == 1).alias("artist_alike"))


def all_flags(s: Spark, d: str) -> DataFrame:
    return quality.all_flags(table(s, d, "track_crawl")).select("crawl_id", F.array_join("flags", "|").alias("flags"), "ok")


# Selections


def _demos(s: Spark, d: str) -> DataFrame:
    """Training pairs as demos with a score from a hash."""
    p = table(s, d, "train_pairs", "pair_id", "split", "specificity", "turn_number", "source").where("split = 'train'")
    spec = F.coalesce(F.upper(F.trim("specificity")), F.lit("unknown"))
    return p.select("pair_id", spec.alias("specificity"), selection.turn_position(F.col("turn_number")).alias("turn"), F.col("source").alias("category"), F.round(features.unit_hash(F.lit("demo"), F.col("pair_id").cast("string")), 6).alias("score"))


def demo_fallback(s: Spark, d: str) -> DataFrame:
    wanted = eval_pairs(table(s, d, "train_pairs", "pair_id", "split", "specificity", "turn_number", "source"))
    wanted = wanted.select(F.col("pair_id").alias("wanted"), F.coalesce(F.upper(F.trim("specificity")), F.lit("unknown")).alias("specificity"), selection.turn_position(F.col("turn_number")).alias("turn"), F.col("source").alias("category"))
    layers = [["specificity", "turn", "category"], ["specificity", "turn"], ["specificity"], []]
    return selection.fallback(wanted, _demos(s, d), layers, 3, "wanted", "pair_id", "score")


def demo_coverage(s: Spark, d: str) -> DataFrame:
    rows = _demos(s, d).withColumn("bucket", selection.coverage_key({c: F.col(c) for c in ("specificity", "category", "turn")}, "all"))
    return selection.covering(rows, "bucket", "score", "pair_id", 40, 1).select("pair_id", "bucket", "score", "pass")


def demo_buckets(s: Spark, d: str) -> DataFrame:
    return _demos(s, d).groupBy("specificity", "turn").agg(F.count(F.lit(1)).alias("n"))


def blended_neighbors(s: Spark, d: str) -> DataFrame:
    """Nearest rows re-ranked by similarity, a score between 0 and 1 and a bonus for the same label."""
    v = table(s, d, "embeddings", "vec_id", "embedding", "label")
    near = ranking.dense_top_k(v.where("vec_id % 100 = 0"), v, 20, "vec_id", "embedding")
    scored = selection.min_max(v.select("vec_id", "label", (F.col("vec_id") % 37).cast("double").alias("raw")), "raw", "score")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    rows = near.join(scored, "vec_id").join(own, "query_id")
    return selection.blend(rows, "sim", "score", F.when(F.col("label") == F.col("own"), 0.05).otherwise(0.0), 5, "query_id", "vec_id").select("query_id", "vec_id", "blended", "place")


def capped_groups(s: Spark, d: str) -> DataFrame:
    """Candidates by artist: the two largest groups of a query keep their name."""
    t = _tracks(s, d).select("track_id", F.coalesce(tx.first_filled(F.col("artist_name")), F.lit("unknown")).alias("artist"))
    return selection.largest_groups(recommend(s, d).join(t, "track_id"), ["pair_id"], "artist", "rank", 2).select("pair_id", "track_id", "kept_group")


def sampled_pairs(s: Spark, d: str) -> DataFrame:
    return selection.sample(table(s, d, "train_pairs", "pair_id"), 50, F.col("pair_id").cast("string")).select("pair_id")


def run_consistency(s: Spark, d: str) -> DataFrame:
    p = table(s, d, "train_pairs", "pair_id")
    return selection.consistent([p, p.where("pair_id % 10 <> 0"), p.union(p.select(F.col("pair_id") + 10_000_000))], ["pair_id"])


def score_summary(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "events", "value").withColumn("other", F.col("value") % 7)
    return selection.score_summary(e, ["value", "other"])


def nearest_pool(s: Spark, d: str) -> DataFrame:
    v = _vectors(s, d, "cf-bpr", 128).select("track_id", "vector")
    p = table(s, d, "train_pairs", "pair_id", "track_id", "bm25_top_tids").where("pair_id % 100 = 0 AND track_id IS NOT NULL")
    truth = p.select("pair_id", F.lit(0).alias("place"), "track_id")
    return selection.nearest_pool(truth, v, "pair_id", 20)


def intents(s: Spark, d: str) -> DataFrame:
    v = _vectors(s, d, "cf-bpr", 128).select("track_id", "vector")
    p = table(s, d, "train_pairs", "pair_id", "track_id", "seen", "bm25_top_tids").where("pair_id % 100 = 0")
    candidates = p.select("pair_id", F.explode(F.array_distinct("bm25_top_tids")).alias("track_id")).where("track_id IS NOT NULL")
    queries = p.join(v, "track_id", "left").select("pair_id", "vector", F.coalesce(F.array_distinct("seen"), F.array().cast("array<string>")).alias("seen"))
    return selection.intents(candidates, queries, v, "pair_id", 0.3, 0.2, 0.15)


def first_turns(s: Spark, d: str) -> DataFrame:
    """The first rows in order of session and turn."""
    return table(s, d, "train_pairs", "pair_id", "session_id", "turn_number").where("session_id IS NOT NULL").orderBy(_key(), "turn_number", "pair_id").limit(100).select("pair_id", "turn_number")


# Overviews


def track_overview(s: Spark, d: str) -> DataFrame:
    """Each session's tracks at a glance: artists heard twice or more, years, most frequent tags, albums."""
    plays = slicing.distinct_messages(table(s, d, "messages")).where("speaker = 'music'").select("session_id", F.col("content").alias("track_id")).distinct()
    rows = plays.join(_tracks(s, d), "track_id").select(
        "session_id", tx.first_filled(F.col("artist_name")).alias("artist"), tx.first_filled(F.col("album_name")).alias("album"), tx.year(F.col("release_date")).cast("int").alias("year"), F.slice(tx.clean_tags(F.col("tag_list")), 1, 10).alias("tags")
    )
    totals = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_tracks"), F.countDistinct("artist").alias("n_artists"), F.countDistinct("album").alias("n_albums"), F.array_sort(F.collect_list("year")).alias("ys"))

    def top(part: DataFrame, column: str, least: int, n: int) -> DataFrame:
        counts = part.where(F.col(column).isNotNull()).groupBy("session_id", column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        ranked = counts.withColumn("i", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), column))).where(F.col("i") <= n)
        return ranked.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", column))), lambda x: x[column]), "|").alias(f"top_{column}"))

    out = totals.join(top(rows, "artist", 2, 3), "session_id", "left").join(top(rows.select("session_id", F.explode("tags").alias("tag")), "tag", 1, 5), "session_id", "left")
    years = [F.get("ys", F.lit(0)), F.get("ys", F.size("ys") - 1), compose.upper_median(F.col("ys"))]
    return out.select("session_id", "n_tracks", "n_artists", "n_albums", *(y.cast("double").alias(n) for y, n in zip(years, ("first_year", "last_year", "median_year"), strict=True)), "top_artist", "top_tag")


def novelty(s: Spark, d: str) -> DataFrame:
    """Share of a reply's content words that no earlier half of replies (by hash) uses, blended with a score; 0 outside 5 to 120 words."""
    r = _replies(s, d)
    w = F.array_distinct(F.filter(tx.words(F.col("reply")), lambda x: (F.length(x) >= 4) & ~x.isin(*tx.STOP_WORDS)))
    h = features.unit_hash(F.lit("half"), F.col("session_id"), F.col("turn_number").cast("string"))
    rows = r.select("session_id", "turn_number", w.alias("w"), F.size(F.filter(F.split("reply", r"\s+"), lambda x: x != "")).alias("n_words"), (h < 0.5).alias("known"))
    known = rows.where("known").select(F.explode("w").alias("word")).distinct().withColumn("old", F.lit(1))
    each = rows.where("NOT known").select("session_id", "turn_number", "n_words", F.explode_outer("w").alias("word")).join(known, "word", "left")
    per = each.groupBy("session_id", "turn_number", "n_words").agg(F.count("word").alias("n"), F.count("old").alias("old"))
    fresh = F.when(F.col("n") == 0, 1.0).otherwise((F.col("n") - F.col("old")) / F.col("n"))
    gate = F.col("n_words").between(5, 120)
    return per.select("session_id", "turn_number", F.round(fresh, 6).alias("novelty"), F.round(F.when(gate, 0.7 * 0.5 + 0.3 * fresh).otherwise(0.0), 6).alias("blended"))


def padded_responses(s: Spark, d: str) -> DataFrame:
    """Replies with tags appended until distinct word pairs reach their target; pairs before and after."""
    r = _replies(s, d).select("session_id", "turn_number", "reply")
    tags = compose.tag_counts(_tracks(s, d))
    padded = postprocess.pad_lexical(r, ["session_id", "turn_number"], "reply", tags, 0.6)
    before, after = evaluation.distinct_bigrams(r, "reply"), evaluation.distinct_bigrams(padded, "reply")
    return before.select(F.lit("before").alias("state"), "*").unionByName(after.select(F.lit("after").alias("state"), "*")).select("state", (F.col("distinct2") >= 0.6).alias("reached"), F.col("n_total") > 0)


# Stores


def vector_dims(s: Spark, d: str) -> DataFrame:
    return _vectors(s, d).groupBy("vector_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dimension"))


def batch_vectors(s: Spark, d: str) -> DataFrame:
    """Vectors of each turn's candidates in their order, missing ones null: here whether there is one, and its first element."""
    v = _vectors(s, d, "cf-bpr", 128).select("track_id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x"))
    p = table(s, d, "train_pairs", "pair_id", "bm25_top_tids").select("pair_id", F.posexplode("bm25_top_tids").alias("place", "track_id"))
    return p.join(v, "track_id", "left").select("pair_id", "place", F.col("x").isNotNull().alias("found"), "x")


def user_vectors(s: Spark, d: str) -> DataFrame:
    """User to profile key to the key's number of users: two joins, missing halves null."""
    u = table(s, d, "sessions", "user_id", "user_profile").where("trim(coalesce(user_id, '')) <> '' AND user_profile IS NOT NULL").groupBy("user_id").agg(F.min("user_profile").alias("p"))
    keyed = u.select("user_id", cues.profile_key(F.col("p")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_users"))
    asked = table(s, d, "messages", "user_id").where("trim(coalesce(user_id, '')) <> ''").distinct()
    return asked.join(keyed, "user_id", "left").join(sizes, "key", "left").select("user_id", "key", "n_users")


def filled_profiles(s: Spark, d: str) -> DataFrame:
    """Profile fields of users, missing ones filled from their other sessions; known ones stay."""
    rows = table(s, d, "sessions", "session_id", "user_id", "user_profile").where("trim(coalesce(user_id, '')) <> ''")
    fields = ("age_group", "country_code", "gender")
    own = rows.where("user_profile IS NOT NULL").groupBy("user_id").agg(F.min(F.struct("session_id", "user_profile"))["user_profile"].alias("p"))
    other = rows.groupBy("user_id").agg(*(F.min(F.when(F.trim(F.col("user_profile")[f]) != "", F.struct("session_id", F.col("user_profile")[f].alias("v"))))["v"].alias(f"o_{f}") for f in fields))
    return other.join(own, "user_id", "left").select("user_id", *(F.coalesce(F.nullif(F.trim(F.col("p")[f]), F.lit("")), F.col(f"o_{f}")).alias(f) for f in fields))


def crawl_upsert(s: Spark, d: str) -> DataFrame:
    """Crawl rows of one half taken over by those of the other: the last row of a track wins, other tracks stay."""
    c = table(s, d, "track_crawl", "crawl_id", "track_id", "tempo", "ok").where("track_id IS NOT NULL")
    now = latest_per_key(c.where("crawl_id % 2 = 0"), ["track_id"], [F.col("crawl_id")])
    return tables.upsert(now, c.where("crawl_id % 2 = 1"), ["track_id"], [F.col("crawl_id")])


def crawl_union(s: Spark, d: str) -> DataFrame:
    """Two sources by precedence: rows with lyrics before rows without, one a track."""
    c = _crawl(s, d).select("track_id", "lyrics", "crawl_id")
    return tables.union_first_wins([c.where("crawl_id % 3 = 0 AND lyrics IS NOT NULL"), c], "track_id").select("track_id", F.octet_length("lyrics").alias("n_bytes"))


def query_cache(s: Spark, d: str) -> DataFrame:
    """Distinct query texts by hash that are not in a cache of the training split yet; of equal hashes the first text."""
    p = table(s, d, "train_pairs", "pair_id", "split", "query").where("trim(query) <> ''").select("split", "pair_id", tx.hash16(F.trim("query")).alias("key"))
    new = tables.pending(p.where("split <> 'train'"), p.where("split = 'train'"), ["key"])
    return new.groupBy("key").agg(F.min("pair_id").alias("pair_id"), F.count(F.lit(1)).alias("n"))


def all_turns(s: Spark, d: str) -> DataFrame:
    """Turns of all splits, each query once: what is there to embed."""
    p = table(s, d, "train_pairs", "split", "session_id", "turn_number").where("session_id IS NOT NULL AND turn_number IS NOT NULL")
    return p.groupBy("split", "turn_number").agg(F.countDistinct(_key()).alias("n_sessions"))


def contiguous_turns(s: Spark, d: str) -> DataFrame:
    """Turns from the first on without a gap that have a request and a track: training slices end at the first gap."""
    t = slicing.turns(table(s, d, "messages")).where("query IS NOT NULL AND size(tracks) > 0 AND turn_number >= 1")
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_number"))
    return t.withColumn("n", n).where("n = turn_number").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max(F.get("tracks", F.lit(0))).alias("some_track"))


MORE = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
#: Pools that are asked every pair.
EVERY = ("bm25", "bm25_qmr", "bm25_crawl_lyrics", "bm25_simple", "bm25_tags_crawl_kw")
MORE |= {f"pool_{name}": _pool(name, every=name in EVERY) for name in ("popular", "bm25_music_only", "bm25_simple", "bm25_tags_raw", "bm25_tags", "bm25_tags_crawl_kw", "bm25_crawl_kw", "bm25_crawl", "bm25_crawl_lyrics", "bm25", "qemb_cf", "bm25_qmr")}

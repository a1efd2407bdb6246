"""User histories: pairs of request and played track, bounded by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import speaker
from .slicing import distinct_messages


def request_pairs(messages: DataFrame, said: bool = True) -> DataFrame:
    """``session_id, turn_number, utterance, track_id``: each user utterance with the first track played after
    it; the latest utterance counts, and it is used up by that track.

    Without ``said`` there is no ``utterance``, and no text of a user is shuffled.
    """
    if not said:
        has = F.when(F.trim("content") != "", F.lit("-"))
        return request_pairs(messages.withColumn("content", F.when(speaker(F.col("role")) == "user", has).otherwise(F.col("content")))).drop("utterance")
    m = distinct_messages(messages).where(F.col("speaker").isin("user", "music") & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    place = F.when(F.col("speaker") == "user", 0).otherwise(1)
    order = Window.partitionBy("session_id").orderBy("turn_number", place, "msg_id")
    before = m.withColumn("_who", F.lag("speaker").over(order)).withColumn("_said", F.lag("content").over(order))
    return before.where((F.col("speaker") == "music") & (F.col("_who") == "user")).select("session_id", "turn_number", F.col("_said").alias("utterance"), F.col("content").alias("track_id"))


def session_dates(sessions: DataFrame) -> DataFrame:
    """``session_id, user_id, session_date`` of sessions of known users; blank dates are null."""
    s = sessions.groupBy("session_id").agg(F.max("user_id").alias("user_id"), F.max("session_date").alias("session_date"))
    return s.where(F.trim(F.coalesce("user_id", F.lit(""))) != "").withColumn("session_date", F.when(F.trim("session_date") != "", F.col("session_date")))


def user_profiles(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """``user_id, n_sessions, n_pairs, first_date, last_date``"""
    pairs = request_pairs(messages).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        session_dates(sessions).join(pairs, "session_id", "left").groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n_sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"))
    )


def prior_sessions(sessions: DataFrame, same_day: bool = False) -> DataFrame:
    """``session_id, n_prior``: sessions of the same user before its date, counted from per-day sums, so a user's
    sessions are never paired with each other.  Undated sessions have none and count for none."""
    s = session_dates(sessions)
    days = s.where(F.col("session_date").isNotNull()).groupBy("user_id", "session_date").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("user_id").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0 if same_day else -1)
    counted = days.select("user_id", "session_date", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_prior"))
    own = 1 if same_day else 0
    return s.join(counted, ["user_id", "session_date"], "left").select("session_id", "user_id", F.coalesce(F.col("n_prior") - own, F.lit(0)).alias("n_prior"))


def last_before(events: DataFrame, what: str, of: str) -> DataFrame:
    """``event_id, user_id, ts, prior_ts``: for each event of type ``what``, the time of the user's last ``of`` event before it."""
    rows = events.where(F.col("event_type").isin(what, of)).withColumn("day", F.date_trunc("day", "ts"))
    hit = F.when(F.col("event_type") == of, F.col("ts"))
    # Days are carried over in one small table, so a user's events are only ordered within a day.
    days = rows.groupBy("user_id", "day").agg(F.max(hit).alias("latest"))
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("user_id", "day", F.max("latest").over(before).alias("carried"))
    within = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("own", F.max(hit).over(within)).where(F.col("event_type") == what).join(days, ["user_id", "day"])
    return found.select("event_id", "user_id", "ts", F.coalesce("own", "carried").alias("prior_ts"))


def histories(messages: DataFrame, sessions: DataFrame, said: bool = True) -> DataFrame:
    """``user_id, session_id, session_date, place, turn_number, utterance, track_id``: each pair of a known user's sessions.

    ``place`` counts a user's sessions with pairs by date (undated first) and id.  Pairs stay rows, so no user's history is one value.
    ``said``: with the utterances.
    """
    pairs = request_pairs(messages, said)
    dated = session_dates(sessions).join(pairs.select("session_id").distinct(), "session_id", "left_semi")
    order = Window.partitionBy("user_id").orderBy(F.coalesce("session_date", F.lit("")), "session_id")
    return dated.withColumn("place", F.row_number().over(order)).join(pairs, "session_id").select("user_id", "session_id", "session_date", "place", "turn_number", *(["utterance"] if said else []), "track_id")


def history_records(pairs: DataFrame) -> DataFrame:
    """``user_id, n_sessions, n_turns, sessions``: one record per user, its sessions in order with their pairs."""
    pair = F.struct("turn_number", "utterance", "track_id")
    each = pairs.groupBy("user_id", "place", "session_id", "session_date").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    listed = F.array_sort(F.collect_list(F.struct("place", "session_id", "session_date", "pairs")))
    return each.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum(F.size("pairs")).alias("n_turns"), listed.alias("sessions"))


def profiles(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    """``user_id, profile, n_sessions, n_turns``: users with a profile, a history or both."""
    counts = pairs.groupBy("user_id").agg(F.countDistinct("session_id").alias("n_sessions"), F.count(F.lit(1)).alias("n_turns"))
    known = sessions.where((F.trim(F.coalesce("user_id", F.lit(""))) != "") & F.col("user_profile").isNotNull())
    # Of several profiles of a user, the first by session.
    first = known.groupBy("user_id").agg(F.min(F.struct("session_id", "user_profile"))["user_profile"].alias("profile"))
    both = first.join(counts, "user_id", "full_outer")
    return both.select("user_id", "profile", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), F.coalesce("n_turns", F.lit(0)).alias("n_turns"))


def before(pairs: DataFrame, targets: DataFrame, strict: bool = True) -> DataFrame:
    """``target, ...pairs``: the pairs of each target's user from sessions before its date, never from the target itself.

    ``targets``: target (a session id), user_id, target_date.  Strict: an earlier date, and undated sessions are left out;
    else the same day and undated ones count too.  A target without a date has the whole history.
    """
    date = F.col("session_date")
    inside = date < F.col("target_date") if strict else date.isNull() | (date <= F.col("target_date"))
    rows = targets.join(pairs, "user_id").where((F.col("session_id") != F.col("target")) & (F.col("target_date").isNull() | F.coalesce(inside, F.lit(False))))
    return rows.select("target", *pairs.columns)


def select_pairs(pairs: DataFrame, keep: Column | None, k: int | None, by: str = "target", latest: bool = False) -> DataFrame:
    """The first k pairs of each target for which ``keep`` holds, in order of the history (or the latest), with their ``n`` from 1."""
    rows = pairs if keep is None else pairs.where(keep)
    order = ["place", "turn_number", "track_id"]
    n = F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc(c) if latest else F.col(c) for c in order)))
    numbered = rows.withColumn("n", n)
    return numbered.where(F.col("n") <= k) if k is not None else numbered


def pairs_before(pairs: DataFrame, targets: DataFrame, keep: Column | None, k: int, strict: bool = True, latest: bool = False) -> DataFrame:
    """``target, n, ...pairs``: what ``select_pairs`` takes from ``before``, without pairing a user's sessions with each other.

    A user's pairs are numbered in their order (``place`` has undated sessions first, then by date).  A target may have one range of these
    numbers, less those of its own session, so its k pairs are looked up by their numbers.
    """
    kept = pairs if keep is None else pairs.where(keep)
    m = F.count(F.lit(1)).alias("_m")
    sessions = kept.groupBy("user_id", "session_id", "session_date", "place").agg(m)
    sessions = sessions.withColumn("_from", F.sum("_m").over(Window.partitionBy("user_id").orderBy("place")) - F.col("_m"))
    inside = F.row_number().over(Window.partitionBy("user_id", "session_id").orderBy("turn_number", "track_id"))
    numbered = kept.withColumn("_i", inside).join(sessions.select("user_id", "session_id", "_from"), ["user_id", "session_id"]).withColumn("_x", F.col("_from") + F.col("_i"))
    # Pairs before each date of a session or target, from sums per date.
    days = sessions.select("user_id", F.col("session_date").alias("_d"), "_m").unionByName(targets.select("user_id", F.col("target_date").alias("_d"), F.lit(0).cast("long").alias("_m")))
    days = days.groupBy(F.col("user_id").alias("_u"), "_d").agg(F.sum("_m").alias("_m"))
    user = Window.partitionBy("_u")
    before_date = user.orderBy(F.col("_d").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    undated = F.sum(F.when(F.col("_d").isNull(), F.col("_m")).otherwise(0)).over(user) if strict else F.lit(0)
    whole = F.col("_d").isNull()
    days = days.select("_u", "_d", F.when(whole, 0).otherwise(undated).alias("_lo"), F.when(whole, F.sum("_m").over(user)).otherwise(F.coalesce(F.sum("_m").over(before_date), F.lit(0))).alias("_hi"))
    own = sessions.select(F.col("user_id").alias("_ou"), F.col("session_id").alias("_os"), F.col("_from").alias("_a"), F.col("_m").alias("_own"))
    rows = targets.join(days, (F.col("user_id") == F.col("_u")) & F.col("target_date").eqNullSafe(F.col("_d"))).join(own, (F.col("user_id") == F.col("_ou")) & (F.col("target") == F.col("_os")), "left")
    rows = rows.withColumn("_own", F.when((F.col("_a") >= F.col("_lo")) & (F.col("_a") < F.col("_hi")), F.col("_own")).otherwise(0))
    most = F.least(F.lit(k), F.col("_hi") - F.col("_lo") - F.col("_own")).cast("int")
    rows = rows.where(most > 0).select("target", "user_id", "_lo", "_hi", "_a", "_own", F.explode(F.sequence(F.lit(1), most)).alias("n"))
    x = F.col("_hi") - F.col("n") + 1 if latest else F.col("_lo") + F.col("n")
    x = x - F.when(x <= F.col("_a") + F.col("_own"), F.col("_own")).otherwise(0) if latest else x + F.when(x > F.col("_a"), F.col("_own")).otherwise(0)
    return rows.select("target", "user_id", "n", x.alias("_x")).join(numbered, ["user_id", "_x"]).select("target", "n", *pairs.columns)


def holds(word: str, any_case: bool = True) -> Column:
    """Whether an utterance holds a word or phrase."""
    return F.contains(F.lower("utterance"), F.lit(word.lower())) if any_case else F.contains("utterance", F.lit(word))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where they differ in length or one has no length."""
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def score_pairs(pairs: DataFrame, wanted: DataFrame, vectors: DataFrame, threshold: float, k: int | None, digits: int = 6) -> DataFrame:
    """``target, n, utterance, track_id, sim``: pairs whose track is similar enough to what the target asks for, the most similar first.

    ``wanted``: target, vector; ``vectors``: track_id, vector.  Ties keep the order of the history.
    """
    rows = pairs.join(vectors.withColumnRenamed("vector", "_v"), "track_id").join(wanted, "target")
    scored = rows.withColumn("sim", F.round(cosine(F.col("_v"), F.col("vector")), digits)).where(F.col("sim") >= threshold)
    n = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("sim"), "place", "turn_number", "track_id"))
    ranked = scored.withColumn("n", n).select("target", "n", "utterance", "track_id", "sim")
    return ranked.where(F.col("n") <= k) if k is not None else ranked


def relevant_priors(pairs: DataFrame, candidates: DataFrame, signals: list[tuple[DataFrame, float]], digits: int = 6) -> DataFrame:
    """``target, track_id``: prior tracks that are near a candidate by any of several signals.

    ``candidates``: target, candidate; a signal: vectors (track_id, vector) and the least cosine.  Candidates per target are few (a top list).
    Each two tracks are compared once, however many targets they meet for.
    """
    both = pairs.select("target", "track_id").distinct().join(candidates, "target")
    met, near = both.select("track_id", "candidate").distinct(), None
    for vectors, least in signals:
        sides = met.join(vectors.withColumnRenamed("vector", "_a"), "track_id").join(vectors.select(F.col("track_id").alias("candidate"), F.col("vector").alias("_b")), "candidate")
        part = sides.where(F.round(cosine(F.col("_a"), F.col("_b")), digits) >= least).select("track_id", "candidate")
        near = part if near is None else near.unionByName(part)
    return both.join(near.distinct(), ["track_id", "candidate"]).select("target", "track_id").distinct()

"""Sessions cut into one row per turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import speaker


def distinct_messages(messages: DataFrame) -> DataFrame:
    """``session_id, turn_number, speaker, content, msg_id``: redelivered rows once, under the first id."""
    rows = messages.select("session_id", "turn_number", speaker(F.col("role")).alias("speaker"), "content", "msg_id")
    return rows.groupBy("session_id", "turn_number", "speaker", "content").agg(F.min("msg_id").alias("msg_id"))


def turns(messages: DataFrame) -> DataFrame:
    """``session_id, turn_number, n_messages, query, reply, tracks``: query and reply are the first of the turn
    that have content, tracks the played ones in order."""
    m = distinct_messages(messages)
    has = F.col("content").isNotNull()
    user, reply, music = (has & (F.col("speaker") == s) for s in ("user", "assistant", "music"))
    played = F.collect_list(F.when(music, F.struct("msg_id", "content")))
    return m.groupBy("session_id", "turn_number").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min(F.when(user, F.struct("msg_id", "content")))["content"].alias("query"),
        F.min(F.when(reply, F.struct("msg_id", "content")))["content"].alias("reply"),
        F.transform(F.array_sort(played), lambda x: x["content"]).alias("tracks"),
    )


def turn_slices(messages: DataFrame) -> DataFrame:
    """Turns with a query and at least one track, with what went before: ``n_history`` messages and the set
    ``seen`` of tracks of earlier turns (strictly earlier)."""
    earlier = Window.partitionBy("session_id").orderBy("turn_number").rowsBetween(Window.unboundedPreceding, -1)
    t = turns(messages)
    t = t.withColumn("n_history", F.coalesce(F.sum("n_messages").over(earlier), F.lit(0)))
    t = t.withColumn("seen", F.array_sort(F.array_distinct(F.flatten(F.collect_list("tracks").over(earlier)))))
    return t.where(F.col("query").isNotNull() & (F.size("tracks") > 0)).select("session_id", "turn_number", "query", "tracks", "n_history", "seen")


def last_turn_slices(messages: DataFrame) -> DataFrame:
    """The last message of each session as the query, and how many came before it."""
    m = distinct_messages(messages)
    place = F.struct("turn_number", "msg_id", "speaker", "content")
    return m.groupBy("session_id").agg(F.max(place).alias("last"), (F.count(F.lit(1)) - 1).alias("n_history")).select("session_id", F.col("last.turn_number").alias("turn_number"), F.col("last.speaker").alias("speaker"), F.col("last.content").alias("query"), "n_history")


def normalised_strata(sessions: DataFrame) -> DataFrame:
    """``session_id, split, specificity, category`` with unknown values named so."""
    s = sessions.groupBy("session_id").agg(F.max("user_profile.user_split").alias("split"), F.max("conversation_goal.specificity").alias("spec"), F.max("conversation_goal.category").alias("cat"))
    split = F.regexp_replace(F.lower(F.trim("split")), "^test_", "")
    spec, cat = F.upper(F.trim("spec")), F.upper(F.trim("cat"))
    return s.select(
        "session_id",
        F.when(split.isin("warm", "cold", "train"), split).otherwise("unknown").alias("split"),
        F.when(spec.isin("HH", "HL", "LH", "LL"), spec).otherwise("unknown").alias("specificity"),
        F.when(cat.rlike("^[A-K]$"), cat).otherwise("unknown").alias("category"),
    )

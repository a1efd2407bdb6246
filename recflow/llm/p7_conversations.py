"""Conversations out of message rows.

The rows are an event log.  The first row with a content creates a message; a further row of the same
session, turn, speaker and content is a retry; a row of the same message with other content is an edit, the
next version; an edit to null content deletes the message.  Music is played, not edited: each of its
contents is a message of its own.  The fold numbers the versions of a message by their first arrival
(sent_at or, where that is missing, ingested_at; then msg_id), so a retry of an old version does not
bring it back, and keeps the last version.

Both queries read the folded log: sessions are judged by its messages, and conversations are its final
versions.  A user message of several versions makes its session broken (which text was meant is not
known); of a reply the last version counts.

Everything is aggregated by (session, turn, speaker, content), then by message, by turn and by session, with
partial aggregates, so a session that holds a third of all rows costs one task no more than its number of
distinct turns.

Edge cases: a null session_id is a session of its own (null); a null turn_number makes its
session broken; null content is a value that differs from any other; a late row (ingested
long after it was sent) counts as any other row; a deleted reply is still a reply, but does not come out in
the conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_blank, role_of

#: Turns per output row of ``conversations``: longer sessions come out in several parts.
PART_TURNS = 512


def fold(messages: DataFrame, content: bool = False) -> DataFrame:
    """The folded log: ``session_id, turn_number, speaker, n_versions, retries, created, visible`` of each message, and
    with ``content`` the text of its last version.  ``speaker`` is null for a role that names none."""
    text = ["content"] if content else []
    rows = messages.select(
        "session_id", "turn_number", role_of(F.col("role")).alias("speaker"),
        # Null content is a version of its own, apart from every text.
        F.when(F.col("content").isNull(), F.lit(0)).otherwise(F.xxhash64("content")).alias("version"),
        F.struct(F.coalesce("sent_at", "ingested_at").alias("at"), F.col("msg_id").alias("id")).alias("arrival"),
        (~is_blank(F.col("content"))).alias("visible"), *text,
    )
    key = ["session_id", "turn_number", "speaker"]
    versions = rows.groupBy(*key, "version").agg(F.min("arrival").alias("first"), F.count(F.lit(1)).alias("events"), F.max("visible").alias("visible"), *(F.first(c).alias(c) for c in text))
    last = F.max(F.struct("first", *text))
    folded = versions.groupBy(*key, F.when(F.col("speaker") == "music", F.col("version")).alias("_play")).agg(
        F.count(F.lit(1)).alias("n_versions"),
        (F.sum("events") - F.count(F.lit(1))).alias("retries"),
        F.min("first").alias("created"),
        F.max("visible").alias("visible"),
        last.alias("_last"),
    )
    return folded.select(*key, "n_versions", "retries", "created", "visible", *(F.col("_last")[c].alias(c) for c in text))


def session_states(folded: DataFrame) -> DataFrame:
    """One row per session of a folded log: ``session_id, n_turns, reason``; reason is null for kept sessions."""
    user, reply = F.col("speaker") == "user", F.col("speaker") == "assistant"
    turns = folded.groupBy("session_id", "turn_number").agg(
        F.max(F.when(user, F.col("n_versions"))).alias("asked"),
        F.max(F.coalesce(reply, F.lit(False))).alias("replied"),
        F.max(F.col("speaker").isNull()).alias("nameless"),
        F.max(F.coalesce((user | reply) & F.col("visible"), F.lit(False))).alias("visible"),
    )
    sessions = turns.groupBy("session_id").agg(
        F.count("turn_number").alias("n_turns"),
        F.count(F.lit(1)).alias("n_groups"),
        F.min("turn_number").alias("first_turn"),
        F.max("turn_number").alias("last_turn"),
        F.max("visible").alias("visible"),
        F.max("nameless").alias("nameless"),
        F.max(F.coalesce(F.col("asked") != 1, F.lit(True))).alias("unclear"),
        F.min("replied").alias("replied"),
    )
    numbered = (F.col("first_turn") == 1) & (F.col("last_turn") == F.col("n_turns")) & (F.col("n_groups") == F.col("n_turns"))
    return sessions.select(
        "session_id",
        "n_turns",
        F.when(~F.col("visible"), "empty")
        .when(F.col("nameless") | F.col("unclear") | ~F.coalesce(numbered, F.lit(False)), "broken")
        .when(~F.col("replied"), "missing_reply")
        .alias("reason"),
    )


def dropped_sessions(messages: DataFrame) -> DataFrame:
    """``session_id, reason`` of each session that cannot be kept; the first reason that holds."""
    return session_states(fold(messages)).where(F.col("reason").isNotNull()).select("session_id", "reason")


def conversations(messages: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Kept sessions as ordered turns: ``session_id, part, n_turns, turns``.

    ``turns`` is an array of (turn_number, role, content), ordered by turn and, within a turn, user, music,
    assistant and time: the last version of each message, without deleted ones.  A session of more than
    ``part_turns`` turns comes out in consecutive parts, so no task has to hold an unbounded session.
    """
    kept = session_states(fold(messages)).where(F.col("reason").isNull()).select("session_id", "n_turns")
    folded = fold(messages, content=True).withColumnRenamed("session_id", "_session")
    rows = folded.join(kept, F.col("_session").eqNullSafe(F.col("session_id"))).drop("_session")
    rows = rows.where((F.col("n_versions") == 1) | F.col("content").isNotNull())
    place = F.when(F.col("speaker") == "user", 1).when(F.col("speaker") == "music", 2).otherwise(3)
    turn = F.struct("turn_number", place.alias("place"), F.col("created").alias("first"), F.col("speaker").alias("role"), "content")
    return (
        rows.withColumn("part", F.floor((F.col("turn_number") - 1) / part_turns).cast("int"))
        .groupBy("session_id", "part")
        .agg(F.max("n_turns").alias("n_turns"), F.array_sort(F.collect_list(turn)).alias("t"))
        .select(
            "session_id",
            "part",
            "n_turns",
            F.transform("t", lambda x: F.struct(x["turn_number"].alias("turn_number"), x["role"].alias("role"), x["content"].alias("content"))).alias("turns"),
        )
    )

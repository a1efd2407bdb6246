from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recflow.functions import text as tx
from recflow.operators import history, quality, slicing, splits
from recflow.sources import tables

MESSAGES = "msg_id bigint, session_id string, user_id string, turn_number int, role string, content string, sent_at timestamp, ingested_at timestamp"


def messages(spark, rows):
    at = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, s, "u", t, r, c, at, at) for i, (s, t, r, c) in enumerate(rows)], MESSAGES)


def test_history_is_strictly_earlier(spark):
    m = messages(spark, [("s", 1, "user", "hi"), ("s", 1, "music", "t1"), ("s", 1, "music", "t1"), ("s", 2, "Human ", "more"), ("s", 2, "track", "t2"), ("s", 2, "bot", "ok"), ("s", 3, "user", None)])
    got = slicing.turn_slices(m).orderBy("turn_number").collect()
    assert [(r["turn_number"], r["query"], r["tracks"], r["n_history"], r["seen"]) for r in got] == [(1, "hi", ["t1"], 0, []), (2, "more", ["t2"], 2, ["t1"])]


def test_request_pairs_use_the_latest_utterance_once(spark):
    rows = [("s", 1, "user", "u1"), ("s", 1, "music", "m1"), ("s", 1, "music", "m2"), ("s", 2, "user", "u2"), ("s", 3, "user", "u3"), ("s", 3, "music", "m3")]
    got = history.request_pairs(messages(spark, rows)).orderBy("turn_number").collect()
    assert [(r["utterance"], r["track_id"]) for r in got] == [("u1", "m1"), ("u3", "m3")]


@pytest.mark.parametrize(("same_day", "want"), [(False, {"a": 0, "b": 1, "c": 1, "d": 0}), (True, {"a": 0, "b": 2, "c": 2, "d": 0})])
def test_prior_sessions_are_before_the_date(spark, same_day, want):
    rows = [("a", "u", "2024-01-01"), ("b", "u", "2024-01-02"), ("c", "u", "2024-01-02"), ("d", "u", ""), ("e", "", "2024-01-03"), ("e", None, None)]
    got = history.prior_sessions(spark.createDataFrame(rows, "session_id string, user_id string, session_date string"), same_day).collect()
    assert {r["session_id"]: r["n_prior"] for r in got} == want


def test_text_phrases(spark):
    df = spark.createDataFrame([("1993-05", 2.5), ("1996", 3.5), ("1999", 80.0), ("", None), (None, 19.4)], "d string, p double")
    got = df.select(tx.decade_phrase(F.col("d")).alias("e"), tx.popularity_round(F.col("p")).alias("p"), tx.popularity_phrase(F.col("p")).alias("h")).collect()
    assert [(r["e"], r["p"], r["h"]) for r in got] == [("early 1990s", 2, "obscure"), ("mid 1990s", 4, "obscure"), ("late 1990s", 80, "highly popular"), (None, None, None), (None, 19, "obscure")]


def test_tags(spark):
    df = spark.createDataFrame([(["Rock. ", "rock", "10 of 10 stars", "Colour", "x" * 31, "80s", " "],), (None,), ([],)], "t array<string>")
    got = [r for r in df.select(tx.clean_tags(F.col("t")).alias("c"), tx.search_tags(F.col("t")).alias("s")).collect()]
    assert [r["c"] for r in got] == [["rock", "color", "80s"], [], []]
    assert got[0]["s"] == ["rock.", "rock", "colour", "x" * 31]


def test_truncate_words(spark):
    df = spark.createDataFrame([("hello wide world",), ("short",), ("a" * 20,)], "t string")
    assert [r["x"] for r in df.select(tx.truncate_words(F.col("t"), 12).alias("x")).collect()] == ["hello wide", "short", "a" * 12]


def test_quality_flags(spark):
    line = "la la la la la la la la la la la la la la\n"
    rows = [(1, "[Instrumental]", "n/a", "C", "120", None, "x"), (2, line * 4, "a caption that is long enough to count", "C", "fast", "Am", None), (3, None, "  ", "", "", "", ""), (4, "words " * 30, "a caption that is long enough to count", "C", "NaN", "C", "m")]
    df = spark.createDataFrame(rows, "crawl_id bigint, lyrics string, caption string, chord string, tempo string, music_key string, mbid string")
    got = {r["crawl_id"]: r for r in quality.flags(df).collect()}
    assert {"lyrics_instrumental_marker", "lyrics_too_short", "caption_too_short", "key_empty"} <= set(got[1]["flags"]) and not got[1]["ok"]
    assert got[2]["flags"] == ["lyrics_repeated_line_dominant", "mbid_missing", "tempo_invalid"] and not got[2]["ok"]
    assert "lyrics_empty" in got[3]["flags"] and "tempo_empty" in got[3]["flags"]
    assert got[4]["ok"] and got[4]["flags"] == ["tempo_invalid"]


def test_folds_keep_groups_together_and_are_even(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 53)
    got = splits.k_folds(df, F.col("g"), 5).select("g", "fold").distinct().groupBy("fold").count().collect()
    assert sum(r["count"] for r in got) == 53
    assert max(r["count"] for r in got) - min(r["count"] for r in got) <= 1


def test_jsonl_leaves_out_malformed_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\nnot json\n{"id": "b"}\n\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    rows = tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("a", 1), ("b", None)]


def test_upsert_and_precedence(spark):
    current = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "id string, v int, at int")
    changes = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1), (None, 5, 9)], "id string, v int, at int")
    got = {r["id"]: r["v"] for r in tables.upsert(current, changes, ["id"], [F.col("at")]).collect()}
    assert got == {"a": 1, "b": 3, "c": 4}
    first = {r["id"]: r["v"] for r in tables.union_first_wins([current, changes.where("id is not null and v <> 3")], "id").collect()}
    assert first == {"a": 1, "b": 1, "c": 4}


def test_partitioned_round_trip(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "id % 3 AS turn_number")
    tables.write_partitioned(df, str(tmp_path / "t"), ["turn_number"])
    assert spark.read.parquet(str(tmp_path / "t")).where("turn_number = 1").count() == 7


def test_streams(spark, tmp_path):
    from recflow.streaming import sessions as st

    m = messages(spark, [("s", 1, "user", "a"), ("s", 1, "user", "a"), ("s", 1, "assistant", "b"), ("s", 1, None, "c")])
    m.write.parquet(str(tmp_path / "in"))
    stream = st.read_messages(spark, str(tmp_path / "in"))
    q = st.activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["speaker"]: r["n"] for r in spark.table("activity").collect()} == {"user": 2, "assistant": 1, "other": 1}
    q = st.distinct_arrivals(st.read_messages(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrivals").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("arrivals").count() == 3


def test_queries_have_oracles_or_are_known_without():
    from recflow.plans.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) <= {"diversified", "match_flags", "all_flags", "crawl_segments", "citation_states", "repaired_replies", "padded_responses", "pool_bm25_qmr"}

"""Extra columns whose names clash with inner ones, nulls everywhere, repeated rows and empty tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from recflow.llm import p1_entities, p2_overlap, p3_neighbors, p4_truncation, p5_splits, p6_pairs, p7_conversations, p8_tokens, p9_packing, p10_sentences

CLASHES = ("cls", "component", "speaker", "ident", "record", "track", "v", "n", "word", "frame", "keys", "label", "session", "container", "item", "end_char", "cell", "title", "ids", "version", "found", "key")


def widened(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES if c not in df.columns))


def both(df, count):
    """Same number of rows with clashing columns, and none from an empty table."""
    n = count(df)
    assert count(widened(df)) == n
    assert count(widened(df).limit(0)) == 0
    return n


def test_documents(spark):
    df = spark.createDataFrame([(1, "One here. Two there.", "a"), (1, "One here. Two there.", "a"), (None, None, None), (2, "", None)], "doc_id bigint, text string, source string")
    assert both(df, lambda d: p8_tokens.token_ids(d).count()) == 4
    assert both(df, lambda d: p9_packing.fill_containers(d).count()) == 4
    assert both(df, lambda d: p10_sentences.sentences(d, texts=False).count()) == 4


def test_messages(spark):
    at = dt.datetime(2025, 1, 1)
    rows = [(1, "s", "u", 1, "user", "A question?", at, at), (2, "s", "u", 1, "assistant", None, None, at), (3, None, None, None, None, None, None, None), (2, "s", "u", 1, "assistant", None, None, at)]
    df = spark.createDataFrame(rows, "msg_id bigint, session_id string, user_id string, turn_number int, role string, content string, sent_at timestamp, ingested_at timestamp")
    assert both(df, lambda d: p6_pairs.first_defects(d).count()) == 1
    assert both(df, lambda d: p7_conversations.dropped_sessions(d).count()) == 1
    assert both(df, lambda d: p7_conversations.conversations(d).count()) == 1


def test_pairs(spark):
    q = "please find me a tender song for the long ride"
    rows = [(1, "S-1", 1, "train", "x", q), (2, "s1", 2, "devset", "x", q.upper()), (3, None, None, None, None, None), (4, "s1", 1, "devset", None, "")]
    df = spark.createDataFrame(rows, "pair_id bigint, session_id string, turn_number int, split string, source string, query string")
    sessions = spark.createDataFrame([("S1", "u"), ("S1", "u"), (None, None)], "session_id string, user_id string")
    assert both(df, lambda d: p2_overlap.overlap_pairs(d).count()) == 2
    assert both(df, lambda d: p5_splits.assign_splits(d, widened(sessions)).count()) == 4
    assert p5_splits.assign_splits(df, sessions.limit(0)).count() == 4


def test_catalog(spark):
    records = spark.createDataFrame([(1, "Cold Kingdom", "Papri Lanbri", None, 304.0), (1, "Cold Kingdom", "Papri Lanbri", None, 304.0), (2, None, None, None, None)], "record_id bigint, track_name string, artist_name string, album_name string, duration double")
    tracks = spark.createDataFrame([("a", ["Cold Kingdom"], ["Papri Lanbri"], None, 304402), (None, None, None, None, None)], "track_id string, track_name array<string>, artist_name array<string>, album_name array<string>, duration int")
    assert both(records, lambda d: p1_entities.found(d, widened(tracks)).count()) == 1
    assert p1_entities.found(records, tracks.limit(0)).count() == 0
    crawl = spark.createDataFrame([(1, "a line\nand a [cut", None, None), (1, "a line\nand a [cut", None, {}), (None, None, None, None)], "crawl_id bigint, lyrics string, caption string, sources map<string,string>")
    assert both(crawl, lambda d: p4_truncation.truncated_values(d).count()) == 1
    vectors = spark.createDataFrame([("cf-bpr", "a", [1.0] * 128), ("cf-bpr", "b", [1.0] * 127 + [0.9]), ("cf-bpr", "b", [1.0] * 127 + [0.9]), (None, "c", [1.0] * 128), ("cf-bpr", None, None)], "vector_type string, track_id string, vector array<float>")
    assert both(vectors, lambda d: p3_neighbors.close_pairs(d).count()) == 1

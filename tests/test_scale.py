"""Searches and histories whose pairs must not leave their task: results against brute force, and what is shuffled."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from recflow.functions import compose
from recflow.llm import p2_overlap
from recflow.operators import history, pools, priors, ranking, retrieval
from recflow.plans import more, queries


def bm25(queries: dict, docs: dict, k: int, seen: dict | None = None) -> dict:
    words = {i: re.findall("[a-z0-9][a-z0-9]+", t.lower()) for i, t in docs.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, text in queries.items():
        scores = defaultdict(Decimal)
        for w in set(re.findall("[a-z0-9][a-z0-9]+", text.lower())) & df.keys():
            for i, ws in words.items():
                if tf := ws.count(w):
                    weight = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / mean))
                    scores[i] += Decimal(weight).quantize(Decimal("1e-9"), ROUND_HALF_UP)
        top = sorted((-float(s.quantize(Decimal("1e-6"), ROUND_HALF_UP)), i) for i, s in scores.items() if i not in (seen or {}).get(q, ()))[:k]
        out |= {(q, r): (i, -s) for r, (s, i) in enumerate(top, 1)}
    return out


@pytest.mark.parametrize(("block", "sent"), [(1 << 14, 1 << 22), (7, 40)])
def test_bm25_equals_brute_force(spark, monkeypatch, block, sent):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = {f"d{i:03d}": "Title: " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6))) for i in range(90)} | {"e": ""}
    queries = {i: "title " * (i % 3 == 0) + " ".join(rng.choice([*vocabulary, "unknown"]) for _ in range(rng.randrange(5))) for i in range(20)}
    monkeypatch.setattr(retrieval, "MOST_QUERY_WORDS", sent)
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", block)
    q = spark.createDataFrame([*queries.items(), (None, "w1"), (50, None)], "q long, text string")
    d = spark.createDataFrame([*docs.items()], "d string, doc string")
    got = {(r["q"], r["rank"]): (r["d"], r["score"]) for r in retrieval.search(q, d, 8, "q", "text", "d", "doc").collect()}
    assert got == bm25(queries, docs, 8)
    assert retrieval.search(q.limit(0), d, 8, "q", "text", "d", "doc").count() == retrieval.search(q, d.limit(0), 8, "q", "text", "d", "doc").count() == 0


def test_bm25_sends_the_best_only(spark):
    docs = spark.range(3000).select(F.format_string("d%05d", "id").alias("d"), F.concat(F.lit("title "), F.col("id")).alias("doc")).coalesce(1)
    queries = spark.range(10).select("id", F.lit("title").alias("text"))
    assert retrieval.candidates(queries, docs, 5, "id", "text", "d", "doc").count() == 50
    found = retrieval.search(queries, docs, 5, "id", "text", "d", "doc").where("id = 7").orderBy("rank").collect()
    assert [r["d"] for r in found] == [f"d{i:05d}" for i in range(5)]


def test_text_pool_equals_brute_force(spark):
    rng = random.Random(2)
    names = ["Circus No. 10", " 0 Anchor 1 ", "Letting Go", "Golden Ladder"]
    tracks = [(f"t{i:02d}", [f"{rng.choice(names)} {i % 4}"], [rng.choice(names)], [rng.choice(names), ""], "1999", None, None, None) for i in range(60)]
    catalog = spark.createDataFrame(tracks, "track_id string, track_name array<string>, artist_name array<string>, album_name array<string>, release_date string, popularity double, duration int, tag_list array<string>")
    queries = {i: (rng.choice(names), rng.sample([t[0] for t in tracks], i)) for i in range(5)}
    q = spark.createDataFrame([(i, t, s, None) for i, (t, s) in queries.items()], "query_id long, query string, seen array<string>, specificity string")
    got = {(r["query_id"], r["rank"] + 1): (r["track_id"], r["score"]) for r in pools.text_pool(pools.Context(q, catalog), 6, ("track_name", "artist_name", "album_name")).collect()}
    docs = {t[0]: f"track_name: {t[1][0].strip()}\nartist_name: {t[2][0].strip()}\nalbum_name: {t[3][0].strip()}" for t in tracks}
    lines = {t[0]: f"{t[1][0]} {t[2][0]} {t[3][0]}" for t in tracks}
    asked = {i: "\n".join([*(lines[x] for x in s), t]) for i, (t, s) in queries.items()}
    assert got == bm25(asked, docs, 6, {i: s for i, (_, s) in queries.items()})


def test_names_keep_their_first_and_last_figures(spark):
    row = spark.range(1).select(F.array(F.lit("0 Days No. 10 "), F.lit("1 More 1")).alias("x"))
    assert row.select(compose.joined(F.col("x"))).collect()[0][0] == "0 Days No. 10, 1 More 1"


PAIRS = "user_id string, session_id string, session_date string, place int, turn_number int, utterance string, track_id string"


@pytest.fixture(scope="module")
def told(spark):
    """(pairs, targets) of a few users with equal dates, undated sessions and sessions without pairs."""
    rng = random.Random(4)
    pairs, targets = [], []
    for u in range(4):
        sessions = sorted((rng.choice(["", *(f"2024-01-{d:02d}" for d in range(1, 6))]), f"u{u}s{i}") for i in range(12))
        targets += [(s, f"u{u}", date or None) for date, s in sessions]
        held = [x for x in sessions if rng.random() < 0.8]
        for place, (date, s) in enumerate(held, 1):
            pairs += [(f"u{u}", s, date or None, place, t, rng.choice(["a song", "none"]), f"t{rng.randrange(6)}") for t in range(rng.randrange(1, 5))]
    return spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(targets, "target string, user_id string, target_date string")


@pytest.mark.parametrize(("word", "k", "strict", "latest"), [("song", 5, True, False), (None, 3, True, True), (None, 4, False, False), ("song", 2, False, True)])
def test_pairs_before_equal_the_paired_sessions(told, word, k, strict, latest):
    pairs, targets = told
    keep = history.holds(word) if word else None
    want = history.select_pairs(history.before(pairs, targets, strict), keep, k, latest=latest).select("target", "n", *pairs.columns)
    got = history.pairs_before(pairs, targets, keep, k, strict, latest)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def vectors_of(spark, rng, sizes: list[int]):
    """Vectors of t0 to t5: small whole numbers (so that equal cosines occur), one with a null, one of another length."""
    rows = [(f"t{i}", [float(rng.randrange(-2, 3)) for _ in range(n)] if n else [1.0, None]) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "track_id string, vector array<float>")


def shuffled_rows(spark, df) -> int:
    """Rows that all stages of a run write for others."""
    def stages():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = sc._jvm.java.util.ArrayList()
        found = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    old = stages().keys()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for i, n in stages().items() if i not in old)


@pytest.fixture(scope="module")
def one_listener(spark, tmp_path_factory):
    """Tables of one user with 300 sessions of two plays, each on a day of its own."""
    at, rng = tmp_path_factory.mktemp("one"), random.Random(6)
    messages = [(4 * i + 2 * t + m, f"s{i:03d}", "u", t, ("user", "music")[m], (f"song {i}", f"t{2 * i + t}")[m]) for i in range(300) for t in range(2) for m in range(2)]
    vectors = [(kind, f"t{i}", [rng.gauss(0, 1) for _ in range(n)]) for kind, n in (("cf-bpr", 128), (pools.VECTOR_POOLS["qemb_metadata"], 1024)) for i in range(600 if n < 1000 else 50)]
    for name, rows, kinds in (
        ("messages", messages, "msg_id long, session_id string, user_id string, turn_number int, role string, content string"),
        ("sessions", [(f"s{i:03d}", "u", f"20{i // 28:02d}-01-{i % 28 + 1:02d}") for i in range(300)], "session_id string, user_id string, session_date string"),
        ("track_vectors", vectors, "vector_type string, track_id string, vector array<float>"),
    ):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("query", ["relevant_priors", "scored_pairs"])
def test_sessions_of_a_user_are_not_paired(spark, one_listener, query):
    # 300 sessions have 89,700 earlier pairs.  Joins are those of large tables.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert 0 < shuffled_rows(spark, getattr(more, query)(spark, one_listener)) < 15_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("most", [1 << 15, 7])
def test_relevant_before_equals_the_paired_sessions(spark, told, monkeypatch, most):
    pairs, targets = told
    rng = random.Random(5)
    monkeypatch.setattr(priors, "MOST_HEARD", most)
    monkeypatch.setattr(priors, "MOST_ASKED", most)
    signals = [(vectors_of(spark, rng, [3, 3, 3, 3, 0, 2]), 0.5), (vectors_of(spark, rng, [2, 2, 0, 3, 2]), 1.0)]
    candidates = spark.createDataFrame([(t["target"], f"t{rng.randrange(7)}") for t in targets.collect() for _ in range(2)], "target string, candidate string")
    want = history.relevant_priors(history.before(pairs, targets), candidates, signals)
    got = priors.relevant_before(pairs, targets, candidates, signals)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize(("most", "least", "k"), [(1 << 15, 0.05, 3), (7, -1.0, 5)])
def test_scored_before_equals_the_paired_sessions(spark, told, monkeypatch, most, least, k):
    pairs, targets = told
    rng = random.Random(7)
    monkeypatch.setattr(priors, "MOST_HEARD", most)
    monkeypatch.setattr(priors, "MOST_ASKED", most)
    vectors = vectors_of(spark, rng, [3, 3, 3, 0, 2, 2])
    wanted = spark.createDataFrame([(t["target"], f"t{rng.randrange(7)}") for t in targets.collect()], "target string, track_id string")
    asked = wanted.join(vectors, "track_id").select("target", "vector")
    want = history.score_pairs(history.before(pairs, targets), asked, vectors, least, k).select("target", "n", "track_id", "sim")
    got = priors.scored_before(pairs, targets, wanted, vectors, least, k).select("target", "n", "track_id", "sim")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_overlap_words_of_all_scripts(spark):
    hindi = "मेरी पसंद की पुरानी हिंदी गाने वाली सूची दिखाओ ज़रा अभी"
    rows = [("train", hindi), ("devset", hindi.replace("पुरानी", "नयीवाली")), ("train", "play the old_school rock_music list of mine"), ("devset", "play the old school rock music list of mine")]
    rows += [("train", "one two three four five si\x07x"), ("devset", "one two three four five six")]
    df = spark.createDataFrame([(i, s, "x", q, None, None) for i, (s, q) in enumerate(rows)], "pair_id long, split string, source string, query string, session_id string, turn_number int")
    assert {tuple(r) for r in p2_overlap.overlap_pairs(df).collect()} == {(0, 1), (2, 3), (4, 5)}
    assert p2_overlap.plain("Él “sing” naïve_x – Ⅷ\u200b") == "el sing naive x viii"


@pytest.fixture(scope="module")
def pairs_of_200(spark, tmp_path_factory):
    """Tables of 200 pairs, each of which asks for a word that tracks hold."""
    at = tmp_path_factory.mktemp("pairs")
    vectors = [(pools.VECTOR_POOLS["qemb_metadata"], f"t{i}", [1.0, float(i), 0.5]) for i in range(30)]
    for name, rows, kinds in (
        ("train_pairs", [(i, f"s{i}", 1, "train" if i % 2 else "devset", f"a song{i % 30} please", "HH" if i % 3 else "LL", f"t{i % 30}", [f"t{i % 7}"] * (i % 4 > 0)) for i in range(1, 201)], "pair_id long, session_id string, turn_number int, split string, query string, specificity string, track_id string, seen array<string>"),
        ("tracks", [(f"t{i}", [f"Song{i}"], ["Ann"], ["Moon"], "1999-01-01", 5.0, 100, ["rock"]) for i in range(30)], "track_id string, track_name array<string>, artist_name array<string>, album_name array<string>, release_date string, popularity double, duration int, tag_list array<string>"),
        ("track_crawl", [(i, f"t{i}", "2020-01-01", "la la", None, ["rock"], "L", "DE", "1999", 100.0, "C", None) for i in range(30)], "crawl_id long, track_id string, fetched_at string, lyrics string, caption string, mb_tags array<string>, label string, country string, mb_release_date string, tempo double, music_key string, chord string"),
        ("track_vectors", vectors, "vector_type string, track_id string, vector array<float>"),
    ):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("query", ["bm25_search", "pool_bm25", "pool_bm25_crawl_lyrics", "pool_bm25_simple", "pool_bm25_tags_crawl_kw", "pool_weighted", "predict_routed", "pool_bm25_qmr"])
def test_every_pair_is_asked(spark, pairs_of_200, query):
    got = queries.QUERIES[query](spark, pairs_of_200)
    assert {r[0] for r in got.select(got.columns[0]).distinct().collect()} == set(range(1, 201))


@pytest.mark.parametrize(("first", "left"), [(1, 0.0), (2, 0.25), (8, 0.99)])
def test_words_left_for_later_lose_no_document(spark, monkeypatch, first, left):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = {f"d{i:03d}": "Title: " + " ".join(rng.choices(vocabulary, range(1, 41), k=rng.randrange(9))) for i in range(400)}
    asked = {i: "title " * (i % 2) + " ".join(rng.choices(vocabulary, k=rng.randrange(12))) for i in range(40)} | {90: "title", 91: "title"}
    monkeypatch.setattr(retrieval, "FIRST_ENTRIES", first)
    monkeypatch.setattr(retrieval, "LEFT", left)
    monkeypatch.setattr(retrieval, "SLICE_QUERIES", 7)
    q, d = spark.createDataFrame([*asked.items()], "q long, text string"), spark.createDataFrame([*docs.items()], "d string, doc string")
    got = {(r["q"], r["rank"]): (r["d"], r["score"]) for r in retrieval.search(q, d, 5, "q", "text", "d", "doc").collect()}
    assert got == bm25(asked, docs, 5)


def test_many_query_vectors_go_in_rounds(spark, monkeypatch):
    rng = random.Random(9)
    v = spark.createDataFrame([(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(40)], "i long, x array<float>")
    whole = sorted(map(tuple, ranking.dense_top_k(v, v, 7, "i", "x").collect()))
    monkeypatch.setattr(ranking, "MOST_QUERY_BYTES", 100)
    assert sorted(map(tuple, ranking.dense_top_k(v, v, 7, "i", "x").collect())) == whole and len(whole) == 280


def test_an_ensemble_leaves_out_pools_that_lack_input_only(spark, monkeypatch):
    catalog = spark.createDataFrame([("t1", ["Song"], ["Ann"], ["Moon"], "1999")], "track_id string, track_name array<string>, artist_name array<string>, album_name array<string>, release_date string")
    context = pools.Context(spark.createDataFrame([(1, "song", [])], "query_id long, query string, seen array<string>"), catalog)
    assert pools.ensemble(context, 5, ("bm25_music_only", "qemb_metadata", "bm25_crawl")).count() == 1

    def broken(context, n):
        raise ValueError("a failure of its own")

    monkeypatch.setitem(pools.POOLS, "broken", broken)
    for name in ("broken", "no such pool"):
        with pytest.raises(ValueError):
            pools.ensemble(context, 5, ("bm25_music_only", name))

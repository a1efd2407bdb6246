"""Micro cases of compositions, histories, selections, citations and pools, with answers worked out by hand."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from recflow.functions import compose, cues
from recflow.functions import text as tx
from recflow.operators import citations, evaluation, features, history, pools, postprocess, quality, selection

SMALL = "/root/testdata/sf0.001"


def one(spark, expression, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, value if not isinstance(value, str | None.__class__) else F.lit(value).cast("string"))
    return df.select(expression.alias("x")).collect()[0]["x"]


def test_eras_and_cues(spark):
    assert one(spark, cues.eras(F.col("t")), t="80s or '90 hits, nineties, 1984, 1991s, 25s and the twenties") == ["1980s", "1990s", "2020s"]
    assert one(spark, cues.eras(F.col("t")), t=None) == []
    assert one(spark, cues.first_cue(F.col("t"), cues.POPULARITY_CUES), t="A Smash  Hit, no niche") == "top-tier"
    assert one(spark, cues.goal_phrase(F.lit("g"), F.lit(" hl ")), t="") == "wants tracks matching a specific mood and emotion angle"
    assert one(spark, cues.goal_phrase(F.lit("Z"), F.lit("HH")), t="") is None


@pytest.mark.parametrize(("popularity", "word"), [(20.0, "obscure"), (20.5, "obscure"), (21.5, "niche"), (60.0, "moderate popularity"), (80.0, "highly popular"), (80.6, "mainstream hit"), (None, None)])
def test_popularity_words(spark, popularity, word):
    assert one(spark, tx.popularity_phrase(F.lit(popularity).cast("double")), t="") == word


def test_kept_tags(spark):
    freq = F.create_map(*(F.lit(x) for kv in {"rock": 50, "indie rock": 60, "pop": 9, "synth pop": 9, "rare": 1}.items() for x in kv))
    tags = F.array(*(F.lit(t) for t in ("Rock", "indie rock", "pop", "Synth Pop.", "rare", "rock")))
    assert one(spark, tx.kept_tags(tags, freq), t="") == ["indie rock", "synth pop"]
    assert one(spark, tx.kept_tags(tags, freq, least=1, dedup=False, most=3, by_frequency=True), t="") == ["indie rock", "rock", "pop"]
    assert one(spark, tx.kept_tags(F.lit(None).cast("array<string>"), freq), t="") == []
    assert one(spark, tx.search_tags(F.array(F.lit("via pandora"), F.lit("Soul"), F.lit("x"), F.lit("80s"))), t="") == ["soul"]


def test_names_and_match_flags(spark):
    rows = [
        (1, "Letting Go", "Ann", 200_000, ("letting go (feat. Bo)", "ann", 205.0, "lrclib_get")),
        (2, "artist", "Ann", 200_000, ("some other artist", "Bob", 250.0, "genius_search")),
        (3, "Letting Go", None, 0, ("Letting Go live", "x", 250.0, "lrclib_search")),
        (4, "a", "b", 1, None),
    ]
    df = spark.createDataFrame(rows, "crawl_id int, track_name string, artist_name string, duration int, lyrics_match struct<track_name:string,artist_name:string,duration:double,method:string>")
    got = {r["crawl_id"]: r["flags"] for r in quality.match_flags(df).collect()}
    assert got == {1: [], 2: ["lyrics_artist_mismatch", "lyrics_duration_mismatch", "lyrics_method_search_fuzzy", "lyrics_title_mismatch"], 3: ["lyrics_method_search_fuzzy"]}
    assert one(spark, quality.unprintable(F.col("t")), t="\x00" * 15 + "abcdefghij") is True
    assert one(spark, quality.unprintable(F.col("t")), t="\x00" * 15) is False


def test_query_text_fits_its_budget(spark):
    empty = F.array().cast("array<string>")
    lines = F.array(*(F.lit(f'"Song {i}" by Somebody Long Enough ({1990 + i}, folk)') for i in range(5)))
    q = {"recent": lines, "goal": F.lit("wants a specific era sound track"), "era": F.lit("1990s"), "popularity": F.lit("niche"), "tags": F.array(F.lit("folk")), "goal_eras": empty, "goal_popularity": F.lit(None).cast("string"), "goal_time": F.lit("classic"), "wish": F.lit(" Something QUIET "), "category": F.lit("era sound")}
    full = one(spark, compose.query_text(q, 240), t="")
    assert full.endswith("\nLooking for: something quiet — era sound") and "Context: wants a specific era sound track. era 1990s; niche; tags: folk. time cue: classic." in full
    for budget in (90, 60, 40, 12, 3):
        text = one(spark, compose.query_text(q, budget), t="")
        assert len(text) <= budget * 3.5 and full.endswith(text[-10:])


def test_history_cut_by_date(spark):
    pairs = spark.createDataFrame([("u", f"s{i}", date, i, 1, "a song", f"t{i}") for i, date in enumerate([None, "2024-01-01", "2024-01-02"])], "user_id string, session_id string, session_date string, place int, turn_number int, utterance string, track_id string")
    targets = spark.createDataFrame([("x", "u", "2024-01-02"), ("s1", "u", None)], "target string, user_id string, target_date string")
    strict = {(r["target"], r["track_id"]) for r in history.before(pairs, targets).collect()}
    assert strict == {("x", "t1"), ("s1", "t0"), ("s1", "t2")}
    assert {r["track_id"] for r in history.before(pairs, targets, strict=False).where("target = 'x'").collect()} == {"t0", "t1", "t2"}
    first = history.select_pairs(history.before(pairs, targets, strict=False).where("target = 'x'"), history.holds("SONG"), 2)
    assert [r["track_id"] for r in first.orderBy("n").collect()] == ["t0", "t1"]
    assert history.before(pairs.limit(0), targets).count() == 0


def test_fallback_layers(spark):
    wanted = spark.createDataFrame([(1, "HH", "first"), (2, "LL", "mid")], "w int, spec string, turn string")
    demos = spark.createDataFrame([("a", "HH", "first", 0.1), ("b", "HH", "mid", 0.9), ("c", "HH", "mid", 0.5), ("d", "XX", "mid", 0.7)], "id string, spec string, turn string, score double")
    got = selection.fallback(wanted, demos, [["spec", "turn"], ["spec"], []], 3, "w", "id", "score").orderBy("w", "place").collect()
    assert [(r["w"], r["id"], r["level"]) for r in got] == [(1, "a", 0), (1, "b", 1), (1, "c", 1), (2, "b", 2), (2, "d", 2), (2, "c", 2)]


def test_diversify_equals_its_definition(spark):
    lists = [[f"t{(q * 3 + i) % 17}" for i in range(12)] for q in range(9)] + [["t1", "t2"]]
    rows = [(f"q{q}", q, t, i) for q, ts in enumerate(lists) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "query string, ord bigint, track_id string, rank int")
    got: dict = {}
    for r in postprocess.diversify(df, 2, 6, 8, 0.5).orderBy("ord", "rank").collect():
        got.setdefault(r["query"], []).append(r["track_id"])
    use: dict = {}
    for q, ts in enumerate(lists):
        chosen = ts
        if len(ts) >= 6:
            rest = ts[2:10]
            top = max(use.values(), default=0) + 1
            cheap = sorted(range(len(rest)), key=lambda i: (0.5 * i / (len(rest) - 1) + 0.5 * use.get(rest[i], 0) / top, i))[:4]
            chosen = ts[:2] + [rest[i] for i in sorted(cheap)]
        assert got[f"q{q}"] == chosen
        for t in chosen:
            use[t] = use.get(t, 0) + 1


def test_padding_reaches_its_target(spark):
    rows = spark.createDataFrame([(i, "the same old words in every reply") for i in range(40)] + [(99, None)], "id int, reply string")
    tags = spark.createDataFrame([("".join(chr(97 + (i // 26**k) % 26) for k in range(3)), 100 - i) for i in range(80)], "tag string, n int")
    out = postprocess.pad_lexical(rows, ["id"], "reply", tags, 0.9)
    assert out.count() == 41 and evaluation.distinct_bigrams(out, "reply").collect()[0]["distinct2"] >= 0.9
    with pytest.raises(ValueError):
        postprocess.pad_lexical(rows, ["id"], "reply", tags, 1.0)


def test_citations(spark):
    replies = spark.createDataFrame([(1, 'Try "Cold Kingdom" by Somebody, “Paper Moons”, "Nowhere Song" and "My Wish".')], "id int, reply string")
    pool = spark.createDataFrame([(1, 1, "Cold kingdom!", "Ann"), (1, 2, "Paper Moon", "Bo")], "id int, idx int, pool_title string, artist string")
    asked = spark.createDataFrame([(1, "my wish")], "id int, protected_title string")
    found = citations.resolve(citations.cited(replies, ["id"], "reply"), pool, ["id"], asked)
    assert {r["title"]: (r["how"], r["idx"]) for r in found.collect()} == {"Cold Kingdom": ("exact", 1), "Paper Moons": ("fuzzy", 2), "Nowhere Song": ("fabricated", None), "My Wish": ("protected", None)}
    assert citations.repair(replies, found, ["id"], "reply").collect()[0]["reply"] == 'Try "Cold kingdom!" by Ann, "Paper Moon" by Bo and My Wish.'


def test_pool_names():
    assert pools.expand(["bm25", "tower_all", "bm25"]) == ["bm25", *(f"tower_fold{i}" for i in range(5))]
    assert pools.signature(["tower_fold1", "bm25", "tower_fold0"]) == "bm25-tower"
    assert pools.parse_tid(pools.format_tid("ens", ["bm25", "popular"], "agreement")) == ("ens", ["bm25", "popular"], "agreement")
    assert pools.parse_tid("ens__bm25")[2] == "passthrough"
    with pytest.raises(ValueError):
        pools.pool("no such pool")


def test_negative_shares_are_whole():
    assert all(abs(sum(p for _, p in ways) - 1) < 1e-9 for ways in features.NEGATIVE_SHARES.values())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_every_registered_query(spark):
    """Each core query can be built; those without SQL run (the others are held against their SQL by the driver)."""
    import __spark_entry__ as entry

    queries, sql = {k: v for k, v in entry.queries().items() if not k[1:2].isdigit()}, entry.oracle_sql()
    for name, query in queries.items():
        df = query(spark, SMALL)
        assert df.columns, name
        if name not in sql and name != "pool_bm25_qmr":
            assert df.count() > 0, name

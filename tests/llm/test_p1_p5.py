from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from recflow.llm import p1_entities, p2_overlap, p3_neighbors, p4_truncation, p5_splits
from recflow.llm.common import dealt_join

RECORDS = "record_id bigint, source string, track_name string, artist_name string, album_name string, duration double"
TRACKS = "track_id string, track_name array<string>, artist_name array<string>, album_name array<string>, duration int"


def test_entities(spark):
    tracks = spark.createDataFrame(
        [
            ("a", ["Cold Kingdom"], ["Papri Lanbri"], ["Cold Kingdom"], 304402),
            ("a", ["Cold Kingdom"], ["Papri Lanbri"], ["Cold Kingdom"], 304402),
            ("b", ["Cold Kingdom (Live at Tarrow)"], ["Papri Lanbri"], None, 330000),
            ("c", ["", "Swim or Steal"], ["Habri Délmo", "Guest One"], [], None),
            (None, ["Nothing"], ["Nobody"], [], 1000),
            ("d", None, None, None, 0),
        ],
        TRACKS,
    )
    records = spark.createDataFrame(
        [
            (1, "x", "COLD KINGDOM (2009 Remaster)", "Lanbri, Papri", None, 304.0),
            (2, "x", "Cold Kingdmo", "papri lanbri feat. Someone", "x", 0.0),
            (3, "x", "Cold Kingdom (Live at Tarrow)", "Papri Lanbri", "Live", 330100.0),
            (4, "x", "Cold Kingdom - Remix", "Papri Lanbri", None, 304.0),
            (5, "x", "Cold Kingdom", "Someone Else", "Cold Kingdom", 304.0),
            (6, "x", "Habri Delmo - Swim or Steal [Official Audio]", None, None, None),
            (7, "x", None, "Papri Lanbri", None, 304.0),
            (8, "x", "", "", "", None),
        ],
        RECORDS,
    )
    got = {r["record_id"]: r["track_id"] for r in p1_entities.found(records, tracks).collect()}
    assert {k: got.get(k) for k in range(1, 6)} == {1: "a", 2: "a", 3: "b", 4: None, 5: None}
    assert 7 not in got and 8 not in got
    assert p1_entities.found(records.limit(0), tracks).count() == 0


def test_window_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.random() < 0.4, f"0{rng.randrange(40):03d}") for i in range(400)]
    schema = "ident bigint, sig bigint, keys array<string>"
    records = spark.createDataFrame([(i, 0, [k]) for i, t, k in rows if not t], schema)
    tracks = spark.createDataFrame([(i, 0, [k]) for i, t, k in rows if t], schema)
    got = {tuple(r) for r in p1_entities.neighbours(records, tracks, 3).select("record", "track").collect()}
    order = sorted((k, t, i) for i, t, k in rows)
    listed = [(t, i) for _, t, i in order]
    want = set()
    for n, (t, i) in enumerate(listed):
        if not t:
            before = [x for is_t, x in listed[:n] if is_t][-3:]
            after = [x for is_t, x in listed[n:] if is_t][:3]
            want |= {(i, x) for x in before + after}
    assert got == want


def test_entities_of_large_blocks(spark):
    tracks = [(f"v{i:02d}", ["Cold Kingdom" + (f" (Live at Tarrow {i})" if i else "")], ["Papri Lanbri"], None, 200_000 + 9_000 * i) for i in range(40)]
    tracks += [(f"w{i:02d}", ["Golden Ladder"], [f"{c}abri Delmo"], None, 100_000 + 10_000 * i) for i, c in enumerate(("fghjklmnpqrstvwxz" * 3)[:40])]
    records = [(i, "x", t[1][0], "Papri Lanbri", None, None) for i, t in enumerate(tracks[:40])]
    records += [(100 + i, "x", "Golden Ladder", "x" + t[2][0], None, t[4] / 1000) for i, t in enumerate(tracks[40:])]
    tracks, records = spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(records, RECORDS)
    got = {r["record_id"]: r["track_id"] for r in p1_entities.found(records, tracks).collect()}
    assert got == {i: f"v{i:02d}" for i in range(40)} | {100 + i: f"w{i:02d}" for i in range(40)}
    one = spark.createDataFrame([(i, "a", "b") for i in range(7)] + [(9, "a", "")], "ident bigint, title string, artist string")
    assert sorted(tuple(r) for r in p1_entities.same_names(one, one, 3).collect()) == sorted(itertools.product(range(7), range(7)))


def test_auction_is_optimal(spark):
    rng = random.Random(5)
    worth = {(r, t): round(rng.uniform(0.8, 1), 2) for r in range(5) for t in range(4) if rng.random() < 0.7}
    pairs = spark.createDataFrame([(r, str(t), w) for (r, t), w in worth.items()], "record_id bigint, track_id string, confidence double")
    got = p1_entities.one_to_one(pairs).collect()
    assert len({r["track_id"] for r in got}) == len({r["record_id"] for r in got}) == len(got)
    best = max(sum(worth.get((r, t), 0) for r, t in zip(p, range(4), strict=True)) for p in itertools.permutations(range(5), 4))
    assert abs(sum(r["confidence"] for r in got) - best) <= 5e-3 + 1e-9


@pytest.mark.parametrize("vocabulary", [30, 3])  # with few words, shingles repeat within a text
def test_overlap_equals_brute_force(spark, vocabulary):
    rng = random.Random(vocabulary)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(160):
        if rows and rng.random() < 0.6:
            base = rows[rng.randrange(len(rows))][3].split()
            for _ in range(rng.randrange(4)):
                base = base or ["w1"]
                at = rng.randrange(len(base))
                base[at : at + 1] = rng.choice([[], [rng.choice(words)], [base[at], "new"]])
        else:
            base = [rng.choice(words) for _ in range(rng.choice([4, 6, 9, 12, 25, 40]))]
        rows.append((i, rng.choice(["train", "devset"]), "src", " ".join(base) or "w1", rng.choice(["S-1", "s1", "b", None]), rng.choice([1, 2, None])))
    rows += [(1000, "train", "src", None, None, None), (1001, "devset", "src", "", None, 3), (1002, "devset", "src", None, None, None)]
    df = spark.createDataFrame(rows, "pair_id bigint, split string, source string, query string, session_id string, turn_number int")
    got = {tuple(r) for r in p2_overlap.overlap_pairs(df).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = set()
    for a, b in itertools.combinations(rows, 2):
        if (a[1] == "train") == (b[1] == "train"):
            continue
        x, y = p2_overlap.plain(a[3]).split(), p2_overlap.plain(b[3]).split()
        text = min(len(x), len(y)) >= 6 and distance(x, y) <= max(len(x), len(y)) / 10
        turn = a[4] and b[4] and a[4].lower().replace("-", "") == b[4].lower().replace("-", "") and a[5] is not None and a[5] == b[5]
        if text or turn:
            want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == want
    report = p2_overlap.overlap_report(df).collect()
    assert sum(r["n_pairs"] for r in report) == len(want)
    assert sum(r["n_overlapping"] for r in report) == len({i for p in want for i in p if i in {r[0] for r in rows if r[1] != "train"}})
    assert sum(r["n_rows"] for r in report) == sum(r[1] != "train" for r in rows)


def test_overlap_of_shifted_repeats(spark):
    rows = [(1, "train", "x", "w0 w0 w1 w0 w0 w2 w0 w0 w0 w1", None, None), (2, "devset", "x", "w0 w0 w1 w0 w3 w0 w2 w0 w0 w0 w1", None, None)]
    rows += [(3, "train", "x", " ".join(["no"] * 10), None, None), (4, "devset", "x", "no no no no yes no no no no no", None, None)]
    df = spark.createDataFrame(rows, "pair_id bigint, split string, source string, query string, session_id string, turn_number int")
    assert {tuple(r) for r in p2_overlap.overlap_pairs(df).collect()} == {(1, 2), (3, 4)}


def test_dealt_join_equals_join(spark):
    left = spark.createDataFrame([(i % 3 if i < 40 else i, i) for i in range(60)] + [(None, 99)], "k int, a int")
    right = spark.createDataFrame([(0 if i < 30 else i, i) for i in range(50)] + [(None, 98)], "k int, b int")
    want = sorted(tuple(r) for r in left.join(right, "k").collect())
    assert sorted(tuple(r) for r in dealt_join(left, right, ["k"], 4).collect()) == want
    assert dealt_join(left.limit(0), right, ["k"]).count() == 0


def test_plain_sets_aside_marks_and_accents():
    assert p2_overlap.plain("Träume,  DE​L Sol…\n(Ok)!") == "traume del sol ok"
    assert p2_overlap.plain(None) == p2_overlap.plain("  ") == ""


def test_neighbors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 128))
    x[100:140] = x[:40] + 0.15 * rng.normal(size=(40, 128))
    x[200:215] = x[200]  # copies
    rows = [("cf-bpr", f"t{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[5], ("cf-bpr", "null", None), ("cf-bpr", "zero", [0.0] * 128), ("cf-bpr", "short", [1.0] * 64), ("cf-bpr", "nan", [float("nan")] * 128), ("other", "alone", [1.0] * 1024)]
    df = spark.createDataFrame(rows, "vector_type string, track_id string, vector array<float>")
    got = {tuple(r) for r in p3_neighbors.close_pairs(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = set()
    for i in range(300):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:10]
        want |= {("cf-bpr", f"t{min(i, j):03d}", f"t{max(i, j):03d}") for j in order if s[i, j] >= 0.85}
    assert got == want
    near = p3_neighbors.nearest(df, 10)
    assert near.where("track_id = 'alone'").count() == 0
    assert {r["n"] for r in near.groupBy("track_id").count().withColumnRenamed("count", "n").collect()} == {10}
    assert p3_neighbors.nearest(df.limit(0)).count() == 0


def test_truncation(spark):
    rng = random.Random(4)
    lines = [f"we were {v} till the morning came" for v in ("dancing", "driving", "hiding")] + ["tell the river i'm coming home", "hold on to the lantern"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(12)), "A slow build leads to cello and a sudden ending. It could be used for packing boxes.", {"lyrics": "a", "caption": "b"}) for i in range(200)]
    cuts = {1000: "we were dancing till the morn", 1001: "we were dancing till the", 1002: "tell the river i'm comi<more>", 1003: "[Cho", 1004: "hold on to the lan…"}
    rows += [(k, lines[0] + "\n" + v, None, None) for k, v in cuts.items()]
    rows += [(2000 + i, lines[0] + "\nla la la…", "  ", {}) for i in range(10)]
    rows += [(2100 + i, "Instrumental", "n/a", None) for i in range(10)]
    rows += [(2200, lines[0] + "\n[Outro]", None, None), (2201, None, None, None)]
    df = spark.createDataFrame(rows, "crawl_id bigint, lyrics string, caption string, sources map<string,string>")
    assert {(r["crawl_id"], r["field_name"]) for r in p4_truncation.truncated_values(df).collect()} == {(k, "lyrics") for k in cuts}
    assert p4_truncation.truncated_values(df.limit(0)).count() == 0


def test_length_spikes(spark):
    rows = [("lyrics", "a", 500, 500)] * 60 + [("lyrics", "a", 400 + i, 400 + i) for i in range(200)]
    got = p4_truncation.length_spikes(spark.createDataFrame(rows, "field_name string, source string, n_chars int, n_bytes int")).collect()
    assert {(r["measure"], r["length"]) for r in got} == {("chars", 500), ("bytes", 500)}


def test_values_at_a_field_limit(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda size: " ".join(word() for _ in range(200))[:size]
    lyrics = [line(120)[:-1] + "x" for _ in range(40)]  # cut at the limit
    lyrics += [line(119) + "." for _ in range(10)] + [line(119) + "…" for _ in range(5)] + [line(113) + "[Outro]" for _ in range(5)]
    lyrics += [line(60 + i)[:-1] + "x" for i in range(110) if i != 60]  # of any length
    lyrics += ["not on file yet zzz"] * 30  # a placeholder
    lyrics += [line(115) + "ééx"]  # as many bytes as the limit has characters
    df = spark.createDataFrame([(i, v, None, {"lyrics": "a"}) for i, v in enumerate(lyrics)], "crawl_id bigint, lyrics string, caption string, sources map<string,string>")
    got = {r["crawl_id"]: r for r in p4_truncation.judge(df).collect()}
    assert {k for k, r in got.items() if r["truncated"]} == set(range(40))
    assert {r["n_chars"] for r in got.values() if r["at_spike"]} >= {19, 120}
    assert {k for k, r in got.items() if r["at_limit"]} == set(range(60))


@pytest.mark.parametrize("users", [5, 60])
def test_splits_keep_components_together(spark, users):
    rng = random.Random(users)
    sessions = [(f"AB-{i}", f"u{rng.randrange(users)}" if i % 7 else "") for i in range(300)] + [("AB-1", "u0"), (None, "u1")]
    pairs = [(i, rng.choice(["ab{}", "AB-{}"]).format(rng.randrange(300)), 1, rng.choice("xyz")) for i in range(4000)] + [(5000, None, None, None), (5001, None, None, None)]
    p = spark.createDataFrame(pairs, "pair_id bigint, session_id string, turn_number int, source string")
    s = spark.createDataFrame(sessions, "session_id string, user_id string")
    got = p5_splits.assign_splits(p, s).collect()
    assert len(got) == len(pairs)
    where: dict = {}
    key = lambda x: x.lower().replace("-", "")
    known: dict = {}
    for a, u in sessions:
        if a and u:
            known.setdefault(key(a), set()).add(u)
    for r in got:
        if r["session_id"]:
            for node in {key(r["session_id"])} | known.get(key(r["session_id"]), set()):
                where.setdefault(node, set()).add(r["split"])
    assert all(len(v) == 1 for v in where.values())
    if users == 60:
        share = sum(r["split"] == "train" for r in got) / len(got)
        assert abs(share - 0.8) < 0.02


def test_components_follow_chains(spark):
    edges = spark.createDataFrame([(f"s{i}", f"u{i + d}") for i in range(20) for d in (0, 1)], "session string, user string")
    assert {r["component"] for r in p5_splits.components(edges).collect()} == {"u0"}


def test_plan_is_exact_on_small_pieces():
    plan = p5_splits.plan_bundles([("a", 1, 1000), ("a", 7, 30), ("b", 3, 200), ("b", 400, 1)])
    rows = [sum(v[k] * size for (_, size), v in plan.items()) for k in range(3)]
    total = sum(rows)
    assert total == 1000 + 210 + 600 + 400
    assert all(abs(r - total * s) <= 1 for r, s in zip(rows, (0.8, 0.1, 0.1), strict=True))

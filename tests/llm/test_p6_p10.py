from __future__ import annotations

import datetime as dt
import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from recflow.llm import p6_pairs, p7_conversations, p8_tokens, p9_packing, p10_sentences, tokenizer

MESSAGES = "msg_id bigint, session_id string, user_id string, turn_number int, role string, content string, sent_at timestamp, ingested_at timestamp"


def messages(spark, rows):
    at = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, s, "u", t, r, c, None if i % 5 == 0 else at, at + dt.timedelta(seconds=i)) for i, (s, t, r, c) in enumerate(rows)], MESSAGES)


def test_pair_defects(spark):
    q = "Can you find a tender song close to Cold Kingdom for a long train ride please"
    good = "My suggestion is \"Paper Moon\" by Dal Fenor, a gentle piece of folk that suits the gym."
    cases = {
        "ok": (q, good), "empty": (q, None), "empty2": (q, " ​"), "empty3": (q, "[empty]"), "empty4": (q, "..."),
        "refusal": (q, "I'm sorry, but I can't discuss Salo & Pertal. Maybe another service can assist."),
        "trap": (q, "I must decline to pick a favourite, so here is the louder one. " + good),
        "copy": (q, "> " + q.upper()), "echo": (q, "You want a tender song? " + good),
        "other_language": (q, "Mein Vorschlag ist Paper Moon, dort klingt Dal Fenor noch sanfter als sonst und passt für den Weg."),
        "truncated": (q, "My suggestion is \"Paper Moon\" by Dal Fenor, a gentle piece of folk that suits the"),
        "smile": (q, good[:-1] + " 🎶"),
    }
    rows = [(f"filler{i}", 1, r, c) for i in range(40) for r, c in (("user", q + f" number {i}"), ("assistant", good))]
    for name, (a, b) in cases.items():
        rows += [(name, 1, "user", a), (name, 1, "assistant", b), (name, 1, "Assistant ", b)]
    rows += [("two", 1, "user", q), ("two", 1, "user", q + "!"), ("two", 1, "assistant", None), ("blank", 1, "user", " "), ("blank", 1, "assistant", None), ("two answers", 1, "user", q), ("two answers", 1, "assistant", "a"), ("two answers", 1, "assistant", None)]
    got = {r["session_id"]: r["defect"] for r in p6_pairs.first_defects(messages(spark, rows)).collect()}
    assert got == {n: n.rstrip("0123456789") for n in cases if n not in ("ok", "trap", "echo", "smile")}
    assert p6_pairs.first_defects(messages(spark, rows).limit(0)).count() == 0


def test_rules_beyond_the_lists():
    for text in ("Desculpe, não posso ajudar com isso.", "Mi dispiace, non posso rispondere.", "К сожалению, не могу помочь с этим.", "抱歉，我无法回答这个问题。"):
        assert p6_pairs.is_refusal(text), text
    assert not p6_pairs.is_refusal('Mi dispiace, non posso rispondere. Prova "Paper Moon" di Dal Fenor.')
    for text in ("." * 60, "." * 61, "-- " * 500, " " * 200 + "No response" + " " * 200, "\u200b" * 90):
        assert p6_pairs.is_empty_answer(text), text
    assert not p6_pairs.is_empty_answer("ok") and not p6_pairs.is_empty_answer("no response came from the band that night, so they played on")
    assert p6_pairs.ending('He said "this is it.')[2]
    q = "can you find a tender song for the train"
    assert p6_pairs.is_copy(q, "You said: can-you-find a ＴＥＮＤＥＲ song, for the train!") and p6_pairs.is_copy(q, q + " " + q)
    assert not p6_pairs.is_copy(q, "can you find a tender song for the train is a fine wish, so try Paper Moon by Dal Fenor tonight")


def test_languages():
    assert p6_pairs.language("¿Tienes algo más tranquilo para leer por la noche?") == "es"
    assert p6_pairs.language("Prueba Where the Valley Sleeps de Dal Fenor, que mantiene un pulso suave") == "es"
    assert p6_pairs.language("Dal Fenorの「Cold Kingdom」をおすすめします。") == "ja"
    assert p6_pairs.language("") is None and p6_pairs.language("Paper Moon") is None


def test_sessions_to_drop(spark):
    full = lambda s, n: [x for t in range(1, n + 1) for x in ((s, t, "user", f"q{t}"), (s, t, "assistant", f"a{t}"))]
    rows = full("ok", 2) + [("ok", 1, "User", "q1"), ("ok", 2, "music", "t")]
    rows += [("empty", 1, "user", " \n"), ("empty", 1, "assistant", None), ("empty", 1, "music", "t")]
    rows += full("gap", 1) + [("gap", 3, "user", "x"), ("gap", 3, "assistant", "y")]
    rows += full("differs", 1) + [("differs", 1, "user", "other")]
    rows += full("nameless", 1) + [("nameless", 1, None, "z")]
    rows += full("unasked", 1) + [("unasked", 2, "assistant", "y")]
    rows += full("null turn", 1) + [("null turn", None, "user", "y")]
    rows += full("silent", 1) + [("silent", 2, "user", "x")]
    rows += [("blank reply", 1, "user", "x"), ("blank reply", 1, "assistant", None)]
    got = {r["session_id"]: r["reason"] for r in p7_conversations.dropped_sessions(messages(spark, rows)).collect()}
    assert got == {"empty": "empty", "gap": "broken", "differs": "broken", "nameless": "broken", "unasked": "broken", "null turn": "broken", "silent": "missing_reply"}
    kept = {r["session_id"]: [(t["turn_number"], t["role"], t["content"]) for t in r["turns"]] for r in p7_conversations.conversations(messages(spark, rows)).collect()}
    assert kept["ok"] == [(1, "user", "q1"), (1, "assistant", "a1"), (2, "user", "q2"), (2, "music", "t"), (2, "assistant", "a2")]
    assert set(kept) == {"ok", "blank reply"}
    log = full("log", 1) + [("log", 1, "assistant", "better"), ("log", 1, "assistant", "a1"), ("log", 1, "music", "t"), ("log", 1, "music", "u"), ("log", 1, "music", "t")]
    log += [("gone", 1, "user", "q1")] + full("gone", 2) + [("gone", 2, "assistant", None), (None, 1, "user", "q"), (None, 1, "bot", "a")]
    kept = {r["session_id"]: [(t["turn_number"], t["role"], t["content"]) for t in r["turns"]] for r in p7_conversations.conversations(messages(spark, log)).collect()}
    assert kept == {"log": [(1, "user", "q1"), (1, "music", "t"), (1, "music", "u"), (1, "assistant", "better")], "gone": [(1, "user", "q1"), (1, "assistant", "a1"), (2, "user", "q2")], None: [(1, "user", "q"), (1, "assistant", "a")]}
    folded = {(r["speaker"], r["n_versions"], r["retries"]) for r in p7_conversations.fold(messages(spark, log)).where("session_id = 'log'").collect()}
    assert folded == {("user", 1, 0), ("assistant", 2, 1), ("music", 1, 1), ("music", 1, 0)}
    parts = p7_conversations.conversations(messages(spark, full("long", 7)), part_turns=3).orderBy("part").collect()
    assert [len(r["turns"]) for r in parts] == [6, 6, 2]
    assert p7_conversations.dropped_sessions(messages(spark, rows).limit(0)).count() == 0


def _reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


REFERENCE = _reference()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the  \n\t'sé日本12.-😀"), max_size=600), st.integers(3, 90))
def test_joined_segments_equal_the_whole(text, size):
    e = tokenizer.piece_encoder(f"{tokenizer.vocabulary_dir()}/byte_bpe_50k.tiktoken")
    cuts = tokenizer.cut_points(text, size)
    parts = [e.encode(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert e.join_segments(text, cuts, parts) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_long_unsplit_pieces_are_exact():
    e = tokenizer.PieceEncoder(f"{tokenizer.vocabulary_dir()}/byte_bpe_50k.tiktoken", leaf=16)
    rng = random.Random(0)
    for alphabet in ("ab", "theingr", "=", "日本"):
        text = "".join(rng.choice(alphabet) for _ in range(3000))
        assert e.encode(text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_tree_equals_encoding_in_one_go():
    rng = random.Random(9)
    e = tokenizer.PieceEncoder(f"{tokenizer.vocabulary_dir()}/byte_bpe_50k.tiktoken", leaf=16)
    parts = ["word", " ", "\n\n", "日本語テキスト", "x" * 90, "don't", "12345", "  ", "é́", "\u200b", "👩‍👩‍👧", "ไทย", "\u3000", "!?..", "'s", "ааааббб" * 12]
    for n in range(150):
        text = "".join(rng.choice(parts[:: rng.choice([1, 1, 3])]) for _ in range(rng.randrange(1, 60)))
        assert e.encode_long(text, rng.choice([3, 8, 24, 64])) == e.encoding.encode_ordinary(text), (n, text)
    for text in ("y" * 5000, "ab" * 3000, "日本" * 2000, "な。" * 900, " " * 700 + "x"):
        assert e.encode_long(text, 128) == e.encoding.encode_ordinary(text)


def test_token_ids(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["word", "日本語", "x" * 50, "12"]) for _ in range(800))
    texts = ["hello world", "", None, "<|endoftext|> is text", long, long, "y" * 5000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    df = df.union(df.where("doc_id = 4"))
    for size, spread in ((2048, 1 << 20), (100, 700), (500, 40)):
        rows = p8_tokens.token_ids(df, segment_chars=size, spread_chars=spread).collect()
        assert len(rows) == len(texts) + 1
        got = {r["doc_id"]: r["ids"] for r in rows}
        assert got == {i: REFERENCE.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert p8_tokens.token_ids(df.limit(0)).count() == 0


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 60))) for i in range(400)] + [(400, None), (401, ""), (402, "word " * 333), (0, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = p9_packing.fill_containers(df, capacity=100, block_items=64).collect()
    by: dict = {}
    for r in got:
        if r["container"]:
            by.setdefault(r["container"], []).append(r)
    assert all(sum(r["n_tokens"] for r in v) <= 100 and {r["fill"] for r in v} == {sum(r["n_tokens"] for r in v)} for v in by.values())
    total = sum(r["n_tokens"] for r in got)
    assert total == sum(len(REFERENCE.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert len(by) <= -(-total // 100) + 2
    split = [r for r in got if r["doc_id"] == 402]
    assert sorted(r["first_token"] for r in split) == [100 * i for i in range(len(split))]
    assert sum(r["piece"] > 0 for r in got if r["doc_id"] != 402) == 0
    assert {r["container"] for r in got if r["doc_id"] in (400, 401)} == {None}


def test_improve_empties_bins():
    sizes = [60, 60, 40, 39, 41]
    out = p9_packing.improve([[0, 3], [1], [2, 4]], sizes, 100)
    assert sorted(itertools.chain(*out)) == list(range(5))
    assert all(sum(sizes[i] for i in b) <= 100 for b in out)


def test_improve_sees_all_bins_and_items():
    # Two for one in bins of many items, and an exchange with the last of many bins.
    sizes = [1] * 60 + [38] + [31, 9] + [97] * 80
    out = p9_packing.improve([[*range(60), 60], [61, 62], *[[i] for i in range(63, 143)]], sizes, 100)
    assert sorted(itertools.chain(*out)) == list(range(143))
    assert len(out) == 82 and max(sum(sizes[i] for i in b) for b in out) == 100  # 38 out, 31 and 9 in
    rng = random.Random(3)
    sizes = [rng.randrange(1100, 1150) for _ in range(3000)]
    assert len(p9_packing.improve(p9_packing.best_fit(sizes, 2048), sizes, 2048)) == 3000


def test_levels_are_bounded(spark):
    df = spark.createDataFrame([(str(i), 60) for i in range(3000)], "item string, n_tokens int")
    got = p9_packing.pack_items(df, 100, 64).collect()
    assert len(got) == 3000 and len({r["container"] for r in got}) == 3000


CASES = [
    ("press_review", "Dr. Selda mixed it in Jan. 2010 at 33.3 rpm. It works! “We slept. We never stopped,” recalls Hami. Done.", ["rpm.", "It works!", "recalls Hami.", "Done."]),
    ("press_review", "The label (it was founded in 1989. It closed in 2011.) never paid.The rest is rumour", ["never paid.", "is rumour"]),
    ("press_review", "One line\nwraps here. Next\n\nNew block\n\n1. First song\n- Second song\n\nEnd.", ["wraps here.", "Next", "New block", "First song", "Second song", "End."]),
    ("lrclib", "[Chorus]\r\nLa la. La\n\n  last line  ", ["[Chorus]", "La la. La", "last line"]),
    ("press_review", "「車で眠った。止まらなかった。」と歌手は語る。評価は9.37点です。", ["語る。", "点です。"]),
    ("press_review", "यह गीत 1.81 मिनट का है। क्या यह सच है?", ["है।", "है?"]),
    ("press_review", "It grew on me 🔥 Prof. Kapri agrees! 😅", ["🔥", "agrees! 😅"]),
    ("press_review", "ฟังแล้วคิดถึงบ้านค่ะ เพลงนี้ยาว 8.54 นาทีครับ", ["บ้านค่ะ", "นาทีครับ"]),
    ("press_review", "  \n ", []),
]


def test_sentence_cases():
    splitter = p10_sentences.Splitter()
    for source, text, ends in CASES:
        found = splitter.ends_of(text, source)
        assert len(found) == len(ends), (text, [text[:e] for e in found])
        assert all(text[:e].endswith(end) for e, end in zip(found, ends, strict=True))


def test_sentences_of_a_corpus(spark):
    rows = [(i, t, s) for i, (s, t, _) in enumerate(CASES)] + [(100, None, "genius"), (101, "", None), (102, "One. Two. " * 4000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got: dict = {}
    for r in p10_sentences.sentences(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, (_, text, ends) in enumerate(CASES):
        assert len(got.get(i, [])) == len(ends)
        assert all(text[: r["end_char"]].endswith(r["sentence"]) for r in got.get(i, []))
    assert len(got[102]) == 8000 and 100 not in got and 101 not in got
    assert p10_sentences.sentences(df.limit(0)).count() == 0


def test_documents_tell_their_own_abbreviations_and_names():
    splitter = p10_sentences.Splitter(small=frozenset(["mango", "slept"]))
    cases = [
        ("Cut by the orch. of Lund. The orch. Lanbri led was small. They left.", ["Lund.", "was small.", "They left."]),
        ("The band slept. and woke. We slept. Kapri slept on.", ["woke.", "We slept.", "slept on."]),
        ("We met Mango there. Songs, demos etc. Mango kept them.", ["there.", "kept them."]),
        ("Songs, demos etc. Mango kept them.", ["etc.", "kept them."]),
    ]
    for text, ends in cases:
        found = splitter.ends_of(text, "press_review")
        assert len(found) == len(ends), (text, [text[:e] for e in found])
        assert all(text[:e].endswith(end) for e, end in zip(found, ends, strict=True))


def test_rare_corpus_entries_count_at_any_size(spark, monkeypatch):
    texts = ["Played by the orch. of Lund in May."] * 6 + ["they never came back to us"] * 6 + ["so it goes again tonight"] * 6
    texts += ["The orch. Lanbri led it.", "Then they never came back to us so it goes on.", "One more. so it goes on."] + [f"Filler {i} is here." for i in range(60)]
    df = spark.createDataFrame([(i, t, "press_review") for i, t in enumerate(texts)] + [(500, None, None), (501, "La la", "genius")], "doc_id bigint, text string, source string")
    ends = lambda: sorted(tuple(r) for r in p10_sentences.sentences(df, texts=False).collect())
    want = ends()
    assert (18, len("The orch.")) not in want and len([e for e in want if e[0] == 20]) == 2 and len([e for e in want if e[0] == 19]) == 2
    monkeypatch.setattr(p10_sentences, "RARITY", 1)
    assert ends() == want

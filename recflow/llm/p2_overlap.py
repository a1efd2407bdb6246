"""Records of evaluation splits that also occur in the training split.

Two rows overlap if their queries are the same or nearly the same, or if both have the same
session (case and hyphens aside) and turn.  Nearly the same: the word edit distance is at most
``MOST_EDITS`` of the words of the longer query; queries of fewer than ``LEAST_WORDS`` words
never count by their text.

Method: an exact prefix-filter join.  Queries are reduced to distinct normalised texts first, so
any number of copies costs one text.  A text's shingles (``SHINGLE`` words) are ordered from the
rarest; d edits destroy at most SHINGLE * d of them, so the first shingle that an edit script keeps is
among the first SHINGLE * d + 1 of both texts, at most d places apart.  (Of equal shingles the earlier
comes first; a script keeps their order, so this holds for repeated shingles too.)  The prefixes of
evaluation texts are the index and those of training texts probe it, with filters on length (at most
d words apart) and position (at most d places apart); what is left is verified by a banded edit distance.

Joins are merge joins of ids and hashes; hot shingles, queries and (session, turn) keys are dealt over
tasks, and texts are fetched once per pair of texts that is left.  The report counts pairs from the sizes
of classes of equal texts and turns and never builds them.

Nothing is capped: a frequent shingle can be in a prefix only if the text has no rarer ones.

Edge cases: null and blank queries never match by text; null sessions or turns never match by
session; rows that match both ways come out once; an empty side gives no rows.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import dealt_join, materialize, session_key

#: Words of a shingle, share of words that may differ, and words that a query must have.
SHINGLE, MOST_EDITS, LEAST_WORDS = 2, 0.1, 6

_WORD = re.compile(r"[^\W_]+")
#: ASCII characters, and letters of Hangul, that show nothing.
_HIDDEN, _FILLERS = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]"), ("\u115f", "\u1160")


def plain(text: str | None) -> str:
    """Words of a text, with case, accents, punctuation, spacing and invisible characters set aside.  A vowel sign that takes up
    space (as in Devanagari) is part of its word, an underscore is punctuation."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(_WORD.findall(_HIDDEN.sub("", text).casefold()))
    kept = []
    for c in unicodedata.normalize("NFKD", text):
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf") or kind == "Cc" and not c.isspace() or c in _FILLERS:
            continue
        kept.append(c if c.isalnum() or kind == "Mc" else " ")
    return " ".join("".join(kept).casefold().split())


def edits_within(a: list[str], b: list[str], most: int) -> bool:
    """Whether at most ``most`` words must be changed, dropped or added between a and b."""
    lo, end_a, end_b = 0, len(a), len(b)
    while lo < end_a and lo < end_b and a[lo] == b[lo]:
        lo += 1
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[lo:end_a], b[lo:end_b]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    if not n or not m:
        return max(n, m) <= most
    over = most + 1
    row = [j if j <= most else over for j in range(m + 1)]
    for i in range(1, n + 1):
        first, last = max(1, i - most), min(m, i + most)
        new = [over] * (m + 1)
        if i <= most:
            new[0] = i
        for j in range(first, last + 1):
            new[j] = min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
        if min(row) > most:
            return False
    return row[m] <= most


def _plain(texts: pd.Series) -> pd.Series:
    return texts.map(plain)


def _grams(texts: pd.Series) -> pd.Series:
    """Hashes of the shingles of each text, in order."""
    out = []
    for text in texts:
        words = text.split(" ")
        grams = (" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1))
        out.append(np.array([xxhash.xxh64_intdigest(g) - (1 << 63) for g in grams], dtype=np.int64))
    return pd.Series(out)


def _near(a: pd.Series, b: pd.Series) -> pd.Series:

    out = []
    for x, y in zip(a, b, strict=True):
        x, y = x.split(" "), y.split(" ")
        out.append(edits_within(x, y, max(len(x), len(y)) // 10))
    return pd.Series(out, dtype=bool)


def _prefixes(texts: DataFrame) -> DataFrame:
    """``cls, in_train, in_eval, n, gram, at``: the rarest shingles of each text, with their places."""
    longest = F.floor(F.col("n") / (1 - MOST_EDITS) + 1e-9)
    most = F.floor(longest * MOST_EDITS + 1e-9).cast("int")
    grams = texts.where(most > 0).select("cls", pandas_udf(_grams, "array<bigint>")("words").alias("g"))
    flat = grams.select("cls", F.posexplode("g").alias("at", "gram"))
    often = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ordered = flat.join(often, "gram").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))).alias("g"))
    return (
        ordered.join(texts.select("cls", "in_train", "in_eval", "n"), "cls")
        .select("cls", "in_train", "in_eval", "n", F.explode(F.slice("g", F.lit(1), SHINGLE * most + 1)).alias("g"))
        .select("cls", "in_train", "in_eval", "n", "g.gram", "g.at")
    )


def near_texts(texts: DataFrame) -> DataFrame:
    """``cls_eval, cls_train`` of different texts within the edit bound.  ``texts``: cls, words, n,
    in_train, in_eval, distinct by cls, all of at least LEAST_WORDS words."""
    prefixes = materialize(_prefixes(texts), "overlap-prefixes")
    e = prefixes.where("in_eval").select(F.col("cls").alias("cls_eval"), F.col("n").alias("n_e"), "gram", F.col("at").alias("at_e"))
    t = prefixes.where("in_train").select(F.col("cls").alias("cls_train"), F.col("n").alias("n_t"), "gram", F.col("at").alias("at_t"))
    most = F.floor(F.greatest("n_e", "n_t") * MOST_EDITS + 1e-9)
    found = (
        dealt_join(e, t, ["gram"])
        .where((F.abs(F.col("n_e") - F.col("n_t")) <= most) & (F.abs(F.col("at_e") - F.col("at_t")) <= most) & (F.col("cls_eval") != F.col("cls_train")))
        .select("cls_eval", "cls_train")
        .distinct()
    )
    words = texts.select("cls", "words")
    both = found.join(words.withColumnsRenamed({"cls": "cls_eval", "words": "a"}), "cls_eval").join(words.withColumnsRenamed({"cls": "cls_train", "words": "b"}), "cls_train")
    return both.where(pandas_udf(_near, "boolean")("a", "b")).select("cls_eval", "cls_train")


def classes(pairs: DataFrame, train: str) -> tuple[DataFrame, DataFrame]:
    """(rows: pair_id, is_train, session, turn_number, cls, n, split, source; ``cls_eval, cls_train``: classes of
    equal texts that overlap).  Rows of short or blank queries have a class that overlaps with none."""
    rows = pairs.select(
        "pair_id", "split", "source", (F.coalesce(F.col("split"), F.lit("")) == train).alias("is_train"),
        session_key(F.col("session_id")).alias("session"), "turn_number", pandas_udf(_plain, "string")("query").alias("words"),
    )
    rows = rows.withColumn("n", F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", " ")))).withColumn("cls", F.unhex(F.md5("words")))
    rows = materialize(rows, "overlap-rows")
    long = rows.where(F.col("n") >= LEAST_WORDS)
    texts = materialize(
        long.groupBy("cls").agg(F.first("words").alias("words"), F.first("n").alias("n"), F.max("is_train").alias("in_train"), F.max(~F.col("is_train")).alias("in_eval")),
        "overlap-texts",
    )
    same = texts.where("in_train and in_eval").select(F.col("cls").alias("cls_eval"), F.col("cls").alias("cls_train"))
    return rows.drop("words"), materialize(same.unionByName(near_texts(texts)), "overlap-classes")


def overlap_pairs(pairs: DataFrame, train: str = "train") -> DataFrame:
    """``pair_id_a, pair_id_b`` (smaller first) of overlapping rows."""
    rows, near = classes(pairs, train)
    key = ["session", "turn_number"]
    e = rows.where(~F.col("is_train")).select(F.col("pair_id").alias("eval_id"), F.col("cls").alias("cls_eval"), *key)
    t = rows.where("is_train").select(F.col("pair_id").alias("train_id"), F.col("cls").alias("cls_train"), *key)
    # Training rows of each evaluation class first: both joins are on classes, whose rows are dealt.
    linked = materialize(dealt_join(near, t.select("train_id", "cls_train"), ["cls_train"]).select("cls_eval", "train_id"), "overlap-linked")
    by_text = dealt_join(linked, e.select("eval_id", "cls_eval"), ["cls_eval"]).select("eval_id", "train_id")
    by_turn = dealt_join(e.select("eval_id", *key), t.select("train_id", *key), key).select("eval_id", "train_id")
    both = by_text.unionByName(by_turn)
    return both.select(F.least("eval_id", "train_id").alias("pair_id_a"), F.greatest("eval_id", "train_id").alias("pair_id_b")).distinct()


def overlap_report(pairs: DataFrame, train: str = "train") -> DataFrame:
    """``split, source, n_rows, n_overlapping, n_pairs``: per evaluation split and source.

    Counted from classes: the pairs of a row are the training rows of overlapping texts and those of its
    turn, less those that are both.  ``pair_id`` is taken to be unique.
    """
    rows, near = classes(pairs, train)
    key = ["session", "turn_number"]
    count = F.count(F.lit(1))
    groups = rows.where(~F.col("is_train")).groupBy("split", "source", F.col("cls").alias("cls_eval"), *key).agg(count.alias("n"))
    t = rows.where("is_train").groupBy(F.col("cls").alias("cls_train"), *key).agg(count.alias("m"))
    t = materialize(t, "overlap-training")
    sizes = t.groupBy("cls_train").agg(F.sum("m").alias("m"))
    by_text = near.join(sizes, "cls_train").groupBy("cls_eval").agg(F.sum("m").alias("by_text"))
    by_turn = t.groupBy(*key).agg(F.sum("m").alias("by_turn"))
    turns = groups.select("cls_eval", *key).where(F.col("session").isNotNull() & F.col("turn_number").isNotNull()).distinct()
    twice = turns.join(near, "cls_eval").join(t, ["cls_train", *key]).groupBy("cls_eval", *key).agg(F.sum("m").alias("twice"))
    found = groups.join(by_text, "cls_eval", "left").join(by_turn, key, "left").join(twice, ["cls_eval", *key], "left")
    each = F.coalesce("by_text", F.lit(0)) + F.coalesce("by_turn", F.lit(0)) - F.coalesce("twice", F.lit(0))
    return (
        found.withColumn("each", each)
        .groupBy("split", "source")
        .agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("each") > 0, F.col("n")).otherwise(0)).alias("n_overlapping"), F.sum(F.col("n") * F.col("each")).alias("n_pairs"))
    )

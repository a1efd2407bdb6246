"""Text values that were cut off by a field limit or in transfer.

1. Per source and field, histograms of the length in characters and in bytes show spikes: a
   length held by many times more values than its neighbourhood.  A spike marks a field limit.
2. A value that ends at a field limit without terminal punctuation is cut; so is one that ends
   with a sign that something is missing.  A spike is a limit where at least half of its values are
   different texts (one text many times is a placeholder).  A limit in characters shows in the
   histogram of bytes too, by its ASCII values, and the other way round: of two spikes at one length
   the one with fewer values decides nothing.
3. Most cuts leave no spike (transfers break anywhere), so each value's last unit (line of lyrics,
   sentence of a caption) is also held against how units end in the whole corpus: its last
   word, how often that word ends a unit or goes on, whether it is only the beginning of a known
   word; and its frame (frequent words kept, others as a slot), how often it is a whole unit and how
   often only the beginning of one.  All counts are over all values.

Counts are combined per batch before they are shuffled; lookups are joins by word and by frame.

Edge cases: null, blank and white-space values are no values; a repeated row is judged like any
other; a value without words is complete unless it has a sign; dots and a closed label count as an
end at a limit; a null source is a group of its own;
in a corpus too small to count (fewer than ``LEAST_SEEN`` sightings) only signs, open brackets and
beginnings of known words count.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_blank, materialize

FIELDS = ("lyrics", "caption")
#: Signs that something is missing, at the end of a value (fixed values).
SIGN = re.compile(r"(?:\[\s*truncated\s*\]|<\s*more\s*>|\(\s*read more\s*\)|&hellip;|\[\s*(?:…|\.{2,})\s*\])\s*$", re.IGNORECASE)
#: Marks that may follow the last word of a complete text (fixed values).
TERMINAL = re.compile(r"[.!?。！？।؟]['\"”’»)\]]*\s*$")
DOTS = re.compile(r"(?:…|\.{2,})['\"”’»)\]]*\s*$")
LABEL = re.compile(r"[\])]\s*$")
WORD = re.compile(r"\w+(?:['’]\w+)*")
UNIT_END = {"lyrics": re.compile(r"[\r\n]+"), "caption": re.compile(r"(?<=[.!?…])\s+|[\r\n]+")}

#: Frequent words that frames keep; sightings from which a share says something; shares of
#: sightings as an ending below which an ending is none, without and with a spike.
FRAME_WORDS, LEAST_SEEN, WORD_SHARE, FRAME_SHARE, SPIKE_SHARE = 300, 12, 0.02, 0.05, 0.15
#: A word that is so many times more often the beginning of another is taken for a beginning.
BEGINNING_TIMES = 200
#: A spike: so many values of one length, and so many times the mean of the lengths around it.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_AROUND = 8, 6.0, 25


def values(crawl: DataFrame) -> DataFrame:
    """``crawl_id, field_name, source, value`` of each value that is not blank."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col("sources")[f].alias("source"), F.col(f).alias("value")) for f in FIELDS)))
    return crawl.select("crawl_id", each.alias("x")).select("crawl_id", "x.*").where(~is_blank(F.col("value")))


def _units(field: str, value: str) -> list[list[str]]:
    out = [WORD.findall(u.lower()) for u in UNIT_END[field].split(value)]
    return [u for u in out if u]


def _slots(words: list[str], frame: frozenset) -> list[str]:
    return [w if w in frame else "#" if w[0].isdigit() else "*" for w in words]


def prefix_hashes(words: list[str]) -> list[int]:
    """A hash of each beginning of a list of words, in one pass."""
    state, out = xxhash.xxh64(), []
    for w in words:
        state.update(w + " ")
        out.append(state.intdigest() - (1 << 63))
    return out


def _count_words(frames):
    for frame in frames:
        ends, goes, sure = Counter(), Counter(), Counter()
        for field, value in zip(frame["field_name"], frame["value"], strict=True):
            units = _units(field, value)
            for n, u in enumerate(units):
                goes.update(u[:-1])
                sure.update(u[:-1])
                ends[u[-1]] += 1
                if n < len(units) - 1 or (TERMINAL.search(value) and not DOTS.search(value)):
                    sure[u[-1]] += 1
        words = list(ends.keys() | goes.keys())
        if words:
            yield pd.DataFrame({"word": words, "ends": [ends[w] for w in words], "goes": [goes[w] for w in words], "sure": [sure[w] for w in words]})


def _count_frames(frames, shared):
    for frame in frames:
        ends, goes = Counter(), Counter()
        units = Counter()
        for field, value in zip(frame["field_name"], frame["value"], strict=True):
            units.update(" ".join(_slots(u, shared.value)) for u in _units(field, value))
        for unit, n in units.items():
            *begins, whole = prefix_hashes(unit.split(" "))
            ends[whole] += n
            for key in begins:
                goes[key] += n
        keys = list(ends.keys() | goes.keys())
        if keys:
            yield pd.DataFrame({"frame": keys, "ends": [ends[k] for k in keys], "goes": [goes[k] for k in keys]})


def _look_at_ends(frames, shared):
    for frame in frames:
        rows = []
        for crawl_id, field, source, value, text in frame[["crawl_id", "field_name", "source", "value", "text"]].itertuples(index=False):
            sign = bool(SIGN.search(value))
            units = _units(field, value)
            last = units[-1] if units else []
            dots = bool(DOTS.search(value))
            open_label = value.rfind("[") > value.rfind("]") or value.rfind("(") > value.rfind(")")
            ended = not dots and bool(TERMINAL.search(value))
            label = bool(LABEL.search(value)) and not open_label
            slots = _slots(last, shared.value)
            telling = any(w not in ("*", "#") for w in slots)  # a frame of slots only says nothing
            rows.append((crawl_id, field, source, text, len(value), len(value.encode("utf-8", "replace")), last[-1] if last else None, prefix_hashes(slots)[-1] if slots else 0, slots[-1:] == ["*"], telling, sign, open_label, ended, label, dots))
        if rows:
            yield pd.DataFrame(rows, columns=["crawl_id", "field_name", "source", "text", "n_chars", "n_bytes", "word", "frame", "slot_last", "telling", "sign", "open_label", "ended", "label", "dots"])


_LOOKS = "field_name string, source string, text bigint, n_chars int, n_bytes int, word string, frame bigint, slot_last boolean, telling boolean, sign boolean, open_label boolean, ended boolean, label boolean, dots boolean"


def length_spikes(looks: DataFrame) -> DataFrame:
    """``field_name, source, measure, length, n, times``: lengths that hold far more values than those around."""
    each = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("n_bytes").alias("length"))))
    counts = looks.select("field_name", "source", each.alias("x")).groupBy("field_name", "source", "x.measure", "x.length").agg(F.count(F.lit(1)).alias("n"))
    near = F.explode(F.sequence(F.col("length") - SPIKE_AROUND, F.col("length") + SPIKE_AROUND))
    around = counts.select("field_name", "source", "measure", near.alias("at"), F.col("length").alias("from"), F.col("n").alias("m")).where(F.col("at") != F.col("from"))
    around = around.groupBy("field_name", "source", "measure", F.col("at").alias("length")).agg((F.sum("m") / (2 * SPIKE_AROUND)).alias("mean"))
    key = [F.col("a.source").eqNullSafe(F.col("b.source")), *(F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("field_name", "measure", "length"))]
    joined = counts.alias("a").join(around.alias("b"), key, "left").select("a.*", F.coalesce("b.mean", F.lit(0.0)).alias("mean"))
    times = F.col("n") / F.greatest("mean", F.lit(0.25))
    return joined.withColumn("times", F.round(times, 2)).where((F.col("n") >= SPIKE_LEAST) & (times >= SPIKE_TIMES)).select("field_name", "source", "measure", "length", "n", "times")


def field_limits(looks: DataFrame, spikes: DataFrame) -> DataFrame:
    """``field_name, source, measure, length``: the spikes that are limits and no placeholders."""
    each = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("n_bytes").alias("length"))))
    at = looks.select("field_name", "source", "text", each.alias("x")).select("field_name", "source", "text", "x.*")
    key = [F.col("v.source").eqNullSafe(F.col("s.source")), *(F.col(f"v.{c}") == F.col(f"s.{c}") for c in ("field_name", "measure", "length"))]
    texts = at.alias("v").join(spikes.alias("s"), key).groupBy("s.field_name", "s.source", "s.measure", "s.length", "s.n").agg(F.countDistinct("v.text").alias("texts"))
    most = F.max("n").over(Window.partitionBy("field_name", "source", "length"))
    return texts.withColumn("most", most).where((F.col("texts") * 2 >= F.col("n")) & (F.col("n") == F.col("most"))).select("field_name", "source", "measure", "length")


def _by_measure(spikes: DataFrame, name: str) -> DataFrame:
    sets = (F.collect_set(F.when(F.col("measure") == m, F.col("length"))).alias(f"{m}_{name}") for m in ("chars", "bytes"))
    return spikes.groupBy("field_name", "source").agg(*sets)


def judge(crawl: DataFrame) -> DataFrame:
    """``crawl_id, field_name, source, n_chars, n_bytes, at_spike, at_limit, truncated, reason`` of each value."""
    spark = crawl.sparkSession
    rows = values(crawl)
    kind = dict(crawl.dtypes)["crawl_id"]
    words = rows.select("field_name", "value").mapInPandas(_count_words, "word string, ends bigint, goes bigint, sure bigint")
    words = materialize(words.groupBy("word").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"), F.sum("sure").alias("sure")), "ends-words")
    frequent = [r["word"] for r in words.orderBy(F.desc(F.col("ends") + F.col("goes")), "word").limit(FRAME_WORDS).collect()]
    shared = spark.sparkContext.broadcast(frozenset(frequent))
    frames = rows.select("field_name", "value").mapInPandas(lambda it: _count_frames(it, shared), "frame bigint, ends bigint, goes bigint")
    frames = frames.groupBy("frame").agg(F.sum("ends").alias("frame_ends"), F.sum("goes").alias("frame_goes"))
    looks = materialize(rows.withColumn("text", F.xxhash64("value")).mapInPandas(lambda it: _look_at_ends(it, shared), f"crawl_id {kind}, {_LOOKS}"), "ends-looks")
    spikes = materialize(length_spikes(looks), "ends-spikes")
    at, limits = _by_measure(spikes, "spikes"), _by_measure(field_limits(looks, spikes), "limits")
    # Beginnings of known words: how often the beginning is a word itself, and how often it goes on.
    sure = words.where(F.col("sure") > 0)
    begins = (
        sure.select(F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k"), "word", "sure")
        .groupBy(F.expr("substring(word, 1, k)").alias("word"))
        .agg(F.sum(F.when(F.col("k") == F.length("word"), F.col("sure")).otherwise(0)).alias("known"), F.sum(F.when(F.col("k") < F.length("word"), F.col("sure")).otherwise(0)).alias("longer"))
    )
    same = lambda of: [F.col("l.source").eqNullSafe(F.col(f"{of}.source")), F.col("l.field_name") == F.col(f"{of}.field_name")]
    held = lambda name: F.coalesce(F.array_contains(f"chars_{name}", F.col("n_chars")), F.lit(False)) | F.coalesce(F.array_contains(f"bytes_{name}", F.col("n_bytes")), F.lit(False))
    j = (
        looks.join(words.select("word", "ends", "goes"), "word", "left")
        .join(begins, "word", "left")
        .join(frames, "frame", "left")
        .alias("l")
        .join(at.alias("s"), same("s"), "left")
        .join(limits.alias("m"), same("m"), "left")
        .select("l.*", held("spikes").alias("at_spike"), held("limits").alias("at_limit"))
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    part_of_word = (n("known") * BEGINNING_TIMES < n("longer")) & (n("longer") > 0)
    often_whole = ~F.col("slot_last") & (n("frame_ends") >= 5) & (n("frame_ends") >= n("frame_goes"))
    rarely_ends = ~often_whole & (n("goes") >= LEAST_SEEN) & (n("ends") < WORD_SHARE * (n("ends") + n("goes")))
    share = F.when(F.col("at_spike"), SPIKE_SHARE).otherwise(FRAME_SHARE)
    goes_on = F.col("telling") & (n("frame_goes") >= LEAST_SEEN) & (n("frame_ends") < share * (n("frame_ends") + n("frame_goes")))
    reason = (
        F.when(F.col("sign"), "sign")
        .when(F.col("open_label"), "open bracket")
        .when(F.col("ended") | F.col("label") | F.col("word").isNull(), None)
        .when(part_of_word, "part of a word")
        .when(rarely_ends, "word that goes on")
        .when(goes_on, "unit that goes on")
        .when(F.col("at_limit") & ~F.col("dots"), "field limit")
    )
    return j.select("crawl_id", "field_name", "source", "n_chars", "n_bytes", "at_spike", "at_limit", reason.isNotNull().alias("truncated"), reason.alias("reason"), "word", "frame", "ends", "goes", "known", "longer", "frame_ends", "frame_goes")


def truncated_values(crawl: DataFrame) -> DataFrame:
    """``crawl_id, field_name`` of each truncated value."""
    return judge(crawl).where("truncated").select("crawl_id", "field_name").distinct()


def truncation_rates(crawl: DataFrame) -> DataFrame:
    """``field_name, source, n_values, n_truncated, n_at_spike, share``."""
    return (
        judge(crawl)
        .groupBy("field_name", "source")
        .agg(F.count(F.lit(1)).alias("n_values"), F.sum(F.col("truncated").cast("int")).alias("n_truncated"), F.sum((F.col("truncated") & F.col("at_spike")).cast("int")).alias("n_at_spike"))
        .withColumn("share", F.round(F.col("n_truncated") / F.col("n_values"), 4))
    )


def spikes_of(crawl: DataFrame) -> DataFrame:
    """Length spikes per field, source and measure (see ``length_spikes``)."""
    rows = values(crawl).select("field_name", "source", F.length("value").alias("n_chars"), F.octet_length("value").alias("n_bytes"))
    return length_spikes(rows)

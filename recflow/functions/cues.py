"""Cues mined from requests, replies and judge output, and keys of texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Words for decades (fixed values).
DECADE_WORDS = {
    "thirties": "1930s", "forties": "1940s", "fifties": "1950s", "sixties": "1960s", "seventies": "1970s", "eighties": "1980s",
    "nineties": "1990s", "aughts": "2000s", "noughties": "2000s", "tens": "2010s", "twenties": "2020s",
}
#: Numbers that name a year or decade (fixed value).
ERA_NUMBER = r"\b(?:(?:19|20)\d{2}s?|'?\d{2}s)\b"
#: Phrases that tell how popular, and how recent, a wish is; the first that holds counts (fixed values).
POPULARITY_CUES = {
    "top-tier": r"\b(?:top|biggest|#1|number\s+one|chart[- ]?topping|smash\s+hit|mega[- ]?hit|huge\s+hit|massive\s+hit)\b",
    "popular": r"\b(?:popular|mainstream|famous|well[- ]?known)\b",
    "obscure": r"\b(?:obscure|hidden\s+gem|underrated|underground|lesser[- ]?known|under\s+the\s+radar|deep\s+cut|niche)\b",
}
TIME_CUES = {
    "present": r"\b(?:right\s+now|nowadays|these\s+days|this\s+(?:week|month|year)|recent(?:ly)?|latest|brand[- ]?new|trending|currently)\b",
    "classic": r"\b(?:classic|oldies|vintage|retro|throwback|nostalgic|nostalgia|old[- ]?school|yesteryear)\b",
}
#: Words for the categories of a goal (fixed values).
CATEGORY_WORDS = {
    "A": "sonic characteristics", "B": "lyrical themes", "C": "album artwork", "D": "activity fit", "E": "guided discovery", "F": "vague memory",
    "G": "mood and emotion", "H": "artist exploration", "I": "exact popular hit", "J": "popular trends", "K": "era sound",
}
#: Phrases for how specific a goal is, around the words of its category (fixed values).
GOAL_PHRASES = {
    "HH": ("wants a specific ", " track"), "HL": ("wants tracks matching a specific ", " angle"),
    "LH": ("trying to recall a particular track from a vague ", " sense"), "LL": ("exploring various ", " tracks"),
}
OTHER_GOAL = ("interested in ", " tracks")
PROFILE_FIELDS = ("age_group", "country_code", "gender", "preferred_language", "preferred_musical_culture")


def era(token: Column) -> Column:
    """``80s``, ``'80s``, ``1984`` and ``1980s`` as ``1980s``: two digits from 30 on belong to the last century."""
    digits = F.regexp_extract(token, r"(\d+)", 1)
    n = digits.try_cast("int")
    full = F.when(F.length(digits) == 2, F.when(n >= 30, n + 1900).otherwise(n + 2000)).when(F.length(digits) == 4, n)
    return F.concat((F.floor(full / 10) * 10).cast("string"), F.lit("s"))


def eras(text: Column) -> Column:
    """Distinct decades named in a text: numbers first, then words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    numbers = F.transform(F.regexp_extract_all(low, F.lit(f"({ERA_NUMBER})"), F.lit(1)), era)
    pairs = F.create_map(*(F.lit(x) for kv in DECADE_WORDS.items() for x in kv))
    named = F.transform(F.regexp_extract_all(low, F.lit(r"\b(" + "|".join(DECADE_WORDS) + r")\b"), F.lit(1)), lambda w: F.element_at(pairs, w))
    return F.array_distinct(F.concat(numbers, named))


def first_cue(text: Column, cues: dict[str, str]) -> Column:
    """The name of the first pattern that a text matches, in any case; null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(low.rlike(pattern), F.lit(name)) for name, pattern in cues.items()))


def category_words(category: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in CATEGORY_WORDS.items() for x in kv)), F.upper(F.trim(category)))


def goal_phrase(category: Column, specificity: Column) -> Column:
    """A goal in words; null without a known category."""
    name, how = category_words(category), F.upper(F.trim(F.coalesce(specificity, F.lit(""))))
    out = None
    for key, (before, after) in GOAL_PHRASES.items():
        phrase = F.concat(F.lit(before), name, F.lit(after))
        out = F.when(how == key, phrase) if out is None else out.when(how == key, phrase)
    return out.otherwise(F.concat(F.lit(OTHER_GOAL[0]), name, F.lit(OTHER_GOAL[1])))


def quoted_titles(text: Column) -> Column:
    """Distinct titles in straight double quotation marks, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('"([^"]+)"'), F.lit(1)))


def title_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def profile_key(profile: Column) -> Column:
    """Five fields of a user profile joined by bars; missing ones are ``unknown``."""
    return F.concat_ws("|", *(F.coalesce(F.nullif(F.trim(profile[f]), F.lit("")), F.lit("unknown")) for f in PROFILE_FIELDS))


def profile_prompt(profile: Column) -> Column:
    f = {k: F.coalesce(F.nullif(F.trim(profile[k]), F.lit("")), F.lit("unknown")) for k in PROFILE_FIELDS}
    return F.concat_ws(", ", *(F.concat(F.lit(f"{k}: "), v) for k, v in f.items()))


def json_object(text: Column, schema: str) -> Column:
    """The whole text as an object, else the widest part in braces; null if neither parses."""
    parse = lambda c: F.from_json(c, schema, {"mode": "PERMISSIVE"})
    inner = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(F.trim(text).startswith("{") & F.trim(text).endswith("}"), parse(F.trim(text))).when(inner != "", parse(inner))


def clamp_score(raw: Column) -> Column:
    """A whole score from 1 to 5; what is none counts as 1."""
    return F.coalesce(F.least(F.greatest(raw.try_cast("double").cast("int"), F.lit(1)), F.lit(5)), F.lit(1))


def judge_mean(personal: Column, explained: Column) -> Column:
    return ((personal - 1) / 4 + (explained - 1) / 4) / 2


def similarity_label(sim: Column) -> Column:
    return F.when(sim >= 0.65, "strong").when(sim >= 0.45, "moderate").otherwise("weak")


def token_estimate(text: Column) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) / 3.5).cast("int") + 1


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two texts that lies in matching blocks; not symmetric.  Equal pairs of a batch are compared once."""
    known: dict = {}
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = SequenceMatcher(None, pair[0] or "", pair[1] or "").ratio()
    return pd.Series([known[p] for p in zip(a, b, strict=True)], dtype="float64")


def compared_name(name: Column) -> Column:
    """A name for comparison: small, trimmed, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s+", " "))


#: What may follow a name that goes on with a note (fixed value).
NOTE_STARTS = " ([-/"


def name_similarity(found: Column, asked: Column) -> Column:
    """Of compared names: 1 where one is empty or is the other plus a note, else the sequence ratio; null is empty."""
    longer = F.when(F.length(found) > F.length(asked), found).otherwise(asked)
    shorter = F.when(F.length(found) > F.length(asked), asked).otherwise(found)
    # One blank, bracket, dash or slash after the shorter name is enough.
    note = (F.length(longer) > F.length(shorter)) & longer.startswith(shorter) & F.substring(longer, F.length(shorter) + 1, F.lit(1)).isin(*NOTE_STARTS)
    sure = (shorter == "") | (found == asked) | note
    return F.when(sure, F.lit(1.0)).otherwise(sequence_ratio(F.when(~sure, found), F.when(~sure, asked)))

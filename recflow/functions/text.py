"""Column expressions over names, tags, dates and popularity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: British spellings of tags and their American forms (fixed values).
SPELLINGS = {
    "favourites": "favorites",
    "favourite": "favorite",
    "favourite song": "favorite song",
    "favourite songs": "favorite songs",
    "favourites song": "favorites song",
    "favourites songs": "favorites songs",
    "colour": "color",
    "favourite bands": "favorite bands",
    "favourite band": "favorite band",
}
#: Tags that carry no information (fixed values).
NOISE = (
    r"^\d+ of \d+ stars?$",
    r"^\d+\s*stars?$",
    r"^[a-z]{2,5}-?fm$",
    r"^i (love|like|listen|always|just|absolutely)\b",
    r"^my (favo?u?rite|fav)\b",
    r"^favo?u?rite\s+song",
    r"^\d{1,2}\s*of\s*\d{1,2}$",
)
LONGEST_TAG = 30
#: Common words that carry no content (fixed values).
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its itself just like make me more most my myself "
    "no nor not now of off on once only or other our ours out over own really same she should so some such than that the their theirs them then there these "
    "they this those through to too track under until up us very was we were what when where which while who whom why will with would you your yours song"
).split()
#: Beginnings of tags that the text index leaves out (fixed values).
SEARCH_NOISE = ("via ", "ion b ", "3 of ", "4 of ", "5 of ")


def first_filled(names: Column) -> Column:
    """The first element that is not blank, else null."""
    return F.get(F.filter(names, lambda x: F.trim(x) != ""), F.lit(0))


def plain_tag(tag: Column) -> Column:
    """Lower case, single blanks, no punctuation at the end, American spelling."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(tag)), r"\s+", " "), r"[.,;:!?]+$", "")
    pairs = [F.lit(x) for kv in SPELLINGS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), t), t)


def is_noise(tag: Column) -> Column:
    out = (tag == "") | (F.length(tag) > LONGEST_TAG)
    for pattern in NOISE:
        out = out | tag.rlike(pattern)
    return out


def clean_tags(tags: Column) -> Column:
    """Distinct plain tags in order, without noise."""
    return F.filter(F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), plain_tag)), lambda t: ~is_noise(t))


def search_tags(tags: Column) -> Column:
    """Tags for the text index: lower case, two letters or more, no digits, distinct."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: (F.length(t) >= 2) & ~t.rlike(r"\d") & ~t.rlike("^(" + "|".join(SEARCH_NOISE) + ")")))


def kept_tags(tags: Column, freq: Column, least: int = 5, most: int | None = 20, dedup: bool = True, by_frequency: bool = False) -> Column:
    """Plain tags without noise that ``least`` tracks have at least, in order (or by falling frequency), ``most`` of them.

    ``freq`` is a map from plain tag to its number of tracks.  With ``dedup``, of two tags of which one contains the
    other the more frequent stays, of equally frequent ones the longer, of equally long ones the first: a tag is left
    out if a kept one beats it, else it takes the place of all kept ones it meets.
    """
    listed = F.transform(clean_tags(tags), lambda t: F.struct(t.alias("t"), F.coalesce(F.try_element_at(freq, t), F.lit(0)).cast("long").alias("n")))
    listed = F.filter(listed, lambda x: x["n"] >= least)
    if dedup:
        meets = lambda a, b: F.contains(a["t"], b["t"]) | F.contains(b["t"], a["t"])
        wins = lambda x, k: (x["n"] > k["n"]) | ((x["n"] == k["n"]) & (F.length(x["t"]) > F.length(k["t"])))
        step = lambda kept, x: F.when(F.exists(kept, lambda k: meets(x, k) & ~wins(x, k)), kept).otherwise(F.array_append(F.filter(kept, lambda k: ~meets(x, k)), x))
        listed = F.aggregate(listed, F.array().cast("array<struct<t:string,n:bigint>>"), step)
    if by_frequency:
        listed = F.transform(F.array_sort(F.transform(listed, lambda x: F.struct((-x["n"]).alias("m"), x["t"].alias("t"), x["n"].alias("n")))), lambda x: F.struct(x["t"].alias("t"), x["n"].alias("n")))
    out = F.transform(listed, lambda x: x["t"])
    return F.slice(out, 1, most) if most else out


def year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(date, F.lit("")), r"^(\d{4})", 1), F.lit(""))


def decade(date: Column) -> Column:
    """``1990s``"""
    return F.concat((F.floor(year(date).cast("int") / 10) * 10).cast("string"), F.lit("s"))


def decade_phrase(date: Column) -> Column:
    """``early 1990s`` up to the year ending in 3, ``mid`` up to 6, else ``late``."""
    digit = year(date).cast("int") % 10
    return F.concat(F.when(digit <= 3, "early ").when(digit <= 6, "mid ").otherwise("late "), decade(date))


def popularity_round(popularity: Column) -> Column:
    """Whole number, halves to the even one."""
    return F.bround(popularity).cast("int")


def popularity_bucket(popularity: Column) -> Column:
    """``p60-69``"""
    low = (F.floor(popularity_round(popularity) / 10) * 10).cast("int")
    return F.concat(F.lit("p"), low.cast("string"), F.lit("-"), (low + 9).cast("string"))


def popularity_phrase(popularity: Column) -> Column:
    """Words for a popularity of up to 20, 40, 60 and 80, and beyond."""
    p = popularity_round(popularity)
    return F.when(p <= 20, "obscure").when(p <= 40, "niche").when(p <= 60, "moderate popularity").when(p <= 80, "highly popular").when(p.isNotNull(), "mainstream hit")


def tempo_phrase(tempo: Column) -> Column:
    """Words for beats a minute below 70, 110 and 140, and beyond."""
    bpm = F.trim(tempo.cast("string")).try_cast("double")
    return F.when(bpm < 70, "slow").when(bpm < 110, "mid-tempo").when(bpm < 140, "upbeat").when(bpm.isNotNull(), "fast")


def track_text(name: Column, artist: Column, album: Column, date: Column, popularity: Column, tags: Column, most_tags: int = 5) -> Column:
    """``title: ..., artist: ..., album: ...[, year][, popularity][, tags]`` in lower case."""
    listed = F.slice(clean_tags(tags), 1, most_tags)
    parts = [
        F.concat(F.lit("title: "), F.coalesce(first_filled(name), F.lit("unknown"))),
        F.concat(F.lit("artist: "), F.coalesce(first_filled(artist), F.lit("unknown"))),
        F.concat(F.lit("album: "), F.coalesce(first_filled(album), F.lit("unknown"))),
        F.concat(F.lit("year: "), year(date)),
        F.concat(F.lit("popularity: "), popularity_round(popularity).cast("string")),
        F.when(F.size(listed) > 0, F.concat(F.lit("tags: "), F.array_join(listed, " "))),
    ]
    return F.lower(F.concat_ws(", ", *parts))


def words(text: Column) -> Column:
    """Words of two letters or digits and more, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9]+)"), F.lit(1))


def truncate_words(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last blank if that lies past the middle."""
    head = F.substring(text, 1, most)
    blank = most - F.instr(F.reverse(head), " ")
    return F.when(F.length(text) <= most, text).otherwise(F.when((F.instr(head, " ") > 0) & (blank > most / 2), F.substring(head, F.lit(1), blank)).otherwise(head))


def hash16(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)

"""Texts composed of track, goal and profile fields: prose for retrieval, queries within a budget, lines for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cues
from . import text as tx

#: What surrounds an alias (fixed value).
ALIAS_EDGES = ".,;:!?\"'`-"
#: Parts that are dropped, in this order, until a query fits its budget.
DROPS = ("aggregates", "recent_middle", "cues", "goal", "recent_first")
PROFILE = ("age", "age_group", "gender", "country_name", "preferred_language", "preferred_musical_culture")


def filled(text: Column) -> Column:
    """A trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def first_text(values: Column) -> Column:
    """The first element, trimmed, whatever it is; null for none or a blank one."""
    return filled(F.get(values, F.lit(0)))


def joined(values: Column, between: str = ", ", most: int | None = None) -> Column:
    """Elements that are not empty, trimmed and joined; null for none."""
    kept = F.transform(F.filter(values, lambda x: x.isNotNull() & (x != "")), lambda x: F.trim(x))
    return F.nullif(F.array_join(F.slice(kept, 1, most) if most else kept, between), F.lit(""))


def split_list(text: Column) -> Column:
    """``a, b,,c`` as its trimmed parts that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def era_genre(date: Column, genre: Column) -> Column:
    """``late 1980s synth-pop``; either side may be missing."""
    return F.nullif(F.concat_ws(" ", tx.decade_phrase(date), filled(genre)), F.lit(""))


def alias(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), F.lit(ALIAS_EDGES)), F.lit(""))


def alias_line(*names: Column) -> Column:
    """Distinct aliases of the names, joined by bars; null for none."""
    return F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(*(alias(n) for n in names)))), " | "), F.lit(""))


def in_brackets(head: Column, notes: Column) -> Column:
    """``head (notes)`` with either side missing; empty texts are missing."""
    return F.nullif(F.concat_ws(" ", F.nullif(head, F.lit("")), F.concat(F.lit("("), F.nullif(notes, F.lit("")), F.lit(")"))), F.lit(""))


def credit(title: Column, artist: Column) -> Column:
    """``"Title" by Artist``"""
    return F.concat_ws(" ", F.concat(F.lit('"'), title, F.lit('"')), F.concat(F.lit("by "), artist))


def bpm(tempo: Column) -> Column:
    n = F.trim(tempo.cast("string")).try_cast("double")
    return F.when(n.between(-1e9, 1e9), n)


def track_prose(t: dict[str, Column], tags: Column) -> Column:
    """A track as prose, a line for each of identity, release, aliases, tags, tempo and key, popularity.

    ``t``: track_name, artist_name, album_name, release_date, popularity, tag_list and, of the crawl, mb_tags, label, country, tempo, music_key.
    """
    c = F.concat
    title, artist, album, year = first_text(t["track_name"]), joined(t["artist_name"]), joined(t["album_name"]), tx.year(t["release_date"])
    curated = F.filter(F.transform(t["mb_tags"], lambda x: F.trim(x)), lambda x: x != "")
    genre = F.coalesce(F.get(curated, F.lit(0)), first_text(t["tag_list"]))
    head = in_brackets(credit(title, artist), F.concat_ws(", ", year, genre))
    label, where = filled(t["label"]), F.nullif(F.concat_ws(", ", filled(t["country"]), era_genre(t["release_date"], genre)), F.lit(""))
    noted = F.coalesce(c(F.lit(" ("), where, F.lit(")")), F.lit(""))
    from_album = c(F.lit("From "), album)
    release = (
        F.when(label.isNotNull(), F.concat_ws(", ", from_album, c(F.when(album.isNull(), "Released on ").otherwise("released on "), label, noted)))
        .when(album.isNotNull(), c(from_album, noted))
        .otherwise(c(F.lit("Released "), where))
    )
    pace = c(F.lit("Tempo: "), F.bround(bpm(t["tempo"])).cast("long").cast("string"), F.lit(" BPM ("), tx.tempo_phrase(bpm(t["tempo"]).cast("string")), F.lit(")"))
    tone = F.nullif(F.concat_ws(". ", pace, c(F.lit("Key: "), filled(t["music_key"]))), F.lit(""))
    return F.concat_ws(
        "\n",
        c(head, F.lit(".")),
        c(release, F.lit(".")),
        c(F.lit("Also known as: "), alias_line(title, artist, album), F.lit(".")),
        c(F.lit("Notable tags: "), F.nullif(F.array_join(tags, ", "), F.lit("")), F.lit(".")),
        c(tone, F.lit(".")),
        c(F.lit("Popularity: "), tx.popularity_phrase(t["popularity"]), F.lit(" ("), tx.popularity_round(t["popularity"]).cast("string"), F.lit("/100).")),
    )


def listen_line(t: dict[str, Column]) -> Column:
    """``"Title" by Artist (Year, tag)``; null if nothing is known."""
    return in_brackets(credit(first_text(t["track_name"]), first_text(t["artist_name"])), F.concat_ws(", ", tx.year(t["release_date"]), first_text(t["tag_list"])))


def recommended_line(place: Column, t: dict[str, Column], tags: Column) -> Column:
    """``1. Title — Artist (Album, Year) [tags]`` of a listed track; unknown names are ``unknown``."""
    named = F.concat(place.cast("string"), F.lit(". "), F.coalesce(tx.first_filled(t["track_name"]), F.lit("unknown")), F.lit(" — "), F.coalesce(tx.first_filled(t["artist_name"]), F.lit("unknown")))
    return F.concat_ws(" ", in_brackets(named, F.concat_ws(", ", tx.first_filled(t["album_name"]), tx.year(t["release_date"]))), F.concat(F.lit("["), F.nullif(F.array_join(F.slice(tags, 1, 8), ", "), F.lit("")), F.lit("]")))


def profile_line(p: Column) -> Column:
    """Known fields of a profile, age before age group; null for no profile."""
    age = F.coalesce(p["age"].cast("string"), filled(p["age_group"]))
    parts = [F.concat(F.lit("age: "), age), *(F.concat(F.lit(f"{f}: "), filled(p[f])) for f in PROFILE[2:])]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def goal_line(g: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *(F.concat(F.lit(f"{f}: "), filled(g[f])) for f in ("category", "specificity", "listener_goal"))), F.lit(""))


def first_sentence(text: Column, most: int = 160) -> Column:
    """The first sentence of a text, cut at a word to ``most`` characters."""
    return tx.truncate_words(F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), r"(?s)^(.*?[.!?])(?:\s|$)|^(.*)$", 0), most)


def lyric_hook(lyrics: Column, lines: int = 2, most: int = 110) -> Column:
    """The first lines of lyrics that are no headings, language marks or CJK text, joined; null for none."""
    each = F.transform(F.split(F.coalesce(lyrics, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    kept = F.filter(each, lambda x: (F.length(x) > 0) & ~x.rlike(r"^[\[(].*[\])]$") & ~x.rlike("[぀-ヿ㐀-鿿가-힯]"))
    return F.nullif(tx.truncate_words(F.array_join(F.slice(kept, 1, lines), " / "), most), F.lit(""))


def query_text(q: dict[str, Column], budget: int = 240) -> Column:
    """A query of at most ``budget`` estimated tokens: recent listens, context, and what is looked for at the end.

    ``q``: recent (lines, latest first), goal, era, popularity, tags, goal_eras, goal_popularity, goal_time, wish, category.  Parts
    are dropped in the order of ``DROPS`` until the text fits; if the rest does not fit either, its end is kept.
    """
    c, empty = F.concat, F.lit("")
    listed = lambda name, xs, between=", ": c(F.lit(name), F.nullif(F.array_join(xs, between), empty))
    wish = c(F.lit("Looking for: "), F.coalesce(filled(F.lower(q["wish"])), F.lit("(no current message)")), F.coalesce(c(F.lit(" — "), q["category"]), empty))
    aggregates = F.nullif(F.concat_ws("; ", c(F.lit("era "), q["era"]), q["popularity"], listed("tags: ", F.slice(q["tags"], 1, 8))), empty)
    mined = F.nullif(F.concat_ws("; ", listed("era cue: ", q["goal_eras"]), c(F.lit("popularity cue: "), q["goal_popularity"]), c(F.lit("time cue: "), q["goal_time"])), empty)
    n = F.size(q["recent"])

    def body(dropped: set[str]) -> Column:
        recent = q["recent"]
        if "recent_first" in dropped:
            recent = F.slice(recent, 1, 1)
        elif "recent_middle" in dropped:
            recent = F.when(n > 2, F.array(F.get(recent, F.lit(0)), F.get(recent, n - 1))).otherwise(recent)
        context = [part for name, part in (("goal", q["goal"]), ("aggregates", aggregates), ("cues", mined)) if name not in dropped]
        told = F.nullif(F.concat_ws(". ", *context), empty) if context else F.lit(None).cast("string")
        return F.concat_ws("\n", c(listed("Recent listens: ", recent, "; "), F.lit(".")), c(F.lit("Context: "), told, F.lit(".")), wish)

    bodies = [body(set(DROPS[:k])) for k in range(len(DROPS) + 1)]
    fits = [F.when(cues.token_estimate(b) <= budget, b) for b in bodies]
    return F.coalesce(*fits, F.right(bodies[-1], F.lit(int(budget * 3.5))))


def upper_median(values: Column) -> Column:
    """The middle element, the upper one of two; null for none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def span(values: Column) -> Column:
    """``first-last`` of sorted distinct values, one if all are equal; null for none."""
    s = F.array_sort(F.array_distinct(values))
    return F.when(F.size(s) == 1, F.get(s, F.lit(0))).when(F.size(s) > 1, F.concat(F.get(s, F.lit(0)), F.lit("-"), F.get(s, F.size(s) - 1)))


def tag_counts(tracks: DataFrame, ident: str = "track_id") -> DataFrame:
    """``tag, n``: tracks of each plain tag; a tag counts once a track."""
    plain = F.array_distinct(F.filter(F.transform("tag_list", tx.plain_tag), lambda t: t != ""))
    return tracks.select(ident, F.explode(plain).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def with_tag_counts(tracks: DataFrame, ident: str = "track_id") -> DataFrame:
    """``tracks`` with ``tag_counts``, a map from each of its own plain tags to the number of tracks that have it."""
    plain = F.array_distinct(F.filter(F.transform("tag_list", tx.plain_tag), lambda t: t != ""))
    own = tracks.select(ident, F.explode(plain).alias("tag")).join(tag_counts(tracks, ident), "tag").groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("tag_counts"))
    return tracks.join(own, ident, "left").withColumn("tag_counts", F.coalesce("tag_counts", F.create_map().cast("map<string,bigint>")))

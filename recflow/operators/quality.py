"""Quality flags of crawled fields and their profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues

#: Bounds and patterns of the flags (fixed values).
LYRICS_CHARS, CAPTION_CHARS, TEMPO = (100, 100_000), (30, 5_000), (30.0, 300.0)
REPEATED_LINE, LEAST_LINES = 0.5, 4
APOLOGY = r"(?i)(instrumental track that has no lyrics|this song is an instrumental|no lyrics? (available|found))"
INSTRUMENTAL = r"(?i)^\s*[\[\(]?\s*instrumental\s*[\]\)]?\s*$"
INFORMATIONAL = ("lyrics_method_search_fuzzy",)
#: Characters from which on a text may be mostly unprintable, and the least share of printable ones (fixed values).
PRINTABLE_FROM, PRINTABLE = 20, 0.5
#: Characters that are not printed: controls but white space, formats, surrogates, private and unassigned ones, blanks but the plain one.
UNPRINTED = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zs}\p{Zl}\p{Zp}&&[^ \n\r\t]]"
FIELDS = ("lyrics", "caption", "chord", "tempo", "music_key", "mbid", "isrc", "label", "country", "mb_release_date")


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text, F.lit(" \t\r\n")) == "", F.lit(True))


def _length(text: Column) -> Column:
    return F.length(F.trim(text, F.lit(" \t\r\n")))


def unprintable(text: Column) -> Column:
    """Whether less than half of a text of 20 characters or more is printed."""
    n = F.length(text)
    return F.coalesce((n >= PRINTABLE_FROM) & (F.length(F.regexp_replace(text, UNPRINTED, "")) < PRINTABLE * n), F.lit(False))


def blocking(flags: Column) -> Column:
    """Whether a flag of lyrics or caption stands; informational ones do not count."""
    return F.exists(flags, lambda f: (f.startswith("lyrics_") | f.startswith("caption_")) & ~f.isin(*INFORMATIONAL))


def line_flags(rows: DataFrame, ident: str) -> DataFrame:
    """``ident, instrumental, dominated``: of the lines of the lyrics, all say instrumental; one makes up half."""
    lines = rows.select(ident, F.explode(F.split("lyrics", r"\r\n|\r|\n")).alias("line")).select(ident, F.lower(F.trim("line", F.lit(" \t"))).alias("line")).where(F.col("line") != "")
    per = lines.groupBy(ident, "line").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(ident).agg(F.min(F.col("line").rlike(INSTRUMENTAL)).alias("instrumental"), ((F.sum("n") >= LEAST_LINES) & (F.max("n") >= REPEATED_LINE * F.sum("n"))).alias("dominated"))


def flags(crawl: DataFrame, ident: str = "crawl_id") -> DataFrame:
    """``ident, flags, ok``: sorted flags of each record; ok when no flag of lyrics or caption stands."""
    text, cap, tempo = F.col("lyrics"), F.col("caption"), F.trim("tempo")
    has, has_cap = ~blank(text), ~blank(cap)
    bpm = tempo.try_cast("double")
    needed = crawl.select(ident, "lyrics", "caption", "chord", "tempo", "music_key", "mbid")
    rows = needed.join(line_flags(needed, ident), ident, "left")
    named = [
        ("lyrics_empty", ~has),
        ("lyrics_too_short", has & (_length(text) < LYRICS_CHARS[0])),
        ("lyrics_too_long", has & (F.length(text) > LYRICS_CHARS[1])),
        ("lyrics_instrumental_marker", has & F.coalesce("instrumental", F.lit(False))),
        ("lyrics_repeated_line_dominant", has & F.coalesce("dominated", F.lit(False))),
        ("lyrics_mostly_non_printable", has & unprintable(text)),
        ("lyrics_apology", has & text.rlike(APOLOGY)),
        ("caption_empty", ~has_cap),
        ("caption_too_short", has_cap & (_length(cap) < CAPTION_CHARS[0])),
        ("caption_too_long", has_cap & (F.length(cap) > CAPTION_CHARS[1])),
        ("caption_mostly_non_printable", has_cap & unprintable(cap)),
        ("chord_empty", blank(F.col("chord"))),
        ("key_empty", blank(F.col("music_key"))),
        ("tempo_empty", blank(F.col("tempo"))),
        ("tempo_invalid", ~blank(F.col("tempo")) & (bpm.isNull() | F.isnan(bpm) | ~bpm.between(*TEMPO))),
        ("mbid_missing", blank(F.col("mbid"))),
    ]
    found = F.array_sort(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in named))))
    return rows.select(ident, found.alias("flags")).withColumn("ok", ~blocking(F.col("flags")))


def coverage(crawl: DataFrame) -> DataFrame:
    """``field, n_filled, n_rows, share``: filled values per field."""
    sums = crawl.agg(F.count(F.lit(1)).alias("n_rows"), *(F.coalesce(F.sum((~blank(F.col(f))).cast("long")), F.lit(0)).alias(f) for f in FIELDS))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n_filled")) for f in FIELDS)))
    return sums.select("n_rows", each.alias("x")).select("x.field", "x.n_filled", "n_rows", F.round(F.col("x.n_filled") / F.col("n_rows"), 6).alias("share"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def source_counts(crawl: DataFrame) -> DataFrame:
    """``field, source, n``: where the fields came from."""
    return crawl.select(F.explode("sources").alias("field", "source")).groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"))


def duplicate_texts(crawl: DataFrame, column: str = "lyrics") -> DataFrame:
    """``digest, n_tracks``: equal texts of more than one track."""
    rows = crawl.where(~blank(F.col(column))).select(F.sha2(F.trim(column, F.lit(" \t\r\n")), 256).alias("digest"), "track_id")
    return rows.groupBy("digest").agg(F.countDistinct("track_id").alias("n_tracks")).where("n_tracks > 1")


#: Least similarity of title and artist, most seconds apart, and the ways of a fuzzy search (fixed values).
TITLE_RATIO, ARTIST_RATIO, APART, FUZZY = 0.80, 0.85, 10.0, ("lrclib_search", "genius_search")


def seconds(duration: Column) -> Column:
    """A length asked for, in seconds: more than 1000 are milliseconds, none or 0 is unknown."""
    d = duration.cast("double")
    return F.when(d > 1000, d / 1000).when(d > 0, d)


def match_tests(crawl: DataFrame, ident: str = "crawl_id") -> DataFrame:
    """``ident, title, artist, apart, fuzzy``: similarities of names, seconds apart and way of search of found lyrics.

    The similarities are null where the names are surely alike, so only doubtful pairs of names reach Python.
    """
    m = F.col("lyrics_match")
    rows = crawl.where(m.isNotNull()).select(
        ident, cues.compared_name(m["track_name"]).alias("t1"), cues.compared_name(F.col("track_name")).alias("t2"), cues.compared_name(m["artist_name"]).alias("a1"),
        cues.compared_name(F.col("artist_name")).alias("a2"), F.abs(m["duration"].cast("double") - seconds(F.col("duration"))).alias("apart"), F.coalesce(m["method"].isin(*FUZZY), F.lit(False)).alias("fuzzy"),
    )
    return rows.select(ident, cues.name_similarity(F.col("t1"), F.col("t2")).alias("title"), cues.name_similarity(F.col("a1"), F.col("a2")).alias("artist"), "apart", "fuzzy")


def match_flags(crawl: DataFrame, ident: str = "crawl_id") -> DataFrame:
    """``ident, flags``: how far the names and the length found with the lyrics are from those asked for."""
    named = [
        ("lyrics_title_mismatch", F.col("title") < TITLE_RATIO),
        ("lyrics_artist_mismatch", F.col("artist") < ARTIST_RATIO),
        ("lyrics_duration_mismatch", F.col("apart") > APART),
        ("lyrics_method_search_fuzzy", F.col("fuzzy")),
    ]
    return match_tests(crawl, ident).select(ident, F.array_sort(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in named)))).alias("flags"))


def all_flags(crawl: DataFrame, ident: str = "crawl_id") -> DataFrame:
    """``ident, flags, ok``: flags of the fields and of the match together."""
    match = match_flags(crawl, ident).withColumnRenamed("flags", "_match")
    both = F.array_sort(F.concat("flags", F.coalesce("_match", F.array().cast("array<string>"))))
    return flags(crawl, ident).join(match, ident, "left").select(ident, both.alias("flags")).withColumn("ok", ~blocking(F.col("flags")))

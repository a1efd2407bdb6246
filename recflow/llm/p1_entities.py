"""Ties between records of outside sources and tracks of a catalog that share no key.

1. Names are parsed: case, accents and marks go, guests and editions (remaster, deluxe, official
   audio ...) are taken off, versions (live, remix, acoustic, demo, instrumental) are kept apart, since
   they make another recording; "artist - title" packed into one field is taken apart.
2. Sorted neighbourhood: records and tracks are sorted by several composite keys (``KEYS``), and each
   record is compared with the ``WINDOW`` nearest tracks on either side in each order.  Rows equal in all
   parsed fields are one row here.  The sorts are range partitions; records near the border of a
   partition also meet the tracks beyond it, which are known from the partitions' first and last tracks
   (at most 2 * WINDOW per partition).  Ties are ordered by version and duration.  Records also meet
   every track of the same title and first artist, however many there are, by an equality join; the
   records of a hot block are dealt over several tasks.
3. Weighted similarities of title, artist, album and duration give the confidence; a pair counts only if
   the versions agree and title and artist are each within a spelling error.
4. Each record takes the track of highest confidence.  A track may have several records, so under
   this rule that is the assignment of maximal total confidence.  ``one_to_one`` gives the assignment in
   which a track takes one record, by an auction.

Edge cases: records without a title never match; a missing artist, album or duration drops out of the
weights (without artist the duration or the album must agree); repeated tracks are one track; ties go
to the nearer version, then to the smaller track_id; an empty side gives no rows.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_rows, materialize

#: Tracks on either side of a record in each order.
WINDOW = 6
#: Records of one title and artist that a task joins with the tracks of that name.
BLOCK_RECORDS = 2_000
WEIGHTS = {"title": 0.45, "artist": 0.35, "album": 0.08, "duration": 0.12}
#: Least confidence of a tie, spelling errors of a title or artist (as edits), and how far lengths
#: may be apart (seconds, share) where nothing else is in doubt.
LEAST, MOST_EDITS, SECONDS, SECONDS_SHARE = 0.8, 3, 5.0, 0.02
#: Lengths of more than this are milliseconds.
MILLISECONDS = 2000

#: Words of versions that are recordings of their own, and of editions and notes that are not (fixed values).
VERSIONS = ("live", "remix", "acoustic", "demo", "instrumental", "karaoke", "a cappella", "acapella", "unplugged", "cover", "rework", "dub mix")
EDITIONS = re.compile(r"remaster|official|deluxe|single version|album version|radio version|explicit|bonus|anniversary|expanded|\bmono\b|\bstereo\b|\baudio\b|\bvideo\b|lyric|\bedition\b|\bhd\b|\bhq\b|^\d{4}$")
GUESTS = re.compile(r"^(?:feat\.?|ft\.?|featuring|with|w/)\s", re.IGNORECASE)
GUEST_TAIL = re.compile(r"\s+(?:feat\.?|ft\.?|featuring)\s.*$", re.IGNORECASE)
BRACKET = re.compile(r"[(\[{]([^)\]}]*)[)\]}]")
PACKED = re.compile(r"\s+(?:[-–—|~]|//)\s+|\s*:\s{1,}")
MOVED = re.compile(r"^(.*?)\s*,\s*(my|the|an?)$", re.IGNORECASE)
DASH = re.compile(r"\s+[-–—]\s+")
SPLIT_ARTIST = re.compile(r"\s+(?:feat\.?|ft\.?|featuring|with|x|vs\.?|presents)\s+|;|/", re.IGNORECASE)
#: Spellings of one word (fixed values).
SAME_WORDS = {"doctor": "dr", "saint": "st", "mister": "mr", "number": "no", "nr": "no", "versus": "vs", "n": "and"}
DROPPED = frozenset(["the", "and"])


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = unicodedata.normalize("NFKD", text.casefold().replace("&", " and ").replace("+", " and "))
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf" and c not in "'’`")
    return [SAME_WORDS.get(w, w) for w in re.findall(r"\w+", text)]


def parse_title(text: str | None) -> tuple[str, str]:
    """(core title, version)"""
    text = text or ""
    versions: list[str] = []

    def take(part: str) -> bool:
        low = part.strip().casefold()
        if not low or GUESTS.match(low) or EDITIONS.search(low):
            return True
        for v in VERSIONS:
            if re.search(rf"\b{v}\b", low):
                name = " ".join(w for w in words_of(low) if w not in ("at", "in", "from", "version", "the"))
                versions.append(name if v in ("live", "remix") else v)
                return True
        return False

    text = BRACKET.sub(lambda m: " " if take(m.group(1)) else m.group(0), text)
    parts = DASH.split(text)
    while len(parts) > 1 and take(parts[-1]):
        parts.pop()
    text = GUEST_TAIL.sub("", " ".join(parts))
    text = MOVED.sub(r"\2 \1", text.strip())
    return " ".join(words_of(text)), " ".join(sorted(versions))


def _linking(word: str) -> bool:
    """"the" or "and", or one of them with a spelling error."""
    if not 2 <= len(word) <= 4:
        return False
    for known in DROPPED:
        if word == known or sorted(word) == sorted(known):
            return True
        if len(word) == 3 and sum(a != b for a, b in zip(word, known, strict=True)) == 1:
            return True
        longer, shorter = (word, known) if len(word) > 3 else (known, word)
        if word != "band" and len(longer) == len(shorter) + 1 and any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer))):
            return True
    return False


def artist_forms(text: str | None) -> tuple[str, str]:
    """(all artists, first artist) with words in order of the alphabet."""
    def form(part: str) -> str:
        words = ["trio" if w == "3" else w for w in words_of(part)]
        return " ".join(sorted(w for w in words if not _linking(w)) or sorted(words))

    text = text or ""
    first = next((p for p in SPLIT_ARTIST.split(text) if p.strip(" ,")), "")
    return form(re.sub(SPLIT_ARTIST, " ", text)), form(first)


def seconds_of(duration) -> float | None:
    if duration is None or not duration > 0:
        return None
    return float(duration) / 1000 if duration > MILLISECONDS else float(duration)


def _signature(title: str) -> int:
    """64 bits of the letter pairs of a title; an edit changes few of them."""
    flat = title.replace(" ", "")
    out = 0
    for a, b in zip(" " + flat, flat + " ", strict=True):
        out |= 1 << ((ord(a) * 31 + ord(b) * 17) % 64)
    return out - (1 << 63)


_PARSED = "title string, version string, artists string, artist string, album string, seconds double, sig bigint, keys array<string>"


def _parse(names: pd.Series, artists: pd.Series, albums: pd.Series, durations: pd.Series) -> pd.DataFrame:
    rows = []
    for name, artist, album, duration in zip(names, artists, albums, durations, strict=True):
        if isinstance(name, np.ndarray | list):  # the catalog has lists
            name = next((x for x in name if x and x.strip()), None)
            artist = [x for x in artist if x and x.strip()] if artist is not None else []
            album = next((x for x in album if x and x.strip()), None) if album is not None else None
            first = artist_forms(artist[0])[1] if artist else ""
            every = artist_forms(" ; ".join(artist))[0]
        else:
            if not (artist or "").strip() and name and PACKED.search(name):
                artist, name = PACKED.split(name, maxsplit=1)
            every, first = artist_forms(artist)
        title, version = parse_title(name)
        album = parse_title(album)[0] if album else ""
        duration = None if duration is None or duration != duration else duration
        seconds = seconds_of(duration)
        flat = title.replace(" ", "")
        keys = [
            f"0{title} {first}",
            f"1{first} {title}",
            f"2{flat[::-1]} {first}",
            f"3{''.join(sorted(flat))} {first}",
            f"4{''.join(sorted(first.replace(' ', '')))} {title}",
            f"5{' '.join(sorted(title.split(), key=lambda w: (-len(w), w)))} {first}",
            f"6{re.sub('[aeiouy]', '', flat)} {first}",
            f"7{album} {title}" if album else f"7{title}",
        ]
        length = "" if seconds is None else f"{round(seconds):06d}"
        keys = [f"{k}\t{version}\t{length}" for k in keys] + [f"8{title}\t{length}\t{version}"]
        rows.append((title, version, every, first, album, seconds, _signature(title), keys))
    return pd.DataFrame(rows, columns=["title", "version", "artists", "artist", "album", "seconds", "sig", "keys"])


#: What the orders sort by: title and artist; artist and title; title backwards; letters of the title;
#: letters of the artist; longest words first; consonants; album and title (each with version and duration behind it); title and duration.
KEYS = 9


def parsed(rows: DataFrame, ident: str) -> DataFrame:
    """``ident`` and the parsed fields; rows without a title are left out."""
    udf = pandas_udf(_parse, _PARSED)
    return rows.select(ident, udf("track_name", "artist_name", "album_name", F.col("duration").cast("double")).alias("p")).select(ident, "p.*").where(F.col("title") != "")


def _window(frames, size: int):
    """Pairs of a sorted partition, and what the neighbours of the partition have to know."""
    from pyspark import TaskContext

    frames = list(frames)
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    part = TaskContext.get().partitionId()
    for order, own in rows.groupby("sort", sort=True):
        is_track = own["is_track"].to_numpy(dtype=bool)
        ident, sig = own["ident"].to_numpy(), own["sig"].to_numpy()
        t_id, t_sig = ident[is_track], sig[is_track]
        r_id, r_sig = ident[~is_track], sig[~is_track]
        before = np.cumsum(is_track)[~is_track]  # tracks of this partition before each record
        pieces = []
        for shift in range(-size, size):
            at = before + shift
            ok = (at >= 0) & (at < len(t_id))
            near = ok.copy()
            near[ok] = np.bitwise_count((r_sig[ok] ^ t_sig[at[ok]]).view(np.uint64)) <= 14
            pieces.append(pd.DataFrame({"kind": "pair", "part": part, "sort": order, "record": r_id[near], "track": t_id[at[near]], "sig": 0, "before": 0, "after": 0}))
        few_before, few_after = np.maximum(0, size - before), np.maximum(0, size - (len(t_id) - before))
        open_ = (few_before > 0) | (few_after > 0)
        pieces.append(pd.DataFrame({"kind": "open", "part": part, "sort": order, "record": r_id[open_], "track": 0, "sig": r_sig[open_], "before": few_before[open_], "after": few_after[open_]}))
        ends = sorted({*range(min(size, len(t_id))), *range(max(0, len(t_id) - size), len(t_id))})
        pieces.append(pd.DataFrame({"kind": "edge", "part": part, "sort": order, "record": 0, "track": t_id[ends], "sig": t_sig[ends], "before": ends, "after": 0}))
        yield pd.concat(pieces, ignore_index=True)


def _beyond(frames, shared, size: int):
    """Pairs of records near a border with the tracks beyond it."""
    for frame in frames:
        out = []
        for part, order, record, sig, before, after in frame[["part", "sort", "record", "sig", "before", "after"]].itertuples(index=False):
            parts, tracks, sigs = shared.value[order]
            lo, hi = np.searchsorted(parts, part), np.searchsorted(parts, part, side="right")
            for at in (*range(max(0, lo - before), lo), *range(hi, min(len(parts), hi + after))):
                if int(np.bitwise_count(np.uint64((int(sig) ^ int(sigs[at])) & (2**64 - 1)))) <= 14:
                    out.append((record, tracks[at]))
        if out:
            yield pd.DataFrame(out, columns=["record", "track"])


def neighbours(records: DataFrame, tracks: DataFrame, window: int = WINDOW) -> DataFrame:
    """``record, track``: pairs that are close in at least one order.  Both: ident, sig, keys."""
    spark = records.sparkSession
    both = records.select(F.lit(False).alias("is_track"), "ident", "sig", "keys").unionByName(tracks.select(F.lit(True).alias("is_track"), "ident", "sig", "keys"))
    rows = both.select("is_track", "ident", "sig", F.explode("keys").alias("key")).withColumn("sort", F.substring("key", 1, 1))
    ordered = rows.repartitionByRange("key", "is_track", "ident").sortWithinPartitions("key", "is_track", "ident")
    schema = "kind string, part int, sort string, record bigint, track bigint, sig bigint, before int, after int"
    found = materialize(ordered.mapInPandas(lambda it: _window(it, window), schema), "entity-window")
    edges = found.where("kind = 'edge'").select("sort", "part", "before", "track", "sig")
    table = pd.DataFrame([r.asDict() for r in bounded_rows(edges, 4_000_000)], columns=["sort", "part", "before", "track", "sig"]).sort_values(["sort", "part", "before"])
    none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
    context = {str(k): none for k in range(KEYS)} | {k: (g["part"].to_numpy(), g["track"].to_numpy(), g["sig"].to_numpy()) for k, g in table.groupby("sort")}
    shared = spark.sparkContext.broadcast(context)
    outside = found.where("kind = 'open'").mapInPandas(lambda it: _beyond(it, shared, window), "record bigint, track bigint")
    return found.where("kind = 'pair'").select("record", "track").unionByName(outside).distinct()


def same_names(records: DataFrame, tracks: DataFrame, block: int = BLOCK_RECORDS) -> DataFrame:
    """``record, track``: all pairs of equal title and first artist.  Both: ident, title, artist."""
    names = ["title", "artist"]
    r = records.where(F.col("artist") != "").select(F.col("ident").alias("record"), *names)
    parts = r.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    t = tracks.where(F.col("artist") != "").select(F.col("ident").alias("track"), *names).join(parts, names)
    t = t.select("track", *names, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    r = r.join(parts, names).select("record", *names, F.pmod(F.xxhash64("record"), F.col("parts")).cast("int").alias("part"))
    return r.join(t, [*names, "part"]).select("record", "track")


def _alike(a, b):
    size = F.greatest(F.length(a), F.length(b))
    return F.when(size == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / size)


def scored_pairs(records: DataFrame, tracks: DataFrame, window: int = WINDOW) -> DataFrame:
    """``record_id, track_id, confidence, version_edits`` of each pair that may be the same recording."""
    r_all = materialize(parsed(records, "record_id").withColumn("ident", F.xxhash64("title", "version", "artists", "artist", "album", "seconds")), "entity-records")
    t_all = materialize(parsed(tracks.where(F.col("track_id").isNotNull()), "track_id").withColumn("ident", F.xxhash64("track_id", "title", "version", "artists", "album", "seconds")), "entity-tracks")
    fields = ("title", "version", "artists", "artist", "album", "seconds")
    r_one = r_all.dropDuplicates(["ident"]).select("ident", "sig", "keys", *fields)
    t_one = t_all.dropDuplicates(["ident"]).select("ident", "track_id", "sig", "keys", *fields)
    near = neighbours(r_one, t_one, window).unionByName(same_names(r_one, t_one)).distinct()
    r = r_one.select(F.col("ident").alias("record"), *(F.col(c).alias(f"r_{c}") for c in fields))
    t = t_one.select(F.col("ident").alias("track"), "track_id", *(F.col(c).alias(f"t_{c}") for c in fields))
    p = near.join(r, "record").join(t, "track")
    c = F.col
    p = p.withColumn("title_edits", F.levenshtein("r_title", "t_title")).where(c("title_edits") <= MOST_EDITS)
    artist = F.greatest(_alike(c("r_artists"), c("t_artists")), _alike(c("r_artist"), c("t_artist")), _alike(c("r_artists"), c("t_artist")), _alike(c("r_artist"), c("t_artists")))
    artist_edits = F.least(F.levenshtein("r_artists", "t_artists"), F.levenshtein("r_artist", "t_artist"), F.levenshtein("r_artists", "t_artist"), F.levenshtein("r_artist", "t_artists"))
    same_version = (c("r_version") == c("t_version")) | ((c("r_version") != "") & (c("t_version") != "") & (F.levenshtein("r_version", "t_version") <= 2) & (F.substring("r_version", 1, 4) == F.substring("t_version", 1, 4)))
    gap = F.abs(c("r_seconds") - c("t_seconds"))
    close = gap <= F.greatest(F.lit(SECONDS), c("t_seconds") * SECONDS_SHARE)
    p = p.select(
        "record", "track_id", "title_edits", same_version.alias("same_version"), F.levenshtein("r_version", "t_version").alias("version_edits"), close.alias("close"),
        F.greatest(_alike(c("r_title"), c("t_title")), F.lit(0.0)).alias("title"),
        F.when((c("r_artists") != "") & (c("t_artists") != ""), artist).alias("artist"),
        artist_edits.alias("artist_edits"),
        F.when((c("r_album") != "") & (c("t_album") != ""), _alike(c("r_album"), c("t_album"))).alias("album"),
        F.when(gap.isNotNull(), F.when(close, 1 - gap / F.greatest(F.lit(SECONDS), c("t_seconds") * SECONDS_SHARE) / 2).otherwise(0.0)).alias("duration"),
    )
    weight = sum(F.when(c(k).isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items())
    total = sum(F.coalesce(c(k), F.lit(0.0)) * w for k, w in WEIGHTS.items())
    same_artist = F.coalesce((c("artist_edits") <= MOST_EDITS) & (c("artist") >= 0.75), (c("duration") > 0) | (c("album") > 0.85), F.lit(False))
    same_length = F.coalesce(c("close"), F.lit(True))
    spelled = c("close").isNotNull() | (c("title_edits") + F.coalesce("artist_edits", F.lit(0)) <= MOST_EDITS)
    sure = c("same_version") & same_artist & same_length & spelled
    p = p.where(sure).withColumn("confidence", F.round(total / weight, 4)).where(c("confidence") >= LEAST)
    best = p.groupBy("record", "track_id").agg(F.max("confidence").alias("confidence"), F.min(F.struct(-c("confidence"), "version_edits"))["version_edits"].alias("version_edits"))
    return r_all.select("record_id", F.col("ident").alias("record")).join(best, "record").select("record_id", "track_id", "confidence", "version_edits")


def matches(records: DataFrame, tracks: DataFrame) -> DataFrame:
    """``track_id, record_id, confidence``: the track of each record that has one."""
    pairs = scored_pairs(records, tracks)
    order = Window.partitionBy("record_id").orderBy(F.desc("confidence"), "version_edits", "track_id")
    return pairs.withColumn("place", F.row_number().over(order)).where("place = 1").select("track_id", "record_id", "confidence")


def found(records: DataFrame, tracks: DataFrame) -> DataFrame:
    """``track_id, record_id``"""
    return matches(records, tracks).select("track_id", "record_id").distinct()


def one_to_one(pairs: DataFrame, step: float = 1e-3) -> DataFrame:
    """``record_id, track_id, confidence``: an assignment of at most one record to a track and one track to a
    record, whose total confidence is within ``step`` per record of the largest possible.

    An auction in rounds: each free record bids for its best track what it is worth to it beyond the
    second best (or beyond staying free); each track goes to the highest bid, and its price rises to it.
    """
    pairs = materialize(pairs.select("record_id", "track_id", "confidence"), "auction-pairs")
    owned = materialize(pairs.limit(0).select("track_id", "record_id", F.col("confidence").alias("price")), "auction-owned")
    while True:
        free = pairs.join(owned.select("record_id"), "record_id", "left_anti").join(owned.select("track_id", "price"), "track_id", "left")
        worth = free.withColumn("worth", F.col("confidence") - F.coalesce("price", F.lit(0.0))).where(F.col("worth") > 0)
        order = Window.partitionBy("record_id").orderBy(F.desc("worth"), "track_id")
        ranked = worth.withColumn("place", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("worth").over(order), F.lit(0.0)))
        bids = ranked.where("place = 1").select("track_id", "record_id", (F.coalesce("price", F.lit(0.0)) + F.col("worth") - F.col("next") + step).alias("price"))
        bids = materialize(bids, "auction-bids")
        if bids.isEmpty():
            return owned.select("record_id", "track_id").join(pairs, ["record_id", "track_id"])
        won = bids.unionByName(owned).withColumn("place", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("price"), "record_id"))).where("place = 1").select("track_id", "record_id", "price")
        owned = materialize(won, "auction-owned")

"""Titles cited in replies: found, held against the titles on offer, and put right."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.cues import sequence_ratio, title_key

#: Quotation marks around titles, opening and closing (fixed values).
QUOTES = (('"', '"'), ("“", "”"), ("«", "»"), ("‘", "’"))
LEAST_RATIO, LEAST_KEY = 0.75, 3


def cited(replies: DataFrame, ident: list[str], column: str) -> DataFrame:
    """``ident, place, title``: distinct titles in quotation marks of each reply, in order."""
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(f"{a}([^{a}{b}]+){b}"), F.lit(1)) for a, b in QUOTES))))
    return replies.select(*ident, F.posexplode(found).alias("place", "title"))


def canonical(title: Column, artist: Column) -> Column:
    """``"Title" by Artist``; the title alone where the artist is unknown."""
    return F.concat(F.lit('"'), title, F.lit('"'), F.coalesce(F.concat(F.lit(" by "), F.nullif(artist, F.lit(""))), F.lit("")))


def exact_matches(titles: DataFrame, pool: DataFrame, ident: list[str]) -> DataFrame:
    """``titles`` with ``idx, pool_title, artist`` of the first title on offer with the same key.  ``pool``: ident, idx (from 1), pool_title, artist."""
    offered = pool.withColumn("_key", title_key(F.col("pool_title"))).where(F.col("_key") != "")
    first = offered.groupBy(*ident, "_key").agg(F.min(F.struct("idx", "pool_title", "artist")).alias("m"))
    return titles.withColumn("_key", title_key(F.col("title"))).join(first, [*ident, "_key"]).select(*titles.columns, "m.*")


def fuzzy_matches(titles: DataFrame, pool: DataFrame, ident: list[str], least: float = LEAST_RATIO) -> DataFrame:
    """``titles`` with ``idx, pool_title, artist, ratio`` of the most similar title on offer, the first of equal ones, if similar enough.

    A reply's titles meet the titles on offer to it (a top list), not the catalog.  Pairs whose lengths rule the ratio out are not compared.
    """
    a, b = F.lower(F.trim("title")), F.lower(F.trim("pool_title"))
    both = titles.join(pool, ident).withColumn("_a", a).withColumn("_b", b)
    # The ratio is at most twice the shorter length over the sum of both.
    able = 2 * F.least(F.length("_a"), F.length("_b")) >= least * (F.length("_a") + F.length("_b"))
    scored = both.where(able).withColumn("ratio", F.round(sequence_ratio("_a", "_b"), 6)).where(F.col("ratio") >= least)
    order = Window.partitionBy(*ident, "place").orderBy(F.desc("ratio"), "idx")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*titles.columns, "idx", "pool_title", "artist", "ratio")


def resolve(titles: DataFrame, pool: DataFrame, ident: list[str], protected: DataFrame | None = None, least: float = LEAST_RATIO) -> DataFrame:
    """``ident, place, title, how, idx, canonical``: what each cited title stands for: exact, protected (named by the listener), fuzzy, or fabricated.

    ``protected``: ident, protected_title; a title is protected if one key contains the other, of three characters at least.
    """
    key = [*ident, "place"]
    exact = exact_matches(titles, pool, ident).select(*key, "title", F.lit("exact").alias("how"), "idx", canonical(F.col("pool_title"), F.col("artist")).alias("canonical"))
    rest = titles.join(exact.select(*key), key, "left_anti")
    none = [F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("canonical")]
    out = exact
    if protected is not None:
        a, b = title_key(F.col("title")), title_key(F.col("protected_title"))
        kept = rest.join(protected, ident).where((F.length(a) >= LEAST_KEY) & (F.length(b) >= LEAST_KEY) & (F.contains(a, b) | F.contains(b, a))).select(*key).distinct()
        out = out.unionByName(rest.join(kept, key, "left_semi").select(*key, "title", F.lit("protected").alias("how"), *none))
        rest = rest.join(kept, key, "left_anti")
    near = fuzzy_matches(rest, pool, ident, least).select(*key, "title", F.lit("fuzzy").alias("how"), "idx", canonical(F.col("pool_title"), F.col("artist")).alias("canonical"))
    gone = rest.join(near.select(*key), key, "left_anti").select(*key, "title", F.lit("fabricated").alias("how"), *none)
    return out.unionByName(near).unionByName(gone)


@pandas_udf(StringType())
def _repaired(text: pd.Series, changes: pd.Series) -> pd.Series:
    import re

    out = []
    for reply, steps in zip(text, changes, strict=True):
        for step in steps if steps is not None else ():
            quoted = "|".join(re.escape(a + step["title"] + b) for a, b in QUOTES)
            follow = r"(?:\s+by\s+[^.,;!?\n]+)?"
            if step["canonical"] is not None:
                reply = re.sub(f"(?:{quoted}){follow}", lambda m, new=step["canonical"]: new, reply, count=1)
            elif step["how"] == "fabricated":
                reply = re.sub(rf",?\s*(?:{quoted}){follow}", "", reply)
            else:
                reply = re.sub(quoted, lambda m: m.group()[1:-1], reply)
        out.append(re.sub(r" +([.,;!?])", r"\1", re.sub(r" {2,}", " ", reply)).strip() if reply is not None else None)
    return pd.Series(out)


def repair(replies: DataFrame, resolved: DataFrame, ident: list[str], column: str) -> DataFrame:
    """``ident, column``: replies with known titles in canonical form, protected ones without quotation marks and fabricated ones taken out."""
    step = F.struct("place", "title", "how", "canonical")
    changes = resolved.groupBy(*ident).agg(F.array_sort(F.collect_list(step)).alias("_changes"))
    both = replies.join(changes, ident, "left")
    fixed = F.when(F.col("_changes").isNull(), F.col(column)).otherwise(_repaired(F.when(F.col("_changes").isNotNull(), F.col(column)), "_changes"))
    return both.select(*ident, fixed.alias(column))


def anchors(listed: DataFrame, ident: list[str]) -> DataFrame:
    """``ident, idx, anchor``: how to name each listed track by its artist: alone if the artist occurs once, else with the year if that is
    unique among the artist's tracks, else with the album, else with its number.  ``listed``: ident, idx, artist, album, year."""
    of = lambda *c: Window.partitionBy(*ident, "artist", *c)
    one = F.count(F.lit(1))
    rows = listed.withColumn("_n", one.over(of())).withColumn("_y", one.over(of("year"))).withColumn("_a", one.over(of("album"))).withColumn("_i", F.row_number().over(of().orderBy("idx")))
    tail = (
        F.when(F.col("_n") == 1, F.lit(""))
        .when(F.col("year").isNotNull() & (F.col("_y") == 1), F.concat(F.lit(" ("), "year", F.lit(")")))
        .when(F.col("album").isNotNull() & (F.col("_a") == 1), F.concat(F.lit(" (from "), "album", F.lit(")")))
        .otherwise(F.concat(F.lit(" (track "), F.col("_i").cast("string"), F.lit(")")))
    )
    return rows.select(*ident, "idx", F.concat("artist", tail).alias("anchor"))

"""Readers and writers: lenient JSON lines, last-row-wins tables, partitioned tables, resumable sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Roles of chat messages, in any case and with blanks around them (fixed values).
ROLES = {"user": ("user", "human"), "assistant": ("assistant", "bot"), "music": ("music", "track")}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def speaker(role: Column) -> Column:
    name = F.lower(F.trim(role))
    out = None
    for canonical, spellings in ROLES.items():
        out = (F.when if out is None else out.when)(name.isin(*spellings), canonical)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines files; malformed lines are left out, absent fields are null."""
    bad = "_corrupt_record"
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    return rows.where(F.col(bad).isNull()).drop(bad)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order.  Rows with a null key are left out."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    best = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``current`` with the last change of each key in place of its row; other rows stay as they are."""
    last = latest_per_key(changes, keys, order)
    return current.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def union_first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of splits in order of precedence; the first row of each key is kept."""
    ranked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("_part")
    return out.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_part")


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not yet done, for resumable jobs."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """A partitioned parquet table; rows of a partition value are spread by their keys' hash, not sent to one task."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def catalog(tracks: DataFrame) -> DataFrame:
    """One row per track out of repeated ones: that of the highest popularity, of equal ones the last by its names, date,
    duration and tags as text.  ``tracks`` needs all columns."""
    listed = lambda c: F.coalesce(F.array_join(c, "\x1f", ""), F.lit(""))
    order = [
        F.coalesce(F.col("popularity").cast("double"), F.lit(-1.0)).alias("_0"), *(listed(c).alias(f"_{i}") for i, c in enumerate(("track_name", "artist_name", "album_name"), 1)),
        F.coalesce("release_date", F.lit("")).alias("_4"), F.coalesce("duration", F.lit(-1)).alias("_5"), listed("tag_list").alias("_6"),
    ]
    rest = [c for c in tracks.columns if c != "track_id"]
    best = tracks.where(F.col("track_id").isNotNull()).groupBy("track_id").agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select("track_id", *(F.col("_best")[c].alias(c) for c in rest))

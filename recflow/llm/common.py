"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Roles of chat messages, in any case and with blanks around them (fixed values).
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "bot")
MUSIC_ROLES = ("music", "track")



def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  It is read from ``spark.checkpoint.dir``; only a
    session on one machine (``local``, ``local[...]``) without that setting gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_own_shared_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext._own_shared_dir = own
    return own


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage at a table that survives the loss of any executor, computes what is
    read several times only once, and pins results of steps that depend on row placement.
    The table is compressed, so its size on disk proves no bound for a broadcast: joins with it, or with
    what is selected or aggregated from it, are merge joins unless a side is marked for broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(schema).parquet(path).hint("merge")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already  # noqa: BLE001
        pass


def role_of(role: Column) -> Column:
    """``user``, ``assistant`` or ``music``; null for a role that names no speaker."""
    name = F.lower(F.trim(role))
    return (
        F.when(name.isin(*USER_ROLES), "user")
        .when(name.isin(*ASSISTANT_ROLES), "assistant")
        .when(name.isin(*MUSIC_ROLES), "music")
    )


def session_key(session_id: Column) -> Column:
    """A session id without regard to case and hyphens."""
    return F.regexp_replace(F.lower(F.trim(session_id)), "-", "")


def is_blank(text: Column) -> Column:
    """True for null and for texts of white space only."""
    return F.coalesce(text.rlike(r"(?U)^\s*$"), F.lit(True))


def bounded_rows(df: DataFrame, most: int) -> list:
    """Rows of a small table, refused (not cut) when there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a small table is expected")
    return rows


#: Hot keys of a join side that are dealt over tasks: a key counts as hot from one row in so many on.
MOST_HOT, HOT_ROWS = 10_000, 2_000


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Inner join on ``keys`` (other columns must differ) whose hot keys are dealt over tasks.

    A key with more than ``most`` rows on a side (by default ``HOT_ROWS``, and at least one in ``MOST_HOT`` of all
    rows) is cut into parts of that size on that side, and the other side's rows of the key are repeated for each
    part, so no task joins more than ``most`` by ``most`` rows of one key.  There are at most MOST_HOT hot keys a
    side, which bounds the table of them that is broadcast.  Both sides are read twice: pass written tables.
    """
    most = most or max(HOT_ROWS, -(-max(left.count(), right.count()) // MOST_HOT))
    hot = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name)).where(F.col(name) > 1)
    parts = hot(left, "_lp").join(hot(right, "_rp"), keys, "full_outer").select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.coalesce("_lp", F.lit(1)).alias("_lp"), F.coalesce("_rp", F.lit(1)).alias("_rp"))

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_h{i}") for i, k in enumerate(keys)))
        rows = df.withColumn("_d", F.xxhash64(*df.columns)).join(F.broadcast(parts), same, "left")
        rows = rows.withColumn(mine, F.pmod("_d", F.coalesce(own, F.lit(1))).cast("int"))
        return rows.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).select(*df.columns, "_l", "_r")

    a, b = dealt(left, "_lp", "_rp", "_l", "_r"), dealt(right, "_rp", "_lp", "_r", "_l")
    return a.hint("merge").join(b.hint("merge"), [*keys, "_l", "_r"]).drop("_l", "_r")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for costly work on rows of few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df

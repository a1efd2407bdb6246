"""Candidate pools: each takes queries and gives a ranking of unseen tracks; pools by name, ensembles, reranked ensembles and routing.

A pool is a function (``Context``, n) -> DataFrame of ``query_id, track_id, rank`` (from 0) and ``score``.  ``POOLS`` holds those known
by name, ``RERANKERS`` and ``RESPONDERS`` the other stages; all three take additions (``register``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import compose
from ..functions import text as tx
from . import retrieval
from .ranking import dense_top_k, fuse, top_popular

KEY = ["query_id"]
#: Fields of a text pool's documents (fixed values): names, content words of names, tags, and fields of the crawl.
NAMES = ("track_name", "artist_name", "album_name", "release_date")
KEYWORDS = ("mb_tags", "label", "country", "mb_release_date", "tempo", "music_key", "chord")
TEXT_POOLS = {
    "bm25_music_only": NAMES,
    "bm25_simple": (*NAMES, "noun_tags"),
    "bm25_history_noun_tags": (*NAMES, "noun_tags"),
    "bm25_tags_raw": (*NAMES, "noun_tags", "tag_list_raw"),
    "bm25_tags": (*NAMES, "noun_tags", "tag_list_clean"),
    "bm25_tags_crawl_kw": (*NAMES, "noun_tags", "tag_list_clean", *KEYWORDS),
    "bm25_crawl_kw": (*NAMES, "noun_tags", *KEYWORDS),
    "bm25_crawl": (*NAMES, "noun_tags", "lyrics", "caption", *KEYWORDS),
    "bm25_crawl_lyrics": (*NAMES, "noun_tags", "lyrics"),
}
#: Pools made of others (fixed values), fused by reciprocal rank.
NESTED_POOLS = {"bm25": ("bm25_simple", "bm25_tags_crawl_kw"), "bm25_qmr": ("bm25", "qemb_metadata")}
#: Vector pools by the type of vector they search.
VECTOR_POOLS = {"qemb_cf": "cf-bpr", "qemb_metadata": "metadata-qwen3_embedding_0.6b", "qemb_lyrics": "lyrics-qwen3_embedding_0.6b"}
FOLDS = 5


@dataclass
class Context:
    """What pools read.  ``queries``: query_id, query, seen (array of track ids), specificity; ``catalog``: one row a track; ``crawl``: one
    row a track; ``vectors``: vector_type, track_id, vector, one row each; ``plays``: track_id of the training split."""

    queries: DataFrame
    catalog: DataFrame
    crawl: DataFrame | None = None
    vectors: DataFrame | None = None
    plays: DataFrame | None = None


Pool = Callable[[Context, int], DataFrame]


class MissingInput(ValueError):
    """A pool's context lacks a table that it reads."""


def ranked(found: DataFrame, n: int) -> DataFrame:
    """Ranks out of scores, ties by id, cut to n."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "track_id")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < n).select("query_id", "track_id", "rank", "score")


def field_text(name: str) -> Column:
    """The text of a document field."""
    if name == "noun_tags":
        every = F.concat_ws(" ", *(compose.joined(F.col(c), " ") for c in NAMES[:3]))
        return F.array_join(F.filter(F.regexp_extract_all(F.lower(every), F.lit(r"([a-z]{3,})"), F.lit(1)), lambda w: ~w.isin(*tx.STOP_WORDS)), " ")
    if name == "tag_list_raw":
        return compose.joined(F.col("tag_list"), " ")
    if name == "tag_list_clean":
        return F.array_join(tx.search_tags(F.col("tag_list")), " ")
    if name in NAMES[:3] or name == "mb_tags":
        return compose.joined(F.col(name), ", ")
    return F.col(name).cast("string")


def documents(context: Context, fields: tuple[str, ...]) -> DataFrame:
    """``track_id, doc``: a line ``name: value`` of each field that has a value; the names are words of the document too."""
    rows = context.catalog
    wanted = [f for f in fields if f in (*KEYWORDS, "lyrics", "caption")]
    if wanted:
        if context.crawl is None:
            raise MissingInput("these fields need the crawl")
        rows = rows.join(context.crawl.select("track_id", *wanted), "track_id", "left")
    lines = [F.concat(F.lit(f"{f}: "), F.nullif(F.trim(field_text(f)), F.lit(""))) for f in fields]
    return rows.select("track_id", F.lower(F.concat_ws("\n", *lines)).alias("doc"))


def query_texts(context: Context) -> DataFrame:
    """``query_id, query``: the query in small letters after a line of names of each track heard before."""
    heard = context.queries.select("query_id", F.posexplode("seen").alias("i", "track_id"))
    names = context.catalog.select("track_id", F.concat_ws(" ", tx.first_filled(F.col("track_name")), tx.first_filled(F.col("artist_name")), tx.first_filled(F.col("album_name"))).alias("line"))
    lines = heard.join(names, "track_id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return context.queries.select("query_id", "query").join(lines, "query_id", "left").select("query_id", F.lower(F.concat_ws("\n", "lines", "query")).alias("query"))


def without_seen(found: DataFrame, context: Context) -> DataFrame:
    """``found`` without the tracks heard before, by lists: it moves by query only, as its ranking needs."""
    heard = context.queries.groupBy(*KEY).agg(F.flatten(F.collect_list("seen")).alias("_heard"))
    return found.join(heard, KEY, "left").where(~F.coalesce(F.array_contains("_heard", F.col("track_id")), F.lit(False))).drop("_heard")


def text_pool(context: Context, n: int, fields: tuple[str, ...]) -> DataFrame:
    """The n best unseen tracks of each query by BM25 over documents of ``fields``."""
    heard = context.queries.select("query_id", F.coalesce(F.size(F.array_distinct("seen")), F.lit(0)).alias("heard"))
    queries = query_texts(context).join(heard, "query_id")
    # A query skips at most as many tracks as it has heard.
    found = retrieval.candidates(queries, documents(context, fields), n, "query_id", "query", "track_id", "doc", F.greatest("heard", F.lit(0)))
    return ranked(without_seen(found, context), n)


def popular_pool(context: Context, n: int) -> DataFrame:
    """The n most played unseen tracks.  A query skips at most as many as it has seen, so n plus the longest list of seen tracks are enough."""
    longest = context.queries.agg(F.coalesce(F.max(F.size("seen")), F.lit(0)).alias("n")).collect()[0]["n"]
    top = F.broadcast(top_popular(context.plays, n + max(0, longest)))
    found = context.queries.select("query_id").repartition("query_id").crossJoin(top).select("query_id", "track_id", F.col("n").cast("double").alias("score"))
    return ranked(without_seen(found, context), n)


def vector_pool(context: Context, n: int, kind: str) -> DataFrame:
    """The n unseen tracks nearest to the mean direction of the tracks heard before; queries without any get none."""
    if context.vectors is None:
        raise MissingInput("this pool needs vectors")
    vectors = context.vectors.where(F.col("vector_type") == kind).select("track_id", "vector")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    heard = context.queries.select("query_id", F.explode(F.array_distinct("seen")).alias("track_id")).join(vectors, "track_id")
    lists = heard.select("query_id", norm.alias("norm"), "vector").groupBy("query_id").agg(F.collect_list(F.struct("norm", "vector")).alias("v"))
    lists = lists.select("query_id", F.col("v.norm").alias("norms"), F.col("v.vector").alias("vectors"))
    means = lists.mapInPandas(_means, f"query_id {dict(lists.dtypes)['query_id']}, vector array<float>")
    longest = context.queries.agg(F.coalesce(F.max(F.size("seen")), F.lit(0)).alias("n")).collect()[0]["n"]
    found = dense_top_k(means.withColumnRenamed("query_id", "track_id"), vectors, n + max(0, longest), "track_id", "vector")
    return ranked(without_seen(found.select("query_id", "track_id", F.col("sim").alias("score")), context), n)


def _means(frames):
    """The mean of each query's unit vectors; of unequal lengths, at each place of those that reach it."""
    import numpy as np
    import pandas as pd

    for frame in frames:
        ids, means = [], []
        for query, norms, vectors in zip(frame["query_id"], frame["norms"], frame["vectors"], strict=True):
            kept = [np.asarray(v, dtype=np.float64) / n for n, v in zip(norms, vectors, strict=True) if n and n == n]
            if kept:
                wide = np.full((len(kept), max(map(len, kept))), np.nan)
                for row, v in zip(wide, kept, strict=True):
                    row[: len(v)] = v
                ids.append(query)
                means.append(np.nanmean(wide, axis=0).astype(np.float32))
        yield pd.DataFrame({"query_id": pd.Series(ids, dtype=frame["query_id"].dtype), "vector": means})


def as_rankings(parts: dict[str, DataFrame]) -> DataFrame:
    """Rankings of several pools as one long table, in order of the pools."""
    out = None
    for i, (name, part) in enumerate(parts.items()):
        rows = part.select("query_id", F.lit(name).alias("pool"), F.lit(i).alias("pool_ord"), "track_id", "rank", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def ensemble(context: Context, n: int, names: tuple[str, ...], method: str = "rrf", weights: dict[str, float] | None = None, ignore_failures: bool = True) -> DataFrame:
    """Pools fused and scored by place, 1 / (rank + 1).  A pool that lacks its input is left out if failures are ignored; no other failure is."""
    parts = {}
    for name in names:
        try:
            parts[name] = pool(name)(context, n)
        except MissingInput:
            if not ignore_failures:
                raise
    if not parts:
        raise ValueError("no pool of the ensemble can be built")
    return fuse(as_rankings(parts), method, n, KEY, weights).select("query_id", "track_id", "rank", (1.0 / (F.col("rank") + 1)).alias("score"))


def reranked(context: Context, n: int, names: tuple[str, ...], reranker: str = "passthrough") -> DataFrame:
    """An ensemble whose candidates are ranked again, as one pool scored by place."""
    rankings = as_rankings({name: pool(name)(context, n) for name in names})
    top = RERANKERS[reranker](fuse(rankings, "rrf", n, KEY), rankings)
    return top.where(F.col("rank") < n).select("query_id", "track_id", "rank", (1.0 / (F.col("rank") + 1)).alias("score"))


def resorted(candidates: DataFrame, score: str, most: int | None = None) -> DataFrame:
    """Candidates by falling model score, equal ones in their order; those beyond the first ``most`` stay behind in theirs."""
    inside = F.col("rank") < most if most else F.lit(True)
    order = Window.partitionBy(*KEY).orderBy(F.when(inside, 0).otherwise(1), F.when(inside, -F.col(score)).asc_nulls_last(), "rank")
    return candidates.withColumn("_new", F.row_number().over(order) - 1).drop("rank").withColumnRenamed("_new", "rank")


def agreement(candidates: DataFrame, rankings: DataFrame) -> DataFrame:
    """Candidates by the number of pools that hold them and their best rank there."""
    seen = rankings.groupBy(*KEY, "track_id").agg(F.countDistinct("pool").alias("pools"), F.min("rank").alias("best"))
    scored = candidates.join(seen, [*KEY, "track_id"]).withColumn("model", F.col("pools") + 1 / (F.col("best") + 2))
    return resorted(scored, "model").select(*candidates.columns)


RERANKERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"passthrough": lambda candidates, rankings: candidates, "agreement": agreement}
RESPONDERS: dict[str, Callable[[DataFrame], Column]] = {"noop": lambda predictions: F.lit("")}
POOLS: dict[str, Pool] = {"popular": popular_pool}
POOLS |= {name: partial(text_pool, fields=fields) for name, fields in TEXT_POOLS.items()}
POOLS |= {name: partial(vector_pool, kind=kind) for name, kind in VECTOR_POOLS.items()}
POOLS |= {name: partial(ensemble, names=names) for name, names in NESTED_POOLS.items()}


def register(name: str, made: Pool) -> None:
    if name in POOLS:
        raise ValueError(f"there is a pool {name}")
    POOLS[name] = made


def pool(name: str) -> Pool:
    """The pool of a name; several names joined by ``-`` are their ensemble."""
    if name in POOLS:
        return POOLS[name]
    parts = tuple(name.split("-"))
    if len(parts) > 1 and all(p in POOLS for p in parts):
        return partial(ensemble, names=parts)
    raise ValueError(f"no such pool: {name}")


def expand(names: list[str]) -> list[str]:
    """Names of pools with folds (``x_all``) as those of their folds; each once, in order."""
    out = [f"{n.removesuffix('_all')}_fold{i}" for n in names for i in range(FOLDS if n.endswith("_all") else 0)] if any(n.endswith("_all") for n in names) else []
    return list(dict.fromkeys(x for n in names for x in ([y for y in out if y.startswith(n.removesuffix("_all") + "_fold")] if n.endswith("_all") else [n])))


def logical(names: list[str]) -> dict[str, list[str]]:
    """Names without their fold suffix, with the names they stand for."""
    out: dict[str, list[str]] = {}
    for n in names:
        out.setdefault(re.sub(r"(_fold\d+|_all)$", "", n), []).append(n)
    return out


def signature(names: list[str]) -> str:
    return "-".join(sorted(logical(names)))


def parse_tid(tid: str) -> tuple[str, list[str], str]:
    """(strategy, pools, reranker) of ``strategy__pool-pool[__reranker]``."""
    strategy, pools, *rest = tid.split("__")
    return strategy, [p for p in pools.split("-") if p], rest[0] if rest else "passthrough"


def format_tid(strategy: str, pools: list[str], reranker: str = "passthrough") -> str:
    return "__".join([strategy, "-".join(pools), *([reranker] if reranker != "passthrough" else [])])


def predict(
    context: Context, names: list[str], method: str = "rrf", reranker: str = "passthrough", top_k: int = 20, n: int = 100,
    first_pool: str | None = None, first_specificity: tuple[str, ...] | None = None, rewrites: DataFrame | None = None, rewritten_pools: tuple[str, ...] = (),
) -> DataFrame:
    """``query_id, track_id, rank, score``: pools, fusion, reranking and cut for all queries at once.

    With ``first_pool``, queries that have heard nothing yet (and are of one of ``first_specificity``) go to that pool alone.
    ``rewrites`` (query_id, rewritten) replaces the query text for ``rewritten_pools``.  With one pool its own scores are kept.
    """
    fresh = F.coalesce(F.size("seen"), F.lit(0)) <= 0
    if first_specificity is not None:
        fresh = fresh & F.coalesce(F.col("specificity").isin(*first_specificity), F.lit(False))
    to_first = fresh if first_pool else F.lit(False)
    main = Context(context.queries.where(~to_first), context.catalog, context.crawl, context.vectors, context.plays)
    parts = {}
    for name in names:
        own = main
        if rewrites is not None and name in rewritten_pools:
            texts = main.queries.join(rewrites, "query_id", "left").withColumn("query", F.coalesce("rewritten", "query")).drop("rewritten")
            own = Context(texts, main.catalog, main.crawl, main.vectors, main.plays)
        parts[name] = pool(name)(own, n)
    rankings = as_rankings(parts)
    fused = fuse(rankings, method, n, KEY) if len(parts) > 1 else parts[names[0]]
    top = RERANKERS[reranker](fused, rankings).where(F.col("rank") < top_k).select("query_id", "track_id", "rank", "score")
    if first_pool:
        routed = Context(context.queries.where(to_first), context.catalog, context.crawl, context.vectors, context.plays)
        top = top.unionByName(pool(first_pool)(routed, n).where(F.col("rank") < top_k))
    return top

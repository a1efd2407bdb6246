"""The most similar vectors of every vector, by an inverted file with product-quantised residuals.

1. A bounded sample (at most ``MOST_SAMPLE`` vectors of each type, drawn by a hash of the id) fits the coarse
   centroids, as many as the root of the number of vectors, and the codebooks of the residuals.  Every vector
   is indexed.  The index that is sent to all tasks has at most MOST_SAMPLE / SAMPLE_PER_CELL centroids and
   256 * dimension codewords a type: 18 MB a type of 1,024 dimensions, whatever the data; the sample that the
   driver holds at most 134 MB.  From 16.8 million vectors a type on cells grow instead of their number.
2. Each vector is a query in the cell of its nearest centroid, and its code (nearest centroid and
   quantised residual) is a candidate in its ``probes`` nearest cells.  So codes of some 70 bytes
   are what travels, and each full vector travels to one cell.
3. In a cell, asymmetric distance tables of the queries give an estimated cosine for every
   candidate; with x' the decoded candidate, q.x' / x'.x' estimates q.x without bias.
4. The ``shortlist`` best candidates (with ``least``: those within ``MARGIN`` of it) are ranked again
   by their exact cosine.

Copies of one vector are one class (a hash of the vector's bytes): batches combine them before
they are shuffled, cells search each class once, and the ranked classes are expanded to at most
k + 1 members each, smallest ids first, which is what the tie rule asks for.  Cells that would
hold more than ``CELL_ROWS`` classes, as estimated from the sample, are searched in blocks of
queries and candidates whose results are merged.

Edge cases: null, empty, all-zero vectors, vectors with null or NaN elements and those of another
dimension than most of their type are left out; a (type, track) with several different vectors keeps the one with the
smallest hash; ties of the cosine go to the smaller id; types are searched apart; with fewer than
k other vectors all of them come out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rows, materialize

#: Vectors of a type that fit its index: at least SAMPLE, SAMPLE_PER_CELL for each of the cells (the root of the
#: number of vectors), at most MOST_SAMPLE.  Rounds of fitting; types that fit the driver.
SAMPLE, SAMPLE_PER_CELL, MOST_SAMPLE, ROUNDS, MOST_TYPES = 4096, 8, 32_768, 6, 64
#: Elements of a vector that share a codebook, by dimension; codewords of a codebook.
CODE_WIDTH, CODEWORDS = {128: 4, 1024: 16}, 256
#: Classes of a cell that are searched in one go, estimates held at a time, and how far an estimate may fall short.
CELL_ROWS, ESTIMATES, MARGIN = 4096, 1 << 24, 0.3


def usable(vectors: DataFrame) -> DataFrame:
    """``vector_type, track_id, vector, v``: rows that count; v is the hash of the vector."""
    fine = (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return vectors.where(F.col("vector_type").isNotNull() & F.col("track_id").isNotNull() & fine).select("vector_type", "track_id", "vector", F.xxhash64("vector").alias("v"))


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, sphere: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        half = 0.0 if sphere else 0.5 * (centers * centers).sum(1)
        near = np.concatenate([(x[a : a + 4096] @ centers.T - half).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(k))
        counts = np.bincount(near, minlength=k)
        sums = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        filled = counts > 0
        centers[filled] = sums[filled] / counts[filled, None]
        if sphere:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    return centers


def _nearest_code(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    m, words, width = books.shape
    half = 0.5 * (books * books).sum(2)
    code = np.empty((len(residual), m), np.uint8)
    for s in range(m):
        code[:, s] = (residual[:, s * width : (s + 1) * width] @ books[s].T - half[s]).argmax(1)
    return code


def fit_index(sample: np.ndarray, count: int) -> dict:
    """Coarse centroids, codebooks and blocks per cell, of a sample of unit vectors out of ``count``."""
    d = sample.shape[1]
    cells = max(1, min(int(count**0.5), len(sample) // SAMPLE_PER_CELL))
    centers = _kmeans(sample, cells, ROUNDS, 1, sphere=True)
    near = np.concatenate([(sample[a : a + 4096] @ centers.T).argmax(1) for a in range(0, len(sample), 4096)])
    residual = sample - centers[near]
    width = CODE_WIDTH.get(d) or next(w for w in (16, 8, 4, 2, 1) if d % w == 0)
    books = [_kmeans(np.ascontiguousarray(residual[:, s : s + width]), CODEWORDS, ROUNDS, 2) for s in range(0, d, width)]
    share = np.bincount(near, minlength=len(centers)) / len(sample)
    blocks = np.maximum(1, np.ceil(share * count / CELL_ROWS)).astype(np.int32)
    return {"centers": centers.astype(np.float32), "books": np.stack(books).astype(np.float32), "blocks": blocks}


def dimensions(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """The dimension of each type (that of most of its vectors, of the larger one if equal) and its number of vectors."""
    out: dict[str, tuple[int, int]] = {}
    sizes = bounded_rows(rows.groupBy("vector_type", F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")), MOST_TYPES * 4096)
    for r in sorted(sizes, key=lambda r: (r["n"], r["d"])):
        out[r["vector_type"]] = (r["d"], r["n"])
    if len(out) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} types of vectors")
    return out


def of_dimension(rows: DataFrame, known: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows whose vector has the dimension of its type."""
    want = F.lit(None).cast("int")
    for kind, (d, _) in known.items():
        want = F.when(F.col("vector_type") == kind, d).otherwise(want)
    return rows.where(F.size("vector") == want)


def fit_indexes(rows: DataFrame, known: dict[str, tuple[int, int]]) -> dict[str, dict]:
    counts = {kind: n for kind, (_, n) in known.items()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for kind, n in counts.items():
        most = min(MOST_SAMPLE, max(SAMPLE, SAMPLE_PER_CELL * int(n**0.5)))
        share = F.when(F.col("vector_type") == kind, min(1.0, most / n)).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(7), "track_id"), F.lit(1_000_000)) < share * 1_000_000).select("vector_type", "vector").toArrow()
    kinds = np.array(drawn.column("vector_type").to_pylist(), dtype=object)
    out = {}
    for kind, n in counts.items():
        part = drawn.filter(kinds == kind) if len(kinds) else drawn
        if part.num_rows == 0:  # a small type of which the hash drew nothing
            part = rows.where(F.col("vector_type") == kind).select("vector").limit(SAMPLE).toArrow()
        flat = part.column("vector").combine_chunks()
        x = _matrix(flat)
        out[kind] = fit_index(x, n)
    return out


def _matrix(lists) -> np.ndarray:
    """Unit rows of an Arrow list array."""
    if hasattr(lists, "combine_chunks"):
        lists = lists.combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(lists), -1)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _place(batches, shared, probes: dict):
    """Rows for the cells: queries (with vectors) and candidates (with codes), combined by batch."""
    import pyarrow as pa

    names = ["cell", "vector_type", "is_query", "v", "home", "data"]
    for batch in batches:
        kinds = np.array(batch.column("vector_type").to_pylist(), dtype=object)
        for kind in set(kinds):
            index = shared.value[kind]
            part = batch.filter(pa.array(kinds == kind))
            v = part.column("v").to_numpy()
            v, first = np.unique(v, return_index=True)
            x = _matrix(part.column("vector"))[first]
            centers, books, blocks = index["centers"], index["books"], index["blocks"]
            score = x @ centers.T
            home = score.argmax(1).astype(np.int32)
            code = _nearest_code(x - centers[home], books)
            most = min(max(probes.get(kind, probes[""]), round(probes.get("root", 0) * len(centers) ** 0.5)), len(centers))
            near = np.argpartition(-score, most - 1, axis=1)[:, :most] if most < len(centers) else np.broadcast_to(np.arange(len(centers)), score.shape)
            rows = []
            block = (v.view(np.uint64) % np.uint64(1 << 20)).astype(np.int64)
            for c in np.unique(home):
                at = np.flatnonzero(home == c)
                b = int(blocks[c])
                for i in range(b):
                    mine = at[block[at] % b == i]
                    if len(mine):
                        rows += [(f"{c}/{i}/{j}", kind, True, v[mine].tobytes(), None, x[mine].tobytes()) for j in range(b)]
            who, cell = np.repeat(np.arange(len(x)), most), near.ravel()
            order = np.argsort(cell, kind="stable")
            who, cell = who[order], cell[order]
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for mine, c in zip(np.split(who, cuts), cell[np.concatenate([[0], cuts])], strict=True):
                b = int(blocks[c])
                for j in range(b):
                    own = mine[block[mine] % b == j] if b > 1 else mine
                    if len(own):
                        rows += [(f"{c}/{i}/{j}", kind, False, v[own].tobytes(), home[own].tobytes(), code[own].tobytes()) for i in range(b)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)


def _search(key, frame, shared, shortlist: int, least: float | None):
    import pandas as pd

    kind = key[0]
    index = shared.value[kind]
    centers, books = index["centers"], index["books"]
    m, words, width = books.shape
    columns = ["vector_type", "q", "c", "guess"]
    is_query = frame["is_query"].to_numpy(dtype=bool)
    queries, others = frame[is_query], frame[~is_query]
    if not len(queries) or not len(others):
        return pd.DataFrame(columns=columns)

    def joined(values, kind):
        return np.frombuffer(b"".join(values), kind)

    qv, first = np.unique(joined(queries["v"], np.int64), return_index=True)
    x = joined(queries["data"], np.float32).reshape(-1, centers.shape[1])[first]
    cv, first = np.unique(joined(others["v"], np.int64), return_index=True)
    home = joined(others["home"], np.int32)[first]
    code = joined(others["data"], np.uint8).reshape(-1, m)[first]
    # x'.x' of the decoded candidates
    norm = np.zeros(len(cv), np.float32)
    for s in range(m):
        word = books[s][code[:, s]] + centers[home, s * width : (s + 1) * width]
        norm += (word * word).sum(1)
    out = []
    step = max(1, min(512, ESTIMATES // len(cv)))
    for a in range(0, len(x), step):
        q = x[a : a + step]
        guess = (centers @ q.T)[home]  # candidates x queries
        for s in range(m):
            table = books[s] @ q[:, s * width : (s + 1) * width].T  # codewords x queries
            guess += table[code[:, s]]
        guess /= np.maximum(norm, 0.05)[:, None]
        guess[cv[:, None] == qv[None, a : a + step]] = -9
        g = guess.T
        if least is not None:
            row, col = np.nonzero(g >= least - MARGIN)
            if len(row):
                order = np.lexsort((-g[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < shortlist], col[place < shortlist]
        else:
            most = min(shortlist, g.shape[1])
            col = np.argpartition(-g, most - 1, axis=1)[:, :most].ravel()
            row = np.repeat(np.arange(len(g)), most)
            keep = g[row, col] > -9
            row, col = row[keep], col[keep]
        out.append(pd.DataFrame({"vector_type": kind, "q": qv[a + row], "c": cv[col], "guess": g[row, col]}))
    return pd.concat(out) if out else pd.DataFrame(columns=columns)


def _cosines(batches):
    import pyarrow as pa

    for batch in batches:
        # Rows of one batch can be of different dimensions.
        a, b = batch.column("a"), batch.column("b")
        size = np.diff(a.offsets.to_numpy())
        cos = np.zeros(len(size))
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            x, y = (_matrix(col.take(pa.array(at))).astype(np.float64) for col in (a, b))
            cos[at] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
        kept = [batch.column(i) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.minimum(1.0, cos))], ["vector_type", "q", "c", "cos"])


def class_neighbors(rows: DataFrame, known: dict, members: DataFrame, probes: dict, shortlist: int, least: float | None) -> DataFrame:
    """``vector_type, q, c, cos`` of classes of equal vectors, both ways as found."""
    spark = rows.sparkSession
    indexes = fit_indexes(rows, known)
    shared = spark.sparkContext.broadcast(indexes)
    placed = rows.select("vector_type", "vector", "v").mapInArrow(lambda batches: _place(batches, shared, probes), "cell string, vector_type string, is_query boolean, v binary, home binary, data binary")
    found = placed.groupBy("vector_type", "cell").applyInPandas(lambda key, frame: _search(key, frame, shared, shortlist, least), "vector_type string, q bigint, c bigint, guess float")
    if any((i["blocks"] > 1).any() for i in indexes.values()):
        best = Window.partitionBy("vector_type", "q").orderBy(F.desc("guess"), "c")
        found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= shortlist)
    # Each unordered pair is ranked once.
    found = materialize(found.select("vector_type", F.least("q", "c").alias("q"), F.greatest("q", "c").alias("c")).distinct(), "neighbor-pairs")
    heads = members.groupBy("vector_type", "v").agg(F.min("track_id").alias("head"))
    one = rows.join(heads.withColumnRenamed("head", "track_id"), ["vector_type", "v", "track_id"], "left_semi").select("vector_type", "v", "vector")
    pairs = found.join(one.withColumnsRenamed({"v": "q", "vector": "a"}), ["vector_type", "q"]).join(one.withColumnsRenamed({"v": "c", "vector": "b"}), ["vector_type", "c"])
    exact = pairs.select("vector_type", "q", "c", "a", "b").mapInArrow(_cosines, "vector_type string, q bigint, c bigint, cos double")
    exact = exact.dropDuplicates(["vector_type", "q", "c"])
    if least is not None:
        exact = exact.where(F.col("cos") >= least)
    exact = materialize(exact, "neighbor-cosines")
    return exact.unionByName(exact.select("vector_type", F.col("c").alias("q"), F.col("q").alias("c"), "cos"))


def nearest(vectors: DataFrame, k: int = 10, least: float | None = None, probes: dict | None = None, shortlist: int = 128) -> DataFrame:
    """``vector_type, track_id, neighbor_id, cos, rank``: the k nearest of each usable vector, with
    ``least`` those of at least this cosine."""
    rows = usable(vectors)
    known = dimensions(rows)
    rows = of_dimension(rows, known)
    members = materialize(rows.groupBy("vector_type", "track_id").agg(F.min("v").alias("v")), "neighbor-members")
    near = class_neighbors(rows, known, members, probes or DEFAULT_PROBES, shortlist, least)
    # First k + 1 members of each class, smallest ids first, in two steps so that no class is one task.
    salted = members.withColumn("salt", F.pmod(F.xxhash64("track_id"), F.lit(64)))
    some = salted.withColumn("i", F.row_number().over(Window.partitionBy("vector_type", "v", "salt").orderBy("track_id"))).where(F.col("i") <= k + 1)
    some = some.withColumn("i", F.row_number().over(Window.partitionBy("vector_type", "v").orderBy("track_id"))).where(F.col("i") <= k + 1)
    firsts = some.select("vector_type", F.col("v").alias("c"), F.col("track_id").alias("neighbor_id"))
    others = near.join(firsts, ["vector_type", "c"]).select("vector_type", "q", "neighbor_id", "cos")
    own = firsts.select("vector_type", F.col("c").alias("q"), "neighbor_id", F.lit(1.0).alias("cos"))
    order = [F.desc("cos"), F.col("neighbor_id")]
    top = others.unionByName(own).withColumn("i", F.row_number().over(Window.partitionBy("vector_type", "q").orderBy(*order))).where(F.col("i") <= k + 1)
    each = members.select("vector_type", F.col("v").alias("q"), "track_id").join(top, ["vector_type", "q"]).where(F.col("track_id") != F.col("neighbor_id"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("vector_type", "track_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("vector_type", "track_id", "neighbor_id", "cos", "rank")


#: Cells that hold the code of a vector, by type; "" is for types not named, "root" times the root of all cells.
#: Pairs of high cosine share near cells; the nearest of vectors without close ones are spread over many.
CLOSE_PROBES, DEFAULT_PROBES = {"": 24}, {"": 32, "root": 4.2}


def close_pairs(vectors: DataFrame, k: int = 10, least: float = 0.85) -> DataFrame:
    """``vector_type, track_id_a, track_id_b`` (smaller first): at least one is among the k nearest of
    the other, and their cosine is at least ``least``."""
    near = nearest(vectors, k, least, CLOSE_PROBES, 64)
    return near.select("vector_type", F.least("track_id", "neighbor_id").alias("track_id_a"), F.greatest("track_id", "neighbor_id").alias("track_id_b")).distinct()

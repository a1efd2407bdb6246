"""Earlier pairs of a user that are near what a session asks for, without pairing the user's sessions.

A user's tracks come with their vectors once into one task, which compares them with each other and knows which session is before
which, so only what is found leaves it.  Users of many rows are cut into cells: a part of what was heard meets a part of the targets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows heard and asked for of a cell (of that order; tracks are asked for repeatedly), scores held at a time, rows of a batch of results.
MOST_HEARD, MOST_ASKED, MOST_SCORES, BATCH_ROWS = 1 << 15, 1 << 16, 1 << 20, 1 << 16
DIGITS = 6


def scored_before(pairs: DataFrame, targets: DataFrame, wanted: DataFrame, vectors: DataFrame, threshold: float, k: int) -> DataFrame:
    """``target, n, place, turn_number, track_id, sim``: what ``history.score_pairs`` takes from ``history.before``.

    ``wanted``: target, track_id (whose vector the target asks for).
    """
    heard = pairs.select("user_id", "track_id", F.col("session_id").alias("_x"), F.col("session_date").alias("_date"), F.array(F.struct(F.col("session_date").alias("date"), "session_id", "place", "turn_number")).alias("h"))
    rows = _cells(heard, wanted.join(targets, "target"), [vectors])
    found = rows.mapInArrow(lambda batches: _run(batches, _score, threshold, k), "target string, place int, turn_number int, track_id string, sim double")
    n = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("sim"), "place", "turn_number", "track_id"))
    return found.withColumn("n", n).where(F.col("n") <= k).select("target", "n", "place", "turn_number", "track_id", "sim")


def relevant_before(pairs: DataFrame, targets: DataFrame, candidates: DataFrame, signals: list[tuple[DataFrame, float]]) -> DataFrame:
    """``target, track_id``: what ``history.relevant_priors`` takes from ``history.before``.

    Of a track's sessions, the two of the earliest dates tell of every target whether one is before it.
    """
    session = F.struct(F.col("session_date").isNull().alias("undated"), F.col("session_date").alias("date"), "session_id")
    first = pairs.groupBy("user_id", "track_id").agg(F.slice(F.array_sort(F.collect_set(session)), 1, 2).alias("h"))
    heard = first.select("user_id", "track_id", F.col("track_id").alias("_x"), F.col("h")[0]["date"].alias("_date"), "h")
    rows = _cells(heard, candidates.select("target", F.col("candidate").alias("track_id")).distinct().join(targets, "target"), [v for v, _ in signals])
    least = [x for _, x in signals]
    return rows.mapInArrow(lambda batches: _run(batches, _relevant, least), "target string, track_id string")


def _cells(heard: DataFrame, asked: DataFrame, vectors: list[DataFrame]) -> DataFrame:
    """``user_id, i, j, track_id, h, w, v0, ...``, in order of the cells (user_id, i, j): a track that the user heard (h) or a target asks for (w).

    ``heard``: user_id, track_id, _x (rows of one value stay together), _date (of the earliest), h; ``asked``: user_id, track_id, target, target_date.
    """
    from ..session import ship

    ship(heard.sparkSession)
    asked = asked.select("user_id", "track_id", F.col("target").alias("_x"), F.col("target_date").alias("_date"), F.struct("target", F.col("target_date").alias("date")).alias("w"))
    rows = heard.withColumn("w", F.lit(None).cast(asked.schema["w"].dataType)).unionByName(asked.withColumn("h", F.lit(None).cast(heard.schema["h"].dataType)))
    user, is_heard, date = Window.partitionBy("user_id"), F.col("w").isNull(), F.col("_date")
    parts = lambda x, most: F.ceil(F.count(F.when(x, 1)).over(user) / most).cast("int")
    rows = rows.withColumns({
        "_hs": parts(is_heard, MOST_HEARD), "_ws": parts(~is_heard, MOST_ASKED), "_first": F.min(F.when(is_heard, date)).over(user), "_last": F.max(F.when(~is_heard, date)).over(user),
        "_all": F.max(~is_heard & date.isNull()).over(user),
    })
    # What is heard on the last date is before no target, and nothing is before the targets of the first date.
    inside = F.col("_all") | F.coalesce(F.when(is_heard, date < F.col("_last")).otherwise(F.col("_first") < date), F.lit(False))
    rows = rows.where((F.col("_hs") > 0) & (F.col("_ws") > 0) & inside)
    part = lambda n: F.pmod(F.xxhash64("_x"), F.col(n)).cast("int")
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    theirs = F.transform(F.sequence(F.lit(0), F.col("_ws") - 1), lambda j: cell(part("_hs"), j))
    mine = F.transform(F.sequence(F.lit(0), F.col("_hs") - 1), lambda i: cell(i, part("_ws")))
    rows = rows.withColumn("_c", F.explode(F.when(is_heard, theirs).otherwise(mine))).select("user_id", F.col("_c.i").alias("i"), F.col("_c.j").alias("j"), "track_id", "h", "w")
    tracks = rows.groupBy("user_id", "i", "j", "track_id").agg(F.flatten(F.collect_list("h")).alias("h"), F.collect_list("w").alias("w"))
    whole = [v.where(F.forall("vector", lambda x: x.isNotNull())).select("track_id", F.col("vector").alias(f"v{n}")) for n, v in enumerate(vectors)]
    tracks = reduce(lambda a, b: a.join(b, "track_id", "left"), whole, tracks).where(F.coalesce(*(f"v{n}" for n in range(len(whole)))).isNotNull())
    return tracks.repartition("user_id", "i", "j").sortWithinPartitions("user_id", "i", "j")


def _run(batches, work, *args):
    """What ``work`` finds in each cell, as record batches."""
    import pyarrow as pa

    for table in _whole_cells(batches):
        rows, held, n = _Rows(table), [], 0
        for a, b in zip(rows.starts[:-1], rows.starts[1:], strict=True):
            for found in work(rows, a, b, *args):
                held.append(found)
                n += found.num_rows
                if n >= BATCH_ROWS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH_ROWS)
                    held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _changes(batch) -> list[int]:
    """Rows that begin another cell than the row before."""
    import numpy as np

    new = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for name in ("user_id", "i", "j"):
        x = batch.column(name)
        codes = (x.combine_chunks() if hasattr(x, "combine_chunks") else x).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return (np.flatnonzero(new) + 1).tolist()


def _whole_cells(batches):
    """Tables of one cell or several."""
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        first, last = (tuple(batch.column(c)[at].as_py() for c in ("user_id", "i", "j")) for at in (0, batch.num_rows - 1))
        if held and first != key:
            table, held = pa.Table.from_batches(held).combine_chunks(), []
            yield table
        if cuts := _changes(batch):
            table, held = pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]).combine_chunks(), []
            yield table
            batch = batch.slice(cuts[-1])
        held.append(batch)
        key = last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _ranks(*columns):
    """Places of strings in the order of all of them, -1 for null."""
    import numpy as np
    import pyarrow as pa

    coded = pa.chunked_array([c.cast(pa.string()) for c in columns]).combine_chunks().dictionary_encode()
    words = np.array(coded.dictionary.to_pylist(), dtype=object)
    rank = np.full(len(words) + 1, -1, dtype=np.int64)
    rank[np.argsort(words)] = np.arange(len(words))
    ranks = rank[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    return np.split(ranks, np.cumsum([len(c) for c in columns])[:-1])


class _Rows:
    """Columns of a table: rows are tracks; ``h`` and ``w`` are flat lists, those of row r from offset r on."""

    def __init__(self, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        one = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        self.n = table.num_rows
        self.starts = np.array([0, *_changes(table), self.n])
        self.track = one(table["track_id"])
        (self.track_rank,) = _ranks(self.track)
        lists = {c: one(pc.list_flatten(table[c])) for c in "hw"}
        self.offset = {c: np.concatenate([[0], np.cumsum(pc.list_value_length(one(table[c])).fill_null(0).to_numpy(zero_copy_only=False))]) for c in "hw"}
        field = lambda c, name: one(pc.struct_field(lists[c], name))
        self.h_date, self.w_date = _ranks(field("h", "date"), field("w", "date"))
        self.h_session, self.w_target = _ranks(field("h", "session_id"), field("w", "target"))
        self.target = field("w", "target")
        names = [f.name for f in lists["h"].type]
        self.place, self.turn = ((field("h", c).fill_null(-(1 << 31)).to_numpy(zero_copy_only=False) if c in names else None) for c in ("place", "turn_number"))
        self.turns = field("h", "turn_number") if "turn_number" in names else None
        self.signals = []
        while (name := f"v{len(self.signals)}") in table.column_names:
            self.signals.append(_Vectors(one(table[name])))

    def sides(self, a: int, b: int, s: int):
        """Rows of a cell with a vector that are heard, and that are asked for."""
        import numpy as np

        has = self.signals[s].at[a:b] >= 0
        return tuple(a + np.flatnonzero(has & (np.diff(self.offset[c][a : b + 1]) > 0)) for c in "hw")

    def before(self, h, w):
        """Whether items h are before targets w and not their own."""
        return (self.h_session[h] != self.w_target[w]) & ((self.w_date[w] < 0) | ((self.h_date[h] >= 0) & (self.h_date[h] < self.w_date[w])))


class _Vectors:
    """Vectors of rows (shorter ones filled up), ``at`` tells where; none of length 0."""

    def __init__(self, column):
        import numpy as np
        import pyarrow.compute as pc

        size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
        rows, begin = np.flatnonzero(size > 0), np.cumsum(size) - size
        self.size = size[rows]
        sizes = np.unique(self.size)
        self.mixed = len(sizes) > 1
        self.raw = np.zeros((len(rows), sizes.max()), dtype=flat.dtype) if self.mixed else flat.reshape(len(rows), sizes[0] if len(sizes) else 0)
        for d in sizes if self.mixed else ():
            own = np.flatnonzero(self.size == d)
            self.raw[own, :d] = flat[begin[rows[own]][:, None] + np.arange(d)]
        self.norm = np.empty(len(rows))
        self.unit = np.zeros(self.raw.shape, dtype=np.float32)
        for i in range(0, len(rows), 4096):
            x = self.raw[i : i + 4096].astype(np.float64)
            self.norm[i : i + 4096] = norm = np.sqrt((x * x).sum(1))
            with np.errstate(all="ignore"):
                self.unit[i : i + 4096] = x / norm[:, None]
        self.at = np.full(len(size), -1, dtype=np.int64)
        self.at[rows] = np.where(self.norm == 0, -1, np.arange(len(rows)))
        # More than the error of a product of unit vectors in single precision, and what rounding adds.
        self.margin = (self.raw.shape[1] + 8) * 1.2e-7 + 10**-DIGITS

    def guess(self, left, right):
        """About the cosines of rows, one way only; -inf where the lengths differ."""
        import numpy as np

        x, y = self.at[left], self.at[right]
        g = self.unit[x] @ self.unit[y].T
        if self.mixed:
            g[self.size[x][:, None] != self.size[y]] = -np.inf
        return g

    def cosine(self, left, right):
        """Rounded cosines of pairs of rows."""
        import numpy as np

        out, step = np.empty(len(left)), max(1, MOST_SCORES // max(1, self.raw.shape[1]))
        for i in range(0, len(left), step):
            x, y = self.at[left[i : i + step]], self.at[right[i : i + step]]
            dot = (self.raw[x].astype(np.float64) * self.raw[y].astype(np.float64)).sum(1)
            with np.errstate(all="ignore"):
                out[i : i + step] = dot / (self.norm[x] * self.norm[y])
        return np.sign(out) * np.floor(np.abs(out) * 10**DIGITS + 0.5) / 10**DIGITS


def _spans(first, size):
    """The numbers first[i], first[i] + 1, ... (size[i] of them), and their i."""
    import numpy as np

    owner = np.repeat(np.arange(len(size)), size)
    return first[owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner], owner


def _score(rows: _Rows, a: int, b: int, threshold: float, k: int):
    import numpy as np
    import pyarrow as pa

    v = rows.signals[0]
    heard, asked = rows.sides(a, b, 0)
    if not len(heard) or not len(asked):
        return
    h, of = _spans(rows.offset["h"][heard], np.diff(rows.offset["h"])[heard])
    w, by = _spans(rows.offset["w"][asked], np.diff(rows.offset["w"])[asked])
    order = np.lexsort((rows.track_rank[heard[of]], rows.turn[h], rows.place[h]))
    h, of = h[order], of[order]
    step = max(1, MOST_SCORES // len(h))
    for at in range(0, len(w), step):
        ws, bs = w[at : at + step], by[at : at + step]
        g = v.guess(asked[bs], heard)[:, of]
        g[np.isnan(g)] = np.inf  # not a number is more than any
        g[~rows.before(h[None, :], ws[:, None]) | (g < threshold - v.margin)] = -np.inf
        least = np.partition(g, len(h) - k, axis=1)[:, len(h) - k, None] - 2 * v.margin if len(h) > k else -np.inf
        r, c = np.nonzero((g > -np.inf) & (g >= least))
        sim = v.cosine(asked[bs[r]], heard[of[c]])
        r, c, sim = (x[~(sim < threshold)] for x in (r, c, sim))
        best = np.lexsort((c, -np.where(np.isnan(sim), np.inf, sim), r))
        r, c, sim = r[best], c[best], sim[best]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c, sim = r[top], c[top], sim[top]
        if len(r):
            columns = [rows.target.take(pa.array(ws[r])), pa.array(rows.place[h[c]].astype(np.int32)), rows.turns.take(pa.array(h[c])).cast(pa.int32()), rows.track.take(pa.array(heard[of[c]])), pa.array(sim)]
            yield pa.RecordBatch.from_arrays(columns, ["target", "place", "turn_number", "track_id", "sim"])


def _relevant(rows: _Rows, a: int, b: int, least: list[float]):
    import numpy as np
    import pyarrow as pa

    keys, items = [], []
    for s, (v, t) in enumerate(zip(rows.signals, least, strict=True)):
        heard, asked = rows.sides(a, b, s)
        if not len(heard):
            continue
        step = max(1, MOST_SCORES // len(heard))
        for at in range(0, len(asked), step):
            bs = asked[at : at + step]
            g = v.guess(bs, heard)
            y, x = np.nonzero(~(g < t - v.margin))
            g = g[y, x]
            y, x = bs[y], heard[x]
            unsure = np.flatnonzero(np.abs(g - t) <= v.margin)
            near = np.ones(len(g), dtype=bool)
            near[unsure] = ~(v.cosine(x[unsure], y[unsure]) < t)
            x, y = x[near], y[near]
            h, pair = _spans(rows.offset["h"][x], np.diff(rows.offset["h"])[x])
            w, item = _spans(rows.offset["w"][y[pair]], np.diff(rows.offset["w"])[y[pair]])
            x, h = x[pair[item]], h[item]
            ok = rows.before(h, w)
            key, one = np.unique(rows.w_target[w[ok]] * rows.n + x[ok], return_index=True)
            keys.append(key)
            items.append(w[ok][one])
    if keys:
        key, one = np.unique(np.concatenate(keys), return_index=True)
        if len(key):
            w = np.concatenate(items)[one]
            yield pa.RecordBatch.from_arrays([rows.target.take(pa.array(w)), rows.track.take(pa.array(key % rows.n))], ["target", "track_id"])

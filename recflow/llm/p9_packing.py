"""Filling containers of fixed capacity with documents, measured in tokens.

A document longer than a container gives full containers of its own and a rest; a document is
split in no other case.  Rests and shorter documents are dealt by hash to blocks of about
``BLOCK_ITEMS`` items.  Each block is filled best-fit by falling size and then improved by local
search over all its underfull bins: documents are moved, exchanged one for one or two for one, always such
that the sum of squared fills rises, until bins empty or no exchange helps.  Of each block the emptiest
bins are taken apart again and packed with those of ``FAN_IN`` other blocks, level by level; a block
passes on its share of the items of one block.  So at the end the whole corpus has about as many underfull
containers as one block.

A block is bounded on every level, whatever the data: items are dealt by a hash of their id, and the
blocks of one group pass on BLOCK_ITEMS items at most.  Bins that are not passed on stay as they are; no item is dropped.

Edge cases: null and empty texts have no tokens and take no container (container is null);
repeated rows are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .p8_tokens import token_ids

CAPACITY = 2048
#: Items of a block, and blocks whose emptiest bins are packed together on the next level, as one block.
BLOCK_ITEMS, FAN_IN = 8192, 32


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: items by falling size, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (free space, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = free.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(free, (left, b))
    return bins


class _Search:
    """Local search over bins.  Which totals of one and of two items the bins can give is kept as an index
    from total to bins and, for each bin and for all, as bits of an integer, so the best exchange of a bin
    with any emptier one is found without looking at pairs of bins."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.holders: tuple[dict, dict] = ({}, {})  # total of one or two items -> bins
        self.every = [0, 0]
        self.totals: dict[int, tuple[set, set]] = {}

    def _totals(self, k: int) -> tuple[set, set]:
        counts: dict[int, int] = {}
        for i in self.bins[k]:
            counts[self.sizes[i]] = counts.get(self.sizes[i], 0) + 1
        kinds = sorted(counts)
        return set(kinds), {a + b for n, a in enumerate(kinds) for b in kinds[n:] if a != b or counts[a] > 1}

    def enter(self, k: int) -> None:
        self.totals[k] = self._totals(k)
        for of in (0, 1):
            for y in self.totals[k][of]:
                at = self.holders[of].setdefault(y, set())
                if not at:
                    self.every[of] |= 1 << y
                at.add(k)

    def leave(self, k: int) -> None:
        for of, totals in enumerate(self.totals.pop(k)):
            for y in totals:
                at = self.holders[of][y]
                at.discard(k)
                if not at:
                    self.every[of] &= ~(1 << y)

    def _donor(self, of: int, y: int, k: int) -> int | None:
        """The emptiest bin, no fuller than k, that can give a total of y."""
        able = [j for j in self.holders[of].get(y, ()) if j != k and (self.fill[j], j) < (self.fill[k], k)]
        return min(able, key=lambda j: (self.fill[j], j), default=None)

    def best(self, k: int):
        """(bin that gives, total out of k, items of it, total into k, items of it) with the largest gain."""
        free = self.capacity - self.fill[k]
        one, two = self.totals[k]
        best, gain = None, 0
        # Nothing or one item against one or two; two items against one.
        for outs, n_out, kinds in (((0,), 0, (0, 1)), (one, 1, (0, 1)), (two, 2, (0,))):
            for x in outs:
                for of in kinds:
                    held = (self.every[of] >> (x + 1)) & ((1 << max(0, min(free, self.fill[k] - x))) - 1)  # an emptier bin gives no more than k has
                    while held:
                        g = held.bit_length()
                        if g <= gain:
                            break
                        donor = self._donor(of, x + g, k)
                        if donor is not None:
                            best, gain = (donor, x, n_out, x + g, of + 1), g
                            break
                        held &= ~(1 << (g - 1))
                if gain == free:
                    return best
        return best

    def _pick(self, k: int, total: int, n: int) -> list[int]:
        if n < 2:
            return [next(i for i in self.bins[k] if self.sizes[i] == total)] if n else []
        first: dict[int, int] = {}
        for i in self.bins[k]:
            if total - self.sizes[i] in first:
                return [first[total - self.sizes[i]], i]
            first.setdefault(self.sizes[i], i)
        raise AssertionError("no two items of this total")

    def step(self, k: int) -> bool:
        found = self.best(k)
        if found is None:
            return False
        donor, out, n_out, into, n_in = found
        gone, come = self._pick(k, out, n_out), self._pick(donor, into, n_in)
        for j, less, more in ((k, gone, come), (donor, come, gone)):
            self.leave(j)
            self.bins[j] = [i for i in self.bins[j] if i not in less] + more
            self.fill[j] += sum(self.sizes[i] for i in more) - sum(self.sizes[i] for i in less)
            if self.bins[j] and self.fill[j] < self.capacity:
                self.enter(j)
        return True

    def run(self) -> list[list[int]]:
        for k in range(len(self.bins)):
            if self.fill[k] < self.capacity:
                self.enter(k)
        moved = True
        while moved:
            moved = False
            for k in sorted(self.totals, key=lambda k: (-self.fill[k], k)):
                while k in self.totals and self.step(k):
                    moved = True
        return [b for b in self.bins if b]


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over all underfull bins; each step raises the sum of squared fills.

    A bin of fill a takes items of total y for items of total x out of a bin of fill b <= a, x < y <= x + free
    space: that raises a*a + b*b.  Steps: (0, 1) and (0, 2) moves, (1, 1), (1, 2) and (2, 1) exchanges.  Of each
    bin the step that fills it most is taken, with the emptiest bin that allows it.
    """
    return _Search([list(b) for b in bins], sizes, capacity).run()


def _pack_block(key, frame, capacity: int, level: int, passed: int):
    frame = frame.sort_values(["n_tokens", "item"], ascending=[False, True], kind="stable")
    sizes = frame["n_tokens"].astype(int).tolist()
    bins = improve(best_fit(sizes, capacity), sizes, capacity)
    fills = [sum(sizes[i] for i in members) for members in bins]
    block = key[0]
    container, fill, loose, left = [None] * len(sizes), [0] * len(sizes), [False] * len(sizes), passed
    for k in sorted(range(len(bins)), key=lambda k: (fills[k], k)):
        passes = fills[k] < capacity and len(bins[k]) <= left
        left = left - len(bins[k]) if passes else 0
        for i in bins[k]:
            container[i], fill[i], loose[i] = f"{level}-{block}-{k}", fills[k], passes
    return frame.assign(container=container, fill=fill, loose=loose)[["item", "n_tokens", "container", "fill", "block", "loose"]]


def _packer(capacity: int, level: int, passed: int):
    return lambda key, frame: _pack_block(key, frame, capacity, level, passed)


def pack_items(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``item, n_tokens, container, fill`` for items (unique ``item`` string, ``n_tokens`` in 1..capacity)."""
    items = materialize(items.select("item", "n_tokens"), "pack-items")
    count = items.count()
    blocks = max(1, -(-count // block_items))
    schema = "item string, n_tokens int, container string, fill int, block int, loose boolean"
    loose = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    done, level = [], 0
    while True:
        passed = max(1, block_items // min(FAN_IN, blocks))
        packed = loose.groupBy("block").applyInPandas(_packer(capacity, level, passed), schema)
        if blocks == 1:
            done.append(packed)
            break
        packed = materialize(packed, f"pack-{level}")
        done.append(packed.where(~F.col("loose")))
        loose = packed.where("loose").select("item", "n_tokens", F.floor(F.col("block") / FAN_IN).cast("int").alias("block"))
        blocks, level = -(-blocks // FAN_IN), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("item", "n_tokens", "container", "fill")


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens, container, fill``; one row per placed piece of a text."""
    sizes = materialize(token_ids(documents, vocabulary, lengths=True).withColumn("copy", F.monotonically_increasing_id()), "pack-sizes")
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = (F.col("n_tokens") % capacity).cast("int")
    item = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string"))
    sizes = sizes.withColumn("item", item)
    whole = (
        sizes.where(full > 0)
        .select("doc_id", "item", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), F.lit(capacity).alias("n_tokens"), F.concat_ws("-", F.lit("w"), "item", F.col("piece").cast("string")).alias("container"), F.lit(capacity).alias("fill"))
    )
    packed = pack_items(sizes.where(rest > 0).select("item", rest.alias("n_tokens")), capacity, block_items)
    rests = (
        sizes.where(rest > 0).select("doc_id", "item", full.alias("piece")).join(packed, "item")
        .select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), "n_tokens", "container", "fill")
    )
    none = sizes.where(F.col("n_tokens") == 0).select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("first_token"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("fill"))
    return whole.unionByName(rests).unionByName(none)


def fill_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``n_containers, n_tokens, n_bound, share_filled``; n_bound is the least number possible by volume."""
    placed = containers.where(F.col("container").isNotNull())
    return placed.agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")).select(
        "n_containers",
        "n_tokens",
        F.ceil(F.col("n_tokens") / capacity).alias("n_bound"),
        F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 4).alias("share_filled"),
    )

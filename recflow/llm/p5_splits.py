"""Train, validation and test splits that keep related records together.

1. Sessions and known users are the two sides of a graph; records of one component go to one
   split.  A record whose session has no known user is tied to its session only.
2. Components of the same size and label profile (the shares of their labels, in quarters) form a
   bundle.  Sizes of N records take at most sqrt(2 N) different values and labels are few, so bundles
   are a small table.
3. A min-cost flow over labels, giants and splits gives the rows that each split should get of
   each (most frequent) label: a split's quota and its quota of each label are free up to the quota and
   cost by the row beyond.  Components larger than the smallest quota are nodes of their own; from the
   largest on, each goes whole where most of it flows, and the flow is solved again around it.
4. The flow is rounded to whole components, bundle by bundle from the largest size down, each bundle
   in the proportions of its label's flow and making up for the rounding of those before it.
5. Members of a bundle are ranked by a hash of the component and cut at the planned counts.
   The rank is built from counts per hash bucket, so that a bundle of a third of all
   components is never sorted in one task.

Edge cases: a null session_id makes a record a component of its own; blank users are unknown;
repeated rows are rows; with no rows there is no output.  Fewer components than splits leave
splits empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rows, dealt_join, materialize, session_key

SPLITS = ("train", "validation", "test")
SHARES = (0.8, 0.1, 0.1)
#: Buckets by which members of one bundle are ranked, and bundles that fit the driver.
BUCKETS, MOST_BUNDLES = 1024, 2_000_000
#: Labels that have quotas of their own (rarer ones share one), and what separates the parts of a profile.
MOST_LABELS, BETWEEN, WITHIN = 64, "\x1f", "\x1e"
#: Cost of a row beyond a split's quota, against 1 for a row beyond a label's quota in a split.
SPLIT_COST = 10


def users_of_sessions(sessions: DataFrame) -> DataFrame:
    """``session, user`` for each known user of a session; distinct."""
    user = F.trim("user_id")
    return (
        sessions.select(session_key(F.col("session_id")).alias("session"), user.alias("user"))
        .where(F.col("session").isNotNull() & (F.length("user") > 0))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``session, component`` of the graph of (session, user) edges, by label propagation.

    A user's label is the least label of the users it shares a session with; each round also
    takes the label of the label, so the number of rounds follows the logarithm of the longest
    chain.  Where each session has one user, the first round changes nothing and is the last.
    """
    edges = materialize(edges, "split-edges")
    labels = edges.select("user").distinct().withColumn("label", F.col("user"))
    while True:
        by_session = edges.join(labels, "user").groupBy("session").agg(F.min("label").alias("label"))
        near = edges.join(by_session, "session").groupBy("user").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("user").alias("near"), F.col("label").alias("far"))
        after = materialize(near.join(jump, "near").join(labels, "user").select("user", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")), "split-labels")
        labels = after.select("user", "label")
        if after.where("moved").isEmpty():
            return edges.join(labels, "user").groupBy("session").agg(F.min("label").alias("component"))


class _Network:
    """Min-cost flow by successive shortest paths, for networks of a few hundred arcs."""

    def __init__(self):
        self.arcs: list[list] = []  # to, capacity left, cost; the reverse arc is i ^ 1
        self.out: dict[object, list[int]] = {}

    def arc(self, a, b, capacity: float, cost: float) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def flow(self, i: int) -> float:
        return self.arcs[i ^ 1][1]

    def solve(self, source, sink) -> None:
        while True:
            far, via, queue = {source: 0.0}, {}, [source]
            while queue:
                x = queue.pop(0)
                for i in self.out.get(x, ()):
                    y, left, cost = self.arcs[i]
                    if left > 0 and far[x] + cost < far.get(y, float("inf")) - 1e-9:
                        far[y], via[y] = far[x] + cost, i
                        if y not in queue:
                            queue.append(y)
            if sink not in via:
                return
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.arcs[via[at] ^ 1][0]
            most = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= most
                self.arcs[i ^ 1][1] += most


def dominant(profile: str) -> str:
    """The most frequent label of a profile."""
    return profile.split(BETWEEN)[0].split(WITHIN)[0]


def _solve(rows: dict[str, int], giants: list[tuple[int, str]], fixed: dict[int, int], shares) -> tuple[dict[str, list[float]], list[list[float]]]:
    """Rows per split of each label's small components and of each giant; ``fixed`` giants have their split."""
    totals = dict(rows)
    for size, label in giants:
        totals[label] = totals.get(label, 0) + size
    total, splits = sum(totals.values()), range(len(shares))
    net, arcs, giant_arcs = _Network(), {}, {}
    for k in splits:
        net.arc(("split", k), "sink", total * shares[k], 0)
        net.arc(("split", k), "sink", total, SPLIT_COST)
        for label, n in totals.items():
            net.arc(("part", k, label), ("split", k), n * shares[k], 0)
            net.arc(("part", k, label), ("split", k), n, 1)
    for i, (size, label) in enumerate(giants):
        net.arc("source", ("giant", i), size, 0)
        for k in splits:
            if fixed.get(i, k) == k:
                giant_arcs[i, k] = net.arc(("giant", i), ("part", k, label), size, 0)
    for label, n in rows.items():
        net.arc("source", ("label", label), n, 0)
        for k in splits:
            arcs[label, k] = net.arc(("label", label), ("part", k, label), n, 0)
    net.solve("source", "sink")
    flow = {label: [net.flow(arcs[label, k]) for k in splits] for label in rows}
    return flow, [[net.flow(giant_arcs[i, k]) if (i, k) in giant_arcs else 0.0 for k in splits] for i in range(len(giants))]


def plan_bundles(bundles: list[tuple[str, int, int]], shares=SHARES) -> dict[tuple[str, int], list[int]]:
    """(profile, size) -> whole components for each split, of (profile, size, number of components)."""
    total, splits = sum(size * n for _, size, n in bundles), range(len(shares))
    of_label: dict[str, int] = {}
    for profile, size, n in bundles:
        of_label[dominant(profile)] = of_label.get(dominant(profile), 0) + size * n
    known = set(sorted(of_label, key=lambda x: (-of_label[x], x))[:MOST_LABELS])
    label_of = lambda profile: dominant(profile) if dominant(profile) in known else ""
    least = max(1, min(int(total * s) for s in shares if s > 0))
    rows: dict[str, int] = {}
    giants: list[tuple[int, str]] = []
    giant_keys: list[tuple[str, int]] = []
    plan = {(profile, size): [0] * len(shares) for profile, size, _ in bundles}
    left = [total * s for s in shares]
    ordered = sorted(bundles, key=lambda b: (-b[1], b[0]))
    for profile, size, n in ordered:
        if size > least:
            giants += [(size, label_of(profile))] * n
            giant_keys += [(profile, size)] * n
        else:
            rows[label_of(profile)] = rows.get(label_of(profile), 0) + size * n
    fixed: dict[int, int] = {}
    while True:
        flow, of_giants = _solve(rows, giants, fixed, shares)
        if len(fixed) == len(giants):
            break
        # The largest giant goes whole where most of it flows; the others are solved again around it.
        i = len(fixed)
        fixed[i] = max(splits, key=lambda k: (of_giants[i][k], left[k], -k))
        left[fixed[i]] -= giants[i][0]
        plan[giant_keys[i]][fixed[i]] += 1
    for profile, size, n in ordered:
        if size > least:
            continue
        room = flow[label_of(profile)]
        of = sum(max(0.0, f) for f in room) or 1.0
        counts = [int(n * max(0.0, r) / of) for r in room]
        for k in splits:
            room[k] -= counts[k] * size
        for _ in range(n - sum(counts)):
            k = max(splits, key=lambda k: (room[k], -k))
            counts[k] += 1
            room[k] -= size
        for k in splits:
            plan[profile, size][k] += counts[k]
            left[k] -= counts[k] * size
    _even_out(plan, left)
    return plan


def _even_out(plan: dict[tuple[str, int], list[int]], left: list[float]) -> None:
    """Move single components from overfull to underfull splits while that brings both nearer to their quotas."""
    sizes = sorted(plan, key=lambda b: (-b[1], b[0]))
    while True:
        over, under = min(range(len(left)), key=lambda k: left[k]), max(range(len(left)), key=lambda k: left[k])
        gain = lambda size: abs(left[over]) + abs(left[under]) - abs(left[over] + size) - abs(left[under] - size)
        best = max((b for b in sizes if plan[b][over]), key=lambda b: gain(b[1]), default=None)
        if best is None or gain(best[1]) <= 1e-9:
            return
        plan[best][over] -= 1
        plan[best][under] += 1
        left[over] += best[1]
        left[under] -= best[1]


def assign_splits(records: DataFrame, sessions: DataFrame, shares=SHARES, label: str = "source") -> DataFrame:
    """``pair_id, session_id, turn_number, component, split`` of each row of ``records``."""
    tied = components(users_of_sessions(sessions))
    lone = F.when(F.col("session").isNull(), F.concat(F.lit("row:"), F.col("pair_id").cast("string"))).otherwise(F.concat(F.lit("session:"), F.col("session")))
    rows = records.select("pair_id", "session_id", "turn_number", session_key(F.col("session_id")).alias("session"), F.coalesce(F.col(label), F.lit("")).alias("label"))
    rows = materialize(rows.join(tied, "session", "left").withColumn("component", F.coalesce(F.concat(F.lit("user:"), "component"), lone)), "split-rows")
    by_label = rows.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    sized = by_label.groupBy("component").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))).alias("labels"))
    quarters = F.transform("labels", lambda x: F.struct(x["label"].alias("label"), F.round(-4 * x["m"] / F.col("size")).cast("int").alias("q")))
    parts = F.transform(F.filter(quarters, lambda x: x["q"] > 0), lambda x: F.concat(x["label"], F.lit(WITHIN), x["q"].cast("string")))
    sized = sized.select("component", "size", F.when(F.size(parts) > 0, F.array_join(parts, BETWEEN)).otherwise(F.col("labels")[0]["label"]).alias("label"))
    sized = materialize(sized.withColumn("h", F.xxhash64("component")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")), "split-components")
    counts = sized.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    plan = plan_bundles([(r["label"], r["size"], r["n"]) for r in bounded_rows(counts, MOST_BUNDLES)], shares)
    spark = records.sparkSession
    planned = spark.createDataFrame([(k[0], k[1], v[0], v[0] + v[1]) for k, v in plan.items()], "label string, size bigint, to_train bigint, to_validation bigint")
    before = Window.partitionBy("label", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("label", "size", "bucket").agg(F.count(F.lit(1)).alias("n")).select("label", "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("label", "size", "bucket").orderBy("h", "component")
    ranked = sized.withColumn("r", F.row_number().over(inside)).join(offsets, ["label", "size", "bucket"]).withColumn("rank", F.col("r") + F.col("offset"))
    placed = ranked.join(planned, ["label", "size"]).select(
        "component",
        F.when(F.col("rank") <= F.col("to_train"), SPLITS[0]).when(F.col("rank") <= F.col("to_validation"), SPLITS[1]).otherwise(SPLITS[2]).alias("split"),
    )
    return dealt_join(rows, materialize(placed, "split-placed"), ["component"]).select("pair_id", "session_id", "turn_number", "component", "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """``split, n_rows, n_components, share``."""
    per = assigned.groupBy("split", "component").agg(F.count(F.lit(1)).alias("n"))
    sums = per.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_components"))
    return sums.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 4))

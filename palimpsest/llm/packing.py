"""Items packed into containers of fixed capacity by non-negative least squares on their length histogram.

1. An item over the capacity is cut into full pieces and a remainder; no other is split.
2. Shallow combinations of up to four lengths that fill the window
   [capacity - slack, capacity] are enumerated over the lengths that occur.
3. Non-negative least squares finds repeat counts whose total use of each length
   matches the histogram; they are rounded down.
4. What is left is packed greedily, largest first, whole runs of equal containers
   at a time.

All of it works on the histogram, which has at most ``capacity`` rows however
many items there are.  The plan is one row per length with its ranges of ranks in
order; an item meets that one row and finds its range by binary search.  Null
texts and texts without tokens need no container.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import with_rank
from palimpsest.session import durable

NNLS_STEPS = 400
PER_LENGTH = 12


def enumerate_fills(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Combinations of up to four present lengths with a sum in the window."""
    slack = max(1, capacity // 256)
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    # The most frequent lengths serve as middle items.
    common = lengths[np.argsort(-counts, kind="stable")][:24]
    fills: set[tuple[int, ...]] = set()

    def closing(rest: int) -> int:
        """The largest present length that closes the window, or 0."""
        for c in range(min(rest, capacity), max(0, rest - slack - 1), -1):
            if c > 0 and present[c]:
                return c
        return 0

    for a in map(int, lengths):
        if capacity - slack <= a:
            fills.add((a,))
        found = 0
        if c := closing(capacity - a):
            fills.add(tuple(sorted((a, c), reverse=True)))
        for b in map(int, common):
            if found >= PER_LENGTH or a + b > capacity:
                continue
            if c := closing(capacity - a - b):
                fills.add(tuple(sorted((a, b, c), reverse=True)))
                found += 1
            rest = capacity - a - b
            for m in (rest // 2, rest // 3):
                if m > 0 and present[m] and (c := closing(rest - m)):
                    fills.add(tuple(sorted((a, b, m, c), reverse=True)))
                    found += 1
    return sorted(fills)


def solve_repeats(fills: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient, rows scaled by the histogram's roots."""
    if not fills:
        return np.zeros(0)
    row = np.array([length for f in fills for length in f])
    col = np.array([i for i, f in enumerate(fills) for _ in f])
    scale = 1 / np.sqrt(np.maximum(histogram, 1.0))
    w = scale[row]
    target = histogram * scale
    use = lambda x: np.bincount(row, w * x[col], len(histogram))
    back = lambda r: np.bincount(col, w * r[row], len(fills))
    v = np.ones(len(fills))
    for _ in range(20):
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(fills))
    t = 1.0
    for _ in range(NNLS_STEPS):
        new = np.maximum(0, y - back(use(y) - target) / (1.02 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (length, first rank, end rank, first container, items of it per container) and the number of containers."""
    left = np.zeros(capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    lengths = np.flatnonzero(left)
    plan, used, containers = [], defaultdict(int), 0

    def take(fill: list[tuple[int, int]], times: int) -> None:
        nonlocal containers
        for length, per in fill:
            plan.append((length, used[length], used[length] + per * times, containers, per))
            used[length] += per * times
            left[length] -= per * times
        containers += times

    fills = enumerate_fills(lengths, left[lengths], capacity)
    repeats = solve_repeats(fills, left)
    for i in np.argsort(-repeats, kind="stable"):
        per = {length: fills[i].count(length) for length in fills[i]}
        times = int(min(np.floor(repeats[i] + 1e-9), *(left[length] // n for length, n in per.items())))
        if times > 0:
            take(sorted(per.items()), times)
    # Greedy: fill a container largest first, then repeat it while all its lengths last.
    while left.any():
        rest, fill = capacity, []
        for length in np.flatnonzero(left)[::-1]:
            n = int(min(left[length], rest // length))
            if n:
                fill.append((int(length), n))
                rest -= n * int(length)
            if not rest:
                break
        take(fill, int(min(left[length] // n for length, n in fill)))
    return plan, containers


def pack(items: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """spec_id, key, piece (from 0), tokens, container for items (key, tokens) and (spec_id, capacity) pairs."""
    spark = items.sparkSession
    items = items.where("tokens > 0")
    specs = F.explode(F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in capacities]))
    pieces = items.select("key", "tokens", specs.alias("c")).select("c.*", "key", F.explode(F.sequence(F.lit(0), F.expr("(tokens - 1) div c.capacity"))).alias("piece"), "tokens")
    pieces = durable(pieces.withColumn("tokens", F.least("capacity", F.expr("tokens - piece * capacity"))))
    # At most the capacity's number of rows per spec.
    counted = pieces.groupBy("spec_id", "tokens").count().collect()
    histograms: dict[int, dict[int, int]] = {s: {} for s, _ in capacities}
    for r in counted:
        histograms[r["spec_id"]][r["tokens"]] = r["count"]
    rows = [row for s, c in capacities for row in _by_length(s, plan_containers(histograms[s], c)[0])]
    plan = spark.createDataFrame(rows, "spec_id int, tokens bigint, lo array<bigint>, base array<bigint>, per array<bigint>")
    ranked = with_rank(pieces, ["spec_id", "tokens"], F.struct("key", "piece"), largest=max((r["count"] for r in counted), default=0))
    # The plan is made of fills over at most sum(capacities) lengths: bounded, whatever the number of items.
    placed = ranked.join(F.broadcast(plan), ["spec_id", "tokens"])
    longest = max((len(r[2]) for r in rows), default=1)
    # The last range that starts at or before the rank: steps of falling powers of two.
    jumps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, (longest - 1).bit_length())))])
    placed = placed.withColumn("at", F.aggregate(jumps, F.lit(0), lambda at, j: F.when(F.get("lo", at + j) <= F.col("rank"), at + j).otherwise(at)))
    return placed.select("spec_id", "key", "piece", "tokens", F.expr("get(base, at) + (rank - get(lo, at)) div get(per, at)").alias("container"))


def _by_length(spec: int, plan: list[tuple[int, int, int, int, int]]) -> list[tuple]:
    """One row per length: its ranges' first ranks, first containers and items per container, in order of rank."""
    by: dict[int, list] = defaultdict(list)
    for length, lo, _, base, per in plan:
        by[length].append((int(lo), int(base), int(per)))
    return [(int(spec), int(length), *map(list, zip(*sorted(ranges)))) for length, ranges in by.items()]

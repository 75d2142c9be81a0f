"""Mixed timestamp formats and zones: every valid reading as an array, chosen by Viterbi.

Each record offers its readings (``functions.instants``).  Along each source's
record order a path pays the readings' priors, ``SWITCH`` for each change of
format and ``BACKWARD`` for each jump back in time.  What a clock declares has
priors that no path can outweigh; where nothing is declared (``infer``) the
path decides.

The path is split so that no source is one task: a source's order is cut into
blocks of arrival time, of a day or as much less as keeps the fullest day's
blocks at ``BLOCK_ROWS`` on average.  Records that never arrived come first, in
the order of a hash of their key, cut into as many blocks as they need.  A block
is solved for every pair of its first and last reading (a handful), a block of a
source then is one small row, and one pass over those rows fixes the pairs: one
source has as many of them as its span has blocks, not as it has records.
Records with one reading leave for the result before any Python; beside the
undecided ones only their direct neighbours and the blocks' ends enter it.

Nulls, empty texts and texts without a date give no instant and take no part in
the path.  Ties are broken by id.  Repeated ids count once (the copy that arrived
first, then the smallest text).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.instants import CANDIDATES, DAY_US, RULED_OUT, with_candidates
from palimpsest.session import durable

SWITCH = 1.0
BACKWARD = 2.0
# Readings closer than this are not a jump back: clocks disagree by seconds.
TOLERANCE_US = 60_000_000

BLOCK_ROWS = 500_000

SOLVED = "source string, block bigint, key string, us array<bigint>, heads array<struct<fmt:string,us:bigint>>, tails array<struct<fmt:string,us:bigint>>, cost array<double>"


def step_cost(before: tuple, after: tuple) -> float:
    """Cost of going from one reading to the next, each (fmt, us)."""
    return SWITCH * (before[0] != after[0]) + BACKWARD * (after[1] < before[1] - TOLERANCE_US)


def solve_block(rows: list[tuple[str, list]]) -> tuple[list, list]:
    """Best paths through a block for every pair of first and last reading.

    ``rows`` are (key, [(prior, fmt, us), ...]).  Returns the costs and, per row,
    the chosen instants, both in the order (first 0, last 0), (first 0, last 1) ...
    """
    first, last = rows[0][1], rows[-1][1]
    costs, picks = [], [[] for _ in rows]
    for i in range(len(first)):
        best = [first[i][0] if k == i else float("inf") for k in range(len(first))]
        back = []
        for (_, before), (_, after) in zip(rows, rows[1:]):
            links, now = [], []
            for prior, fmt, us in after:
                j = min(range(len(before)), key=lambda k: (best[k] + step_cost(before[k][1:], (fmt, us)), k))
                links.append(j)
                now.append(best[j] + step_cost(before[j][1:], (fmt, us)) + prior)
            back.append(links)
            best = now
        for j in range(len(last)):
            if len(rows) == 1 and j != i:
                costs.append(float("inf"))
            else:
                costs.append(best[j])
            k = j
            for at in range(len(rows) - 1, -1, -1):
                picks[at].append(rows[at][1][k][2])
                if at:
                    k = back[at - 1][k]
    return costs, picks


def _solve_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Solve the blocks of a partition sorted by source, block and position, one block in memory at a time."""
    name, rows = None, []

    def finish():
        costs, picks = solve_block(rows)
        ends = lambda c: [{"fmt": f, "us": u} for _, f, u in c]
        out = [(*name, key, [int(x) for x in picks[i]], None, None, None) for i, (key, c) in enumerate(rows) if len(c) > 1]
        out.append((*name, None, None, ends(rows[0][1]), ends(rows[-1][1]), [float(x) for x in costs]))
        return pd.DataFrame(out, columns=["source", "block", "key", "us", "heads", "tails", "cost"])

    for pdf in batches:
        done = []
        for source, block, key, candidates in zip(pdf.source, pdf.block, pdf.key, pdf.candidates):
            if (source, block) != name:
                if rows:
                    done.append(finish())
                name, rows = (source, block), []
            rows.append((key, [(c["prior"], c["fmt"], c["us"]) for c in candidates]))
        if done:
            yield pd.concat(done, ignore_index=True)
    if rows:
        yield finish()


def _choose_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pair of first and last reading of each block of one source, by Viterbi over its blocks."""
    pdf = pdf.sort_values("block")
    best, back = None, []
    tails_before: list = []
    for heads, tails, cost in zip(pdf.heads, pdf.tails, pdf.cost):
        heads = [(h["fmt"], h["us"]) for h in heads]
        tails = [(t["fmt"], t["us"]) for t in tails]
        n = len(tails)
        entry = []
        for head in heads:
            if best is None:
                entry.append((0.0, -1))
            else:
                entry.append(min((best[k] + step_cost(tails_before[k], head), k) for k in range(len(best))))
        links, now = [], []
        for j in range(n):
            value, i = min((entry[i][0] + cost[i * n + j], i) for i in range(len(heads)))
            links.append((i, entry[i][1]))
            now.append(value)
        best, tails_before = now, tails
        back.append((n, links))
    k = min(range(len(best)), key=lambda x: (best[x], x))
    pairs = []
    for n, links in reversed(back):
        i, before = links[k]
        pairs.append(i * n + k)
        k = before
    return pd.DataFrame({"source": pdf.source, "block": pdf.block, "pair": pairs[::-1]})


def normalise_timestamps(records: DataFrame, zone: Column, locale: Column, keep: list[str], block_us: int = DAY_US, infer: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One instant per record: columns key, the ``keep`` ones, us (null: none), by_path (several readings that nothing declared were open).

    ``records`` has key (unique), source, text, arrived_us and the ``keep``
    columns.  ``source`` orders the records of one writer; ``arrived_us`` is when a
    record came in, its readings need not follow it.  ``zone`` and ``locale`` are
    columns of ``records`` as in ``with_candidates``.
    """
    n = F.size("candidates")
    read = with_candidates(records, "text", zone, locale, "candidates", infer).select(
        "key",
        *keep,
        F.coalesce("source", F.lit("")).alias("__source"),
        F.col("arrived_us").alias("__arrived"),
        n.alias("__n"),
        F.when(n > 1, F.col("candidates")).alias("__several"),
        F.when(n == 1, F.col("candidates")[0]["fmt"]).alias("__fmt"),
        F.when(n == 1, F.col("candidates")[0]["us"]).alias("__us"),
        (F.size(F.filter("candidates", lambda x: x["prior"] < RULED_OUT)) > 1).alias("by_path"),
    )
    # Read several times below; without the cut each of them would parse all texts again.
    read = durable(read)
    steps = F.count_if(F.col("__n") > 0)
    by_day = read.groupBy("__source", F.expr(f"__arrived div {block_us}").alias("day"))
    fullest = by_day.agg(steps.alias("n")).agg(F.max(F.when(F.col("day").isNotNull(), F.col("n"))).alias("dated"), F.max(F.when(F.col("day").isNull(), F.col("n"))).alias("undated")).first()
    width = max(1, block_us // -(-max(1, fullest["dated"] or 0) // block_rows))
    parts = -(-max(1, fullest["undated"] or 0) // block_rows)
    # Never arrived: by hash, in blocks before all others.
    hashed = F.pmod(F.xxhash64("key"), F.lit(2**32))
    read = read.withColumn("__place", F.when(F.col("__arrived").isNull(), hashed).otherwise(F.col("__arrived")))
    read = read.withColumn("__block", F.when(F.col("__arrived").isNull(), F.expr(f"(__place * {parts}) div {2**32} - {parts} - 1000000000000000")).otherwise(F.expr(f"__place div {width}")))
    # A text without a reading is no step of the path.
    order = W.partitionBy("__source", "__block").orderBy("__place", "key")
    n = F.col("__n")
    flagged = read.where(n > 0).drop(*keep, "by_path").withColumns({"__before": F.lag(n).over(order), "__after": F.lead(n).over(order)})
    end = F.col("__before").isNull() | F.col("__after").isNull()
    one = F.array(F.struct(F.lit(0.0).alias("prior"), F.col("__fmt").alias("fmt"), F.col("__us").alias("us"))).cast(CANDIDATES)
    kept = flagged.where((n > 1) | end | (F.col("__before") > 1) | (F.col("__after") > 1)).select(
        F.col("__source").alias("source"), F.col("__block").alias("block"), "key", F.coalesce("__several", one).alias("candidates")
    )
    # The window's partitioning and order still hold here, so blocks arrive whole and sorted.
    solved = durable(kept.mapInPandas(_solve_partition, SOLVED))
    blocks = solved.where(F.col("key").isNull()).groupBy("source").applyInPandas(_choose_pairs, "source string, block bigint, pair int")
    chosen = solved.where(F.col("key").isNotNull()).join(blocks, ["source", "block"]).select("key", F.col("us")[F.col("pair")].alias("us"))
    single = read.where(n <= 1).select("key", *keep, F.col("__us").alias("us"), "by_path")
    return single.unionByName(read.where(n > 1).select("key", *keep, "by_path").join(chosen, "key"))

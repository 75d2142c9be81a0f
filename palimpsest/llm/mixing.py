"""Sources mixed to target weights by entropy balancing.

Every document gets a rate, 1 tilted exponentially by its tokens, capped at its
source's repeats: the rates closest to 1 in entropy that meet each source's share
of tokens.  The convex dual has one multiplier per source, and each multiplier's
constraint holds tokens of its own source only, so safeguarded Newton iterations
run source by source on the executors, over the counts per (source, tokens).
Rates become copies per (source, tokens) group, longest texts first, with the
tokens still due carried on, so that totals end within a short text of the
target; a group's documents get equal copies, the rest goes to the first by
hashed rank.

The total is the largest for which every source can reach its share within its
repeats, but no more than all tokens.  With ``nearest`` the total is all tokens
instead: a source whose repeats do not suffice gives all it can, and the others
fill up in proportion to their shares.  Documents of a null or unlisted source,
and those without tokens, are not used.  A listed source without tokens cannot
reach any share: it is left out and the other shares are scaled to one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.tokens import with_rank
from palimpsest.session import durable

STEPS = 60
TOLERANCE = 1e-9
MAX_SOURCES = 10_000


def solve_tilt(tokens: np.ndarray, n: np.ndarray, target: float, cap: float, scale: float) -> float:
    """The multiplier for which the tilted, capped rates of one source add up to ``target`` tokens; Newton steps within a bracket."""
    mass, x = n * tokens, tokens / scale
    low, high, tilt = -60.0, 60.0, 0.0
    for _ in range(STEPS):
        raw = np.exp(np.minimum(tilt * x, 50.0))
        gap = float((mass * np.minimum(raw, cap)).sum()) - target
        if abs(gap) <= TOLERANCE * target:
            break
        low, high = (low, tilt) if gap > 0 else (tilt, high)
        slope = float((mass * raw * x)[raw < cap].sum())
        new = tilt - gap / slope if slope > 0 else low
        tilt = new if low < new < high else (low + high) / 2
    return tilt


def copies_of(tokens: np.ndarray, n: np.ndarray, rate: np.ndarray, cap: float) -> list[int]:
    """Whole copies per group of one source, longest first, with the tokens still due carried to the shorter ones."""
    out, due = [0] * len(tokens), 0.0
    for i in np.argsort(-tokens, kind="stable"):
        due += float(tokens[i]) * n[i] * rate[i]
        out[i] = int(min(max(round(due / tokens[i]), 0), n[i] * cap))
        due -= float(tokens[i]) * out[i]
    return out


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    target, cap, scale = (float(pdf[c].iloc[0]) for c in ("target", "cap", "scale"))
    tokens, n = pdf.tokens.to_numpy(float), pdf.n.to_numpy(float)
    rate = np.minimum(np.exp(np.minimum(solve_tilt(tokens, n, target, cap, scale) * tokens / scale, 50.0)), cap)
    return pd.DataFrame({"source": pdf.source, "tokens": pdf.tokens, "n": pdf.n, "copies": copies_of(tokens, n, rate, cap)})


def fill_up(total: float, most: dict[str, float], shares: dict[str, float]) -> dict[str, float]:
    """Tokens per source: in proportion to the shares, where a source's most is reached the others take the rest."""
    out: dict[str, float] = {}
    left = dict(shares)
    while left:
        rest = total - sum(out.values())
        weight = sum(left.values())
        full = {s for s, w in left.items() if rest * w / weight >= most[s]}
        if not full:
            return out | {s: rest * w / weight for s, w in left.items()}
        out |= {s: most[s] for s in full}
        left = {s: w for s, w in left.items() if s not in full}
    return out


def mix(items: DataFrame, targets: DataFrame, nearest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(uses: key, source, tokens, uses; report: source, target_share, actual_share, documents, uses, tokens, most, max_repeats).

    ``items`` has key, source, tokens; ``targets`` has source, target_share,
    max_repeats.  More than ``MAX_SOURCES`` targets, or two for one source, are an error.
    """
    spark = items.sparkSession
    rows = targets.where("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES or len({r["source"] for r in rows}) < len(rows):
        raise ValueError(f"at most {MAX_SOURCES} targets, and one for each source")
    listed = spark.createDataFrame([(r["source"],) for r in rows], "source string")
    items = durable(items.where("tokens > 0 and source is not null").join(F.broadcast(listed), "source", "left_semi"))
    groups = durable(items.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    sums = groups.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t"), F.sum("n").alias("n"), F.max("n").alias("largest")).collect()
    have = {r["source"]: r["t"] for r in sums}
    given = {r["source"]: (r["target_share"], r["max_repeats"]) for r in rows if have.get(r["source"]) and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0}
    whole = sum(w for w, _ in given.values())
    shares = {s: w / whole for s, (w, _) in given.items()}
    if not shares:
        empty = items.limit(0).select("key", "source", "tokens", F.lit(0).cast("long").alias("uses"))
        return empty, _report(empty, targets)
    most = {s: float(m * have[s]) for s, (_, m) in given.items()}
    if nearest:
        wanted = fill_up(float(sum(have[s] for s in shares)), most, shares)
    else:
        total = min(sum(have.values()), *(most[s] / w for s, w in shares.items()))
        wanted = {s: w * total for s, w in shares.items()}
    scale = sum(have.values()) / sum(r["n"] for r in sums)
    asked = spark.createDataFrame([(s, float(t), float(given[s][1]), float(scale)) for s, t in wanted.items()], "source string, target double, cap double, scale double")
    # One row per source and length, so a source is as long as its longest text at most, however many documents it has.
    planned = groups.join(F.broadcast(asked), "source").groupBy("source").applyInPandas(_plan_source, "source string, tokens bigint, n bigint, copies bigint")
    ranked = with_rank(items, ["source", "tokens"], F.xxhash64("key"), largest=max(r["largest"] for r in sums))
    uses = ranked.join(planned.where("copies > 0"), ["source", "tokens"]).withColumn("uses", F.expr("copies div n + int(rank < copies % n)")).where("uses > 0")
    uses = durable(uses.select("key", "source", "tokens", "uses"))
    return uses, _report(uses, targets)


def _report(uses: DataFrame, targets: DataFrame) -> DataFrame:
    done = uses.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.max("uses").alias("most"))
    joined = targets.where("source is not null").join(done, "source", "left")
    share = F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(W.partitionBy())
    return joined.select(
        "source", "target_share", F.coalesce(share, F.lit(0.0)).alias("actual_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "uses", "tokens", "most")], "max_repeats"
    )

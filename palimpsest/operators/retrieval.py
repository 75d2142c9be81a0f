"""Ranked retrieval: BM25, vectors, the linear blend, voices fused by reciprocal rank, diversity.

Query sets are small literal lists or a stated set of rows; they are the side that
is broadcast, and only behind a counted bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions import vectors as V
from palimpsest.functions.decay import recency, temporal_boost, veracity_weight
from palimpsest.functions.instants import barrier
from palimpsest.session import durable

K1, B = 1.2, 0.75
RRF_K = 60
MAX_QUERY_BYTES = 64_000_000


def query_tokens(query: str) -> list[str]:
    import re

    found = re.findall(r"[^\W_][\w]*(?:[_.:/+-]+[^\W_][\w]*)*", query.lower())
    return list(dict.fromkeys(t for t in found if len(t) >= 3 and t not in X.STOP_WORDS and not t.isdigit()))


def bm25(docs: DataFrame, queries: dict[str, str], k: int | None = None) -> DataFrame:
    """query_id, id, score, rank for documents (id, content); higher is better, ties by id.

    Only the queries' own terms are exploded, so the postings are as small as the
    answer.  Repeated rows count once: they are told apart by id, length and hits,
    so no text is shuffled, and texts are read and cut into words once.
    """
    wanted = {q: query_tokens(t) for q, t in queries.items()}
    terms = sorted({t for ts in wanted.values() for t in ts})
    tokened = docs.where("content is not null").select("id", X.tokens(F.col("content")).alias("t"))
    hits = F.filter("t", lambda x: F.array_contains(F.array(*[F.lit(t) for t in terms]), x))
    sized = durable(tokened.select("id", F.size("t").alias("dl"), hits.alias("h")).distinct())
    whole = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    n, avg = whole["n"], whole["avg"] or 1.0
    postings = sized.where(F.size("h") > 0).select("id", "dl", F.explode("h").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    asked = df.sparkSession.createDataFrame([(q, t) for q, ts in wanted.items() for t in ts], "query_id string, term string")
    # One row per query term.
    weighted = asked.join(df, "term").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avg))
    scored = postings.join(F.broadcast(weighted), "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return ranked(scored, k)


def ranked(scored: DataFrame, k: int | None = None, query: str = "query_id", score: str = "score") -> DataFrame:
    """Rank from 1 per query by rounded score, then id."""
    r = scored.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc(F.round(score, 9)), "id")))
    return r.where(F.col("rank") <= k) if k else r


def _in_passes(search, vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame | None:
    """The union of searches over hashed parts of the queries where all would exceed ``MAX_QUERY_BYTES``; None where they fit."""
    sound = queries.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).select("id", "embedding")
    passes = -(-sound.count() * dim * 8 // MAX_QUERY_BYTES)
    if passes <= 1:
        return None
    every = None
    # Twice as many parts as needed, since hashed parts differ in size.
    for i in range(2 * passes):
        part = search(vectors, sound.where(F.pmod(F.xxhash64("id"), F.lit(2 * passes)) == i), k, dim)
        every = part if every is None else every.unionByName(part)
    return every


def over_fetch(k: int, times: int, least: int) -> int:
    """How many candidates to look at for k results."""
    return max(times * k, least)


def relative_distance(hits: DataFrame) -> DataFrame:
    """Hits (query_id, distance, ...) with ``sim``, 1 - distance over the batch's largest; 1 where all distances are 0."""
    far = F.max("distance").over(W.partitionBy("query_id"))
    return hits.withColumn("sim", F.when(far == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("distance") / far)))


def position_scores(hits: DataFrame) -> DataFrame:
    """Ranked hits (query_id, rank, ...) with ``position_score``, 1 for the first, less by 1/n a place."""
    n = F.count("*").over(W.partitionBy("query_id"))
    return hits.withColumn("position_score", 1 - (F.col("rank") - 1) / n)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """query_id, id, score, rank: exact cosine of a stated query set against all rows (id, embedding), in blocks.

    Each task scores its rows against all queries with one matrix product and
    keeps k per query, so the shuffle carries k rows per query and task.  The
    query vectors are broadcast, at most ``MAX_QUERY_BYTES`` at a time; a larger set
    is cut by hash into as many passes over the rows as it needs.
    """
    passes = _in_passes(vector_topk, vectors, queries, k, dim)
    return passes if passes is not None else _topk(vectors, queries, k, dim, True)


def product_topk(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """As ``vector_topk`` by the plain product, e.g. of quantised vectors."""
    passes = _in_passes(product_topk, vectors, queries, k, dim)
    return passes if passes is not None else _topk(vectors, queries, k, dim, False)


def weighted_topk(vectors: DataFrame, asked: DataFrame, weight: str, k: int, dim: int) -> DataFrame:
    """id, score: the k rows of greatest cosine times weight for one asked vector; no row is passed over for its cosine alone."""
    one = asked.select(F.col("embedding").alias("__q"), F.col("id").alias("__i"))
    # One row.
    both = vectors.where(F.size("embedding") == dim).join(F.broadcast(one), F.col("id") != F.col("__i"))
    scored = both.select("id", (F.round(V.cosine(F.col("embedding"), F.col("__q")), 9) * F.col(weight)).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def _topk(vectors: DataFrame, queries: DataFrame, k: int, dim: int, unit: bool) -> DataFrame:
    sound = queries.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).select("id", "embedding")
    asked = sound.toPandas()
    scaled = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300) if unit else a
    shared = vectors.sparkSession.sparkContext.broadcast((scaled(np.array(asked.embedding.tolist(), float).reshape(-1, dim)), asked.id.to_numpy()))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, names = shared.value
        for pdf in batches:
            if not len(pdf) or not len(names):
                continue
            v = scaled(np.array(pdf.embedding.tolist(), float))
            ids = pdf.id.to_numpy()
            for at in range(0, len(names), 1024):
                s = np.round(q[at : at + 1024] @ v.T, 9)
                s[names[at : at + 1024, None] == ids[None, :]] = -np.inf
                top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                rows, cols = np.repeat(np.arange(len(top)), top.shape[1]), top.ravel()
                good = s[rows, cols] > -np.inf
                yield pd.DataFrame({"query_id": names[at + rows[good]], "id": ids[cols[good]], "score": s[rows[good], cols[good]]})

    kind, asked_kind = dict(vectors.dtypes)["id"], dict(queries.dtypes)["id"]
    near = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).select("id", "embedding")
    return ranked(near.mapInPandas(block, f"query_id {asked_kind}, id {kind}, score double"), k)


def hamming_topk(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """query_id, id, distance, rank: the k rows (id, embedding) whose sign bits differ least from each query's, ties by id, in blocks.

    Rows of another dimension and the query's own row are left out.  Queries are
    cut into passes as in ``vector_topk``.
    """
    passes = _in_passes(hamming_topk, vectors, queries, k, dim)
    if passes is not None:
        return passes
    sound = queries.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).select("id", "embedding")
    asked = sound.toPandas()
    # Signs as 1 and -1: their product is the dimension less twice the distance, exact in single precision.
    signs = lambda rows: np.where(np.array(rows.tolist(), float).reshape(-1, dim) > 0, 1, -1).astype(np.float32)
    q, names = signs(asked.embedding), asked.id.to_numpy()

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf) or not len(names):
                continue
            v, ids = signs(pdf.embedding), pdf.id.to_numpy()
            for at in range(0, len(names), 1024):
                far = ((dim - q[at : at + 1024] @ v.T) / 2).astype(int)
                far[names[at : at + 1024, None] == ids[None, :]] = dim + 1
                top = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :k]
                rows, cols = np.repeat(np.arange(len(top)), top.shape[1]), top.ravel()
                good = far[rows, cols] <= dim
                yield pd.DataFrame({"query_id": names[at + rows[good]], "id": ids[cols[good]], "distance": far[rows[good], cols[good]]})

    kind = dict(vectors.dtypes)["id"]
    near = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).select("id", "embedding")
    found = near.mapInPandas(block, f"query_id {kind}, id {kind}, distance bigint")
    return ranked(found.withColumn("near", -F.col("distance").cast("double")), k, score="near").drop("near")


def with_lexical(rows: DataFrame, query: str, out: str = "lex", matched: str | None = None) -> DataFrame:
    """Add the words' relevance to a query, and how many of its words a row has.

    Stages of plain columns, behind barriers: each text is cut into words once and
    each relevance is worked out once, however often it is used above.
    """
    asked = query_tokens(query)
    staged = rows.withColumn("__t", barrier(X.tokens(F.col("content")))).withColumn("__x", barrier(X.expanded(F.col("__t"))))
    told = {out: barrier(X.lexical_relevance(asked, F.col("__x"), F.col("content"), query))}
    if matched:
        told[matched] = barrier(F.size(F.array_intersect("__x", F.array(*[F.lit(t) for t in asked]).cast("array<string>"))))
    return staged.withColumns(told).drop("__t", "__x")


def linear_working(rows: DataFrame, query: str, ref_us: int, importance_weight: float = 0.2, temporal_weight: float = 0.0) -> DataFrame:
    """The working-tier blend for one query over (id, content, importance, created_us, veracity).

    relevance from tokens behind the gate, importance, recency scale 168 h, the
    temporal boost, trust.  Rows below the gate are left out; score has 4 digits
    before the trust weight, as the reference formula has.
    """
    asked = query_tokens(query)
    iw = importance_weight
    kept = with_lexical(rows.where("content is not null"), query, "relevance").where(F.col("relevance") >= X.minimum_relevance(len(asked)))
    importance = F.coalesce("importance", F.lit(0.5))
    base = F.col("relevance") * (1 - iw) * 0.6 + importance * iw + 0.08 * F.col("relevance") * F.col("relevance")
    rc = (1 - iw) * 0.4
    score = base * (rc + (1 - rc) * recency(F.col("created_us"), ref_us)) * (1 + temporal_weight * temporal_boost(F.col("created_us"), ref_us))
    return kept.withColumn("score", F.round(score, 4) * veracity_weight(F.col("veracity")))


def reciprocal_ranks(voices: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """query_id, id, score: sum of weight / (k + rank) over voices with query_id, id, rank."""
    every = None
    for i, v in enumerate(voices):
        part = v.select("query_id", "id", (F.lit(float(weights[i] if weights else 1.0)) / (F.lit(k) + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def drop_covered_summaries(results: DataFrame, summary_of: Column) -> DataFrame:
    """Results (query_id, id, tier, score, keyword_score) where a summary and the rows it covers meet.

    A summary stays, and the rows it covers go, if it scores at least as high as
    all of them and none has a keyword score of 0.95; otherwise the summary goes.
    """
    links = results.where("tier = 'episodic'").select("query_id", F.col("id").alias("sid"), F.col("score").alias("sscore"), F.explode(F.split(summary_of, ",")).alias("cid"))
    covered = results.where("tier = 'working'").select("query_id", F.col("id").alias("cid"), F.col("score").alias("cscore"), "keyword_score")
    met = links.join(covered, ["query_id", "cid"]).groupBy("query_id", "sid").agg(F.max("cscore").alias("best"), F.max("keyword_score").alias("kw"), F.first("sscore").alias("sscore"), F.collect_set("cid").alias("cids"))
    wins = (F.col("sscore") >= F.col("best")) & (F.col("kw") < 0.95)
    gone = met.where(wins).select("query_id", F.explode("cids").alias("id")).unionByName(met.where(~wins).select("query_id", F.col("sid").alias("id")))
    return results.join(gone.distinct(), ["query_id", "id"], "left_anti")


def _words(text: str) -> set[str]:
    return set(text.lower().split())


def _overlap(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def mmr(results: DataFrame, k: int, lam: float = 0.7, similarity=None, pool: int | None = None) -> DataFrame:
    """query_id, id, position by maximal marginal relevance over (query_id, id, score, content).

    All results of a query are candidates, or its ``pool`` best.  Of results with the
    same words only the k best can be chosen, so no more of them enter a task.
    """
    same = W.partitionBy("query_id", F.lower(F.trim(F.coalesce("content", F.lit(""))))).orderBy(F.desc(F.round("score", 9)), "id")
    top = ranked(results.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k).drop("__n"), pool)

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        words, left, chosen = [_words(c or "") for c in pdf.content], list(range(len(pdf))), []
        like = similarity or _overlap
        scores = pdf.score.round(9).to_numpy()
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (lam * scores[i] - (1 - lam) * max((like(words[i], words[j]) for j in chosen), default=0.0), -i))
            chosen.append(best)
            left.remove(best)
        out = pdf.iloc[chosen][["query_id", "id"]].copy()
        out["position"] = range(1, len(out) + 1)
        return out

    kinds = dict(results.dtypes)
    return top.groupBy("query_id").applyInPandas(rerank, f"query_id {kinds['query_id']}, id {kinds['id']}, position int")


def diverse(results: DataFrame, k: int, limit: float = 0.8) -> DataFrame:
    """The first k results of each query that are not too like a chosen one, down the whole ranked list.

    Each round walks a block of 4k results of each query that are not too like any
    chosen before; the first of a block is always chosen, so there are k rounds at
    most.  What travels between rounds is the chosen rows, at most k per query.
    """
    kinds = dict(results.dtypes)
    every = durable(results.select("query_id", "id", F.round("score", 9).alias("score"), "content"))
    fields = f"query_id {kinds['query_id']}, id {kinds['id']}, score double, content string"
    picked: dict = {}

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = {q: [_words(c) for _, _, c in rows] for q, rows in picked.items()}
        last = {q: rows[-1][:2] for q, rows in picked.items()}
        for pdf in batches:
            keep = []
            for r in pdf.itertuples():
                chosen = words.get(r.query_id, [])
                w = _words(r.content or "")
                keep.append(len(chosen) < k and (-r.score, r.id) > last.get(r.query_id, (-float("inf"), r.id)) and all(_overlap(w, o) <= limit for o in chosen))
            yield pdf[keep]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, rows = [_words(c) for _, _, c in picked.get(pdf.query_id.iloc[0], [])], []
        for row in pdf.sort_values("rank").itertuples():
            w = _words(row.content or "")
            if len(chosen) < k and all(_overlap(w, o) <= limit for o in chosen):
                chosen.append(w)
                rows.append((row.query_id, row.id, row.score, row.content or ""))
        return pd.DataFrame(rows, columns=["query_id", "id", "score", "content"])

    while True:
        rest = every.mapInPandas(left, fields) if picked else every
        new = ranked(rest, 4 * k).groupBy("query_id").applyInPandas(pick, fields).collect()
        for r in sorted(new, key=lambda r: (-r.score, r.id)):
            picked.setdefault(r.query_id, []).append((-r.score, r.id, r.content))
        # The first round chooses each query's first result, so every query is known after it.
        if not new or all(len(rows) >= k for rows in picked.values()):
            break
    out = [(q, i, n + 1) for q, rows in picked.items() for n, (_, i, _) in enumerate(rows)]
    return every.sparkSession.createDataFrame(out, f"query_id {kinds['query_id']}, id {kinds['id']}, position int")

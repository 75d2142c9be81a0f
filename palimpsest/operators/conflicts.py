"""Similarity joins over vectors, clusters of their links, and rows that contradict each other."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from palimpsest.functions import text as X
from palimpsest.session import durable

PIVOTS = 64
BLOCK_ROWS = 8_000
_PLACES: dict = {}


# Longer texts are matched one pair at a time.
MATCHED_TOGETHER = 64


def matched_letters(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the matching blocks of every pair: the longest common part, of these the first in a, then in b, and so on before and behind it; for all pairs at once."""
    total, width = np.zeros(len(a), np.int64), max(1, *map(len, a), *map(len, b))
    codes = lambda t: np.array(t, f"U{width}").view(np.uint32).reshape(-1, width).astype(np.int32)
    x, y, places = codes(a), codes(b), np.arange(width)
    zero = np.zeros(len(a), np.int64)
    row, a0, a1, b0, b1 = np.arange(len(a)), zero, np.array([len(t) for t in a]), zero, np.array([len(t) for t in b])
    while len(row):
        left = np.where((places >= a0[:, None]) & (places < a1[:, None]), x[row], -1)
        right = np.where((places >= b0[:, None]) & (places < b1[:, None]), y[row], -2)
        size, end_a, end_b = (np.zeros(len(row), np.int64) for _ in range(3))
        run = np.zeros((len(row), width + 1), np.uint8)
        for i in range(width):
            # How long the common part is that ends at both letters.
            run[:, 1:] = (run[:, :-1] + 1) * (left[:, i, None] == right)
            j = run.argmax(1)
            n = run[np.arange(len(row)), j]
            more = n > size
            size, end_a, end_b = np.where(more, n, size), np.where(more, i + 1, end_a), np.where(more, j, end_b)
        np.add.at(total, row, size)
        before, behind = (size > 0) & (end_a - size > a0) & (end_b - size > b0), (size > 0) & (end_a < a1) & (end_b < b1)
        row, a0, a1, b0, b1 = (
            np.concatenate([u[before], v[behind]]) for u, v in ((row, row), (a0, end_a), (end_a - size, a1), (b0, end_b), (end_b - size, b1))
        )
    return total


@F.pandas_udf(DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks over both lengths; null for a null."""
    out, short = [None] * len(a), []
    for i, (x, y) in enumerate(zip(a, b)):
        if x is not None and y is not None:
            if 0 < len(x) + len(y) and max(len(x), len(y)) <= MATCHED_TOGETHER:
                short.append((i, x, y))
            else:
                out[i] = difflib.SequenceMatcher(None, x, y).ratio()
    if short:
        for (i, x, y), n in zip(short, matched_letters([x for _, x, _ in short], [y for _, _, y in short]).tolist()):
            out[i] = 2.0 * n / (len(x) + len(y))
    return pd.Series(out, dtype="float64")


def _place(token: str, dim: int) -> tuple[int, float]:
    if (token, dim) not in _PLACES:
        if len(_PLACES) > 200_000:
            _PLACES.clear()
        h = hashlib.md5(token.encode()).hexdigest()
        _PLACES[token, dim] = int(h[:4], 16) % dim, 1.0 if int(h[4], 16) % 2 == 0 else -1.0
    return _PLACES[token, dim]


def hashed_embedding(dim: int):
    """The built-in embedder, a column function of token arrays: each token adds 1 or -1 at a place told by its hash.  Any function of a column to an array of doubles can stand in for it."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(tokens: pd.Series) -> pd.Series:
        out = []
        for ts in tokens:
            v = np.zeros(dim)
            for t in ts if ts is not None else ():
                i, s = _place(t, dim)
                v[i] += s
            out.append(v)
        return pd.Series(out)

    return embed


def _units(column: pd.Series, dim: int) -> np.ndarray:
    v = np.array(column.tolist(), float).reshape(-1, dim)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def vector_classes(rows: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes: keys, class_id, embedding, n; members: id, class_id) of rows (id, embedding, keys) with the same vector; the smallest id names a class.

    A vector without any direction, or a null, is in no class.
    """
    keys = keys or []
    sound = rows.where("embedding is not null and exists(embedding, x -> x != 0)").withColumn("__h", F.xxhash64("embedding"))
    classes = durable(sound.groupBy(*keys, "__h", "embedding").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("n")))
    # By hash and vector, null-safe in the keys.
    named = classes.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.col("__h").alias("c_h"), F.col("embedding").alias("c_e"), "class_id")
    on = (F.col("__h") == F.col("c_h")) & (F.col("embedding") == F.col("c_e"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    return classes.drop("__h"), sound.join(named, on).select("id", "class_id").distinct()


def similar_pairs(vectors: DataFrame, threshold: float, dim: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b, cosine of all pairs of different ids (a < b) whose cosine reaches the threshold; none is lost.

    Every vector goes to the cell of its nearest pivot (a fixed number of vectors,
    chosen by hash; no more of them than blocks are needed, for where nothing can be
    ruled out a row meets every block).  Angles obey the triangle inequality, so two cells can only hold
    a pair if their pivots are no farther apart than both radii and the threshold's
    angle together; other pairs of cells are never met.  Cells are cut into blocks of
    ``block_rows``, a task multiplies two blocks, and only pairs over the threshold
    leave it.  ``vectors`` has id, embedding; collapse equal vectors first
    (``vector_classes``), so that copies are no pairs.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["id"]
    sound = vectors.where(F.size("embedding") == dim).select("id", "embedding")
    pivots = min(pivots, max(1, -(-sound.count() // block_rows)))
    chosen = sound.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()
    empty = f"a {kind}, b {kind}, cosine double"
    if not len(chosen):
        return spark.createDataFrame([], empty)
    p = _units(chosen.embedding, dim)
    shared = spark.sparkContext.broadcast(p)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                s = np.clip(_units(pdf.embedding, dim) @ shared.value.T, -1, 1)
                cell = s.argmax(1)
                yield pdf.assign(cell=cell, angle=np.arccos(s[np.arange(len(s)), cell]))

    placed = durable(sound.mapInPandas(assign, f"id {kind}, embedding array<double>, cell int, angle double"))
    # One row per pivot.
    cells = {r["cell"]: (r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()}
    apart = np.arccos(np.clip(p @ p.T, -1, 1))
    reach = float(np.arccos(min(1.0, max(-1.0, threshold)))) + 1e-6
    cuts = {c: -(-n // block_rows) for c, (n, _) in cells.items()}
    met = [(int(i), int(j), cuts[i], cuts[j]) for i in cells for j in cells if i <= j and apart[i, j] <= cells[i][1] + cells[j][1] + reach]
    pairs = spark.createDataFrame(met, "i int, j int, ni int, nj int")
    sides = pairs.select("i", "j", F.explode(F.expr("sequence(0, ni - 1)")).alias("x"), "nj").select("i", "j", "x", F.explode(F.expr("sequence(0, nj - 1)")).alias("y")).where("i < j or x <= y")
    pair = F.struct("i", "x", "j", "y").alias("pair")
    cut = spark.createDataFrame([(int(c), int(n)) for c, n in cuts.items()], "cell int, cuts int")
    # As many rows as pivots.
    rows = placed.join(F.broadcast(cut), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    left = rows.join(sides.select(pair, F.col("i").alias("cell"), F.col("x").alias("part")), ["cell", "part"]).select("pair", "id", "embedding")
    right = rows.join(sides.select(pair, F.col("j").alias("cell"), F.col("y").alias("part")), ["cell", "part"]).select(F.col("pair").alias("pair2"), F.col("id").alias("id2"), F.col("embedding").alias("embedding2"))

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            same = a.pair.iloc[0]["i"] == a.pair.iloc[0]["j"] and a.pair.iloc[0]["x"] == a.pair.iloc[0]["y"]
            u, v, m, n = _units(a.embedding, dim), _units(b.embedding2, dim), a.id.to_numpy(), b.id2.to_numpy()
            for at in range(0, len(u), 1024):
                s = np.round(u[at : at + 1024] @ v.T, 9)
                r, c = np.nonzero(s >= threshold)
                x, y = m[at + r], n[c]
                keep = x < y if same else x != y
                x, y, s = x[keep], y[keep], s[r, c][keep]
                out.append(pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "cosine": s}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "cosine": []})

    return left.groupBy("pair").cogroup(right.groupBy("pair2")).applyInPandas(multiply, empty)


def components(nodes: DataFrame, links: DataFrame, rounds: int = 50) -> DataFrame:
    """id and cluster_id, the smallest id that links (a, b) connect a node (id) with; a node without links is its own cluster.

    Every round a node takes the least label among its own, its neighbours' and its
    label's label; labels of a chain therefore shrink by doubling.  Rounds end when
    no label changes; needing more than ``rounds`` is an error.
    """
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(nodes.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        once = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        up = once.select(F.col("id").alias("u"), F.col("label").alias("up"))
        new = durable(once.join(up, F.col("label") == F.col("u"), "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        changed = not new.where("label != old").isEmpty()
        labels = new.select("id", "label")
        if not changed:
            return labels.withColumnRenamed("label", "cluster_id")
    raise RuntimeError("more rounds needed to connect the links")


def clusters(rows: DataFrame, threshold: float, dim: int) -> DataFrame:
    """id, cluster_id, n_links (classes of other vectors linked to the row's class) of rows (id, embedding) by links of ``threshold`` and more."""
    classes, members = vector_classes(rows)
    links = durable(similar_pairs(classes.select(F.col("class_id").alias("id"), "embedding"), threshold, dim))
    joined = components(classes.select(F.col("class_id").alias("id")), links)
    degree = links.select(F.col("a").alias("c")).unionByName(links.select(F.col("b").alias("c"))).groupBy("c").agg(F.count("*").alias("n_links"))
    out = members.join(joined, F.col("class_id") == joined.id).select(members.id, "class_id", "cluster_id").join(degree, F.col("class_id") == F.col("c"), "left")
    return out.select("id", "cluster_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


# Words that two texts may share without being about the same.
SHARED_STOPS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might shall can need this that these those it its they them their "
    "we us our you your he she him her his not no nor so if then than too very just about also more some any each every all both what when where why how which who whom get got make made take took use used like "
    "said says know knew think thinks thought see saw seen come came give gave tell told"
).split()


def significant(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), 0), lambda w: ~w.isin(SHARED_STOPS)))


def near_conflicts(rows: DataFrame, group: str, dim: int, threshold: float = 0.88, gap_us: int = 3_600_000_000) -> DataFrame:
    """older, newer, cosine: rows (id, group, content, at_us, embedding) of one group, over ``threshold`` alike, ``gap_us`` apart, that share two significant words.

    Rows of a group with the same vector are one class, told by its smallest id, time and text.
    """
    texts = rows.where("content is not null and at_us is not null")
    classes, _ = vector_classes(texts.select("id", group, "embedding"), [group])
    named = classes.join(texts.select(F.col("id").alias("class_id"), "content", "at_us").groupBy("class_id").agg(F.min(F.struct("at_us", "content")).alias("t")), "class_id")
    told = durable(named.select(F.col("class_id").alias("id"), group, "embedding", F.col("t.at_us").alias("at_us"), significant(F.col("t.content")).alias("words")))
    # Vectors are met once, whatever the number of groups that have them.
    across, owners = vector_classes(told.select("id", "embedding"))
    links = similar_pairs(across.select(F.col("class_id").alias("id"), "embedding"), threshold, dim).where(F.col("cosine") > threshold)
    owned = owners.join(told.drop("embedding"), "id")
    a = links.join(owned.select(F.col("class_id").alias("a"), F.col("id").alias("ia"), F.col(group).alias("sa"), F.col("at_us").alias("ta"), F.col("words").alias("wa")), "a")
    b = owned.select(F.col("class_id").alias("b"), F.col("id").alias("ib"), F.col(group).alias("sb"), F.col("at_us").alias("tb"), F.col("words").alias("wb"))
    both = a.join(b, (a.b == b.b) & F.col("sa").eqNullSafe(F.col("sb"))).where((F.abs(F.col("ta") - F.col("tb")) >= gap_us) & (F.size(F.array_intersect("wa", "wb")) >= 2))
    first = F.col("ta") < F.col("tb")
    return both.select(F.when(first, F.col("ia")).otherwise(F.col("ib")).alias("older"), F.when(first, F.col("ib")).otherwise(F.col("ia")).alias("newer"), "cosine")


def conflicts(rows: DataFrame, group: str, dim: int, threshold: float = 0.88, least_distance: float = 0.3) -> DataFrame:
    """Near conflicts whose texts are no near copies: 1 - edit ratio is over ``least_distance``."""
    texts = rows.where("content is not null").groupBy("id").agg(F.min("content").alias("content"))
    pairs = near_conflicts(rows, group, dim, threshold)
    a, b = texts.select(F.col("id").alias("older"), F.col("content").alias("ca")), texts.select(F.col("id").alias("newer"), F.col("content").alias("cb"))
    return pairs.join(a, "older").join(b, "newer").where(1 - edit_ratio(F.col("ca"), F.col("cb")) > least_distance).select("older", "newer", "cosine")


def harmony(members: DataFrame, beliefs: DataFrame) -> DataFrame:
    """cluster_id, n_members, score: the mean over a cluster's beliefs (id, cluster_id, embedding, confidence) of cosine to the members' centre times confidence.

    ``members`` has cluster_id, embedding.
    """
    centre = members.select("cluster_id", F.posexplode("embedding").alias("i", "v")).groupBy("cluster_id", "i").agg(F.avg("v").alias("c"))
    length = centre.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("r"))
    b = beliefs.select("cluster_id", F.col("id").alias("n"), "confidence", F.posexplode("embedding").alias("i", "v"))
    dots = b.join(centre, ["cluster_id", "i"]).groupBy("cluster_id", "n", "confidence").agg(F.sum(F.col("v") * F.col("c")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    scored = dots.join(length, "cluster_id").withColumn("s", F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("r")), F.lit(0.0)) * F.col("confidence"))
    n = members.groupBy("cluster_id").agg(F.count("*").alias("n_members"))
    return scored.groupBy("cluster_id").agg(F.avg("s").alias("score")).join(n, "cluster_id").select("cluster_id", "n_members", "score")

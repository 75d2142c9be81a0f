"""Whole jobs: no group, pair, row or word is left out."""

import datetime
import math
import random
from itertools import combinations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.functions import text as X
from palimpsest.operators import patterns, relational, retrieval, voices


def test_ordered_text_of_all_sessions(spark, tmp_path):
    at = datetime.datetime(2025, 1, 1)
    rows = [(f"h{i:05d}", "sess-main-0001", None if i % 9 == 0 else at + datetime.timedelta(minutes=(i * 37) % 5000)) for i in range(2300)]
    rows += [(f"n{i}", None, at) for i in range(3)] + [("one", "s1", at)]
    spark.createDataFrame(rows, "id string, session_id string, created_at timestamp").write.parquet(f"{tmp_path}/episodic_memory.parquet")
    got = {(r.session_id, r.chunk): r.members for r in entry.queries()["a15_ordered_text_all"](spark, str(tmp_path)).collect()}
    hot = [r[0] for r in sorted((r for r in rows if r[1] == "sess-main-0001"), key=lambda r: (r[2] is not None, r[2] or at, r[0]))]
    want = {("sess-main-0001", c): " | ".join(hot[c * 1000 : c * 1000 + 1000]) for c in range(3)}
    assert got == want | {(None, 0): "n0 | n1 | n2", ("s1", 0): "one"}


def test_similar_names_against_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    base = ["place:katefefe", "agent:ann", "her", "device:" + "ab" * 11, "x", "straße nord", "", "é" * 15]
    names = set(base) | {" Place:Katefefe", "PLACE:KATEFEFE"}
    for b in base * 40:
        w = list(b)
        for _ in range(rnd.randint(0, 5)):
            at, do = rnd.randint(0, len(w)), rnd.random()
            w[at : at + (do < 0.6)] = [] if do < 0.3 else [rnd.choice("abe:")]
        names.add("".join(w)[: rnd.choice([99, 99, 99, 9, 5])])
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "subject string")
    rows.write.parquet(f"{tmp_path}/triples.parquet")
    got = {(r.name, r.other, r.similarity, r.n_links) for r in entry.queries()["f17_f18_j18_similar_names"](spark, str(tmp_path)).collect()}
    raw = rows.where("subject is not null").select(F.lower(F.trim("subject")).alias("n"), F.col("subject").alias("s"))
    every = raw.crossJoin(raw.select(F.col("n").alias("o"), F.col("s").alias("t"))).where("n < o or n = o and s < t")
    like = F.round(X.entity_similarity(F.col("n"), F.col("o")), 9)
    brute = every.where(X.entity_similarity(F.col("n"), F.col("o")) >= 0.8).groupBy("n", "o", like.alias("x")).agg(F.count("*").alias("k"))
    assert got == {tuple(r) for r in brute.collect()} and len(got) > 300
    assert ("place:katefefe", "place:katefefe", 1.0, 3) in got


def test_similar_names_meet_by_few_keys(spark):
    """Pairs within the edits allowed share a key of their beginnings or ends, and a name has tens of keys, not hundreds."""
    rnd = random.Random(8)
    names = [rnd.choice(["user:", "agent:", "place:", "device:", "project:"]) + "".join(rnd.choice("bdfgk") + rnd.choice("aeiou") for _ in range(4)) for _ in range(300)]
    names += ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    sizes = {n: sum(len(x) == n for x in names) for n in {len(x) for x in names}}
    plan = relational.name_cuts(sizes, names, 0.8)

    def keys(x, m):
        for _, _, side, size, f in (r for r in plan if r[:2] == (len(x), m)):
            part = x[:size] if side == 0 else x[-size:]
            yield from ((side, "".join(c)) for c in combinations(part, size - f))

    per = [sum(math.comb(min(n, size), size - f) for l, _, _, size, f in plan if l == n) for n in (13, 14, 15, 16)]
    assert max(per) <= 150, per
    # Edited as often as is allowed, anywhere.
    met = 0
    for x in names:
        for _ in range(10):
            w, e = list(x), math.floor(0.2 * len(x) + 1e-9)
            for _ in range(rnd.randint(0, e)):
                at, do = rnd.randint(0, len(w)), rnd.random()
                w[at : at + (do < 0.6)] = [] if do < 0.3 else [rnd.choice("abe")]
            y, m = "".join(w), max(len(x), len(w))
            if x != y and m in sizes and len(y) in sizes and m <= relational.CUT_LENGTH:
                assert set(keys(x, m)) & set(keys(y, m)), (x, y)
                met += 1
    assert met > 2000


def test_hamming_search_over_all_rows(spark, tmp_path):
    rnd = random.Random(6)
    # A gap after each query's id, and the nearest row far from it.
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(64)]) for i in [0, 100, *range(102, 190)]]
    rows += [(777, [x * 2 for x in rows[0][1]]), (778, None), (779, [1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.query_id, r["rank"], r.id, r.distance) for r in entry.queries()["k4_hamming_topk"](spark, str(tmp_path)).collect()]
    want = []
    for q, e in rows[:2]:
        far = sorted((sum((x > 0) != (y > 0) for x, y in zip(e, v)), i) for i, v in rows if i != q and v and len(v) == 64)
        want += [(q, n + 1, i, f) for n, (f, i) in enumerate(far[:10])]
    assert sorted(got) == want and (0, 1, 777, 0) in got


def test_diverse_goes_on_below_the_copies(spark):
    copy = "vector index on the office server is slow again this week"
    rows = [("q", f"c{i:03d}", 9.0 - i / 1000, copy + " x" * (i % 2)) for i in range(100)] + [("q", f"d{i}", 1.0 - i / 100, f"another thing {i} {i * 7} here") for i in range(30)]
    rows += [("r", "e", 1.0, None), ("r", "f", 0.5, "one")]
    got = [tuple(r) for r in retrieval.diverse(spark.createDataFrame(rows, "query_id string, id string, score double, content string"), 10).collect()]
    want = []
    for q in "qr":
        chosen = []
        for _, i, _, c in [r for r in rows if r[0] == q]:
            w = set((c or "").split())
            if len(chosen) < 10 and all(len(w & o) <= 0.8 * len(w | o) for _, o in chosen):
                chosen.append((i, w))
        want += [(q, i, n + 1) for n, (i, _) in enumerate(chosen)]
    assert sorted(got) == sorted(want) and sum(r[0] == "q" for r in got) == 10


def test_coverage_looks_at_all_results(spark):
    rnd = random.Random(7)
    rows = [("q", f"a{i:03d}", 1.0 - i / 10000, "vector " + "index " * (i % 2)) for i in range(200)]
    rows += [("q", f"b{i}", 0.9 + rnd.random() / 20, " ".join(rnd.sample(["server", "grocery", "list", "vector", "office"], 3))) for i in range(20)]
    query = "vector index office server grocery list"
    got = [r.id for r in voices.coverage_rerank(spark.createDataFrame(rows, "query_id string, id string, score double, content string"), query, 10).orderBy("position").collect()]
    left, seen, want = sorted(rows, key=lambda r: (-round(r[2], 9), r[1])), set(), []
    while len(want) < 10:
        best = max(left, key=lambda r: (r[2] + 0.06 * len((set(r[3].split()) & set(query.split())) - seen), -left.index(r)))
        left.remove(best)
        seen |= set(best[3].split())
        want.append(best[1])
    assert got == want and any(i.startswith("b") for i in got)


def test_every_memory_of_three_tables(spark, tmp_path):
    for n, ids in {"working_memory": ["a1", "z1"], "memories": ["b1", "z1"], "episodic_memory": ["e1", "z2"]}.items():
        spark.createDataFrame([(i, f"text {i}") for i in ids], "id string, content string").write.parquet(f"{tmp_path}/{n}.parquet")
    got = {(r.id, r.content) for r in entry.queries()["x25_every_memory"](spark, str(tmp_path)).collect()}
    assert got == {(i, f"text {i}") for i in ["a1", "b1", "e1", "z1", "z2"]}


def test_pairs_of_all_words(spark):
    texts = ["zebra quartz violin zebra", "Quartz and zebra", "violin", "vector index", None]
    rows = spark.createDataFrame([(t,) for t in texts], "content string").where("content is not null")
    got = [tuple(r) for r in patterns.frequent_pairs(rows, "content", 3).collect()]
    assert got == [("quartz", "zebra", 2), ("index", "vector", 1), ("quartz", "violin", 1)]

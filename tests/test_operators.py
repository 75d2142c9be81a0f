"""General operators on small frames."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dates, decay, media, predicates, rules, vectors
from palimpsest.functions import text as X
from palimpsest.operators import facts, graph, history, lifecycle, relational, retrieval, sync
from palimpsest.sources import files
from palimpsest.streaming import events as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_decay_points(spark):
    h = 3_600_000_000
    assert one(spark, decay.recency(F.lit(0), 168 * h)) == pytest.approx(0.36787944)
    assert one(spark, decay.recency(F.lit(2 * h), h)) > 1
    assert one(spark, decay.temporal_boost(F.lit(2 * h), h)) == 1.0
    assert one(spark, decay.temporal_boost(F.lit(None).cast("long"), h)) == 0.0
    assert one(spark, decay.weibull(F.lit(0), 168 * h, F.lit("nonsense"))) == pytest.approx(0.36787944)
    assert one(spark, decay.clamp_veracity(F.lit(" Stated "))) == "stated"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(0.70710678)
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, vectors.hamming(a, b)) == 1
    assert one(spark, vectors.int8(b)) == [127, 127]


def test_tokens_and_similarity(spark):
    assert one(spark, X.tokens(F.lit("The naïve c++ a_b-c user_name 123 Bürgeramt: it"))) == ["naïve", "a_b-c", "user_name", "bürgeramt"]
    assert one(spark, X.symbolic_tokens(F.lit("C++ and c# but a+b"))) == ["c++", "c#"]
    assert one(spark, X.leading_hyphen_fragments(F.lit("rm -rf --dry-run git--rebase"))) == ["-rf", "--dry-run"]
    assert one(spark, X.entity_similarity(F.lit("Abdias"), F.lit("abdias j"))) == pytest.approx(0.925)
    assert one(spark, X.entity_similarity(F.lit("her"), F.lit("herxxxxxxxxxxx"))) == 0.0
    assert one(spark, X.entropy(F.lit("abab"))) == pytest.approx(1.0)
    assert one(spark, X.ngrams(F.lit("abcd"))) == ["abc", "bcd"]
    assert one(spark, X.cjk_coverage("東京都", F.lit("京都"))) == pytest.approx(2 / 3)


def test_noise_and_secrets(spark):
    score = lambda c, i=0.5, s="user": one(spark, X.noise_score(F.lit(c), F.lit(i), F.lit(s)))
    assert score("ok") == 0.8 and score("") == 1.0 and score("I prefer tea", 0.1) == 0.3
    assert score("password = hunter2hunter2 for my user") == 0.9
    assert score("project plan", 0.5, "cron") == 0.7
    assert one(spark, X.secrets(F.lit("AKIA" + "A" * 16))) == ["cloud_key"]


def test_rules(spark):
    assert one(spark, rules.memory_type(F.lit("The deadline is tomorrow"))["type"]) == "commitment"
    assert one(spark, rules.memory_type(F.lit("   "))["type"]) == "unknown"
    assert one(spark, rules.memory_type(F.lit("blue"))["confidence"]) == 0.3
    assert one(spark, rules.compact(F.lit("PREFERENCE: tea and milk ( hot )"))) == "PREF|tea+milk (hot)"
    assert one(spark, X.intent(F.lit("when did we deploy last week"))["category"]) == "temporal"


@pytest.mark.parametrize(
    ("text", "day", "precision"),
    [
        ("on 2026-05-20", "2026-05-20", "day"), ("2026-02-30 or 05/20/2026", "2026-05-20", "day"), ("20/05/26", "2026-05-20", "day"), ("May 3rd", "2026-05-03", "day"), ("see you tomorrow", "2026-05-14", "day"), ("last wednesday", "2026-05-06", "day"),
        ("this wednesday", "2026-05-13", "day"), ("next wednesday", "2026-05-20", "day"), ("on Monday", "2026-05-11", "day"), ("last month", "2026-04-01", "month"), ("nothing", None, None),
    ],
)
def test_dates(spark, text, day, precision):
    r = one(spark, dates.named_date(F.lit(text), F.lit("2026-05-13").cast("date")))
    assert (str(r.event_date) if r.event_date else None, r.precision) == (day, precision)


def test_media(spark):
    assert one(spark, media.span_key(F.lit("time"), F.lit(90000), F.lit(None).cast("int"))) == "v1:time:90000-na"
    assert one(spark, media.span_key(F.lit("page"), F.lit(3), F.lit(None).cast("int"))) == "v1:page:3-3"
    assert one(spark, media.normal_ref(F.lit("url"), F.lit("HTTP://Ex.COM/A?b=C#t=90"))) == "http://ex.com/A?b=C#t=90"
    assert one(spark, media.sanitised(F.lit("data:image/png;base64,aGk="))["size"]) == 2
    assert one(spark, media.sanitised(F.lit("plain"))["reason"]) is None


def test_predicates(spark):
    assert one(spark, predicates.still_valid(F.lit("garbage"), 0)) is False
    assert one(spark, predicates.still_valid(F.lit(None).cast("string"), 0)) is True
    assert one(spark, predicates.flag_collision("use --force", F.lit("force it"))) is True
    assert one(spark, predicates.flag_collision("use --force", F.lit("git --force"))) is False
    assert one(spark, predicates.csv_member(F.lit("a,bc"), F.lit("b"))) is False


def test_history(spark):
    t = spark.createDataFrame([(1, "s", "p", "x", "2024-01-01", None), (2, "s", "p", "y", "2024-03-01", None), (3, "s", "p", "y", "2024-04-01", "2024-05-01")], "id int, s string, p string, o string, f string, u string")
    closed = {r.id: r.u for r in history.close_superseded(t, ["s", "p"], ["id"], "f", "u").collect()}
    assert closed == {1: "2024-03-01", 2: "2024-04-01", 3: "2024-05-01"}
    assert [(r.version, r.o, r.previous, r.valid_until) for r in history.versions(t, ["s", "p"], "o", ["id"], "f").orderBy("version").collect()] == [(1, "x", None, "2024-03-01"), (2, "y", "x", None)]
    assert {r.id for r in history.as_of(t, "2024-03-15", "f", "u").collect()} == {1, 2}


def test_facts(spark):
    m = spark.createDataFrame([(1, "a", "stated"), (2, "a", "stated"), (3, "a", "tool"), (4, "b", None)], "id int, k string, veracity string")
    got = {r.k: r.confidence for r in facts.consolidate(m, ["k"], ["id"]).collect()}
    c = 0.5
    for w in (1.0, 0.5):
        c += (1 - c) * w * 0.3
    assert got["a"] == pytest.approx(c) and got["b"] == pytest.approx(0.4)
    v = spark.createDataFrame([("k", "stated"), ("k", "tool"), ("k", None), ("k", "bogus"), ("k", None)], "k string, v string")
    assert facts.majority_label(v, "k", "v").first().label == "tool"


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "a", 0.2), ("c", "d", 0.9), ("x", None, 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hops) for r in graph.reachable(e, seeds, 2, 0.3).collect()} == {("b", 1), ("c", 2)}


def test_sync(spark):
    e = spark.createDataFrame([("m", 5, 0.5, "d1", "e1", "[]"), ("m", 5, 0.5, "d2", "e2", "[]"), ("m", 9, 0.1, "d1", "e3", "[]"), ("m", 4, 1.0, "d1", "e4", '["e3"]')], "m string, t long, i double, d string, e string, p string")
    assert sync.winners(e, "m", "t", "i", "d", "e").first().e == "e3"
    assert sync.chain_winners(e, "m", "t", "i", "d", "e", "p").first().e == "e2"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None)], "id int, v string")
    assert {(r.id, r.operation) for r in sync.mutations(a, b, "id", ["v"]).collect()} == {(1, "DELETE"), (2, "UPDATE"), (3, "CREATE")}
    assert {(r.id, r.v, r.action) for r in relational.upsert(a, b, "id", ["v"]).collect()} == {(1, "x", "kept"), (2, "z", "updated"), (3, None, "inserted")}


def test_retrieval(spark):
    docs = spark.createDataFrame([("a", "vector index rebuilt"), ("b", "grocery list"), ("c", "vector vector index"), ("d", None)], "id string, content string")
    hits = retrieval.bm25(docs, {"q": "the vector index"}).orderBy("rank").collect()
    assert [r.id for r in hits] == ["c", "a"]
    fused = retrieval.reciprocal_ranks([spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, id string, rank int")] * 2).collect()
    assert {r.id: r.score for r in fused}["a"] == pytest.approx(2 / 61)
    results = spark.createDataFrame([("q", "s", "episodic", 0.9, 0.1, "w1,w2"), ("q", "w1", "working", 0.5, 0.2, ""), ("q", "w3", "working", 0.4, 0.0, "")], "query_id string, id string, tier string, score double, keyword_score double, summary_of string")
    assert {r.id for r in retrieval.drop_covered_summaries(results, F.col("summary_of")).collect()} == {"s", "w3"}
    pool = spark.createDataFrame([("q", "a", 1.0, "x y z"), ("q", "b", 0.99, "x y z"), ("q", "c", 0.5, "p q")], "query_id string, id string, score double, content string")
    assert [r.id for r in retrieval.mmr(pool, 2, 0.5).orderBy("position").collect()] == ["a", "c"]
    assert [r.id for r in retrieval.diverse(pool, 3).orderBy("position").collect()] == ["a", "c"]


def test_vector_topk_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(99, None)], "id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.id for r in retrieval.vector_topk(df, df.where("id % 20 = 0"), 5, 4).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        order = [i for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:5]
        assert [got[(q, k + 1)] for k in range(5)] == order


def test_lifecycle(spark):
    assert one(spark, lifecycle.degraded_tier(F.lit(None).cast("int"), F.lit(0), 31 * 86_400_000_000)) == 2
    runs = spark.createDataFrame([("2024-01-01 00:00:00", "ok")], "t string, s string").withColumn("t", F.col("t").cast("timestamp"))
    assert lifecycle.health(runs, "t", F.col("s") == "error", 1_704_067_200_000_000).first().status == "healthy"


def test_files(spark, tmp_path):
    raw = spark.createDataFrame([("1", "hello", "u", None, "0.7"), ("2", "", "u", None, None), ("3", "bye", None, "bot", "x")], "id string, memory string, user_id string, agent_id string, importance string")
    rows = {r.id: r for r in files.normalise(raw, "flat").collect()}
    assert set(rows) == {"1", "3"} and rows["1"].importance == 0.7 and rows["3"].importance == 0.5
    assert rows["3"].author_type == "agent" and rows["1"].author_id == "flat:user_id:u"
    path = str(tmp_path / "out")
    files.export_json(files.normalise(raw, "flat"), path)
    assert files.import_json(spark, path).count() == 2
    snap = files.snapshot(raw, str(tmp_path), "one")
    assert files.verified(spark, raw, snap) and not files.verified(spark, raw.limit(1), snap)
    with pytest.raises(ValueError):
        files.bank_path("r", "a/b")


def test_streaming_value_counts(spark, tmp_path):
    from palimpsest.operators.late import count_state

    schema = "key string, event_us long, arrived_us long, value double"
    rows = [("a", 1, 2, 1.0), ("a", 2, 3, 1.0), ("b", 1, 9_000_000_000, 2.0)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows[:2], schema).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    for part in (None, rows[2:]):
        if part:
            spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        streams.keep_value_counts(stream, count_state, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in streams.read_value_counts(spark, str(tmp_path / "state")).collect()}
    assert got == {tuple(r) for r in count_state(spark.createDataFrame(rows, schema)).collect()}

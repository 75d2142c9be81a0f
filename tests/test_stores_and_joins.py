"""Stores, similarity joins, language, sources and replication on small frames, against brute force where there is one."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import session
from palimpsest.functions import language as L
from palimpsest.functions import media
from palimpsest.operators import conflicts, history, lifecycle, ordered, patterns, recall, relational, retrieval, stores, sync, voices
from palimpsest.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.95])
def test_no_similar_pair_is_lost(spark, threshold):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    v = np.vstack([c + rng.normal(scale=0.35, size=(40, 8)) for c in centres])
    rows = [(f"v{i:03}", [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").withColumn("cell", F.lit("clash"))
    got = {(r.a, r.b) for r in conflicts.similar_pairs(df, threshold, 8, pivots=9, block_rows=13).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    assert got == {(f"v{i:03}", f"v{j:03}") for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= threshold}
    assert conflicts.similar_pairs(df.limit(0), threshold, 8).count() == 0


def test_clusters_with_copies_and_chains(spark):
    # A chain of neighbours 30 degrees apart, a hot group of copies, nulls and zeros.
    angle = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = [(f"c{i}", angle(30 * i)) for i in range(5)] + [(f"h{i:03}", angle(250)) for i in range(200)] + [("n", None), ("z", [0.0, 0.0])]
    got = {r.id: (r.cluster_id, r.n_links) for r in conflicts.clusters(spark.createDataFrame(rows, "id string, embedding array<double>"), 0.8, 2).collect()}
    assert {got[f"c{i}"] for i in range(5)} == {("c0", 1), ("c0", 2)} and got["c2"] == ("c0", 2)
    assert {got[f"h{i:03}"] for i in range(200)} == {("h000", 0)} and "n" not in got and "z" not in got


def test_components_of_a_long_path(spark):
    n = 70
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(n)], "id string")
    order = list(range(n - 1))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in order if i != 40], "a string, b string")
    got = {r.id: r.cluster_id for r in conflicts.components(nodes, links).collect()}
    assert all(got[f"n{i:03}"] == ("n000" if i <= 40 else "n041") for i in range(n))


def test_conflicts_need_all_four(spark):
    v, w = [1.0, 0.0, 0.0], [0.95, 0.2, 0.0]
    rows = [
        ("a", "g", "the vector index is slow on the office server today", 0, v), ("b", "g", "vector index was rebuilt; office quiet, nobody complains any longer", 4_000_000_000, w),
        ("c", "g", "vector index office", 100, w), ("d", "other", "vector index of the office is fast again and everybody cheers", 9_000_000_000, w), ("e", "g", None, 1, v), ("f", "g", "unrelated words entirely", 9_000_000_000, v),
    ]
    df = spark.createDataFrame(rows, "id string, g string, content string, at_us long, embedding array<double>")
    assert {(r.older, r.newer) for r in conflicts.near_conflicts(df.where("id != 'c'"), "g", 3).collect()} == {("a", "b")}
    assert {(r.older, r.newer) for r in conflicts.conflicts(df.where("id != 'c'"), "g", 3).collect()} == {("a", "b")}
    assert one(spark, conflicts.edit_ratio(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(0.75)


def test_matching_blocks_of_many_pairs(spark):
    rnd = random.Random(4)
    text = lambda letters, most: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))
    pairs = [(text(s, most), text(s, most)) for s in ("ab", "abcdefgh:", "é日a\0b😀") for most in (20, 64, 90) for _ in range(150)]
    want = [difflib.SequenceMatcher(None, x, y) for x, y in pairs]
    got = conflicts.matched_letters([x for x, _ in pairs], [y for _, y in pairs])
    assert got.tolist() == [sum(b.size for b in m.get_matching_blocks()) for m in want]
    rows = [(i, x, y) for i, (x, y) in enumerate(pairs)] + [(-1, None, "a"), (-2, "a", None), (-3, "", "")]
    df = spark.createDataFrame(rows, "i int, x string, y string").select("i", conflicts.edit_ratio("x", "y").alias("r"))
    assert {r.i: r.r for r in df.collect()} == {i: m.ratio() for i, m in enumerate(want)} | {-1: None, -2: None, -3: 1.0}


def test_point_operations(spark):
    rows = spark.createDataFrame([("a", "x", 0.5, None), ("b", "y", None, None), ("c", None, 0.1, None)], "id string, content string, importance double, superseded_by string")
    ops = [(1, "update", "a", "new", None, None), (2, "update", "a", None, 0.9, None), (3, "forget", "b", None, None, None), (4, "invalidate", "c", None, None, "a"), (5, "update", "c", None, None, None), (6, "fly", "a", None, None, None), (7, "update", None, "q", None, None), (8, "update", "c", "z", 7.0, None)]
    o = spark.createDataFrame(ops, "n int, op string, id string, content string, importance double, replacement string")
    assert {tuple(r) for r in stores.applied(rows, o).collect()} == {("a", "new", 0.5, None), ("c", None, 0.1, "a")}
    reasons = {r.n: r.reason for r in stores.validated(o).collect()}
    assert reasons == {1: None, 2: "repeated", 3: None, 4: None, 5: "nothing to update", 6: "unknown operation", 7: "no id", 8: "importance out of range"}
    assert stores.applied(rows.limit(0), o).count() == 0 and stores.applied(rows, o.limit(0)).count() == 3


def test_triples_and_slots(spark):
    schema = "id int, subject string, predicate string, object string, valid_from string, valid_until string"
    t = spark.createDataFrame([(1, "S", "p", "x", "2024-01-01", None), (2, None, "p", "y", "2024-01-01", None)], schema)
    new = spark.createDataFrame([(3, "S", "p", "z", "2024-05-01", None)], schema)
    after = {r.id: r.valid_until for r in stores.add_triple(t, new).collect()}
    assert after == {1: "2024-05-01", 2: None, 3: None}
    assert {r.id for r in stores.query_triples(stores.add_triple(t, new), " s ", at="2024-06-01").collect()} == {3}
    ended = stores.end_triple(t, spark.createDataFrame([("S", "p", "2025-01-01")], "subject string, predicate string, at string"))
    assert {r.id: r.valid_until for r in ended.collect()} == {1: "2025-01-01", 2: None}
    notes = spark.createDataFrame([("o", "k", "a", 1), ("o", "k", "a", 2), ("o", "k", "b", 3), ("q", "k", None, 1)], "owner string, name string, body string, n int")
    past = stores.remember_canonical(notes, ["owner", "name"], "body", ["n"], "n")
    assert {(r.owner, r.version, r.body) for r in stores.recall_canonical(past, ["owner", "name"]).collect()} == {("o", 2, "b"), ("q", 1, None)}
    assert {r.owner for r in stores.forget_canonical(past, notes.where("owner = 'q'"), ["owner", "name"]).collect()} == {"o"}
    assert stores.model_card(stores.recall_canonical(past, ["owner", "name"]).where("body is not null"), "owner", "name", "body").first().card == "- k: b"


def test_proposals_and_validations(spark):
    p = spark.createDataFrame([("s", "a", "0.95", 1), ("s", "b", "0.99", 2), ("t", "c", "junk", 3), ("t", "d", "-4", 4), ("u", "e", None, 5)], "slot string, body string, c string, n int").withColumn("confidence", stores.coerced(F.col("c")))
    assert {r.n: r.status for r in stores.decided(p).collect()} == {1: "pending", 2: "applied", 3: "pending", 4: "rejected", 5: "pending"}
    a = spark.createDataFrame([("m", "attest", 1, 1), ("m", "delete", 2, 2), ("n", "update", 1, 1), ("n", "attest", 1, 0), (None, "attest", 1, 1)], "id string, action string, at int, n int")
    assert {(r.id, r.state, r.n_kept) for r in stores.validation_state(a).collect()} == {("m", "deleted", 2), ("n", "updated", 2)}


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_orders_in_two_levels(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(60)]), i, rng.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, i int, v int")
    bucket, order = F.floor(F.col("t") / span), ["t", "i"]
    got = {}
    for r in ordered.neighbour(df, ["k"], bucket, order, "v", "x").collect():
        got[r.i] = [r.x]
    for name, frame in (("x", ordered.neighbour(df, ["k"], bucket, order, "v", "x", ahead=False)), ("x", ordered.next_known(df, ["k"], bucket, order, F.col("v"), "x")), ("x", ordered.running(df, ["k"], bucket, order, F.coalesce("v", F.lit(0)), "x")), ("__old", ordered.beyond_newest(df, ["k"], order, 20))):
        for r in frame.collect():
            got[r.i].append(r[name])
    for k in ("hot", "b", None):
        line = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        values = [r[3] for r in line]
        for n, r in enumerate(line):
            known = [v for v in values[n + 1 :] if v is not None]
            want = [values[n + 1] if n + 1 < len(line) else None, values[n - 1] if n else None, known[0] if known else None, sum(v or 0 for v in values[: n + 1]), len(line) - n > 20]
            assert got[r[2]] == want, (r, got[r[2]], want)


def test_chunks_of_a_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in random.Random(2).sample(range(5000), 2300)] + [(None, 7, "n"), ("x", 1, "a")]
    got = {(r.k, r.chunk): r.evolution for r in history.evolution_chunks(spark.createDataFrame(rows, "k string, n long, v string"), ["k"], "v", "n", 1000, 300).collect()}
    hot = [v for _, _, v in sorted(r for r in rows if r[0] == "hot")]
    assert got == {("hot", c): " -> ".join(hot[c * 1000 : c * 1000 + 1000]) for c in range(3)} | {(None, 0): "n", ("x", 0): "a"}


def test_concurrent_events_are_counted_without_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["k", "m", None]), rng.choice([None, *range(60)]), f"e{i}") for i in range(200)]
    e = spark.createDataFrame(rows, "k string, t long, e string")
    got = {(r.k, r.e): r.n_concurrent for r in sync.concurrent(e, e, "k", "t", "e", 5).collect()}
    want = {}
    for k, t, i in rows:
        if k is not None and t is not None:
            n = sum(1 for q, u, j in rows if q == k and u is not None and abs(u - t) <= 5 and j != i)
            if n:
                want[(k, i)] = n
    assert got == want


def test_language(spark):
    assert [one(spark, L.language(F.lit(t))) for t in ("что это такое", "die Katze ist müde", "¿qué es esto?", "il gatto non è qui", "the cat", "", None)] == ["ru", "de", "es", "it", "en", "en", "en"]
    assert one(spark, L.chat_normal(F.lit("lol u gonna   deployyyy 😀"))) == "you going to deploy" and one(spark, L.chat_normal(F.lit("omg"))) is None and one(spark, L.chat_normal(F.lit(None).cast("string"))) is None
    text = "aaaab" + "x" * 300 + "[c*2]" + "\n" * 5
    coded = one(spark, L.run_length_coded(F.lit("aaaabxx\n\n\n\n")))
    assert coded == "[a*4]bxx[\n*4]" and one(spark, L.run_length_decoded(L.run_length_coded(F.lit(text.replace("[c*2]", ""))))) == text.replace("[c*2]", "")
    assert one(spark, L.trigram_score("привет", F.lit("приветы всем"))) == pytest.approx(4 / 5) and one(spark, L.trigram_score("", F.lit("x"))) == 0
    assert one(spark, L.cjk_terms(F.lit("東京都 x"))) == ["東", "京", "都", "東京", "京都"]
    long = "Nothing here at all, really nothing. " + "Docker must deploy AWS now! " * 3 + "Filler. " * 60
    short = one(spark, L.key_sentences(F.lit(long)))
    assert short.startswith("Docker must deploy AWS now!") and short.endswith("[...]") and len(short) <= 306
    assert one(spark, L.key_sentences(F.lit("short"))) == "short" and one(spark, L.key_sentences(F.lit("y" * 400))) == "y" * 300 + " [...]"
    assert L.expanded_question("the db is slow") == "the (database|db|datastore|data_store) is slow"
    assert one(spark, L.question_key(F.lit("Where is the DB?"))) == "db?" and one(spark, L.question_key(F.lit("what is the db"))) == "database"
    assert one(spark, L.ability(F.lit("How many days until then"))) == "TR" and one(spark, L.ability(F.lit("hello"))) == ""
    assert one(spark, L.safe_preview(F.lit("mail a.b@c.org or +49 30 1234567, password=hunter2hunter2"))) == "mail <redacted-email> or <redacted-phone>, <redacted>"
    assert one(spark, L.mime_of(F.unhex(F.lit("FFD8FF00")))) == "image/jpeg" and one(spark, L.mime_of(F.unhex(F.lit("")))) is None


def test_spans(spark):
    key = lambda k, s, e: one(spark, media.span_key(F.lit(k), F.lit(s), F.lit(e).cast("int")))
    assert (key("whole", None, None), key("char", 3, 9), key("page", 2, None), key("nonsense", 1, 2)) == ("v1:whole", "v1:char:3-9", "v1:page:2-2", None)


def test_files_tell_what_they_refuse(spark, tmp_path):
    path = str(tmp_path / "in.json")
    (tmp_path / "in.json").write_text('{"id": "1", "content": "a"}\n{"id": "2", "content"\n{"id": "3", "content": " "}\n{"id": "4", "content": "b"}\n')
    known = spark.createDataFrame([("4",)], "id string")
    assert {r.outcome: r.n for r in files.import_outcomes(files.import_json(spark, path), known).collect()} == {"imported": 1, "unreadable": 1, "without content": 1, "already there": 1}
    assert files.resolve_file(spark, path).first().size == (tmp_path / "in.json").stat().st_size


def test_replication(spark):
    e = spark.createDataFrame([("m", 0, "UPDATE", 0.1, "d", "a"), ("m", 3, "DELETE", 0.9, "d", "b"), ("m", 100, "UPDATE", 0.1, "d", "c"), ("n", 5, "UPDATE", None, None, "x"), ("n", 5, "UPDATE", None, "d", "y"), (None, 5, "UPDATE", None, "d", "z")], "k string, t long, operation string, importance double, device_id string, event_id string")
    assert {(r.k, r.n_events, r.winner, r.merge) for r in sync.proposals(e, "k", "t", 5).collect()} == {("m", 2, "b", "manual"), ("n", 2, "y", "automatic")}
    p = spark.createDataFrame([("1", "m", "UPDATE", 10, 20), ("2", None, "UPDATE", 1, 2), ("3", "m", "MOVE", 1, 2), ("4", "m", "DELETE", None, 2), ("5", "m", "DELETE", 400_000_000, 2)], "event_id string, memory_id string, operation string, instant_us long, arrived_us long")
    assert {r.event_id: r.outcome for r in sync.push_outcomes(p).collect()} == {"1": "accepted", "2": "no memory", "3": "unknown operation", "4": "no instant", "5": "from the future"}


def test_weights_and_reranking(spark):
    assert recall.resolved_weights(None, None, None) == recall.WEIGHTS and recall.resolved_weights(-1, 0, 0) == recall.WEIGHTS and recall.resolved_weights(float("nan"), 1, 1) == recall.WEIGHTS
    assert recall.resolved_weights(1, 1, -5) == (0.5, 0.5, 0.0)
    # Many copies above: the pool is the whole list, of copies only as many as can be chosen.
    rows = [("q", f"c{i:03}", 1.0 - i / 1e4, "same words here") for i in range(300)] + [("q", "d", 0.2, "another thing")]
    got = [r.id for r in retrieval.mmr(spark.createDataFrame(rows, "query_id string, id string, score double, content string"), 2, 0.3).orderBy("position").collect()]
    assert got == ["c000", "d"]


def test_recall_of_nothing(spark):
    w = spark.createDataFrame([], "id string, content string, importance double, veracity string, created_us long")
    v = spark.createDataFrame([], "id string, embedding array<double>")
    found = recall.candidates(w, v, "vector index", v, 4, 10, 10)
    assert found.count() == 0 and recall.working_scores(w, found, "vector index", 0).count() == 0
    asked = spark.createDataFrame([("a", "x", 5, [1.0])], "id string, content string, stored_us long, embedding array<double>")
    assert voices.cache_tiers(asked, asked, 10).first().cache_tier == 1


def test_passes_and_summaries(spark):
    assert patterns.passes("Which 12 notes does Ann have on the db") == [r"\b(12)\b", r"\b(Ann)\b", r"\b(datastore|data_store)\b", "db"]
    rows = spark.createDataFrame([(f"i{i}", "s", None if i == 3 else f"2025-01-01 0{i}:00:00", f"User wants {i}") for i in range(5)], "id string, s string, at string, head string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.chunk: (r.n, r.summary, r.members) for r in lifecycle.summaries(rows, ["s"], "at", "id", "head", 3).collect()}
    assert got == {0: (3, "WANT 3 | WANT 0 | WANT 1", "i3,i0,i1"), 1: (2, "WANT 2 | WANT 4", "i2,i4")}
    assert {r.id for r in relational.beyond_first(rows.withColumn("k", F.lit(1)), [F.col("k")], "id").collect()} == {"i1", "i2", "i3", "i4"}


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            @staticmethod
                            def isEmpty():
                                return True

                        return Empty

                return Inner

        @staticmethod
        def getConf():
            return {}

    class Frame:
        class sparkSession:
            sparkContext = Context

    with pytest.raises(RuntimeError):
        session.durable(Frame)

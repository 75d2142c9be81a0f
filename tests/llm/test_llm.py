"""Operators for training text: brute force, invariants, held-out accuracy, awkward cases."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing, packing, pii, quality, tokens
from palimpsest.llm.exact import collapse

DATA = "/root/testdata/sf0.001"


def test_collapse_formats(spark):
    fields = {"project": "Abe", "topic": "event log", "owner": "zed team"}
    rows = [
        ("a1", "Die Straße ist lang, sehr lang."), ("a2", "DIE STRASSE IST LANG SEHR   LANG"), ("a3", "(die straße… ist lang; sehr lang!)"), ("a4", "Die Straße ist sehr lang, lang."),
        ("b1", json.dumps(fields)), ("b2", json.dumps({k: fields[k] for k in ("owner", "project", "topic")}, indent=2)), ("b3", "- Owner = zed TEAM\n- topic = Event Log\n- project = abe."), ("b4", "topic:event log | owner:zed team | project:Abe"),
        ("b5", "topic:abe | owner:zed team | project:event log"), ("b6", "project Abe topic event log owner zed team"),
        ("c1", ""), ("c2", "..."), ("c3", None), (None, "Die Straße ist lang, sehr lang."), ("a2", "DIE STRASSE IST LANG SEHR   LANG"), ("d1", "x" * 200_000), ("d2", "X" * 200_000), ("e1", "{broken: json"),
    ]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("key", F.lit("clash"))
    groups, copies = collapse(df)
    assert {tuple(r) for r in copies.collect()} == {("a1", "a2"), ("a1", "a3"), ("b1", "b2"), ("b1", "b3"), ("b1", "b4"), ("b1", "b6"), ("d1", "d2")}
    assert {tuple(r) for r in groups.collect()} == {("a1", 3), ("b1", 5), ("d1", 2)}
    assert collapse(df.limit(0))[1].count() == 0


def test_collapse_hot_group(spark):
    """A third of all rows in one group, beside groups past the broadcast ones."""
    rows = [(f"h{i:05}", ["Same note.", "same NOTE", "same,note"][i % 3]) for i in range(3000)] + [(f"p{i:04}{j}", f"note number {i}" + "!" * j) for i in range(1500) for j in range(2)]
    groups, copies = collapse(spark.createDataFrame(rows, "id string, content string"))
    assert groups.count() == 1501 and copies.count() == 2999 + 1500


CASES = [
    ("Bitte Sofia N. Mardovar anrufen, Tel. 558 555 0125.", {("person_name", "Sofia N. Mardovar"), ("phone", "558 555 0125")}),
    ("Para Zeki escribe a maria.zan+kevo@example.org o llama al 07700-900-065.", {("email", "maria.zan+kevo@example.org"), ("phone", "07700-900-065")}),
    ("User said their SSN: 949-44-2670 and asked to forget it.", {("id_number", "949-44-2670")}),
    ("lost my passport no. X 6813284 near Calle de la Noria n.º 27, please", {("id_number", "X 6813284"), ("street_address", "Calle de la Noria n.º 27")}),
    ("The landlord at 119 Old Tannery Rd. is called Henrik Fenmitch, says Zo.", {("street_address", "119 Old Tannery Rd."), ("person_name", "Henrik Fenmitch")}),
    ("Order 2426-49-1997 for Sibabero contains 9 adapters.", set()),
    ("Job 5550935977 of Zonofegu ended after 40.2 seconds.", set()),
    ("Version 1.88.3.16 reads Grace Period and Will Clause from the import job.", set()),
    ("Set Vidarete to 192.0.2.74 port 8049, mask 255.255.255.0.", set()),
]


def test_personal_information(spark):
    rng = random.Random(2)
    # Enough texts for the votes to tell labelers apart.
    rows = [("t", f"{i:05}", CASES[i % len(CASES)][0] + " note" * rng.randrange(3)) for i in range(900)] + [("t", "none", None), ("t", "empty", ""), ("t", "long", "word " * 50_000 + CASES[2][0])]
    df = spark.createDataFrame(rows, "record_table string, record_id string, content string")
    spans, reliability = pii.find_personal(df)
    found = {r.record_id: {(s.kind, s.item) for s in r.spans} for r in spans.collect()}
    for i in range(len(CASES)):
        assert found.get(f"{i:05}", set()) == CASES[i][1], CASES[i][0]
    assert found["long"] == CASES[2][1] and not found.get("empty") and "none" not in found
    assert reliability["id_number"]["for"][1] > 0.9
    text = {r.record_id: r.content for r in pii.masked(df, spans).collect()}
    assert text["00002"].startswith("User said their SSN: [ID_NUMBER] and asked to forget it.") and text["none"] is None and text["empty"] == ""
    assert pii.find_personal(df.limit(0))[0].count() == 0


HELD_GIVEN = "Oksana Thandiwe Ngozi Bjarne Solveig Aoife Siobhan Kenji Anahit Tamar Ludmila Dragan Zeynep Farhad Ayesha Chidi Itziar Mirela Ragnhild Sigurd Tuomas Wiremu Yaroslav Zuzanna Quentin Harriet Cosmo Delphine Ottavia Leticia".split()
HELD_SURNAMES = "Hrytsenko Mokoena Adeyemi Haugen Lindqvist O'Callaghan Brennan Fujimoto Petrosyan Beridze Sokolova Jovanović Demir Rostami Qureshi Okonkwo Etxeberria Popescu Solberg Eriksen Virtanen Tamihana Bondarenko Wiśniewska Ashworth Featherstone Pemberton Marchand Bellini Quiroga".split()
HELD_TEXTS = [
    "Spoke with {} today, who preferred the shared list.", "Please call {} on Monday about the backup.", "Dr. {} confirmed the appointment for the travel plan.", "my name is {} and I live near the station.", "{} wrote that the index is stale.",
    "Signed for the parcel by {}, tax ID was checked.", "The invite list: {}; the others follow.", "Bitte {} wegen der Sicherung anrufen.", "Met {} at the kitchen tablet after lunch.", "The gift is for {}: ship it soon.", "name = {}\nstatus = open",
    "{} <someone@example.org> asked for the plan.", "Écrire à notre collègue, ou appeler {} demain.", "La cita es mañana; pregunta por {}.", "Dear {}, the queue is empty.",
]


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_names_on_no_list(spark):
    """Names that no gazetteer holds, in sentences of many kinds among the test tables' texts."""
    assert not {w.lower() for w in HELD_GIVEN} & {w.lower() for w in pii.GIVEN} and not set(HELD_SURNAMES) & set(pii.SURNAMES)
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(300):
        g, s = rng.choice(HELD_GIVEN), rng.choice(HELD_SURNAMES)
        name = rng.choice([f"{g} {s}", f"{g} {s}", f"{g[0]}. {s}", f"{g} {rng.choice('ABCDE')}. {s}", f"{s}, {g}", f"{g} {s}-{rng.choice(HELD_SURNAMES)}"])
        truth[f"h{i:03}"] = name
        rows.append(("t", f"h{i:03}", HELD_TEXTS[i % len(HELD_TEXTS)].format(name)))
    parts = [spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{n}.parquet").select(F.lit(n).alias("record_table"), F.col("id").alias("record_id"), "content") for n in ("working_memory", "episodic_memory")]
    both = parts[0].unionByName(parts[1]).where("record_id is not null and content is not null").dropDuplicates(["record_table", "record_id"])
    spans, _ = pii.find_personal(both.unionByName(spark.createDataFrame(rows, "record_table string, record_id string, content string")))
    found = {r.record_id: [s.item for s in r.spans] for r in spans.where("record_table = 't'").collect()}
    recall = sum(name in found.get(key, []) for key, name in truth.items()) / len(truth)
    assert recall >= 0.9, recall


def test_captions_are_no_names(spark):
    texts = ["Version 1.2 reads Grace Period and Will Clause from the import job.", "Mark Complete and Rose Garden are labels of Hodete.", "Spoke with Maria Smith today.", "Please call Robert Johnson on Monday."]
    df = spark.createDataFrame([("t", f"{i:04}", texts[i % 4]) for i in range(400)], "record_table string, record_id string, content string")
    found = {r.record_id: [s.item for s in r.spans] for r in pii.find_personal(df)[0].collect()}
    assert [found.get(f"{i:04}", []) for i in range(4)] == [[], [], ["Maria Smith"], ["Robert Johnson"]]


def _rank_ok(rows, groups):
    by = {}
    for r in rows:
        by.setdefault(tuple(r[g] for g in groups), []).append(r["rank"])
    return all(sorted(v) == list(range(len(v))) for v in by.values())


def test_rank_is_a_numbering(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k")).unionByName(spark.range(500).select(F.lit(0).alias("g"), F.lit(7).alias("k")))
    assert _rank_ok(tokens.with_rank(df, ["g"], F.col("k")).collect(), ["g"])
    assert _rank_ok(tokens.with_rank(df, ["g"], F.col("k"), per_bucket=100).collect(), ["g"])


def test_tokens_of_awkward_texts(spark):
    texts = [None, "", "a <|endoftext|> b", " " * 20_000, "x" * 100_000, "Ünï çödé\n\n" * 50, "don't stop 12345"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("tokens", F.lit("clash"))
    quick = {r.key: r.tokens for r in tokens.token_counts(df, "i", "t").collect()}
    assert quick == {r.key: r.tokens for r in tokens.token_counts(df, "i", "t", path="/opt/tokenizers/byte_bpe_50k.json").collect()}
    assert quick[0] == quick[1] == 0 and quick[3] > 0


def test_placement_meets_one_row(spark):
    """Join rows an item stay one, however many ranges the plan has for its length."""
    rng = np.random.default_rng(3)
    histogram = dict(zip(*np.unique(rng.lognormal(4.5, 1.2, 200_000).astype(int).clip(1, 512), return_counts=True)))
    rows = packing._by_length(1, packing.plan_containers(histogram, 512)[0])
    assert len(rows) == len(histogram) and max(len(r[2]) for r in rows) > 8
    for _, length, lo, _, _ in rows:
        assert lo == sorted(set(lo)) and lo[0] == 0


def test_mixing_refuses_too_many_targets(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a", 5)], "key long, source string, tokens long")
    twice = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        mixing.mix(items, twice)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.mix(items, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], twice.schema))


def test_mixing_of_all_tokens(spark):
    items = spark.createDataFrame([(i, "big" if i % 10 else "small", 10 + i % 7) for i in range(1000)], "key long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    shares = {r.source: r for r in mixing.mix(items, targets, nearest=True)[1].collect()}
    have = items.groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    have = {r.source: r.t for r in have}
    # The small source gives all it can, the big one the rest.
    assert shares["small"].tokens == 3 * have["small"]
    assert shares["big"].tokens + shares["small"].tokens == pytest.approx(sum(have.values()), abs=20)


@pytest.mark.parametrize("seed", [1, 2])
def test_packing(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = np.concatenate([rng.lognormal(4.5, 1.0, 3000).astype(int) + 1, np.full(1500, 97), [0, 1, 512, 513, 5000]])
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "key long, tokens long")
    got = packing.pack(items, [(1, 512), (2, 64)]).toPandas()
    for spec, cap in ((1, 512), (2, 64)):
        g = got[got.spec_id == spec]
        assert g.groupby("container").tokens.sum().max() <= cap
        per_item = g.groupby("key")
        assert (per_item.tokens.sum() == items.where("tokens > 0").toPandas().set_index("key").tokens).all()
        assert (per_item.size() == -(-sizes[sizes > 0] // cap)).all()
        n, least = g.container.nunique(), -(-int(sizes.sum()) // cap)
        # Half of the items are 33 of 64, which no two share.
        assert set(g.container) == set(range(n)) and n <= (1.01 if cap == 512 else 1.1) * least + 1
    assert packing.pack(items.limit(0), [(1, 512)]).count() == 0


def test_repeats_solve_least_squares():
    histogram = np.zeros(11)
    histogram[[4, 6]] = 5
    x = packing.solve_repeats([(6, 4)], histogram)
    assert x[0] == pytest.approx(5, abs=1e-3)


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "big", int(t)) for i, t in enumerate(rng.integers(1, 400, 3000))] + [(10_000 + i, "small", int(t)) for i, t in enumerate(rng.integers(1, 400, 200))] + [(1, None, 5), (2, "unlisted", 5), (3, "big", 0)]
    items = spark.createDataFrame(rows, "key long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(items, targets)
    shares = {r.source: r for r in report.collect()}
    assert shares["big"].actual_share == pytest.approx(0.7 / 0.9, abs=2e-3) and shares["small"].actual_share == pytest.approx(0.2 / 0.9, abs=2e-3)
    assert shares["absent"].uses == 0 and shares["small"].most <= 4 and shares["big"].most <= 1
    pdf = uses.toPandas()
    assert not pdf.key.duplicated().any() and set(pdf.source) == {"big", "small"}
    assert mixing.mix(items.limit(0), targets)[0].count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_quality_held_out(spark):
    """Fitted on half of the labelled rows, the other half as documents."""
    samples = spark.read.parquet(f"{DATA}/quality_samples.parquet")
    words = spark.read.parquet(f"{DATA}/common_words.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    held = samples.where("sample_id div 5 % 2 = 0").select((F.col("sample_id") + 10_000_000).alias("doc_id"), "text", "lang")
    extra = spark.createDataFrame([(20_000_001, None, "en"), (20_000_002, "  \n", "en"), (20_000_003, "word " * 100_000, None), (20_000_004, "ok", "zz-XX")], "doc_id long, text string, lang string")
    out = quality.classify(docs.unionByName(held).unionByName(extra), samples.where("sample_id div 5 % 2 = 1"), words).toPandas().set_index("doc_id")
    truth = {r.sample_id + 10_000_000: r.text_class for r in samples.where("sample_id div 5 % 2 = 0").collect()}
    right = sum(out.text_class[k] == v for k, v in truth.items())
    assert right / len(truth) >= 0.93
    assert 20_000_001 not in out.index and 20_000_002 not in out.index and 20_000_003 in out.index and 20_000_004 in out.index
    row = out.iloc[0]
    assert sum(row.contributions.values()) == pytest.approx(row.outlierness)


def test_quality_without_words_samples_or_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "One plain sentence is here. Another one follows it.", "xx"), (2, "a | b\nc | d\ne | f", None), (3, None, "en"), (4, "Ein Satz mit ö und ü steht hier.", "de")], "doc_id long, text string, lang string").withColumn("language", F.lit("clash"))
    samples = spark.createDataFrame([], "sample_id int, text string, lang string, text_class string")
    words = spark.createDataFrame([], "lang string, word string")
    # No label: everything with a text is prose; no common words: one language for all.
    out = {r.doc_id: (r.text_class, r.language) for r in quality.classify(docs, samples, words).collect()}
    assert out == {1: ("prose", ""), 2: ("prose", ""), 4: ("prose", "")}
    assert quality.classify(docs.limit(0), samples, words).count() == 0
    monkeypatch.setattr(quality, "MAX_WORDS", 1)
    with pytest.raises(ValueError):
        quality.classify(docs, samples, spark.createDataFrame([("en", "the"), ("en", "of")], words.schema))


def test_collapse_looks_through_json_escapes(spark):
    rows = [("a", json.dumps({"owner": "zoë \n groß", "topic": None})), ("b", "owner: ZOË GROSS\ntopic: x"), ("c", json.dumps({"topic": "", "owner": "Zoë\tGROß"}, ensure_ascii=False)), ("d", "owner: zoë gross | topic: x")]
    copies = {tuple(r) for r in collapse(spark.createDataFrame(rows, "id string, content string"))[1].collect()}
    assert copies == {("a", "c"), ("b", "d")}

"""Core problems against brute force, with the awkward cases."""

import random

import pytest
from brute_instants import read
from pyspark.sql import functions as F

from palimpsest.functions.instants import RULED_OUT, SOFT, with_candidates, with_instant
from palimpsest.operators.changes import present_state
from palimpsest.operators.intervals import OPEN_US, merge_intervals
from palimpsest.operators.late import count_state, merge_states, period_counts, period_statistics
from palimpsest.operators.timestamps import normalise_timestamps, solve_block, step_cost

TEXTS = [
    ("2025-03-30 02:30:00", "Europe/Berlin", "de-DE"), ("2024-11-03 01:30:00", "America/New_York", "en-US"), ("04/03/2025 19:13:07", "UTC", "en-US"), ("04/03/2025 19:13:07", "UTC", "en-GB"),
    ("4/4/2025, 12:46 AM", "Asia/Kolkata", "en-IN"), ("4/4/2025, 12:46 PM", None, None), ("20250331T184318Z", "Asia/Tokyo", "ja-JP"), ("20220601", None, None), ("1742682257361", None, None), ("1742682257", None, None),
    ("1742682257.392", None, None), ("1742682257361123", None, None), ("Sat, 22 Mar 2025 16:54:53 +0100", "UTC", None), ("Fri, 22 Mar 2025 16:54:53 +0100", "UTC", None), ("2025-02-30", None, None), ("0000-00-00 00:00:00", None, None),
    ("2025-04-08T28:66:00Z", None, None), ("", None, None), (None, None, None), ("just now", None, None), ("-", None, None), (" 2025-04-06T01:15:37Z ", None, None), ("2025-04-01 23:52:58 AEDT", "UTC", None), ("9 Jul 2023", None, None),
    ("2025-03-13 15:26:59,481", "Europe/Berlin", "de-DE"), ("2024-09-01T02:29:45.254913748Z", None, None), ("2025-03-03T07:13:19+01:00[Europe/Berlin]", "Asia/Tokyo", None), ("29.02.2024 05:00", "Australia/Sydney", "en-AU"), ("x" * 100_000, None, None),
]


def test_instants_match_brute_force(spark):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "i int, t string, z string, l string")
    got = {r.i: r.us for r in with_instant(df, "t", F.col("z"), F.col("l"), "us").collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == read(*t), t


def test_candidates_keep_all_readings(spark):
    df = spark.createDataFrame([("04/03/2025 10:00", None), ("2024-11-03 01:30:00", None)], "t string, l string")
    rows = with_candidates(df, "t", F.lit("America/New_York"), F.col("l"), infer=True).collect()
    assert len(rows[0].candidates) == 2 and {c.prior for c in rows[0].candidates} == {0.0, SOFT}
    first, later = sorted(rows[1].candidates, key=lambda c: c.us)
    assert later.us - first.us == 3_600_000_000 and first.prior == 0 and later.prior == RULED_OUT


def brute_path(rows):
    best = {(): 0.0}
    for _, options in rows:
        new = {}
        for path, cost in best.items():
            for p, f, u in options:
                total = cost + p + (step_cost(path[-1], (f, u)) if path else 0.0)
                new[(*path, (f, u))] = min(total, new.get((*path, (f, u)), total))
        best = new
    return min(best.values())


def test_blocks_solve_exactly():
    rng = random.Random(3)
    for _ in range(40):
        rows = [(str(i), [(rng.random(), rng.choice("abc"), rng.randrange(10) * 10**8) for _ in range(rng.choice((1, 1, 2, 3)))]) for i in range(rng.randrange(1, 7))]
        costs, _ = solve_block(rows)
        assert min(costs) == pytest.approx(brute_path(rows))


def test_undeclared_order_follows_the_path(spark):
    """Without a declared locale the record order decides between day and month first, across block borders."""
    day = 86_400_000_000
    base = 1_735_689_600_000_000
    texts = ["01/02/2025 10:00", "15/02/2025 10:00", "03/03/2025 10:00", "04/03/2025 10:00", "05/04/2025 10:00"]
    rows = [(f"k{i}", "dev", t, base + n * day) for i, (t, n) in enumerate(zip(texts, (31, 45, 61, 62, 94)))]
    df = spark.createDataFrame([*rows, ("k9", "dev", "n/a", base), ("k8", None, None, None)], "key string, source string, text string, arrived_us long")
    got = {r.key: r.us for r in normalise_timestamps(df, F.lit("UTC"), F.lit(None).cast("string"), [], block_us=7 * day, infer=True).collect()}
    for key, _, text, _ in rows:
        assert got[key] == read(text, "UTC", "en-GB"), text
    assert got["k9"] is None and got["k8"] is None


@pytest.mark.parametrize("block_rows", [1, 2, 500_000])
def test_the_path_overrules_day_first(spark, block_rows):
    """Month first, as the unmistakable neighbours of the same source have it, though alone each text would be read day first."""
    day = 86_400_000_000
    texts = ["02/20/2025 10:00", "03/04/2025 10:00", "03/25/2025 10:00", "04/02/2025 10:00", "04/20/2025 10:00"]
    rows = [(f"k{i}", "dev", t, 1_745_000_000_000_000 + i * day // 8) for i, t in enumerate(texts)] + [(f"n{i}", "dev", "05/06/2025 10:00", None) for i in range(6)]
    rows += [("c0", "t", "20250110", 1), ("c1", "t", "2025-01-11", 2), ("d0", "u", "03/04/2025 10:00", 5)]
    df = spark.createDataFrame(rows, "key string, source string, text string, arrived_us long")
    got = {r.key: r for r in normalise_timestamps(df, F.lit("UTC"), F.lit(None).cast("string"), [], infer=True, block_rows=block_rows).collect()}
    for key, source, text, arrived in rows[:5]:
        assert got[key].us == read(text, "UTC", "en-US"), text
    assert got["k1"].by_path and got["k3"].by_path and not got["k0"].by_path
    # Nothing speaks against the date, nor against day first.
    assert got["c0"].us == read("20250110", "UTC", None) and got["d0"].us == read("03/04/2025 10:00", "UTC", None) and len(got) == len(rows)


def brute_periods(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and s < e:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged} | {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize(("ladder", "dense"), [((64,), 1), ((640, 64, 16, 4), 30), ((1280, 128, 8, 1), 3), ((64, 32), 10**6)])
def test_intervals_match_brute_force(spark, ladder, dense):
    rng = random.Random(dense)
    rows = [(rng.choice(["a", "b", None]), s := rng.randrange(-300, 300), s + rng.choice([-5, 0, 1, 3, 10, 40, 200])) for _ in range(400)]
    rows += [("c", 5, OPEN_US), ("c", 0, 3), ("c", None, 9), ("c", 9, None), ("d", 10, 20), ("d", 20, 30), ("d", 10, 20), ("e", 0, 640), ("e", 700, 710), ("e", 64, 128), ("e", 650, 660)]
    rows += [("f", s := rng.randrange(0, 64), s + rng.choice([1, 2])) for _ in range(60)] + [("f", -1000, 64), ("g", 0, 2), ("g", 5, 7), ("g", 9, 64), ("g", 0, 64), ("g", 70, 71), ("h", 3, 4), ("h", 6, 7), ("h", 10, 11), ("h", -64, 2000)]
    df = spark.createDataFrame(rows, "k string, s long, e long").withColumn("kind", F.lit("clash"))
    got = [tuple(r) for r in merge_intervals(df, ["k"], "s", "e", ladder, dense).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_periods(rows)


def test_a_crowded_day_of_one_entity(spark):
    """10^6 intervals of one entity within a day: its shard is divided, so that no task sorts more than a part."""
    day = 86_400_000_000
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 80_000).alias("s"), (F.col("id") * 80_000 + F.when(F.col("id") % 4 == 3, 40_000).otherwise(80_000)).alias("e"))
    got = merge_intervals(df, ["k"], "s", "e", (64 * day, day, day // 64), 100_000)
    assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == {"period": n // 4, "gap": n // 4 - 1}
    ends = got.where("kind = 'period'").agg(F.min("start_us").alias("a"), F.max("end_us").alias("b"), F.sum(F.col("end_us") - F.col("start_us")).alias("c")).first()
    assert (ends.a, ends.b, ends.c) == (0, n * 80_000 - 40_000, n // 4 * 280_000)


def test_intervals_of_nothing(spark):
    assert merge_intervals(spark.createDataFrame([], "k string, s long, e long"), ["k"], "s", "e").count() == 0


def test_late_events(spark):
    h = 3_600_000_000
    rows = [("a", 10, 20, 1.0), ("a", 20, h, 3.0), ("a", 30, h + 1, 9.0), ("a", 40, 25 * h, 3.0), ("a", 50, 25 * h + 1, 100.0), ("a", None, 5, 1.0), ("a", 5, None, 1.0), (None, 5, 5, None), ("b", -1, 0, 2.0)]
    events = spark.createDataFrame(rows, "key string, event_us long, arrived_us long, value double")
    counts = {(r.key, r.period_start_us): (r.n_first, r.n_final, r.n_dropped) for r in period_counts(count_state(events)).collect()}
    assert counts == {("a", 0): (2, 4, 1), (None, 0): (1, 1, 0), ("b", -h): (1, 1, 0)}
    stats = {(r.key, r.period_start_us): r for r in period_statistics(count_state(events)).collect()}
    a = stats[("a", 0)]
    assert (a.median_first, a.median_final, a.min_final, a.max_final, a.n_values_final) == (2.0, 3.0, 1.0, 9.0, 3)
    assert stats[(None, 0)].median_final is None
    # States of disjoint batches add up to the state of all.
    parts = merge_states(count_state(events.where("value < 4")), count_state(events.where("value >= 4 or value is null")))
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in count_state(events).collect()}


def brute_state(events):
    import json

    def body(p):
        try:
            x = json.loads(p)
            x = json.loads(x) if isinstance(x, str) else x
        except (TypeError, ValueError):
            return None
        return x if isinstance(x, dict) else None

    live = {}
    for e in sorted({e[:6] for e in events if e[5] is not None and e[1] is not None}, key=lambda e: (e[5], e[3] or "", e[0])):
        eid, mid, op, _, payload, _ = e
        b = body(payload)
        if op == "CREATE" and b is not None:
            live[mid] = {"last": eid, "content": (eid, b["content"]) if b.get("content") is not None else None}
        elif mid in live and op == "DELETE":
            del live[mid]
        elif mid in live and (op == "CONSOLIDATE" or op == "UPDATE" and b is not None):
            live[mid]["last"] = eid
            if op == "UPDATE" and b.get("content") is not None:
                live[mid]["content"] = (eid, b["content"])
    return {(m, s["last"], s["content"] and s["content"][0], s["content"] and s["content"][1]) for m, s in live.items()}


def test_changes_match_brute_force(spark):
    rng = random.Random(5)
    payloads = ['{"content":"x"}', '{"content":null,"importance":0.5}', '{"importance":1}', '"{\\"content\\":\\"w\\"}"', '{"content":"cut', None, "[]", "null", "{}"]
    rows = []
    for i in range(600):
        row = (f"e{i:04}", rng.choice(["m1", "m2", "m3", "m4", None]), rng.choice(["CREATE", "UPDATE", "UPDATE", "DELETE", "CONSOLIDATE", "OTHER"]), rng.choice(["d1", "d2", None]), rng.choice(payloads), rng.choice([None, *range(40)]))
        rows += [row] * rng.choice([1, 1, 2])
    events = spark.createDataFrame(rows, "event_id string, memory_id string, operation string, device_id string, payload string, instant_us long")
    for chunk in range(1, 5):
        some = [r for r in rows if r[5] is None or r[5] < chunk * 10]
        got = {(r.memory_id, r.last_event_id, r.content_event_id, r.content) for r in present_state(events.where(f"instant_us is null or instant_us < {chunk * 10}")).collect()}
        assert got == brute_state(some)
    assert present_state(events.limit(0)).count() == 0

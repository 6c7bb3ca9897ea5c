import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import deliveries, snapshots

M = "target_identity string, generation string, manifest_kind string, created_at timestamp, snapshot_hash string, fact_value string"
FACT = "target_identity string, generation string, fact_id string, fact_value string, ord int, fact_row long, created_at string"


def brute(manifests, facts):
    snaps = {}
    for t, g, kind, at, *_ in manifests:
        if kind == "trusted":
            snaps.setdefault(t, {})[g] = at
    held = {}
    for t, g, f, v, o, r, *_ in sorted(facts, key=lambda x: (x[4], x[5])):
        held.setdefault((t, g), {}).setdefault(f, snapshots.canonical_json(v) or "null")
    out = set()
    for t, gs in snaps.items():
        order = sorted(gs, key=lambda g: (gs[g], g))
        for a, b in zip(order, order[1:]):
            x, y = held.get((t, a), {}), held.get((t, b), {})
            for k in x.keys() | y.keys():
                kind = "added" if k not in x else "removed" if k not in y else "changed" if x[k] != y[k] else None
                if kind:
                    out.add((t, b, k, kind))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    values = ["1", "1.0", "1e0", '"a"', '"\\u0061"', '"é"', '"e\\u0301"', "null", None, "[1, 2]", "[1,2.0]", "true", '"true"', '{"b":1,"a":2}', '{"a":2,"b":1}']
    manifests, rows, n = [], [], 0
    for t in ("aa", "00ff", "Other"):
        for i in range(25):
            at = datetime(2024, 1, 1) + timedelta(hours=rng.randrange(400))
            g = f"g{i}"
            kind = "candidate" if i % 9 == 8 else "trusted"
            made = [] if i % 7 == 3 else [(f"f{k}", rng.choice(values), 0) for k in range(6) if rng.random() < 0.7]
            same = f"h{t}{g}"
            for _ in range(rng.choice([1, 1, 2])):
                manifests.append((t, g, kind, at, same, "clash"))
            for f, v, o in made:
                rows.append((t, g, f, v, o, n, "clash"))
                n += 1
                if rng.random() < 0.2:
                    rows.append((t, g, f, rng.choice(values), 5, n, "clash"))
                    n += 1
    rows.append(("lost", "g0", "f", "1", 0, n, ""))
    got = snapshots.snapshot_changes(spark.createDataFrame(manifests, M), spark.createDataFrame(rows, FACT))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(manifests, rows)


def test_equal_hashes_in_a_row_are_skipped(spark):
    at = [datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    manifests = [("aa", f"g{i}", "trusted", at[i], h, "") for i, h in enumerate(["x", "x", "y", "x"])]
    rows = [("aa", f"g{i}", "f", v, 0, i, "") for i, v in enumerate(["1", "1.00", "2", "1"])]
    got = snapshots.snapshot_changes(spark.createDataFrame(manifests, M), spark.createDataFrame(rows, FACT))
    assert sorted(tuple(r) for r in got.collect()) == [("aa", "g2", "f", "changed"), ("aa", "g3", "f", "changed")]


def test_empty_tables(spark):
    none = snapshots.snapshot_changes(spark.createDataFrame([], M), spark.createDataFrame([], FACT))
    assert none.count() == 0


@pytest.mark.parametrize("a, b, same", [("0.0", "-0", True), ("1E2", "100", True), ('"1"', "1", False), ("null", None, True), ("{bad", "{bad", True), ("[]", "{}", False), (' "x" ', '"x"', True)])
def test_value_hash(spark, a, b, same):
    df = spark.createDataFrame([(a,), (b,)], "v string").select(snapshots.value_hash("v").alias("h"))
    x, y = [r.h for r in df.collect()]
    assert (x == y) == same


def test_packed_keys_round_trip(spark):
    df = spark.createDataFrame([("00ff",), ("Ab",), ("",), ("é",), ("0",)], "k string")
    packed = df.select("k", snapshots.packed_key("k").alias("p")).select("k", snapshots.unpacked_key("p").alias("u"))
    assert all(r.k == r.u for r in packed.collect())


P = "payload_row long, delivery_id string, generated_at string, change_id string"
C = "change_row long, change_id string, payload_row long, generated_at string"


def test_surplus_copies(spark):
    payloads = [
        (1, " AB ", "2024-01-01T10:00:00.000+02:00", ""),
        (2, "ab", "2024-01-01T09:00:00.000Z", ""),
        (3, "ab\n", None, ""),
        (4, None, "2024-01-01T09:00:00Z", ""),
        (5, None, "2024-01-01T09:00:00Z", ""),
        (6, "  ", None, ""),
        (7, "c", None, ""),
        (8, "C", None, ""),
        (9, "d", "no time", ""),
        (10, "D", "2030-01-01T00:00:00Z", ""),
        (None, "ab", "2020-01-01T00:00:00Z", ""),
    ]
    changes = [(1, "x", 2, ""), (2, "X ", 1, ""), (3, "x", 99, ""), (4, None, 1, ""), (5, "y", None, ""), (6, "Y", None, "")]
    got = deliveries.surplus_deliveries(spark.createDataFrame(payloads, P), spark.createDataFrame(changes, C))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("change", 1), ("change", 3), ("change", 6),
        ("payload", 2), ("payload", 3), ("payload", 8), ("payload", 9),
    ]
    kept = deliveries.deduplicate(spark.createDataFrame(payloads, P), "delivery_id", deliveries.delivery_instant("generated_at"), "payload_row")
    assert sorted(r.payload_row or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 10]
    none = deliveries.surplus_deliveries(spark.createDataFrame([], P), spark.createDataFrame([], C))
    assert none.count() == 0


def test_kept_copy_is_a_hash_aggregation(spark):
    rows = spark.createDataFrame([("a", 1, 1)], "ident string, instant long, row_no long")
    plan = deliveries.kept_copies(rows)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_manifests_and_promotions(spark):
    from tidemark.operators import history

    a, b, t = "a" * 64, "b" * 64, "c" * 64
    day = "2026-01-0{}"
    schema = (
        "target_identity string, manifest_kind string, candidate_id string, generation string, snapshot_hash string, "
        "trusted_parent_snapshot_hash string, byte_length long, created_at string, updated_at string"
    )
    rows = [
        (t, "trusted", None, "g1", a, None, 5, day.format(1), day.format(1)),
        (t, "candidate", "c1", "g2", b, a, 5, day.format(2), day.format(2)),
        (t, "other", None, "g", a, None, 5, "x", "x"), ("short", "trusted", None, "g", a, None, 5, "x", "x"),
        (t, "trusted", None, "g g", a, None, 5, "x", "x"), (t, "trusted", None, None, a, None, 5, "x", "x"), (t, "trusted", None, "g", None, None, 5, "x", "x"),
        (t, "trusted", None, "g", a, None, 5, None, "x"), (t, "trusted", None, "g", a, None, 1, "x", "x"),
        (t, "candidate", "bad id", "g", a, None, 5, "x", "x"), (t, "candidate", "c", "g", a, "nohash", 5, "x", "x"), (None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    found = [r.p for r in df.select(history.manifest_problem(df).alias("p")).collect()]
    assert found == [None, None, "kind", "identity", "hash_or_generation", "hash_or_generation", "hash_or_generation", "timestamps", "byte_length", "lineage", "lineage", "kind"]
    chunked = df.limit(2).selectExpr("*", "33 AS chunk_count", "3 AS history_length")
    assert [r.p for r in chunked.select(history.manifest_problem(chunked).alias("p")).collect()] == ["chunks", "chunks"]
    asked = [(t, "c1", b, a), (t, "c1", a, a), (t, "c1", b, "NO_PARENT"), (t, "nobody", b, a), ("d" * 64, "c1", b, a), (None, None, None, None)]
    requests = spark.createDataFrame(asked, "target_identity string, candidate_id string, expected_hash string, expected_parent string")
    got = sorted((r.candidate_id or "", r.expected_hash or "", r.expected_parent or "", r.target_identity or "", r.promotion) for r in history.promotable(df, requests).collect())
    assert [g[-1] for g in got] == ["no_candidate", "hash", "parent", "match", "no_candidate", "no_candidate"]
    later = df.unionByName(spark.createDataFrame([(t, "trusted", None, "g9", b, None, 5, day.format(9), day.format(9))], schema))
    assert history.promotable(later, requests.limit(1)).first().promotion == "trusted"
    assert history.promotable(df.limit(0), requests.limit(0)).count() == 0


def test_hot_snapshots_are_split_and_give_the_same(spark, monkeypatch):
    from tidemark.operators import skew

    m = spark.createDataFrame([("t", "trusted", f"g{k}", k, f"h{k}") for k in range(4)], "target_identity string, manifest_kind string, generation string, created_at int, snapshot_hash string")
    m = m.withColumn("created_at", F.timestamp_seconds("created_at"))
    rows = [("t", f"g{k % 4}", f"f{k % 7}", str(k % 3), k % 5, k) for k in range(400)]
    f = spark.createDataFrame(rows, "target_identity string, generation string, fact_id string, fact_value string, ord int, fact_row long")
    whole = {tuple(r) for r in snapshots.snapshot_changes(m, f).collect()}
    monkeypatch.setattr(skew, "ROWS", 20)
    assert {tuple(r) for r in snapshots.snapshot_changes(m, f).collect()} == whole and whole

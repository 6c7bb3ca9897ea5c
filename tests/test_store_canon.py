import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canon
from tidemark.operators import facts, reports
from tidemark.sources.store import Conflict, VersionedTable


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.versions() == []
    assert t.commit(spark.range(3), 0) == 1
    with pytest.raises(Conflict):
        t.commit(spark.range(9), 0)
    assert t.commit(spark.range(5), 1) == 2
    assert t.read().count() == 5 and t.read(1).count() == 3 and t.read(7) is None
    t.commit(spark.range(6), 2)
    assert t.vacuum(1) == 2 and t.versions() == [3] and t.read().count() == 6


def test_two_writers(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))

    def write(n):
        try:
            return t.commit(spark.range(n), 0)
        except Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, [1, 2, 3, 4]))
    assert sorted(d for d in done if d) == [1] and t.versions() == [1]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"b": 1.0, "a": [true, null, -0.0]}', '{"a":[true,null,0],"b":1}'),
        ('{"token": "x", "a": {"apiKey": [1]}}', '{"a":{"apiKey":"[REDACTED]"},"token":"[REDACTED]"}'),
        ('{"a": "mail x@y.example", "__proto__": 1}', '{"a":"mail [REDACTED_EMAIL]"}'),
        ("[1e21, 1e-7, 0.1, 123456789.5, 1e-5]", "[1e+21,1e-7,0.1,123456789.5,0.00001]"),
        ('"e\\u0301"', '"é"'),
    ],
)
def test_canonical_text(text, expected):
    got = canon.canonical(text)
    assert got.problem is None
    assert got.text == expected or json.loads(got.text) == json.loads(expected)


def test_problems():
    cases = {"{": "no JSON", '{"body": 1}': "raw document", '"<html >"': "raw document", "NaN": "number is not finite", "[" * 20 + "]" * 20: "too deep", json.dumps([0] * 1_001): "array is too long", json.dumps([[0] * 999] * 12): "too many values"}
    assert {k: canon.canonical(k).problem for k in cases} == cases
    assert canon.canonical(None) == (None, None)


def test_hidden_values(spark):
    cases = {
        '{"a": {"password": "x", "b": ["call +1 555 123 4567"]}}': {"a": {"password": "[REDACTED]", "b": ["call [REDACTED_PHONE]"]}},
        '{"webhook": "kept", "webhook_token": 1, "__proto__": 2}': {"webhook": "kept", "webhook_token": "[REDACTED]"},
        '"mail a@b.example"': "mail [REDACTED_EMAIL]", "[1, null, true]": [1, None, True], "3": 3,
        "[" * 10 + "1" + "]" * 10: json.loads("[" * 9 + '"[TRUNCATED_DEPTH]"' + "]" * 9),
        json.dumps(list(range(300))): list(range(200)),
    }
    for text, expected in cases.items():
        assert json.loads(canon.hidden(text)) == expected, text
    assert canon.hidden(None) is None and canon.hidden("{") is None
    df = spark.createDataFrame([('{"key": 1}',), (None,), ('{"key": 1}',)], "v string")
    assert [r.h for r in df.select(canon.hidden_column(F.col("v")).alias("h")).collect()] == ['{"key": "[REDACTED]"}', None, '{"key": "[REDACTED]"}']


def test_canonical_column(spark):
    plain = ['"in_stock"', '"Basic plan"', "true", "12", '"sold out"', '"a@b.example"', "-0"]
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1.0}',), (None,), ("x",), *[(p,) for p in plain]], "v string")
    rows = [r.c for r in df.select(canon.canonical_column(F.col("v")).alias("c")).collect()]
    assert [r.text for r in rows[4:]] == [canon.canonical(p).text for p in plain] and rows[5].text == '"Basic [REDACTED]"'
    assert rows[0].hash == rows[1].hash and rows[2].hash is None and rows[3].problem == "no JSON"


def test_explanations(spark):
    rows = [("product_feature", "f", "added", None, None), ("price", "f", "removed", None, None), ("price", "p", "changed", 6.0, 20.6897), ("price", "p", "changed", -2.5, None), ("terms_policy", "t", "changed", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d double, e double")
    got = [r[0] for r in df.select(facts.explanation(*[F.col(c) for c in "abcde"])).collect()]
    assert got == ["Product feature was added at f.", "Price was removed from f.", "Price increased by 6 (20.6897%) at p.", "Price decreased by 2.5 at p.", "Terms policy changed at t."]


def test_payload_documents(spark):
    rows = [(k, f"c{k}", "n", "u", "price", "f", "low", k, 1, None) for k in range(12)] + [(99, None, "n", "u", "price", "f", "high", 1, 2, None)]
    df = spark.createDataFrame(rows, "change_row long, change_id string, target_name string, target_url string, category string, field_path string, severity string, confidence_score int, payload_row long, total string")
    got = {r.payload_row: json.loads(r.payload) for r in reports.payload_documents(df, "payload_row").collect()}
    assert got[1]["totalEligibleChanges"] == 12 and [c["change_id"] for c in got[1]["changes"]] == [f"c{k}" for k in range(11, 1, -1)]
    assert set(got) == {1} and len(got[1]["deliveryId"]) == 64

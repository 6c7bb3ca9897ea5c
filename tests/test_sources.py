import json

from pyspark.sql import functions as F

from tidemark.operators import reports
from tidemark.sources import config, robots

FILE = """# comment
User-agent: *
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$
User-agent: tidemark
User-agent: other
Disallow: /a*b
"""


def test_rules():
    assert robots.allowed(FILE, "someone", "/x") and not robots.allowed(FILE, "someone", "/private/y")
    assert robots.allowed(FILE, "someone", "/private/open/z")
    assert not robots.allowed(FILE, "someone", "/f.pdf") and robots.allowed(FILE, "someone", "/f.pdf?x")
    assert robots.allowed(FILE, "Tidemark", "/private") and not robots.allowed(FILE, "Tidemark", "/a-x-b")
    assert robots.allowed(None, "x", None) and robots.allowed("", "x", "/") and robots.allowed("nonsense", "x", "/")


def test_readable_pages(spark):
    pages = spark.createDataFrame([("h", "/private", "k"), ("h", "/ok", "k"), ("i", "/private", "k"), (None, "/x", "k")], "host string, path string, robots string")
    files = spark.createDataFrame([("h", FILE)], "host string, robots string")
    got = sorted((r.host or "", r.path) for r in robots.readable(pages, files, "someone").collect())
    assert got == [("", "/x"), ("h", "/ok"), ("i", "/private")]


def test_status_of_a_robots_file_decides_first(spark):
    pages = spark.createDataFrame([(h, "/private") for h in "abcdefgh"] + [("e", "/ok"), (None, "/x")], "host string, path string")
    long = "x" * (robots.MAX_BYTES + 1)
    rows = [("a", 404, FILE), ("b", 204, None), ("c", 403, ""), ("d", 500, ""), ("e", 200, FILE), ("f", None, ""), ("g", 200, long)]
    files = spark.createDataFrame(rows, "host string, status int, robots string")
    got = sorted((r.host, r.path) for r in robots.readable(pages, files, "someone").collect())
    assert got == [("a", "/private"), ("b", "/private"), ("e", "/ok")]


def test_targets(spark, tmp_path):
    good = {"name": "Shop", "url": "https://x.example/", "changeTypes": ["price"], "currency": "USD"}
    rows = [
        good,
        {**good, "extra": 1},
        {**good, "name": " ", "url": "http://x.example/"},
        {**good, "changeTypes": ["price", "price"], "currency": "us$"},
        {**good, "changeTypes": ["none"], "ignoreTextPatterns": ["a(b"]},
        {**good, "name": "SHOP", "includeSelectors": ["a"] * 11},
    ]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    made = config.read_targets(spark, str(tmp_path / "t.json"))
    problems = [r.problems for r in made.collect()]
    assert problems[:6] == [[], ["unknown fields: extra"], ["name", "url: scheme"], ["changeTypes repeat", "currency"], ["changeTypes", "ignoreTextPatterns: no plain glob"], ["includeSelectors"]]
    assert "no object" in problems[6]
    assert [tuple(r) for r in config.repeated_names(made).collect()] == [("shop", 5)]


def test_more_of_targets(spark):
    good = {"name": "A", "url": "https://x.example/", "changeTypes": ["price"]}
    cases = [
        ({"currency": " usd "}, []), ({"excludeSelectors": ["a", "a"]}, ["excludeSelectors"]), ({"includeSelectors": [""]}, ["includeSelectors"]),
        ({"ignoreTextPatterns": ["x" * 129]}, ["ignoreTextPatterns"]), ({"authorizedRedirectOrigins": ["https://y.example", "https://z.example/"]}, []),
        ({"authorizedRedirectOrigins": ["https://y.example/p"]}, ["authorizedRedirectOrigins: no origin"]),
        ({"productIdentifiers": {"sku": "1", "gtin": "12345678"}}, []), ({"productIdentifiers": {"gtin": "1234567x"}}, ["productIdentifiers"]),
        ({"productIdentifiers": {"other": "1"}}, ["productIdentifiers"]), ({"productIdentifiers": {"sku": None}}, ["productIdentifiers"]),
    ]
    df = spark.createDataFrame([(json.dumps({**good, **more}),) for more, _ in cases], "json string")
    rows = config.check_targets(df).collect()
    assert [r.problems for r in rows] == [p for _, p in cases] and rows[0].target.currency == "USD"


def test_runs(spark):
    cases = [
        ({}, []), ({"weeklyDigestDay": 7, "maxRetries": 2.0, "timezone": None, "dryRun": True}, []), ({"weeklyDigestDay": "7"}, ["weeklyDigestDay"]),
        ({"maxRetries": 3, "requestTimeoutSeconds": 3.5}, ["requestTimeoutSeconds", "maxRetries"]), ({"timezone": "Mars/Base"}, ["timezone"]),
        ({"timezone": "Europe/Berlin", "notificationMode": "immediate", "alertWebhookUrl": "https://x.example/h"}, []), ({"dryRun": None}, ["dryRun"]),
        ({"alertWebhookUrl": "http://x.example"}, ["alertWebhookUrl"]), ({"minimumAlertSeverity": "informational", "other": 1}, ["unknown fields: other", "minimumAlertSeverity"]),
        ({"targets": []}, ["targets"]), ({"targets": [{}] * 26}, ["targets"]), ({"candidateId": "", "expectedCandidateHash": "a" * 64}, ["candidateId"]),
    ]
    texts = [json.dumps({"targets": [{}], **more}) for more, _ in cases]
    rows = config.check_runs(spark.createDataFrame([(t,) for t in [*texts, "[1]", "x", None]], "json string")).collect()
    assert [r.problems for r in rows[: len(cases)]] == [p for _, p in cases]
    assert rows[0].run.requestTimeoutSeconds == 15 and rows[0].run.timezone == "UTC" and rows[0].run.alertWebhookUrl is None
    assert rows[1].run.maxRetries == 2 and rows[1].run.dryRun and rows[2].run.weeklyDigestDay is None
    assert all("no object" in r.problems for r in rows[len(cases) :])


def test_outputs(spark, tmp_path):
    rows = [(1, "c1", "A", "https://x.example/?token=1", "f", "high", 90), (2, "c1", "A", "u", "f", "low", 10), (3, "c2", "=B", "u", "g", "low", 10), (4, None, "C", "u", "h", "low", 10)]
    df = spark.createDataFrame(rows, "change_row long, change_id string, target_name string, target_url string, field_path string, severity string, confidence_score int")
    reports.write_outputs(reports.safe_urls(df), str(tmp_path), ["target_name", "severity"])
    assert [r.change_id for r in spark.read.json(f"{tmp_path}/digest").collect()] == ["c1", "c2"]
    lines = spark.read.option("lineSep", "\r\n").text(f"{tmp_path}/review")
    assert sorted(r.value for r in lines.collect()) == ['"\'=B","low"', '"A","high"', '"A","low"', '"C","low"']
    md = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/digest_markdown").collect())
    assert "## 1. A - high" in md and "%5BREDACTED%5D" in md


def test_rollups(spark):
    rows = [("p", "high", 90), ("p", "low", 81), ("q", "informational", None), ("q", None, 5)]
    df = spark.createDataFrame(rows, "k string, severity string, confidence_score int")
    got = {r.k: tuple(r)[1:] for r in reports.rollup(df, "k").collect()}
    assert got == {"p": (2, "high", 86), "q": (2, "informational", 5)}
    filled = {r.severity: r.n for r in reports.zero_filled(df, "severity", reports.SEVERITIES).collect()}
    assert filled == {"informational": 1, "low": 1, "medium": 0, "high": 1, "critical": 0}
    assert reports.material(df, "medium").count() == 1
    assert reports.rollup(df.filter(F.lit(False)), "k").count() == 0

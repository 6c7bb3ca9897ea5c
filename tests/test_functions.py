import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, net, numbers, text, urls
from tidemark.operators import history, reports


def run(spark, fn, *values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", fn(F.col("v")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


def test_decimal(spark):
    cases = {
        "$1,299.50": 1299.5, "1.299,50 EUR": 1299.5, "(45)": -45.0, "-7": -7.0, "0.125": 125.0, "29": 29.0, "29,5": 29.5,
        "1,000": 1000.0, "1.000.000": 1000000.0, "free": None, "": None, "$29.00.": 2900.0, "1,2.3,4": None, "per 12 of 3": 123.0,
    }
    assert run(spark, numbers.decimal, *cases, None) == [*cases.values(), None]


def test_rounding_and_percent(spark):
    df = spark.createDataFrame([(29.0, 35.0), (0.0, 5.0), (2.5, 0.0), (3.0, 2.0)], "a double, b double")
    d = numbers.delta(F.col("a"), F.col("b"))
    got = [tuple(r) for r in df.select(d, numbers.percent(F.col("a"), d), numbers.half_up(-F.col("a"), 0)).collect()]
    assert got == [(6.0, 20.6897, -29.0), (5.0, None, 0.0), (-2.5, -100.0, -2.0), (-1.0, -33.3333, -3.0)]
    assert [r[0] for r in df.select(numbers.number_text(F.col("a") / 4)).collect()] == ["7.25", "0", "0.625", "0.75"]
    assert [r[0] for r in df.select(numbers.backoff_ms(F.col("a") / 2.5)).collect()][1:3] == [250, 500]


def test_currency_unit_pack(spark):
    assert run(spark, text.currency, "USD 5", "€5", "$29 per month", "5", "£1", None) == ["USD", "EUR", "PER", None, "GBP", None]
    assert run(spark, text.unit, "5 kgs", "per month", "2 yr", "3 ml", "stone", None) == ["kg", "month", "year", "ml", None, None]
    assert run(spark, text.pack_quantity, "Pack of 12", "6 pcs", "3x", "qty: 7", "none") == ["12", "6", "3", "7", None]
    assert run(spark, text.version, "version 1.2.3 is", "v2.0", "2.0", None) == ["1.2.3", "2.0", None, None]


def test_slug_model_availability(spark):
    assert run(spark, text.slug, "Team Plan!", "  ", "Ａｂ c", "é", "-x-", None) == ["team-plan", "unknown", "ab-c", "unknown", "x", "unknown"]
    assert run(spark, text.model_id, "ab-12 / x", "ｘ9") == ["AB12X", "X9"]
    assert run(spark, text.availability, "Sold out", "https://schema.org/InStock", "pre-order", "Maybe later") == ["out_of_stock", "in_stock", "preorder", "maybe-later"]


def test_redaction(spark):
    cases = {
        "Bearer abc.def": "Bearer [REDACTED]",
        "https://x/?token=abc&b=1": "https://x/?token=[REDACTED]",
        "mail a.b@c.example now": "mail [REDACTED_EMAIL] now",
        "call +1 (555) 123-4567 now": "call [REDACTED_PHONE] now",
        "on 2026-01-02 and 1234567890123": "on 2026-01-02 and 1234567890123",
        "password: hunter2, ok": "password=[REDACTED], ok",
        "sk_ABCDEFGHIJKLMNOP": "[REDACTED]",
        "é plain": "é plain",
    }
    got = run(spark, text.redact, *cases)
    assert got[0] == "Bearer [REDACTED]" and got[2:] == list(cases.values())[2:]
    assert "abc" not in got[1]
    assert run(spark, lambda c: text.clean(c, 5), " a \n b c d", None) == ["a b c", None]


def test_noise_and_globs(spark):
    noisy = "Page rendered at 2026-07-19T10:00:00Z id 123e4567-e89b-12d3-a456-426614174000 request_id=abcdef12 x"
    assert run(spark, text.mask_volatile, noisy) == ["[render-time] id [volatile-id] [volatile-id] x"]
    df = spark.createDataFrame([("Seen 12 times. ok", ["seen * times."]), ("a.b", ["a?b", "(x"]), ("keep", None)], "v string, p array<string>")
    assert [r[0].strip() for r in df.select(text.drop_globs(F.col("v"), F.col("p"))).collect()] == ["ok", "", "keep"]


def test_noise_is_one_step_of_a_plan(spark):
    """Also where rows are filtered by the text without noise: as expressions, it was planned and run many times over."""
    cases = [
        ("a \u00a0\n b\u0301  x", None, "a b\u0301 x"),
        ("e\u0301t", [], "\u00e9t"),
        ("mail a@b.example or +1 (212) 555-0100, password: hunter2; Bearer abc sk-abcdefghijklmnop", None, "mail [REDACTED_EMAIL] or [REDACTED_PHONE], password=[REDACTED]; Bearer [REDACTED] [REDACTED]"),
        ("id 123e4567-e89b-12d3-a456-426614174000 Request-ID=abcdef12 generated at 2026-07-19T10:00Z", None, "id [volatile-id] [volatile-id] [render-time]"),
        ("x" * 600 + " 12 Visitors ONLINE now", ["*visitors online*"], "x" * 104 + " now"),
        ("one two visitors online, 5 visitors online", ["*visitors ??line*", "five"], ""),
        ("Session abc build 1234 (x", ["session *", "build ????", "(x"], "abc"),
        ("a.b aXb", ["a.b"], "aXb"),
        ("ab c", ["*"], "a b c"),
        ("\u00c9T\u00c9 1", ["\u00e9t\u00e9"], "1"),
        ("keep 11", ["1"] * 10 + ["keep"], "keep"),
        ("a", [None], None),
        (None, ["a"], None),
    ]
    df = spark.createDataFrame([(k, v, p) for k, (v, p, _) in enumerate(cases)], "k int, v string, p array<string>")
    got = df.select("k", text.suppress_noise(F.col("v"), F.col("p")).alias("t"))
    assert {r.k: r.t for r in got.collect()} == {k: w for k, (_, _, w) in enumerate(cases)}
    plan = got.filter("t != ''")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("batch(") == 1 and len(plan) < 2_000


def test_noise_of_lines_is_one_step_of_a_plan(spark):
    rows = [(0, "a  visitors online\nsession id: abcdef9\n\n b", ["*visitors online*"]), (1, None, None), (2, "a\nb", [None])]
    df = spark.createDataFrame(rows, "k int, v string, p array<string>")
    got = df.select("k", text.suppress_lines(F.col("v"), F.col("p")).alias("t"))
    assert {r.k: r.t for r in got.collect()} == {0: "\n[volatile-id]\n\nb", 1: None, 2: None}
    plan = got.filter("t != ''")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("batch(") == 1 and len(plan) < 2_000


def test_dates(spark):
    cases = {"2026-09-01": "2026-09-01", "September 1, 2026": "2026-09-01", "1 september 2026": "2026-09-01", "30 February 2026": "30 February 2026", "03/04/2026": "03/04/2026"}
    assert run(spark, dates.normalise, *cases) == list(cases.values())
    assert run(spark, dates.extract, "from 1 May 2026 or 2026-01-01", "never", None) == ["2026-05-01", None, None]
    df = spark.sql("SELECT timestamp'2026-07-19 23:30:00' AS t")
    row = df.select(dates.week_start(F.col("t"), "UTC"), dates.week_start(F.col("t"), "Asia/Tokyo"), dates.week_day(F.col("t"), "UTC"), dates.iso_millis(F.col("t"))).first()
    assert (str(row[0]), str(row[1]), row[2], row[3]) == ("2026-07-13", "2026-07-20", 7, "2026-07-19T23:30:00.000Z")


def test_urls(spark):
    assert run(spark, urls.canonical, "HTTPS://U:p@X.example:443/a?b=2&utm_x=1&a=1#f", "no url") == ["https://x.example/a?a=1&b=2", "no url"]
    assert run(spark, urls.redact_url, "https://x.example/?api_key=1&b=2") == ["https://x.example/?api_key=%5BREDACTED%5D&b=2"]
    assert run(spark, urls.run_url, "https://x.example/r?a=1#b", "http://x.example/", "https://u@x.example/", None) == ["https://x.example/r", None, None, None]
    problems = {"": "length", "x": "unparseable", "http://x.example/": "scheme", "https://u:p@x.example/": "credentials", "https://x.example/#f": "fragment", "https://x.example:8443/": "port", "https://x.example/?token=1": "credential_key", "https://x.example/?q=token": None}
    assert run(spark, urls.public_url_problem, *problems) == list(problems.values())


def test_addresses(spark):
    cases = {"127.0.0.1": 2130706433, "2130706433": 2130706433, "0x7f000001": 2130706433, "0177.0.0.1": 2130706433, "127.1": 2130706433, "1.2.3": 16908291, "256.1.1.1": None, "a.b": None, "1.2.3.4.5": None, "": None}
    assert run(spark, net.ipv4_number, *cases) == list(cases.values())
    assert run(spark, net.host_name, "Example.COM.", "%6cocalhost", "[::1]") == ["example.com", "localhost", "::1"]
    assert run(spark, net.host_blocked, "localhost", "a.internal", "example.com") == [True, True, False]
    df = spark.createDataFrame([(2130706433,), (134744072,), (None,)], "ip long")
    assert [r.network for r in net.with_network(df, "ip").collect()] == ["127.0.0.0/8", None, None]


def test_cells_and_escapes(spark):
    assert run(spark, text.csv_cell, '=1+"x"', "-5", "a", None, "  @x") == ['"\'=1+""x"""', '"\'-5"', '"a"', '""', '"\'  @x"']
    assert run(spark, text.escape_markdown, "a_b*[c](d)#!") == ["a\\_b\\*\\[c\\]\\(d\\)\\#\\!"]
    assert run(spark, text.clean_id, "a b/c_d", "///", None) == ["abc_d", None, None]


@pytest.mark.parametrize("value, ok", [("2026-07-19T23:30:00.000Z", True), ("2026-07-19T23:30:00Z", False), ("2026-02-30T00:00:00.000Z", False), (None, False)])
def test_iso_round_trip(spark, value, ok):
    assert run(spark, dates.is_iso_millis, value) == [ok]


def test_inspected_hosts(spark):
    cases = {
        "[::1]": ("v6", "::1/128"), "fe80::1": ("v6", "fe80::/10"), "2606:4700::1": ("v6", None), "::ffff:10.0.0.1": ("v6", "::ffff:0:0/96"),
        "FC00::": ("v6", "fc00::/7"), "0x7f.1": ("v4", "127.0.0.0/8"), "8.8.8.8": ("v4", None), "017700000001": ("v4", "127.0.0.0/8"),
        "printer.LOCAL.": ("name", "printer.local"), "x.example": ("name", None), "a:b": ("name", None), None: (None, None), "": ("name", None),
    }
    df = spark.createDataFrame([(h, "clash") for h in cases], "h string, network string").select("h", F.col("network").alias("other"))
    assert {r.h: (r.host_kind, r.blocked_by) for r in net.inspected(df, "h").collect()} == cases


def test_origins(spark):
    df = spark.createDataFrame([("https://A.example:443/x?q", ["http://b.example:80", "https://a.example/y", "nonsense", None]), (None, None)], "u string, more array<string>")
    got = [r.o for r in df.select(urls.allowed_origins(F.col("u"), F.col("more")).alias("o")).collect()]
    assert got == [["http://b.example", "https://a.example"], []]


def test_small_rules(spark):
    assert run(spark, lambda c: text.clean_id(c, 4, F.lit("none")), "a b!c-d", "%%", None) == ["abc-", "none", "none"]
    df = spark.createDataFrame([(408,), (429,), (500,), (404,), (None,)], "s int")
    assert [r.t for r in df.select(numbers.transient_status(F.col("s")).alias("t")).collect()] == [True, True, True, False, None]
    assert [history.chunk_size(n) for n in (None, 1, 100_000, 10**9)] == [524_288, 65_536, 100_000, 524_288]
    assert run(spark, lambda c: history.too_many_chunks(c, 2), "x" * 64, "x" * 65, None) == [False, True, None]


def test_last_entries_by_instant(spark):
    rows = [("t", 1, "h", "s", 50), ("t", 2, "h", "s", None), ("t", 3, "h", "s", 10), ("t", 3, "h", "s", 10)]
    df = spark.createDataFrame(rows, "target_identity string, entry_id long, snapshot_hash string, check_status string, at long")
    assert [r.entry_id for r in history.last_entries(df, 2, "at").orderBy("place").collect()] == [1, 3]
    assert [r.entry_id for r in history.last_entries(df, 2).orderBy("place").collect()] == [3, 2]


def test_markdown_document(spark):
    schema = "change_row long, change_id string, target_name string, target_url string, field_path string, severity string, confidence_score int"
    rows = [(1, "a", "Shop *1*", "https://x.example/", "f", "high", 9), (2, "a", "Shop", "u", "f", "low", 1), (3, None, "n", "u", "f", "low", 1)]
    df = spark.createDataFrame(rows, schema)
    got = reports.markdown_document(df, "Digest", "2026-01-01T00:00:00.000Z", "https://runs.example/r?token=x").first().document
    assert got.startswith("# Digest\n\nGenerated: 2026-01-01T00:00:00.000Z\nChanged targets: 1\nMaterial changes: 1\n\n## 1. Shop \\*1\\* - high")
    assert got.endswith("Run: https://runs.example/r") and "token" not in got
    assert "No material changes" in reports.markdown_document(df.limit(0), "D", "x").first().document


def test_spacing(spark):
    day = 86_400
    rows = [("a", 1, 5), ("a", 2, 7), ("a", 3, day + 1), ("a", 4, 9 * day), (None, 5, 3), (None, 6, 9 * day), ("b", 7, None), ("b", 8, 4), ("a", 9, 7)]
    df = spark.createDataFrame(rows, "u string, e long, s long").selectExpr("u", "e", "timestamp_seconds(s) AS at", "1 AS k", "2 AS us")
    got = {r.e: r.gap_us and r.gap_us // 1_000_000 for r in history.spacing(df, "u", "at", "e").collect()}
    assert got == {1: None, 2: 2, 9: 0, 3: day - 6, 4: 8 * day - 1, 5: None, 6: 9 * day - 3, 7: None, 8: None}
    assert history.spacing(df.limit(0), "u", "at", "e").count() == 0

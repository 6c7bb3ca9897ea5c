from pyspark.sql import functions as F

from tidemark.operators import document_facts as df_
from tidemark.operators import facts, history
from tidemark.sources import documents as docs
from tidemark.sources import markup


def page(price, dashboards, other, terms):
    return f"""<html><head><title>Shop</title><script type="application/ld+json">
{{"@type": "Product", "sku": "NorthTeam", "brand": {{"name": "North"}}, "offers": {{"@type": "Offer", "price": "{price}", "priceCurrency": "USD", "availability": "https://schema.org/InStock"}}}}
</script></head><body><nav>skip<section class="pricing-plan" data-plan="team"><h2>Team</h2><p class="price">${price} per month</p>
<p class="availability">In stock</p><ul><li>{dashboards} dashboards<li>{other}</ul></section><p class="terms">{terms}</p><div>"""


def test_two_versions_of_a_page(spark):
    rows = [
        ("v1", "t", page(29, 10, "Weekly exports", "Cancel at any time.")),
        ("v2", "t", page(35, 25, "Daily exports", "Annual commitment starts September 1, 2026.")),
    ]
    base = docs.with_html_document(spark.createDataFrame(rows, "v string, target_identity string, html string"), "html")
    wanted = ["price", "availability", "product_feature", "pricing_plan", "terms_policy"]
    versions = []
    for v in ("v1", "v2"):
        made = df_.document_facts(base.filter(F.col("v") == v)).filter(F.col("category").isin(wanted))
        versions.append(made)
    first = {r.fact_id: r.fact_value for r in versions[0].collect()}
    assert first == {
        "product:northteam:price": "29", "product:northteam:currency": '"USD"', "product:northteam:availability": '"in_stock"',
        "plan:team:exists": "true", "plan:team:billing": '"month"', "plan:team:features": '["10 dashboards","Weekly exports"]',
        "plan:team:limit:dashboards": "10", "plan:team:availability": '"in_stock"', "policy:section-1:text": '"Cancel at any time."',
    }
    changes = facts.with_deltas(facts.compare(*versions, ["target_identity", "fact_id"], "fact_value")).collect()
    got = {r.fact_id: (r.change_kind, r.previous, r.current, r.delta, r.delta_percent) for r in changes}
    assert got["product:northteam:price"] == ("changed", "29", "35", 6.0, 20.6897)
    assert got["plan:team:limit:dashboards"] == ("changed", "10", "25", 15.0, 150.0)
    assert got["policy:section-1:effective-date"][:3] == ("added", None, '"2026-09-01"')
    assert set(got) == {"product:northteam:price", "plan:team:limit:dashboards", "plan:team:features", "policy:section-1:text", "policy:section-1:effective-date"}


def test_noise_and_secrets_never_make_a_fact_differ(spark):
    def at(minute, ident):
        html = (
            f"<body><div class=terms><h2>Terms</h2>\n<p>Cancel by mail to a{minute}@b.example. Page rendered at 2026-01-01T10:{minute}Z</p></div>\n"
            f"<div class=changelog>Version 1.2-rc{minute % 1} session id: abcdef{ident}</div>\n<p>ad {ident}</p>\n"
            f"<section class=pricing-plan data-plan=a><ul><li>3 seats<li>ad {ident}</ul></section></body>"
        )
        df = spark.createDataFrame([("t", html, ["ad ?"])], "target_identity string, html string, ignore_text_patterns array<string>")
        return df_.document_facts(docs.with_html_document(df, "html"), patterns=F.col("ignore_text_patterns"))

    one, two = at(10, "1"), at(11, "2")
    assert facts.compare(one, two, ["target_identity", "fact_id"], "fact_value").count() == 0
    made = {r.fact_id: r for r in one.collect()}
    assert made["policy:terms:text"].fact_value == '"Terms Cancel by mail to [REDACTED_EMAIL]. [render-time]"'
    assert "a10@" not in str(made) and made["changelog:entry-1:version"].fact_value == '"1.2-rc0"'
    assert made["plan:a:features"].fact_value == '["3 seats"]' and made["page:general-content"].source == "visible_text"


def test_plans_of_one_name_share_the_first_evidence(spark):
    html = "<div class=plan-card><h3>A</h3>one<ul><li>2 seats</ul></div><div class=plan-card><h3>A</h3>two<ul><li>5 users</ul></div>"
    df = docs.with_html_document(spark.createDataFrame([("t", html)], "target_identity string, html string"), "html")
    made = {r.fact_id: r.evidence for r in df_.plan_facts(df).collect()}
    assert set(made) >= {"plan:a:limit:seats", "plan:a:limit:users"} and len({e[:4] for e in made.values()}) == 1


def test_selectors():
    root = markup.parse('<main id=a><div class="x y"><p data-k="v1">1<p data-k>2</div><br><img src=q></main><p>3')
    assert [n.text() for n in markup.select(root, ".x > p")] == ["1", "2"]
    assert [n.text() for n in markup.select(root, '[data-k*="v"], #a p[data-k]')] == ["1", "2"]
    assert len(markup.select(root, "p")) == 3
    fine = ["main > .x", "p, h1", '[a="b"] c']
    bad = ["", "*", "a:has(b)", "a,b,c,d,e,f", "a b c d e f g h i j k", "a + b", "p:first-child", "x" * 300]
    assert not any(markup.selector_problem(s) for s in fine)
    assert all(markup.selector_problem(s) for s in bad)


def test_include_exclude_and_broken_markup():
    html = "<body><h1>Head</h1><div class=a>one <b>two</div><div class=b>three<script>no</script>"
    assert docs.html_document(html)["visible_text"] == "Headone twothree"
    assert docs.html_document(html, include=[".b"])["visible_text"] == "three"
    assert docs.html_document(html, exclude=[".a"])["visible_text"] == "Headthree"
    assert docs.html_document(None) is None and docs.html_document("")["visible_text"] == ""
    deep = "<div>" * 5_000 + "x"
    assert docs.html_document(deep)["visible_text"] == "x"


def test_secrets_never_reach_a_document(spark):
    html = (
        "<head><title>Mail a@b.example</title><link rel=canonical href='https://u:p@x.example/a?token=abc&q=1#f'>"
        '<script type="application/ld+json">{"@type": "Offer", "name": "password: hunter2", "url": "https://x.example/?key=1"}</script></head>'
        "<body><h1>Bearer abc.def</h1>\n<p class=terms>call +1 555 123 4567</p>\n<p>api_key=zzz  two</p></body>"
    )
    d = docs.html_document(html)
    assert d["title"] == "Mail [REDACTED_EMAIL]" and d["headings"] == ["Bearer [REDACTED]"]
    assert d["policies"][0]["text"] == "call [REDACTED_PHONE]" and "api_key=[REDACTED] two" in d["visible_text"]
    assert d["canonical_url"] == "https://x.example/a?token=%5BREDACTED%5D&q=1"
    assert d["product_offers"][0]["name"] == "password=[REDACTED]" and "key=1" not in d["product_offers"][0]["url"]
    assert docs.flatten_json('{"a@b.example": ["secret=1"]}') == [("$.[REDACTED_EMAIL][0]", "secret=[REDACTED]")]
    rows = [(1, '{"a": "token: x"}', "json"), (2, "<a>x  y</a>", "xml"), (3, "a\u00a0 b", "text"), (4, "{", "json"), (5, None, "text"), (6, "<p>h", "html"), (7, "z", None)]
    made = docs.with_document(spark.createDataFrame(rows, "i int, body string, kind string"), "body", "kind")
    assert {r.i: r.v for r in made.select("i", F.col("document.visible_text").alias("v")).collect()} == {
        1: "token=[REDACTED]", 2: "x y", 3: "a b", 4: None, 5: None, 6: "h", 7: None
    }


def test_json_and_xml(spark):
    assert docs.flatten_json('{"a": [1, {"b": null}], "c": "x", "__proto__": 1}') == [("$.c", "x"), ("$.a[0]", "1"), ("$.a[1].b", None)]
    assert docs.flatten_json("{") is None and docs.flatten_json(None) is None
    assert docs.flatten_xml('<r k="1"><p>2</p><p>3</p></r>') == [("$.r.@_k", "1"), ("$.r.p[0]", "2"), ("$.r.p[1]", "3")]
    assert docs.flatten_xml("<!DOCTYPE x><r/>") is None and docs.flatten_xml("<r>") is None
    df = spark.createDataFrame([(1, '{"k": 5}', "clash"), (2, "bad", "clash"), (3, None, "clash")], "i int, body string, path_ string")
    assert [(r.i, r.path, r.value) for r in docs.with_paths(df, "body").collect()] == [(1, "$.k", "5")]


def test_bodies(spark, tmp_path):
    import gzip
    import zlib

    assert docs.decode_body(gzip.compress(b"x"), "gzip, br", 10) == (b"x", None)
    assert docs.decode_body(zlib.compress(b"xy"), "Deflate", 2) == (b"xy", None)
    cases = {("br", b"x"): "unsupported_encoding", ("gzip", b"x"): "broken_encoding", ("gzip", gzip.compress(b"a" * 50_000_000)): "response_too_large", (None, b"12345678901"): "response_too_large", ("gzip", gzip.compress(b"abc")[:-4]): "broken_encoding"}
    assert {k: docs.decode_body(k[1], k[0], 10)[1] for k in cases} == cases
    assert docs.decode_body(None, "gzip", 10) == (None, None)
    df = spark.createDataFrame([(bytearray(gzip.compress("ä".encode())), "gzip"), (None, None), (bytearray(b"x"), "br")], "b binary, e string")
    assert [tuple(r.d) for r in df.select(docs.decoded(F.col("b"), F.col("e")).alias("d")).collect()] == [("ä", None), (None, None), (None, "unsupported_encoding")]
    (tmp_path / "a.html").write_text("hi")
    (tmp_path / "b.html").write_text("x" * 100)
    got = {r.body: r.problem for r in docs.read_bodies(spark, str(tmp_path), 50).collect()}
    assert got == {"hi": None, None: "response_too_large"}


def test_chunks_round_trip(spark):
    df = spark.createDataFrame([(1, "é" * 5_000), (2, ""), (3, None), (4, "x")], "k int, t string")
    parts = history.chunks(df, "k", "t", 1_001)
    whole = {r.k: r for r in history.reassemble(parts, "k").collect()}
    assert whole[1].text == "é" * 5_000 and whole[1].intact and whole[1].byte_length == 10_000
    assert set(whole) == {1, 2, 4} and whole[2].text == ""
    broken = parts.filter("NOT (k = 1 AND idx = 3)")
    assert not {r.k: r for r in history.reassemble(broken, "k").collect()}[1].intact


def test_glob_ignore_reads_whole_texts(spark, tmp_path):
    from tidemark.plans import queries

    spark.createDataFrame([("t", ["build ????"]), ("u", None)], "target_identity string, ignore_text_patterns array<string>").write.parquet(str(tmp_path / "targets.parquet"))
    pages = [(1, "t", "build 1111 A", "Text\nbuild 2222 B"), (2, "u", None, "build 3333")]
    spark.createDataFrame(pages, "page_id long, target_identity string, title string, visible_text string").write.parquet(str(tmp_path / "extracted_pages.parquet"))
    spark.createDataFrame([(7, 1, "build 4444 C"), (8, 2, None)], "section_id long, page_id long, text string").write.parquet(str(tmp_path / "text_sections.parquet"))
    got = {tuple(r) for r in queries.glob_ignore(spark, str(tmp_path)).collect()}
    assert got == {
        (1, None, "title", "A"), (1, None, "visible_text", "Text B"), (1, 7, "section", "C"),
        (2, None, "title", None), (2, None, "visible_text", "build 3333"), (2, 8, "section", None),
    }


def test_all_sections_of_a_page_make_facts(spark, tmp_path):
    """More than 50 of a kind too, as the SQL has it; a row doesn't grow with their number."""
    import duckdb

    from tidemark.plans import queries

    spark.createDataFrame([("t", ["ad ?"], "usd")], "target_identity string, ignore_text_patterns array<string>, currency string").write.parquet(str(tmp_path / "targets.parquet"))
    pages = [(1, "t", None, "Text ad 1"), (2, "gone", None, None), (3, None, None, "")]
    spark.createDataFrame(pages, "page_id long, target_identity string, title string, visible_text string").write.parquet(str(tmp_path / "extracted_pages.parquet"))
    rows = [(k, 1, "policy" if k % 2 else "changelog", None if k % 4 < 2 else f"Head {k}", f"Body {k} ad 7", k // 6) for k in range(400)]
    rows += [(400, 1, "policy", "Last", "No place", None), (401, 1, "policy", "Head 3", "Second of its name", 900), (402, 1, "policy", None, None, 901)]
    rows += [(403, 1, "policy", None, "After a null text", 902), (404, 2, "changelog", None, "ad 1", 1), (405, None, "policy", "X", "No page", 1), (406, 9, "policy", "X", "Lost page", 1)]
    spark.createDataFrame(rows, "section_id long, page_id long, section_kind string, heading string, text string, ord int").write.parquet(str(tmp_path / "text_sections.parquet"))
    got = {tuple(r) for r in queries.document_texts(spark, str(tmp_path)).collect()}
    values = {(page, fact): value for page, fact, value in got}
    assert len(values) == len(got) == 404 and ("1", "policy:last:text") in values
    assert values["1", "policy:section-199:text"] == '"Body 397"' and values["1", "changelog:head-398:text"] == '"Body 398"'
    assert values["1", "policy:head-3:text"] == '"Body 3"' and values["1", "policy:section-203:text"] == '"After a null text"'
    duck = duckdb.connect()
    for name in ("targets", "extracted_pages", "text_sections"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}.parquet/*.parquet'")
    assert {tuple(r) for r in duck.execute(queries.ORACLE["document_texts"]).fetchall()} == got

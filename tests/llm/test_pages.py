from tidemark.llm import main_content as mc
from tidemark.llm import template_residue as tr

MENU = "Home | Plans | Pricing | Status | Contact"
FOOT = "© 2025 Brand. All rights reserved.\nImprint"


WORDS = "ladder copper meadow invoice harbour lantern ticket winter saddle mirror garden engine cotton bridge pepper candle".split()


def word(k, n):
    return WORDS[(k * (2 * n + 3) + n * n) % len(WORDS)] + "abcdefghij"[(k + n) % 10]


def prose(k):
    return f"Once the {word(k, 1)} was checked, each {word(k, 2)} of the {word(k, 3)} moved to another {word(k, 4)} on 2025-01-0{k % 9 + 1}."


def site(n=40):
    out = []
    for k in range(n):
        promo = "\nEvery plan includes one private feed for schools." if k % 4 == 0 else ""
        text = (
            f"{MENU}\nHome > Plans\n\nRelated pages\nHow schools use a {word(k, 5)} {word(k, 6)} (3 min)\nPro plan: {word(k, 7)} {word(k, 8)} seats"
            f"\nHow teams use a {word(k, 9)} {word(k, 10)}\n{prose(k)}{promo}\n{k} {word(k, 11)}\nUpdated on 2025-03-0{k % 9 + 1}\n{FOOT}"
        )
        out.append((k, "h", "t", text, [("main", prose(k)), ("nav", f"{MENU} Home > Plans"), ("x", None), ("y", " "), ("z", FOOT.replace("\n", " ") + " " + MENU)]))
    return [*out, (900, "h", None, None, None), (901, None, "x", "", []), (900, "h", None, None, None), (None, "h", "{{x}}", prose(1), None)]


SCHEMA = "page_id long, host string, title string, visible_text string, selected_sections array<struct<selector string, text string>>"


def test_main_blocks(spark):
    df = spark.createDataFrame(site(), SCHEMA)
    rows = mc.main_blocks(df).collect()
    got = {(r.block_field, r.block_no) for r in rows if r.page_id == 5}
    assert got == {("visible_text", 6), ("visible_text", 7), ("visible_text", 8), ("visible_text", 9), ("selected_sections", 0)}
    promos = {(r.page_id, r.block_no) for r in rows if "private feed" in (r.text or "")}
    assert not promos
    # The region decides the heading: as the last of the links above prose it is content, before a footer it isn't.
    assert all((k, 6) in {(r.page_id, r.block_no) for r in rows if r.block_field == "visible_text"} for k in range(40))
    assert not [r for r in rows if r.page_id is None or r.page_id >= 900]
    clash = df.selectExpr("*", "1 AS key", "2 AS part", "3 AS lines", "4 AS share")
    assert mc.main_blocks(clash).count() == len(rows)
    assert mc.main_blocks(df.limit(0)).count() == 0


def test_split_hosts_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(site(), SCHEMA)
    whole = sorted(map(tuple, mc.main_blocks(df).select("page_id", "block_field", "block_no").collect()))
    monkeypatch.setattr(mc, "PAGES", 7)
    assert sorted(map(tuple, mc.main_blocks(df).select("page_id", "block_field", "block_no").collect())) == whole


def test_html_in_pieces():
    html = (
        "<html><head><style>p{}</style></head><body><ul>" + "<li><a href='/'>Home</a></li>" * 8 + "</ul><p>"
        + "A long sentence about nothing in particular goes here. " * 4 + "</p><p>" + "And so does another one of them. " * 5
        + "</p><ul>" + "<li><a href='/'>Imprint</a></li>" * 8 + "</ul></body></html>"
    )
    kept = mc.html_content(html[i : i + 7] for i in range(0, len(html), 7))
    assert any("long sentence" in x for x in kept) and any("another one" in x for x in kept)
    assert sum(x in ("Home", "Imprint") for x in kept) <= 4
    assert mc.html_content([]) == []


def test_regions_decide_unsure_lines():
    lines = [mc.line_of(x, "h") for x in ("Most read", "Blue seat and rows", "Green form and logs", "Red desk and tables")]
    known = lambda x: mc.Known(0.3, 0.3, False, True) if x.text == "Most read" else mc.Known()
    body = [mc.line_of("The reading room was moved to the upper floor after long talks with all the readers.", "h")]
    notice = [mc.line_of("All rights are reserved by the owner of this site.", "h")]
    kept = lambda x: [s > 0 for s in mc.line_scores(x, lambda y: mc.Known(0.9, 0.9) if y in notice else known(y))[0]]
    assert kept(lines + body) == [False, False, False, True, True]
    assert kept(lines + notice) == [False] * 5
    assert kept(lines + notice + body) == [False, False, False, True, False, True]
    assert kept([]) == []


def test_lines_with_markup_go_through_the_parser():
    x = mc.line_of("<ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul>", "h")
    assert x.masked == "One Two" and x.tags == 9
    assert mc.line_scores([x], lambda y: mc.Known())[0][0] < 0
    assert mc.line_of("a < b & c", "h").masked == "a < b & c"


def test_smoothing_keeps_the_mean_of_a_constant():
    assert all(abs(v - 3.0) < 1e-9 for v in mc.smooth([3.0] * 9))


def test_line_classes():
    slots = ["Hello {{ name }},", "Valid until ${DATE},", "$plan_name$ x", "%%sku%%: 3 USD", "<%= a.b %>", "@@x@@", "__PLAN__ 3", ":sku: x", "#{a}", "[page.heading]", "«x»", "Solo – %s of %d used", "{% x %}", "{title} | B"]
    assert all(tr.residue(s) == "slot" for s in slots)
    kinds = {
        "Templates now accept variables such as {{first_name}} in the subject.": None, "At 10:30:00 [1] it costs $3 and $4.": None,
        "In the editor, [Insert] places a new row and {0} stands for a digit.": None, "Set the variable ${BASE_DIR} in your shell.": None,
        "pricing.headline.main": "raw", "undefined seats included": "raw", "Price: £NaN": "raw", "Hello null, your form is ready": "raw", "Price:": "raw",
        "An undefined limit means that the plan has no cap.": None, "Nothing is null and void here.": None,
        "Lorem ipsum dolor sit amet elit.": "filler", "xxx xxx xxx": "filler", "Your text here. Replace it.": "filler",
        "Dolor tempor amet, consectetur velit magna aliqua.": "filler", "A lorem of the ipsum kind stands apart.": "filler",
        "Designers often use filler text such as lorem ipsum in drafts; our editor replaces it.": None, "12 seats": None, "": None,
        "word " * 5000 + "{{x}}": "slot", "word " * 5000: None,
    }
    assert {k: tr.residue(k) for k in kinds} == kinds


def body_page(i, body, title="How schools use a weekly form", host="h"):
    return (i, host, title, f"{MENU}\n{body}\n{FOOT}", None)


def test_residue_pages(spark):
    page = body_page
    rows = [
        page(1, prose(1)), page(2, "Access denied\nYou are not known here. Reference 3."),
        page(3, prose(3) + "\nHello {name},"), page(4, prose(4), "undefined | Brand"), page(5, "Loading…\n" + prose(5) + "\n" + prose(6)),
        page(6, ""), page(7, "Lorem ipsum dolor sit amet elit."),
        page(9, "JavaScript is disabled in your browser."), (10, None, None, None, None), (None, "h", "{{x}}", "404 Not Found", None),
        page(11, prose(9), None), page(12, "Come again in a while, the desk is closed for now.", "Oops"), page(13, prose(1) + "\n" + prose(2), "Oops"), page(14, "", "Oops"),
        page(15, "404 - File or directory not found."), page(16, "The requested URL was not found on this server."), page(17, "Sorry, the page you requested was not found."),
        page(18, "The file was not found in the archive, said the keeper, so the whole " + "long " * 40 + "search went on."), page(9, "JavaScript is disabled in your browser."),
    ]
    got = {(r.page_id, r.reason) for r in tr.residue_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    cases = {(2, "message"), (3, "slot"), (4, "raw"), (7, "filler"), (9, "message"), (12, "message"), (15, "message"), (16, "message"), (17, "message")}
    assert got == cases
    assert tr.residue_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_templates_are_judged_by_their_places(spark):
    # No word of these lines is listed anywhere: one stands alone on pages of two hosts, the other beside prose.
    rows = []
    for k in range(24):
        host = "ab"[k % 2]
        rows.append(body_page(k, f"Ohje {k}: sisältö ei aukea.", None, host))
        rows.append(body_page(100 + k, f"Kahvila on auki {k} tuntia päivässä.\n{prose(k)} {prose(k + 7)}", None, host))
        rows += [body_page(200 + 10 * k + j, prose(3 * k + j) + " " + prose(5 * k + j + 1), None, host) for j in range(8)]
    got = {r.page_id for r in tr.residue_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(range(24))

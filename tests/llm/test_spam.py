import numpy as np

from tidemark.llm import spam

PROSE = "For the record, the old endpoint will be removed after a short trial, so {0} seats are affected. Once approved, schools can invite {0} guests to a shared feed. "


def pages():
    rng = np.random.default_rng(1)
    words = "buy cheap price sale offer review online best".split()
    out = []
    for k in range(60):
        out.append((k, PROSE.format(k) * (1 + k % 4), f"h{k % 3}"))
        out.append((100 + k, " ".join(rng.choice(words, 120)), f"h{k % 3}"))
        out.append((200 + k, " | ".join(f"[lamp](https://x{j}.test/p{j})" for j in range(30)), "h0"))
        out.append((300 + k, " / ".join(f"lamp slate {j}cm SKU{1000 + j}" for j in range(40)) + "\n" + PROSE.format(k), None))
        out.append((400 + k, PROSE.format(k) * 3 + "\nsegments, data sources, views", "h1"))
        out.append((500 + k, "Plan price table\n" + "\n".join(f"Solo{j}: {j} EUR per month, {j} seats, weekly export included" for j in range(8)), "h1"))
    return [*out, (None, out[1][1], "h1"), (900, None, "h1"), (901, "  ", None), (902, "a" * 40_000, "h1"), (903, "﻿The desk is open for all guests.​\xad\x07The desk is open for all guests.", "h1")]


def test_kinds(spark):
    df = spark.createDataFrame([(*p, 0.5) for p in pages()], "doc_id long, text string, source string, score double")
    got = {r.doc_id for r in spam.spam_pages(df).collect()}
    assert got == {i for i, *_ in pages() if i is not None and 100 <= i < 400}
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_one_class_keeps_its_labels(spark):
    schema = "doc_id long, text string, source string"
    assert spam.spam_pages(spark.createDataFrame([(1, PROSE, "h"), (2, PROSE, None)], schema)).count() == 0
    farm = [(k, text, "farm") for k, text, _ in pages() if k is not None and 100 <= k < 160]
    assert spam.spam_pages(spark.createDataFrame(farm, schema)).count() == 60


PROSES = {
    "pl": "Wczoraj rada miasta przyjęła nowy plan rozbudowy tramwajów. Prace zaczną się wiosną i potrwają około dwóch lat. Mieszkańcy dzielnic na wschodzie liczą na krótszy dojazd do centrum.",
    "tr": "Belediye meclisi dün yeni tramvay planını kabul etti. Çalışmalar ilkbaharda başlayacak ve yaklaşık iki yıl sürecek. Doğudaki mahallelerde oturanlar merkeze daha kısa sürede ulaşmayı bekliyor.",
    "fi": "Kaupunginvaltuusto hyväksyi eilen uuden raitiotiesuunnitelman. Työt alkavat keväällä ja kestävät noin kaksi vuotta. Itäisten kaupunginosien asukkaat toivovat lyhyempää matkaa keskustaan.",
    "zh": "市议会昨天通过了新的电车线路扩建方案。工程将于春季开始，预计持续两年左右。东部城区的居民希望前往市中心的路程能够缩短。",
    "th": "เมื่อวานนี้สภาเมืองได้อนุมัติแผนขยายเส้นทางรถรางใหม่ งานก่อสร้างจะเริ่มในฤดูใบไม้ผลิ",
}


def test_no_language_is_spam_for_being_unknown(spark):
    extra = [(1000 + k, text, "h1") for k, text in enumerate(PROSES.values())]
    df = spark.createDataFrame([*pages(), *extra], "doc_id long, text string, source string")
    got = {r.doc_id for r in spam.spam_pages(df).collect()}
    assert got == {i for i, *_ in pages() if i is not None and 100 <= i < 400}


def test_labelling_functions_disagree():
    x = np.array([spam.page_features(t) for _, t, _ in pages()])
    votes = spam.votes(x)
    assert ((votes > 0).any(axis=1) & (votes < 0).any(axis=1)).mean() > 0.1
    assert set(spam.weak_labels(x)) <= {-1, 0, 1}


def test_trees_separate_held_out_rows_and_decide_unlabelled_ones():
    rng = np.random.default_rng(2)
    x = rng.random((2_000, 4))
    y = ((x[:, 1] > 0.6) & (x[:, 2] < 0.5)).astype(float)
    model = spam.fit(x[:1_000], y[:1_000], ["h"] * 1_000)
    assert ((spam.predict(model.trees, x[1_000:]) >= 0.5) == y[1_000:]).mean() > 0.95


def test_host_weight_is_fitted():
    rng = np.random.default_rng(3)
    host = rng.normal(0, 1.5, 4_000)
    page = rng.normal(0, 1, 4_000)
    told = (rng.random(4_000) < 1 / (1 + np.exp(-(page + 1.2 * host)))).astype(float)
    untold = (rng.random(4_000) < 1 / (1 + np.exp(-page))).astype(float)
    assert abs(spam.host_weights(page, host, told)[1] - 1.2) < 0.15
    assert spam.host_weights(page, host, untold)[1] < 0.15
    assert spam.host_weights(page[:2], host[:2], told[:2]) != (1.0, spam.HOST_WEIGHT)


def test_host_rates_decide_pages_near_the_middle(spark):
    # The same unclear page on a host of spam and on a host of prose.
    unclear = "Tags: lamp, copper lamp, desk, ivory desk, riser, cable, sand filter, seed tray, growth plan. The desk is back in stock at the depot for all guests."
    rows = [(k, t, "farm" if k is not None and 100 <= k < 400 else "news") for k, t, _ in pages()]
    df = spark.createDataFrame([*rows, (2000, unclear, "farm"), (2001, unclear, "news")], "doc_id long, text string, source string")
    score = {r.doc_id: r for r in spam.spam_scores(df).filter("doc_id >= 2000").collect()}
    assert score[2000].page_score == score[2001].page_score
    assert score[2000].score > score[2001].score

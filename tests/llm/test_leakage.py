import random

from tidemark.llm import leakage

WORDS = [f"w{i}" for i in range(3_000)]


def passage(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


ITEMS = [(k, passage(k), f"question {k} about w{k}?", f"w{k}") for k in range(40)] + [(100, passage(0), "q", "a"), (101, None, None, None), (102, "", "", "")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, passage string")


def found(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, passage string, question string, answer string")
    return leakage.leaked_items(spark, frame(spark, docs), items)


def test_cases(spark):
    a, b, c = (passage(k).split() for k in (0, 1, 2))
    replaced = [w if i % 5 else "zzz" for i, w in enumerate(b)]
    marked = "<b>" + " ".join(c).replace("w1", "W1") + "</b>"
    docs = [
        (1, "intro " + " ".join(a) + " end", ""),
        (2, "x " + " ".join(replaced), ""),
        (3, marked.replace(" ", ",  \n"), ""),
        (4, " ".join(b[:29]), ""),
        (5, " ".join(b[10:42]), ""),
        (6, " ".join(b[:20]) + " other words here " + " ".join(b[40:]), ""),
        (7, " ".join(b[40:]) + " " + " ".join(b[:20]), ""),
        (8, " ".join(random.Random(4).sample(b, len(b))), ""),
        (9, None, ""),
        (10, "   ", ""),
        (11, "question 3 about w3? w3", ""),
        (12, "word " * 200_000 + " ".join(c), ""),
        (13, "​".join(" ".join(a)), ""),
        (1, "intro " + " ".join(a) + " end", ""),
        (None, " ".join(a), ""),
    ]
    got = sorted({(r.doc_id, r.item_id) for r in found(spark, docs).collect()})
    assert got == [(1, 0), (1, 100), (2, 1), (3, 2), (5, 1), (6, 1), (12, 2), (13, 0), (13, 100)]


def test_offsets_are_those_of_the_original(spark):
    text = "Ünö, <i>dos</i>: " + passage(5).upper()
    row = next(r for r in found(spark, [(1, text, "")]).collect())
    assert text[row.start_offset :].lower().startswith(passage(5).split()[0])
    assert text[row.last_word_offset :].lower() == passage(5).split()[-1]


def test_questions_and_answers_are_told(spark):
    rows = {r.item_id: r for r in found(spark, [(1, passage(7) + " Question 7 about W7?", ""), (2, passage(8), "")]).collect()}
    assert rows[7].question_found and rows[7].answer_found
    assert not rows[8].question_found


def test_small_pieces_and_many_replaced_words(spark):
    twenty = passage(50, 20).split()
    three = "a b c ".join(" ".join(twenty[k : k + 5]) + " " for k in (0, 7, 15))
    third = " ".join("zz" if k % 3 == 2 else w for k, w in enumerate(twenty))
    tag = " ".join(twenty[:10]) + " <span title='" + "y" * 3_000 + "'> " + " ".join(twenty[10:])
    compared = " ".join(twenty[:6]) + " 3 < 5 " + " ".join(twenty[6:12]) + " > 2"
    loose = " q ".join(twenty)
    docs = [(1, three, ""), (2, third, ""), (3, tag, ""), (4, compared, ""), (5, loose, ""), (6, " ".join(twenty[:9]), "")]
    items = spark.createDataFrame([(9, " ".join(twenty), None, None)], "item_id long, passage string, question string, answer string")
    got = {r.doc_id: r.share for r in leakage.leaked_items(spark, frame(spark, docs), items).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1] == 0.75 and got[2] >= 0.95 and got[3] == 1.0


def test_common_windows_are_left_out_of_the_first_count_only():
    shared = passage(60, 30)
    items = [leakage.item_of(k, f"{shared} {passage(70 + k, 30)}", None, None) for k in range(60)]
    scanner = leakage.Scanner(items)
    assert sum(map(len, scanner.counted.values())) < sum(map(len, scanner.own)) and min(scanner.least) >= 5
    for text, expected in ((shared, set(range(60))), (passage(75, 30), {5}), (passage(75, 20), set())):
        hits = scanner.scan(text, f" {' '.join(leakage.plain_words(text))} ")
        assert {h[0] for h in hits} == expected


def test_questions_are_told_for_every_document(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, passage string, question string, answer string")
    docs = frame(spark, [(1, "Ask: QUESTION 3 about w3?", ""), (2, "nothing", "")])
    rows = [(r.doc_id, r.item_id, r.share, r.question_found, r.start_offset) for r in leakage.item_hits(spark, docs, items).collect()]
    assert rows == [(1, 3, 0.0, True, None)]
    assert leakage.leaked_items(spark, docs, items.limit(0)).count() == 0
    assert leakage.leaked_items(spark, docs.limit(0), items).count() == 0


def test_one_scan_for_any_number_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 3)
    plan = found(spark, [(1, passage(1), "")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_blocks_give_the_same(spark, monkeypatch):
    docs = [(k, passage(k), "") for k in range(40)]
    whole = {(r.doc_id, r.item_id) for r in found(spark, docs).collect()}
    monkeypatch.setattr(leakage, "BLOCK", 7)
    assert {(r.doc_id, r.item_id) for r in found(spark, docs).collect()} == whole
    monkeypatch.setattr(leakage, "BLOCK", 2_000)
    monkeypatch.setattr(leakage, "BLOCK_CHARACTERS", 3_000)
    assert {(r.doc_id, r.item_id) for r in found(spark, docs).collect()} == whole
    assert found(spark, docs).filter("false").count() == 0

import datetime as dt
import time

from tidemark.streaming import weekly

SCHEMA = "destination string, change_id string, rank int, confidence int, at timestamp"
ANSWER = "destination string, delivery_id string, succeeded boolean, at timestamp"
HOUR = 3_600_000


def at(day, hour=10):
    return int(dt.datetime.fromisoformat(f"{day}T{hour:02}:00:00+00:00").timestamp() * 1000)


def step(state, rows=(), now=-1, day=1):
    state, told = weekly.advance(state, "x", list(rows), now, "UTC", day)
    return state, [(t[2], t[4], t[5]) for t in told], state.sending_id


def change(name, rank, day):
    return ("change", name, rank, 50, at(day))


def test_a_change_of_sunday_is_sent_by_the_clock():
    s, told, _ = step(weekly.EMPTY, [change("a", 1, "2026-07-19")])
    assert told == [("queued", 1, [])]
    s, told, ident = step(s, now=at("2026-07-20"))
    assert told == [("sending", 1, ["a"])] and ident
    # Pending until it is acknowledged, and not sent twice in the meantime.
    assert step(s, now=at("2026-07-20") + 60_000)[1] == [] and s.ids == ["a"]
    s, told, _ = step(s, [("sent", ident, None, None, at("2026-07-20") + 1)])
    assert told == [("delivered", 0, ["a"])] and s.ids == []
    s, told, _ = step(s, [change("b", 2, "2026-07-20")])
    assert told == [("queued", 1, [])] and step(s, now=at("2026-07-27"))[1] == [("sending", 1, ["b"])]


def test_a_failed_or_forgotten_delivery_keeps_its_changes():
    s, _, ident = step(weekly.EMPTY, [change("a", 1, "2026-07-20")])
    s, _, _ = step(s, [change("b", None, "2026-07-20")])
    s, told, again = step(s, [("failed", ident, None, None, at("2026-07-20") + 5)])
    assert told == [("failed", 2, ["a"]), ("sending", 2, ["a", "b"])] and again != ident
    late, told, _ = step(s, now=at("2026-07-20") + weekly.LEASE + HOUR)
    assert told == [("sending", 2, ["a", "b"])]
    # An answer to another delivery changes nothing; what came in after sending stays.
    assert step(late, [("sent", "unknown", None, None, None)])[1] == []
    s, _, _ = step(late, [change("c", 9, "2026-07-20")])
    s, told, _ = step(s, [("sent", s.sending_id, None, None, None)])
    assert told == [("delivered", 1, ["a", "b"])] and s.ids == ["c"]


def test_odd_ids_and_nulls():
    s, told, _ = step(weekly.EMPTY, [("change", "a\tb\nc", None, None, at("2026-07-21")), ("change", None, 1, 1, None)])
    assert s.ids == ["a\tb\nc"] and s.ranks == [-1] and told == [("queued", 1, [])]
    assert step(weekly.EMPTY)[1] == []


def test_stream_with_clock_and_answers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "answers").mkdir()
    changes = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    answers = spark.readStream.schema(ANSWER).json(str(tmp_path / "answers"))
    today = dt.datetime.now(dt.UTC)
    rows = weekly.weekly_stream(changes, "UTC", today.isoweekday(), answers, look=500)
    told = []
    q = (
        rows.writeStream.outputMode("update")
        .foreachBatch(lambda batch, _: told.extend(map(tuple, batch.collect())))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .start()
    )

    def wait(status):
        for _ in range(240):
            if any(t[2] == status for t in told):
                return next(t for t in told if t[2] == status)
            assert q.exception() is None
            time.sleep(0.25)
        raise AssertionError((status, told))

    try:
        # A change of another weekday: only the clock can send it.
        before = (today - dt.timedelta(days=1)).replace(tzinfo=None)
        rows = [("x", "a\tb", 3, 50, before), ("x", "c", None, None, before), (None, "d", 1, 1, before)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        assert wait("queued")[4] == 2
        sent = wait("sending")
        assert sent[5] == ["a\tb", "c"] and sent[4] == 2
        answer = [("x", sent[3], True, dt.datetime.now(dt.UTC).replace(tzinfo=None))]
        spark.createDataFrame(answer, ANSWER).coalesce(1).write.mode("append").json(str(tmp_path / "answers"))
        assert wait("delivered")[4] == 0
    finally:
        q.stop()


def test_merge_is_bounded_and_first_wins(spark):
    merged = weekly.merge_pending([("a", 1, 1)], [("a", 9, 9), ("b", 2, 0)], 1)
    assert merged == [("b", 2, 0)]
    schema = "destination string, change_id string, rank int, confidence int, row_no long"
    old = spark.createDataFrame([("x", "a", 1, 1, 5), ("y", "a", None, None, 6)], schema)
    new = spark.createDataFrame([("x", "a", 9, 9, 1), ("x", "b", 2, 0, 2), ("x", None, 9, 9, 3)], schema)
    got = [tuple(r) for r in weekly.merged_pending(old, new).select("destination", "change_id", "rank", "place").orderBy("destination", "place").collect()]
    assert got == [("x", "b", 2, 1), ("x", "a", 1, 2), ("y", "a", None, 1)]


def test_immediate_keeps_nothing(spark):
    schema = "destination string, change_id string, rank int, confidence int, row_no long"
    rows = [("x", f"c{k:02}", k, 1, k) for k in range(12)] + [("x", "c00", 99, 1, 99), ("y", None, 1, 1, 1), (None, "z", 1, 1, 1)]
    got = weekly.immediate(spark.createDataFrame(rows, schema)).collect()
    assert [(r.destination, r.total, r.change_ids) for r in got] == [("x", 12, [f"c{k:02}" for k in range(11, 1, -1)])]

from datetime import UTC, datetime

import pytest

from tidemark.functions.zones import ZoneTables, database_version
from tidemark.operators import timestamps as ts

ABBREVIATIONS = {"UTC": 0, "GMT": 0, "CEST": 120, "PST": -480, "JST": 540}


def one(text, zone="Europe/Berlin", order="DMY", whole=True):
    import pandas as pd

    c = ts.Converter(ABBREVIATIONS, ZoneTables(database_version()))
    got = c.instants(pd.Series([text]), pd.Series([whole]), pd.Series([zone]), pd.Series([order]))[0]
    return None if pd.isna(got) else datetime.fromtimestamp(got / 1e6, UTC).isoformat()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2025-11-14T14:26:57.097Z", "2025-11-14T14:26:57.097000+00:00"),
        ("2024-08-18T04:39:19.533145106Z", "2024-08-18T04:39:19.533145+00:00"),
        ("2024-08-18T04:39:19." + "5" * 200 + "Z", "2024-08-18T04:39:19.555555+00:00"),
        ("1730194456." + "2" * 300, "2024-10-29T09:34:16.222222+00:00"),
        ("2024-08-18T04:39:19Z" + "x" * 5000, None),
        ("20260405T022751", "2026-04-05T00:27:51+00:00"),
        ("20260405T022751Z", "2026-04-05T02:27:51+00:00"),
        ("2026-06-14t03:31z", "2026-06-14T03:31:00+00:00"),
        ("2024-07-07T17:54:21,627Z", "2024-07-07T17:54:21.627000+00:00"),
        ("1719330970761", "2024-06-25T15:56:10.761000+00:00"),
        ("1763279397", "2025-11-16T07:49:57+00:00"),
        ("1764268372603680", "2025-11-27T18:32:52.603680+00:00"),
        ("1730194456.253", "2024-10-29T09:34:16.253000+00:00"),
        ("915148800", None),
        ("99999999999999999999", None),
        ("Mon Jun 15 00:30:47 PST 2026", "2026-06-15T08:30:47+00:00"),
        ("Fri Jan 09 2026 18:45:24 GMT+0100 (Central European Standard Time)", "2026-01-09T17:45:24+00:00"),
        ("Sat Jul  6 05:03:20 2024", "2024-07-06T03:03:20+00:00"),
        ("Sat, 14 Jun 2025 22:53:05 GMT", "2025-06-14T22:53:05+00:00"),
        ("2025-05-16T04:39:58+10:00[Australia/Sydney]", "2025-05-15T18:39:58+00:00"),
        ("2024-04-30 18:53:23 America/St_Johns", "2024-04-30T21:23:23+00:00"),
        ("9 March 2026, 20:21 (America/Sao_Paulo)", "2026-03-09T23:21:00+00:00"),
        ("June 14, 2024 4:12:20 PM CEST", "2024-06-14T14:12:20+00:00"),
        ("October 25, 2026 at 2:48 AM", "2026-10-25T00:48:00+00:00"),
        ("5. März 2025 09:05", "2025-03-05T08:05:00+00:00"),
        ("2025-09-04 17:21 UTC+5:30", "2025-09-04T11:51:00+00:00"),
        ("2025-08-30 02:54 UTC+1", "2025-08-30T01:54:00+00:00"),
        ("2025-01-27T11:31:22-05", "2025-01-27T16:31:22+00:00"),
        ("2025-12-12 10:02 GMT+0", "2025-12-12T10:02:00+00:00"),
        (" 2024-04-21 09:41:34+10:30 ", "2024-04-20T23:11:34+00:00"),
        ("23.01.26 2:25am", "2026-01-23T01:25:00+00:00"),
        ("26/05/2024, 05:27:14", "2024-05-26T03:27:14+00:00"),
        ("05/26/2024, 05:27:14", None),
        ("7.4.2024 12:42:53am", "2024-04-06T22:42:53+00:00"),
        ("7.4.2024 13:42:53am", None),
        # twice: the earlier instant; skipped: the offset before the skip
        ("2025-10-26 02:30", "2025-10-26T00:30:00+00:00"),
        ("2025-03-30 02:30", "2025-03-30T01:30:00+00:00"),
        ("2025-02-30T10:00:00Z", None),
        ("2025-07-08T25:61:00Z", None),
        ("0000-00-00 00:00:00", None),
        ("2025-07-08", None),
        ("12:30", None),
        ("yesterday", None),
        ("", None),
        (None, None),
    ],
)
def test_whole_texts(text, expected):
    assert one(text) == expected


def test_date_order_and_unknown_zone():
    assert one("2/3/2024 4:17am", "UTC", "MDY") == "2024-02-03T04:17:00+00:00"
    assert one("2/3/2024 4:17am", "UTC", None) is None
    assert one("2024-02-03 04:17", None) is None
    assert one("2024-02-03 04:17Z", None) == "2024-02-03T04:17:00+00:00"


def test_first_named_time_counts():
    text = "See 2025-06-01. An import listed 2025-02-30 10:00:00 as its date. Deployed 7 April 2024 01:37 to all. 2026-01-01T00:00Z"
    assert one(text, "UTC", "DMY", whole=False) == "2024-04-07T01:37:00+00:00"
    assert one("The clock showed 2026-13-05T26:10Z. Hours are 09:00 to 17:30. Build 2.14.05 replaces 2.13.59.", whole=False) is None
    assert one("適用開始 20250114T102912 より", "Asia/Tokyo", "MDY", whole=False) == "2025-01-14T01:29:12+00:00"


def test_long_text_and_lord_howe():
    assert one("word " * 50_000 + "[2025-05-12 09:56:59.044+10:30] entry", whole=False) == "2025-05-11T23:26:59.044000+00:00"
    assert one("2024-10-06 02:15", "Australia/Lord_Howe") == "2024-10-05T15:45:00+00:00"


def test_version_is_checked():
    with pytest.raises(RuntimeError):
        ZoneTables("another")


def test_query_with_nulls_duplicates_and_extra_columns(spark):
    h = spark.createDataFrame(
        [(1, "t", "2024-02-03 04:17", "x"), (1, "t", "2024-02-03 04:17", "x"), (2, None, "1763279397", "x"), (3, "u", None, "x")],
        "entry_id long, target_identity string, checked_at string, host string",
    )
    s = spark.createDataFrame([(7, None, "at 2024-02-03 04:17Z ok"), (8, "h", None)], "section_id long, host string, text string")
    t = spark.createDataFrame([("t", "h")], "target_identity string, host string")
    sites = spark.createDataFrame([("h", "UTC", "DMY")], "host string, tz_name string, date_order string")
    z = spark.createDataFrame([("UTC", 0)], "abbrev string, offset_minutes int")
    got = sorted(map(tuple, ts.instants(h, s, t, sites, z).collect()))
    us = 1706933820_000_000
    assert got == [("history", 1, us), ("history", 2, 1763279397_000_000), ("section", 7, us)]
    assert ts.instants(h.limit(0), s.limit(0), t, sites, z).count() == 0

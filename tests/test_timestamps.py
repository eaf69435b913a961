from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from loomwire.operators.timestamps import normalise_times, wrong_dates

RAW = "raw_id bigint, time string, source_name string, fetched_at timestamp, zone_id string, w string"
PROFILES = [("NY", "America/New_York", "mdy"), ("SH", "Asia/Shanghai", "ymd"), ("LO", "Europe/London", "dmy"), ("CH", "America/Chicago", "mdy"), ("UT", "UTC", "ymd"), ("NY", "America/New_York", "mdy")]


def us(*parts, zone="UTC", fold=0):
    t = datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold)
    return round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def run(spark, *rows):
    profiles = spark.createDataFrame(PROFILES, "source_name string, zone_id string, date_order string")
    df = spark.createDataFrame([(i, t, s, None, "clash", "clash") for i, (t, s) in enumerate(rows)], RAW)
    return {r.raw_id: r for r in normalise_times(df, profiles).collect()}


CASES = [
    ("2025-03-12T21:15:21Z", "NY", us(2025, 3, 12, 21, 15, 21)),
    ("2025-07-19T12:48:39.917450+01:00", "SH", us(2025, 7, 19, 11, 48, 39, 917450)),
    ("2025-05-14 15:21:01-0500", "UT", us(2025, 5, 14, 20, 21, 1)),
    ("Sat, 25 Oct 2025 10:09:10 GMT", "LO", us(2025, 10, 25, 10, 9, 10)),
    ("Thu, 6 Mar 2025 11:44:20 +0000", "SH", us(2025, 3, 6, 11, 44, 20)),
    ("2025-07-29 23:07:35 CST", "SH", us(2025, 7, 29, 15, 7, 35)),
    ("2025-01-29 23:07:35 CST", "CH", us(2025, 1, 30, 5, 7, 35)),
    ("Jul 20, 2025 13:46:10 BST", "LO", us(2025, 7, 20, 12, 46, 10)),
    ("2025-11-02 01:30:00 EST", "NY", us(2025, 11, 2, 6, 30)),
    ("1754295102", "NY", 1754295102000000), ("1744730101076", "NY", 1744730101076000), ("1762080798000468", "NY", 1762080798000468),
    ("20241231083831", "SH", us(2024, 12, 31, 0, 38, 31)), ("20250501T210807Z", "SH", us(2025, 5, 1, 21, 8, 7)),
    ("09/07/2025 10:16", "NY", us(2025, 9, 7, 10, 16, zone="America/New_York")), ("09/07/2025 10:16", "LO", us(2025, 7, 9, 10, 16, zone="Europe/London")),
    ("7-5-2025 07:06", "LO", us(2025, 5, 7, 7, 6, zone="Europe/London")), ("8/11/2025 12:23 AM", "NY", us(2025, 8, 11, 0, 23, zone="America/New_York")),
    ("Apr 29, 2025 at 12:42 pm", "UT", us(2025, 4, 29, 12, 42)), ("Updated 25 Sep 2024, 19:37", "UT", us(2024, 9, 25, 19, 37)),
    ("12 de junio de 2025, 14:15", "UT", us(2025, 6, 12, 14, 15)), ("le 10 décembre 2024, 14:59", "UT", us(2024, 12, 10, 14, 59)), ("14 mars 2025 à 10h21", "UT", us(2025, 3, 14, 10, 21)),
    ("24. April 2025, 19:43 Uhr", "UT", us(2025, 4, 24, 19, 43)), ("27 enero 2025 14:16 h", "UT", us(2025, 1, 27, 14, 16)), ("2024年11月06日06时06分", "SH", us(2024, 11, 5, 22, 6)), ("2025年7月11日 12:34", "SH", us(2025, 7, 11, 4, 34)),
    ("\xa02025-09-15 ", "NY", us(2025, 9, 15, 4)), ("2025.02.08 20:01\n", "SH", us(2025, 2, 8, 12, 1)), ("11 September 2025", "UT", us(2025, 9, 11)),
    # twice and never on the clock
    ("2025-11-02 01:30", "NY", us(2025, 11, 2, 1, 30, zone="America/New_York", fold=0)), ("2025-03-09 02:30", "NY", us(2025, 3, 9, 7, 30)), ("2025-03-30 01:30", "LO", us(2025, 3, 30, 1, 30)),
    ("2025-01-01 10:00", "unknown", us(2025, 1, 1, 10)), ("2024-02-29", "UT", us(2024, 2, 29)),
    *[(t, "NY", None) for t in ("", " ", None, "24:71", "2025-02-30 10:15", "Tue, 32 Jun 2025 10:00:00 GMT", "2025-13-04T08:00:00Z", "0000-00-00 00:00:00", "31/11/2024 09:20", "2 hours ago", "yesterday", "刚刚", "n/a", "null", "Invalid date", "hace 3 horas", "2025-01-01 25:00", "TBC")],
]


@pytest.fixture(scope="module")
def instants(spark):
    return run(spark, *[c[:2] for c in CASES])


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: repr(CASES[i][0]))
def test_instants(instants, i):
    assert instants[i].epoch_us == CASES[i][2]


def test_mixture(spark):
    # a source without a profile that writes days first: its own dates decide
    rows = [(f"{d}/03/2025 10:00", "own") for d in range(13, 29)] + [("05/04/2025 10:00", "own"), ("05/04/2025 10:00", "alone"), ("05/04/2025 10:00", None)]
    got = run(spark, *rows)
    assert got[16].order == "dmy" and not got[16].ambiguous and got[16].epoch_us == us(2025, 4, 5, 10)
    assert got[17].ambiguous and got[18].ambiguous and got[17].epoch_us is not None
    assert run(spark, ("25/12/2024 10:00", "NY"))[0].order == "dmy"  # the only valid reading


def test_no_rows_and_repeats(spark):
    assert run(spark) == {}
    profiles = spark.createDataFrame(PROFILES, "source_name string, zone_id string, date_order string")
    df = spark.createDataFrame([(1, "2025-01-01", "NY", None, "", "")] * 2, RAW)
    assert normalise_times(df, profiles).count() == 2


def test_wrong_dates(spark, rows):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    times = spark.createDataFrame([(1, 1_000_000), (2, None)], "raw_id bigint, epoch_us bigint")
    at = datetime(1970, 1, 1, 0, 0, 1, tzinfo=timezone.utc)
    items = spark.createDataFrame([(10, 1, at), (11, 1, at + timedelta(hours=8)), (12, 2, at), (13, None, at), (14, 1, None)], "item_id bigint, raw_id bigint, source_date timestamp")
    assert rows(wrong_dates(items, times), "item_id", "epoch_us") == [(11, 1_000_000)]

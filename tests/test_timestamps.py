from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from signalpanel.operators.timestamps import resolve_instants


def us(*a):
    d = datetime(*a, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds) * 10**6 + d.microseconds


CASES = [
    ("2021-07-01T12:00:00Z", None, us(2021, 7, 1, 12), "offset"),
    ("2021-07-01 12:00:00", "America/New_York", us(2021, 7, 1, 16), "unique"),
    (" 2021-07-01T12:00:00.123456789Z ", None, us(2021, 7, 1, 12, 0, 0, 123456), "offset"),
    ("2021-07-01T12:00:00-05", "Asia/Tokyo", us(2021, 7, 1, 17), "offset"),
    ("2021-07-01T12:00:00-05:00[America/New_York]", None, us(2021, 7, 1, 17), "offset"),
    ("2021-03-14 02:30:00", "US/Eastern", us(2021, 3, 14, 7, 30), "nonexistent"),
    ("2021-11-07 01:30:00", "america/new york", us(2021, 11, 7, 5, 30), "ambiguous"),
    ("2021-11-07 01:30:00 EST", "america/new york", us(2021, 11, 7, 6, 30), "offset"),
    ("20210701120000", "ET", us(2021, 7, 1, 16), "unique"),
    ("20210701T120000Z", None, us(2021, 7, 1, 12), "offset"),
    ("1625140800", "ET", 1625140800 * 10**6, "epoch"),
    ("1625140800123", None, 1625140800123000, "epoch"),
    ("1625140800123456", None, 1625140800123456, "epoch"),
    ("1/2/2021 3:04 PM", "GMT-05:00", us(2021, 1, 2, 20, 4), "offset"),
    ("12/31/2021 12:00 am", " unknown ", us(2021, 12, 31), "unique"),
    ("01.02.2021 16:00", "Europe/Berlin\t", us(2021, 2, 1, 15), "unique"),
    ("Fri, 01 Oct 2021 16:00:00 -0400", None, us(2021, 10, 1, 20), "offset"),
    ("Jul 2, 2021 5:33:53 PM EDT", None, us(2021, 7, 2, 21, 33, 53), "offset"),
    ("2021-07-01 12:00:00 BST", None, us(2021, 7, 1, 11), "offset"),
    ("2021-07-01 12:00:00", "GB", us(2021, 7, 1, 11), "unique"),
    ("2021-07-01 12:00", "", us(2021, 7, 1, 12), "unique"),
    ("2021-02-30 10:00:00", None, None, None),
    ("2021-02-03 24:00:00", None, None, None),
    ("2021-02-03 10:60:00", None, None, None),
    ("2/3/2021 13:00 PM", None, None, None),
    ("0000-00-00 00:00:00", None, None, None),
    ("2021-07-01", None, None, None),
    ("pending", None, None, None),
    ("", None, None, None),
    (None, "ET", None, None),
    ("2021-07-01 12:00:00", "Nowhere/At_All", None, None),
]


def test_texts(spark):
    df = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(CASES)], "k int, t string, z string")
    got = {r.k: (r.instant_us, r.instant_us_match) for r in resolve_instants(df, "t", "z").collect()}
    assert got == {k: c[2:] for k, c in enumerate(CASES)}


def test_extra_and_clashing_columns_empty_and_long(spark):
    df = spark.createDataFrame([(1, "x" * 100_000, None, "keep")], "k int, t string, z string, instant_us string").selectExpr("*", "'a' as zone_name", "1 as spans")
    row = resolve_instants(df, "t", "z").collect()[0]
    assert row.instant_us is None and row.zone_name == "a" and row.spans == 1
    assert resolve_instants(df.limit(0), "t", "z").count() == 0


@pytest.mark.parametrize("n", [3])
def test_repeated_rows_keep_their_number(spark, n):
    df = spark.createDataFrame([("2021-11-07 01:30:00", "ET")] * n, "t string, z string")
    assert resolve_instants(df, "t", "z").count() == n


def plain(wall, zone):
    """By the standard library: the first of two, the offset before the change for a skipped one."""
    z = ZoneInfo(zone)
    d = wall - datetime(1970, 1, 1) - wall.replace(tzinfo=z).utcoffset()  # fold 0: the first of two, and the offset before a gap
    return (d.days * 86400 + d.seconds) * 10**6 + d.microseconds


def check(spark, walls):
    df = spark.createDataFrame([(w.strftime("%Y-%m-%d %H:%M:%S").rjust(19, "0"), z) for w, z in walls], "t string, z string").withColumn("k", F.monotonically_increasing_id())
    got = [r.instant_us for r in resolve_instants(df, "t", "z").orderBy("k").collect()]
    assert got == [plain(w, z) for w, z in walls]


def test_all_years(spark):
    years = (1, 1500, 1800, 1834, 1835, 1883, 1895, 1919, 1969, 2037, 2038, 2087, 2099, 2100, 2101, 2128, 2129, 2150, 2400, 4000, 9998)
    zones = ("America/New_York", "Europe/Amsterdam", "Europe/Dublin", "Europe/Berlin", "UTC", "Australia/Lord_Howe", "America/Sao_Paulo", "Africa/Casablanca", "America/Nuuk", "Africa/Cairo", "Asia/Gaza", "Pacific/Apia")
    check(spark, [(datetime(y, m, d, 2, 30), z) for y in years for z in zones for m, d in ((1, 1), (3, 14), (6, 1), (12, 31))])


def test_every_day_where_zones_suspend_summer_time(spark):
    check(spark, [(datetime(y, 1, 1, 2, 30) + timedelta(k), z) for y in (2050, 2060, 2080) for z in ("Africa/Casablanca", "Africa/El_Aaiun") for k in range(365)])


def test_hours_around_changes(spark):
    around = [datetime(y, m, d) + timedelta(minutes=20 * k) for y, m, d in ((2150, 3, 8), (2150, 11, 1), (2021, 3, 14), (1942, 2, 9)) for k in range(72)]
    check(spark, [(w, "America/New_York") for w in around])


def test_last_instant_of_the_last_year(spark):
    df = spark.createDataFrame([("9999-12-31 23:59:59", None), ("9999-12-31 23:59:59", "Europe/Berlin"), ("0001-01-01 00:00:00", "")], "t string, z string")
    end = us(9999, 12, 31, 23, 59, 59)
    assert [r.instant_us for r in resolve_instants(df, "t", "z").collect()] == [end, end - 3600 * 10**6, us(1, 1, 1)]

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalpanel.operators import bitemporal

from signalpanel.operators.bitemporal import locate_versions

E = "doc string, k string, day date, known timestamp, regions string, _row int"
V = "k string, rec long, snap date, pub timestamp, f date, e date"


def brute(events, versions):
    out = {}
    for doc, k, day, known, *_ in events:
        ok = [(v[2], v[3], v[1]) for v in versions if None not in (k, day, known, v[0], v[2], v[3]) and v[0] == k and v[3] <= known and v[2] <= day and (v[4] is None or v[4] <= day) and (v[5] is None or day <= v[5])]
        out[doc] = max(ok)[2] if ok else None
    return out


def run(spark, events, versions):
    e, v = spark.createDataFrame(events, E), spark.createDataFrame(versions, V)
    begin = F.when(F.col("snap").isNotNull(), F.greatest("snap", "f"))
    got = locate_versions(e, v.where("snap is not null"), "k", "day", "known", begin, F.col("e"), F.col("pub"), [F.col("snap"), F.col("pub"), F.col("rec")], "rec", "rec")
    return got


@pytest.mark.parametrize("change", [{}, {"CELL_DAYS": 8, "LEVELS": 3, "CELL_US": 9 * 86400 * 10**6}, {"LISTED": 1}, {"LISTED": 0, "PER_STRIP": 2}, {"LISTED": 0, "PER_STRIP": 1, "CELL_DAYS": 1024, "LEVELS": 10}])
def test_against_brute_force(spark, monkeypatch, change):
    rnd = random.Random(7)
    day = lambda: date(2020, 1, 1) + timedelta(rnd.randrange(900))
    at = lambda: datetime(2020, 1, 1) + timedelta(rnd.randrange(900), rnd.randrange(86400))
    maybe = lambda x, p: None if rnd.random() < p else x
    versions = [(maybe(rnd.choice("abc"), 0.05), n, maybe(day(), 0.05), maybe(at(), 0.05), maybe(day(), 0.4), maybe(day(), 0.6)) for n in range(200)]
    events = [(f"d{n}", maybe(rnd.choice("abcz"), 0.05), maybe(day(), 0.05), maybe(at(), 0.05), "r", 1) for n in range(400)]
    want = brute(events, versions)
    for name, value in change.items():
        monkeypatch.setattr(bitemporal, name, value)
    got = run(spark, events, versions + versions[:20])
    assert {r.doc: r.rec for r in got.collect()} == want
    assert got.columns == ["doc", "k", "day", "known", "regions", "_row", "rec"]


def test_hot_key(spark):
    """Many versions and events of one key within 200 days, at few instants and at many: ties in time, rank and cell."""
    rnd = random.Random(8)
    day = lambda: date(2020, 1, 1) + timedelta(rnd.randrange(200))
    at = lambda: datetime(2020, 1, 1) + timedelta(rnd.randrange(200), rnd.choice((0, rnd.randrange(86400))))
    versions = [("hot", n, day(), at(), day(), rnd.choice((None, day()))) for n in range(3000)]
    events = [(f"d{n}", "hot", day(), at(), "r", 1) for n in range(600)]
    assert {r.doc: r.rec for r in run(spark, events, versions).collect()} == brute(events, versions)


def test_boundaries_and_empty(spark):
    t = datetime(2020, 1, 5, 12)
    v = [("a", 1, date(2020, 1, 1), t, None, date(2020, 1, 5))]
    e = [("in", "a", date(2020, 1, 5), t, "", 0), ("early", "a", date(2020, 1, 5), t - timedelta(microseconds=1), "", 0), ("over", "a", date(2020, 1, 6), t, "", 0)]
    assert {r.doc: r.rec for r in run(spark, e, v).collect()} == {"in": 1, "early": None, "over": None}
    assert run(spark, e, []).where("rec is not null").count() == 0
    assert run(spark, [], v).count() == 0
    assert run(spark, e + e, v).count() == 6

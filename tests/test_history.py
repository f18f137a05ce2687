from datetime import date, datetime

from signalpanel.functions.text import ticker
from signalpanel.operators.history import attribute_history

SCHEMA = "entity string, rec long, snap date, pub timestamp, t string, f date, e date, v string, r string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = attribute_history(df, "entity", ticker("t"), "snap", "pub", "rec", "f", "e", "historical")
    return sorted((r.entity, r.historical, r.valid_from and str(r.valid_from), r.valid_to and str(r.valid_to), r.n_snapshots) for r in out.collect())


def d(m, day=1, y=2020):
    return date(y, m, day)


def p(m, day=2, y=2020):
    return datetime(y, m, day)


def test_versions_return_and_latest_publication(spark):
    rows = [
        ("a", 1, d(1), p(1), " aa", d(1), None), ("a", 2, d(2), p(2), "AA", d(1, 3), None), ("a", 3, d(3), p(3), "BB", d(3), None),
        ("a", 4, d(4), p(4), "aa ", d(4), d(12)), ("a", 5, d(5), p(5), "AA", None, d(11)), ("a", 6, d(5), p(4), "ZZ", d(5), None), ("a", 7, d(6), p(6), "  ", d(6), None), ("a", 8, d(7), p(7), None, d(6), None),
    ]
    want = [("a", "AA", "2020-01-03", "2020-02-29", 2), ("a", "AA", "2020-04-01", "2020-11-01", 2), ("a", "BB", "2020-03-01", "2020-03-31", 1)]
    assert run(spark, rows) == want
    assert run(spark, rows * 3) == want  # exact repeats


def test_missing_bounds_late_publication_ties(spark):
    late = [("a", 1, d(1), p(9), "AA", d(1, 5), None), ("a", 2, d(2), p(2), "AA", d(1, 7), None), ("a", 3, d(3), None, "BB", None, None), ("b", 5, d(1), p(1), "X", d(1), None), ("b", 6, d(1), p(1), "Y", d(2), None), (None, 9, d(1), p(1), "Q", d(1), None), ("c", 9, None, p(1), "Q", d(1), None)]
    assert run(spark, late) == [("a", "AA", "2020-01-05", None, 2), ("a", "BB", None, "9999-12-31", 1), ("b", "Y", "2020-02-01", "9999-12-31", 1)]


def test_empty(spark):
    assert run(spark, []) == []

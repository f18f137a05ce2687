import random
from collections import Counter
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from signalpanel.operators.diff import diff_copies, latest_rows, relative_apart, residues, unequal
from signalpanel.operators.grid import to_grid

DAYS = [date(2020, 1, 1) + timedelta(n) for n in (0, 1, 2, 5, 6, 7, 8, 9, 12)]


def grid(spark, rows, **kw):
    r = spark.createDataFrame([(*x, "extra", 1) for x in rows], "k string, day date, v double, ord int, session string, idx int")
    s = spark.createDataFrame([(x,) for x in [*DAYS, DAYS[0]]] + [(None,)], "d date")
    return sorted((x.k, str(x.session), x.value, x.status, x.gap) for x in to_grid(r, s, "k", "day", "v", [F.col("ord")], "d", **kw).collect())


def test_gaps_ties_and_boundaries(spark):
    rows = [("a", DAYS[1], 1.0, 1), ("a", DAYS[1], 2.0, 2), ("a", DAYS[1], 2.0, 2), ("a", DAYS[4], 5.0, 1), ("a", DAYS[5], 6.0, 1), ("a", date(2020, 1, 4), 99.0, 1), (None, DAYS[1], 1.0, 1), ("a", DAYS[8], None, 1), ("b", DAYS[3], 7.0, 1)]
    want = [("a", "2020-01-02", 2.0, "read", 0), ("a", "2020-01-03", 3.0, "interpolated", 2), ("a", "2020-01-06", 4.0, "interpolated", 2), ("a", "2020-01-07", 5.0, "read", 0), ("a", "2020-01-08", 6.0, "read", 0), ("b", "2020-01-06", 7.0, "read", 0)]
    assert grid(spark, rows) == want
    marked = grid(spark, rows, max_gap=1)
    assert [x[3] for x in marked] == ["read", "missing", "missing", "read", "read", "read"] and marked[1][2] is None
    wide = grid(spark, rows, start=F.lit("2020-01-01").cast("date"), end=F.lit("2020-01-09").cast("date"))
    assert [(x[1], x[3]) for x in wide if x[0] == "b"] == [("2020-01-01", "before"), ("2020-01-02", "before"), ("2020-01-03", "before"), ("2020-01-06", "read"), ("2020-01-07", "after"), ("2020-01-08", "after"), ("2020-01-09", "after")]
    assert grid(spark, []) == []


def diff(spark, left, right):
    schema = "k string, p double, q long, src string, loaded timestamp, finding string, l int"
    a, b = (latest_rows(spark.createDataFrame([(*r, "x", 0) for r in rows], schema), ["k"], ["p", "q", "src"], "loaded") for rows in (left, right))
    out = diff_copies(a, b, ["k"], {"p": relative_apart(1e-6), "q": unequal, "src": unequal}, "primary", "copy")
    return sorted((r.k, r.finding) for r in out.collect())


def test_diff(spark):
    t = datetime(2020, 1, 1)
    late = t + timedelta(1)
    left = [("same", 1.0, 1, "a", t), ("same", 9.0, 9, "z", t - timedelta(1)), ("close", 1.0, 1, "a", t), ("apart", 1.0, 1, "a", t), ("nulls", None, None, None, t), ("only", 1.0, 1, "a", t), (None, 1.0, 1, "a", t), ("half", None, 1, "a", t), ("tie", 1.0, 2, "a", t), ("tie", 1.0, 1, "a", t)]
    right = [("same", 1.0, 1, "a", late), ("close", 1.0000009, 1, "a", t), ("apart", 1.0000012, 2, "b", t), ("nulls", None, None, None, t), ("new", 1.0, 1, "a", t), ("half", 2.0, 1, "a", None), ("tie", 1.0, 2, "a", t)]
    want = [("apart", "p"), ("apart", "q"), ("apart", "src"), ("half", "p"), ("new", "missing_in_primary"), ("only", "missing_in_copy")]
    assert diff(spark, left, right) == want
    assert diff(spark, left * 2, right * 2) == want
    assert diff(spark, [], []) == [] and diff(spark, left[:1], []) == [("same", "missing_in_copy")]


def test_residues_are_those_of_except_all(spark):
    rnd = random.Random(11)
    side = lambda: spark.createDataFrame([(rnd.choice(("a", "b", None)), rnd.choice((1, 2, None))) for _ in range(200)], "k string, v int")
    a, b = side(), side()
    got = sorted((str((r.k, r.v)), r._n) for r in residues(a, b, ["k", "v"]).collect())
    plain = Counter(str((r.k, r.v)) for r in a.exceptAll(b).collect())
    plain.subtract(Counter(str((r.k, r.v)) for r in b.exceptAll(a).collect()))
    assert got == sorted((k, n) for k, n in plain.items() if n) and got

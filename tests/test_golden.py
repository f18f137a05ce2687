"""Closed-form values of ranks, correlations, adjustment, drift, labels, turnover."""

from datetime import date
from math import log

import pytest
from pyspark.sql import functions as F

from signalpanel.functions import stats as S
from signalpanel.operators import evaluation as E
from signalpanel.operators import features as T
from signalpanel.operators import inference as I
from signalpanel.operators import panel as P
from signalpanel.operators import portfolio as B
from signalpanel.operators import sections as X
from signalpanel.sources import files as L


def cross(spark, scores, y=None):
    return spark.createDataFrame([("g", n, float(s), float((y or scores)[n])) for n, s in enumerate(scores)], "g string, n int, yhat double, y double")


def test_average_ranks_and_correlation(spark):
    r = cross(spark, [1, 1, 2, 3], [1, 2, 3, 4]).withColumn("r", S.average_rank("yhat", ["g"], zero_based=True)).orderBy("n")
    assert [x.r for x in r.collect()] == [0.5, 0.5, 2.0, 3.0]
    ic = E.information_coefficients(cross(spark, [1, 1, 2, 3], [1, 2, 3, 4]), ["g"]).collect()[0]
    assert ic.rank_ic == pytest.approx(0.9486832980505139)
    assert E.information_coefficients(cross(spark, [2, 2, 2], [1, 2, 3]), ["g"]).collect()[0].rank_ic == 0.0
    assert E.information_coefficients(cross(spark, [2]), ["g"]).collect()[0].ic == 0.0


def test_extremes(spark):
    legs = lambda v: {x.n: x.leg for x in E.ranked_cross_section(cross(spark, v), ["g"], "yhat").collect()}
    assert set(legs([1, 1, 1, 1]).values()) == {None}
    got = legs([0, 1, 1, 3, 4, 5, 6, 7, 7, 7])
    assert {n for n, s in got.items() if s == -1} == {0, 1, 2} and {n for n, s in got.items() if s == 1} == {7, 8, 9}
    assert {x.quantile for x in E.ranked_cross_section(cross(spark, [1, 1, 1]), ["g"], "yhat").collect()} == {3}


def test_newey_west(spark):
    x = [1.0, 2.0, 4.0, 3.0]
    m = sum(x) / 4
    e = [v - m for v in x]
    c = [sum(e[i] * e[i - k] for i in range(k, 4)) / 4 for k in range(3)]
    want = m / ((c[0] + 2 * (2 / 3) * c[1] + 2 * (1 / 3) * c[2]) / 4) ** 0.5
    df = spark.createDataFrame([(x,), ([1.0],), ([2.0, 2.0],)], "a array<double>")
    assert [r.t for r in df.select(S.newey_west_t(F.col("a"), 2).alias("t")).collect()] == [pytest.approx(want), 0.0, 0.0]


def test_adjustment_and_zero(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.5)], "fam string, spec_id string, p double")
    got = {r.spec_id: r for r in I.adjust_p_values(df, ["fam"]).collect()}
    assert [round(got[k].holm, 6) for k in "abcd"] == [0.04, 0.09, 0.09, 0.5]
    assert [round(got[k].benjamini_hochberg, 5) for k in "abcd"] == [0.04, 0.05333, 0.05333, 0.5]
    zero = spark.createDataFrame([("f", "a", 0.0), ("f", "b", None)], "fam string, spec_id string, p double")
    assert {r.spec_id: r.holm for r in I.adjust_p_values(zero, ["fam"]).collect()} == {"a": 0.0, "b": 1.0}
    assert {r.holm for r in I.adjust_p_values(zero, ["fam"], zero_is_one=True).collect()} == {1.0}


def test_normal_p(spark):
    p = [r.p for r in spark.createDataFrame([(0.0,), (1.959963984540054,), (None,)], "z double").select(S.normal_two_sided_p("z").alias("p")).collect()]
    assert p[:2] == [1.0, pytest.approx(0.05)] and p[2] is None


def test_labels_and_windows(spark):
    days = [date(2023, 11, d) for d in (1, 2, 3, 6, 7)]
    rows = [("AAPL", d, p) for d, p in zip(days, (99.0, 100.0, 102.0, 101.0, 104.0))] + [("SPY", d, p) for d, p in zip(days, (399.0, 400.0, 402.0, 404.0, 403.0))]
    panel = P.base_returns(spark.createDataFrame(rows, "ticker string, date date, price double"))
    ev = spark.createDataFrame([("AAPL", date(2023, 11, 2), 1), ("AAPL", date(2023, 11, 6), 2), ("NONE", date(2023, 11, 2), 3)], "ticker string, event_date date, doc_id int")
    got = {r.doc_id: r for r in P.build_labels(ev, panel, "SPY", 1, 3, ["CAR"], ["doc_id"]).collect()}
    assert (got[1].window_start, got[1].window_end) == (days[2], days[4])
    assert got[1].label_value == pytest.approx(log(104 / 100) - log(403 / 400))
    assert got[2].failure == got[3].failure == "insufficient_window" and got[2].label_value is None


def test_delisting(spark):
    df = spark.createDataFrame([("A", date(2020, 1, 1), 10.0, "-0.2", "-0.5", "500"), ("A", date(2020, 1, 2), 9.0, None, None, "500"), ("A", date(2020, 1, 3), 9.0, "x", "-0.1", None)], "ticker string, date date, price double, ret string, dlret string, dlstcd string")
    got = P.delisting_returns(P.base_returns(df)).orderBy("date").collect()
    assert [r.simple_return for r in got] == [pytest.approx(-0.6), None, pytest.approx(-0.1)] and [r.delisting_flag for r in got] == ["applied", "missing", "applied"]


def test_expanding_windows(spark):
    w = P.expanding_windows(spark, 2010, 2018, 5, 1, 1, date(2018, 6, 30)).collect()
    assert [x.split_id for x in w] == ["test_2016", "test_2017", "test_2018"] and str(w[-1].test_end) == "2018-06-30" and {str(x.train_start) for x in w} == {"2010-01-01"}


def test_drift_drops_for_good(spark):
    rows = [("g", "A", 1.0, date(2020, 1, 1), 0.1), ("g", "B", -1.0, date(2020, 1, 1), -0.1), ("g", "A", 1.0, date(2020, 1, 2), 0.1), ("g", "B", -1.0, date(2020, 1, 2), None), ("g", "A", 1.0, date(2020, 1, 3), 0.1), ("g", "B", -1.0, date(2020, 1, 3), 5.0)]
    got = B.drift(spark.createDataFrame([(*r, 1.0) for r in rows], "g string, ticker string, weight double, date date, ret double, turnover double"), ["g"], 0.001).orderBy("date").collect()
    assert [round(r.gross_return, 10) for r in got] == [0.2, round(0.1 * 1.1 / 1.2, 10), round(1.1 / 1.2 * 1.1 / (1 + 0.11 / 1.2) * 0.1, 10)]
    assert got[0].net_return == pytest.approx(0.199) and got[1].net_return == got[1].gross_return


def test_turnover(spark):
    w = spark.createDataFrame([("m", 1, "A", 1.0), ("m", 1, "B", -1.0), ("m", 2, "B", 1.0), ("m", 2, "A", -1.0), ("m", 3, "C", 1.0)], "m string, d int, ticker string, weight double")
    assert {r.d: r.turnover for r in B.turnover(w, ["m"], "d").collect()} == {1: 1.0, 2: 2.0, 3: 1.5}


def test_tokens_and_sections(spark):
    df = spark.createDataFrame([("Liquidity, litigation-risk MAY fluctuate.",), (None,)], "t string").select(T.tokens("t").alias("w"))
    assert [r.w for r in df.collect()] == [["liquidity", "litigation-risk", "may", "fluctuate"], []]
    text = "Item 1. Business .... 3\nItem 7. MD&A .... 9\nItem 1. Business\nWe sell things.\nItem 1A. Risk Factors\nMany risks.\nItem 7. Management\n" + "long body " * 5 + "\nItem 8. Statements\nNumbers"
    got = {r.item: r for r in X.parse_sections(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t", ("1", "1a", "3", "7")).collect()}
    assert got["1"].body == "We sell things." and got["1a"].body == "Many risks." and got["3"].status == "missing" and got["7"].body.startswith("long body")
    pages = [("<p>a&amp;b</p><script>x = '</p>'</script><div>c &amp;lt; d</div>", "a&b\n\nc < d"), ("<!-- <p> -->x<br>y&nbsp; z&#x41;&bogus;&#65", "x\ny zA&bogus;&#65"), ("a<style>b", "a"), ("&amp;amp;lt;", "&lt;"), (None, None), ("", "")]
    got = spark.createDataFrame(pages, "p string, t string").select(X.html_text(F.col("p")).alias("g"), "t").collect()
    assert [r.g for r in got] == [r.t for r in got]


def test_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    good, bad = L.read_jsonl(spark, str(p), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 1
    c = tmp_path / "x.csv"
    c.write_bytes("﻿a,b\n1,\n".encode())
    assert [tuple(r) for r in L.read_csv(spark, str(c), "a int, b string").collect()] == [(1, None)]
    assert L.read_csv(spark, str(tmp_path / "none.csv"), "a int", missing_ok=True).count() == 0
    with pytest.raises(ValueError):
        L.load_config("a: 1\nz: 2", {"a": int})
    assert L.load_config("a: 1", {"a": int}) == {"a": 1}
    with pytest.raises(KeyError):
        L.Providers("x").load()

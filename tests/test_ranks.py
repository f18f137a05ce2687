import random

import pytest
from pyspark.sql import functions as F

from signalpanel.functions.stats import average_rank
from signalpanel.operators import evaluation as E
from signalpanel.operators.ranks import percentile, value_ranks, with_ranks


def rows(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), rnd.choice((None, 0.0, -1.5, 2.0, float(rnd.randrange(40)), rnd.random())), rnd.random()) for _ in range(500)]
    return spark.createDataFrame([*data, ("c", 1.0, 0.0), ("d", None, None), (None, 1.0, 1.0), (None, 2.0, 1.0)], "g string, y double, yhat double")


def test_ranks_equal_those_of_windows(spark):
    df = rows(spark)
    got = with_ranks(df, ["g"], {"y": "ry", "yhat": "rp"}).select("g", "y", "yhat", "ry", "rp")
    want = df.withColumns({"ry": average_rank("y", ["g"]), "rp": average_rank("yhat", ["g"])})
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_percentile(spark):
    df = rows(spark).where("y is not null and g = 'a'")
    got = value_ranks(df, ["g"], ["y"]).groupBy("g").agg(percentile(0.01).alias("a"), percentile(0.37).alias("b")).first()
    want = df.agg(F.percentile("y", 0.01), F.percentile("y", 0.37)).first()
    assert tuple(got)[1:] == pytest.approx(tuple(want))


def test_empty(spark):
    df = rows(spark).limit(0)
    assert value_ranks(df, ["g"], ["y"]).count() == 0 and with_ranks(df, ["g"], {"y": "r"}).count() == 0


def test_direction(spark):
    df = spark.createDataFrame([("up", float(k), float(k)) for k in range(20)] + [("down", float(k), -float(k)) for k in range(20)] + [("flat", 1.0, 5.0)] * 3, "g string, yhat double, y double")
    of = lambda **kw: {r.g: r.direction for r in E.signal_direction(df, ["g"], **kw).collect()}
    assert of() == {"up": 1, "down": -1, "flat": 1}
    assert of(volatility=F.lit(True)) == {"up": -1, "down": -1, "flat": -1}
    assert of(requested=F.lit(1)) == {"up": 1, "down": 1, "flat": 1}
    assert of(requested=F.lit(1), volatility=F.lit(True)) == {"up": -1, "down": -1, "flat": -1}

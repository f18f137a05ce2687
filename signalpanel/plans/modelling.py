"""Queries of models and features sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.operators import features as T
from signalpanel.operators import models as M
from signalpanel.operators import panel as P
from signalpanel.plans.base import EVENTS_SQL, META_SQL, events, meta
from signalpanel.plans.evaluate import _round
from signalpanel.plans.texts import COMPONENTS, FIT, GRAMS, split_docs
from signalpanel.session import table


def _rows(s: SparkSession, d: str) -> DataFrame:
    """Event rows with a role in the split of 2000: train to 1998, validation 1999, test 2000."""
    year = F.year("event_date")
    role = F.when(year <= 1998, "train").when(year == 1999, "validation").when(year == 2000, "test")
    return events(s, d).join(meta(s, d), "ticker").withColumns({"split_id": F.lit(2000), "role": role}).where("role is not null").drop("yhat")


def _split_rows(s: SparkSession, d: str) -> DataFrame:
    """Event rows by role for each expanding split with a test year of 1999 to 2001. The target is of the event's own day, so nothing is purged."""
    e = events(s, d).drop("yhat").join(meta(s, d), "ticker").withColumns({"window_start": F.date_add("event_date", 1), "window_end": F.col("event_date")})
    return P.assign_splits(e, P.expanding_windows(s, 1995, 2001, 3, 1, 1), 0).drop("window_start", "window_end", "status")


def a9_splits(s: SparkSession, d: str) -> DataFrame:
    return _round(M.train_mean(_split_rows(s, d), ["split_id"]).select("split_id", "doc_id", "role", (F.col("yhat") + 1e-9).alias("yhat")))  # means that end in half a digit round alike


def a10_splits(s: SparkSession, d: str) -> DataFrame:
    return _round(M.industry_mean(_split_rows(s, d), ["split_id"], "industry").select("split_id", "doc_id", "role", (F.col("yhat") + 1e-9).alias("yhat")))  # means that end in half a digit round alike


def a9(s: SparkSession, d: str) -> DataFrame:
    return _round(M.train_mean(_rows(s, d), ["split_id"]).select("doc_id", "role", "yhat"))


def a10(s: SparkSession, d: str) -> DataFrame:
    return _round(M.industry_mean(_rows(s, d), ["split_id"], "industry").select("doc_id", "role", "yhat"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).select("doc_id", "yhat")
    rows = _split_rows(s, d).join(e, "doc_id").withColumn("x", F.array(F.col("yhat2").cast("double"), F.col("yhat").cast("double"), (F.col("ticker") % 10).cast("double"))).drop("yhat")
    return rows.select("split_id", "role", "doc_id", "y", "x")


def r19(s: SparkSession, d: str) -> DataFrame:
    return _round(M.ridge(_vectors(s, d), ["split_id"]))


def r15(s: SparkSession, d: str) -> DataFrame:
    """Vectors from the train documents of each split, scores for all its documents."""
    docs = split_docs(s, d)
    blocks = T.tfidf_rows(docs, ["split_id"], "text", *GRAMS, *FIT, "role = 'train'", M.document_blocks(docs.schema, ["split_id"], "doc_id"))
    return _round(M.svd_of_blocks(blocks, ["split_id"], "doc_id", COMPONENTS), 5)


def _features(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("part_"), (F.col("l_partkey") % 50).cast("string")).alias("name"), F.col("l_quantity").alias("value"))
    return li.groupBy("doc_id", "name").agg(F.max("value").alias("value")).withColumn("split_id", F.lit(2000))


def _split_features(s: SparkSession, d: str) -> DataFrame:
    windows = P.expanding_windows(s, 1995, 2001, 3, 1, 1).select("split_id")
    return _features(s, d).drop("split_id").join(F.broadcast(windows), how="cross")


def r18_splits(s: SparkSession, d: str) -> DataFrame:
    f = M.select_features(_split_features(s, d), _split_rows(s, d), ["split_id"])
    return f.groupBy("split_id", "name").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))


def r21_splits(s: SparkSession, d: str) -> DataFrame:
    return M.prediction_failures(_split_rows(s, d), _split_features(s, d).where("value > 20"), ["split_id"]).groupBy("split_id", "reason").agg(F.count("*").alias("n"))


def r17_splits(s: SparkSession, d: str) -> DataFrame:
    rows = _split_rows(s, d).select("split_id", "doc_id", "ticker", "role", "y")
    return _model_rows(s, d, rows)


def r18(s: SparkSession, d: str) -> DataFrame:
    f = M.select_features(_features(s, d), _rows(s, d), ["split_id"])
    return f.groupBy("name").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))


def r21(s: SparkSession, d: str) -> DataFrame:
    return M.prediction_failures(_rows(s, d), _features(s, d).where("value > 20"), ["split_id"]).groupBy("reason").agg(F.count("*").alias("n"))


def r17(s: SparkSession, d: str) -> DataFrame:
    """Model rows: assignments with labels, features and metadata with defaults."""
    return _model_rows(s, d, _rows(s, d).select("doc_id", "ticker", "role", "y"))


def _model_rows(s: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    f = _features(s, d).groupBy("doc_id").agg(F.count("*").alias("n_features"), F.round(F.sum("value"), 2).alias("total"))
    m = meta(s, d).where("ticker % 5 <> 0").select("ticker", "industry", "sector")
    return rows.join(f, "doc_id").join(m, "ticker", "left").withColumn("industry", F.coalesce("industry", F.lit("__GLOBAL__")))


def r20(s: SparkSession, d: str) -> DataFrame:
    """Boosted trees: three grid points, the choice by validation rank correlation, a refit for test rows."""
    return _round(M.boosting(_vectors(s, d), ["split_id"]))


_R = f"{EVENTS_SQL}, {META_SQL}, rws as (select doc_id, e.ticker, event_date, y, industry, sector, case when year(event_date) <= 1998 then 'train' when year(event_date) = 1999 then 'validation' else 'test' end role from events0 e join meta m on m.ticker = e.ticker where year(event_date) <= 2000)"
_F = "f as (select l_orderkey doc_id, 'part_' || l_partkey % 50 \"name\", max(l_quantity) v from lineitem group by 1, 2)"
_RS = f"{EVENTS_SQL}, {META_SQL}, rws as (select 'test_' || ty split_id, doc_id, e.ticker, y, industry, sector, case when year(event_date) = ty then 'test' when year(event_date) = ty - 1 then 'validation' else 'train' end role from events0 e join meta m on m.ticker = e.ticker join (values (1999), (2000), (2001)) w(ty) on year(event_date) between 1995 and ty), tm as (select split_id, avg(y) m from rws where role = 'train' group by 1)"
QUERIES = {"A9_train_mean": a9, "A10_industry_mean": a10, "R17_J2_J3_model_rows": r17, "R18_feature_selection": r18, "R21_prediction_failures": r21, "R19_ridge": r19, "R15_truncated_svd": r15, "R20_boosting": r20}
QUERIES |= {"A9_split_train_mean": a9_splits, "A10_split_industry_mean": a10_splits, "R17_split_model_rows": r17_splits, "R18_split_feature_selection": r18_splits, "R21_split_prediction_failures": r21_splits}
ORACLES = {
    "A9_train_mean": f"with {_R} select doc_id, role, round((select avg(y) from rws where role = 'train'), 6) yhat from rws where role <> 'train'",
    "A10_industry_mean": f"with {_R}, i as (select industry, avg(y) m from rws where role = 'train' group by 1) select doc_id, role, round(coalesce(m, (select avg(y) from rws where role = 'train')), 6) yhat from rws left join i using (industry) where role <> 'train'",
    "R17_J2_J3_model_rows": f"with {_R}, {_F} select doc_id, r.ticker, role, y, n_features, total, coalesce(m.industry, '__GLOBAL__') industry, m.sector from rws r join (select doc_id, count(*) n_features, round(sum(v), 2) total from f group by 1) using (doc_id) left join (select * from meta where ticker % 5 <> 0) m on m.ticker = r.ticker",
    "R18_feature_selection": f"with {_R}, {_F} select name, count(*) n_rows, round(sum(v), 2) total from f where name in (select name from f join rws using (doc_id) where role = 'train') group by 1",
    "R21_prediction_failures": f"with {_R}, {_F} select 'missing_row_features' reason, count(*) n from rws where role <> 'train' and doc_id not in (select doc_id from f where v > 20)",
}
ORACLES |= {
    "A9_split_train_mean": f"with {_RS} select split_id, doc_id, role, round(m + 1e-9, 6) yhat from rws join tm using (split_id) where role <> 'train'",
    "A10_split_industry_mean": f"with {_RS}, i as (select split_id, industry, avg(y) own from rws where role = 'train' group by 1, 2) select split_id, doc_id, role, round(coalesce(own, m) + 1e-9, 6) yhat from rws join tm using (split_id) left join i using (split_id, industry) where role <> 'train'",
    "R17_split_model_rows": f"with {_RS}, {_F} select split_id, doc_id, r.ticker, role, y, n_features, total, coalesce(m.industry, '__GLOBAL__') industry, m.sector from rws r join (select doc_id, count(*) n_features, round(sum(v), 2) total from f group by 1) using (doc_id) left join (select * from meta where ticker % 5 <> 0) m on m.ticker = r.ticker",
    "R18_split_feature_selection": f"with {_RS}, {_F}, k as (select distinct split_id, name from f join rws using (doc_id) where role = 'train') select split_id, name, count(*) n_rows, round(sum(v), 2) total from f join k using (name) group by 1, 2",
    "R21_split_prediction_failures": f"with {_RS}, {_F} select split_id, 'missing_row_features' reason, count(*) n from rws where role <> 'train' and doc_id not in (select doc_id from f where v > 20) group by 1",
}

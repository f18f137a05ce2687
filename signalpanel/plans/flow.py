"""End-to-end flows and the last small operators: labels to rank correlation by split, p-value methods, ids, review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.functions import scalars as C
from signalpanel.functions.stats import fisher_z
from signalpanel.operators import evaluation as E
from signalpanel.operators import features as T
from signalpanel.operators import panel as P
from signalpanel.plans.base import META_SQL, events, meta, panel
from signalpanel.plans.evaluate import _C, _round
from signalpanel.plans.panels import _FWD
from signalpanel.session import table


def _oos(s: SparkSession, d: str) -> DataFrame:
    """Out-of-sample rows: 20-row forward volatility as y, the event's score as yhat, for each expanding split's test year."""
    ret = P.base_returns(panel(s, d))
    e = events(s, d).select("ticker", "event_date", "doc_id", "yhat")
    fwd = P.forward_windows(e, ret, ["doc_id", "yhat"], 1, 20).where("n_rows = 20").withColumn("y", F.round("volatility", 6))
    return P.assign_splits(fwd, P.expanding_windows(s, 1995, 2001, 3, 1, 1), 20).where("role = 'test' and status = 'pass' and y is not null")


def flow_rank_ic(s: SparkSession, d: str) -> DataFrame:
    """Does the score rank future volatility out of sample? Rank correlation by split, and over all splits."""
    rows = _oos(s, d).select("split_id", "doc_id", "y", F.col("yhat").cast("double").alias("yhat"))
    both = rows.unionByName(rows.withColumn("split_id", F.lit("ALL_SPLITS")))
    return _round(E.information_coefficients(both, ["split_id"]))


def p_method(split: Column, rank: Column) -> Column:
    """Two-sided normal of the Newey-West t for pooled monthly rows, else the Sharpe approximation."""
    return F.when((split == "ALL_SPLITS") & rank.startswith("monthly"), "newey_west_normal").otherwise("sharpe_normal")


def f33(s: SparkSession, d: str) -> DataFrame:
    """z scores by method: Fisher for correlations, Sharpe * sqrt(n / 252) for returns; null where p is fixed at 1; availability of finite metrics."""
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100 / 100 - 0.5).alias("m"), (F.col("o_orderkey") % 7).cast("int").alias("n"), F.when(F.col("o_orderkey") % 2 == 0, "ALL_SPLITS").otherwise("s1").alias("split"), F.when(F.col("o_orderkey") % 3 == 0, "monthly_x").otherwise("event").alias("family"))
    sharpe = F.when(F.col("n") >= 2, F.col("m") * F.sqrt(F.col("n") / 252.0))
    available = F.col("m").isNotNull() & ~F.isnan("m") & (F.abs("m") < float("inf"))
    return _round(o.select("o_orderkey", p_method(F.col("split"), F.col("family")).alias("method"), fisher_z(F.col("m"), F.col("n")).alias("fisher"), sharpe.alias("sharpe"), available.alias("available")))


def f41(s: SparkSession, d: str) -> DataFrame:
    """Year bounds and window text of an event's split, contents-line predicate, normalised item."""
    m = table(s, d, "document_manifest").where("fiscal_year is not null")
    y = F.col("fiscal_year")
    return m.select("row_id", F.make_date(y, F.lit(1), F.lit(1)).alias("first_day"), F.concat_ws("..", y.cast("string"), (y + 1).cast("string")).alias("window"), F.lower(F.regexp_replace("document_type", r"[\s.]+", "")).alias("item"), F.coalesce(F.col("document_type").rlike(r"\.{2,}\s*\d+$"), F.lit(False)).alias("contents_line"))


def f43(s: SparkSession, d: str) -> DataFrame:
    """Distinct normalised tickers in order of first appearance."""
    from signalpanel.functions.text import ticker

    t = table(s, d, "document_manifest").select(ticker("ticker").alias("ticker"), "row_id").where("ticker is not null")
    return t.groupBy("ticker").agg(F.min("row_id").alias("first_row"))


def r42(s: SparkSession, d: str) -> DataFrame:
    """Universe seed rows: rank-based placeholder size where the cap is unknown, flagged as an estimate."""
    from pyspark.sql import Window

    m = meta(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("sector").orderBy("ticker")))
    cap = F.coalesce("cap", F.lit(1000.0) / F.col("rank"))
    flag = F.when(F.col("cap").isNull(), "rank_proxy").otherwise("vendor")
    return _round(m.select("ticker", cap.alias("cap"), flag.alias("flag"), C.is_estimated_cap(flag).alias("estimated")))


_OOS = f"{_FWD}, oos as (select 'test_' || year(f.event_date) split_id, f.doc_id, round(volatility, 6) y, e.yhat from fwd f join events0 e using (doc_id) where n_rows = 20 and year(f.event_date) between 1999 and 2001 and volatility is not null and window_start > f.event_date), bo as (select * from oos union all select 'ALL_SPLITS', doc_id, y, yhat from oos), rk as (select *, rank() over (partition by split_id order by y) + (count(*) over (partition by split_id, y) - 1) / 2.0 ry, rank() over (partition by split_id order by yhat) + (count(*) over (partition by split_id, yhat) - 1) / 2.0 rp from bo)"
_M = "o_orderkey % 100 / 100 - 0.5"
QUERIES = {"flow_rank_ic": flow_rank_ic, "F33_F36_F38_test_scores": f33, "F40_F41_windows": f41, "F43_tickers": f43, "R42_seed_rows": r42}
ORACLES = {
    "flow_rank_ic": f"with {_OOS} select split_id, round({_C.format('y', 'yhat')}, 6) + 0.0 ic, round({_C.format('ry', 'rp')}, 6) + 0.0 rank_ic, count(*) n from rk group by 1",
    "F33_F36_F38_test_scores": f"select o_orderkey, case when o_orderkey % 2 = 0 and o_orderkey % 3 = 0 then 'newey_west_normal' else 'sharpe_normal' end \"method\", case when o_orderkey % 7 >= 4 then round(atanh({_M}) * sqrt(o_orderkey % 7 - 3), 6) + 0.0 end fisher, case when o_orderkey % 7 >= 2 then round(({_M}) * sqrt((o_orderkey % 7) / 252.0), 6) + 0.0 end sharpe, true available from orders",
    "F40_F41_windows": "select row_id, make_date(fiscal_year, 1, 1) first_day, fiscal_year || '..' || (fiscal_year + 1) \"window\", lower(regexp_replace(document_type, '[\\s.]+', '', 'g')) item, coalesce(regexp_matches(document_type, '\\.{2,}\\s*\\d+$'), false) contents_line from document_manifest where fiscal_year is not null",
    "F43_tickers": "select t ticker, min(row_id) first_row from (select *, upper(regexp_replace(ticker, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) t from document_manifest) where t <> '' group by 1",
    "R42_seed_rows": f"with {META_SQL} select ticker, round(coalesce(cap, 1000.0 / row_number() over (partition by sector order by ticker)), 6) cap, case when cap is null then 'rank_proxy' else 'vendor' end flag, cap is null estimated from meta",
}

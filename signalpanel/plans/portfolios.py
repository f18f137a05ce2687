"""Queries of portfolios and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.functions.stats import fisher_z, normal_two_sided_p
from signalpanel.operators import evaluation as E
from signalpanel.operators import inference as I
from signalpanel.operators import portfolio as B
from signalpanel.plans.base import SCORED_SQL, scored
from signalpanel.plans.evaluate import _C, _LEGS, _RANKS_G, _round

K = ["model_id", "event_date"]


def _rows(s: SparkSession, d: str) -> DataFrame:
    """Test rows, one for each ticker and date: the largest document stands."""
    t = scored(s, d).where("role = 'test'")
    best = t.groupBy("model_id", "event_date", "ticker").agg(F.max(F.struct("doc_id", "y", "yhat", "industry", "sector", "cap")).alias("x"))
    return best.select("model_id", "event_date", "ticker", "x.*")


def _weights(s: SparkSession, d: str, variant: str) -> DataFrame:
    return B.leg_weights(_rows(s, d), K, variant).select(*K, "ticker", "weight")


def r25(variant: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        return _round(_weights(s, d, variant))

    return query


def r24(s: SparkSession, d: str) -> DataFrame:
    return B.variants_available(_rows(s, d), K)


def a14(s: SparkSession, d: str) -> DataFrame:
    return _round(B.exposures(_weights(s, d, "risk_scaled"), K))


def a15(s: SparkSession, d: str) -> DataFrame:
    return _round(B.turnover(_weights(s, d, "equal"), ["model_id"], "event_date"))


def a13(s: SparkSession, d: str) -> DataFrame:
    return _round(B.event_backtest(_rows(s, d), ["model_id"], 10.0, 5))


def w9(s: SparkSession, d: str) -> DataFrame:
    t = B.trades(_weights(s, d, "equal"), ["model_id"], "event_date")
    return _round(t.groupBy("model_id", "ticker").agg(F.count("*").alias("n"), F.sum("trade_weight").alias("net_traded"), F.sum(F.abs("trade_weight")).alias("traded")))


def _drift(s: SparkSession, d: str) -> DataFrame:
    w = _weights(s, d, "equal").withColumn("turnover", F.lit(2.0))
    days = w.select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    ret = (F.pmod(F.col("ticker") * 7 + F.col("k") * 3, F.lit(11)) - 5) / 100.0
    return B.drift(days.withColumns({"date": F.date_add("event_date", F.col("k")), "ret": ret}), K, 0.001)


def w10(s: SparkSession, d: str) -> DataFrame:
    return _round(_drift(s, d))


def a11(s: SparkSession, d: str) -> DataFrame:
    daily = _drift(s, d).groupBy("model_id", "date").agg(F.round(F.avg("net_return"), 8).alias("net_return"))
    return _round(B.performance(daily, ["model_id"]).select("model_id", "n", "cumulative", "volatility", "sharpe", "hit_rate", "max_drawdown"), 5)


def a12(s: SparkSession, d: str) -> DataFrame:
    """Second level over splits: the concatenated series of a model."""
    daily = _drift(s, d).withColumn("model", F.split("model_id", "::")[0]).groupBy("model", "date").agg(F.round(F.avg("net_return"), 8).alias("net_return"))
    return _round(B.performance(daily, ["model"]).select("model", "n", "cumulative", "volatility", "sharpe", "hit_rate", "max_drawdown"), 5)


def _tests(s: SparkSession, d: str) -> DataFrame:
    ic = E.information_coefficients(scored(s, d), ["model_id", "role", "ticker"], cross_sections=True)
    family = F.concat_ws("|", F.split("model_id", "::")[0], "role")
    sid = I.spec_id({"model": F.col("model_id"), "role": F.col("role"), "ticker": F.col("ticker").cast("string")})
    return ic.select(family.alias("family"), sid.alias("spec_id"), F.round("rank_ic", 6).alias("rank_ic"), "n").withColumn("p", F.round(1 - F.abs("rank_ic"), 6))


def r31(s: SparkSession, d: str) -> DataFrame:
    return _round(I.adjust_p_values(_tests(s, d), ["family"]))


def f31(s: SparkSession, d: str) -> DataFrame:
    z = _tests(s, d).withColumn("z", fisher_z(F.col("rank_ic"), F.col("n")))
    return z.select("spec_id", F.round("z", 6).alias("z"), normal_two_sided_p("z").alias("p_value"))


def r32(s: SparkSession, d: str) -> DataFrame:
    """All-splits rank correlation of the test rows: split, event date and ticker clusters, plain and industry-neutral, 2,000 draws."""
    rows = scored(s, d).where("role = 'test'").withColumn("industry", E.industry_key("industry", "sector"))
    return _round(I.bootstrap_rank_ic(rows, ["model"], "split_id", {"split": "split_id", "event_date": "event_date", "ticker": "ticker"}))


_BASE = f"with {SCORED_SQL}, src as (select model_id, event_date, ticker, arg_max(y, doc_id) y, arg_max(yhat, doc_id) yhat, arg_max(sector, doc_id) sector, arg_max(cap, doc_id) cap from scored where role = 'test' group by 1, 2, 3), "
_PLAIN = _BASE + _LEGS.format(k="model_id, event_date", src="src")
_EQ = _PLAIN + ", w as (select model_id, event_date, ticker, leg * 1.0 / count(*) over (partition by model_id, event_date, leg) weight from legs where leg is not null)"
_DRIFT = _EQ + """, g as (select w.*, k, (((ticker * 7 + k * 3) % 11) - 5) / 100.0 ret from w cross join range(1, 6) r(k)),
cp as (select *, weight * coalesce(exp(sum(ln(1 + ret)) over (partition by model_id, event_date, ticker order by k rows between unbounded preceding and 1 preceding)), 1) v from g),
cr as (select model_id, event_date, k, sum(weight * ret) x from g group by 1, 2, 3),
val as (select model_id, event_date, k, sum(v * ret) dv, sum(v) net, sum(abs(v * (1 + ret))) gv from cp group by 1, 2, 3),
acc as (select *, 1 + coalesce(sum(dv) over (partition by model_id, event_date order by k rows between unbounded preceding and 1 preceding), 0) wealth from val),
dr as (select model_id, event_date, cast(event_date + cast(k as int) as date) date, dv / wealth gross_return, dv / wealth - case when k = 1 then 0.002 else 0 end net_return, gv / (wealth + dv) gross_exposure from acc)"""


def _perf(key: str) -> str:
    return f""", daily as (select {key}, date, round(avg(net_return), 8) r from dr group by 1, 2), cum as (select *, exp(sum(ln(1 + r)) over (partition by {key.split(" ")[-1]} order by date)) wv from daily), pk as (select *, greatest(1, max(wv) over (partition by {key.split(" ")[-1]} order by date)) peak from cum)
select {key.split(" ")[-1]}, count(*) n, round(product(1 + r) - 1, 5) + 0.0 cumulative, round(stddev_samp(r) * sqrt(252), 5) volatility, round(avg(r) / stddev_samp(r) * sqrt(252), 5) sharpe, round(avg(case when r > 0 then 1.0 else 0.0 end), 5) hit_rate, round(least(0, min(wv / peak - 1)), 5) + 0.0 max_drawdown from pk group by 1"""


_P = f"""{_RANKS_G.replace("partition by model_id, role", "partition by model_id, role, ticker")}, ic as (select model_id, role, ticker, round({_C.format("ry", "rp")}, 6) rank_ic, count(*) n from ranked group by 1, 2, 3),
t as (select split_part(model_id, '::', 1) || '|' || role family, substr(sha256('{{"model": "' || model_id || '", "role": "' || role || '", "ticker": "' || ticker || '"}}'), 1, 16) spec_id, rank_ic + 0.0 rank_ic, n, round(1 - abs(rank_ic), 6) p from ic),
o as (select *, count(*) over (partition by family) m, row_number() over (partition by family order by p, spec_id) i from t)"""
QUERIES = {
    "R25_equal_weights": r25("equal"), "R25_value_weights": r25("value"), "R25_risk_scaled_weights": r25("risk_scaled"), "R26_sector_neutral": r25("sector_neutral"), "R24_variants": r24, "A14_exposures": a14, "A15_U4_turnover": a15,
    "A13_event_backtest": a13, "W9_trades": w9, "W10_R27_drift": w10, "A11_W7_performance": a11, "A12_all_splits_performance": a12, "R31_W16_W17_adjusted_p": r31, "F31_F32_p_values": f31, "R32_bootstrap": r32,
}
ORACLES = {
    "R25_equal_weights": f"{_EQ} select model_id, event_date, ticker, round(weight, 6) weight from w",
    "R25_value_weights": f"{_PLAIN} select model_id, event_date, ticker, round(leg * case when min(coalesce(cap, 0)) over q > 0 then cap / sum(cap) over q else 1.0 / count(*) over q end, 6) weight from legs where leg is not null window q as (partition by model_id, event_date, leg)",
    "R25_risk_scaled_weights": f"{_PLAIN} select model_id, event_date, ticker, round(leg / greatest(abs(yhat), 1e-6) / sum(1 / greatest(abs(yhat), 1e-6)) over (partition by model_id, event_date, leg), 6) weight from legs where leg is not null",
    "R26_sector_neutral": f"{_BASE}{_LEGS.format(k='model_id, event_date, sector', src='src')}, z as (select * from legs where leg is not null), n as (select model_id, event_date, count(distinct sector) ns from z group by 1, 2) select model_id, event_date, ticker, round(leg * 1.0 / count(*) over (partition by model_id, event_date, sector, leg) / ns, 6) weight from z join n using (model_id, event_date)",
    "R24_variants": f"{_BASE} v as (select model_id, event_date, min(coalesce(cap, 0)) > 0 caps from src group by 1, 2) select model_id, event_date, unnest(case when caps then ['equal', 'risk_scaled', 'value', 'sector_neutral'] else ['equal', 'risk_scaled', 'sector_neutral'] end) variant from v",
    "A14_exposures": f"{_PLAIN}, w as (select model_id, event_date, leg / greatest(abs(yhat), 1e-6) / sum(1 / greatest(abs(yhat), 1e-6)) over (partition by model_id, event_date, leg) weight from legs where leg is not null) select model_id, event_date, round(sum(greatest(weight, 0)), 6) long, round(sum(least(weight, 0)), 6) short, round(sum(abs(weight)), 6) gross, round(sum(weight), 6) + 0.0 net from w group by 1, 2",
    "A15_U4_turnover": f"{_EQ}, n as (select *, lead(event_date) over (partition by model_id order by event_date) nx from (select distinct model_id, event_date from w)), p as (select w.model_id, nx event_date, ticker, weight from w join n using (model_id, event_date) where nx is not null) select model_id, event_date, round(sum(abs(coalesce(w.weight, 0) - coalesce(p.weight, 0))) / 2, 6) turnover from w full join p using (model_id, event_date, ticker) group by 1, 2",
    "W9_trades": f"{_EQ}, n as (select *, lead(event_date) over (partition by model_id order by event_date) nx from (select distinct model_id, event_date from w)), p as (select w.model_id, nx event_date, ticker, weight from w join n using (model_id, event_date) where nx is not null) select model_id, ticker, count(*) n, round(sum(coalesce(w.weight, 0) - coalesce(p.weight, 0)), 6) + 0.0 net_traded, round(sum(abs(coalesce(w.weight, 0) - coalesce(p.weight, 0))), 6) traded from w full join p using (model_id, event_date, ticker) group by 1, 2",
    "W10_R27_drift": f"{_DRIFT} select model_id, event_date, date, round(gross_return, 6) + 0.0 gross_return, round(net_return, 6) + 0.0 net_return, round(gross_exposure, 6) gross_exposure from dr",
    "A11_W7_performance": _DRIFT + _perf("model_id"),
    "A12_all_splits_performance": _DRIFT + _perf("split_part(model_id, '::', 1) model"),
    "R31_W16_W17_adjusted_p": f"with {_P} select family, spec_id, rank_ic, n, p, round(least(p * m, 1), 6) bonferroni, round(least(max((m - i + 1) * p) over (partition by family order by p, spec_id), 1), 6) holm, round(least(min(p * m / i) over (partition by family order by p desc, spec_id desc), 1), 6) benjamini_hochberg from o".replace("with with", "with"),
}

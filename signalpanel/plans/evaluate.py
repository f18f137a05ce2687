"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.operators import evaluation as E
from signalpanel.plans.base import SCORED_SQL, scored

G = ["model_id", "role"]


def _round(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, n) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def a1_groups(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).groupBy("model_id", "split_id", "role").agg(F.count("*").alias("n"))


def a2_errors(s: SparkSession, d: str) -> DataFrame:
    return _round(E.error_metrics(scored(s, d), G))


def a3_correlations(s: SparkSession, d: str) -> DataFrame:
    return _round(E.information_coefficients(scored(s, d), G))


def a4_ic_series(s: SparkSession, d: str) -> DataFrame:
    return _round(E.ic_series(scored(s, d), G))


def a5_a6_ic_statistics(s: SparkSession, d: str) -> DataFrame:
    return _round(E.ic_statistics(E.ic_series(scored(s, d), G), G, 5))


def a7_all_splits(s: SparkSession, d: str) -> DataFrame:
    k = ["model_id", "model", "role"]
    rows = scored(s, d)
    m = E.error_metrics(rows, k).join(E.information_coefficients(rows, k).drop("n"), k)
    out = E.pooled_metrics(m, ["model", "role"])
    return _round(out.withColumn("model_id", F.concat_ws("::", "model", F.lit("y"), F.lit("ALL_SPLITS"))))


def a8_neutral(s: SparkSession, d: str) -> DataFrame:
    rows = E.neutral_residuals(scored(s, d).withColumn("industry", E.industry_key("industry", "sector")), G, "industry")
    return _round(rows.select("model_id", "doc_id", "industry", "y", "yhat", "industry_n"), 9)


def r30_neutral_ic(s: SparkSession, d: str) -> DataFrame:
    rows = E.neutral_residuals(scored(s, d).withColumn("industry", E.industry_key("industry", "sector")), G, "industry")
    return _round(E.information_coefficients(rows, [*G, "event_date"], cross_sections=True).where("n >= 2"))


def w1_w2_w3_cross_section(s: SparkSession, d: str) -> DataFrame:
    r = E.ranked_cross_section(scored(s, d), [*G, "event_date"], "yhat")
    return r.select("model_id", "doc_id", "avg_rank", "n_rows", "quantile", "leg")


def r23_direction(s: SparkSession, d: str) -> DataFrame:
    return E.signal_direction(scored(s, d).where("role = 'validation'"), ["model"])


def a19_distribution(s: SparkSession, d: str) -> DataFrame:
    return _round(E.prediction_distribution(scored(s, d), G))


def o2_best(s: SparkSession, d: str) -> DataFrame:
    k = ["model_id", "role"]
    rows = scored(s, d)
    m = E.error_metrics(rows, k).join(E.information_coefficients(rows, k).drop("n"), k).where("role = 'test'")
    m = m.withColumns({"rank_ic": F.round("rank_ic", 8), "rmse": F.round("rmse", 8)})
    return m.orderBy(F.desc("rank_ic"), "rmse", "model_id").limit(3).select("model_id", F.round("rank_ic", 6).alias("rank_ic"), F.round("rmse", 6).alias("rmse"))


RANKS = """{base}, ranked as (select *, rank() over (partition by {k} order by y) + (count(*) over (partition by {k}, y) - 1) / 2.0 ry,
 rank() over (partition by {k} order by yhat) + (count(*) over (partition by {k}, yhat) - 1) / 2.0 rp from {src})"""
_C = "coalesce(case when stddev_pop({0}) * stddev_pop({1}) > 1e-12 then covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) end, 0.0)"
_IC = f"{_C.format('y', 'yhat')} ic, {_C.format('ry', 'rp')} rank_ic"
_ERR = "count(*) n, sqrt(avg((yhat - y) * (yhat - y))) rmse, avg(abs(yhat - y)) mae, 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) r2, avg(case when sign(y) = sign(yhat) then 1.0 else 0.0 end) directional_accuracy"
_T = "case when count({0}) > 1 and stddev_samp({0}) > 0 then avg({0}) / (stddev_samp({0}) / sqrt(count({0}))) else 0.0 end"
_SER = f"with {RANKS.format(base=SCORED_SQL, k='model_id, role, event_date', src='scored')}, ser as (select model_id, role, event_date, {_IC}, count(*) n from ranked group by 1, 2, 3 having count(*) >= 2)"
_R6 = "round({0}, 6) {0}"
_IND = "coalesce(nullif(industry, ''), nullif(sector, ''), '__MISSING_INDUSTRY__')"
_ZERO = "case when abs({0}) <= 2.220446049250313e-16 * 32 * greatest(max(abs({0})) over (partition by model_id, role), 1.0) then 0.0 else {0} end"
_MEAN = "{0} - cast(sum(cast({0} as decimal(38, 12))) over w as double) / count({0}) over w"
_RES = f"""less as (select *, {_IND} ind, {_MEAN.format("y")} ey, {_MEAN.format("yhat")} ep, count(*) over w industry_n from scored window w as (partition by model_id, role, {_IND})),
neutral as (select model_id, role, doc_id, event_date, ind industry, {_ZERO.format("ey")} ry0, {_ZERO.format("ep")} rp0, industry_n from less)"""
_LEGS = """legs0 as (select *, count(*) over w n_rows, row_number() over (w order by yhat) u, row_number() over (w order by yhat desc) dn, rank() over (w order by yhat) + (count(*) over (partition by {k}, yhat) - 1) / 2.0 avg_rank from {src} window w as (partition by {k})),
legs1 as (select *, max(case when u = greatest(1, floor(n_rows * 0.2)) then yhat end) over (partition by {k}) lo, max(case when dn = greatest(1, floor(n_rows * 0.2)) then yhat end) over (partition by {k}) hi from legs0),
legs as (select *, cast(least(greatest(floor((avg_rank - 0.5) / n_rows * 5) + 1, 1), 5) as int) quantile, case when lo < hi then case when yhat <= lo then -1 when yhat >= hi then 1 end end leg from legs1)"""
_RANKS_G = RANKS.format(base=SCORED_SQL, k="model_id, role", src="scored")

QUERIES = {
    "A1_groups": a1_groups, "A2_errors": a2_errors, "A3_correlations": a3_correlations, "A4_ic_series": a4_ic_series, "A5_A6_ic_statistics": a5_a6_ic_statistics, "A7_all_splits": a7_all_splits,
    "A8_neutral_residuals": a8_neutral, "R30_neutral_ic": r30_neutral_ic, "W1_W2_W3_cross_section": w1_w2_w3_cross_section, "R23_direction": r23_direction, "A19_distribution": a19_distribution, "O2_best": o2_best,
}
ORACLES = {
    "A1_groups": f"with {SCORED_SQL} select model_id, split_id, role, count(*) n from scored group by 1, 2, 3",
    "A2_errors": f"with {SCORED_SQL} select model_id, role, n, {', '.join(_R6.format(c) for c in ('rmse', 'mae', 'r2', 'directional_accuracy'))} from (select model_id, role, {_ERR} from scored group by 1, 2)",
    "A3_correlations": f"with {_RANKS_G} select model_id, role, round({_C.format('y', 'yhat')}, 6) ic, round({_C.format('ry', 'rp')}, 6) rank_ic, count(*) n from ranked group by 1, 2",
    "A4_ic_series": f"{_SER} select model_id, role, event_date, round(ic, 6) + 0.0 ic, round(rank_ic, 6) + 0.0 rank_ic, n from ser",
    "A5_A6_ic_statistics": f"""{_SER}, dev as (select *, rank_ic - avg(rank_ic) over (partition by model_id, role) e, row_number() over (partition by model_id, role order by event_date) i from ser),
      cov as (select a.model_id, a.role, l.l, sum(a.e * b.e) c from dev a join range(0, 6) l(l) on true join dev b on a.model_id = b.model_id and a.role = b.role and b.i = a.i - l.l group by 1, 2, 3),
      base as (select model_id, role, count(*) n_dates, avg(rank_ic) m, {_T.format("rank_ic")} t from ser group by 1, 2),
      var as (select model_id, role, sum(case when l = 0 then c / n_dates else 2 * greatest(1 - l / (least(5, n_dates - 1) + 1.0), 0) * c / n_dates end) v from cov join base using (model_id, role) group by 1, 2)
      select model_id, role, n_dates, round(m, 6) mean_rank_ic, round(t, 6) t_stat, round(m / sqrt(greatest(v, 0) / n_dates), 6) newey_west_t from base join var using (model_id, role)""",
    "A7_all_splits": f"""with {_RANKS_G}, m as (select model_id, model, role, {_ERR}, {_C.format("ry", "rp")} rank_ic from ranked group by 1, 2, 3)
      select model, role, count(*) n_splits, cast(sum(n) as bigint) n, round(sqrt(sum(rmse * rmse * n) / sum(n)), 6) rmse, round(sum(mae * n) / sum(n), 6) mae, round(sum(r2 * n) / sum(n), 6) r2, round(sum(directional_accuracy * n) / sum(n), 6) directional_accuracy,
      round(avg(rank_ic), 6) rank_ic, round({_T.format("rank_ic")}, 6) rank_ic_t, model || '::y::ALL_SPLITS' model_id from m group by model, role""",
    "A8_neutral_residuals": f"with {SCORED_SQL}, {_RES} select model_id, doc_id, industry, round(ry0, 9) + 0.0 y, round(rp0, 9) + 0.0 yhat, industry_n from neutral",
    "R30_neutral_ic": f"with {SCORED_SQL}, {_RES}, src as (select *, ry0 y, rp0 yhat from neutral), {RANKS.format(base='one as (select 1)', k='model_id, role, event_date', src='src')} select model_id, role, event_date, round({_C.format('y', 'yhat')}, 6) + 0.0 ic, round({_C.format('ry', 'rp')}, 6) + 0.0 rank_ic, count(*) n from ranked group by 1, 2, 3 having count(*) >= 2",
    "W1_W2_W3_cross_section": f"with {SCORED_SQL}, {_LEGS.format(k='model_id, role, event_date', src='scored')} select model_id, doc_id, avg_rank, n_rows, quantile, leg from legs",
    "R23_direction": f"with {SCORED_SQL}, src as (select * from scored where role = 'validation'), {_LEGS.format(k='model', src='src')} select model, case when coalesce(avg(y) filter (where leg = 1) - avg(y) filter (where leg = -1), 0) >= 0 then 1 else -1 end direction from legs group by 1",
    "A19_distribution": f"with {SCORED_SQL}, b as (select model_id, role, min(yhat) lowest, max(yhat) highest, round(quantile_cont(yhat, 0.01), 6) p01, round(quantile_cont(yhat, 0.99), 6) p99, round(greatest(abs(min(yhat)), abs(max(yhat))) / max(abs(y)), 6) scale_ratio, count(*) filter (where abs(yhat) > 100 * abs(y)) n_outliers from scored group by 1, 2) select *, case when scale_ratio >= 1000 then 'fail' when scale_ratio >= 100 then 'warn' else 'pass' end guard from b",
    "O2_best": f"with {_RANKS_G} select model_id, round(rank_ic, 6) rank_ic, round(rmse, 6) rmse from (select model_id, round({_C.format('ry', 'rp')}, 8) rank_ic, round(sqrt(avg((yhat - y) * (yhat - y))), 8) rmse from ranked where role = 'test' group by 1) order by rank_ic desc, rmse, model_id limit 3",
}

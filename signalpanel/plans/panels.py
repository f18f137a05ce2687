"""Queries of price panels, labels, splits and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalpanel.operators import panel as P
from signalpanel.plans.base import EVENTS_SQL, PANEL_SQL, events, meta, panel
from signalpanel.plans.evaluate import _round
from signalpanel.session import table


def _returns(s: SparkSession, d: str) -> DataFrame:
    return P.base_returns(panel(s, d))


def r1_panel(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    raw = li.groupBy(F.concat(F.lit(" s"), F.col("l_suppkey").cast("string")).alias("ticker"), F.col("l_shipdate").alias("date")).agg(F.max("l_extendedprice").cast("string").alias("close"))
    return _round(P.build_panel(raw, "close"))


def a30_duplicates(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    return P.duplicate_keys(P.build_panel(li.select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").alias("date"), "l_extendedprice"), "l_extendedprice"))


def w4_returns(s: SparkSession, d: str) -> DataFrame:
    return _round(_returns(s, d), 8)


def r3_delisting(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d)
    day, tick = F.dayofmonth("date"), F.col("ticker")
    p = p.withColumns({"dlret": F.when((day == 13) & (tick % 2 == 0), F.lit("-0.5")), "dlstcd": F.when(day == 13, F.lit("500"))})
    return _round(P.delisting_returns(P.base_returns(p)).select("ticker", "date", "simple_return", "delisting_flag", "delisting_code_used"), 8)


def j6_forward(s: SparkSession, d: str) -> DataFrame:
    return _round(P.forward_windows(events(s, d), _returns(s, d), ["doc_id"], 1, 20))


def _bench(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d)
    index = p.groupBy("date").agg(F.round(F.avg("price") + 1e-8, 6).alias("price")).select(F.lit(-1).cast("bigint").alias("ticker"), "date", "price")
    return P.base_returns(p.unionByName(index))


def r5_labels(s: SparkSession, d: str) -> DataFrame:
    out = P.build_labels(events(s, d), _bench(s, d), -1, 1, 20, ["CAR", "realized_volatility"], ["doc_id"])
    return _round(out.select("doc_id", F.concat("kind", F.lit("_1_20")).alias("target"), "window_start", "window_end", "label_value", "failure"))


def r9_splits(s: SparkSession, d: str) -> DataFrame:
    labels = P.forward_windows(events(s, d), _returns(s, d), ["doc_id"], 1, 20).where("n_rows = 20")
    return P.assign_splits(labels, P.expanding_windows(s, 1995, 2001, 3, 1, 1), 20).select("doc_id", "split_id", "role", "status")


def f8_targets(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "customer").select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("CAR_", "realized_volatility_", "beta_")]), (F.col("c_custkey") % 3 + 1).cast("int")), (F.col("c_custkey") % 4).cast("string"), F.lit("_"), (F.col("c_custkey") % 7).cast("string")).alias("t")).distinct()
    return names.select("t", *[c.alias(n) for n, c in P.parse_target(F.col("t")).items()])


def j7_expiring(s: SparkSession, d: str) -> DataFrame:
    """Latest signal per ticker with age of at most 370 days at each month's last price date."""
    signals = events(s, d).select("ticker", "event_date", "yhat", "doc_id")
    return P.expiring_signals(signals, "ticker", "event_date", "doc_id", P.month_ends(panel(s, d))).select("ticker", "rebalance", "yhat", "doc_id")


def j7_asof(s: SparkSession, d: str) -> DataFrame:
    """Last price at or before each event, at most 30 days old."""
    return P.asof_backward(events(s, d).select("ticker", "event_date", "doc_id"), panel(s, d), "ticker", "event_date", "date", ["date", "price"], 30)


def j8_fallback(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d).withColumn("at", F.make_date(F.lit(1998), F.lit(1), (F.col("ticker") % 28 + 1).cast("int")))
    return p.groupBy("ticker").agg(P.asof_with_fallback(p, ["ticker"], "date", F.col("at"), "price").alias("price"))


def j15_next(s: SparkSession, d: str) -> DataFrame:
    days = panel(s, d).select("date").distinct().withColumn("month", F.trunc("date", "month"))
    nxt = days.withColumn("next_date", F.coalesce(F.lead("date").over(Window.orderBy("date")), F.col("date")))  # one row per calendar day
    return nxt.groupBy("month").agg(F.max("date").alias("rebalance"), F.max_by("next_date", "date").alias("next_date")).select("rebalance", "next_date")


def j18_missing_days(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d)
    days = p.groupBy("date").agg(F.countDistinct("ticker").alias("k")).where("k >= 3").select("date")
    missing = meta(s, d).select("ticker").join(F.broadcast(days), how="cross").join(p.select("ticker", "date"), ["ticker", "date"], "left_anti")
    return missing.groupBy("ticker").agg(F.count("*").alias("n_missing"), F.min("date").alias("first_missing"))


def w10_mean_by_month(s: SparkSession, d: str) -> DataFrame:
    m = _returns(s, d).groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.count("simple_return").alias("n"), F.sum(F.log1p("simple_return")).alias("log_total"))
    return _round(m)


_RET = f"{PANEL_SQL}, ret as (select *, price / lag(price) over w - 1 simple_return, ln(price / lag(price) over w) log_return, row_number() over w pos from panel window w as (partition by ticker order by date))"
_FWD = f"""{_RET}, {EVENTS_SQL}, first as (select e.doc_id, e.ticker, e.event_date, coalesce(min(r.pos), (select max(pos) + 1 from ret q where q.ticker = e.ticker)) p from events0 e left join ret r on r.ticker = e.ticker and r.date > e.event_date group by 1, 2, 3),
fwd as (select f.ticker, f.event_date, f.doc_id, count(r.pos) n_rows, count(r.log_return) n_returns, min(r.date) window_start, max(r.date) window_end, sum(r.log_return) total, stddev_samp(r.log_return) volatility
 from first f left join ret r on r.ticker = f.ticker and r.pos between f.p and f.p + 19 group by 1, 2, 3)"""
_IDX = f"""{_FWD}, ix as (select date, round(avg(price) + 1e-8, 6) price from panel group by 1), ixr as (select *, ln(price / lag(price) over (order by date)) r, row_number() over (order by date) pos from ix),
bf as (select d.event_date, min(i.pos) p from (select distinct event_date from events0) d join ixr i on i.date > d.event_date group by 1), b as (select event_date, count(*) bn, sum(r) bt from bf join ixr on pos between p and p + 19 group by 1)"""

QUERIES = {
    "R1_build_panel": r1_panel, "A30_duplicate_keys": a30_duplicates, "W4_R2_returns": w4_returns, "R3_delisting": r3_delisting, "J6_R4_W5_forward_windows": j6_forward, "R5_labels": r5_labels, "R9_J5_R8_splits": r9_splits,
    "F8_parse_target": f8_targets, "J7_asof_expiring": j7_expiring, "J7_asof_price": j7_asof, "J8_asof_fallback": j8_fallback, "J15_W6_W8_next_date": j15_next, "J18_U6_missing_days": j18_missing_days, "W4_monthly_returns": w10_mean_by_month,
}
ORACLES = {
    "R1_build_panel": "select 'S' || l_suppkey ticker, cast(l_shipdate as date) date, round(max(l_extendedprice), 6) price from lineitem group by 1, 2",
    "A30_duplicate_keys": "select cast(l_suppkey as varchar) ticker, cast(l_shipdate as date) date, count(*) n from lineitem group by 1, 2 having count(*) > 1",
    "W4_R2_returns": f"with {_RET} select ticker, date, round(price, 8) price, round(simple_return, 8) + 0.0 simple_return, round(log_return, 8) + 0.0 log_return from ret",
    "R3_delisting": f"with {_RET}, x as (select ticker, date, simple_return r, case when day(date) = 13 and ticker % 2 = 0 then -0.5 end dl, case when day(date) = 13 then '500' end code from ret) select ticker, date, round(case when dl is null then r when r is null then dl else (1 + r) * (1 + dl) - 1 end, 8) + 0.0 simple_return, case when dl is not null then 'applied' when code is not null then 'missing' end delisting_flag, code delisting_code_used from x",
    "J6_R4_W5_forward_windows": f"with {_FWD} select ticker, event_date, doc_id, n_rows, n_returns, window_start, window_end, round(total, 6) + 0.0 total, round(volatility, 6) volatility from fwd",
    "R5_labels": f"""with {_IDX} select doc_id, 'CAR_1_20' target, window_start, window_end, case when n_rows = 20 and n_returns = 20 and bn = 20 then round(total - bt, 6) + 0.0 end label_value,
      case when n_rows < 20 then 'insufficient_window' when n_returns < 20 then 'missing_return' when coalesce(bn, 0) < 20 then 'insufficient_benchmark' end failure from fwd left join b using (event_date)
      union all select doc_id, 'realized_volatility_1_20', window_start, window_end, case when n_rows = 20 and n_returns >= 2 then round(volatility, 6) end, case when n_rows < 20 then 'insufficient_window' when n_returns < 2 then 'missing_return' end from fwd""",
    "R9_J5_R8_splits": f"""with {_FWD}, w as (select y, make_date(1995, 1, 1) t0, make_date(y - 2, 12, 31) t1, make_date(y - 1, 1, 1) v0, make_date(y - 1, 12, 31) v1, make_date(y, 1, 1) s0, make_date(y, 12, 31) s1 from range(1999, 2002) r(y)),
      x as (select *, case when event_date between t0 and t1 then 'train' when event_date between v0 and v1 then 'validation' when event_date between s0 and s1 then 'test' end role from fwd cross join w where n_rows = 20)
      select doc_id, 'test_' || y split_id, role, case when window_start <= event_date then 'fail' when (role = 'train' and window_end >= v0 - 20) or (role = 'validation' and window_end >= s0 - 20) then 'purged' else 'pass' end status from x where role is not null""",
    "F8_parse_target": "with n as (select distinct ['CAR_', 'realized_volatility_', 'beta_'][c_custkey % 3 + 1] || c_custkey % 4 || '_' || c_custkey % 7 t, c_custkey % 3 k, cast(c_custkey % 4 as int) a, cast(c_custkey % 7 as int) b from customer), o as (select *, k < 2 and a >= 1 and b >= a ok from n) select t, case when ok then ['CAR', 'realized_volatility'][k + 1] end kind, case when ok then a end \"start\", case when ok then b end \"end\" from o",
    "J7_asof_expiring": f"with {PANEL_SQL}, {EVENTS_SQL}, reb as (select max(date) rebalance from panel group by year(date), month(date)) select s_suppkey ticker, rebalance, arg_max(yhat, (event_date, doc_id)) yhat, arg_max(doc_id, (event_date, doc_id)) doc_id from supplier cross join reb join events0 e on e.ticker = s_suppkey and e.event_date <= rebalance and rebalance - e.event_date <= 370 group by 1, 2",
    "J7_asof_price": f"with {PANEL_SQL}, {EVENTS_SQL} select e.ticker, event_date, doc_id, case when event_date - p.date <= 30 then p.date end date, case when event_date - p.date <= 30 then price end price from events0 e asof left join panel p on p.ticker = e.ticker and p.date <= e.event_date",
    "J8_asof_fallback": f"with {PANEL_SQL}, p as (select *, make_date(1998, 1, cast(ticker % 28 + 1 as int)) at_day from panel) select ticker, coalesce(arg_max(price, date) filter (where date <= at_day), arg_min(price, date)) price from p group by 1",
    "J15_W6_W8_next_date": f"with {PANEL_SQL}, days as (select distinct date from panel), n as (select date, coalesce(lead(date) over (order by date), date) next_date from days) select max(date) rebalance, arg_max(next_date, date) next_date from n group by date_trunc('month', date)",
    "J18_U6_missing_days": f"with {PANEL_SQL}, days as (select date from panel group by 1 having count(distinct ticker) >= 3), m as (select s_suppkey ticker, date from supplier cross join days except select ticker, date from panel) select ticker, count(*) n_missing, min(date) first_missing from m group by 1",
    "W4_monthly_returns": f"with {_RET} select ticker, cast(date_trunc('month', date) as date) \"month\", count(simple_return) n, round(sum(log_return), 6) + 0.0 log_total from ret group by 1, 2",
}

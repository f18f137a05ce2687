"""Long-short portfolios: leg weights, turnover, daily drift and performance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalpanel.functions.stats import max_drawdown, newey_west_t
from signalpanel.operators.evaluation import ranked_cross_section

VARIANTS = ("equal", "value", "risk_scaled", "sector_neutral")
RISK_FLOOR = 1e-6


def _leg_share(variant: str, keys: list[str]) -> Column:
    """Share of a row in its leg. Value weights fall back to equal ones for a whole leg if any of its caps is missing or not positive."""
    w = Window.partitionBy(*keys, "leg")
    equal = 1.0 / F.count("*").over(w)
    if variant == "value":
        whole = F.min(F.coalesce((F.col("cap") > 0).cast("int"), F.lit(0))).over(w) == 1
        return F.when(whole, F.col("cap") / F.sum("cap").over(w)).otherwise(equal)
    if variant == "risk_scaled":
        inv = 1.0 / F.greatest(F.abs(F.col("yhat")), F.lit(RISK_FLOOR))
        return inv / F.sum(inv).over(w)
    return equal


def leg_weights(rows: DataFrame, keys: list[str], variant: str) -> DataFrame:
    """Rows in a leg with weight: +1.0 shared by the long leg and -1.0 by the short one (gross 2.0).

    sector_neutral forms legs in each sector (at least two rows and distinct boundaries) and divides by the number of sectors that have any.
    """
    if variant == "sector_neutral":
        legs = ranked_cross_section(rows, [*keys, "sector"], "yhat").where("leg is not null")
        n = legs.groupBy(*keys).agg(F.countDistinct("sector").alias("_n"))
        return legs.withColumn("_s", _leg_share("equal", [*keys, "sector"])).join(n, keys).withColumn("weight", F.col("leg") * F.col("_s") / F.col("_n")).drop("_s", "_n")
    legs = ranked_cross_section(rows, keys, "yhat").where("leg is not null")
    return legs.withColumn("weight", F.col("leg") * _leg_share(variant, keys))


def variants_available(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, variant: value weights need every cap, sector-neutral ones every sector; the others are always there."""
    each = rows.groupBy(*keys).agg(F.min(F.coalesce((F.col("cap") > 0).cast("int"), F.lit(0))).alias("caps"), F.min((F.coalesce("sector", F.lit("")) != "").cast("int")).alias("sectors"))
    names = F.array(F.lit("equal"), F.lit("risk_scaled"), F.when(F.col("caps") == 1, "value"), F.when(F.col("sectors") == 1, "sector_neutral"))
    return each.select(*keys, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("variant"))


def exposures(weights: DataFrame, keys: list[str]) -> DataFrame:
    w = F.col("weight")
    return weights.groupBy(*keys).agg(F.sum(F.when(w > 0, w).otherwise(0.0)).alias("long"), F.sum(F.when(w < 0, w).otherwise(0.0)).alias("short"), F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"))


def trades(weights: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Every ticker held now or at the rebalance before: weight, previous_weight, trade_weight (0 where not held).

    Each position is carried to the next rebalance of its series and met with the one held there: a sum by (date, ticker), so a ticker absent
    before has a previous weight of 0.
    """
    dates = weights.select(*keys, date).distinct()
    nxt = dates.withColumn("_next", F.lead(date).over(Window.partitionBy(*keys).orderBy(date)))
    now = weights.select(*keys, date, "ticker", F.col("weight"), F.lit(0.0).alias("previous_weight"))
    old = weights.join(nxt, [*keys, date]).where("_next is not null").select(*keys, F.col("_next").alias(date), "ticker", F.lit(0.0).alias("weight"), F.col("weight").alias("previous_weight"))
    out = now.unionByName(old).groupBy(*keys, date, "ticker").agg(F.sum("weight").alias("weight"), F.sum("previous_weight").alias("previous_weight"))
    return out.withColumn("trade_weight", F.col("weight") - F.col("previous_weight"))


def turnover(weights: DataFrame, keys: list[str], date: str) -> DataFrame:
    return trades(weights, keys, date).groupBy(*keys, date).agg((F.sum(F.abs("trade_weight")) / 2).alias("turnover"))


def event_backtest(rows: DataFrame, keys: list[str], cost_bps: float, lag: int) -> DataFrame:
    """By group over event dates with both legs: gross and net mean spread, turnover 2.0, annualised Sharpe and Newey-West t of net spreads."""
    legs = ranked_cross_section(rows, [*keys, "event_date"], "yhat").where("leg is not null")
    by_date = legs.groupBy(*keys, "event_date").agg((F.avg(F.when(F.col("leg") == 1, F.col("y"))) - F.avg(F.when(F.col("leg") == -1, F.col("y")))).alias("spread")).where("spread is not null")
    net = by_date.withColumn("net", F.col("spread") - 2.0 * cost_bps / 10_000)
    series = F.transform(F.sort_array(F.collect_list(F.struct("event_date", "net"))), lambda x: x["net"])
    agg = net.groupBy(*keys).agg(F.count("*").alias("n_dates"), F.avg("spread").alias("gross"), F.avg("net").alias("net"), F.coalesce(F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"), series.alias("s"))
    return agg.withColumns({"turnover": F.lit(2.0), "newey_west_t": newey_west_t(F.col("s"), lag)}).drop("s")


def drift(positions: DataFrame, keys: list[str], cost: float = 0.0) -> DataFrame:
    """Daily returns of drifting holdings: keys, date, gross_return, net_return, gross_exposure (after the day).

    positions has keys, ticker, weight, date, ret and turnover: one row for each holding and day. A position without a return on a day is
    dropped for good, nothing is renormalised, a day without usable positions is skipped, weights don't drift through a total loss, and the
    cost of the turnover is charged on the first day. An ordered fold over days: a group is the holding period of one rebalance, and many
    groups are folded per Arrow batch.
    """
    out = ", ".join(f"{k} {positions.schema[k].dataType.simpleString()}" for k in keys) + ", date date, gross_return double, net_return double, gross_exposure double"
    held = F.sort_array(F.collect_list(F.struct("date", "ticker", "weight", "ret")))
    groups = positions.groupBy(*keys).agg(held.alias("h"), F.coalesce(F.max("turnover"), F.lit(0.0)).alias("turnover"))
    pick = lambda c: F.transform("h", lambda x: x[c]).alias(c)
    arrays = groups.select(*keys, "turnover", *[pick(c) for c in ("date", "ticker", "weight", "ret")])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g in batch.itertuples(index=False, name=None):
                key, (turn, dates, tickers, first, rets) = g[: len(keys)], g[len(keys) :]
                weight, charge, k = dict(zip(tickers, first)), cost * turn, 0
                while k < len(dates):
                    day, ret = dates[k], {}
                    while k < len(dates) and dates[k] == day:
                        if tickers[k] in weight and rets[k] is not None and rets[k] == rets[k]:
                            ret[tickers[k]] = rets[k]
                        k += 1
                    if not ret:
                        continue
                    total = sum(weight[t] * r for t, r in ret.items())
                    weight = {t: weight[t] * (1 + r) / (1 + total) if 1 + total > 0 else weight[t] for t, r in ret.items()}
                    rows.append((*key, day, total, total - charge, sum(map(abs, weight.values()))))
                    charge = 0.0
            yield pd.DataFrame(rows, columns=[*keys, "date", "gross_return", "net_return", "gross_exposure"])

    return arrays.mapInPandas(fold, out)


def performance(returns: DataFrame, keys: list[str], periods: int = 252) -> DataFrame:
    """Cumulative and annualised return, volatility, Sharpe, maximum drawdown, hit rate and Newey-West t (lag min(21, n - 1)) of daily net returns."""
    r = F.col("net_return")
    s = F.transform(F.sort_array(F.collect_list(F.struct("date", "net_return"))), lambda x: x["net_return"])
    agg = returns.where(r.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), (F.product(1 + r) - 1).alias("cumulative"), (F.coalesce(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))).alias("volatility"),
        F.coalesce(F.try_divide(F.avg(r), F.stddev_samp(r)), F.lit(0.0)).alias("_s"), F.avg((r > 0).cast("double")).alias("hit_rate"), s.alias("s"),
    )
    annual = F.when(F.col("cumulative") > -1, F.pow(1 + F.col("cumulative"), periods / F.col("n")) - 1).otherwise(-1.0)
    return agg.withColumns({"annualised": annual, "sharpe": F.col("_s") * F.sqrt(F.lit(float(periods))), "max_drawdown": max_drawdown(F.col("s")), "newey_west_t": newey_west_t(F.col("s"), 21)}).drop("s", "_s")

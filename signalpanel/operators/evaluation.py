"""Cross-sectional evaluation of predictions: errors, tie-aware rank correlation, neutral residuals, extremes and directions.

A scored row has group keys, event_date, ticker, y (target), yhat (prediction) and optional industry. Groups and dates are shuffle keys,
so each date's cross-section is ranked in one task; whole groups are ranked by counts of their values (:mod:`signalpanel.operators.ranks`), and
series per group hold one value for each date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalpanel.functions.stats import average_rank, correlation, mean_t, newey_west_t, quantile, r_squared
from signalpanel.operators.ranks import percentile, value_ranks, with_ranks

EPSILON = 2.220446049250313e-16


def error_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """n, rmse, mae, r2, directional_accuracy (a zero sign is a class of its own) by group."""
    e = F.col("yhat") - F.col("y")
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r_squared("y", "yhat").alias("r2"),
        F.avg((F.signum("y") == F.signum("yhat")).cast("double")).alias("directional_accuracy"),
    )


def information_coefficients(scored: DataFrame, keys: list[str], cross_sections: bool = False) -> DataFrame:
    """Pearson and rank correlation by group, over average ranks.

    cross_sections: the groups are those of one date, each small enough for a task, and are ranked by a window; other groups may be of any size.
    """
    if cross_sections:
        ranked = scored.withColumns({"ry": average_rank("y", keys), "rp": average_rank("yhat", keys)})
    else:
        ranked = with_ranks(scored, keys, {"y": "ry", "yhat": "rp"})
    return ranked.groupBy(*keys).agg(correlation("y", "yhat").alias("ic"), correlation("ry", "rp").alias("rank_ic"), F.count("*").alias("n"))


def ic_series(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Correlations by event date, for cross-sections of two rows at least; a group without any gets one pooled row of null date."""
    by_date = information_coefficients(scored, [*keys, "event_date"], cross_sections=True).where("n >= 2")
    # a group without a date of two rows has no more rows than days
    rest = scored.join(by_date.select(*keys).distinct(), keys, "left_anti")
    pooled = information_coefficients(rest, keys, cross_sections=True).withColumn("event_date", F.lit(None).cast("date"))
    return by_date.unionByName(pooled)


def ic_statistics(series: DataFrame, keys: list[str], lag: int) -> DataFrame:
    """Mean, plain t and Newey-West t of the rank correlations in the order of dates."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("event_date", "rank_ic"))), lambda x: x["rank_ic"])
    agg = series.groupBy(*keys).agg(F.count("*").alias("n_dates"), F.avg("rank_ic").alias("mean_rank_ic"), mean_t("rank_ic").alias("t_stat"), ordered.alias("s"))
    return agg.withColumn("newey_west_t", newey_west_t(F.col("s"), lag)).drop("s")


def pooled_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Second level over splits: errors weighted by observations (all alike if there are none), correlations unweighted, t over splits.

    Squared errors are averaged before the root, so the level isn't additive and a rollup would be wrong.
    """
    w = F.when(F.sum("n").over(Window.partitionBy(*keys)) > 0, F.col("n")).otherwise(F.lit(1)).cast("double")
    m = metrics.withColumn("_w", w)
    mean = lambda c: F.sum(c * F.col("_w")) / F.sum("_w")
    return m.groupBy(*keys).agg(
        F.count("*").alias("n_splits"), F.sum("n").alias("n"), F.sqrt(mean(F.pow("rmse", 2))).alias("rmse"), mean(F.col("mae")).alias("mae"), mean(F.col("r2")).alias("r2"),
        mean(F.col("directional_accuracy")).alias("directional_accuracy"), F.avg("rank_ic").alias("rank_ic"), mean_t("rank_ic").alias("rank_ic_t"),
    )


def industry_key(industry: str, sector: str) -> Column:
    """Industry, else sector, else a sentinel; empty texts fall through."""
    return F.coalesce(F.nullif(F.col(industry), F.lit("")), F.nullif(F.col(sector), F.lit("")), F.lit("__MISSING_INDUSTRY__"))


def neutral_residuals(scored: DataFrame, keys: list[str], industry: str) -> DataFrame:
    """y and yhat less their industry means within a group; residuals within rounding of zero are zero. Adds industry_n.

    Means are of exact sums of 12 decimals, so they don't depend on the order of rows. Rounding is measured by the group's largest residual.
    """
    k = [*keys, industry]
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,12)")).cast("double")
    means = scored.groupBy(*k).agg(exact("y").alias("_sy"), exact("yhat").alias("_sp"), F.count("*").alias("industry_n"), F.count("y").alias("_ny"), F.count("yhat").alias("_np"))
    out = scored.join(means, k).withColumns({"y": F.col("y") - F.col("_sy") / F.col("_ny"), "yhat": F.col("yhat") - F.col("_sp") / F.col("_np")}).select(*scored.columns, "industry_n")
    largest = lambda c: F.greatest(F.max(F.abs(F.col(c))), F.lit(1.0)).alias(f"_{c}")
    scale = out.groupBy(*keys).agg(largest("y"), largest("yhat"))
    clean = lambda c: F.when(F.abs(F.col(c)) <= EPSILON * F.col(f"_{c}") * 32, F.lit(0.0)).otherwise(F.col(c))
    return out.join(scale, keys).withColumns({"y": clean("y"), "yhat": clean("yhat")}).drop("_y", "_yhat")


def ranked_cross_section(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds avg_rank (1-based), n_rows, quantile and leg: -1 and 1 for the boundary-inclusive low and high fifth, null between.

    A leg has max(1, n // 5) rows by order and all that tie with its boundary; where the low boundary isn't below the high one there is no leg.
    """
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(value)
    r = rows.withColumns({"avg_rank": average_rank(value, keys), "n_rows": F.count("*").over(w), "_up": F.row_number().over(ordered), "_down": F.row_number().over(w.orderBy(F.col(value).desc()))})
    leg = F.greatest(F.lit(1), F.floor(F.col("n_rows") * 0.2))
    r = r.withColumns({"_lo": F.max(F.when(F.col("_up") == leg, F.col(value))).over(w), "_hi": F.max(F.when(F.col("_down") == leg, F.col(value))).over(w)})
    side = F.when(F.col("_lo") < F.col("_hi"), F.when(F.col(value) <= F.col("_lo"), -1).when(F.col(value) >= F.col("_hi"), 1))
    return r.withColumns({"quantile": quantile(F.col("avg_rank"), F.col("n_rows")), "leg": side}).drop("_up", "_down", "_lo", "_hi")


def signal_direction(validation: DataFrame, keys: list[str], requested: Column | None = None, volatility: Column | None = None) -> DataFrame:
    """direction by group: 1 if the high leg's mean target is at least the low leg's on validation rows, else -1; 1 without legs.

    Legs are those of :func:`ranked_cross_section`, over whole groups of any size. requested (an aggregate or literal), where it is 1 or -1, goes
    before that, and volatility, where it is true, gives -1 before both.
    """
    r = value_ranks(validation, keys, ["yhat"])
    leg = F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))
    low, high = F.col("below") < leg, F.col("n") - F.col("below") - F.col("ties") < leg
    bounds = r.groupBy(*keys).agg(F.max(F.when(low, F.col("value"))).alias("_lo"), F.min(F.when(high, F.col("value"))).alias("_hi"))
    m = validation.join(bounds, keys)
    has = F.col("_lo") < F.col("_hi")
    spread = F.avg(F.when(has & (F.col("yhat") >= F.col("_hi")), F.col("y"))) - F.avg(F.when(has & (F.col("yhat") <= F.col("_lo")), F.col("y")))
    chosen = F.when(F.coalesce(spread, F.lit(0.0)) >= 0, 1).otherwise(-1)
    if requested is not None:
        chosen = F.when(requested.isin(1, -1), requested).otherwise(chosen)
    if volatility is not None:
        chosen = F.when(volatility, -1).otherwise(chosen)
    return m.groupBy(*keys).agg(chosen.alias("direction"))


def prediction_distribution(scored: DataFrame, keys: list[str], ratio_limit: float = 100.0) -> DataFrame:
    """Range, 1st and 99th percentile (linear interpolation) of predictions, their scale against the targets' and outliers by group."""
    span = F.greatest(F.abs(F.min("yhat")), F.abs(F.max("yhat")))
    base = scored.groupBy(*keys).agg(
        F.min("yhat").alias("lowest"), F.max("yhat").alias("highest"),
        F.coalesce(F.try_divide(span, F.max(F.abs(F.col("y")))), F.lit(0.0)).alias("scale_ratio"), F.sum((F.abs("yhat") > ratio_limit * F.abs("y")).cast("long")).alias("n_outliers"),
    )
    base = base.join(value_ranks(scored, keys, ["yhat"]).groupBy(*keys).agg(percentile(0.01).alias("p01"), percentile(0.99).alias("p99")), keys)
    return base.withColumn("guard", F.when(F.col("scale_ratio") >= 1000, "fail").when(F.col("scale_ratio") >= 100, "warn").otherwise("pass"))

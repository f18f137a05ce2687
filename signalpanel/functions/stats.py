"""Statistics as Column builders with defined results for ties, constants and small groups. Nothing here divides by zero or returns NaN."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _w(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def average_rank(value: str, keys: list[str], zero_based: bool = False) -> Column:
    """Average rank of ties within keys: min-rank plus half of the other tied rows."""
    low = F.rank().over(_w(keys).orderBy(value))
    ties = F.count("*").over(_w([*keys, value]))
    return (low + (ties - 1) / 2 - (1 if zero_based else 0)).cast("double")


def quantile(rank: Column, n: Column, buckets: int = 5) -> Column:
    """Tie-aware bucket 1..buckets of a 1-based average rank."""
    return F.least(F.greatest(F.floor((rank - 0.5) / n * buckets) + 1, F.lit(1)), F.lit(buckets)).cast("int")


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation, 0.0 for fewer than two rows or a constant side."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def mean_t(x: Column | str) -> Column:
    """Aggregate: mean over its standard error, 0.0 for fewer than two rows or no spread."""
    return F.coalesce(F.try_divide(F.avg(x), F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x)))), F.lit(0.0))


def newey_west_t(ordered: Column, lag: int | Column) -> Column:
    """t statistic of the mean of an ordered array of doubles with Bartlett-weighted autocovariances up to min(lag, n - 1).

    The variance is clamped at zero; 0.0 for fewer than two values or zero variance.
    """
    n = F.size(ordered)
    mean = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x) / n
    dev = F.transform(ordered, lambda x: x - mean)
    depth = F.least(F.lit(lag) if isinstance(lag, int) else lag, n - 1)

    def autocov(k: Column) -> Column:
        pairs = F.zip_with(F.slice(dev, k + 1, n - k), F.slice(dev, F.lit(1), n - k), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / n

    lags = F.when(depth >= 1, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    var = autocov(F.lit(0)) + F.aggregate(lags, F.lit(0.0), lambda a, k: a + 2.0 * (1.0 - k / (depth + 1.0)) * autocov(k))
    return F.when(n >= 2, F.coalesce(F.try_divide(mean, F.sqrt(F.greatest(var, F.lit(0.0)) / n)), F.lit(0.0))).otherwise(F.lit(0.0))


def r_squared(y: str, yhat: str) -> Column:
    """Aggregate: 1 - RSS / TSS, 0.0 for fewer than two rows or a constant target."""
    return F.coalesce(1 - F.try_divide(F.sum(F.pow(F.col(y) - F.col(yhat), 2)), F.var_pop(y) * F.count(y)), F.lit(0.0))


def fisher_z(rho: Column, n: Column) -> Column:
    """z score of a correlation, its magnitude clamped below one; null where the p-value is fixed (n < 4)."""
    r = F.greatest(F.least(rho, F.lit(0.999999)), F.lit(-0.999999))
    return F.when(n >= 4, F.atanh(r) * F.sqrt(n - 3))


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    """erfc(|z| / sqrt 2), clamped to [0, 1]; null for null. Spark has no erfc, so the few statistics go through Arrow."""
    return pd.Series([None if v is None or math.isnan(v) else min(1.0, max(0.0, math.erfc(abs(v) / math.sqrt(2)))) for v in z], dtype="float64")


def max_drawdown(returns: Column) -> Column:
    """Smallest wealth over its running peak, less one, of an ordered array of returns; 0.0 when empty."""
    state = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(a: Column, r: Column) -> Column:
        w = a["w"] * (1.0 + r)
        peak = F.greatest(a["peak"], w)
        return F.struct(w.alias("w"), peak.alias("peak"), F.least(a["dd"], w / peak - 1.0).alias("dd"))

    return F.aggregate(returns, state, step, lambda a: a["dd"])

"""Ranks within groups of any size: values are counted first, and no group has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalpanel.session import cut


def value_ranks(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, column, value DOUBLE, below, ties, n: for each distinct value of each of the columns the group's rows below it, those that have it, and all.

    Nulls lie below all values, NaN above; an empty table has no rows. Rows are counted by value before anything moves. The distinct values are
    laid out in order over all partitions and written once; ranks are running sums in a partition plus the totals of those before it.
    """
    k = [*keys, "column"]
    each = F.inline(F.array(*[F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("value")) for v in values]))
    counts = rows.select(*keys, each).groupBy(*k, "value").agg(F.count("*").alias("ties"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the layout depends on a sample, so it must not be computed twice
    laid = cut(counts.repartitionByRange(parts, *k, "value").withColumn("_part", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("ties").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = laid.groupBy(*k, "_part").agg(F.sum("ties").alias("ties"))
    totals = totals.select(*k, "_part", before(Window.partitionBy(*k).orderBy("_part")).alias("_before"), F.sum("ties").over(Window.partitionBy(*k)).alias("n"))
    own = laid.withColumn("below", before(Window.partitionBy(*k, "_part").orderBy("value")))
    totals = totals.withColumnsRenamed({c: f"_t{i}" for i, c in enumerate([*k, "_part"])})
    on = [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate([*k, "_part"])]  # keys may be null
    return own.join(totals, on).select(*k, "value", (F.col("below") + F.col("_before")).alias("below"), own["ties"], "n")


def with_ranks(rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """``rows`` with the average rank (from 1) of each of the columns within its group, by the name given for it."""
    ranks, out = value_ranks(rows, keys, list(values)), rows
    for v, name in values.items():
        r = ranks.where(F.col("column") == v).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("value").alias("_v"), average(F.col("below"), F.col("ties")).alias(name))
        on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)] + [F.col(v).cast("double").eqNullSafe(F.col("_v"))]
        out = out.join(r, on).drop("_v", *[f"_k{i}" for i in range(len(keys))])
    return out


def average(below: Column, ties: Column) -> Column:
    """Average rank (from 1) of tied rows."""
    return (below + (ties + 1) / 2).cast("double")


def percentile(share: float) -> Column:
    """Aggregate over :func:`value_ranks` of one column: the percentile with linear interpolation."""
    at = (F.col("n") - 1) * share
    low, high = F.floor(at), F.ceil(at)
    value = lambda i: F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("ties")), F.col("value")))
    return value(low) + (value(high) - value(low)) * F.max(at - low)

"""Multiple-testing adjustment within families, specification ids, and a cluster bootstrap of rank correlations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spec_id(fields: dict[str, Column]) -> Column:
    """First 16 hex digits of the SHA-256 of a key-sorted JSON object of texts, with ``", "`` and ``": "`` as separators."""
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": "'), fields[k], F.lit('"')) for k in sorted(fields)])
    return F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 16)


def adjust_p_values(tests: DataFrame, family: list[str], p: str = "p", tie: str = "spec_id", zero_is_one: bool = False) -> DataFrame:
    """Adds bonferroni, holm and benjamini_hochberg, capped at 1, within families. A null p counts as 1.

    A p of exactly 0 stays 0; ``zero_is_one`` reads it as 1. Families are of specifications, so a window per family is small.
    """
    value = F.coalesce(F.nullif(F.col(p), F.lit(0.0)) if zero_is_one else F.col(p), F.lit(1.0))
    w = Window.partitionBy(*family)
    up, down = w.orderBy("_p", tie), w.orderBy(F.desc("_p"), F.desc(tie))
    t = tests.withColumn("_p", value).withColumns({"_m": F.count("*").over(w), "_i": F.row_number().over(up)})
    head = lambda s: s.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.withColumns({
        "bonferroni": F.least(F.col("_p") * F.col("_m"), F.lit(1.0)),
        "holm": F.least(F.max((F.col("_m") - F.col("_i") + 1) * F.col("_p")).over(head(up)), F.lit(1.0)),
        "benjamini_hochberg": F.least(F.min(F.col("_p") * F.col("_m") / F.col("_i")).over(head(down)), F.lit(1.0)),
    }).drop("_p", "_m", "_i")


def weighted_rank_ic(y: np.ndarray, yhat: np.ndarray, times: np.ndarray) -> float:
    """Tie-aware rank correlation of rows that count ``times`` over (positive whole numbers); 0.0 for a constant side."""

    def centred(v: np.ndarray) -> np.ndarray:
        order = np.argsort(v)
        s, t = v[order], times[order]
        last = np.flatnonzero(np.append(s[1:] != s[:-1], True))
        upto = np.cumsum(t)[last]
        size = np.diff(upto, prepend=0)
        rank = np.empty(len(v))
        rank[order] = np.repeat(upto - (size - 1) / 2, np.diff(last, prepend=-1))
        return rank - (times.sum() + 1) / 2

    a, b = centred(y), centred(yhat)
    aa, bb = np.sum(times * a * a), np.sum(times * b * b)
    return float(np.sum(times * a * b) / np.sqrt(aa * bb)) if aa > 0 and bb > 0 else 0.0


def _neutral(v: np.ndarray, industry: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Values less their industry's mean over the sample; residuals within rounding of zero, by the largest residual, are zero."""
    n = np.bincount(industry, times)
    r = v - (np.bincount(industry, times * v) / np.where(n > 0, n, 1))[industry]
    r[np.abs(r) <= np.finfo(float).eps * 32 * max(np.abs(r).max(initial=0.0), 1.0)] = 0.0
    return r


def bootstrap_rank_ic(scored: DataFrame, keys: list[str], split: str, clusters: dict[str, str], draws: int = 2000, seed: int = 42, chunk: int = 125) -> DataFrame:
    """Cluster bootstrap of the all-splits rank correlation (mean over splits of two rows or more, else 0.0), plain and industry-neutral.

    keys, estimand, method, point, low, high (95 % percentiles), se, p (two-sided), n_clusters, draws. ``clusters`` names the cluster column of each
    method. A draw takes as many whole clusters as a group has, with replacement, and ranks the resampled rows of each split anew; picks come
    from numpy's generator with ``seed`` + 1009 x estimand + 101 x method over clusters sorted as text, for any partitioning.
    ``scored`` has y, yhat and ``industry`` (the key to neutralise by); rows without y or yhat are left out.

    A task holds the rows of a split of a group and a chunk of draws; a draw is a count for each row, so no resampled row is ever made.
    """
    k, methods = [*keys, split], list(clusters)
    rows = scored.select(*k, "industry", *dict.fromkeys(clusters.values()), F.col("y").cast("double").alias("y"), F.col("yhat").cast("double").alias("yhat")).where("y is not null and yhat is not null")
    for i, m in enumerate(methods):
        name = F.coalesce(F.col(clusters[m]).cast("string"), F.lit("None"))
        rows = rows.withColumn(f"_k{i}", name)
    base = rows
    for i in range(len(methods)):
        ids = base.select(*keys, f"_k{i}").distinct().withColumns({f"_c{i}": F.row_number().over(Window.partitionBy(*keys).orderBy(f"_k{i}")) - 1, f"_n{i}": F.count("*").over(Window.partitionBy(*keys))})
        rows = rows.join(ids, [*keys, f"_k{i}"])
    ids_n = [x for i in range(len(methods)) for x in (f"_c{i}", f"_n{i}")]
    n_chunks = -(-draws // chunk)
    many = rows.select(*k, "industry", "y", "yhat", *ids_n, F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("_chunk"))
    kinds = ", ".join(f"{c} {many.schema[c].dataType.simpleString()}" for c in k)

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "yhat", "industry", *ids_n], ignore_index=True)
        y, yhat = pdf["y"].to_numpy(), pdf["yhat"].to_numpy()
        industry = pd.factorize(pdf["industry"], use_na_sentinel=False)[0]
        first = int(pdf["_chunk"].iloc[0]) * chunk
        out = []
        for e, estimand in enumerate(("plain", "industry_neutral")):

            def statistic(times: np.ndarray) -> float | None:
                at = np.flatnonzero(times)
                if times.sum() < 2:
                    return None
                a, b, t = y[at], yhat[at], times[at]
                if e:  # noqa: B023
                    a, b = _neutral(a, industry[at], t), _neutral(b, industry[at], t)
                return weighted_rank_ic(a, b, t)

            whole = statistic(np.ones(len(y), dtype=np.int64)) if first == 0 else None
            for i, method in enumerate(methods):
                c, n = pdf[f"_c{i}"].to_numpy(), int(pdf[f"_n{i}"].iloc[0])
                if first == 0:
                    out.append((estimand, method, 0, n, whole))
                rng, seen = np.random.default_rng(seed + 1009 * e + 101 * i), {}
                single = c.min() == c.max()
                for d in range(min(first + chunk, draws)):
                    picks = rng.integers(0, n, size=n)
                    if d < first:
                        continue
                    times = np.bincount(picks, minlength=n)[c]
                    if not single:
                        ic = statistic(times)
                    elif (t := int(times[0])) in seen:  # the whole split is one cluster: few counts are possible
                        ic = seen[t]
                    else:
                        ic = seen[t] = statistic(times)
                    out.append((estimand, method, d + 1, n, ic))
        res = pd.DataFrame(out, columns=["estimand", "method", "draw", "n", "ic"]).astype({"ic": "float64"})
        for c in reversed(k):
            res.insert(0, c, pdf[c].iloc[0])
        return res

    each = many.repartition(8 * n_chunks, *k, "_chunk").groupBy(*k, "_chunk").applyInPandas(sample, f"{kinds}, estimand string, method string, draw int, n long, ic double")
    ic = F.when(~F.isnan("ic"), F.col("ic"))
    m = each.groupBy(*keys, "estimand", "method", "draw").agg(F.coalesce(F.avg(ic), F.lit(0.0)).alias("m"), F.max("n").alias("n"))
    drawn = F.when(F.col("draw") > 0, F.col("m"))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((drawn <= 0).cast("double")), F.avg((drawn >= 0).cast("double"))))
    return m.groupBy(*keys, "estimand", "method").agg(
        F.max(F.when(F.col("draw") == 0, F.col("m"))).alias("point"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"),
        F.coalesce(F.stddev_samp(drawn), F.lit(0.0)).alias("se"), p.alias("p"), F.max("n").alias("n_clusters"), F.count(drawn).alias("draws"),
    )

"""Tested specifications: their roles, families with adjusted p-values, and the registry of primary ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalpanel.operators.inference import adjust_p_values

#: Preferred targets and models, first the best, and the models of the feature ablation with their family.
TARGETS = ("realized_volatility_1_20", "CAR_1_20", "CAR_1_5")
MODELS = ("ridge", "xgboost")
ABLATION = {"ridge_dictionary_only": "dictionary", "ridge_tfidf_svd_only": "tfidf_svd", "ridge_industry_plus_text": "industry_plus_text"}
ALL, MONTHLY = "ALL_SPLITS", "monthly_common_rebalance"


def preference_rank(name: Column, preferred: tuple[str, ...]) -> Column:
    """Place in the list from 0; the list's length for a name that isn't in it, null included."""
    at = F.array_position(F.array(*[F.lit(p) for p in preferred]), name)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(preferred)).otherwise(at - 1).cast("int")


def specification_role(target: Column, split: Column, model: Column, method: Column, weighting: Column, sector_neutral: Column, metric: Column) -> Column:
    """primary, robustness or exploratory. Nulls in any field count as no match.

    Rank correlation over all splits: primary for the first target and model, robustness for allowed and ablation models. Its industry-neutral form: robustness over all
    splits for allowed and ablation models. Portfolio Sharpe: primary for the monthly method over all splits with the first target and model, equal weights and
    neutral sectors; robustness for the monthly method with allowed models. Newey-West t: robustness for allowed models. All else is exploratory.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    best = (preference_rank(target, TARGETS) == 0) & (preference_rank(model, MODELS) == 0)
    allowed, ablation = preference_rank(model, MODELS) < len(MODELS), yes(model.isin(*ABLATION))
    pooled, monthly = yes(split == ALL), yes(method.startswith(MONTHLY))
    some = lambda c: F.when(c, "robustness").otherwise("exploratory")
    return (
        F.when(metric == "rank_ic", F.when(pooled & best, "primary").otherwise(some(pooled & (allowed | ablation))))
        .when(metric == "industry_neutral_rank_ic", some(pooled & (allowed | ablation)))
        .when(metric == "portfolio_sharpe", F.when(monthly & pooled & best & yes(weighting == "equal_weight") & yes(sector_neutral), "primary").otherwise(some(monthly & allowed)))
        .when(metric == "newey_west_t_stat", some(allowed))
        .otherwise("exploratory")
    )


def specifications(metrics: DataFrame, backtests: DataFrame, portfolios: DataFrame) -> DataFrame:
    """One row for each tested specification, with family_id, spec_role, and z and p_method for its p-value.

    metrics (target, split, model, role, rank_ic, neutral_rank_ic, n) gives two rows for each test row, backtests (target, split, model, method, weighting,
    newey_west_t) and portfolios (target, split, model, method, weighting, sector_neutral, sharpe, newey_west_t, n) one each. z is null where p is 1 by rule.
    """
    from signalpanel.functions.stats import fisher_z

    none, no = F.lit("not_applicable"), F.lit(False)
    z = lambda c: fisher_z(F.col(c), F.col("n"))
    base = ["target", "split", "model"]
    m = metrics.where("role = 'test'")
    plain = m.select(*base, F.lit("prediction_metric").alias("method"), none.alias("weighting"), no.alias("sector_neutral"), F.lit("rank_ic").alias("metric"), F.col("rank_ic").alias("value"), z("rank_ic").alias("z"), F.lit("fisher_z_rank_ic").alias("p_method"))
    neutral = m.select(*base, F.lit("prediction_metric_industry_neutral").alias("method"), none.alias("weighting"), F.lit(True).alias("sector_neutral"), F.lit("industry_neutral_rank_ic").alias("metric"), F.col("neutral_rank_ic").alias("value"), z("neutral_rank_ic").alias("z"), F.lit("fisher_z_industry_neutral_rank_ic").alias("p_method"))
    events = backtests.select(*base, "method", "weighting", no.alias("sector_neutral"), F.lit("newey_west_t_stat").alias("metric"), F.col("newey_west_t").alias("value"), F.col("newey_west_t").alias("z"), F.lit("event_level_newey_west_t_stat").alias("p_method"))
    pooled = (F.col("split") == ALL) & F.col("method").startswith("monthly")
    by_sharpe = F.when(F.col("n") >= 2, F.col("sharpe") * F.sqrt(F.col("n") / 252.0))
    sharpe = portfolios.select(*base, "method", "weighting", "sector_neutral", F.lit("portfolio_sharpe").alias("metric"), F.col("sharpe").alias("value"), F.when(pooled, F.col("newey_west_t")).otherwise(by_sharpe).alias("z"), F.when(pooled, "newey_west_normal").otherwise("sharpe_normal").alias("p_method"))
    every = plain.unionByName(neutral).unionByName(events).unionByName(sharpe)
    role = specification_role(*[F.col(c) for c in ("target", "split", "model", "method", "weighting", "sector_neutral", "metric")])
    return every.withColumns({"family_id": F.concat_ws("::", "target", "metric"), "spec_role": role})


def family_report(specs: DataFrame, p: str = "p", spec_id: str = "spec_id") -> DataFrame:
    """By role and family: number of tests, best raw and adjusted specification with its p, discoveries at 5 and 10 percent after Benjamini-Hochberg.

    A null p counts as 1; ties for the best go to the smallest spec_id.
    """
    a = adjust_p_values(specs, ["spec_role", "family_id"], p, spec_id)
    best = lambda c: F.min(F.struct(F.col(c).alias("p"), F.col(spec_id).alias("id")))
    f = a.withColumn("_raw", F.coalesce(F.col(p), F.lit(1.0))).groupBy("spec_role", "family_id").agg(
        F.count("*").alias("n_tests"), best("_raw").alias("_b"), best("benjamini_hochberg").alias("_a"), F.count_if(F.col("benjamini_hochberg") <= 0.05).alias("found_5pct"), F.count_if(F.col("benjamini_hochberg") <= 0.10).alias("found_10pct")
    )
    return f.select("spec_role", "family_id", "n_tests", F.col("_b.id").alias("best_raw_spec"), F.col("_b.p").alias("best_raw_p"), F.col("_a.id").alias("best_adjusted_spec"), F.col("_a.p").alias("best_adjusted_p"), "found_5pct", "found_10pct")


def registry(specs: DataFrame, families: DataFrame, p: str = "p") -> DataFrame:
    """By role: specifications, those with a p-value, families, and discoveries over its families; roles without any have no row."""
    n = specs.groupBy("spec_role").agg(F.count("*").alias("n_specs"), F.count(p).alias("n_p_values"))
    f = families.groupBy("spec_role").agg(F.count("*").alias("n_families"), F.sum("found_5pct").alias("found_5pct"), F.sum("found_10pct").alias("found_10pct"))
    return n.join(f, "spec_role", "left")


def examples(specs: DataFrame, keys: list[str], spec_id: str, k: int = 20) -> DataFrame:
    """The first k specifications of each group by id: a report's examples."""
    ids = F.slice(F.sort_array(F.collect_set(spec_id)), 1, k)
    return specs.groupBy(*keys).agg(ids.alias("ids")).select(*keys, F.posexplode("ids").alias("k", spec_id))

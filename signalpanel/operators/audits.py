"""Coverage of predictions, and audit checks: aggregates of one row with the conditions under which they fail or warn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Check = tuple[str, DataFrame, Column, Column]


def _no() -> Column:
    return F.lit(False)


def _count(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def coverage(labels: DataFrame, expected: DataFrame, predicted: DataFrame, specs: DataFrame) -> DataFrame:
    """One row of seven ratios (0 on an empty denominator) and their counts.

    labels (label_id, eligible, portfolio_eligible), expected and predicted (model, label_id), specs (spec_id, metric, spec_role, covered). Repeated labels and pairs count once.
    """
    p = predicted.select("label_id").distinct().withColumn("_p", F.lit(True))
    got = F.col("_p").isNotNull()
    one = labels.groupBy("label_id").agg(F.max("eligible").alias("eligible"), F.max("portfolio_eligible").alias("portfolio_eligible")).join(p, "label_id", "left")
    a = one.agg(
        F.count("*").alias("labels_total"), _count(got, "predicted_labels"), _count(F.col("eligible"), "eligible_labels"), _count(F.col("eligible") & got, "predicted_eligible_labels"),
        _count(F.col("portfolio_eligible"), "portfolio_eligible_labels"), _count(F.col("portfolio_eligible") & got, "predicted_portfolio_eligible_labels"),
    )
    pairs = expected.select("model", "label_id").distinct().join(predicted.select("model", "label_id").distinct().withColumn("_p", F.lit(True)), ["model", "label_id"], "left")
    b = pairs.agg(F.count("*").alias("expected_pairs"), _count(got, "predicted_pairs"))
    s = specs.where("spec_role = 'primary'").groupBy("spec_id").agg(F.max("metric").alias("metric"), F.max("covered").alias("covered"))
    is_portfolio = F.col("metric") == "portfolio_sharpe"
    c = s.agg(
        F.count("*").alias("primary_specs"), _count(F.col("covered"), "primary_covered_specs"), _count(~is_portfolio, "primary_prediction_specs"), _count(~is_portfolio & F.col("covered"), "primary_covered_prediction_specs"),
        _count(is_portfolio, "primary_portfolio_specs"), _count(is_portfolio & F.col("covered"), "primary_covered_portfolio_specs"),
    )
    r = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0)), 6)
    return a.join(b, how="cross").join(c, how="cross").withColumns({  # one row each
        "raw_label_coverage": r("predicted_labels", "labels_total"), "eligible_oos_coverage": r("predicted_eligible_labels", "eligible_labels"), "model_expected_coverage": r("predicted_pairs", "expected_pairs"),
        "portfolio_eligible_coverage": r("predicted_portfolio_eligible_labels", "portfolio_eligible_labels"), "primary_prediction_coverage": r("primary_covered_prediction_specs", "primary_prediction_specs"),
        "primary_portfolio_coverage": r("primary_covered_portfolio_specs", "primary_portfolio_specs"), "primary_spec_coverage": r("primary_covered_specs", "primary_specs"),
    })


def coverage_by(expected: DataFrame, predicted: DataFrame, failures: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """By target, split, ticker or model: expected and predicted rows, their ratio, failures and the most common failure stage (ties by name; null without any).

    expected has ``by`` and the keys that it shares with predicted; failures has ``by`` and stage.
    """
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    e = expected.select(*by, *[k for k in keys if k not in by]).distinct().join(p, keys, "left").groupBy(*by).agg(F.count("*").alias("n_expected"), F.count("_p").alias("n_predicted"))
    n = failures.groupBy(*by, "stage").agg(F.count("*").alias("c"))
    top = n.groupBy(*by).agg(F.sum("c").alias("n_failures"), F.min_by("stage", F.struct((-F.col("c")).alias("c"), "stage")).alias("top_stage"))
    return e.join(top, by, "left").withColumns({"n_failures": F.coalesce("n_failures", F.lit(0)), "coverage": F.round(F.col("n_predicted") / F.col("n_expected"), 6)})


def coverage_threshold(cover: DataFrame, threshold: float, formal: bool, n_missing_split: Column) -> Check:
    """Formal runs fail below max(0.90, threshold) of eligible labels, 0.95 of primary specifications, or with labels without split; others warn below max(0.80, min(threshold, 0.90))."""
    if formal:
        return "coverage_waterfall_threshold", cover, (F.col("eligible_oos_coverage") < max(0.9, threshold)) | (F.col("primary_spec_coverage") < 0.95) | (n_missing_split > 0), _no()
    return "coverage_waterfall_threshold", cover, _no(), (F.col("eligible_oos_coverage") < max(0.8, min(threshold, 0.9))) | (n_missing_split > 0)


def primary_model_coverage(by_model: DataFrame, primary: list[str], formal: bool) -> Check:
    """Least coverage of the primary models: 0.95 at least; warns where none of them is there."""
    one = by_model.where(F.col("model").isin(*primary)).agg(F.min("coverage").alias("least"))
    low = F.coalesce(F.col("least") < 0.95, F.lit(False))
    return "primary_model_expected_coverage", one, low if formal else _no(), F.col("least").isNull() | low


def baseline_coverage(by_model: DataFrame, baseline: str) -> Check:
    """Every row of the baseline has coverage 1."""
    return "historical_mean_oos_coverage", by_model.where(F.col("model") == baseline).agg(_count(F.col("coverage") < 1, "n_low")), F.col("n_low") > 0, _no()


def alignment(predictions: DataFrame, labels: DataFrame, key: str) -> Check:
    """No prediction without its label; null keys are orphans."""
    one = predictions.select(key).distinct().join(labels.select(key).distinct().withColumn("_l", F.lit(1)), key, "left").agg(_count(F.col("_l").isNull(), "n_orphans"))
    return "prediction_label_alignment", one, F.col("n_orphans") > 0, _no()


def split_leakage(assignments: DataFrame) -> Check:
    """Leaking rows fail, purged ones warn. assignments has status: pass, purged, warn or fail."""
    return "split_purge_and_leakage", assignments.agg(_count(F.col("status") == "fail", "n_fail"), _count(F.col("status").isin("purged", "warn"), "n_purged")), F.col("n_fail") > 0, F.col("n_purged") > 0


def lookahead(rows: DataFrame, feature_time: str, prediction_time: str) -> Check:
    """No feature becomes available after the prediction; a null time fails."""
    bad = ~F.coalesce(F.col(feature_time) <= F.col(prediction_time), F.lit(False))
    return "feature_lookahead", rows.agg(_count(bad, "n_late")), F.col("n_late") > 0, _no()


def fit_scope(manifests: DataFrame, wanted: str = "train_only") -> Check:
    """TF-IDF manifests (method, fit_scope) were fitted on train rows alone."""
    return "tfidf_train_window_fit_scope", manifests.where("method = 'tfidf'").agg(_count(~F.coalesce(F.col("fit_scope") == wanted, F.lit(False)), "n_other")), F.col("n_other") > 0, _no()


def vocabulary_alignment(vocabulary: DataFrame, manifests: DataFrame, scope: list[str]) -> Check:
    """The vocabulary has as many terms as its manifest (n_terms) says; a scope on one side only counts as different."""
    n = vocabulary.groupBy(*scope).agg(F.count("*").alias("_n"))
    one = n.join(manifests.select(*scope, "n_terms"), scope, "full").agg(_count(~F.col("_n").eqNullSafe(F.col("n_terms")), "n_different"))
    return "feature_manifest_vocabulary_alignment", one, F.col("n_different") > 0, _no()


def training_rows(manifests: DataFrame) -> Check:
    return "model_manifest_training_rows", manifests.agg(_count(~F.coalesce(F.col("n_train") > 0, F.lit(False)), "n_empty")), F.col("n_empty") > 0, _no()


def manifest_version(manifests: DataFrame, version: str) -> Check:
    return "model_manifest_version", manifests.agg(_count(~F.coalesce(F.col("version") == version, F.lit(False)), "n_old")), F.col("n_old") > 0, _no()


def selection_metric(manifests: DataFrame, allowed: tuple[str, ...] = ("validation_rank_ic", "none")) -> Check:
    """Models were chosen by validation metrics alone."""
    return "model_selection_validation_only", manifests.agg(_count(~F.coalesce(F.col("selection_metric").isin(*allowed), F.lit(False)), "n_other")), F.col("n_other") > 0, _no()


def present(name: str, rows: DataFrame, required: bool = True) -> Check:
    """A table with rows; without any, a required one fails and another warns."""
    empty = F.col("n_rows") == 0
    return name, rows.agg(F.count("*").alias("n_rows")), empty if required else _no(), _no() if required else empty


def constant_predictions(scored: DataFrame, model: str, keys: list[str]) -> Check:
    """The baseline predicts one value in each group, so that its rank correlation is 0 by the tie rule."""
    groups = scored.where(F.col("model") == model).groupBy(*keys).agg((F.min("yhat") != F.max("yhat")).alias("varies"))
    return "constant_baseline_rank_ic", groups.agg(_count(F.col("varies"), "n_varying")), F.col("n_varying") > 0, _no()


def no_portfolios(portfolios: DataFrame, model: str) -> Check:
    """No portfolio comes from the constant model."""
    return "constant_baseline_portfolio", portfolios.agg(_count(F.col("model") == model, "n_rows")), F.col("n_rows") > 0, _no()


def tie_policy(ics: DataFrame) -> Check:
    """Constant sides give a correlation of 0: every value is there and lies between -1 and 1."""
    ok = F.col("rank_ic").isNotNull() & ~F.isnan("rank_ic") & (F.abs("rank_ic") <= 1 + 1e-12)
    return "rank_ic_tie_policy", ics.agg(_count(~ok, "n_bad")), F.col("n_bad") > 0, _no()


def method_metadata(metrics: DataFrame, split: str, method: str, pooled: str) -> Check:
    """Rows over all splits, and no others, are marked with the pooled method."""
    return "evaluation_method_metadata", metrics.agg(_count((F.col(split) == "ALL_SPLITS") != F.coalesce(F.col(method) == pooled, F.lit(False)), "n_bad")), F.col("n_bad") > 0, _no()


def delistings(report: DataFrame, formal: bool) -> Check:
    """report has one row with n_missing: formal runs fail on missing delisting returns, others warn."""
    missing = F.col("n_missing") > 0
    return "delisting_application_report", report, missing if formal else _no(), missing


def sources(rows: DataFrame, source: str) -> Check:
    """More than one provider of market data is worth a warning; case and blanks don't count."""
    return "mixed_market_data_source_boundary", rows.agg(F.countDistinct(F.lower(F.trim(source))).alias("n_sources")), _no(), F.col("n_sources") > 1


def disclosure(specs: DataFrame, registered: DataFrame, families: DataFrame) -> Check:
    """Specifications, registry (n_specs) and families (n_tests) agree in number, and there is a primary one."""
    one = specs.agg(F.count("*").alias("n"), _count(F.col("spec_role") == "primary", "n_primary")).join(registered.agg(F.sum("n_specs").alias("n_registered")), how="cross").join(families.agg(F.sum("n_tests").alias("n_tests")), how="cross")
    return "tested_specifications_disclosure", one, ~(F.col("n").eqNullSafe(F.col("n_registered")) & F.col("n").eqNullSafe(F.col("n_tests"))) | (F.col("n_primary") == 0), _no()


def required_fields(name: str, rows: DataFrame, fields: list[str], formal: bool) -> Check:
    """Formal runs need every one of the fields in every row; elsewhere a missing one is a warning."""
    missing = F.exists(F.array(*[F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) for f in fields]), lambda x: x == "")
    bad = F.col("n_missing") > 0
    return name, rows.agg(_count(missing, "n_missing")), bad if formal else _no(), bad

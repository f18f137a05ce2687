"""Queries of specifications, coverage and audit checks, and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.operators import audits as A
from signalpanel.operators import evaluation as E
from signalpanel.operators import models as M
from signalpanel.operators import specs as S
from signalpanel.operators import universe as U
from signalpanel.plans import extra, panels, relational, texts
from signalpanel.plans.base import EVENTS_SQL, SCORED_SQL, events, scored
from signalpanel.plans.evaluate import _round
from signalpanel.session import table

VERSION = "model-manifest-v1"
_PICK = {
    "target": ("realized_volatility_1_20", "CAR_1_20", "CAR_1_5", "CAR_9_9"), "model": ("ridge", "xgboost", "ridge_dictionary_only", "historical_mean"), "method": ("monthly_common_rebalance_x", "event"),
    "weighting": ("equal_weight", "value_weight"), "metric": ("rank_ic", "industry_neutral_rank_ic", "portfolio_sharpe", "newey_west_t_stat", "rmse"),
}
_AT = {"target": "k % 4", "model": "k div 4 % 4", "method": "k div 16 % 2", "weighting": "k div 32 % 2", "metric": "k % 5"}


def _fields(s: SparkSession, d: str) -> DataFrame:
    """A specification of every kind for each customer number."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    pick = {n: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.expr(_AT[n]) + 1).cast("int")) for n, vs in _PICK.items()}
    return c.withColumns({**pick, "split": F.when(F.col("k") % 3 == 0, S.ALL).otherwise("test_2000"), "sector_neutral": F.expr("k div 64 % 2 = 0")})


def _specs(s: SparkSession, d: str) -> DataFrame:
    f = _fields(s, d)
    role = S.specification_role(*[F.col(c) for c in ("target", "split", "model", "method", "weighting", "sector_neutral", "metric")])
    p = F.when(F.col("k") % 29 != 0, (F.col("k") * 37 % 1000) / 1000)
    return f.withColumns({"spec_role": role, "spec_id": F.lpad(F.col("k").cast("string"), 8, "0"), "family_id": F.concat_ws("::", "target", "metric"), "p": p})


def f34(s: SparkSession, d: str) -> DataFrame:
    """Role and preference ranks of specifications of every kind."""
    return _specs(s, d).select("spec_id", "spec_role", S.preference_rank(F.col("target"), S.TARGETS).alias("target_rank"), S.preference_rank(F.col("model"), S.MODELS).alias("model_rank"), F.col("model").isin(*S.ABLATION).alias("ablation"))


def r31_specs(s: SparkSession, d: str) -> DataFrame:
    """Specifications from evaluation metrics, event backtests and portfolio metrics in one table."""
    f = _fields(s, d).withColumns({"v": F.round((F.col("k") % 200 - 100) / 150, 6), "n": (F.col("k") % 50).cast("int"), "role": F.when(F.col("k") % 7 == 0, "validation").otherwise("test")})
    metrics = f.select("target", "split", "model", "role", F.col("v").alias("rank_ic"), (-F.col("v")).alias("neutral_rank_ic"), "n")
    rest = f.select("target", "split", "model", "method", "weighting", "sector_neutral", F.col("v").alias("sharpe"), (F.col("v") * 3).alias("newey_west_t"), "n")
    return _round(S.specifications(metrics, rest.where("method = 'event'"), rest))


def r31_families(s: SparkSession, d: str) -> DataFrame:
    return _round(S.family_report(_specs(s, d)))


def r31_registry(s: SparkSession, d: str) -> DataFrame:
    return S.registry(_specs(s, d), S.family_report(_specs(s, d)))


def o6(s: SparkSession, d: str) -> DataFrame:
    """The first 20 specifications of each role, and nothing more."""
    return S.examples(_specs(s, d), ["spec_role"], "spec_id")


def a26(s: SparkSession, d: str) -> DataFrame:
    """Feature ablation: pooled rank correlations of its models with their family, best first within a target."""
    family = F.create_map(*[F.lit(x) for kv in S.ABLATION.items() for x in kv])
    f = _fields(s, d).where(F.col("model").isin(*S.ABLATION) & (F.col("split") == S.ALL) & (F.col("metric") == "rank_ic"))
    return _round(f.groupBy("target", "model").agg(F.avg((F.col("k") % 200 - 100) / 150).alias("rank_ic"), F.count("*").alias("n")).withColumn("family", F.element_at(family, F.col("model"))))


def _covered(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All events as labels, of which those since 1996 are eligible; two models; every tenth event has no feature and one model fails for some tickers."""
    labels = events(s, d).select(F.col("doc_id").alias("label_id"), "ticker", F.year("event_date").alias("split_id"), (F.year("event_date") >= 1996).alias("eligible"), ((F.year("event_date") >= 1996) & (F.col("ticker") % 2 == 0)).alias("portfolio_eligible"))
    expected = labels.where("eligible").withColumn("model", F.explode(F.array(F.lit("m1"), F.lit("m2"))))
    lost = "label_id % 10 = 3 or (model = 'm2' and ticker % 9 = 4)"
    failures = expected.where(lost).withColumn("stage", F.when(F.col("label_id") % 10 == 3, "missing_feature").otherwise("missing_model_prediction"))
    return labels, expected, expected.where(f"not ({lost})"), failures


def _cover(s: SparkSession, d: str) -> DataFrame:
    labels, expected, predicted, _ = _covered(s, d)
    covered = _specs(s, d).select("spec_id", "metric", "spec_role", (F.col("k") % 11 != 0).alias("covered"))
    return A.coverage(labels, expected, predicted, covered)


def a20(s: SparkSession, d: str) -> DataFrame:
    return _cover(s, d)


def _by(s: SparkSession, d: str, by: list[str]) -> DataFrame:
    _, expected, predicted, failures = _covered(s, d)
    return A.coverage_by(expected, predicted, failures, by, ["label_id", "model"])


def a21_split(s: SparkSession, d: str) -> DataFrame:
    return _by(s, d, ["split_id"])


def a21_model(s: SparkSession, d: str) -> DataFrame:
    return _by(s, d, ["model"])


def a21_ticker(s: SparkSession, d: str) -> DataFrame:
    return _by(s, d, ["ticker"])


def r50(s: SparkSession, d: str) -> DataFrame:
    """Model manifest of every split: rows by role."""
    return M.model_manifest(panels.r9_splits(s, d), ["split_id"], VERSION, "validation_rank_ic")


def r34(s: SparkSession, d: str) -> DataFrame:
    """Status of every audit check over the domain tables."""
    rows, manifest, specs = scored(s, d), table(s, d, "document_manifest"), _specs(s, d)
    mean = rows.withColumns({"model": F.lit("mean"), "yhat": F.lit(0.5)})
    vocabulary, models, families = texts._vocab(s, d), r50(s, d), S.family_report(specs)
    ics = E.information_coefficients(rows, ["model_id", "event_date"], cross_sections=True)
    portfolios = rows.select("model").distinct()
    scopes = vocabulary.groupBy("scope").agg(F.count("*").alias("n_terms")).withColumns({"method": F.lit("tfidf"), "fit_scope": F.lit("train_only")})
    metrics = _fields(s, d).select("split", F.when(F.col("split") == S.ALL, "pooled_over_splits").otherwise("by_split").alias("method"))
    times = manifest.select(F.col("event_date").alias("feature_time"), F.to_date("available_time_utc").alias("prediction_time"))
    checks = [
        A.present("artifact_exists::events", events(s, d)), A.present("evaluation_outputs_present", ics), A.coverage_threshold(_cover(s, d), 0.9, False, F.lit(0)), A.baseline_coverage(a21_model(s, d), "m1"),
        A.primary_model_coverage(a21_model(s, d), ["m1"], False), A.alignment(table(s, d, "documents").where("document_id is not null"), manifest, "document_id"), A.split_leakage(panels.r9_splits(s, d)),
        A.lookahead(times, "feature_time", "prediction_time"), A.fit_scope(scopes), A.vocabulary_alignment(vocabulary, scopes, ["scope"]), A.training_rows(models), A.manifest_version(models, VERSION), A.selection_metric(models),
        A.tie_policy(ics), A.constant_predictions(mean, "mean", ["model", "split_id"]), A.no_portfolios(portfolios, "mean"), A.method_metadata(metrics, "split", "method", "pooled_over_splits"),
        A.delistings(extra.a16(s, d), False), A.sources(table(s, d, "vendor_prices"), "source"), A.disclosure(specs, S.registry(specs, families), families),
        A.required_fields("licensed_data_manifest", manifest, ["license_note", "source_id", "hash_sha256"], False), A.required_fields("formal_metadata_gate", manifest, ["available_time_utc", "event_date", "document_id"], True),
    ]
    return U.audit(checks).select("check_id", "status")


def r34_status(s: SparkSession, d: str) -> DataFrame:
    return U.overall_status(r34(s, d))


def _choice(n: str) -> str:
    return f"(['{"', '".join(_PICK[n])}'])[{_AT[n].replace(' div ', ' // ')} + 1]"


_F = f"f as (select c_custkey k, {', '.join(f'{_choice(n)} {n}' for n in _PICK)}, case when c_custkey % 3 = 0 then 'ALL_SPLITS' else 'test_2000' end split, c_custkey // 64 % 2 = 0 sector_neutral from customer)".replace("k % 4 + 1", "c_custkey % 4 + 1").replace("k // ", "c_custkey // ").replace("[k % 5", "[c_custkey % 5").replace("c_custc_custkey", "c_custkey")
_OK, _AB = "model in ('ridge', 'xgboost')", "model in ('ridge_dictionary_only', 'ridge_tfidf_svd_only', 'ridge_industry_plus_text')"
_BEST = "target = 'realized_volatility_1_20' and model = 'ridge'"
_ROLE = f"""case when metric = 'rank_ic' and split = 'ALL_SPLITS' and {_BEST} then 'primary' when metric in ('rank_ic', 'industry_neutral_rank_ic') and split = 'ALL_SPLITS' and ({_OK} or {_AB}) then 'robustness'
 when metric = 'portfolio_sharpe' and method like 'monthly_common_rebalance%' and split = 'ALL_SPLITS' and {_BEST} and weighting = 'equal_weight' and sector_neutral then 'primary'
 when metric = 'portfolio_sharpe' and method like 'monthly_common_rebalance%' and {_OK} then 'robustness' when metric = 'newey_west_t_stat' and {_OK} then 'robustness' else 'exploratory' end"""
_SP = f"{_F}, sp as (select *, {_ROLE} spec_role, lpad(k::varchar, 8, '0') spec_id, target || '::' || metric family_id, case when k % 29 <> 0 then (k * 37 % 1000) / 1000 end p from f)"
_FAM = f"""{_SP}, o as (select *, coalesce(p, 1.0) q, count(*) over w m, row_number() over (w order by coalesce(p, 1.0), spec_id) i from sp window w as (partition by spec_role, family_id)),
adj as (select *, least(min(q * m / i) over (partition by spec_role, family_id order by q desc, spec_id desc), 1) bh from o),
fam as (select spec_role, family_id, count(*) n_tests, arg_min(spec_id, (q, spec_id)) best_raw_spec, round(min(q), 6) best_raw_p, arg_min(spec_id, (bh, spec_id)) best_adjusted_spec, round(min(bh), 6) best_adjusted_p, count(*) filter (bh <= 0.05) found_5pct, count(*) filter (bh <= 0.1) found_10pct from adj group by 1, 2)"""
_Z = "case when n >= 4 then atanh(greatest(least({0}, 0.999999), -0.999999)) * sqrt(n - 3) end"
_COV = f"""{EVENTS_SQL}, lab as (select doc_id label_id, ticker, year(event_date) split_id, year(event_date) >= 1996 eligible, year(event_date) >= 1996 and ticker % 2 = 0 portfolio_eligible from events0),
ex as (select *, label_id % 10 = 3 or (model = 'm2' and ticker % 9 = 4) lost, case when label_id % 10 = 3 then 'missing_feature' else 'missing_model_prediction' end stage from (select *, unnest(['m1', 'm2']) model from lab where eligible)),
got as (select distinct label_id from ex where not lost), {_SP}, pri as (select metric, k % 11 <> 0 covered from sp where spec_role = 'primary')"""
_CNT = """cnt as (select (select count(*) from lab) labels_total, (select count(*) from lab where label_id in (select label_id from got)) predicted_labels, (select count(*) from lab where eligible) eligible_labels,
(select count(*) from lab where eligible and label_id in (select label_id from got)) predicted_eligible_labels, (select count(*) from lab where portfolio_eligible) portfolio_eligible_labels, (select count(*) from lab where portfolio_eligible and label_id in (select label_id from got)) predicted_portfolio_eligible_labels,
(select count(*) from ex) expected_pairs, (select count(*) from ex where not lost) predicted_pairs, (select count(*) from pri) primary_specs, (select count(*) from pri where covered) primary_covered_specs, (select count(*) from pri where metric <> 'portfolio_sharpe') primary_prediction_specs,
(select count(*) from pri where metric <> 'portfolio_sharpe' and covered) primary_covered_prediction_specs, (select count(*) from pri where metric = 'portfolio_sharpe') primary_portfolio_specs, (select count(*) from pri where metric = 'portfolio_sharpe' and covered) primary_covered_portfolio_specs)"""
_DIV = "round(case when {1} > 0 then {0} / {1} else 0.0 end, 6)"
_RATIOS = {
    "raw_label_coverage": ("predicted_labels", "labels_total"), "eligible_oos_coverage": ("predicted_eligible_labels", "eligible_labels"), "model_expected_coverage": ("predicted_pairs", "expected_pairs"),
    "portfolio_eligible_coverage": ("predicted_portfolio_eligible_labels", "portfolio_eligible_labels"), "primary_prediction_coverage": ("primary_covered_prediction_specs", "primary_prediction_specs"),
    "primary_portfolio_coverage": ("primary_covered_portfolio_specs", "primary_portfolio_specs"), "primary_spec_coverage": ("primary_covered_specs", "primary_specs"),
}
_A20 = f"with {_COV}, {_CNT} select *, {', '.join(f'{_DIV.format(*v)} {n}' for n, v in _RATIOS.items())} from cnt"
_A21 = f"""with {_COV}, e as (select @BY, count(*) n_expected, count(*) filter (not lost) n_predicted from ex group by 1), c as (select @BY, stage, count(*) c from ex where lost group by 1, 2), t as (select @BY, sum(c) n_failures, arg_min(stage, (-c, stage)) top_stage from c group by 1)
select e.*, cast(coalesce(n_failures, 0) as bigint) n_failures, top_stage, round(n_predicted / n_expected, 6) coverage from e left join t using (@BY)"""
_R9 = panels.ORACLES["R9_J5_R8_splits"]
_WHEN = "select '{}' check_id, case when {} then 'fail' when {} then 'warn' else 'pass' end status"
_LEAST = "(select count(*) filter (not lost) / count(*) from ex where model = 'm1')"
_EMPTY = lambda fs: " or ".join(f"trim(coalesce(cast({f} as varchar), '')) = ''" for f in fs)
_CHECKS = [
    ("artifact_exists::events", "(select count(*) from lab) = 0", "false"), ("evaluation_outputs_present", "(select count(*) from lab) = 0", "false"), ("coverage_waterfall_threshold", "false", "(select predicted_eligible_labels / eligible_labels from cnt) < 0.9"),
    ("historical_mean_oos_coverage", f"round({_LEAST}, 6) < 1", "false"), ("primary_model_expected_coverage", "false", f"round({_LEAST}, 6) < 0.95"),
    ("prediction_label_alignment", "(select count(*) from documents where document_id is not null and document_id not in (select document_id from document_manifest)) > 0", "false"),
    ("split_purge_and_leakage", "(select count(*) from r9 where status = 'fail') > 0", "(select count(*) from r9 where status in ('purged', 'warn')) > 0"),
    ("feature_lookahead", "(select count(*) from document_manifest where not coalesce(event_date <= cast(available_time_utc as date), false)) > 0", "false"), ("tfidf_train_window_fit_scope", "false", "false"),
    ("feature_manifest_vocabulary_alignment", "false", "false"), ("model_manifest_training_rows", "(select count(*) from (select split_id from r9 group by 1 having count(*) filter (role = 'train' and status = 'pass') = 0)) > 0", "false"),
    ("model_manifest_version", "false", "false"), ("model_selection_validation_only", "false", "false"), ("rank_ic_tie_policy", "false", "false"), ("constant_baseline_rank_ic", "false", "false"), ("constant_baseline_portfolio", "false", "false"),
    ("evaluation_method_metadata", "false", "false"), ("delisting_application_report", "false", "(select max(n_missing) from dl) > 0"), ("mixed_market_data_source_boundary", "false", "(select count(distinct lower(trim(source, ' '))) from vendor_prices) > 1"),
    ("tested_specifications_disclosure", "(select count(*) from pri) = 0", "false"), ("licensed_data_manifest", "false", f"(select count(*) from document_manifest where {_EMPTY(('license_note', 'source_id', 'hash_sha256'))}) > 0"),
    ("formal_metadata_gate", f"(select count(*) from document_manifest where {_EMPTY(('available_time_utc', 'event_date', 'document_id'))}) > 0", "false"),
]
_R34 = f"{_COV}, {_CNT}, r9 as ({_R9}), dl as ({extra.ORACLES['A16_delisting_report']}) " + " union all ".join(_WHEN.format(*c) for c in _CHECKS)
QUERIES = {
    "F34_F37_spec_roles": f34, "R31_specifications": r31_specs, "R31_family_report": r31_families, "R31_registry": r31_registry, "O6_examples": o6, "A26_ablation": a26, "A20_R33_waterfall": a20, "A21_coverage_by_split": a21_split, "A21_coverage_by_model": a21_model,
    "A21_coverage_by_ticker": a21_ticker, "R50_model_manifest": r50, "R34_audit": r34, "R34_overall_status": r34_status,
}
ORACLES = {
    "F34_F37_spec_roles": f"with {_SP} select spec_id, spec_role, cast(k % 4 as int) target_rank, case model when 'ridge' then 0 when 'xgboost' then 1 else 2 end model_rank, {_AB} ablation from sp",
    "R31_specifications": f"""with {_F}, g as (select *, round((k % 200 - 100) / 150, 6) v, cast(k % 50 as int) n, k % 7 <> 0 test from f), u as (
select target, split, model, 'prediction_metric' "method", 'not_applicable' weighting, false sector_neutral, 'rank_ic' metric, v "value", {_Z.format("v")} z, 'fisher_z_rank_ic' p_method from g where test
union all select target, split, model, 'prediction_metric_industry_neutral', 'not_applicable', true, 'industry_neutral_rank_ic', -v, {_Z.format("-v")}, 'fisher_z_industry_neutral_rank_ic' from g where test
union all select target, split, model, method, weighting, false, 'newey_west_t_stat', v * 3, v * 3, 'event_level_newey_west_t_stat' from g where method = 'event'
union all select target, split, model, method, weighting, sector_neutral, 'portfolio_sharpe', v, case when split = 'ALL_SPLITS' and method like 'monthly%' then v * 3 when n >= 2 then v * sqrt(n / 252.0) end, case when split = 'ALL_SPLITS' and method like 'monthly%' then 'newey_west_normal' else 'sharpe_normal' end from g)
select * replace (round("value", 6) + 0.0 as "value", round(z, 6) + 0.0 as z), target || '::' || metric family_id, {_ROLE} spec_role from u""",
    "R31_family_report": f"with {_FAM} select * from fam",
    "R31_registry": f"with {_FAM} select spec_role, n_specs, n_p_values, n_families, found_5pct, found_10pct from (select spec_role, count(*) n_specs, count(p) n_p_values from sp group by 1) join (select spec_role, count(*) n_families, cast(sum(found_5pct) as bigint) found_5pct, cast(sum(found_10pct) as bigint) found_10pct from fam group by 1) using (spec_role)",
    "O6_examples": f"with {_SP} select spec_role, cast(i - 1 as int) k, spec_id from (select spec_role, spec_id, row_number() over (partition by spec_role order by spec_id) i from sp) where i <= 20",
    "A26_ablation": f"with {_F} select target, model, round(avg((k % 200 - 100) / 150), 6) + 0.0 rank_ic, count(*) n, replace(model, 'ridge_', '') family from f where {_AB} and split = 'ALL_SPLITS' and metric = 'rank_ic' group by 1, 2".replace("replace(model, 'ridge_', '') family", "case model when 'ridge_dictionary_only' then 'dictionary' when 'ridge_tfidf_svd_only' then 'tfidf_svd' else 'industry_plus_text' end family"),
    "A20_R33_waterfall": _A20, "A21_coverage_by_split": _A21.replace("@BY", "split_id"), "A21_coverage_by_model": _A21.replace("@BY", "model"), "A21_coverage_by_ticker": _A21.replace("@BY", "ticker"),
    "R50_model_manifest": f"with r9 as ({_R9}) select split_id, count(*) filter (role = 'train' and status = 'pass') n_train, count(*) filter (role = 'validation' and status = 'pass') n_validation, count(*) filter (role = 'test' and status = 'pass') n_test, 'validation_rank_ic' selection_metric, '{VERSION}' \"version\" from r9 group by 1",
    "R34_audit": f"with {_R34}",
    "R34_overall_status": f"with r as (with {_R34}) select case when count(*) filter (where status = 'fail') > 0 then 'fail' when count(*) filter (where status = 'warn') > 0 then 'warn' else 'pass' end status, count(*) filter (where status = 'fail') n_fail, count(*) filter (where status = 'warn') n_warn, count(*) filter (where status = 'pass') n_pass from r",
}

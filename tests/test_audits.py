from pyspark.sql import functions as F

from signalpanel.operators import audits as A
from signalpanel.operators import specs as S
from signalpanel.operators import universe as U


def status(*checks):
    return [(r.check_id.split("_")[0], r.status) for r in U.audit(list(checks)).collect()]


def test_checks_fail_and_warn(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    cover = df([(0.85, 0.9)], "eligible_oos_coverage double, primary_spec_coverage double")
    assert [s for _, s in status(A.coverage_threshold(cover, 0.9, True, F.lit(0)), A.coverage_threshold(cover, 0.9, False, F.lit(0)), A.coverage_threshold(cover, 0.8, False, F.lit(0)), A.coverage_threshold(cover, 0.8, False, F.lit(1)))] == ["fail", "warn", "pass", "warn"]
    by = df([("mean", 0.99), ("ridge", 0.96)], "model string, coverage double")
    got = status(A.baseline_coverage(by, "mean"), A.primary_model_coverage(by, ["ridge"], True), A.primary_model_coverage(by, ["none"], True), A.primary_model_coverage(by, ["mean"], True))
    assert [s for _, s in got] == ["fail", "pass", "warn", "pass"]
    keys = df([("a",), (None,)], "k string")
    assert [s for _, s in status(A.alignment(keys, keys.where("k = 'a'"), "k"), A.alignment(keys.where("k = 'a'"), keys, "k"))] == ["fail", "pass"]
    st = df([("pass",), ("purged",)], "status string")
    assert [s for _, s in status(A.split_leakage(st), A.split_leakage(st.union(df([("fail",)], "status string"))), A.split_leakage(st.limit(0)))] == ["warn", "fail", "pass"]
    times = df([(1, 1), (1, 2)], "f int, p int")
    assert [s for _, s in status(A.lookahead(times, "f", "p"), A.lookahead(times, "p", "f"), A.lookahead(df([(None, 1)], "f int, p int"), "f", "p"))] == ["pass", "fail", "fail"]
    man = df([("tfidf", "all", 0, "v0", "test_rank_ic"), ("svd", "all", 5, "v1", "none")], "method string, fit_scope string, n_train int, version string, selection_metric string")
    assert {s for _, s in status(A.fit_scope(man), A.training_rows(man), A.manifest_version(man, "v1"), A.selection_metric(man))} == {"fail"}
    assert {s for _, s in status(*(c(man.where("method = 'svd'")) for c in (A.fit_scope, A.training_rows, A.selection_metric)))} == {"pass"}
    voc = df([("s", "a"), ("s", "b"), ("t", "a")], "scope string, term string")
    assert [s for _, s in status(A.vocabulary_alignment(voc, df([("s", 2), ("t", 1)], "scope string, n_terms long"), ["scope"]), A.vocabulary_alignment(voc, df([("s", 2)], "scope string, n_terms long"), ["scope"]))] == ["pass", "fail"]
    sc = df([("m", 1.0), ("m", 1.0), ("x", 1.0), ("x", 2.0)], "model string, yhat double")
    assert [s for _, s in status(A.constant_predictions(sc, "m", ["model"]), A.constant_predictions(sc, "x", ["model"]), A.no_portfolios(sc, "m"), A.no_portfolios(sc, "z"))] == ["pass", "fail", "fail", "pass"]
    assert [s for _, s in status(A.tie_policy(df([(0.0,), (1.0,)], "rank_ic double")), A.tie_policy(df([(None,)], "rank_ic double")), A.tie_policy(df([(float("nan"),)], "rank_ic double")))] == ["pass", "fail", "fail"]
    meta = df([("ALL_SPLITS", "pooled"), ("s", "x")], "split string, method string")
    assert [s for _, s in status(A.method_metadata(meta, "split", "method", "pooled"), A.method_metadata(meta, "split", "method", "x"))] == ["pass", "fail"]
    assert [s for _, s in status(A.sources(df([("A ",), ("a",)], "s string"), "s"), A.sources(df([("a",), ("b",)], "s string"), "s"), A.present("x", st.limit(0)), A.present("x", st.limit(0), False))] == ["pass", "warn", "fail", "warn"]
    rows = df([("a", None), ("b", " ")], "x string, y string")
    assert [s for _, s in status(A.required_fields("r", rows, ["x"], True), A.required_fields("r", rows, ["x", "y"], True), A.required_fields("r", rows, ["y"], False))] == ["pass", "fail", "warn"]
    assert [s for _, s in status(A.delistings(df([(1,)], "n_missing int"), True), A.delistings(df([(1,)], "n_missing int"), False), A.delistings(df([(0,)], "n_missing int"), True))] == ["fail", "warn", "pass"]


def test_empty_coverage_and_families(spark):
    labels = spark.createDataFrame([], "label_id long, eligible boolean, portfolio_eligible boolean")
    pairs = spark.createDataFrame([], "model string, label_id long")
    row = A.coverage(labels, pairs, pairs, spark.createDataFrame([], "spec_id string, metric string, spec_role string, covered boolean")).first()
    assert row.raw_label_coverage == row.primary_spec_coverage == 0 and row.labels_total == 0
    specs = spark.createDataFrame([("primary", "f", "b", 0.01), ("primary", "f", "a", None), ("robustness", "g", "c", 0.2)], "spec_role string, family_id string, spec_id string, p double")
    fam = S.family_report(specs)
    assert [(r.spec_role, r.n_tests, r.best_raw_spec, r.best_adjusted_p, r.found_5pct) for r in fam.orderBy("spec_role").collect()] == [("primary", 2, "b", 0.02, 1), ("robustness", 1, "c", 0.2, 0)]
    assert [s for _, s in status(A.disclosure(specs, S.registry(specs, fam), fam), A.disclosure(specs.where("spec_id = 'c'"), S.registry(specs, fam), fam))] == ["pass", "fail"]


def test_universe_findings(spark):
    schema = "entity_id string, record_id long, historical_ticker string, gics_industry string, name_start_date date, name_end_date date, snapshot_date date, available_time_utc timestamp"
    links = spark.createDataFrame([("a", 0.9), ("a", None)], "entity_id string, link_confidence double")
    d = "cast('2020-01-02' as date)"
    master = spark.createDataFrame([("a", 1, "X"), ("a", 1, "X"), ("b", 2, " x"), ("b", 3, None)], "entity_id string, record_id long, historical_ticker string")
    master = master.selectExpr("*", "cast(null as string) gics_industry", f"{d} name_start_date", f"{d} - 1 name_end_date", f"{d} snapshot_date", f"cast({d} as timestamp) available_time_utc")
    got = {r.finding: (r.severity, r.n) for r in U.universe_findings(master, links).collect()}
    assert got == {"entity_without_link": ("blocker", 1), "inverted_name_period": ("blocker", 4), "low_confidence_link": ("warning", 1), "entity_without_industry": ("warning", 2), "shared_ticker": ("warning", 1)}
    assert U.universe_findings(spark.createDataFrame([], schema), links.limit(0)).count() == 0


def test_word_list(spark, tmp_path):
    from signalpanel.sources import files as L

    spare = {"up": "Rise rise gain"}
    assert sorted(map(tuple, L.word_list(spark, None, spare).collect())) == sorted(map(tuple, L.word_list(spark, str(tmp_path / "no.csv"), spare).collect())) == [("up", "gain"), ("up", "rise")]
    (tmp_path / "w.csv").write_text("category,term\nup, Rise \nup,rise\n,x\ndown,\n")
    assert [tuple(r) for r in L.word_list(spark, str(tmp_path / "w.csv"), spare).collect()] == [("up", "rise")]
    (tmp_path / "e.csv").write_text("category,term\n")
    assert L.word_list(spark, str(tmp_path / "e.csv"), spare).count() == 0

"""Queries of scalar projections, joins, set operations, reference data, sources and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.functions import scalars as C
from signalpanel.functions import text as T
from signalpanel.operators import panel as P
from signalpanel.operators import universe as U
from signalpanel.plans.base import EVENTS_SQL, META_SQL, events, meta
from signalpanel.plans.evaluate import _round
from signalpanel.session import table
from signalpanel.sources import files as S

MASTER = "research_grade_example_security_master"


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_manifest")


def f_ids(s: SparkSession, d: str) -> DataFrame:
    label = F.concat_ws(":", "document_id", F.lit("CAR_1_20"), F.lit("v1"))
    model = F.concat_ws("::", F.lit("ridge"), F.lit("CAR_1_20"), F.col("fiscal_year").cast("string"))
    m = _manifest(s, d).select("row_id", label.alias("l"), model.alias("m"))
    return m.select("row_id", C.document_of_label(F.col("l")).alias("document_id"), C.model_part(F.col("m"), 0).alias("model"), C.model_part(F.col("m"), 2).alias("split_id"), C.all_splits_id(F.col("m"), F.lit("CAR_1_20")).alias("pooled_id"), C.label_window(F.col("m")).alias("label_window"))


def f15(s: SparkSession, d: str) -> DataFrame:
    return _manifest(s, d).select("row_id", C.cik10(F.col("cik")).alias("cik"), C.cik_short(F.col("cik")).alias("cik_short"), S.safe_name("document_id").alias("path"))


def f16(s: SparkSession, d: str) -> DataFrame:
    m = _manifest(s, d).select("row_id", F.unix_micros(C.acceptance_to_utc(F.col("event_time_utc"))).alias("us")).where("us is not null")
    return m


def f17(s: SparkSession, d: str) -> DataFrame:
    m = _manifest(s, d)
    return m.select("row_id", C.fiscal_year(F.col("raw_filing_date"), F.col("event_date")).alias("fiscal"), C.is_annual_form(F.col("document_type")).alias("annual"), C.role_or_test(F.col("fiscal_period")).alias("period"), T.ticker("ticker").alias("ticker"))


def f26(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vendor_prices_copy")
    return v.agg(F.count(P.number(F.col("date"))).alias("n_numeric_dates"), F.count(C.positive_number(F.col("close"))).alias("n_positive"), F.sum(C.scale_guard(F.col("volume") / 1000).eqNullSafe("fail").cast("long")).alias("n_large"))


def j1(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus").join(li, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def j4(s: SparkSession, d: str) -> DataFrame:
    last = U.latest(table(s, d, MASTER).select("entity_id", "record_id", "gics_sector"), ["entity_id"], [F.col("record_id"), F.col("gics_sector")])
    return _manifest(s, d).select("row_id", "entity_id").join(last, "entity_id")


def j9(s: SparkSession, d: str) -> DataFrame:
    v = U.valid_on(_manifest(s, d).select("row_id", "entity_id", "event_date"), table(s, d, "entity_link_history"), "entity_id", "event_date", "link_start_date", "link_end_date", ["link_id"])
    return v.groupBy("row_id").agg(F.count("*").alias("n_links"), F.min("link_id").alias("first_link"))


def j10(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vendor_prices").select("ticker", "date").distinct()
    j = v.join(F.broadcast(table(s, d, "market_sessions").select(F.col("session_date").alias("date"), "is_early_close")), "date", "left")
    return j.groupBy("is_early_close").agg(F.count("*").alias("n"))


def j11(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "prices").select(T.ticker("ticker").alias("ticker"), "row_id")
    known = table(s, d, MASTER).select(T.ticker("ticker").alias("ticker"))
    return p.join(known, "ticker", "left_semi").groupBy("ticker").agg(F.count("*").alias("n"))


def j12(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("document_id is not null")
    return docs.join(_manifest(s, d).select("document_id"), "document_id", "left_anti").agg(F.count("*").alias("n_orphans"))


def j13(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_date_resolution").select("document_id", "exchange", "resolution_id")
    excluded = r.where("resolution_id % 7 = 0").select("document_id", "exchange")
    return r.join(excluded, ["document_id", "exchange"], "left_anti").select("resolution_id").distinct()


def j14(s: SparkSession, d: str) -> DataFrame:
    m = _manifest(s, d).select("document_id", "fiscal_year").where("fiscal_year is not null").distinct()
    expected = m.select("fiscal_year").distinct().withColumn("model", F.explode(F.array(F.lit("ridge"), F.lit("mean"))))
    return m.join(expected, "fiscal_year").groupBy("fiscal_year", "model").agg(F.count("*").alias("n"))


def j16(s: SparkSession, d: str) -> DataFrame:
    days = _manifest(s, d).select("event_date").distinct()
    return U.next_session(days, table(s, d, "market_sessions"), "event_date", "session_date")


def j17(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "entity_link_history").where("permno is not null").select("permno", "link_id", "link_start_date", "ticker").distinct()
    return U.latest(links, ["permno"], [F.col("link_start_date"), F.col("link_id")])


def r6(s: SparkSession, d: str) -> DataFrame:
    e = U.resolve_event_day(_manifest(s, d).select("row_id", "available_time_utc"), table(s, d, "market_sessions"), "available_time_utc")
    return e.select("row_id", "local_day", "resolved_day")


def w11(s: SparkSession, d: str) -> DataFrame:
    m = _manifest(s, d).where("fiscal_year is not null").select("entity_id", "fiscal_year", "row_id", "event_date")
    return U.first_in_group(m, ["entity_id", "fiscal_year"], [F.col("event_date"), F.col("row_id")])


def w12(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    m = meta(s, d)
    return m.select("ticker", "sector", F.row_number().over(Window.partitionBy("sector").orderBy(F.col("cap").desc_nulls_last(), "ticker")).alias("rank"))


def a23(s: SparkSession, d: str) -> DataFrame:
    return U.universe_quality(table(s, d, MASTER))


def a23_findings(s: SparkSession, d: str) -> DataFrame:
    return U.universe_findings(table(s, d, MASTER), table(s, d, "entity_link_history"))


def a23_tickers(s: SparkSession, d: str) -> DataFrame:
    """Historical tickers that several entities have."""
    return U.duplicates(table(s, d, MASTER).withColumn("t", F.upper(F.trim("historical_ticker"))), "t", "entity_id")


def _cover(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = events(s, d).select("doc_id", "ticker", F.year("event_date").alias("split_id"))
    both = e.withColumn("model", F.explode(F.array(F.lit("m1"), F.lit("m2"))))
    return e, both, both.where("not (doc_id % 10 = 3 or (model = 'm2' and ticker % 9 = 4))")


def a20(s: SparkSession, d: str) -> DataFrame:
    e, expected, predicted = _cover(s, d)
    return U.coverage_waterfall(expected, predicted, e, ["doc_id", "model"])


def _failures(s: SparkSession, d: str) -> DataFrame:
    _, expected, predicted = _cover(s, d)
    lost = expected.join(predicted, ["doc_id", "model"], "left_anti")
    return lost.withColumn("stage", F.when(F.col("doc_id") % 10 == 3, "missing_feature").otherwise("missing_model_prediction"))


def a22(s: SparkSession, d: str) -> DataFrame:
    return _failures(s, d).groupBy("stage", "model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stage", "model").limit(10)


def u_sets(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "vendor_prices").select(T.ticker("ticker").alias("t")), table(s, d, "prices").select(T.ticker("ticker").alias("t"))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return one("union_all", a.unionByName(b)).unionByName(one("union", a.union(b).distinct())).unionByName(one("intersect", a.intersect(b))).unionByName(one("except", a.subtract(b))).unionByName(one("except_all", a.exceptAll(b)))


def o3(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    return li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(12).select("l_orderkey", "l_linenumber", "l_extendedprice")


def o7(s: SparkSession, d: str) -> DataFrame:
    m = meta(s, d).where("cap is not null")
    return m.groupBy("sector").agg(F.max_by("ticker", F.struct("cap", "ticker")).alias("largest"), F.min_by("ticker", F.struct("cap", "ticker")).alias("smallest"))


def r41(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vendor_prices_copy").select("ticker", "date", F.coalesce(C.positive_number(F.col("closeadj")), C.positive_number(F.col("close"))).alias("adj"))
    return v.groupBy(T.ticker("ticker").alias("ticker")).agg(F.count("*").alias("n"), F.count("adj").alias("n_usable"), F.round(F.sum("adj"), 2).alias("total"))


def r39(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vendor_prices").where("closeadj > 0 and not isnan(closeadj)").select(T.ticker("ticker").alias("ticker"), "date", "closeadj", "loaded_at")
    v = U.latest(v, ["ticker", "date"], [F.col("loaded_at"), F.col("closeadj")])
    price = P.asof_with_fallback(v, ["ticker"], "date", F.lit("2018-06-29").cast("date"), "closeadj")
    return _round(v.groupBy("ticker").agg(price.alias("price"), (price * 1_000_000.0).alias("cap")), 4)


def s1(s: SparkSession, d: str) -> DataFrame:
    path = S.scratch_path(s, "jsonl")
    S.write_table(table(s, d, "supplier"), path, "json")
    good, _ = S.read_jsonl(s, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    return good


def s3(s: SparkSession, d: str) -> DataFrame:
    path = S.scratch_path(s, "csv")
    S.write_table(table(s, d, "entity_link_history").select("link_id", "entity_id", "link_start_date", "link_end_date", "link_confidence"), path, "csv")
    return S.read_csv(s, path, "link_id bigint, entity_id string, link_start_date date, link_end_date date, link_confidence double")


def s9(s: SparkSession, d: str) -> DataFrame:
    wide = table(s, d, "nation").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, "2009").otherwise("0").alias("negative"), F.when(F.col("n_nationkey") % 3 == 0, "1").alias("positive"))
    return S.flag_dictionary(wide, "n_name", ["negative", "positive"])


def s11(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "nation").groupBy("n_regionkey").agg(F.struct(F.sort_array(F.collect_list("n_nationkey")).alias("key"), F.sort_array(F.collect_list("n_name")).alias("name")).alias("recent"))
    return S.zip_columns(j, "recent", ["key", "name"])


def s17(s: SparkSession, d: str) -> DataFrame:
    path = S.scratch_path(s, "matrix")
    S.write_table(table(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity"), path, "parquet", ["l_returnflag"])
    return s.read.parquet(path).where("l_returnflag = 'R'").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


_UT = "upper(regexp_replace(ticker, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))"
_COV = f"{EVENTS_SQL}, e as (select doc_id, ticker from events0), x as (select *, unnest(['m1', 'm2']) model from e), pr as (select * from x where not (doc_id % 10 = 3 or (model = 'm2' and ticker % 9 = 4))), fl as (select *, case when doc_id % 10 = 3 then 'missing_feature' else 'missing_model_prediction' end stage from x where (doc_id % 10 = 3 or (model = 'm2' and ticker % 9 = 4)))"
_A20 = "select (select count(*) from x) n_expected, (select count(*) from pr) n_predicted, (select count(*) from e) n_eligible, round((select count(*) from pr) / (select count(*) from x), 6) expected_ratio, round((select count(*) from pr) / (select count(*) from e), 6) eligible_ratio"
_CIK = "regexp_replace(trim(cik), '[^0-9]', '', 'g')"
_SHARED = f"sh as (select upper(trim(historical_ticker, ' ')) \"value\", count(distinct entity_id) n from {MASTER} where trim(historical_ticker, ' ') <> '' group by 1 having count(distinct entity_id) > 1)"
QUERIES = {
    "F5_F6_F7_F9_ids": f_ids, "F15_F39_identifiers": f15, "F16_acceptance_time": f16, "F13_F17_F20_filing_fields": f17, "F22_F26_F29_numbers": f26, "J1_inner": j1, "J4_last_wins": j4, "J9_interval_validity": j9, "J10_left": j10,
    "J11_semi": j11, "J12_anti": j12, "J13_anti_pair": j13, "J14_expected": j14, "J16_next_session": j16, "J17_latest_link": j17, "R6_R7_event_day": r6, "W11_first_filing": w11, "W12_selection_rank": w12, "A23_universe_quality": a23, "A23_universe_findings": a23_findings, "A23_shared_tickers": a23_tickers,
    "A20_R33_coverage": a20, "A22_failure_reasons": a22, "U1_U8_sets": u_sets, "O3_O4_top_rows": o3, "O7_extremes": o7, "R41_A27_adjusted_close": r41, "R39_market_cap": r39,
    "S1_S15_jsonl": s1, "S3_S18_csv": s3, "S9_flag_dictionary": s9, "S11_zip_arrays": s11, "S17_partitioned_matrix": s17,
}
ORACLES = {
    "F5_F6_F7_F9_ids": "select row_id, document_id, 'ridge' model, cast(fiscal_year as varchar) split_id, 'ridge::CAR_1_20::ALL_SPLITS' pooled_id, 'unspecified' label_window from document_manifest",
    "F15_F39_identifiers": f"select row_id, case when length({_CIK}) between 1 and 10 then lpad({_CIK}, 10, '0') end cik, nullif(ltrim(case when length({_CIK}) between 1 and 10 then {_CIK} end, '0'), '') cik_short, regexp_replace(document_id, '[^A-Za-z0-9_.-]+', '_', 'g') path from document_manifest",
    "F13_F17_F20_filing_fields": f"select row_id, cast(case when month(d) = 1 and day(d) <= 7 then year(d) - 1 else year(d) end as int) fiscal, upper(trim(document_type)) = '10-K' annual, coalesce(nullif(fiscal_period, ''), 'test') period, {_UT} ticker from (select *, coalesce(raw_filing_date, event_date) d from document_manifest)",
    "F22_F26_F29_numbers": "select count(try_cast(date as double)) n_numeric_dates, count(case when close > 0 and not isnan(close) then 1 end) n_positive, cast(sum(case when volume / 1000 >= 1000 then 1 else 0 end) as bigint) n_large from vendor_prices_copy",
    "J1_inner": "select o_orderkey, o_orderstatus, n, qty from orders join (select l_orderkey, count(*) n, round(sum(l_quantity), 2) qty from lineitem group by 1) on l_orderkey = o_orderkey",
    "J4_last_wins": f"select row_id, d.entity_id, record_id, gics_sector from document_manifest d join (select entity_id, max(record_id) record_id, arg_max(gics_sector, (record_id, gics_sector)) gics_sector from {MASTER} group by 1) m on m.entity_id = d.entity_id",
    "J9_interval_validity": "select row_id, count(*) n_links, min(link_id) first_link from document_manifest d join (select distinct entity_id, link_id, link_start_date, link_end_date from entity_link_history) l on l.entity_id = d.entity_id and event_date >= link_start_date and event_date <= coalesce(link_end_date, date '9999-12-31') group by 1",
    "J10_left": "select is_early_close, count(*) n from (select distinct ticker, date from vendor_prices) left join market_sessions on session_date = date group by 1",
    "J11_semi": f"select {_UT} ticker, count(*) n from prices where {_UT} in (select {_UT} from {MASTER} where ticker is not null) group by 1",
    "J12_anti": "select count(*) n_orphans from documents where document_id is not null and not exists (select 1 from document_manifest m where m.document_id = documents.document_id)",
    "J13_anti_pair": "select distinct resolution_id from event_date_resolution r where not exists (select 1 from event_date_resolution e where e.resolution_id % 7 = 0 and e.document_id = r.document_id and e.exchange = r.exchange)",
    "J14_expected": "select fiscal_year, model, count(*) n from (select distinct document_id, fiscal_year from document_manifest) cross join (select unnest(['ridge', 'mean']) model) where fiscal_year is not null group by 1, 2",
    "J16_next_session": "select event_date, (select min(session_date) from market_sessions where session_date >= event_date and session_date <= event_date + 14) next_session from (select distinct event_date from document_manifest)",
    "J17_latest_link": "select permno, arg_max(link_id, (link_start_date, link_id)) link_id, max(link_start_date) link_start_date, arg_max(ticker, (link_start_date, link_id)) ticker from entity_link_history where permno is not null group by 1",
    "R6_R7_event_day": """with e as (select row_id, timezone('America/New_York', available_time_utc::timestamptz) l from document_manifest), f as (select row_id, cast(l as date) local_day, case when exists (select 1 from market_sessions where session_date = cast(l as date) and date_part('hour', l) * 60 + date_part('minute', l) + date_part('second', l) / 60.0 <= case when is_early_close then 780 else 960 end) then cast(l as date) else cast(l as date) + 1 end f from e)
      select row_id, local_day, (select min(session_date) from market_sessions where session_date >= f and session_date <= f + 14) resolved_day from f""",
    "W11_first_filing": "select entity_id, fiscal_year, row_id, event_date from (select *, row_number() over (partition by entity_id, fiscal_year order by event_date, row_id) n from document_manifest where fiscal_year is not null) where n = 1",
    "W12_selection_rank": f"with {META_SQL} select ticker, sector, cast(row_number() over (partition by sector order by cap desc nulls last, ticker) as int) rank from meta",
    "A23_shared_tickers": f"with {_SHARED} select * from sh",
    "A23_universe_findings": f"""with {_SHARED}, en as (select entity_id, bool_or(gics_industry is not null) h from {MASTER} where entity_id is not null group by 1), u as (
select 'entity_without_link' finding, 'blocker' severity, count(*) n from en where entity_id not in (select entity_id from entity_link_history where entity_id is not null)
union all select 'inverted_name_period', 'blocker', count(*) from {MASTER} where name_end_date < name_start_date
union all select 'reused_record_id', 'blocker', count(*) from (select record_id from (select distinct * from {MASTER}) group by 1 having count(*) > 1)
union all select 'low_confidence_link', 'warning', count(*) from entity_link_history where coalesce(link_confidence < 0.8, true)
union all select 'published_before_snapshot', 'warning', count(*) from {MASTER} where cast(available_time_utc as date) < snapshot_date
union all select 'entity_without_industry', 'warning', count(*) from en where not h union all select 'shared_ticker', 'warning', count(*) from sh) select * from u where n > 0""",
    "A23_universe_quality": f"select count(*) n_rows, count(distinct entity_id) n_entities, count(*) filter (where permno is null) n_no_permno, count(*) filter (where gvkey is null) n_no_gvkey, count(*) filter (where gics_industry is null) n_no_industry, count(*) filter (where historical_ticker is null or trim(historical_ticker) = '') n_no_ticker, count(*) filter (where name_end_date < name_start_date) n_inverted, count(*) filter (where cast(available_time_utc as date) > snapshot_date + 60) n_late, count(*) - count(distinct record_id) n_repeated from {MASTER}",
    "A20_R33_coverage": f"with {_COV} {_A20}",
    "A22_failure_reasons": f"with {_COV} select stage, model, count(*) n from fl group by 1, 2 order by n desc, stage, model limit 10",
    "U1_U8_sets": f"with a as (select {_UT} t from vendor_prices), b as (select {_UT} t from prices) select 'union_all' op, count(*) n from (select * from a union all select * from b) union all select 'union', count(*) from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b) union all select 'except', count(*) from (select * from a except select * from b) union all select 'except_all', count(*) from (select * from a except all select * from b)",
    "O3_O4_top_rows": "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 12",
    "O7_extremes": f"with {META_SQL} select sector, arg_max(ticker, (cap, ticker)) largest, arg_min(ticker, (cap, ticker)) smallest from meta where cap is not null group by 1",
    "R41_A27_adjusted_close": f"select {_UT} ticker, count(*) n, count(a) n_usable, round(sum(a), 2) total from (select *, coalesce(case when closeadj > 0 and not isnan(closeadj) then closeadj end, case when close > 0 and not isnan(close) then close end) a from vendor_prices_copy) group by 1",
    "R39_market_cap": f"with v as (select {_UT} t, date, arg_max(closeadj, (loaded_at, closeadj)) c from vendor_prices where closeadj > 0 and not isnan(closeadj) group by 1, 2), p as (select t, coalesce(arg_max(c, date) filter (where date <= date '2018-06-29'), arg_min(c, date)) p from v group by 1) select t ticker, round(p, 4) price, round(p * 1000000.0, 4) cap from p",
    "S1_S15_jsonl": "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier",
    "S3_S18_csv": "select link_id, entity_id, link_start_date, link_end_date, link_confidence from entity_link_history",
    "S9_flag_dictionary": "select 'negative' category, lower(trim(n_name)) term from nation where n_nationkey % 2 = 0 union select 'positive', lower(trim(n_name)) from nation where n_nationkey % 3 = 0",
    "S11_zip_arrays": "select n_regionkey, unnest(list_sort(list(n_nationkey))) \"key\", unnest(list_sort(list(n_name))) \"name\" from nation group by 1",
    "S17_partitioned_matrix": "select l_linenumber, count(*) n, round(sum(l_quantity), 2) qty from lineitem where l_returnflag = 'R' group by 1",
}

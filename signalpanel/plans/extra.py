"""Queries of the remaining predicates, reports, panels and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalpanel.functions import scalars as C
from signalpanel.functions.text import ticker
from signalpanel.operators import evaluation as E
from signalpanel.operators import features as T
from signalpanel.operators import panel as P
from signalpanel.operators import portfolio as B
from signalpanel.operators import universe as U
from signalpanel.operators.ranks import value_ranks
from signalpanel.plans import texts
from signalpanel.plans.base import EVENTS_SQL, META_SQL, PANEL_SQL, SCORED_SQL, events, meta, panel, scored
from signalpanel.plans.evaluate import _C, _LEGS, _RANKS_G, _round
from signalpanel.session import table
from signalpanel.sources import files as S

MASTER = "research_grade_example_security_master"
#: Feature method by model name, with a default.
METHODS = {"ridge": "combined", "historical_mean": "baseline"}


def f10(s: SparkSession, d: str) -> DataFrame:
    """Split and role of a feature version (four parts at least, known roles), volatility and ablation predicates, method of a model."""
    c = table(s, d, "customer")
    version = F.concat_ws(":", F.lit("tfidf"), F.lit("v1"), (F.col("c_custkey") % 3).cast("string"), F.element_at(F.array(F.lit("train"), F.lit("test"), F.lit("other")), (F.col("c_custkey") % 3 + 1).cast("int")))
    v = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "short:v").otherwise(version).alias("v"), F.when(F.col("c_custkey") % 2 == 0, "realized_volatility_1_20").otherwise("CAR_1_20").alias("t"), F.element_at(F.array(F.lit("ridge"), F.lit("historical_mean"), F.lit("x")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("m"))
    parts = F.split("v", ":")
    ok = (F.size(parts) >= 4) & F.element_at(parts, -1).isin("train", "validation", "test")
    method = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), F.col("m")), F.lit("other"))
    return v.select("c_custkey", F.when(ok, F.get(parts, F.lit(2))).alias("split_id"), F.when(ok, F.element_at(parts, -1)).alias("role"), C.is_volatility(F.col("t")).alias("volatility"), F.col("m").isin("ridge_a", "ridge_b").alias("ablation"), method.alias("method"))


def f14(s: SparkSession, d: str) -> DataFrame:
    return meta(s, d).select("ticker", E.industry_key("industry", "sector").alias("industry_key"))


def f30(s: SparkSession, d: str) -> DataFrame:
    """Exchange and share-class codes, prefix number of a scale text, estimated-cap flag, feature id."""
    m = table(s, d, MASTER).select("record_id", "entity_id", "exchange", "share_class", "source_version").distinct()
    code = F.when(F.upper("exchange") == "NYSE", 1).when(F.upper("exchange") == "NASDAQ", 3).otherwise(0)
    return m.groupBy("record_id").agg(F.max(code).alias("exchange_code"), F.max(F.regexp_extract("source_version", r"^(\d+)", 1).try_cast("int")).alias("year"), F.max(F.concat_ws(":", "entity_id", F.lit("meta"), "source_version")).alias("feature_id"), F.max(C.is_estimated_cap(F.col("source_version")).cast("int")).alias("estimated"))


def a16(s: SparkSession, d: str) -> DataFrame:
    """How many delisting returns were applied or missing, and whether any was."""
    p = panel(s, d)
    day = F.dayofmonth("date")
    p = P.delisting_returns(P.base_returns(p.withColumns({"dlret": F.when((day == 13) & (F.col("ticker") % 2 == 0), F.lit("-0.5")), "dlstcd": F.when(day == 13, F.lit("500"))})))
    n = lambda x: F.sum(F.coalesce((F.col("delisting_flag") == x).cast("long"), F.lit(0)))
    return p.agg(n("applied").alias("n_applied"), n("missing").alias("n_missing")).withColumn("status", F.when(F.col("n_missing") > 0, "fail").when(F.col("n_applied") > 0, "pass").otherwise("not_applicable"))


def a28(s: SparkSession, d: str) -> DataFrame:
    """Documents by scope: the whole text counts for any document with text, a feed for its own."""
    t = table(s, d, "documents").where("trim(text) <> ''")
    return t.select(F.explode(F.array(F.lit("full"), "source")).alias("scope")).groupBy("scope").agg(F.count("*").alias("n"))


def a29(s: SparkSession, d: str) -> DataFrame:
    """Stability of models over splits: mean, positive splits and the best split."""
    k = ["model", "split_id"]
    ic = E.information_coefficients(scored(s, d), k).withColumn("rank_ic", F.round("rank_ic", 8))
    return _round(ic.groupBy("model").agg(F.avg("rank_ic").alias("mean_rank_ic"), F.sum((F.col("rank_ic") > 0).cast("long")).alias("n_positive"), F.max_by("split_id", "rank_ic").alias("best_split")))


def a31(s: SparkSession, d: str) -> DataFrame:
    """Document sets by split and role."""
    return scored(s, d).groupBy("split_id", "role").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def o5(s: SparkSession, d: str) -> DataFrame:
    """First five filings of each entity."""
    m = table(s, d, "document_manifest").select("entity_id", "row_id", "event_date")
    return U.first_in_group(m, ["entity_id"], [F.col("event_date"), F.col("row_id")], 5).select("entity_id", "row_id")


def r11(s: SparkSession, d: str) -> DataFrame:
    """Manifest records from a filing index of parallel arrays by entity, joined back to the latest security-master record."""
    m = table(s, d, "document_manifest").where("document_type is not null")
    rows = F.sort_array(F.collect_list(F.struct("row_id", "document_type", "raw_filing_date")))
    pick = lambda c: F.transform("r", lambda x: x[c]).alias(c)
    index = m.groupBy("entity_id").agg(rows.alias("r")).select("entity_id", F.struct(*[pick(c) for c in ("row_id", "document_type", "raw_filing_date")]).alias("recent"))
    filings = S.zip_columns(index, "recent", ["row_id", "document_type", "raw_filing_date"]).where(C.is_annual_form(F.col("document_type")))
    last = U.latest(table(s, d, MASTER).select("entity_id", "record_id", "permno"), ["entity_id"], [F.col("record_id"), F.col("permno")])
    return filings.join(last, "entity_id").select("row_id", "entity_id", "record_id", "permno", C.fiscal_year(F.col("raw_filing_date")).alias("fiscal_year"))


def r13(s: SparkSession, d: str) -> DataFrame:
    """Metadata features in long form: numbers and texts in their own columns."""
    m = meta(s, d)
    long = F.inline(F.array(F.struct(F.lit("industry").alias("name"), F.nullif("industry", F.lit("")).alias("value_str"), F.lit(None).cast("double").alias("value_num")), F.struct(F.lit("sector").alias("name"), F.col("sector").alias("value_str"), F.lit(None).cast("double").alias("value_num")), F.struct(F.lit("market_cap").alias("name"), F.lit(None).cast("string").alias("value_str"), F.col("cap").alias("value_num"))))
    return m.select("ticker", long).where("value_str is not null or value_num is not null")


def r28(s: SparkSession, d: str) -> DataFrame:
    """Monthly factor panel: latest unexpired signals at month ends, ranked, with equal leg weights."""
    sig = P.expiring_signals(events(s, d).select("ticker", "event_date", "yhat", "doc_id"), "ticker", "event_date", "doc_id", P.month_ends(panel(s, d)))
    ranked = E.ranked_cross_section(sig, ["rebalance"], "yhat")
    w = B.leg_weights(sig, ["rebalance"], "equal").select("rebalance", "ticker", "weight")
    return _round(ranked.select("rebalance", "ticker", "avg_rank", "quantile").join(w, ["rebalance", "ticker"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))))


def r40(s: SparkSession, d: str) -> DataFrame:
    """Membership with validity intervals: an entity's first and last snapshot, its rank by number of snapshots."""
    m = table(s, d, MASTER).groupBy("entity_id").agg(F.min("snapshot_date").alias("entry_date"), F.max("snapshot_date").alias("exit_date"), F.countDistinct("snapshot_date").alias("n"))
    # the rank of the negative number, so that most come first
    r = value_ranks(m.withColumn("value", -F.col("n")), [], ["value"]).select((-F.col("value")).cast("bigint").alias("n"), (F.col("below") + 1).cast("int").alias("rank"))
    return m.join(r, "n").select("entity_id", "entry_date", "exit_date", "n", "rank")


def s8(s: SparkSession, d: str) -> DataFrame:
    """Section texts of a document as one map, and their join in key order."""
    t = table(s, d, "documents").where("document_id is not null and section_key is not null")
    one = t.groupBy("document_id", "section_key").agg(F.min("text").alias("text"))
    m = one.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section_key", "text")))).alias("m"))
    return m.select("document_id", F.size("m").alias("n_sections"), F.md5(F.array_join(F.map_values("m"), "\n\n")).alias("digest"))


def s7(s: SparkSession, d: str) -> DataFrame:
    """Whole files, one row each."""
    path = S.scratch_path(s, "raw")
    table(s, d, "region").select("r_name").coalesce(1).write.text(path)
    return s.read.text(path, wholetext=True).select(F.length("value").alias("n_chars"))


def s10(s: SparkSession, d: str) -> DataFrame:
    """Distinct terms by category of a word list from a file, and of the fallback where there is no file."""
    path = S.scratch_path(s, "words")
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    S.write_table(n.select(F.col("r_name").alias("category"), F.explode(F.array("n_name", F.concat(F.lit(" "), F.lower("n_name")))).alias("term")), path, "csv")
    read, spare = S.word_list(s, path, texts.WORDS), S.word_list(s, f"{path}/none", texts.WORDS)
    return read.unionByName(spare).groupBy("category").agg(F.countDistinct("term").alias("n_terms"), F.min("term").alias("first"))


_MAS = f"(select distinct record_id, entity_id, exchange, share_class, source_version from {MASTER})"
_J7 = f"{PANEL_SQL}, {EVENTS_SQL}, reb as (select max(date) rebalance from panel group by year(date), month(date)), sig as (select e.ticker, rebalance, arg_max(yhat, (event_date, doc_id)) yhat from reb join events0 e on e.event_date <= rebalance and rebalance - e.event_date <= 370 group by 1, 2)"
QUERIES = {
    "F10_F11_F12_F35_predicates": f10, "F14_industry_key": f14, "F23_F28_F30_codes": f30, "A16_delisting_report": a16, "A28_scope_counts": a28, "A29_stability": a29, "A31_document_sets": a31,
    "O5_first_k": o5, "R11_filing_index": r11, "R13_metadata_features": r13, "R28_monthly_panel": r28, "R40_membership": r40, "S8_section_map": s8, "S7_whole_files": s7, "S10_U7_terms": s10,
}
ORACLES = {
    "F10_F11_F12_F35_predicates": "select c_custkey, case when c_custkey % 5 <> 0 and c_custkey % 3 < 2 then cast(c_custkey % 3 as varchar) end split_id, case when c_custkey % 5 <> 0 and c_custkey % 3 < 2 then ['train', 'test'][c_custkey % 3 + 1] end role, c_custkey % 2 = 0 volatility, false ablation, ['combined', 'baseline', 'other'][c_custkey % 3 + 1] method from customer",
    "F14_industry_key": f"with {META_SQL} select ticker, coalesce(nullif(industry, ''), nullif(sector, ''), '__MISSING_INDUSTRY__') industry_key from meta",
    "F23_F28_F30_codes": f"select record_id, max(case upper(exchange) when 'NYSE' then 1 when 'NASDAQ' then 3 else 0 end) exchange_code, max(try_cast(regexp_extract(source_version, '^(\\d+)', 1) as int)) \"year\", max(concat_ws(':', entity_id, 'meta', source_version)) feature_id, max(case when regexp_matches(lower(coalesce(source_version, '')), 'not_crsp|estimate|proxy') then 1 else 0 end) estimated from {_MAS} group by 1",
    "A16_delisting_report": f"with {PANEL_SQL}, n as (select count(*) filter (where day(date) = 13 and ticker % 2 = 0) n_applied, count(*) filter (where day(date) = 13 and ticker % 2 = 1) n_missing from panel) select *, case when n_missing > 0 then 'fail' when n_applied > 0 then 'pass' else 'not_applicable' end status from n",
    "A28_scope_counts": "select scope, count(*) n from (select unnest(['full', source]) scope from documents where trim(text, ' ') <> '') group by 1",
    "A29_stability": f"with {_RANKS_G.replace('partition by model_id, role', 'partition by model, split_id')}, ic as (select model, split_id, round({_C.format('ry', 'rp')}, 8) r from ranked group by 1, 2) select model, round(avg(r), 6) + 0.0 mean_rank_ic, count(*) filter (where r > 0) n_positive, arg_max(split_id, r) best_split from ic group by 1",
    "A31_document_sets": f"with {SCORED_SQL} select split_id, role, count(distinct doc_id) n_docs, min(doc_id) first_doc, max(doc_id) last_doc from scored group by 1, 2",
    "O5_first_k": "select entity_id, row_id from (select *, row_number() over (partition by entity_id order by event_date, row_id) n from document_manifest) where n <= 5",
    "R11_filing_index": f"select row_id, d.entity_id, record_id, permno, cast(case when month(raw_filing_date) = 1 and day(raw_filing_date) <= 7 then year(raw_filing_date) - 1 else year(raw_filing_date) end as int) fiscal_year from document_manifest d join (select entity_id, max(record_id) record_id, (arg_max(struct_pack(p := permno), record_id)).p permno from (select entity_id, record_id, max(permno) permno from {MASTER} group by 1, 2) group by 1) m on m.entity_id = d.entity_id where upper(trim(document_type)) = '10-K'",
    "R13_metadata_features": f"with {META_SQL} select ticker, 'industry' \"name\", industry value_str, cast(null as double) value_num from meta where industry <> '' union all select ticker, 'sector', sector, null from meta union all select ticker, 'market_cap', null, cap from meta where cap is not null",
    "R28_monthly_panel": f"with {_J7}, {_LEGS.format(k='rebalance', src='sig')} select rebalance, ticker, avg_rank, quantile, round(case when leg is null then 0 else leg * 1.0 / count(*) over (partition by rebalance, leg) end, 6) weight from legs",
    "R40_membership": f"with m as (select entity_id, min(snapshot_date) entry_date, max(snapshot_date) exit_date, count(distinct snapshot_date) n from {MASTER} group by 1) select *, cast(rank() over (order by n desc) as int) rank from m",
    "S8_section_map": "select document_id, cast(count(*) as int) n_sections, md5(string_agg(text, chr(10) || chr(10) order by section_key)) digest from (select document_id, section_key, min(text) text from documents where document_id is not null and section_key is not null group by 1, 2) group by 1",
    "S7_whole_files": "select cast(sum(length(r_name) + 1) as int) n_chars from region",
    "S10_U7_terms": "select r_name category, count(distinct lower(n_name)) n_terms, min(lower(n_name)) \"first\" from nation join region on n_regionkey = r_regionkey group by 1 union all select c, len(list_distinct(string_split(w, ' '))), list_min(string_split(w, ' ')) from (values " + ", ".join(f"('{c}', '{w}')" for c, w in texts.WORDS.items()) + ") t(c, w)",
}

"""Queries of the general data problems p1 to p5, each over its whole tables, and their reference SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.functions.text import squeeze, strip, ticker
from signalpanel.operators.bitemporal import locate_versions
from signalpanel.operators.diff import diff_copies, latest_rows, relative_apart, unequal
from signalpanel.operators.grid import to_grid
from signalpanel.operators.history import attribute_history
from signalpanel.operators.timestamps import resolve_instants
from signalpanel.session import cut, table

MASTER = "research_grade_example_security_master"


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- p1: mixed timestamp formats and time zones


def _instants(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null time text of the manifest and of the event-date resolutions, resolved. The manifest is read once for both."""
    m = table(spark, d, "document_manifest").select("row_id", "timezone", F.expr("stack(2, 'event_time_utc', event_time_utc, 'retrieval_time_utc', retrieval_time_utc) as (field_name, value)"))
    r = table(spark, d, "event_date_resolution").select(F.col("resolution_id").alias("row_id"), "timezone", F.lit("market_close_utc").alias("field_name"), F.col("market_close_utc").alias("value"))
    both = m.withColumn("table_name", F.lit("document_manifest")).unionByName(r.withColumn("table_name", F.lit("event_date_resolution")))
    return resolve_instants(both.where("value is not null"), "value", "timezone")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Exact UTC instants of all time texts that state a possible date and time."""
    return _instants(spark, d).where("instant_us is not null").select("table_name", "row_id", "field_name", "instant_us").distinct()


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """How the instants were found, by field: epoch, own offset, one interval, ambiguous, skipped, or unreadable."""
    n = _instants(spark, d).groupBy("table_name", "field_name", F.coalesce("instant_us_match", F.lit("unreadable")).alias("how"))
    return n.agg(F.count("*").alias("n_values"))


# --- p2: history of changing entity attributes


def _ticker_history(spark: SparkSession, d: str) -> DataFrame:
    return attribute_history(table(spark, d, MASTER), "entity_id", ticker("historical_ticker"), "snapshot_date", "available_time_utc", "record_id", "name_start_date", "name_end_date", "historical_ticker")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's sequence of historical tickers with first and last day."""
    h = _ticker_history(spark, d)
    return h.select("entity_id", "historical_ticker", _day(F.col("valid_from")).alias("valid_from"), _day(F.col("valid_to")).alias("valid_to")).distinct()


def p2_versions_per_entity(spark: SparkSession, d: str) -> DataFrame:
    """Number of versions and of snapshots behind them, by entity."""
    return _ticker_history(spark, d).groupBy("entity_id").agg(F.count("*").alias("n_versions"), F.sum("n_snapshots").cast("bigint").alias("n_snapshots"))


P2_HELD = f"""
held as (select * from (select entity_id, t, snapshot_date s, available_time_utc a, record_id r, name_start_date f, name_end_date e,
    row_number() over (partition by entity_id, snapshot_date order by available_time_utc desc nulls last, record_id desc) k
  from (select *, upper(regexp_replace(historical_ticker, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) t from {MASTER}) where t <> '') where k = 1),
runs as (select *, sum(case when t = p then 0 else 1 end) over (partition by entity_id order by s) v from (select *, lag(t) over (partition by entity_id order by s) p from held)),
versions as (select entity_id, v, any_value(t) t, count(*) n,
    arg_max(f, (a, r)) filter (where f is not null) vf, arg_max(e, (a, r)) filter (where e is not null) ve from runs group by entity_id, v)"""
P2_SQL = f"""with {P2_HELD}
select entity_id, t historical_ticker, strftime(vf, '%Y-%m-%d') valid_from,
  case when lead(v) over w is null then coalesce(strftime(ve, '%Y-%m-%d'), '9999-12-31') else strftime(lead(vf) over w - 1, '%Y-%m-%d') end valid_to
from versions window w as (partition by entity_id order by v)"""
P2_COUNT_SQL = f"with {P2_HELD} select entity_id, count(*) n_versions, cast(sum(n) as bigint) n_snapshots from versions group by 1"


# --- p3: attributes as known at event time


def _as_known(spark: SparkSession, d: str) -> DataFrame:
    """Each delivered (document, entity, event day, available time) with the master record and the link then valid."""
    docs = table(spark, d, "document_manifest").select("document_id", "entity_id", "event_date", "available_time_utc")
    master = table(spark, d, MASTER).where(ticker("historical_ticker").isNotNull())
    # a record begins to hold at its snapshot day; greatest skips nulls
    begins = F.when(F.col("snapshot_date").isNotNull(), F.greatest("snapshot_date", "name_start_date"))
    rank = [F.col("snapshot_date"), F.col("available_time_utc"), F.col("record_id")]
    # written once: the second search reads it several times
    out = cut(locate_versions(docs, master.where("snapshot_date is not null"), "entity_id", "event_date", "available_time_utc", begins, F.col("name_end_date"), F.col("available_time_utc"), rank, "record_id", "record_id"))
    links = table(spark, d, "entity_link_history").where("link_start_date is not null")
    # validity has no recorded time here: one strip
    return locate_versions(out, links, "entity_id", "event_date", None, F.col("link_start_date"), F.col("link_end_date"), None, [F.col("link_confidence"), -F.col("link_id")], "link_id", "link_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the security-master record and the entity link valid on the event day and known by then."""
    return _as_known(spark, d).where("record_id is not null and link_id is not null").select("document_id", "record_id", "link_id").distinct()


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Number of documents by which partner is missing."""
    side = F.when(F.col("record_id").isNull() & F.col("link_id").isNull(), "both").when(F.col("record_id").isNull(), "record").when(F.col("link_id").isNull(), "link").otherwise("none")
    return _as_known(spark, d).groupBy(side.alias("missing")).agg(F.countDistinct("document_id").alias("n_documents"))


P3_JOINED = f"""
docs as (select distinct document_id, entity_id, event_date, available_time_utc from document_manifest),
m as (select d.*, arg_max(m.record_id, (m.snapshot_date, m.available_time_utc, m.record_id)) record_id from docs d left join
  (select * from {MASTER} where regexp_replace(historical_ticker, '[\\s\\p{{Z}}]+', '', 'g') <> '') m
  on m.entity_id = d.entity_id and m.available_time_utc <= d.available_time_utc and m.snapshot_date <= d.event_date
  and coalesce(m.name_start_date, date '0001-01-01') <= d.event_date and coalesce(m.name_end_date, date '9999-12-31') >= d.event_date group by all),
x as (select m.*, arg_max(l.link_id, (l.link_confidence, -l.link_id)) link_id from m left join entity_link_history l
  on l.entity_id = m.entity_id and l.link_start_date <= m.event_date and coalesce(l.link_end_date, date '9999-12-31') >= m.event_date group by all)"""
P3_SQL = f"with {P3_JOINED} select distinct document_id, record_id, link_id from x where record_id is not null and link_id is not null"
P3_UNMATCHED_SQL = f"""with {P3_JOINED} select case when record_id is null and link_id is null then 'both' when record_id is null then 'record' when link_id is null then 'link' else 'none' end missing,
count(distinct document_id) n_documents from x group by 1"""


# --- p4: irregular readings onto a regular grid


def _grid(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "prices").select(ticker("ticker").alias("ticker"), "date", "adj_close", "received_at", "row_id")
    # NaN is larger than any number in Spark's order, so it is excluded by name; infinity is no number to use either
    usable = p.where((F.col("adj_close") > 0) & ~F.isnan("adj_close") & (F.col("adj_close") < float("inf")))
    return to_grid(usable, table(spark, d, "market_sessions"), "ticker", "date", "adj_close", [F.col("received_at"), F.col("row_id")], "session_date", max_gap=5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions between a ticker's first and last usable reading that have none."""
    return _grid(spark, d).where("status <> 'read'").select("ticker", _day(F.col("session")).alias("session_date"))


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole regular series: one row per ticker and session, gaps of up to five sessions interpolated, longer ones marked."""
    return _grid(spark, d).select("ticker", _day(F.col("session")).alias("session_date"), F.round("value", 6).alias("value"), "status", F.col("gap").cast("int").alias("gap"))


P4_BASE = """
cal as (select session_date s, row_number() over (order by session_date) - 1 i from (select distinct session_date from market_sessions)),
r as (select t, i, arg_max(adj_close, (received_at, row_id)) v from
  (select *, upper(regexp_replace(ticker, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) t from prices) join cal on s = date
  where adj_close > 0 and not isnan(adj_close) and not isinf(adj_close) and t <> '' group by 1, 2),
p as (select *, lead(i) over w i2, lead(v) over w v2 from r window w as (partition by t order by i))"""
P4_SQL = f"with {P4_BASE} select t ticker, strftime(s, '%Y-%m-%d') session_date from p join cal on cal.i > p.i and cal.i < p.i2"
P4_GRID_SQL = f"""with {P4_BASE} select t ticker, strftime(s, '%Y-%m-%d') session_date, round(case when cal.i = p.i then v when i2 - p.i - 1 <= 5 then v + (v2 - v) * (cal.i - p.i) / (i2 - p.i) end, 6) "value",
case when cal.i = p.i then 'read' when i2 - p.i - 1 <= 5 then 'interpolated' else 'missing' end status, cast(case when cal.i = p.i then 0 else i2 - p.i - 1 end as int) gap
from p join cal on cal.i >= p.i and (cal.i < p.i2 or cal.i = p.i)"""


# --- p5: differences between two copies

PRICE_FIELDS = ("open", "high", "low", "close", "closeadj")


def day_text(c: Column) -> Column:
    """Calendar day of a date text as written: ISO with or without a time, eight digits, month/day/year or day.month.year."""
    s = squeeze(c)
    part = lambda pattern, y, m, d: F.try_to_date(F.format_string("%s-%s-%s", *[F.lpad(F.regexp_extract(s, pattern, k), n, "0") for k, n in ((y, 4), (m, 2), (d, 2))]), "yyyy-MM-dd")
    forms = [(r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[Tt ].*)?$", 1, 2, 3), (r"^(\d{4})(\d{2})(\d{2})(?:[Tt ]?\d.*)?$", 1, 2, 3), (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:[Tt ].*)?$", 3, 1, 2), (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:[Tt ].*)?$", 3, 2, 1)]
    return reduce(lambda rest, f: F.when(s.rlike(f[0]), part(*f)).otherwise(rest), reversed(forms), F.lit(None).cast("date"))


def _copy(df: DataFrame, day: Column) -> DataFrame:
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + 0.0).alias(c)
    rows = df.select(ticker("ticker").alias("ticker"), day.alias("date"), *[number(c) for c in PRICE_FIELDS], number("volume"), F.lower(strip("source")).alias("source"), "loaded_at")
    return latest_rows(rows, ["ticker", "date"], [*PRICE_FIELDS, "volume", "source"], "loaded_at")


def _vendor_diff(spark: SparkSession, d: str) -> DataFrame:
    apart = relative_apart(1e-6)
    fields = {**dict.fromkeys(PRICE_FIELDS, apart), "volume": unequal, "source": unequal}
    primary, copy = _copy(table(spark, d, "vendor_prices"), F.col("date")), _copy(table(spark, d, "vendor_prices_copy"), day_text(F.col("date")))
    return diff_copies(primary, copy, ["ticker", "date"], fields, "primary", "copy")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Row by row and field by field where the vendor panel and its copy disagree."""
    return _vendor_diff(spark, d).select("ticker", _day(F.col("date")).alias("date"), "finding").distinct()


def p5_summary(spark: SparkSession, d: str) -> DataFrame:
    """Number of findings and of tickers by kind."""
    return _vendor_diff(spark, d).groupBy("finding").agg(F.count("*").alias("n_findings"), F.countDistinct("ticker").alias("n_tickers"))


_NUM = "case when not isnan({0}::double) then {0}::double end {0}"
_SIDE = "(select * from (select *, row_number() over (partition by ticker, date order by loaded_at desc nulls last, open desc nulls last, high desc nulls last, low desc nulls last, close desc nulls last, closeadj desc nulls last, volume desc nulls last, source desc nulls last) k from (select upper(regexp_replace(ticker, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) ticker, {1} date, {2}, lower(regexp_replace(source, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) source, loaded_at from {0}) where ticker <> '' and date is not null) where k = 1)"
_NUMS = ", ".join(_NUM.format(c) for c in (*PRICE_FIELDS, "volume"))
_DAY = "case when regexp_matches(date, '^\\d\\d/') then try_strptime(left(date, 10), '%m/%d/%Y')::date when regexp_matches(date, '^\\d{8}') then try_strptime(left(date, 8), '%Y%m%d')::date else try_cast(left(date, 10) as date) end"
_FIELD = "select ticker, date, '{0}' finding from j where lt is not null and rt is not null and {0}_l is distinct from {0}_r and {1}"
P5_BASE = f"""
l as {_SIDE.format("vendor_prices", "date", _NUMS)}, r as {_SIDE.format("vendor_prices_copy", _DAY, _NUMS)},
j as (select coalesce(l.ticker, r.ticker) ticker, coalesce(l.date, r.date) date, l.ticker lt, r.ticker rt, {", ".join(f"l.{c} {c}_l, r.{c} {c}_r" for c in (*PRICE_FIELDS, "volume", "source"))} from l full join r on l.ticker = r.ticker and l.date = r.date),
f as (select ticker, date, 'missing_in_copy' finding from j where rt is null union all select ticker, date, 'missing_in_primary' from j where lt is null union all
{" union all ".join(_FIELD.format(c, f"({c}_l is null or {c}_r is null or abs({c}_l - {c}_r) > 1e-6 * greatest(abs({c}_l), abs({c}_r)))" if c in PRICE_FIELDS else "true") for c in (*PRICE_FIELDS, "volume", "source"))})"""
P5_SQL = f"with {P5_BASE} select ticker, strftime(date, '%Y-%m-%d') date, finding from f"
P5_SUMMARY_SQL = f"with {P5_BASE} select finding, count(*) n_findings, count(distinct ticker) n_tickers from f group by 1"

QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_versions_per_entity, p3_found, p3_unmatched, p4_found, p4_grid, p5_found, p5_summary)}
ORACLES = {
    "p2_found": P2_SQL, "p2_versions_per_entity": P2_COUNT_SQL, "p3_found": P3_SQL, "p3_unmatched": P3_UNMATCHED_SQL, "p4_found": P4_SQL, "p4_grid": P4_GRID_SQL, "p5_found": P5_SQL, "p5_summary": P5_SUMMARY_SQL,
}

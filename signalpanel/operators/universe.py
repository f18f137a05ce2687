"""Reference data: latest rows, validity intervals, ranks, sessions, quality and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the whole row that comes last in ``order``; by a combinable max, so a hot key is reduced before the shuffle."""
    o = F.struct(*[c.alias(f"_o{k}") for k, c in enumerate(order)])
    rest = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(rest, o).alias("_r")).select(*keys, "_r.*")


def first_in_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def valid_on(events: DataFrame, intervals: DataFrame, key: str, day: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Every interval of the key that holds the event's day, inclusive; a null end is open. An equality join with a range filter."""
    iv = intervals.select(key, F.col(start).alias("_s"), F.coalesce(F.col(end), F.lit("9999-12-31").cast("date")).alias("_e"), *values).distinct()
    return events.join(iv, key).where((F.col(day) >= F.col("_s")) & (F.col(day) <= F.col("_e"))).drop("_s", "_e")


def next_session(days: DataFrame, sessions: DataFrame, day: str, session: str, within: int = 14) -> DataFrame:
    """``days`` with next_session: the first session on or after the day, within so many days; null if there is none.

    A calendar of sessions is a small reference table: it is exploded to the days before each session and joined by equality.
    """
    s = sessions.select(F.col(session).cast("date").alias("_s")).distinct()
    prev = s.select("_s", F.lag("_s").over(Window.orderBy("_s")).alias("_p"))
    first = F.greatest(F.coalesce(F.date_add("_p", 1), F.date_sub("_s", within)), F.date_sub("_s", within))
    table = prev.select(F.col("_s").alias("next_session"), F.explode(F.sequence(first, F.col("_s"))).alias(day))
    return days.join(F.broadcast(table), day, "left")


def resolve_event_day(events: DataFrame, sessions: DataFrame, instant: str, zone: str = "America/New_York") -> DataFrame:
    """local_day and resolved_day: the local day if it is a session and the time is not after its close (16:00, early 13:00), else the next session."""
    local = F.from_utc_timestamp(F.col(instant), zone)
    e = events.withColumns({"local_day": F.to_date(local), "_t": F.hour(local) * 60 + F.minute(local) + F.second(local) / 60.0})
    cal = sessions.groupBy(F.col("session_date").alias("local_day")).agg(F.max(F.when(F.col("is_early_close"), 780).otherwise(960)).alias("_close"))
    e = e.join(F.broadcast(cal), "local_day", "left")
    e = e.withColumn("_from", F.when(F.col("_t") <= F.col("_close"), F.col("local_day")).otherwise(F.date_add("local_day", 1)))
    return next_session(e, sessions, "_from", "session_date").drop("_from", "_t", "_close").withColumnRenamed("next_session", "resolved_day")


def universe_quality(master: DataFrame) -> DataFrame:
    """Counts over a security master in one pass: rows, entities, missing fields, inverted intervals, duplicates."""
    c = lambda cond, name: F.sum(F.coalesce(cond, F.lit(False)).cast("long")).alias(name)
    dup = master.groupBy("record_id").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n_repeated"))
    one = master.agg(
        F.count("*").alias("n_rows"), F.countDistinct("entity_id").alias("n_entities"), c(F.col("permno").isNull(), "n_no_permno"), c(F.col("gvkey").isNull(), "n_no_gvkey"), c(F.col("gics_industry").isNull(), "n_no_industry"),
        c(F.trim("historical_ticker").isNull() | (F.trim("historical_ticker") == ""), "n_no_ticker"), c(F.col("name_end_date") < F.col("name_start_date"), "n_inverted"), c(F.to_date("available_time_utc") > F.date_add("snapshot_date", 60), "n_late"),
    )
    return one.join(dup, how="cross")  # one row each


def duplicates(df: DataFrame, value: str, of: str) -> DataFrame:
    """value, n: values that more than one distinct ``of`` has, nulls and blanks apart. Each once, whatever their number."""
    named = df.where(F.trim(F.col(value).cast("string")) != "")
    return named.groupBy(F.col(value).alias("value")).agg(F.countDistinct(of).alias("n")).where("n > 1")


def universe_findings(master: DataFrame, links: DataFrame, least_confidence: float = 0.8) -> DataFrame:
    """finding, severity, n: blockers and warnings of a security master and its entity links, with the number of rows or entities behind each; only those that hold.

    Blockers: entities without a link, inverted name periods, overlapping record ids (one id, different rows). Warnings: links of low or no confidence, rows
    published before their snapshot, entities without industry, tickers of several entities. Empty tables have no findings.
    """
    entities = master.where("entity_id is not null").groupBy("entity_id").agg(F.max(F.col("gics_industry").isNotNull()).alias("has_industry"))
    unlinked = entities.join(links.select("entity_id").distinct(), "entity_id", "left_anti").agg(F.count("*").alias("n"))
    ids = master.distinct().groupBy("record_id").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    tickers = duplicates(master.withColumn("_t", F.upper(F.trim("historical_ticker"))), "_t", "entity_id").agg(F.count("*").alias("n"))
    if_so = lambda df, cond: df.agg(F.count_if(F.coalesce(cond, F.lit(False))).alias("n"))
    found = [
        ("entity_without_link", "blocker", unlinked), ("inverted_name_period", "blocker", if_so(master, F.col("name_end_date") < F.col("name_start_date"))), ("reused_record_id", "blocker", ids),
        ("low_confidence_link", "warning", links.agg(F.count_if(F.coalesce(F.col("link_confidence") < least_confidence, F.lit(True))).alias("n"))),
        ("published_before_snapshot", "warning", if_so(master, F.to_date("available_time_utc") < F.col("snapshot_date"))), ("entity_without_industry", "warning", if_so(entities, ~F.col("has_industry"))), ("shared_ticker", "warning", tickers),
    ]
    out = None
    for name, severity, one in found:
        row = one.select(F.lit(name).alias("finding"), F.lit(severity).alias("severity"), "n")
        out = row if out is None else out.unionByName(row)
    return out.where("n > 0")


def coverage_waterfall(expected: DataFrame, predicted: DataFrame, eligible: DataFrame, keys: list[str]) -> DataFrame:
    """One row: counts of eligible, expected, predicted rows and their ratios (0 on an empty denominator)."""
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    e = expected.select(*keys).distinct().join(p, keys, "left").agg(F.count("*").alias("n_expected"), F.coalesce(F.sum("_p"), F.lit(0)).alias("n_predicted"))
    n = eligible.agg(F.count("*").alias("n_eligible"))
    r = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return e.join(n, how="cross").withColumns({"expected_ratio": r("n_predicted", "n_expected"), "eligible_ratio": r("n_predicted", "n_eligible")})


def audit(checks: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """check_id, status, observed: each check is an aggregate of one row; fail and warn are conditions over its columns."""
    out = None
    for name, one, fail, warn in checks:
        row = one.select(F.lit(name).alias("check_id"), F.when(fail, "fail").when(warn, "warn").otherwise("pass").alias("status"), F.to_json(F.struct(*one.columns)).alias("observed"))
        out = row if out is None else out.unionByName(row)
    return out


def overall_status(report: DataFrame) -> DataFrame:
    """fail before warn before pass."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return report.agg(F.when(n("fail") > 0, "fail").when(n("warn") > 0, "warn").otherwise("pass").alias("status"), n("fail").alias("n_fail"), n("warn").alias("n_warn"), n("pass").alias("n_pass"))

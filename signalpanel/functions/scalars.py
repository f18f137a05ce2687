"""Scalar projections: identifiers, codes, dates, predicates. Pure Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_of_label(label_id: Column) -> Column:
    """All but the last two ``:`` parts; null if there are fewer than three."""
    return F.nullif(F.regexp_extract(label_id, r"^(.*):[^:]*:[^:]*$", 1), F.lit(""))


def model_part(model_id: Column, k: int) -> Column:
    """k-th ``::`` part, null if absent."""
    return F.get(F.split(model_id, "::"), F.lit(k))


def all_splits_id(model_id: Column, target: Column) -> Column:
    return F.concat_ws("::", model_part(model_id, 0), target, F.lit("ALL_SPLITS"))


def label_window(target: Column) -> Column:
    """``start_end`` suffix of a target, else ``unspecified``."""
    w = F.regexp_extract(target, r"_(\d+_\d+)$", 1)
    return F.when(w != "", w).otherwise("unspecified")


def is_volatility(target: Column) -> Column:
    t = F.lower(target)
    return t.contains("volatility") | t.startswith("realized_vol")


def role_or_test(role: Column) -> Column:
    return F.coalesce(F.nullif(role, F.lit("")), F.lit("test"))


def cik10(cik: Column) -> Column:
    """Digits only, zero-padded to ten; null without digits or with more than ten."""
    digits = F.regexp_replace(F.trim(cik), r"[^0-9]", "")
    return F.when(F.length(digits).between(1, 10), F.lpad(digits, 10, "0"))


def cik_short(cik: Column) -> Column:
    return F.nullif(F.regexp_replace(cik10(cik), "^0+", ""), F.lit(""))


def acceptance_to_utc(text: Column) -> Column:
    """``yyyyMMddHHmmss`` in New York wall time, or ISO text with a T already in UTC, as an instant; null if neither."""
    local = F.to_utc_timestamp(F.try_to_timestamp(F.when(text.rlike(r"^\d{14}$"), text), F.lit("yyyyMMddHHmmss")), "America/New_York")
    iso = F.try_to_timestamp(F.when(text.contains("T"), text))
    return F.coalesce(local, iso)


def fiscal_year(report_date: Column, filing_date: Column | None = None) -> Column:
    """Year of the report date, the previous one for 1 to 7 January; of the filing date where there is no report date."""
    d = F.coalesce(report_date, filing_date) if filing_date is not None else report_date
    return F.when((F.month(d) == 1) & (F.dayofmonth(d) <= 7), F.year(d) - 1).otherwise(F.year(d))


def is_annual_form(form: Column, amendments: bool = False) -> Column:
    return F.upper(F.trim(form)).isin(*(["10-K", "10-K/A"] if amendments else ["10-K"]))


def scale_guard(ratio: Column) -> Column:
    return F.when(ratio >= 1000, "fail").when(ratio >= 100, "warn").otherwise("pass")


def positive_number(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when((v > 0) & ~F.isnan(v), v)


def is_estimated_cap(flag: Column) -> Column:
    return F.coalesce(F.lower(flag).rlike("not_crsp|estimate|proxy"), F.lit(False))

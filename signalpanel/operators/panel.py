"""Price panels, forward windows, labels and expanding splits with purging.

Positions in a ticker's own series are row numbers over (ticker, date); a forward window is then one shuffle on the ticker and a window
frame, never a scan of the panel for each event.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """Numeric value or null: texts that aren't numbers don't raise."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("double")


def build_panel(frame: DataFrame, price_field: str) -> DataFrame:
    """ticker (upper case, trimmed), date, price and the optional return and delisting columns that the frame has."""
    optional = [c for c in ("simple_return", "log_return", "ret", "retx", "dlret", "delisting_return", "dlstcd", "delisting_code") if c in frame.columns]
    return frame.select(F.upper(F.trim(F.col("ticker").cast("string"))).alias("ticker"), F.col("date").cast("date").alias("date"), number(price_field).alias("price"), *optional)


def duplicate_keys(panel: DataFrame) -> DataFrame:
    """(ticker, date) that occur more than once, with their count; a panel is valid if there are none."""
    return panel.groupBy("ticker", "date").agg(F.count("*").alias("n")).where("n > 1")


def base_returns(panel: DataFrame) -> DataFrame:
    """Adds simple_return and log_return: a given simple return, else a given ret, else the price over the ticker's previous one, less 1.

    log_return is null where the simple one is null or at most -1.
    """
    given = next((c for c in ("simple_return", "ret") if c in panel.columns), None)
    prev = F.lag("price").over(Window.partitionBy("ticker").orderBy("date"))
    r = number(given) if given else F.try_divide(F.col("price"), prev) - 1
    return panel.withColumn("simple_return", r).withColumn("log_return", F.when(F.col("simple_return") > -1, F.log1p("simple_return")))


def delisting_returns(panel: DataFrame) -> DataFrame:
    """Compounds a delisting return into the day's: (1 + r)(1 + d) - 1, d alone without r; flags codes that lack a return.

    Adds delisting_flag: ``applied``, ``missing`` or null, and delisting_code_used.
    """
    have = lambda names: F.coalesce(*[number(c) if "code" not in c and c != "dlstcd" else F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in panel.columns], F.lit(None))
    d, code = have(["dlret", "delisting_return"]).cast("double"), have(["dlstcd", "delisting_code"]).cast("string")
    r = F.col("simple_return")
    out = F.when(d.isNull(), r).when(r.isNull(), d).otherwise((1 + r) * (1 + d) - 1)
    flag = F.when(d.isNotNull(), "applied").when(code.isNotNull(), "missing")
    p = panel.withColumns({"simple_return": out, "delisting_flag": flag, "delisting_code_used": code})
    return p.withColumn("log_return", F.when(F.col("simple_return") > -1, F.log1p("simple_return")))


def positions(panel: DataFrame) -> DataFrame:
    """pos: 1-based number of a row in its ticker's series."""
    return panel.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))


def first_position_after(events: DataFrame, panel: DataFrame, keep: list[str]) -> DataFrame:
    """Each event with p: the position of its ticker's first row after the event date (one past the end if there is none).

    Events and rows of a ticker are merged in one sorted pass: the number of rows up to the date, plus one.
    """
    rows = panel.select("ticker", F.col("date").alias("_d"), F.lit(0).alias("_kind"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in keep])
    ev = events.select("ticker", F.col("event_date").alias("_d"), F.lit(1).alias("_kind"), *keep)
    w = Window.partitionBy("ticker").orderBy("_d", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = rows.unionByName(ev).withColumn("p", F.sum(1 - F.col("_kind")).over(w) + 1)
    return merged.where("_kind = 1").drop("_kind").withColumnRenamed("_d", "event_date")


def forward_windows(events: DataFrame, panel: DataFrame, keep: list[str], start: int, end: int, return_field: str = "log_return") -> DataFrame:
    """Each event with its ticker's rows start..end after the event date: n_rows, window_start, window_end, total, volatility (sample).

    total and volatility are over the returns present. As the window is relative to a position, it is an equality join of the position
    with one frame per row of the panel, not a range join.
    """
    ahead = Window.partitionBy("ticker").orderBy("pos").rowsBetween(0, end - start)
    frames = positions(panel).select(
        "ticker", "pos", F.count("*").over(ahead).alias("n_rows"), F.count(return_field).over(ahead).alias("n_returns"), F.min("date").over(ahead).alias("window_start"), F.max("date").over(ahead).alias("window_end"),
        F.sum(return_field).over(ahead).alias("total"), F.stddev_samp(return_field).over(ahead).alias("volatility"),
    )
    at = first_position_after(events, panel, keep).withColumn("pos", F.col("p") + start - 1)
    return at.join(frames, ["ticker", "pos"], "left").select("ticker", "event_date", *keep, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_returns", F.lit(0)).alias("n_returns"), "window_start", "window_end", "total", "volatility")


def parse_target(c: Column) -> dict[str, Column]:
    """kind, start, end of a target such as ``CAR_1_20`` or ``realized_volatility_1_20``; null unless 1 <= start <= end."""
    pattern = r"^(CAR|realized_volatility|annualized_volatility)_(\d+)_(\d+)$"
    a, b = F.regexp_extract(c, pattern, 2).try_cast("int"), F.regexp_extract(c, pattern, 3).try_cast("int")
    ok = (a >= 1) & (b >= a)
    return {"kind": F.when(ok, F.regexp_extract(c, pattern, 1)), "start": F.when(ok, a), "end": F.when(ok, b)}


def build_labels(events: DataFrame, panel: DataFrame, benchmark: int | str, start: int, end: int, kinds: list[str], keep: list[str]) -> DataFrame:
    """kind, label_value and failure for each event and kind: CAR (sum less the benchmark's sum over its own rows), realized_volatility or another kind, which is volatility by year.

    failure: ``insufficient_window`` (fewer rows than asked for), ``missing_return`` (a CAR's or all of a volatility's returns missing), ``insufficient_benchmark``.
    All kinds share one computation of the windows.
    """
    size = end - start + 1
    own = forward_windows(events, panel, keep, start, end)
    days = events.select("event_date").distinct().withColumn("ticker", F.lit(benchmark))
    if "CAR" in kinds:
        bench = forward_windows(days, panel.where(F.col("ticker") == benchmark), [], start, end).select("event_date", F.col("n_rows").alias("_bn"), F.col("total").alias("_bt"))
        own = own.join(bench, "event_date", "left")

    def one(kind: str) -> Column:
        fail = F.when(F.col("n_rows") < size, "insufficient_window")
        if kind == "CAR":
            fail = fail.when(F.col("n_returns") < size, "missing_return").when(F.coalesce("_bn", F.lit(0)) < size, "insufficient_benchmark")
            value = F.col("total") - F.col("_bt")
        else:
            fail = fail.when(F.col("n_returns") < 2, "missing_return")
            value = F.col("volatility") * (F.lit(1.0) if kind == "realized_volatility" else F.sqrt(F.lit(252.0)))
        return F.struct(F.lit(kind).alias("kind"), fail.alias("failure"), F.when(fail.isNull(), value).alias("label_value"))

    return own.select("*", F.inline(F.array(*[one(k) for k in kinds]))).drop("_bn", "_bt")


def expanding_windows(spark: SparkSession, first: int, last: int, train: int, validation: int, test: int, sample_end: date | None = None) -> DataFrame:
    """Yearly windows with a fixed train start: split_id, train_start..test_end. The last test end is clipped to ``sample_end``. A few rows."""
    rows, year = [], first + train + validation
    while year + test - 1 <= last:
        end = date(year + test - 1, 12, 31)
        rows.append((f"test_{year}", date(first, 1, 1), date(year - validation - 1, 12, 31), date(year - validation, 1, 1), date(year - 1, 12, 31), date(year, 1, 1), min(end, sample_end) if sample_end else end))
        year += test
    return spark.createDataFrame(rows, "split_id string, train_start date, train_end date, validation_start date, validation_end date, test_start date, test_end date")


def assign_splits(labels: DataFrame, windows: DataFrame, embargo_days: int) -> DataFrame:
    """Labels x windows that hold them: role and leakage status.

    Train labels that end at or after the validation start less the embargo (calendar days) are ``purged``, as are validation labels against the test
    start; a label that starts on or before its event date is ``fail``; others ``pass``. Windows are few, so they are broadcast.
    """
    d = F.col("event_date")
    role = F.when(d.between(F.col("train_start"), F.col("train_end")), "train").when(d.between(F.col("validation_start"), F.col("validation_end")), "validation").when(d.between(F.col("test_start"), F.col("test_end")), "test")
    boundary = F.when(F.col("role") == "train", F.col("validation_start")).when(F.col("role") == "validation", F.col("test_start"))
    status = F.when(F.col("window_start") <= d, "fail").when(F.col("window_end") >= F.date_sub(boundary, embargo_days), "purged").otherwise("pass")
    return labels.join(F.broadcast(windows), how="cross").withColumn("role", role).where("role is not null").withColumn("status", status).drop(*[c for c in windows.columns if c != "split_id"])


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], max_age_days: int | None = None, order: str | None = None) -> DataFrame:
    """Left rows with the latest right row of the key at or before their time, within ``max_age_days``; ties by ``order``, last wins.

    Both sides are merged in one sorted pass per key: the last non-null struct so far is the match.
    """
    pack = F.struct(F.col(right_time).alias("_t"), *values)
    r = right.select(key, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), pack.alias("_m"), *([F.col(order).alias("_o")] if order else [F.lit(0).alias("_o")]))
    cols = [c for c in left.columns if c != key]
    le = left.select(key, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.struct(*cols).alias("_l"))
    both = r.withColumn("_l", F.lit(None).cast(le.schema["_l"].dataType)).unionByName(le.withColumns({"_m": F.lit(None).cast(r.schema["_m"].dataType), "_o": F.lit(None).cast(r.schema["_o"].dataType)}))
    w = Window.partitionBy(key).orderBy("_at", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.lit(True) if max_age_days is None else F.datediff("_at", F.col("_m._t")) <= max_age_days
    return out.select(key, "_l.*", *[F.when(fresh, F.col("_m")[v]).alias(v) for v in values])


def asof_with_fallback(rows: DataFrame, keys: list[str], time: str, at: Column, value: str) -> Column:
    """Aggregate: the last value at or before ``at``, else the first one."""
    t, v = F.col(time), F.col(value)
    return F.coalesce(F.max_by(v, F.when(t <= at, t)), F.min_by(v, t))


def month_ends(panel: DataFrame) -> DataFrame:
    """rebalance: the last price date of each month, with month (its first day)."""
    return panel.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("rebalance"))


def expiring_signals(signals: DataFrame, key: str, day: str, order: str, rebalances: DataFrame, max_age_days: int = 370) -> DataFrame:
    """For each rebalance and key the latest signal of at most ``max_age_days``; of several on a day the last by ``order``.

    A signal holds from its day to the next one's or its expiry, so it is exploded only to the months of that span (at most 14) and meets the
    month's rebalance by equality: no pairing of all dates with all keys.
    """
    w = Window.partitionBy(key).orderBy(day, order)
    s = signals.withColumn("_next", F.lead(day).over(w)).withColumn("_until", F.least(F.date_add(day, max_age_days), F.coalesce(F.date_sub("_next", 1), F.lit("9999-12-31").cast("date"))))
    s = s.where(F.col("_until") >= F.col(day)).withColumn("month", F.explode(F.sequence(F.trunc(day, "month"), F.trunc("_until", "month"), F.expr("interval 1 month"))))
    return s.join(F.broadcast(rebalances), "month").where((F.col("rebalance") >= F.col(day)) & (F.col("rebalance") <= F.col("_until"))).drop("_next", "_until", "month")

"""Irregular readings onto a regular grid of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_index(sessions: DataFrame, day: str) -> DataFrame:
    """Distinct non-null sessions in order: session (DATE), idx from 0. A calendar is small (days); one task numbers it."""
    d = sessions.select(F.col(f"`{day}`").cast("date").alias("session")).where("session is not null").distinct()
    return d.select("session", (F.row_number().over(Window.orderBy("session")) - 1).alias("idx"))


def to_grid(
    readings: DataFrame, sessions: DataFrame, key: str, day: str, value: str, order: list[Column], session_day: str, max_gap: int | None = None, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """One row for each key and session from the key's first to its last reading: key, session, value, status, gap.

    Of several readings of a session the one of highest ``order`` stands. status is ``read``; or for a session without reading
    ``interpolated`` (linear in sessions between the neighbours) if its gap has at most ``max_gap`` sessions (None: any), else
    ``missing`` with a null value. gap is the number of consecutive sessions without reading, 0 for read ones. With ``start`` or
    ``end`` (DATE literals) series are extended to these boundaries by rows of
    status ``before`` and ``after``, value null.

    Method: lead pairs consecutive readings; only grid times between the two of a pair are exploded, and filled or marked inline by
    the gap's length. Readings with a null key, day or value, or on days without session, must be filtered out or are ignored here.
    Repeated readings collapse by a combinable max first, so a key read many times a day costs no more than others, and no key has
    more rows than there are sessions. Empty input gives no rows; extra columns are ignored. The calendar is broadcast: it has one
    row per session day, whatever the readings' number.
    """
    cal = F.broadcast(session_index(sessions, session_day))
    v = F.col(f"`{value}`").cast("double")
    r = readings.select(F.col(f"`{key}`").alias("k"), F.col(f"`{day}`").cast("date").alias("session"), F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], v.alias("v")).alias("x")).where("k is not null and x.v is not null")
    r = r.join(cal, "session").groupBy("k", "idx").agg(F.max("x")["v"].alias("v"))
    w = Window.partitionBy("k").orderBy("idx")
    pairs = r.select("k", "idx", "v", F.lead("idx").over(w).alias("idx2"), F.lead("v").over(w).alias("v2"), F.lag("idx").over(w).alias("idx0"))
    gap = F.coalesce(F.col("idx2") - F.col("idx") - 1, F.lit(0))
    fill = (F.lit(True) if max_gap is None else gap <= max_gap)
    at = F.sequence(F.lit(0), gap)
    rows = F.transform(
        at,
        lambda i: F.struct(
            (F.col("idx") + i).alias("idx"),
            F.when(i == 0, F.col("v")).when(fill, F.col("v") + (F.col("v2") - F.col("v")) * i / (gap + 1)).alias("value"),
            F.when(i == 0, "read").when(fill, "interpolated").otherwise("missing").alias("status"), F.when(i == 0, 0).otherwise(gap).alias("gap"),
        ),
    )
    if start is not None or end is not None:
        edges = session_index(sessions, session_day).agg(
            F.min(F.when(F.col("session") >= start, F.col("idx")) if start is not None else F.lit(None).cast("int")).alias("lo"),
            F.max(F.when(F.col("session") <= end, F.col("idx")) if end is not None else F.lit(None).cast("int")).alias("hi"),
        )
        pairs = pairs.join(F.broadcast(edges), how="cross")  # one row
        mark = lambda status: lambda i: F.struct(i.alias("idx"), F.lit(None).cast("double").alias("value"), F.lit(status).alias("status"), F.lit(0).alias("gap"))
        none = F.array().cast("array<int>")
        before = F.when(F.col("idx0").isNull() & (F.col("lo") < F.col("idx")), F.sequence(F.col("lo"), F.col("idx") - 1)).otherwise(none)
        after = F.when(F.col("idx2").isNull() & (F.col("hi") > F.col("idx")), F.sequence(F.col("idx") + 1, F.col("hi"))).otherwise(none)
        rows = F.concat(F.transform(before, mark("before")), rows, F.transform(after, mark("after")))
    out = pairs.select("k", F.inline(rows))
    return out.join(cal, "idx").select(F.col("k").alias(key), "session", "value", "status", "gap")

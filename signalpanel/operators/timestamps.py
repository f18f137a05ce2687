"""Mixed timestamp texts to one exact UTC instant.

Texts are parsed to wall-clock fields by regular expressions in the JVM; wall times are then as-of joined to the exploded
zone-offset intervals of :mod:`signalpanel.operators.zones`. Two matching intervals mean the wall time occurred twice
(``ambiguous``; the first occurrence is taken), none means it was skipped (``nonexistent``; the offset in force before the
change is taken), one gives the offset directly (``unique``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalpanel.functions.text import squeeze
from signalpanel.operators.zones import PERIOD, table_year, zone_names, zone_periods

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?([aApP]\.?[mM]\.?(?![A-Za-z]))? ?(.*)"
_MONTH = r"([A-Za-z]{3,9})\.?"
#: (pattern, order of the groups as year, month, day, hour, minute, second, fraction, am/pm, zone; 0: absent)
_FORMATS: list[tuple[str, tuple[int, ...]]] = [
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[Tt]| |, )? ?{_TIME}$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)? ?(.*)$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", (1, 2, 3, 4, 5, 6, 0, 0, 0)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?[ Tt] ?{_TIME}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?[ Tt] ?{_TIME}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"^(?:[A-Za-z]{{3,9}}\.?,? )?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}}),?[ Tt] ?{_TIME}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"^(?:[A-Za-z]{{3,9}}\.?, )?{_MONTH} (\d{{1,2}}),? (\d{{4}}),?(?: at)? {_TIME}$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
]
#: Hours east of UTC of the zone letters that a time may carry.
LETTERS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "akst": -9, "akdt": -8, "hst": -10,
    "ast": -4, "adt": -3, "bst": 1, "ist": 5.5, "cet": 1, "cest": 2, "mez": 1, "mesz": 2, "west": 1, "eet": 2, "eest": 3, "msk": 3, "jst": 9, "kst": 9, "hkt": 8, "sgt": 8,
    "aest": 10, "aedt": 11, "acst": 9.5, "acdt": 10.5, "awst": 8, "nzst": 12, "nzdt": 13,
}
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_OFFSET = r"^(?:utc|gmt|ut|etc/gmt(?=:))? ?([+-−])(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?(?: ?\[.*\])?$"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _offset_parts(zone: Column) -> Column:
    """Sign, hours, minutes and seconds of a numeric offset (``-05:00``, ``UTC+1``, ``GMT-0500``) in lower case; null if it is none."""
    return F.when(zone.rlike(_OFFSET), F.split(F.regexp_replace(zone, _OFFSET, "$1|$2|$3|$4"), r"\|"))


def _offset_seconds(parts: Column) -> Column:
    """Seconds east of UTC of an offset's parts; null if it is impossible."""
    n = lambda k: F.coalesce(_int(F.get(parts, F.lit(k))), F.lit(0))
    size = n(1) * 3600 + n(2) * 60 + n(3)
    return F.when(parts.isNotNull() & (size <= 64800) & (n(2) < 60), F.when(F.get(parts, F.lit(0)) == "+", size).otherwise(-size))


def parse_fields(s: Column) -> Column:
    """Texts of year, month, day, hour, minute, second, fraction, am/pm mark and zone of a squeezed timestamp text; null where it has none of the known forms."""
    fields = F.lit(None).cast("array<string>")
    for pattern, order in reversed(_FORMATS):
        fields = F.when(s.rlike(pattern), F.split(F.regexp_replace(s, pattern, "|".join(f"${k}" if k else "" for k in order)), r"\|")).otherwise(fields)
    return fields


def epoch_us(s: Column) -> Column:
    """Instant of an epoch number (10 digits seconds, 13 milli-, 16 microseconds); null for other texts."""
    scale = F.when(F.length(s) == 10, 1_000_000).when(F.length(s) == 13, 1_000).otherwise(1)
    return F.when(s.rlike(r"^(\d{10}|\d{13}|\d{16})$"), s.try_cast("long") * scale)


def _with_wall(d: DataFrame, f: str, p: str) -> DataFrame:
    """``d`` with local seconds, microseconds and zone text of the split fields ``f``; seconds are null if the date or time is impossible.

    In small steps: each becomes a method of its own in the generated code, short enough to be compiled.
    """
    g = lambda k: F.get(F.col(f), F.lit(k))
    c = lambda n: F.col(p + n)
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(g(1), 1, 3)))
    d = d.withColumns({p + "y": _int(g(0)), p + "m": _int(g(1)), p + "at": F.when(F.length(g(1)) >= 3, at), p + "d": _int(g(2))})
    d = d.withColumns({p + "h": _int(g(3)), p + "mi": _int(g(4)), p + "se": F.coalesce(_int(F.nullif(g(5), F.lit(""))), F.lit(0)), p + "half": F.lower(F.substring(g(7), 1, 1))})
    d = d.withColumns({p + "frac": F.coalesce(_int(F.substring(F.rpad(g(6), 6, "0"), 1, 6)), F.lit(0)), p + "own": F.coalesce(F.lower(F.trim(g(8))), F.lit(""))})
    month = F.coalesce(c("m"), F.when((c("at") > 0) & (c("at") % 3 == 1), F.expr(f"({p}at + 2) div 3").cast("int")))
    hour = F.when(c("half") == "", F.when(c("h") < 24, c("h"))).when(c("h").between(1, 12), c("h") % 12 + F.when(c("half") == "p", 12).otherwise(0))
    d = d.withColumns({p + "mo": month, p + "ho": hour})
    leap = ((c("y") % 4 == 0) & (c("y") % 100 != 0)) | (c("y") % 400 == 0)
    days = F.when(c("mo") == 2, F.when(leap, 29).otherwise(28)).when(c("mo").isin(4, 6, 9, 11), 30).otherwise(31)
    ok = c("y").between(1, 9999) & c("mo").between(1, 12) & (c("d") >= 1) & (c("d") <= days) & (c("mi") < 60) & (c("se") < 60)
    d = d.withColumn(p + "day", F.when(ok, F.unix_date(F.make_date(c("y"), c("mo"), c("d"))).cast("long")))
    return d.withColumn(p + "local", c("day") * 86400 + c("ho") * 3600 + c("mi") * 60 + c("se"))


def resolve_instants(df: DataFrame, value: str, zone: str, out: str = "instant_us") -> DataFrame:
    """``df`` with ``out`` (BIGINT microseconds since 1970-01-01 UTC) and ``{out}_match`` for the text column ``value``.

    ``{out}_match``: ``epoch``, ``offset`` (own offset or zone letters), ``unique``, ``ambiguous`` or ``nonexistent``. Wall times
    without a zone of their own are in ``zone``: a region in any usual spelling or a fixed offset; null, blank or ``unknown``
    means UTC. Both are null where the text is null, blank, states no possible date and time, or its zone can't be known.
    All years from 1 to 9999 have their intervals, to the second. Any number of extra columns pass through; columns named like an output are
    replaced. No shuffle: the interval table is of fixed size and broadcast.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in (out, f"{out}_match")]
    p = "__ts_"
    key = lambda c: F.regexp_replace(F.lower(squeeze(c)), r"[_ ]+", " ")
    d = df.select(*keep, squeeze(F.col(f"`{value}`")).alias(p + "s"), F.coalesce(key(F.col(f"`{zone}`")), F.lit("")).alias(p + "row"))
    # parts that are used more than once are columns of their own, no structs, so that they are computed once
    d = d.withColumns({p + "f": parse_fields(F.col(p + "s")), p + "epoch": epoch_us(F.col(p + "s"))})
    d = _with_wall(d, p + "f", p)
    d = d.withColumn(p + "own", F.when(F.col(p + "own").rlike(r"^\[.*\]$"), F.regexp_replace(F.col(p + "own"), r"^\[|\]$", "")).otherwise(F.col(p + "own")))
    letters = F.try_element_at(_map({k: int(v * 3600) for k, v in LETTERS.items()}), F.regexp_replace(F.col(p + "own"), r"[().]", ""))
    d = d.withColumn(p + "parts", _offset_parts(F.col(p + "own")))
    d = d.withColumn(p + "fixed", F.coalesce(letters, _offset_seconds(F.col(p + "parts"))))
    # a region named in the text goes before the row's; otherwise the row's own
    zone_text = F.when(F.col(p + "own") != "", key(F.col(p + "own"))).when(F.col(p + "row").isin("", "unknown", "n/a", "na", "none", "null"), F.lit("utc")).otherwise(F.col(p + "row"))
    d = d.withColumn(p + "zone", F.when(F.col(p + "fixed").isNull() & F.col(p + "local").isNotNull(), zone_text))
    d = d.withColumn(p + "parts", _offset_parts(F.col(p + "zone")))
    d = d.withColumn(p + "zone_s", _offset_seconds(F.col(p + "parts")))
    # years under rules alone are read at a like year: t is the wall time moved there
    d = d.withColumn(p + "year", F.when(F.col(p + "zone").isNotNull() & F.col(p + "zone_s").isNull(), F.col(p + "y")))
    d = d.withColumn(p + "as", table_year(F.col(p + "year")))
    start = lambda c: F.unix_date(F.make_date(c, F.lit(1), F.lit(1))).cast("long") * 86400
    moved = F.when(F.col(p + "year") > F.col(p + "as"), start(F.col(p + "as")) - start(F.col(p + "year"))).otherwise(F.lit(0))
    d = d.withColumns({p + "t": F.col(p + "local") + moved, p + "period": F.floor(F.col(p + "as") / PERIOD).cast("int")})
    # The rows go through a generator of one row each: else the optimizer, looking for partitions to prune by the join's key, would follow the key
    # down through all steps above and write it out in terms of the input, in seconds and at a length that doubles with every step.
    needed = [p + n for n in ("zone", "period", "t", "local", "frac", "fixed", "zone_s", "epoch")]
    d = d.select(*keep, F.inline(F.array(F.struct(*needed))))
    names = zone_names(spark).select(F.col("zone_name").alias(p + "zone"), F.col("zone_id").alias(p + "id"))
    spans = zone_periods(spark).select(F.col("zone_id").alias(p + "id"), F.col("period").alias(p + "period"), F.col("spans").alias(p + "spans"))
    d = d.join(F.broadcast(names), p + "zone", "left").join(F.broadcast(spans), [p + "id", p + "period"], "left")
    t = F.col(p + "t")
    d = d.withColumn(p + "hits", F.filter(F.col(p + "spans"), lambda x: (x["local_from"] <= t) & (t < x["local_to"])))
    before = F.filter(F.col(p + "spans"), lambda x: (x["local_to"] <= t) & (t < x["gap_to"]))
    hits = F.col(p + "hits")
    span_s = F.when(F.size(hits) > 0, F.get(hits, F.lit(0))["offset_s"]).otherwise(F.get(before, F.lit(0))["offset_s"])
    offset = F.coalesce(F.col(p + "fixed"), F.col(p + "zone_s"), span_s)
    epoch, local = F.col(p + "epoch"), F.col(p + "local")
    how = (
        F.when(epoch.isNotNull(), "epoch").when(local.isNull() | offset.isNull(), F.lit(None)).when(F.col(p + "fixed").isNotNull() | F.col(p + "zone_s").isNotNull(), "offset")
        .when(F.size(hits) > 1, "ambiguous").when(F.size(hits) == 1, "unique").otherwise("nonexistent")
    )
    return d.select(*keep, F.coalesce(epoch, (local - offset) * 1_000_000 + F.col(p + "frac")).alias(out), how.alias(f"{out}_match"))

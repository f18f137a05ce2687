"""Attributes as known at event time, by bitemporal rectangles.

A version is valid over a range of days and known from an instant on. Of the versions that are valid and known at a point, the
one of highest rank is current. The plane (valid day x recorded time) of each key is cut into cells of a grid, to which the versions'
rectangles are indexed; in each cell they are split into disjoint regions in each of which one version is current, and every event point
lies in exactly one cell and at most one region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalpanel.session import cut

_DAY_LOW, _DAY_HIGH = -719162, 2932896  # 0001-01-01 and 9999-12-31 as days since 1970
_US_LOW = -(2**62)
#: Days in a cell (a power of two), microseconds of recorded time in a cell, and versions in a cell up to which its regions are listed.
LEVELS = 8
CELL_DAYS, CELL_US, LISTED = 1 << LEVELS, (1 << LEVELS) * 86_400_000_000, 24
#: Versions for which a strip of recorded time of a fuller cell is meant.
PER_STRIP = 1024
_CELL = ["_k", "_dc", "_ac"]


def locate_versions(
    events: DataFrame, versions: DataFrame, key: str, day: str, known_at: str | None, valid_from: Column, valid_to: Column, recorded_from: Column | None, rank: list[Column], payload: str, out: str,
) -> DataFrame:
    """``events`` with ``out``: the ``payload`` of the version of the same ``key`` current at (``day``, ``known_at``), or null.

    valid_from..valid_to are inclusive days (null: no bound), recorded_from the instant from which a version is known (a null one is
    never known; None: always known). Highest ``rank`` wins (columns compared in order, null lowest); further ties go to the larger
    payload. Events whose key, day or known_at is null get null. Repeated versions change nothing; events keep their multiplicity.
    Extra columns pass through; a column named ``out`` is replaced.

    Scale: a version is indexed to the day cells of its rectangle that hold events of its key, and met there with the cells of recorded time.
    Those that cover a cell wholly are reduced to the best one by a combinable max and the others counted before any are gathered. At
    most ``LISTED`` others are listed with the cell as strips of recorded time by days. In a fuller cell every version goes to the nodes of a
    binary tree over the cell's days (two a level at most), every event point to the nodes above its day, and each node is swept in order of
    recorded time, in strips of about ``PER_STRIP`` versions that are told the best version before them. So a hot key is spread over cells, nodes
    and strips, and the work grows with versions and events, not with their product.
    """
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    keep = [c for c in events.columns if c != out]
    at_us = us(F.col(f"`{known_at}`")) if known_at else F.lit(0).cast("long")
    e = events.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(f"`{key}`").alias("_k"), F.unix_date(F.col(f"`{day}`").cast("date")).alias("_d"), at_us.alias("_a"))
    e = e.withColumns({"_dc": _cell(F.col("_d"), CELL_DAYS), "_ac": _cell(F.col("_a"), CELL_US)})
    since = us(recorded_from) if recorded_from is not None else F.lit(_US_LOW)
    v = versions.select(
        F.col(f"`{key}`").alias("_k"), F.coalesce(F.unix_date(valid_from.cast("date")), F.lit(_DAY_LOW)).alias("d0"), F.coalesce(F.unix_date(valid_to.cast("date")), F.lit(_DAY_HIGH)).alias("d1"),
        since.alias("a0"), F.struct(*[c.alias(f"r{k}") for k, c in enumerate(rank)], F.col(f"`{payload}`").alias("p")).alias("r"),
    ).where("_k is not null and a0 is not null and d0 <= d1").distinct()
    points = e.where("_k is not null and _d is not null and _a is not null")
    cells = points.select(*_CELL).distinct()
    # the calendar bounds the day cells of a key
    days = cells.groupBy("_k").agg(F.collect_set("_dc").alias("_dcs"))
    c0, b0 = F.col("_dc") * CELL_DAYS, F.col("_ac") * CELL_US
    c1, b1 = c0 + CELL_DAYS - 1, b0 + CELL_US - 1
    near = F.filter("_dcs", lambda c: (F.col("d0") <= c * CELL_DAYS + CELL_DAYS - 1) & (F.col("d1") >= c * CELL_DAYS))
    index = v.join(days, "_k").select("_k", F.explode(near).alias("_dc"), "d0", "d1", "a0", "r")
    met = index.join(cells, ["_k", "_dc"]).where(F.col("a0") <= b1)
    part = ~((F.col("d0") <= c0) & (F.col("d1") >= c1) & (F.col("a0") <= b0))
    held = met.groupBy(*_CELL).agg(F.max(F.when(~part, F.col("r"))).alias("best"), F.count_if(part).alias("n"))
    clipped = F.struct(F.greatest("a0", b0).alias("a0"), F.greatest(F.col("d0").cast("long"), c0).alias("d0"), F.least(F.col("d1").cast("long"), c1).alias("d1"), "r")
    parts = met.where(part).select(*_CELL, clipped.alias("x")).join(held.where("n > 0"), _CELL).where("best is null or x.r > best").select(*_CELL, "x")
    # all cells with what is known of them, written once, as the listed and the full ones are read several times
    known = cut(held.join(parts, _CELL, "left"))
    info = known.groupBy(*_CELL).agg(F.max("best").alias("best"), F.max("n").alias("n"), F.collect_set(F.when(F.col("n") <= LISTED, F.col("x"))).alias("part"))
    info = info.withColumns({"c0": c0, "c1": c1, "b0": b0})
    found = e.join(_regions(info), _CELL, "left")
    strip = F.element_at(F.filter("regions", lambda x: x["a0"] <= F.col("_a")), -1)
    # the strip and the day interval in which the point lies are the last that begin at or before it
    p = F.when(F.col("regions").isNotNull(), F.element_at(F.filter(strip["days"], lambda x: x["d0"] <= F.col("_d")), -1)["p"])
    full = known.where((F.col("n") > LISTED) & F.col("x").isNotNull()).select(*_CELL, "n", "x.*")
    if known.where(F.col("n") > LISTED).isEmpty():
        return found.select("_row.*", p.alias(out))
    swept = _sweep(points.select(*_CELL, "_d", "_a").distinct(), full).withColumnsRenamed({c: f"{c}2" for c in (*_CELL, "_d", "_a")})
    on = [F.col(c) == F.col(f"{c}2") for c in (*_CELL, "_d", "_a")]
    # of the covering version, which the regions of a full cell consist of, and the swept one the higher is current
    both = found.join(swept, on, "left").select("_row", F.greatest("best", "swept")["p"].alias("_top"), p.alias("_p"), F.coalesce(F.col("n") > LISTED, F.lit(False)).alias("_full"))
    return both.select("_row.*", F.when(F.col("_full"), F.col("_top")).otherwise(F.col("_p")).alias(out))


def _regions(info: DataFrame) -> DataFrame:
    """The cells with regions: strips of recorded time between the instants at which a version becomes known, cut at the days where validity changes."""
    part, base = F.col("part"), F.col("best")
    strips = F.array_sort(F.array_distinct(F.concat(F.array("b0"), F.transform(part, lambda x: x["a0"]))))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("c0"), F.transform(part, lambda x: x["d0"]), F.filter(F.transform(part, lambda x: x["d1"] + 1), lambda d: d <= F.col("c1")))))

    def current(a: Column, d: Column) -> Column:
        hit = F.array_max(F.transform(F.filter(part, lambda x: (x["a0"] <= a) & (x["d0"] <= d) & (d <= x["d1"])), lambda x: x["r"]))
        return F.coalesce(hit, base)["p"]

    regions = F.transform(F.col("strips"), lambda a: F.struct(a.alias("a0"), F.transform(F.col("cuts"), lambda d: F.struct(d.alias("d0"), current(a, d).alias("p"))).alias("days")))
    return info.withColumns({"strips": strips, "cuts": cuts}).select(*_CELL, "best", "n", regions.alias("regions"))


def _sweep(points: DataFrame, full: DataFrame) -> DataFrame:
    """cell, _d, _a, swept: the highest version valid and known at each point of the full cells, among those that don't cover the cell."""
    b0 = F.col("_ac") * CELL_US
    strips = F.least(F.lit(1 << 20), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / PER_STRIP, F.lit(1.0))))).cast("long"))
    width = F.expr(f"{CELL_US} div strips")
    strip = lambda t: F.least(F.expr(f"({t} - _ac * {CELL_US}) div width"), F.col("strips") - 1)
    # nodes: 2^LEVELS + day for a day, halved for each level above; a range has those whose parent it doesn't hold
    x, y = (F.col("d0") - F.col("_dc") * CELL_DAYS).cast("long"), (F.col("d1") - F.col("_dc") * CELL_DAYS).cast("long")
    nodes = []
    for k in range(LEVELS + 1):
        low, high, at = F.shiftright(x + ((1 << k) - 1), k), F.shiftright(y + 1, k) - 1, F.lit(CELL_DAYS >> k)
        inside = low <= high
        if k == LEVELS:
            nodes.append(F.when(inside, at + low))
        else:
            nodes += [F.when(inside & (low % 2 == 1), at + low), F.when(inside & (high % 2 == 0), at + high)]
    sized = full.withColumn("strips", strips).withColumn("width", width)
    v = sized.select(*_CELL, "strips", "width", F.explode(F.array_compact(F.array(*nodes))).alias("node"), strip("a0").alias("strip"), F.col("a0").alias("t"), "r")
    first = v.groupBy(*_CELL, "strips", "width", "node", "strip").agg(F.max("r").alias("r"))
    before = Window.partitionBy(*_CELL, "node").orderBy("strip")
    first = first.withColumns({"r": F.max("r").over(before), "next": F.coalesce(F.lead("strip").over(before), F.col("strips") - 1)})
    told = first.where("next > strip").select(*_CELL, "node", F.explode(F.sequence(F.col("strip") + 1, "next")).alias("strip"), "width", "r")
    told = told.select(*_CELL, "node", "strip", (b0 + F.col("strip") * F.col("width")).alias("t"), "r")
    cells = sized.select(*_CELL, "strips", "width").distinct()
    day = (F.col("_d") - F.col("_dc") * CELL_DAYS + CELL_DAYS).cast("long")
    e = points.join(cells, _CELL).select(*_CELL, F.explode(F.array(*[F.shiftright(day, k) for k in range(LEVELS + 1)])).alias("node"), strip("_a").alias("strip"), F.col("_a").alias("t"), "_d")
    rows = v.select(*_CELL, "node", "strip", "t", "r").unionByName(told).withColumn("_d", F.lit(None).cast("int")).unionByName(e.withColumn("r", F.lit(None).cast(v.schema["r"].dataType)))
    # of one instant the versions come first
    so_far = Window.partitionBy(*_CELL, "node", "strip").orderBy("t", F.col("_d").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("r", F.max("r").over(so_far)).where("_d is not null and r is not null").groupBy(*_CELL, "_d", F.col("t").alias("_a")).agg(F.max("r").alias("swept"))


def _cell(c: Column, size: int) -> Column:
    """Number of the cell of ``size``, by floor division in exact arithmetic."""
    n = c.cast("long")
    return ((n - F.pmod(n, F.lit(size))) / F.lit(size)).cast("long")

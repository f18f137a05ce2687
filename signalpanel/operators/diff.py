"""Differences between two copies of a dataset, row by row and field by field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relative_apart(tolerance: float) -> Callable[[Column, Column], Column]:
    """Whether two doubles are apart by more than ``tolerance`` of the larger magnitude; null differs from any value, not from null."""
    return lambda a, b: ~a.eqNullSafe(b) & (a.isNull() | b.isNull() | (F.abs(a - b) > tolerance * F.greatest(F.abs(a), F.abs(b))))


def unequal(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def latest_rows(df: DataFrame, keys: list[str], fields: list[str], loaded: str) -> DataFrame:
    """Of each key the row loaded last (null: first); rows loaded together and not equal: the one of largest field values. Combinable."""
    best = F.max(F.struct(F.col(loaded).alias("_l"), F.struct(*fields).alias("f")))
    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.f.*")


def residues(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """cols, _n: the distinct rows of EXCEPT ALL in both directions, with how often they come out: n times of the left one, -n times of the right one."""
    both = left.select(*cols, F.lit(1).alias("_n")).unionByName(right.select(*cols, F.lit(-1).alias("_n")))
    return both.groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n <> 0")


def diff_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, Callable[[Column, Column], Column]], left_name: str, right_name: str) -> DataFrame:
    """keys, finding, left_value, right_value: one row for each one-sided key (``missing_in_<name>``) and each differing field.

    Both sides hold normalised rows, unique by key (see :func:`latest_rows`). Method: EXCEPT ALL in both directions, computed in one
    pass as a signed count of equal rows, so that the bulk of equal rows is gone after one aggregation with map-side combine; the two
    residues are then full-joined by key and compared by each field's own predicate (null-safe). Keys never hold a null. Empty sides
    are allowed. Columns other than keys and fields are ignored, whatever their names.
    """
    residue = residues(left, right, [*keys, *fields])
    side = lambda sign, name: residue.where(F.col("_n") * sign > 0).select(*keys, F.struct(*fields).alias(name))
    joined = side(1, "l").join(side(-1, "r"), keys, "full")
    return _findings(joined, keys, fields, left_name, right_name)


def _findings(joined: DataFrame, keys: list[str], fields: dict[str, Callable[[Column, Column], Column]], left_name: str, right_name: str) -> DataFrame:
    item = lambda name, a, b: F.struct(F.lit(name).alias("finding"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value"))
    null = F.lit(None)
    one_sided = [F.when(F.col("r").isNull(), item(f"missing_in_{right_name}", null, null)), F.when(F.col("l").isNull(), item(f"missing_in_{left_name}", null, null))]
    pairs = [(f, F.col("l")[f], F.col("r")[f], apart) for f, apart in fields.items()]
    two_sided = [F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & apart(a, b), item(f, a, b)) for f, a, b, apart in pairs]
    return joined.select(*keys, F.inline(F.filter(F.array(*one_sided, *two_sided), lambda x: x.isNotNull())))

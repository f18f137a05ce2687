"""Full history of a changing entity attribute, built from periodic snapshots or updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def attribute_history(df: DataFrame, entity: str, value: Column, as_of: str, published: str, tie: str, starts: str, ends: str, value_name: str) -> DataFrame:
    """One row for each version: entity, ``value_name``, valid_from, valid_to (DATE), n_snapshots, first_as_of, last_as_of.

    Of several rows of an entity with one ``as_of`` only the latest ``published`` (then largest ``tie``) holds. A version is an
    unbroken run of equal values in the order of ``as_of``; a value that comes back is a new version. valid_from is the run's most
    recently published non-null ``starts``; valid_to the day before the next version's valid_from, for the last version its most
    recently published non-null ``ends``, else 9999-12-31.

    Method: rows that hold are found by a combinable max over (entity, as_of); each entity's rows then form a sorted struct array,
    folded by a higher-order function that appends a version only upon change, and the versions are exploded with their end times.
    The array has at most one element for each distinct ``as_of`` day, however many rows an entity has, so a hot entity stays small.

    Nulls: rows whose value is null or blank, or whose entity or ``as_of`` is null, state nothing. A null ``published`` sorts first.
    A version none of whose rows has a start gets a null valid_from, and the version before it a null valid_to. Exact repeats
    collapse. Empty input gives no rows. Extra columns are ignored, whatever their names.
    """
    rows = df.select(
        F.col(f"`{entity}`").alias("_e"), value.alias("_v"), F.col(f"`{as_of}`").alias("_s"),
        F.struct(F.col(f"`{published}`").alias("p"), F.col(f"`{tie}`").alias("t")).alias("_k"), F.col(f"`{starts}`").alias("_from"), F.col(f"`{ends}`").alias("_to"),
    ).where((F.col("_v") != "") & F.col("_e").isNotNull() & F.col("_s").isNotNull())
    held = rows.groupBy("_e", "_s").agg(F.max(F.struct("_k", "_v", "_from", "_to")).alias("r"))
    arrays = held.groupBy("_e").agg(F.sort_array(F.collect_list(F.struct("_s", "r"))).alias("rows"))
    key = arrays.schema["rows"].dataType.elementType["r"].dataType["_k"].dataType.simpleString()
    version = f"struct<v:string,sk:{key},s:date,ek:{key},e:date,n:int,a:date,b:date>"

    def fold(acc: Column, x: Column) -> Column:
        r, cur = x["r"], acc["cur"]
        has_from, has_to = r["_from"].isNotNull(), r["_to"].isNotNull()
        null = F.lit(None)
        same = cur["v"] == r["_v"]
        # most recently published bounds so far; null keys sort first, and greater-or-null wins
        new_from = has_from & (~same | cur["s"].isNull() | (_after(r["_k"], cur["sk"])))
        new_to = has_to & (~same | cur["e"].isNull() | (_after(r["_k"], cur["ek"])))
        nxt = F.struct(
            r["_v"].alias("v"),
            F.when(new_from, r["_k"]).when(same, cur["sk"]).otherwise(null).alias("sk"), F.when(new_from, r["_from"]).when(same, cur["s"]).otherwise(null).alias("s"),
            F.when(new_to, r["_k"]).when(same, cur["ek"]).otherwise(null).alias("ek"), F.when(new_to, r["_to"]).when(same, cur["e"]).otherwise(null).alias("e"),
            F.when(same, cur["n"] + 1).otherwise(F.lit(1)).alias("n"), F.when(same, cur["a"]).otherwise(x["_s"]).alias("a"), x["_s"].alias("b"),
        ).cast(version)
        done = F.when(cur.isNull() | same, acc["done"]).otherwise(F.array_append(acc["done"], cur))
        return F.struct(done.alias("done"), nxt.alias("cur"))

    zero = F.struct(F.array().cast(f"array<{version}>").alias("done"), F.lit(None).cast(version).alias("cur"))
    versions = arrays.select("_e", F.aggregate("rows", zero, fold, lambda acc: F.array_append(acc["done"], acc["cur"])).alias("vs"))
    out = versions.select("_e", "vs", F.posexplode("vs").alias("i", "x"))
    last = F.col("i") == F.size("vs") - 1
    following = F.get(F.col("vs"), F.col("i") + 1)["s"]
    return out.select(
        F.col("_e").alias(entity), F.col("x.v").alias(value_name), F.col("x.s").alias("valid_from"),
        F.when(last, F.coalesce(F.col("x.e"), F.lit(OPEN_END).cast("date"))).otherwise(F.date_sub(following, 1)).alias("valid_to"),
        F.col("x.n").alias("n_snapshots"), F.col("x.a").alias("first_as_of"), F.col("x.b").alias("last_as_of"),
    )


def _after(a: Column, b: Column) -> Column:
    """Whether key a = (published, tie) comes after b, nulls first."""
    pa, pb = a["p"], b["p"]
    return F.coalesce(pa > pb, pa.isNotNull() & pb.isNull()) | (pa.eqNullSafe(pb) & F.coalesce(a["t"] > b["t"], a["t"].isNotNull() & b["t"].isNull()))

"""Filling containers of fixed capacity with items, by pattern packing on the length histogram.

Planning sees only the histogram of lengths, whose size is bounded by the capacity, not by the data: patterns of few documents
that fill a container exactly are enumerated, their repeat counts fitted to the histogram by non-negative least squares, rounded
down to what the histogram holds, fitted again to what is left until no pattern repeats, and the residual lengths packed best-fit in decreasing
order, whole groups of equal containers at a time. Documents then take the planned slots by their rank among documents of equal length,
found in parallel.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from signalpanel.session import cut

#: Parameters of the plan: documents in an enumerated pattern, and the most frequent lengths from which all but a pattern's last document are
#: taken. Rarer lengths repeat too seldom for patterns; they can be a pattern's last and are otherwise packed with the residuals.
PATTERN_DOCS, PATTERN_LENGTHS = 3, 512
#: Documents of one length that are ranked in one task.
RANKED_TOGETHER = 1_000_000
#: The public word-and-punctuation pattern, its Unicode classes written out: letters, numbers and the underscore; no white space.
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]+"


def count_tokens(text: Column) -> Column:
    """Matches of the public word-and-punctuation pattern; null for null."""
    return F.regexp_count(text, F.lit(_TOKEN)).cast("long")


def enumerate_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one to three of the given lengths that fill the capacity exactly: rows of bin numbers, -1 where unused.

    Of a pattern's lengths all but one are among the ``PATTERN_LENGTHS`` most frequent, so there are at most half that number squared, whatever the capacity.
    """
    where = np.full(capacity + 1, -1)
    where[lengths] = np.arange(len(lengths))
    usual = np.sort(lengths[np.argsort(-counts, kind="stable")[:PATTERN_LENGTHS]])
    out = [np.array([[where[capacity], -1, -1]])] if where[capacity] >= 0 else []
    two = usual[where[capacity - usual] >= 0] if len(usual) else usual
    out.append(np.stack([where[two], where[capacity - two], np.full(len(two), -1)], 1))
    for a in usual:
        b = usual[(usual >= a) & (usual < capacity - a)]
        b = b[where[capacity - a - b] >= 0]
        out.append(np.stack([np.full(len(b), where[a]), where[b], where[capacity - a - b]], 1))
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts that bring the patterns' lengths close to the histogram, in weighted least squares.

    Exact steps along the coordinate that gains most, until none would change its count by a half. Each step lowers the error by a fixed least amount, so they
    end; and they keep the solution sparse, so that rounding down loses little.
    """
    n, x = len(counts), np.zeros(len(patterns))
    bins = np.where(patterns < 0, n, patterns)
    w2 = np.append(weights**2, 0.0)
    r = np.append(counts.astype(float), 0.0)
    same = (bins[:, :, None] == bins[:, None, :]).sum(2)
    size = (w2[bins] * same).sum(1)  # a length that comes m times in a pattern counts m * m
    root = np.sqrt(size)
    holders = np.argsort(bins.ravel(), kind="stable")
    start = np.searchsorted(bins.ravel()[holders], np.arange(n + 2))
    holders //= bins.shape[1]
    grad = (w2 * r)[bins].sum(1)
    while len(x):
        step = np.maximum(grad / size, -x)
        p = int(np.argmax(np.abs(step) * root))
        if abs(step[p]) < 0.5:
            break
        x[p] += step[p]
        for b in bins[p]:
            if b < n:
                r[b] -= step[p]
                np.add.at(grad, holders[start[b] : start[b + 1]], -step[p] * w2[b])
    return x


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of containers, {length: how often in each}) for lengths 1..capacity; every counted length is placed, none twice."""
    left = {n: c for n, c in histogram.items() if c > 0}
    plan: list[tuple[int, dict[int, int]]] = []
    while True:
        lengths = np.array(sorted(n for n, c in left.items() if c > 0), dtype=int)
        if not len(lengths):
            break
        counts = np.array([left[n] for n in lengths])
        patterns = enumerate_patterns(lengths, counts, capacity)
        x = fit_counts(patterns, counts, np.sqrt(lengths / capacity))  # long residuals are harder to place, so they weigh more
        placed = 0
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 1:
                break
            need: dict[int, int] = defaultdict(int)
            for b in patterns[p][patterns[p] >= 0]:
                need[int(lengths[b])] += 1
            k = min(int(x[p]), *(left[n] // m for n, m in need.items()))
            if k > 0:
                placed += k
                plan.append((k, dict(need)))
                for n, m in need.items():
                    left[n] -= m * k
        if not placed:
            break
    return plan + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit in decreasing order, on groups of equal containers: room -> [[count, contents]]."""
    by_room: dict[int, list] = defaultdict(list)
    rooms: list[int] = []  # those of groups, in order

    def put(room: int, k: int, content: dict[int, int]) -> None:
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append([k, content])

    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                k, content = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
                # as many of this length as the room takes, into as many containers of the group as can be filled up
                each = max(1, min(room // n, todo))
                used = min(k, todo // each)
                if k > used:
                    put(room, k - used, content)
            else:
                room, content = capacity, {}
                each = min(capacity // n, todo)
                used = todo // each
            todo -= used * each
            put(room - each * n, used, {**content, n: content.get(n, 0) + each})
    merged: dict[tuple, int] = defaultdict(int)
    for groups in by_room.values():
        for k, content in groups:
            merged[tuple(sorted(content.items()))] += k
    return [(k, dict(c)) for c, k in merged.items()]


def _slots(plan: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """length, first rank, containers, slots in each, number of the first container: one row for each length of each group."""
    rows, taken, base = [], defaultdict(int), 0
    for k, content in plan:
        for n, m in content.items():
            rows.append((n, taken[n], m, base))
            taken[n] += m * k
        base += k
    return pd.DataFrame(rows, columns=["length", "first", "each", "base"]).sort_values(["length", "first"], ignore_index=True)


def pack(items: DataFrame, item_id: str, n_tokens: str, budgets: DataFrame, budget_id: str, capacity: str) -> DataFrame:
    """budget_id, container_id STRING, item_id, piece INT, start_token BIGINT, n_tokens BIGINT: where each item lies, for each budget.

    An item of at most the capacity is in one container, whole. A longer one is cut into full pieces, each filling a container of its
    own, and a last piece that is packed like an item. Items of null, zero or negative size hold nothing and don't appear. Repeated
    rows are separate items. Budgets of null or non-positive capacity are left out; there are few budgets (they come to the driver
    with one histogram each, of at most ``capacity`` bins). Ties in length are ranked by item id. Extra columns are ignored.

    Scale: sizes are written once, as (item, length); then two aggregations of (budget, length) counts and one shuffle on (budget, length, part).
    Documents of one length are ranked in parts of about ``RANKED_TOGETHER``, so that a length shared by many rows stays parallel. Only lengths move, never texts.
    """
    caps = {r[0]: r[1] for r in budgets.select(F.col(f"`{budget_id}`"), F.col(f"`{capacity}`").cast("long")).where(f"`{capacity}` > 0 and `{budget_id}` is not null").distinct().collect()}
    base = cut(items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{n_tokens}`").cast("long").alias("n")).where("n > 0"))
    spark = items.sparkSession
    each = F.array(*[F.struct(F.lit(b).cast("long").alias("budget"), F.lit(c).cast("long").alias("cap")) for b, c in caps.items()]) if caps else F.array().cast("array<struct<budget:bigint,cap:bigint>>")
    rows = base.select("id", "n", F.inline(each)).withColumn("full", F.floor((F.col("n") - 1) / F.col("cap")).cast("long"))
    rows = rows.withColumn("len", (F.col("n") - F.col("full") * F.col("cap")).cast("int"))
    histogram = defaultdict(dict)
    for b, n, c in rows.groupBy("budget", "len").agg(F.count("*")).collect():
        histogram[b][n] = c
    n_parts = max(1, -(-max((c for h in histogram.values() for c in h.values()), default=0) // RANKED_TOGETHER))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int"))
    parts = rows.groupBy("budget", "len", "part").agg(F.count("*").alias("c"))
    slots = [_slots(plan_containers(histogram[b], caps[b])).assign(budget=b) for b in histogram]
    table = pd.concat(slots, ignore_index=True) if slots else pd.DataFrame(columns=["length", "first", "each", "base", "budget"], dtype="int64")
    shared = spark.sparkContext.broadcast({b: tuple(t[c].to_numpy("int64") for c in ("length", "first", "each", "base")) for b, t in table.groupby("budget")})

    @F.pandas_udf(LongType())
    def container(budget: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(budget), "int64")
        for b in budget.unique():
            at = (budget == b).to_numpy()
            lengths, first, slots_each, start = shared.value[b]
            big = 1 << 40
            r = rank.to_numpy("int64")[at]
            k = np.searchsorted(lengths * big + first, length.to_numpy("int64")[at] * big + r, side="right") - 1
            out[at] = start[k] + (r - first[k]) // slots_each[k]
        return pd.Series(out)

    before = F.coalesce(F.sum("c").over(Window.partitionBy("budget", "len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("budget", "len", "part", before.alias("before"))
    ranked = rows.join(offsets, ["budget", "len", "part"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("budget", "len", "part").orderBy("id")) - 1)
    placed = ranked.withColumn("c", container("budget", "len", "rank"))
    last = F.struct(F.concat(F.lit("c"), F.col("c")).alias("container_id"), F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("cap")).alias("start_token"), F.col("len").cast("long").alias("n_tokens"))
    # rank keeps repeated rows of one id apart
    fulls = F.transform(
        F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda k: F.struct(F.concat_ws("-", F.lit("f"), F.col("id").cast("string"), F.col("len").cast("string"), F.col("rank").cast("string"), k.cast("string")).alias("container_id"), k.cast("int").alias("piece"), (k * F.col("cap")).alias("start_token"), F.col("cap").alias("n_tokens")),
    )
    return placed.select(F.col("budget").alias(budget_id), F.col("id").alias(item_id), F.inline(F.concat(fulls, F.array(last)))).select(budget_id, "container_id", item_id, "piece", "start_token", "n_tokens")

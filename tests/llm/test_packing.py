import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from signalpanel.llm.packing import count_tokens, pack, plan_containers


def test_plan_places_every_length_once():
    rnd = random.Random(3)
    for cap in (1, 7, 64, 512):
        h = Counter(min(cap, max(1, int(rnd.expovariate(4 / cap)))) for _ in range(3000))
        got: Counter = Counter()
        plan = plan_containers(h, cap)
        for k, content in plan:
            assert k > 0 and sum(n * m for n, m in content.items()) <= cap
            for n, m in content.items():
                got[n] += m * k
        assert got == h
        total, least = sum(n * c for n, c in h.items()), 0
        least = math.ceil(total / cap)
        assert sum(k for k, _ in plan) <= 1.02 * least + 1
    assert plan_containers({}, 10) == []


def test_pack(spark):
    rnd = random.Random(5)
    sizes = [rnd.choice([0, 1, 5, 50, 99, 100, 101, 250, 1000, None, -3]) for _ in range(500)] + [7] * 400
    items = spark.createDataFrame([(n, s, "x", 1) for n, s in enumerate(sizes)], "doc long, n int, budget string, len int")
    budgets = spark.createDataFrame([(1, 100), (2, 333), (3, None), (4, 0), (1, 100)], "budget_id long, cap int")
    rows = pack(items, "doc", "n", budgets, "budget_id", "cap").collect()
    for b, cap in ((1, 100), (2, 333)):
        used, pieces = defaultdict(int), defaultdict(list)
        for r in rows:
            if r.budget_id == b:
                used[r.container_id] += r.n_tokens
                pieces[r.doc].append((r.piece, r.start_token, r.n_tokens))
        assert max(used.values()) <= cap
        assert set(pieces) == {n for n, s in enumerate(sizes) if s and s > 0}
        for n, p in pieces.items():
            p.sort()
            assert sum(x[2] for x in p) == sizes[n] and [x[1] for x in p] == [k * cap for k in range(len(p))] and len(p) == max(1, math.ceil(sizes[n] / cap))
        assert len(used) <= math.ceil(sum(used.values()) / cap) * 1.02 + 1
    assert {r.budget_id for r in rows} == {1, 2}


def test_pack_empty_and_repeated(spark):
    budgets = spark.createDataFrame([(1, 10)], "budget_id long, cap int")
    assert pack(spark.createDataFrame([], "doc long, n int"), "doc", "n", budgets, "budget_id", "cap").count() == 0
    twice = pack(spark.createDataFrame([(1, 25), (1, 25)], "doc long, n int"), "doc", "n", budgets, "budget_id", "cap").collect()
    by = Counter()
    for r in twice:
        by[r.container_id] += r.n_tokens
    assert len(twice) == 6 and max(by.values()) <= 10
    assert pack(spark.createDataFrame([(1, 25)], "doc long, n int"), "doc", "n", budgets.limit(0), "budget_id", "cap").count() == 0


def test_count_tokens(spark):
    df = spark.createDataFrame([("a b, c",), ("",), (None,), ("日本。",), ("½ x_1 ٣ \u200b\x1cé̂",)], "t string").select(count_tokens(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [4, 0, None, 2, 6]

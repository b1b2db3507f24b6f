"""Operators that must stay exact when one group holds most rows: checked against brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom.operators import findings as FI
from auditloom.operators import ordered, packing


def skewed(spark, n=3000):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 20)}", i * 7 + 3, rng.choice([None, 1, 2, 5]))
            for i in range(n)]
    return spark.createDataFrame(rows, "g string, seq bigint, v bigint")


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def test_bucketed_forms_equal_plain_windows(spark):
    df = skewed(spark)
    w = Window.partitionBy("g").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    assert rows(ordered.row_number(df, ["g"], "seq", "n", width=100), "g", "seq", "n") == rows(
        df.withColumn("n", F.row_number().over(w)), "g", "seq", "n")
    assert rows(ordered.running_sum(df, ["g"], "seq", {"s": "v"}, 100), "g", "seq", "s") == rows(
        df.withColumn("s", F.sum("v").over(upto)), "g", "seq", "s")
    assert rows(ordered.carry_forward(df, ["g"], "seq", "v", "c", 100), "g", "seq", "c") == rows(
        df.withColumn("c", F.last("v", True).over(upto)), "g", "seq", "c")
    assert rows(ordered.top_n(df, ["g"], [F.desc("seq")], 25, "seq", salts=4), "g", "seq") == rows(
        df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("seq")))).filter("n <= 25"), "g", "seq")
    lead = ordered.row_number(df.withColumn("r", F.coalesce("v", F.lit(9))), [], "seq", "n", ["r"], 100)
    assert [r.n for r in lead.orderBy("r", "seq").collect()] == list(range(1, df.count() + 1))


def test_dedup_with_one_hot_key(spark):
    rng = random.Random(5)
    names = ["critical", "high", "medium", "low", "informational", "odd", "High"]
    data = [("r", i, rng.choice(["hot", "hot", "hot", "a", "b", "", None]), rng.choice(names[2:] if i < 50 else names))
            for i in range(2000)]
    df = spark.createDataFrame(data, "repo string, seq bigint, dedupKey string, severity string")
    rank = {n: i for i, n in enumerate(names[:5])}
    kept, slots = {}, {}
    for _, seq, key, severity in data:
        key = key or f"#{seq}"
        value = rank.get(severity.lower(), 5)
        if key not in kept or value < kept[key][0]:
            kept[key] = (value, seq)
        slots.setdefault(key, seq)
    want = sorted((kept[k][1], slots[k]) for k in kept)
    assert sorted(map(tuple, FI.dedup_by_key(df).select("seq", "slot").collect())) == want


def greedy(items, budget):
    taken, left = set(), budget
    for _, seq, _, tokens in sorted(items, key=lambda x: (-x[2], x[1])):
        if tokens <= left:
            taken.add(seq)
            left -= tokens
    return taken


def test_pack_budget_is_the_exact_greedy_walk(spark):
    rng = random.Random(11)
    data = []
    for repo, n, high in (("hot", 1500, 300), ("small", 40, 900), ("tiny", 300, 3), ("big", 5, 5000)):
        data += [(repo, i, rng.randint(0, 30), rng.choice([0, 1, rng.randint(1, high), high])) for i in range(n)]
    # Sizes that fall by one: each file that fits makes the next larger ones impossible.
    data += [("stairs", i, 10_000 - i, 1 if i % 2 == 0 else 1001 - i // 2) for i in range(400)]
    df = spark.createDataFrame(data, "repo string, seq bigint, score bigint, tokens bigint")
    got = packing.pack_budget(df, budget=1000, batch=16).filter("included").collect()
    for repo in {d[0] for d in data}:
        want = greedy([d for d in data if d[0] == repo], 1000)
        assert {r.seq for r in got if r.repo == repo} == want, repo


def test_pack_budget_without_candidates(spark):
    df = spark.createDataFrame([("r", 1, 1, 500), ("r", 2, 1, 0)], "repo string, seq bigint, score bigint, tokens bigint")
    assert {(r.seq, r.included) for r in packing.pack_budget(df, 10).collect()} == {(1, False), (2, True)}

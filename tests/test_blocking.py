"""Blocking joins against plain loops: repeated ids, nulls, keys that many records share, and tables that no join may broadcast."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from resolvent.operators import blocking as B


def table(spark, seed, id_name, n, unique):
    rng = random.Random(seed)
    word = lambda: rng.choice([None, "", "a", "b", "c", "hot", "hot", "hot"])
    rows = [(f"{id_name}{i if unique else rng.randrange(n // 2):03d}", rng.choice(["X", "Y", None]), word(), word()) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{id_name} string, c string, k string, m string")


def same(a, b):
    return bool(a) and a == b


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs(df):
    return sorted((r["s1_id"], r["target_id"]) for r in df.collect())


@pytest.mark.parametrize("unique", [True, False])
def test_disjunction_gives_a_pair_once(spark, unique):
    a, left = table(spark, 1, "s1_id", 40, unique)
    b, right = table(spark, 2, "target_id", 60, unique)
    got = B.disjunctive_block(left, right, ["c"], ["k", "m"])
    assert pairs(got) == sorted({(x[0], y[0]) for x in a for y in b if same(x[1], y[1]) and (same(x[2], y[2]) or same(x[3], y[3]))})
    assert ("HashAggregate" in plan(got)) is not unique  # pairs are compared only where ids repeat


@pytest.mark.parametrize("unique", [True, False])
def test_first_in_block(spark, unique):
    a, left = table(spark, 3, "s1_id", 40, unique)
    b, right = table(spark, 4, "target_id", 60, True)
    got = B.first_in_block(left, right, ["c", "k"], 5)
    want = []
    for i in {x[0] for x in a}:
        want += sorted((i, y[0]) for x in a if x[0] == i for y in b if same(x[1], y[1]) and same(x[2], y[2]))[:5]
    assert pairs(got) == sorted(want)
    assert pairs(got) == pairs(B.capped(B.exact_block(left, right, ["c", "k"]), ["s1_id"], "target_id", 5))


@pytest.mark.parametrize("budget", [1, 7, 50, 5000])
def test_budgeted_join_sends_rows_to_few_cells(spark, budget):
    left = spark.range(90).select(F.expr("case when id % 9 = 0 then null when id < 80 then 1 else id end").alias("k"), F.col("id").alias("a"))
    right = spark.range(200).select(F.expr("case when id < 150 then 1 else id - 100 end").alias("k"), F.col("id").alias("b"))
    key = lambda r: (r["k"], r["a"], r["b"])
    got = B.budgeted_join(left, right, ["k"], budget)
    assert sorted(map(key, got.collect())) == sorted(map(key, left.join(right, "k").collect()))


def test_budgeted_join_cells_are_square(spark):
    many = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    sides = [x.split("\n") for x in [B.budgeted_join(many, many.withColumnRenamed("a", "b"), ["k"], 100)._jdf.queryExecution().optimizedPlan().toString()]][0]
    assert sum("Generate explode" in x for x in sides) == 2  # both sides are dealt, none goes to every cell


def test_exploded_keys_are_not_broadcast(spark):
    rows = spark.createDataFrame([(f"t{i}", "name", i % 7) for i in range(50)], "target_id string, family string, key long")
    got = B.weighted_key_join(rows.withColumnRenamed("target_id", "s1_id"), rows, 60)
    assert plan(got).count("BroadcastHashJoin") == 0 and plan(got).count("SortMergeJoin") >= 5
    assert got.count() == sum(len([i for i in range(50) if i % 7 == k]) ** 2 for k in range(7))


@pytest.mark.parametrize("most", [300_000, 1])
def test_weighted_keys_meet_lists(spark, monkeypatch, most):
    rng = random.Random(5)
    fam = lambda k: ("name", "address", "cross")[k % 3]
    draw = lambda name, n: [(None if rng.random() < 0.05 else f"{name}{rng.randrange(n):02d}", fam(k), k) for k in (min(rng.randrange(40), rng.randrange(40)) for _ in range(8 * n))]
    a, b = draw("s", 20), draw("t", 30)
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(k):
        made.add(1)
        return k

    monkeypatch.setattr(B, "HOT_KEYS", most)
    side = lambda rows, name: spark.createDataFrame(rows, f"{name} string, family string, key long").withColumn("key", counted.asNondeterministic()("key"))
    got = B.weighted_key_join(side(a, "s1_id"), side(b, "target_id"), 8)
    assert ("BroadcastHashJoin" in plan(got)) is (most > 1)  # of keys left out, after they were counted
    c = Counter(k for _, _, k in b)
    w = {k: math.log((len({t for t, _, _ in b}) + 1) / (n + 1)) for k, n in c.items() if n <= 8}
    assert 1 < len(w) < len(c) - 1
    mass = lambda rows, i: sum(w.get(k, 0) for j, _, k in rows if i == j)
    want = {}
    for i, f, k in a:
        for j, _, m in b:
            if k == m and k in w and i and j:
                x = want.setdefault((i, j), Counter())
                x.update({"total": w[k], "n_keys": 1, f"bs_{f}": w[k], "score": w[k] / math.sqrt((mass(a, i) + 1) * (mass(b, j) + 1))})
    rows = {(r["s1_id"], r["target_id"]): r for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(rows[p][x] == pytest.approx(want[p][x]) for p in rows for x in ("total", "n_keys", "bs_name", "bs_address", "bs_cross", "score"))
    assert made.value == len(a) + len(b)  # keys are made once a side

"""Row numbers, running sums and quantiles over chunks against brute force; caps that are cut before the shuffle."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import metrics as M
from flowsieve.operators import splitting as S
from flowsieve.operators.prefix import numbered, quantiles, running_sums


def rows(spark, n=2000):
    rng = random.Random(4)
    data = [(i, rng.choice(["big"] * 8 + ["small", None]), rng.choice([None, 0.0, 0.5, rng.random()]), rng.randint(0, 1)) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, k string, v double, y int").repartition(7).withColumn("_chunk", F.lit("clash")).drop("_chunk")


def test_numbers_and_sums_of_a_hot_key(spark):
    data, df = rows(spark)
    got = {r.id: (r.k, r._rn, r._rn_total) for r in numbered(df, ["k"], ["id"]).collect()}
    place = defaultdict(int)
    total = defaultdict(int)
    for _, k, _, _ in data:
        total[k] += 1
    want = {}
    for i, k, _, _ in data:
        place[k] += 1
        want[i] = (k, place[k], total[k])
    assert got == want
    sums = {r.id: r.s for r in running_sums(df, ["k"], [F.col("id").desc()], {"s": F.col("y")}).collect()}
    run = defaultdict(int)
    for i, k, _, y in reversed(data):
        run[k] += y
        assert sums[i] == run[k]


def test_quantiles_against_numpy(spark):
    data, df = rows(spark)
    ps = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.k: r.q for r in quantiles(df, ["k"], "v", ps).collect()}
    for k in ("big", "small", None):
        assert got[k] == pytest.approx(list(np.quantile([v for _, x, v, _ in data if x == k and v is not None], ps)))


def test_empty(spark):
    _, df = rows(spark, 10)
    none = df.where("false")
    assert numbered(none, ["k"], ["id"]).count() == 0 and quantiles(none, ["k"], "v", [0.5]).count() == 0
    assert M.auc(none, ["k"], "v", F.col("y") == 1).count() == 0


def test_auc_of_a_hot_key(spark):
    data, df = rows(spark, 600)
    got = {r.k: r.auc for r in M.auc(df.where("v IS NOT NULL"), ["k"], "v", F.col("y") == 1).collect()}
    for k in ("big", None):
        pos, neg = ([v for _, x, v, y in data if x == k and v is not None and y == t] for t in (1, 0))
        assert got[k] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))


def test_cap_is_cut_before_the_shuffle(spark):
    _, df = rows(spark)
    plan = S.capped(df, ["k"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan

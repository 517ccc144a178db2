"""Hand-computed values of metrics, labels, arrays and statistics."""

import math

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import arrays as A
from flowsieve.functions import labels as L
from flowsieve.functions import numbers as N
from flowsieve.functions import text as T
from flowsieve.operators import metrics as M
from flowsieve.operators import splitting as S
from flowsieve.operators import statistics as ST
from flowsieve.operators import sweep as W


def f1(spark, truth, pred, labels):
    df = spark.createDataFrame([("k", t, p) for t, p in zip(truth, pred)], "k string, truth string, pred string")
    return M.macro_f1(M.confusion(df, ["k"], "truth", "pred"), ["k"], labels).first().macro_f1


def test_macro_f1_label_sets(spark):
    two = ["Benign", "Botnet"]
    assert f1(spark, two, two, two) == 1.0
    assert f1(spark, two, two, [*two, "Unknown"]) == pytest.approx(2 / 3)
    truth, pred = ["Benign", "Botnet", "Unknown", "Unknown"], ["Benign", "Botnet", "Unknown", "DDoS"]
    assert f1(spark, truth, pred, ["Benign", "Botnet", "DDoS", "Unknown"]) == pytest.approx((1 + 1 + 0 + 2 / 3) / 4)
    assert f1(spark, truth, ["Benign", "Botnet", "Unknown", "Botnet"], ["Benign", "Botnet", "Unknown"]) == pytest.approx((1 + 2 / 3 + 2 / 3) / 3)


def test_rates_without_rows(spark):
    df = spark.createDataFrame([("Benign", "Benign"), ("Botnet", "Unknown")], "truth string, pred string")
    hit, base = F.col("pred") == "Unknown", F.col("truth") == "Unknown"
    assert df.agg(M.rate(hit, base)).first()[0] is None
    assert df.agg(M.rate(hit, base, "zero")).first()[0] == 0.0
    with pytest.raises(Exception):
        df.agg(M.rate(hit, base, "error")).collect()


def test_probability_rows(spark):
    df = spark.createDataFrame([([0.9, 0.1],), ([0.52, 0.48],), ([0.65, 0.35],), ([1.0],)], "p array<double>")
    out = df.select(F.array_max("p").alias("m"), A.top2_margin(F.col("p")).alias("g"), A.entropy(F.col("p")).alias("e")).collect()
    assert [round(r.g, 6) for r in out] == [0.8, 0.04, 0.3, 1.0]
    assert out[0].e == pytest.approx(0.468995593589)
    assert out[3].e == 0.0
    ties = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>").select(A.argmax(F.col("p"))).first()[0]
    assert ties == 0
    uniform = spark.createDataFrame([([0.0, 0.0],)], "p array<double>").select(A.normalised(F.col("p"))).first()[0]
    assert uniform == [0.5, 0.5]


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.04), ("a", 3, 0.20), ("a", 4, None), ("a", 5, float("nan"))], "k string, i int, p double")
    got = {r.i: (r.p_bh, r.p_bonferroni) for r in ST.benjamini_hochberg(df, ["k"], "p", "i").collect()}
    assert [got[i][0] for i in (1, 2, 3)] == pytest.approx([0.03, 0.06, 0.20])
    assert got[2][1] == pytest.approx(0.12) and got[4] == (None, None) and got[5] == (None, None)
    half = spark.range(1).select(N.worst_half_width(F.lit(200.0))).first()[0]
    assert half == pytest.approx(0.06863914039610812)
    one = spark.createDataFrame([("a", 0.5)], "k string, m double")
    row = ST.seed_summary(one, ["k"], ["m"]).first()
    assert row.n == 1 and row.sd is None and row.ci95_low is None
    assert ST.T_975[3] == pytest.approx(2.7764451051977987)


def test_auc_and_precision_with_ties(spark):
    df = spark.createDataFrame([("k", 0.1, 0), ("k", 0.4, 1), ("k", 0.4, 0), ("k", 0.8, 1)], "k string, s double, y int")
    assert M.auc(df, ["k"], "s", F.col("y") == 1).first().auc == pytest.approx(0.875)
    assert M.average_precision(df, ["k"], "s", F.col("y") == 1).first().average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)
    none = df.withColumn("y", F.lit(0))
    assert M.auc(none, ["k"], "s", F.col("y") == 1).first().auc is None


def test_calibration_keeps_empty_bins(spark):
    df = spark.createDataFrame([("k", 1.0, 1), ("k", 0.05, 0)], "k string, p double, y int")
    bins = M.calibration_bins(df, ["k"], "p", F.col("y")).orderBy("bin").collect()
    assert len(bins) == 10 and bins[9].n == 1 and bins[0].n == 1 and bins[5].n == 0 and bins[5].mean_p is None


def test_decisions_are_strict(spark):
    df = spark.createDataFrame([(0.5, 0.6, "DDoS"), (0.49, 0.9, "DDoS"), (0.9, 0.59, "DDoS")], "p double, m double, f string")
    got = [r[0] for r in df.select(L.decide(F.col("p"), F.col("m"), F.col("f"), 0.5, 0.6)).collect()]
    assert got == ["DDoS", "Benign", "Unknown"]
    none = df.select(*[x.alias(n) for x, n in zip(L.rejector("conformal_reject", F.col("p"), F.col("m"), F.lit(0.1), F.lit(0.1), F.col("f"), 0.5, F.lit(None).cast("double")), "abc")]).collect()
    assert [r.a for r in none] == ["DDoS", "Benign", "DDoS"] and none[1].c == 0.0


def test_names_and_ports(spark):
    df = spark.createDataFrame([("  Flow ID (x) ",)], "n string")
    assert df.select(T.canonical(F.col("n"))).first()[0] == "flow_id_x"
    assert df.select(T.sanitized(F.lit(" ../: "))).first()[0] == "NA"
    ports = spark.createDataFrame([("80",), ("x",), (None,), ("50000",), ("-4",)], "p string").select(N.port_bucket(F.col("p"))).collect()
    assert [r[0] for r in ports] == ["well_known", "NA", "NA", "ephemeral", "NA"]


def test_taxonomies(spark):
    df = spark.createDataFrame([("DDoS-SynSurge",), ("DoS-IdleHold",), ("neptune.",), (None,), ("Fuzzers",)], "l string")
    got = lambda t: [r[0] for r in df.select(L.family_of(F.col("l"), t)).collect()]
    assert got("keyword")[:2] == ["DDoS", "DoS"]
    assert got("connection_records")[2] == "DoS"
    assert got("category")[3:] == ["Other", "Fuzzers"]
    assert set(got("absent")) == {"Other"}


def test_quotas_sum_and_cover(spark):
    counts = spark.createDataFrame([(f"s{n}", n) for n in range(0, 60)], "s string, n long")
    for r in S.quotas(counts, "n").collect():
        assert r.n_train + r.n_val + r.n_test == r.n and min(r.n_train, r.n_val, r.n_test) >= 0
        assert r.n < 3 or min(r.n_val, r.n_test) >= 1


def test_compressed_sweep_equals_naive(spark):
    df = spark.range(500).select(F.lit("k").alias("k"), (F.pmod(F.hash("id"), F.lit(11)) / 10).alias("p"), (F.pmod(F.hash(F.col("id") + 1), F.lit(11)) / 10).alias("pmax"), F.lit("DDoS").alias("pred_fam"), F.when(F.col("id") % 3 == 0, "Benign").otherwise("DDoS").alias("truth"))
    a = W.decided_counts(df, ["k"], [0.3, 0.5], [0.4, 0.5, 0.6]).collect()
    b = W.decided_counts_naive(df, ["k"], [0.3, 0.5], [0.4, 0.5, 0.6]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert sum(r.n for r in a) == 500 * 6


def test_holdout_audit(spark):
    s = spark.createDataFrame([("d", "Benign", 24, 12, 12), ("d", "Botnet", 20, 10, 10), ("d", "DDoS", 20, 10, 10)], "d string, family string, train long, val long, test long")
    rows = S.holdout_audit(s, ["d"], 8).collect()
    assert len(rows) == 2 and all(r.scenario_valid for r in rows)
    bad = S.holdout_audit(s, ["d"], 11).collect()
    assert all("unknown_val_below_min" in r.reasons for r in bad)
    assert S.holdout_audit(s.where("false"), ["d"], 1).count() == 0


def test_rates_are_finite(spark):
    low, high = N.wilson(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert row.a is None and row.b is None
    low, high = N.wilson(F.lit(5.0), F.lit(5.0))
    row = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert 0.5 < row.a < row.b <= 1 and not math.isnan(row.a)

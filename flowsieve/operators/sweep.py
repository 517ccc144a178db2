"""Operating-point sweeps.

The naive form joins every row with every candidate. The compressed form cuts each score at the candidates' values
once: rows are counted per (key, threshold bin, tau bin, truth, predicted family), a table whose size depends on the
candidates and labels only, and every candidate is evaluated on these counts. Both give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.selection import first_per_group


def cut_bin(score: Column, cuts: list[float]) -> Column:
    """Number of cuts that are at or below the score: score < cuts[i] exactly if the bin is at most i."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= score))


def states(df: DataFrame, keys: list[str], thresholds: list[float], taus: list[float], p: str = "p", pmax: str = "pmax") -> DataFrame:
    return df.groupBy(*keys, cut_bin(F.col(p), thresholds).alias("p_bin"), cut_bin(F.col(pmax), taus).alias("m_bin"), "truth", "pred_fam").agg(F.count(F.lit(1)).alias("n"))


def decided_counts(df: DataFrame, keys: list[str], thresholds: list[float], taus: list[float]) -> DataFrame:
    """keys, threshold, tau, truth, pred, n for every candidate, from compressed states."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"), F.lit(j).alias("j"), F.lit(float(u)).alias("tau")) for i, t in enumerate(sorted(thresholds)) for j, u in enumerate(sorted(taus))])).alias("c")
    each = states(df, keys, sorted(thresholds), sorted(taus)).select("*", grid)
    pred = F.when(F.col("p_bin") <= F.col("c.i"), "Benign").when(F.col("m_bin") <= F.col("c.j"), "Unknown").otherwise(F.col("pred_fam"))
    return each.groupBy(*keys, F.col("c.threshold").alias("threshold"), F.col("c.tau").alias("tau"), "truth", pred.alias("pred")).agg(F.sum("n").alias("n"))


def decided_counts_naive(df: DataFrame, keys: list[str], thresholds: list[float], taus: list[float]) -> DataFrame:
    """The same by one row per (row, candidate); for comparison."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(u)).alias("tau")) for t in thresholds for u in taus])).alias("c")
    each = df.select(*keys, "p", "pmax", "pred_fam", "truth", grid)
    pred = F.when(F.col("p") < F.col("c.threshold"), "Benign").when(F.col("pmax") < F.col("c.tau"), "Unknown").otherwise(F.col("pred_fam"))
    return each.groupBy(*keys, F.col("c.threshold").alias("threshold"), F.col("c.tau").alias("tau"), "truth", pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def candidate_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of every candidate from decided counts."""
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    t, q = F.col("truth"), F.col("pred")
    return counts.groupBy(*keys).agg(
        F.try_divide(n(t == q), F.sum("n")).alias("accuracy"),
        F.try_divide(n((t == "Benign") & ~q.isin("Benign", "Unknown")), n(t == "Benign")).alias("benign_fp_rate"),
        F.try_divide(n(q == "Unknown"), F.sum("n")).alias("overall_reject_rate"),
        F.try_divide(n((t == "Unknown") & (q == "Unknown")), n(t == "Unknown")).alias("unknown_detection_rate"),
        F.try_divide(n((t != "Unknown") & (q == "Unknown")), n(t != "Unknown")).alias("false_unknown_rate"),
    )


def best_feasible(metrics: DataFrame, keys: list[str], bars: dict[str, float], order: list[Column], slack: float = 1e-12) -> DataFrame:
    """Best candidate of each group that keeps all bars; where none does, the best one with `feasible` = false."""
    ok = F.lit(True)
    for c, most in bars.items():
        ok = ok & (F.coalesce(F.col(c), F.lit(0.0)) <= most + slack)
    return first_per_group(metrics.withColumn("feasible", ok), keys, [F.col("feasible").desc(), *order])

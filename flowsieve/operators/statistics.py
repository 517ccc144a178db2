"""Multiple testing, repeated seeds and bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: 0.975 quantile of Student's t for 1 to 30 degrees of freedom.
T_975 = [
    12.706204736432095, 4.302652729911275, 3.182446305284263, 2.7764451051977987, 2.570581835636314, 2.4469118511449692, 2.3646242515927844,
    2.3060041352041662, 2.2621571628540993, 2.2281388519649385, 2.200985160082949, 2.1788128296634177, 2.1603686564610127, 2.1447866879169273,
    2.131449545559323, 2.119905299221011, 2.109815577833181, 2.10092204024096, 2.093024054408263, 2.085963447265837, 2.079613844727662,
    2.0738730679040147, 2.0686576104190406, 2.0638985616280205, 2.059538552753294, 2.055529438642871, 2.0518305164802833, 2.048407141795244,
    2.045229642132703, 2.042272456301238,
]


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, tie: str) -> DataFrame:
    """Adds `p_bh` and `p_bonferroni`; null and NaN p-values are no tests and stay null."""
    valid = F.when(~F.isnan(p), F.col(p))
    group = Window.partitionBy(*keys, "_v")
    marked = df.withColumn("_p", valid).withColumn("_v", F.col("_p").isNotNull())
    marked = marked.withColumns({"_m": F.count(F.lit(1)).over(group), "_rn": F.row_number().over(group.orderBy("_p", tie))})
    back = group.orderBy(F.col("_rn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    capped = lambda x: F.when(F.col("_v"), F.least(F.lit(1.0), x))
    adjusted = capped(F.min(F.col("_p") * F.col("_m") / F.col("_rn")).over(back))
    return marked.withColumns({"p_bh": adjusted, "p_bonferroni": capped(F.col("_p") * F.col("_m"))}).drop("_p", "_v", "_m", "_rn")


def seed_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, n, mean, sd, min, max and the bounds of the 95 % t interval (null for one value)."""
    long = df.unpivot(keys, metrics, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    out = long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    t = F.get(F.array(*[F.lit(x) for x in T_975]), F.least(F.col("n") - 2, F.lit(29)).cast("int"))
    half = F.when(F.col("n") > 1, t * F.col("sd") / F.sqrt("n"))
    return out.withColumns({"ci95_low": F.col("mean") - half, "ci95_high": F.col("mean") + half})


def bootstrap_states(states: DataFrame, keys: list[str], resamples: int = 1000, seed: int = 123) -> DataFrame:
    """Percentile intervals of macro-F1 and detection of unknowns from confusion states (keys, true_label, pred_label, n).

    A group is its confusion matrix, hence bounded by the square of the number of labels; rows are never collected.
    """
    shape = ", ".join(f"{k} string" for k in keys) + ", metric string, estimate double, low double, high double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf["n"].to_numpy(np.int64)
        truth, pred = pdf["true_label"].to_numpy(str), pdf["pred_label"].to_numpy(str)
        labels = sorted({*truth, *pred})
        rng = np.random.default_rng([seed, *map(ord, "|".join(str(pdf[k].iloc[0]) for k in keys))])
        draws = np.vstack([counts, rng.multinomial(counts.sum(), counts / counts.sum(), resamples)]).astype(float)
        f1 = []
        for x in labels:
            tp = draws[:, (truth == x) & (pred == x)].sum(1)
            both = draws[:, truth == x].sum(1) + draws[:, pred == x].sum(1)
            f1.append(np.divide(2 * tp, both, out=np.zeros_like(tp), where=both > 0))
        unknown = draws[:, truth == "Unknown"].sum(1)
        found = np.divide(draws[:, (truth == "Unknown") & (pred == "Unknown")].sum(1), unknown, out=np.full(len(draws), np.nan), where=unknown > 0)
        out = []
        for name, v in (("macro_f1", np.mean(f1, axis=0)), ("unknown_detection_rate", found)):
            rest = v[1:][~np.isnan(v[1:])]
            low, high = np.quantile(rest, [0.025, 0.975]) if len(rest) else (None, None)
            out.append([*[str(pdf[k].iloc[0]) for k in keys], name, None if np.isnan(v[0]) else float(v[0]), low, high])
        return pd.DataFrame(out, columns=[*keys, "metric", "estimate", "low", "high"])

    return states.groupBy(*keys).applyInPandas(run, shape)


def paired_bootstrap(states: DataFrame, keys: list[str], resamples: int = 1000, seed: int = 123) -> DataFrame:
    """Difference of accuracy and of unknown detection between two methods, with a two-sided p-value.

    `states`: keys, true_label, pred_a, pred_b, n: joint counts of truth and both decisions.
    """
    shape = ", ".join(f"{k} string" for k in keys) + ", metric string, delta double, low double, high double, p_value double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf["n"].to_numpy(np.int64)
        rng = np.random.default_rng([seed, *map(ord, "|".join(str(pdf[k].iloc[0]) for k in keys))])
        draws = np.vstack([counts, rng.multinomial(counts.sum(), counts / counts.sum(), resamples)]).astype(float)
        truth, a, b = (pdf[c].to_numpy(str) for c in ("true_label", "pred_a", "pred_b"))
        out = []
        for name, base, x, y in (("accuracy", np.ones(len(counts), bool), truth == a, truth == b), ("unknown_detection_rate", truth == "Unknown", a == "Unknown", b == "Unknown")):
            n = draws[:, base].sum(1)
            d = np.divide(draws[:, base & x].sum(1) - draws[:, base & y].sum(1), n, out=np.full(len(n), np.nan), where=n > 0)
            rest = d[1:][~np.isnan(d[1:])]
            if not len(rest):
                out.append([*[str(pdf[k].iloc[0]) for k in keys], name, None, None, None, None])
                continue
            p = min(1.0, 2 * min((rest <= 0).mean(), (rest >= 0).mean()))
            out.append([*[str(pdf[k].iloc[0]) for k in keys], name, float(d[0]), *map(float, np.quantile(rest, [0.025, 0.975])), float(p)])
        return pd.DataFrame(out, columns=[*keys, "metric", "delta", "low", "high", "p_value"])

    return states.groupBy(*keys).applyInPandas(run, shape)

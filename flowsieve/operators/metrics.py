"""Metrics as one projection and one or two aggregations; everything is combined map-side, labels are tiny relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.prefix import running_sums


def rate(hit: Column, base: Column, undefined: str = "null") -> Column:
    """Share of `base` rows that are `hit`; with no base rows null, 0 (`zero`) or an error (`error`)."""
    n = F.count_if(base)
    value = F.try_divide(F.count_if(hit & base), n)
    if undefined == "zero":
        return F.coalesce(value, F.lit(0.0))
    if undefined == "error":
        return F.when(n == 0, F.raise_error(F.lit("rate without rows")).cast("double")).otherwise(value)
    return value


def confusion(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """Long confusion counts: keys, true_label, pred_label, n."""
    return df.groupBy(*keys, F.col(truth).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))


def per_label(matrix: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Per key and declared label: tp, support, predicted, precision, recall, f1 (0 where undefined).

    Labels without rows are kept; predictions outside the declared set still cost recall.
    """
    declared = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    # every matrix cell counts for its true label and for its predicted one; no join is needed
    sides = F.explode(
        F.array(
            F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
        )
    )
    seen = matrix.select(*keys, sides.alias("x")).select(*keys, "x.*")
    empty = matrix.select(*keys).distinct().select(*keys, declared).withColumns({c: F.lit(0).cast("long") for c in ("support", "predicted", "tp")})
    sums = seen.where(F.col("label").isin(labels)).unionByName(empty).groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.withColumns({
        "precision": zero(F.col("tp"), F.col("predicted")), "recall": zero(F.col("tp"), F.col("support")),
        "f1": zero(2 * F.col("tp"), F.col("support") + F.col("predicted")),
    })


def macro_f1(matrix: DataFrame, keys: list[str], labels: list[str], supported_only: bool = False) -> DataFrame:
    table = per_label(matrix, keys, labels)
    return (table.where(F.col("support") > 0) if supported_only else table).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def report(matrix: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Rows per label plus `macro avg` and `weighted avg`, from one pass by grouping sets."""
    table = per_label(matrix, keys, labels)
    share = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    cols = ["precision", "recall", "f1"]
    each = table.select(*keys, "label", *cols, "support")
    macro = table.groupBy(*keys).agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support"))
    weighted = table.groupBy(*keys).agg(F.lit("weighted avg").alias("label"), *[share(c).alias(c) for c in cols], F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted)


def system_columns(undefined: str = "null") -> dict[str, Column]:
    """Aggregates over columns truth, pred, y1 of a decided score frame."""
    truth, pred = F.col("truth"), F.col("pred")
    known_attack = (truth != "Benign") & (truth != "Unknown")
    always = F.lit(True)
    return {
        "n_rows": F.count(F.lit(1)),
        "accuracy": rate(truth == pred, always, undefined),
        "benign_fp_rate": rate(~pred.isin("Benign", "Unknown"), truth == "Benign", undefined),
        "benign_reject_rate": rate(pred == "Unknown", truth == "Benign", undefined),
        "overall_reject_rate": rate(pred == "Unknown", always, undefined),
        "unknown_detection_rate": rate(pred == "Unknown", truth == "Unknown", undefined),
        "false_unknown_all_known": rate(pred == "Unknown", truth != "Unknown", undefined),
        "false_unknown_known_attacks": rate(pred == "Unknown", known_attack, undefined),
        "unknown_support": F.count_if(truth == "Unknown"),
    }


def auc(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """ROC-AUC with ties averaged, as a rank sum: rows are first combined per distinct score."""
    by = df.groupBy(*keys, score).agg(F.count_if(positive).alias("_p"), F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(by, keys, [score], {"_upto": F.col("_n")}).withColumn("rank", F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("_p")).alias("r"), F.sum("_p").cast("double").alias("_p"), F.sum("_n").cast("double").alias("_n"))
    return sums.select(*keys, F.try_divide(F.col("r") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * (F.col("_n") - F.col("_p"))).alias("auc"))


def average_precision(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Step-wise area under precision and recall, ties grouped."""
    by = df.groupBy(*keys, score).agg(F.count_if(positive).alias("_p"), F.count(F.lit(1)).alias("_n"))
    run = running_sums(by, keys, [F.col(score).desc()], {"tp": F.col("_p"), "all": F.col("_n")})
    return run.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_p") * F.col("tp") / F.col("all")), F.sum("_p")).alias("average_precision"))


def calibration_bins(df: DataFrame, keys: list[str], p: str, y: Column, bins: int = 10) -> DataFrame:
    """Per bin: n, mean prediction, mean outcome, gap; the last bin is closed, empty bins are kept."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    seen = df.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y.cast("double")).alias("mean_y"))
    frame = seen.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(seen, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y", F.abs(F.col("mean_p") - F.col("mean_y")).alias("gap"))


def ece(df: DataFrame, keys: list[str], p: str, y: Column, bins: int = 10) -> DataFrame:
    table = calibration_bins(df, keys, p, y, bins)
    return table.groupBy(*keys).agg(F.try_divide(F.sum(F.col("gap") * F.col("n")), F.sum("n")).alias("ece"))

"""Shared relations of the queries, each as a DataFrame and as the same SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.functions.labels import decide
from flowsieve.functions.numbers import finite
from flowsieve.tables import table

FAMILIES = ["DDoS", "DoS", "Botnet", "Scan/Recon", "BruteForce", "Web/App", "Other"]
LABELS = ["Benign", *FAMILIES, "Unknown"]
THRESHOLD, TAU = 0.5, 0.6


class Book:
    """Queries of one module, with their SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def register(query):
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return register


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """flows with tidy split, family and fine label."""
    tidy = {"split": F.lower(F.trim("split")), "family": F.coalesce(F.trim("y_stage2_family"), F.lit("")), "fine": F.coalesce(F.trim("y_stage2_fine"), F.lit(""))}
    return table(spark, folder, "flows").withColumns(tidy)


FLOWS = "f AS (SELECT * REPLACE (lower(trim(split)) AS split), coalesce(trim(y_stage2_family), '') AS family, coalesce(trim(y_stage2_fine), '') AS fine FROM flows)"


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """The latest score of each (run, row) with valid probabilities; the central fact table."""
    latest = Window.partitionBy("run_id", "row_id").orderBy(F.col("loaded_at").desc(), F.col("score_id").desc())
    t = table(spark, folder, "score_frame")
    # only four columns are shuffled to find the few older loads; these are taken out by a join that AQE broadcasts if small
    older = t.select("run_id", "row_id", "loaded_at", "score_id").withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") > 1).select("score_id")
    t = t.join(older, "score_id", "left_anti")
    valid = F.col("p_attack").between(0, 1) & F.col("fam_pmax").between(0, 1)
    return t.where(valid).select(
        "score_id", "run_id", "dataset", "model_name", "run_seed", "holdout_family", "row_id", F.lower(F.trim("split")).alias("split"),
        F.col("y_stage1_attack").alias("y1"), F.coalesce(F.trim("y_stage2_family"), F.lit("")).alias("fam"), F.col("y_true_sys").alias("truth"),
        F.col("is_true_unknown").alias("unk"), F.col("p_attack").alias("p"), F.col("fam_pred_idx").alias("idx"), F.col("fam_pred_family").alias("pred_fam"),
        F.col("fam_pmax").alias("pmax"), F.col("top2_margin").alias("margin"), F.col("stage2_entropy").alias("entropy"), finite(F.col("true_known_family_prob")).alias("tprob"),
    )


SCORES = (
    "s AS (SELECT score_id, run_id, dataset, model_name, run_seed, holdout_family, row_id, lower(trim(split)) AS split, y_stage1_attack AS y1, coalesce(trim(y_stage2_family), '') AS fam, "
    "y_true_sys AS truth, is_true_unknown AS unk, p_attack AS p, fam_pred_idx AS idx, fam_pred_family AS pred_fam, fam_pmax AS pmax, top2_margin AS margin, stage2_entropy AS entropy, "
    "CASE WHEN isfinite(true_known_family_prob) THEN true_known_family_prob END AS tprob FROM (SELECT *, row_number() OVER (PARTITION BY run_id, row_id ORDER BY loaded_at DESC, score_id DESC) AS rn FROM score_frame) "
    "WHERE rn = 1 AND isfinite(p_attack) AND p_attack BETWEEN 0 AND 1 AND isfinite(fam_pmax) AND fam_pmax BETWEEN 0 AND 1)"
)


def setting(spark: SparkSession, name: str, default: float) -> float:
    """A number from `spark.flowsieve.<name>` of the session's configuration, else the default."""
    return float(spark.conf.get(f"spark.flowsieve.{name}", str(default)))


def decided(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with the system's decision; `spark.flowsieve.threshold` and `spark.flowsieve.tau` replace the defaults."""
    threshold, tau = setting(spark, "threshold", THRESHOLD), setting(spark, "tau", TAU)
    return scores(spark, folder).withColumn("pred", decide(F.col("p"), F.col("pmax"), F.col("pred_fam"), threshold, tau))


DECIDED = f"{SCORES}, d AS (SELECT *, CASE WHEN p < {THRESHOLD} THEN 'Benign' WHEN pmax < {TAU} THEN 'Unknown' ELSE pred_fam END AS pred FROM s)"
IN_LABELS = ", ".join(f"('{x}')" for x in LABELS)
#: per run and declared label: tp, support, predicted
PER_LABEL = (
    f"{DECIDED}, lab(label) AS (VALUES {IN_LABELS}), c AS (SELECT run_id, truth AS true_label, pred AS pred_label, count(*) AS n FROM d GROUP BY ALL), "
    "pl AS (SELECT r.run_id, label, coalesce(sum(n) FILTER (WHERE true_label = label AND pred_label = label), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (WHERE true_label = label), 0)::BIGINT AS support, "
    "coalesce(sum(n) FILTER (WHERE pred_label = label), 0)::BIGINT AS predicted FROM (SELECT DISTINCT run_id FROM c) r CROSS JOIN lab LEFT JOIN c ON c.run_id = r.run_id AND (true_label = label OR pred_label = label) GROUP BY ALL)"
)
F1 = "CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END"

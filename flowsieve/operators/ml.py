"""Score sources on pyspark.ml: preprocessing, classifiers, calibration and ensembles.

Gradient-boosting libraries are not available to Spark; their profiles are mapped to GBT, in stage 2 one against the
rest, which is an approximation: the probabilities differ, the data flow (weights, hold-outs, score frames) is the same.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import arrays as A
from flowsieve.functions.numbers import finite, logit

PROFILES = {
    "rf": lambda **k: RandomForestClassifier(numTrees=20, maxDepth=8, **k),
    "extra": lambda **k: RandomForestClassifier(numTrees=30, maxDepth=8, featureSubsetStrategy="onethird", **k),
    "xgb": lambda **k: GBTClassifier(maxIter=10, maxDepth=4, **k),
    "lgbm": lambda **k: GBTClassifier(maxIter=10, maxDepth=5, stepSize=0.2, **k),
}


def scaling(df: DataFrame, features: list[str], categorical: str | None = None, top: int = 50) -> tuple[dict[str, tuple[float, float]], list[str]]:
    """Mean and population deviation (below 1e-8: 1) of each feature, and the most frequent categories."""
    stats = df.agg(*[F.avg(finite(F.col(c).cast("double"))).alias("m_" + c) for c in features], *[F.stddev_pop(finite(F.col(c).cast("double"))).alias("s_" + c) for c in features]).first()
    scale = {c: (stats["m_" + c] or 0.0, stats["s_" + c] if stats["s_" + c] and stats["s_" + c] >= 1e-8 else 1.0) for c in features}
    if not categorical:
        return scale, []
    counts = df.groupBy(F.coalesce(F.col(categorical), F.lit("NA")).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "c").limit(top).collect()
    return scale, [r.c for r in counts]


def scaled(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardised features; missing values become 0, the mean."""
    return df.withColumns({f"z_{c}": F.coalesce((finite(F.col(c).cast("double")) - m) / s, F.lit(0.0)) for c, (m, s) in scale.items()})


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Adds `weight`: inverse frequency of the label, 1 on average; the counts are one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total, k = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    return df.join(F.broadcast(counts), label).withColumn("weight", F.lit(float(total or 0)) / (F.lit(float(k)) * F.col("_n"))).drop("_n")


def balanced(df: DataFrame, label: str, seed: int) -> DataFrame:
    """A draw, by hash, in which every class has about as many rows as the rarest; the counts are one row per class."""
    counts = {r[0]: r["count"] for r in df.groupBy(label).count().collect()}
    least = min(counts.values(), default=0)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *df.columns), 11) / float(1 << 53)
    share = F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(k)), F.lit(least / n)) for k, n in counts.items()]) if counts else F.lit(1.0)
    return df.where(u < share)


def two_stage(train: DataFrame, features: list[str], profile: str = "rf", holdout: str | None = None, stage1_holdout: bool = False, seed: int = 7):
    """Fitted (scale, stage 1 pipeline, stage 2 pipeline, families) on columns y1, family and features.

    The held-out family never reaches stage 2, and with `stage1_holdout` neither stage 1.
    """
    scale, _ = scaling(train, features)
    z = [f"z_{c}" for c in features]
    ready = scaled(train, scale)
    first = ready.where(F.col("family") != holdout) if stage1_holdout and holdout else ready
    assemble = VectorAssembler(inputCols=z, outputCol="x")
    stage1 = Pipeline(stages=[assemble, PROFILES[profile](featuresCol="x", labelCol="y1", weightCol="weight", seed=seed)]).fit(weighted(first, "y1"))
    attacks = ready.where("y1 = 1")
    if holdout:
        attacks = attacks.where(F.col("family") != holdout)
    families = sorted(r.family for r in attacks.select("family").distinct().collect())
    if len(families) < 2:
        raise ValueError("stage 2 needs two families")
    index = StringIndexer(inputCol="family", outputCol="k", stringOrderType="alphabetAsc", handleInvalid="keep")
    if profile in ("xgb", "lgbm"):  # boosted trees know two classes
        base = OneVsRest(classifier=PROFILES[profile](seed=seed), featuresCol="x", labelCol="k", weightCol="weight", parallelism=4)
    else:
        base = PROFILES[profile](featuresCol="x", labelCol="k", weightCol="weight", seed=seed)
    stage2 = Pipeline(stages=[assemble, index, base]).fit(weighted(attacks, "family"))
    return scale, stage1, stage2, families


def score_frame(model, rows: DataFrame) -> DataFrame:
    """p_attack, fam_pred_family, fam_pmax, top2_margin and stage2_entropy for each row."""
    scale, stage1, stage2, families = model
    out = stage1.transform(scaled(rows, scale)).withColumn("p_attack", F.get(vector_to_array("probability"), F.lit(1))).drop("x", "probability", "rawPrediction", "prediction")
    out = stage2.transform(out)
    if "probability" in out.columns:
        each = vector_to_array("probability")
    else:  # one against the rest: the logistic function of each model's margin
        each = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
    out = out.withColumn("q", A.normalised(F.slice(each, 1, len(families))))
    names = F.array(*[F.lit(f) for f in families])
    return out.withColumns({
        "fam_pred_family": F.get(names, A.argmax(F.col("q"))), "fam_pmax": F.array_max("q"), "top2_margin": A.top2_margin(F.col("q")), "stage2_entropy": A.entropy(F.col("q")),
    }).drop("x", "k", "probability", "rawPrediction", "prediction")


def fit_platt(df: DataFrame, p: str, y: str) -> tuple[float, float]:
    """(a, b) of Platt's sigmoid: logistic regression on the logit, without penalty."""
    ready = df.select(logit(F.col(p)).alias("l"), F.col(y).cast("double").alias("y"))
    m = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.0).fit(VectorAssembler(inputCols=["l"], outputCol="x").transform(ready))
    return float(m.coefficients[0]), float(m.intercept)


def fit_temperature(df: DataFrame, p: str, truth: str, grid: list[float]) -> float:
    """Temperature with the least mean negative log-likelihood of the true class; all candidates in one aggregation."""
    nll = [F.avg(-F.ln(F.greatest(F.get(A.tempered(F.col(p), t), F.col(truth)), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(grid)]
    row = df.agg(*nll).first()
    return min(zip(row, grid))[1]


def best_features(df: DataFrame, features: list[str], label: str, k: int) -> list[str]:
    """The k features with the largest ANOVA F value."""
    x = VectorAssembler(inputCols=features, outputCol="x").transform(df)
    s = UnivariateFeatureSelector(featuresCol="x", labelCol=label, outputCol="o", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return [features[i] for i in s.fit(x).selectedFeatures]


def soft_vote(frames: list[DataFrame], key: str, p: str) -> DataFrame:
    """Mean probability of several models per key."""
    out = frames[0].select(key, p)
    for f in frames[1:]:
        out = out.unionAll(f.select(key, p))
    return out.groupBy(key).agg(F.avg(p).alias(p), F.count(F.lit(1)).alias("n_models"))

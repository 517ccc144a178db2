"""Compositions (ANA-01 to ANA-33) and estimators (ML-01 to ML-10)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsieve.functions import labels as L
from flowsieve.functions import numbers as N
from flowsieve.operators import metrics as M
from flowsieve.operators import ml
from flowsieve.operators import selection as P
from flowsieve.operators import splitting as S
from flowsieve.operators import statistics as ST
from flowsieve.operators import sweep as W
from flowsieve.operators.prefix import quantiles
from flowsieve.plans.base import DECIDED, F1, FLOWS, LABELS, PER_LABEL, SCORES, Book, decided, flows, scores
from flowsieve.plans.clean_queries import _QUOTA
from flowsieve.plans.metric_queries import REJECTED, _FAM, rejected_by_methods, support_family
from flowsieve.plans.window_queries import _CM, _METH, _SWEEP, RUNS, methods, runs, swept
from flowsieve.streaming import incremental
from flowsieve.tables import table

book = Book()
R = lambda c, n=6: F.round(c, n)

_SUP = f"{FLOWS}, c AS (SELECT dataset, {_FAM} AS family, count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test FROM f GROUP BY ALL)"


def support(spark, d):
    return S.support_table(flows(spark, d), ["dataset"], F.col("split"), support_family(), ["train", "val", "test"])


def _audit_sql(least: str, source: str = "c", keys: str = "dataset") -> str:
    """Audit of every holdout of every key at the minimum `least`."""
    on = " AND ".join(f"k.{x} = h.{x}" for x in keys.split(", "))
    ben = " AND ".join(f"b.{x} = h.{x}" for x in keys.split(", "))
    hk = ", ".join(f"h.{x}" for x in keys.split(", "))
    return (
        f"kn AS (SELECT * FROM {source} WHERE family NOT IN ('Benign', '__EMPTY__') AND train > 0), "
        f"au AS (SELECT {hk}, h.family AS holdout_family, coalesce(any_value(b.val), 0) AS benign_val, coalesce(any_value(b.test), 0) AS benign_test, any_value(h.val) AS unknown_val, any_value(h.test) AS unknown_test, count(k.family) AS n_known, "
        f"coalesce(array_to_string(list(k.family ORDER BY k.family) FILTER (WHERE k.train >= {least} AND k.val >= {least} AND k.test >= {least}), '|'), '') AS valid_known, "
        f"coalesce(array_to_string(list(k.family ORDER BY k.family) FILTER (WHERE NOT (k.train >= {least} AND k.val >= {least} AND k.test >= {least})), '|'), '') AS invalid_known, "
        f"count_if(k.train >= {least} AND k.val >= {least} AND k.test >= {least}) AS n_valid, any_value({least}) AS least FROM kn h LEFT JOIN kn k ON {on} AND k.family <> h.family LEFT JOIN {source} b ON {ben} AND b.family = 'Benign' GROUP BY {hk}, h.family)"
    )


_VALID = "(benign_val >= least AND benign_test >= least AND unknown_val >= least AND unknown_test >= least AND n_valid >= 1 AND invalid_known = '')"
_REASONS = (
    "array_to_string(list_filter([CASE WHEN benign_val < least THEN 'benign_val_below_min' END, CASE WHEN benign_test < least THEN 'benign_test_below_min' END, CASE WHEN unknown_val < least THEN 'unknown_val_below_min' END, "
    "CASE WHEN unknown_test < least THEN 'unknown_test_below_min' END, CASE WHEN n_valid < 1 THEN 'not_enough_valid_known_families_after_holdout' END, CASE WHEN invalid_known <> '' THEN 'remaining_known_families_failed_support_rule' END], lambda x: x IS NOT NULL), '|')"
)


@book("ana01_support_audit", f"WITH {_SUP}, {_audit_sql('2')} SELECT dataset, holdout_family, benign_val, benign_test, unknown_val, unknown_test, n_known, valid_known, invalid_known, {_REASONS} AS reasons, {_VALID} AS scenario_valid FROM au")
def ana01(spark, d):
    a = S.holdout_audit(support(spark, d), ["dataset"], 2)
    joined = {c: F.array_join(c, "|").alias(c) for c in ("valid_known", "invalid_known", "reasons")}
    return a.select(*[joined.get(c, F.col(c)) for c in ("dataset", "holdout_family", "benign_val", "benign_test", "unknown_val", "unknown_test", "n_known", "valid_known", "invalid_known", "reasons", "scenario_valid")])


_LEASTS = (1, 2, 5, 10, 20)


@book(
    "ana02_support_sensitivity",
    " UNION ALL ".join(f"(WITH {_SUP}, {_audit_sql(str(x))} SELECT {x} AS threshold, dataset, holdout_family, {_REASONS} AS reasons, {_VALID} AS scenario_valid FROM au)" for x in _LEASTS),
)
def ana02(spark, d):
    """The audit at several minimums, from one support table."""
    s = support(spark, d)
    each = [S.holdout_audit(s, ["dataset"], x).select(F.lit(x).alias("threshold"), "dataset", "holdout_family", F.array_join("reasons", "|").alias("reasons"), "scenario_valid") for x in _LEASTS]
    out = each[0]
    for e in each[1:]:
        out = out.unionAll(e)
    return out


_CANDS = (
    f"{FLOWS}, l AS (" + " UNION ALL ".join(f"SELECT candidate_no, '{s}' AS split, trim(x) AS unit_id FROM (SELECT candidate_no, unnest(string_split(coalesce({s}_units, ''), '|')) AS x FROM candidate_splits)" for s in ("train", "val", "test"))
    + f"), a AS (SELECT DISTINCT candidate_no, split, unit_no FROM l JOIN plan_units USING (unit_id)), uc AS (SELECT unit_no, {_FAM} AS family, count(*) AS n FROM f GROUP BY ALL), "
    "c AS (SELECT candidate_no, family, coalesce(sum(n) FILTER (WHERE split = 'train'), 0)::BIGINT AS train, coalesce(sum(n) FILTER (WHERE split = 'val'), 0)::BIGINT AS val, coalesce(sum(n) FILTER (WHERE split = 'test'), 0)::BIGINT AS test FROM a JOIN uc USING (unit_no) GROUP BY ALL)"
)


def candidate_support(spark, d):
    """Support of every candidate split: (candidate, unit, split) joined with the unit x family counts, in one job."""
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.split(F.coalesce(F.col(f"{s}_units"), F.lit("")), "[|]").alias("ids")) for s in ("train", "val", "test")])
    listed = table(spark, d, "candidate_splits").select("candidate_no", F.explode(parts).alias("p")).select("candidate_no", "p.split", F.explode("p.ids").alias("unit_id"))
    assigned = listed.withColumn("unit_id", F.trim("unit_id")).join(table(spark, d, "plan_units").select("unit_id", "unit_no"), "unit_id").select("candidate_no", "split", "unit_no").distinct()
    counts = flows(spark, d).groupBy("unit_no", support_family().alias("family")).agg(F.count(F.lit(1)).alias("n"))
    n = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s)
    return assigned.join(counts, "unit_no").groupBy("candidate_no", "family").agg(*[n(s) for s in ("train", "val", "test")])


_SPLIT = f"{_CANDS}, {_audit_sql('2', keys='candidate_no')}, ev AS (SELECT candidate_no, count_if({_VALID}) AS n_eligible, max(CASE WHEN {_VALID} THEN n_valid ELSE 0 END) AS max_known, any_value(benign_val) AS bv, any_value(benign_test) AS bt FROM au GROUP BY 1)"
_EVAL_SCORE = "((CASE WHEN n_eligible > 0 AND bv >= 2 AND bt >= 2 THEN 1000000000000 ELSE 0 END) + n_eligible * 100000000 + max_known * 1000000 + bv + bt)::BIGINT"


@book("ana03_split_evaluation", f"WITH {_SPLIT} SELECT candidate_no, n_eligible, max_known, bv AS benign_val, bt AS benign_test, {_EVAL_SCORE} AS split_score FROM ev")
def ana03(spark, d):
    a = S.holdout_audit(candidate_support(spark, d), ["candidate_no"], 2)
    e = a.groupBy("candidate_no").agg(F.count_if("scenario_valid").alias("n_eligible"), F.max(F.when(F.col("scenario_valid"), F.size("valid_known")).otherwise(0)).alias("max_known"), F.any_value("benign_val").alias("benign_val"), F.any_value("benign_test").alias("benign_test"))
    ok = (F.col("n_eligible") > 0) & (F.col("benign_val") >= 2) & (F.col("benign_test") >= 2)
    score = F.when(ok, 10**12).otherwise(0) + F.col("n_eligible") * 10**8 + F.col("max_known") * 10**6 + F.col("benign_val") + F.col("benign_test")
    return e.withColumn("split_score", score.cast("long"))


@book("ana04_best_split", f"WITH {_SPLIT}, sc AS (SELECT candidate_no, {_EVAL_SCORE} AS split_score FROM ev) SELECT dataset, candidate_no, split_score FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY split_score DESC, candidate_no) AS k FROM sc JOIN candidate_splits USING (candidate_no)) WHERE k = 1")
def ana04(spark, d):
    """All candidates scored in one job, best first per dataset."""
    scored = ana03(spark, d).join(table(spark, d, "candidate_splits").select("candidate_no", "dataset"), "candidate_no")
    return P.first_per_group(scored, ["dataset"], [F.col("split_score").desc(), F.col("candidate_no")]).select("dataset", "candidate_no", "split_score")


@book("ana05_hill_climb")
def ana05(spark, d):
    """Randomised hill climbing over unit assignments of each dataset; only the unit x split sizes of one dataset at a
    time are in one task (a dataset's files, not its rows)."""
    units = flows(spark, d).where("unit_no IS NOT NULL").groupBy("dataset", "unit_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_stage1_attack") == 1).alias("a"))
    shape = "dataset string, unit_no long, split string, gap double"

    def climb(pdf):
        rng = np.random.default_rng(7)
        w = pdf[["n", "a"]].to_numpy(float)
        goal = np.outer([0.7, 0.15, 0.15], w.sum(0))
        best, best_gap = None, np.inf
        for _ in range(4):
            at = rng.choice(3, len(w), p=[0.7, 0.15, 0.15])
            have = np.array([w[at == s].sum(0) for s in range(3)])
            gap = np.abs(have - goal).sum()
            for _ in range(300):
                i, s = rng.integers(len(w)), rng.integers(3)
                new = have.copy()
                new[at[i]] -= w[i]
                new[s] += w[i]
                if (g := np.abs(new - goal).sum()) < gap:
                    have, gap, at[i] = new, g, s
            if gap < best_gap:
                best, best_gap = at.copy(), gap
        return pdf[["dataset", "unit_no"]].assign(split=np.array(["train", "val", "test"])[best], gap=best_gap / max(1.0, w.sum()))

    return units.groupBy("dataset").applyInPandas(climb, shape)


@book("ana06_planner", f"WITH {_SPLIT}, sc AS (SELECT candidate_no, n_eligible, {_EVAL_SCORE} AS split_score FROM ev), b AS (SELECT dataset, candidate_no, n_eligible, row_number() OVER (PARTITION BY dataset ORDER BY split_score DESC, candidate_no) AS k FROM sc JOIN candidate_splits USING (candidate_no)) SELECT b.dataset, b.candidate_no, n_eligible > 0 AS valid, split, count(*) AS n_units FROM b JOIN a USING (candidate_no) WHERE k = 1 GROUP BY ALL")
def ana06(spark, d):
    """The planner's outcome: units per split of the best candidate of each dataset."""
    e = ana03(spark, d)
    best = P.first_per_group(e.join(table(spark, d, "candidate_splits"), "candidate_no"), ["dataset"], [F.col("split_score").desc(), F.col("candidate_no")])
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.split(F.coalesce(F.col(f"{s}_units"), F.lit("")), "[|]").alias("ids")) for s in ("train", "val", "test")])
    listed = best.select("dataset", "candidate_no", (F.col("n_eligible") > 0).alias("valid"), F.explode(parts).alias("p")).select("dataset", "candidate_no", "valid", "p.split", F.explode("p.ids").alias("unit_id"))
    known = listed.withColumn("unit_id", F.trim("unit_id")).distinct().join(table(spark, d, "plan_units").select("unit_id"), "unit_id")
    return known.groupBy("dataset", "candidate_no", "valid", "split").agg(F.count(F.lit(1)).alias("n_units"))


@book(
    "ana07_stratified_split",
    f"WITH {FLOWS}, {_QUOTA}, r AS (SELECT fine, family, row_number() OVER (PARTITION BY fine ORDER BY md5(row_id::VARCHAR), row_id) AS k FROM f) SELECT family, CASE WHEN k <= n_train THEN 'train' WHEN k <= n_train + n_val THEN 'val' WHEN k <= n THEN 'test' ELSE 'train' END AS new_split, count(*) AS n FROM r JOIN q USING (fine) GROUP BY ALL",
)
def ana07(spark, d):
    """Stratified split by fine label: counts, quotas, fill in hash order."""
    f = flows(spark, d).select("row_id", "fine", "family")
    q = S.quotas(f.groupBy("fine").agg(F.count(F.lit(1)).alias("n")), "n")
    filled = S.quota_fill(f, "fine", [F.md5(F.col("row_id").cast("string")), F.col("row_id")], q)
    return filled.groupBy("family", F.col("split").alias("new_split")).agg(F.count(F.lit(1)).alias("n"))


@book(
    "ana08_dataset_profile",
    f"WITH {FLOWS} SELECT dataset, count(*) AS n_rows, count(DISTINCT fine) AS n_fine, count(DISTINCT family) AS n_families, count(DISTINCT unit_no) AS n_units, round(avg((NOT coalesce(isfinite(flow_bytes_s), false))::INT), 6) AS missing_bytes_s, round(avg((y_stage1_attack = 1)::INT), 6) AS attack_share FROM f GROUP BY dataset",
)
def ana08(spark, d):
    """Labels, units, missing values; distinct values are counted over pre-aggregated rows."""
    per = flows(spark, d).groupBy("dataset", "fine", "family", "unit_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(N.finite(F.col("flow_bytes_s")).isNull()).alias("miss"), F.count_if(F.col("y_stage1_attack") == 1).alias("a"))
    return per.groupBy("dataset").agg(
        F.sum("n").alias("n_rows"), F.count_distinct("fine").alias("n_fine"), F.count_distinct("family").alias("n_families"), F.count_distinct("unit_no").alias("n_units"),
        R(F.sum("miss") / F.sum("n")).alias("missing_bytes_s"), R(F.sum("a") / F.sum("n")).alias("attack_share"),
    )


@book("ana09_leakage_audit", f"WITH {FLOWS}, u AS (SELECT unit_no, list_sort(list(DISTINCT split)) AS s, count(*) AS n FROM f WHERE unit_no IS NOT NULL GROUP BY 1) SELECT array_to_string(s, '|') AS splits, count(*) AS n_units, sum(n)::BIGINT AS n_rows FROM u GROUP BY 1")
def ana09(spark, d):
    """Units whose rows lie in several splits."""
    u = flows(spark, d).where("unit_no IS NOT NULL").groupBy("unit_no").agg(F.array_join(F.array_sort(F.collect_set("split")), "|").alias("splits"), F.count(F.lit(1)).alias("n"))
    return u.groupBy("splits").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_rows"))


_FEATS = ("fwd_bytes", "pkt_len_mean", "fwd_hdr_len")


@book("ana10_preprocessor_fit", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(v), 4) AS mean, round(CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END, 4) AS sd FROM (SELECT CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END AS v FROM flows WHERE lower(trim(split)) = 'train')" for c in _FEATS))
def ana10(spark, d):
    scale, _ = ml.scaling(flows(spark, d).where("split = 'train'"), list(_FEATS), "protocol")
    return spark.createDataFrame([(c, *v) for c, v in scale.items()], "feature string, mean double, sd double").select("feature", R("mean", 4).alias("mean"), R("sd", 4).alias("sd"))


@book(
    "ana11_preprocessor_transform",
    "WITH t AS (SELECT " + ", ".join(f"avg(CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END) FILTER (WHERE lower(trim(split)) = 'train') AS m_{c}, stddev_pop(CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END) FILTER (WHERE lower(trim(split)) = 'train') AS s_{c}" for c in _FEATS) + " FROM flows) SELECT row_id, " + ", ".join(f"round(coalesce((CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END - m_{c}) / s_{c}, 0), 5) AS z_{c}" for c in _FEATS) + " FROM flows, t WHERE lower(trim(split)) = 'test'",
)
def ana11(spark, d):
    f = flows(spark, d)
    scale, _ = ml.scaling(f.where("split = 'train'"), list(_FEATS))
    return ml.scaled(f.where("split = 'test'"), scale).select("row_id", *[R(f"z_{c}", 5).alias(f"z_{c}") for c in _FEATS])


_QS = (0.9, 0.95, 0.99, 0.995)


@book(
    "ana12_fpr_threshold",
    f"WITH {SCORES}, b AS (SELECT run_id, unnest([" + ", ".join(f"quantile_cont(p, {q})" for q in _QS) + "]) AS thr FROM s WHERE y1 = 0 AND split = 'val' GROUP BY run_id), e AS (SELECT run_id, thr, avg((p >= thr)::INT) FILTER (WHERE y1 = 0) AS fpr, avg((p >= thr)::INT) FILTER (WHERE y1 = 1) AS tpr FROM b JOIN s USING (run_id) WHERE split = 'val' GROUP BY ALL) "
    "SELECT run_id, round(thr, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (fpr <= 0.05) DESC, tpr DESC NULLS LAST, thr) AS k FROM e) WHERE k = 1",
)
def ana12(spark, d):
    """Thresholds at benign quantiles, best recall under a false-alarm bar. A run's few thresholds travel as an array."""
    val = scores(spark, d).where("split = 'val'")
    cuts = quantiles(val.where("y1 = 0"), ["run_id"], "p", list(_QS)).withColumnRenamed("q", "cuts")
    each = val.join(cuts, "run_id").select("run_id", "p", "y1", F.explode(F.array_distinct("cuts")).alias("thr"))
    e = each.groupBy("run_id", "thr").agg(F.avg(F.when(F.col("y1") == 0, (F.col("p") >= F.col("thr")).cast("int"))).alias("fpr"), F.avg(F.when(F.col("y1") == 1, (F.col("p") >= F.col("thr")).cast("int"))).alias("tpr"))
    best = P.first_per_group(e, ["run_id"], [(F.col("fpr") <= 0.05).desc(), F.col("tpr").desc_nulls_last(), F.col("thr")])
    return best.select("run_id", R("thr").alias("threshold"), R("fpr").alias("fpr"), R("tpr").alias("tpr"))


_BARS = "coalesce(benign_fp_rate, 0) <= {0} + 1e-12 AND coalesce(overall_reject_rate, 0) <= {1} + 1e-12"


def _tuned_sql(where: str, bars: str, order: str) -> str:
    return f"WITH {_SWEEP} SELECT run_id, threshold, tau, feasible, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CM) + f" FROM (SELECT *, {bars} AS feasible, row_number() OVER (PARTITION BY run_id ORDER BY ({bars}) DESC, {order}) AS k FROM cm WHERE split = 'val' AND {where}) WHERE k = 1"


def tuned(df, bars, order):
    best = W.best_feasible(df, ["run_id"], bars, order)
    return best.select("run_id", "threshold", "tau", "feasible", *[R(c).alias(c) for c in _CM])




def _by_udr():
    return [F.round(F.coalesce("unknown_detection_rate", F.lit(-1.0)), 9).desc(), F.round("accuracy", 9).desc(), F.col("threshold"), F.col("tau")]


_BY_UDR = "round(coalesce(unknown_detection_rate, -1), 9) DESC, round(accuracy, 9) DESC, threshold, tau"


@book("ana13_tune_tau", _tuned_sql("threshold = 0.5", _BARS.format(0.02, 0.3), _BY_UDR))
def ana13(spark, d):
    """Abstention sweep at a fixed threshold under bars."""
    return tuned(swept(spark, d).where("split = 'val' AND threshold = 0.5"), {"benign_fp_rate": 0.02, "overall_reject_rate": 0.3}, _by_udr())


@book("ana14_joint_cascade", _tuned_sql("true", _BARS.format(0.05, 0.2), _BY_UDR))
def ana14(spark, d):
    """Joint sweep of threshold and tau."""
    return tuned(swept(spark, d).where("split = 'val'"), {"benign_fp_rate": 0.05, "overall_reject_rate": 0.2}, _by_udr())


@book("ana15_overlay", f"WITH {_SWEEP}, b AS (SELECT run_id, max(accuracy) AS best FROM cm WHERE split = 'val' GROUP BY 1) SELECT run_id, threshold, tau FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_BY_UDR}) AS k FROM cm JOIN b USING (run_id) WHERE split = 'val' AND accuracy >= best - 0.05 - 1e-12) WHERE k = 1")
def ana15(spark, d):
    """Best detection among candidates within an accuracy drop of 0.05."""
    val = swept(spark, d).where("split = 'val'")
    best = F.max("accuracy").over(Window.partitionBy("run_id"))
    near = val.withColumn("best", best).where(F.col("accuracy") >= F.col("best") - 0.05 - 1e-12)
    return P.first_per_group(near, ["run_id"], _by_udr()).select("run_id", "threshold", "tau")


@book("ana16_bias_ascent")
def ana16(spark, d):
    """Coordinate ascent of class multipliers: each step evaluates all candidates of one class in one aggregation."""
    from flowsieve.functions import arrays as A
    from flowsieve.plans.clean_queries import probs

    data = probs(spark, d).select("q", F.col("label").alias("y"))
    m, grid = [1.0] * 5, [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]
    score = 0.0
    for _ in range(2):
        for k in range(5):
            options = [[*m[:k], g, *m[k + 1 :]] for g in grid]
            row = data.agg(*[F.avg((A.argmax(A.biased(F.col("q"), o)) == F.col("y")).cast("int")).alias(str(i)) for i, o in enumerate(options)]).first()
            best = max(range(len(grid)), key=lambda i: (row[i] or 0.0, -abs(grid[i] - 1)))
            m, score = options[best], row[best] or 0.0
    return spark.createDataFrame([(k, x, float(score)) for k, x in enumerate(m)], "class int, multiplier double, accuracy double")


_REJ = "SELECT run_id, method, split, avg((truth = pred)::INT)::DOUBLE AS accuracy, avg((pred = 'Unknown')::INT)::DOUBLE AS rr, count_if(truth = 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth = 'Unknown'), 0) AS udr FROM r GROUP BY ALL"


@book("ana17_rejector_selection", f"WITH {REJECTED}, x AS ({_REJ}), b AS (SELECT run_id, method, row_number() OVER (PARTITION BY run_id ORDER BY (rr <= 0.3 + 1e-12) DESC, round(coalesce(udr, -1), 9) DESC, round(accuracy, 9) DESC, method) AS k FROM x WHERE split = 'val') SELECT b.run_id, b.method, round(t.accuracy, 6) AS test_accuracy, round(t.udr, 6) AS test_udr FROM b LEFT JOIN x t ON t.run_id = b.run_id AND t.method = b.method AND t.split = 'test' WHERE k = 1")
def ana17(spark, d):
    """Rejector chosen on val, replayed on test."""
    m = M.system_columns()
    x = rejected_by_methods(spark, d).groupBy("run_id", "method", "split").agg(m["accuracy"].alias("accuracy"), m["overall_reject_rate"].alias("rr"), m["unknown_detection_rate"].alias("udr"))
    best = P.first_per_group(x.where("split = 'val'"), ["run_id"], [(F.col("rr") <= 0.3 + 1e-12).desc(), F.round(F.coalesce("udr", F.lit(-1.0)), 9).desc(), F.round("accuracy", 9).desc(), F.col("method")])
    test = x.where("split = 'test'").select("run_id", "method", R("accuracy").alias("test_accuracy"), R("udr").alias("test_udr"))
    return best.select("run_id", "method").join(test, ["run_id", "method"], "left")


@book("ana17_rejection_curve", f"WITH {REJECTED}, b AS (SELECT method, doubt, count_if(unk = 1) AS a, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY method ORDER BY doubt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rk FROM b) SELECT method, round((sum(rk * a) - sum(a) * (sum(a) + 1) / 2) / nullif(sum(a) * (sum(n) - sum(a)), 0), 4) AS auroc FROM k GROUP BY method")
def ana17c(spark, d):
    """Area under the curve of unknown detection by each method's uncertainty."""
    return M.auc(rejected_by_methods(spark, d), ["method"], "doubt", F.col("unk") == 1).select("method", R("auc", 4).alias("auroc"))


_SINKS = [(st, mf) for st in (0.6, 0.7, 0.8) for mf in (0.1, 0.3)]


@book(
    "ana18_sink_frontier",
    f"WITH {SCORES}, g(st, mf) AS (VALUES {', '.join(f'({a}, {b})' for a, b in _SINKS)}), x AS (SELECT run_id, st::DOUBLE AS sink_tau, mf::DOUBLE AS floor, truth, CASE WHEN p < 0.5 THEN 'Benign' WHEN pmax < 0.4 OR (pred_fam = 'DDoS' AND (pmax < st OR margin < mf)) THEN 'Unknown' ELSE pred_fam END AS pred FROM s, g) "
    "SELECT run_id, sink_tau, floor, round(avg((truth = pred)::INT), 6) AS accuracy, round(avg((pred = 'Unknown')::INT), 6) AS reject_rate FROM x GROUP BY ALL",
)
def ana18(spark, d):
    """Frontier over (sink tau, margin floor); candidates are a fixed short list."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("st"), F.lit(b).alias("mf")) for a, b in _SINKS])).alias("c")
    each = scores(spark, d).select("run_id", "truth", "p", "pmax", "margin", "pred_fam", grid)
    pred = L.sink_aware(F.col("p"), F.col("pmax"), F.col("margin"), F.col("pred_fam"), "DDoS", 0.5, 0.4, F.col("c.st"), F.col("c.mf"))
    return each.groupBy("run_id", F.col("c.st").alias("sink_tau"), F.col("c.mf").alias("floor")).agg(R(F.avg((F.col("truth") == pred).cast("int"))).alias("accuracy"), R(F.avg((pred == "Unknown").cast("int"))).alias("reject_rate"))


@book("ana19_bootstrap_states")
def ana19(spark, d):
    return ST.bootstrap_states(M.confusion(decided(spark, d), ["run_id"], "truth", "pred"), ["run_id"], 500)


def _pairs(spark, d):
    r = rejected_by_methods(spark, d).where(F.col("method").isin("control_tau", "margin_reject"))
    both = r.groupBy("run_id", "score_id", "truth").pivot("method", ["control_tau", "margin_reject"]).agg(F.first("pred"))
    return both.groupBy("run_id", F.col("truth").alias("true_label"), F.col("control_tau").alias("pred_a"), F.col("margin_reject").alias("pred_b")).agg(F.count(F.lit(1)).alias("n"))


@book("ana20_paired_bootstrap")
def ana20(spark, d):
    return ST.paired_bootstrap(_pairs(spark, d), ["run_id"], 500)


@book("ana21_bootstrap_mean")
def ana21(spark, d):
    """Percentile interval of the mean accuracy over runs: B resamples drawn as Poisson weights, one aggregation."""
    m = runs(spark, d).select("accuracy", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("b"), F.xxhash64("run_id", "dataset").alias("h"))
    u = (F.shiftrightunsigned(F.xxhash64("h", "b"), 11) + 0.5) / float(1 << 53)
    weight = F.size(F.filter(F.array(*[F.lit(float(x)) for x in np.cumsum([np.exp(-1) / np.prod(range(1, k + 1) or [1]) for k in range(8)])]), lambda c: c < u))
    means = m.withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col("accuracy")) / F.greatest(F.lit(1), F.sum("w"))).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


@book("ana22_statistics_refresh")
def ana22(spark, d):
    """Paired tests of all runs with adjusted p-values."""
    out = ST.paired_bootstrap(_pairs(spark, d), ["run_id"], 500)
    return ST.benjamini_hochberg(out, ["metric"], "p_value", "run_id")


@book("ana23_validation_selected", f"WITH {DECIDED}, v AS (SELECT dataset, holdout_family, run_id, avg((truth = pred)::INT)::DOUBLE AS a FROM d WHERE split = 'val' GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, holdout_family ORDER BY a DESC, run_id) AS k FROM v) WHERE k = 1) SELECT b.dataset, b.holdout_family, b.run_id, round(b.a, 6) AS val_accuracy, round(avg((d.truth = d.pred)::INT), 6) AS test_accuracy FROM b LEFT JOIN d ON d.dataset = b.dataset AND d.run_id = b.run_id AND d.holdout_family = b.holdout_family AND d.split = 'test' GROUP BY ALL")
def ana23(spark, d):
    """Chosen by val only, reported on test."""
    keys = ["dataset", "holdout_family", "run_id"]
    per = decided(spark, d).groupBy(*keys).pivot("split", ["val", "test"]).agg(F.avg((F.col("truth") == F.col("pred")).cast("int")))
    best = P.first_per_group(per.where("val IS NOT NULL"), keys[:2], [F.col("val").desc(), F.col("run_id")])
    return best.select(*keys, R("val").alias("val_accuracy"), R("test").alias("test_accuracy"))


@book("ana24_grid_summary", f"WITH {RUNS}, x AS (SELECT *, 2.0 * accuracy - 1.0 * coalesce(benign_fp_rate, 1) - 0.5 * reject_rate AS sc FROM m) SELECT run_id, dataset, round(sc, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(sc, 9) DESC, run_id) AS rank FROM x)")
def ana24(spark, d):
    """All runs ranked by a weighted score."""
    score = N.rank_score({"accuracy": 2.0}, {"benign_fp_rate": 1.0, "reject_rate": 0.5})
    r = runs(spark, d).withColumn("sc", score)
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(F.round("sc", 9).desc(), "run_id"))
    return r.select("run_id", "dataset", R("sc").alias("score"), rank.alias("rank"))


@book("ana25_frontier_flags", f"WITH {_METH}, z AS (SELECT *, run_id || '/' || method AS id FROM mm) SELECT id, NOT EXISTS (SELECT 1 FROM z o WHERE o.run_id = z.run_id AND o.accuracy >= z.accuracy - 1e-12 AND o.reject_rate <= z.reject_rate + 1e-12 AND (o.accuracy > z.accuracy + 1e-12 OR o.reject_rate < z.reject_rate - 1e-12)) AS on_front FROM z")
def ana25(spark, d):
    q = methods(spark, d).withColumn("id", F.concat_ws("/", "run_id", "method"))
    return P.pareto(q, "id", ["run_id"], ["accuracy"], ["reject_rate"]).select("id", "on_front")


_POL = {"strict": (0.5, 0.0), "cascade": (0.3, 0.0), "strict_tau": (0.5, 0.6), "cascade_tau": (0.3, 0.6)}


@book(
    "ana26_four_policies",
    f"WITH {SCORES}, po(policy, thr, tau) AS (VALUES {', '.join(f"('{k}', {a}, {b})" for k, (a, b) in _POL.items())}), x AS (SELECT run_id, policy, truth, CASE WHEN p < thr THEN 'Benign' WHEN pmax < tau THEN 'Unknown' ELSE pred_fam END AS pred FROM s, po), lab(label) AS (VALUES {', '.join(f"('{x}')" for x in LABELS)}), "
    f"t AS (SELECT k.run_id, k.policy, label, count_if(truth = label AND pred = label) AS tp, count_if(truth = label) AS support, count_if(pred = label) AS predicted FROM (SELECT DISTINCT run_id, policy FROM x) k CROSS JOIN lab LEFT JOIN x ON x.run_id = k.run_id AND x.policy = k.policy AND (truth = label OR pred = label) GROUP BY ALL) SELECT run_id, policy, round(avg({F1}), 6) AS macro_f1 FROM t GROUP BY ALL",
)
def ana26(spark, d):
    """Full evaluation under four policies: one projection, one confusion table."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), L.decide(F.col("p"), F.col("pmax"), F.col("pred_fam"), a, b).alias("pred")) for k, (a, b) in _POL.items()])).alias("x")
    x = scores(spark, d).select("run_id", "truth", each).select("run_id", "truth", "x.*")
    return M.macro_f1(M.confusion(x, ["run_id", "policy"], "truth", "pred"), ["run_id", "policy"], LABELS).select("run_id", "policy", R("macro_f1").alias("macro_f1"))


@book("ana27_metric_correction", f"WITH {PER_LABEL}, f AS (SELECT *, {F1} AS f1 FROM pl) SELECT run_id, round(avg(f1) FILTER (WHERE support > 0 AND label <> 'Unknown'), 6) AS supported, round(avg(f1), 6) AS declared, count_if(support > 0 AND label <> 'Unknown') AS n_supported FROM f GROUP BY run_id")
def ana27(spark, d):
    """Macro-F1 over supported and over declared labels; Unknown predictions cost recall in both."""
    t = M.per_label(M.confusion(decided(spark, d), ["run_id"], "truth", "pred"), ["run_id"], LABELS)
    ok = (F.col("support") > 0) & (F.col("label") != "Unknown")
    return t.groupBy("run_id").agg(R(F.avg(F.when(ok, F.col("f1")))).alias("supported"), R(F.avg("f1")).alias("declared"), F.count_if(ok).alias("n_supported"))


@book("ana28_seed_campaign", f"WITH {RUNS} SELECT model_name, run_seed, count(DISTINCT run_id) AS n_runs, count(DISTINCT holdout_family) AS n_holdouts, round(avg(accuracy), 6) AS mean FROM m GROUP BY ALL")
def ana28(spark, d):
    return runs(spark, d).groupBy("model_name", "run_seed").agg(F.count_distinct("run_id").alias("n_runs"), F.count_distinct("holdout_family").alias("n_holdouts"), R(F.avg("accuracy")).alias("mean"))


@book("ana29_metric_drop", f"WITH {RUNS}, a AS (SELECT dataset, model_name, avg(accuracy) AS v FROM m GROUP BY ALL) SELECT dataset, model_name, round(v, 6) AS accuracy, round(v - max(v) OVER (PARTITION BY dataset), 6) AS drop_to_best FROM a")
def ana29(spark, d):
    a = runs(spark, d).groupBy("dataset", "model_name").agg(F.avg("accuracy").alias("v"))
    return a.select("dataset", "model_name", R("v").alias("accuracy"), R(F.col("v") - F.max("v").over(Window.partitionBy("dataset"))).alias("drop_to_best"))


@book("ana30_competitive_pack", f"WITH {RUNS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model_name ORDER BY accuracy DESC, run_id) AS k FROM m) WHERE k = 1) SELECT dataset, model_name, run_id, round(accuracy, 6) AS accuracy, round(accuracy - avg(accuracy) OVER (PARTITION BY dataset), 6) AS delta_to_mean FROM b")
def ana30(spark, d):
    b = P.first_per_group(runs(spark, d), ["dataset", "model_name"], [F.col("accuracy").desc(), F.col("run_id")])
    return b.select("dataset", "model_name", "run_id", R("accuracy").alias("accuracy"), R(F.col("accuracy") - F.avg("accuracy").over(Window.partitionBy("dataset"))).alias("delta_to_mean"))


@book("ana31_tradeoff_table", f"WITH {_METH}, c AS (SELECT run_id, method, accuracy - max(accuracy) FILTER (WHERE method = 'control_tau') OVER (PARTITION BY run_id) AS da, reject_rate - max(reject_rate) FILTER (WHERE method = 'control_tau') OVER (PARTITION BY run_id) AS dr FROM mm) SELECT run_id, method, CASE WHEN da >= 0.02 AND dr <= 0 THEN 'better' WHEN da <= -0.02 AND dr >= 0 THEN 'worse' ELSE 'tradeoff' END AS verdict FROM c WHERE method <> 'control_tau'")
def ana31(spark, d):
    c = P.delta_to(methods(spark, d), ["run_id"], F.col("method") == "control_tau", ["accuracy", "reject_rate"]).where("method <> 'control_tau'")
    a, r = F.col("delta_accuracy"), F.col("delta_reject_rate")
    return c.select("run_id", "method", F.when((a >= 0.02) & (r <= 0), "better").when((a <= -0.02) & (r >= 0), "worse").otherwise("tradeoff").alias("verdict"))


@book("ana32_release_gates", f"WITH {SCORES} SELECT model_name, count(DISTINCT run_seed) AS n_seeds, count(DISTINCT run_seed) = 3 AS all_seeds, count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM s) AS all_datasets FROM s GROUP BY model_name")
def ana32(spark, d):
    """Coverage gates: every model has all seeds and all datasets."""
    s = scores(spark, d).select("model_name", "run_seed", "dataset").distinct()
    n = s.select("dataset").distinct().count()
    return s.groupBy("model_name").agg(F.count_distinct("run_seed").alias("n_seeds"), (F.count_distinct("run_seed") == 3).alias("all_seeds"), (F.count_distinct("dataset") == n).alias("all_datasets"))


@book("ana33_status_upsert", "WITH n AS (SELECT feed_id, count(*) AS n FROM capture_files GROUP BY 1) SELECT feed_id, n, CASE WHEN n >= 10 THEN 'complete' ELSE 'partial' END AS status FROM n UNION ALL SELECT DISTINCT feed_id, 0, 'planned' FROM candidate_splits WHERE feed_id NOT IN (SELECT feed_id FROM n)")
def ana33(spark, d):
    """Planned feeds, each replaced by its newer row once files of it have arrived."""
    old = table(spark, d, "candidate_splits").where(F.col("feed_id").isNotNull()).select("feed_id").distinct().select("feed_id", F.lit(0).cast("long").alias("n"), F.lit("planned").alias("status"))
    n = table(spark, d, "capture_files").groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"))
    return P.upsert(old, n.withColumn("status", F.when(F.col("n") >= 10, "complete").otherwise("partial")), ["feed_id"])


@book("agg01_incremental_counts", f"WITH {FLOWS} SELECT dataset, split, count(*) AS n FROM f GROUP BY ALL")
def agg01_incremental(spark, d):
    """AGG-01 fed by a file stream: the same counts as in batch."""
    schema = table(spark, d, "flows").schema
    counted = incremental.count_files(spark, f"{d}/flows.parque[t]", schema, {"dataset": F.col("dataset"), "split": F.lower(F.trim("split"))})
    return counted.select("dataset", "split", "n")


# estimators: rows-only checks, their numbers depend on the model library

_X = ["flow_duration", "tot_fwd_pkts", "fwd_bytes", "bwd_bytes", "pkt_len_mean", "pkt_len_std", "fwd_hdr_len", "iat_mean"]


def _model_rows(spark, d):
    f = flows(spark, d).select("row_id", "split", "family", F.col("y_stage1_attack").cast("double").alias("y1"), *_X)
    return f.where("family <> ''")


def _scored(spark, d, profile="rf", holdout=None):
    rows = _model_rows(spark, d)
    return ml.score_frame(ml.two_stage(rows.where("split = 'train'"), _X, profile, holdout), rows.where("split = 'test'"))


@book("ml01_random_forest")
def ml01(spark, d):
    return _scored(spark, d).select("row_id", "p_attack", "fam_pred_family", "fam_pmax")


@book("ml02_boosted_trees")
def ml02(spark, d):
    """Boosted trees in both stages, one against the rest in stage 2 (approximation of the boosting profiles of ML-02)."""
    return _scored(spark, d, "xgb").select("row_id", "p_attack", "fam_pred_family", "fam_pmax")


@book("ml03_boosted_profile")
def ml03(spark, d):
    """The second boosting profile, mapped to boosted trees with larger steps (approximation)."""
    return _scored(spark, d, "lgbm").select("row_id", "p_attack", "fam_pred_family", "fam_pmax")


@book("ml04_balanced_ensemble", f"WITH {FLOWS} SELECT count(*) AS n_rows, 3 AS n_models, 0 AS n_outside FROM f WHERE split = 'test' AND family <> '' GROUP BY ALL")
def ml04_balanced(spark, d):
    """Forests on class-balanced draws, mean of three: every row scored by each, probabilities within 0 and 1."""
    rows = _model_rows(spark, d)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    frames = [ml.score_frame(ml.two_stage(ml.balanced(train, "y1", seed), _X, seed=seed), test) for seed in (1, 2, 3)]
    return ml.soft_vote(frames, "row_id", "p_attack").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_models").alias("n_models"), F.count_if(~F.col("p_attack").between(0, 1)).alias("n_outside"))


@book("ml04_extra_forest")
def ml04(spark, d):
    return _scored(spark, d, "extra").select("row_id", "p_attack", "fam_pred_family", "fam_pmax")


@book("ml05_grid_selection")
def ml05(spark, d):
    """Profiles fitted on train and ranked on val by AUC."""
    rows = _model_rows(spark, d)
    out = []
    for profile in ("rf", "extra", "xgb"):
        frame = ml.score_frame(ml.two_stage(rows.where("split = 'train'"), _X, profile), rows.where("split = 'val'"))
        auc = M.auc(frame.withColumn("k", F.lit(0)), ["k"], "p_attack", F.col("y1") == 1).first()
        out.append((profile, float(auc.auc) if auc and auc.auc is not None else None))
    return spark.createDataFrame(out, "profile string, auc double").orderBy(F.col("auc").desc_nulls_last(), "profile")


@book("ml06_calibration_fit")
def ml06(spark, d):
    """Platt's parameters from the score frame and a temperature from the probability rows."""
    from flowsieve.plans.clean_queries import probs

    a, b = ml.fit_platt(scores(spark, d).where("split = 'val'"), "p", "y1")
    t = ml.fit_temperature(probs(spark, d).select("q", F.col("label").alias("y")), "q", "y", [0.5, 0.75, 1.0, 1.5, 2.0, 3.0])
    return spark.createDataFrame([("platt_a", a), ("platt_b", b), ("temperature", float(t))], "parameter string, value double")


@book("ml07_feature_selection")
def ml07(spark, d):
    rows = _model_rows(spark, d).where("split = 'train'").withColumns({c: F.coalesce(N.finite(F.col(c).cast("double")), F.lit(0.0)) for c in _X})
    return spark.createDataFrame([(c,) for c in ml.best_features(rows, _X, "y1", 4)], "feature string")


@book("ml08_soft_vote")
def ml08(spark, d):
    return ml.soft_vote([_scored(spark, d, p) for p in ("rf", "extra")], "row_id", "p_attack")


@book("ml09_leave_one_out")
def ml09(spark, d):
    """Stage 2 without the held-out family: how its rows are scored."""
    out = _scored(spark, d, "rf", "Botnet").where("family = 'Botnet'")
    return out.groupBy("fam_pred_family").agg(F.count(F.lit(1)).alias("n"), F.avg("fam_pmax").alias("mean_pmax"))


@book("ml09_holdout_invariant", f"WITH {FLOWS} SELECT count_if(family = 'Botnet') AS n_rows, 0 AS n_predicted FROM f WHERE split = 'test' AND family <> ''")
def ml09_invariant(spark, d):
    """No row is ever given the held-out family."""
    held = F.col("fam_pred_family") == "Botnet"
    return _scored(spark, d, "rf", "Botnet").agg(F.count_if(F.col("family") == "Botnet").alias("n_rows"), F.count_if(held).alias("n_predicted"))


@book("ml10_frame_invariants", f"WITH {FLOWS} SELECT count(*) AS n_rows, 0 AS n_outside, 0 AS n_margin_above, 0 AS n_without_family FROM f WHERE split = 'test' AND family <> ''")
def ml10_invariants(spark, d):
    """Every row of the score frame: probabilities and entropy within 0 and 1, margin not above the maximum, a family named."""
    inside = F.col("p_attack").between(0, 1) & F.col("fam_pmax").between(0, 1 + 1e-9) & F.col("stage2_entropy").between(-1e-9, 1 + 1e-9)
    return _scored(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~inside).alias("n_outside"), F.count_if(F.col("top2_margin") > F.col("fam_pmax") + 1e-9).alias("n_margin_above"), F.count_if(F.col("fam_pred_family").isNull()).alias("n_without_family"))


@book("ml10_score_frame")
def ml10(spark, d):
    return _scored(spark, d).select("row_id", "p_attack", "fam_pred_family", "fam_pmax", "top2_margin", "stage2_entropy")


@book("snk04_model_roundtrip", f"WITH {FLOWS} SELECT count(*) AS n, 0 AS n_different FROM f WHERE split = 'test' AND family <> ''")
def snk04(spark, d):
    """A fitted pipeline saved to the shared folder and loaded again gives the same probabilities."""
    import uuid

    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from flowsieve import scratch

    rows = _model_rows(spark, d)
    scale, stage1, _, _ = ml.two_stage(rows.where("split = 'train'"), _X)
    at = f"{scratch.shared_folder(spark)}/model-{uuid.uuid4().hex}"
    stage1.write().overwrite().save(at)
    test = ml.scaled(rows.where("split = 'test'"), scale)
    p = lambda m, n: m.transform(test).select("row_id", F.get(vector_to_array("probability"), F.lit(1)).alias(n))
    return p(stage1, "a").join(p(PipelineModel.load(at), "b"), "row_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_different"))


QUERIES, SQL = book.queries, book.sql

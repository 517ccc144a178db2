"""Evaluation lanes to their full extent: system reports, candidate grids, statistics, audits (ANA, MTH-09, HSH-03)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from flowsieve.functions import labels as L
from flowsieve.functions.numbers import finite
from flowsieve.operators import metrics as M
from flowsieve.operators import selection as P
from flowsieve.operators import splitting as S
from flowsieve.operators import statistics as ST
from flowsieve.operators.prefix import quantiles
from flowsieve.plans.analysis_queries import _POL
from flowsieve.plans.base import DECIDED, FLOWS, SCORES, THRESHOLD, Book, decided, flows, scores
from flowsieve.plans.metric_queries import _CONF, _ROW, row_hash
from flowsieve.tables import table

book = Book()
R = lambda c, n=6: F.round(c, n)
_SPLITS = ("train", "val", "test")

# --- ANA-26: the system under four policies, its stages and their calibration

_RATES = {
    "accuracy": "avg((truth = pred)::INT)", "benign_fp_rate": "count_if(truth = 'Benign' AND pred NOT IN ('Benign', 'Unknown')) / nullif(count_if(truth = 'Benign'), 0)",
    "benign_reject_rate": "count_if(truth = 'Benign' AND pred = 'Unknown') / nullif(count_if(truth = 'Benign'), 0)", "overall_reject_rate": "avg((pred = 'Unknown')::INT)",
    "unknown_detection_rate": "count_if(truth = 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth = 'Unknown'), 0)", "false_unknown_all_known": "count_if(truth <> 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth <> 'Unknown'), 0)",
    "false_unknown_known_attacks": "count_if(truth NOT IN ('Benign', 'Unknown') AND pred = 'Unknown') / nullif(count_if(truth NOT IN ('Benign', 'Unknown')), 0)",
}


def by_policy(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), L.decide(F.col("p"), F.col("pmax"), F.col("pred_fam"), a, b).alias("pred")) for k, (a, b) in _POL.items()])).alias("x")
    return scores(spark, d).select("run_id", "split", "truth", each).select("run_id", "split", "truth", "x.*")


_BY_POLICY = f"{SCORES}, po(policy, thr, tau) AS (VALUES {', '.join(f"('{k}', {a}, {b})" for k, (a, b) in _POL.items())}), x AS (SELECT run_id, split, policy, truth, CASE WHEN p < thr THEN 'Benign' WHEN pmax < tau THEN 'Unknown' ELSE pred_fam END AS pred FROM s, po)"


@book("ana26_system_report", f"WITH {_BY_POLICY} SELECT run_id, policy, count(*) AS n_rows, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _RATES.items()) + " FROM x WHERE split = 'test' GROUP BY ALL")
def ana26_system(spark, d):
    """All system metrics of every run under strict, cascade and their abstaining forms, on test."""
    m = M.system_columns()
    return by_policy(spark, d).where("split = 'test'").groupBy("run_id", "policy").agg(m["n_rows"].alias("n_rows"), *[R(m[k]).alias(k) for k in _RATES])


@book(
    "ana26_stage1_report",
    f"WITH {SCORES}, b AS (SELECT run_id, p, count_if(y1 = 1) AS a, count(*) AS n FROM s WHERE split = 'test' GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER w, 0) + (n + 1) / 2 AS rk FROM b WINDOW w AS (PARTITION BY run_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "u AS (SELECT run_id, (sum(rk * a) - sum(a) * (sum(a) + 1) / 2) / nullif(sum(a) * (sum(n) - sum(a)), 0) AS auc FROM r GROUP BY run_id), c AS (SELECT run_id, count_if(p >= 0.5 AND y1 = 1) AS tp, count_if(p >= 0.5 AND y1 = 0) AS fp, count_if(p < 0.5 AND y1 = 1) AS fn, count_if(p < 0.5 AND y1 = 0) AS tn, avg((p - y1) * (p - y1)) AS brier FROM s WHERE split = 'test' GROUP BY run_id) "
    "SELECT run_id, tp, fp, fn, tn, round(fp / greatest(1, fp + tn), 6) AS fpr, round(tp / greatest(1, tp + fn), 6) AS tpr, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(brier, 6) AS brier, round(auc, 6) AS auc FROM c JOIN u USING (run_id)",
)
def ana26_stage1(spark, d):
    """Stage 1 on test: confusion at the threshold, rates, F1, Brier and AUC."""
    test = scores(spark, d).where("split = 'test'")
    hit, attack = F.col("p") >= THRESHOLD, F.col("y1") == 1
    c = test.groupBy("run_id").agg(F.count_if(hit & attack).alias("tp"), F.count_if(hit & ~attack).alias("fp"), F.count_if(~hit & attack).alias("fn"), F.count_if(~hit & ~attack).alias("tn"), F.avg((F.col("p") - F.col("y1")) ** 2).alias("brier"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.join(M.auc(test, ["run_id"], "p", attack), "run_id")
    return out.select("run_id", "tp", "fp", "fn", "tn", R(fp / F.greatest(F.lit(1), fp + tn)).alias("fpr"), R(tp / F.greatest(F.lit(1), tp + fn)).alias("tpr"), R(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), R("brier").alias("brier"), R("auc").alias("auc"))


@book(
    "ana26_stage2_report",
    f"WITH {SCORES} SELECT run_id, fam AS family, count(*) AS support, round(avg((pred_fam = fam)::INT), 6) AS recall, round(avg(pmax) + 1e-9, 6) AS mean_pmax, round(avg(CASE WHEN pred_fam <> fam THEN pmax END) + 1e-9, 6) AS mean_pmax_wrong, round(avg(entropy) + 1e-9, 6) AS mean_entropy FROM s WHERE split = 'test' AND y1 = 1 AND fam <> '' AND isfinite(entropy) GROUP BY ALL",
)
def ana26_stage2(spark, d):
    """Stage 2 on the attacks of test: recall and confidence of each family, right and wrong; means that end on a half are rounded up."""
    a = scores(spark, d).where("split = 'test' AND y1 = 1 AND fam <> ''").where(finite(F.col("entropy")).isNotNull())
    wrong = F.col("pred_fam") != F.col("fam")
    return a.groupBy("run_id", F.col("fam").alias("family")).agg(F.count(F.lit(1)).alias("support"), R(F.avg((~wrong).cast("int"))).alias("recall"), R(F.avg("pmax") + 1e-9).alias("mean_pmax"), R(F.avg(F.when(wrong, F.col("pmax"))) + 1e-9).alias("mean_pmax_wrong"), R(F.avg("entropy") + 1e-9).alias("mean_entropy"))


@book(
    "ana26_calibration_report",
    f"WITH {SCORES}, b AS (SELECT run_id, least(floor(p * 10), 9)::INT AS b1, least(floor(pmax * 10), 9)::INT AS b2, p, pmax, y1, (pred_fam = fam)::INT AS ok, (y1 = 1 AND truth <> 'Unknown') AS known FROM s WHERE split = 'test'), "
    "e1 AS (SELECT run_id, sum(g * n) / sum(n) AS stage1_ece FROM (SELECT run_id, b1, count(*) AS n, abs(avg(p) - avg(y1)) AS g FROM b GROUP BY ALL) GROUP BY run_id), e2 AS (SELECT run_id, sum(g * n) / sum(n) AS stage2_ece, sum(n)::BIGINT AS n_known FROM (SELECT run_id, b2, count(*) AS n, abs(avg(pmax) - avg(ok)) AS g FROM b WHERE known GROUP BY ALL) GROUP BY run_id) "
    "SELECT run_id, round(stage1_ece, 6) AS stage1_ece, round(stage2_ece, 6) AS stage2_ece, coalesce(n_known, 0) AS n_known FROM e1 LEFT JOIN e2 USING (run_id)",
)
def ana26_calibration(spark, d):
    """Calibration error of both stages on test; stage 2 over known attacks."""
    test = scores(spark, d).where("split = 'test'").withColumn("ok", F.col("pred_fam") == F.col("fam"))
    known = test.where("y1 = 1 AND truth <> 'Unknown'")
    first = M.ece(test, ["run_id"], "p", F.col("y1") == 1).withColumnRenamed("ece", "stage1_ece")
    second = M.ece(known, ["run_id"], "pmax", F.col("ok")).withColumnRenamed("ece", "stage2_ece").join(known.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_known")), "run_id")
    return first.join(second, "run_id", "left").select("run_id", R("stage1_ece").alias("stage1_ece"), R("stage2_ece").alias("stage2_ece"), F.coalesce("n_known", F.lit(0)).alias("n_known"))


# --- ANA-17: rejectors over a grid of candidates, ANA-18: the sink frontier on test

_GRID = {"control_tau": [0.4, 0.5, 0.6, 0.7, 0.8], "margin_reject": [0.1, 0.2, 0.3, 0.4, 0.5], "entropy_reject": [0.3, 0.4, 0.5, 0.6, 0.7], "conformal_reject": [0.8, 0.9, 1.0, 1.1, 1.2]}
_RULES = {"control_tau": "pmax < {0}", "margin_reject": "margin < {0}", "entropy_reject": "entropy > {0}", "conformal_reject": "pmax < {0} * coalesce(t, 0)"}


def rejection_grid(spark, d):
    """run_id, split, method, cut and the counts of each candidate: every candidate is three counters of one pass, no row is multiplied."""
    s = scores(spark, d)
    q = quantiles(s.where("split = 'val' AND y1 = 1").drop("pred_fam").withColumnRenamed("fam", "pred_fam"), ["run_id", "pred_fam"], "tprob", [0.1]).select("run_id", "pred_fam", R(F.get("q", F.lit(0)), 9).alias("t"))
    j = s.join(q, ["run_id", "pred_fam"], "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    attack, unknown = F.col("p") >= THRESHOLD, F.col("truth") == "Unknown"
    doubt = {"control_tau": lambda c: F.col("pmax") < c, "margin_reject": lambda c: F.col("margin") < c, "entropy_reject": lambda c: F.col("entropy") > c, "conformal_reject": lambda c: F.col("pmax") < c * F.col("t")}
    counters, shown = [], []
    for m, c in ((m, c) for m, cuts in _GRID.items() for c in cuts):
        reject = attack & F.coalesce(doubt[m](F.lit(c)), F.lit(False))
        pred = F.when(~attack, "Benign").when(reject, "Unknown").otherwise(F.col("pred_fam"))
        i = len(shown)
        counters += [F.count_if(reject).alias(f"r{i}"), F.count_if(reject & unknown).alias(f"u{i}"), F.count_if(pred == F.col("truth")).alias(f"c{i}")]
        shown.append(F.struct(F.lit(m).alias("method"), F.lit(c).alias("cut"), F.col(f"r{i}").alias("rejected"), F.col(f"u{i}").alias("found"), F.col(f"c{i}").alias("right")))
    per = j.groupBy("run_id", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(unknown).alias("n_unknown"), *counters)
    each = per.select("run_id", "split", "n", "n_unknown", F.explode(F.array(*shown)).alias("x")).select("run_id", "split", "n", "n_unknown", "x.*")
    return each.select("run_id", "split", "method", "cut", (F.col("right") / F.col("n")).alias("accuracy"), (F.col("rejected") / F.col("n")).alias("reject_rate"), F.try_divide("found", "n_unknown").alias("udr"))


_GRID_SQL = f"{SCORES}, {_CONF}, cand(method, cut) AS (VALUES {', '.join(f"('{m}', {c}::DOUBLE)" for m, cs in _GRID.items() for c in cs)}), z AS (SELECT run_id, split, method, cut, truth, p >= 0.5 AND coalesce(CASE method " + " ".join(
    f"WHEN '{m}' THEN {_RULES[m].format('cut')}" for m in _GRID
) + " END, false) AS rejected, CASE WHEN p < 0.5 THEN 'Benign' ELSE pred_fam END AS closed FROM j, cand), gr AS (SELECT run_id, split, method, cut, avg((CASE WHEN rejected THEN 'Unknown' ELSE closed END = truth)::INT) AS accuracy, avg(rejected::INT) AS reject_rate, count_if(rejected AND truth = 'Unknown') / nullif(count_if(truth = 'Unknown'), 0) AS udr FROM z GROUP BY ALL)"


@book("ana17_rejector_grid", f"WITH {_GRID_SQL} SELECT run_id, split, method, cut, round(accuracy, 6) AS accuracy, round(reject_rate, 6) AS reject_rate, round(udr, 6) AS udr FROM gr")
def ana17_grid(spark, d):
    """Every candidate of every rejection method on every split."""
    return rejection_grid(spark, d).select("run_id", "split", "method", "cut", R("accuracy").alias("accuracy"), R("reject_rate").alias("reject_rate"), R("udr").alias("udr"))


_BEST = "(reject_rate <= 0.3 + 1e-12) DESC, round(coalesce(udr, -1), 9) DESC, round(accuracy, 9) DESC, cut"


@book("ana17_grid_replay", f"WITH {_GRID_SQL}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, method ORDER BY {_BEST}) AS k FROM gr WHERE split = 'val') WHERE k = 1) SELECT b.run_id, b.method, b.cut, round(b.accuracy, 6) AS val_accuracy, round(t.accuracy, 6) AS test_accuracy, round(t.reject_rate, 6) AS test_reject_rate, round(t.udr, 6) AS test_udr FROM b LEFT JOIN gr t ON t.run_id = b.run_id AND t.method = b.method AND t.cut = b.cut AND t.split = 'test'")
def ana17_replay(spark, d):
    """The candidate of each method that is best on val under the rejection bar, replayed on test."""
    grid = rejection_grid(spark, d)
    by = [(F.col("reject_rate") <= 0.3 + 1e-12).desc(), F.round(F.coalesce("udr", F.lit(-1.0)), 9).desc(), F.round("accuracy", 9).desc(), F.col("cut")]
    best = P.first_per_group(grid.where("split = 'val'"), ["run_id", "method"], by).select("run_id", "method", "cut", R("accuracy").alias("val_accuracy"))
    test = grid.where("split = 'test'").select("run_id", "method", "cut", R("accuracy").alias("test_accuracy"), R("reject_rate").alias("test_reject_rate"), R("udr").alias("test_udr"))
    return best.join(test, ["run_id", "method", "cut"], "left")


_SINK_GRID = [(st, mf) for st in (0.6, 0.7, 0.8) for mf in (0.1, 0.3)]


def _sink_counts(spark, d):
    """run_id, split, sink_tau, floor (null: without the sink's rule) and what each candidate does; counters of one pass."""
    unknown = F.col("truth") == "Unknown"
    counters, shown = [], []
    for i, (st, mf) in enumerate([(None, None), *_SINK_GRID]):
        args = (F.col("p"), F.col("pmax"), F.col("margin"), F.col("pred_fam"))
        pred = L.decide(F.col("p"), F.col("pmax"), F.col("pred_fam"), 0.5, 0.4) if st is None else L.sink_aware(*args, "DDoS", 0.5, 0.4, F.lit(st), F.lit(mf))
        counters += [F.count_if(pred == F.col("truth")).alias(f"c{i}"), F.count_if(pred == "Unknown").alias(f"r{i}"), F.count_if((pred == "Unknown") & unknown).alias(f"u{i}")]
        shown.append(F.struct(F.lit(st).cast("double").alias("sink_tau"), F.lit(mf).cast("double").alias("floor"), F.col(f"c{i}").alias("right"), F.col(f"r{i}").alias("rejected"), F.col(f"u{i}").alias("found")))
    per = scores(spark, d).groupBy("run_id", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(unknown).alias("n_unknown"), *counters)
    each = per.select("run_id", "split", "n", "n_unknown", F.explode(F.array(*shown)).alias("x")).select("run_id", "split", "n", "n_unknown", "x.*")
    return each.select("run_id", "split", "sink_tau", "floor", (F.col("right") / F.col("n")).alias("accuracy"), (F.col("rejected") / F.col("n")).alias("reject_rate"), F.try_divide("found", "n_unknown").alias("udr"))


@book(
    "ana18_sink_test",
    f"WITH {SCORES}, g(st, mf) AS (VALUES (NULL, NULL), {', '.join(f'({a}, {b})' for a, b in _SINK_GRID)}), x AS (SELECT run_id, split, st::DOUBLE AS sink_tau, mf::DOUBLE AS floor, truth, CASE WHEN p < 0.5 THEN 'Benign' WHEN pmax < 0.4 OR (st IS NOT NULL AND pred_fam = 'DDoS' AND (pmax < st OR margin < mf)) THEN 'Unknown' ELSE pred_fam END AS pred FROM s, g), "
    "m AS (SELECT run_id, split, sink_tau, floor, avg((truth = pred)::INT) AS accuracy, avg((pred = 'Unknown')::INT) AS reject_rate, count_if(pred = 'Unknown' AND truth = 'Unknown') / nullif(count_if(truth = 'Unknown'), 0) AS udr FROM x GROUP BY ALL), "
    "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (reject_rate <= 0.3 + 1e-12) DESC, round(coalesce(udr, -1), 9) DESC, round(accuracy, 9) DESC, sink_tau, floor) AS k FROM m WHERE split = 'val' AND sink_tau IS NOT NULL) WHERE k = 1) "
    "SELECT b.run_id, b.sink_tau, b.floor, round(t.accuracy, 6) AS test_accuracy, round(t.udr, 6) AS test_udr, round(t.accuracy - c.accuracy, 6) AS delta_accuracy, round(t.udr - c.udr, 6) AS delta_udr, round(t.reject_rate - c.reject_rate, 6) AS delta_reject_rate FROM b JOIN m t ON t.run_id = b.run_id AND t.split = 'test' AND t.sink_tau = b.sink_tau AND t.floor = b.floor JOIN m c ON c.run_id = b.run_id AND c.split = 'test' AND c.sink_tau IS NULL",
)
def ana18_test(spark, d):
    """The sink rule chosen on val against the plain threshold, on test."""
    m = _sink_counts(spark, d)
    by = [(F.col("reject_rate") <= 0.3 + 1e-12).desc(), F.round(F.coalesce("udr", F.lit(-1.0)), 9).desc(), F.round("accuracy", 9).desc(), F.col("sink_tau"), F.col("floor")]
    best = P.first_per_group(m.where("split = 'val' AND sink_tau IS NOT NULL"), ["run_id"], by).select("run_id", "sink_tau", "floor")
    test = m.where("split = 'test'")
    control = test.where("sink_tau IS NULL").select("run_id", *[F.col(c).alias("c_" + c) for c in ("accuracy", "udr", "reject_rate")])
    out = best.join(test.drop("split"), ["run_id", "sink_tau", "floor"]).join(control, "run_id")
    delta = lambda c: R(F.col(c) - F.col("c_" + c)).alias("delta_" + c)
    return out.select("run_id", "sink_tau", "floor", R("accuracy").alias("test_accuracy"), R("udr").alias("test_udr"), delta("accuracy"), delta("udr"), delta("reject_rate"))


# --- ANA-21, ANA-22: bootstrap with hashed draws, adjusted p-values and audit rows

_B = 200
_U_SQL = "(('0x' || substr(md5({0}), 1, 8))::BIGINT + 0.5) / 4294967296.0"
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253]


def _poisson(key: Column) -> Column:
    """A Poisson(1) draw from the MD5 of a key: any engine draws the same."""
    u = (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return sum(((u > F.lit(c)).cast("int") for c in _POISSON[1:]), (u > F.lit(_POISSON[0])).cast("int"))


def _poisson_sql(key: str) -> str:
    return "(" + " + ".join(f"({_U_SQL.format(key)} > {c})::INT" for c in _POISSON) + ")"


_STATES = f"{SCORES}, st AS (SELECT run_id, (CASE WHEN p < 0.5 THEN 'Benign' WHEN pmax < 0.6 THEN 'Unknown' ELSE pred_fam END = truth)::INT AS a, (CASE WHEN p < 0.5 THEN 'Benign' WHEN pmax < 0.4 THEN 'Unknown' ELSE pred_fam END = truth)::INT AS b, score_id % 97 AS block FROM s), bl AS (SELECT run_id, block, sum(a) AS a, sum(b) AS b, count(*) AS n FROM st GROUP BY ALL)"


def _blocks(spark, d):
    """Right answers of two decision rules per run and block of score ids: the states that are drawn again."""
    right = lambda tau: (L.decide(F.col("p"), F.col("pmax"), F.col("pred_fam"), 0.5, tau) == F.col("truth")).cast("int")
    s = scores(spark, d).select("run_id", right(0.6).alias("a"), right(0.4).alias("b"), (F.col("score_id") % 97).alias("block"))
    return s.groupBy("run_id", "block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))


def _resampled(spark, d):
    """run_id, r and the resampled accuracies of both rules; at most 97 blocks a run are drawn, whatever the number of rows."""
    each = _blocks(spark, d).select("*", F.explode(F.sequence(F.lit(1), F.lit(_B))).alias("r"))
    w = each.withColumn("w", _poisson(F.concat_ws("|", "run_id", "block", "r")))
    share = lambda c: F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum(F.col("w") * F.col("n")))
    return w.groupBy("run_id", "r").agg(share("a").alias("a"), share("b").alias("b"))


_RESAMPLED = f"{_STATES}, dr AS (SELECT run_id, r, a, b, n, {_poisson_sql('''concat_ws('|', run_id, block, r)''')} AS w FROM bl, (SELECT unnest(range(1, {_B + 1})) AS r)), rs AS (SELECT run_id, r, sum(w * a) / nullif(sum(w * n), 0) AS a, sum(w * b) / nullif(sum(w * n), 0) AS b FROM dr GROUP BY ALL)"


@book("ana21_hashed_bootstrap", f"WITH {_RESAMPLED}, e AS (SELECT run_id, sum(a) / sum(n) AS estimate FROM bl GROUP BY run_id) SELECT run_id, round(any_value(estimate), 6) AS estimate, round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high FROM rs JOIN e USING (run_id) GROUP BY run_id")
def ana21(spark, d):
    """Percentile interval of each run's accuracy by a block bootstrap with hashed Poisson weights."""
    e = _blocks(spark, d).groupBy("run_id").agg((F.sum("a") / F.sum("n")).alias("estimate"))
    q = F.percentile("a", F.array(F.lit(0.025), F.lit(0.975)))  # over the resamples, a fixed number
    return _resampled(spark, d).groupBy("run_id").agg(q.alias("q")).join(e, "run_id").select("run_id", R("estimate").alias("estimate"), R(F.get("q", F.lit(0))).alias("low"), R(F.get("q", F.lit(1))).alias("high"))


@book(
    "ana22_adjusted_tests",
    f"WITH {_RESAMPLED}, pv AS (SELECT run_id, avg(a - b) AS delta, least(1.0, 2 * least(avg((a - b <= 0)::INT), avg((a - b >= 0)::INT))) AS p FROM rs GROUP BY run_id), o AS (SELECT *, row_number() OVER (ORDER BY p, run_id) AS k, count(*) OVER () AS m FROM pv) "
    "SELECT run_id, round(delta, 6) AS delta, round(p, 6) AS p_value, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_bh, round(least(1.0, p * m), 6) AS p_bonferroni FROM o",
)
def ana22_adjusted(spark, d):
    """Paired difference of two rules per run, two-sided p-value, Benjamini-Hochberg and Bonferroni."""
    x = F.col("a") - F.col("b")
    two = F.least(F.lit(1.0), 2 * F.least(F.avg((x <= 0).cast("int")), F.avg((x >= 0).cast("int"))))
    tests = _resampled(spark, d).groupBy("run_id").agg(F.avg(x).alias("delta"), two.alias("p_value")).withColumn("family", F.lit("all"))
    out = ST.benjamini_hochberg(tests, ["family"], "p_value", "run_id")
    return out.select("run_id", R("delta").alias("delta"), R("p_value").alias("p_value"), R("p_bh").alias("p_bh"), R("p_bonferroni").alias("p_bonferroni"))


@book("ana22_audit_rows", f"WITH {_RESAMPLED}, q AS (SELECT run_id, count(*) AS n_resamples, count_if(a IS NULL) AS n_empty, quantile_cont(a - b, 0.025) AS low, quantile_cont(a - b, 0.975) AS high, avg(a - b) AS delta FROM rs GROUP BY run_id) SELECT run_id, n_resamples, n_empty, low <= delta AND delta <= high AS inside, low > 0 OR high < 0 AS excludes_zero FROM q")
def ana22_audit(spark, d):
    """Audit of the refresh: resamples, empty ones, and whether the mean lies in its interval and the interval beside zero."""
    x = F.col("a") - F.col("b")
    q = _resampled(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_resamples"), F.count_if(F.col("a").isNull()).alias("n_empty"), F.percentile(x, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg(x).alias("delta"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return q.select("run_id", "n_resamples", "n_empty", ((low <= F.col("delta")) & (F.col("delta") <= high)).alias("inside"), ((low > 0) | (high < 0)).alias("excludes_zero"))


# --- ANA-09, ANA-08: leakage audit and dataset profile


@book(
    "ana09_hash_overlap",
    f"WITH {FLOWS}, h AS (SELECT split, {_ROW} AS h, count(*) AS n FROM f WHERE split IN ('train', 'val', 'test') GROUP BY ALL) SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_hashes, sum(b.n)::BIGINT AS n_rows_b FROM h a JOIN h b USING (h) WHERE (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test')) GROUP BY ALL",
)
def ana09_hashes(spark, d):
    """Rows of one split whose features also stand in another: one aggregation over the hashes, no join of rows."""
    n = lambda s: F.count_if(F.col("split") == s).alias(s)
    per = flows(spark, d).where(F.col("split").isin(*_SPLITS)).groupBy(row_hash().alias("h")).agg(*[n(s) for s in _SPLITS])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    each = F.explode(F.array_compact(F.array(*[F.when((F.col(a) > 0) & (F.col(b) > 0), F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(b).alias("n"))) for a, b in pairs]))).alias("x")
    return per.select(each).groupBy("x.split_a", "x.split_b").agg(F.count(F.lit(1)).alias("n_hashes"), F.sum("x.n").alias("n_rows_b"))


@book(
    "ana09_interval_audit",
    "WITH u AS (SELECT lower(trim(source_file_path)) AS file, row_start, row_end, raw_row_count, lead(row_start) OVER (PARTITION BY lower(trim(source_file_path)) ORDER BY row_start, row_end) AS nxt FROM plan_units WHERE source_file_path IS NOT NULL) "
    "SELECT file, count(*) AS n_units, min(row_start) = 0 AS starts_at_zero, coalesce(bool_and(nxt IS NULL OR nxt >= row_end), true) AS no_overlap, coalesce(bool_and(nxt IS NULL OR nxt = row_end), true) AS contiguous, max(row_end) = sum(raw_row_count) AS covers_rows FROM u GROUP BY file",
)
def ana09_intervals(spark, d):
    """Row intervals of the units of each source file: overlaps, gaps and coverage."""
    units = table(spark, d, "plan_units").where(F.col("source_file_path").isNotNull()).withColumn("file", F.lower(F.trim("source_file_path")))
    return S.interval_audit(units, "file", "row_start", "row_end", "raw_row_count")


_NUM = ("flow_duration", "fwd_bytes", "flow_bytes_s", "iat_mean", "pkt_len_std")


@book(
    "ana08_numeric_profile",
    " UNION ALL ".join(f"SELECT dataset, '{c}' AS feature, count(*) AS n_rows, count_if(NOT coalesce(isfinite({c}::DOUBLE), false)) AS n_missing, round(avg({c}) FILTER (WHERE isfinite({c}::DOUBLE)) / 1000, 4) AS mean_k, min({c}::DOUBLE) FILTER (WHERE isfinite({c}::DOUBLE)) AS least, max({c}::DOUBLE) FILTER (WHERE isfinite({c}::DOUBLE)) AS most FROM flows GROUP BY dataset" for c in _NUM),
)
def ana08_numeric(spark, d):
    """Missing values, mean and range of numeric features per data set, in one pass."""
    v = {c: finite(F.col(c).cast("double")) for c in _NUM}
    stats = [x for c in _NUM for x in (F.count_if(v[c].isNull()).alias(f"n_{c}"), F.avg(v[c]).alias(f"m_{c}"), F.min(v[c]).alias(f"l_{c}"), F.max(v[c]).alias(f"h_{c}"))]
    per = flows(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), *stats)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n_missing"), R(F.col(f"m_{c}") / 1000, 4).alias("mean_k"), F.col(f"l_{c}").alias("least"), F.col(f"h_{c}").alias("most")) for c in _NUM])).alias("x")
    return per.select("dataset", "n_rows", each).select("dataset", "n_rows", "x.*")


@book(
    "ana08_schema_groups",
    "WITH k AS (SELECT file_no, list_sort(list_distinct(list_transform(json_keys(payload), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_')))) AS ks FROM capture_records WHERE json_valid(payload)), "
    "c AS (SELECT file_no, list_sort(list_distinct(flatten(list(ks)))) AS cols FROM k GROUP BY file_no) SELECT md5(array_to_string(cols, '|')) AS schema_hash, len(cols)::INT AS n_columns, count(*) AS n_files FROM c GROUP BY ALL",
)
def ana08_groups(spark, d):
    """Files of one schema: the hash of their sorted canonical column names."""
    from flowsieve.operators.schema_drift import compared

    keys = F.transform(F.json_object_keys("payload"), compared)
    names = table(spark, d, "capture_records").select("file_no", F.explode(keys).alias("k")).distinct()
    cols = names.groupBy("file_no").agg(F.array_sort(F.collect_set("k")).alias("cols"))  # bounded by the width of a record
    return cols.groupBy(F.md5(F.array_join("cols", "|")).alias("schema_hash"), F.size("cols").alias("n_columns")).agg(F.count(F.lit(1)).alias("n_files"))


# --- ANA-04, MTH-09: enumeration of split candidates

_SHARES = (0.70, 0.15, 0.15)


@book(
    "mth09_split_counts",
    "WITH n AS (SELECT feed_id, count(*) AS n FROM capture_files GROUP BY feed_id), g AS (SELECT feed_id, n, v, t, n - v - t AS r FROM n, (SELECT unnest(range(0, 1000)) AS v) a, (SELECT unnest(range(0, 1000)) AS t) b "
    "WHERE abs(v - round_even(0.15 * n, 0)) <= 1 AND abs(t - round_even(0.15 * n, 0)) <= 1 AND v >= 1 AND t >= 1 AND n - v - t >= 1) SELECT feed_id, r AS n_train, v AS n_val, t AS n_test, round(abs(r - 0.7 * n) + abs(v - 0.15 * n) + abs(t - 0.15 * n), 6) AS distance FROM g",
)
def mth09(spark, d):
    """Numbers of files per split in the neighbourhood of the target shares, with their distance from them; enumerated per feed inside the JVM."""
    n = table(spark, d, "capture_files").groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"))
    near = lambda share: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: x + F.rint(share * F.col("n")).cast("long"))
    each = n.select("feed_id", "n", F.explode(near(0.15)).alias("n_val"), F.lit(0).alias("_")).select("*", F.explode(near(0.15)).alias("n_test"))
    each = each.withColumn("n_train", F.col("n") - F.col("n_val") - F.col("n_test")).where("n_val >= 1 AND n_test >= 1 AND n_train >= 1")
    gap = F.abs(F.col("n_train") - 0.7 * F.col("n")) + F.abs(F.col("n_val") - 0.15 * F.col("n")) + F.abs(F.col("n_test") - 0.15 * F.col("n"))
    return each.select("feed_id", "n_train", "n_val", "n_test", R(gap).alias("distance"))


_UNITS = 6  # the heaviest units of a data set are assigned exhaustively, the rest stay in train
_ASSIGNMENTS = [a for a in itertools.product(_SPLITS, repeat=_UNITS) if "val" in a and "test" in a]


@book(
    "ana04_enumerated_splits",
    f"WITH {FLOWS}, c AS (SELECT dataset, unit_no, count(*) AS n FROM f WHERE unit_no IS NOT NULL GROUP BY ALL), w AS (SELECT dataset, unit_no, n, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, unit_no) AS k, sum(n) OVER (PARTITION BY dataset) AS total FROM c), h AS (SELECT dataset, any_value(total) AS total, {', '.join(f'max(n) FILTER (WHERE k = {i + 1}) AS n{i}' for i in range(_UNITS))} FROM w GROUP BY dataset), "
    f"s3(x) AS (VALUES ('train'), ('val'), ('test')), e AS (SELECT dataset, total, concat_ws('|', {', '.join(f's{i}.x' for i in range(_UNITS))}) AS assignment, ({' + '.join(f'CASE WHEN s{i}.x = {chr(39)}val{chr(39)} THEN coalesce(n{i}, 0) ELSE 0 END' for i in range(_UNITS))}) AS v, ({' + '.join(f'CASE WHEN s{i}.x = {chr(39)}test{chr(39)} THEN coalesce(n{i}, 0) ELSE 0 END' for i in range(_UNITS))}) AS t FROM h, {', '.join(f's3 s{i}' for i in range(_UNITS))}) "
    "SELECT dataset, assignment, round(gap, 6) AS gap FROM (SELECT dataset, assignment, abs(v / total - 0.15) + abs(t / total - 0.15) AS gap, row_number() OVER (PARTITION BY dataset ORDER BY round(abs(v / total - 0.15) + abs(t / total - 0.15), 9), assignment) AS k FROM e WHERE assignment LIKE '%val%' AND assignment LIKE '%test%') WHERE k = 1",
)
def ana04_enumerated(spark, d):
    """Exhaustive search: all assignments of the heaviest units of each data set to the splits, nearest to the target shares first."""
    c = flows(spark, d).where("unit_no IS NOT NULL").groupBy("dataset", "unit_no").agg(F.count(F.lit(1)).alias("n"))
    ranked = c.withColumn("k", F.row_number().over(Window.partitionBy("dataset").orderBy(F.col("n").desc(), "unit_no")))
    heavy = ranked.groupBy("dataset").agg(F.sum("n").alias("total"), *[F.coalesce(F.max(F.when(F.col("k") == i + 1, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(_UNITS)])
    each = heavy.select("*", F.explode(F.array(*[F.lit("|".join(a)) for a in _ASSIGNMENTS])).alias("assignment"))
    held = lambda s: sum((F.when(F.get(F.split("assignment", "[|]"), F.lit(i)) == s, F.col(f"n{i}")).otherwise(0) for i in range(_UNITS)), F.lit(0)) / F.col("total")
    gap = F.abs(held("val") - 0.15) + F.abs(held("test") - 0.15)
    best = P.first_per_group(each.withColumn("gap", gap), ["dataset"], [F.round("gap", 9), F.col("assignment")])
    return best.select("dataset", "assignment", R("gap").alias("gap"))


@book("hsh03_row_digest", f"WITH {FLOWS} SELECT row_id, {_ROW} AS digest FROM f")
def hsh03(spark, d):
    """The row hash over all features, from MD5 instead of the engine's own 64-bit hash, so that any engine can check it."""
    return flows(spark, d).select("row_id", row_hash().alias("digest"))


# --- ANA-28, ANA-32: seed campaign and release gates


@book("ana28_selection_audit", f"WITH {DECIDED}, r AS (SELECT model_name, run_seed, run_id, avg((truth = pred)::INT) AS a FROM d WHERE split = 'val' GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY round(a, 9) DESC, run_id) AS k, count(*) OVER (PARTITION BY model_name) AS n, max(a) OVER (PARTITION BY model_name) - min(a) OVER (PARTITION BY model_name) AS spread FROM r) SELECT model_name, run_id, run_seed, n AS n_candidates, round(a, 6) AS val_accuracy, round(spread, 6) AS spread FROM b WHERE k = 1")
def ana28(spark, d):
    """Which run of each model the validation split selects, out of how many, and how far they lie apart."""
    r = decided(spark, d).where("split = 'val'").groupBy("model_name", "run_seed", "run_id").agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("a"))
    all_ = Window.partitionBy("model_name")  # one row per run
    best = P.first_per_group(r.withColumns({"n": F.count(F.lit(1)).over(all_), "spread": F.max("a").over(all_) - F.min("a").over(all_)}), ["model_name"], [F.round("a", 9).desc(), F.col("run_id")])
    return best.select("model_name", "run_id", "run_seed", F.col("n").alias("n_candidates"), R("a").alias("val_accuracy"), R("spread").alias("spread"))


@book("ana32_seed_gates", f"WITH {SCORES}, want AS (SELECT list_sort(list(DISTINCT run_seed)) AS seeds FROM s), h AS (SELECT model_name, dataset, list_sort(list(DISTINCT run_seed)) AS seeds FROM s GROUP BY ALL) SELECT model_name, dataset, array_to_string(h.seeds, '|') AS seeds, h.seeds = want.seeds AS complete, array_to_string(list_filter(want.seeds, lambda x: NOT list_contains(h.seeds, x)), '|') AS missing FROM h, want")
def ana32(spark, d):
    """Exact seed sets of every model and data set against the campaign's seeds."""
    s = scores(spark, d).select("model_name", "dataset", "run_seed").distinct()
    want = sorted(r.run_seed for r in s.select("run_seed").distinct().collect() if r.run_seed is not None)  # the seeds of a campaign
    wanted = F.array(*[F.lit(x) for x in want]) if want else F.expr("CAST(array() AS array<int>)")
    h = s.groupBy("model_name", "dataset").agg(F.array_sort(F.collect_set("run_seed")).alias("seeds"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), "|")
    return h.select("model_name", "dataset", text(F.col("seeds")).alias("seeds"), (F.col("seeds") == wanted).alias("complete"), text(F.array_except(wanted, "seeds")).alias("missing"))


# --- ANA-10: the categories of the preprocessor, ANA-06: the planner's report and its sorted slice


@book("ana10_categories", f"WITH {FLOWS}, c AS (SELECT coalesce(protocol, 'NA') AS category, count(*) AS n FROM f WHERE split = 'train' GROUP BY ALL) SELECT category, (k - 1)::INT AS code, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS k FROM c) WHERE k <= 50")
def ana10_categories(spark, d):
    """The fitted categories, most frequent first, with their codes; the rest share the code of unknown ones."""
    train = flows(spark, d).where("split = 'train'")
    c = train.groupBy(F.coalesce("protocol", F.lit("NA")).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category").limit(50)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "category"))  # at most 50 rows
    return c.select("category", (rank - 1).alias("code"), "n")


@book(
    "ana06_sorted_slice",
    "WITH u AS (SELECT unit_no, greatest(coalesce(raw_row_count, 0), 0) AS n, sum(greatest(coalesce(raw_row_count, 0), 0)) OVER (ORDER BY unit_order, unit_no) AS upto, sum(greatest(coalesce(raw_row_count, 0), 0)) OVER () AS total FROM plan_units), "
    "s AS (SELECT *, CASE WHEN upto - n < 0.70 * total THEN 'train' WHEN upto - n < 0.85 * total THEN 'val' ELSE 'test' END AS split FROM u) SELECT split, count(*) AS n_units, sum(n)::BIGINT AS n_rows, min(unit_no) AS first_unit FROM s GROUP BY split",
)
def ana06_slice(spark, d):
    """The planner's fallback: units in their order, cut where the rows before a unit pass 70 and 85 percent."""
    from flowsieve.operators.prefix import running_sums

    units = table(spark, d, "plan_units").select("unit_no", "unit_order", F.greatest(F.coalesce("raw_row_count", F.lit(0)), F.lit(0)).alias("n"), F.lit(0).alias("all"))
    run = running_sums(units, ["all"], ["unit_order", "unit_no"], {"upto": F.col("n")})
    before = F.col("upto") - F.col("n")
    split = F.when(before < 0.70 * F.col("upto_total"), "train").when(before < 0.85 * F.col("upto_total"), "val").otherwise("test")
    return run.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_rows"), F.min("unit_no").alias("first_unit"))


@book(
    "ana06_planning_report",
    "SELECT dataset, count(*) AS n_candidates, count_if(is_valid) AS n_valid, max(score) AS best_score, arg_max(candidate_no, (score, -candidate_no)) AS best_candidate, max(n_eligible_holdouts)::BIGINT AS most_eligible, count_if(train_units IS NULL OR val_units IS NULL OR test_units IS NULL) AS n_incomplete FROM candidate_splits WHERE score IS NOT NULL GROUP BY dataset",
)
def ana06_report(spark, d):
    """What the planner chose from: candidates, valid ones, the best by score, and candidates without a list of units."""
    c = table(spark, d, "candidate_splits").where(F.col("score").isNotNull())
    missing = F.col("train_units").isNull() | F.col("val_units").isNull() | F.col("test_units").isNull()
    return c.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if("is_valid").alias("n_valid"), F.max("score").alias("best_score"), F.max_by("candidate_no", F.struct(F.col("score"), -F.col("candidate_no"))).alias("best_candidate"),
        F.max("n_eligible_holdouts").cast("long").alias("most_eligible"), F.count_if(missing).alias("n_incomplete"),
    )


# --- JN-07, ANA-29: the closest task of a published table for every data set


_PAPER = [("paper_a", 0, "family", 0.81), ("paper_a", 1, "binary", 0.97), ("paper_b", 0, "binary", 0.95), ("paper_b", 1, "fine", 0.78), ("paper_c", 0, "fine", 0.74)]


@book(
    "ana29_reference_comparison",
    f"WITH {DECIDED}, p(paper, task_no, task, published) AS (VALUES {', '.join(f"('{a}', {b}, '{c}', {v})" for a, b, c, v in _PAPER)}), o AS (SELECT dataset, avg((truth = pred)::INT) AS own FROM d GROUP BY dataset), "
    "k AS (SELECT paper, dataset, task, published, own, row_number() OVER (PARTITION BY paper, dataset ORDER BY CASE task WHEN 'family' THEN 0 WHEN 'binary' THEN 1 ELSE 2 END, task_no) AS k FROM p, o) SELECT paper, dataset, task, published::DOUBLE AS published, round(own, 6) AS own, round(own - published, 6) AS delta FROM k WHERE k = 1",
)
def ana29_reference(spark, d):
    """Each paper's task that is closest to ours (family, then binary, then any other), beside our own accuracy and the difference."""
    own = decided(spark, d).groupBy("dataset").agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("own"))
    tasks = F.explode(F.array(*[F.struct(F.lit(a).alias("paper"), F.lit(b).alias("task_no"), F.lit(c).alias("task"), F.lit(v).alias("published")) for a, b, c, v in _PAPER])).alias("t")
    rank = F.when(F.col("task") == "family", 0).when(F.col("task") == "binary", 1).otherwise(2)
    best = P.first_per_group(own.select("dataset", "own", tasks).select("dataset", "own", "t.*"), ["paper", "dataset"], [rank, F.col("task_no")])
    return best.select("paper", "dataset", "task", "published", R("own").alias("own"), R(F.col("own") - F.col("published")).alias("delta"))


QUERIES, SQL = book.queries, book.sql

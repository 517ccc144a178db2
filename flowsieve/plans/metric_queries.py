"""Decisions and metrics over the score frame (PRJ-14 to PRJ-24, AGG-01 to AGG-36)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions import labels as L
from flowsieve.functions import numbers as N
from flowsieve.operators import metrics as M
from flowsieve.operators.prefix import quantiles
from flowsieve.plans.base import DECIDED, F1, FAMILIES, FLOWS, LABELS, PER_LABEL, SCORES, THRESHOLD, Book, decided, flows, scores
from flowsieve.tables import table

book = Book()
R = lambda c, n=6: F.round(c, n)


@book("agg09_macro_f1", f"WITH {PER_LABEL} SELECT run_id, round(avg({F1}), 6) AS macro_f1 FROM pl GROUP BY run_id")
def agg09(spark, d):
    return M.macro_f1(M.confusion(decided(spark, d), ["run_id"], "truth", "pred"), ["run_id"], LABELS).select("run_id", R("macro_f1").alias("macro_f1"))


@book("agg09_macro_f1_supported", f"WITH {PER_LABEL} SELECT run_id, round(avg({F1}), 6) AS macro_f1 FROM pl WHERE support > 0 GROUP BY run_id")
def agg09s(spark, d):
    return M.macro_f1(M.confusion(decided(spark, d), ["run_id"], "truth", "pred"), ["run_id"], LABELS, supported_only=True).select("run_id", R("macro_f1").alias("macro_f1"))


@book("agg08_confusion", f"WITH {DECIDED} SELECT run_id, truth AS true_label, pred AS pred_label, count(*) AS n FROM d GROUP BY ALL")
def agg08(spark, d):
    return M.confusion(decided(spark, d), ["run_id"], "truth", "pred")


_WIDE = ", ".join(f"count(*) FILTER (WHERE pred = '{x}') AS \"{x}\"" for x in LABELS)


@book("agg08_confusion_wide", f"WITH {DECIDED} SELECT truth, {_WIDE} FROM d GROUP BY truth")
def agg08w(spark, d):
    return decided(spark, d).groupBy("truth").pivot("pred", LABELS).count().na.fill(0)


@book(
    "agg10_classification_report",
    f"WITH {PER_LABEL}, v AS (SELECT run_id, label, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc, {F1} AS f, support FROM pl) "
    "SELECT run_id, label, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1, support FROM v UNION ALL "
    "SELECT run_id, 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f), 6), sum(support)::BIGINT FROM v GROUP BY run_id UNION ALL "
    "SELECT run_id, 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM v GROUP BY run_id",
)
def agg10(spark, d):
    out = M.report(M.confusion(decided(spark, d), ["run_id"], "truth", "pred"), ["run_id"], LABELS)
    return out.select("run_id", "label", *[R(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@book(
    "agg11_metric_payload",
    f"WITH {DECIDED} SELECT run_id, count(*) AS n_rows, round(avg((truth = pred)::INT), 6) AS accuracy, count_if(truth = 'Benign' AND pred <> 'Benign') AS benign_fp, "
    "round(count_if(truth <> 'Benign' AND pred = 'Benign') / nullif(count_if(truth <> 'Benign'), 0), 6) AS attack_to_benign, "
    "round(2 * count_if(truth <> 'Benign' AND pred <> 'Benign') / nullif(count_if(truth <> 'Benign') + count_if(pred <> 'Benign'), 0), 6) AS binary_f1 FROM d GROUP BY run_id",
)
def agg11(spark, d):
    attack, alarm = F.col("truth") != "Benign", F.col("pred") != "Benign"
    return decided(spark, d).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"), R(F.avg((F.col("truth") == F.col("pred")).cast("int"))).alias("accuracy"), F.count_if(~attack & alarm).alias("benign_fp"),
        R(M.rate(~alarm, attack)).alias("attack_to_benign"), R(F.try_divide(2 * F.count_if(attack & alarm), F.count_if(attack) + F.count_if(alarm))).alias("binary_f1"),
    )


_SYS = (
    "count(*) AS n_rows, round(avg((truth = pred)::INT), 6) AS accuracy, round(count_if(truth = 'Benign' AND pred NOT IN ('Benign', 'Unknown')) / nullif(count_if(truth = 'Benign'), 0), 6) AS benign_fp_rate, "
    "round(count_if(truth = 'Benign' AND pred = 'Unknown') / nullif(count_if(truth = 'Benign'), 0), 6) AS benign_reject_rate, round(avg((pred = 'Unknown')::INT), 6) AS overall_reject_rate, "
    "round(count_if(truth = 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth = 'Unknown'), 0), 6) AS unknown_detection_rate, "
    "round(count_if(truth <> 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth <> 'Unknown'), 0), 6) AS false_unknown_all_known, "
    "round(count_if(truth NOT IN ('Benign', 'Unknown') AND pred = 'Unknown') / nullif(count_if(truth NOT IN ('Benign', 'Unknown')), 0), 6) AS false_unknown_known_attacks, count_if(truth = 'Unknown') AS unknown_support"
)


@book("agg12_system_metrics", f"WITH {DECIDED} SELECT run_id, holdout_family, split, {_SYS} FROM d GROUP BY ALL")
def agg12(spark, d):
    cols = M.system_columns()
    out = decided(spark, d).groupBy("run_id", "holdout_family", "split").agg(*[c.alias(n) for n, c in cols.items()])
    return out.select("run_id", "holdout_family", "split", *[R(c).alias(c) if c.endswith("rate") or c.startswith("false") or c == "accuracy" else F.col(c) for c in cols])


@book(
    "agg13_stage1_confusion",
    f"WITH {SCORES} SELECT run_id, count_if(y1 = 1 AND p >= 0.5) AS tp, count_if(y1 = 0 AND p >= 0.5) AS fp, count_if(y1 = 0 AND p < 0.5) AS tn, count_if(y1 = 1 AND p < 0.5) AS fn, "
    "round(count_if(y1 = 0 AND p >= 0.5) / greatest(count_if(y1 = 0), 1), 6) AS fpr, round(count_if(y1 = 1 AND p >= 0.5) / greatest(count_if(y1 = 1), 1), 6) AS tpr FROM s GROUP BY run_id",
)
def agg13(spark, d):
    y, a = F.col("y1") == 1, F.col("p") >= THRESHOLD
    count = F.count_if
    return scores(spark, d).groupBy("run_id").agg(
        count(y & a).alias("tp"), count(~y & a).alias("fp"), count(~y & ~a).alias("tn"), count(y & ~a).alias("fn"),
        R(count(~y & a) / F.greatest(count(~y), F.lit(1))).alias("fpr"), R(count(y & a) / F.greatest(count(y), F.lit(1))).alias("tpr"),
    )


@book(
    "agg14_stage_errors",
    f"WITH {DECIDED} SELECT run_id, count_if(y1 = 1 AND p < 0.5) AS missed_attacks, count_if(y1 = 0 AND p >= 0.5) AS false_alarms, count_if(y1 = 1 AND p >= 0.5 AND pred = 'Unknown' AND truth <> 'Unknown') AS rejected_known, "
    "count_if(y1 = 1 AND p >= 0.5 AND pred NOT IN ('Unknown', truth) AND truth <> 'Unknown') AS wrong_family, count_if(truth = 'Unknown' AND pred NOT IN ('Unknown', 'Benign')) AS absorbed_unknown FROM d GROUP BY run_id",
)
def agg14(spark, d):
    y, a, t, q = F.col("y1") == 1, F.col("p") >= THRESHOLD, F.col("truth"), F.col("pred")
    return decided(spark, d).groupBy("run_id").agg(
        F.count_if(y & ~a).alias("missed_attacks"), F.count_if(~y & a).alias("false_alarms"), F.count_if(y & a & (q == "Unknown") & (t != "Unknown")).alias("rejected_known"),
        F.count_if(y & a & (q != "Unknown") & (q != t) & (t != "Unknown")).alias("wrong_family"), F.count_if((t == "Unknown") & ~q.isin("Unknown", "Benign")).alias("absorbed_unknown"),
    )


@book(
    "agg15_family_recall",
    f"WITH {SCORES}, r AS (SELECT run_id, fam, avg((p >= 0.5)::INT) AS r FROM s WHERE y1 = 1 AND fam NOT IN ('', 'nan') GROUP BY ALL HAVING count(*) >= 5), o AS (SELECT run_id, avg((p >= 0.5)::INT) AS o FROM s WHERE y1 = 1 GROUP BY run_id) "
    "SELECT o.run_id, round(coalesce(min(r), any_value(o)), 6) AS min_recall, round(coalesce(quantile_cont(r, 0.1), any_value(o)), 6) AS p10_recall FROM o LEFT JOIN r USING (run_id) GROUP BY o.run_id",
)
def agg15(spark, d):
    """Recall per attack family with at least 5 rows: minimum and 10 % quantile; without such families the overall recall."""
    attacks = scores(spark, d).where("y1 = 1").withColumn("hit", (F.col("p") >= THRESHOLD).cast("int"))
    families = attacks.groupBy("run_id", "fam").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    good = (F.col("n") >= 5) & ~F.col("fam").isin("", "nan")
    recall = F.when(good, F.col("hits") / F.col("n"))
    overall = F.sum("hits") / F.sum("n")
    return families.groupBy("run_id").agg(R(F.coalesce(F.min(recall), overall)).alias("min_recall"), R(F.coalesce(F.percentile(recall, F.lit(0.1)), overall)).alias("p10_recall"))


@book(
    "agg16_exact_quantiles",
    f"WITH {SCORES} SELECT run_id, " + ", ".join(f"round(quantile_cont(p, {q}), 6) AS q{int(q * 1000):03d}" for q in (0.5, 0.9, 0.95, 0.99, 0.995)) + " FROM s WHERE y1 = 0 GROUP BY run_id",
)
def agg16(spark, d):
    qs = [0.5, 0.9, 0.95, 0.99, 0.995]
    out = quantiles(scores(spark, d).where("y1 = 0"), ["run_id"], "p", qs)
    return out.select("run_id", *[R(F.get("q", F.lit(i))).alias(f"q{int(q * 1000):03d}") for i, q in enumerate(qs)])


@book(
    "agg17_conformal_thresholds",
    f"WITH {SCORES}, fams(family) AS (VALUES {', '.join(f"('{x}')" for x in FAMILIES)}), q AS (SELECT run_id, fam, quantile_cont(tprob, 0.1) AS t FROM s WHERE split = 'val' AND y1 = 1 AND tprob IS NOT NULL GROUP BY ALL) "
    "SELECT r.run_id, family, round(coalesce(t, 0), 9) AS threshold FROM (SELECT DISTINCT run_id FROM s) r CROSS JOIN fams LEFT JOIN q ON q.run_id = r.run_id AND q.fam = family",
)
def agg17(spark, d):
    """Per run and family the 10 % quantile of the true family's probability on val; 0 without rows."""
    s = scores(spark, d)
    q = quantiles(s.where("split = 'val' AND y1 = 1").withColumn("family", F.col("fam")), ["run_id", "family"], "tprob", [0.1]).select("run_id", "family", F.get("q", F.lit(0)).alias("t"))
    frame = s.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(x) for x in FAMILIES])).alias("family"))
    return frame.join(q, ["run_id", "family"], "left").select("run_id", "family", R(F.coalesce("t", F.lit(0.0)), 9).alias("threshold"))


@book(
    "agg18_roc_auc",
    f"WITH {SCORES}, b AS (SELECT run_id, p, count_if(y1 = 1) AS a, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY run_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rk FROM b) "
    "SELECT run_id, round((sum(rk * a) - sum(a) * (sum(a) + 1) / 2) / nullif(sum(a) * (sum(n) - sum(a)), 0), 6) AS auc FROM r GROUP BY run_id",
)
def agg18(spark, d):
    return M.auc(scores(spark, d), ["run_id"], "p", F.col("y1") == 1).select("run_id", R("auc").alias("auc"))


@book(
    "agg19_average_precision",
    f"WITH {SCORES}, b AS (SELECT run_id, p, count_if(y1 = 1) AS a, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, sum(a) OVER w AS tp, sum(n) OVER w AS al FROM b WINDOW w AS (PARTITION BY run_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) "
    "SELECT run_id, round(sum(a * tp / al) / nullif(sum(a), 0), 6) AS average_precision FROM r GROUP BY run_id",
)
def agg19(spark, d):
    return M.average_precision(scores(spark, d), ["run_id"], "p", F.col("y1") == 1).select("run_id", R("average_precision").alias("average_precision"))


@book("agg20_brier", f"WITH {SCORES} SELECT run_id, round(avg((p - y1) * (p - y1)), 6) AS brier, round(avg(power(greatest(1e-12, least(1 - 1e-12, p)) - y1, 2)), 6) AS brier_clipped FROM s GROUP BY run_id")
def agg20(spark, d):
    return scores(spark, d).groupBy("run_id").agg(R(F.avg(F.pow(F.col("p") - F.col("y1"), 2))).alias("brier"), R(F.avg(F.pow(N.clipped(F.col("p")) - F.col("y1"), 2))).alias("brier_clipped"))


_BINS = f"{SCORES}, b AS (SELECT run_id, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y1) AS my FROM s GROUP BY ALL), fr AS (SELECT run_id, unnest(range(10))::INT AS bin FROM (SELECT DISTINCT run_id FROM s))"


@book("agg21_calibration_bins", f"WITH {_BINS} SELECT fr.run_id, fr.bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y, round(abs(mp - my), 6) AS gap FROM fr LEFT JOIN b USING (run_id, bin)")
def agg21(spark, d):
    out = M.calibration_bins(scores(spark, d), ["run_id"], "p", F.col("y1"))
    return out.select("run_id", "bin", "n", *[R(c).alias(c) for c in ("mean_p", "mean_y", "gap")])


@book("agg21_ece", f"WITH {_BINS} SELECT run_id, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b GROUP BY run_id")
def agg21e(spark, d):
    return M.ece(scores(spark, d), ["run_id"], "p", F.col("y1")).select("run_id", R("ece").alias("ece"))


@book("agg22_top_confidence", f"WITH {SCORES} SELECT run_id, round(avg(greatest(1 - p, p * pmax)), 6) AS mean_confidence, round(avg(CASE WHEN tprob IS NOT NULL THEN 1 - p * tprob END), 6) AS mean_miss FROM s GROUP BY run_id")
def agg22(spark, d):
    """Top-label confidence where Benign competes through p, and the mass the true known family lacks."""
    p = F.col("p")
    return scores(spark, d).groupBy("run_id").agg(R(F.avg(F.greatest(1 - p, p * F.col("pmax")))).alias("mean_confidence"), R(F.avg(1 - p * F.col("tprob"))).alias("mean_miss"))


@book(
    "agg23_family_calibration",
    f"WITH {SCORES}, a AS (SELECT dataset, fam, least(floor(pmax * 10), 9)::INT AS bin, count(*) AS n, sum(pmax) AS sp, sum((pred_fam = fam)::INT) AS hit, list(DISTINCT holdout_family) AS h FROM s WHERE y1 = 1 GROUP BY ALL) "
    "SELECT dataset, fam AS family, sum(n)::BIGINT AS n, round(sum(abs(sp - hit)) / sum(n), 6) AS ece, array_to_string(list_sort(list_distinct(flatten(list(h)))), '|') AS holdouts FROM a GROUP BY dataset, fam",
)
def agg23(spark, d):
    """Ten-bin calibration per dataset and family from mergeable bin states."""
    attacks = scores(spark, d).where("y1 = 1")
    bins = attacks.groupBy("dataset", F.col("fam").alias("family"), F.least(F.floor(F.col("pmax") * 10), F.lit(9)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pmax").alias("sp"), F.count_if(F.col("pred_fam") == F.col("fam")).alias("hit"), F.collect_set("holdout_family").alias("h")
    )
    names = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("h")))), "|")
    return bins.groupBy("dataset", "family").agg(F.sum("n").alias("n"), R(F.sum(F.abs(F.col("sp") - F.col("hit"))) / F.sum("n")).alias("ece"), names.alias("holdouts"))


@book(
    "agg24_sink_diagnostic",
    f"WITH {DECIDED} SELECT holdout_family, pred_fam AS sink, count(*) AS n, round(avg(pmax), 6) AS mean_pmax, round(avg(p), 6) AS mean_p, round(avg((pmax >= 0.9)::INT), 6) AS overconfident, max(struct_pack(pmax := pmax, score_id := score_id)).score_id AS example FROM d WHERE truth = 'Unknown' AND p >= 0.5 GROUP BY ALL",
)
def agg24(spark, d):
    """Families that absorb true unknowns, with the most confident example."""
    rows = decided(spark, d).where((F.col("truth") == "Unknown") & (F.col("p") >= THRESHOLD))
    return rows.groupBy("holdout_family", F.col("pred_fam").alias("sink")).agg(
        F.count(F.lit(1)).alias("n"), R(F.avg("pmax")).alias("mean_pmax"), R(F.avg("p")).alias("mean_p"), R(F.avg((F.col("pmax") >= 0.9).cast("int"))).alias("overconfident"),
        F.max(F.struct("pmax", "score_id"))["score_id"].alias("example"),
    )


@book(
    "agg25_top_sinks",
    f"WITH {DECIDED}, c AS (SELECT run_id, pred, count(*) AS n FROM d WHERE truth = 'Unknown' GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY run_id) AS total, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, pred) AS k FROM c) "
    "SELECT run_id, max(pred) FILTER (WHERE k = 1) AS top_sink, round(max(n / total) FILTER (WHERE k = 1), 6) AS top_share, max(pred) FILTER (WHERE k = 2) AS second_sink, round(max(n / total) FILTER (WHERE k = 2), 6) AS second_share FROM r GROUP BY run_id",
)
def agg25(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("run_id")
    c = decided(spark, d).where("truth = 'Unknown'").groupBy("run_id", "pred").agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumns({"share": F.col("n") / F.sum("n").over(w), "k": F.row_number().over(w.orderBy(F.col("n").desc(), "pred"))}).where("k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return r.groupBy("run_id").agg(pick(1, "pred").alias("top_sink"), R(pick(1, "share")).alias("top_share"), pick(2, "pred").alias("second_sink"), R(pick(2, "share")).alias("second_share"))


@book("agg01_group_counts", f"WITH {FLOWS} SELECT dataset, split, family, count(*) AS n FROM f GROUP BY ALL")
def agg01(spark, d):
    return flows(spark, d).groupBy("dataset", "split", "family").agg(F.count(F.lit(1)).alias("n"))


@book(
    "agg02_unit_counts",
    f"WITH {FLOWS} SELECT unit_no, count(*) AS n, count_if(y_stage1_attack = 1) AS attack_rows, count_if(y_stage1_attack = 0) AS benign_rows, count(DISTINCT family) FILTER (WHERE y_stage1_attack = 1) AS families FROM f GROUP BY unit_no",
)
def agg02(spark, d):
    """Rows per unit and family first; family diversity is then a count of rows, without a distinct aggregate."""
    per = flows(spark, d).groupBy("unit_no", "family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_stage1_attack") == 1).alias("a"))
    return per.groupBy("unit_no").agg(F.sum("n").alias("n"), F.sum("a").alias("attack_rows"), F.sum(F.col("n") - F.col("a")).alias("benign_rows"), F.count_if(F.col("a") > 0).alias("families"))


_FAM = "CASE WHEN y_stage1_attack = 0 THEN 'Benign' WHEN family = '' THEN '__EMPTY__' ELSE family END"


def support_family():
    return F.when(F.col("y_stage1_attack") == 0, "Benign").when(F.col("family") == "", "__EMPTY__").otherwise(F.col("family"))


@book(
    "agg03_support_tables",
    f"WITH {FLOWS}, g AS (SELECT dataset, split, {_FAM} AS family FROM f) SELECT dataset, split, family, n, (sum(n) OVER (PARTITION BY dataset, split))::BIGINT AS split_rows_total FROM (SELECT dataset, split, family, count(*) AS n FROM g GROUP BY ALL)",
)
def agg03(spark, d):
    from pyspark.sql import Window

    g = flows(spark, d).groupBy("dataset", "split", support_family().alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("split_rows_total", F.sum("n").over(Window.partitionBy("dataset", "split")))


@book(
    "agg03_support_grouping_sets",
    f"WITH {FLOWS}, g AS (SELECT dataset, split, {_FAM} AS family FROM f) SELECT dataset, split, family, (grouping(dataset) * 4 + grouping(split) * 2 + grouping(family))::INT AS level, count(*) AS n FROM g GROUP BY GROUPING SETS ((dataset, split, family), (split, family), (split))",
)
def agg03g(spark, d):
    g = flows(spark, d).select("dataset", "split", support_family().alias("family"))
    sets = g.groupingSets([[F.col("dataset"), F.col("split"), F.col("family")], [F.col("split"), F.col("family")], [F.col("split")]], F.col("dataset"), F.col("split"), F.col("family"))
    return sets.agg((F.grouping("dataset") * 4 + F.grouping("split") * 2 + F.grouping("family")).cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


@book("agg04_support_pivot", f"WITH {FLOWS} SELECT dataset, {_FAM} AS family, " + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}" for s in ("train", "val", "test")) + " FROM f GROUP BY ALL")
def agg04(spark, d):
    return flows(spark, d).groupBy("dataset", support_family().alias("family")).pivot("split", ["train", "val", "test"]).count().na.fill(0)


PROFILED = ["flow_duration", "flow_bytes_s", "flow_pkts_s", "iat_mean", "iat_std", "pkt_len_mean", "active_mean"]


@book(
    "agg05_numeric_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if(v IS NULL) AS n_missing, count(v) AS n, round(avg(v), 3) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(stddev_pop(v) / nullif(avg(v), 0), 5) AS cv FROM (SELECT CASE WHEN isfinite({c}) THEN {c} END AS v FROM flows)"
        for c in PROFILED
    ),
)
def agg05(spark, d):
    """Missing values, count, mean, minimum, maximum and population deviation (relative to the mean) per column."""
    wide = table(spark, d, "flows").select(*[N.finite(F.col(c)).alias(c) for c in PROFILED])
    aggs = [
        F.struct(
            F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.count(c).alias("n"), R(F.avg(c), 3).alias("mean"), R(F.min(c)).alias("min"), R(F.max(c)).alias("max"), R(F.try_divide(F.stddev_pop(c), F.avg(c)), 5).alias("cv")
        )
        for c in PROFILED
    ]
    return wide.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


@book(
    "agg06_numeric_columns",
    "WITH x AS (SELECT line_id, string_split(line_text, ',') AS f FROM raw_lines WHERE line_text NOT LIKE '%\"%'), c AS (SELECT generate_subscripts(f, 1) AS pos, unnest(f) AS v FROM x WHERE len(f) = 43) "
    "SELECT column_name, round(avg((try_cast(trim(v) AS DOUBLE) IS NOT NULL)::INT), 6) AS numeric_share, avg((try_cast(trim(v) AS DOUBLE) IS NOT NULL)::INT) >= 0.9 AS is_numeric FROM c JOIN raw_schema ON pos = col_pos GROUP BY column_name",
)
def agg06(spark, d):
    x = table(spark, d, "raw_lines").where(~F.col("line_text").contains('"')).select(F.split("line_text", ",").alias("f")).where(F.size("f") == 43)
    c = x.select(F.posexplode("f").alias("i", "v")).withColumn("ok", F.trim("v").try_cast("double").isNotNull().cast("int"))
    share = c.groupBy((F.col("i") + 1).alias("col_pos")).agg(F.avg("ok").alias("s"))
    return share.join(F.broadcast(table(spark, d, "raw_schema")), "col_pos").select("column_name", R("s").alias("numeric_share"), (F.col("s") >= 0.9).alias("is_numeric"))


@book(
    "agg07_schema_groups",
    "WITH k AS (SELECT file_no, rec_no, json_keys(any_value(payload)) AS ks FROM capture_records GROUP BY ALL), n AS (SELECT file_no, rec_no, array_to_string(list_sort(list_transform(ks, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_'))), '|') AS s FROM k) "
    "SELECT substr(md5(s), 1, 12) AS schema_hash, count(DISTINCT file_no) AS n_files, count(*) AS n_records, min(file_no) AS example FROM n GROUP BY s",
)
def agg07(spark, d):
    from flowsieve.functions.text import canonical, short_hash

    once = table(spark, d, "capture_records").groupBy("file_no", "rec_no").agg(F.any_value("payload").alias("payload"))
    names = F.array_join(F.array_sort(F.transform(F.json_object_keys("payload"), lambda x: canonical(x))), "|")
    per_file = once.groupBy(names.alias("s"), "file_no").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(short_hash(F.col("s"), 12, "md5").alias("schema_hash")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_records"), F.min("file_no").alias("example"))


_RUNS = f"{DECIDED}, m AS (SELECT dataset, model_name, holdout_family, run_seed, avg((truth = pred)::INT)::DOUBLE AS accuracy, count_if(truth = 'Benign' AND pred <> 'Benign') / nullif(count_if(truth = 'Benign'), 0) AS benign_alarm FROM d GROUP BY ALL)"


def run_metrics(spark, d, keys=("dataset", "model_name", "holdout_family", "run_seed")):
    benign = F.col("truth") == "Benign"
    return decided(spark, d).groupBy(*keys).agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("accuracy"), M.rate(F.col("pred") != "Benign", benign).alias("benign_alarm"))


_T = "CASE n WHEN 2 THEN 12.706204736432095 WHEN 3 THEN 4.302652729911275 WHEN 4 THEN 3.182446305284263 WHEN 5 THEN 2.7764451051977987 WHEN 6 THEN 2.570581835636314 WHEN 7 THEN 2.4469118511449692 WHEN 8 THEN 2.3646242515927844 WHEN 9 THEN 2.3060041352041662 WHEN 10 THEN 2.2621571628540993 WHEN 11 THEN 2.2281388519649385 WHEN 12 THEN 2.200985160082949 END"


@book(
    "agg26_seed_summary",
    f"WITH {_RUNS}, l AS (SELECT dataset, model_name, run_seed, 'accuracy' AS metric, accuracy AS v FROM m UNION ALL SELECT dataset, model_name, run_seed, 'benign_alarm', benign_alarm FROM m), "
    "a AS (SELECT dataset, model_name, metric, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM l WHERE v IS NOT NULL GROUP BY ALL) "
    f"SELECT dataset, model_name, metric, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(lo, 6) AS min, round(hi, 6) AS max, round(mean - {_T} * sd / sqrt(n), 6) AS ci95_low, round(mean + {_T} * sd / sqrt(n), 6) AS ci95_high FROM a",
)
def agg26(spark, d):
    from flowsieve.operators.statistics import seed_summary

    out = seed_summary(run_metrics(spark, d), ["dataset", "model_name"], ["accuracy", "benign_alarm"])
    return out.select("dataset", "model_name", "metric", "n", *[R(c).alias(c) for c in ("mean", "sd", "min", "max", "ci95_low", "ci95_high")])


@book(
    "agg27_heterogeneity",
    f"WITH {_RUNS}, a AS (SELECT dataset, run_seed, avg(accuracy) AS mean, min(accuracy) AS lo, max(accuracy) AS hi, max(accuracy) - min(accuracy) AS rng FROM m GROUP BY ALL) "
    "SELECT dataset, count(*) AS n_seeds, round(avg(mean), 6) AS mean, round(avg(lo), 6) AS mean_min, round(avg(hi), 6) AS mean_max, round(avg(rng), 6) AS mean_range FROM a GROUP BY dataset",
)
def agg27(spark, d):
    per = run_metrics(spark, d).groupBy("dataset", "run_seed").agg(F.avg("accuracy").alias("m"), F.min("accuracy").alias("lo"), F.max("accuracy").alias("hi"))
    return per.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_seeds"), R(F.avg("m")).alias("mean"), R(F.avg("lo")).alias("mean_min"), R(F.avg("hi")).alias("mean_max"), R(F.avg(F.col("hi") - F.col("lo"))).alias("mean_range"))


@book(
    "agg28_runtime",
    "SELECT run_id, model_name, count(*) AS n_rows, max(date_diff('microsecond', scored_at, loaded_at))::BIGINT AS max_us, sum(date_diff('microsecond', scored_at, loaded_at))::BIGINT AS sum_us FROM score_frame GROUP BY ALL",
)
def agg28(spark, d):
    """Loading delay per run: maximum, sum and size; null keys are groups of their own."""
    us = F.expr("timestampdiff(MICROSECOND, scored_at, loaded_at)")
    return table(spark, d, "score_frame").groupBy("run_id", "model_name").agg(F.count(F.lit(1)).alias("n_rows"), F.max(us).alias("max_us"), F.sum(us).alias("sum_us"))


@book(
    "agg31_class_weights",
    f"WITH {FLOWS}, c AS (SELECT family, count(*) AS n FROM f WHERE y_stage1_attack = 1 AND family <> '' GROUP BY ALL), t AS (SELECT *, sum(n) OVER () AS total, count(*) OVER () AS k FROM c), w AS (SELECT *, total / n AS inv, total / (k * n) AS bal FROM t) "
    "SELECT family, n, round(inv / avg(inv) OVER (), 6) AS balanced, round((1 / n) / (k / total), 6) AS inverse_family, round(least(25, greatest(0.1, bal / median(bal) OVER ())), 6) AS clipped, round(n / total, 6) AS prior FROM w",
)
def agg31(spark, d):
    """Class weights per attack family: balanced, inverse frequency (row mean 1), median-scaled and clipped, prior."""
    from pyspark.sql import Window

    c = flows(spark, d).where("y_stage1_attack = 1 AND family <> ''").groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy()  # one row per family
    t = c.withColumns({"total": F.sum("n").over(all_), "k": F.count(F.lit(1)).over(all_)}).withColumns({"inv": F.col("total") / F.col("n"), "bal": F.col("total") / (F.col("k") * F.col("n"))})
    middle = F.percentile("bal", F.lit(0.5)).over(all_)
    return t.select(
        "family", "n", R(F.col("inv") / F.avg("inv").over(all_)).alias("balanced"), R((1 / F.col("n")) / (F.col("k") / F.col("total"))).alias("inverse_family"),
        R(F.least(F.lit(25.0), F.greatest(F.lit(0.1), F.col("bal") / middle))).alias("clipped"), R(F.col("n") / F.col("total")).alias("prior"),
    )


FEATURES = [
    "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "fwd_bytes", "bwd_bytes", "flow_bytes_s", "flow_pkts_s",
    "iat_mean", "iat_std", "pkt_len_mean", "pkt_len_std", "fwd_hdr_len", "init_win_bytes", "active_mean",
]
_TOLD = "CASE WHEN {0} IS NULL THEN '~' WHEN isnan({0}::DOUBLE) THEN 'nan' WHEN abs({0}::DOUBLE) < 1e15 THEN floor({0}::DOUBLE * 1000 + 0.5)::BIGINT::VARCHAR ELSE 'inf' END"
_ROW = "md5(concat_ws('|', " + ", ".join(_TOLD.format(c) for c in FEATURES) + "))"


def row_hash(*extra):
    """Hash of all 14 features (and `extra` columns); numbers count to thousandths, so that any engine writes them alike."""
    return F.md5(F.concat_ws("|", *[_told(c) for c in FEATURES], *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in extra]))


def _told(c: str):
    v = F.col(c).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e15)
    return F.when(usable, F.floor(v * 1000 + 0.5).cast("long").cast("string")).otherwise(F.when(v.isNull(), "~").when(F.isnan(v), "nan").otherwise("inf"))


@book(
    "agg32_duplicate_rows",
    f"WITH {FLOWS}, h AS (SELECT split, {_ROW} AS h, count(*) AS n FROM f GROUP BY ALL) SELECT split, sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(n) - count(*))::BIGINT AS n_duplicates FROM h GROUP BY split",
)
def agg32(spark, d):
    h = flows(spark, d).groupBy("split", row_hash().alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("n") - 1).alias("n_duplicates"))


@book("agg33_most_common", "SELECT label, count(*) AS n FROM flows WHERE label IS NOT NULL GROUP BY label ORDER BY n DESC, label LIMIT 25")
def agg33(spark, d):
    """Top-k report: the 25 most frequent spellings."""
    return table(spark, d, "flows").where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label").limit(25)


@book("agg34_pivot_max", f"WITH {_RUNS} SELECT holdout_family, " + ", ".join(f"round(max(accuracy) FILTER (WHERE model_name = '{m}'), 6) AS {m}" for m in ("rf", "xgb", "lgbm", "extra")) + " FROM m GROUP BY holdout_family")
def agg34(spark, d):
    return run_metrics(spark, d).groupBy("holdout_family").pivot("model_name", ["rf", "xgb", "lgbm", "extra"]).agg(R(F.max("accuracy")))


@book(
    "agg35_residual_structure",
    f"WITH {DECIDED}, c AS (SELECT truth, pred, count(*) AS n FROM d WHERE truth <> pred GROUP BY ALL), s2 AS (SELECT *, n / sum(n) OVER (PARTITION BY truth) AS sh, row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred) AS k FROM c) "
    "SELECT truth, sum(n)::BIGINT AS n_errors, max(pred) FILTER (WHERE k = 1) AS modal, round(max(sh), 6) AS modal_share, round(CASE WHEN count(*) > 1 THEN -sum(sh * ln(sh)) / ln(count(*)) ELSE 0 END, 6) AS entropy, round(sum(sh * sh), 6) AS concentration FROM s2 GROUP BY truth",
)
def agg35(spark, d):
    """Where errors go: modal destination, its share, normalised entropy and concentration."""
    from pyspark.sql import Window

    w = Window.partitionBy("truth")
    c = decided(spark, d).where("truth <> pred").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    s = c.withColumns({"sh": F.col("n") / F.sum("n").over(w), "k": F.row_number().over(w.orderBy(F.col("n").desc(), "pred"))})
    ent = F.when(F.count(F.lit(1)) > 1, -F.sum(F.col("sh") * F.ln("sh")) / F.ln(F.count(F.lit(1)).cast("double"))).otherwise(0.0)
    return s.groupBy("truth").agg(F.sum("n").alias("n_errors"), F.max(F.when(F.col("k") == 1, F.col("pred"))).alias("modal"), R(F.max("sh")).alias("modal_share"), R(ent).alias("entropy"), R(F.sum(F.col("sh") * F.col("sh"))).alias("concentration"))


@book(
    "agg36_budget_coverage",
    f"WITH {DECIDED}, b(budget) AS (VALUES (0.01), (0.05), (0.1), (0.2)), m AS (SELECT dataset, holdout_family, avg((pred = 'Unknown')::INT)::DOUBLE AS rr FROM d GROUP BY ALL) "
    "SELECT dataset, budget::DOUBLE AS budget, count_if(rr <= budget) AS n_feasible, count(*) AS n_total, coalesce(array_to_string(list(holdout_family ORDER BY holdout_family) FILTER (WHERE rr <= budget), '|'), '') AS feasible FROM m, b GROUP BY ALL",
)
def agg36(spark, d):
    m = decided(spark, d).groupBy("dataset", "holdout_family").agg(F.avg((F.col("pred") == "Unknown").cast("int")).alias("rr"))
    each = m.select("*", F.explode(F.array(*[F.lit(x) for x in (0.01, 0.05, 0.1, 0.2)])).alias("budget"))
    ok = F.col("rr") <= F.col("budget")
    names = F.array_join(F.array_sort(F.collect_list(F.when(ok, F.col("holdout_family")))), "|")
    return each.groupBy("dataset", "budget").agg(F.count_if(ok).alias("n_feasible"), F.count(F.lit(1)).alias("n_total"), names.alias("feasible"))


# decisions and truths

@book("prj14_support_family", f"WITH {FLOWS} SELECT row_id, {_FAM} AS family FROM f")
def prj14(spark, d):
    return flows(spark, d).select("row_id", support_family().alias("family"))


@book("prj15_closed_truth", f"WITH {SCORES} SELECT run_id, CASE WHEN y1 = 0 THEN 'Benign' ELSE fam END AS truth, count(*) AS n FROM s GROUP BY ALL")
def prj15(spark, d):
    return scores(spark, d).groupBy("run_id", L.closed_truth(F.col("y1"), F.col("fam")).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


@book(
    "prj16_open_truth",
    f"WITH {SCORES} SELECT run_id, CASE WHEN y1 = 0 THEN 'Benign' WHEN fam = holdout_family THEN 'Unknown' WHEN fam IN ({', '.join(f"'{x}'" for x in FAMILIES)}) THEN fam ELSE 'Unknown' END AS open_truth, count(*) AS n FROM s GROUP BY ALL",
)
def prj16(spark, d):
    return scores(spark, d).groupBy("run_id", L.open_truth(F.col("y1"), F.col("fam"), F.col("holdout_family"), FAMILIES).alias("open_truth")).agg(F.count(F.lit(1)).alias("n"))


@book("prj17_decision", f"WITH {DECIDED} SELECT score_id, pred FROM d")
def prj17(spark, d):
    return decided(spark, d).select("score_id", "pred")


@book("prj18_abstain_policy", f"WITH {DECIDED} SELECT score_id, CASE WHEN pred = 'Unknown' THEN 'Benign' ELSE pred END AS decision, pred = 'Unknown' AS rejected FROM d")
def prj18(spark, d):
    decision, rejected = L.abstain(F.col("pred"), "reject_to_benign")
    return decided(spark, d).select("score_id", decision.alias("decision"), rejected.alias("rejected"))


_METHODS = {"control_tau": 0.6, "margin_reject": 0.3, "entropy_reject": 0.5, "conformal_reject": 0.4}
_RULE = {"control_tau": ("pmax < 0.6", "1 - pmax"), "margin_reject": ("margin < 0.3", "1 - margin"), "entropy_reject": ("entropy > 0.5", "entropy"), "conformal_reject": ("pmax < coalesce(t, 0)", "coalesce(t, 0) - pmax")}
_CONF = "q AS (SELECT run_id, fam AS family, round(quantile_cont(tprob, 0.1), 9) AS t FROM s WHERE split = 'val' AND y1 = 1 AND tprob IS NOT NULL GROUP BY ALL), j AS (SELECT s.*, t FROM s LEFT JOIN q ON q.run_id = s.run_id AND q.family = s.pred_fam)"


def rejected_by_methods(spark, d):
    """Scores decided by each of the four rejectors: method, pred, rejected, doubt."""
    s = scores(spark, d)
    q = quantiles(s.where("split = 'val' AND y1 = 1").drop("pred_fam").withColumnRenamed("fam", "pred_fam"), ["run_id", "pred_fam"], "tprob", [0.1]).select("run_id", "pred_fam", R(F.get("q", F.lit(0)), 9).alias("t"))
    j = s.join(q, ["run_id", "pred_fam"], "left")
    col = F.col
    each = []
    for m, cut in _METHODS.items():
        pred, rejected, doubt = L.rejector(m, col("p"), col("pmax"), col("margin"), col("entropy"), col("pred_fam"), THRESHOLD, col("t") if m == "conformal_reject" else cut)
        each.append(F.struct(F.lit(m).alias("method"), pred.alias("pred"), rejected.alias("rejected"), doubt.alias("doubt")))
    return j.select("run_id", "dataset", "holdout_family", "split", "score_id", "truth", "y1", "unk", F.explode(F.array(*each)).alias("r")).select("run_id", "dataset", "holdout_family", "split", "score_id", "truth", "y1", "unk", "r.*")


REJECTED = f"{SCORES}, {_CONF}, r AS (" + " UNION ALL ".join(
    f"SELECT run_id, dataset, holdout_family, split, score_id, truth, y1, unk, '{m}' AS method, CASE WHEN p < 0.5 THEN 'Benign' WHEN {rule} THEN 'Unknown' ELSE pred_fam END AS pred, p >= 0.5 AND {rule} AS rejected, CASE WHEN p < 0.5 THEN 0 ELSE {doubt} END AS doubt FROM j" for m, (rule, doubt) in _RULE.items()
) + ")"


@book("prj19_rejectors", f"WITH {REJECTED} SELECT score_id, method, pred, rejected, round(doubt, 8) AS doubt FROM r")
def prj19(spark, d):
    return rejected_by_methods(spark, d).select("score_id", "method", "pred", "rejected", R("doubt", 8).alias("doubt"))


@book("prj20_sink_aware", f"WITH {SCORES} SELECT score_id, CASE WHEN p < 0.5 THEN 'Benign' WHEN pmax < 0.4 OR (pred_fam = 'DDoS' AND (pmax < 0.7 OR margin < 0.2)) THEN 'Unknown' ELSE pred_fam END AS pred FROM s")
def prj20(spark, d):
    return scores(spark, d).select("score_id", L.sink_aware(F.col("p"), F.col("pmax"), F.col("margin"), F.col("pred_fam"), "DDoS", THRESHOLD, 0.4, 0.7, 0.2).alias("pred"))


@book(
    "prj21_label_sets",
    f"WITH {DECIDED}, pr AS (SELECT DISTINCT run_id, truth AS label FROM d), lab(label) AS (VALUES {', '.join(f"('{x}')" for x in LABELS)}) SELECT r.run_id, lab.label, pr.label IS NOT NULL AS present FROM (SELECT DISTINCT run_id FROM d) r CROSS JOIN lab LEFT JOIN pr ON pr.run_id = r.run_id AND pr.label = lab.label",
)
def prj21(spark, d):
    """Declared labels of each run and whether they occur; labels of a run fit in one row."""
    sets = decided(spark, d).groupBy("run_id").agg(F.collect_set("truth").alias("there"))
    return sets.select("run_id", F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("label"), "there").select("run_id", "label", F.array_contains("there", F.col("label")).alias("present"))


@book("prj23_selected_cases", f"WITH {SCORES} SELECT dataset || '::' || holdout_family AS case_key, count(*) AS n FROM s WHERE dataset || '::' || holdout_family IN ('MillNet::DDoS', 'CoastIDS::Botnet', 'QuarryNB::DoS') GROUP BY ALL")
def prj23(spark, d):
    from flowsieve.functions.text import case_key

    key = case_key(F.col("dataset"), F.col("holdout_family"))
    return scores(spark, d).where(key.isin("MillNet::DDoS", "CoastIDS::Botnet", "QuarryNB::DoS")).groupBy(key.alias("case_key")).agg(F.count(F.lit(1)).alias("n"))


@book("prj25_comparison_key", f"WITH {SCORES} SELECT DISTINCT dataset || '::' || model_name || '::' || holdout_family AS comparison_key, CASE WHEN model_name IN ('rf', 'extra') THEN 'forest' ELSE 'boosting' END AS surface FROM s")
def prj25(spark, d):
    from flowsieve.functions.text import case_key

    surface = F.when(F.col("model_name").isin("rf", "extra"), "forest").otherwise("boosting")
    return scores(spark, d).select(case_key(F.col("dataset"), F.col("model_name"), F.col("holdout_family")).alias("comparison_key"), surface.alias("surface")).distinct()


QUERIES, SQL = book.queries, book.sql

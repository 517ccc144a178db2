"""Windows, sorts, samples, set operations and joins (WIN, SRT, SMP, SET, JN, AGG-29, AGG-30)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsieve.functions import text as T
from flowsieve.operators import selection as P
from flowsieve.operators import splitting as S
from flowsieve.operators import statistics as ST
from flowsieve.operators import sweep as W
from flowsieve.operators.metrics import system_columns
from flowsieve.plans.base import DECIDED, FLOWS, SCORES, Book, decided, flows, scores
from flowsieve.plans.clean_queries import _QUOTA
from flowsieve.plans.metric_queries import _ROW, REJECTED, row_hash
from flowsieve.tables import table

book = Book()
R = lambda c, n=6: F.round(c, n)

RUNS = (
    f"{DECIDED}, m AS (SELECT run_id, dataset, holdout_family, model_name, run_seed, avg((truth = pred)::INT)::DOUBLE AS accuracy, count_if(truth = 'Benign' AND pred NOT IN ('Benign', 'Unknown')) / nullif(count_if(truth = 'Benign'), 0) AS benign_fp_rate, "
    "avg((pred = 'Unknown')::INT)::DOUBLE AS reject_rate, count(*) AS n FROM d GROUP BY ALL)"
)


def runs(spark, d):
    """One metric row per run and dataset."""
    m = system_columns()
    return decided(spark, d).groupBy("run_id", "dataset", "holdout_family", "model_name", "run_seed").agg(m["accuracy"].alias("accuracy"), m["benign_fp_rate"].alias("benign_fp_rate"), m["overall_reject_rate"].alias("reject_rate"), m["n_rows"].alias("n"))


@book("win01_best_per_holdout", f"WITH {RUNS} SELECT dataset, holdout_family, run_id, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY dataset, holdout_family ORDER BY accuracy DESC, benign_fp_rate NULLS LAST, run_id) AS k FROM m) WHERE k = 1")
def win01(spark, d):
    best = P.first_per_group(runs(spark, d), ["dataset", "holdout_family"], [F.col("accuracy").desc(), F.col("benign_fp_rate").asc_nulls_last(), F.col("run_id")])
    return best.select("dataset", "holdout_family", "run_id", R("accuracy").alias("accuracy"))


@book("win02_latest", "SELECT run_id, row_id, score_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, row_id ORDER BY loaded_at DESC, score_id DESC) AS k FROM score_frame) WHERE k = 1")
def win02(spark, d):
    """Latest row per key; expressed as an aggregate, so that rows are combined before the shuffle and nothing is sorted."""
    return table(spark, d, "score_frame").groupBy("run_id", "row_id").agg(F.max_by("score_id", F.struct("loaded_at", "score_id")).alias("score_id"))


@book("win03_cap", f"WITH {FLOWS} SELECT row_id, fine FROM (SELECT *, row_number() OVER (PARTITION BY split, fine ORDER BY row_id) AS k FROM f) WHERE k <= 100")
def win03(spark, d):
    return S.capped(flows(spark, d), ["split", "fine"], [F.col("row_id")], 100).select("row_id", "fine")


@book(
    "win04_quota_fill",
    f"WITH {FLOWS}, {_QUOTA}, r AS (SELECT row_id, fine, row_number() OVER (PARTITION BY fine ORDER BY row_id) AS k FROM f) SELECT row_id, CASE WHEN k <= n_train THEN 'train' WHEN k <= n_train + n_val THEN 'val' WHEN k <= n THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (fine)",
)
def win04(spark, d):
    f = flows(spark, d).select("row_id", "fine")
    q = S.quotas(f.groupBy("fine").agg(F.count(F.lit(1)).alias("n")), "n")
    return S.quota_fill(f, "fine", [F.col("row_id")], q).select("row_id", "split")


@book("win05_contiguous_parts", f"WITH {FLOWS} SELECT row_id, (floor((row_number() OVER (PARTITION BY unit_no ORDER BY row_id) - 1) / ceil(count(*) OVER (PARTITION BY unit_no) / 4)) + 1)::INT AS part FROM f")
def win05(spark, d):
    return S.contiguous_parts(flows(spark, d).select("unit_no", "row_id"), "unit_no", "row_id", F.lit(4)).select("row_id", "part")


@book("win06_window_groups", "SELECT dataset, unit_no, ntile(3) OVER (PARTITION BY dataset ORDER BY unit_no) AS g FROM (SELECT DISTINCT dataset, unit_no FROM flows WHERE unit_no IS NOT NULL)")
def win06(spark, d):
    units = table(spark, d, "flows").where("unit_no IS NOT NULL").select("dataset", "unit_no").distinct()
    return units.withColumn("g", F.ntile(3).over(Window.partitionBy("dataset").orderBy("unit_no")))


@book(
    "win07_interval_audit",
    "WITH u AS (SELECT *, lead(row_start) OVER (PARTITION BY source_file_name ORDER BY row_start, row_end) AS nx FROM plan_units) SELECT source_file_name, count(*) AS n_units, min(row_start) = 0 AS starts_at_zero, bool_and(nx IS NULL OR nx >= row_end) AS no_overlap, bool_and(nx IS NULL OR nx = row_end) AS contiguous, max(row_end) = sum(raw_row_count) AS covers_rows FROM u GROUP BY source_file_name",
)
def win07(spark, d):
    return S.interval_audit(table(spark, d, "plan_units"), "source_file_name", "row_start", "row_end", "raw_row_count")


_TESTS = f"{SCORES}, t AS (SELECT dataset, holdout_family, exp(-abs(avg(pmax) - 0.6) * 20) AS pv FROM s GROUP BY ALL)"


def tests(spark, d):
    """Stand-in p-values per dataset and holdout."""
    return scores(spark, d).groupBy("dataset", "holdout_family").agg(F.exp(-F.abs(F.avg("pmax") - 0.6) * 20).alias("pv"))


@book(
    "win08_benjamini_hochberg",
    f"WITH {_TESTS}, r AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS m, row_number() OVER (PARTITION BY dataset ORDER BY pv, holdout_family) AS k FROM t) "
    "SELECT dataset, holdout_family, round(least(1, min(pv * m / k) OVER (PARTITION BY dataset ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_bh, round(least(1, pv * m), 6) AS p_bonferroni FROM r",
)
def win08(spark, d):
    """Benjamini-Hochberg and (WIN-09) Bonferroni."""
    out = ST.benjamini_hochberg(tests(spark, d), ["dataset"], "pv", "holdout_family")
    return out.select("dataset", "holdout_family", R("p_bh").alias("p_bh"), R("p_bonferroni").alias("p_bonferroni"))


@book("win09_bonferroni", f"WITH {_TESTS} SELECT dataset, holdout_family, round(least(1, pv * count(*) OVER ()), 6) AS p FROM t")
def win09(spark, d):
    return tests(spark, d).select("dataset", "holdout_family", R(F.least(F.lit(1.0), F.col("pv") * F.count(F.lit(1)).over(Window.partitionBy()))).alias("p"))


_TAUS = [0.4, 0.5, 0.6, 0.7, 0.8]
_THRS = [0.3, 0.5, 0.7]
_GRID = f"g(threshold, tau) AS (SELECT t, u FROM (VALUES {', '.join(f'({t})' for t in _THRS)}) a(t), (VALUES {', '.join(f'({u})' for u in _TAUS)}) b(u))"
_SWEEP = (
    f"{SCORES}, {_GRID}, x AS (SELECT run_id, split, threshold::DOUBLE AS threshold, tau::DOUBLE AS tau, truth, CASE WHEN p < threshold THEN 'Benign' WHEN pmax < tau THEN 'Unknown' ELSE pred_fam END AS pred FROM s, g), "
    "cm AS (SELECT run_id, split, threshold, tau, avg((truth = pred)::INT)::DOUBLE AS accuracy, count_if(truth = 'Benign' AND pred NOT IN ('Benign', 'Unknown')) / nullif(count_if(truth = 'Benign'), 0) AS benign_fp_rate, avg((pred = 'Unknown')::INT)::DOUBLE AS overall_reject_rate, "
    "count_if(truth = 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth = 'Unknown'), 0) AS unknown_detection_rate, count_if(truth <> 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth <> 'Unknown'), 0) AS false_unknown_rate FROM x GROUP BY ALL)"
)
_CM = ("accuracy", "benign_fp_rate", "overall_reject_rate", "unknown_detection_rate", "false_unknown_rate")


def swept(spark, d):
    return W.candidate_metrics(W.decided_counts(scores(spark, d), ["run_id", "split"], _THRS, _TAUS), ["run_id", "split", "threshold", "tau"])


@book("jn13_candidate_sweep", f"WITH {_SWEEP} SELECT run_id, split, threshold, tau, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CM) + " FROM cm")
def jn13(spark, d):
    """Rows x candidates in compressed form."""
    return swept(spark, d).select("run_id", "split", "threshold", "tau", *[R(c).alias(c) for c in _CM])


@book("jn13_candidate_sweep_naive", f"WITH {_SWEEP} SELECT run_id, split, threshold, tau, round(accuracy, 6) AS accuracy FROM cm")
def jn13n(spark, d):
    counts = W.decided_counts_naive(scores(spark, d), ["run_id", "split"], _THRS, _TAUS)
    return W.candidate_metrics(counts, ["run_id", "split", "threshold", "tau"]).select("run_id", "split", "threshold", "tau", R("accuracy").alias("accuracy"))


_FEAS = "coalesce(benign_fp_rate, 0) <= 0.02 + 1e-12 AND coalesce(overall_reject_rate, 0) <= 0.3 + 1e-12"


@book("win10_first_best", f"WITH {_SWEEP} SELECT run_id, threshold, tau, feasible FROM (SELECT *, {_FEAS} AS feasible, row_number() OVER (PARTITION BY run_id ORDER BY ({_FEAS}) DESC, round(accuracy, 9) DESC, threshold, tau) AS k FROM cm WHERE split = 'val') WHERE k = 1")
def win10(spark, d):
    best = W.best_feasible(swept(spark, d).where("split = 'val'"), ["run_id"], {"benign_fp_rate": 0.02, "overall_reject_rate": 0.3}, [F.round("accuracy", 9).desc(), F.col("threshold"), F.col("tau")])
    return best.select("run_id", "threshold", "tau", "feasible")


@book(
    "win11_two_level_best",
    f"WITH {_SWEEP}, a AS (SELECT *, row_number() OVER (PARTITION BY run_id, threshold ORDER BY round(coalesce(unknown_detection_rate, -1), 9) DESC, tau) AS k FROM cm WHERE split = 'val'), b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(accuracy, 9) DESC, threshold DESC) AS j FROM a WHERE k = 1) SELECT run_id, threshold, tau FROM b WHERE j = 1",
)
def win11(spark, d):
    """Best tau per threshold, then the best threshold, by other keys."""
    one = P.first_per_group(swept(spark, d).where("split = 'val'"), ["run_id", "threshold"], [F.round(F.coalesce("unknown_detection_rate", F.lit(-1.0)), 9).desc(), F.col("tau")])
    return P.first_per_group(one, ["run_id"], [F.round("accuracy", 9).desc(), F.col("threshold").desc()]).select("run_id", "threshold", "tau")


@book("win12_rank_statistics", f"WITH {SCORES} SELECT run_id, p, n, (sum(n) OVER (PARTITION BY run_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM (SELECT run_id, round(p, 2) AS p, count(*) AS n FROM s GROUP BY ALL)")
def win12(spark, d):
    by = scores(spark, d).groupBy("run_id", R("p", 2).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("cum", F.sum("n").over(Window.partitionBy("run_id").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)))


_METH = f"{REJECTED}, mm AS (SELECT run_id, method, avg((truth = pred)::INT)::DOUBLE AS accuracy, avg(rejected::INT)::DOUBLE AS reject_rate FROM r GROUP BY ALL)"


def methods(spark, d):
    from flowsieve.plans.metric_queries import rejected_by_methods

    return rejected_by_methods(spark, d).groupBy("run_id", "method").agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("accuracy"), F.avg(F.col("rejected").cast("int")).alias("reject_rate"))


@book("win13_delta_to_control", f"WITH {_METH} SELECT run_id, method, round(accuracy - max(accuracy) FILTER (WHERE method = 'control_tau') OVER (PARTITION BY run_id), 6) AS delta_accuracy, round(reject_rate - max(reject_rate) FILTER (WHERE method = 'control_tau') OVER (PARTITION BY run_id), 6) AS delta_reject_rate FROM mm")
def win13(spark, d):
    out = P.delta_to(methods(spark, d), ["run_id"], F.col("method") == "control_tau", ["accuracy", "reject_rate"])
    return out.select("run_id", "method", R("delta_accuracy").alias("delta_accuracy"), R("delta_reject_rate").alias("delta_reject_rate"))


@book("win14_split_total", f"WITH {FLOWS} SELECT split, family, n, (sum(n) OVER (PARTITION BY split))::BIGINT AS total FROM (SELECT split, family, count(*) AS n FROM f GROUP BY ALL)")
def win14(spark, d):
    g = flows(spark, d).groupBy("split", "family").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy("split")))


# sorts and samples

@book("srt01_mixed_sort", f"WITH {RUNS} SELECT run_id, dataset, round(accuracy, 6) AS accuracy, row_number() OVER (ORDER BY holdout_family, accuracy DESC NULLS LAST, benign_fp_rate NULLS LAST, run_id, dataset) AS position FROM m")
def srt01(spark, d):
    """Mixed directions with missing values last; the sorted result is one row per run."""
    order = Window.partitionBy().orderBy("holdout_family", P.nan_last(F.col("accuracy"), True), P.nan_last(F.col("benign_fp_rate")), "run_id", "dataset")
    return runs(spark, d).withColumn("position", F.row_number().over(order)).select("run_id", "dataset", R("accuracy").alias("accuracy"), "position")


_DAYS = ["night", "day", "lab", "mix"]


@book("srt02_custom_order", "SELECT unit_no, CASE regexp_extract(source_file_name, '_([a-z]+)_', 1) WHEN 'night' THEN 0 WHEN 'day' THEN 1 WHEN 'lab' THEN 2 WHEN 'mix' THEN 3 ELSE 999 END::INT AS kind_key, coalesce(try_cast(regexp_extract(unit_id, 'part(\\d+)of', 1) AS INT), 999999) AS part_key FROM plan_units")
def srt02(spark, d):
    lookup = F.create_map(*[F.lit(x) for kv in zip(_DAYS, range(4)) for x in kv])
    kind = F.regexp_extract("source_file_name", "_([a-z]+)_", 1)
    part = F.nullif(F.regexp_extract("unit_id", r"part(\d+)of", 1), F.lit("")).cast("int")
    return table(spark, d, "plan_units").select("unit_no", F.coalesce(F.try_element_at(lookup, kind), F.lit(999)).alias("kind_key"), F.coalesce(part, F.lit(999999)).alias("part_key"))


@book("srt03_top_k", f"WITH {RUNS} SELECT dataset, run_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, run_id) AS rank FROM m) WHERE rank <= 3")
def srt03(spark, d):
    """Top-k report: the three best runs of each dataset."""
    return P.first_per_group(runs(spark, d), ["dataset"], [F.col("accuracy").desc(), F.col("run_id")], 3).select("dataset", "run_id", "rank")


@book("srt04_head", "SELECT row_id FROM flows ORDER BY row_id LIMIT 1000")
def srt04(spark, d):
    """Head limit in a defined order (a feature of the report it feeds)."""
    return table(spark, d, "flows").orderBy("row_id").limit(1000).select("row_id")


@book("smp01_row_cap", f"WITH {FLOWS} SELECT split, row_id FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) AS k FROM f) WHERE k <= 500")
def smp01(spark, d):
    """Sampling operator: the first 500 rows of each split in row order."""
    return S.capped(flows(spark, d), ["split"], [F.col("row_id")], 500).select("split", "row_id")


@book("smp02_hash_sample", "SELECT row_id FROM flows ORDER BY md5(row_id || '|7'), row_id LIMIT 700")
def smp02(spark, d):
    """Uniform sample of exact size by hash order: repeatable and independent of the partitioning."""
    return table(spark, d, "flows").orderBy(F.md5(F.concat("row_id", F.lit("|7"))), "row_id").limit(700).select("row_id")


@book("smp03_bernoulli_then_exact", "SELECT row_id FROM flows ORDER BY md5(row_id || '|5'), row_id LIMIT 800")
def smp03(spark, d):
    """Bernoulli sample at 1.25 times the target, by the first digits of a hash, cut to its exact size in hash order; whole if the draw falls short."""
    df, n = table(spark, d, "flows").select("row_id"), 800
    total = df.count()
    h = F.md5(F.concat("row_id", F.lit("|5")))
    drawn = df.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < int(min(1.0, 1.25 * n / max(1, total)) * (1 << 32)))
    enough = drawn.count() >= min(n, total)
    return (drawn if enough else df).orderBy(h, "row_id").limit(n)


@book("smp04_rows_per_file", "SELECT file_name, line_id FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY md5(line_id::VARCHAR), line_id) AS k FROM raw_lines) WHERE k <= 20")
def smp04(spark, d):
    return S.capped(table(spark, d, "raw_lines"), ["file_name"], [F.md5(F.col("line_id").cast("string")), F.col("line_id")], 20).select("file_name", "line_id")


@book("smp05_exact_sample", f"WITH {FLOWS} SELECT family, row_id FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY md5(row_id::VARCHAR), row_id) AS k FROM f) WHERE k <= 30")
def smp05(spark, d):
    return S.capped(flows(spark, d), ["family"], [F.md5(F.col("row_id").cast("string")), F.col("row_id")], 30).select("family", "row_id")


# set operations

@book("set01_union_by_name", "SELECT unit_no AS id, dataset, NULL::VARCHAR AS feed_id FROM (SELECT DISTINCT unit_no, dataset FROM flows WHERE unit_no IS NOT NULL) UNION ALL SELECT file_no, dataset, feed_id FROM capture_files")
def set01(spark, d):
    a = table(spark, d, "flows").where("unit_no IS NOT NULL").select(F.col("unit_no").alias("id"), "dataset").distinct()
    b = table(spark, d, "capture_files").select(F.col("file_no").alias("id"), "dataset", "feed_id")
    return a.unionByName(b, allowMissingColumns=True)


@book("set02_surfaces", f"WITH {RUNS} SELECT 'accuracy' AS surface, run_id, dataset, round(accuracy, 6) AS v FROM m UNION ALL SELECT 'reject', run_id, dataset, round(reject_rate, 6) FROM m")
def set02(spark, d):
    long = runs(spark, d).select("run_id", "dataset", F.col("accuracy"), F.col("reject_rate").alias("reject")).unpivot(["run_id", "dataset"], ["accuracy", "reject"], "surface", "v")
    return long.withColumn("v", R("v"))


_H = _ROW


@book("set03_hash_overlap", f"WITH {FLOWS}, h AS (SELECT DISTINCT split, {_H} AS h FROM f) SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_common FROM h a JOIN h b USING (h) WHERE a.split < b.split GROUP BY ALL")
def set03(spark, d):
    """Row hashes common to two splits, for all pairs of splits in one aggregation over the hashes (also JN-17)."""
    per = flows(spark, d).groupBy(row_hash().alias("h")).agg(F.array_sort(F.collect_set("split")).alias("s"))  # at most three splits
    pair = F.explode(F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("split_a"), y.alias("split_b"))))))
    return per.where(F.size("s") > 1).select(pair.alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("n_common"))


@book("set04_missing_labels", f"WITH {FLOWS} SELECT fine FROM f WHERE split = 'train' EXCEPT SELECT fine FROM f WHERE split = 'test'")
def set04(spark, d):
    f = flows(spark, d)
    return f.where("split = 'train'").select("fine").subtract(f.where("split = 'test'").select("fine"))


@book("set05_column_overlap", "WITH c AS (SELECT 'raw' AS s, lower(column_name) AS n FROM raw_schema UNION SELECT 'capture', field_name FROM field_catalog) SELECT count(*) AS n_common, array_to_string(list_sort(list(a.n)), '|') AS common FROM c a JOIN c b ON a.n = b.n AND a.s = 'capture' AND b.s = 'raw'")
def set05(spark, d):
    raw = table(spark, d, "raw_schema").agg(F.collect_set(T.canonical(F.col("column_name"))).alias("a"))
    fields = table(spark, d, "field_catalog").agg(F.collect_set("field_name").alias("b"))
    common = F.array_sort(F.array_intersect("a", "b"))
    return raw.crossJoin(fields).select(F.size(common).cast("long").alias("n_common"), F.array_join(common, "|").alias("common"))  # one row each


@book("set06_upsert", "SELECT candidate_no, score FROM candidate_splits WHERE NOT is_valid UNION ALL SELECT candidate_no, score + 1000 FROM candidate_splits WHERE is_valid")
def set06(spark, d):
    old = table(spark, d, "candidate_splits").select("candidate_no", "score")
    new = table(spark, d, "candidate_splits").where("is_valid").select("candidate_no", (F.col("score") + 1000).alias("score"))
    return P.upsert(old, new, ["candidate_no"])


@book("set07_merged_seeds", "SELECT DISTINCT run_seed AS seed FROM score_frame UNION SELECT unnest([100, 101, 105])")
def set07(spark, d):
    asked = spark.createDataFrame([(100,), (101,), (105,)], "seed int")
    return table(spark, d, "score_frame").select(F.col("run_seed").alias("seed")).union(asked).distinct()


@book("set08_partition_overwrite", f"WITH {FLOWS} SELECT dataset, CASE WHEN dataset = (SELECT min(dataset) FROM f) THEN 0 ELSE count(*) END AS n FROM f GROUP BY dataset")
def set08(spark, d):
    """Rewriting one partition of a summary leaves the others untouched."""
    import uuid

    from flowsieve import scratch

    at = f"{scratch.shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    summary = flows(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    summary.write.partitionBy("dataset").parquet(at)
    changed = summary.agg(F.min("dataset").alias("dataset")).select("dataset", F.lit(0).cast("long").alias("n"))
    changed.write.partitionBy("dataset").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(at)
    return spark.read.parquet(at).select("dataset", "n")


# joins

@book("jn01_many_to_one", f"WITH {SCORES}, k AS (SELECT dataset, feed_id, regexp_replace(lower(dataset || holdout_family), '[^a-z0-9]+', '', 'g') AS case_key, min(audit_no) AS audit_no FROM scenario_audits GROUP BY ALL), kk AS (SELECT case_key, min(audit_no) AS audit_no FROM k GROUP BY 1) SELECT s.run_id, s.dataset, kk.audit_no FROM (SELECT DISTINCT run_id, dataset, regexp_replace(lower(dataset || holdout_family), '[^a-z0-9]+', '', 'g') AS case_key FROM s) s LEFT JOIN kk USING (case_key)")
def jn01(spark, d):
    """Runs to audits by normalised case key; the right side is checked to be unique."""
    key = T.alnum(F.concat("dataset", "holdout_family"))
    audits = table(spark, d, "scenario_audits").groupBy(key.alias("case_key")).agg(F.min("audit_no").alias("audit_no"))
    cases = scores(spark, d).select("run_id", "dataset", key.alias("case_key")).distinct()
    return cases.join(P.unique_or_fail(audits, ["case_key"]), "case_key", "left").select("run_id", "dataset", "audit_no")


@book("jn02_control_join", f"WITH {_METH} SELECT a.run_id, a.method, round(a.accuracy - c.accuracy, 6) AS delta FROM mm a LEFT JOIN mm c ON c.run_id = a.run_id AND c.method = 'control_tau'")
def jn02(spark, d):
    m = methods(spark, d)
    control = m.where("method = 'control_tau'").select("run_id", F.col("accuracy").alias("control"))
    return m.join(control, "run_id", "left").select("run_id", "method", R(F.col("accuracy") - F.col("control")).alias("delta"))


@book("jn03_selected_vs_legacy", f"WITH {RUNS}, a AS (SELECT dataset, holdout_family, arg_max(run_id, (round(accuracy, 9), run_id)) AS selected FROM m GROUP BY ALL), b AS (SELECT dataset, holdout_family, min(run_id) AS legacy FROM m GROUP BY ALL) SELECT a.*, legacy, selected = legacy AS same FROM a LEFT JOIN b USING (dataset, holdout_family)")
def jn03(spark, d):
    r = runs(spark, d)
    keys = ["dataset", "holdout_family"]
    selected = r.groupBy(*keys).agg(F.max_by("run_id", F.struct(F.round("accuracy", 9), "run_id")).alias("selected"))
    return selected.join(r.groupBy(*keys).agg(F.min("run_id").alias("legacy")), keys, "left").withColumn("same", F.col("selected") == F.col("legacy"))


@book("jn04_best_with_failures", f"WITH {RUNS}, b AS (SELECT dataset, holdout_family, max(accuracy) AS best FROM m GROUP BY ALL), u AS (SELECT dataset, holdout_family, count(*) AS absorbed FROM d WHERE truth = 'Unknown' AND pred NOT IN ('Unknown', 'Benign') GROUP BY ALL) SELECT b.dataset, b.holdout_family, round(best, 6) AS best, coalesce(absorbed, 0) AS absorbed FROM b LEFT JOIN u USING (dataset, holdout_family)")
def jn04(spark, d):
    keys = ["dataset", "holdout_family"]
    best = runs(spark, d).groupBy(*keys).agg(F.max("accuracy").alias("best"))
    bad = decided(spark, d).where("truth = 'Unknown' AND pred NOT IN ('Unknown', 'Benign')").groupBy(*keys).agg(F.count(F.lit(1)).alias("absorbed"))
    return best.join(bad, keys, "left").select(*keys, R("best").alias("best"), F.coalesce("absorbed", F.lit(0)).alias("absorbed"))


@book("jn05_optional_side", f"WITH {FLOWS} SELECT a.dataset, a.n AS n_flows, b.n AS n_files FROM (SELECT dataset, count(*) AS n FROM f GROUP BY 1) a LEFT JOIN (SELECT dataset, count(*) AS n FROM capture_files GROUP BY 1) b USING (dataset)")
def jn05(spark, d):
    a = flows(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_flows"))
    return a.join(table(spark, d, "capture_files").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_files")), "dataset", "left")


@book(
    "jn06_taxonomy",
    f"WITH {RUNS}, b AS (SELECT dataset, holdout_family, max(accuracy) AS best FROM m GROUP BY ALL), u AS (SELECT dataset, holdout_family, count_if(truth = 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth = 'Unknown'), 0) AS udr FROM d GROUP BY ALL), v AS (SELECT dataset, count_if(scenario_valid) AS valid FROM scenario_audits GROUP BY ALL) "
    "SELECT b.dataset, b.holdout_family, CASE WHEN udr IS NULL THEN 'mixed' WHEN udr < 0.1 THEN 'hard-collapse' WHEN udr >= 0.75 THEN 'strong' WHEN best >= 0.9 AND coalesce(valid, 0) > 0 THEN 'recoverable' ELSE 'mixed' END AS category FROM b LEFT JOIN u USING (dataset, holdout_family) LEFT JOIN v USING (dataset)",
)
def jn06(spark, d):
    """Point lookups from several tables into one category ladder."""
    keys = ["dataset", "holdout_family"]
    best = runs(spark, d).groupBy(*keys).agg(F.max("accuracy").alias("best"))
    udr = decided(spark, d).groupBy(*keys).agg(system_columns()["unknown_detection_rate"].alias("udr"))
    valid = table(spark, d, "scenario_audits").groupBy("dataset").agg(F.count_if("scenario_valid").alias("valid"))
    category = F.when(F.col("udr").isNull(), "mixed").when(F.col("udr") < 0.1, "hard-collapse").when(F.col("udr") >= 0.75, "strong").when((F.col("best") >= 0.9) & (F.coalesce("valid", F.lit(0)) > 0), "recoverable").otherwise("mixed")
    return best.join(udr, keys, "left").join(valid, "dataset", "left").select(*keys, category.alias("category"))


@book("jn07_closest_task", f"WITH {RUNS}, a AS (SELECT m.dataset, m.run_id, c.candidate_no, abs(c.score - m.n) AS gap, row_number() OVER (PARTITION BY m.dataset, m.run_id ORDER BY abs(c.score - m.n), c.candidate_no) AS k FROM m JOIN candidate_splits c ON c.dataset = m.dataset) SELECT dataset, run_id, candidate_no, gap FROM a WHERE k = 1")
def jn07(spark, d):
    """Nearest match per run: an equi-join on the dataset, then the least distance by aggregation."""
    c = table(spark, d, "candidate_splits").select("dataset", "candidate_no", "score")
    met = runs(spark, d).select("dataset", "run_id", "n").join(c, "dataset").withColumn("gap", F.abs(F.col("score") - F.col("n")))
    return met.groupBy("dataset", "run_id").agg(F.min(F.struct("gap", "candidate_no")).alias("x")).select("dataset", "run_id", "x.candidate_no", "x.gap")


@book("jn08_one_to_one", "SELECT a.fine_label, a.family, b.n FROM label_map a JOIN (SELECT trim(y_stage2_fine) AS fine_label, count(*) AS n FROM flows GROUP BY 1) b USING (fine_label)")
def jn08(spark, d):
    counts = table(spark, d, "flows").groupBy(F.trim("y_stage2_fine").alias("fine_label")).agg(F.count(F.lit(1)).alias("n"))
    return P.unique_or_fail(table(spark, d, "label_map"), ["fine_label"]).join(counts, "fine_label").select("fine_label", "family", "n")


@book("jn09_unit_split", "SELECT f.row_id, u.partition_mode FROM flows f LEFT JOIN plan_units u USING (unit_no)")
def jn09(spark, d):
    return table(spark, d, "flows").select("row_id", "unit_no").join(table(spark, d, "plan_units").select("unit_no", "partition_mode"), "unit_no", "left").select("row_id", "partition_mode")


@book("jn10_plus_pairs", "WITH n AS (SELECT DISTINCT regexp_replace(lower(source_file_name), '\\.csv(\\.gz)?$', '') AS stem FROM plan_units) SELECT a.stem, b.stem AS plus_stem, CASE WHEN b.stem IS NULL THEN 'missing_plus_pair' ELSE 'matched' END AS status FROM n a LEFT JOIN n b ON b.stem = a.stem || '_plus' WHERE a.stem NOT LIKE '%\\_plus' ESCAPE '\\'")
def jn10(spark, d):
    """Files and their *_plus exports, paired by stem."""
    n = table(spark, d, "plan_units").select(F.regexp_replace(F.lower("source_file_name"), r"\.csv(\.gz)?$", "").alias("stem")).distinct()
    plus = n.where(F.col("stem").endswith("_plus")).select(F.col("stem").alias("plus_stem"), F.regexp_replace("stem", "_plus$", "").alias("stem"))
    return n.where(~F.col("stem").endswith("_plus")).join(plus, "stem", "left").withColumn("status", F.when(F.col("plus_stem").isNull(), "missing_plus_pair").otherwise("matched"))


@book("jn11_semi", "SELECT row_id FROM flows WHERE row_id IN (SELECT row_id FROM score_frame WHERE model_name = 'rf')")
def jn11(spark, d):
    return table(spark, d, "flows").join(table(spark, d, "score_frame").where("model_name = 'rf'").select("row_id"), "row_id", "left_semi").select("row_id")


@book("jn12_anti", f"WITH {FLOWS} SELECT DISTINCT dataset, fine FROM f WHERE split = 'train' AND (dataset, fine) NOT IN (SELECT (dataset, fine) FROM f WHERE split = 'val')")
def jn12(spark, d):
    """Strata of train that val lacks, per dataset."""
    f = flows(spark, d).select("dataset", "fine", "split")
    return f.where("split = 'train'").select("dataset", "fine").distinct().join(f.where("split = 'val'"), ["dataset", "fine"], "left_anti")


@book("jn14_holdout_thresholds", f"WITH {FLOWS}, c AS (SELECT family, count_if(split = 'test') AS n FROM f WHERE family NOT IN ('', 'Benign') GROUP BY ALL) SELECT family, t AS threshold, n >= t AS eligible FROM c, (SELECT unnest([50, 100, 200, 500]) AS t)")
def jn14(spark, d):
    c = flows(spark, d).where("family NOT IN ('', 'Benign')").groupBy("family").agg(F.count_if(F.col("split") == "test").alias("n"))
    return c.select("family", "n", F.explode(F.array(*[F.lit(t) for t in (50, 100, 200, 500)])).alias("threshold")).select("family", "threshold", (F.col("n") >= F.col("threshold")).alias("eligible"))


@book("jn15_run_plan", "SELECT DISTINCT dataset, holdout_family, m AS model, mode FROM scenario_audits, (SELECT unnest(['rf', 'xgb']) AS m), (SELECT unnest(['strict', 'cascade']) AS mode) WHERE scenario_valid")
def jn15(spark, d):
    cases = table(spark, d, "scenario_audits").where("scenario_valid").select("dataset", "holdout_family").distinct()
    choice = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    return cases.select("*", choice(["rf", "xgb"]).alias("model")).select("*", choice(["strict", "cascade"]).alias("mode"))


@book(
    "jn16_pareto",
    f"WITH {RUNS}, r AS (SELECT run_id || '/' || dataset AS id, * FROM m) SELECT id, NOT EXISTS (SELECT 1 FROM r o WHERE o.dataset = r.dataset AND o.accuracy >= r.accuracy - 1e-12 AND o.reject_rate <= r.reject_rate + 1e-12 AND (o.accuracy > r.accuracy + 1e-12 OR o.reject_rate < r.reject_rate - 1e-12)) AS on_front FROM r",
)
def jn16(spark, d):
    r = runs(spark, d).withColumn("id", F.concat_ws("/", "run_id", "dataset"))
    return P.pareto(r, "id", ["dataset"], ["accuracy"], ["reject_rate"]).select("id", "on_front")


@book("jn17_pairwise_overlap", f"WITH {FLOWS}, h AS (SELECT DISTINCT dataset, {_H} AS h FROM f) SELECT a.dataset AS dataset_a, b.dataset AS dataset_b, count(*) AS n_common FROM h a JOIN h b USING (h) WHERE a.dataset < b.dataset GROUP BY ALL")
def jn17(spark, d):
    h = flows(spark, d).select("dataset", row_hash().alias("h")).distinct()
    other = h.select(F.col("dataset").alias("dataset_b"), "h")
    return h.join(other, "h").where("dataset < dataset_b").groupBy(F.col("dataset").alias("dataset_a"), "dataset_b").agg(F.count(F.lit(1)).alias("n_common"))


@book("jn18_adjacency", "WITH u AS (SELECT *, lead(row_start) OVER (PARTITION BY source_file_name ORDER BY row_start, unit_no) AS nx FROM plan_units) SELECT unit_no, nx - row_end AS gap FROM u WHERE nx IS NOT NULL AND nx <> row_end")
def jn18(spark, d):
    nx = F.lead("row_start").over(Window.partitionBy("source_file_name").orderBy("row_start", "unit_no"))
    return table(spark, d, "plan_units").withColumn("nx", nx).where("nx IS NOT NULL AND nx <> row_end").select("unit_no", (F.col("nx") - F.col("row_end")).alias("gap"))


_SENS = f"{FLOWS}, c AS (SELECT dataset, family, count_if(split = 'val') AS v, count_if(split = 'test') AS t FROM f WHERE family NOT IN ('', 'Benign') GROUP BY ALL), e AS (SELECT dataset, thr AS threshold, family, v >= thr AND t >= thr AS ok FROM c, (SELECT unnest([1, 2, 5, 10, 20, 50]) AS thr))"


def sensitivity(spark, d):
    c = flows(spark, d).where("family NOT IN ('', 'Benign')").groupBy("dataset", "family").agg(F.count_if(F.col("split") == "val").alias("v"), F.count_if(F.col("split") == "test").alias("t"))
    e = c.select("*", F.explode(F.array(*[F.lit(x) for x in (1, 2, 5, 10, 20, 50)])).alias("threshold"))
    return e.withColumn("ok", (F.col("v") >= F.col("threshold")) & (F.col("t") >= F.col("threshold")))


@book("agg29_sensitivity_summary", f"WITH {_SENS} SELECT dataset, threshold, count(*) AS n, count_if(ok) AS n_valid, bool_and(ok) AS all_eligible FROM e GROUP BY ALL")
def agg29(spark, d):
    return sensitivity(spark, d).groupBy("dataset", "threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_valid"), F.every("ok").alias("all_eligible"))


@book("agg30_selected_threshold", f"WITH {_SENS}, g AS (SELECT threshold, bool_and(ok) AS ok FROM e GROUP BY 1) SELECT max(threshold) FILTER (WHERE ok) AS selected FROM g")
def agg30(spark, d):
    per = sensitivity(spark, d).groupBy("threshold").agg(F.every("ok").alias("ok"))
    return per.agg(F.max(F.when(F.col("ok"), F.col("threshold"))).alias("selected"))


QUERIES, SQL = book.queries, book.sql

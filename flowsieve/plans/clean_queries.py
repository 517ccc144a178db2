"""Sources, sinks, cleaning and scalar functions (SRC, SNK, PRJ-01 to 13 and 26 to 30, STR, HSH, MTH, ARR, MAP, JSN, CST, CND)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsieve import scratch
from flowsieve.functions import arrays as A
from flowsieve.functions import labels as L
from flowsieve.functions import numbers as N
from flowsieve.functions import text as T
from flowsieve.operators import splitting as S
from flowsieve.operators.line_loader import WELL_FORMED
from flowsieve.plans.base import DECIDED, FLOWS, LABELS, SCORES, Book, decided, flows, scores
from flowsieve.plans.data_queries import _F
from flowsieve.sources import files as I
from flowsieve.tables import table

book = Book()
R = lambda c, n=6: F.round(c, n)
_PATHS = "p AS (SELECT file_no, feed_id, file_path, regexp_extract(file_path, '[^/\\\\]+$') AS name FROM capture_files)"


@book("src01_list_files", f"WITH {_PATHS} SELECT file_no, file_path FROM p WHERE name LIKE '%.csv' AND lower(name) NOT LIKE '%night%'")
def src01(spark, d):
    files = table(spark, d, "capture_files").where(I.base_name(F.col("file_path")).endswith(".csv"))
    return I.without_words(files, "file_path", ["NIGHT"]).select("file_no", "file_path").orderBy("file_path")


@book("src02_patterns", f"WITH {_PATHS} SELECT file_path, min(CASE WHEN name LIKE '%mix%.csv' THEN 0 WHEN name LIKE 'feed000001%' THEN 1 WHEN name LIKE '%day%' THEN 2 END)::INT AS pattern_no FROM p WHERE name LIKE '%mix%.csv' OR name LIKE 'feed000001%' OR name LIKE '%day%' GROUP BY file_path")
def src02(spark, d):
    return I.by_patterns(table(spark, d, "capture_files"), "file_path", ["*mix*.csv", "feed000001*", "*day*"]).select("file_path", "pattern_no")


@book("src03_csv_records", f"WITH l AS (SELECT line_id, regexp_extract_all(',' || line_text, ',({_F})', 1) AS f FROM raw_lines WHERE regexp_full_match(line_text, '{_F}(?:,{_F})*')), c AS (SELECT line_id, list_transform(f, lambda x: trim(CASE WHEN x[1] = '\"' THEN replace(x[2:-2], '\"\"', '\"') ELSE x END)) AS f FROM l WHERE len(f) = 43) SELECT line_id, f[2] AS protocol_type, f[5] AS src_bytes FROM c")
def src03(spark, d):
    """All well-formed records of 43 fields, quoted and padded ones included."""
    names = ", ".join(f"c{i} string" for i in range(43))
    formed = F.col("line_text").rlike(WELL_FORMED) & (F.regexp_count(F.concat(F.lit(","), "line_text"), F.lit(f",{_F}")) == 43)
    parsed = I.csv_columns(F.col("line_text"), names)
    return table(spark, d, "raw_lines").where(formed).select("line_id", parsed.alias("r")).select("line_id", F.coalesce("r.c1", F.lit("")).alias("protocol_type"), F.coalesce("r.c4", F.lit("")).alias("src_bytes"))


@book("src04_row_range", "SELECT file_name, line_no, line_id FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY line_no, line_id) AS rn FROM raw_lines) WHERE rn > 100 AND rn <= 150")
def src04(spark, d):
    rows = table(spark, d, "raw_lines").withColumn("o", F.struct("line_no", "line_id"))
    return I.row_range(rows, "file_name", "o", 100, 50).select("file_name", "line_no", "line_id")


@book("src05_row_counts", "SELECT file_name, count(*) AS n FROM raw_lines GROUP BY file_name")
def src05(spark, d):
    return table(spark, d, "raw_lines").groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


@book("src06_label_column", "SELECT column_name, lower(trim(column_name)) IN ('label', 'class', 'target', 'attack_cat') AS is_label FROM raw_schema")
def src06(spark, d):
    """Header probe: which column holds the label."""
    return table(spark, d, "raw_schema").select("column_name", T.canonical(F.col("column_name")).isin("label", "class", "target", "attack_cat").alias("is_label"))


@book("src07_split_parts", f"WITH {FLOWS} SELECT dataset, count(*) AS n, min(row_id) AS first_row FROM f WHERE split = 'test' GROUP BY dataset")
def src07(spark, d):
    return flows(spark, d).where("split = 'test'").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


@book("src08_projection", f"WITH {FLOWS} SELECT row_id, fwd_bytes, family FROM f WHERE split = 'val'")
def src08(spark, d):
    return flows(spark, d).where("split = 'val'").select("row_id", "fwd_bytes", "family")


@book("src09_unit_window", f"WITH {FLOWS} SELECT unit_no, row_id FROM (SELECT *, row_number() OVER (PARTITION BY unit_no ORDER BY md5(row_id::VARCHAR), row_id) AS rn FROM f WHERE unit_no BETWEEN 10 AND 40) WHERE rn <= 5")
def src09(spark, d):
    """A window of units with a sample of 5 rows each, by hash order."""
    rank = F.row_number().over(Window.partitionBy("unit_no").orderBy(F.md5(F.col("row_id").cast("string")), "row_id"))
    return flows(spark, d).where("unit_no BETWEEN 10 AND 40").withColumn("rn", rank).where("rn <= 5").select("unit_no", "row_id")


@book("src10_feature_dictionary", "SELECT c.column_name, f.field_type FROM raw_schema c LEFT JOIN (SELECT field_name, field_type FROM field_catalog) f ON lower(c.column_name) = f.field_name")
def src10(spark, d):
    features = table(spark, d, "field_catalog").select(T.canonical(F.col("field_name")).alias("k"), "field_type")
    return table(spark, d, "raw_schema").withColumn("k", T.canonical(F.col("column_name"))).join(features, "k", "left").select("column_name", "field_type")


@book("src12_canonical_json", "SELECT candidate_no, '{\"dataset\":\"' || dataset || '\",\"feed_id\":\"' || feed_id || '\",\"score\":' || score || '}' AS evidence FROM candidate_splits")
def src12(spark, d):
    return table(spark, d, "candidate_splits").select("candidate_no", I.canonical_json(["score", "feed_id", "dataset"]).alias("evidence"))


@book("src13_tolerant_json", "SELECT file_no, rec_no, max(coalesce(json_extract_string(payload, '$.label'), json_extract_string(payload, '$.\"Label\"'))) AS label FROM capture_records GROUP BY ALL")
def src13(spark, d):
    label = F.coalesce(F.get_json_object("payload", "$.label"), F.get_json_object("payload", "$.Label"))
    return table(spark, d, "capture_records").groupBy("file_no", "rec_no").agg(F.max(label).alias("label"))


@book("src14_run_crawl", f"WITH {_PATHS} SELECT file_no, regexp_extract(name, '_(\\d{{8}})_', 1) AS day, regexp_extract(name, '_(\\d{{3}})', 1) AS part, regexp_extract(name, 'feed\\d+_([a-z]+)_', 1) AS kind FROM p")
def src14(spark, d):
    name = I.base_name(F.col("file_path"))
    take = lambda p: F.regexp_extract(name, p, 1)
    return table(spark, d, "capture_files").select("file_no", take(r"_(\d{8})_").alias("day"), take(r"_(\d{3})").alias("part"), take(r"feed\d+_([a-z]+)_").alias("kind"))


@book("src15_run_ids", "SELECT DISTINCT run_id, regexp_extract(run_id, 'run-(\\d+)-', 1)::INT AS run_no, regexp_extract(run_id, '-([a-z]+)$', 1) AS model, CASE WHEN run_id LIKE '%-rf' OR run_id LIKE '%-extra' THEN 'forest' ELSE 'boosting' END AS surface FROM score_frame")
def src15(spark, d):
    r = F.col("run_id")
    return table(spark, d, "score_frame").select("run_id").distinct().select(
        "run_id", F.regexp_extract(r, r"run-(\d+)-", 1).cast("int").alias("run_no"), F.regexp_extract(r, "-([a-z]+)$", 1).alias("model"), F.when(r.endswith("-rf") | r.endswith("-extra"), "forest").otherwise("boosting").alias("surface")
    )


@book("src16_missing_file", "SELECT NULL::VARCHAR AS dataset, NULL::DOUBLE AS value WHERE false")
def src16(spark, d):
    return I.read_or_empty(spark, f"{d}/no_such_table.parquet", "dataset string, value double")


@book("src17_constants", "SELECT * FROM (VALUES ('protocol_a', 'closed set', 1), ('protocol_b', 'open set', 2)) t(lane, description, ord)")
def src17(spark, d):
    return spark.createDataFrame([("protocol_a", "closed set", 1), ("protocol_b", "open set", 2)], "lane string, description string, ord int")


@book("src18_run_record", f"WITH {DECIDED} SELECT run_id, any_value(model_name) AS model, any_value(run_seed) AS seed, count(DISTINCT dataset) AS n_datasets, count(*) AS n_rows FROM d WHERE model_name IN ('rf', 'xgb') GROUP BY run_id")
def src18(spark, d):
    rows = decided(spark, d).where(F.col("model_name").isin("rf", "xgb"))
    return rows.groupBy("run_id").agg(F.any_value("model_name").alias("model"), F.any_value("run_seed").alias("seed"), F.count_distinct("dataset").alias("n_datasets"), F.count(F.lit(1)).alias("n_rows"))


def _place(spark) -> str:
    return f"{scratch.shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@book("snk01_partitioned_parts", f"WITH {FLOWS} SELECT split, count(*) AS n, sum(row_id)::BIGINT AS ids FROM f WHERE split = 'test' GROUP BY split")
def snk01(spark, d):
    """Part files by split, read back with partition pruning."""
    at = _place(spark)
    I.write_parts(flows(spark, d).select("split", "dataset", "row_id", "family"), at, ["split"])
    return spark.read.parquet(at).where("split = 'test'").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


@book("snk02_csv_result", f"WITH {FLOWS} SELECT dataset, family, count(*) AS n FROM f GROUP BY ALL")
def snk02(spark, d):
    at = _place(spark)
    I.write_csv(flows(spark, d).groupBy("dataset", "family").agg(F.count(F.lit(1)).alias("n")), at, ["dataset", "family"])
    return spark.read.schema("dataset string, family string, n long").option("header", True).csv(at).na.fill({"family": ""})


@book("snk03_json_manifest", "SELECT candidate_no, dataset, is_valid FROM candidate_splits")
def snk03(spark, d):
    at = _place(spark)
    I.write_json(table(spark, d, "candidate_splits").select("candidate_no", "dataset", "is_valid"), at)
    return spark.read.schema("candidate_no long, dataset string, is_valid boolean").json(at)


@book("snk05_score_archive", f"WITH {SCORES} SELECT split, count(*) AS n, round(sum(pmax), 4) AS mass FROM s GROUP BY split")
def snk05(spark, d):
    at = _place(spark)
    I.write_parts(scores(spark, d).select("split", "score_id", "pmax"), at, ["split"])
    return spark.read.parquet(at).groupBy("split").agg(F.count(F.lit(1)).alias("n"), R(F.sum("pmax"), 4).alias("mass"))


@book("snk06_manifest", "SELECT doc_id, strlen(text) AS n_bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def snk06(spark, d):
    return I.manifest(table(spark, d, "documents").where(F.col("text").isNotNull()), "doc_id", "text")


_SCAN = {"sensor": r"s-\d{4}", "clock": r"\d\d:\d\d", "markup": "<[a-z]+>", "dataset": "CoastIDS|MillNet|QuarryNB|OrchardIoT"}


@book("snk07_content_scan", " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS n_texts FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for c, p in _SCAN.items()))
def snk07(spark, d):
    return I.findings(table(spark, d, "documents"), "doc_id", "text", _SCAN)


_CANON = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_')"


@book("prj01_canonical", f"SELECT DISTINCT label, {_CANON.format('label')} AS canonical FROM flows WHERE label IS NOT NULL")
def prj01(spark, d):
    return table(spark, d, "flows").select("label").where("label IS NOT NULL").distinct().select("label", T.canonical(F.col("label")).alias("canonical"))


@book("prj02_spellings", "SELECT DISTINCT source, regexp_replace(trim(source), '\\s+', '_', 'g') AS b, regexp_replace(lower(trim(source)), '\\s+', '_', 'g') AS c, replace(lower(trim(source)), ' ', '_') AS d FROM documents WHERE source IS NOT NULL")
def prj02(spark, d):
    s = F.col("source")
    return table(spark, d, "documents").select("source").where("source IS NOT NULL").distinct().select("source", *[T.canonical(s, v).alias(v) for v in "bcd"])


_NAMES = "n AS (SELECT column_name AS name FROM raw_schema UNION SELECT field_name FROM field_catalog UNION SELECT unnest(known_aliases) FROM field_catalog)"


def column_names(spark, d):
    """All column names that raw lines and captures use; one row per name."""
    schema, catalog = table(spark, d, "raw_schema"), table(spark, d, "field_catalog")
    return schema.select(F.col("column_name").alias("name")).union(catalog.select("field_name")).union(catalog.select(F.explode("known_aliases"))).distinct()


_LEAK = (
    "name IN ('id', 'row_id', 'record_id', 'flow_id', 'flowid', 'flow_identifier', 'packet_id', 'session_id') OR name LIKE '%timestamp%' OR name IN ('time', 'datetime') OR regexp_matches(name, '(_time|_ts|_date)$') OR name IN ('ip', 'srcip', 'dstip') "
    "OR regexp_matches(name, '(^|_)ip($|_)|ip_dec$') OR (name LIKE '%ip%' AND regexp_matches(name, 'src|dst|source|dest|destination|local')) OR name IN ('port', 'sport', 'dsport', 'srcport', 'dstport') OR regexp_matches(name, '(^|_)port($|_)') OR (name LIKE '%port%' AND regexp_matches(name, 'src|dst|source|dest|destination|local'))"
)


@book("prj03_leakage_columns", f"WITH {_NAMES} SELECT name, {_LEAK} AS leaks FROM n")
def prj03(spark, d):
    return column_names(spark, d).select("name", L.leakage_column(F.col("name")).alias("leaks"))


@book("prj04_port_bucket", "SELECT p_partkey, CASE WHEN p_size * 1000 < 0 THEN 'NA' WHEN p_size * 1000 <= 1023 THEN 'well_known' WHEN p_size * 1000 <= 49151 THEN 'registered' ELSE 'ephemeral' END AS bucket, 'NA' AS of_text FROM part")
def prj04(spark, d):
    return table(spark, d, "part").select("p_partkey", N.port_bucket(F.col("p_size") * 1000).alias("bucket"), N.port_bucket(F.col("p_name")).alias("of_text"))


@book("prj05_finite", "SELECT row_id, CASE WHEN isfinite(flow_bytes_s) THEN flow_bytes_s END AS flow_bytes_s, CASE WHEN isfinite(iat_std) THEN iat_std END AS iat_std FROM flows")
def prj05(spark, d):
    return table(spark, d, "flows").select("row_id", *[N.finite(F.col(c)).alias(c) for c in ("flow_bytes_s", "iat_std")])


@book("prj06_fine_label", "SELECT row_id, trim(label) AS kept, replace(trim(label), '.', '') AS stripped FROM flows")
def prj06(spark, d):
    return table(spark, d, "flows").select("row_id", L.fine_label(F.col("label")).alias("kept"), L.fine_label(F.col("label"), True).alias("stripped"))


_KEYWORD = (
    "CASE WHEN t LIKE 'benign%' THEN 'Benign' WHEN t LIKE '%ddos%' THEN 'DDoS' WHEN t LIKE '%dos%' THEN 'DoS' WHEN t LIKE '%botnet%' OR t LIKE '%mirai%' THEN 'Botnet' WHEN t LIKE '%recon%' OR t LIKE '%scan%' OR t LIKE '%port%' THEN 'Scan/Recon' "
    "WHEN t LIKE '%brute%' OR t LIKE '%patator%' THEN 'BruteForce' WHEN t LIKE '%web%' OR t LIKE '%http%' OR t LIKE '%xss%' OR t LIKE '%sql%' THEN 'Web/App' ELSE 'Other' END"
)
_HOST = (
    "CASE WHEN t = 'benign' THEN 'Benign' WHEN t LIKE '%ddos%' THEN 'DDoS' WHEN t LIKE '%dos%' THEN 'DoS' WHEN t LIKE '%scan%' THEN 'Scan/Recon' WHEN t LIKE '%patator%' OR t LIKE '%brute%' THEN 'BruteForce' "
    "WHEN t LIKE '%web attack%' OR t LIKE '%xss%' OR t LIKE '%sql%' THEN 'Web/App' WHEN t LIKE '%botnet%' THEN 'Botnet' ELSE 'Other' END"
)


@book("prj07_families", f"SELECT label, {_KEYWORD} AS keyword, {_HOST} AS host_flows, 'Other' AS connection_records, CASE WHEN t IN ('normal', 'benign') THEN 'Benign' WHEN t IN ('', 'nan', 'none') THEN 'Other' ELSE trim(coalesce(label, '')) END AS category, 'Other' AS no_such FROM (SELECT DISTINCT label, lower(replace(trim(coalesce(label, '')), '.', '')) AS t FROM flows)")
def prj07(spark, d):
    label = F.col("label")
    return table(spark, d, "flows").select("label").distinct().select("label", *[L.family_of(label, t).alias(t) for t in (*L.TAXONOMIES, "no_such")])


@book("prj08_stage1", f"WITH {FLOWS} SELECT row_id, (family <> 'Benign')::INT AS y1 FROM f")
def prj08(spark, d):
    return flows(spark, d).select("row_id", L.is_attack(F.col("family")).alias("y1"))


@book("prj09_drop_families", f"WITH {FLOWS} SELECT dataset, count_if(family NOT IN ('Other', 'Web/App')) AS kept, count_if(family IN ('Other', 'Web/App')) AS dropped FROM f GROUP BY dataset")
def prj09(spark, d):
    gone = F.col("family").isin("Other", "Web/App")
    return flows(spark, d).groupBy("dataset").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("dropped"))


def cleaned(df, drop_families=("Other",), features=("flow_duration", "fwd_bytes", "bwd_bytes", "flow_bytes_s", "ttl_min")):
    """The whole cleaning pipeline: tidy labels, drop families, targets, finite features, absent features as null."""
    family = F.coalesce(F.trim("y_stage2_family"), F.lit(""))
    have = set(df.columns)
    typed = [N.finite(F.col(c).cast("double")).alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in features]
    tidy = df.withColumn("_family", family).where(~F.col("_family").isin(*drop_families))
    return tidy.select("row_id", *typed, L.is_attack(F.col("_family")).alias("y_stage1_attack"), F.col("_family").alias("y_stage2_family"), L.fine_label(F.coalesce("y_stage2_fine", F.lit("")), True).alias("y_stage2_fine"))


@book(
    "prj11_clean_pipeline",
    f"WITH {FLOWS} SELECT row_id, " + ", ".join(f"CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END AS {c}" for c in ("flow_duration", "fwd_bytes", "bwd_bytes", "flow_bytes_s")) + ", NULL::DOUBLE AS ttl_min, (family <> 'Benign')::INT AS y_stage1_attack, family AS y_stage2_family, replace(fine, '.', '') AS y_stage2_fine FROM f WHERE family <> 'Other'",
)
def prj11(spark, d):
    """PRJ-10 to PRJ-12 in one transform: label and identifier columns go, missing features come as null."""
    return table(spark, d, "flows").transform(cleaned)


@book("prj13_rare_stratum", f"WITH {FLOWS} SELECT row_id, CASE WHEN count(*) OVER (PARTITION BY fine) < 50 THEN '__RARE__' || family ELSE fine END AS stratum FROM f")
def prj13(spark, d):
    """Rare fine labels are merged per family; the counts of fine labels are a small table."""
    f = flows(spark, d)
    rare = f.groupBy("fine").agg(F.count(F.lit(1)).alias("n")).where("n < 50").select("fine", F.lit(True).alias("rare"))
    return f.join(rare, "fine", "left").select("row_id", F.when(F.col("rare"), F.concat(F.lit("__RARE__"), "family")).otherwise(F.col("fine")).alias("stratum"))


@book("prj22_eligible_rules", "SELECT candidate_no FROM candidate_splits WHERE benign_val >= 2000 AND benign_test >= 1000 AND n_eligible_holdouts >= 1")
def prj22(spark, d):
    """Conjunction of minimum rules; rules on absent columns are ignored, cells that are no numbers fail."""
    df = table(spark, d, "candidate_splits")
    for c, least in {"benign_val": 2000, "benign_test": 1000, "n_eligible_holdouts": 1, "no_such_column": 5}.items():
        if c in df.columns:
            df = df.where(F.col(c).try_cast("double") >= least)
    return df.select("candidate_no")


@book("prj24_reorder", "SELECT split, row_id, dataset FROM flows")
def prj24(spark, d):
    front = ["split", "row_id"]
    df = table(spark, d, "flows").select("dataset", "row_id", "split")
    return df.select(*front, *[c for c in df.columns if c not in front])


_SCORE = " + ".join(f"(CASE WHEN name LIKE '%{w.replace('_', '$_')}%' ESCAPE '$' THEN {s} ELSE 0 END)" for w, s in L.LEAKAGE_WORDS.items())


@book("prj26_leakage_score", f"WITH {_NAMES} SELECT name, ({_SCORE})::INT AS score FROM n WHERE {_SCORE} >= 3")
def prj26(spark, d):
    return column_names(spark, d).select("name", L.leakage_score(F.col("name")).alias("score")).where("score >= 3")


@book("prj27_label_candidates", f"WITH {_NAMES} SELECT name, regexp_matches(name, '^(label|class|target|y)$|label|attack|category|class') AS label_like, regexp_matches(name, 'time|date') AS time_like FROM n")
def prj27(spark, d):
    n = F.col("name")
    return column_names(spark, d).select("name", n.rlike("^(label|class|target|y)$|label|attack|category|class").alias("label_like"), n.rlike("time|date").alias("time_like"))


_CAND = ("label", "y_stage2_family", "y_stage2_fine", "protocol")


@book(
    "prj28_label_recommendation",
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n, avg((coalesce(trim({c}), '') = '')::INT)::DOUBLE AS garbage FROM flows" for c in _CAND) + ") SELECT name, n, round(garbage, 6) AS garbage FROM c WHERE n > 1 ORDER BY garbage >= 0.8, n, garbage, name LIMIT 1",
)
def prj28(spark, d):
    """The candidate with the fewest distinct values, then the least garbage; below 80 % garbage."""
    wide = table(spark, d, "flows").agg(F.array(*[F.struct(F.lit(c).alias("name"), F.count_distinct(c).alias("n"), F.avg((F.coalesce(F.trim(c), F.lit("")) == "").cast("int")).alias("garbage")) for c in _CAND]).alias("a"))
    return wide.select(F.inline("a")).where("n > 1").orderBy(F.col("garbage") >= 0.8, "n", "garbage", "name").limit(1).select("name", "n", R("garbage").alias("garbage"))


_KINDS = {"dataset": "string", "protocol": "string", "sensor_id": "string", "label": "string", "fwd_bytes": "number", "flow_duration": "number", "iat_std": "number"}


@book("prj29_feature_types", " UNION ALL ".join(f"SELECT '{c}' AS name, " + ("'numeric'" if k == "number" else f"CASE WHEN count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'dropped' END") + " AS kind FROM flows" + (" GROUP BY 1" if k == "number" else "") for c, k in _KINDS.items()))
def prj29(spark, d):
    """Numeric by type; strings with at most 50 values are categorical, others are dropped."""
    df = table(spark, d, "flows")
    text = [c for c, k in _KINDS.items() if k == "string"]
    counts = df.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.when(F.count_distinct(c) <= 50, "categorical").otherwise("dropped").alias("kind")) for c in text]).alias("a")).select(F.inline("a"))
    return counts.union(spark.createDataFrame([(c, "numeric") for c, t in df.dtypes if c in _KINDS and t != "string"], "name string, kind string"))


@book("prj30_path_classes", f"WITH {_PATHS} SELECT file_path, CASE WHEN name LIKE '%.gz' THEN 'archive' WHEN name LIKE '%\\_plus.%' ESCAPE '\\' THEN 'export' WHEN name LIKE '%lab%' THEN 'laboratory' WHEN name LIKE '%.csv' THEN 'capture' ELSE 'other' END AS category FROM p")
def prj30(spark, d):
    n = I.base_name(F.col("file_path"))
    category = F.when(n.endswith(".gz"), "archive").when(n.contains("_plus."), "export").when(n.contains("lab"), "laboratory").when(n.endswith(".csv"), "capture").otherwise("other")
    return table(spark, d, "capture_files").select("file_path", category.alias("category"))


# strings, hashes, JSON

@book("str02_sanitized", "SELECT DISTINCT y_stage2_family AS family, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(y_stage2_family), '[\\\\/:*?\"<>|\\s]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'NA') AS token FROM flows")
def str02(spark, d):
    return table(spark, d, "flows").select(F.col("y_stage2_family").alias("family")).distinct().select("family", T.sanitized(F.col("family")).alias("token"))


@book("str03_normal_case", "SELECT DISTINCT label, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS token FROM flows")
def str03(spark, d):
    return table(spark, d, "flows").select("label").distinct().select("label", T.alnum(F.col("label")).alias("token"))


@book("str04_run_names", "SELECT DISTINCT run_id, dataset || '__holdout_' || replace(holdout_family, '/', '_') || '__seed_' || run_seed AS run_name FROM score_frame")
def str04(spark, d):
    name = F.concat_ws("__", "dataset", F.concat(F.lit("holdout_"), F.replace("holdout_family", F.lit("/"), F.lit("_"))), F.concat(F.lit("seed_"), "run_seed"))
    return table(spark, d, "score_frame").select("run_id", name.alias("run_name")).distinct()


@book("str05_joined_lists", f"WITH {FLOWS} SELECT dataset, array_to_string(list_sort(list(DISTINCT family)), '|') AS families FROM f WHERE family <> '' GROUP BY dataset")
def str05(spark, d):
    return flows(spark, d).where("family <> ''").groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_set("family")), "|").alias("families"))


@book("str06_shown_numbers", "SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN format('{:,}', round_even(o_totalprice, 0)::BIGINT) ELSE printf('%.4f', o_totalprice) END AS shown FROM orders")
def str06(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.shown(F.col("o_totalprice")).alias("shown"))


@book("str07_base_feature", "SELECT DISTINCT protocol, 'protocol=' || protocol AS feature, 'protocol' AS base FROM flows WHERE protocol IS NOT NULL")
def str07(spark, d):
    f = table(spark, d, "flows").where("protocol IS NOT NULL").select("protocol").distinct().withColumn("feature", F.concat(F.lit("protocol="), "protocol"))
    return f.withColumn("base", T.base_feature(F.col("feature")))


@book("str08_unit_parts", "SELECT unit_no, CASE WHEN regexp_matches(unit_id, 'part(\\d+)of(\\d+)') THEN regexp_extract(unit_id, 'part(\\d+)of', 1)::INT ELSE 1 END AS part, CASE WHEN regexp_matches(unit_id, 'part(\\d+)of(\\d+)') THEN regexp_extract(unit_id, 'of(\\d+)', 1)::INT ELSE 1 END AS parts FROM plan_units")
def str08(spark, d):
    return table(spark, d, "plan_units").select("unit_no", T.part_of(F.col("unit_id")).alias("p")).select("unit_no", "p.*")


@book("str09_notes", f"WITH {DECIDED} SELECT holdout_family, CASE WHEN avg((pred = 'Unknown')::INT) >= 0.5 THEN 'mostly rejected: ' ELSE 'mostly absorbed: ' END || count(*) || ' rows' AS note FROM d WHERE truth = 'Unknown' GROUP BY holdout_family")
def str09(spark, d):
    u = decided(spark, d).where("truth = 'Unknown'").groupBy("holdout_family").agg(F.avg((F.col("pred") == "Unknown").cast("int")).alias("r"), F.count(F.lit(1)).alias("n"))
    return u.select("holdout_family", F.when(F.col("r") >= 0.5, F.format_string("mostly rejected: %d rows", "n")).otherwise(F.format_string("mostly absorbed: %d rows", "n")).alias("note"))


@book("hsh01_short_hash", "SELECT candidate_no, substr(sha1('{\"dataset\":\"' || dataset || '\",\"score\":' || score || '}'), 1, 12) AS h FROM candidate_splits")
def hsh01(spark, d):
    return table(spark, d, "candidate_splits").select("candidate_no", T.short_hash(I.canonical_json(["score", "dataset"])).alias("h"))


@book("hsh02_evidence_id", "SELECT DISTINCT run_id, substr(sha256(run_id || '|' || model_name), 1, 24) AS evidence_id FROM score_frame")
def hsh02(spark, d):
    key = F.concat_ws("|", "run_id", "model_name")
    return table(spark, d, "score_frame").select("run_id", T.short_hash(key, 24, "sha256").alias("evidence_id")).distinct()


@book("hsh03_row_hash")
def hsh03(spark, d):
    """64-bit row hashes of the features: counts of rows per hash (no SQL counterpart of the hash function)."""
    cols = ["flow_duration", "fwd_bytes", "bwd_bytes", "iat_mean"]
    return table(spark, d, "flows").groupBy(F.xxhash64(*cols).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# numbers

@book("mth01_sigmoid_logit", f"WITH {SCORES} SELECT score_id, round(ln(greatest(1e-12, least(1 - 1e-12, p)) / (1 - greatest(1e-12, least(1 - 1e-12, p)))), 5) AS logit, round(1 / (1 + exp(-greatest(-60, least(60, margin * 4 - 2)))), 6) AS sigmoid FROM s")
def mth01(spark, d):
    return scores(spark, d).select("score_id", R(N.logit(F.col("p")), 5).alias("logit"), R(N.sigmoid(F.col("margin") * 4 - 2)).alias("sigmoid"))


@book("mth02_platt", f"WITH {SCORES} SELECT score_id, round(1 / (1 + exp(-greatest(-60, least(60, 0.8 * ln(greatest(1e-12, least(1 - 1e-12, p)) / (1 - greatest(1e-12, least(1 - 1e-12, p)))) + 0.1)))), 6) AS q FROM s")
def mth02(spark, d):
    return scores(spark, d).select("score_id", R(N.platt(F.col("p"), 0.8, 0.1)).alias("q"))


@book(
    "mth04_wilson",
    f"WITH {DECIDED}, c AS (SELECT run_id, count_if(truth = pred)::DOUBLE AS k, count(*)::DOUBLE AS n FROM d GROUP BY run_id), z AS (SELECT *, k / n AS r, 1.959963984540054 AS z FROM c) "
    "SELECT run_id, round(greatest(0, (r + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1, (r + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high, round(z * sqrt(0.25 / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS worst FROM z",
)
def mth04(spark, d):
    c = decided(spark, d).groupBy("run_id").agg(F.count_if(F.col("truth") == F.col("pred")).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = N.wilson(F.col("k"), F.col("n"))
    return c.select("run_id", R(low).alias("low"), R(high).alias("high"), R(N.worst_half_width(F.col("n"))).alias("worst"))


@book("mth05_rank_score", f"WITH {DECIDED}, m AS (SELECT run_id, avg((truth = pred)::INT) AS acc, count_if(truth = 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth = 'Unknown'), 0) AS udr, avg((pred = 'Unknown')::INT) AS rej FROM d GROUP BY run_id) SELECT run_id, round(3.0 * coalesce(udr, 0) + 2.0 * coalesce(acc, 0) - 1.0 * coalesce(rej, 1), 6) AS rank_score FROM m")
def mth05(spark, d):
    from flowsieve.operators.metrics import system_columns

    m = system_columns()
    runs = decided(spark, d).groupBy("run_id").agg(m["accuracy"].alias("acc"), m["unknown_detection_rate"].alias("udr"), m["overall_reject_rate"].alias("rej"))
    return runs.select("run_id", R(N.rank_score({"udr": 3.0, "acc": 2.0}, {"rej": 1.0})).alias("rank_score"))


@book("mth06_candidate_score", "SELECT candidate_no, (CASE WHEN is_valid THEN 1000000000000 ELSE 0 END + n_eligible_holdouts::BIGINT * 100000000 + n_overlap_known::BIGINT * 1000000 + coalesce(benign_val, 0) + coalesce(benign_test, 0) - greatest(0, 2000 - coalesce(benign_val, 0)) * 10000)::BIGINT AS candidate_score FROM candidate_splits")
def mth06(spark, d):
    """Validity first, then holdouts, known families, benign mass, less the shortfall; integers throughout."""
    big = lambda c, w: F.coalesce(F.col(c).cast("long"), F.lit(0)) * w
    score = F.when(F.col("is_valid"), 10**12).otherwise(0) + big("n_eligible_holdouts", 10**8) + big("n_overlap_known", 10**6) + big("benign_val", 1) + big("benign_test", 1)
    short = F.greatest(F.lit(0), 2000 - F.coalesce("benign_val", F.lit(0))) * 10**4
    return table(spark, d, "candidate_splits").select("candidate_no", (score - short).cast("long").alias("candidate_score"))


_QUOTA = (
    "q0 AS (SELECT fine, count(*) AS n FROM f GROUP BY fine), q1 AS (SELECT fine, n, 1 + round_even(0.7::DOUBLE * (n - 3), 0)::BIGINT AS t, 1 + round_even(0.15::DOUBLE * (n - 3), 0)::BIGINT AS v FROM q0), "
    "q2 AS (SELECT *, greatest(0, 1 - (n - t - v)) AS need FROM q1), q AS (SELECT fine, n, CASE WHEN n < 3 THEN n ELSE t - least(need, t - 1) END AS n_train, CASE WHEN n < 3 THEN 0 ELSE v - least(need - least(need, t - 1), v - 1) END AS n_val FROM q2)"
)


@book("mth07_quotas", f"WITH {FLOWS}, {_QUOTA} SELECT fine, n, n_train, n_val, n - n_train - n_val AS n_test FROM q")
def mth07(spark, d):
    return S.quotas(flows(spark, d).groupBy("fine").agg(F.count(F.lit(1)).alias("n")), "n")


@book(
    "mth08_cap_allocation",
    f"WITH {FLOWS}, c AS (SELECT fine, split, count(*) AS n FROM f GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY fine) AS total, floor(200 * n / sum(n) OVER (PARTITION BY fine)) AS base, 200 * n / sum(n) OVER (PARTITION BY fine) - floor(200 * n / sum(n) OVER (PARTITION BY fine)) AS rest FROM c), "
    "b AS (SELECT *, 200 - sum(base) OVER (PARTITION BY fine) AS l, row_number() OVER (PARTITION BY fine ORDER BY rest DESC, n DESC, split) AS k FROM a) SELECT fine, split, n, CASE WHEN total <= 200 THEN n ELSE least(n, base + (k <= l)::INT) END::BIGINT AS quota FROM b",
)
def mth08(spark, d):
    c = flows(spark, d).groupBy("fine", "split").agg(F.count(F.lit(1)).alias("n"))
    return S.largest_remainder(c, "fine", "split", "n", 200)


@book("mth09_split_counts")
def mth09(spark, d):
    """Whole numbers of units per split around the target shares, closest first; enumerated on the driver from counts."""
    shares = {"train": 0.70, "val": 0.15, "test": 0.15}
    rows = []
    for r in table(spark, d, "plan_units").groupBy(F.substring_index("source_file_name", "_", 1).alias("feed")).agg(F.count(F.lit(1)).alias("n")).collect():  # one row per feed
        want = {s: r.n * x for s, x in shares.items()}
        base_v, base_t = round(want["val"]), round(want["test"])
        options = {(max(1, base_v + i), max(1, base_t + j)) for i in (-1, 0, 1) for j in (-1, 0, 1)}
        for v, t in options:
            if r.n - v - t >= 1:
                rows.append((r.feed, r.n - v - t, v, t, float(abs(r.n - v - t - want["train"]) + abs(v - want["val"]) + abs(t - want["test"]))))
    return spark.createDataFrame(sorted(rows, key=lambda x: (x[0], x[4], x)), "feed string, n_train long, n_val long, n_test long, distance double")


# arrays of probabilities, made from embeddings

_PROBS = (
    "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings), x AS (SELECT vec_id, label, list_transform(z, lambda v: exp(v - list_max(z))) AS w FROM e), "
    "pr AS (SELECT vec_id, label, list_transform(w, lambda v: v / list_sum(w)) AS q FROM x)"
)


def probs(spark, d):
    z = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", A.softmax(z).alias("q"))


@book("arr01_max_softmax", f"WITH {_PROBS} SELECT vec_id, round(list_max(q), 6) AS pmax, (list_position(q, list_max(q)) - 1)::INT AS idx FROM pr")
def arr01(spark, d):
    return probs(spark, d).select("vec_id", R(F.array_max("q")).alias("pmax"), A.argmax(F.col("q")).alias("idx"))


@book("arr02_margin", f"WITH {_PROBS} SELECT vec_id, round(list_reverse_sort(q)[1] - list_reverse_sort(q)[2], 6) AS margin FROM pr")
def arr02(spark, d):
    return probs(spark, d).select("vec_id", R(A.top2_margin(F.col("q"))).alias("margin"))


@book("arr03_entropy", f"WITH {_PROBS} SELECT vec_id, round(-list_sum(list_transform(q, lambda v: v * ln(greatest(v, 1e-12)))) / ln(64), 6) AS entropy FROM pr")
def arr03(spark, d):
    return probs(spark, d).select("vec_id", R(A.entropy(F.col("q"))).alias("entropy"))


@book("arr04_renormalised", f"WITH {_PROBS}, c AS (SELECT vec_id, list_transform(q, lambda v: greatest(v, 0.02)) AS c FROM pr) SELECT vec_id, round(c[1] / list_sum(c), 6) AS first, round(c[-1] / list_sum(c), 6) AS last FROM c")
def arr04(spark, d):
    q = A.normalised(F.col("q"), 0.02)
    return probs(spark, d).select("vec_id", q.alias("q")).select("vec_id", R(F.get("q", F.lit(0))).alias("first"), R(F.element_at("q", -1)).alias("last"))


@book("arr05_biased", f"WITH {_PROBS}, c AS (SELECT vec_id, list_transform(q, lambda v, i: v * (0.5 + i % 4 * 0.5)) AS c FROM pr) SELECT vec_id, round(list_max(c) / list_sum(c), 6) AS pmax, (list_position(c, list_max(c)) - 1)::INT AS idx FROM c")
def arr05(spark, d):
    b = probs(spark, d).select("vec_id", A.biased(F.col("q"), [0.5 + i % 4 * 0.5 for i in range(1, 65)]).alias("b"))
    return b.select("vec_id", R(F.array_max("b")).alias("pmax"), A.argmax(F.col("b")).alias("idx"))


@book("arr06_true_class", f"WITH {_PROBS} SELECT vec_id, round(q[label + 1], 6) AS p_true, round(list_sum(list_transform(q, lambda v: v * v)) + 1 - 2 * q[label + 1], 6) AS brier FROM pr")
def arr06(spark, d):
    k = F.col("label")
    return probs(spark, d).select("vec_id", R(F.get("q", k)).alias("p_true"), R(A.known_brier(F.col("q"), k)).alias("brier"))


_LAB = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


@book(
    "arr07_matrix",
    f"WITH {DECIDED}, n AS (SELECT run_id, truth, pred, count(*) AS n FROM d GROUP BY ALL) SELECT run_id, label, coalesce(sum(n) FILTER (WHERE truth = label AND pred = label), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (WHERE truth <> label AND pred = label), 0)::BIGINT AS fp, coalesce(sum(n) FILTER (WHERE truth = label AND pred <> label), 0)::BIGINT AS fn FROM n, (SELECT unnest({_LAB}) AS label) GROUP BY ALL",
)
def arr07(spark, d):
    """Each run's confusion matrix as a nested array, and per-label counts from the array alone."""
    k = len(LABELS)
    at = lambda c: F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col(c)) - 1
    cells = decided(spark, d).groupBy("run_id", (at("truth") * k + at("pred")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    held = cells.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))  # at most k * k cells
    row = lambda i: F.array(*[F.coalesce(F.try_element_at("m", F.lit(i * k + j).cast("long")), F.lit(0).cast("long")) for j in range(k)])
    nested = held.select("run_id", F.array(*[row(i) for i in range(k)]).alias("m"))
    each = nested.select("run_id", "m", F.posexplode(F.array(*[F.lit(x) for x in LABELS])).alias("i", "label"))
    whole = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    tp = F.get(F.get("m", F.col("i")), F.col("i"))
    column = F.transform("m", lambda r: F.get(r, F.col("i")))
    return each.select("run_id", "label", tp.alias("tp"), (whole(column) - tp).alias("fp"), (whole(F.get("m", F.col("i"))) - tp).alias("fn"))


@book("mth03_temperature", f"WITH {_PROBS}, l AS (SELECT vec_id, list_transform(q, lambda v: ln(greatest(v, 1e-12)) / 2.0) AS l FROM pr), w AS (SELECT vec_id, list_transform(l, lambda v: exp(v - list_max(l))) AS w FROM l) SELECT vec_id, round(list_max(w) / list_sum(w), 6) AS pmax FROM w")
def mth03(spark, d):
    return probs(spark, d).select("vec_id", R(F.array_max(A.tempered(F.col("q"), 2.0))).alias("pmax"))


@book("map01_lookup", f"WITH {SCORES} SELECT score_id, CASE pred_fam WHEN 'DDoS' THEN 0.4 WHEN 'DoS' THEN 0.5 ELSE 0.3 END::DOUBLE AS threshold FROM s")
def map01(spark, d):
    lookup = F.create_map(*[F.lit(x) for kv in {"DDoS": 0.4, "DoS": 0.5}.items() for x in kv])
    return scores(spark, d).select("score_id", F.coalesce(F.try_element_at(lookup, F.col("pred_fam")), F.lit(0.3)).alias("threshold"))


@book("jsn01_params", "SELECT event_id, (props->>'k')::INT AS k, '{\"k\":' || (props->>'k') || '}' AS again FROM events")
def jsn01(spark, d):
    parsed = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return parsed.select("event_id", "p.k", F.to_json("p").alias("again"))


@book("dte01_stamps", "SELECT score_id, strftime(scored_at, '%Y%m%d_%H%M%S') AS stamp, round(date_diff('microsecond', scored_at, loaded_at) / 3600000000.0, 9) AS hours FROM score_frame")
def dte01(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, scored_at, loaded_at)")
    return table(spark, d, "score_frame").select("score_id", F.date_format("scored_at", "yyyyMMdd_HHmmss").alias("stamp"), R(us / 3600000000.0, 9).alias("hours"))


@book("cst01_coerced", "SELECT line_id, CASE WHEN regexp_full_match(trim(split_part(line_text, ',', 5)), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim(split_part(line_text, ',', 5)) AS DOUBLE) END AS v FROM raw_lines")
def cst01(spark, d):
    field = F.split_part("line_text", F.lit(","), F.lit(5))
    """Every line: what is no number becomes null."""
    return table(spark, d, "raw_lines").select("line_id", N.numeric(field).alias("v"))


@book(
    "cnd01_case_labels",
    f"WITH {DECIDED}, m AS (SELECT run_id, count_if(truth = 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth = 'Unknown'), 0) AS u, count_if(truth <> 'Unknown' AND pred = 'Unknown') / nullif(count_if(truth <> 'Unknown'), 0) AS f FROM d GROUP BY run_id) "
    "SELECT run_id, CASE WHEN u IS NULL OR f IS NULL THEN 'unknown' WHEN u >= 0.75 AND f <= 0.01 THEN 'strong case' WHEN u < 0.1 THEN 'hard failure case' ELSE 'mixed case' END AS case_label, CASE WHEN u - f IS NULL THEN 'n/a' WHEN u - f >= 0.02 THEN 'gain' WHEN u - f >= 0.005 THEN 'slight gain' WHEN u - f > -0.005 THEN 'level' WHEN u - f > -0.02 THEN 'slight loss' ELSE 'loss' END AS band FROM m",
)
def cnd01(spark, d):
    from flowsieve.operators.metrics import system_columns

    m = system_columns()
    r = decided(spark, d).groupBy("run_id").agg(m["unknown_detection_rate"].alias("u"), m["false_unknown_all_known"].alias("f"))
    return r.select("run_id", L.holdout_case(F.col("u"), F.col("f")).alias("case_label"), L.delta_band(F.col("u") - F.col("f")).alias("band"))


@book("prj10_drop_columns", "SELECT row_id, protocol, fwd_bytes, y_stage2_family FROM flows")
def prj10(spark, d):
    """Label spelling, identifiers and times go; absent names in the list are ignored."""
    gone = ["label", "sensor_id", "captured_at", "ingested_at", "no_such_column"]
    return table(spark, d, "flows").drop(*gone).select("row_id", "protocol", "fwd_bytes", "y_stage2_family")


@book("prj12_expected_features", "SELECT row_id, fwd_bytes::DOUBLE AS fwd_bytes, NULL::DOUBLE AS ttl_min FROM flows")
def prj12(spark, d):
    df = table(spark, d, "flows")
    return df.select("row_id", *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("fwd_bytes", "ttl_min")])


@book("str01_canonical_names", f"WITH {_PATHS} SELECT file_no, {_CANON.format('name')} AS canonical FROM p")
def str01(spark, d):
    return table(spark, d, "capture_files").select("file_no", T.canonical(I.base_name(F.col("file_path"))).alias("canonical"))


@book("udf01_sql_functions", f"WITH {SCORES} SELECT score_id, CASE WHEN p < 0.5 THEN 'Benign' WHEN pmax < 0.6 THEN 'Unknown' ELSE pred_fam END AS pred, CASE WHEN y1 = 0 THEN 'Benign' ELSE fam END AS truth FROM s")
def udf01(spark, d):
    """The rules as temporary SQL functions, expanded in line."""
    from flowsieve.functions import sql

    sql.register(spark)
    return scores(spark, d).selectExpr("score_id", "decide(p, pmax, pred_fam, 0.5D, 0.6D) AS pred", "closed_truth(y1, fam) AS truth")


QUERIES, SQL = book.queries, book.sql

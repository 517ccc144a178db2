"""File sources: part files, CSV and JSON lines are written to the shared folder, listed, probed and read back (SRC)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowsieve import scratch
from flowsieve.functions import text as T
from flowsieve.plans.base import DECIDED, FLOWS, LABELS, SCORES, Book, decided, flows, scores
from flowsieve.sources import files as I
from flowsieve.tables import table

book = Book()
R = lambda c, n=6: F.round(c, n)
_COLUMNS = ["row_id", "fwd_bytes", "dst_port_bucket", "Attack Label"]


def _landed(spark, d) -> str:
    """A landing folder: one CSV file with header per data set."""
    at = f"{scratch.shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    rows = flows(spark, d).select("dataset", "row_id", "fwd_bytes", "dst_port_bucket", F.col("family").alias("Attack Label"))
    rows.repartition("dataset").sortWithinPartitions("row_id").write.partitionBy("dataset").option("header", True).csv(at)
    return at


def _dataset(path):
    return F.regexp_extract(path, r"dataset=([^/]+)/", 1)


@book("src01_landing_files", "SELECT dataset, 1::BIGINT AS n_files, true AS not_empty FROM flows WHERE dataset NOT ILIKE '%mill%' GROUP BY dataset")
def src01(spark, d):
    """Files below a folder by a glob, without those whose path holds an excluded word."""
    listed = I.list_files(spark, _landed(spark, d), "*.csv").withColumn("dataset", _dataset(F.col("path")))
    kept = listed.where(~F.lower("dataset").contains("mill"))
    return kept.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_files"), (F.min("length") > 0).alias("not_empty"))


@book("src02_landing_patterns", "SELECT dataset, CASE WHEN dataset LIKE '%IDS%' THEN 0 WHEN dataset LIKE '%Net%' THEN 1 ELSE 2 END::INT AS pattern_no FROM flows GROUP BY dataset")
def src02(spark, d):
    """Several globs: each file once, under the first pattern that names it."""
    listed = I.list_files(spark, _landed(spark, d), "*.csv").select(_dataset(F.col("path")).alias("dataset"))
    return I.by_patterns(listed, "dataset", ["*IDS*", "*Net*", "*"]).select("dataset", "pattern_no")


@book("src03_landing_read", f"WITH {FLOWS} SELECT dataset, row_id, fwd_bytes, nullif(family, '') AS family FROM f")
def src03(spark, d):
    """CSV files with header as strings; only the named columns are parsed; the file tells the data set."""
    rows = I.read_csv(spark, [_landed(spark, d) + "/*"], columns=["row_id", "fwd_bytes", "`Attack Label`"])
    return rows.select(_dataset(F.col("_file")).alias("dataset"), F.col("row_id").cast("long"), F.col("fwd_bytes").cast("long"), F.col("Attack Label").alias("family"))


@book("src05_landing_counts", "SELECT dataset, count(*) AS n_rows FROM flows GROUP BY dataset")
def src05(spark, d):
    """Data rows of each file: its lines less the header."""
    lines = spark.read.text(_landed(spark, d) + "/*").select(_dataset(F.col("_metadata.file_path")).alias("dataset"))
    return lines.groupBy("dataset").agg((F.count(F.lit(1)) - 1).alias("n_rows"))


@book("src06_landing_headers", "SELECT dataset, 4 AS n_columns, 'attack_label' AS label_column FROM flows GROUP BY dataset")
def src06(spark, d):
    """Header probe of each file: the first line of its first block, canonical names, and the column that holds the label."""
    lines = spark.read.text(_landed(spark, d) + "/*").where("_metadata.file_block_start = 0")
    first = lines.select(_dataset(F.col("_metadata.file_path")).alias("dataset"), "value", F.monotonically_increasing_id().alias("at")).groupBy("dataset").agg(F.min_by("value", "at").alias("header"))
    names = F.transform(F.split("header", ","), lambda n: T.canonical(n))
    label = F.filter(names, lambda n: n.isin("label", "class", "target", "attack_cat", "attack_label"))
    return first.select("dataset", F.size(names).alias("n_columns"), F.get(label, F.lit(0)).alias("label_column"))


@book("src07_landing_parts", f"WITH {FLOWS} SELECT split, CASE split WHEN 'train' THEN 'parquet' WHEN 'val' THEN 'csv' ELSE 'csv.gz' END AS format, count(*) AS n_rows FROM f WHERE split IN ('train', 'val', 'test') GROUP BY split")
def src07(spark, d):
    """Parts of each split in the first format that is there: parquet, CSV, packed CSV."""
    at = f"{scratch.shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    rows = flows(spark, d).select("split", "row_id", "fwd_bytes")
    rows.where("split = 'train'").drop("split").write.parquet(f"{at}/train")
    rows.where("split = 'train'").drop("split").write.mode("append").option("header", True).csv(f"{at}/train")
    rows.where("split = 'val'").drop("split").write.option("header", True).csv(f"{at}/val")
    rows.where("split = 'test'").drop("split").write.option("header", True).option("compression", "gzip").csv(f"{at}/test")
    out = None
    for split in ("train", "val", "test"):
        kind, part = I.read_parts(spark, f"{at}/{split}", "row_id long, fwd_bytes long")
        n = part.agg(F.lit(split).alias("split"), F.lit(kind).alias("format"), F.count("row_id").alias("n_rows"))
        out = n if out is None else out.unionAll(n)
    return out


@book("src11_matrix_files", f"WITH {DECIDED} SELECT run_id, count(*) AS n_rows, count(DISTINCT (truth, pred)) AS n_cells, true AS is_valid FROM d GROUP BY run_id")
def src11(spark, d):
    """Every run's confusion matrix as a square CSV file, read back and validated: equal labels on both sides, no negative count."""
    at = f"{scratch.shared_folder(spark)}/matrices-{uuid.uuid4().hex}"
    decided(spark, d).groupBy("run_id", "truth").pivot("pred", LABELS).count().na.fill(0).repartition("run_id").write.partitionBy("run_id").option("header", True).csv(at)
    shape = "truth string, " + ", ".join(f"`{x}` long" for x in LABELS)
    wide = spark.read.schema(shape).option("header", True).option("enforceSchema", False).csv(at + "/*").withColumn("run_id", F.regexp_extract("_metadata.file_path", r"run_id=([^/]+)/", 1))
    long = wide.unpivot(["run_id", "truth"], LABELS, "pred", "n")
    valid = F.every(F.col("truth").isin(LABELS) & (F.col("n") >= 0))
    return long.groupBy("run_id").agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 0).alias("n_cells"), valid.alias("is_valid"))


@book("src12_evidence_lines", "SELECT candidate_no, sha256('{\"dataset\":\"' || dataset || '\",\"feed_id\":\"' || feed_id || '\",\"score\":' || score || '}')[1:24] AS evidence_id, score FROM candidate_splits")
def src12(spark, d):
    """Canonical JSON lines with their evidence id, written, read back and checked against it."""
    at = f"{scratch.shared_folder(spark)}/evidence-{uuid.uuid4().hex}"
    told = table(spark, d, "candidate_splits").select("candidate_no", I.canonical_json(["score", "feed_id", "dataset"]).alias("evidence"))
    told.select(F.to_json(F.struct("candidate_no", "evidence", F.substring(F.sha2("evidence", 256), 1, 24).alias("evidence_id")))).write.text(at)
    back = spark.read.schema("candidate_no long, evidence string, evidence_id string").json(at)
    honest = back.where(F.substring(F.sha2("evidence", 256), 1, 24) == F.col("evidence_id"))
    return honest.select("candidate_no", "evidence_id", F.get_json_object("evidence", "$.score").cast("long").alias("score"))


@book("src13_tolerant_records", "SELECT candidate_no, score, n_overlap_known FROM candidate_splits")
def src13(spark, d):
    """JSON with something after the first object: the object is kept, the rest ignored."""
    first = F.to_json(F.struct("score", "n_overlap_known"))
    spoiled = table(spark, d, "candidate_splits").select("candidate_no", F.concat(first, F.lit(' {"score": -1} trailing')).alias("t"))
    kept = I.first_object(F.col("t"), "score long, n_overlap_known int")
    return spoiled.select("candidate_no", kept.alias("r")).select("candidate_no", "r.score", "r.n_overlap_known")


@book("src14_run_folders", f"WITH {SCORES} SELECT run_id, any_value(model_name) AS model, count(*) AS n_rows, round(avg(pmax) + 1e-9, 6) AS mean_pmax FROM s GROUP BY run_id")
def src14(spark, d):
    """A crawl over run folders: one metrics file each, the run id from the path; folders without one are passed over."""
    at = f"{scratch.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    per = scores(spark, d).groupBy("run_id").agg(F.any_value("model_name").alias("model"), F.count(F.lit(1)).alias("n_rows"), F.avg("pmax").alias("mean_pmax"))
    per.write.partitionBy("run_id").json(at)
    back = spark.read.schema("model string, n_rows long, mean_pmax double").json(at + "/*")
    return back.select(F.regexp_extract("_metadata.file_path", r"run_id=([^/]+)/", 1).alias("run_id"), "model", "n_rows", R(F.col("mean_pmax") + 1e-9).alias("mean_pmax"))


@book("src16_optional_file", f"WITH {FLOWS} SELECT 'there' AS source, count(*) AS n_rows FROM f WHERE split = 'val' UNION ALL SELECT 'missing', 0")
def src16(spark, d):
    """A table that is there is read, one that is not gives the same columns without rows."""
    at = f"{scratch.shared_folder(spark)}/optional-{uuid.uuid4().hex}"
    flows(spark, d).where("split = 'val'").select("row_id").write.parquet(f"{at}/there")
    n = lambda name: I.read_or_empty(spark, f"{at}/{name}", "row_id long").agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n_rows"))
    return n("there").unionAll(n("missing"))


@book("snk06_folder_manifest", "SELECT dataset, true AS same_bytes, 64 AS digest_length FROM flows GROUP BY dataset")
def snk06(spark, d):
    """SHA-256 manifest of the files of a folder, from their bytes."""
    at = _landed(spark, d)
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(at)
    out = read.select(_dataset(F.col("path")).alias("dataset"), (F.octet_length("content") == F.col("length")).alias("same_bytes"), F.sha2("content", 256).alias("digest"))
    return out.select("dataset", "same_bytes", F.length("digest").alias("digest_length"))


QUERIES, SQL = book.queries, book.sql

"""Queries of the training-data operators of this subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve import scratch
from flowsieve.llm.leak_rows import classes, near_pairs
from flowsieve.llm.leak_text import leaks
from flowsieve.llm.linked_splits import components, linked_splits
from flowsieve.llm.multi_select import percentiles
from flowsieve.llm.packing import fill_report, pack
from flowsieve.llm.residue import detect
from flowsieve.llm.target_sample import target_report, target_sample
from flowsieve.tables import table

#: The 14 numeric features of flows (fixed by the data's description).
FEATURES = [
    "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "fwd_bytes", "bwd_bytes", "flow_bytes_s", "flow_pkts_s",
    "iat_mean", "iat_std", "pkt_len_mean", "pkt_len_std", "fwd_hdr_len", "init_win_bytes", "active_mean",
]


PERCENTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
DIMS = ["model_name", "holdout_family", "y_stage2_family", "score_day"]


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of p_attack and fam_pmax per group of DIMS and per every merger of such groups; exact."""
    valid = lambda c: F.when(F.col(c).between(0.0, 1.0), F.col(c))
    scores = table(spark, folder, "score_frame").withColumn("score_day", F.to_date("scored_at").cast("string"))
    out = percentiles(scores, DIMS, {c: valid(c) for c in ("p_attack", "fam_pmax")}, PERCENTS)
    return out.select(*DIMS, "grouping_id", "metric", "n", *[F.round(F.get("q", F.lit(i)), 9).alias(f"p{round(p * 100):02d}") for i, p in enumerate(PERCENTS)])


_BITS = " + ".join(f"grouping({d}) * {1 << i}" for i, d in enumerate(DIMS))
P1_SQL = " UNION ALL ".join(
    f"SELECT {', '.join(DIMS)}, CAST({_BITS} AS INT) AS grouping_id, '{m}' AS metric, count(v) AS n, "
    + ", ".join(f"round(quantile_cont(v, {p}), 9) AS p{round(p * 100):02d}" for p in PERCENTS)
    + f" FROM (SELECT model_name, holdout_family, y_stage2_family, CAST(CAST(scored_at AS DATE) AS VARCHAR) AS score_day, CASE WHEN isfinite({m}) AND {m} BETWEEN 0 AND 1 THEN {m} END AS v FROM score_frame) GROUP BY CUBE ({', '.join(DIMS)})"
    for m in ("p_attack", "fam_pmax")
)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_pairs(table(spark, folder, "flows"), "row_id", "split", FEATURES)
    return pairs.select(F.least("train_key", "eval_key").alias("row_id_a"), F.greatest("train_key", "eval_key").alias("row_id_b"))


def p4_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation rows with a partner in train, per split and dataset, beside all rows of that split and dataset."""
    # copies stand for each other: pairs are sought between distinct records only, and counted by their rows
    distinct, _ = scratch.cut(classes(table(spark, folder, "flows"), "row_id", "split", ["dataset"], FEATURES))
    leaked = near_pairs(distinct, "row_id", "split", FEATURES).select(F.col("eval_key").alias("row_id")).distinct().withColumn("leaked", F.lit(True))
    rows = distinct.where(F.col("split").isin("val", "test")).select("row_id", "split", "dataset", "n_rows").join(leaked, "row_id", "left")
    return rows.groupBy("split", "dataset").agg(F.sum("n_rows").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("leaked"), F.col("n_rows"))), F.lit(0)).alias("n_leaked"))


def _agree(f: str) -> str:
    fin = lambda x: f"coalesce(isfinite({x}.{f}::DOUBLE), false)"
    return f"(CASE WHEN {fin('a')} AND {fin('b')} THEN (abs(a.{f} - b.{f}) <= 0.002 * greatest(abs(a.{f}), abs(b.{f})))::INT WHEN {fin('a')} OR {fin('b')} THEN 0 ELSE 1 END)"


_PAIRS = (
    "SELECT a.row_id AS t, b.row_id AS e FROM (SELECT * FROM flows WHERE lower(trim(split)) = 'train') a, "
    f"(SELECT * FROM flows WHERE lower(trim(split)) IN ('val', 'test')) b WHERE {' + '.join(map(_agree, FEATURES))} >= 12"
)
P4_FOUND_SQL = f"SELECT least(t, e) AS row_id_a, greatest(t, e) AS row_id_b FROM ({_PAIRS})"
P4_OVERLAP_SQL = (
    f"WITH leaked AS (SELECT DISTINCT e FROM ({_PAIRS})) SELECT lower(trim(split)) AS split, dataset, count(*) AS n_rows, count(e) AS n_leaked "
    "FROM flows LEFT JOIN leaked ON row_id = e WHERE lower(trim(split)) IN ('val', 'test') GROUP BY ALL"
)

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}


def unit_keys() -> list:
    """Source file, session and campaign of a planning unit; null where it has none."""
    name = F.lower(F.trim("source_file_name"))
    for ending in (r"\.(gz|bz2|xz|zip|zst|lz4|z)$", r"\.[a-z0-9]+$", r"_plus$"):
        name = F.regexp_replace(name, ending, "")
    session = F.lower(F.trim("session_id"))
    family = F.lower(F.trim("holdout_family"))
    return [
        F.nullif(name, F.lit("")),
        F.when(session.rlike("[0-9]"), session),  # an id has a number; "none", "n/a", "unknown", "-" name no session
        F.when(F.col("campaign_no").isNotNull() & (family != ""), F.concat_ws(":", F.col("campaign_no").cast("string"), family)),
    ]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "plan_units")
    members = units.select(F.col("unit_no").alias("id"), F.explode(F.array(*[F.when(k.isNotNull(), F.concat(F.lit(f"{i}:"), k)) for i, k in enumerate(unit_keys())])).alias("key"))
    return components(members).select(F.col("first").alias("group_first"), F.col("id").alias("unit_no"))


def p3_split(spark: SparkSession, folder: str) -> DataFrame:
    """Every planning unit with its group and split."""
    out = linked_splits(table(spark, folder, "plan_units"), F.col("unit_no"), F.col("raw_row_count"), unit_keys(), SHARES)
    return out.select(F.col("id").alias("unit_no"), F.col("first").alias("group_first"), "bin", "split")


def p3_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Per split: groups that reach into another split, and whether its share of the rows is within 1 % (or half the heaviest group, which stays whole) of its target."""
    units = table(spark, folder, "plan_units").select("unit_no", F.greatest(F.coalesce("raw_row_count", F.lit(0)), F.lit(0)).alias("w"))
    placed = p3_split(spark, folder).join(units, "unit_no")
    torn = placed.groupBy("group_first").agg(F.count_distinct("split").alias("n"), F.sum("w").alias("w")).agg(F.count_if(F.col("n") > 1).alias("n_torn"), (F.max("w") / F.sum("w")).alias("heaviest"))
    shares = placed.groupBy("split").agg(F.sum("w").alias("w"))
    total = placed.agg(F.sum("w").alias("total"))
    goal = F.element_at(F.create_map(*[F.lit(x) for kv in SHARES.items() for x in kv]), F.col("split"))
    out = shares.join(F.broadcast(total)).join(F.broadcast(torn))  # one row each
    return out.select("split", "n_torn", (F.abs(F.col("w") / F.col("total") - goal) <= F.greatest(F.lit(0.01), F.col("heaviest") / 2)).alias("near_target"))


P3_BALANCE_SQL = "SELECT unnest(['train', 'val', 'test']) AS split, 0 AS n_torn, true AS near_target"


def p3_candidate_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Per candidate split: groups of related units that it tears apart between splits."""
    units = table(spark, folder, "plan_units")
    first = units.select("unit_no", "unit_id").join(p3_found(spark, folder), "unit_no", "left").select(F.col("unit_id"), F.coalesce("group_first", "unit_no").alias("group_first"))
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.split(F.coalesce(F.col(f"{s}_units"), F.lit("")), "[|]").alias("ids")) for s in SHARES])
    listed = table(spark, folder, "candidate_splits").select("candidate_no", F.explode(parts).alias("p")).select("candidate_no", "p.split", F.explode("p.ids").alias("unit_id"))
    listed = listed.select("candidate_no", "split", F.trim("unit_id").alias("unit_id")).distinct()
    torn = listed.join(first, "unit_id").groupBy("candidate_no", "group_first").agg(F.count_distinct("split").alias("n"))
    return torn.groupBy("candidate_no").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_torn"))


_P3_KEYS = """
unit_keys AS (
  SELECT unit_no, '0:' || nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(source_file_name)), '\\.(gz|bz2|xz|zip|zst|lz4|z)$', ''), '\\.[a-z0-9]+$', ''), '_plus$', ''), '') AS k FROM plan_units
  UNION ALL SELECT unit_no, '1:' || lower(trim(session_id)) FROM plan_units WHERE regexp_matches(session_id, '[0-9]')
  UNION ALL SELECT unit_no, '2:' || campaign_no || ':' || lower(trim(holdout_family)) FROM plan_units WHERE campaign_no IS NOT NULL AND trim(holdout_family) <> ''),
star AS (SELECT DISTINCT u.unit_no AS a, m.b FROM unit_keys u JOIN (SELECT k, min(unit_no) AS b FROM unit_keys WHERE k IS NOT NULL GROUP BY k) m USING (k)),
links AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)"""
P3_FOUND_SQL = f"WITH RECURSIVE {_P3_KEYS} SELECT min(other) AS group_first, id AS unit_no FROM reach GROUP BY id HAVING min(other) < id"
P3_BREAKS_SQL = f"""
WITH RECURSIVE {_P3_KEYS}, firsts AS (SELECT id, least(id, min(other)) AS g FROM reach GROUP BY id),
listed AS (SELECT DISTINCT candidate_no, split, trim(x) AS unit_id FROM ({" UNION ALL ".join(f"SELECT candidate_no, '{s}' AS split, unnest(string_split(coalesce({s}_units, ''), '|')) AS x FROM candidate_splits" for s in SHARES)})),
torn AS (SELECT candidate_no, coalesce(g, unit_no) AS g, count(DISTINCT split) AS n FROM listed JOIN plan_units USING (unit_id) LEFT JOIN firsts ON id = unit_no GROUP BY ALL)
SELECT candidate_no, count(*) AS n_groups, count_if(n > 1) AS n_torn FROM torn GROUP BY candidate_no
"""

LEVELS = {"family": "y_stage2_family", "fine": "y_stage2_fine"}


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Each target with its population in flows, what it needs, what its sample holds, and the gaps that are left."""
    return target_report(table(spark, folder, "flows"), table(spark, folder, "sample_targets"), "flow_no", "row_id", "split", LEVELS)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that the drawn samples leave unmet because flows has too few rows of them."""
    return p6_report(spark, folder).where("shortfall > 0 AND drawn < need").select("target_no")


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per plan, over the sample itself: keys drawn twice, records of another category or split, minimums missed though flows has the rows."""
    flows, targets = table(spark, folder, "flows"), table(spark, folder, "sample_targets")
    tidy = lambda c: F.lower(F.trim(F.col(c)))
    drawn = p6_sample(spark, folder).join(targets.select("target_no", "cat_level", tidy("category").alias("want"), tidy("split").alias("only")), "target_no")
    rows = flows.select("row_id", tidy("split").alias("split"), tidy("y_stage2_family").alias("family"), tidy("y_stage2_fine").alias("fine"))
    met = drawn.join(rows, "row_id").withColumn("has", F.when(F.col("cat_level") == "family", F.col("family")).otherwise(F.col("fine")))
    wrong = ~F.coalesce(F.col("has") == F.col("want"), F.lit(False)) | ~F.coalesce(F.col("split") == F.col("only"), F.col("only").isNull())
    twice = drawn.groupBy("plan_no", "flow_no").agg(F.count(F.lit(1)).alias("n")).groupBy("plan_no").agg(F.count_if(F.col("n") > 1).alias("n_twice"))
    missed = p6_report(spark, folder).join(targets.select("target_no", "min_rows"), "target_no")
    missed = missed.groupBy("plan_no").agg(F.count_if((F.col("population") >= F.col("min_rows")) & (F.col("drawn") < F.col("min_rows"))).alias("n_missed"), F.count_if(F.col("drawn") != F.col("quota")).alias("n_off_quota"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return missed.join(twice, "plan_no", "left").join(met.groupBy("plan_no").agg(F.count_if(wrong).alias("n_wrong")), "plan_no", "left").select("plan_no", zero("n_twice"), zero("n_wrong"), "n_missed", "n_off_quota")


P6_CHECK_SQL = "SELECT plan_no, 0 AS n_twice, 0 AS n_wrong, 0 AS n_missed, 0 AS n_off_quota FROM sample_targets GROUP BY plan_no"


def p6_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sample of every plan; shares and minimums as p6_report's quotas."""
    drawn = target_sample(table(spark, folder, "flows"), table(spark, folder, "sample_targets"), "flow_no", "row_id", "split", LEVELS)
    return drawn.select("plan_no", "target_no", F.col("_key").alias("flow_no"), F.col("_record").alias("row_id"), F.round("weight", 12).alias("weight"))


P6_FOUND_SQL = """
WITH pop AS (SELECT flow_no, max(lower(trim(split))) AS split, max(lower(trim(y_stage2_family))) AS family, max(lower(trim(y_stage2_fine))) AS fine FROM flows GROUP BY flow_no),
c AS (SELECT 'family' AS lvl, split, family AS cat, count(*) AS n FROM pop GROUP BY ALL UNION ALL SELECT 'fine', split, fine, count(*) FROM pop GROUP BY ALL)
SELECT t.target_no FROM sample_targets t LEFT JOIN c ON c.lvl = t.cat_level AND c.cat = lower(trim(t.category)) AND (t.split IS NULL OR c.split = lower(trim(t.split)))
GROUP BY t.target_no, t.min_rows, t.target_share, t.sample_size HAVING coalesce(sum(c.n), 0) < greatest(t.min_rows, round(t.target_share * t.sample_size, 6))
"""


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the containers' table holds in several pieces, hence with a second one."""
    return p8_containers(spark, folder).where("piece = 1").select("capacity_no", "doc_id")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document, or piece of a document above the capacity, lies."""
    out = pack(table(spark, folder, "documents"), table(spark, folder, "capacities"), "doc_id", "text")
    return out.withColumnRenamed("item", "doc_id")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: documents and tokens laid out, containers above their capacity, texts cut in vain, and whether at most 1 % (and one container) more than the least possible number is used."""
    caps = table(spark, folder, "capacities")
    out = fill_report(pack(table(spark, folder, "documents"), caps, "doc_id", "text"), caps).join(caps, "capacity_no")
    tight = F.col("n_containers") <= F.ceil(1.01 * F.col("n_tokens") / F.col("capacity_tokens")) + 1
    return out.select("capacity_no", "n_items", "n_tokens", "n_overfull", "n_cut_in_vain", tight.alias("tight"))


_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x{85}\p{Z}]+'))"
P8_FILL_SQL = f"SELECT capacity_no, count(*) AS n_items, sum({_TOKENS})::BIGINT AS n_tokens, 0 AS n_overfull, 0 AS n_cut_in_vain, true AS tight FROM documents, capacities GROUP BY capacity_no"
P8_FOUND_SQL = r"""
SELECT capacity_no, doc_id FROM documents, capacities
WHERE len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x{85}\p{Z}]+')) > capacity_tokens
"""


def p10_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what each detector says of it; rows with `residue` are to be left out."""
    return detect(table(spark, folder, "documents"), "doc_id", "text", "source", "doc_kind").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_verdicts(spark, folder).where("residue").select("doc_id")



def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of test items, verbatim or paraphrased."""
    out = leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return out.select("doc_id", "item_id", "kind", "longest_run", F.round("subsequence", 6).alias("subsequence"), F.round("answers", 6).alias("answers"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks with a run of at least 12 common words: the same search and checks as p9_leaks."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).where("longest_run >= 12").select("doc_id", "item_id")


P9_FOUND_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
eg AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM e WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
"""

QUERIES = {"p1_percentiles": p1_percentiles, "p3_found": p3_found, "p3_split": p3_split, "p3_balance": p3_balance, "p3_candidate_breaks": p3_candidate_breaks, "p4_found": p4_found, "p4_overlap": p4_overlap, "p8_found": p8_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p10_found": p10_found, "p10_verdicts": p10_verdicts, "p9_found": p9_found, "p9_leaks": p9_leaks, "p6_found": p6_found, "p6_report": p6_report, "p6_sample": p6_sample, "p6_check": p6_check}
SQL = {"p1_percentiles": P1_SQL, "p3_found": P3_FOUND_SQL, "p3_balance": P3_BALANCE_SQL, "p3_candidate_breaks": P3_BREAKS_SQL, "p4_found": P4_FOUND_SQL, "p4_overlap": P4_OVERLAP_SQL, "p8_found": P8_FOUND_SQL, "p8_fill": P8_FILL_SQL, "p9_found": P9_FOUND_SQL, "p6_found": P6_FOUND_SQL, "p6_check": P6_CHECK_SQL}

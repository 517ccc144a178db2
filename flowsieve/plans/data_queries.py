"""Queries of the general data-processing operators (problems 2, 5 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators import schema_drift
from flowsieve.operators.line_loader import load_lines
from flowsieve.operators.tree_aggregate import exact, key_totals, tree_states
from flowsieve import scratch
from flowsieve.tables import table

SUMMED = {"tot_fwd_pkts": 0, "tot_bwd_pkts": 0, "fwd_bytes": 0, "bwd_bytes": 0, "flow_duration": 4}


def _states(spark: SparkSession, folder: str) -> DataFrame:
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return tree_states(
        table(spark, folder, "flows"),
        {"family": blank("y_stage2_family"), "fine": blank("y_stage2_fine")},
        F.col("sensor_id"),
        {f"sum_{c}": exact(F.col(c), scale) for c, scale in SUMMED.items()},
    )


def _doubles() -> list:
    return [F.round(f"sum_{c}", 3).cast("double").alias(f"sum_{c}") for c in SUMMED]


def p2_key_sensors(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct sensors of each family and each fine label of flows, with the rows and sums each contributes."""
    return _states(spark, folder).select("key_kind", "key_value", F.col("member").alias("sensor_id"), "n_rows", *_doubles())


def p2_key_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, sums and number of distinct sensors of each family and each fine label of flows."""
    out = key_totals(_states(spark, folder), [f"sum_{c}" for c in SUMMED])
    return out.select("key_kind", "key_value", "n_rows", *_doubles(), F.col("n_members").alias("n_sensors"))


_P2_SUMS = ", ".join(
    f"round(sum(CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DECIMAL(28,{s}) END), 3)::DOUBLE AS sum_{c}" for c, s in SUMMED.items()
)
_P2_KEYS = (("family", "y_stage2_family"), ("fine", "y_stage2_fine"))
P2_SENSORS_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS key_kind, nullif(trim({c}), '') AS key_value, sensor_id, count(*) AS n_rows, {_P2_SUMS} FROM flows GROUP BY nullif(trim({c}), ''), sensor_id" for kind, c in _P2_KEYS
)
P2_TOTALS_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS key_kind, nullif(trim({c}), '') AS key_value, count(*) AS n_rows, {_P2_SUMS}, count(DISTINCT sensor_id) AS n_sensors FROM flows GROUP BY nullif(trim({c}), '')" for kind, c in _P2_KEYS
)


def _drift(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rescue table, columns of files, resolved names)."""
    catalog = table(spark, folder, "field_catalog")
    taken = schema_drift.ingest(table(spark, folder, "capture_records"), catalog)
    columns, _ = scratch.cut(schema_drift.columns_of_files(taken))
    return taken, columns, schema_drift.resolve_names(taken, columns, catalog)


def p5_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of a file's columns against the file captured before it in its feed, with what it was before."""
    _, columns, resolved = _drift(spark, folder)
    return schema_drift.changes(table(spark, folder, "capture_files"), columns, resolved)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_changes(spark, folder).select("file_no", "column_name", "change_kind")


def p5_table(spark: SparkSession, folder: str) -> DataFrame:
    """All capture records as one table with the fields of the catalog; the rest as JSON in _rescued."""
    taken, _, resolved = _drift(spark, folder)
    return schema_drift.replay(taken, resolved, table(spark, folder, "field_catalog"))


def p5_preserved(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: records, and the (record, key, value) triples of the payloads that the typed columns or `_rescued` still hold after replay."""
    taken, _, resolved = _drift(spark, folder)
    done = schema_drift.replay(taken, resolved, table(spark, folder, "field_catalog"))
    rescued = schema_drift.rescued_values(done).select("file_no", "rec_no", "name", "value").distinct()
    seen = taken.select("file_no", "rec_no", F.explode("_placed").alias("x")).select("file_no", "rec_no", "x.name", "x.value").unionByName(schema_drift.rescued_values(taken)).distinct()
    fields = [c for c in done.columns if c not in ("file_no", "rec_no", "_rescued")]
    held = done.select("file_no", "rec_no", sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)).alias("n_typed"))
    kept = seen.join(rescued, ["file_no", "rec_no", "name", "value"], "left_anti").groupBy("file_no", "rec_no").agg(F.count(F.lit(1)).alias("n_placed"))
    lost = held.join(kept, ["file_no", "rec_no"], "left").where(F.coalesce("n_placed", F.lit(0)) < F.col("n_typed"))
    per = done.groupBy("file_no").agg(F.count(F.lit(1)).alias("n_records"))
    n = seen.groupBy("file_no").agg(F.count(F.lit(1)).alias("n_values"))
    return per.join(n, "file_no", "left").join(lost.groupBy("file_no").agg(F.count(F.lit(1)).alias("n_lost")), "file_no", "left").select("file_no", "n_records", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_lost", F.lit(0)).alias("n_lost"))


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    labels = [r.fine_label for r in table(spark, folder, "label_map").select("fine_label").collect()]
    return load_lines(table(spark, folder, "raw_lines"), "line_id", "line_text", table(spark, folder, "raw_schema"), labels)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(spark, folder).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p7_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected lines with the reason and the columns of the failing cells."""
    return _loaded(spark, folder).where(F.col("reason").isNotNull()).select("line_id", "reason", F.array_join("bad_columns", "|").alias("bad_columns"))


def p7_table(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that load, typed."""
    return _loaded(spark, folder).where(F.col("reason").isNull()).drop("reason", "bad_columns")


_F = r'''(?:"(?:[^"]|"")*"|[^",\r\n]*)'''
_P7_JUDGED = rf"""
WITH formed AS (SELECT line_id, coalesce(line_text, '') AS t FROM raw_lines WHERE regexp_full_match(coalesce(line_text, ''), '{_F}(?:,{_F})*')),
split_ AS (SELECT line_id, regexp_extract_all(',' || t, ',({_F})', 1) AS f FROM formed),
cells AS (SELECT line_id, unnest(f) AS c, generate_subscripts(f, 1) AS pos FROM split_ WHERE len(f) = 43),
tidy AS (SELECT line_id, pos, trim(CASE WHEN c[1] = '"' THEN replace(c[2:-2], '""', '"') ELSE c END, chr(32) || chr(9) || chr(10) || chr(13)) AS v FROM cells),
bad AS (SELECT line_id, list(column_name ORDER BY pos) AS names FROM tidy JOIN raw_schema ON pos = col_pos WHERE CASE
  WHEN v = '' THEN NOT may_be_empty
  WHEN value_kind IN ('integer', 'flag') THEN NOT regexp_full_match(v, '[+-]?[0-9]+') OR NOT coalesce(try_cast(v AS DOUBLE) BETWEEN min_value AND max_value, false)
  WHEN value_kind = 'real' THEN NOT regexp_full_match(v, '[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') OR NOT coalesce(try_cast(v AS DOUBLE) BETWEEN min_value AND max_value, false)
  WHEN value_kind = 'label' THEN lower(replace(v, '.', '')) NOT IN (SELECT lower(replace(fine_label, '.', '')) FROM label_map)
  ELSE false END GROUP BY line_id),
judged AS (SELECT r.line_id, CASE WHEN s.line_id IS NULL THEN 'quoting' WHEN len(s.f) <> 43 THEN 'column_count' WHEN b.line_id IS NOT NULL THEN 'bad_value' END AS reason, coalesce(array_to_string(b.names, '|'), '') AS names
  FROM raw_lines r LEFT JOIN split_ s USING (line_id) LEFT JOIN bad b ON b.line_id = r.line_id)"""
P5_PRESERVED_SQL = """
WITH one AS (SELECT file_no, rec_no, min(payload) AS p FROM capture_records GROUP BY ALL),
kv AS (SELECT file_no, rec_no, k, json_extract_string(p, '$."' || k || '"') AS v FROM (SELECT file_no, rec_no, p, unnest(json_keys(p)) AS k FROM one WHERE json_valid(p))),
t AS (SELECT DISTINCT file_no, rec_no, trim(regexp_replace(lower(k), '[^a-z0-9]+', '_', 'g'), '_') AS k, v FROM kv WHERE v IS NOT NULL)
SELECT file_no, (SELECT count(*) FROM one o WHERE o.file_no = f.file_no) AS n_records, (SELECT count(*) FROM t WHERE t.file_no = f.file_no) AS n_values, 0 AS n_lost FROM (SELECT DISTINCT file_no FROM one) f
"""
#: The columns of raw_lines by kind, in the order of raw_schema, with their positions.
_KINDS = {
    "BIGINT": "1:duration 5:src_bytes 6:dst_bytes 7:land 8:wrong_fragment 9:urgent 10:hot 11:num_failed_logins 12:logged_in 13:num_compromised 14:root_shell 15:su_attempted 16:num_root 17:num_file_creations 18:num_shells 19:num_access_files 20:num_outbound_cmds 21:is_host_login 22:is_guest_login 23:count 24:srv_count 32:dst_host_count 33:dst_host_srv_count 43:difficulty",
    "DOUBLE": "25:serror_rate 26:srv_serror_rate 27:rerror_rate 28:srv_rerror_rate 29:same_srv_rate 30:diff_srv_rate 31:srv_diff_host_rate 34:dst_host_same_srv_rate 35:dst_host_diff_srv_rate 36:dst_host_same_src_port_rate 37:dst_host_srv_diff_host_rate 38:dst_host_serror_rate 39:dst_host_srv_serror_rate 40:dst_host_rerror_rate 41:dst_host_srv_rerror_rate",
    "VARCHAR": "2:protocol_type 3:service 4:flag 42:label",
}
_CELLS = ", ".join(f'try_cast(ltrim(max(nullif(v, \'\')) FILTER (WHERE pos = {x.split(":")[0]}), \'{"" if k == "VARCHAR" else "+"}\') AS {k}) AS "{x.split(":")[1]}"' for k, xs in _KINDS.items() for x in xs.split())
P7_TABLE_SQL = f"{_P7_JUDGED} SELECT line_id, {_CELLS} FROM tidy JOIN judged USING (line_id) WHERE reason IS NULL GROUP BY line_id"
P7_FOUND_SQL = f"{_P7_JUDGED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"
P7_REJECTS_SQL = f"{_P7_JUDGED} SELECT line_id, reason, CASE WHEN reason = 'bad_value' THEN names END AS bad_columns FROM judged WHERE reason IS NOT NULL"

QUERIES = {"p7_found": p7_found, "p7_rejects": p7_rejects, "p7_table": p7_table, "p5_found": p5_found, "p5_changes": p5_changes, "p5_table": p5_table, "p5_preserved": p5_preserved, "p2_key_sensors": p2_key_sensors, "p2_key_totals": p2_key_totals}
SQL = {"p7_found": P7_FOUND_SQL, "p7_rejects": P7_REJECTS_SQL, "p7_table": P7_TABLE_SQL, "p5_preserved": P5_PRESERVED_SQL, "p2_key_sensors": P2_SENSORS_SQL, "p2_key_totals": P2_TOTALS_SQL}

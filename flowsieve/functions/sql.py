"""The scalar rules as temporary SQL functions, for users who write SQL. They are expanded in line: no Python is run."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "finite_or_null": "(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN NOT isnan(x) AND abs(x) <> double('inf') THEN x END",
    "port_bucket": "(port STRING) RETURNS STRING RETURN CASE WHEN coalesce(try_cast(port AS INT), -1) < 0 THEN 'NA' WHEN try_cast(port AS INT) <= 1023 THEN 'well_known' WHEN try_cast(port AS INT) <= 49151 THEN 'registered' ELSE 'ephemeral' END",
    "canonical_name": "(name STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_'), '^_+|_+$', '')",
    "closed_truth": "(attack INT, family STRING) RETURNS STRING RETURN CASE WHEN attack = 0 THEN 'Benign' ELSE family END",
    "decide": "(p DOUBLE, pmax DOUBLE, family STRING, threshold DOUBLE, tau DOUBLE) RETURNS STRING RETURN CASE WHEN p < threshold THEN 'Benign' WHEN pmax < tau THEN 'Unknown' ELSE family END",
}


def register(spark: SparkSession) -> list[str]:
    """Creates (or replaces) the functions in the session and returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return sorted(FUNCTIONS)

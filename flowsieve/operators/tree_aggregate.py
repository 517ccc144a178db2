"""Per-key counts, exact sums and distinct members when a few keys hold most rows: multi-level tree aggregation.

Level 0 takes the input's splits (of fixed size, `spark.sql.files.maxPartitionBytes`) as chunks and combines each where
it lies, to one state row per (key, member) that occurs in it. Each round then merges the states of `fan_in` neighbouring nodes, shuffled by
(node, key kind, key, member): a reducer receives at most `fan_in` states for each of its members, so even a key that
holds nearly all rows is spread over all tasks, by member. The number of rounds is the logarithm of the number of
chunks. The root has one row for each (key, member); counting those rows per key is done with map-side combination and
moves one row per task and key.

Defined results: a null or blank key is the key null, counted like any other; a null member counts rows and sums but is
no distinct member; NaN and infinite values are left out of sums; an empty table gives no rows; sums are exact
(decimal), hence independent of the order of merging.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact(value: Column, scale: int) -> Column:
    """The value as a decimal of fixed scale; null for null, NaN and infinite."""
    number = value.cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, value.cast(f"decimal(28,{scale})"))


def tree_states(
    rows: DataFrame,
    keys: dict[str, Column],
    member: Column,
    sums: dict[str, Column],
    fan_in: int = 8,
    n_chunks: int | None = None,
) -> DataFrame:
    """One row per (key_kind, key_value, member): n_rows and one exact sum for each of `sums`.

    `n_chunks`: number of chunks (input splits) if known, else that of the plan's first stage.
    """
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("value")) for kind, key in keys.items()])
    base = rows.select(F.spark_partition_id().alias("_node"), F.explode(kinds).alias("_k"), member.cast("string").alias("_member"), *[v.alias(n) for n, v in sums.items()])
    base = base.select("_node", F.col("_k.kind").alias("key_kind"), F.col("_k.value").alias("key_value"), "_member", *sums)
    merged = [F.sum(n).cast("decimal(38,4)").alias(n) for n in sums]
    chunks = n_chunks or rows.select(F.lit(1)).rdd.getNumPartitions()
    state = base.groupBy("_node", "key_kind", "key_value", "_member").agg(F.count(F.lit(1)).alias("n_rows"), *merged)
    for _ in range(max(1, math.ceil(math.log(max(2, chunks), fan_in)))):
        state = state.groupBy(F.floor(F.col("_node") / fan_in).alias("_node"), "key_kind", "key_value", "_member").agg(F.sum("n_rows").alias("n_rows"), *merged)
    return state.drop("_node").withColumnRenamed("_member", "member")


def key_totals(states: DataFrame, sums: list[str]) -> DataFrame:
    """One row per (key_kind, key_value): n_rows, the sums, n_members; from the root states of `tree_states`."""
    merged = [F.sum(n).cast("decimal(38,4)").alias(n) for n in sums]
    return states.groupBy("key_kind", "key_value").agg(F.sum("n_rows").alias("n_rows"), *merged, F.count("member").alias("n_members"))

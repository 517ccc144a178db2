"""Row numbers, running sums and exact quantiles of groups of any size: no group is brought into one task.

The rows are range-partitioned by (keys, order), so that a group lies in consecutive chunks; the chunks are written to
the shared folder with their numbers, their totals are summed up per group (one row for each group and chunk), and each
chunk then continues from the total of the chunks before it. Rows with equal order values keep any order among them.

Defined results: null keys are groups of their own; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve import scratch

Order = list[str | Column]


def running_sums(rows: DataFrame, keys: list[str], order: Order, sums: dict[str, Column]) -> DataFrame:
    """Adds, per name of `sums`, the inclusive running sum `name` and the group's total `name_total`."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    valued = rows.withColumns({f"_v_{n}": v for n, v in sums.items()})
    chunks, _ = scratch.cut(valued.repartitionByRange(*[F.col(k) for k in keys], *by).withColumn("_chunk", F.spark_partition_id()))
    totals = chunks.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_c"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_chunk") == F.col("_c"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    summed = chunks.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(within) for n in sums})
    out = summed.join(offsets, same)
    return out.select(*rows.columns, *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums], *[f"{n}_total" for n in sums])


def numbered(rows: DataFrame, keys: list[str], order: Order, name: str = "_rn") -> DataFrame:
    """Adds the row number within the keys, from 1, and `<name>_total`, the number of rows of the keys."""
    return running_sums(rows, keys, order, {name: F.lit(1)})


def quantiles(rows: DataFrame, keys: list[str], value: str, percents: list[float]) -> DataFrame:
    """keys, q: exact, linearly interpolated quantiles (an array) of the non-null values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sums(counts, keys, ["_x"], {"_r": F.col("_n")})
    low = lambda p: F.floor(F.lit(p) * (F.col("_r_total") - 1))
    at = lambda rank: F.min(F.when(F.col("_r") > rank, F.col("_x")))
    found = upto.groupBy(*keys).agg(
        F.first("_r_total").alias("_t"), *[at(low(p)).alias(f"_a{i}") for i, p in enumerate(percents)], *[at(F.least(low(p) + 1, F.col("_r_total") - 1)).alias(f"_b{i}") for i, p in enumerate(percents)]
    )
    part = lambda i, p: F.lit(p) * (F.col("_t") - 1) - F.floor(F.lit(p) * (F.col("_t") - 1))
    mixed = [F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * part(i, p) for i, p in enumerate(percents)]
    return found.select(*keys, F.array(*mixed).alias("q"))

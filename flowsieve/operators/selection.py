"""Best rows, latest rows, dominance and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The k first rows of each group; `order` must end with a unique column to be deterministic."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return out.drop("_rank") if k == 1 else out.withColumnRenamed("_rank", "rank")


def nan_last(c: Column, descending: bool = False) -> Column:
    """Sort order with missing values last in both directions; NaN counts as missing."""
    value = F.when(~F.isnan(c), c)
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


def pareto(df: DataFrame, id: str, keys: list[str], benefits: list[str], costs: list[str], slack: float = 1e-12) -> DataFrame:
    """Adds `on_front`: no other row of the group is at least as good everywhere and better somewhere.

    The join is an equi-join on the group's keys; groups are the runs of one case and stay small.
    """
    other = df.select(*keys, F.col(id).alias("_o"), *[F.col(c).alias("_" + c) for c in benefits + costs])
    good = [F.col("_" + c) >= F.col(c) - slack for c in benefits] + [F.col("_" + c) <= F.col(c) + slack for c in costs]
    better = [F.col("_" + c) > F.col(c) + slack for c in benefits] + [F.col("_" + c) < F.col(c) - slack for c in costs]
    dominated = df.join(other, keys).where(reduce(lambda a, b: a & b, good) & reduce(lambda a, b: a | b, better)).select(id).distinct().withColumn("_d", F.lit(True))
    return df.join(dominated, id, "left").withColumn("on_front", F.col("_d").isNull()).drop("_d")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `old` whose key is not in `new`, and all of `new`."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delta_to(df: DataFrame, keys: list[str], is_base: Column, metrics: list[str]) -> DataFrame:
    """Adds `delta_<metric>`: difference to the base row of the group."""
    group = Window.partitionBy(*keys)
    return df.withColumns({f"delta_{m}": F.col(m) - F.max(F.when(is_base, F.col(m))).over(group) for m in metrics})


def unique_or_fail(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame itself; a query over it fails if a key occurs twice (for many-to-one joins)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("key is not unique")).cast("boolean")).otherwise(True)).drop("_n")

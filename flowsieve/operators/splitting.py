"""Quotas, caps, contiguous parts and audits of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.operators.prefix import numbered


def quotas(counts: DataFrame, n: str, fractions: tuple[float, float, float] = (0.70, 0.15, 0.15), least: int = 1) -> DataFrame:
    """Adds n_train, n_val, n_test to stratum counts; strata too small for all three go to train.

    Half values round to even; a test quota below the minimum is repaired from train, then from val.
    """
    c = F.col(n).cast("long")
    rest = c - 3 * least
    part = lambda f: least + F.rint(F.lit(f) * rest).cast("long")
    small = c < 3 * least
    out = counts.withColumns({"_t": part(fractions[0]), "_v": part(fractions[1])})
    need = F.greatest(F.lit(0), least - (c - F.col("_t") - F.col("_v")))
    from_train = F.least(need, F.col("_t") - least)
    from_val = F.least(need - from_train, F.col("_v") - least)
    out = out.withColumns({"n_train": F.when(small, c).otherwise(F.col("_t") - from_train), "n_val": F.when(small, 0).otherwise(F.col("_v") - from_val)})
    return out.withColumn("n_test", c - F.col("n_train") - F.col("n_val")).drop("_t", "_v")


def quota_fill(rows: DataFrame, stratum: str, order: list[Column], quota: DataFrame) -> DataFrame:
    """Assigns `split`: in row order each stratum fills train, then val, then test; the rest goes to train."""
    ranked = numbered(rows, [stratum], order).drop("_rn_total")
    joined = ranked.join(quota.select(stratum, "n_train", "n_val", "n_test"), stratum)
    rn, t, v, s = F.col("_rn"), F.col("n_train"), F.col("n_val"), F.col("n_test")
    split = F.when(rn <= t, "train").when(rn <= t + v, "val").when(rn <= t + v + s, "test").otherwise("train")
    return joined.withColumn("split", split).drop("_rn", "n_train", "n_val", "n_test")


def capped(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first `cap` rows of each key, in row order; each task cuts its own rows to `cap` per key before the shuffle (WindowGroupLimit, up to a cap of 1,000)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rn", rank).where(F.col("_rn") <= cap).drop("_rn")


def contiguous_parts(rows: DataFrame, file: str, order: str, parts: Column) -> DataFrame:
    """Adds `part` (from 1): row ranges of ceil(n / parts) rows; tails without rows do not occur."""
    ranked = numbered(rows, [file], [order])
    size = F.ceil(F.col("_rn_total") / parts)
    return ranked.withColumn("part", (F.floor((F.col("_rn") - 1) / size) + 1).cast("int")).drop("_rn", "_rn_total")


def interval_audit(units: DataFrame, file: str, start: str, end: str, rows: str) -> DataFrame:
    """Per file: whether its row ranges start at 0, do not overlap, touch each other and cover all rows."""
    w = Window.partitionBy(file)
    following = F.lead(start).over(w.orderBy(start, end))
    marked = units.withColumn("_next", following)
    return marked.groupBy(file).agg(
        F.count(F.lit(1)).alias("n_units"),
        (F.min(start) == 0).alias("starts_at_zero"),
        F.every(F.col("_next").isNull() | (F.col("_next") >= F.col(end))).alias("no_overlap"),
        F.every(F.col("_next").isNull() | (F.col("_next") == F.col(end))).alias("contiguous"),
        (F.max(end) == F.sum(rows)).alias("covers_rows"),
    )


def largest_remainder(counts: DataFrame, key: str, part: str, n: str, cap: int) -> DataFrame:
    """Adds `quota`: at most `cap` rows of each key, shared over its parts by largest remainders."""
    w = Window.partitionBy(key)
    total = F.sum(n).over(w)
    exact = F.lit(cap) * F.col(n) / total
    base = F.floor(exact)
    out = counts.withColumns({"_total": total, "_base": base, "_rest": exact - base})
    out = out.withColumn("_left", cap - F.sum("_base").over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.col("_rest").desc(), F.col(n).desc(), part)))
    extra = (F.col("_rank") <= F.col("_left")).cast("long")
    return out.withColumn("quota", F.when(F.col("_total") <= cap, F.col(n)).otherwise(F.least(F.col(n), F.col("_base") + extra))).drop("_total", "_base", "_rest", "_left", "_rank")


def support_table(rows: DataFrame, keys: list[str], split: Column, family: Column, splits: list[str]) -> DataFrame:
    """keys, family and one count column per split (0 where absent)."""
    return rows.groupBy(*keys, family.alias("family")).agg(*[F.count_if(split == s).alias(s) for s in splits])


def holdout_audit(support: DataFrame, keys: list[str], minimum: int, benign: str = "Benign", empty: str = "__EMPTY__", least_known: int = 1, count: str = "valid") -> DataFrame:
    """One row per key and held-out family: counts, valid and invalid remaining families, reasons, verdict.

    `support`: keys, family, train, val, test. Families are those of train. `count`: whether valid or all remaining
    families are held against `least_known`.
    """
    attack = ~F.col("family").isin(benign, empty)
    base = support.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("family") == benign, F.col("val"))), F.lit(0)).alias("benign_val"),
        F.coalesce(F.max(F.when(F.col("family") == benign, F.col("test"))), F.lit(0)).alias("benign_test"),
        F.collect_list(F.when(attack & (F.col("train") > 0), F.struct("family", "train", "val", "test"))).alias("known"),  # one entry per family
    )
    each = base.select("*", F.explode("known").alias("h"))
    rest = F.filter("known", lambda x: x["family"] != F.col("h.family"))
    ok = lambda x: (x["train"] >= minimum) & (x["val"] >= minimum) & (x["test"] >= minimum)
    out = each.select(
        *keys, F.col("h.family").alias("holdout_family"), "benign_val", "benign_test", F.col("h.val").alias("unknown_val"), F.col("h.test").alias("unknown_test"),
        F.size(rest).alias("n_known"),
        F.array_sort(F.transform(F.filter(rest, ok), lambda x: x["family"])).alias("valid_known"),
        F.array_sort(F.transform(F.filter(rest, lambda x: ~ok(x)), lambda x: x["family"])).alias("invalid_known"),
    )
    held = F.size("valid_known") if count == "valid" else F.col("n_known")
    reasons = [
        (F.col("benign_val") < minimum, "benign_val_below_min"), (F.col("benign_test") < minimum, "benign_test_below_min"),
        (F.col("unknown_val") < minimum, "unknown_val_below_min"), (F.col("unknown_test") < minimum, "unknown_test_below_min"),
        (held < least_known, "not_enough_valid_known_families_after_holdout"), (F.size("invalid_known") > 0, "remaining_known_families_failed_support_rule"),
    ]
    out = out.withColumn("reasons", F.array_compact(F.array(*[F.when(c, r) for c, r in reasons])))
    return out.withColumn("scenario_valid", F.size("reasons") == 0)

"""Samples whose category shares match given targets: raking, exponential keys, repair of minimums, residual gaps.

1. Records are counted once per contingency cell (split x family x fine label, plus "any other"); this table is bounded
   by the target table's categories and is all that reaches the driver.
2. For each plan, cell weights are raked by iterative proportional fitting over its category margin (the target shares)
   and the split margin (the population's split shares, for plans that are not restricted to one split).
3. Quotas come from the shares by largest remainders; minimums that can be met are then raised to, and the excess is
   taken from the categories above their minimum. A quota never exceeds the population. A minimum that cannot be met
   is reported and leaves the category at its share, so that one impossible target does not displace all others.
4. Within a category the records with the smallest keys -ln(u) / weight are drawn, u being a hash of the record's key:
   the same record has the same key on every run and after every lost executor. A record is only ever shuffled if its
   key lies under a bound that holds a few more records than the quota; ranks are found by counting key buckets and
   ordering the one bucket in which the quota ends, so no task orders a whole category.

Defined results: categories and splits are compared without case and padding; null or blank matches no target;
repeated deliveries of one key count once, with the smallest record id; a target whose category does not occur has
population 0; an empty table leaves every target with a positive need unmet; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve import scratch


def normal(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def population(records: DataFrame, key: str, record: str, split: str, levels: dict[str, str]) -> DataFrame:
    """One row per key: _key, _record (smallest), _split and one normalised column for each level."""
    narrow = records.select(F.col(key).alias("_key"), F.col(record).alias("_record"), normal(F.col(split)).alias("_split"), *[normal(F.col(c)).alias(f"_{n}") for n, c in levels.items()])
    return narrow.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_record").alias("_record"), *[F.max(c).alias(c) for c in ["_split", *[f"_{n}" for n in levels]]])


def _bounded(pop: DataFrame, targets: pd.DataFrame, levels: list[str]) -> DataFrame:
    """Categories that no target names become null, which bounds the number of cells."""
    for n in levels:
        known = sorted({c for c in targets.loc[targets.cat_level == n, "category"] if c})
        pop = pop.withColumn(f"_{n}", F.when(F.col(f"_{n}").isin(known), F.col(f"_{n}")) if known else F.lit(None).cast("string"))
    splits = sorted({*targets["split"].dropna(), "train", "val", "test"})
    return pop.withColumn("_split", F.when(F.col("_split").isin(splits), F.col("_split")))


def read_targets(targets: DataFrame) -> pd.DataFrame:
    """The (fixed, small) target table, normalised."""
    cols = ["target_no", "plan_no", "cat_level", "split", "category", "target_share", "min_rows", "sample_size"]
    t = targets.select(*cols).toPandas()
    low = lambda x: None if x is None or not str(x).strip() else str(x).strip().lower()
    for c in ("cat_level", "split", "category"):
        t[c] = pd.Series([low(x) for x in t[c]], dtype=object)
    return t.fillna({"target_share": 0.0, "min_rows": 0, "sample_size": 0}).reset_index(drop=True)


def rake(counts: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200) -> np.ndarray:
    """Weights per record of each cell so that the weighted cells meet each margin (codes, shares); 0 where a share is 0."""
    w = np.ones(len(counts))
    for _ in range(rounds):
        before = w.copy()
        for codes, shares in margins:
            total = np.bincount(codes, w * counts, len(shares))
            factor = np.divide(shares, total, out=np.zeros(len(shares)), where=total > 0)
            w = w * factor[codes]
        if np.allclose(w, before, rtol=1e-9, atol=0):
            break
    return w


def margin_gap(counts: np.ndarray, weights: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """Largest gap between a margin's share and that of the weighted cells, among the categories that occur; 0 is met."""
    gaps = [0.0]
    for codes, shares in margins:
        occur = np.bincount(codes, counts, len(shares)) > 0
        got = np.bincount(codes, weights * counts, len(shares))
        gaps += list(np.abs(got - shares)[occur])
    return float(max(gaps))


def quotas(shares: np.ndarray, size: int, available: np.ndarray, minimums: np.ndarray) -> np.ndarray:
    """Whole rows per category: largest remainders, then the minimums that can be met, then the excess taken back."""
    exact = shares * size
    q = np.floor(exact).astype(np.int64)
    spare = min(len(q), max(0, int(round(exact.sum())) - int(q.sum())))
    q[np.argsort(-(exact - q), kind="stable")[:spare]] += 1
    q = np.minimum(q, available)
    floor_ = np.where(minimums <= available, minimums, 0)
    q = np.maximum(q, floor_)
    excess = int(q.sum()) - size
    while excess > 0 and (room := np.maximum(q - np.maximum(floor_, np.minimum(1, q)), 0)).sum() > 0:
        cut = np.minimum(room, np.maximum(1, np.floor(room * min(1.0, excess / room.sum()))).astype(np.int64) * (room > 0))
        order = np.argsort(-room, kind="stable")
        taken = np.minimum(cut[order], np.maximum(0, excess - np.concatenate([[0], np.cumsum(cut[order])[:-1]])))
        q[order] -= taken
        excess = int(q.sum()) - size
    return q


def plan(cells: pd.DataFrame, targets: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(targets with population, need, quota, gap of the raked margins; cells with plan_no, target_no, weight per record)."""
    report, drawn = [], []
    for plan_no, t in targets.groupby("plan_no"):
        t = t.reset_index(drop=True)
        level, size = t.cat_level[0], int(t.sample_size.max())
        inside = cells if t["split"][0] is None else cells[cells["_split"] == t["split"][0]]
        place = {c: i for i, c in enumerate(t.category) if c}
        own = inside[inside[f"_{level}"].isin(list(place))]
        codes = own[f"_{level}"].map(place).to_numpy(dtype=np.int64)
        counts = own["n"].to_numpy(dtype=np.float64)
        available = np.bincount(codes, counts, len(t)).astype(np.int64)
        split_names, split_codes = np.unique(own["_split"].fillna("").to_numpy(dtype=str), return_inverse=True) if len(own) else (np.array([""]), codes)
        shares = t.target_share.to_numpy(dtype=np.float64)
        margins = [(codes, shares)]
        if t["split"][0] is None and len(own):
            margins = [(split_codes, np.bincount(split_codes, counts, len(split_names)) / counts.sum()), *margins]
        weight = rake(counts, margins)
        q = quotas(shares, size, available, t.min_rows.to_numpy(dtype=np.int64))
        need = np.maximum(t.min_rows.to_numpy(dtype=np.float64), np.round(shares * t.sample_size.to_numpy(dtype=np.float64), 6))
        report.append(t.assign(population=available, need=need, quota=q, rake_gap=margin_gap(counts, weight, margins)))
        drawn.append(own.assign(plan_no=plan_no, target_no=t.target_no.to_numpy()[codes], code=codes, weight=weight))
    return pd.concat(report, ignore_index=True), pd.concat(drawn, ignore_index=True)


def _cells(pop: DataFrame, levels: list[str]) -> pd.DataFrame:
    return pop.groupBy("_split", *[f"_{n}" for n in levels]).agg(F.count(F.lit(1)).alias("n")).toPandas()


def target_report(records: DataFrame, targets: DataFrame, key: str, record: str, split: str, levels: dict[str, str], **options) -> DataFrame:
    """One row per target, with what its sample holds.

    population, need, quota; drawn (records of the sample), shortfall (need that even the whole population cannot meet;
    0 where it can), share_gap (share of the plan's sample less the target share), split_gap (largest gap between the
    split shares of the plan's sample and those of its population; null for plans within one split), rake_gap (largest gap
    of the plan's margins after raking; above about 1e-9 the margins contradict each other).
    """
    spark = records.sparkSession
    shape = "target_no long, plan_no int, category string, population long, need double, quota long, drawn long, shortfall double, share_gap double, split_gap double, rake_gap double"
    drawn, report, cells = _draw(records, targets, key, record, split, levels, **options)
    if drawn is None:
        return spark.createDataFrame([], shape)
    got = drawn.groupBy("target_no", "_split").agg(F.count(F.lit(1)).alias("n")).toPandas()  # one row per target and split
    report = report.merge(got.groupby("target_no")["n"].sum().rename("drawn").reset_index(), "left", "target_no").fillna({"drawn": 0})
    size = report.groupby("plan_no")["drawn"].transform("sum")
    report["share_gap"] = np.where(size > 0, report["drawn"] / size.where(size > 0, 1) - report["target_share"], np.nan)
    gaps = {}
    for plan_no, t in report[report["split"].isna()].groupby("plan_no"):
        inside = got[got.target_no.isin(t.target_no)].fillna({"_split": ""}).groupby("_split")["n"].sum()
        whole = cells[cells.plan_no == plan_no].fillna({"_split": ""}).groupby("_split")["n"].sum()
        if inside.sum() and whole.sum():
            gaps[plan_no] = float((inside / inside.sum()).sub(whole / whole.sum(), fill_value=0).abs().max())
    known = lambda x: None if x is None or x != x else float(x)
    rows = [
        (int(r.target_no), int(r.plan_no), r.category, int(r.population), float(r.need), int(r.quota), int(r.drawn), max(0.0, float(r.need) - r.population), known(r.share_gap), gaps.get(r.plan_no), float(r.rake_gap))
        for r in report.itertuples()
    ]
    return spark.createDataFrame(rows, shape)


def _bound(counts: np.ndarray, weights: np.ndarray, wanted: float) -> float:
    """Key under which about `wanted` records lie: sum of counts * (1 - exp(-weight * key)) = wanted."""
    if wanted >= counts[weights > 0].sum() * 0.999:
        return float("inf")
    low, high = 0.0, 1.0
    inside = lambda x: float((counts * -np.expm1(-weights * x)).sum())
    while inside(high) < wanted:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if inside(mid) < wanted else (low, mid)
    return high


def target_sample(records: DataFrame, targets: DataFrame, key: str, record: str, split: str, levels: dict[str, str], **options) -> DataFrame:
    """The drawn records of every plan: plan_no, target_no, key, record, weight (raked weight per record)."""
    drawn, _, _ = _draw(records, targets, key, record, split, levels, **options)
    if drawn is None:
        return records.sparkSession.createDataFrame([], "plan_no int, target_no long, _key long, _record long, weight double")
    return drawn.drop("_split")


def _draw(records: DataFrame, targets: DataFrame, key: str, record: str, split: str, levels: dict[str, str], seed: int = 7, bucket_rows: int = 4096):
    """(drawn records, report of the targets, raked cells); without targets all are None."""
    spark = records.sparkSession
    t = read_targets(targets)
    if not len(t):
        return None, None, None
    pop, _ = scratch.cut(_bounded(population(records, key, record, split, levels), t, list(levels)))
    report, cells = plan(_cells(pop, list(levels)), t)
    quota = report.set_index("target_no")["quota"]
    bounds = {}
    for target_no, c in cells.groupby("target_no"):
        q = float(quota[target_no])
        bounds[target_no] = _bound(c["n"].to_numpy(float), c["weight"].to_numpy(float), q + 6 * q**0.5 + 30) if q else 0.0
    names = ["_split", *[f"_{n}" for n in levels]]

    def candidates(bounds: dict) -> DataFrame:
        rows = [
            (*[None if pd.isna(r[n]) else r[n] for n in names], int(r.plan_no), int(r.target_no), float(r.weight), float(bounds[r.target_no]), int(quota[r.target_no]))
            for _, r in cells.iterrows()
            if quota[r.target_no] and r.weight > 0
        ]
        shape = ", ".join(f"{n} string" for n in names) + ", plan_no int, target_no long, weight double, bound double, quota long"
        # bounded by the target table: at most one row per target and cell of its category
        side = F.broadcast(spark.createDataFrame(rows, shape).select(*[F.col(n).alias("t" + n) for n in names], "plan_no", "target_no", "weight", "bound", "quota"))
        met = pop.join(side, [F.col(n).eqNullSafe(F.col("t" + n)) for n in names])
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "plan_no", "_key"), 11) + 0.5) / float(1 << 53)
        return met.withColumn("k", -F.ln(u) / F.col("weight")).where(F.col("k") <= F.col("bound")).select("plan_no", "target_no", "_key", "_record", "_split", "weight", "bound", "quota", "k")

    found, path = scratch.cut(candidates(bounds))
    have = {r.target_no: r["n"] for r in found.groupBy("target_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    lacking = [x for x in bounds if have.get(x, 0) < min(quota[x], report.set_index("target_no")["population"][x])]
    if lacking:  # practically never: the bound is six standard deviations wide
        bounds |= dict.fromkeys(lacking, float("inf"))
        scratch.drop(spark, path)
        found, path = scratch.cut(candidates(bounds))
    # keys are turned into a bucket of the unit interval by their rank-preserving exponential; about bucket_rows each
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("quota") / bucket_rows))
    by = found.withColumn("bucket", F.floor(F.when(F.col("bound") == float("inf"), -F.expm1(-F.col("k") * F.col("weight"))).otherwise(F.col("k") / F.col("bound")) * parts).cast("long"))
    sizes = by.groupBy("plan_no", "target_no", "quota", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("target_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sizes.withColumn("before", before).where(F.col("before") < F.col("quota")).select("target_no", "bucket", "before", "n")
    kept = by.join(edge, ["target_no", "bucket"])
    whole = kept.where(F.col("before") + F.col("n") <= F.col("quota"))
    cutting = kept.where(F.col("before") + F.col("n") > F.col("quota")).withColumn("rank", F.row_number().over(Window.partitionBy("target_no").orderBy("k", "_key")))
    out = ["plan_no", "target_no", "_key", "_record", "_split", "weight"]
    drawn = whole.select(*out).unionAll(cutting.where(F.col("rank") <= F.col("quota") - F.col("before")).select(*out))
    return drawn, report, cells

"""Same or nearly the same records on both sides of a train / evaluation split.

Every record is canonicalised (split name without case and padding, each numeric feature turned into the number of
its cell on a logarithmic grid, null / NaN / infinite into one "missing" cell) and hashed; evaluation hashes are
joined with training hashes. Two records may disagree on `max_disagree` features, so with `max_disagree + 1`
disjoint groups of features at least one group agrees completely: each record is hashed once per group. Cells are
wider than the tolerance, and an evaluation record also probes the neighbouring cell of a value that lies within the
tolerance of a cell's edge, so no pair is lost.

The shuffle of this join carries, besides hash and key, two longs with one byte per feature (a fine cell number modulo
256): pairs whose bytes are too far apart are dropped inside the join, so what is left is nearly the result. Only these
pairs fetch the exact values of their rows and are verified.

Buckets in which more than `hot_pairs` pairs would have to be compared are divided further by the same argument on
the other features (at most `max_disagree` of them disagree), so one frequent combination of values cannot make the
join quadratic.

Defined results: null keys in `split` take no part; a record whose features are all missing matches others like it;
repeated records each give their own pairs; an empty table gives no pairs; other columns are never read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve import scratch

#: Cell width on the log scale; any width above twice the tolerance is exact, wider means fewer probes, larger buckets.
CELL = 0.06
HOT_PAIRS = 2_000_000


def usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def agrees(a: Column, b: Column, tol: float) -> Column:
    """Equal within `tol` of the larger absolute value, or both missing; never null."""
    near = F.abs(a - b) <= F.lit(tol) * F.greatest(F.abs(a), F.abs(b))
    return F.when(usable(a) & usable(b), near).otherwise(~usable(a) & ~usable(b))


def _cell(value: Column, shift: float) -> Column:
    grid = F.floor((F.ln(F.abs(value)) + F.lit(shift)) / F.lit(CELL)) * 2
    return (
        F.when(~F.coalesce(usable(value), F.lit(False)), F.lit(1 << 40))
        .when(value == 0, F.lit(1 << 41))
        .otherwise(grid + (value < 0).cast("long"))
    )


def _hashes(seed: Column, which: Column) -> Column:
    """Hashes of the cells numbered `which`, chained from `seed`: one for each combination of cells within reach."""

    def step(hashes: Column, i: Column) -> Column:
        low, high = F.get("_low", i), F.get("_high", i)
        both = lambda h: F.when(low == high, F.array(F.xxhash64(h, low))).otherwise(F.array(F.xxhash64(h, low), F.xxhash64(h, high)))
        return F.flatten(F.transform(hashes, both))

    return F.aggregate(which, F.array(seed), step)


def _numbers(ints: list[int]) -> Column:
    return F.array(*[F.lit(i) for i in ints])


def _signature(names: list[str], step: float) -> Column:
    """One byte for each of up to seven features: cells of the tolerance's width, modulo 256."""
    out = F.lit(0).cast("long")
    for i, n in enumerate(names):
        v = F.col(n)
        byte = F.when(~F.coalesce(usable(v), F.lit(False)), 0).when(v == 0, 128).otherwise(F.floor(F.ln(F.abs(v)) / F.lit(step)).bitwiseAND(F.lit(255)))
        out = out.bitwiseOR(F.shiftleft(byte.cast("long"), 8 * i))
    return out


def _close_bytes(a: Column, b: Column, n: int) -> Column:
    """How many of the first `n` bytes differ by at most one, modulo 256."""
    apart = lambda i: F.pmod(F.shiftright(a, 8 * i) - F.shiftright(b, 8 * i) + 1, F.lit(256))
    return reduce(lambda x, y: x + y, [(apart(i) <= 2).cast("int") for i in range(n)])


def classes(records: DataFrame, key: str, split: str, also: list[str], features: list[str]) -> DataFrame:
    """One row per distinct record of a split (and `also`): the smallest key, the canonical features and n_rows; copies are combined map-side."""
    value = lambda f: F.when(usable(F.col(f).cast("double")), F.col(f).cast("double"))
    side = F.lower(F.trim(F.col(split)))
    return records.groupBy(side.alias(split), *also, *[value(f).alias(f) for f in features]).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_rows"))


def near_pairs(
    records: DataFrame,
    key: str,
    split: str,
    features: list[str],
    tol: float = 0.002,
    max_disagree: int = 2,
    train: str = "train",
    evaluation: tuple[str, ...] = ("val", "test"),
    hot_pairs: int = HOT_PAIRS,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Pairs (train_key, eval_key, eval_split) of records that agree on all but `max_disagree` features."""
    reach = -math.log1p(-tol) + 1e-9
    side = F.lower(F.trim(F.col(split)))
    rows = records.select(F.col(key).alias("_id"), side.alias("_split"), *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(features)])
    names = [f"_v{i}" for i in range(len(features))]
    groups = [names[i :: max_disagree + 1] for i in range(max_disagree + 1)]

    index = [[names.index(n) for n in fs] for fs in groups]

    def cells(df: DataFrame, probes: bool) -> DataFrame:
        reached = reach if probes else 0.0
        return df.withColumns({"_low": F.array(*[_cell(F.col(n), -reached) for n in names]), "_high": F.array(*[_cell(F.col(n), reached) for n in names])} if probes else {"_low": (low := F.array(*[_cell(F.col(n), 0.0) for n in names])), "_high": low})

    def keyed(df: DataFrame, probes: bool) -> DataFrame:
        bands = F.transform(F.array(*[_numbers(x) for x in index]), lambda which, g: F.struct(g.alias("g"), _hashes(g.cast("long"), which).alias("h")))
        signed = cells(df, probes).withColumns({f"_s{i}": _signature(names[7 * i : 7 * i + 7], reach) for i in range(-(-len(names) // 7))})
        found = signed.select("_id", "_low", "_high", *[c for c in signed.columns if c.startswith("_s") and c != "_split"], F.explode(bands).alias("_b"))
        return found.select("*", F.col("_b.g").alias("_g"), F.explode("_b.h").alias("_h")).drop("_b")

    left = keyed(rows.where(F.col("_split") == train), False)
    right = keyed(rows.where(F.col("_split").isin(*evaluation)), True)
    pick = lambda df, n: F.broadcast(df) if 32 * n <= broadcast_bytes else df  # a long and a flag take at most 32 bytes in a hash table
    hot, _ = scratch.cut(
        left.select("_h", F.lit(1).alias("t"), F.lit(0).alias("e"))
        .unionAll(right.select("_h", F.lit(0).alias("t"), F.lit(1).alias("e")))
        .groupBy("_h")
        .agg(F.sum("t").alias("t"), F.sum("e").alias("e"))
        .where(F.col("t") * F.col("e") > hot_pairs)
        .select("_h", F.lit(True).alias("_hot"))
    )
    hot = pick(hot, hot.count())
    parts = [[[n for n in names if n not in fs][s :: max_disagree + 1] for s in range(max_disagree + 1)] for fs in groups]
    halves = [names[i : i + 7] for i in range(0, len(names), 7)]

    def placed(df: DataFrame, probes: bool, prefix: str) -> DataFrame:
        """One row per hash; rows of hot buckets are hashed again, by thirds of the features outside their group."""
        rest = F.get(F.array(*[F.array(*[_numbers([names.index(n) for n in sub]) for sub in subs]) for subs in parts]), F.col("_g"))
        finer = F.flatten(F.transform(rest, lambda which, s: _hashes(F.xxhash64("_h", s), which)))
        chosen = df.join(hot, "_h", "left").select("*", F.explode(F.when(F.col("_hot"), finer).otherwise(F.array("_h"))).alias("_k"))
        return chosen.select(F.col("_k").alias(prefix + "k"), F.col("_id").alias(prefix + "id"), *[F.col(f"_s{i}").alias(f"{prefix}s{i}") for i in range(len(halves))])

    a, b = placed(left, False, "a_"), placed(right, True, "b_")
    close = reduce(lambda x, y: x + y, [_close_bytes(F.col(f"a_s{i}"), F.col(f"b_s{i}"), len(h)) for i, h in enumerate(halves)])
    met = a.join(b, (F.col("a_k") == F.col("b_k")) & (close >= len(names) - max_disagree)).select("a_id", "b_id").distinct()
    met, _ = scratch.cut(met)
    n = met.count()
    involved = met.select(F.col("a_id").alias("_id")).unionAll(met.select(F.col("b_id").alias("_id"))).distinct()
    few = rows.join(pick(involved, 2 * n), "_id", "left_semi")
    side_of = lambda df, p: df.select(F.col("_id").alias(p + "id"), F.col("_split").alias(p + "split"), *[F.col(x).alias(p + x) for x in names])
    agree = reduce(lambda x, y: x + y, [agrees(F.col("a_" + x), F.col("b_" + x), tol).cast("int") for x in names])
    return (
        met.join(side_of(few, "a_"), "a_id")
        .join(side_of(few, "b_"), "b_id")
        .where(agree >= len(names) - max_disagree)
        .select(F.col("a_id").alias("train_key"), F.col("b_id").alias("eval_key"), F.col("b_split").alias("eval_split"))
    )

"""Filling fixed-capacity containers with items by minimum bin slack.

Items are dealt to groups of bounded size. Within a group each container takes the largest remaining item, and a
subset-sum over the multiset of remaining lengths (reachable sums as the bits of one integer, multiplicities split into
powers of two) finds the lengths that fill the rest closest to the capacity; the counts are traced back, and the same
multiset is used again as long as the remaining counts allow. Containers that stay below `good` of the capacity are
opened again and their items packed together with those of other groups, round after round, so that unused space does
not add up over the groups. For one capacity this ends when one group is left, when the opened containers are proven
optimal (their number is the larger of total size / capacity, rounded up, and the number of pieces above half the
capacity, no two of which fit together), or when a round saves less than `least_gain` of the containers it opened:
items that cannot be packed tighter are not moved again, so the number of rounds does not depend on their number.

An item above the capacity is cut into full containers and one remainder, which is packed like any item.

Defined results: null and empty texts have 0 tokens and lie in the first container of their group; repeated texts are
items of their own; without documents or capacities there are no rows; null or non-positive capacities hold nothing.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve import scratch

#: The public WordPunct rule: runs of letters, digits and underscores, and runs of other characters but white space.
WORD_PUNCT = r"[\p{L}\p{N}_]+|(?U:[^\p{L}\p{N}_\s]+)"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PUNCT)), F.lit(0)).cast("long")


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of the given lengths whose sum is the largest one within `room`."""
    reach, steps, full = 1, [], (1 << room + 1) - 1
    for length in sorted(counts, reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left > 0:
            take = min(chunk, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & full
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return used


def fill(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item (0 < size <= capacity)."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(sizes):
        waiting[s].append(i)
    counts = {s: len(x) for s, x in waiting.items()}
    out, number = [0] * len(sizes), 0
    while counts:
        largest = max(counts)
        rest = dict(counts)
        rest[largest] -= 1
        used = best_fill({s: c for s, c in rest.items() if c and s <= capacity - largest}, capacity - largest)
        used[largest] = used.get(largest, 0) + 1
        for _ in range(min(counts[s] // c for s, c in used.items() if c)):
            for s, c in used.items():
                for _ in range(c):
                    out[waiting[s].pop()] = number
                counts[s] -= c
            number += 1
        counts = {s: c for s, c in counts.items() if c}
    return out


def pieces(documents: DataFrame, capacities: DataFrame, id: str, text: str) -> DataFrame:
    """capacity_no, capacity, item, tokens, n_pieces, piece, start, size: items cut only where above the capacity."""
    sized = documents.select(F.col(id).alias("item"), token_count(F.col(text)).alias("tokens"))
    # the fixed list of container sizes becomes part of the expression, so nothing is joined or broadcast
    sizes = capacities.select(F.col("capacity_no").cast("int"), F.col("capacity_tokens").cast("long").alias("c")).where(F.col("c") > 0).collect()
    caps = F.array(*[F.struct(F.lit(r.capacity_no).cast("int").alias("capacity_no"), F.lit(r.c).cast("long").alias("capacity")) for r in sizes])
    if not sizes:
        caps = F.expr("CAST(array() AS array<struct<capacity_no: int, capacity: bigint>>)")
    each = sized.select("item", "tokens", F.explode(caps).alias("_c")).select("item", "tokens", "_c.capacity_no", "_c.capacity")
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("long")
    cut = each.withColumn("n_pieces", n).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)).alias("piece"))
    return cut.withColumn("start", F.col("piece") * F.col("capacity")).withColumn("size", F.least(F.col("capacity"), F.col("tokens") - F.col("start")))


def pack(documents: DataFrame, capacities: DataFrame, id: str, text: str, group_rows: int = 2000, good: float = 0.995, least_gain: float = 0.001) -> DataFrame:
    """capacity_no, item, piece, start, size, container: where each piece lies."""
    spark = documents.sparkSession
    key = ["capacity_no", "capacity", "item", "piece", "start", "size"]
    todo, path = scratch.cut(pieces(documents, capacities, id, text).select(*key))
    shape = "capacity_no int, capacity long, item long, piece long, start long, size long, container string, filled double"
    done, level, opened = [], 0, {}
    n_rows = {r.capacity_no: r["count"] for r in todo.groupBy("capacity_no").count().collect()}  # one row per container size, here and below
    while n_rows:
        n_groups = {c: -(-n // group_rows) for c, n in n_rows.items()}
        share = F.element_at(F.create_map(*[F.lit(x).cast(t) for c, n in n_groups.items() for x, t in ((c, "int"), (n, "long"))]), F.col("capacity_no"))
        dealt = todo.withColumn("node", F.pmod(F.xxhash64("item", "piece", F.lit(level)), share))

        def place(pdf: pd.DataFrame) -> pd.DataFrame:
            capacity, node = int(pdf["capacity"].iloc[0]), int(pdf["node"].iloc[0])
            pdf = pdf.sort_values(["item", "piece"], kind="stable")
            sizes = pdf["size"].to_numpy()
            number = pd.Series(0, index=pdf.index)
            number[sizes > 0] = fill([int(s) for s in sizes[sizes > 0]], capacity)
            total = pdf["size"].groupby(number).sum()
            return pdf[key].assign(container=[f"{node}-{x}" for x in number], filled=(number.map(total) / capacity).astype(float))

        packed = dealt.groupBy("capacity_no", "node").applyInPandas(place, shape)
        placed, new = scratch.cut(packed.withColumn("container", F.concat(F.lit(f"{level}-"), "container")))
        scratch.drop(spark, path)
        path = None
        bad = F.col("filled") < good
        boxes = placed.groupBy("capacity_no", "container").agg(
            F.first("capacity").alias("capacity"), F.max(bad.cast("int")).alias("bad"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.count_if(2 * F.col("size") > F.col("capacity")).alias("large")
        )
        is_open = F.col("bad") == 1
        least = F.greatest(F.ceil(F.sum(F.when(is_open, F.col("total"))) / F.first("capacity")), F.sum(F.when(is_open, F.col("large"))))
        counts = boxes.groupBy("capacity_no").agg(F.count(F.lit(1)).alias("boxes"), F.count_if(is_open).alias("open"), F.coalesce(F.sum(F.when(is_open, F.col("n"))), F.lit(0)).alias("rows"), least.alias("least")).collect()
        again = {}
        for r in counts:
            saved = opened.get(r.capacity_no, 2 * r.boxes) - r.boxes  # the first round always counts as a gain
            if r.open and n_groups[r.capacity_no] > 1 and r.open > r.least and saved >= least_gain * r.boxes:
                again[r.capacity_no], opened[r.capacity_no] = r.rows, r.open
        goes_on = F.col("capacity_no").isin(list(again)) & bad
        done.append(placed.where(~goes_on) if again else placed)
        if again:
            todo, path = scratch.cut(placed.where(goes_on).select(*key))
        n_rows, level = again, level + 1
    scratch.drop(spark, path)
    out = done[0] if done else spark.createDataFrame([], shape)
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select("capacity_no", "item", "piece", "start", "size", "container")


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """capacity_no, n_items, n_tokens, n_containers, n_overfull, n_cut_in_vain, unused (share of the containers' space)."""
    sizes = F.broadcast(capacities.select("capacity_no", F.col("capacity_tokens").cast("long").alias("capacity")))  # the fixed list, one row per container size
    boxes = packed.groupBy("capacity_no", "container").agg(F.sum("size").alias("total"), F.count_if(F.col("piece") == 0).alias("n_items"), F.count_if((F.col("piece") > 0) & (F.col("size") <= 0)).alias("vain"))
    return boxes.join(sizes, "capacity_no").groupBy("capacity_no").agg(
        F.sum("n_items").alias("n_items"), F.sum("total").alias("n_tokens"), F.count(F.lit(1)).alias("n_containers"),
        F.count_if(F.col("total") > F.col("capacity")).alias("n_overfull"), F.sum("vain").alias("n_cut_in_vain"), (1 - F.sum("total") / F.sum("capacity")).alias("unused"),
    )

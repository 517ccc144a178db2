"""Splits that keep related records together: components over shared keys, then largest-differencing balance.

Components: every key gives a star from its members to its smallest member; alternating large-star and small-star
steps then turn the graph into one star per component, in a number of rounds that is logarithmic in its size. A round
consists of `min` aggregations (combined map-side, so a hub's edges are never gathered) and a join with them; its
edges are cut to a table in the shared folder. Nothing but a count and a checksum of the edges reaches the driver.

Balance: components are dealt to groups of bounded size; in each group the two most uneven partial solutions are
combined again and again, largest bin with smallest (largest differencing, `n_bins` bins). The groups' bin vectors are
combined the same way over further rounds of bounded fan-in, until `n_bins` nearly equal bins are left. Whole bins are
then given to the splits by target proportion.

Defined results: null keys link nothing; a record without any key is a component of its own; repeated rows of one id
count once (largest weight); null or negative weights count 0; an empty table gives no rows. A component heavier than
a bin stays whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve import scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(members: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From (id, key) rows: (id, first) with the smallest id of its component, for ids that share a key with another."""
    links = members.where(F.col("id").isNotNull() & F.col("key").isNotNull()).select("id", "key")
    lead = links.groupBy("key").agg(F.min("id").alias("v"))
    edges, path = scratch.cut(links.join(lead, "key").where(F.col("id") > F.col("v")).select(F.col("id").alias("u"), "v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v")).distinct()
        lead = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lead, "u")
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lead.select("u", F.col("m").alias("v"))).where(F.col("u") > F.col("v")).distinct()
        edges, new = scratch.cut(step)
        scratch.drop(edges.sparkSession, path)
        path, before, seen = new, seen, _state(edges)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("first"))


def differencing(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest differencing of bin vectors (items x bins): (sums per bin, bin of each item's slot)."""
    n, k = vectors.shape
    where = np.tile(np.arange(k), (n, 1))
    heap = []
    for i, v in enumerate(vectors):
        order = np.argsort(-v, kind="stable")
        slot = np.empty(k, dtype=np.int64)
        slot[order] = np.arange(k)
        where[i] = slot
        s = v[order]
        heap.append((float(s[-1] - s[0]), i, s, [i]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        where[other] = k - 1 - where[other]  # the largest bin of one meets the smallest of the other
        s = a + b[::-1]
        order = np.argsort(-s, kind="stable")
        slot = np.empty(k, dtype=np.int64)
        slot[order] = np.arange(k)
        own += other
        where[own] = slot[where[own]]
        s = s[order]
        heapq.heappush(heap, (float(s[-1] - s[0]), i, s, own))
    return (heap[0][2] if heap else np.zeros(k)), where


def allot(sums: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Split of each bin: bins from the heaviest to the split that lacks most; then moves and swaps that lower the gap."""
    goal = shares * sums.sum()
    out = np.zeros(len(sums), dtype=np.int64)
    have = np.zeros(len(shares))
    for i in np.argsort(-sums, kind="stable"):
        out[i] = int(np.argmax(goal - have))
        have[out[i]] += sums[i]
    for _ in range(500):
        best = (1e-9, None)
        for i in range(len(sums)):
            for j in range(len(sums)):
                x, y = out[i], out[j]
                if x != y and i < j:
                    d = sums[i] - sums[j]
                    gain = abs(have[x] - goal[x]) + abs(have[y] - goal[y]) - abs(have[x] - d - goal[x]) - abs(have[y] + d - goal[y])
                    if gain > best[0]:
                        best = (gain, (i, j, d))
        if best[1] is None:
            break
        i, j, d = best[1]
        have[out[i]] -= d
        have[out[j]] += d
        out[i], out[j] = out[j], out[i]
    return out


def balanced(parts: DataFrame, shares: dict[str, float], n_bins: int = 100, group_size: int = 1000, fan_in: int = 50) -> DataFrame:
    """From (first, weight) rows, one per component: (first, bin, split)."""
    spark = parts.sparkSession
    n = parts.count()
    n_groups = max(1, -(-n // group_size))
    dealt = parts.select("first", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.pmod(F.xxhash64("first"), F.lit(n_groups)).alias("node"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((len(pdf), n_bins))
        v[:, 0] = pdf["weight"]
        _, where = differencing(v)
        return pd.DataFrame({"first": pdf["first"], "weight": pdf["weight"], "node": pdf["node"], "bin": where[:, 0]})

    placed, _ = scratch.cut(dealt.groupBy("node").applyInPandas(pack, "first long, weight double, node long, bin long"))
    bins = placed.groupBy("node", "bin").agg(F.sum("weight").alias("weight"))
    route = placed.select("first", "node", "bin")
    while n_groups > 1:

        def combine(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes, at = np.unique(pdf["node"], return_inverse=True)
            v = np.zeros((len(nodes), n_bins))
            v[at, pdf["bin"]] = pdf["weight"]
            _, where = differencing(v)
            return pd.DataFrame({"node": np.repeat(nodes, n_bins), "bin": np.tile(np.arange(n_bins), len(nodes)), "weight": v.ravel(), "up": int(pdf["up"].iloc[0]), "to": where.ravel()})

        moved, _ = scratch.cut(bins.withColumn("up", F.floor(F.col("node") / fan_in)).groupBy("up").applyInPandas(combine, "node long, bin long, weight double, up long, to long"))
        route = route.join(moved.select("node", "bin", "up", "to"), ["node", "bin"]).select("first", F.col("up").alias("node"), F.col("to").alias("bin"))
        bins = moved.groupBy(F.col("up").alias("node"), F.col("to").alias("bin")).agg(F.sum("weight").alias("weight"))
        n_groups = -(-n_groups // fan_in)
    sums = np.zeros(n_bins)  # at most n_bins rows reach the driver
    for r in bins.collect():
        sums[r.bin] = r.weight
    names = list(shares)
    split_of = [names[i] for i in allot(sums, np.array([shares[s] for s in names]))]
    return route.select("first", F.col("bin").cast("int").alias("bin"), F.get(F.array(*[F.lit(s) for s in split_of]), F.col("bin")).alias("split"))


def linked_splits(rows: DataFrame, id: Column, weight: Column, keys: list[Column], shares: dict[str, float], **options) -> DataFrame:
    """(id, first, split): rows that share a key, directly or through others, have the same `first` and `split`."""
    keyed = rows.select(id.alias("id"), weight.alias("weight"), F.array(*[F.when(k.isNotNull(), F.concat(F.lit(f"{i}:"), k)) for i, k in enumerate(keys)]).alias("keys"))
    members, _ = scratch.cut(keyed.where(F.col("id").isNotNull()))
    groups = components(members.select("id", F.explode("keys").alias("key")))
    units = members.groupBy("id").agg(F.max("weight").alias("weight")).join(groups, "id", "left").select("id", F.coalesce("first", "id").alias("first"), "weight")
    units, _ = scratch.cut(units)
    return units.join(balanced(units.groupBy("first").agg(F.sum("weight").alias("weight")), shares, **options), "first").select("id", "first", "bin", "split")

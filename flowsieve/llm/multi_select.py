"""Exact percentiles per group, and per every merger of groups, by distributed multi-select (error bound: 0).

The rows are narrowed once to a summary table: a 64-bit hash per grouping column and the usable values. It is the
mergeable state: summaries of separate partitions or days are appended, and every percentile of their union follows.

Every group of more than `finish_rows` values goes through the rounds: each partition sorts what it holds and proposes
the median of the values it has inside a target's active range, weighted by their number; the weighted median of the
proposals becomes the pivot; the next scan counts the values below and at the pivot, discards the part that cannot hold
the wanted rank, and brings proposals for either side along, so that a round is one scan for all targets. A range, or a
whole group, of at most `finish_rows` values is finished by sending its values, as packed sorted runs, to one task.

The driver holds only pivots and counts of one batch of groups (`batch` of them); the values stay where they are, and
the answers of a batch are written to the shared folder. The weighted median discards at least a quarter of a range each
round, so the rounds are logarithmic. Tasks work in chunks of bounded memory.

Defined results: null, NaN, infinite and out-of-range values are left out; a group without usable values has n = 0 and
null percentiles; a null grouping column is a group of its own (`grouping_id` tells it from a merger); ties count as
often as they occur; percentiles are interpolated linearly between neighbouring ranks; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve import scratch


def _set_salt(s: int) -> int:
    x = (s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def _gids(hashes: np.ndarray, s: int) -> np.ndarray:
    """Group ids under grouping set `s` (bit i: column i is kept) of rows given by their columns' hashes."""
    out = np.full(len(hashes), _set_salt(s), dtype=np.int64)
    for i in range(hashes.shape[1]):
        if s >> i & 1:
            out ^= hashes[:, i]
    return out


def _interpolated(ordered: np.ndarray, percents: list[float]) -> list[float]:
    at = np.asarray(percents) * (len(ordered) - 1)
    low = np.floor(at).astype(np.int64)
    a, b = ordered[low], ordered[np.minimum(low + 1, len(ordered) - 1)]
    return list(a + (b - a) * (at - low))


class _Part:
    """One partition's rows: base groups as codes, and each metric sorted by value."""

    def __init__(self, batches: Iterator[pd.DataFrame], n_dims: int, n_metrics: int):
        frames = [b for b in batches if len(b)]
        pdf = pd.concat(frames, ignore_index=True) if frames else None
        self.rows = 0 if pdf is None else len(pdf)
        if not self.rows:
            return
        hashes = pdf[[f"d{i}" for i in range(n_dims)]].to_numpy(np.int64)
        mixed = np.zeros(self.rows, dtype=np.int64)
        for i in range(n_dims):
            mixed ^= np.left_shift(hashes[:, i], i) ^ np.right_shift(hashes[:, i], 7 * i + 3)
        _, first, code = np.unique(mixed, return_index=True, return_inverse=True)
        self.base = hashes[first]
        self.metrics = []
        for m in range(n_metrics):
            v = pdf[f"v{m}"].to_numpy(np.float64)
            order = np.argsort(v, kind="stable")
            order = order[: np.count_nonzero(~np.isnan(v))]
            v = v[order]
            new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=bool)
            self.metrics.append((v, code[order], np.cumsum(new) - 1, v[new]))

    def runs(self, s: int, m: int, wanted: np.ndarray | None, skip: np.ndarray | None = None):
        """(group ids, their bounds, values sorted within each group, search keys) of one grouping set and metric."""
        values, code, ranks, distinct = self.metrics[m]
        gid_of_base = _gids(self.base, s)
        gids, dense = np.unique(gid_of_base, return_inverse=True)
        if wanted is not None or skip is not None:
            keep = np.isin(gids, wanted) if wanted is not None else ~np.isin(gids, skip)
            place = np.where(keep, np.cumsum(keep) - 1, -1)
            gids, dense = gids[keep], place[dense]
        group = dense[code]
        if len(group) and (group < 0).any():
            kept = group >= 0
            group, values, ranks = group[kept], values[kept], ranks[kept]
        if len(gids) < 32000:
            group = group.astype(np.int16)  # a stable sort of small integers is a radix sort
        order = np.argsort(group, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(gids)))])
        keys = group[order].astype(np.int64) * (len(distinct) + 1) + ranks[order]
        return gids, bounds, values[order], (keys, distinct)


def _chunks(batches: Iterator[pd.DataFrame], n_dims: int, n_metrics: int, rows: int = 1 << 20) -> Iterator[_Part]:
    """A partition in chunks of bounded memory; counts, medians and runs of chunks are combined like those of partitions."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= rows:
            yield _Part(iter(held), n_dims, n_metrics)
            held, size = [], 0
    if size:
        yield _Part(iter(held), n_dims, n_metrics)


def _within(search: tuple[np.ndarray, np.ndarray], which: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
    """For each (group, x): the position among the grouped sorted values where x belongs."""
    keys, distinct = search
    return np.searchsorted(keys, which.astype(np.int64) * (len(distinct) + 1) + np.searchsorted(distinct, x, side=side))


def _whole_keys(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by `key`, regrouped so that no key is spread over two frames; holds one batch and one key at a time."""
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        keys = pdf[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pdf.iloc[:cut]
        held = pdf.iloc[cut:]
    if held is not None:
        yield held


def percentiles(
    rows: DataFrame, dims: list[str], values: dict[str, Column], percents: list[float], finish_rows: int = 1024, batch: int = 20_000, known_ids: int = 1_000_000
) -> DataFrame:
    """Columns: dims (null where merged), grouping_id (bit i set: dims[i] is merged), metric, n, q (array of doubles).

    `known_ids`: up to so many groups that went through the rounds are told to the finishing tasks (8 bytes each); beyond
    it their runs are taken out by a join.
    """
    spark = rows.sparkSession
    k, names = len(dims), list(values)
    n_m = len(names)
    sets = list(range(1 << k))
    hashed = [F.xxhash64(F.lit(i), F.col(f"k{i}")).alias(f"d{i}") for i in range(k)]
    narrow = rows.select(*[F.col(d).alias(f"k{i}") for i, d in enumerate(dims)], *[values[n].cast("double").alias(f"v{m}") for m, n in enumerate(names)])
    d_cols, v_cols = [f"d{i}" for i in range(k)], [f"v{m}" for m in range(n_m)]
    summary, _ = scratch.cut(narrow.select(*hashed, *v_cols))
    base = narrow.groupBy(*[f"k{i}" for i in range(k)]).agg(*[F.count(v).alias("n_" + v) for v in v_cols]).select("*", *hashed)

    def gid(s: int) -> Column:
        out = F.lit(_set_salt(s)).cast("long")
        for i in range(k):
            if s >> i & 1:
                out = out.bitwiseXOR(F.col(f"d{i}"))
        return out

    def cube_row(s: int) -> Column:
        kept = [F.when(F.lit(bool(s >> i & 1)), F.col(f"k{i}")).alias(f"k{i}") for i in range(k)]
        return F.struct(F.lit(s).alias("s"), gid(s).alias("gid"), *kept)

    keys = [f"k{i}" for i in range(k)]
    cube = (
        base.select(F.explode(F.array(*[cube_row(s) for s in sets])).alias("c"), *["n_" + v for v in v_cols])
        .groupBy("c.s", "c.gid", *[F.col(f"c.{x}") for x in keys])
        .agg(*[F.sum("n_" + v).alias("n_" + v) for v in v_cols])
    )
    cube, _ = scratch.cut(cube.select("s", "gid", *keys, *["n_" + v for v in v_cols]))
    most = F.greatest(*[F.col("n_" + v) for v in v_cols]) if n_m > 1 else F.col("n_" + v_cols[0])
    shape = "gid long, metric int, n long, q array<double>"
    large = cube.where(most > finish_rows).select("s", "gid", *["n_" + v for v in v_cols])
    n_large = large.count()
    n_batches = -(-n_large // batch)
    answered = []
    for b in range(n_batches):
        found = large.where(F.pmod("gid", F.lit(n_batches)) == b).collect()
        if found:
            answered.append(scratch.cut(spark.createDataFrame(_rounds(spark, summary, found, k, n_m, percents, finish_rows), shape))[0])

    told = n_large <= known_ids
    skip = np.sort(np.array([r.gid for r in large.select("gid").collect()], dtype=np.int64)) if told else np.zeros(0, dtype=np.int64)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, m, s in ((part, m, s) for part in _chunks(batches, k, n_m) for m in range(n_m) for s in sets):
            gids, bounds, ordered, _ = part.runs(s, m, None, skip)
            few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) <= finish_rows))  # a longer run belongs to a large group
            if len(few):
                yield pd.DataFrame({"gid": gids[few], "metric": m, "run": [ordered[bounds[x] : bounds[x + 1]].tobytes() for x in few]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, m, runs in zip(pdf["gid"], pdf["metric"], pdf["runs"]):
                v = np.sort(np.frombuffer(b"".join(runs), dtype=np.float64))
                out.append((g, m, len(v), _interpolated(v, percents)))
            yield pd.DataFrame(out, columns=["gid", "metric", "n", "q"])

    runs = summary.mapInPandas(gather, "gid long, metric int, run binary")
    if not told:
        runs = runs.join(large.select("gid"), "gid", "left_anti")
    answers = runs.groupBy("gid", "metric").agg(F.collect_list("run").alias("runs")).mapInPandas(finish, shape)  # at most finish_rows values each
    for a in answered:
        answers = answers.unionAll(a)
    metric = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(n).alias("name"), F.col(f"n_v{m}").alias("n")) for m, n in enumerate(names)])).alias("x")
    groups = cube.select("s", "gid", *keys, metric).select("s", "gid", *keys, F.col("x.metric").alias("metric"), F.col("x.name").alias("name"), F.col("x.n").alias("n"))
    full = (1 << k) - 1
    return groups.join(answers.drop("n"), ["gid", "metric"], "left").select(
        *[F.col(f"k{i}").alias(d) for i, d in enumerate(dims)], (F.lit(full) - F.col("s")).cast("int").alias("grouping_id"), F.col("name").alias("metric"), "n", "q"
    )


def _rounds(spark, summary: DataFrame, groups: list, k: int, n_m: int, percents: list[float], finish_rows: int) -> list[tuple]:
    """Multi-select for the given large groups: rows (gid, metric, n, percentiles)."""
    targets = []  # gid, set, metric, n, rank
    for r in groups:
        for m in range(n_m):
            n = r[f"n_v{m}"]
            if n:
                at = np.floor(np.asarray(percents) * (n - 1)).astype(int)
                targets += [(r.gid, r.s, m, n, int(rank)) for rank in sorted({*at, *np.minimum(at + 1, n - 1)})]
    if not targets:
        return []
    gid, set_, metric, total, rank = (np.array(x, dtype=np.int64) for x in zip(*targets))
    low, high = np.full(len(rank), -np.inf), np.full(len(rank), np.inf)
    below, inside = np.zeros(len(rank), dtype=np.int64), total.copy()  # values <= low; values strictly between low and high
    pivot, value = np.full(len(rank), np.nan), np.full(len(rank), np.nan)
    shape = "rid int, lt long, eq long, wl long, ml double, wr long, mr double"

    def ranges(which: np.ndarray):
        """Distinct active ranges of the targets `which`: as a table, and the row of it for each target."""
        table = pd.DataFrame({"gid": gid[which], "s": set_[which], "m": metric[which], "low": low[which], "high": high[which], "pivot": pivot[which]})
        codes = table.groupby(list(table.columns), sort=False, dropna=False).ngroup().to_numpy()
        return table.iloc[np.unique(codes, return_index=True)[1]].reset_index(drop=True), codes

    def scan(table: pd.DataFrame):
        cols = {c: table[c].to_numpy() for c in table.columns}
        cells = {key: np.array(ids) for key, ids in table.groupby(["s", "m"]).indices.items()}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, (s, m), ids in ((part, *cell) for part in _chunks(batches, k, n_m) for cell in cells.items()):
                gids, bounds, ordered, search = part.runs(int(s), int(m), np.unique(cols["gid"][ids]))
                if not len(ordered):
                    continue
                here = ids[np.isin(cols["gid"][ids], gids)]
                g = np.searchsorted(gids, cols["gid"][here])
                a = _within(search, g, cols["low"][here], "right")
                z = _within(search, g, cols["high"][here], "left")
                p = cols["pivot"][here]
                opening = np.isnan(p)  # no pivot yet: propose for the whole range
                x = np.where(opening, z, _within(search, g, np.where(opening, 0, p), "left"))
                y = np.where(opening, z, _within(search, g, np.where(opening, 0, p), "right"))
                last = len(ordered) - 1
                yield pd.DataFrame({
                    "rid": here.astype(np.int32), "lt": x - a, "eq": y - x,
                    "wl": x - a, "ml": ordered[np.clip(a + np.maximum(x - a - 1, 0) // 2, 0, last)],
                    "wr": z - y, "mr": ordered[np.clip(y + np.maximum(z - y - 1, 0) // 2, 0, last)],
                })

        return run

    def weighted(rid: np.ndarray, w: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        order = np.lexsort((v, rid))
        rid, w, v = rid[order], w[order], v[order]
        total_w, run = np.bincount(rid, w, n), np.cumsum(w)
        start = np.concatenate([[0], np.cumsum(total_w)])[:-1]
        hit = (run - start[rid]) * 2 >= total_w[rid]
        out = np.full(n, np.nan)
        out[rid[hit][::-1]] = v[hit][::-1]
        out[total_w == 0] = np.nan
        return out

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in _whole_keys(batches, "rid"):
            ids, rid = np.unique(t["rid"], return_inverse=True)
            n = len(ids)
            total_of = lambda c: np.bincount(rid, t[c], n).astype(np.int64)
            sides = {c: weighted(rid[(w := t["w" + c].to_numpy()) > 0], w[w > 0], t["m" + c].to_numpy()[w > 0], n) for c in "lr"}
            yield pd.DataFrame({"rid": ids.astype(np.int32), "lt": total_of("lt"), "eq": total_of("eq"), "wl": total_of("wl"), "ml": sides["l"], "wr": total_of("wr"), "mr": sides["r"]})

    active = np.arange(len(rank))[inside > finish_rows]
    while len(active):
        table, code = ranges(active)
        got = summary.mapInPandas(scan(table), shape).repartition("rid").sortWithinPartitions("rid").mapInPandas(merge, shape).toPandas().set_index("rid").reindex(range(len(table))).iloc[code]
        lt, eq, ml, mr = got["lt"].to_numpy(np.int64), got["eq"].to_numpy(np.int64), got["ml"].to_numpy(), got["mr"].to_numpy()
        p, wanted = pivot[active], rank[active] - below[active]  # rank within the range, from 0
        opening = np.isnan(p)
        left, at = ~opening & (wanted < lt), ~opening & (wanted >= lt) & (wanted < lt + eq)
        right = ~opening & (wanted >= lt + eq)
        value[active[at]] = p[at]
        high[active[left]], inside[active[left]] = p[left], lt[left]
        low[active[right]] = p[right]
        below[active[right]] += (lt + eq)[right]
        inside[active[right]] -= (lt + eq)[right]
        pivot[active] = np.where(opening | left, ml, mr)
        active = active[~at & (inside[active] > finish_rows)]
    rest = np.arange(len(rank))[np.isnan(value)]
    if len(rest):
        pivot[rest] = np.nan
        table, code = ranges(rest)
        cols = {c: table[c].to_numpy() for c in table.columns}
        cells = {key: np.array(ids) for key, ids in table.groupby(["s", "m"]).indices.items()}
        wanted_of = pd.Series(rank[rest] - below[rest]).groupby(code).agg(lambda x: sorted(set(x))).to_dict()

        def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, (s, m), ids in ((part, *cell) for part in _chunks(batches, k, n_m) for cell in cells.items()):
                gids, bounds, ordered, search = part.runs(int(s), int(m), np.unique(cols["gid"][ids]))
                if len(ordered):
                    here = ids[np.isin(cols["gid"][ids], gids)]
                    g = np.searchsorted(gids, cols["gid"][here])
                    a = _within(search, g, cols["low"][here], "right")
                    z = _within(search, g, cols["high"][here], "left")
                    some = z > a
                    yield pd.DataFrame({"rid": here[some].astype(np.int32), "run": [ordered[i:j].tobytes() for i, j in zip(a[some], z[some])]})

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for rid, runs in zip(pdf["rid"], pdf["runs"]):
                    v = np.sort(np.frombuffer(b"".join(runs), dtype=np.float64))
                    out += [(rid, w, v[w]) for w in wanted_of[rid]]
                yield pd.DataFrame(out, columns=["rid", "w", "v"])

        ranges_left = summary.mapInPandas(collect, "rid int, run binary").groupBy("rid").agg(F.collect_list("run").alias("runs"))  # at most finish_rows values each
        picked = ranges_left.mapInPandas(pick, "rid int, w long, v double").toPandas()
        answer = dict(zip(zip(picked["rid"], picked["w"]), picked["v"]))
        value[rest] = [answer[c, w] for c, w in zip(code, rank[rest] - below[rest])]
    out = []
    stats = {(g, m, r): v for g, m, r, v in zip(gid.tolist(), metric.tolist(), rank.tolist(), value.tolist())}
    for r in groups:
        for m in range(n_m):
            n = r[f"n_v{m}"]
            if n:
                at = np.asarray(percents) * (n - 1)
                lo = np.floor(at).astype(int)
                a = np.array([stats[r.gid, m, int(x)] for x in lo])
                z = np.array([stats[r.gid, m, int(min(x + 1, n - 1))] for x in lo])
                out.append((r.gid, m, n, [float(x) for x in a + (z - a) * (at - lo)]))
    return out

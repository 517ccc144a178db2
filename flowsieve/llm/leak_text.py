"""Evaluation passages inside a training corpus: latent semantic retrieval, then subsequence and answer checks.

1. Words. Each document is tokenised once and written as codes of the test items' words (their number is fixed by the
   held-out set); words outside this vocabulary share one code. Document frequencies are counted over all documents.
2. Passages, of two lengths: consecutive tiles of `shared` / 2 words, and passages of 2 * `shared` words that overlap by
   half. Of each test item all windows of a tile's length are taken, and windows of the longer length at every
   `shared` / 2 words. A run of `shared` common words holds at least one whole tile of the document, which then equals a
   window of the item; a paraphrase shares most words of a longer passage with an item, though no six in a row.
3. A distributed randomised SVD (range finder with power iterations; each partition adds up its part of A'AW, partial
   sums meet in a shuffle by word) of the items' tiles and all tiles of the corpus that are searched.
4. Candidates: passages whose words lie mostly in the vocabulary are compared, in blocks, with the windows of the fixed
   held-out set in the space of the leading singular vectors; a tile is a candidate from `cosine` on, a longer passage
   from `cosine_long` on. Equal passages have equal vectors, hence cosine 1: no exact copy is lost. The windows' vectors
   are the only thing sent to all executors; their number is fixed by the held-out set.
5. Checks, in the same task. For tiles: the longest common subsequence of the item and the stretch of the document that
   its alignment covers must have `shared` words; then the longest run of common words along it is exact. For longer
   passages: the share of the item's answers (numbers and names) that the stretch repeats, then the longest common
   subsequence as a share of the item. `kind` is verbatim or paraphrase.

Defined results: words are runs of letters and digits without case; null, empty or short texts give no rows; repeated
texts and repeated items each give their own rows; very long texts are searched whole; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve import scratch

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _tiles(tokens: np.ndarray, size: int) -> np.ndarray:
    """Consecutive passages of `size` words, one per row; the rest of the text is covered by its runs' other passages."""
    n = len(tokens) // size
    return tokens[: n * size].reshape(n, size)


def _windows(tokens: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(tokens, size) if len(tokens) >= size else np.zeros((0, size), dtype=tokens.dtype)


def _starts(n: int, size: int, step: int) -> np.ndarray:
    """Starts of overlapping passages that cover n words, the last one flush with the end."""
    if n < size:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(0, n - size + 1, step)
    return at if at[-1] == n - size else np.append(at, n - size)


def _project(passages: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum of the words' weighted basis rows; words outside the vocabulary (last row) add nothing."""
    out = np.zeros((len(passages), basis.shape[1]), dtype=basis.dtype)
    for j in range(passages.shape[1]):
        t = passages[:, j]
        out += weights[t][:, None] * basis[t]
    return out


def fit_svd(passages: DataFrame, weights: np.ndarray, rank: int, oversample: int = 10, power: int = 2, seed: int = 11) -> np.ndarray:
    """Right singular vectors (words + 1 rows; the last, for unknown words, is zero) of the passages' TF-IDF matrix."""
    n_words = len(weights) - 1
    width = min(rank + oversample, n_words)
    shape = "word int, part array<double>"

    def times(basis: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((n_words + 1, width))
            for pdf in batches:
                if len(pdf):
                    t = np.stack(pdf["codes"].to_numpy()).astype(np.int64)
                    x = _project(t, weights, basis)
                    for j in range(t.shape[1]):
                        order = np.argsort(t[:, j], kind="stable")
                        ids, start = np.unique(t[order, j], return_index=True)
                        total[ids] += np.add.reduceat(x[order] * weights[t[order, j]][:, None], start, axis=0)
            some = np.flatnonzero(np.abs(total[:n_words]).sum(axis=1))
            if len(some):
                yield pd.DataFrame({"word": some.astype(np.int32), "part": list(total[some])})

        sums = passages.mapInPandas(run, shape).groupBy("word").agg(*[F.sum(F.get("part", F.lit(i))).alias(f"x{i}") for i in range(width)]).toPandas()
        out = np.zeros((n_words + 1, width))
        if len(sums):
            out[sums["word"].to_numpy()] = sums[[f"x{i}" for i in range(width)]].to_numpy()
        return out

    basis = np.zeros((n_words + 1, width))
    basis[:n_words] = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_words, width)))[0]
    for _ in range(power):
        basis[:n_words] = np.linalg.qr(times(basis)[:n_words])[0]
    small = basis.T @ times(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[: min(rank, width)]]


def _subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    place: dict[str, int] = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & place.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - bin(v).count("1")


def _longest_run(equal: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    shared: int = 12,
    rank: int = 64,
    cosine: float = 0.95,
    cosine_long: float = 0.6,
    least_known: float = 0.6,
    least_known_long: float = 0.4,
    paraphrase_passages: int = 1,
    least_subsequence: float = 0.5,
    least_answers: float = 0.5,
    verbatim_only: bool = False,
) -> DataFrame:
    """doc_id, item_id, kind, longest_run, subsequence (share of the item), answers (share of its numbers and names)."""
    spark = documents.sparkSession
    tile, long = shared // 2, 2 * shared
    shape = "doc_id long, item_id long, kind string, longest_run int, subsequence double, answers double"
    held = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).toPandas()  # the fixed held-out set
    item_words = [words(t) for t in held["t"]]
    some = [k for k, ws in enumerate(item_words) if len(ws) >= tile]
    if not some:
        return spark.createDataFrame([], shape)
    item_ids, item_words = [int(held["i"][k]) for k in some], [item_words[k] for k in some]
    code = {w: k for k, w in enumerate(sorted({w for ws in item_words for w in ws}))}
    other = len(code)
    item_codes = [np.array([code[w] for w in ws], dtype=np.int32) for ws in item_words]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = code.get
        for pdf in batches:
            coded = [np.array([get(w, other) for w in words(t)], dtype=np.int32).tobytes() for t in pdf["t"]]
            yield pd.DataFrame({"d": pdf["d"], "codes": coded})

    docs, _ = scratch.cut(documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInPandas(encode, "d long, codes binary"))
    read = lambda pdf: [np.frombuffer(b, dtype=np.int32) for b in pdf["codes"]]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(other + 1, dtype=np.int64)
        for pdf in batches:
            n += len(pdf)
            for c in read(pdf):
                df[np.unique(c)] += 1
        df[other] = n  # the last place counts the documents
        yield pd.DataFrame({"k": np.flatnonzero(df).astype(np.int32), "n": df[df > 0]})

    df = {r.k: r.n for r in docs.mapInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # one row per word of the held-out set
    n_docs = df.get(other, 0)
    inner = np.zeros(other + 1)
    inner[:other] = [1 + np.log((n_docs + 1) / (df.get(k, 0) + 1)) for k in range(other)]
    squared = inner**2
    squared[other] = squared[:other].mean()  # a word that no item holds weighs like an ordinary one
    known_share = lambda t: 1 - squared[other] * (t == other).sum(axis=1) / squared[t].sum(axis=1)
    own = np.concatenate([_windows(t, tile) for t in item_codes])
    owner = np.repeat(np.arange(len(item_codes)), [len(_windows(t, tile)) for t in item_codes])
    at = np.concatenate([np.arange(len(_windows(t, tile))) for t in item_codes])
    at_long = [_starts(len(t), long, tile) if len(t) >= long else np.zeros(1, dtype=np.int64) for t in item_codes]
    padded = [t if len(t) >= long else np.concatenate([t, np.full(long - len(t), other, dtype=np.int32)]) for t in item_codes]
    own_long = np.concatenate([_windows(t, long)[s] for t, s in zip(padded, at_long)])
    owner_long = np.repeat(np.arange(len(item_codes)), [len(s) for s in at_long])

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = [x for x in (_tiles(c, tile) for c in read(pdf)) if len(x)]
            if t:
                t = np.concatenate(t)
                t = t[known_share(t) >= least_known]
                if len(t):
                    yield pd.DataFrame({"codes": list(t)})

    passages = docs.mapInPandas(searched, "codes array<int>")
    training, training_path = scratch.cut(passages.unionAll(spark.createDataFrame(pd.DataFrame({"codes": own.tolist()}), "codes array<int>")))
    basis = fit_svd(training, inner, rank).astype(np.float32)
    scratch.drop(spark, training_path)
    light = inner.astype(np.float32)

    def unit(passages: np.ndarray) -> np.ndarray:
        z = _project(passages, light, basis)
        norm = np.sqrt((z * z).sum(axis=1))
        flat = norm < 1e-9  # passages without any direction are only like each other
        z = np.concatenate([z / np.where(flat, 1, norm)[:, None] * ~flat[:, None], flat[:, None].astype(np.float32)], axis=1)
        return z.astype(np.float32)

    queries = spark.sparkContext.broadcast((unit(own).T.copy(), unit(own_long).T.copy()))
    numbered = [{code[w] for w in ws if any(c.isdigit() for c in w)} for ws in item_words]

    def near(t: np.ndarray, wall: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo in range(0, len(t), 1024):  # blocks of passages against the held-out windows
            a, b = np.nonzero(unit(t[lo : lo + 1024]) @ wall >= least)
            yield a + lo, b

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wall, wall_long = queries.value
        for pdf in batches:
            coded = read(pdf)
            verbatim: dict[tuple[int, int], set[int]] = {}  # (document, item): alignments, that is differences of positions
            alike: dict[tuple[int, int], list[int]] = {}
            count = [len(c) // tile for c in coded]
            if sum(count):
                t = np.concatenate([_tiles(c, tile) for c in coded])
                doc = np.repeat(np.arange(len(pdf)), count)
                pos = np.concatenate([np.arange(c) * tile for c in count])
                keep = np.flatnonzero((t != other).all(axis=1))
                t, doc, pos = t[keep], doc[keep], pos[keep]
                for a, b in near(t, wall, cosine):
                    same = (t[a] == own[b]).all(axis=1)
                    for d, i, x in zip(doc[a[same]].tolist(), owner[b[same]].tolist(), (pos[a[same]] - at[b[same]]).tolist()):
                        verbatim.setdefault((d, i), set()).add(x)
            starts = [_starts(len(c), long, shared) for c in coded] if not verbatim_only else []
            if sum(map(len, starts)):
                doc = np.repeat(np.arange(len(pdf)), [len(s) for s in starts])
                pos = np.concatenate(starts)
                t = np.concatenate([_windows(c, long)[s] for c, s in zip(coded, starts) if len(s)])
                keep = np.flatnonzero(known_share(t) >= least_known_long)
                t, doc, pos = t[keep], doc[keep], pos[keep]
                places = np.concatenate(at_long)
                for a, b in near(t, wall_long, cosine_long):
                    for d, i, x in zip(doc[a].tolist(), owner_long[b].tolist(), (pos[a] - places[b]).tolist()):
                        alike.setdefault((d, i), []).append(x)
            out = []
            numbers: dict[int, set[int]] = {}
            for d, i in verbatim.keys() | alike.keys():
                mine, theirs = coded[d], item_codes[i]
                n, longest, sub = len(theirs), 0, 0
                for x in verbatim.get((d, i), ()):
                    lo, hi = max(0, x), min(len(mine), x + n)
                    common = _subsequence(theirs.tolist(), mine[lo:hi].tolist())
                    sub = max(sub, common)
                    if common >= shared:
                        longest = max(longest, _longest_run(mine[lo:hi] == theirs[lo - x : hi - x]))
                if longest < shared:
                    hits = alike.get((d, i), [])
                    if verbatim_only or len(hits) < paraphrase_passages:
                        continue
                    if d not in numbers:
                        numbers[d] = set(np.unique(mine).tolist())
                    if numbered[i] and len(numbered[i] & numbers[d]) < least_answers * len(numbered[i]):
                        continue
                    # the alignment that most hits agree on; its stretch is looked at with an item's length on either side
                    hits = np.unique(hits)
                    best = int(hits[np.argmax(np.searchsorted(hits, hits + n // 2) - np.arange(len(hits)))])
                else:
                    best = min(verbatim[d, i], key=abs) if len(verbatim[d, i]) == 1 else int(np.median(list(verbatim[d, i])))
                stretch = mine[max(0, best - n) : max(0, best + 2 * n)]
                ans = len(numbered[i] & set(stretch.tolist())) / len(numbered[i]) if numbered[i] else 1.0  # an item without answers is judged by its words
                sub = max(sub, _subsequence(theirs.tolist(), stretch.tolist())) / n
                if longest >= shared:
                    out.append((int(pdf["d"].iloc[d]), item_ids[i], "verbatim", longest, sub, ans))
                elif sub >= least_subsequence and ans >= least_answers:
                    out.append((int(pdf["d"].iloc[d]), item_ids[i], "paraphrase", longest, sub, ans))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind", "longest_run", "subsequence", "answers"])

    return docs.mapInPandas(search, shape)

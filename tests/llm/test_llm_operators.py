"""The operators of the llm subpackage against brute force and on edge cases."""

import itertools
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowsieve.llm import leak_text, linked_splits, packing, residue, target_sample  # noqa: E402
from flowsieve.llm.leak_rows import near_pairs  # noqa: E402
from flowsieve.llm.multi_select import percentiles  # noqa: E402

NAN, INF = float("nan"), float("inf")

# --- 1: percentiles

P = [0.01, 0.25, 0.5, 0.99]


def asked(spark, rows, **options):
    df = spark.createDataFrame(rows, "a string, b string, v double, w double").withColumn("d0", F.lit("clash")).repartition(5)
    out = percentiles(df, ["a", "b"], {"v": F.when(F.col("v").between(0, 1), F.col("v")), "w": F.col("w")}, P, **options)
    return {(r.a, r.b, r.grouping_id, r.metric): (r.n, r.q) for r in out.collect()}


@pytest.mark.parametrize("options", [{}, {"finish_rows": 50}, {"finish_rows": 5}, {"finish_rows": 1, "batch": 2, "known_ids": 3}])
def test_percentiles_against_numpy(spark, options):
    rng = random.Random(5)
    value = lambda: rng.choice([None, NAN, -1.0, 2.0, INF, 0.0, 0.5, 1.0, rng.random(), rng.random() ** 4])
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice(["p", "q", None]), value(), rng.choice([1.0, 2.0, None])) for _ in range(900)]
    got = asked(spark, rows, **options)
    want = {}
    for a, b, v, w in rows:
        for keep_a, keep_b in itertools.product((0, 1), repeat=2):
            key = (a if keep_a else None, b if keep_b else None, (1 - keep_a) + 2 * (1 - keep_b))
            for m, x in (("v", v if v is not None and 0 <= v <= 1 else None), ("w", w)):
                want.setdefault((*key, m), []).extend([] if x is None else [x])
    assert set(got) == set(want)
    for k, xs in want.items():
        assert got[k][0] == len(xs)
        assert got[k][1] == pytest.approx(list(np.quantile(xs, P))) if xs else got[k][1] is None


def test_every_large_group_goes_through_the_rounds(spark, monkeypatch):
    from flowsieve.llm import multi_select

    rounds, seen = multi_select._rounds, []
    monkeypatch.setattr(multi_select, "_rounds", lambda spark, summary, groups, *a: seen.extend(groups) or rounds(spark, summary, groups, *a))
    rows = [("xy"[i % 2], "pqr"[i % 3], (i * 37 % 1001) / 1001, None) for i in range(6000)]
    got = asked(spark, rows)
    assert len(seen) == 6 and all(v[0] >= 1000 for v in got.values() if v[0])  # x, y, p, q, r and all; the six of 1,000 values are finished at once
    assert got[None, None, 3, "v"][1] == pytest.approx(list(np.quantile([r[2] for r in rows], P)))


def test_percentiles_empty_and_without_values(spark):
    assert asked(spark, []) == {}
    assert asked(spark, [("x", "p", None, None)])["x", "p", 0, "v"] == (0, None)


# --- 3: linked splits


def test_components_against_union_find(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 300), rng.choice([None, f"k{rng.randint(1, 260)}"])) for _ in range(500)] + [(i, "chain%d" % (i // 2)) for i in range(400, 460)] + [(i, "chain%d" % ((i + 1) // 2)) for i in range(400, 460)]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, g in itertools.groupby(sorted((k, i) for i, k in rows if k), key=lambda x: x[0]):
        ids = [i for _, i in g]
        for i in ids[1:]:
            parent[max(find(i), find(ids[0]))] = min(find(i), find(ids[0]))
    want = {(i, find(i)) for i in parent if find(i) != i}
    got = {tuple(r) for r in linked_splits.components(spark.createDataFrame(rows, "id long, key string").withColumn("u", F.lit(1))).collect()}
    assert got == want


def test_components_hub_and_empty(spark):
    hub = spark.range(1, 3000).select("id", F.lit("one").alias("key"))
    got = linked_splits.components(hub).collect()
    assert len(got) == 2998 and {r.first for r in got} == {1}
    assert linked_splits.components(spark.createDataFrame([], "id long, key string")).count() == 0


def test_split_keeps_groups_and_shares(spark):
    rows = spark.range(3000).select("id", (F.pmod(F.hash("id"), F.lit(50)) + 1).alias("w"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), F.floor(F.col("id") / 30))).alias("key"), F.lit("clash").alias("first"))
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    out = linked_splits.linked_splits(rows, F.col("id"), F.col("w"), [F.col("key")], shares, n_bins=20, group_size=200, fan_in=3).toPandas()
    assert len(out) == 3000 and (out.groupby("first")["split"].nunique() == 1).all()
    w = out.merge(rows.select("id", "w").toPandas(), on="id")
    got = w.groupby("split")["w"].sum() / w["w"].sum()
    assert all(abs(got[s] - x) < 0.01 for s, x in shares.items())
    bins = w.groupby("bin")["w"].sum()
    assert bins.max() - bins.min() < 0.05 * bins.mean()


def test_split_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, None, None), (2, -5, "a"), (3, 7, "a"), (3, 7, "a"), (None, 1, "a")], "id long, w long, key string")
    out = {r.id: r.first for r in linked_splits.linked_splits(rows, F.col("id"), F.col("w"), [F.col("key")], {"train": 0.5, "test": 0.5}).collect()}
    assert out == {1: 1, 2: 2, 3: 2}
    assert linked_splits.linked_splits(rows.where("false"), F.col("id"), F.col("w"), [F.col("key")], {"train": 1.0}).count() == 0


# --- 4: near rows


def brute_pairs(rows, n):
    def agree(x, y):
        fx, fy = (v is not None and abs(v) < INF and v == v for v in (x, y))
        return abs(x - y) <= 0.002 * max(abs(x), abs(y)) if fx and fy else not fx and not fy

    side = [(i, s.strip().lower(), v) for i, s, v in rows if s]
    return {(a[0], b[0]) for a in side if a[1] == "train" for b in side if b[1] in ("val", "test") and sum(agree(x, y) for x, y in zip(a[2], b[2])) >= n - 2}


@pytest.mark.parametrize("hot", [2_000_000, 0, 40])
def test_near_pairs_against_brute_force(spark, hot):
    rng = random.Random(7)
    base = [[rng.choice([None, NAN, INF, 0.0, -3.0, rng.lognormvariate(3, 2), float(rng.randint(1, 4))]) for _ in range(14)] for _ in range(60)]
    rows = []
    for i in range(420):
        v = list(rng.choice(base))
        for k in rng.sample(range(14), rng.choice([0, 1, 2, 3])):
            v[k] = rng.choice([None, 0.0, 5.0])
        v = [x * (1 + rng.choice([0, 0.0019, -0.0019, 0.0021])) if x is not None and abs(x) < INF and x == x else x for x in v]
        rows.append((i, rng.choice(["train", " Train", "TEST ", "val", None, "other"]), v))
    names = [f"f{k}" for k in range(14)]
    df = spark.createDataFrame([(i, s, *v) for i, s, v in rows], "row_id long, split string, " + ", ".join(f"{n} double" for n in names)).withColumn("_h", F.lit("clash"))
    got = [(r.train_key, r.eval_key) for r in near_pairs(df, "row_id", "split", names, hot_pairs=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 14)


def test_near_pairs_all_missing_and_empty(spark):
    names = [f"f{k}" for k in range(14)]
    shape = "row_id long, split string, " + ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame([(1, "train", *[None] * 14), (2, "test", *[NAN] * 14), (3, "val", *[1.0] * 14)], shape)
    assert [(r.train_key, r.eval_key) for r in near_pairs(df, "row_id", "split", names).collect()] == [(1, 2)]
    assert near_pairs(df.where("false"), "row_id", "split", names).count() == 0


# --- 6: samples by target


def population(spark, n=4000):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.floor(F.col("id") / 2).alias("flow_no"), F.when(F.col("id") % 10 < 6, " Train").otherwise("val").alias("split"),
        F.when(F.pmod(F.hash(F.floor(F.col("id") / 2)), F.lit(20)) < 15, "Benign").when(F.pmod(F.hash(F.floor(F.col("id") / 2)), F.lit(20)) < 19, "DDoS").otherwise(None).alias("fam"), F.lit(None).cast("string").alias("fine"), F.lit("clash").alias("weight"),
    )


TARGETS = "target_no long, plan_no int, cat_level string, split string, category string, target_share double, min_rows long, sample_size long"
LEVELS = {"family": "fam", "fine": "fine"}


@pytest.mark.parametrize("bucket", [4096, 7])
def test_sample_meets_quotas(spark, bucket):
    pop = population(spark)
    t = spark.createDataFrame([(1, 1, "family", None, "BENIGN ", 0.5, 1, 300), (2, 1, "family", None, "ddos", 0.5, 200, 300), (3, 2, "family", "val", "DDoS", 1.0, 10**6, 50), (4, 2, "fine", "val", "absent", 0.0, 1, 50)], TARGETS)
    args = (pop, t, "flow_no", "row_id", "split", LEVELS)
    report = {r.target_no: r for r in target_sample.target_report(*args).collect()}
    drawn = target_sample.target_sample(*args, bucket_rows=bucket).toPandas()
    got = drawn.groupby("target_no").size().to_dict()
    assert got == {k: r.quota for k, r in report.items() if r.quota}
    assert got[2] == 200 and got[1] == 100 and not drawn.duplicated(["plan_no", "_key"]).any()
    assert report[3].shortfall > 0 and report[4].population == 0 and report[4].shortfall == 1 and report[1].shortfall == 0
    again = target_sample.target_sample(pop.repartition(9), *args[1:], bucket_rows=bucket).toPandas()
    assert sorted(again["_key"]) == sorted(drawn["_key"])


def test_sample_empty(spark):
    t = spark.createDataFrame([(1, 1, "family", None, "Benign", 0.5, 1, 300)], TARGETS)
    assert target_sample.target_report(population(spark, 0), t, "flow_no", "row_id", "split", LEVELS).first().shortfall == 150.0
    assert target_sample.target_sample(population(spark, 0), t, "flow_no", "row_id", "split", LEVELS).count() == 0
    assert target_sample.target_sample(population(spark, 10), t.where("false"), "flow_no", "row_id", "split", LEVELS).count() == 0


def test_rake_meets_margins():
    counts = np.array([50.0, 10, 30, 10])
    w = target_sample.rake(counts, [(np.array([0, 0, 1, 1]), np.array([0.5, 0.5])), (np.array([0, 1, 0, 1]), np.array([0.3, 0.7]))])
    assert (w * counts)[:2].sum() == pytest.approx(0.5) and (w * counts)[[0, 2]].sum() == pytest.approx(0.3)


# --- 8: packing


def test_best_fill_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        room = rng.randint(1, 30)
        best = max(sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room)
        used = packing.best_fill({s: sizes.count(s) for s in sizes}, room)
        assert sum(s * c for s, c in used.items()) == best and all(c <= sizes.count(s) for s, c in used.items())


def test_pack_round_trip(spark):
    rng = random.Random(6)
    texts = [None, "", "a b c " * 900] + [" ".join("w" for _ in range(rng.randint(1, 60))) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("size", F.lit("clash"))
    caps = spark.createDataFrame([(1, 64), (2, 256), (3, None), (4, 0)], "capacity_no int, capacity_tokens int")
    out = packing.pack(docs, caps, "doc_id", "text", group_rows=150).toPandas()
    for c, capacity in ((1, 64), (2, 256)):
        q = out[out.capacity_no == c]
        assert sorted(q["item"].unique()) == list(range(len(texts)))
        fill = q.groupby("container")["size"].sum()
        assert fill.max() <= capacity and q["size"].sum() == sum(len((t or "").split()) for t in texts)
        assert 1 - fill.sum() / (len(fill) * capacity) < (0.05 if c == 1 else 0.02)
        assert (q.groupby("item").size() > 1).sum() == 1
    assert set(out.capacity_no) == {1, 2}
    assert packing.pack(docs.where("false"), caps, "doc_id", "text").count() == 0


def test_pack_of_items_that_do_not_fit_together_settles(spark, monkeypatch):
    """Equal items of 60 % of the capacity: one to a container is optimal and moved no more than once."""
    cut, rows = packing.scratch.cut, []
    monkeypatch.setattr(packing.scratch, "cut", lambda df: rows.append(1) or cut(df))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 60)").alias("text"))
    caps = spark.createDataFrame([(1, 100)], "capacity_no int, capacity_tokens int")
    out = packing.pack(docs, caps, "doc_id", "text", group_rows=500)
    assert out.select("container").distinct().count() == 3000 and len(rows) == 2


def test_pack_repacks_while_containers_fall(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * rng.choice([30, 31, 47, 53])) for i in range(2000)], "doc_id long, text string")
    caps = spark.createDataFrame([(1, 128)], "capacity_no int, capacity_tokens int")
    few = packing.pack(docs, caps, "doc_id", "text", group_rows=25, least_gain=10.0).select("container").distinct().count()
    many = packing.pack(docs, caps, "doc_id", "text", group_rows=25).select("container").distinct().count()
    assert many <= few
    report = packing.fill_report(packing.pack(docs, caps, "doc_id", "text"), caps).first()
    assert report.n_items == 2000 and report.n_overfull == 0 and report.n_cut_in_vain == 0


def test_token_rule(spark):
    texts = ["a_1 -- b.c", "été où!?", "x" * 50_000, "  ", "ß² 中文。"]
    want = [len(re.findall(r"\w+|[^\w\s]+", t)) for t in texts]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(packing.token_count(F.col("t"))).collect()]
    assert got == want


# --- 9: leaking passages

ITEM = "During replay 897 the probe Xur85 counts 4827 opening handshakes and 567 closing handshakes before station Din56 refuses a session after 240 silent intervals of rack 982"


def leaked(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("w", F.lit("clash"))
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("i", F.lit("clash"))
    return {(r.doc_id, r.item_id): r for r in leak_text.leaks(docs, tests, **options).collect()}


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(12)] + [None, "", "short one"]
    texts = [None, "", "w1 w2"]
    for _ in range(150):
        own = [rng.choice([*vocabulary, "other"]) for _ in range(rng.randint(5, 50))]
        for _ in range(rng.choice([0, 1, 2])):
            src = rng.choice(items[:12]).split()
            n, a = rng.randint(9, 16), rng.randint(0, 24)
            at = rng.randint(0, len(own))
            own[at:at] = [x.upper() if rng.random() < 0.5 else x for x in src[a : a + n]]
        texts.append(rng.choice([" ", ", ", "\n", "_-_"]).join(own))
    grams = lambda t: {tuple(w[i : i + 12]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 11)}
    want = {(d, i) for d, t in enumerate(texts) for i, s in enumerate(items) if grams(t) & grams(s)}
    assert len(want) > 20 and set(leaked(spark, texts, items, verbatim_only=True)) == want


def test_paraphrase_and_long_text(spark):
    words = ITEM.split()
    swapped = [("maybe" if k % 9 == 8 else w) for k, w in enumerate(words)]
    got = leaked(spark, ["filler text " * 20_000 + ITEM, " ".join(swapped), "nothing of the kind is here today at all really"], [ITEM], cosine=0.7, paraphrase_passages=2)
    assert got[0, 0].kind == "verbatim" and got[0, 0].longest_run == len(words)
    assert got[1, 0].kind == "paraphrase" and got[1, 0].subsequence > 0.8 and (2, 0) not in got


def test_svd_is_fitted_on_all_passages(spark, monkeypatch):
    fit, rows = leak_text.fit_svd, []
    monkeypatch.setattr(leak_text, "fit_svd", lambda passages, *a, **k: rows.append(passages.count()) or fit(passages, *a, **k))
    words = ITEM.split()
    leaked(spark, [" ".join(words[i % 20 : i % 20 + 6]) for i in range(7000)], [ITEM], verbatim_only=True)
    assert rows == [7000 + len(words) - 5]


def test_paraphrases_against_brute_force(spark, monkeypatch):
    """Production parameters; brute force is the cosine in the whole space of words."""
    rng = random.Random(9)
    items = [" ".join(f"t{rng.randint(1, 400)}" for _ in range(40)) for _ in range(20)]
    swapped = lambda s, step: " ".join("maybe" if k % step == step - 1 else w for k, w in enumerate(s.split()))
    texts = [swapped(s, step) for s in items for step in (4, 7, 11)]
    got = {k for k, r in leaked(spark, texts, items, cosine=0.8).items() if r.kind == "paraphrase"}
    monkeypatch.setattr(leak_text, "fit_svd", lambda passages, weights, rank, **k: np.eye(len(weights))[:, :-1])
    want = {k for k, r in leaked(spark, texts, items, cosine=0.8).items() if r.kind == "paraphrase"}
    assert len(want) >= len(items) and len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("change", [4, 5, "swap"])
def test_recall_of_paraphrases(spark, change):
    """Production parameters: every 4th or 5th word replaced, or all neighbours swapped, inside other text."""
    rng = random.Random(12)
    verbs = ["counts", "sends", "drops", "holds", "marks", "keeps"]
    items = [" ".join(f"the probe {rng.choice('abcdefgh')}{rng.randint(10, 99)} of station s{rng.randint(100, 999)} {rng.choice(verbs)} {rng.randint(100, 9999)} packets while rack {rng.randint(100, 999)} is offline" for _ in range(6)) for _ in range(40)]
    plain = "with the usual seeds the audit of this set counts the rows by unit and by label and nothing else is planned "

    def changed(text):
        w = text.split()
        if change == "swap":
            return " ".join(x for k in range(0, len(w), 2) for x in reversed(w[k : k + 2]))
        return " ".join(rng.choice(["roughly", "maybe", "some", "other"]) if k % change == change - 1 else x for k, x in enumerate(w))

    texts = [plain * rng.randint(0, 4) + changed(t) + " " + plain * rng.randint(0, 4) for t in items] + [plain * 5] * 40
    got = set(leaked(spark, texts, items))
    assert len(got & {(k, k) for k in range(40)}) >= 0.9 * 40 and len(got) <= 44


def test_run_at_any_place(spark):
    """A run of 12 words is found wherever it stands in the document and in the item, one of 11 words nowhere."""
    words = ITEM.split()
    texts = ["x " * k + " ".join(words[a : a + n]) + " y" * (7 - k) for n in (11, 12) for k in range(7) for a in (0, 5, len(words) - 12)]
    assert {d for d, _ in leaked(spark, texts, [ITEM], verbatim_only=True)} == set(range(21, 42))


def test_leaks_empty(spark):
    assert leaked(spark, [], [ITEM]) == {} and leaked(spark, [ITEM], []) == {}


def test_subsequence_length():
    assert leak_text._subsequence(list("abcde"), list("xaybzd")) == 3 and leak_text._subsequence(["a"], []) == 0


# --- 10: residue

RESIDUE = [
    "The scaler was fitted on {{ split }} only.", "We kept ${score} of the rows.", "A note on undefined: it lasts.", "The run on [MODEL NAME] of [DATASET] ended.", "Rows of <insert family here> came late.", "It lasted %(seconds)s seconds.",
    "Lorem ipsum dolor sit amet.", "Click to edit this section.", "Corpis porro imbrel ullam elun. Vestan quoris lunatis porro mivet fortane.", "text text text text text",
    "<html><body><h1>404 Not Found</h1></body></html>", "Audit of capture 5 of MillNet\n\nAccess denied. You do not have permission to open this chart.", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE.", "Erreur interne du serveur. Veuillez réessayer dans 5 minutes.",
]
CONTENT = [
    None, "", "The template leaves `{{ family }}` empty when the label is missing; this was fixed in run 5.", "Access denied replies make up 5 percent of the DDoS traffic, as the audit of last week shows.", "<p>The interval [0.1, 0.2] holds, and cells marked [a] are from seed 3.</p>",
    "Pages that require scripts cannot be replayed by the bench, so 12 such flows were left out of the set.", "The config line is {\"tau\": 0.2} and was not changed.", "word " * 3 + "The rows came late. " * 5000,
]


def test_residue_detectors(spark):
    texts = RESIDUE + CONTENT
    docs = spark.createDataFrame([(i, t, f"h{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumn("s", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.id: r.residue for r in residue.detect(docs, "doc_id", "text", "source").collect()}
    assert [i for i in range(len(RESIDUE)) if not got[i]] == [] and [i for i in range(len(RESIDUE), len(texts)) if got[i]] == []


def test_filler_in_part_of_a_text(spark):
    before, after = "The rows of unit 1729 came late and were labelled again.", "Please check the sensor of MillNet before the next sweep."
    filler = ["asdf asdf asdf qwer qwer test test test", "test test test", "Corpis porro imbrel ullam elun.", "hjkl asdf qwer zxcv uiop"]
    other = ["Flow Features Excluded During Training", "botnet, scan, recon, bruteforce, other", "xgb beats rf on DDoS by 0.43, but loses on DDoS. xgb beats xgb on Other by 0.009, but loses on DDoS.", 'The form held "asdf asdf asdf qwer qwer" as its note.']
    place = lambda x: ["\n\n".join(p) for p in ([x, before, after], [before, x, after], [before, after, x])]
    texts = [t for x in filler + other for t in place(x)]
    docs = spark.createDataFrame([(i, t, f"h{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.id for r in residue.detect(docs, "doc_id", "text", "source").where("filler").collect()}
    assert got == set(range(3 * len(filler)))


def test_notice_after_short_lines(spark):
    texts = ["Capture overview\nStatus\nGateway\n503 Service Unavailable", "Overview\nStatus\nUnit\nMillNet\nGateway\nAccess denied.\nYou do not have permission to open this chart."]
    other = ["Overview\nStatus\nGateway\n503 Service Unavailable\nThe gateway of MillNet answered so after nine seconds of waiting.", "Overview\nStatus\nUnit\nGateway\nThe rows came late."]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts + other)], "doc_id long, text string, source string")
    assert {r.id for r in residue.detect(docs, "doc_id", "text", "source").where("notice").collect()} == set(range(len(texts)))


def test_residue_by_host_evidence(spark):
    body = "The night capture of this set has many rows and the audit counts them by unit and by label. "
    rows = [(i, body * 3, f"h{i % 5}") for i in range(300)] + [(1000 + i, f"Zorgel blip {i} quantum fnord gate", f"h{i % 5}") for i in range(5)] + [(2000, "Single oddity without company whatsoever", "h1")]
    got = {r.id for r in residue.detect(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source", rare_share=0.1).where("response").collect()}
    assert got == {1000 + i for i in range(5)}


def test_long_responses_of_few_words(spark):
    body = "The night capture of this set has many rows and the audit counts them by unit and by label. "
    dump = lambda i, n: f"Zorgel blip {i} quantum fnord gate " + "4f 10 7 x " * 20_000 + "".join(f" zo{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))
    rows = [(i, body * 3, f"h{i % 5}") for i in range(300)] + [(1000 + 10 * n + i, dump(i, n), f"h{i % 5}") for n in (0, 35, 36) for i in range(5)]
    got = {r.id for r in residue.detect(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source", rare_share=0.1).where("response").collect()}
    assert got == {1000 + 10 * n + i for n in (0, 35) for i in range(5)}


#: Written for the test after the detectors; single texts, where the hosts are no help.
UNSEEN_RESIDUE = [
    "The unit [% unit_name %] was replayed twice.", "<<analyst>> closed the ticket before noon.", "The owner of this set is TBD.", "HTTP 502 nginx", "We can't find the page you're looking for.", "Pagina non trovata", "404 - Page Not Found",
    "Oops! An internal error has occurred. Please try again later.", "Your session timed out. Please log in again.", "503 Service Temporarily Unavailable\nnginx/1.18.0", "This site requires JavaScript to be enabled.", "JavaScript must be enabled in your browser to display this content.",
    "Please turn on cookies and reload.", "You are not authorized to access this page. Contact the administrator.", "Request blocked by the firewall. Request id 7781.", "Die Seite existiert nicht.", "Zugriff verweigert. Bitte anmelden.", "La page demandée est introuvable.", "Connexion refusée par le serveur.", "Página no encontrada (404)", "Su sesión ha expirado. Acceso denegado.",
    "The site is offline for maintenance.", "Fatal error: unable to connect to the database.", "Hello {{ user.name }}, the sweep of unit 12 ended.", "The split was {% split %} in both runs.", "Rows of $" + "{unit} came late.", "The seed was %d in run 7.", "Label [YOUR LABEL HERE] was removed.", "The reject rate rose to NaN.", "Sensor undefined sent 120 flows.", "%%OWNER%% will check the unit.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Enter your description here.", "Write this section later.", "TBD", "Dummy text for the summary", "Content coming soon.", "foo foo foo foo foo", "Dolorem quentum varian sollis pretum. Anquis belor tamen crescun fuit.", "FIXME: describe the capture",
]
UNSEEN_CONTENT = [
    "Error 12 was traced to a bad cable, and the capture was repeated on Monday.", "The text uses {name} style fields in format strings.", "Sample heading sizes were counted by the audit.", "Scripts on the small node requested a retrain every night, which explains the load.", "The server room lost power, so two captures of MillNet are short.", "Access to the label store is logged for every analyst.",
    "HTTP floods make up a third of the DoS rows in this capture.", "A page on the wiki lists all seeds of the five runs.", "The session table joins flows with the unit that sent them.", "We found that the error rate of rf falls with more seeds.", "The timeout of idle flows is 120 seconds in both captures.", "Login attempts by the brute force tool come in bursts of forty.", "Requests that fail are counted as benign by the old mapper.",
    "Undefined behaviour of the parser was fixed before the second run.", "None of the units were relabelled after the audit.", "The null hypothesis was rejected for four families.", "Rows with NaN values were dropped before scaling.", "None was found.", "The placeholder label Other stands for all rare families.", "Your reading of the table is right, the threshold is too low.", "Type errors in the label column were mended by hand.", "Add the two counts and the support is met.", "Replace the seed and the interval moves by a tenth.",
    "The audit said `Access denied` was the most frequent reply.", "The form said \"Please enable JavaScript\" in every replay, so the bench skipped it.", "Matrix entries [1, 2] and [2, 1] are swapped.", "The share is 12% sure to fall below 40% of rows.", "El servidor de la unidad 7 envió 300 flujos con la etiqueta DoS.", "Der Server der Einheit 7 hat 300 Flüsse mit dem Etikett DoS geliefert.", "Le serveur de l'unité 7 a envoyé 300 flux avec l'étiquette DoS.", "This surprised us.", "No further action is planned.", "botnet, scan, recon, bruteforce, other", "Many, many more seeds are needed.", "xgb beats rf, rf beats knn, knn beats none.",
    "The proxy logs show 400 refused connections from the scan host.", "Browser traffic is labelled benign in all four data sets.", "The limit of 200 rows per family removed Web/App from the list.", "Maintenance of the sensors took two days and cost 900 rows.", "The soon to come capture of CoastIDS has more units.",
]


def test_unseen_residue_and_content(spark):
    texts = UNSEEN_RESIDUE + UNSEEN_CONTENT
    docs = spark.createDataFrame([(i, t, f"h{i}", "run_note") for i, t in enumerate(texts)], "doc_id long, text string, source string, doc_kind string")
    got = {r.id for r in residue.detect(docs, "doc_id", "text", "source", "doc_kind").where("residue").collect()}
    true = set(range(len(UNSEEN_RESIDUE)))
    assert len(got & true) >= 0.9 * len(true), [texts[i] for i in sorted(true - got)]
    assert len(got & true) >= 0.9 * len(got), [texts[i] for i in sorted(got - true)]


def test_notices_by_hosts_alone(spark, monkeypatch):
    """Without any term, repeated responses of several hosts are found; content of the same length is not."""
    monkeypatch.setattr(residue, "RESPONSE_TERMS", ["nosuchterm"])
    notices = ["Access denied. You do not have permission to open this chart.", "Interner Serverfehler. Bitte versuchen Sie es später erneut. Vorgang {}", "Too many requests. Slow down and retry after {} seconds."]
    content = ["The rows of unit {} came late.", "No further action is planned for unit {}.", "The threshold of seed {} is too low."]
    rows = [(i, content[i % 3].format(i) + (" Nothing else is known about this unit and its rows." if i % 2 else ""), f"h{i % 7}") for i in range(900)]
    rows += [(1000 + i, notices[i % 3].format(i), f"h{i % 5}") for i in range(15)] + [(2000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.id for r in residue.detect(docs, "doc_id", "text", "source").where("residue").collect()}
    assert got == set(range(1000, 1015))


def test_residue_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert residue.detect(docs, "doc_id", "text", "source").count() == 0

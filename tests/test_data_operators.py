"""Problems 2, 5 and 7 on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import csv
import io
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import schema_drift as D
from flowsieve.operators.line_loader import load_lines
from flowsieve.operators.tree_aggregate import exact, key_totals, tree_states

# --- 2: a few keys hold most records


def test_tree_aggregate_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 20 + ["b", None]), rng.choice([None, "s1", "s2", "s3"]), rng.choice([None, float("nan"), float("inf"), 1.25, 2.5])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "key string, m string, v double").repartition(13).withColumn("n_rows", F.lit("clash")).withColumn("_node", F.lit(1))
    states = tree_states(df, {"k": F.col("key")}, F.col("m"), {"s": exact(F.col("v"), 4)}, fan_in=2)
    assert states.groupBy("key_kind", "key_value", "member").count().where("count > 1").count() == 0
    got = {r.key_value: (r.n_rows, float(r.s), r.n_members) for r in key_totals(states, ["s"]).collect()}
    want = defaultdict(lambda: [0, 0.0, set()])
    for k, m, v in rows:
        want[k][0] += 1
        want[k][1] += v if v in (1.25, 2.5) else 0
        want[k][2] |= {m} - {None}
    assert got == {k: (n, s, len(m)) for k, (n, s, m) in want.items()}


def test_tree_aggregate_empty(spark):
    df = spark.createDataFrame([], "key string, m string, v double")
    states = tree_states(df, {"k": F.col("key")}, F.col("m"), {"s": exact(F.col("v"), 2)})
    assert states.count() == 0 and key_totals(states, ["s"]).count() == 0


# --- 5: schemas that drift

CATALOG = [("dst_port", "integer", ["dport"]), ("flow_iat_mean", "decimal", ["iat_avg"]), ("protocol", "text", []), ("syn_flag", "integer", [])]


def drift(spark, records, files):
    catalog = spark.createDataFrame(CATALOG, "field_name string, field_type string, known_aliases array<string>")
    taken = D.ingest(spark.createDataFrame(records, "file_no long, rec_no int, payload string").withColumn("name", F.lit("clash")), catalog)
    columns = D.columns_of_files(taken).cache()
    resolved = D.resolve_names(taken, columns, catalog)
    table = spark.createDataFrame(files, "file_no long, feed_id string, captured_at string")
    found = {(r.file_no, r.column_name, r.change_kind) for r in D.changes(table, columns, resolved).collect()}
    return found, D.replay(taken, resolved, catalog)


def test_drift_kinds(spark):
    def rec(**kw):
        return json.dumps({k.replace("__", "-"): v for k, v in kw.items()})

    records = []
    for i in range(8):
        records += [(1, i, rec(Dst__Port=80 + i, iat_avg=0.5 + i, proto="tcp")), (2, i, rec(dport=80 + i, iat_avg=str(0.5 + i), proto="udp", syn_flag=1)), (3, i, rec(dst_port=90 + i, protocol="tcp"))]
    records += [(1, 0, records[0][2]), (2, 9, "not json"), (2, 10, None), (3, 9, json.dumps({"stray": {"a": 1}}))]
    found, out = drift(spark, records, [(2, "f", "2031-01-02"), (1, "f", "2031-01-01"), (3, "f", "2031-01-03"), (9, "g", None)])
    assert found == {
        (2, "dport", "renamed"), (2, "iat_avg", "retyped"), (2, "syn_flag", "added"),
        (3, "dst_port", "renamed"), (3, "protocol", "renamed"), (3, "iat_avg", "removed"), (3, "syn_flag", "removed"),
    }
    rows = {(r.file_no, r.rec_no): r for r in out.collect()}
    assert len(rows) == 8 * 3 + 3
    assert rows[1, 3].dst_port == 83 and rows[2, 3].flow_iat_mean == 3.5 and rows[1, 3].protocol == "tcp"
    assert "not json" in rows[2, 9]._rescued and rows[2, 10]._rescued is None and "stray" in rows[3, 9]._rescued


def test_second_values_of_a_field_are_rescued(spark):
    records = [
        (1, 1, '{"dst_port": 80, "dport": 443, "protocol": "tcp"}'), (1, 2, '{"dst_port": 80, "Dst-Port": 22, "DST PORT": 21, "protocol": "tcp"}'), (1, 3, '{"syn_flag": "soon", "Syn Flag": "late", "protocol": "udp"}'),
        (1, 4, '{"dst_port": 80, "dport": "80", "protocol": "tcp"}'), (1, 5, '{"dst_port": 7, "protocol": "tcp", "Protocol": "a \\"b\\"", "stray": 1}'), (1, 6, '{"dst_port": null, "dport": 5}'),
    ]
    _, out = drift(spark, records, [(1, "f", "2031-01-01")])
    rows = {r.rec_no: (r.dst_port, r.protocol, r.syn_flag, r._rescued and json.loads(r._rescued)) for r in out.collect()}
    assert rows == {
        1: (443, "tcp", None, {"dst_port": "80"}), 2: (80, "tcp", None, {"dst_port": ["21", "22"]}), 3: (None, "udp", None, {"syn_flag": ["late", "soon"]}),
        4: (80, "tcp", None, None), 5: (7, "tcp", None, {"protocol": 'a "b"', "stray": "1"}), 6: (5, None, None, None),
    }


def test_rescued_first_then_replayed(spark):
    """A later name and another spelling lie in `_rescued` until the name is approved and the value replayed."""
    records = [(1, i, json.dumps({"dst_port": 80 + i, "flow_iat_mean": 0.5 + i, "protocol": "tcp"})) for i in range(9)]
    records += [(2, i, json.dumps({"dst_port": f"{80 + i}.0", "iat_mean_flow": 0.5 + i, "protocol": "tcp", "mood": "calm"})) for i in range(9)]
    catalog = spark.createDataFrame(CATALOG, "field_name string, field_type string, known_aliases array<string>")
    taken = D.ingest(spark.createDataFrame(records, "file_no long, rec_no int, payload string"), catalog)
    before = {(r.file_no, r.rec_no): r for r in taken.collect()}
    assert before[2, 3].flow_iat_mean is None and before[2, 3].dst_port is None
    assert json.loads(before[2, 3]._rescued) == {"dst_port": "83.0", "iat_mean_flow": "3.5", "mood": "calm"}
    resolved = D.resolve_names(taken, D.columns_of_files(taken), catalog)
    after = {(r.file_no, r.rec_no): r for r in D.replay(taken, resolved, catalog).collect()}
    assert len(after) == 18 and after[2, 3].flow_iat_mean == 3.5 and after[2, 3].dst_port == 83
    assert json.loads(after[2, 3]._rescued) == {"mood": "calm"} and after[1, 3]._rescued is None and after[1, 3].dst_port == 83


def test_drift_empty(spark):
    found, out = drift(spark, [], [])
    assert found == set() and out.count() == 0


def test_spelling_and_order_are_no_change(spark):
    records = [(1, 1, '{"A B": 1, "c": 2}'), (2, 1, '{"C": 2, "a-b": 1}')]
    found, _ = drift(spark, records, [(1, "f", "a"), (2, "f", "b")])
    assert found == set()


# --- 7: rows that fail to parse

SCHEMA = [(1, "n", "integer", 0.0, 10.0, True), (2, "r", "real", None, 1.0, False), (3, "t", "text", None, None, True), (4, "l", "label", None, None, False)]


def loaded(spark, texts):
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id long, line_text string").withColumn("reason", F.lit("clash"))
    schema = spark.createDataFrame(SCHEMA, "col_pos int, column_name string, value_kind string, min_value double, max_value double, may_be_empty boolean")
    return {r.line_id: r for r in load_lines(lines, "line_id", "line_text", schema, ["Benign-X", "DoS"]).collect()}


CASES = [
    ("1,0.5,a,DoS", None), ('"1","0.5","a, ""b""","dos."', None), (" +3 , 5E-1 ,, Benign-X ", None), (",.5,a,DoS", None),
    ("1,0.5,a", "column_count"), ("1,0.5,a,DoS,", "column_count"), ("", "column_count"), (None, "column_count"),
    ('1,"0.5,a,DoS', "quoting"), ('1,0.5,a"b,DoS', "quoting"), ('1,"0.5"x,a,DoS', "quoting"), ('1, "0.5",a,DoS', "quoting"), ("1,0.5,a\nb,DoS", "quoting"),
    ('1,0.5,"a\nb",DoS', None), ("11,0.5,a,DoS", "bad_value"), ("1.0,0.5,a,DoS", "bad_value"), ("1,,a,DoS", "bad_value"), ("1,NaN,a,DoS", "bad_value"), ("1,2,a,DoS", "bad_value"),
    ("1,0.5,a,Nope", "bad_value"), ("1,0.5,a,", "bad_value"), ("-,0.5,a,DoS", "bad_value"), ("99999999999999999999,0.5,a,DoS", "bad_value"), ("1,0.5," + "x" * 300_000 + ",DoS", None),
]


def test_reasons(spark):
    got = loaded(spark, [t for t, _ in CASES])
    assert {i: got[i].reason for i in got} == {i: r for i, (_, r) in enumerate(CASES)}
    assert got[1].t == 'a, "b"' and got[2].n == 3 and got[2].t is None and got[3].n is None and got[13].t == "a\nb"
    assert got[18].bad_columns == ["r"] and got[18].n is None


def test_wide_integers(spark):
    """Bounds are exact above 2^53; what a bigint cannot hold is rejected, never a silent null."""
    lines = spark.createDataFrame(list(enumerate(["9300000000000000000", "9223372036854775807", "-9223372036854775808", "0000000000000000000012", "+7", "123456789012345678901234567890"])), "line_id long, line_text string")
    schema = "col_pos int, column_name string, value_kind string, min_value double, max_value double, may_be_empty boolean"
    free = {r.line_id: (r.n, r.reason) for r in load_lines(lines, "line_id", "line_text", spark.createDataFrame([(1, "n", "integer", None, None, True)], schema), []).collect()}
    assert free == {0: (None, "bad_value"), 1: (2**63 - 1, None), 2: (-(2**63), None), 3: (12, None), 4: (7, None), 5: (None, "bad_value")}
    edge = spark.createDataFrame(list(enumerate([str(2**53), str(2**53 + 1), str(-(2**53) - 1)])), "line_id long, line_text string")
    bound = spark.createDataFrame([(1, "n", "integer", -float(2**53), float(2**53), True)], schema)
    assert {r.line_id: r.reason for r in load_lines(edge, "line_id", "line_text", bound, []).collect()} == {0: None, 1: "bad_value", 2: "bad_value"}


def test_round_trip_of_written_csv(spark):
    rng = random.Random(3)
    rows = [[str(rng.randint(0, 10)), f"{rng.random():.3f}", "".join(rng.choice('ab ",\n') for _ in range(rng.randint(0, 9))), "DoS"] for _ in range(300)]
    texts = []
    for r in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        texts.append(out.getvalue())
    got = loaded(spark, texts)
    assert all(got[i].reason is None and got[i].n == int(r[0]) and got[i].r == float(r[1]) and (got[i].t or "") == r[2].strip() for i, r in enumerate(rows))


def test_loader_empty_and_all_rejected(spark):
    assert loaded(spark, []) == {}
    assert {r.reason for r in loaded(spark, ["a,b", "c"]).values()} == {"column_count"}


@pytest.mark.parametrize("n", [1, 50])
def test_repeated_lines(spark, n):
    assert len([r for r in loaded(spark, ["1,0.5,a,DoS"] * n).values() if r.reason is None]) == n

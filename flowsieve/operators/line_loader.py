"""Loading headerless CSV records with a reason for each record that does not load.

Records are processed as Arrow batches. A linear-time expression checks RFC 4180 quoting; the rest goes through the
Arrow CSV reader, whose invalid-row callback names the records with a wrong number of fields; all fields are read as
strings, and each column is then checked and cast as one vector, which labels the failing cells.

Reasons, the first that holds: `quoting`, `column_count`, `bad_value`. Defined results: a null text counts as an empty
one; blanks around a field are stripped before it is checked; an empty field that may be empty is null; fields may hold
line breaks only within quotes; repeated records are judged each for itself; an empty table gives no rows; an integer
that a bigint cannot hold is a bad value, and integers are compared with their bounds exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark.sql import DataFrame

_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
WELL_FORMED = rf"^{_FIELD}(?:,{_FIELD})*$"
INTEGER = r"^[+-]?[0-9]+$"
REAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
TYPES = {"integer": "bigint", "flag": "bigint", "real": "double", "text": "string", "label": "string"}


_WIDE = pa.decimal128(19, 0)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _fields(texts: pa.Array, width: int) -> tuple[pa.Table | None, np.ndarray, list[int]]:
    """(string columns, the rows they came from, rows with a wrong number of fields)."""
    wrong: list[int] = []

    def invalid(row) -> str:
        wrong.append(int(row.text.partition(",")[0]))
        return "skip"

    rows = pc.cast(pa.array(np.arange(len(texts))), pa.string())
    data = "\n".join(pc.binary_join_element_wise(rows, texts, ",").to_pylist()).encode() + b"\n"
    names = ["_row", *[f"c{i}" for i in range(width)]]
    try:
        table = pa.csv.read_csv(
            pa.BufferReader(data),
            read_options=pa.csv.ReadOptions(column_names=names, use_threads=False, block_size=min(len(data) + 1, (1 << 31) - 1)),
            parse_options=pa.csv.ParseOptions(newlines_in_values=True, invalid_row_handler=invalid),
            convert_options=pa.csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
        ).combine_chunks()
    except pa.ArrowInvalid:
        if len(wrong) < len(texts):
            raise
        return None, np.zeros(0, dtype=np.int64), wrong
    return table, pc.cast(table["_row"], pa.int64()).to_numpy(), wrong


def _whole(text: pa.Array, shaped: pa.Array, low, high) -> tuple[pa.Array, pa.Array]:
    """(bigints, whether the number lies within the bounds and the type) of texts of digits; exact."""
    digits = pc.replace_substring_regex(pc.if_else(shaped, text, None), r"^\+", "")
    digits = pc.replace_substring_regex(digits, r"^(-?)0+([0-9])", r"\1\2")
    wide = pc.cast(pc.if_else(pc.match_substring_regex(digits, r"^-?[0-9]{1,19}$"), digits, None), _WIDE)
    held = pc.and_(pc.greater_equal(wide, pa.scalar(Decimal(_LEAST), _WIDE)), pc.less_equal(wide, pa.scalar(Decimal(_MOST), _WIDE)))
    value = pc.cast(pc.if_else(held, wide, None), pa.int64())
    least = _LEAST if low is None or low <= _LEAST else math.ceil(low)
    most = _MOST if high is None or high >= _MOST else math.floor(high)
    if least > _MOST or most < _LEAST:
        return value, pa.array(np.zeros(len(text), dtype=bool))
    inside = pc.and_(pc.greater_equal(value, pa.scalar(least, pa.int64())), pc.less_equal(value, pa.scalar(most, pa.int64())))
    return value, pc.fill_null(inside, False)


def _checked(column: pa.Array, kind: str, low, high, may_be_empty: bool, labels: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(typed values, null where empty or bad; whether the cell is bad)."""
    text = pc.utf8_trim_whitespace(column)
    empty = pc.equal(text, "")
    if kind == "real":
        shaped = pc.match_substring_regex(text, REAL)
        number = pc.cast(pc.replace_substring_regex(pc.if_else(shaped, text, None), r"^\+", ""), pa.float64())
        inside = pc.and_(pc.greater_equal(number, float("-inf") if low is None else low), pc.less_equal(number, float("inf") if high is None else high))
        good = pc.fill_null(inside, False)
        value = pc.if_else(good, number, None)
    elif kind in ("integer", "flag"):
        value, good = _whole(text, pc.match_substring_regex(text, INTEGER), low, high)
        value = pc.if_else(good, value, None)
    elif kind == "label":
        good = pc.is_in(pc.replace_substring(pc.utf8_lower(text), ".", ""), value_set=labels)
        value = pc.if_else(good, text, None)
    else:
        good = pc.invert(empty)
        value = pc.if_else(empty, None, text)
    bad = pc.if_else(empty, not may_be_empty, pc.invert(good))
    return pc.if_else(empty, None, value), bad


def load_lines(lines: DataFrame, key: str, text: str, schema: DataFrame, labels: list[str]) -> DataFrame:
    """key, reason (null: loaded), bad_columns, and the typed columns of `schema` (null where rejected).

    `schema`: col_pos, column_name, value_kind, min_value, max_value, may_be_empty; one row per field, fixed and small.
    """
    none = lambda x: None if x is None or x != x else float(x)
    fields = [(r.column_name, r.value_kind, none(r.min_value), none(r.max_value), bool(r.may_be_empty)) for r in schema.orderBy("col_pos").collect()]
    known = pa.array(sorted({x.replace(".", "").strip().lower() for x in labels if x}), pa.string())
    key_type = lines.select(key).schema[0].dataType.simpleString()
    typed = ", ".join(f"`{n}` {TYPES[k]}" for n, k, *_ in fields)
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}

    columns = pa.array([n for n, *_ in fields], pa.string())
    reasons = pa.array([None, "quoting", "column_count", "bad_value"], pa.string())

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            n = len(texts)
            formed = pc.match_substring_regex(texts, WELL_FORMED)
            at = pc.indices_nonzero(formed).to_numpy()
            reason = np.where(formed.to_numpy(zero_copy_only=False), 0, 1)
            place = np.zeros(n, dtype=np.int64)
            loaded = np.zeros(n, dtype=bool)
            values = [pa.nulls(n, arrow[TYPES[k]]) for _, k, *_ in fields]
            failing = np.zeros((n, len(fields)), dtype=bool)
            if len(at):
                table, rows, wrong = _fields(texts.take(pa.array(at)), len(fields))
                reason[at[wrong]] = 2
                if table is not None and table.num_rows:
                    own = at[rows]
                    chunk = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                    checked = [_checked(chunk(table[f"c{c}"]), *spec[1:], known) for c, spec in enumerate(fields)]
                    for c, (_, bad) in enumerate(checked):
                        failing[own, c] = pc.fill_null(bad, False).to_numpy(zero_copy_only=False)
                    reason[own[failing[own].any(axis=1)]] = 3
                    place[own] = np.arange(len(own))
                    loaded[own] = reason[own] == 0
                    take = pa.array(place, pa.int64(), mask=~loaded)
                    values = [v.take(take) for v, _ in checked]
            ends = np.concatenate([[0], np.cumsum(failing.sum(axis=1))]).astype(np.int32)
            ends_or_null = pa.array(ends, pa.int32(), mask=np.concatenate([reason != 3, [False]]))
            cells = pa.ListArray.from_arrays(ends_or_null, columns.take(pa.array(np.nonzero(failing)[1])))
            out = [batch.column(0), reasons.take(pa.array(reason)), cells, *values]
            yield pa.RecordBatch.from_arrays(out, names=["_key", "_reason", "_cells", *[f for f, *_ in fields]])

    result = lines.select(key, text).mapInArrow(load, f"_key {key_type}, _reason string, _cells array<string>, {typed}")
    return result.withColumnsRenamed({"_key": key, "_reason": "reason", "_cells": "bad_columns"})

"""Schemas that drift between files: a list of every change, and one table by rescue-column ingestion.

1. `ingest` enforces the catalog's schema on every record: values under a catalog name or a known alias that cast
   strictly go into the typed columns; what has no place, cannot be cast, or differs from the value kept for its field
   (the largest) is preserved as JSON in `_rescued`, as a list where a name has several such values. The table is
   written to the shared folder. `_placed` tells which name and spelling each typed value came from, `_seen` which names
   and kinds of values the record carried.
2. `columns_of_files` derives from `_seen` the columns of each file (carried by at least half of its records) and their
   types; `resolve_names` looks at the rescued names and decides which of them stand for a quantity of the catalog, by
   evidence from all files together: equal parts of the names, the distribution or the vocabulary of the rescued values
   against the placed ones, and that two names of one quantity do not occur in the same file. A name without enough
   evidence stays a quantity of its own.
3. `replay` reads `_rescued` again, casts the values of approved names, and other spellings of a value (decimal comma,
   135.0, yes / no, ISO time), into typed columns that are still empty, and takes what was placed out of `_rescued`.
4. `changes` compares each file with the one captured before it in its feed.

Defined results: a record delivered twice counts once; a payload that is no JSON object is a record without keys and is
rescued whole; null payloads give null columns; an empty file has no columns, so its successor adds all of its own; a
column whose values are all null has no type and is never retyped; the commoner type wins, of equally common ones the
first of integer, decimal, boolean, text; nested values count as text; of several rescued values the largest is
replayed; empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve import scratch

KINDS = ["integer", "decimal", "boolean", "text"]
TYPES = {"integer": "bigint", "decimal": "double", "boolean": "boolean"}


def compared(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _entries(records: DataFrame) -> DataFrame:
    """file_no, rec_no, unread, name, kind, value: one row per key of a record, and one with null name for a record without."""
    once = records.select("file_no", "rec_no", "payload").groupBy("file_no", "rec_no").agg(F.min("payload").alias("payload"))
    parsed = once.withColumn("m", F.from_json("payload", "map<string,variant>"))
    unread = F.when(F.coalesce(F.size("m"), F.lit(0)) <= 0, F.col("payload"))
    raw = parsed.select("file_no", "rec_no", unread.alias("unread"), F.explode_outer("m").alias("key", "v"))
    told = raw.select("file_no", "rec_no", "unread", compared(F.col("key")).alias("name"), F.expr("schema_of_variant(v)").alias("t"), F.expr("try_variant_get(v, '$', 'string')").alias("value"))
    whole = F.col("t").isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (F.col("t").startswith("DECIMAL") & F.col("t").endswith(",0)") & (F.length("value") > 18))
    kind = (
        F.when(F.col("t") == "VOID", None)
        .when(whole, "integer")
        .when(F.col("t").startswith("DECIMAL") | F.col("t").isin("DOUBLE", "FLOAT"), "decimal")
        .when(F.col("t") == "BOOLEAN", "boolean")
        .otherwise("text")
    )
    return told.select("file_no", "rec_no", "unread", "name", kind.alias("kind"), "value")


def _catalog(catalog: DataFrame) -> tuple[dict[str, str], dict[str, list[str]]]:
    """(Spark type of each field, its names): the catalog is one row per field of the target schema."""
    rows = [r for r in catalog.orderBy("field_name").collect() if r.field_name]
    return {r.field_name: TYPES.get(r.field_type, "string") for r in rows}, {r.field_name: [r.field_name, *(r.known_aliases or [])] for r in rows}


def _strict(to: str) -> Column:
    return F.expr(f"try_cast(value as {to})")


def _lenient(to: str) -> Column:
    """Other spellings of a value: decimal comma, padding, 135.0, yes / no, ISO time."""
    tidy = "replace(trim(value), ',', '.')"
    if to == "bigint":
        number = F.expr(f"try_cast({tidy} as double)")
        whole = F.when(number == F.floor(number), F.expr(f"try_cast(floor(try_cast({tidy} as double)) as bigint)"))
        word = F.lower(F.trim("value"))
        truth = F.when(word.isin("true", "yes"), 1).when(word.isin("false", "no"), 0).cast("bigint")
        moment = F.expr("unix_seconds(try_to_timestamp(value, \"yyyy-MM-dd'T'HH:mm:ss\"))")
        return F.coalesce(_strict(to), whole, truth, moment)
    return F.coalesce(_strict(to), F.expr(f"try_cast({tidy} as {to})")) if to == "double" else _strict(to)


def _by_name(pairs: Column) -> Column:
    """Sorted (name, value) pairs as JSON: a name's value, or the list of its values where there are several."""
    values = lambda n: F.transform(F.filter(pairs, lambda x: x["name"] == n), lambda x: x["value"])
    told = lambda n: F.when(F.size(values(n)) > 1, values(n).cast("variant")).otherwise(F.get(values(n), F.lit(0)).cast("variant"))
    return F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: x["name"])), lambda n: F.struct(n, told(n)))))


def ingest(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """file_no, rec_no, the catalog's fields, _rescued, _placed (name, value), _seen (name, kinds): the rescue table, written once."""
    of, names = _catalog(catalog)
    entries = _entries(records)
    fields = list(of)
    place = F.coalesce(*[F.when(F.col("name").isin(names[f]), F.lit(i)) for i, f in enumerate(fields)]) if fields else F.lit(None).cast("int")
    placed = entries.withColumn("at", place)
    # the strictly cast value as text: the same text is the same value
    typed = F.coalesce(*[F.when(F.col("at").isin([i for i, f in enumerate(fields) if of[f] == to]), _strict(to).cast("string")) for to in sorted({*of.values(), "string"})])
    told = F.when(F.col("name").isNotNull(), F.struct("name", "kind", "value", "at", typed.alias("typed")))
    # the rows of a record lie together since they were made unique, so this moves nothing
    rows = placed.groupBy("file_no", "rec_no").agg(F.max("unread").alias("_unread"), F.collect_list(told).alias("_told"))
    fits = F.filter("_told", lambda x: x["typed"].isNotNull())
    own = F.transform("_told", lambda x: x["name"])
    rows = rows.withColumns({
        "_fits": F.transform(fits, lambda x: F.struct(x["at"].alias("at"), x["typed"].alias("typed"))),
        "_once": F.size(F.array_distinct(own)) == F.size(own),
    })
    rows = rows.withColumn("_single", F.size(F.array_distinct(F.transform("_fits", lambda x: x["at"]))) == F.size("_fits"))
    rows = rows.withColumn("_by_place", F.when(F.col("_single"), F.map_from_entries("_fits")))

    def kept_value(i: int, to: str) -> Column:
        """The value of a field; only records with several values for one field are searched for the largest."""
        several = F.array_max(F.transform(F.filter("_fits", lambda x: x["at"] == i), lambda x: x["typed"].cast(to)))
        return F.when(F.col("_single"), F.try_element_at("_by_place", F.lit(i)).cast(to)).otherwise(several)

    rows = rows.withColumns({f: kept_value(i, of[f]) for i, f in enumerate(fields)})
    rows = rows.withColumn("_all", F.when(~F.col("_single"), F.array(*[F.col(f).cast("string") for f in fields])))
    kept = lambda x: x["typed"].isNotNull() & (F.col("_single") | F.coalesce(x["typed"] == F.get("_all", x["at"]), F.lit(False)))
    pair = lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))
    left = F.sort_array(F.array_distinct(F.transform(F.filter("_told", lambda x: x["value"].isNotNull() & ~kept(x)), pair)))
    single = F.transform("_told", lambda x: F.struct(x["name"].alias("name"), F.array_compact(F.array(x["kind"])).alias("kinds")))
    several = F.transform(F.array_distinct(own), lambda n: F.struct(n.alias("name"), F.array_distinct(F.array_compact(F.transform(F.filter("_told", lambda x: x["name"] == n), lambda x: x["kind"]))).alias("kinds")))
    unread = F.when(F.col("_unread").isNotNull(), F.to_json(F.struct(F.col("_unread").alias("_payload"))))
    out = rows.withColumn("_left", left).select(
        "file_no", "rec_no", *of, F.coalesce(F.when(F.size("_left") > 0, _by_name(F.col("_left"))), unread).alias("_rescued"),
        F.transform(F.filter("_told", kept), pair).alias("_placed"), F.when(F.col("_once"), single).otherwise(several).alias("_seen"),
    )
    return scratch.cut(out)[0]


def rescued_values(table: DataFrame) -> DataFrame:
    """file_no, rec_no, name, value of what `_rescued` preserves; records that could not be read have none."""
    raw = table.where(F.col("_rescued").isNotNull()).select("file_no", "rec_no", F.explode(F.from_json("_rescued", "map<string,variant>")).alias("name", "v")).where(F.col("name") != "_payload")
    several = F.expr("try_variant_get(v, '$', 'array<string>')")
    return raw.select("file_no", "rec_no", "name", F.explode(F.coalesce(several, F.array(F.expr("try_variant_get(v, '$', 'string')")))).alias("value"))


def columns_of_files(table: DataFrame, least_share: float = 0.5) -> DataFrame:
    """file_no, name, type of each column, from what the rescue table has seen."""
    sizes = table.groupBy("file_no").agg(F.count(F.lit(1)).alias("n_records"))
    per = table.select("file_no", F.explode("_seen").alias("x")).groupBy("file_no", F.col("x.name").alias("name"))
    per = per.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("x.kinds", k)).alias(k) for k in KINDS])
    most = F.greatest(*[F.col(k) for k in KINDS])
    kind = F.when(most > 0, reduce(lambda rest, k: F.when(F.col(k) == most, k).otherwise(rest), reversed(KINDS), F.lit(None)))
    return per.join(sizes, "file_no").where(F.col("n") >= F.col("n_records") * least_share).select("file_no", "name", kind.alias("type"))


def _tokens(name: str) -> set[str]:
    return set(name.split("_")) - {""}


def _profiles(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Per name: mean and deviation of log values, share of numbers, sketches of vocabulary and shapes of texts."""
    value = F.expr("try_cast(replace(value, ',', '.') as double)")
    scaled = F.signum(value) * F.log1p(F.abs(value))
    shape = F.regexp_replace(F.regexp_replace(F.lower("value"), "[a-z]+", "a"), "[0-9]+", "0")
    known = entries.join(names.select("name").distinct(), "name").where(F.col("value").isNotNull())
    return known.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(scaled).alias("n_num"),
        F.avg(scaled).alias("mean"),
        F.coalesce(F.stddev_pop(scaled), F.lit(0.0)).alias("sd"),
        F.expr("approx_top_k(lower(value), 30)").alias("words"),
        F.approx_count_distinct("value").alias("n_distinct"),
        F.mode(shape, deterministic=True).alias("shape"),
    )


def _alike(a: dict, b: dict) -> float:
    """Likeness of two profiles, 0 to 1."""
    numeric = lambda p: p["n_num"] >= 0.8 * p["n"]
    if numeric(a) != numeric(b):
        return 0.0
    if numeric(a):
        spread = (a["sd"] + b["sd"]) / 2 + 0.05
        return math.exp(-abs(a["mean"] - b["mean"]) / spread) * math.exp(-abs(math.log((a["sd"] + 0.02) / (b["sd"] + 0.02))))
    x, y = set(a["words"]), set(b["words"])
    shared = len(x & y) / max(1, min(len(x), len(y)))
    return max(shared, 0.6 if a["shape"] == b["shape"] and a["shape"] not in ("a", "0") else 0.0)


def resolve_names(table: DataFrame, columns: DataFrame, catalog: DataFrame, least_score: float = 0.75) -> DataFrame:
    """name, field, approved: the catalog field that each column name stands for, else the name itself.

    Only profiles of names reach the driver: one row per distinct column name, never records or files.
    """
    spark = table.sparkSession
    _, fields = _catalog(catalog)
    of = {a: f for f, names in fields.items() for a in names}
    names = columns.groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    # each value of a record is either placed or rescued
    entries = table.select(F.explode("_placed").alias("x")).select("x.name", "x.value").unionByName(rescued_values(table).select("name", "value"))
    profiles = {r.name: r.asDict() | {"words": [w[0] for w in r.words]} for r in _profiles(entries, names).collect()}
    file_counts = {r.name: r.files for r in names.collect()}
    unknown = [n for n in file_counts if n not in of]
    together = {}
    if unknown:
        # columns of one file: their number is bounded by the width of a record
        asked = columns.join(spark.createDataFrame([(n,) for n in unknown], "name string"), "name")
        pair = asked.select("file_no", "name").join(columns.select("file_no", F.col("name").alias("other")), "file_no").where(F.col("name") != F.col("other"))
        together = {(r.name, r.other): r["n"] for r in pair.groupBy("name", "other").agg(F.count(F.lit(1)).alias("n")).collect()}
    members: dict[str, list[str]] = {f: [m for m in ms if m in file_counts] for f, ms in fields.items()}

    def meets(a: str, b: str) -> bool:
        return together.get((a, b), 0) > 0.05 * min(file_counts.get(a, 0), file_counts.get(b, 0))

    def score(name: str, field: str) -> float:
        if any(meets(name, m) for m in members[field]):
            return 0.0
        own = _tokens(name)
        parts = max((2 * len(own & t) / (len(own) + len(t)) for m in {*members[field], *fields[field]} if (t := _tokens(m)) and own), default=0.0)
        seen = [_alike(profiles[name], profiles[m]) for m in members[field] if m in profiles and name in profiles]
        return parts + (max(seen) if seen else 0.0)

    # the surest name first: it then counts as a member of its field for the others, whose scores with that field change
    scores = {(n, f): score(n, f) for n in unknown for f in fields}
    while scores:
        best, name, field = max((v, n, f) for (n, f), v in scores.items())
        if best < least_score:
            break
        of[name] = field
        members[field].append(name)
        scores = {(n, f): v for (n, f), v in scores.items() if n != name}
        scores |= {(n, field): score(n, field) for n, f in scores if f == field}
    rows = [(n, of.get(n, n), n in of) for n in sorted(file_counts)]
    return spark.createDataFrame(rows, "name string, field string, approved boolean")


def changes(files: DataFrame, columns: DataFrame, resolved: DataFrame) -> DataFrame:
    """file_no, column_name, change_kind, before: each file against the one captured before it in its feed."""
    order = Window.partitionBy("feed_id").orderBy("captured_at", "file_no")
    steps = files.select("file_no", F.lag("file_no").over(order).alias("before_no")).where(F.col("before_no").isNotNull())
    cols = columns.join(resolved.select("name", "field"), "name", "left").select("file_no", "name", "type", F.coalesce("field", "name").alias("field"))
    new = steps.join(cols, "file_no").select("file_no", "name", F.col("type").alias("new_type"), "field")
    old = steps.join(cols.withColumnRenamed("file_no", "before_no"), "before_no").select("file_no", "name", F.col("type").alias("old_type"), "field")
    mark = F.lit(True)
    state = new.withColumn("is_new", mark).join(old.drop("field").withColumn("is_old", mark), ["file_no", "name"], "full").drop("field")
    state = state.join(resolved.select("name", "field"), "name", "left").withColumn("field", F.coalesce("field", "name"))
    turn = Window.partitionBy("file_no", "field").orderBy("name")
    added = state.where(F.col("is_old").isNull()).withColumn("turn", F.row_number().over(turn)).select("file_no", "field", "turn", "name", "new_type")
    removed = state.where(F.col("is_new").isNull()).withColumn("turn", F.row_number().over(turn)).select("file_no", "field", "turn", F.col("name").alias("old_name"), "old_type")
    moved = added.join(removed, ["file_no", "field", "turn"], "full")
    kept = state.where(F.col("is_new") & F.col("is_old")).select("file_no", "name", F.col("name").alias("old_name"), "new_type", "old_type")
    every = kept.unionByName(moved.select("file_no", "name", "old_name", "new_type", "old_type"))
    retyped = F.col("name").isNotNull() & F.col("old_name").isNotNull() & (F.col("new_type") != F.col("old_type"))
    kind = F.when(F.col("old_name").isNull(), "added").when(F.col("name").isNull(), "removed").when(F.col("name") != F.col("old_name"), "renamed")
    kinds = F.array_compact(F.array(kind, F.when(retyped, "retyped")))
    before = F.when(F.col("change_kind") == "retyped", F.col("old_type")).otherwise(F.col("old_name"))
    return every.select("*", F.explode(kinds).alias("change_kind")).select("file_no", F.coalesce("name", "old_name").alias("column_name"), "change_kind", before.alias("before"))


def replay(table: DataFrame, resolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """The rescue table with the rescued values of approved names, and of other spellings, in the typed columns they belong to."""
    of, names = _catalog(catalog)
    known = table.sparkSession.createDataFrame([(n, f) for f, ns in names.items() for n in dict.fromkeys(ns)], "name string, field string")
    approved = known.unionByName(resolved.where("approved").join(known.select("name"), "name", "left_anti").select("name", "field"))
    values = rescued_values(table).join(approved, "name", "left")
    kinds = sorted({*of.values(), "string"})
    for to in kinds:
        values = values.withColumn(f"_{to}", F.when(F.col("field").isin([f for f in of if of[f] == to]), _lenient(to)))
    best = [F.max(F.when(F.col("field") == f, F.col(f"_{to}"))).alias(f"_new_{f}") for f, to in of.items()]
    again = values.groupBy(F.col("file_no").alias("_f"), F.col("rec_no").alias("_r")).agg(*best, F.collect_set(F.struct("name", "value", "field", *[f"_{to}" for to in kinds])).alias("_told"))
    joined = table.join(again, F.col("file_no").eqNullSafe(F.col("_f")) & F.col("rec_no").eqNullSafe(F.col("_r")), "left")
    filled = joined.withColumns({f: F.coalesce(f, f"_new_{f}") for f in of})

    def placed(x: Column) -> Column:
        return reduce(lambda rest, f: F.when(x["field"] == f, F.coalesce(x[f"_{of[f]}"] == F.col(f), F.lit(False))).otherwise(rest), of, F.lit(False))

    left = F.sort_array(F.transform(F.filter("_told", lambda x: ~placed(x)), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))))
    rest = filled.withColumn("_left", left)
    as_json = F.when(F.col("_told").isNull(), F.col("_rescued")).when(F.size("_left") > 0, _by_name(F.col("_left")))
    return rest.select("file_no", "rec_no", *of, as_json.alias("_rescued"))

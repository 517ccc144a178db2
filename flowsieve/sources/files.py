"""Readers and writers: file lists, CSV records, part files, evidence, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def list_files(spark: SparkSession, root: str, pattern: str = "*", exclude: list[str] | None = None) -> DataFrame:
    """path, length of the files below `root` that match `pattern`; names holding an excluded word are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length")
    return without_words(files, "path", exclude or []).orderBy("path")


def without_words(files: DataFrame, path: str, words: list[str]) -> DataFrame:
    name = F.lower(base_name(F.col(path)))
    for w in words:
        files = files.where(~name.contains(w.lower()))
    return files


def by_patterns(files: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """Files that match any glob, once each, with the number of the first pattern that names them (`pattern_no`)."""
    name = base_name(F.col(path))
    as_regex = lambda g: "^" + re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    number = F.coalesce(*[F.when(name.rlike(as_regex(g)), F.lit(i)) for i, g in enumerate(patterns)])
    return files.withColumn("pattern_no", number).where(F.col("pattern_no").isNotNull()).dropDuplicates([path])


def read_csv(spark: SparkSession, paths: list[str], schema: StructType | str | None = None, header: bool = True, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """CSV files as strings (or by `schema`), with the file they came from in `_file`; only `columns` are parsed."""
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(paths)
    return df.select(*(columns or df.columns), F.col("_metadata.file_path").alias("_file"))


def csv_columns(text: Column, schema: str) -> Column:
    """Fields of one headerless CSV record as a struct of strings."""
    return F.from_csv(text, schema, {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})


def row_range(df: DataFrame, file: str, order: str, start: int, rows: int) -> DataFrame:
    """Rows start .. start + rows - 1 of each file, by its row order."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(file).orderBy(order))
    return df.withColumn("_rn", rank).where((F.col("_rn") > start) & (F.col("_rn") <= start + rows)).drop("_rn")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parquet table at `path`, or an empty one of the same schema where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Part files below one folder per value, so that a later scan prunes partitions. Types without a parquet form become strings."""
    tidy = df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t in ("void",)}) if any(t == "void" for _, t in df.dtypes) else df
    tidy.write.partitionBy(*by).mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A small sorted result as one CSV file with header."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def canonical_json(cols: list[str]) -> Column:
    """JSON text with sorted keys, as hashed for evidence ids."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))


def manifest(df: DataFrame, name: str, content: str) -> DataFrame:
    """name, length in bytes and SHA-256 of each content."""
    return df.select(name, F.octet_length(content).alias("n_bytes"), F.sha2(F.col(content), 256).alias("sha256"))


def findings(df: DataFrame, name: str, content: str, categories: dict[str, str]) -> DataFrame:
    """Per category of regular expressions: how many texts match."""
    hit = F.explode(F.array_compact(F.array(*[F.when(F.col(content).rlike(p), F.lit(c)) for c, p in categories.items()]))).alias("category")
    return df.select(name, hit).groupBy("category").agg(F.count(F.lit(1)).alias("n_texts"))


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_parts(spark: SparkSession, folder: str, schema: str) -> tuple[str, DataFrame]:
    """(format, rows) of the part files of a folder, in the first of parquet, CSV and packed CSV that is there; `none` and no rows otherwise."""
    for kind in ("parquet", "csv", "csv.gz"):
        if _exists(spark, f"{folder}/*.{kind}"):
            reader = spark.read.schema(schema).option("pathGlobFilter", f"*.{kind}")
            return kind, reader.parquet(folder) if kind == "parquet" else reader.option("header", True).csv(folder)
    return "none", spark.createDataFrame([], schema)


def first_object(text: Column, schema: str) -> Column:
    """The first JSON object of a text, typed; what follows it is ignored, null where none can be read."""
    depth = F.regexp_extract(text, r"^\s*(\{(?:[^{}\"]|\"(?:[^\"\\]|\\.)*\"|\{(?:[^{}\"]|\"(?:[^\"\\]|\\.)*\")*\})*\})", 1)
    return F.from_json(F.nullif(depth, F.lit("")), schema)

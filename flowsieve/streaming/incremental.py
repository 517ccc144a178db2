"""Incremental mode of the algebraic aggregates: the counts of batch mode, kept up to date file by file.

The reference has no streams; this only serves tables that arrive in parts. State is one row per group, so it stays
small, and the source's and state's checkpoints lie in the shared folder: a restarted query continues where it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowsieve import scratch


def count_files(spark: SparkSession, path: str, schema: StructType, keys: dict[str, Column], place: str | None = None, max_files: int = 1000) -> DataFrame:
    """Processes all files at `path` that are new since the last call with this `place`, and returns the counts so far."""
    at = place or f"{scratch.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    counts = rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/counts/{number % 2}")  # the last complete state stays readable
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{at}/last")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{at}/last").first().number
    return spark.read.parquet(f"{at}/counts/{last % 2}")

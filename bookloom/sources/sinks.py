"""Sinks: append-only queues, versioned tables, run reports, the take cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.operators.checks import review_queue, upserted


def append_review(found: DataFrame, path: str, attempts: int = 0) -> None:
    """Appends the first violations of each failing book and check to the review queue."""
    rows = review_queue(found).select(F.current_timestamp().alias("ts"), F.col("doc_id").alias("book"), "stage", "dimension", "unit_id", "message", F.lit(attempts).alias("attempts"))
    rows.write.mode("append").json(path)


def write_version(df: DataFrame, path: str, version: str) -> None:
    """Writes a table beside its earlier versions; nothing is overwritten but the version itself."""
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def write_report(results: DataFrame, path: str, run_id: str) -> None:
    """Writes the matrix of a run."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_baseline(baseline: DataFrame, current: DataFrame, path: str) -> None:
    """Writes the baseline with the current statuses over it to a new place."""
    upserted(baseline, current).orderBy("doc_id", "dimension").write.mode("errorifexists").parquet(path)


def append_takes(misses: DataFrame, make, schema: str, path: str) -> None:
    """Makes what the cache misses, in batches on the workers, and appends it; ``make`` turns an iterator of frames into one."""
    misses.dropDuplicates(["key"]).mapInPandas(make, schema).write.mode("append").parquet(path)


def export_json(df: DataFrame, path: str, by: str = "book_id") -> None:
    """One folder of JSON a book."""
    df.write.mode("overwrite").partitionBy(by).json(path)

"""Recomputing only what changed: content keys, cache misses, tolerant logs, windows to redo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions import text as X


def take_key(engine: Column, params: Column, text: Column) -> Column:
    """The content address of a take: engine, parameters in the order of their names, text."""
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return X.short_hash(engine, entries, text)


def cache_misses(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct keys (key) that are wanted and not held; deduplicated before the anti-join, so repeated texts are made once."""
    return wanted.select("key").distinct().join(held.select("key").distinct(), "key", "left_anti")


def live(index: DataFrame, rejected: DataFrame) -> DataFrame:
    """Index rows without those whose key was rejected."""
    return index.join(rejected.select("key").distinct(), "key", "left_anti")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    columns = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def windows_to_redo(violations: DataFrame, segments: DataFrame) -> DataFrame:
    """(book_id, window_key) of the windows whose segments have a fixable violation; violations are (doc_id, unit_id, fixable) with seg_uid units."""
    units = violations.filter("fixable").select(F.col("unit_id").cast("long").alias("seg_uid")).distinct()
    return segments.filter("window_key is not null").join(units, "seg_uid", "left_semi").select("book_id", "window_key").distinct()


def fresh(stored: Column, current: Column) -> Column:
    """Whether a stage may be skipped: no stamp was stored, or it is the current one."""
    return stored.isNull() | (stored == current)

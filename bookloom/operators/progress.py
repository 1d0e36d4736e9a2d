"""Pace and progress of rendering, in batch; :mod:`bookloom.streaming.pace` is its stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Minutes of the trailing window.
MINUTES = 30


def pace(log: DataFrame, by: str, at: str) -> DataFrame:
    """(by, total, recent, last_at, per_hour): rows in the last half hour before the newest; no pace from fewer than two."""
    newest = log.groupBy(by).agg(F.max(at).alias("last_at"), F.count("*").alias("total"))
    held = log.join(newest, by).filter(F.col(at) > F.col("last_at") - F.expr(f"INTERVAL {MINUTES} MINUTES"))
    recent = held.groupBy(by).agg(F.count("*").alias("recent"))
    return newest.join(recent, by).select(by, "total", "recent", "last_at", F.when(F.col("recent") < 2, 0.0).otherwise(F.col("recent") * 60.0 / MINUTES).alias("per_hour"))


def windows(log: DataFrame, by: str, at: str, length: str = "30 minutes", slide: str = "15 minutes") -> DataFrame:
    """(by, start, n): rows in sliding windows of event time."""
    own = log.groupBy(F.window(at, length, slide).alias("w"), by).agg(F.count("*").alias("n"))
    return own.select(by, F.col("w.start").alias("start"), "n")


def book_progress(segments: DataFrame, takes: DataFrame) -> DataFrame:
    """(book_id, segments, rendered, fraction, phase): how far each book is; the script is a tenth, rendering 85, mastering 5 hundredths."""
    want = segments.groupBy("book_id").agg(F.count_distinct("id").alias("segments"))
    done = takes.filter("duration_s is not null").groupBy("book_id").agg(F.count_distinct("segment_id").alias("rendered"))
    held = want.join(done, "book_id", "left").withColumn("rendered", F.coalesce("rendered", F.lit(0)))
    share = F.least(F.lit(1.0), F.col("rendered") / F.col("segments"))
    phase = F.when(F.col("rendered") == 0, "script").when(F.col("rendered") < F.col("segments"), "render").otherwise("master")
    return held.select("book_id", "segments", "rendered", F.round(F.lit(0.10) + share * 0.85, 6).alias("fraction"), phase.alias("phase"))

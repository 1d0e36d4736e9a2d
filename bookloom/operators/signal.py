"""Shapes in measured signals: runs of active frames, gaps between speech, levels, reference windows.

Samples and models stay outside; these work on frames, word times and measured
tables. A signal is one array in one row, or rows of one take, never a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dbfs(level: Column) -> Column:
    """Decibels below full scale, with a floor for silence."""
    return 20 * F.log10(F.greatest(level, F.lit(1e-12)))


def rms(samples: Column) -> Column:
    """Root mean square of an array of samples; 0 for none."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def frames(takes: DataFrame, key: str, samples: str, size: int) -> DataFrame:
    """(key, frame, level): levels of frames of ``size`` samples; a rest shorter than a frame is left out."""
    n = F.floor(F.size(samples) / size).cast("int")
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k < n)
    each = takes.select(key, F.posexplode(F.transform(places, lambda k: rms(F.slice(samples, k * size + 1, size)))).alias("frame", "level"))
    return each


def regions(levels: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, region, start, end) of runs of frames at or above a level; the end is the frame after the last."""
    o = W.partitionBy(key).orderBy("frame")
    own = levels.filter(F.col("level") >= threshold).withColumn("island", F.col("frame") - F.row_number().over(o))
    runs = own.groupBy(key, "island").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"))
    return runs.select(key, (F.row_number().over(W.partitionBy(key).orderBy("start")) - 1).alias("region"), "start", "end")


def onset_artifacts(found: DataFrame, key: str, frame_s: float = 0.02) -> DataFrame:
    """(key) of takes whose first burst starts early, is short, and is parted from what follows."""
    first = found.filter("region = 0").select(key, F.col("start").alias("a"), F.col("end").alias("b"))
    second = found.filter("region = 1").select(key, F.col("start").alias("c"))
    held = first.join(second, key)
    return held.filter((F.col("a") * frame_s < 0.15) & ((F.col("b") - F.col("a")) * frame_s <= 0.40) & ((F.col("c") - F.col("b")) * frame_s >= 0.20)).select(key)


def longest_gap(speech: DataFrame, key: str, total: str, guard: float = 0.5, most: float = 5.0) -> DataFrame:
    """(key, start, end): the longest span without speech, less a guard at both ends and centred to at most ``most`` seconds.

    ``speech`` has (key, start, end) of speech and the whole length ``total``.
    """
    o = W.partitionBy(key).orderBy("start")
    gaps = speech.select(key, F.coalesce(F.lag("end").over(o), F.lit(0.0)).alias("a"), F.col("start").alias("b"))
    tail = speech.groupBy(key).agg(F.max("end").alias("a"), F.first(total).alias("b"))
    spans = gaps.unionByName(tail).select(key, (F.col("a") + guard).alias("a"), (F.col("b") - guard).alias("b")).filter("b > a")
    best = spans.groupBy(key).agg(F.max_by(F.struct("a", "b"), F.col("b") - F.col("a")).alias("g")).select(key, "g.a", "g.b")
    cut = F.greatest(F.lit(0.0), (F.col("b") - F.col("a") - most) / 2)
    return best.select(key, (F.col("a") + cut).alias("start"), (F.col("b") - cut).alias("end"))


def speech_end(levels: DataFrame, key: str, frame_s: float = 0.02) -> DataFrame:
    """(key, end_s): the end of the last frame within 30 dB of the loudest and above -45 dB."""
    top = levels.groupBy(key).agg(F.max("level").alias("top"))
    held = levels.join(top, key).filter((dbfs(F.col("level")) >= dbfs(F.col("top")) - 30) & (dbfs(F.col("level")) > -45))
    return held.groupBy(key).agg(((F.max("frame") + 1) * frame_s).alias("end_s"))


def reference_windows(words: DataFrame, key: str, length: float = 10.0, longest_pause: float = 0.8) -> DataFrame:
    """(key, start, end): the run of timed segments nearest to a length, without a long pause inside; words are (key, start, end)."""
    o = W.partitionBy(key).orderBy("start")
    own = words.withColumn("pause", F.col("start") - F.lag("end").over(o)).withColumn("part", F.sum(F.when(F.coalesce(F.col("pause"), F.lit(0.0)) > longest_pause, 1).otherwise(0)).over(o))
    a = own.select(key, "part", F.col("start").alias("a"))
    b = own.select(key, "part", F.col("end").alias("b"))
    spans = a.join(b, [key, "part"]).filter((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= 2 * length))
    return spans.groupBy(key).agg(F.min_by(F.struct("a", "b"), F.struct(F.abs(F.col("b") - F.col("a") - length), "a")).alias("w")).select(key, F.col("w.a").alias("start"), F.col("w.b").alias("end"))


def gain_db(level_db: Column, target: float = -20.0, least: float = -12.0, most: float = 16.0) -> Column:
    """Gain to a target level, held within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.lit(target) - level_db))


def pace_factor(words: Column, seconds: Column, target_wpm: float = 130.0) -> Column:
    """Tempo factor to a target pace, held to 0.88 and 1.08; 1 within 3 per cent and for fewer than three words."""
    natural = words / (seconds / 60)
    factor = F.greatest(F.lit(0.88), F.least(F.lit(1.08), F.lit(target_wpm) / natural))
    return F.when((words < 3) | (seconds <= 0) | (F.abs(factor - 1) <= 0.03), 1.0).otherwise(factor)

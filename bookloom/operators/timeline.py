"""From segments and takes to a timed programme: gaps, starts, chapter markers, pace, duration checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions import text as X
from bookloom.operators.ordered import with_previous, with_running

# Seconds of silence before and after each type, between sentences, and at both ends of a book.
BEFORE = {"chapter_heading": 2.0, "section_heading": 1.2, "paragraph": 0.5, "blockquote": 0.7}
AFTER = {"chapter_heading": 1.5, "section_heading": 0.8, "paragraph": 0.0, "blockquote": 0.7}
SENTENCE, HEAD, TAIL = 0.55, 0.75, 2.0
#: Bounds of seconds a character, and of a take against its book's median.
SLOWEST, FASTEST, ABOVE, BELOW, LONG = 0.14, 0.045, 2.2, 0.45, 40


def _policy(kind: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, seconds in table.items():
        out = F.when(kind == name, F.lit(seconds)).otherwise(out)
    return out


def current_takes(takes: DataFrame) -> DataFrame:
    """(book_id, segment_id, duration_s, chars, hash): the last take of each segment that has a duration."""
    held = takes.filter("duration_s is not null")
    return held.groupBy("book_id", "segment_id").agg(F.max_by(F.struct("duration_s", "chars", "hash"), F.struct("rendered_at", "hash")).alias("t")).select("book_id", "segment_id", "t.*")


def timeline(segments: DataFrame, takes: DataFrame, section_mode: str = "pause") -> DataFrame:
    """(book_id, segment_id, chapter_id, type, seg_ord, start_s, duration_s, silence_before_s).

    With ``section_mode`` pause, section headings are not spoken and their pauses go to the segment behind them.
    """
    rows = segments.select("book_id", F.col("id").alias("segment_id"), "chapter_id", "type", "para_id", "seg_ord")
    flagged = with_previous(rows, ["book_id"], "seg_ord", ["type"], "raw").withColumn("after_heading", F.coalesce(F.col("raw.type") == "section_heading", F.lit(False)))
    if section_mode == "pause":
        flagged = flagged.filter("type <> 'section_heading'")
    spoken = flagged.join(current_takes(takes), ["book_id", "segment_id"])
    held = with_previous(spoken, ["book_id"], "seg_ord", ["type", "para_id"])
    plain = _policy(F.col("prev.type"), AFTER) + _policy(F.col("type"), BEFORE)
    extra = F.when(F.col("after_heading") & F.lit(section_mode == "pause"), BEFORE["section_heading"] + AFTER["section_heading"]).otherwise(0.0)
    gap = F.when(F.col("prev").isNull(), 0.0).when(F.col("prev.para_id") == F.col("para_id"), SENTENCE).otherwise(plain + extra)
    timed = with_running(held.withColumn("silence_before_s", gap), ["book_id"], "seg_ord", F.col("silence_before_s") + F.col("duration_s"), "_end")
    start = F.round(F.col("_end") - F.col("duration_s") + HEAD, 3)
    return timed.select("book_id", "segment_id", "chapter_id", "type", "seg_ord", start.alias("start_s"), "duration_s", F.round("silence_before_s", 3).alias("silence_before_s"))


def markers(line: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, id, title, start_ms, end_ms) of each chapter: it owns the pause before its first segment, and ends where the next starts."""
    starts = line.groupBy("book_id", "chapter_id").agg(F.min(F.col("start_s") - F.col("silence_before_s")).alias("s"), F.max(F.col("start_s") + F.col("duration_s")).alias("e"))
    o = W.partitionBy("book_id").orderBy("s")
    total = F.max("e").over(W.partitionBy("book_id")) + TAIL
    own = starts.withColumn("until", F.coalesce(F.lead("s").over(o), total))
    titles = chapters.select("book_id", F.col("id").alias("chapter_id"), "title").dropDuplicates(["book_id", "chapter_id"])
    ms = lambda c: F.floor(F.round(c * 1000, 2)).cast("long")
    return own.join(titles, ["book_id", "chapter_id"], "left").select("book_id", F.col("chapter_id").alias("id"), F.coalesce("title", "chapter_id").alias("title"), ms(F.col("s")).alias("start_ms"), ms(F.col("until")).alias("end_ms"))


def words_per_minute(segments: DataFrame, takes: DataFrame) -> DataFrame:
    """(book_id, words, seconds, wpm) over spoken seconds of all segments that have a take."""
    own = segments.select("book_id", F.col("id").alias("segment_id"), X.word_count(F.col("text")).alias("w")).join(current_takes(takes), ["book_id", "segment_id"])
    sums = own.groupBy("book_id").agg(F.sum("w").alias("words"), F.sum("duration_s").alias("s"))
    return sums.select("book_id", "words", F.round("s", 3).alias("seconds"), F.round(F.try_divide("words", F.col("s") / 60), 3).alias("wpm"))


def duration_outliers(takes: DataFrame) -> DataFrame:
    """(book_id, segment_id, ratio, median, mad, outlier) of takes of long enough texts, in whole microseconds a character.

    A take is an outlier if it is out of bounds or far from its book's median. Whole numbers are counted before the medians
    are taken, so what a book's task holds is its different ratios.
    """
    own = current_takes(takes).filter(F.col("chars") >= LONG).withColumn("ratio", F.floor(F.col("duration_s") * 1_000_000 / F.col("chars")))

    def median(rows: DataFrame, value: str, to: str) -> DataFrame:
        counted = rows.filter(F.col(value).isNotNull()).groupBy("book_id", value).agg(F.count("*").alias("n"))
        return counted.groupBy("book_id").agg(F.percentile(value, F.lit(0.5), F.col("n")).alias(to))

    near = own.join(median(own, "ratio", "median"), "book_id").withColumn("far", F.abs(F.col("ratio") - F.col("median")))
    held = near.join(median(near, "far", "mad"), "book_id")
    ratio = F.col("ratio")
    out = ~ratio.between(FASTEST * 1_000_000, SLOWEST * 1_000_000) | (ratio > ABOVE * F.col("median")) | (ratio < BELOW * F.col("median"))
    return held.select("book_id", "segment_id", "ratio", "median", F.when(F.col("mad") == 0, 5000.0).otherwise(F.col("mad")).alias("mad"), out.alias("outlier"))


def speaker_similarity(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, similarity): cosine to the label's centroid, which is taken again over the vectors at or above its median.

    Vectors are exploded by dimension, so centroids are plain grouped means with a partial step.
    """

    def centroids(rows: DataFrame) -> DataFrame:
        each = rows.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
        mean = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("r")).select("label", F.transform("r", lambda x: x["m"]).alias("c"))
        norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
        return mean.select("label", F.transform("c", lambda x: x / norm).alias("c"))

    def scored(rows: DataFrame, c: DataFrame) -> DataFrame:
        dot = F.aggregate(F.zip_with("embedding", "c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
        return rows.join(c, "label").withColumn("similarity", dot / norm).drop("c")

    own = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    first = scored(own, centroids(own))
    med = first.groupBy("label").agg(F.median("similarity").alias("m"))
    core = first.join(med, "label").filter(F.col("similarity") >= F.col("m")).select("vec_id", "label", "embedding")
    return scored(own, centroids(core)).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def collapse_guards(segments: DataFrame, wpm: float = 150.0) -> DataFrame:
    """(seg_uid, expected_s, token_cap): expected length of a take, and the most tokens a take of its text may have."""
    expected = X.word_count(F.col("text")) / wpm * 60
    return segments.select("seg_uid", F.round(expected, 4).alias("expected_s"), F.round(F.greatest(F.lit(15.0), expected * 4) * 13.5, 3).alias("token_cap"))

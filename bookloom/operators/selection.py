"""Small relational operators: samples, batches, first of a kind, set comparisons, fallbacks, silences against gaps.

None of them orders a whole table in one task: ranks run within a book or a
chapter, or over rows that were counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded_sample(rows: DataFrame, by: list[str], key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each group, the same ones for the same seed: those with the least hashes (a sampling operator)."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), key), key))
    return rows.withColumn("_p", place).filter(F.col("_p") <= most).drop("_p")


def first_of(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group (a bounded run over a book)."""
    return rows.withColumn("_p", F.row_number().over(W.partitionBy(*by).orderBy(order))).filter(F.col("_p") <= most).drop("_p")


def batches(rows: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """Rows with the number of their batch of ``size`` within a group."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("int"))


def most_frequent(rows: DataFrame, by: list[str], value: str, first: str) -> DataFrame:
    """(by, value, n): the most frequent value of each group, of equal ones that which came first; values are counted before they are compared."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(first).alias("_f"))
    return counted.groupBy(*by).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_f"))).alias("m")).select(*by, f"m.{value}", "m.n")


def best_candidate(rows: DataFrame, by: list[str], key: str, warnings: str, similarity: str) -> DataFrame:
    """(by, key): the candidate of each group with the fewest warnings, then the highest similarity."""
    return rows.groupBy(*by).agg(F.min_by(key, F.struct(warnings, -F.col(similarity), key)).alias(key))


def added(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are there after a change and were not before; the number of equal rows counts."""
    return after.select(*columns).exceptAll(before.select(*columns))


def unequal(found: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """Both sets' rows that the other lacks, with ``side``: found or expected; none if the sets are equal."""
    a, b = found.select(*columns).distinct(), expected.select(*columns).distinct()
    return a.join(b, columns, "left_anti").withColumn("side", F.lit("found")).unionByName(b.join(a, columns, "left_anti").withColumn("side", F.lit("expected")))


def listed_numbers(spec: Column, all_to: int = 6) -> Column:
    """A list such as 1-3,5 as an array of its numbers in order; an empty one is all from 1."""
    part = lambda p: F.sequence(F.split(F.trim(p), "-")[0].cast("int"), F.element_at(F.split(F.trim(p), "-"), -1).cast("int"))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), part))))
    return F.when(F.coalesce(F.trim(spec), F.lit("")) == "", F.sequence(F.lit(1), F.lit(all_to))).otherwise(numbers)


def with_fallback(rows: DataFrame, decisions: DataFrame, key: list[str], decision: str, fallback: Column) -> DataFrame:
    """Rows with the decision made for their key, or what the fallback rule says where none was."""
    own = decisions.groupBy(*key).agg(F.last(decision).alias("_d"))
    return rows.join(own, key, "left").withColumn(decision, F.coalesce("_d", fallback)).drop("_d")


def replaced(rows: DataFrame, newer: DataFrame, key: list[str], column: str) -> DataFrame:
    """Rows with a column taken from newer ones of the same key, where there are such, as recognised pages take the place of extracted ones."""
    own = newer.select(*key, F.col(column).alias("_n")).dropDuplicates(key)
    return rows.join(own, key, "left").withColumn(column, F.coalesce("_n", column)).drop("_n")


def allowed(sentences: DataFrame, patterns: DataFrame) -> DataFrame:
    """Sentences (doc_id, text, ...) with ``allowed``: whether a pattern for all documents (doc_id null) or their own matches their start.

    Patterns are a few rows a document; they are gathered to one array a document and go with its sentences by an equality join.
    """
    own = patterns.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set("pattern").alias("_own"))
    common = patterns.filter("doc_id is null").agg(F.collect_set("pattern").alias("_all"))
    held = sentences.join(own, "doc_id", "left").join(common.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"), "left")
    starts = F.exists(F.concat("_all", F.coalesce("_own", F.array().cast("array<string>"))), lambda p: F.regexp_like(F.trim("text"), F.concat(F.lit("^(?i:"), p, F.lit(")"))))
    return held.withColumn("allowed", F.coalesce(starts, F.lit(False))).drop("_own", "_all", "_one")


def uncovered_gaps(gaps: DataFrame, silences: DataFrame, slack: float = 0.35, bucket: float = 10.0) -> DataFrame:
    """Gaps (book_id, at, length) in which no run of silence (book_id, start, stop) covers the gap within the slack.

    Both are put into buckets of seconds, so the range join is an equality join and a filter.
    """
    asked = gaps.withColumn("_k", F.explode(F.sequence(F.floor((F.col("at") - slack) / bucket), F.floor((F.col("at") + F.col("length") + slack) / bucket))))
    held = silences.withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))
    met = asked.join(held, ["book_id", "_k"]).filter((F.col("start") <= F.col("at") + slack) & (F.col("stop") >= F.col("at") + F.col("length") - slack))
    return gaps.join(met.select("book_id", "at").distinct(), ["book_id", "at"], "left_anti")


def shifted(timeline: DataFrame, head: float) -> DataFrame:
    """A timeline with ``local_s``: seconds from the start of the chapter, after ``head`` seconds of it."""
    first = timeline.groupBy("book_id", "chapter_id").agg(F.min("start_s").alias("_f"))
    return timeline.join(first, ["book_id", "chapter_id"]).withColumn("local_s", F.round(F.col("start_s") - F.col("_f") + head, 6)).drop("_f")


def token_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """The share of the different tokens of each array that the other has; 0 for an empty one."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(F.array_distinct(a))), F.lit(0.0)), F.coalesce(F.try_divide(both, F.size(F.array_distinct(b))), F.lit(0.0))


def windows_done(log: DataFrame, plan: DataFrame) -> DataFrame:
    """(book_id, done, total): different windows in the log, at most as many as are planned; both have (book_id, window_key)."""
    total = plan.groupBy("book_id").agg(F.count_distinct("window_key").alias("total"))
    done = log.filter("window_key is not null").groupBy("book_id").agg(F.count_distinct("window_key").alias("n"))
    return total.join(done, "book_id", "left").select("book_id", F.least(F.coalesce("n", F.lit(0)), "total").alias("done"), "total")


def page_break_spans(pages: DataFrame, junk: DataFrame) -> DataFrame:
    """(book_id, number, span): the sentence that goes over the end of each page, of six words or more.

    Lines of ``junk`` (book_id, line) and page numbers are left out. Pages meet their next one by number, not by a window.
    """
    from bookloom.functions import text as X

    lines = pages.filter("text is not null").select("book_id", "number", F.posexplode(F.split("text", "\n")).alias("k", "raw")).withColumn("line", X.normalized(F.col("raw"), True))
    kept = lines.filter((F.col("line") != "") & ~F.col("line").rlike("^[0-9ivxlc]+$")).join(junk.select("book_id", "line").distinct(), ["book_id", "line"], "left_anti")
    rows = F.array_sort(F.collect_list(F.struct("k", F.trim("raw").alias("t"))))
    text = kept.groupBy("book_id", "number").agg(F.array_join(F.transform(rows, lambda x: x["t"]), " ").alias("t"))
    end = r"[.!?][\"')\]]*"
    tail = F.regexp_replace("t", rf"^.*{end}\s+(?=[A-Z\"'(\[])", "")
    head = F.regexp_extract("after", rf"^(.*?{end})(?:\s|$)", 1)
    after = text.select("book_id", (F.col("number") - 1).alias("number"), F.col("t").alias("after"))
    span = F.concat(tail, F.lit(" "), F.when(head != "", head).otherwise(F.col("after")))
    joined = text.join(after, ["book_id", "number"]).withColumn("span", X.normalized(F.regexp_replace(F.trim(span), r"(\w)-\s+(\w)", "$1$2")))
    return joined.filter(X.word_count(F.col("span")) >= 6).select("book_id", "number", "span")

"""Sources beside the parquet tables: word lists, whole texts, JSON artifacts, tolerant logs, sidecars and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.functions.text import lines, scrubbed, trimmed, upper_median
from bookloom.operators.ordered import with_running


def word_list(spark: SparkSession, *paths: str) -> DataFrame:
    """Distinct trimmed lower-case words (word) of text files, one a line; without a path the list is empty."""
    if not paths:
        return spark.createDataFrame([], "word string")
    return spark.read.text(list(paths)).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, each as one value."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_artifact(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents that span lines, by a given schema; what does not parse comes out as nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Rows of a JSON-lines log; torn lines and, with ``key``, rows without it are left out, and the last row of a key wins."""
    rows = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("_n")).select(F.from_json("value", schema).alias("r"), "_n", F.col("value"))
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    good = rows.filter(F.col("value").rlike(r"^\s*\{.*\}\s*$") & F.col("r").isNotNull()).select("r.*", "_n")
    if key is None:
        return good.filter(F.coalesce(*[F.col(n).isNotNull() for n in names])).drop("_n")
    last = good.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[n for n in names if n != key]), "_n").alias("_r"))
    return last.select(key, "_r.*")


def newest_log(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of the newest file of a folder, only what follows its last launch marker."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    newest = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
    rows = spark.read.format("binaryFile").load(path).join(newest, "path", "left_semi").select(F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line_no", "line"))
    marks = rows.filter(F.col("line").startswith("=== launch")).agg(F.coalesce(F.max("line_no"), F.lit(-1)).alias("mark"))
    return rows.join(F.broadcast(marks)).filter("line_no > mark").drop("mark")


def sidecar(spark: SparkSession, book_id: str, text: str | None) -> DataFrame:
    """(book_id, title, start_page, matter) of a declared chapter list in YAML, pages from 0; empty if there is none."""
    entries = (yaml.safe_load(text) or {}).get("chapters") or [] if text else []
    rows = [(book_id, str(e["title"]), int(e["start_page"]) - 1, e.get("matter", "body")) for e in entries]
    return spark.createDataFrame(rows, "book_id string, title string, start_page int, matter string")


def pages_from_spans(spans: DataFrame) -> DataFrame:
    """(book_id, page, block_ord, text, size) from extracted text spans (book_id, page, block_ord, kind, text, sizes).

    Text blocks only, scrubbed and trimmed, empty ones dropped; a block's size is the upper median of its spans'.
    """
    clean = trimmed(scrubbed(F.col("text")))
    own = spans.filter("kind = 0").select("book_id", "page", "block_ord", clean.alias("text"), F.round(upper_median(F.col("sizes")), 1).alias("size"))
    return own.filter("text <> ''")


def outline(entries: DataFrame) -> DataFrame:
    """Outline entries with levels and pages from 0; pages below 1 are null."""
    return entries.select("book_id", "ord", (F.col("level") - 1).alias("level"), F.trim("title").alias("title"), F.when(F.col("page") > 0, F.col("page") - 1).alias("page"))


def salvaged(replies: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, type, text): every whole {type, text} object of replies that may be cut off."""
    found = F.regexp_extract_all(text, F.lit(r'\{\s*"type"\s*:\s*"[^"]*"\s*,\s*"text"\s*:\s*"(?:[^"\\]|\\.)*"\s*\}'), F.lit(0))
    rows = replies.select(key, F.posexplode(found).alias("place", "o"))
    return rows.select(key, "place", F.from_json("o", "type string, text string").alias("r")).select(key, "place", "r.*")


def repaired_json(text):
    """A JSON reply without its code fence, stray backslashes and trailing commas."""
    out = F.regexp_replace(F.trim(text), "^```(?:json)?\\s*|\\s*```$", "")
    out = F.regexp_replace(out, r'\\(?!["\\/bfnrtu])', r"\\\\")
    return F.regexp_replace(out, r",\s*([}\]])", "$1")


def attempt_events(log: DataFrame) -> DataFrame:
    """(line_no, attempt, line): log lines with the attempt they belong to, counted by its markers; continuation lines go with theirs."""
    mark = F.when(F.col("line").rlike("^attempt [0-9]+"), 1).otherwise(0)
    return with_running(log.withColumn("_log", F.lit(0)), ["_log"], "line_no", mark, "attempt").select("line_no", "attempt", "line")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the pipeline; the defaults are the values it ships with."""

    header_zone: float = 0.12
    footer_zone: float = 0.90
    repeat_min_count: int = 3
    footnote_size_ratio: float = 0.85
    window_paragraphs: int = 6
    window_max_chars: int = 3500
    max_segment_chars: int = 900
    section_mode: str = "pause"
    silence_tolerance_ms: int = 150
    head_tone_s: float = 0.75
    tail_tone_s: float = 2.0
    extra: dict = field(default_factory=dict)

    @classmethod
    def read(cls, text: str) -> Settings:
        """Settings from YAML; keys that are none of the fields go to ``extra``."""
        tree = yaml.safe_load(text) or {}
        flat = {k: v for part in (tree.values() if all(isinstance(v, dict) for v in tree.values()) else [tree]) for k, v in part.items()}
        known = {k: v for k, v in flat.items() if k in cls.__dataclass_fields__ and k != "extra"}
        return cls(**known, extra={k: v for k, v in flat.items() if k not in known})

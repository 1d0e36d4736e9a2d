"""The trailing pace as a stream: sliding windows over a log with a watermark, late rows kept out by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet") -> DataFrame:
    """A folder of log files as a stream; each file is read once."""
    return spark.readStream.schema(schema).format(kind).load(path)


def windowed(log: DataFrame, by: str, at: str, late: str = "1 hour", length: str = "30 minutes", slide: str = "15 minutes") -> DataFrame:
    """(by, start, n) of a streamed log; rows later than ``late`` behind the newest are dropped with their windows' state."""
    own = log.withWatermark(at, late).groupBy(F.window(at, length, slide).alias("w"), by).agg(F.count("*").alias("n"))
    return own.select(by, F.col("w.start").alias("start"), "n")


def first_of_key(log: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Log rows whose key was not seen within the watermark, for append-only checkpoints that are read again."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark([key])

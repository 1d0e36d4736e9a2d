"""Order within long sequences: previous rows and running sums in chunks.

A window over a whole book would put a hot book into one task. Rows are put
into chunks of consecutive places instead; windows run within a chunk, one
summary row a chunk carries on to the next, and only those summaries are
ordered over a whole book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places in a chunk.
CHUNK = 1000


def with_previous(rows: DataFrame, by: list[str], order: str, columns: list[str], to: str = "prev") -> DataFrame:
    """``rows`` with a struct of ``columns`` of the row before, null for the first."""
    own = rows.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    one = F.struct(*columns)
    within = F.lag(one).over(W.partitionBy(*by, "_chunk").orderBy(order))
    last = own.groupBy(*by, "_chunk").agg(F.max_by(one, order).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(W.partitionBy(*by).orderBy("_chunk"))).drop("_last")
    return own.withColumn("_within", within).join(before, [*by, "_chunk"]).withColumn(to, F.coalesce("_within", "_before")).drop("_chunk", "_within", "_before")


def with_running(rows: DataFrame, by: list[str], order: str, value: Column, to: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row."""
    own = rows.withColumns({"_chunk": F.floor(F.col(order) / CHUNK), "_v": value})
    within = F.sum("_v").over(W.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    sums = own.groupBy(*by, "_chunk").agg(F.sum("_v").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("_offset", before).drop("_s")
    return own.withColumn("_within", within).join(offsets, [*by, "_chunk"]).withColumn(to, F.col("_within") + F.col("_offset")).drop("_chunk", "_v", "_within", "_offset")

"""Problem 9: filling containers of fixed capacity by harmonic classes.

An item of size s is in class k = floor(capacity / s): k such items always fit
one container, so each class fills containers with a fixed number of items, in
every worker on its own. Within a class the items go by size, so the containers
of a class differ little; the space that a container of the low classes (k of
at most ``LOW``) leaves is itself given to the items of the class which that
space is a harmonic size of, the largest that fit first. What no container
takes is packed by its own class. Items above the capacity are cut into full
containers and a rest, which is packed like any item.

Blocks of items are packed independently: an item's block is a hash of its key,
with so many blocks that each has about ``BLOCK`` items, and within it items go
by key. A container number is (block, container), so it depends on the items
alone, not on partitions or settings, and nothing is gathered in one place.

Defined cases: items without tokens and null sizes or keys of any kind are
left out only if their size is null or below 1; repeated rows are packed once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.session import written

#: Tokens a container holds.
CAPACITY = 2048
#: Classes whose containers take smaller items into the space they leave.
LOW = 32
#: Items packed together, on average; bounds the memory of a task.
BLOCK = 20_000


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Containers as lists of positions in ``sizes``; every size must be 1 to ``capacity``."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    by_class: dict[int, list[int]] = {}
    for i in order:
        by_class.setdefault(capacity // sizes[i], []).append(i)
    free = [(sizes[i], -i) for i in reversed(order)]  # ascending; the last that fits is the largest
    taken = bytearray(len(sizes))
    bins = []

    def largest(space: int) -> int:
        """The largest free item that fits ``space``, removed, or -1."""
        at = bisect_right(free, (space, 1))
        while at > 0:
            at -= 1
            i = -free.pop(at)[1]
            if not taken[i]:
                return i
        return -1

    for k in sorted(by_class):
        held: list[int] = []
        room = capacity
        for i in by_class[k]:
            if taken[i]:
                continue
            taken[i] = 1
            held.append(i)
            room -= sizes[i]
            if len(held) == k:
                while k <= LOW and room > 0 and (j := largest(room)) >= 0:
                    taken[j] = 1
                    held.append(j)
                    room -= sizes[j]
                bins.append(held)
                held, room = [], capacity
        if held:
            while room > 0 and (j := largest(room)) >= 0:
                taken[j] = 1
                held.append(j)
                room -= sizes[j]
            bins.append(held)
    return bins


def containers(items: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """Rows (container, key, piece, tokens); pieces count from 0 and only an item above the capacity has more than one."""
    kind = items.schema[key].dataType
    out = T.StructType([T.StructField("container", T.LongType()), T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("tokens", T.IntegerType())])
    sizes = written(items.select(key, F.col(size).cast("long").alias("_size")).filter(F.col("_size") >= 1).dropDuplicates([key]), "sizes")
    blocks = max(1, -(-sizes.count() // BLOCK))
    pieces = (
        sizes.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long"))
        .repartition(blocks, "_block")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_size") - 1) / capacity).cast("int"))))
        .select("_block", key, F.col("_piece").alias("piece"), F.least(F.lit(capacity).cast("long"), F.col("_size") - F.col("_piece") * capacity).cast("int").alias("tokens"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bins = pack(block.column(3).to_pylist(), capacity)
            take = np.fromiter((i for b in bins for i in b), np.int64, block.num_rows)
            numbers = np.repeat(np.arange(len(bins), dtype=np.int64), [len(b) for b in bins]) + (block.column(0)[0].as_py() << 32)
            own = block.take(pa.array(take))
            return pa.RecordBatch.from_arrays([pa.array(numbers), own.column(1), own.column(2), own.column(3)], names=["container", key, "piece", "tokens"])

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(0).to_numpy()
            ends = [*(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
            start = 0
            for end in ends:
                if held and held[-1].column(0)[0].as_py() != numbers[start]:
                    yield flush()
                    held = []
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield flush()

    return pieces.sortWithinPartitions("_block", key, "piece").mapInArrow(run, out)

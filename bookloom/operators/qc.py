"""The quality loop: run a stage, check it, redo only what failed, a bounded number of times, then queue or stop.

Each attempt is a table in the shared folder, so the lineage of a loop does not
grow and a lost executor costs one attempt at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.session import written

#: How often a stage is redone.
RETRIES = {4: 2, 5: 3}


@dataclass
class Outcome:
    """What a loop came to."""

    stage: int
    attempts: int
    passed: bool
    output: DataFrame
    left: DataFrame
    history: list[int] = field(default_factory=list)


def loop(stage: int, run: Callable[[], DataFrame], check: Callable[[DataFrame], DataFrame], retry: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Outcome:
    """Runs a stage until its checks find nothing that can be fixed, or the retries are used up.

    ``check`` gives violations (doc_id, dimension, unit_id, fixable); ``retry`` gets the output and the fixable ones.
    """
    output = written(run(), f"stage{stage}")
    history = []
    for attempt in range(RETRIES.get(stage, 0) + 1):
        found = written(check(output), f"violations{stage}")
        history.append(found.count())
        fixable = found.filter("fixable")
        last = attempt == RETRIES.get(stage, 0) or retry is None
        if history[-1] == 0 or last or fixable.isEmpty():
            return Outcome(stage, attempt + 1, history[-1] == 0, output, found, history)
        output = written(retry(output, fixable), f"stage{stage}")
    raise AssertionError("the loop ends within its retries")


def stubborn(history: DataFrame, least: int = 2) -> DataFrame:
    """(segment_id, failures) of segments that failed in at least ``least`` attempts; history is (attempt, segment_id)."""
    return history.groupBy("segment_id").agg(F.count_distinct("attempt").alias("failures")).filter(F.col("failures") >= least)


def redo(rows: DataFrame, bad: DataFrame, keys: list[str], again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with those whose keys are in ``bad`` made again; all others stay as they are."""
    keep = rows.join(bad.select(*keys).distinct(), keys, "left_anti")
    return keep.unionByName(again(rows.join(bad.select(*keys).distinct(), keys, "left_semi")))

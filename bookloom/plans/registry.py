"""All queries of the engine's own operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookloom.plans import chapters, folds, layout, narration, pages, quality, timeline

MODULES = (pages, layout, chapters, narration, timeline, quality, folds)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

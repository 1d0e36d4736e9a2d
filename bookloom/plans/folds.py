"""Queries of greedy folds and of the script that needs no writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookloom.operators import windows as Wn
from bookloom.plans.chapters import chapters_of
from bookloom.plans.narration import segments_of

QUERIES, ORACLE = {}, {}


def query(f, sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""
    QUERIES[f.__name__] = f
    if sql:
        ORACLE[f.__name__] = sql
    return f


def greedy(texts: str, limit: int, gap: int, most: int) -> str:
    """SQL for the number of the greedy group of each text of a list: parts held and characters of the open group go first, then the numbers."""
    new = f"a[1] = 0 OR a[1] >= {most} OR a[2] + x[1] + {gap} > {limit}"
    step = f"CASE WHEN {new} THEN [1, x[1] + {gap}] || a[3:] || [a[-1] + 1] ELSE [a[1] + 1, a[2] + x[1] + {gap}] || a[3:] || [a[-1]] END"
    return f"list_reduce([[0, 0, -1]] || list_transform({texts}, lambda t: [CAST(length(t) AS INTEGER)]), lambda a, x: {step})[4:]"


WINDOWS = rf"""
    WITH c AS (SELECT DISTINCT chapter_uid, string_split(text, chr(10) || chr(10)) AS ps FROM chapters WHERE text IS NOT NULL),
    q AS (SELECT chapter_uid, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM c),
    o AS (SELECT *, coalesce(sum(length(p) + 2) OVER (PARTITION BY chapter_uid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
                 CASE WHEN length(p) <= 3500 THEN [p] ELSE string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) END AS ss FROM q),
    g AS (SELECT chapter_uid, k, off, unnest(ss) AS s, generate_subscripts(ss, 1) AS j, unnest({greedy("ss", 3501, 1, 2**31 - 1)}) AS i FROM o),
    h AS (SELECT *, off + coalesce(sum(length(s) + 1) OVER (PARTITION BY chapter_uid, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM g),
    e AS (SELECT chapter_uid, k, i, min(pos) AS pos, string_agg(s, ' ' ORDER BY j) AS piece FROM h GROUP BY 1, 2, 3),
    l AS (SELECT chapter_uid, list(piece ORDER BY k, i) AS ws, list(pos ORDER BY k, i) AS ats FROM e GROUP BY 1),
    w AS (SELECT chapter_uid, unnest(ws) AS piece, unnest(ats) AS pos, generate_subscripts(ws, 1) AS n, unnest({greedy("ws", 3500, 2, 6)}) AS i FROM l),
    r AS (SELECT chapter_uid, i, min(pos) AS pos, string_agg(piece, chr(10) || chr(10) ORDER BY n) AS win FROM w GROUP BY 1, 2)
    SELECT chapter_uid, CAST(row_number() OVER (PARTITION BY chapter_uid ORDER BY i) - 1 AS INTEGER) AS place, CAST(pos AS INTEGER) AS "offset", win AS "window", substr(sha256(win), 1, 16) AS key FROM r WHERE regexp_matches(win, '\S')
"""


def window_packing(spark: SparkSession, sf: str) -> DataFrame:
    return Wn.windows(chapters_of(spark, sf))


query(window_packing, WINDOWS)


@query
def long_segment_split(spark: SparkSession, sf: str) -> DataFrame:
    return Wn.long_segments(segments_of(spark, sf))


@query
def passthrough_script(spark: SparkSession, sf: str) -> DataFrame:
    return Wn.passthrough(chapters_of(spark, sf))

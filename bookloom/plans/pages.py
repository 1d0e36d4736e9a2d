"""Queries over pages and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions import text as X
from bookloom.operators import dictionary as D
from bookloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def pages_of(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, repeated rows once."""
    return table(spark, sf, "pages").dropDuplicates(["page_uid"])


P = "(SELECT DISTINCT page_uid, book_id, number, text, page_height FROM pages)"
DICT = "(SELECT DISTINCT lower(trim(word)) AS word FROM lexicon WHERE lang = 'en' AND trim(word) <> '')"
#: Tokens of ``tok`` (tok) that are words, by the rule as it is stated.
KNOWN = f"""
    dict AS {DICT},
    ends AS (SELECT unnest(['s', 'es', 'ed', 'd', 'ing', 'ly']) AS e),
    base AS (SELECT DISTINCT tok, left(tok, length(tok) - length(e)) AS b FROM (SELECT DISTINCT tok FROM tok) t, ends WHERE suffix(tok, e) AND length(tok) - length(e) >= 2),
    forms AS (
        SELECT DISTINCT tok, tok AS f FROM tok
        UNION SELECT tok, b FROM base
        UNION SELECT tok, b || 'e' FROM base
        UNION SELECT tok, left(b, length(b) - 1) FROM base WHERE length(b) >= 3 AND right(b, 1) = substr(b, length(b) - 1, 1)
        UNION SELECT tok, left(b, length(b) - 1) || 'y' FROM base WHERE right(b, 1) = 'i'),
    known AS (SELECT DISTINCT tok FROM forms JOIN dict ON f = word)
"""
GARBAGE = "[\\x{FFFD}\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{E000}-\\x{F8FF}]"


@query(f"""
    SELECT page_uid, CAST(length(text) AS BIGINT) AS n_chars,
           round(CASE WHEN length(text) = 0 THEN 0.0 ELSE len(regexp_extract_all(text, '{GARBAGE}')) / length(text) END, 6) AS density
    FROM {P} WHERE text IS NOT NULL
""")
def page_quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    own = pages_of(spark, sf).filter("text is not null")
    return own.select("page_uid", F.length("text").cast("long").alias("n_chars"), F.round(X.garbage_density(F.col("text")), 6).alias("density"))


@query(f"SELECT word FROM {DICT}")
def dictionary_build(spark: SparkSession, sf: str) -> DataFrame:
    return D.dictionary(table(spark, sf, "lexicon"))


@query(f"""
    WITH tok AS (SELECT page_uid, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}'))) AS tok FROM {P} WHERE text IS NOT NULL), {KNOWN}
    SELECT p.page_uid, count(t.tok) AS tokens, coalesce(round(count(k.tok) / nullif(count(t.tok), 0), 6), 1.0) AS dict_word_ratio
    FROM {P} p LEFT JOIN tok t USING (page_uid) LEFT JOIN known k ON t.tok = k.tok WHERE p.text IS NOT NULL GROUP BY 1
""")
def dict_word_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return D.word_ratio(pages_of(spark, sf).filter("text is not null"), D.dictionary(table(spark, sf, "lexicon")), "page_uid")


@query(f"""
    WITH raw AS (SELECT page_uid, unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}')) AS raw FROM {P} WHERE text IS NOT NULL),
    tok AS (SELECT page_uid, raw, lower(raw) AS tok FROM raw), {KNOWN},
    s AS (SELECT page_uid, count(*) AS n, count(k.tok) AS hits, count(*) FILTER (WHERE k.tok IS NOT NULL OR NOT regexp_full_match(raw, '[A-Z][a-z]*')) AS prose
          FROM tok t LEFT JOIN known k ON t.tok = k.tok GROUP BY 1)
    SELECT p.page_uid, round(CASE WHEN n IS NULL THEN 1.0 WHEN prose < 3 THEN hits / n ELSE hits / prose END, 6) AS prose_ratio
    FROM {P} p LEFT JOIN s USING (page_uid) WHERE p.text IS NOT NULL
""")
def prose_word_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return D.prose_word_ratio(pages_of(spark, sf).filter("text is not null"), D.dictionary(table(spark, sf, "lexicon")), "page_uid")


@query(f"""
    WITH p AS (SELECT book_id, coalesce(length(text), 0) AS n FROM {P})
    SELECT book_id, count(*) AS pages, count(*) FILTER (WHERE n < 100) AS near_empty,
           round(count(*) FILTER (WHERE n < 100) / count(*), 6) AS share,
           count(*) > 3 AND count(*) FILTER (WHERE n < 100) / count(*) > 0.3 AS needs_ocr
    FROM p GROUP BY 1
""")
def ocr_gate(spark: SparkSession, sf: str) -> DataFrame:
    few = F.count(F.when(F.coalesce(F.length("text"), F.lit(0)) < 100, 1))
    own = pages_of(spark, sf).groupBy("book_id").agg(F.count("*").alias("pages"), few.alias("near_empty"))
    share = F.col("near_empty") / F.col("pages")
    return own.select("book_id", "pages", "near_empty", F.round(share, 6).alias("share"), ((F.col("pages") > 3) & (share > 0.3)).alias("needs_ocr"))


@query(f"""
    WITH p AS (SELECT DISTINCT page_uid, book_id, chars, dict_word_ratio, garbage_density FROM pages)
    SELECT book_id, count(*) FILTER (WHERE chars > 200) AS substantial,
           count(*) FILTER (WHERE chars > 200 AND garbage_density > 0.02) AS garbled,
           round(coalesce(count(*) FILTER (WHERE chars > 200 AND dict_word_ratio < 0.6) / nullif(count(*) FILTER (WHERE chars > 200), 0), 0), 6) AS poor_share,
           count(*) > 5 AND count(*) FILTER (WHERE coalesce(chars, 0) < 100) / count(*) > 0.3 AS mostly_empty
    FROM p GROUP BY 1
""")
def gate_shares(spark: SparkSession, sf: str) -> DataFrame:
    full = F.col("chars") > 200
    own = pages_of(spark, sf).groupBy("book_id").agg(
        F.count(F.when(full, 1)).alias("substantial"),
        F.count(F.when(full & (F.col("garbage_density") > 0.02), 1)).alias("garbled"),
        F.count(F.when(full & (F.col("dict_word_ratio") < 0.6), 1)).alias("poor"),
        F.count(F.when(F.coalesce("chars", F.lit(0)) < 100, 1)).alias("few"),
        F.count("*").alias("n"),
    )
    share = F.coalesce(F.try_divide("poor", "substantial"), F.lit(0.0))
    return own.select("book_id", "substantial", "garbled", F.round(share, 6).alias("poor_share"), ((F.col("n") > 5) & (F.col("few") / F.col("n") > 0.3)).alias("mostly_empty"))


@query(f"""
    WITH l AS (SELECT page_uid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM {P} WHERE text IS NOT NULL)
    SELECT page_uid, CAST(k AS INTEGER) AS line_no,
           lower(trim(regexp_replace(replace(replace(replace(translate(line, '“”‘’–—−' || chr(160), '""''''--- '), 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(173), ''),
             '[\\x{{09}}-\\x{{0D}}\\x{{1C}}-\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))) AS norm
    FROM l WHERE trim(replace(replace(line, chr(9), ' '), chr(13), ' ')) <> ''
""")
def normalized_lines(spark: SparkSession, sf: str) -> DataFrame:
    own = pages_of(spark, sf).filter("text is not null").select("page_uid", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    own = own.filter(F.trim(F.regexp_replace("line", "[\\t\\r]", " ")) != "")
    return own.select("page_uid", "line_no", X.normalized(F.col("line"), True).alias("norm"))


#: Words of a line that announces a figure.
FIGURE = r"\b(?:family tree|figure|fig\.|table|chart|diagram|map|plate|genealog)\b"
TOC = r"(?:\.\s*){4,}[0-9]*\s*$"


@query(rf"""
    WITH l AS (SELECT page_uid, trim(replace(replace(unnest(string_split(text, chr(10))), chr(9), ' '), chr(13), ' ')) AS line FROM {P} WHERE text IS NOT NULL),
    h AS (SELECT page_uid, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')[1] AS first FROM {P} WHERE text IS NOT NULL),
    c AS (SELECT page_uid, count(*) AS n, count(*) FILTER (WHERE regexp_matches(line, '{TOC}')) AS leaders,
                 count(*) FILTER (WHERE regexp_matches(line, '\s(?:[0-9]{{1,4}}|[ivxlc]{{1,7}})\s*$') OR contains(line, '•')) AS trail
          FROM l WHERE line <> '' GROUP BY 1)
    SELECT page_uid, n AS n_lines, leaders, trail, lower(trim(first)) IN ('contents', 'table of contents') OR leaders >= 3 OR (trail >= 4 AND trail / n >= 0.3) AS toc_like FROM c JOIN h USING (page_uid)
""")
def toc_like_pages(spark: SparkSession, sf: str) -> DataFrame:
    each = pages_of(spark, sf).filter("text is not null").select("page_uid", F.transform(X.lines(F.col("text")), lambda x: x["line"]).alias("l")).filter(F.size("l") > 0)
    leaders = F.size(F.filter("l", lambda x: x.rlike(TOC))).cast("long")
    trailing = F.size(F.filter("l", lambda x: x.rlike(r"\s(?:[0-9]{1,4}|[ivxlc]{1,7})\s*$") | x.contains("•"))).cast("long")
    headed = F.lower(F.trim(F.get("l", F.lit(0)))).isin("contents", "table of contents")
    own = each.select("page_uid", F.size("l").cast("long").alias("n_lines"), leaders.alias("leaders"), trailing.alias("trail"), headed.alias("toc_like"))
    return own.withColumn("toc_like", F.col("toc_like") | (F.col("leaders") >= 3) | ((F.col("trail") >= 4) & (F.col("trail") / F.col("n_lines") >= 0.3)))


@query(rf"""
    WITH l AS (SELECT page_uid, trim(replace(replace(unnest(string_split(text, chr(10))), chr(9), ' '), chr(13), ' ')) AS line FROM {P} WHERE text IS NOT NULL),
    c AS (SELECT page_uid, count(*) AS n, list_sort(list(length(line))) AS lens, count(*) FILTER (WHERE regexp_matches(line, '[.!?:;"”’)]$')) AS ended,
                 count(*) FILTER (WHERE len(list_filter(regexp_split_to_array(line, '[ \t\n\r]+'), lambda w: w <> '')) <= 2) AS few
          FROM l WHERE line <> '' GROUP BY 1),
    h AS (SELECT page_uid, trim(replace(replace(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')[1], chr(9), ' '), chr(13), ' ')) AS first FROM {P} WHERE text IS NOT NULL)
    SELECT page_uid, n AS n_lines, CAST(lens[n // 2 + 1] AS INTEGER) AS median_length, n >= 6 AND (length(first) < 60 AND regexp_matches(lower(first), '\b(?:family tree|figure|fig\.|table|chart|diagram|map|plate|genealog)\b') OR lens[n // 2 + 1] < 28 AND ended / n < 0.12 AND few / n >= 0.5) AS candidate FROM c JOIN h USING (page_uid)
""")
def non_prose_candidates(spark: SparkSession, sf: str) -> DataFrame:
    each = pages_of(spark, sf).filter("text is not null").select("page_uid", F.transform(X.lines(F.col("text")), lambda x: x["line"]).alias("l")).filter(F.size("l") > 0)
    n = F.size("l")
    own = each.select(
        "page_uid",
        n.cast("long").alias("n_lines"),
        X.upper_median(F.transform("l", F.length)).alias("median_length"),
        (F.size(F.filter("l", lambda x: x.rlike('[.!?:;"”’)]$'))) / n).alias("ended"),
        (F.size(F.filter("l", lambda x: F.size(X.words(x)) <= 2)) / n).alias("few"),
        ((F.length(F.get("l", F.lit(0))) < 60) & F.lower(F.get("l", F.lit(0))).rlike(FIGURE)).alias("figure"),
    )
    labels = (F.col("median_length") < 28) & (F.col("ended") < 0.12) & (F.col("few") >= 0.5)
    return own.select("page_uid", "n_lines", "median_length", ((F.col("n_lines") >= 6) & (F.col("figure") | labels)).alias("candidate"))


@query(f"""
    WITH p AS (SELECT book_id, number, text, coalesce(trim(text, chr(10) || chr(9) || chr(13) || ' ') = '', true) AS blank FROM {P}),
    w AS (SELECT *, lag(text) OVER o AS before, lag(blank) OVER o AS blank_before FROM p WINDOW o AS (PARTITION BY book_id ORDER BY number)),
    x AS (SELECT book_id, number, blank, NOT blank AND before IS NOT NULL AND NOT blank_before AND NOT regexp_matches(rtrim(before, chr(10) || chr(13) || ' '), '[.!?:;"”’)]$') AS goes_on FROM w)
    SELECT book_id, number, goes_on, CAST(count(*) FILTER (WHERE NOT goes_on) OVER (PARTITION BY book_id ORDER BY number) AS BIGINT) AS island FROM x
""")
def cross_page_reflow(spark: SparkSession, sf: str) -> DataFrame:
    from bookloom.operators import structural

    return structural.page_islands(pages_of(spark, sf))

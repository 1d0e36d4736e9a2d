"""Queries over chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions import text as X
from bookloom.operators import chapterize as Z
from bookloom.operators import chapters as C
from bookloom.operators import dictionary as D
from bookloom.plans.pages import KNOWN, pages_of
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


def chapters_of(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters, repeated rows once."""
    return table(spark, sf, "chapters").dropDuplicates(["chapter_uid"])


CH = "c AS (SELECT DISTINCT chapter_uid, book_id, id, title, level, source, matter, front_matter, start_page, end_page, text FROM chapters)"
PG = "p AS (SELECT DISTINCT page_uid, book_id, number, text FROM pages)"
#: Titles of front and back matter, titles that are no chapter's, and what only front matter says, in SQL.
SQL_FRONT = """(lower(trim(title)) IN ('contents', 'table of contents', 'copyright', 'title page', 'half title', 'dedication', 'figures', 'illustrations', 'maps', 'plates', 'tables', 'abbreviations', 'about the author', 'epigraph',
    'list of figures', 'list of tables', 'list of maps', 'list of illustrations', 'list of abbreviations') OR starts_with(lower(trim(title)), 'note on ') OR starts_with(lower(trim(title)), 'a note on ') OR regexp_full_match(lower(trim(title)), 'acknowledg[a-z0-9_]*'))"""
SQL_BACK = "regexp_matches(lower(trim(title)), '^(?:bibliograph|appendix|(?:references|works cited|index|indexes|notes|endnotes|glossary|further reading|about the author|also by)\\b)')"
SQL_JUNK = "(contains(lower(title), '.indd') OR contains(lower(title), '.pdf') OR contains(lower(title), 'amazon') OR suffix(lower(title), '-print') OR lower(title) = 'untitled' OR regexp_matches(lower(title), '^(?:[0-9]+_|cover\\b|blank\\b)'))"
SQL_SAYS_FRONT = "regexp_matches(lower(substr(text, 1, 3000)), 'all rights reserved|library of congress|printed in the united states|isbn[\\s:0-9-]')"
HEAD = "^(?i:chapter|part|book)\\s+(?i:[0-9]+|[ivxlc]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)\\b\\s*[:.-]?\\s*.{0,60}$"
LEADER = r"\.{3,}\s*[0-9]+\s*$"
SPANS = f"""
    {CH}, {PG}, n AS (SELECT book_id, max(number) + 1 AS n_pages FROM p GROUP BY 1),
    o AS (SELECT c.book_id, title, start_page, n_pages, row_number() OVER w - 1 AS ord, lead(start_page) OVER w AS nxt FROM c JOIN n USING (book_id) WHERE start_page IS NOT NULL
          WINDOW w AS (PARTITION BY c.book_id ORDER BY start_page, title)),
    s AS (SELECT book_id, CAST(ord AS INTEGER) AS ord, title, start_page, greatest(coalesce(nxt - 1, n_pages - 1), start_page) AS end_page FROM o
          UNION ALL SELECT book_id, -1, 'Front Matter', 0, start_page - 1 FROM o WHERE ord = 0 AND start_page > 0)"""


@query(f"WITH {SPANS} SELECT * FROM s")
def chapter_spans(spark: SparkSession, sf: str) -> DataFrame:
    starts = chapters_of(spark, sf).filter("start_page is not null").select("book_id", "title", "start_page")
    return C.spans(starts, pages_of(spark, sf))


@query(f"WITH {SPANS} SELECT s.book_id, ord, count(*) AS pages, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM s JOIN p ON p.book_id = s.book_id AND number BETWEEN start_page AND end_page GROUP BY 1, 2")
def chapter_pages(spark: SparkSession, sf: str) -> DataFrame:
    laid = C.pages_in(chapter_spans(spark, sf), pages_of(spark, sf).select("book_id", "number", F.coalesce(F.length("text"), F.lit(0)).alias("n")))
    return laid.groupBy("book_id", "ord").agg(F.count("*").alias("pages"), F.sum("n").alias("n_chars"))


@query(f"""
    WITH {CH}, {PG}, a AS (SELECT book_id, sum(coalesce(length(text), 0)) AS held FROM c GROUP BY 1), b AS (SELECT book_id, sum(coalesce(length(text), 0)) AS body FROM p GROUP BY 1)
    SELECT b.book_id, CAST(coalesce(held, 0) AS BIGINT) AS held, CAST(body AS BIGINT) AS body, round(coalesce(held, 0) / nullif(body, 0), 6) AS coverage, coalesce(coalesce(held, 0) / nullif(body, 0) < 0.97, false) AS violation
    FROM b LEFT JOIN a USING (book_id)
""")
def chapter_coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = F.sum(F.coalesce(F.length("text"), F.lit(0)))
    held = chapters_of(spark, sf).groupBy("book_id").agg(n.alias("held"))
    body = pages_of(spark, sf).groupBy("book_id").agg(n.alias("body"))
    out = body.join(held, "book_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    ratio = F.try_divide("held", "body")
    return out.select("book_id", "held", "body", F.round(ratio, 6).alias("coverage"), F.coalesce(ratio < 0.97, F.lit(False)).alias("violation"))


@query(rf"""
    WITH {CH}, {PG}, n AS (SELECT book_id, max(number) + 1 AS n_pages FROM p GROUP BY 1)
    SELECT chapter_uid, CASE WHEN {SQL_FRONT} THEN 'front' WHEN {SQL_BACK} AND start_page / n_pages > 0.5 THEN 'back' ELSE 'body' END AS found
    FROM c JOIN n USING (book_id)
""")
def chapter_matter(spark: SparkSession, sf: str) -> DataFrame:
    size = pages_of(spark, sf).groupBy("book_id").agg((F.max("number") + 1).alias("n_pages"))
    own = chapters_of(spark, sf).join(size, "book_id")
    return own.select("chapter_uid", C.matter(F.col("title"), F.col("start_page") / F.col("n_pages")).alias("found"))


@query(rf"""
    WITH {CH}, l AS (SELECT book_id, level, count(*) AS n, avg(CASE WHEN {SQL_JUNK} THEN 1.0 ELSE 0.0 END) AS junk FROM c WHERE start_page IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2)
    SELECT book_id, min(level) AS level FROM l WHERE n BETWEEN 2 AND 80 AND junk <= 0.3 GROUP BY 1
""")
def outline_level(spark: SparkSession, sf: str) -> DataFrame:
    return C.outline_level(chapters_of(spark, sf).filter("start_page is not null and title is not null"))


@query(rf"""
    WITH {CH}, x AS (SELECT chapter_uid, trim(unnest([title, 'Chapter ' || (level + 1) || '. ' || title, upper(title), 'INTRODUCTION', title || ' 12', title || ' ..... 12'])) AS p, unnest(range(6)) AS k FROM c WHERE title IS NOT NULL)
    SELECT chapter_uid, CAST(k AS INTEGER) AS k,
           length(p) BETWEEN 3 AND 90 AND NOT contains(p, chr(10)) AND NOT (regexp_matches(p, '{LEADER}') OR contains(p, '•')
             OR (regexp_matches(p, '\s[0-9]{{1,4}}$') AND NOT regexp_matches(p, '^(?i:chapter|part|book)\s+[0-9]{{1,4}}\s*$')) OR regexp_matches(p, '[-–]\s*[0-9]{{1,4}}\b') OR suffix(lower(p), 'contents'))
           AND (regexp_matches(p, '{HEAD}') OR (regexp_matches(lower(p), '^(?:introduction|preface|foreword|prologue|epilogue|conclusion)\b') AND length(p) < 40 AND upper(p) = p)) AS heading
    FROM x
""")
def heading_forms(spark: SparkSession, sf: str) -> DataFrame:
    own = chapters_of(spark, sf).filter("title is not null")
    t = F.col("title")
    forms = F.array(t, F.concat(F.lit("Chapter "), (F.col("level") + 1).cast("string"), F.lit(". "), t), F.upper(t), F.lit("INTRODUCTION"), F.concat(t, F.lit(" 12")), F.concat(t, F.lit(" ..... 12")))
    each = own.select("chapter_uid", F.posexplode(forms).alias("k", "p"))
    return each.select("chapter_uid", "k", C.is_heading(F.col("p")).alias("heading"))


@query(f"""
    WITH {CH}, m AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY id) - 1 AS place, coalesce(title, '') AS title FROM c),
    g AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY id) - 1 AS place, coalesce(title, '') AS title FROM c WHERE coalesce(matter, 'body') = 'body')
    SELECT coalesce(m.book_id, g.book_id) AS book_id, CAST(coalesce(m.place, g.place) AS INTEGER) AS place, coalesce(m.title, '<missing>') AS mine, coalesce(g.title, '<extra>') AS golden
    FROM m FULL JOIN g ON m.book_id = g.book_id AND m.place = g.place WHERE lower(coalesce(m.title, '<missing>')) <> lower(coalesce(g.title, '<extra>'))
""")
def chapter_titles_diff(spark: SparkSession, sf: str) -> DataFrame:
    own = chapters_of(spark, sf)
    place = F.row_number().over(W.partitionBy("book_id").orderBy("id")) - 1
    listed = lambda df: df.select("book_id", place.alias("place"), F.coalesce("title", F.lit("")).alias("title"))
    return C.titles_diff(listed(own), listed(own.filter(F.coalesce("matter", F.lit("body")) == "body")))


@query(rf"""
    WITH {CH} SELECT chapter_uid, {SQL_SAYS_FRONT} AS front_words,
           CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{LEADER}'))) AS BIGINT) AS leaders
    FROM c WHERE text IS NOT NULL AND NOT coalesce(front_matter, false)
""")
def front_matter_leaks(spark: SparkSession, sf: str) -> DataFrame:
    own = chapters_of(spark, sf).filter("text is not null and not coalesce(front_matter, false)")
    leaders = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(C.LEADER))).cast("long")
    return own.select("chapter_uid", C.says_front(F.substring("text", 1, 3000)).alias("front_words"), leaders.alias("leaders"))


@query(f"""
    WITH {CH}, tok AS (SELECT chapter_uid, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}'))) AS tok FROM c WHERE text IS NOT NULL), {KNOWN},
    r AS (SELECT chapter_uid, round(count(k.tok) / count(*), 6) AS ratio FROM tok t LEFT JOIN known k ON t.tok = k.tok GROUP BY 1)
    SELECT c.chapter_uid, coalesce(ratio, 1.0) AS ratio, coalesce(ratio, 1.0) < CASE WHEN length(text) < 1500 THEN 0.55 ELSE 0.75 END AS violation
    FROM c LEFT JOIN r USING (chapter_uid) WHERE text IS NOT NULL
""")
def body_chapter_quality(spark: SparkSession, sf: str) -> DataFrame:
    own = chapters_of(spark, sf).filter("text is not null").select("chapter_uid", "text")
    ratio = D.word_ratio(own, D.dictionary(table(spark, sf, "lexicon")), "chapter_uid")
    sized = own.select("chapter_uid", F.length("text").alias("n"))
    bar = F.when(F.col("n") < 1500, 0.55).otherwise(0.75)
    return ratio.join(sized, "chapter_uid").select("chapter_uid", F.col("dict_word_ratio").alias("ratio"), (F.col("dict_word_ratio") < bar).alias("violation"))


@query(f"""
    WITH {CH} SELECT chapter_uid, book_id, 'ch' || lpad(CAST(row_number() OVER (PARTITION BY book_id ORDER BY id) - 1 AS VARCHAR), 2, '0') AS new_id FROM c WHERE trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) <> ''
""")
def chapter_renumber(spark: SparkSession, sf: str) -> DataFrame:
    own = chapters_of(spark, sf).filter(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\n\\t\\r]+", "") != "")
    place = F.row_number().over(W.partitionBy("book_id").orderBy("id")) - 1
    return own.select("chapter_uid", "book_id", F.concat(F.lit("ch"), F.lpad(place.cast("string"), 2, "0")).alias("new_id"))


@query(rf"""
    WITH {CH} SELECT chapter_uid, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[0-9]{{1,3}}\.\s+[A-Z][^.]*, [0-9]{{1,4}}'))) AS BIGINT) AS notes,
           CAST(len(regexp_extract_all(text, '[a-z][.,;][0-9]{{1,3}}\s')) AS BIGINT) AS markers
    FROM c WHERE text IS NOT NULL
""")
def inline_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    own = chapters_of(spark, sf).filter("text is not null")
    notes = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*[0-9]{1,3}\.\s+[A-Z][^.]*, [0-9]{1,4}"))).cast("long")
    return own.select("chapter_uid", notes.alias("notes"), F.regexp_count("text", F.lit(r"[a-z][.,;][0-9]{1,3}\s")).cast("long").alias("markers"))


@query(f"""
    WITH {CH}, x AS (SELECT chapter_uid, trim(p, ' ' || chr(10)) AS p FROM c, unnest(string_split(text, chr(10) || chr(10))) AS u(p))
    SELECT chapter_uid, count(*) FILTER (WHERE length(p) > 200) AS long_paragraphs, count(*) FILTER (WHERE length(p) > 200 AND NOT regexp_matches(p, '[.!?:;"”’)»。！？।؟]$')) AS broken FROM x GROUP BY 1
""")
def paragraph_reflow(spark: SparkSession, sf: str) -> DataFrame:
    own = chapters_of(spark, sf).filter("text is not null")
    p = F.transform(F.split("text", "\n\n"), lambda x: F.regexp_replace(x, "^[ \\n]+|[ \\n]+$", ""))
    long = F.filter(p, lambda x: F.length(x) > 200)
    return own.select("chapter_uid", F.size(long).cast("long").alias("long_paragraphs"), F.size(F.filter(long, lambda x: ~x.rlike('[.!?:;"”’)»。！？।؟]$'))).cast("long").alias("broken"))


@query(f"WITH {CH} SELECT chapter_uid, coalesce(matter, 'body') AS matter, coalesce(title, id) AS title, start_page + 1 AS first_page, end_page + 1 AS last_page, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')), 0) AS INTEGER) AS words FROM c")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    own = chapters_of(spark, sf)
    return own.select("chapter_uid", F.coalesce("matter", F.lit("body")).alias("matter"), F.coalesce("title", "id").alias("title"), (F.col("start_page") + 1).alias("first_page"), (F.col("end_page") + 1).alias("last_page"), X.word_count(F.col("text")).alias("words"))


UNSPACED = "array_to_string(list_transform(string_split(regexp_replace({0}, '\\b((?:[A-Za-z] ){{2,}}[A-Za-z])\\b', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x, i: CASE WHEN i % 2 = 0 THEN replace(x, ' ', '') ELSE x END), '')"
IS_CONTENTS = rf"""(len(ls) > 0 AND (lower(trim(ls[1])) IN ('contents', 'table of contents') OR len(list_filter(ls, lambda x: regexp_matches(x, '{LEADER}'))) >= 3
    OR (len(list_filter(ls, lambda x: regexp_matches(x, '\s(?:[0-9]{{1,4}}|[ivxlc]{{1,7}})\s*$') OR contains(x, '•'))) >= 4
        AND len(list_filter(ls, lambda x: regexp_matches(x, '\s(?:[0-9]{{1,4}}|[ivxlc]{{1,7}})\s*$') OR contains(x, '•'))) / len(ls) >= 0.3)))"""
IS_HEAD = rf"""(length(p) BETWEEN 3 AND 90 AND NOT contains(p, chr(10)) AND NOT regexp_matches(p, '{LEADER}') AND NOT contains(p, '•') AND NOT regexp_matches(p, '[-–]\s*[0-9]{{1,4}}\b') AND NOT suffix(lower(p), 'contents')
    AND (NOT regexp_matches(p, '\s[0-9]{{1,4}}$') OR regexp_matches(p, '^(?i:chapter|part|book)\s+[0-9]{{1,4}}$'))
    AND (regexp_matches(p, '{HEAD}') OR (regexp_matches(lower(p), '^(?:introduction|preface|foreword|prologue|epilogue|conclusion)\b') AND length(p) < 40 AND upper(p) = p)))"""


@query(rf"""
    WITH {PG}, l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM p WHERE text IS NOT NULL),
    k AS (SELECT book_id, number, string_split(text, chr(10) || chr(10)) AS ps FROM l WHERE NOT {IS_CONTENTS}),
    e AS (SELECT book_id, number, i, {UNSPACED.format("trim(ps[i])")} AS p FROM k, LATERAL (SELECT unnest(generate_series(1, len(ps))) AS i))
    SELECT book_id, number AS start_page, CAST(min(i) - 1 AS INTEGER) AS place FROM e WHERE {IS_HEAD} GROUP BY 1, 2
""")
def heading_starts(spark: SparkSession, sf: str) -> DataFrame:
    return Z.heading_starts(pages_of(spark, sf)).select("book_id", "start_page", "place")


@query(f"""
    WITH {CH}, {PG}, n AS (SELECT book_id, count(*) AS n_pages, min(number) AS first, max(number) AS last FROM p GROUP BY 1),
    d AS (SELECT book_id, start_page, title, matter FROM c WHERE start_page IS NOT NULL AND matter IS NOT NULL),
    o AS (SELECT book_id, start_page, title, CAST(NULL AS VARCHAR) AS matter FROM c WHERE start_page IS NOT NULL),
    x AS (SELECT *, 'declared' AS source FROM d UNION ALL SELECT *, 'outline' FROM o WHERE book_id IN (SELECT book_id FROM o GROUP BY 1 HAVING count(*) >= 2) AND book_id NOT IN (SELECT book_id FROM d GROUP BY 1 HAVING count(*) >= 3)),
    g AS (SELECT * FROM x WHERE source = 'outline' OR book_id IN (SELECT book_id FROM d GROUP BY 1 HAVING count(*) >= 3)),
    w AS (SELECT g.*, n_pages, first, last, row_number() OVER b - 1 AS ord, lead(start_page) OVER b AS nxt FROM g JOIN n USING (book_id) WINDOW b AS (PARTITION BY g.book_id ORDER BY start_page, title)),
    r AS (SELECT book_id, ord, title, coalesce(matter, CASE WHEN {SQL_FRONT} THEN 'front' WHEN {SQL_BACK} AND start_page / greatest(1, n_pages) > 0.5 THEN 'back' ELSE 'body' END) AS matter, source, start_page, greatest(coalesce(nxt - 1, last), start_page) AS end_page FROM w
          UNION ALL SELECT book_id, -1, 'Front Matter', 'front', source, first, start_page - 1 FROM w WHERE ord = 0 AND start_page > first
          UNION ALL SELECT book_id, 0, 'Full Text', 'body', 'none', first, last FROM n WHERE book_id NOT IN (SELECT book_id FROM g))
    SELECT book_id, CAST(ord AS INTEGER) AS ord, title, matter, source, start_page, end_page FROM r
""")
def strategy_cascade(spark: SparkSession, sf: str) -> DataFrame:
    own = chapters_of(spark, sf).filter("start_page is not null").select("book_id", "start_page", "title", "matter")
    chosen = Z.chosen_starts([("declared", own.filter("matter is not null"), 3), ("outline", own.drop("matter"), 2)])
    return Z.chapters_between(chosen, pages_of(spark, sf)).drop("place")


@query(f"""
    WITH {SPANS}, k AS (SELECT s.book_id, s.ord, number, text FROM s JOIN p ON p.book_id = s.book_id AND number BETWEEN start_page AND end_page WHERE coalesce(text, '') <> '')
    SELECT s.book_id, s.ord, CAST(coalesce(sum(len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: true))), 0) AS BIGINT) AS paragraphs FROM s LEFT JOIN k ON k.book_id = s.book_id AND k.ord = s.ord GROUP BY 1, 2
""")
def chapter_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of each chapter, kept and dropped; none is lost between pages and chapters."""
    spans = chapter_spans(spark, sf).withColumns({"place": F.lit(0), "matter": F.lit("body"), "source": F.lit("outline")})
    parts = Z.page_parts(spans, pages_of(spark, sf))
    # A dropped page of contents is one entry, whatever its paragraphs; it counts as them here.
    counted = parts.join(pages_of(spark, sf).select("book_id", "number", F.size(F.split("text", "\n\n")).alias("n")), ["book_id", "number"])
    whole = F.exists("dropped", lambda d: d["reason"] == "mini_toc")
    sums = counted.groupBy("book_id", "ord").agg(F.sum(F.when(whole, F.col("n")).otherwise(F.size("kept") + F.size("dropped"))).alias("k"))
    return spans.select("book_id", "ord").join(sums, ["book_id", "ord"], "left").select("book_id", "ord", F.coalesce("k", F.lit(0)).cast("long").alias("paragraphs"))


@query()
def chapters_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters of all books by the cascade of headings by words and by size."""
    from bookloom.operators import structural as S

    blocks, pages = S.blocks_of(table(spark, sf, "blocks"), table(spark, sf, "pages")), pages_of(spark, sf)
    return Z.chapterized(pages, blocks, S.body_size(blocks), D.dictionary(table(spark, sf, "lexicon")))

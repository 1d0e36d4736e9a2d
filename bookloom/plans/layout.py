"""Queries over blocks: margins, templates, footnotes, removals, repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions import text as X
from bookloom.operators import dictionary as D
from bookloom.operators import reflow as R
from bookloom.operators import structural as S
from bookloom.plans.pages import DICT
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


def blocks_of(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with the height of their page, repeated rows once."""
    return S.blocks_of(table(spark, sf, "blocks"), table(spark, sf, "pages"))


NL = "chr(10)"
HEIGHTS = "(SELECT book_id, number AS page, any_value(page_height) AS page_height FROM pages GROUP BY ALL)"
B = f"""b AS (
    SELECT x.*, CASE WHEN p.page_height > 0 THEN p.page_height ELSE 1.0 END AS h, x.bbox.y0 AS y0, x.bbox.y1 AS y1
    FROM (SELECT DISTINCT block_uid, book_id, page, block_ord, bbox, text, size FROM blocks) x
    LEFT JOIN (SELECT DISTINCT book_id, number AS page, page_height FROM pages) p USING (book_id, page))"""
#: Lines of the blocks that are not blank, trimmed, with their place.
L = f"""l AS (
    SELECT * FROM (SELECT b.*, unnest(generate_series(0, len(string_split(text, {NL})) - 1)) AS line_no FROM b WHERE text IS NOT NULL) z,
    LATERAL (SELECT trim(replace(replace(string_split(z.text, {NL})[z.line_no + 1], chr(9), ' '), chr(13), ' ')) AS line) y WHERE line <> '')"""
#: A line's template; letter-spaced runs are closed up letter by letter between two marks.
T = """t AS (
    SELECT *, trim(regexp_replace(lower(regexp_replace(array_to_string(list_transform(
        string_split(regexp_replace(line, '\\b((?:[A-Za-z] ){2,}[A-Za-z])\\b', chr(1) || '\\1' || chr(1), 'g'), chr(1)),
        lambda x, i: CASE WHEN i % 2 = 0 THEN replace(x, ' ', '') ELSE x END), ''), '[0-9]+', '#', 'g')), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM l)"""
Z = "CASE WHEN y1 < h * 0.12 THEN 'header' WHEN y0 > h * 0.90 THEN 'footer' END"
TEMPLATES = f"m AS (SELECT book_id, zone, t, count(DISTINCT page) AS pages FROM (SELECT *, {Z} AS zone FROM t) WHERE zone IS NOT NULL AND length(t) >= 2 GROUP BY 1, 2, 3 HAVING count(DISTINCT page) >= 3)"
SIZE = "s AS (SELECT book_id, coalesce((SELECT size FROM (SELECT size, sum(coalesce(length(text), 0)) AS n FROM b i WHERE i.book_id = o.book_id AND size > 0 GROUP BY 1) ORDER BY n DESC, size LIMIT 1), 10.0) AS body_size FROM (SELECT DISTINCT book_id FROM b) o)"
NOTE = r"^\s*(?:[0-9]{1,3}\.\s|\*|†)"
FOOT = rf"""f AS (
    SELECT b.*, body_size, len(list_filter(string_split(text, {NL}), lambda x: regexp_matches(x, '{NOTE}'))) AS notes,
           len(string_split(CASE WHEN suffix(text, {NL}) THEN text[:-2] ELSE text END, {NL})) AS n_lines FROM b JOIN s USING (book_id) WHERE text IS NOT NULL)"""
IS_FOOT = rf"""coalesce((size > 0 AND size < body_size * 0.85 AND y0 > h * 0.62) OR (size > 0 AND size < body_size * 0.97 AND regexp_matches(text, '{NOTE}') AND y0 > h * 0.4)
    OR (y0 > h * 0.4 AND notes >= greatest(1, n_lines // 2) AND size <= body_size), false)"""
CAPTION = r"^\s*(?i:figure|fig\.|table|map|plate|illustration|photo)\s+[0-9]+[.:]"


@query(f"WITH {B}, {L}, {T}, {TEMPLATES} SELECT book_id, zone, t, pages FROM m")
def margin_templates(spark: SparkSession, sf: str) -> DataFrame:
    return S.templates(S.blocks_of(table(spark, sf, "blocks"), table(spark, sf, "pages"), once=False))


@query(f"WITH {B}, {SIZE} SELECT * FROM s")
def body_font_size(spark: SparkSession, sf: str) -> DataFrame:
    return S.body_size(blocks_of(spark, sf))


@query(f"WITH {B}, {SIZE}, {FOOT} SELECT block_uid, {IS_FOOT} AS footnote, regexp_matches(text, '{CAPTION}') AS caption FROM f")
def footnote_blocks(spark: SparkSession, sf: str) -> DataFrame:
    own = blocks_of(spark, sf)
    held = own.filter("text is not null").join(S.body_size(own), "book_id")
    foot = S.is_footnote(F.col("size"), F.col("bbox.y0"), F.col("h"), F.col("body_size"), F.col("text"))
    return held.select("block_uid", foot.alias("footnote"), F.col("text").rlike(S.CAPTION).alias("caption"))


@query(f"WITH {B}, {L} SELECT block_uid, CAST(line_no AS INTEGER) AS line_no FROM l WHERE regexp_matches(line, '^(?:[0-9 ]{{1,6}}|[ivxlcIVXLC]{{1,7}})$')")
def page_number_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.block_lines(blocks_of(spark, sf)).filter(X.is_page_number(F.col("line"))).select("block_uid", "line_no")


@query(f"""
    WITH {B}, {L}, {T}, {TEMPLATES}, {SIZE}, {FOOT}, o AS (SELECT book_id, t, bool_or(zone = 'header') AS head FROM m GROUP BY 1, 2), k AS (SELECT block_uid, {IS_FOOT} AS foot, regexp_matches(text, '{CAPTION}') AS cap FROM f),
    r AS (SELECT t.block_uid, line_no, t.book_id, page, block_ord, y0, bbox, coalesce(head AND size <= body_size * 1.15, false) AS head, CASE WHEN foot THEN 'footnote' WHEN cap THEN 'caption' WHEN regexp_matches(line, '^(?:[0-9 ]{{1,6}}|[ivxlcIVXLC]{{1,7}})$') THEN 'page_number'
                 WHEN {Z} IS NOT NULL AND o.t IS NOT NULL THEN 'margin_line' END AS reason
          FROM t JOIN k ON t.block_uid = k.block_uid JOIN s ON s.book_id = t.book_id LEFT JOIN o ON t.book_id = o.book_id AND t.t = o.t),
    g AS (SELECT block_uid, line_no, coalesce(reason, CASE WHEN head AND count(*) FILTER (WHERE reason IS NULL AND NOT head) OVER (PARTITION BY book_id, page ORDER BY round_even(y0, 0) NULLS FIRST, bbox.x0 NULLS FIRST, block_ord, line_no) = 0 THEN 'first_line' END) AS reason FROM r)
    SELECT block_uid, CAST(line_no AS INTEGER) AS line_no, reason FROM g WHERE reason IS NOT NULL
""")
def removal_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return S.removals(blocks_of(spark, sf))


@query(f"""
    WITH {B} SELECT block_uid, CAST(row_number() OVER (PARTITION BY book_id, page ORDER BY round_even(y0, 0) NULLS FIRST, bbox.x0 NULLS FIRST, block_ord) - 1 AS INTEGER) AS place FROM b
""")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("book_id", "page").orderBy(F.bround("bbox.y0"), "bbox.x0", "block_ord")) - 1
    return blocks_of(spark, sf).select("block_uid", place.alias("place"))


@query(rf"""
    WITH {B}, {L}, n AS (SELECT book_id, page, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS line FROM l),
    body AS (SELECT c.book_id, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS line, count(*) AS body_count
             FROM (SELECT DISTINCT chapter_uid, book_id, text FROM chapters) c, unnest(string_split(c.text, {NL})) AS u(x) GROUP BY 1, 2),
    h AS (SELECT book_id, line, count(DISTINCT page) AS page_count FROM n WHERE length(line) >= 4 AND NOT regexp_matches(line, '^(?:[0-9 ]+|[ivxlc]+)$') GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3),
    tot AS (SELECT book_id, count(DISTINCT page) AS n FROM b GROUP BY 1)
    SELECT book_id, line, page_count, coalesce(body_count, 0) AS body_count, page_count >= greatest(2, floor(n * 0.2)) AS fifth_of_pages
    FROM h JOIN tot USING (book_id) LEFT JOIN body USING (book_id, line)
""")
def running_headers(spark: SparkSession, sf: str) -> DataFrame:
    flat = lambda line: F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))
    # Pages are counted once each, so copies of blocks change nothing and no text is shuffled to remove them.
    own = table(spark, sf, "blocks").select("book_id", "page", "text")
    lines = S.block_lines(own).select("book_id", "page", flat(F.col("line")).alias("line"))
    lines = lines.filter((F.length("line") >= 4) & ~F.col("line").rlike("^(?:[0-9 ]+|[ivxlc]+)$"))
    heads = lines.groupBy("book_id", "line").agg(F.count_distinct("page").alias("page_count")).filter("page_count >= 3")
    body = table(spark, sf, "chapters").select("book_id", "chapter_uid", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("book_id", "chapter_uid", "k", flat(F.col("line")).alias("line"))
    # Only lines that recur are counted in the body: the large side is cut by the small one before copies go and it is grouped.
    body = body.join(heads.select("book_id", "line"), ["book_id", "line"], "left_semi").distinct().groupBy("book_id", "line").agg(F.count("*").alias("body_count"))
    pages = own.groupBy("book_id").agg(F.count_distinct("page").alias("n"))
    out = heads.join(pages, "book_id").join(body, ["book_id", "line"], "left")
    return out.select("book_id", "line", "page_count", F.coalesce("body_count", F.lit(0)).alias("body_count"), (F.col("page_count") >= F.greatest(F.lit(2), F.floor(F.col("n") * 0.2))).alias("fifth_of_pages"))


@query(rf"""
    WITH s AS (SELECT DISTINCT seg_uid, text FROM segments WHERE text IS NOT NULL)
    SELECT seg_uid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-z0-9])([.!?])([A-Z])', '\1\2 \3', 'g'), '([a-z])([,;:])([A-Za-z])', '\1\2 \3', 'g'),
           '([.!?,;:]["”’])([A-Za-z])', '\1 \2', 'g'), '([,;:.!?])([“"])([A-Za-z])', '\1 \2\3', 'g') AS repaired
    FROM s
""")
def punctuation_repair(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "segments").filter("text is not null").dropDuplicates(["seg_uid"])
    return own.select("seg_uid", S.repair_spacing(F.col("text")).alias("repaired"))


@query(f"""
    WITH {B}, {L}, w AS (SELECT block_uid, line_no, line, lead(line) OVER (PARTITION BY block_uid ORDER BY line_no) AS nxt FROM l),
    k AS (SELECT block_uid, line_no, lower(regexp_extract(line, '([A-Za-z]+)[-‐]$', 1)) AS a, lower(regexp_extract(nxt, '^([A-Za-z]+)', 1)) AS z FROM w WHERE regexp_matches(line, '[A-Za-z][-‐]$') AND regexp_matches(nxt, '^[A-Za-z]')),
    d AS {DICT}
    SELECT block_uid, CAST(line_no AS INTEGER) AS line_no,
           CASE WHEN (SELECT count(*) FROM d WHERE word = a || z) = 0 AND (SELECT count(*) FROM d WHERE word = a) > 0 AND (SELECT count(*) FROM d WHERE word = z) > 0 AND length(a) >= 4 THEN a || '-' || z ELSE a || z END AS word
    FROM k
""")
def dehyphenation(spark: SparkSession, sf: str) -> DataFrame:
    own = blocks_of(spark, sf).filter("text is not null").select("block_uid", X.lines(F.col("text")).alias("l"))
    pairs = F.transform("l", lambda x, k: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.get("l", k + 1)["line"].alias("nxt")))
    broken = own.select("block_uid", F.inline(pairs)).filter(F.col("line").rlike("[A-Za-z][-‐]$") & F.col("nxt").rlike("^[A-Za-z]"))
    cut = broken.select("block_uid", "line_no", F.lower(F.regexp_extract("line", "([A-Za-z]+)[-‐]$", 1)).alias("a"), F.lower(F.regexp_extract("nxt", "^([A-Za-z]+)", 1)).alias("z"))
    words = D.dictionary(table(spark, sf, "lexicon"))
    out = cut
    for name, value in (("fused", F.concat("a", "z")), ("left", F.col("a")), ("right", F.col("z"))):
        out = out.withColumn("_k", value).join(words.select(F.col("word").alias("_k"), F.lit(True).alias(name)), "_k", "left").drop("_k")
    known = [F.coalesce(name, F.lit(False)) for name in ("fused", "left", "right")]
    return out.select("block_uid", "line_no", D.joined_break(F.col("a"), F.col("z"), *known).alias("word"))


@query(rf"""
    WITH {B}, {L}, m AS (SELECT block_uid, count(*) AS n, list_sort(list(length(line)))[count(*) // 2 + 1] AS med FROM l GROUP BY 1),
    w AS (SELECT l.block_uid, line_no, n, med, line, lead(line) OVER o AS nxt FROM l JOIN m USING (block_uid) WINDOW o AS (PARTITION BY l.block_uid ORDER BY line_no)),
    e AS (SELECT *, CASE WHEN n >= 4 AND regexp_matches(line, '[.!?:;"”’)]$') AND length(line) < med * 0.72 AND coalesce(regexp_matches(nxt, '^[A-Z"“''‘(]'), false) THEN 1 ELSE 0 END AS f FROM w),
    g AS (SELECT block_uid, CAST(coalesce(sum(f) OVER (PARTITION BY block_uid ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS paragraph FROM e)
    SELECT block_uid, paragraph, count(*) AS n_lines FROM g GROUP BY 1, 2
""")
def indent_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return S.paragraphs(blocks_of(spark, sf))


@query(rf"""
    WITH s AS (SELECT DISTINCT chapter_uid, book_id, text FROM chapters WHERE text IS NOT NULL)
    SELECT chapter_uid, CAST(length(text) AS BIGINT) AS n_chars,
           CAST(len(regexp_extract_all(text, '[a-z][.!?][A-Z]')) AS BIGINT) AS fused,
           length(text) >= 5000 AND len(regexp_extract_all(text, '[a-z][.!?][A-Z]')) * 1000.0 / length(text) > 0.3 AS violation
    FROM s
""")
def punctuation_spacing(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "chapters").filter("text is not null").dropDuplicates(["chapter_uid"])
    fused, n = F.regexp_count("text", F.lit("[a-z][.!?][A-Z]")).cast("long"), F.length("text").cast("long")
    return own.select("chapter_uid", n.alias("n_chars"), fused.alias("fused"), ((n >= 5000) & (fused * 1000.0 / n > 0.3)).alias("violation"))


@query()
def footnote_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters without the markers of footnotes in their text; SQL has no look around, tests have the cases."""
    own = table(spark, sf, "chapters").filter("text is not null").dropDuplicates(["chapter_uid"])
    plain = S.without_markers(F.col("text"))
    return own.select("chapter_uid", plain.alias("text"), (F.length("text") - F.length(plain)).alias("dropped"))


@query(f"""
    WITH s AS (SELECT DISTINCT chapter_uid, text FROM chapters WHERE text IS NOT NULL), d AS {DICT},
    m AS (SELECT chapter_uid, regexp_extract_all(replace(text, chr(1), ''), '\\b[A-Za-z]{{2,}}- [a-z]{{2,}}\\b') AS found FROM s),
    x AS (SELECT chapter_uid, unnest(found) AS w FROM m),
    k AS (SELECT x.chapter_uid, count(*) AS n, count(d.word) AS fused FROM x LEFT JOIN d ON d.word = lower(replace(w, '- ', '')) WHERE NOT regexp_matches(w, '- (?:and|or|nor|und|oder|to)$') GROUP BY 1)
    SELECT chapter_uid, CAST(coalesce(n, 0) AS BIGINT) AS broken, CAST(coalesce(fused, 0) AS BIGINT) AS fused FROM s LEFT JOIN k USING (chapter_uid)
""")
def spaced_hyphens(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a hyphen and a space part, per chapter: how many there were, and how many are one word without it."""
    own = table(spark, sf, "chapters").filter("text is not null").dropDuplicates(["chapter_uid"]).select("chapter_uid", "text")
    made = R.spaced_hyphens(own, ["chapter_uid"], D.dictionary(table(spark, sf, "lexicon"))).withColumnRenamed("text", "made")
    both = own.join(made, "chapter_uid")
    # A fused word loses the hyphen and the space, another the space alone.
    lost, n = F.length("text") - F.length("made"), F.regexp_count("text", F.lit(r"\b[A-Za-z]{2,}- (?!(?:and|or|nor|und|oder|to)\b)[a-z]{2,}\b"))
    return both.select("chapter_uid", n.cast("long").alias("broken"), (lost - n).cast("long").alias("fused"))


@query()
def page_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The paragraphs of each page without what is not narrated, printed lines joined."""
    return R.block_paragraphs(blocks_of(spark, sf), D.dictionary(table(spark, sf, "lexicon")))


@query()
def reflowed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The text of each page after paragraphs that go on over blocks and pages are one."""
    words = D.dictionary(table(spark, sf, "lexicon"))
    pages = table(spark, sf, "pages").dropDuplicates(["page_uid"])
    return R.page_texts(R.flowed(page_paragraphs(spark, sf), pages, words), words)

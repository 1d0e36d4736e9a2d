"""Queries over narration segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions import text as X
from bookloom.operators import dictionary as D
from bookloom.operators import narration as N
from bookloom.operators import script as Sc
from bookloom.operators import selection as Se
from bookloom.plans.pages import DICT, KNOWN
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


def segments_of(spark: SparkSession, sf: str) -> DataFrame:
    """Segments, repeated rows once."""
    return table(spark, sf, "segments").dropDuplicates(["seg_uid"])


SG = "s AS (SELECT DISTINCT seg_uid, book_id, seg_ord, id, chapter_id, type, text, para_id, sentence_index, source_span FROM segments)"
SAID = r"^(?i:(?:(?:he|she|I|we|they)\s+)?(?:asked|exclaimed|cried|said|replied|shouted|answered|muttered|whispered)[.!?]?)$"
PROSE = "('paragraph', 'blockquote')"
BARE = r"^[^A-Za-z0-9À-ɏͰ-ϿЀ-ӿ\x{0900}-\x{097F}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]+$"
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(rf"""
    WITH {SG}, x AS (SELECT seg_uid, type, text, regexp_replace(regexp_replace(regexp_replace(text, '^{WS}|{WS}$', '', 'g'),
             '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(2), 'g'), '\b((?:{"|".join(N.HONORIFICS)})\.)' || chr(2), '\1 ', 'g') AS marked FROM s WHERE text IS NOT NULL),
    p AS (SELECT seg_uid, type, text, list_filter(list_transform(string_split(marked, chr(2)), lambda y: trim(y)), lambda y: y <> '') AS ps FROM x),
    e AS (SELECT seg_uid, type, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM p WHERE type IN {PROSE}),
    f AS (SELECT *, regexp_matches(p, '{BARE}') AS bare, regexp_matches(p, '{SAID}') AS attr FROM e),
    g AS (SELECT *, sum(CASE WHEN NOT bare AND NOT attr THEN 1 ELSE 0 END) OVER (PARTITION BY seg_uid ORDER BY k) AS solid,
                 min(CASE WHEN NOT bare THEN k END) OVER (PARTITION BY seg_uid) AS first_k FROM f),
    h AS (SELECT seg_uid, CASE WHEN solid = 0 THEN 0 WHEN first_k < (SELECT min(k) FROM f i WHERE i.seg_uid = g.seg_uid AND NOT bare AND NOT attr) THEN solid ELSE solid - 1 END AS idx, k, p FROM g WHERE k >= first_k),
    j AS (SELECT seg_uid, CAST(idx AS INTEGER) AS sentence_index, string_agg(p, ' ' ORDER BY k) AS text FROM h GROUP BY 1, 2)
    SELECT * FROM j UNION ALL SELECT seg_uid, 0, text FROM s WHERE text IS NOT NULL AND type NOT IN {PROSE}
    UNION ALL SELECT seg_uid, 0, text FROM s WHERE text IS NOT NULL AND type IN {PROSE} AND seg_uid NOT IN (SELECT seg_uid FROM j)
""")
def sentence_explode(spark: SparkSession, sf: str) -> DataFrame:
    return N.sentences(segments_of(spark, sf))


JOINS = rf"""j AS (
    SELECT *, coalesce(type IN {PROSE} AND lead(type) OVER o IN {PROSE} AND (regexp_matches(trim(text), '{N.INITIAL_END}') OR regexp_matches(trim(text), '{N.ABBREVIATION_END}'))
        AND length(trim(lead(text) OVER o)) > 0, false) AS joins FROM s WINDOW o AS (PARTITION BY book_id, chapter_id ORDER BY seg_ord))"""


@query(f"""
    WITH {SG}, {JOINS}, g AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY book_id, chapter_id ORDER BY seg_ord), false) AS goes_on FROM j),
    i AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, chapter_id ORDER BY seg_ord) AS island FROM g)
    SELECT book_id, chapter_id, min(seg_ord) AS first_ord, count(*) AS n, coalesce(string_agg(text, ' ' ORDER BY seg_ord), '') AS text FROM i GROUP BY book_id, chapter_id, island
""")
def split_adjudication(spark: SparkSession, sf: str) -> DataFrame:
    return N.adjudicated(segments_of(spark, sf))


PLAIN = "lower(regexp_replace({}, '[^A-Za-z0-9À-ɏЀ-ӿ]+', '', 'g'))"


@query(f"""
    WITH {SG}, w AS (SELECT seg_uid, text, row_number() OVER o AS place, first(text) OVER o AS announced, first(type) OVER o AS opens FROM s WINDOW o AS (PARTITION BY book_id, chapter_id ORDER BY seg_ord))
    SELECT seg_uid FROM w WHERE place BETWEEN 2 AND 5 AND opens = 'chapter_heading' AND length(text) < 90 AND {PLAIN.format("text")} = {PLAIN.format("announced")} AND {PLAIN.format("text")} <> ''
""")
def opening_title_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return N.opening_duplicates(segments_of(spark, sf))


@query(f"""
    WITH {SG}, l AS (SELECT DISTINCT type, min_chars, max_chars FROM length_limits WHERE item = 'segment')
    SELECT seg_uid, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, CASE WHEN coalesce(length(text), 0) < coalesce(min_chars, 1) THEN 'short' ELSE 'long' END AS kind
    FROM s LEFT JOIN l USING (type) WHERE coalesce(length(text), 0) < coalesce(min_chars, 1) OR length(text) > coalesce(max_chars, 900)
""")
def segment_length_limits(spark: SparkSession, sf: str) -> DataFrame:
    return N.length_violations(segments_of(spark, sf), table(spark, sf, "length_limits"))


@query(f"""
    WITH {SG}, d AS {DICT}, x AS (SELECT seg_uid, regexp_extract_all(text, '[A-Za-z]{{2,}}') AS toks FROM s WHERE text IS NOT NULL AND length(trim(text)) < 60),
    t AS (SELECT seg_uid, lower(unnest(toks)) AS tok FROM x), r AS (SELECT seg_uid, avg(CASE WHEN word IS NULL THEN 1.0 ELSE 0.0 END) AS oov FROM t LEFT JOIN d ON tok = word GROUP BY 1)
    SELECT x.seg_uid FROM x LEFT JOIN r USING (seg_uid) WHERE coalesce(oov, 1.0) >= 0.4
""")
def map_label_segments(spark: SparkSession, sf: str) -> DataFrame:
    return Sc.map_labels(segments_of(spark, sf), D.dictionary(table(spark, sf, "lexicon")))


@query(rf"""
    WITH {SG}, x AS (SELECT seg_uid, text, regexp_replace(text, '[ \t\n\r]+', '', 'g') AS shown FROM s WHERE text IS NOT NULL)
    SELECT seg_uid FROM x WHERE regexp_matches(trim(text), '^\(\s*[A-Z][A-Za-z.''’-]+,?\s+[0-9]{{4}}[a-z]?[^)]{{0,80}}\)\s*[.;,]?$')
       OR (length(shown) >= 20 AND length(regexp_replace(shown, '[^A-Za-zÀ-ɏͰ-ϿЀ-ӿ\x{{0600}}-\x{{06FF}}\x{{0900}}-\x{{0DFF}}\x{{0E00}}-\x{{0E7F}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}]', '', 'g')) < 0.5 * length(shown))
""")
def content_free_segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments_of(spark, sf).filter(N.content_free(F.col("text"))).select("seg_uid")


NUMBERS = "|".join(N.NUMBER_WORDS)
#: A text without its number words and digits, token by token.
BLIND = f"""array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'),
    lambda w: CASE WHEN regexp_full_match(lower(w), '{NUMBERS}') THEN ' ' ELSE regexp_replace(w, '[0-9]+', ' ', 'g') END), '')"""


@query(rf"WITH {SG} SELECT seg_uid, trim(regexp_replace({BLIND}, '[ \t\n\r]+', ' ', 'g')) AS blind FROM s WHERE text IS NOT NULL")
def numeric_blind(spark: SparkSession, sf: str) -> DataFrame:
    return segments_of(spark, sf).filter("text is not null").select("seg_uid", N.numeric_blind(F.col("text")).alias("blind"))


@query(f"""
    WITH {SG} SELECT seg_uid, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT regexp_full_match(w, '[0-9]+') AND NOT regexp_full_match(w, '{NUMBERS}|and')), ' ') AS skeleton FROM s WHERE text IS NOT NULL
""")
def number_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return segments_of(spark, sf).filter("text is not null").select("seg_uid", F.array_join(N.skeleton(F.col("text")), " ").alias("skeleton"))


@query(rf"""
    WITH {SG} SELECT seg_uid, regexp_matches(text, '[0-9¼½¾⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞]') AS digits, regexp_matches(text, '{N.BARE_ROMAN}') AS romans, regexp_matches(text, '{N.ERA_CENTURY}') AS arithmetic_year
    FROM s WHERE text IS NOT NULL
""")
def number_style(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    own = segments_of(spark, sf).filter("text is not null")
    return own.select("seg_uid", t.rlike("[0-9¼½¾⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞]").alias("digits"), t.rlike(N.BARE_ROMAN).alias("romans"), t.rlike(N.ERA_CENTURY).alias("arithmetic_year"))


@query(rf"""
    WITH {SG}, b AS (SELECT seg_uid, {BLIND} AS text FROM s WHERE type IN {PROSE} AND length(text) >= 40),
    raw AS (SELECT seg_uid, unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}')) AS raw FROM b), tok AS (SELECT seg_uid, raw, lower(raw) AS tok FROM raw), {KNOWN},
    q AS (SELECT seg_uid, count(*) AS n, count(k.tok) AS hits, count(*) FILTER (WHERE k.tok IS NOT NULL OR NOT regexp_full_match(raw, '[A-Z][a-z]*')) AS prose FROM tok t LEFT JOIN known k ON t.tok = k.tok GROUP BY 1),
    r AS (SELECT b.seg_uid, round(CASE WHEN n IS NULL THEN 1.0 WHEN prose < 3 THEN hits / n ELSE hits / prose END, 6) AS ratio FROM b LEFT JOIN q USING (seg_uid))
    SELECT seg_uid, ratio FROM r WHERE ratio < 0.55
""")
def segment_text_quality(spark: SparkSession, sf: str) -> DataFrame:
    own = segments_of(spark, sf).filter(F.col("type").isin(*N.PROSE) & (F.length("text") >= 40))
    blind = own.select("seg_uid", F.regexp_replace("text", rf"(?i)[0-9]+|\b(?:{NUMBERS})\b", " ").alias("text"))
    ratio = D.prose_word_ratio(blind, D.dictionary(table(spark, sf, "lexicon")), "seg_uid")
    return ratio.filter("prose_ratio < 0.55").withColumnRenamed("prose_ratio", "ratio")


@query(f"""
    WITH {SG}, q AS (SELECT seg_uid AS key, book_id, chapter_id, source_span.start + (source_span."end" - source_span.start) // 2 AS pos FROM s WHERE source_span IS NOT NULL)
    SELECT q.key, arg_min(s.seg_uid, (s.seg_ord, s.seg_uid)) AS seg_uid FROM q JOIN s ON s.book_id = q.book_id AND s.chapter_id = q.chapter_id AND pos >= s.source_span.start AND pos < s.source_span."end" GROUP BY 1
""")
def span_cover(spark: SparkSession, sf: str) -> DataFrame:
    own = segments_of(spark, sf)
    a, b = F.col("source_span.start"), F.col("source_span.end")
    asked = own.filter("source_span is not null").select(F.col("seg_uid").alias("key"), "book_id", "chapter_id", (a + F.floor((b - a) / 2)).alias("at"))
    return N.at_positions(asked, own)


@query(f"""
    WITH {SG}, d AS {DICT}, t AS (SELECT book_id, unnest(regexp_extract_all(text, '[A-Za-z]{{3,}}')) AS raw FROM s WHERE text IS NOT NULL),
    c AS (SELECT book_id, lower(raw) AS term, count(*) AS n, count(*) FILTER (WHERE regexp_matches(raw, '^[A-Z]')) AS caps FROM t GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN caps / n >= 0.6 THEN 'name' WHEN n >= 3 THEN 'term' END AS kind FROM c WHERE term NOT IN (SELECT word FROM d)),
    r AS (SELECT book_id, term, n, kind, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN kind = 'name' THEN 0 ELSE 1 END, n DESC, term) AS place FROM k WHERE kind IS NOT NULL)
    SELECT book_id, term, n, kind, CAST(place AS INTEGER) AS place FROM r WHERE place <= 200
""")
def book_terms(spark: SparkSession, sf: str) -> DataFrame:
    return N.book_terms(segments_of(spark, sf), D.dictionary(table(spark, sf, "lexicon")))


@query(f"""
    WITH {SG} SELECT seg_uid, NOT coalesce(regexp_full_match(id, 'seg_[0-9]{{4,}}'), false) AS bad_id, coalesce(text, '') = '' AS no_text, type NOT IN ('chapter_heading', 'section_heading', 'paragraph', 'blockquote') AS bad_type FROM s
""")
def narration_schema(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("chapter_heading", "section_heading", "paragraph", "blockquote")
    return segments_of(spark, sf).select("seg_uid", (~F.coalesce(F.col("id").rlike("^seg_[0-9]{4,}$"), F.lit(False))).alias("bad_id"), (F.coalesce("text", F.lit("")) == "").alias("no_text"), (~F.col("type").isin(*kinds)).alias("bad_type"))


@query(f"""
    WITH {SG}, o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seg_ord) - 1 AS n, row_number() OVER (PARTITION BY book_id, para_id ORDER BY seg_ord) - 1 AS k FROM s)
    SELECT seg_uid, CASE WHEN n < 10000 THEN 'seg_' || lpad(CAST(n AS VARCHAR), 4, '0') ELSE 'seg_' || n END AS new_id, CAST(k AS INTEGER) AS sentence_index FROM o
""")
def segment_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return Sc.numbered(segments_of(spark, sf)).select("seg_uid", "new_id", "sentence_index")


@query(rf"""
    WITH {SG}, x AS (SELECT seg_uid, text, coalesce(type, '') = 'chapter_heading' AS head FROM s WHERE text IS NOT NULL), d AS {DICT},
    t AS (SELECT seg_uid, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}'))) AS tok FROM x WHERE NOT head AND length(trim(text)) < 60),
    r AS (SELECT seg_uid, count(*) AS n, count(word) AS hits FROM t LEFT JOIN d ON tok = word GROUP BY 1),
    k AS (SELECT seg_uid, regexp_replace(text, '[ \t\n\r]+', '', 'g') AS shown, head, text FROM x)
    SELECT k.seg_uid FROM k LEFT JOIN r USING (seg_uid) WHERE head OR NOT (
        regexp_matches(trim(text), '^\(\s*[A-Z][A-Za-z.''’-]+,?\s+[0-9]{{4}}[a-z]?[^)]{{0,80}}\)\s*[.;,]?$')
        OR (length(shown) >= 20 AND length(regexp_replace(shown, '[^A-Za-zÀ-ɏͰ-ϿЀ-ӿ\x{{0600}}-\x{{06FF}}\x{{0900}}-\x{{0DFF}}\x{{0E00}}-\x{{0E7F}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}]', '', 'g')) < 0.5 * length(shown))
        OR (length(trim(text)) < 60 AND (coalesce(n, 0) = 0 OR (n - hits) * 10 >= n * 4)))
""")
def script_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return Sc.cleaned(segments_of(spark, sf), D.dictionary(table(spark, sf, "lexicon"))).select("seg_uid")


@query()
def assembled_script(spark: SparkSession, sf: str) -> DataFrame:
    """The whole script: cleaned, spoken, cut into sentences, joined where wrongly split, numbered."""
    return Sc.assembled(segments_of(spark, sf), D.dictionary(table(spark, sf, "lexicon")))


@query(rf"""
    WITH {SG}, b AS (SELECT seg_uid, lower(trim(regexp_replace(regexp_replace(text, '(?i)[0-9]+|\b(?:{"|".join(N.NUMBER_WORDS)})\b', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS t FROM s WHERE text IS NOT NULL)
    SELECT seg_uid, array_to_string(list_filter(regexp_extract_all(replace(replace(replace(t, '-', ' '), '’', ''), chr(39), ''), '[a-z]+'), lambda w: w <> 'and'), ' ') AS words FROM b
""")
def tolerance_words(spark: SparkSession, sf: str) -> DataFrame:
    own = segments_of(spark, sf).filter("text is not null")
    return own.select("seg_uid", F.array_join(Sc.tolerance_tokens(F.col("text")), " ").alias("words"))


@query()
def heard_tolerably(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed takes whose transcript differs from the segment at most in names and terms of the book."""
    segments = segments_of(spark, sf).filter("text is not null")
    heard = table(spark, sf, "take_review").filter("transcript is not null").dropDuplicates(["review_id"]).select("review_id", "book_id", F.col("segment_id").alias("id"), "transcript")
    terms = N.book_terms(segments, D.dictionary(table(spark, sf, "lexicon"))).groupBy("book_id").agg(F.collect_set("term").alias("terms"))
    pairs = heard.join(segments.select("book_id", "id", "text"), ["book_id", "id"]).join(terms, "book_id", "left")
    return Sc.tolerable(pairs, "text", "transcript", "terms").select("review_id", "tolerable")


@query(r"""
    WITH c AS (SELECT DISTINCT chapter_uid, id, title FROM chapters)
    SELECT chapter_uid, coalesce(nullif(substr(regexp_replace(trim(regexp_replace(title, '[^\p{L}\p{N} -]', '', 'g')), ' +', '_', 'g'), 1, 60), ''), id) AS name FROM c
""")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "chapters").dropDuplicates(["chapter_uid"])
    return own.select("chapter_uid", Sc.safe_name(F.col("title"), F.col("id")).alias("name"))


@query(f"""
    WITH {SG}, n AS (SELECT book_id, type, count(*) AS n, min(seg_ord) AS f FROM s WHERE type IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, f) AS k FROM n)
    SELECT book_id, type, n FROM r WHERE k = 1
""")
def usual_type(spark: SparkSession, sf: str) -> DataFrame:
    return Se.most_frequent(segments_of(spark, sf), ["book_id"], "type", "seg_ord")


@query(f"WITH {SG}, o AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_id ORDER BY seg_ord) - 1 AS k FROM s) SELECT seg_uid, CAST(k // 25 AS INTEGER) AS batch FROM o")
def segment_batches(spark: SparkSession, sf: str) -> DataFrame:
    return Se.batches(segments_of(spark, sf), ["book_id", "chapter_id"], "seg_ord", 25).select("seg_uid", "batch")


@query(f"""
    WITH {SG}, x AS (SELECT *, ['1-3,5', '', '2', '4-6,1'][CAST(seg_ord % 4 AS INTEGER) + 1] AS spec FROM s), l AS (SELECT DISTINCT spec FROM x)
    SELECT spec, CASE spec WHEN '' THEN '1 2 3 4 5 6' WHEN '1-3,5' THEN '1 2 3 5' WHEN '2' THEN '2' ELSE '1 4 5 6' END AS stages FROM l
""")
def stage_lists(spark: SparkSession, sf: str) -> DataFrame:
    spec = F.get(F.array(*map(F.lit, ("1-3,5", "", "2", "4-6,1"))), (F.col("seg_ord") % 4).cast("int"))
    return segments_of(spark, sf).select(spec.alias("spec")).distinct().select("spec", F.array_join(F.transform(Se.listed_numbers(F.col("spec")), lambda n: n.cast("string")), " ").alias("stages"))


@query("""
    WITH s AS (SELECT DISTINCT seg_uid, book_id, type, window_key FROM segments WHERE window_key IS NOT NULL),
    p AS (SELECT book_id, count(DISTINCT window_key) AS total FROM s GROUP BY 1), d AS (SELECT book_id, count(DISTINCT window_key) AS n FROM s WHERE type = 'blockquote' GROUP BY 1)
    SELECT book_id, least(coalesce(n, 0), total) AS done, total FROM p LEFT JOIN d USING (book_id)
""")
def windows_done(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with a blockquote, of all windows of a book."""
    own = table(spark, sf, "segments").filter("window_key is not null")
    return Se.windows_done(own.filter("type = 'blockquote'"), own)


@query()
def page_break_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences that go over the end of a page, without margin lines that recur in the book."""
    from bookloom.operators import structural as S
    from bookloom.plans.layout import blocks_of

    lines = S.block_lines(blocks_of(spark, sf)).select("book_id", "page", X.normalized(F.col("line"), True).alias("line"))
    junk = lines.groupBy("book_id", "line").agg(F.count_distinct("page").alias("n")).filter("n >= 3").select("book_id", "line")
    return Se.page_break_spans(table(spark, sf, "pages").dropDuplicates(["page_uid"]), junk)

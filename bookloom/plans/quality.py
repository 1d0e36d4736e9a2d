"""Queries over the quality matrix, caches, reviews and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions import text as X
from bookloom.operators import align
from bookloom.operators import checks as K
from bookloom.operators import incremental as I
from bookloom.operators import narration as N
from bookloom.operators import progress as P
from bookloom.plans.narration import segments_of
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


#: Checks whose matrix is compared with SQL.
SOME = ["narration_schema_valid", "no_surviving_digits", "segment_length_limits", "chapter_text_coverage", "no_toc_leakage"]
SG = "s AS (SELECT DISTINCT seg_uid, book_id, seg_ord, id, chapter_id, type, text, window_key FROM segments)"
V = f"""{SG}, c AS (SELECT DISTINCT chapter_uid, book_id, text, front_matter FROM chapters), p AS (SELECT DISTINCT page_uid, book_id, text FROM pages),
    l AS (SELECT DISTINCT type, min_chars, max_chars FROM length_limits WHERE item = 'segment'),
    v AS (SELECT book_id AS doc_id, 'narration_schema_valid' AS dimension, CAST(seg_uid AS VARCHAR) AS unit_id FROM s WHERE NOT coalesce(regexp_full_match(id, 'seg_[0-9]{{4,}}') AND coalesce(text, '') <> '' AND type IN ('chapter_heading', 'section_heading', 'paragraph', 'blockquote'), false)
        UNION ALL SELECT book_id, 'no_surviving_digits', CAST(seg_uid AS VARCHAR) FROM s WHERE regexp_matches(text, '[0-9¼½¾⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞]')
        UNION ALL SELECT book_id, 'segment_length_limits', CAST(seg_uid AS VARCHAR) FROM s LEFT JOIN l USING (type) WHERE coalesce(length(text), 0) < coalesce(min_chars, 1) OR length(text) > coalesce(max_chars, 900)
        UNION ALL SELECT b.book_id, 'chapter_text_coverage', b.book_id FROM (SELECT book_id, sum(coalesce(length(text), 0)) AS body FROM p GROUP BY 1) b
            LEFT JOIN (SELECT book_id, sum(coalesce(length(text), 0)) AS held FROM c GROUP BY 1) h USING (book_id) WHERE coalesce(held, 0) < 0.97 * body
        UNION ALL SELECT book_id, 'no_toc_leakage', CAST(chapter_uid AS VARCHAR) FROM c WHERE NOT coalesce(front_matter, false) AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\.{{3,}}\\s*[0-9]+\\s*$'))) >= 3),
    d AS (SELECT unnest(['narration_schema_valid', 'no_surviving_digits', 'segment_length_limits', 'chapter_text_coverage', 'no_toc_leakage']) AS dimension, unnest([4, 4, 4, 3, 3]) AS stage),
    r AS (SELECT b.doc_id, d.stage, d.dimension, CASE WHEN count(v.unit_id) > 0 THEN 'fail' ELSE 'pass' END AS status, count(v.unit_id) AS n
          FROM (SELECT DISTINCT book_id AS doc_id FROM pages) b, d LEFT JOIN v ON v.doc_id = b.doc_id AND v.dimension = d.dimension GROUP BY 1, 2, 3)"""


def _tables(spark: SparkSession, sf: str):
    return lambda name: table(spark, sf, name)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("book_id").alias("doc_id")).distinct()


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return K.results(K.violations(_tables(spark, sf), SOME), _docs(spark, sf), SOME)


@query(f"WITH {V} SELECT * FROM r")
def check_results(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf)


@query()
def all_violations(spark: SparkSession, sf: str) -> DataFrame:
    return K.violation_counts(_tables(spark, sf))


@query(f"WITH {V} SELECT doc_id, " + ", ".join(f"max(CASE WHEN dimension = '{x}' THEN status END) AS {x}" for x in SOME) + " FROM r GROUP BY 1")
def status_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).groupBy("doc_id").pivot("dimension", SOME).agg(F.first("status"))


@query(f"WITH {V} SELECT stage, dimension, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed FROM r GROUP BY ROLLUP (stage, dimension)")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).rollup("stage", "dimension").agg(F.count(F.when(F.col("status") == "pass", 1)).alias("passed"), F.count(F.when(F.col("status") == "fail", 1)).alias("failed"))


@query(f"WITH {V} SELECT doc_id, dimension FROM r WHERE status = 'fail' AND n < 3")
def regression_diff(spark: SparkSession, sf: str) -> DataFrame:
    current = _results(spark, sf)
    baseline = current.withColumn("status", F.when(F.col("n") < 3, "pass").otherwise("fail"))
    return K.regressions(baseline, current)


@query(f"WITH {V}, q AS (SELECT doc_id, dimension, unit_id, row_number() OVER (PARTITION BY doc_id, dimension ORDER BY unit_id) AS place FROM v) SELECT doc_id, dimension, unit_id, CAST(place AS INTEGER) AS place FROM q WHERE place <= 10")
def review_queue_topk(spark: SparkSession, sf: str) -> DataFrame:
    return K.review_queue(K.violations(_tables(spark, sf), SOME)).select("doc_id", "dimension", "unit_id", "place")


@query("""
    WITH t AS (SELECT DISTINCT book_id, segment_id, hash, duration_s, chars, rendered_at FROM takes),
    o AS (SELECT *, row_number() OVER (PARTITION BY book_id, segment_id ORDER BY rendered_at, hash, duration_s) AS round, CASE WHEN duration_s IS NULL THEN 'error' WHEN duration_s / chars BETWEEN 0.045 AND 0.14 THEN 'pass' ELSE 'fail' END AS status FROM t)
    SELECT book_id || ':' || segment_id AS doc_id, 'duration' AS dimension, CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE arg_min(status, round) FILTER (WHERE status <> 'pass') END AS status, count(*) AS rounds FROM o GROUP BY 1
""")
def pass_k_merge(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    own = table(spark, sf, "takes").select("book_id", "segment_id", "hash", "duration_s", "chars", "rendered_at").distinct()
    status = F.when(F.col("duration_s").isNull(), "error").when((F.col("duration_s") / F.col("chars")).between(0.045, 0.14), "pass").otherwise("fail")
    place = F.row_number().over(W.partitionBy("book_id", "segment_id").orderBy("rendered_at", "hash", "duration_s"))
    rounds = own.select(F.concat_ws(":", "book_id", "segment_id").alias("doc_id"), F.lit("duration").alias("dimension"), place.alias("round"), status.alias("status"))
    return K.pass_k(rounds)


@query(f"""
    WITH {SG}, w AS (SELECT DISTINCT substr(sha256(concat_ws('|', 'kokoro', 'speed=1.0,voice=af_1', text)), 1, 24) AS key FROM s WHERE text IS NOT NULL),
    h AS (SELECT DISTINCT substr(sha256(concat_ws('|', t.engine, 'speed=' || t.params['speed'] || ',voice=' || t.params['voice'], s.text)), 1, 24) AS key FROM takes t JOIN s ON s.book_id = t.book_id AND s.id = t.segment_id WHERE s.text IS NOT NULL)
    SELECT key FROM w WHERE key NOT IN (SELECT key FROM h WHERE key IS NOT NULL)
""")
def take_cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    own = segments_of(spark, sf).filter("text is not null")
    params = F.create_map(F.lit("speed"), F.lit("1.0"), F.lit("voice"), F.lit("af_1"))
    wanted = own.select(I.take_key(F.lit("kokoro"), params, F.col("text")).alias("key"))
    takes = table(spark, sf, "takes").select("book_id", F.col("segment_id").alias("id"), "engine", "params")
    held = takes.join(own.select("book_id", "id", "text"), ["book_id", "id"]).select(I.take_key(F.col("engine"), F.col("params"), F.col("text")).alias("key"))
    return I.cache_misses(wanted, held)


@query("SELECT book_id, hash, count(DISTINCT (engine, coalesce(chars, -1))) AS variants, count(DISTINCT (segment_id, rendered_at)) AS takes FROM takes GROUP BY 1, 2")
def cache_integrity(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "takes").groupBy("book_id", "hash")
    return own.agg(F.count_distinct("engine", F.coalesce("chars", F.lit(-1))).alias("variants"), F.count_distinct("segment_id", "rendered_at").alias("takes"))


@query(f"WITH {V} SELECT DISTINCT s.book_id, s.window_key FROM s JOIN v ON v.unit_id = CAST(s.seg_uid AS VARCHAR) AND v.dimension = 'segment_length_limits' WHERE s.window_key IS NOT NULL")
def delta_recompute(spark: SparkSession, sf: str) -> DataFrame:
    return I.windows_to_redo(K.violations(_tables(spark, sf), ["segment_length_limits"]), segments_of(spark, sf))


@query("""
    WITH t AS (SELECT DISTINCT book_id, segment_id, hash, rendered_at FROM takes), m AS (SELECT book_id, max(rendered_at) AS last_at, count(*) AS total FROM t GROUP BY 1),
    r AS (SELECT t.book_id, count(*) AS recent FROM t JOIN m USING (book_id) WHERE rendered_at > last_at - INTERVAL 30 MINUTES GROUP BY 1)
    SELECT book_id, total, recent, last_at, CASE WHEN recent < 2 THEN 0.0 ELSE CAST(recent * 2 AS DOUBLE) END AS per_hour FROM m JOIN r USING (book_id)
""")
def render_pace(spark: SparkSession, sf: str) -> DataFrame:
    return P.pace(table(spark, sf, "takes").select("book_id", "segment_id", "hash", "rendered_at").distinct(), "book_id", "rendered_at")


@query("""
    WITH w AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 15 MINUTES * k AS start FROM events, (SELECT unnest([0, 1]) AS k))
    SELECT event_type, start, count(*) AS n FROM w GROUP BY 1, 2
""")
def sliding_pace(spark: SparkSession, sf: str) -> DataFrame:
    return P.windows(table(spark, sf, "events"), "event_type", "ts")


@query(f"""
    WITH {SG}, a AS (SELECT book_id, count(DISTINCT id) AS segments FROM s GROUP BY 1), b AS (SELECT book_id, count(DISTINCT segment_id) AS rendered FROM takes WHERE duration_s IS NOT NULL GROUP BY 1)
    SELECT book_id, segments, coalesce(rendered, 0) AS rendered, round(0.10 + least(1.0, coalesce(rendered, 0) / segments) * 0.85, 6) AS fraction,
           CASE WHEN coalesce(rendered, 0) = 0 THEN 'script' WHEN rendered < segments THEN 'render' ELSE 'master' END AS phase FROM a LEFT JOIN b USING (book_id)
""")
def book_progress(spark: SparkSession, sf: str) -> DataFrame:
    return P.book_progress(segments_of(spark, sf), table(spark, sf, "takes"))


@query()
def word_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    heard = table(spark, sf, "take_review").dropDuplicates(["review_id"]).filter("transcript is not null").select("review_id", "book_id", "segment_id", "transcript")
    pairs = heard.join(segments_of(spark, sf).select("book_id", F.col("id").alias("segment_id"), "text").filter("text is not null"), ["book_id", "segment_id"])
    return pairs.select("review_id", F.round(align.word_error_rate(F.col("text"), F.col("transcript")), 6).alias("wer"))


@query()
def faithfulness_alignment(spark: SparkSession, sf: str) -> DataFrame:
    own = segments_of(spark, sf).filter(F.col("type").isin(*N.PROSE) & F.col("text").isNotNull()).select("book_id", "chapter_id", "id", "seg_uid", "text")
    heard = table(spark, sf, "take_review").dropDuplicates(["review_id"]).filter("transcript is not null").select("book_id", F.col("segment_id").alias("id"), "review_id", "transcript")
    rewrite = heard.join(own.select("book_id", "chapter_id", "id"), ["book_id", "id"]).select("book_id", "chapter_id", F.col("review_id").alias("id"), F.col("transcript").alias("text"))
    return align.best_matches(own.select("book_id", "chapter_id", F.col("seg_uid").alias("id"), "text"), rewrite)


@query("""
    WITH l AS (SELECT source, lower(trim(x)) AS line, doc_id FROM documents, unnest(string_split(text, chr(10))) AS u(x) WHERE text IS NOT NULL),
    c AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE length(line) >= 4 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, line) AS place FROM c)
    SELECT source, line, n, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8
""")
def top_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    lines = table(spark, sf, "documents").select("source", "doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.lower(F.trim(x))))).alias("line")).filter(F.length("line") >= 4)
    counts = lines.groupBy("source", "line").agg(F.count_distinct("doc_id").alias("n"))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.col("n").desc(), "line"))
    return counts.withColumn("place", place).filter(F.col("place") <= 8)


NORM = """lower(trim(regexp_replace(replace(replace(replace(translate({0}, '“”‘’–—−' || chr(160), '""''''--- '), 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(173), ''),
    '[\\x{{09}}-\\x{{0D}}\\x{{1C}}-\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')))"""


@query(f"""
    WITH {SG}, a AS (SELECT book_id AS doc_id, CAST(seg_uid AS VARCHAR) AS id, text FROM s WHERE type = 'chapter_heading' AND text IS NOT NULL),
    c AS (SELECT DISTINCT chapter_uid, book_id AS doc_id, text AS body FROM chapters WHERE text IS NOT NULL)
    SELECT doc_id, id, bool_or(contains({NORM.format("body")}, {NORM.format("text")})) AS hit FROM c JOIN a USING (doc_id) GROUP BY 1, 2
""")
def seeded_strings(spark: SparkSession, sf: str) -> DataFrame:
    heads = segments_of(spark, sf).filter("type = 'chapter_heading' and text is not null")
    seeds = heads.select(F.col("book_id").alias("doc_id"), F.lit("must_not_contain").alias("polarity"), F.col("seg_uid").cast("string").alias("id"), "text", F.lit("substring").alias("match"))
    texts = table(spark, sf, "chapters").dropDuplicates(["chapter_uid"]).filter("text is not null").select(F.col("book_id").alias("doc_id"), "text")
    return K.seeded(texts, seeds).select("doc_id", "id", "hit")


@query(f"""
    WITH {SG}, g AS (SELECT DISTINCT block_uid, book_id AS doc_id, substr({NORM.format("text")}, 1, 120) AS part, regexp_extract(lower(text), '[a-zà-ÿа-я]{{6,}}') AS w FROM blocks WHERE length(text) >= 60 AND size < 9.9)
    SELECT DISTINCT g.doc_id, CAST(block_uid AS VARCHAR) AS unit_id FROM g JOIN s ON s.book_id = g.doc_id
    WHERE w <> '' AND list_contains(regexp_extract_all(lower(s.text), '[a-zà-ÿа-я]{{6,}}'), w) AND contains({NORM.format("s.text")}, part)
""")
def removed_text_absent(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "blocks").dropDuplicates(["block_uid"]).filter("size < 9.9").select(F.col("book_id").alias("doc_id"), F.col("block_uid").cast("string").alias("unit_id"), "text")
    said = segments_of(spark, sf).filter("text is not null").select(F.col("book_id").alias("doc_id"), "seg_ord", "text")
    return K.removed_text_absent(gone, said, order="seg_ord").select("doc_id", "unit_id")


@query()
def sentence_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of the sentences of chapters against those of their narration: kept, ambiguous or dropped."""
    source, rewrite = _aligned_sides(spark, sf)
    return align.aligned(source, rewrite)


@query()
def rewrites_without_source(spark: SparkSession, sf: str) -> DataFrame:
    source, rewrite = _aligned_sides(spark, sf)
    return align.without_source(source, rewrite)


def _aligned_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    def sentences(rows: DataFrame, uid: str) -> DataFrame:
        each = rows.select("book_id", "chapter_id", uid, F.posexplode(X.aligned_sentences(F.col("text"))).alias("place", "text"))
        return each.select("book_id", "chapter_id", (F.shiftleft(F.col(uid).cast("long"), 24) + F.col("place")).alias("id"), N.numeric_blind(F.col("text")).alias("text"))

    chapters = table(spark, sf, "chapters").dropDuplicates(["chapter_uid"]).filter("text is not null and not coalesce(front_matter, false)")
    segments = segments_of(spark, sf).filter("text is not null and type in ('paragraph', 'blockquote', 'section_heading')")
    return sentences(chapters.withColumn("chapter_id", F.col("id")), "chapter_uid"), sentences(segments, "seg_uid")


@query(f"""
    WITH {V}, k AS (SELECT DISTINCT doc_id FROM r WHERE dimension = 'no_toc_leakage' AND doc_id LIKE '%a%')
    SELECT r.doc_id, stage, dimension, CASE WHEN dimension = 'no_toc_leakage' AND k.doc_id IS NOT NULL THEN 'skip' ELSE status END AS status, CASE WHEN dimension = 'no_toc_leakage' AND k.doc_id IS NOT NULL THEN 0 ELSE n END AS n FROM r LEFT JOIN k ON k.doc_id = r.doc_id
    UNION ALL SELECT doc_id, 6, 'words_per_minute', 'skip', 0 FROM r WHERE dimension = 'no_toc_leakage'
""")
def check_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses with a skip list and a stage that has not run."""

    def tables(name: str) -> DataFrame:
        if name == "takes":
            raise LookupError(name)
        return table(spark, sf, name)

    docs = _docs(spark, sf)
    skips = docs.filter("doc_id like '%a%'").select("doc_id", F.lit("no_toc_leakage").alias("dimension"))
    return K.statuses(tables, docs, [*SOME, "words_per_minute"], skips).select("doc_id", "stage", "dimension", "status", "n")

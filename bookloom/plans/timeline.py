"""Queries over takes, timing and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions import numbers as M
from bookloom.operators import timeline as T
from bookloom.plans.chapters import chapters_of
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


SG = "s AS (SELECT DISTINCT seg_uid, book_id, seg_ord, id, chapter_id, type, text, para_id FROM segments)"
TK = "k AS (SELECT book_id, segment_id, arg_max((duration_s, chars, hash), (rendered_at, hash)) AS t FROM takes WHERE duration_s IS NOT NULL GROUP BY 1, 2), t AS (SELECT book_id, segment_id, t[1] AS duration_s, t[2] AS chars, t[3] AS hash FROM k)"
POLICY = "(VALUES ('chapter_heading', 2.0::DOUBLE, 1.5::DOUBLE), ('section_heading', 1.2, 0.8), ('paragraph', 0.5, 0.0), ('blockquote', 0.7, 0.7)) AS pol(type, before, after)"
LINE = f"""{SG}, {TK},
    a AS (SELECT *, lag(type) OVER (PARTITION BY book_id ORDER BY seg_ord) = 'section_heading' AS skipped FROM s),
    b AS (SELECT a.*, t.duration_s FROM a JOIN t ON a.book_id = t.book_id AND a.id = t.segment_id WHERE type <> 'section_heading'),
    c AS (SELECT *, lag(type) OVER w AS ptype, lag(para_id) OVER w AS ppara, row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY book_id ORDER BY seg_ord)),
    d AS (SELECT c.*, CASE WHEN rn = 1 THEN 0.0 WHEN ppara = para_id THEN 0.55 ELSE coalesce(x.after, 0) + coalesce(y.before, 0) + CASE WHEN skipped THEN 2.0 ELSE 0.0 END END AS gap
          FROM c LEFT JOIN {POLICY.replace("pol(", "x(")} ON x.type = ptype LEFT JOIN {POLICY.replace("pol(", "y(")} ON y.type = c.type),
    line AS (SELECT book_id, id AS segment_id, chapter_id, type, seg_ord, round(sum(gap + duration_s) OVER (PARTITION BY book_id ORDER BY seg_ord) - duration_s + 0.75, 3) AS start_s, duration_s, round(gap, 3) AS silence_before_s FROM d)"""


@query(f"WITH {LINE} SELECT * FROM line")
def gap_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return T.timeline(segments_of(spark, sf), table(spark, sf, "takes"))


@query(f"""
    WITH {LINE}, m AS (SELECT book_id, chapter_id, min(start_s - silence_before_s) AS s, max(start_s + duration_s) AS e FROM line GROUP BY 1, 2),
    n AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY book_id ORDER BY s), max(e) OVER (PARTITION BY book_id) + 2.0) AS u FROM m)
    SELECT n.book_id, chapter_id AS id, coalesce(title, chapter_id) AS title, CAST(floor(round(s * 1000, 2)) AS BIGINT) AS start_ms, CAST(floor(round(u * 1000, 2)) AS BIGINT) AS end_ms
    FROM n LEFT JOIN (SELECT DISTINCT book_id, id, title FROM chapters) h ON h.book_id = n.book_id AND h.id = chapter_id
""")
def chapter_markers(spark: SparkSession, sf: str) -> DataFrame:
    return T.markers(gap_timeline(spark, sf), chapters_of(spark, sf))


@query(f"""
    WITH {SG}, {TK}, x AS (SELECT s.book_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS w, duration_s FROM s JOIN t ON t.book_id = s.book_id AND t.segment_id = s.id)
    SELECT book_id, CAST(coalesce(sum(w), 0) AS BIGINT) AS words, round(sum(duration_s), 3) AS seconds, round(coalesce(sum(w), 0) / nullif(sum(duration_s) / 60, 0), 3) AS wpm FROM x GROUP BY 1
""")
def words_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    return T.words_per_minute(segments_of(spark, sf), table(spark, sf, "takes"))


@query(f"""
    WITH {TK}, r AS (SELECT *, CAST(floor(duration_s * 1000000 / chars) AS BIGINT) AS ratio FROM t WHERE chars >= 40), m AS (SELECT book_id, median(ratio) AS med FROM r GROUP BY 1),
    d AS (SELECT r.book_id, median(abs(ratio - med)) AS mad FROM r JOIN m USING (book_id) GROUP BY 1)
    SELECT r.book_id, segment_id, ratio, med AS median, CASE WHEN mad = 0 THEN 5000.0 ELSE mad END AS mad, ratio NOT BETWEEN 45000 AND 140000 OR ratio > 2.2 * med OR ratio < 0.45 * med AS outlier
    FROM r JOIN m USING (book_id) JOIN d USING (book_id)
""")
def duration_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return T.duration_outliers(table(spark, sf, "takes"))


CENTRE = """SELECT label, d, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM (SELECT label, d, avg(x) AS m FROM {0} GROUP BY 1, 2)"""


@query(f"""
    WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
    c1 AS ({CENTRE.format("e")}), s1 AS (SELECT vec_id, e.label, sum(x * c) / sqrt(sum(x * x)) AS sim FROM e JOIN c1 USING (label, d) GROUP BY 1, 2),
    m AS (SELECT label, median(sim) AS m FROM s1 GROUP BY 1), core AS (SELECT e.* FROM e JOIN s1 USING (vec_id) JOIN m ON m.label = e.label WHERE sim >= m),
    c2 AS ({CENTRE.format("core")})
    SELECT vec_id, e.label, round(sum(x * c) / sqrt(sum(x * x)), 6) AS similarity FROM e JOIN c2 USING (label, d) GROUP BY 1, 2
""")
def speaker_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return T.speaker_similarity(table(spark, sf, "embeddings"))


@query(f"""
    WITH {SG}, x AS (SELECT seg_uid, coalesce(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '')), 0) / 150.0 * 60 AS e FROM s)
    SELECT seg_uid, CAST(round(e, 4) AS DOUBLE) AS expected_s, CAST(round(greatest(15.0, e * 4) * 13.5, 3) AS DOUBLE) AS token_cap FROM x
""")
def collapse_guards(spark: SparkSession, sf: str) -> DataFrame:
    return T.collapse_guards(segments_of(spark, sf))


@query(f"""
    WITH {TK}, n AS (SELECT book_id, segment_id, row_number() OVER (PARTITION BY book_id ORDER BY segment_id) - 1 AS rn, count(*) OVER (PARTITION BY book_id) AS c FROM t)
    SELECT book_id, segment_id FROM n WHERE rn % greatest(1, c // 40) = 0 AND rn // greatest(1, c // 40) < 40
""")
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    own = T.current_takes(table(spark, sf, "takes"))
    n = own.groupBy("book_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 40)).alias("step"))
    held = own.withColumn("rn", F.row_number().over(W.partitionBy("book_id").orderBy("segment_id")) - 1).join(n, "book_id")
    return held.filter((F.col("rn") % F.col("step") == 0) & (F.floor(F.col("rn") / F.col("step")) < 40)).select("book_id", "segment_id")


@query(f"""
    WITH {LINE}, g AS (SELECT *, lag(start_s + duration_s) OVER (PARTITION BY book_id ORDER BY seg_ord) AS before FROM line)
    SELECT book_id, count(*) AS takes, count(*) FILTER (WHERE start_s < before - 0.002) AS overlaps, round(sum(silence_before_s), 2) AS silence FROM g GROUP BY 1
""")
def timeline_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    from bookloom.operators.ordered import with_previous

    held = with_previous(gap_timeline(spark, sf), ["book_id"], "seg_ord", ["start_s", "duration_s"])
    over = F.col("start_s") < F.col("prev.start_s") + F.col("prev.duration_s") - 0.002
    return held.groupBy("book_id").agg(F.count("*").alias("takes"), F.count(F.when(over, 1)).alias("overlaps"), F.round(F.sum("silence_before_s"), 2).alias("silence"))


INTS = "n AS (SELECT DISTINCT CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders UNION SELECT p_size FROM part UNION SELECT unnest([0, 100, 101, 1000, 1000000, 20000000, 3000000007])::BIGINT)"
SMALLS = "[" + ", ".join(f"'{w}'" for w in M.SMALL) + "]"
TENS = "[" + ", ".join(f"'{w}'" for w in M.TENS) + "]"
B100 = "(CASE WHEN {0} < 20 THEN {1}[{0} + 1] ELSE {2}[{0} // 10 + 1] || CASE WHEN {0} % 10 > 0 THEN '-' || {1}[{0} % 10 + 1] ELSE '' END END)"
W100 = lambda x: B100.format(x, SMALLS, TENS)
W1000 = f"w AS (SELECT m, CASE WHEN m < 100 THEN {W100('m')} ELSE {SMALLS}[m // 100 + 1] || ' hundred' || CASE WHEN m % 100 > 0 THEN ' ' || {W100('(m % 100)')} ELSE '' END END AS t FROM range(1000) r(m))"


@query(f"""
    WITH {INTS}, {W1000} SELECT n, CASE WHEN n = 0 THEN 'zero' ELSE concat_ws(' ', CASE WHEN a.m > 0 THEN a.t || ' billion' END, CASE WHEN b.m > 0 THEN b.t || ' million' END, CASE WHEN c.m > 0 THEN c.t || ' thousand' END, CASE WHEN d.m > 0 THEN d.t END) END AS words
    FROM n JOIN w a ON a.m = n // 1000000000 % 1000 JOIN w b ON b.m = n // 1000000 % 1000 JOIN w c ON c.m = n // 1000 % 1000 JOIN w d ON d.m = n % 1000
""")
def int_to_words(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.floor("o_totalprice").cast("long").alias("n"))
    b = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("n"))
    c = spark.createDataFrame([(x,) for x in (0, 100, 101, 1000, 1000000, 20000000, 3000000007)], "n long")
    own = a.union(b).union(c).distinct()
    return own.select("n", M.int_words(F.col("n")).alias("words"))


@query(f"""
    WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS n FROM orders UNION SELECT unnest(range(1000, 2100))::INTEGER)
    SELECT n, CASE WHEN n // 100 = 20 THEN 'two thousand' || CASE WHEN n % 100 > 0 THEN ' ' || {W100('(n % 100)')} ELSE '' END WHEN n % 100 = 0 THEN {W100('(n // 100)')} || ' hundred'
        WHEN n % 100 < 10 THEN {W100('(n // 100)')} || ' oh-' || {SMALLS}[n % 100 + 1] ELSE {W100('(n // 100)')} || ' ' || {W100('(n % 100)')} END AS words FROM y
""")
def year_words(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select(F.year("o_orderdate").alias("n")).union(spark.range(1000, 2100).select(F.col("id").cast("int").alias("n"))).distinct()
    return own.select("n", M.year_words(F.col("n")).alias("words"))


ORD = "[" + ", ".join(f"'{w}'" for w in M.ORDINAL) + "]"
OTENS = "[" + ", ".join(f"'{w}'" for w in M.ORDINAL_TENS) + "]"


@query(f"""
    WITH {W1000} SELECT CAST(m AS INTEGER) AS n, CASE WHEN m = 0 THEN '' WHEN m <= 20 THEN {ORD}[m + 1] WHEN m < 100 AND m % 10 = 0 THEN {OTENS}[m // 10 + 1] WHEN m < 100 THEN {TENS}[m // 10 + 1] || '-' || {ORD}[m % 10 + 1] ELSE t || 'th' END AS words
    FROM w JOIN (SELECT DISTINCT n_nationkey AS q FROM nation UNION SELECT unnest(range(1000))) ON q = m
""")
def ordinal_words(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("n")).union(spark.range(1000).select(F.col("id").cast("int"))).distinct()
    return own.select("n", M.ordinal_words(F.col("n")).alias("words"))


ROMANS = "[" + ", ".join(f"'{r}'" for r in M.ROMAN) + "]"


@query(f"""
    WITH n AS (SELECT DISTINCT upper(n_name[1]) || lower(n_name[2:]) AS name FROM nation), r AS (SELECT unnest(range(1, 20)) AS k),
    x AS (SELECT name || ' ' || {ROMANS}[k + 1] || ' spoke' AS text, CASE WHEN regexp_full_match(name, '[A-Z][a-z]{{2,}}') THEN name || ' the ' || upper({ORD}[k + 2][1]) || {ORD}[k + 2][2:] || ' spoke' ELSE name || ' ' || {ROMANS}[k + 1] || ' spoke' END AS words FROM n, r
          UNION ALL SELECT 'Part ' || {ROMANS}[k + 1] || '.', 'Part ' || upper({W100('(k + 1)')}[1]) || {W100('(k + 1)')}[2:] || '.' FROM r)
    SELECT text, words FROM x
""")
def roman_words(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").select(F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)"))).alias("name")).distinct()
    numerals = F.explode(F.array(*map(F.lit, M.ROMAN[1:]))).alias("r")
    each = names.select("name", numerals).select(F.concat("name", F.lit(" "), "r", F.lit(" spoke")).alias("text"))
    parts = spark.range(1).select(numerals).select(F.concat(F.lit("Part "), "r", F.lit(".")).alias("text"))
    return each.union(parts).select("text", M.roman_words(F.col("text")).alias("words"))


@query()
def digits_verbalized(spark: SparkSession, sf: str) -> DataFrame:
    own = segments_of(spark, sf).filter(F.col("text").rlike("[0-9¼½¾⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞]"))
    return own.select("seg_uid", M.spoken_numbers(F.col("text")).alias("spoken"))


@query()
def year_style(spark: SparkSession, sf: str) -> DataFrame:
    """Years that are spoken as quantities, in pairs; tests have the cases."""
    return segments_of(spark, sf).filter("text is not null").select("seg_uid", M.year_style(F.col("text")).alias("text"))


@query()
def number_values(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of each segment as plain digits, and whether its spoken form has the same."""
    from bookloom.session import written

    # A Python function cannot take what higher-order functions make in the same step.
    own = written(segments_of(spark, sf).filter("text is not null").select("seg_uid", "text", M.spoken_numbers(F.col("text")).alias("spoken")), "spoken")
    both = own.select("seg_uid", M.number_values("text").alias("a"), M.number_values("spoken").alias("b"))
    return both.select("seg_uid", F.array_join("a", " ").alias("numbers"), (F.col("a") == F.col("b")).alias("kept"))


ROMAN_SQL = "list_sum(list_transform(generate_series(1, length(r)), lambda i: CASE WHEN list_position(['I', 'V', 'X', 'L', 'C'], r[i + 1]) > list_position(['I', 'V', 'X', 'L', 'C'], r[i]) THEN -1 ELSE 1 END * [1, 5, 10, 50, 100][list_position(['I', 'V', 'X', 'L', 'C'], r[i])]))"


@query(f"WITH n AS (SELECT unnest({ROMANS} || ['XL', 'XC', 'CXLIV', 'IIII']) AS r) SELECT r AS numeral, CAST({ROMAN_SQL} AS INTEGER) AS value FROM n")
def roman_values(spark: SparkSession, sf: str) -> DataFrame:
    own = spark.range(1).select(F.explode(F.array(*map(F.lit, [*M.ROMAN, "XL", "XC", "CXLIV", "IIII"]))).alias("numeral"))
    return own.select("numeral", M.roman_value(F.col("numeral")).alias("value"))

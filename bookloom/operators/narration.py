"""Narration segments: sentences, adjudicated splits, opening titles, predicates, spans.

Sequential folds are gaps and islands where that is exact: a flag per row, and
the island as a running sum of flags within a chapter or a paragraph, never
over a whole book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions import text as X

PROSE = ("paragraph", "blockquote")
# Honorifics whose full stop ends no sentence, ends that are abbreviations, and bare attributions.
HONORIFICS = "Mr Mrs Ms Dr St Lieut Col Capt Sergt Prof Hon Rev Gen Maj No".split()
INITIAL_END = r"\b[A-Z]\.$"
ABBREVIATION_END = r"\b(?:Jr|Sr|Inc|Ltd|Co|Bros|vs|etc|Mt|Ft)\.$"
SPEECH_VERBS = ("asked", "exclaimed", "cried", "said", "replied", "shouted", "answered", "muttered", "whispered")
SPEAKERS = ("he", "she", "i", "we", "they")
ERA_CENTURY = r"(?i)\bone thousand,?(?: and)? (?:one|two|three|four|five|six|seven|eight|nine) hundred\b"
BARE_ROMAN = r"\b(?:[A-Z][a-z]{2,}|Chapter|Part|Volume|Book|Act|Section)\s+(?:II|III|IV|V|VI|VII|VIII|IX|X|XI|XII|XIII|XIV|XV|XVI|XVII|XVIII|XIX|XX)\b"
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion point oh".split()


def sentences(segments: DataFrame, key: str = "seg_uid") -> DataFrame:
    """(key, sentence_index, text): sentences of prose segments, cut after marks but not after honorifics.

    A piece of punctuation alone, or a bare attribution, joins the piece before it; leading punctuation is dropped.
    Headings are one sentence. All of it is array functions within one row.
    """
    pieces = F.filter(F.transform(F.split(X.trimmed(F.col("text")), r"(?<=[.!?])\s+"), lambda p: F.trim(p)), lambda p: p != "")
    bare = lambda p: p.rlike(r"^[^A-Za-z0-9À-ɏͰ-ϿЀ-ӿऀ-ॿ؀-ۿ฀-๿぀-ヿ一-鿿]+$")
    titled = lambda p: F.regexp_extract(p, r"\b([A-Za-z]+)\.$", 1).isin(*HONORIFICS)

    def said(p: Column) -> Column:
        """Whether a piece is a verb of speech alone, or with who speaks."""
        words = F.split(F.lower(F.regexp_replace(p, "[.!?]$", "")), r"\s+")
        verb = F.element_at(words, -1).isin(*SPEECH_VERBS)
        return verb & ((F.size(words) == 1) | ((F.size(words) == 2) & F.get(words, F.lit(0)).isin(*SPEAKERS)))

    def fold(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), p)))
        return F.when((F.size(done) > 0) & (titled(last) | bare(p) | said(p)), joined).when(bare(p), done).otherwise(F.concat(done, F.array(p)))

    prose = F.aggregate(pieces, F.array().cast("array<string>"), fold)
    out = F.when(F.col("type").isin(*PROSE), F.when(F.size(prose) > 0, prose).otherwise(F.array("text"))).otherwise(F.array("text"))
    return segments.filter(F.col("text").isNotNull()).select(key, F.posexplode(out).alias("sentence_index", "text"))


def joins_next(segments: DataFrame) -> DataFrame:
    """Segments with ``joins``: whether a wrongly split segment goes on in the next of its chapter, by the fallback rule.

    Neighbours are those of one chapter, so the window is a chapter.
    """
    o = W.partitionBy("book_id", "chapter_id").orderBy("seg_ord")
    own, after = F.trim("text"), F.trim(F.lead("text").over(o))
    ends = own.rlike(INITIAL_END) | own.rlike(ABBREVIATION_END)
    prose = F.col("type").isin(*PROSE) & F.lead("type").over(o).isin(*PROSE)
    return segments.withColumn("joins", F.coalesce(prose & ends & (F.length(after) > 0), F.lit(False)))


def adjudicated(segments: DataFrame) -> DataFrame:
    """(book_id, chapter_id, first_ord, n, text): segments after joins; a run of joins is one island of its chapter."""
    o = W.partitionBy("book_id", "chapter_id").orderBy("seg_ord")
    flagged = joins_next(segments).withColumn("goes_on", F.coalesce(F.lag("joins").over(o), F.lit(False)))
    held = flagged.withColumn("island", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(o))
    rows = F.array_sort(F.collect_list(F.struct("seg_ord", "text")))
    return held.groupBy("book_id", "chapter_id", "island").agg(F.min("seg_ord").alias("first_ord"), F.count("*").alias("n"), rows.alias("r")).select("book_id", "chapter_id", "first_ord", "n", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"))


def opening_duplicates(segments: DataFrame, first: int = 5, short: int = 90) -> DataFrame:
    """(seg_uid) of short segments among a chapter's first that repeat its announcement."""
    o = W.partitionBy("book_id", "chapter_id").orderBy("seg_ord")
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9À-ɏЀ-ӿ]+", ""))
    held = segments.withColumn("place", F.row_number().over(o)).withColumn("announced", F.first("text").over(o)).withColumn("opens", F.first("type").over(o) == "chapter_heading")
    same = (F.col("place") > 1) & (F.col("place") <= first) & F.col("opens") & (F.length("text") < short) & (plain(F.col("text")) == plain(F.col("announced"))) & (plain(F.col("text")) != "")
    return held.filter(same).select("seg_uid")


def content_free(text: Column) -> Column:
    """A bare citation in brackets, or twenty signs or more of which less than half are letters."""
    shown = F.regexp_replace(text, "[ \\t\\n\\r]+", "")
    letters = F.length(F.regexp_replace(shown, "[^A-Za-zÀ-ɏͰ-ϿЀ-ӿ\\u0600-\\u06FF\\u0900-\\u0DFF\\u0E00-\\u0E7F\\u3040-\\u30FF\\u4E00-\\u9FFF]", ""))
    return F.trim(text).rlike(r"^\(\s*[A-Z][A-Za-z.'’-]+,?\s+[0-9]{4}[a-z]?[^)]{0,80}\)\s*[.;,]?$") | ((F.length(shown) >= 20) & (letters < 0.5 * F.length(shown)))


def numeric_blind(text: Column) -> Column:
    """Text with number words and digits replaced by a space, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)[0-9]+|\b(?:" + "|".join(NUMBER_WORDS) + r")\b", " "), r"[ \t\n\r]+", " "))


def skeleton(text: Column) -> Column:
    """Words that are no numerals or number words, lower-case, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: ~w.rlike("^[0-9]+$") & ~w.isin(*NUMBER_WORDS, "and"))


def length_violations(segments: DataFrame, limits: DataFrame) -> DataFrame:
    """(seg_uid, n_chars, kind) of segments shorter or longer than their type allows; ``limits`` is a table of a few rows."""
    own = limits.filter("item = 'segment'").select("type", "min_chars", "max_chars").dropDuplicates(["type"])
    held = segments.join(own, "type", "left").withColumns({"lo": F.coalesce("min_chars", F.lit(1)), "hi": F.coalesce("max_chars", F.lit(900)), "n_chars": F.coalesce(F.length("text"), F.lit(0))})
    kind = F.when(F.col("n_chars") < F.col("lo"), "short").when(F.col("n_chars") > F.col("hi"), "long")
    return held.select("seg_uid", "n_chars", kind.alias("kind")).filter("kind is not null")


def at_positions(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """(key, seg_uid): the first segment of the chapter whose half-open span holds a position; positions are (key, book_id, chapter_id, at).

    Spans are put into buckets of ``bucket`` characters, so the range join is an equality join and a filter.
    """
    bucket = 500
    spans = segments.filter("source_span is not null").select("seg_uid", "seg_ord", "book_id", "chapter_id", F.col("source_span.start").alias("a"), F.col("source_span.end").alias("b")).filter("b > a")
    spans = spans.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor((F.col("b") - 1) / bucket))))
    asked = positions.withColumn("k", F.floor(F.col("at") / bucket))
    met = asked.join(spans, ["book_id", "chapter_id", "k"]).filter((F.col("at") >= F.col("a")) & (F.col("at") < F.col("b")))
    return met.groupBy("key").agg(F.min_by("seg_uid", F.struct("seg_ord", "seg_uid")).alias("seg_uid"))


def book_terms(segments: DataFrame, words: DataFrame, most: int = 200) -> DataFrame:
    """(book_id, term, n, kind, place): tokens no dictionary has, names by capitals, terms by count; at most ``most`` a book (a report)."""
    each = segments.filter(F.col("text").isNotNull()).select("book_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("raw"))
    counted = each.groupBy("book_id", F.lower("raw").alias("term")).agg(F.count("*").alias("n"), F.count(F.when(F.col("raw").rlike("^[A-Z]"), 1)).alias("caps"))
    unknown = counted.join(words.select(F.col("word").alias("term")), "term", "left_anti")
    kind = F.when(F.col("caps") / F.col("n") >= 0.6, "name").when(F.col("n") >= 3, "term")
    ranked = unknown.withColumn("kind", kind).filter("kind is not null")
    place = F.row_number().over(W.partitionBy("book_id").orderBy(F.when(F.col("kind") == "name", 0).otherwise(1), F.col("n").desc(), "term"))
    return ranked.withColumn("place", place).filter(F.col("place") <= most).select("book_id", "term", "n", "kind", "place")

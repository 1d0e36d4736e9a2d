"""Problem 4: splitting oversized texts at natural boundaries.

One regular expression does the cutting: its alternatives take at least half
and at most the whole of the room up to a boundary, in the order paragraph,
line, sentence, clause, word, and at last so many characters. The pieces after
the first are preceded by the end of the piece before them, found by looking
back from the cut, from the start of a word where one is there. All of it is
built-in array functions, without Python.

Defined cases: a null text or limit gives no piece; an empty text, or one
within its limit, is one piece, itself; a limit below 1 counts as 1; an overlap
takes at most half the limit; repeated rows give repeated pieces; lengths are
code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that end a sentence, those that may follow them, and those that end a clause.
END = r"[.!?…。！？।؟|]"
CLOSE = r"[\"'”’»」』）)\]]*"
CLAUSE = r"[,;:，；：、،؛—–]"
#: Where no character is cut from its accents, joiners and tones.
WHOLE = r"(?![\p{M}\x{200D}\x{1F3FB}-\x{1F3FF}])(?<!\x{200D})"
#: Letters of scripts that part words; in the others any character may begin an overlap.
WORD = r"[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]"


def _options(room: Column) -> Column:
    """What a piece of at most ``room`` code points may be: the rest, or up to the strongest boundary that leaves at least half."""
    least = F.greatest(F.lit(1), F.floor(room / 2).cast("int")).cast("string")
    most = room.cast("string")
    span = F.concat(F.lit("[\\s\\S]{"), least, F.lit(","), most, F.lit("}"))
    options = [r"(?<=\n\s{0,3}\n)", r"(?<=\n)", rf"(?<={END}{CLOSE.replace('*', '{0,3}')}\s)", r"(?<=[。！？।])", rf"(?<={CLAUSE}\s)", r"(?<=[，；：、])", r"(?<=\s)"]
    upto = F.concat(F.lit("[\\s\\S]{1,"), most, F.lit("}"))
    # At last so many characters: whole ones with their accents and joiners if one of them fits.
    return F.concat_ws("|", F.concat(upto, F.lit("(?![\\s\\S])")), *[F.concat(span, F.lit(o)) for o in options], F.concat(upto, F.lit(WHOLE)), upto)


def _pattern(first: Column, later: Column) -> Column:
    """The cutting expression: the first piece has no overlap before it, so it has more room than the later ones."""
    return F.concat(F.lit("\\A(?:"), _options(first), F.lit(")|(?:"), _options(later), F.lit(")"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once: Spark would repeat an expression that is used twice."""
    return F.element_at(F.transform(F.array(value), then), 1)


def pieces(text: Column, limit: Column, overlap: Column) -> Column:
    """An array of (piece, start, text); start is the place in the text where the piece's own part begins."""
    size = F.greatest(F.lit(1), limit.cast("int"))
    back = F.greatest(F.lit(0), F.least(F.coalesce(overlap.cast("int"), F.lit(0)), F.floor(size / 2).cast("int")))

    def built(bodies: Column) -> Column:
        starts = F.aggregate(bodies, F.array(F.lit(0)), lambda done, body: F.concat(done, F.array(F.element_at(done, -1) + F.length(body))))

        def one(start: Column, body: Column, k: Column) -> Column:
            tail = F.substr(text, F.greatest(F.lit(0), start - back) + 1, F.least(start, back))
            # A tail that begins inside a word loses that part, unless nothing would be left.
            inside = (start > back) & F.substr(text, F.greatest(F.lit(1), start - back), F.lit(1)).rlike(WORD) & tail.rlike("^" + WORD)
            shorter = F.regexp_replace(tail, f"^{WORD}+[^\\p{{L}}\\p{{M}}\\p{{N}}]+(?=[\\s\\S]*[\\p{{L}}\\p{{N}}])", "")
            lead = F.when((k == 0) | (back == 0), F.lit("")).when(inside, shorter).otherwise(tail)
            return F.struct(k.alias("piece"), start.alias("start"), F.concat(lead, body).alias("text"))

        return _let(starts, lambda s: F.transform(bodies, lambda body, k: one(F.get(s, k), body, k)))

    # Bodies after the first are cut by the room that is left beside an overlap, so every piece keeps the limit.
    cut = F.when(F.length(text) > size, F.regexp_extract_all(text, _pattern(size, size - back), F.lit(0))).when(text.isNotNull() & limit.isNotNull(), F.array(text))
    return _let(cut, built)


def limited(chapters: DataFrame, segments: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows (src, uid, text, max_chars, overlap_chars) of both tables with the limit that holds for each.

    ``limits`` is a table of one row per item and type and is broadcast below Spark's own size check.
    """
    own = limits.select("item", "type", "max_chars", "overlap_chars").dropDuplicates(["item", "type"])
    a = chapters.select(F.lit("chapters").alias("src"), F.col("chapter_uid").alias("uid"), "text", F.lit("chapter").alias("item"), F.lit("chapter").alias("type"))
    b = segments.select(F.lit("segments").alias("src"), F.col("seg_uid").alias("uid"), "text", F.lit("segment").alias("item"), "type")
    return a.unionByName(b).filter(F.col("text").isNotNull()).join(own, ["item", "type"])


def split_rows(chapters: DataFrame, segments: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows (src, uid, piece, start, text): the pieces of every text above its limit."""
    own = limited(chapters, segments, limits).filter(F.length("text") > F.col("max_chars"))
    cut = own.select("src", "uid", F.inline(pieces(F.col("text"), F.col("max_chars"), F.col("overlap_chars"))))
    return cut.dropDuplicates(["src", "uid", "piece"])


def oversized(chapters: DataFrame, segments: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows (src, uid) of the texts that come out as more than one piece."""
    own = limited(chapters, segments, limits)
    cut = own.select("src", "uid", F.inline(pieces(F.col("text"), F.col("max_chars"), F.col("overlap_chars"))).alias("piece", "start", "text"))
    return cut.filter(F.col("piece") == 1).select("src", "uid").distinct()

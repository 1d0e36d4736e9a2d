"""Re-flow: printed lines into paragraphs, paragraphs over blocks and pages into continuous text.

What joins is decided row by row from a piece and the one before it; runs of
joined pieces are islands, and an island's text is put together in one
aggregation. Whether a word broken at a hyphen is a compound is an equality
join of the broken words alone with the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions import text as X
from bookloom.operators import structural as S
from bookloom.operators.ordered import with_previous, with_running
from bookloom.session import written

# Marks after which nothing goes on, and the words that open headings.
ENDED = '[.!?:;"”’)]$'
HEADING_WORDS = ("chapter", "part", "book", "section", "introduction", "preface", "foreword", "prologue", "epilogue", "conclusion", "appendix")
#: Letters that the left half of a compound has at least.
COMPOUND = 4
#: Places within a page, for an order over a whole book.
PLACES = 1000


def looks_heading(text: Column) -> Column:
    """A short text in capitals, or one that begins with a word of headings and has no mark at its end."""
    t = F.trim(text)
    capitals = (F.upper(t) == t) & (F.lower(t) != t)
    opens = F.lower(F.regexp_extract(t, r"^(\w+)", 1)).isin(*HEADING_WORDS) & ~t.rlike("[.!?,;]$")
    return (t != "") & (F.length(t) <= 90) & (capitals | opens)


def goes_on(before: Column, after: Column, over_pages: Column) -> Column:
    """Whether a text goes on from an unfinished one; over the end of a page all do but headings."""
    ended = before.rlike(ENDED)
    hanging = before.rlike("[-,]$")
    small = after.rlike("^\\p{Ll}") | after.rlike("^[\"'(\\[]")
    noun = before.rlike("\\p{Ll}$") & ~looks_heading(before) & ~looks_heading(after)
    return F.coalesce(~ended & (hanging | F.when(over_pages, ~looks_heading(after)).otherwise(small | noun)), F.lit(False))


def compounds(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (left, right) of halves that stay apart by their hyphen: both are words, what they make together is none."""
    own = pairs.select("left", "right").distinct().filter(F.length("left") >= COMPOUND)
    for name, value in (("left", F.col("left")), ("right", F.col("right"))):
        own = own.withColumn("_k", value).join(words.select(F.col("word").alias("_k")), "_k", "left_semi").drop("_k")
    return own.withColumn("_k", F.concat("left", "right")).join(words.select(F.col("word").alias("_k")), "_k", "left_anti").drop("_k")


def joined(pieces: DataFrame, group: list[str], order: str, words: DataFrame, text: str = "text") -> DataFrame:
    """(group, text): the pieces of each group in order as one text, words broken at its joints repaired."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    plain = F.replace(F.regexp_replace(plain, "­+$", "-"), F.lit("­"), F.lit(""))
    own = pieces.select(*group, order, plain.alias("_t")).filter("_t <> ''")
    after = F.lead("_t").over(W.partitionBy(*group).orderBy(order))
    own = own.withColumn("_broken", F.col("_t").endswith("-") & after.isNotNull())
    own = own.withColumns({"left": F.when(F.col("_broken"), F.lower(F.regexp_extract("_t", "([A-Za-z]+)-$", 1))), "right": F.when(F.col("_broken"), F.lower(F.regexp_extract(after, "^([A-Za-z]+)", 1)))})
    kept = compounds(own.filter("left <> '' and right <> ''"), words).withColumn("_kept", F.lit(True))
    held = own.join(kept, ["left", "right"], "left")
    head = F.expr("substring(_t, 1, length(_t) - 1)")
    said = F.when(F.col("_broken") & F.col("_kept").isNull(), head).when(F.col("_broken"), F.col("_t")).otherwise(F.concat("_t", F.lit(" ")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("t"))))
    whole = F.rtrim(F.array_join(F.transform("r", lambda x: x["t"]), ""))
    return held.groupBy(*group).agg(rows.alias("r")).select(*group, whole.alias("text"))


def block_paragraphs(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(book_id, page, place, text): the paragraphs of each page in reading order, without what is not narrated.

    A block is a paragraph or several; footnote markers and lost spaces are mended.
    """
    removed = S.removals(blocks).select("block_uid", "line_no")
    lines = S.block_lines(blocks.filter(F.col("text").isNotNull())).select("block_uid", "book_id", "page", "block_ord", "bbox", "line_no", "line")
    kept = lines.join(removed, ["block_uid", "line_no"], "left_anti")
    by_block = kept.groupBy("block_uid", "book_id", "page", "block_ord", F.bround("bbox.y0").alias("y"), F.col("bbox.x0").alias("x")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    by_block = by_block.withColumn("l", F.transform("l", lambda v: v["line"]))
    each = by_block.select("*", F.posexplode(S.paragraph_numbers(F.col("l"))).alias("k", "paragraph")).withColumn("line", F.get("l", F.col("k")))
    made = joined(each, ["book_id", "page", "y", "x", "block_ord", "block_uid", "paragraph"], "k", words, "line")
    place = F.row_number().over(W.partitionBy("book_id", "page").orderBy("y", "x", "block_ord", "block_uid", "paragraph")) - 1
    mended = made.withColumn("text", S.repair_spacing(S.without_markers(F.col("text")))).filter("text <> ''")
    return mended.select("book_id", "page", place.alias("place"), "text")


def flowed(paragraphs: DataFrame, pages: DataFrame, words: DataFrame, starts: DataFrame | None = None, scanned: DataFrame | None = None) -> DataFrame:
    """(book_id, page, place, text, n): paragraphs that go on over blocks and pages as one, at the place where each begins.

    Pages without paragraphs are looked past; nothing goes on over a blank page, or into a declared chapter start
    (``starts``: book_id, page). Pages of ``scanned`` (book_id, page) break lines into blocks, so they go on within as over pages.
    """
    own = written(paragraphs, "paragraphs").withColumn("_o", F.col("page").cast("long") * PLACES + F.col("place"))
    blank = pages.filter(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).select("book_id", (F.col("number") + 1).alias("page")).distinct()
    stops = blank if starts is None else blank.unionByName(starts.select("book_id", "page")).distinct()
    held = with_previous(own, ["book_id"], "_o", ["page", "text"]).join(stops.withColumn("_stop", F.lit(True)), ["book_id", "page"], "left")
    if scanned is None:
        held = held.withColumn("_scan", F.lit(False))
    else:
        held = held.join(scanned.select("book_id", "page").distinct().withColumn("_scan", F.lit(True)), ["book_id", "page"], "left").withColumn("_scan", F.coalesce("_scan", F.lit(False)))
    new_page = F.col("prev.page") != F.col("page")
    on = goes_on(F.col("prev.text"), F.col("text"), new_page | F.col("_scan")) & ~(new_page & F.coalesce(F.col("_stop"), F.lit(False)))
    numbered = with_running(held.withColumn("_on", F.coalesce(on, F.lit(False))), ["book_id"], "_o", F.when(F.col("_on"), 0).otherwise(1), "_island")
    numbered = written(numbered.select("book_id", "_island", "_o", "text"), "flow")
    text = joined(numbered, ["book_id", "_island"], "_o", words)
    first = numbered.groupBy("book_id", "_island").agg(F.min("_o").alias("_o"), F.count("*").alias("n"))
    return text.join(first, ["book_id", "_island"]).select("book_id", F.floor(F.col("_o") / PLACES).cast("int").alias("page"), (F.col("_o") % PLACES).cast("int").alias("place"), "text", "n")


def spaced_hyphens(texts: DataFrame, key: list[str], words: DataFrame, text: str = "text") -> DataFrame:
    """(key, text): 'self- made' in one: without the hyphen if that is a word, with it else; 'eighteenth- and' stays."""
    broken = r"\b([A-Za-z]{2,}- (?!(?:and|or|nor|und|oder|to)\b)[a-z]{2,})\b"
    parts = F.split(F.regexp_replace(F.replace(text, F.lit("\u0001"), F.lit("")), broken, "\u0001$1\u0001"), "\u0001")
    marked = texts.select(*key, F.col(text).alias("_text"), parts.alias("_p"))
    each = marked.filter(F.size("_p") > 1).select(*key, F.posexplode("_p").alias("k", "part"))
    fused = F.lower(F.replace("part", F.lit("- "), F.lit("")))
    hit = each.withColumn("word", F.when(F.col("k") % 2 == 1, fused)).join(words.select("word").withColumn("_hit", F.lit(True)), "word", "left")
    put = F.when(F.col("k") % 2 == 0, F.col("part")).otherwise(F.replace("part", F.lit("- "), F.when(F.col("_hit"), "").otherwise("-")))
    made = hit.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", put.alias("t")))).alias("r")).select(*key, F.array_join(F.transform("r", lambda x: x["t"]), "").alias("text"))
    return made.unionByName(marked.filter((F.size("_p") <= 1) | F.col("_text").isNull()).select(*key, F.col("_text").alias("text")))


def page_texts(paragraphs: DataFrame, words: DataFrame) -> DataFrame:
    """(book_id, number, text): the flowed paragraphs of each page that begins one, blank lines between."""
    rows = F.array_sort(F.collect_list(F.struct("place", "text")))
    own = paragraphs.groupBy("book_id", F.col("page").alias("number")).agg(rows.alias("r")).select("book_id", "number", F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"))
    return spaced_hyphens(own, ["book_id", "number"], words)

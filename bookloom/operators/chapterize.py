"""Chapters found from pages: where they start, by the best evidence a book has, and the text between.

Evidence, in this order: declared starts, an outline, headings by their words,
headings by their size, or none (the whole book is one chapter). Each gives rows
(book_id, start_page, place, title, matter); a book takes the first that it has
enough of. A page is one row and its paragraphs are an array in it, so what is
dropped within a page is array functions; only starts are ordered over a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.functions import text as X
from bookloom.operators import chapters as C
from bookloom.operators import dictionary as D
from bookloom.session import written

#: Size of a heading's type against the body's, how far down it may stand, and the dictionary words that it needs.
LARGE, UPPER, WORDS = 1.35, 0.45, 0.5
#: A page number at the end of a line, and the start of a numbered line.
TRAILING = r"\s(?:[0-9]{1,4}|[ivxlc]{1,7})\s*$"
NUMBERED = r"^\s*[0-9]{1,2}\.\s+\S"
DOTS = r"(?:\.\s*){4,}[0-9]*\s*$"


def _shown(text: Column) -> Column:
    """The lines of a text that are not blank."""
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")


def _count(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def is_contents(text: Column, leader: str = C.LEADER) -> Column:
    """Whether lines of text are those of a table of contents: its heading, three leaders, or many page numbers at line ends."""

    def judged(lines: Column) -> Column:
        trailing = _count(lines, lambda x: x.rlike(TRAILING) | x.contains("•"))
        headed = F.lower(F.trim(F.get(lines, F.lit(0)))).isin("contents", "table of contents")
        return (F.size(lines) > 0) & (headed | (_count(lines, lambda x: x.rlike(leader)) >= 3) | ((trailing >= 4) & (trailing / F.size(lines) >= 0.3)))

    return F.coalesce(X.let(_shown(text), judged), F.lit(False))


def is_listing(paragraph: Column) -> Column:
    """A paragraph of a contents heading or of dotted lines."""
    dotted = lambda lines: X.let(_count(lines, lambda x: x.rlike(DOTS)), lambda n: (F.size(lines) > 0) & ((n >= 2) | (n == F.size(lines))))
    return F.lower(F.trim(paragraph)).isin("contents", "table of contents") | X.let(_shown(paragraph), dotted)


def is_section_outline(paragraph: Column) -> Column:
    """A list of numbered section titles, without sentences, at the opening of a chapter."""
    p = F.trim(paragraph)
    one = p.rlike(NUMBERED) & ~p.endswith(".") & (F.length(p) < 200)
    listed = lambda lines: F.when(F.size(lines) < 2, one).otherwise(_count(lines, lambda x: x.rlike(NUMBERED) | x.rlike(TRAILING)) / F.size(lines) >= 0.6)
    return F.lower(p).isin("contents", "table of contents") | X.let(_shown(p), listed)


def repeats_title(paragraph: Column, title: Column) -> Column:
    """A short paragraph that says its chapter's title, or the start or end of it."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\W+", " "))
    return X.let(flat(X.unspaced(paragraph)), lambda p: (p != "") & (F.length(p) < 90) & F.contains(flat(title), p))


def without_leading(items: Column, test) -> Column:
    """An array without the items at its start that pass a test."""
    stops = F.transform(items, lambda x, k: F.when(test(x), F.size(items)).otherwise(k))
    first = F.coalesce(F.array_min(stops), F.size(items))
    return F.slice(items, first + 1, F.size(items))


def heading_starts(pages: DataFrame) -> DataFrame:
    """(book_id, start_page, place, title): the first heading by its words on each page that is no table of contents.

    A heading of a number alone takes the capitals of the next paragraph as its title.
    """
    paragraphs = F.split("text", "\n\n")
    each = pages.filter(F.col("text").isNotNull() & ~is_contents(F.col("text"))).select("book_id", "number", F.posexplode(F.transform(paragraphs, lambda p, k: F.struct(p.alias("p"), F.get(paragraphs, k + 1).alias("after")))).alias("place", "x"))
    held = each.withColumn("head", C.heading(F.col("x.p"))).filter("head is not null")
    first = held.groupBy("book_id", "number").agg(F.min_by(F.struct("place", "head", "x.after"), "place").alias("f")).select("book_id", F.col("number").alias("start_page"), "f.*")
    after = X.unspaced(F.trim("after"))
    capitals = (F.upper(after) == after) & (F.lower(after) != after) & F.length(after).between(4, 79) & ~after.contains("\n")
    bare = F.col("head").rlike(r"^(?i:chapter|part|book)\s+\S+\s*[:.-]?\s*$")
    own = C.title_case(F.col("head"))
    both = F.concat(F.regexp_replace(own, "[ :.-]+$", ""), F.lit(": "), C.title_case(after))
    return first.select("book_id", "start_page", "place", F.when(F.coalesce(bare & capitals, F.lit(False)), both).otherwise(own).alias("title"))


def font_starts(blocks: DataFrame, pages: DataFrame, sizes: DataFrame, words: DataFrame) -> DataFrame:
    """(book_id, start_page, place, title): the first short block in large type in the upper part of each page with text.

    ``sizes`` are (book_id, body_size); noise in large type is no title: it begins with a capital and half its words are known.
    """
    text = X.unspaced(F.trim(F.regexp_replace("text", r"\s+", " ")))
    own = blocks.join(sizes, "book_id").select("block_uid", "book_id", "page", "block_ord", text.alias("text"), "size", "body_size", "h", F.col("bbox.y0").alias("y0"))
    own = own.filter((F.col("size") >= F.col("body_size") * LARGE) & F.length("text").between(4, 90) & (F.col("y0") < F.col("h") * UPPER))
    own = own.filter(~F.col("text").rlike("^[0-9]+$") & ~F.col("text").rlike(C.LEADER) & F.col("text").rlike(r"^\p{Lu}"))
    known = D.word_ratio(own.select("block_uid", "text"), words, "block_uid").filter(F.col("dict_word_ratio") >= WORDS).select("block_uid")
    shown = pages.filter(F.coalesce(F.col("text"), F.lit("")) != "").select("book_id", F.col("number").alias("page"))
    held = own.join(known, "block_uid").join(shown, ["book_id", "page"])
    return held.groupBy("book_id", F.col("page").alias("start_page")).agg(F.lit(0).alias("place"), C.title_case(F.min_by("text", F.struct("block_ord", "block_uid"))).alias("title"))


def chosen_starts(strategies: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """(book_id, start_page, place, title, matter, source): each book's starts by the first strategy that has enough of them.

    ``strategies`` are (name, starts, least), the best evidence first.
    """
    union = None
    for rank, (name, starts, least) in enumerate(strategies):
        matter = F.col("matter") if "matter" in starts.columns else F.lit(None).cast("string")
        place = F.col("place") if "place" in starts.columns else F.lit(0)
        rows = starts.select("book_id", "start_page", place.alias("place"), "title", matter.alias("matter"), F.lit(name).alias("source"), F.lit(rank).alias("_rank"), F.lit(least).alias("_least"))
        union = rows if union is None else union.unionByName(rows)
    counts = union.groupBy("book_id", "_rank").agg(F.count("*").alias("n"), F.first("_least").alias("least")).filter("n >= least")
    best = counts.groupBy("book_id").agg(F.min("_rank").alias("_rank"))
    return union.join(best, ["book_id", "_rank"]).drop("_rank", "_least")


def font_before_heading(headings: DataFrame, fonts: DataFrame) -> DataFrame:
    """The starts by size of books that have two or more, and fewer than two by words."""
    n = headings.groupBy("book_id").agg(F.count("*").alias("n_head"))
    m = fonts.groupBy("book_id").agg(F.count("*").alias("n_font"))
    better = m.join(n, "book_id", "left").filter((F.coalesce("n_head", F.lit(0)) < 2) & (F.col("n_font") >= F.greatest(F.lit(2), F.coalesce("n_head", F.lit(0)) + 1)))
    return fonts.join(better.select("book_id"), "book_id", "left_semi")


def chapters_between(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, ord, title, matter, source, start_page, end_page, place) of all books of ``pages``.

    A chapter ends before the next one; pages before the first are front matter (ord -1); a book without starts is one chapter.
    """
    size = pages.groupBy("book_id").agg(F.count("*").alias("n_pages"), F.min("number").alias("first"), F.max("number").alias("last"))
    o = W.partitionBy("book_id").orderBy("start_page", "place", "title")
    held = starts.join(size, "book_id").withColumns({"ord": F.row_number().over(o) - 1, "next": F.lead("start_page").over(o)})
    end = F.greatest(F.coalesce(F.col("next") - 1, F.col("last")), F.col("start_page"))
    matter = F.coalesce("matter", C.matter(F.col("title"), F.col("start_page") / F.greatest(F.lit(1), F.col("n_pages"))))
    own = held.select("book_id", "ord", "title", matter.alias("matter"), "source", "start_page", end.alias("end_page"), "place", "first")
    front = own.filter((F.col("ord") == 0) & (F.col("start_page") > F.col("first")))
    front = front.select("book_id", F.lit(-1).alias("ord"), F.lit("Front Matter").alias("title"), F.lit("front").alias("matter"), "source", F.col("first").alias("start_page"), (F.col("start_page") - 1).alias("end_page"), F.lit(0).alias("place"))
    none = size.join(starts.select("book_id").distinct(), "book_id", "left_anti")
    whole = none.select("book_id", F.lit(0).alias("ord"), F.lit("Full Text").alias("title"), F.lit("body").alias("matter"), F.lit("none").alias("source"), F.col("first").alias("start_page"), F.col("last").alias("end_page"), F.lit(0).alias("place"))
    return own.drop("first").unionByName(front).unionByName(whole)


def page_parts(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Per chapter and page, its paragraphs that are narrated (kept) and those that are not: (book_id, ord, number, kept, dropped), dropped an array of (reason, chars)."""
    laid = C.pages_in(chapters, pages.select("book_id", "number", "text").filter(F.coalesce(F.col("text"), F.lit("")) != ""))
    opens = F.col("number") == F.col("start_page")
    out = lambda reason, items: F.transform(items, lambda p: F.struct(F.lit(reason).alias("reason"), F.length(p).alias("chars")))
    none = F.array().cast("array<string>")
    later = ~opens & is_contents(F.col("text"))
    base = laid.withColumn("all", F.when(later, none).otherwise(F.split("text", "\n\n")))
    base = base.withColumns({"plain": F.filter("all", lambda p: ~is_listing(p)), "listing": F.filter("all", lambda p: is_listing(p))})
    base = base.withColumn("a", F.when(opens, F.slice("plain", F.col("place") + 1, F.size("plain"))).otherwise(F.col("plain")))
    base = base.withColumn("b", F.when(opens, without_leading(F.col("a"), lambda p: repeats_title(p, F.col("title")))).otherwise(F.col("a")))
    base = base.withColumn("c", F.when(opens, without_leading(F.col("b"), is_section_outline)).otherwise(F.col("b")))
    mini = opens & (F.size("c") > 0) & is_contents(F.array_join("c", "\n"))
    said = lambda a, b: F.slice(a, 1, F.size(a) - F.size(b))
    dropped = F.concat(
        out("listing", F.col("listing")), out("title", said("a", "b")), out("section_outline", said("b", "c")),
        out("mini_toc", F.when(mini, F.array(F.array_join("c", "")))  .when(later, F.array("text")).otherwise(none)),
    )
    return base.select("book_id", "ord", "number", F.when(mini, none).otherwise(F.col("c")).alias("kept"), dropped.alias("dropped"))


def filled(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """The chapters with their text, paragraphs of their pages in order; a body chapter that turns out to be contents or a copyright page becomes front matter."""
    parts = page_parts(chapters, pages).filter(F.size("kept") > 0).groupBy("book_id", "ord").agg(F.array_sort(F.collect_list(F.struct("number", "kept"))).alias("r"))
    text = F.array_join(F.flatten(F.transform("r", lambda x: x["kept"])), "\n\n")
    total = chapters.groupBy("book_id").agg((F.max("end_page") + 1).alias("_total"))
    own = chapters.join(parts.select("book_id", "ord", text.alias("text")), ["book_id", "ord"], "left").join(total, "book_id").withColumn("text", F.coalesce("text", F.lit("")))
    head = F.substring("text", 1, 3000)
    body = F.col("matter") == "body"
    contents = body & is_contents(head)
    leak = body & (F.col("start_page") / F.col("_total") < 0.15) & C.says_front(head)
    title = F.when(contents & ~C.is_front_title(F.col("title")), "Contents").otherwise(F.col("title"))
    return own.select("book_id", "ord", title.alias("title"), F.when(contents | leak, "front").otherwise(F.col("matter")).alias("matter"), "source", "start_page", "end_page", "text")


def chapterized(pages: DataFrame, blocks: DataFrame, sizes: DataFrame, words: DataFrame, declared: DataFrame | None = None, outline: DataFrame | None = None) -> DataFrame:
    """Chapters of all books by the cascade, with their text, empty ones left out.

    ``declared`` is (book_id, start_page, title, matter), ``outline`` (book_id, level, title, start_page).
    """
    strategies = []
    if declared is not None:
        strategies.append(("sidecar", declared, 1))
    if outline is not None:
        entries = C.outline_entries(outline.filter("start_page is not null and title is not null"))
        strategies.append(("outline", entries.withColumn("title", C.title_case(F.trim("title"))), 2))
    headings, fonts = written(heading_starts(pages), "headings"), written(font_starts(blocks, pages, sizes, words), "fonts")
    strategies += [("font", font_before_heading(headings, fonts), 2), ("heading", headings, 1)]
    return filled(written(chapters_between(chosen_starts(strategies), pages), "chapters"), pages).filter(F.trim("text") != "")

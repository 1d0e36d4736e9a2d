"""Problem 5: lines and blocks of lines that keep coming back within one source.

Every line gets an identifier that numbers, dates, case, spacing, look-alikes,
misread characters and marks do not change. The texts of a source, as sequences
of identifiers, form one long string, whose suffix array groups what has a
common prefix. Its first level, suffixes with one line in common, is a hash
aggregate over (source, identifier) with a partial count on the map side, so a
source that holds a third of all rows is spread like any other. Lines below the
threshold cannot be part of a block that is above it; only lines above it go on
to the further levels, names of 2, 4, ... lines made by doubling, from which
the longest common prefix of each place with others gives the blocks of several
lines. The lines of all blocks, of one line or more, are deleted.

Defined cases: null and empty texts have no lines; blank lines and bare page
numbers are never found; a null source is a source of its own; repeated rows
and lines repeated within a text count once; lines of any length are whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.llm.lookalike import CYRILLIC, GREEK, consistent
from bookloom.session import written

#: A line is found in at least so many documents, and this share of its source's.
DOCUMENTS, SHARE = 5, 0.05
#: A margin line is found on at least so many pages of its book; margins as shares of the page height.
PAGES, TOP, BOTTOM = 3, 0.12, 0.90
#: Longer identifiers are replaced by their hash.
LONG = 120
#: Most misread characters that an identifier may hold and still be compared.
WILD = 3

# Month names, words for "page", and characters that scanners confuse, as (read, meant).
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec".split()
PAGE_WORDS = {"", "page", "p", "pp", "seite", "s", "página", "pagina", "pág", "pag", "стр", "страница", "с", "第页", "页", "頁", "ページ", "पृष्ठ", "หน้า", "صفحة", "ص", "folio", "blatt"}
READ = {"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "@": "a", "!": "l"}
FOLD = str.maketrans("cfyi", "etvl")
#: Letters of all scripts go to one, whatever their case, so capitals do not change an identifier.
ONE_SCRIPT = str.maketrans({**{k: v for k, v in {**GREEK, **CYRILLIC}.items() if k.islower()}, "т": "t", "к": "k", "м": "m", "в": "b", "н": "h", "τ": "t", "κ": "k", "μ": "m", "β": "b", "η": "h", "ι": "i", "χ": "x", "υ": "y", "α": "a", "ε": "e", "ζ": "z"})

#: What the months begin with; a line with none of it needs no look for their names.
_month_starts = sorted({m[:3] for m in MONTHS})
_month = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")(?![^\W\d_])")
_read = re.compile(r"(?<=[^\W\d_])[01569@!](?=[^\W\d_])|(?<![\w@!])[01569@!](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[01569@](?![\w@])")
_no_letter = re.compile(r"[\W\d_]+")
_mark = re.compile("[̀-ͯ]+")
_roman = re.compile(r"(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_readable = re.compile("[0-9@!]")
_ascii_letters = bytes(ord(chr(c).translate(FOLD)) for c in range(128)) + bytes(128)
_ascii_others = bytes(c for c in range(128) if not chr(c).isalpha())
_ascii_others_in_line = _ascii_others.replace(b"\n", b"")
_one_script = {**FOLD, **{k: ord(chr(v).translate(FOLD)) if isinstance(v, int) else v.translate(FOLD) for k, v in ONE_SCRIPT.items()}}
_roman_digits = frozenset("ivxlc")
#: A number in roman digits at the start of a line, or of the line read backwards.
_edge = re.compile(r"\W*([ivxlc]+)\W+(?=\w\w)")


def _without_roman(text: str) -> str:
    """A line without a roman number at its start and at its end."""
    head, tail = _edge.match(text), _edge.match(text[::-1])
    start = head.end() if head and _roman.fullmatch(head[1]) else 0
    end = len(text) - tail.end() if tail and _roman.fullmatch(tail[1][::-1]) else len(text)
    if start == 0 and end == len(text):
        return text
    # In a line of spaced letters these are letters.
    words = text.split()
    return text[start:end] if sum(len(w) == 1 for w in words) * 2 <= len(words) else text


def identifier(line: str, hashed: bool = True) -> str | None:
    """What all printings of one line have in common; None for blank lines and bare page numbers.

    A replacement character stands for one letter that could not be read.
    """
    if not line or line.isspace():
        return None
    text = consistent(line).casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFC", _mark.sub("", unicodedata.normalize("NFD", text)))
    # Words for "page" and roman numbers are short; a line whose start has more letters is none.
    plain = _no_letter.sub("", text[:16])
    if len(plain) < 9:
        plain = plain if len(text) <= 16 else _no_letter.sub("", text)
        if plain in PAGE_WORDS or (len(plain) < 8 and _roman.fullmatch(plain)):
            return None
    if text[0] in _roman_digits or text[-1] in _roman_digits or not (text[0].isalpha() and text[-1].isalpha()):
        text = _without_roman(text)
    if _readable.search(text):
        # Dates have digits, so months matter only beside some; a digit within a word is a misread letter.
        if any(m in text for m in _month_starts):
            text = _month.sub(" ", text)
        text = _read.sub(lambda m: READ[m[0]], text)
    if text.isascii():
        text = text.encode().translate(_ascii_letters, _ascii_others).decode()
    else:
        text = "".join([c for c in text if c.isalpha() or c == "�"]).translate(_one_script)
    text = text.replace("rn", "m")
    if not text:
        return None
    # One with unread letters stays as it is, to be compared letter by letter.
    return text if len(text) <= LONG or not hashed or "�" in text else "#" + xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def named(lines: list[str], name: str) -> list[int]:
    """Places of the lines whose identifier is ``name``.

    The identifier of a line of ASCII in which nothing can be a misread letter is
    a part of its folded letters, unless it is hashed; so such lines are folded
    together, and only those that hold the name are looked at.
    """
    if name.startswith("#"):
        return [k for k, line in enumerate(lines) if identifier(line) == name]
    plain = [k for k, line in enumerate(lines) if line.isascii() and not _readable.search(line)]
    folded = "\n".join([lines[k] for k in plain]).lower().encode().translate(_ascii_letters, _ascii_others_in_line).replace(b"rn", b"m")
    sought = name.encode("utf-8", "surrogatepass")
    asked = set(range(len(lines))).difference(plain)
    if sought in folded:
        asked.update(k for k, letters in zip(plain, folded.split(b"\n")) if sought in letters)
    return [k for k in sorted(asked) if identifier(lines[k]) == name]


def identified(texts: DataFrame) -> DataFrame:
    """Rows (src, grp, uid, unit, key, lines) per distinct identifier of a text; lines are the places it stands in.

    ``texts`` has (src, grp, uid, unit, text); unit is what is counted, a document or a page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str | None] = {}
        for batch in batches:
            at, keys, lines = [], [], []
            for k, text in enumerate(batch.column(4).to_pylist()):
                own: dict[str, list[int]] = {}
                for n, line in enumerate((text or "").split("\n")):
                    if line in memo:
                        key = memo[line]
                    else:
                        key = identifier(line)
                        if len(line) < 100:
                            memo[line] = key
                    if key is not None:
                        own.setdefault(key, []).append(n)
                at.extend([k] * len(own))
                keys.extend(own)
                lines.extend(own.values())
            if len(memo) > 100_000:
                memo.clear()
            take = pa.array(at, pa.int64())
            columns = [batch.column(c).take(take) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.string()), pa.array(lines, pa.list_(pa.int32()))], names=["src", "grp", "uid", "unit", "key", "lines"])

    return texts.select("src", "grp", "uid", "unit", "text").mapInArrow(run, "src string, grp string, uid long, unit long, key string, lines array<int>")


def spelt_out(often: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Frequent identifiers (src, grp, key) with their letters (_key), also where the identifier is a hash of them.

    The letters behind a hash are read from one text that has the line; ``texts`` has (src, grp, uid, text).
    """
    import pandas as pd

    def run(batches):
        for series in batches:
            yield series.map(lambda line: identifier(line, hashed=False), na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    own = often.select("src", "grp", "key")
    hashed = own.filter(F.col("key").startswith("#"))
    first = F.min(F.struct("uid", F.element_at("lines", 1).alias("line"))).alias("_at")
    one = written(lines.join(hashed, ["src", "grp", "key"]).groupBy("src", "grp", "key").agg(first), "hashed")
    held = one.select("src", "grp", F.col("_at.uid").alias("uid"), "key", F.col("_at.line").alias("_line")).join(texts.select("src", "grp", "uid", "text").filter("text is not null"), ["src", "grp", "uid"])
    line = F.get(F.split("text", "\n"), F.col("_line"))
    letters = held.select("src", "grp", "key", F.pandas_udf(run, "string")(line).alias("_key")).dropDuplicates(["src", "grp", "key"])
    return own.filter(~F.col("key").startswith("#")).withColumn("_key", F.col("key")).unionByName(letters)


def readable(lines: DataFrame, often: DataFrame, texts: DataFrame) -> DataFrame:
    """Lines with unread letters whose identifier can be a frequent one of their group: (src, grp, uid, unit, key, lines) with its key."""
    wild = lines.filter(F.col("key").contains("�") & (F.length("key") >= 4 * WILD) & (F.length(F.regexp_replace("key", "[^�]", "")) <= WILD))
    wild = wild.withColumnRenamed("key", "_wild").withColumn("_n", F.length("_wild"))
    if wild.filter(F.col("_n") > LONG).isEmpty():
        own = often.select("src", "grp", "key", F.col("key").alias("_key"))
    else:
        own = spelt_out(often, lines, texts)
    own = own.withColumn("_n", F.length("_key"))
    fits = F.expr("_key rlike concat('^', replace(_wild, '�', '.'), '$')")
    return wild.join(own, ["src", "grp", "_n"]).filter(fits).select("src", "grp", "uid", "unit", "key", "lines")


def documents_texts(documents: DataFrame) -> DataFrame:
    """Documents as (src, grp, uid, unit, text)."""
    texts = documents.select(F.lit("documents").alias("src"), F.coalesce("source", F.lit("")).alias("grp"), F.col("doc_id").alias("uid"), F.col("doc_id").alias("unit"), "text")
    return texts.filter(F.col("text").isNotNull())


def documents_lines(documents: DataFrame) -> DataFrame:
    """The lines of documents, grouped by source."""
    return identified(documents_texts(documents))


def documents_least(documents: DataFrame) -> DataFrame:
    """How many documents of each source a line must be in."""
    own = documents.groupBy(F.coalesce("source", F.lit("")).alias("grp")).agg(F.count("*").alias("n"))
    return own.select(F.lit("documents").alias("src"), "grp", F.greatest(F.lit(DOCUMENTS), F.ceil(F.col("n") * SHARE)).cast("long").alias("least"))


def margin_texts(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks that lie wholly in the top or bottom margin of their page, as (src, grp, uid, unit, text), grouped by book."""
    heights = pages.select("book_id", F.col("number").alias("page"), "page_height").filter(F.col("page_height") > 0)
    low, high = heights.agg(F.min("page_height"), F.max("page_height")).first()
    texts = blocks.select("book_id", "page", "block_uid", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"), "text").filter("text is not null")
    if high is None:
        texts, low, high = texts.limit(0), 0.0, 0.0
    near = texts.filter((F.col("y1") <= TOP * high) | (F.col("y0") >= BOTTOM * low))
    # Page heights may be repeated rows; the result counts a page once.
    held = near.join(heights.dropDuplicates(["book_id", "page"]), ["book_id", "page"])
    held = held.filter((F.col("y1") <= TOP * F.col("page_height")) | (F.col("y0") >= BOTTOM * F.col("page_height")))
    return held.select(F.lit("blocks").alias("src"), F.col("book_id").alias("grp"), F.col("block_uid").alias("uid"), F.col("page").cast("long").alias("unit"), "text")


def often_of(lines: DataFrame, least: DataFrame | None) -> DataFrame:
    """The frequent identifiers of lines; without ``least`` the bound for margins holds."""
    if least is None:
        pages = lines.select("src", "grp", "key", "unit").distinct()
        return pages.groupBy("src", "grp", "key").agg(F.count("*").alias("n")).filter((F.col("n") >= PAGES) & ~F.col("key").contains("�")).select("src", "grp", "key", "n")
    counts = lines.groupBy("src", "grp", "key").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= DOCUMENTS) & ~F.col("key").contains("�")).join(least, ["src", "grp"]).filter(F.col("n") >= F.col("least")).select("src", "grp", "key", "n")


def covered(lines: DataFrame, often: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (src, grp, uid, unit, key, lines) of the lines whose identifier is frequent in their group."""
    own = lines.join(often.select("src", "grp", "key"), ["src", "grp", "key"]).select("src", "grp", "uid", "unit", "key", "lines")
    return own.unionByName(readable(lines, often, texts))


def held_lines(documents: DataFrame, blocks: DataFrame, pages: DataFrame) -> list[DataFrame]:
    """The frequent lines of documents and of page margins, each as (src, grp, uid, unit, key, lines)."""
    out = []
    for texts, least in ((documents_texts(documents), documents_least(documents)), (margin_texts(blocks, pages), None)):
        kept = written(identified(texts), "lines")
        out.append(covered(kept, often_of(kept, least), texts))
    return out


def found(documents: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct (src, uid, line_no) of all repeated lines of documents and of page margins."""
    out = [held.select("src", "uid", F.explode("lines").alias("line_no")) for held in held_lines(documents, blocks, pages)]
    return out[0].unionByName(out[1]).distinct()


def repeated_blocks(documents: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, grp, block, n_lines, n_docs): the longest blocks of several lines that span enough documents of a source, or pages of a book.

    ``block`` is the array of its lines as one text has them. Every line of such
    a block is itself frequent, so only those go on. As a suffix array is built
    by doubling, each place gets the name of the 1, 2, 4, ... lines that begin
    there, made of the names of its two halves; a name stays while enough
    documents have it, so a round ends up with fewer places than the one before
    and the last with none. Then the longest common prefix of each place with
    enough others is found from the longest names down: a block that is
    frequent takes the next name if it still is together with it. A block on
    which some place ends is counted at all places that have it. No suffix is
    written out; rows are places with a number, spread by source and document.
    """
    docs, margins = held_lines(documents, blocks, pages)
    least = documents_least(documents).unionByName(margins.select("src", "grp").distinct().withColumn("least", F.lit(PAGES).cast("long")))
    all_lines = docs.unionByName(margins).select("src", "grp", "uid", "unit", F.lit(1).alias("n_lines"), F.xxhash64("key").alias("name"), F.explode("lines").alias("line_no"))
    levels = [written(all_lines, "names")]
    keys = ["src", "grp", "uid"]

    block = ["src", "grp", "n_lines", "name"]
    place = [*keys, "line_no"]

    def frequent(places: DataFrame) -> DataFrame:
        """The blocks (with n_docs) that enough units of their group have."""
        counts = places.select(*block, "unit").distinct().groupBy(*block).agg(F.count("*").alias("n_docs"))
        return counts.join(least, ["src", "grp"]).filter("n_docs >= least").drop("least")

    def longer(places: DataFrame, step: DataFrame, by: int) -> DataFrame:
        """Places with their block and the ``by`` lines of ``step`` that follow it."""
        on = step.select(*keys, F.col("line_no").alias("_at"), F.col("name").alias("_next"))
        both = places.withColumn("_at", F.col("line_no") + F.col("n_lines")).join(on, [*keys, "_at"])
        return both.withColumns({"name": F.xxhash64("name", "_next"), "n_lines": F.col("n_lines") + by}).drop("_at", "_next")

    def longest(places: DataFrame) -> DataFrame:
        """The longest block of each place."""
        return places.groupBy(*place).agg(F.max_by("name", "n_lines").alias("name"), F.max("n_lines").alias("n_lines"))

    while not levels[-1].isEmpty():
        more = longer(levels[-1], levels[-1], 1 << (len(levels) - 1))
        levels.append(written(more.join(frequent(more).drop("n_docs"), block, "left_semi"), "names"))
    held = levels[0]
    for k in range(len(levels) - 2, -1, -1):
        more = longer(held, levels[k], 1 << k)
        both = written(held.unionByName(more.join(frequent(more), block, "left_semi")), "held")
        held = written(both.join(longest(both).select(*block).distinct(), block, "left_semi"), "held")
    # A place inside a block that begins before it is part of that one.
    whole = longest(held).filter("n_lines > 1")
    inside = whole.select(*keys, F.explode(F.sequence(F.col("line_no") + 1, F.col("line_no") + F.col("n_lines") - 1)).alias("line_no")).distinct()
    one = whole.join(inside, place, "left_anti").groupBy(*block).agg(F.min(F.struct("uid", "line_no")).alias("_at")).join(frequent(held), block)
    texts = documents_texts(documents).unionByName(margin_texts(blocks, pages)).select("src", "grp", "uid", "text").dropDuplicates(["src", "uid"])
    shown = one.select("*", F.col("_at.uid").alias("uid")).join(texts, ["src", "grp", "uid"])
    return shown.select("src", "grp", F.slice(F.split("text", "\n"), F.col("_at.line_no") + 1, F.col("n_lines")).alias("block"), "n_lines", "n_docs")


def without(texts: DataFrame, rows: DataFrame, uid: str, src: str, text: str = "text") -> DataFrame:
    """``texts`` (one row per uid) without the lines that ``rows`` (src, uid, line_no) names; their other columns stay."""
    gone = rows.filter(F.col("src") == src).groupBy(F.col("uid").alias(uid)).agg(F.collect_set("line_no").alias("_gone"))
    kept: Column = F.filter(F.split(text, "\n"), lambda _, k: ~F.array_contains("_gone", k))
    return texts.join(gone, uid, "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_gone")


def cleaned(documents: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, uid, text): every text of documents and of blocks, in a margin or not, without its repeated lines; null stays null."""
    rows = written(found(documents, blocks, pages), "repeated")
    texts = (("documents", documents.select(F.col("doc_id").alias("uid"), "text")), ("blocks", blocks.select(F.col("block_uid").alias("uid"), "text")))
    out = [without(own.dropDuplicates(["uid"]), rows, "uid", src).select(F.lit(src).alias("src"), "uid", "text") for src, own in texts]
    return out[0].unionByName(out[1])

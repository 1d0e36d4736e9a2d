"""Problem 2: statistics of text quality, and what is natural prose.

Each text gets its word count, mean word length, symbol ratio, share of lines
that end in punctuation, share of common words, shares of duplicate lines and
paragraphs, and the part of it that its most frequent character n-gram covers.
Each line gets a class from the same kinds of figures: prose, entry (of a list,
index or contents), table or junk. A text is no prose if more than half of its
visible characters are in lines that are none, not counting lines that come
back in its source, page numbers and running heads, or if it repeats itself:
one n-gram covers more than ``COVER`` of it, or more than ``AGAIN`` of it is in
lines, or in paragraphs, that it had before. The repetition is measured of
every text, whatever its lines are and however long it is.

Lines that come back are those of the repeated-lines operator: line classes are
measured in the same pass that identifies lines, so documents are read once.

Defined cases: null texts have no row; texts with fewer than 20 visible
characters, and headings, are never found; repeated rows count once; the
statistics of a text without words are 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm import repeated_lines
from bookloom.llm.scan_noise import is_number
from bookloom.session import checked_broadcast_rows, written

#: Visible characters below which a text is never found.
SHORT = 20
#: Lines that a page may have beside its number and still be nothing but margins.
MARGINS = 2
#: Length of the character n-grams, a power of two, how often one has to occur, and the part of a text it may cover.
GRAM, OCCURS, COVER = 8, 3, 0.5
#: The part of a text that may be in second or later copies of its lines, or of its paragraphs.
AGAIN = 0.5
#: Characters that are measured in one array operation; longer texts are measured whole, alone.
TOGETHER = 1_000_000
#: Most words of the lexicon that are sent to every worker; the lexicon is a fixed table.
LEXICON = 50_000
#: Words of at least this frequency in the lexicon are common.
COMMON = 6

# What marks running text in scripts without spaces.
FUNCTION = re.compile("[的了在是不没有都和与为这那从说到]|[ぁ-ん]|และ|ที่|ว่า|มี|เมื่อ|ใน|ของ|เป็น|คือ|จาก|ไม่|กับ|รู้|ยาว|แล้ว|จึง|เรื่อง|ถาม|มา|ไป|จน|ราว")
_unspaced = re.compile("[぀-ヿ㐀-鿿฀-๿]")
_words = re.compile("[^\\W\\d_][\\ẁ-ͯऀ-ःऺ-ॏ॑-ॗॢॣً-ٟ'’-]*")
#: Signs of what may be no prose; a line without any needs no more than its words.
_special = re.compile(r"[\t|;/_□¤§¿¾�Ã\\{}<>=+*#…·]")
_run_on = re.compile(r",(?=\S)")
_coded = re.compile(r"\d\S*[A-Za-z]\S{8}")
_vowel = re.compile("[aeiouy]")
_numeric = re.compile(r"\d+(?:[.,]\d+)*")
_leader = re.compile(r"(?:\.\s?){5,}|(?:…\s?){3,}|(?:·\s?){5,}|_{5,}")
_marker = re.compile(r"\s*(?:\(?\d{1,3}[.)]|[-*•·–—>‣◦▪]|\(?[a-z]\)|\[\d+\])\s+")
_index = re.compile(r".{1,60}?[,\s]\s*\d{1,4}(?:\s*[-–]\s*\d{1,4})?[.;]?\s*$")
_final = re.compile(r"[.!?…。！？।؟][\"'”’»」』)\]]*\s*$")
_strange = re.compile(r"[□¤§¿¾½¼µ¶º¹²³¸´¯¢£¥¦¨ª±×÷|~^_�°{}<>=+*#\\@$%&/]|Ã|Â")
_spaces3 = re.compile(r" {3,}|\t|\s\|\s")
_blank = re.compile(r"\n\s*\n")
_code = re.compile(r"(?=\S*\d)(?=\S*[A-Za-z])[A-Za-z0-9+/=]{14,}")


def _odd(shown: str) -> bool:
    """Whether a line has a sign, or a word, that prose seldom has."""
    if _special.search(shown) or "....." in shown or "   " in shown or _run_on.search(shown):
        return True
    long = [w for w in shown.split() if len(w) > 9]
    return bool(long) and (max(map(len, long)) > 34 or any(map(_coded.search, long)))


def line_class(line: str, common: frozenset[str]) -> str:
    """Class of a line on its own: prose, entry, table, junk, or '' where it alone does not tell (a few words)."""
    shown = line.strip()
    if not shown:
        return ""
    lower = words = _words.findall(shown.lower())
    known = sum(map(common.__contains__, lower))
    if len(words) >= 4 and known * 8 >= len(words) and not _odd(shown) and not _marker.match(shown):
        return "prose"
    size = len(shown) - shown.count(" ")
    if not words:
        return "junk"
    numbers = len(_numeric.findall(shown))
    if "\t" in shown and len(shown.split("\t")) > 2 or shown.count("|") > 1 and " | " in shown:
        return "table"
    if _leader.search(shown):
        return "entry" if len(_leader.findall(shown)) == 1 and shown[-1].isdigit() else "junk"
    fields = re.split(r";(?=\S)|,(?=\S)", shown)
    if len(fields) > 2 and (all(" " not in f.strip() or len(f) < 24 for f in fields)):
        return "table"
    if numbers > 1 and numbers * 2 >= len(words) + numbers and len(words) < 6:
        if numbers > 2:
            return "table"
    signs = len(_strange.findall(shown))
    if signs > 2 and signs > 0.08 * size:
        return "junk"
    if not _unspaced.search(shown):
        longest = max(map(len, shown.split()))
        if longest > 34 or _code.search(shown):
            return "junk"
        if len(_spaces3.split(shown)) > 2 and known * 4 < len(words):
            return "table"
        if _marker.match(shown) and len(words) <= 10 and (not _final.search(shown) or known * 3 <= len(words)) or " / " in shown and len(words) < 12:
            if not (known >= 3 and _final.search(shown)):
                return "entry"
        if known * 8 >= len(words) and len(words) >= 4 and known >= 1:
            return "prose"
        if _index.fullmatch(shown) and len(words) <= 6 and known * 3 < len(words):
            return "entry"
        if known * 8 < len(words) and len(words) >= 3 and 2 * sum(w.isascii() and len(w) > 2 and not _vowel.search(w) for w in lower) > len(words):
            return "junk"
        if len(words) >= 6 and known * 12 < len(words):
            return "junk" if _final.search(shown) is None or known == 0 and len(words) > 12 else ""
        if known == 0 and len(words) <= 5:
            return "short"
        return ""
    hits = len(FUNCTION.findall(shown))
    if len(_spaces3.split(shown)) > 2 and numbers > 1:
        return "table"
    if _marker.match(shown) and size < 30 and hits * 6 < size or " / " in shown:
        return "entry"
    if hits * 16 >= size and size >= 6:
        return "prose"
    if _index.fullmatch(shown) and size < 30:
        return "entry"
    if max(map(len, shown.split())) > 60 and hits * 40 < size:
        return "junk"
    if _final.search(shown) and size > 8 and hits:
        return "prose"
    return "short" if size < 24 else "" if hits else "junk"


def classes(lines: list[str], common: frozenset[str]) -> list[str]:
    """Class of each line; lines of few words are judged by what they follow and by their neighbours."""
    own = [line_class(line, common) for line in lines]
    shown = [k for k in range(len(lines)) if own[k] or lines[k].strip()]
    few = {k for k in shown if own[k] in ("", "short")}
    before, ended = "", True
    for at, k in enumerate(shown):
        line = lines[k].rstrip()
        if k in few:
            # One line of few words may end a paragraph; several in a row are entries.
            alone = at + 1 == len(shown) or shown[at + 1] not in few or shown[at + 1] > k + 1
            if before == "prose" and not ended and alone and shown[at - 1] == k - 1 and not _marker.match(line):
                own[k] = "prose"
            elif own[k] == "" and _final.search(line):
                own[k] = "prose"
            else:
                own[k] = "few"
        before, ended = own[k], bool(_final.search(line))
    # What is left: lines of few words go on in prose, or stand among entries, or are a title.
    first = list(own)
    for at, k in enumerate(shown):
        if own[k] != "few":
            continue
        near = [first[j] for j in shown[max(0, at - 2) : at + 3] if j != k]
        after = own[shown[at + 1]] if at + 1 < len(shown) else ""
        if after == "prose" and lines[shown[at + 1]].lstrip()[:1].islower() and not _final.search(lines[k].rstrip()):
            own[k] = "prose"
        elif near and sum(c in ("few", "entry", "table", "junk") for c in near) * 2 > len(near):
            own[k] = "entry"
        else:
            own[k] = "title"
    return own


def visible(text: str) -> int:
    """Number of characters that show."""
    return len("".join(text.split()))


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the n-gram at each place but the last few, its high bits mixed."""
    if len(codes) < GRAM:
        return np.zeros(0, np.uint64)
    hashes, size = codes, 1
    while size < GRAM:
        # Two neighbours of half the length make one of the whole.
        hashes = hashes[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + hashes[size:]
        size *= 2
    return hashes * np.uint64(0xD6E8FEB86659FD93)


def _codes(shown: str) -> np.ndarray:
    return np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def coverage(text: str) -> float:
    """The part of a text's visible characters that its most frequent n-gram covers; 0 if none occurs often enough."""
    shown = "".join(text.split())
    hashes = _grams(_codes(shown))
    if not len(hashes):
        return 0.0
    values, counts = np.unique(hashes, return_counts=True)
    if counts.max() < OCCURS:
        return 0.0
    at = np.flatnonzero(hashes == values[np.argmax(counts)])
    # Copies that overlap cover their common part once.
    return float(np.minimum(np.diff(at), GRAM).sum() + GRAM) / len(shown)


def covered(texts: list[str]) -> list[bool]:
    """Whether one n-gram covers more than ``COVER`` of each text.

    No n-gram covers more than its length times its count, which one sort gives
    for many texts; only texts where that is enough are measured on their own.
    """
    out, start = [], 0
    while start < len(texts):
        shown, size, end = [], 0, start
        while end < len(texts) and (end == start or size + len(texts[end]) <= TOGETHER):
            shown.append("".join(texts[end].split()))
            size += len(texts[end])
            end += 1
        sizes = np.array([len(x) for x in shown])
        ends = np.cumsum(sizes)
        own = np.repeat(np.arange(len(shown)), sizes)
        hashes = _grams(_codes("".join(shown)))
        inside = np.arange(len(hashes)) + GRAM <= ends[own[: len(hashes)]]
        of = own[: len(hashes)][inside]
        keys = (of.astype(np.uint64) << np.uint64(40)) | (hashes[inside] >> np.uint64(24))
        keys.sort()
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
        most = np.zeros(len(shown), np.int64)
        counts = np.diff(edges)
        held = np.flatnonzero(counts >= OCCURS)
        np.maximum.at(most, (keys[edges[held]] >> np.uint64(40)).astype(np.int64), counts[held])
        enough = (most >= OCCURS) & (most * GRAM > COVER * sizes)
        out.extend(bool(e) and coverage(texts[start + k]) > COVER for k, e in enumerate(enough))
        start = end
    return out


def again(parts: list[str]) -> int:
    """Visible characters of the parts that are copies of one before."""
    if len(set(parts)) == len(parts):
        return 0
    seen: set[str] = set()
    size = 0
    for part in parts:
        if part in seen:
            size += visible(part)
        elif part:
            seen.add(part)
    return size


def repeats(text: str, lines: list[str]) -> bool:
    """Whether more than ``AGAIN`` of a text is in copies of its own lines, or of its paragraphs however they are wrapped."""
    if len(lines) < 2:
        return False
    least = AGAIN * visible(text)
    if again([line.strip() for line in lines]) > least:
        return True
    return "\n\n" in text and again([" ".join(p.split()) for p in _blank.split(text)]) > least


def statistics(text: str, common: frozenset[str]) -> tuple[int, float, float, float, float, float, float, float]:
    """The eight figures of a text."""
    words = _words.findall(text)
    shown = visible(text)
    lines = [x for line in text.split("\n") if (x := line.strip())]
    paragraphs = [x for p in _blank.split(text) if (x := p.strip())]
    letters = sum(map(len, words))
    symbols = shown - letters - sum(map(len, _numeric.findall(text)))
    rate = lambda n, of: round(n / of, 6) if of else 0.0
    return (
        len(words),
        rate(letters, len(words)),
        rate(max(0, symbols), shown),
        rate(sum(bool(_final.search(x)) for x in lines), len(lines)),
        rate(sum(w.lower() in common for w in words), len(words)),
        rate(len(lines) - len(set(lines)), len(lines)),
        rate(len(paragraphs) - len(set(paragraphs)), len(paragraphs)),
        round(coverage(text), 6),
    )


def no_prose(text: str, common: frozenset[str], whole: bool | None = None) -> bool:
    """Whether a text that stands alone is no natural prose; ``whole`` says whether one n-gram covers it, where that is known for a batch."""
    if visible(text) < SHORT:
        return False
    lines = text.split("\n")
    shown = other = 0
    own = classes(lines, common)
    whole = repeats(text, lines) or (covered([text])[0] if whole is None else whole)
    for line, kind in zip(lines, own):
        if kind and not is_number(line):
            size = visible(line)
            shown += size if kind != "title" else 0
            other += size if whole or kind in ("entry", "table", "junk") else 0
    return other * 2 > shown


def common_words(lexicon: DataFrame) -> frozenset[str]:
    """The common words of a lexicon; the table has a fixed size, which is checked."""
    return frozenset(r.word for r in checked_broadcast_rows(lexicon.filter(F.col("freq") >= COMMON).select("word").distinct(), LEXICON, "the lexicon"))


def text_statistics(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row of statistics per (src, uid) of ``texts`` (src, uid, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(common_words(lexicon))
    names = ["words", "mean_word_length", "symbol_ratio", "lines_ended", "common_words", "duplicate_lines", "duplicate_paragraphs", "top_gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(text, shared.value) for text in batch.column(2).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 8
            arrays = [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[1:]]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["src", "uid", *names])

    schema = "src string, uid long, words int, " + ", ".join(f"{n} double" for n in names[1:])
    return texts.select("src", "uid", "text").filter(F.col("text").isNotNull()).dropDuplicates(["src", "uid"]).mapInArrow(run, schema)


def measured(texts: DataFrame, common: frozenset[str], by_line: bool) -> DataFrame:
    """Per text, or per distinct line identifier of a text: visible characters (shown) and those that are no prose (other).

    ``texts`` has (src, grp, uid, text, long); long goes on to the result.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            at, keys, shown, other = [], [], [], []
            sources, texts_of = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for k, (text, whole) in enumerate(zip(texts_of, covered(texts_of))):
                lines = text.split("\n")
                own = classes(lines, words)
                junk = whole or repeats(text, lines)
                sums: dict[str | None, list[int]] = {}
                # A page of so few lines is its margins; they are no list.
                few = not by_line and "junk" not in own and sum(bool(kind) and not is_number(line) for line, kind in zip(lines, own)) <= MARGINS and sources[k] == "pages"
                for line, kind in zip(lines, own):
                    if not kind or is_number(line) or few and kind in ("entry", "table"):
                        continue
                    size = visible(line)
                    key = repeated_lines.identifier(line) if by_line else ""
                    entry = sums.setdefault(key, [0, 0])
                    if kind != "title":
                        entry[0] += size
                    if junk or kind in ("entry", "table", "junk"):
                        entry[1] += size
                at.extend([k] * len(sums))
                keys.extend(sums)
                shown.extend(s for s, _ in sums.values())
                other.extend(o for _, o in sums.values())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in (0, 1, 2, 4)], pa.array(keys, pa.string()), pa.array(shown, pa.int64()), pa.array(other, pa.int64())], names=["src", "grp", "uid", "long", "key", "shown", "other"])

    return texts.select("src", "grp", "uid", "text", "long").mapInArrow(run, "src string, grp string, uid long, long boolean, key string, shown long, other long")


def long_enough(text: str = "text"):
    """Texts with enough visible characters."""
    return F.length(F.regexp_replace(text, r"[\s\p{Z}\p{C}]+", "")) >= SHORT


def found(documents: DataFrame, pages: DataFrame, segments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct (src, uid) of the texts that are no natural prose."""
    common = common_words(lexicon)
    docs = documents.select(F.lit("documents").alias("src"), F.coalesce("source", F.lit("")).alias("grp"), F.col("doc_id").alias("uid"), "text").filter(F.col("text").isNotNull())
    # Short documents are never found, but their lines count among those that come back.
    lines = written(measured(docs.withColumn("long", long_enough()), common, True), "quality")
    least = repeated_lines.documents_least(documents)
    often = repeated_lines.often_of(lines.filter("key is not null"), least).select("src", "grp", "key")
    own = lines.filter("long").join(often, ["src", "grp", "key"], "left_anti").groupBy("src", "uid").agg(F.sum("shown").alias("shown"), F.sum("other").alias("other"))
    rest = pages.select(F.lit("pages").alias("src"), F.lit("").alias("grp"), F.col("page_uid").alias("uid"), "text").unionByName(other_segments(segments))
    alone = measured(rest.filter(F.col("text").isNotNull() & long_enough()).withColumn("long", F.lit(True)), common, False)
    return own.select("src", "uid", "shown", "other").unionByName(alone.select("src", "uid", "shown", "other")).filter("other * 2 > shown").select("src", "uid").distinct()


def other_segments(segments: DataFrame) -> DataFrame:
    """Segments that are no headings, as (src, grp, uid, text)."""
    own = segments.filter(~F.coalesce("type", F.lit("")).endswith("heading"))
    return own.select(F.lit("segments").alias("src"), F.lit("").alias("grp"), F.col("seg_uid").alias("uid"), "text")

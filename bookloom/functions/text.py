"""Column builders for text: normalization, tokens, character classes. All of it stays in the JVM.

Null texts give null; empty texts give what each function says of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What normalization unifies, and the marks of failed extraction.
QUOTES = ("“”‘’–—− ", "\"\"''--- ")
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"))
GARBAGE = "[\\x{FFFD}\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{E000}-\\x{F8FF}]"
SPACE = "[\\t-\\r\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once: Spark would repeat an expression that is used twice."""
    return F.element_at(F.transform(F.array(value), then), 1)


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalized(text: Column, fold: bool = False) -> Column:
    """Quotes, dashes and ligatures unified, soft hyphens dropped, white space collapsed; ``fold`` also drops case."""
    out = F.translate(text, *QUOTES)
    for glyph, letters in LIGATURES:
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    out = F.regexp_replace(F.replace(out, F.lit("­"), F.lit("")), f"{SPACE}+", " ")
    out = F.trim(out)
    return F.lower(out) if fold else out


def contains_normalized(text: Column, part: Column) -> Column:
    """Whether a text contains another, both normalized and without case."""
    return F.contains(normalized(text, True), normalized(part, True))


def scrubbed(text: Column) -> Column:
    """Text without private-use and control characters; tab, newline and the replacement character stay."""
    return F.regexp_replace(text, "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{E000}-\\x{F8FF}]", "")


def garbage_density(text: Column) -> Column:
    """Share of characters that mark a failed extraction; 0 for an empty text."""
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(GARBAGE)) / F.length(text))


def tokens(text: Column) -> Column:
    """Alphabetic ASCII tokens of two letters or more, as printed."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")


# Abbreviations that end no sentence where sentences are aligned.
ALIGNED_ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "cf", "ed", "vol", "no", "pp", "ca", "e.g", "i.e")


def aligned_sentences(text: Column) -> Column:
    """The sentences of a text as two texts are aligned by them: cut before a capital or a digit, not after abbreviations."""
    pieces = F.split(F.regexp_replace(normalized(text), r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9])", "\u0001"), "\u0001")

    def fold(done: Column, piece: Column) -> Column:
        short = F.lower(F.regexp_extract(F.element_at(done, -1), r"\b((?:[A-Za-z]\.)?[A-Za-z]+)\.$", 1)).isin(*ALIGNED_ABBREVIATIONS)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), piece)))
        return F.when(F.size(done) == 0, F.array(piece)).when(short, joined).otherwise(F.concat(done, F.array(piece)))

    whole = F.aggregate(pieces, F.array().cast("array<string>"), fold)
    return F.filter(F.transform(whole, lambda s: F.trim(s)), lambda s: s != "")


def letter_words(text: Column) -> Column:
    """Lower-case words of letters and apostrophes; an apostrophe alone is none."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z' ]", " "), " +"), lambda w: F.regexp_replace(w, "'", "") != "")


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank, each with its place among all lines of the text."""
    numbered = F.transform(F.split(text, "\n"), lambda line, k: F.struct(k.alias("line_no"), F.trim(F.regexp_replace(line, "[\\t\\r]", " ")).alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def unspaced(text: Column) -> Column:
    """Letter-spaced runs of three letters or more, closed up."""
    marked = F.regexp_replace(text, "\\b(?:[A-Za-z] ){2,}[A-Za-z]\\b", "\u0001$0\u0001")
    # Only what is between two marks loses its spaces: every odd part of the split.
    parts = F.transform(F.split(marked, "\u0001"), lambda part, k: F.when(k % 2 == 1, F.replace(part, F.lit(" "), F.lit(""))).otherwise(part))
    return F.array_join(parts, "")


def template(text: Column) -> Column:
    """What the printings of one margin line have in common: digits to #, no case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(unspaced(text), "[0-9]+", "#")), "[ \\t\\r\\n]+", " "))


def is_page_number(line: Column) -> Column:
    """Up to six digits and spaces, or up to seven roman letters."""
    return line.rlike("^(?:[0-9 ]{1,6}|[ivxlcIVXLC]{1,7})$")


def excerpt(text: Column, needle: str, radius: int = 40) -> Column:
    """Characters around the first hit, newlines as spaces; the needle's head where there is none."""
    at = F.locate(needle, text)
    around = F.substr(text, F.greatest(F.lit(1), at - radius), F.least(at - 1, F.lit(radius)) + len(needle) + radius)
    return F.when(at > 0, F.regexp_replace(around, "\n", " ")).otherwise(F.lit(needle[: 2 * radius]))


def upper_median(values: Column) -> Column:
    """The upper middle of an array of numbers; null for an empty one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def short_hash(*parts: Column) -> Column:
    """24 hexadecimal digits of SHA-256 over the parts, separated by |."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)

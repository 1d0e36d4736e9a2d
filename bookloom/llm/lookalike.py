"""Problem 3: one consistent form for texts that look the same.

Each token of letters gets the set of scripts in which all of it could be
spelled: a letter that looks like letters of other scripts is in all of them,
and the sets of a token's letters are intersected. One script left, or the
text's own script among several (a whole-script confusable), gives the
spelling; a token that no script can spell (mixed) takes the common form letter
by letter. The sets are the same for all spellings that look alike, so equal
looking texts come to the same form. Then width, ligatures and presentation
forms, radicals, accents, invisible characters, spaces and hyphens are unified.
Letter case, digits, words, accents, the number of spaces and line breaks stay.

Defined cases: null stays null; an empty text is itself; texts without a
visible character are in no pair; repeated rows of one uid count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.session import written

# Letters of other scripts beside the Latin letter that they look like.
CYRILLIC = dict(zip("асеһіјоԛѕԝхуԁрАВСЕНІЈКМОРԚЅТԜХУ", "acehijoqswxydpABCEHIJKMOPQSTWXY"))
GREEK = dict(zip("ονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "ovpABEZHIKMNOPTYXcj"))
ARMENIAN = dict(zip("օոսհցզքյՕՍՏԼ", "onuhgqpjOUSL"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"))
#: Letters of the Latin script that look like plain ones.
LATIN = dict(zip("ɡɑıⅼⅰ", "gaili"))
#: The scripts by a letter each, in the order in which a token takes one, and what of each looks like which Latin letter.
LOOKS = {"L": LATIN, "C": CYRILLIC, "G": GREEK, "A": ARMENIAN, "K": CHEROKEE, "I": LISU}
TO_LATIN = {k: v for table in LOOKS.values() for k, v in table.items()}
OF_LATIN = {script: {v: k for k, v in table.items()} for script, table in LOOKS.items() if script != "L"}

INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻"
SPACES = "   -   　"
HYPHENS = "‐‑﹣－"


def _compatible() -> dict[int, str]:
    """Characters whose compatibility form looks the same: widths, ligatures, presentation forms, radicals."""
    table = {}
    ranges = [(0x2E80, 0x2FE0), (0xF900, 0xFB50), (0xFB50, 0xFE00), (0xFE70, 0xFEFF), (0xFF01, 0xFFEF), (0x1F1, 0x1F4), (0x132, 0x134), (0x1C4, 0x1CD), (0x1D400, 0x1D800)]
    for a, b in ranges:
        for code in range(a, b):
            same = unicodedata.normalize("NFKC", chr(code))
            if same != chr(code):
                table[code] = same
    # Single letters of other styles among the letter-like symbols.
    for code in range(0x2100, 0x2140):
        same = unicodedata.normalize("NFKC", chr(code))
        if len(same) == 1 and same.isascii() and same.isalpha():
            table[code] = same
    return table


_table = _compatible()
_table.update({c: " " for a, b in ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(a, b + 1)})
_table.update({ord(c): "-" for c in HYPHENS})
_table.update({ord("へ"): "ヘ", ord("べ"): "ベ", ord("ぺ"): "ペ"})
_change = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_table) if c < 0x10000) + "]")
#: Characters beyond the first plane have a range of their own: in one class with the others each would be tried in turn.
_styled = re.compile("[\U0001d400-\U0001d7ff]")
_invisible = re.compile(f"[{INVISIBLE}]")
_broken = re.compile("­(?=[ \t]*[\r\n])")
_rare = "԰-֏Ꭰ-Ᏽꓐ-꓿"
_other = re.compile(f"[ɡɑıͰ-ϿЀ-ԯ{_rare}]")
_token = re.compile(f"(?:[A-Za-zÀ-ɐɑɡͰ-ϿЀ-ԯ{_rare}][̀-ͯ]*)+")
_seldom = re.compile(f"[{_rare}]")
_only_latin = re.compile("[bfgklmnrtuzDFGLNRQUV]")
_only_cyrillic = re.compile("[бвгджзийклмнптфцчшщъыьэюяёБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ]")
_only_greek = re.compile("[βγδεζηθλμξπστφχψωαικυΓΔΘΛΞΠΣΦΨΩ]")


_ranges = (("C", "Ѐ", "ԯ"), ("G", "Ͱ", "Ͽ"), ("A", "԰", "֏"), ("K", "Ꭰ", "Ᏽ"), ("I", "ꓐ", "꓿"))


def _script(letter: str) -> str:
    return next((script for script, a, b in _ranges if a <= letter <= b), "C" if letter in CYRILLIC else "L")


def _scripts(letter: str) -> frozenset[str]:
    """Scripts that have a letter looking like this one."""
    latin = TO_LATIN.get(letter, letter)
    if latin.isascii():
        return frozenset(["L", *[script for script, table in OF_LATIN.items() if latin in table]])
    return frozenset(_script(letter))


_of: dict[str, frozenset[str]] = {}
_spelt: dict[tuple[str, str], str] = {}


def spelling(token: str, own: str) -> str:
    """The token in one script: its only one, else the text's own, else the first in the order of the scripts."""
    known = _spelt.get((token, own))
    if known is not None:
        return known
    possible = frozenset(LOOKS)
    for letter in token:
        if not "̀" <= letter <= "ͯ":
            scripts = _of.get(letter)
            if scripts is None:
                scripts = _of[letter] = _scripts(letter)
            possible &= scripts
    to = own if own in possible else next((s for s in LOOKS if s in possible), "")
    latin = "".join([TO_LATIN.get(c, c) for c in token])
    out = "".join([OF_LATIN[to].get(c, c) for c in latin]) if to in OF_LATIN else latin
    if len(_spelt) > 300_000:
        _spelt.clear()
    _spelt[token, own] = out
    return out


def consistent(text: str | None) -> str | None:
    """The one form of all texts that look like this one."""
    if text is None or text.isascii():
        return text
    if _invisible.search(text):
        text = _invisible.sub("", _broken.sub("-", text))
    if _change.search(text):
        text = _change.sub(lambda m: _table[ord(m[0])], text)
    if _styled.search(text):
        text = _styled.sub(lambda m: _table.get(ord(m[0]), m[0]), text)
    if _other.search(text):
        text = unicodedata.normalize("NFD", text)
        marks = [(len(p.findall(text)), k) for p, k in ((_only_greek, "G"), (_only_cyrillic, "C"), (_only_latin, "L"))]
        if _seldom.search(text):
            # Letters that no other script has speak for a seldom one.
            marks += [(sum(a <= c <= b and c not in LOOKS[script] for c in text), script) for script, a, b in _ranges[2:]]
        own = max(marks)[1]
        text = _token.sub(lambda m: spelling(m[0], own), text)
    return unicodedata.normalize("NFC", text)


def forms(texts: DataFrame, text: str = "text", to: str = "form") -> DataFrame:
    """``texts`` with the consistent form of a column."""

    import pandas as pd

    def run(batches):
        for series in batches:
            yield series.map(consistent, na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return texts.withColumn(to, F.pandas_udf(run, T.StringType())(F.col(text)))


def fingerprints(texts: DataFrame) -> DataFrame:
    """(src, uid, form, raw): 128-bit hashes of the consistent form and of the text, of texts with a visible character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, form, raw = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                own = consistent(text)
                if own and not own.isspace():
                    rows.append(k)
                    form.append(xxhash.xxh3_128_digest(own.encode("utf-8", "surrogatepass")))
                    raw.append(form[-1] if own is text else xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], names=["src", "uid", "form", "raw"])

    return texts.select("src", "uid", "text").mapInArrow(run, "src string, uid long, form binary, raw binary")


def pairs(texts: DataFrame) -> DataFrame:
    """Distinct (src, uid_a, uid_b), uid_a < uid_b, of texts of one src that look the same but differ.

    Copies are grouped first: variants are paired, then each variant brings its
    uids, so no two exact copies ever meet and the work is that of the result.
    """
    rows = written(fingerprints(texts).distinct(), "forms")
    variants = rows.select("src", "form", "raw").distinct()
    several = variants.groupBy("src", "form").agg(F.count("*").alias("n")).filter("n > 1").select("src", "form")
    held = rows.join(several, ["src", "form"], "left_semi")
    shapes = held.select("src", "form", "raw").distinct()
    both = shapes.withColumnRenamed("raw", "raw_a").join(shapes.withColumnRenamed("raw", "raw_b"), ["src", "form"]).filter("raw_a < raw_b")
    left = held.select("src", "form", F.col("raw").alias("raw_a"), F.col("uid").alias("u"))
    right = held.select("src", "form", F.col("raw").alias("raw_b"), F.col("uid").alias("v"))
    out = both.join(left, ["src", "form", "raw_a"]).join(right, ["src", "form", "raw_b"]).filter("u <> v")
    return out.select("src", F.least("u", "v").alias("uid_a"), F.greatest("u", "v").alias("uid_b")).distinct()


def groups(texts: DataFrame) -> DataFrame:
    """(src, uid, grp, variant): the class of each text that looks like a different one, and which of its spellings it has.

    The same links as the pairs, one row a text, whatever the number of copies; both numbers are hashes.
    """
    rows = written(fingerprints(texts).distinct(), "forms")
    variants = rows.select("src", "form", "raw").distinct().groupBy("src", "form").agg(F.count("*").alias("n")).filter("n > 1").select("src", "form")
    return rows.join(variants, ["src", "form"], "left_semi").select("src", "uid", F.lower(F.hex("form")).alias("grp"), F.lower(F.hex("raw")).alias("variant"))


def both(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """The texts of documents and segments as (src, uid, text)."""
    a = documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("uid"), "text")
    b = segments.select(F.lit("segments").alias("src"), F.col("seg_uid").alias("uid"), "text")
    return a.unionByName(b).filter(F.col("text").isNotNull())


def found(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs within documents and within segments."""
    return pairs(both(documents, segments))

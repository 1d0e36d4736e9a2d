"""Script assembly: cleanup, spoken forms, sentences, repaired splits and numbering of a whole script; tolerance of what was heard.

Every step is a function of rows; the order of steps is that of ``assembled``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.functions import numbers as M
from bookloom.functions import text as X
from bookloom.operators import narration as N
from bookloom.operators import windows as Wn
from bookloom.operators.ordered import with_running
from bookloom.session import written

#: Share of a window's characters that its rewrite has at least, and the most of a segment.
SHORTEST, LONGEST = 0.85, 900
#: Digits and number words that a tolerant comparison leaves out, in any case; letters and numbers of any script go on a word, marks do not.
BLINDED = r"(?iu)[0-9]+|(?<![\p{L}\p{N}_])(?:" + "|".join(N.NUMBER_WORDS) + r")(?![\p{L}\p{N}_])"


def map_labels(segments: DataFrame, words: DataFrame, short: int = 60) -> DataFrame:
    """(seg_uid) of short segments of which four tenths of the tokens or more are in no dictionary."""
    own = segments.filter(F.length(F.trim("text")) < short).select("seg_uid", F.explode_outer(F.transform(X.tokens(F.col("text")), F.lower)).alias("word"))
    known = own.join(words.withColumn("hit", F.lit(1)), "word", "left")
    share = known.groupBy("seg_uid").agg(F.count("word").alias("n"), F.count("hit").alias("hits"))
    return share.filter((F.col("n") == 0) | ((F.col("n") - F.col("hits")) * 10 >= F.col("n") * 4)).select("seg_uid")


def cleaned(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments without those that say nothing and labels of maps; headings of chapters stay."""
    kept = segments.filter(F.col("text").isNotNull() & ((F.col("type") == "chapter_heading") | ~N.content_free(F.col("text"))))
    labels = map_labels(kept.filter("type <> 'chapter_heading'"), words)
    return kept.join(labels, "seg_uid", "left_anti")


def numbered(segments: DataFrame, order: str = "seg_ord") -> DataFrame:
    """Segments with a new id by their place in the book, and their place within the paragraph; the count goes by chunks, not whole books."""
    held = with_running(segments, ["book_id"], order, F.lit(1), "_n")
    within = F.row_number().over(W.partitionBy("book_id", "para_id").orderBy(order)) - 1
    return held.withColumns({"new_id": F.format_string("seg_%04d", F.col("_n").cast("long") - 1), "sentence_index": within}).drop("_n")


def spoken(text: Column) -> Column:
    """A text with fractions, roman numerals and years as they are spoken, backslashes as spaces."""
    return F.trim(M.year_style(M.roman_words(M.spoken_fractions(F.replace(text, F.lit("\\"), F.lit(" "))))))


def assembled(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(book_id, chapter_id, para_id, ord, new_id, sentence_index, type, text): the script as it is narrated.

    Cleanup, repeated opening titles, spoken forms, sentences, wrongly split ones joined, long ones cut, numbers: in this order.
    """
    kept = cleaned(segments, words)
    kept = kept.join(N.opening_duplicates(kept), "seg_uid", "left_anti").withColumn("text", spoken(F.col("text")))
    each = N.sentences(kept, "seg_uid").join(kept.select("seg_uid", "book_id", "chapter_id", "para_id", "seg_ord", "type"), "seg_uid")
    placed = each.select("book_id", "chapter_id", "para_id", "type", "text", (F.col("seg_ord").cast("long") * 10_000 + F.col("sentence_index")).alias("seg_ord"))
    o = W.partitionBy("book_id", "chapter_id").orderBy("seg_ord")
    flagged = N.joins_next(placed).withColumn("_on", F.coalesce(F.lag("joins").over(o), F.lit(False)))
    held = flagged.withColumn("_island", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(o))
    rows = F.array_sort(F.collect_list(F.struct("seg_ord", "text", "type", "para_id")))
    joined = held.groupBy("book_id", "chapter_id", "_island").agg(rows.alias("r"))
    first = F.get("r", F.lit(0))
    whole = joined.select("book_id", "chapter_id", first["para_id"].alias("para_id"), first["seg_ord"].alias("_o"), first["type"].alias("type"), F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"))
    parts = F.when(F.col("type").isin(*N.PROSE), Wn.cut_long(F.col("text"), LONGEST)).otherwise(F.array("text"))
    cut = whole.select("book_id", "chapter_id", "para_id", "type", "_o", F.posexplode(parts).alias("_p", "text"))
    # Places of parts leave room between those of sentences.
    out = written(cut.withColumn("ord", F.col("_o") * 100 + F.col("_p")).drop("_o", "_p"), "script")
    return numbered(out, "ord").select("book_id", "chapter_id", "para_id", "ord", "new_id", "sentence_index", "type", "text")


def window_problems(source: Column, texts: Column) -> Column:
    """What is wrong with the rewrite of a window (an array of texts): digits that are left, too little text, segments that are too long."""
    joined = F.array_join(texts, " ")
    problems = F.array(
        F.when(joined.rlike("[0-9]"), F.lit("digits")),
        F.when(F.length(joined) < SHORTEST * F.length(source), F.lit("short")),
        F.when(F.exists(texts, lambda t: F.length(t) > LONGEST), F.lit("long")),
    )
    return F.filter(problems, lambda p: p.isNotNull())


def tolerance_tokens(text: Column) -> Column:
    """Words as a tolerant comparison sees them: no numbers, marks or "and", hyphens as spaces."""
    plain = F.replace(F.lower(F.regexp_replace(text, BLINDED, " ")), F.lit("-"), F.lit(" "))
    return F.filter(F.regexp_extract_all(F.regexp_replace(plain, "[’']", ""), F.lit("[a-z]+"), F.lit(0)), lambda w: w != "and")


def _only_terms(a: list[str], b: list[str], terms: set[str]) -> bool:
    """Whether two word lists differ only where the first has known terms, each put into at most twice as many words and one."""
    import difflib

    if a is None or b is None or not len(a) or not len(b):
        return False
    for kind, i, j, k, m in difflib.SequenceMatcher(None, list(a), list(b), autojunk=False).get_opcodes():
        if kind != "equal" and not (kind == "replace" and terms.issuperset(a[i:j]) and m - k <= 2 * (j - i) + 1):
            return False
    return True


@F.pandas_udf(T.BooleanType())
def _tolerated(a: pd.Series, b: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([_only_terms(x, y, set(t) if t is not None else set()) for x, y, t in zip(a, b, terms)])


def tolerable(pairs: DataFrame, source: str, heard: str, terms: str) -> DataFrame:
    """``pairs`` with ``tolerable``: whether what was heard differs from its source only in known terms (an array column). Equal ones never leave the JVM; a null text is not tolerable."""
    own = pairs.withColumns({"_a": tolerance_tokens(F.col(source)), "_b": tolerance_tokens(F.col(heard))})
    # A Python function cannot take what higher-order functions make in the same step, so the words are written first.
    own = written(own, "tokens")
    same = own.filter(F.col("_a") == F.col("_b")).withColumn("tolerable", F.lit(True))
    rest = own.filter(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).withColumn("tolerable", _tolerated("_a", "_b", terms))
    return same.unionByName(rest).drop("_a", "_b")


def terms_line(terms: Column, head: str = "KNOWN NAMES AND TERMS: ") -> Column:
    """The terms of a book (an array) as one line, empty without any."""
    return F.when(F.size(terms) > 0, F.concat(F.lit(head), F.array_join(terms, ", "))).otherwise(F.lit(""))


def escaped(text: Column) -> Column:
    """A value for a file of metadata: its special signs and line ends behind a backslash."""
    return F.regexp_replace(text, r"([=;#\\\n])", r"\\$1")


def safe_name(title: Column, fallback: Column, most: int = 60) -> Column:
    """A file name of letters, digits, dashes and underscores, at most so long; the fallback where nothing is left."""
    kept = F.trim(F.regexp_replace(title, r"[^\p{L}\p{N} -]", ""))
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(kept, " +", "_"), 1, most), F.lit("")), fallback)


@F.pandas_udf(T.StringType())
def take_hash(engine: pd.Series, params: pd.Series, text: pd.Series) -> pd.Series:
    """24 hexadecimal digits over a take's engine, parameters and text as JSON with its keys in order, as stored caches have it."""
    import hashlib
    import json

    rows = ({"engine": e, "params": dict(p) if p is not None else {}, "text": t} for e, p, t in zip(engine, params, text))
    return pd.Series([hashlib.sha256(json.dumps(row, sort_keys=True).encode()).hexdigest()[:24] for row in rows])


def take_path(root: str, key: Column) -> Column:
    """The file of a take in a cache."""
    return F.concat(F.lit(root.rstrip("/") + "/"), key, F.lit(".wav"))

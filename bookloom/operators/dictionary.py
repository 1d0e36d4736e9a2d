"""The dictionary and the share of dictionary words of a text.

A token is a word if the dictionary has it, or has what is left of it without
one of six endings, with an e put back, a doubled letter undone or an i turned
into y. The rule is turned round: every accepted token is derived from the
dictionary's words once, so texts meet one table by equality. That table has at
most 25 rows for each word of the dictionary, whose size is checked before it
is broadcast; a larger one is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions import text as X

#: Accepted tokens up to which they are broadcast, and how many a word has at most.
SMALL, FORMS = 1_000_000, 25
# The endings that inflected words may have.
ENDINGS = ("s", "es", "ed", "d", "ing", "ly")


def dictionary(lexicon: DataFrame, lang: str | None = "en") -> DataFrame:
    """Distinct trimmed lower-case words (word) of a lexicon."""
    own = lexicon.filter(F.col("lang") == lang) if lang else lexicon
    return own.select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct()


def accepted(words: DataFrame) -> DataFrame:
    """Distinct tokens (token) that count as words of a dictionary (word)."""
    w, n = F.col("word"), F.length("word")
    last, head = F.substring("word", -1, 1), F.substr("word", F.lit(1), F.length("word") - 1)
    stems = F.array(
        F.when(n >= 2, w),
        F.when((last == "e") & (n >= 3), head),
        F.when(n >= 2, F.concat(w, last)),
        F.when((last == "y") & (n >= 2), F.concat(head, F.lit("i"))),
    )
    inflected = F.flatten(F.transform(F.filter(stems, lambda s: s.isNotNull()), lambda s: F.array(*[F.concat(s, F.lit(e)) for e in ENDINGS])))
    return words.select(F.explode(F.concat(F.array(w), inflected)).alias("token")).distinct()


def known_tokens(words: DataFrame) -> DataFrame:
    """The accepted tokens, marked for broadcast if the dictionary is small enough."""
    table = accepted(words)
    return F.broadcast(table) if words.limit(SMALL // FORMS + 1).count() <= SMALL // FORMS else table


def word_ratio(texts: DataFrame, words: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, tokens, dict_word_ratio): the share of a text's tokens that are words, 1 for texts without tokens."""
    each = texts.select(key, F.explode_outer(F.transform(X.tokens(F.col(text)), F.lower)).alias("token"))
    known = known_tokens(words).withColumn("hit", F.lit(1))
    joined = each.join(known, "token", "left")
    return joined.groupBy(key).agg(F.count("token").alias("tokens"), F.round(F.try_divide(F.count("hit"), F.count("token")), 6).alias("r")).select(key, "tokens", F.coalesce("r", F.lit(1.0)).alias("dict_word_ratio"))


def prose_word_ratio(texts: DataFrame, words: DataFrame, key: str, text: str = "text", least: int = 3) -> DataFrame:
    """(key, prose_ratio): as word_ratio, but unknown capitalised tokens are names and left out if at least ``least`` tokens remain."""
    each = texts.select(key, F.explode_outer(X.tokens(F.col(text))).alias("raw")).withColumn("token", F.lower("raw"))
    joined = each.join(known_tokens(words).withColumn("hit", F.lit(1)), "token", "left")
    name = F.col("hit").isNull() & F.col("raw").rlike("^[A-Z][a-z]*$")
    sums = joined.groupBy(key).agg(F.count("raw").alias("n"), F.count("hit").alias("hits"), F.count(F.when(~name & F.col("raw").isNotNull(), 1)).alias("prose"))
    ratio = F.when(F.col("n") == 0, F.lit(1.0)).when(F.col("prose") < least, F.col("hits") / F.col("n")).otherwise(F.col("hits") / F.col("prose"))
    return sums.select(key, F.round(ratio, 6).alias("prose_ratio"))


def joined_break(left: Column, right: Column, fused_known: Column, left_known: Column, right_known: Column) -> Column:
    """A word broken at a line end as it should read: its hyphen stays only if both halves are words and their fusion is none."""
    keep = ~fused_known & left_known & right_known & (F.length(left) >= 4)
    return F.when(keep, F.concat(left, F.lit("-"), right)).otherwise(F.concat(left, right))

"""Queries of the training-data problems; the entry module adds them if this subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm import bpe, lookalike, packing, quality, repeated_lines, repetition, scan_noise, sentences, splitting, subjects
from bookloom.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.found(table(spark, sf, "segments"), table(spark, sf, "lexicon"))


def p1_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_rows(table(spark, sf, "segments"), table(spark, sf, "lexicon"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.found(table(spark, sf, "documents"), table(spark, sf, "pages"), table(spark, sf, "segments"), table(spark, sf, "lexicon"))


def p2_stats(spark: SparkSession, sf: str) -> DataFrame:
    names = (("documents", "doc_id"), ("pages", "page_uid"), ("segments", "seg_uid"))
    parts = [table(spark, sf, t).select(F.lit(t).alias("src"), F.col(uid).alias("uid"), "text") for t, uid in names]
    return quality.text_statistics(parts[0].unionByName(parts[1]).unionByName(parts[2]), table(spark, sf, "lexicon"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.found(table(spark, sf, "documents"), table(spark, sf, "segments"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.groups(lookalike.both(table(spark, sf, "documents"), table(spark, sf, "segments")))


def p3_forms(spark: SparkSession, sf: str) -> DataFrame:
    names = (("documents", "doc_id"), ("segments", "seg_uid"))
    parts = [table(spark, sf, t).select(F.lit(t).alias("src"), F.col(uid).alias("uid"), "text").dropDuplicates(["uid"]) for t, uid in names]
    return lookalike.forms(parts[0].unionByName(parts[1])).select("src", "uid", "form")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized(table(spark, sf, "chapters"), table(spark, sf, "segments"), table(spark, sf, "length_limits"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_rows(table(spark, sf, "chapters"), table(spark, sf, "segments"), table(spark, sf, "length_limits"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.found(table(spark, sf, "documents"), table(spark, sf, "blocks"), table(spark, sf, "pages"))


def p5_blocks(spark: SparkSession, sf: str) -> DataFrame:
    found = repeated_lines.repeated_blocks(table(spark, sf, "documents"), table(spark, sf, "blocks"), table(spark, sf, "pages"))
    return found.select("src", "grp", F.array_join("block", "\n").alias("block"), "n_lines", "n_docs")


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.cleaned(table(spark, sf, "documents"), table(spark, sf, "blocks"), table(spark, sf, "pages"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.found(table(spark, sf, "take_review"), table(spark, sf, "subject_examples"))


def p6_scores(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.scored(table(spark, sf, "take_review"), table(spark, sf, "subject_examples")).distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.found(table(spark, sf, "documents"), table(spark, sf, "chapters"))


def p7_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.repaired_texts(table(spark, sf, "documents"), table(spark, sf, "chapters"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf, "documents"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers(bpe.token_counts(table(spark, sf, "documents")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    names = ("documents", "subject_examples", "lexicon", "subject_areas")
    return subjects.found(*(table(spark, sf, name) for name in names))


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    return p10_found(spark, sf).groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_sentences, p2_found, p2_stats, p3_found, p3_groups, p3_forms, p4_found, p4_pieces, p5_found, p5_blocks, p5_clean, p6_found, p6_scores, p7_found, p7_repaired, p8_ids, p9_containers, p10_found, p10_composition)}

ORACLE: dict[str, str] = {
    "p4_found": """
        SELECT DISTINCT 'chapters' AS src, c.chapter_uid AS uid
        FROM chapters c JOIN length_limits l ON l.item = 'chapter' AND length(c.text) > l.max_chars
        UNION ALL
        SELECT DISTINCT 'segments' AS src, s.seg_uid AS uid
        FROM segments s JOIN length_limits l ON l.item = 'segment' AND l.type = s.type AND length(s.text) > l.max_chars
    """,
}

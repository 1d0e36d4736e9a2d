"""The quality matrix: checks that return violations, results per book and check, regressions, pass^k, the review queue.

A check is a function of the tables that returns violations (doc_id, unit_id,
message); the registry adds its stage, dimension and whether a retry can fix
it. One query runs a check over all books, and the matrix is a union of these
queries, so a new book costs rows, not jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.functions import text as X
from bookloom.operators import align, chapters, dictionary, narration, structural, timeline
from bookloom.session import written

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Check:
    """A registered check."""

    stage: int
    dimension: str
    fixable: bool
    run: Callable[[Tables], DataFrame]


CHECKS: dict[str, Check] = {}


def check(stage: int, dimension: str, fixable: bool = False):
    """Registers a check under its dimension."""

    def put(f):
        CHECKS[dimension] = Check(stage, dimension, fixable, f)
        return f

    return put


def _rows(df: DataFrame, doc: str, unit, message: str) -> DataFrame:
    return df.select(F.col(doc).alias("doc_id"), F.col(unit).cast("string").alias("unit_id") if isinstance(unit, str) else unit.cast("string").alias("unit_id"), F.lit(message).alias("message"))


class Once:
    """Tables whose rows without copies are written once and read by all checks."""

    def __init__(self, tables: Tables):
        self.tables, self.held = tables, {}

    def __call__(self, name: str) -> DataFrame:
        return self.tables(name)

    def distinct(self, name: str, key: str) -> DataFrame:
        if name not in self.held:
            self.held[name] = written(self.tables(name).dropDuplicates([key]), name)
        return self.held[name]


def _distinct(t: Tables, name: str, key: str) -> DataFrame:
    return t.distinct(name, key) if isinstance(t, Once) else t(name).dropDuplicates([key])


def _chapters(t: Tables) -> DataFrame:
    return _distinct(t, "chapters", "chapter_uid").filter("text is not null and not coalesce(front_matter, false)")


def _segments(t: Tables) -> DataFrame:
    return _distinct(t, "segments", "seg_uid")


@check(1, "extract_schema_valid")
def extract_schema_valid(t: Tables) -> DataFrame:
    bad = t("pages").filter("book_id is null or number is null or number < 0 or chars is null or chars < 0")
    return _rows(bad, "book_id", "page_uid", "page without number or size")


@check(1, "ocr_gate_flags")
def ocr_gate_flags(t: Tables) -> DataFrame:
    bad = t("pages").dropDuplicates(["page_uid"]).filter((F.col("chars") > 200) & (F.col("garbage_density") > 0.02))
    return _rows(bad, "book_id", "page_uid", "page with many unreadable signs")


@check(2, "no_page_numbers")
def no_page_numbers(t: Tables) -> DataFrame:
    lines = _chapters(t).select("book_id", "chapter_uid", F.explode(X.lines(F.col("text"))).alias("l"))
    return _rows(lines.filter(F.col("l.line").rlike("^(?:[0-9]{1,4}|[ivxlc]{1,7})$")), "book_id", "chapter_uid", "page number in the text")


@check(2, "no_running_headers")
def no_running_headers(t: Tables) -> DataFrame:
    blocks = structural.blocks_of(t("blocks"), t("pages"))
    heads = structural.templates(blocks).filter("zone = 'header'").select("book_id", "t").distinct()
    lines = _chapters(t).select("book_id", "chapter_uid", F.explode(X.lines(F.col("text"))).alias("l")).select("book_id", "chapter_uid", X.template(F.col("l.line")).alias("t"))
    hits = lines.join(heads, ["book_id", "t"]).groupBy("book_id", "t").agg(F.count("*").alias("n")).filter("n >= 3")
    return _rows(hits, "book_id", "t", "running head in the text")


@check(2, "punctuation_spacing")
def punctuation_spacing(t: Tables) -> DataFrame:
    bad = _chapters(t).filter((F.length("text") >= 5000) & (F.regexp_count("text", F.lit("[a-z][.!?][A-Z]")) * 1000.0 / F.length("text") > 0.3))
    return _rows(bad, "book_id", "chapter_uid", "marks without a space")


@check(2, "dehyphenation")
def dehyphenation(t: Tables) -> DataFrame:
    return _rows(_chapters(t).filter(F.col("text").rlike("[a-z][-‐]\\n[a-z]")), "book_id", "chapter_uid", "word broken at a line end")


@check(2, "paragraph_reflow")
def paragraph_reflow(t: Tables) -> DataFrame:
    long = F.filter(F.split("text", "\n\n"), lambda p: F.length(p) > 200)
    open_ended = F.filter(long, lambda p: ~F.trim(p).rlike('[.!?:;"”’)»。！？।؟]$'))
    sums = _chapters(t).groupBy("book_id").agg(F.sum(F.size(long)).alias("n"), F.sum(F.size(open_ended)).alias("k"))
    return _rows(sums.filter("n > 0 and k > 0.05 * n"), "book_id", "book_id", "paragraphs that break off")


@check(3, "no_toc_leakage")
def no_toc_leakage(t: Tables) -> DataFrame:
    leaders = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(chapters.LEADER)))
    return _rows(_chapters(t).filter(leaders >= 3), "book_id", "chapter_uid", "lines of a table of contents")


@check(3, "front_matter_excluded")
def front_matter_excluded(t: Tables) -> DataFrame:
    return _rows(_chapters(t).filter(chapters.says_front(F.substring("text", 1, 3000))), "book_id", "chapter_uid", "front matter in a chapter")


@check(3, "body_chapter_quality")
def body_chapter_quality(t: Tables) -> DataFrame:
    own = _chapters(t).select("book_id", "chapter_uid", "text")
    ratio = dictionary.word_ratio(own, dictionary.dictionary(t("lexicon")), "chapter_uid")
    bar = F.when(F.length("text") < 1500, 0.55).otherwise(0.75)
    return _rows(own.join(ratio, "chapter_uid").filter(F.col("dict_word_ratio") < bar), "book_id", "chapter_uid", "few dictionary words")


@check(3, "chapter_text_coverage")
def chapter_text_coverage(t: Tables) -> DataFrame:
    n = F.sum(F.coalesce(F.length("text"), F.lit(0)))
    held = t("chapters").dropDuplicates(["chapter_uid"]).groupBy("book_id").agg(n.alias("held"))
    body = t("pages").dropDuplicates(["page_uid"]).groupBy("book_id").agg(n.alias("body"))
    return _rows(body.join(held, "book_id", "left").filter("coalesce(held, 0) < 0.97 * body"), "book_id", "book_id", "text of pages is in no chapter")


@check(4, "narration_schema_valid")
def narration_schema_valid(t: Tables) -> DataFrame:
    kinds = ("chapter_heading", "section_heading", "paragraph", "blockquote")
    good = F.col("id").rlike("^seg_[0-9]{4,}$") & (F.coalesce("text", F.lit("")) != "") & F.col("type").isin(*kinds)
    return _rows(_segments(t).filter(~F.coalesce(good, F.lit(False))), "book_id", "seg_uid", "segment without id, text or type")


@check(4, "no_surviving_digits", fixable=True)
def no_surviving_digits(t: Tables) -> DataFrame:
    return _rows(_segments(t).filter(F.col("text").rlike("[0-9¼½¾⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞]")), "book_id", "seg_uid", "digits in the narration")


@check(4, "no_bare_roman_numerals", fixable=True)
def no_bare_roman_numerals(t: Tables) -> DataFrame:
    return _rows(_segments(t).filter(F.col("text").rlike(narration.BARE_ROMAN)), "book_id", "chapter_id", "bare roman numeral")


@check(4, "segment_length_limits", fixable=True)
def segment_length_limits(t: Tables) -> DataFrame:
    own = _segments(t)
    bad = narration.length_violations(own, t("length_limits")).join(own.select("seg_uid", "book_id"), "seg_uid")
    return _rows(bad, "book_id", "seg_uid", "segment too short or too long")


@check(5, "take_review", fixable=True)
def take_review(t: Tables) -> DataFrame:
    heard = t("take_review").dropDuplicates(["review_id"]).filter("transcript is not null").select("review_id", "book_id", "segment_id", "transcript")
    pairs = heard.join(_segments(t).select("book_id", F.col("id").alias("segment_id"), "text"), ["book_id", "segment_id"])
    return _rows(pairs.filter(align.word_error_rate(F.col("text"), F.col("transcript")) > 0.25), "book_id", "segment_id", "a take says something else")


@check(5, "sec_per_char_outlier", fixable=True)
def sec_per_char_outlier(t: Tables) -> DataFrame:
    return _rows(timeline.duration_outliers(t("takes")).filter("outlier"), "book_id", "segment_id", "take too long or short for its text")


@check(5, "cache_integrity", fixable=True)
def cache_integrity(t: Tables) -> DataFrame:
    split = t("takes").groupBy("book_id", "hash").agg(F.count_distinct("engine", F.coalesce("chars", F.lit(-1))).alias("n")).filter("n > 1")
    return _rows(split, "book_id", "hash", "one key holds different takes")


@check(6, "silence_gaps_vs_policy")
def silence_gaps(t: Tables) -> DataFrame:
    from bookloom.operators.ordered import with_previous

    held = with_previous(timeline.timeline(_segments(t), t("takes")), ["book_id"], "seg_ord", ["start_s", "duration_s"])
    gap = F.col("start_s") - F.col("prev.start_s") - F.col("prev.duration_s")
    return _rows(held.filter(F.abs(gap - F.col("silence_before_s")) > 0.003), "book_id", "segment_id", "a gap differs from the policy")


@check(6, "words_per_minute")
def words_per_minute(t: Tables) -> DataFrame:
    return _rows(timeline.words_per_minute(_segments(t), t("takes")).filter("wpm is null or wpm not between 130 and 178"), "book_id", "book_id", "spoken too fast or slow")


@check(2, "no_footnotes_inline")
def no_footnotes_inline(t: Tables) -> DataFrame:
    notes = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*[0-9]{1,3}\.\s+[A-Z][^.]*, [0-9]{1,4}")))
    markers = F.regexp_count("text", F.lit(r"[a-z][.,;][0-9]{1,3}\s"))
    return _rows(_chapters(t).filter((notes >= 5) | (markers >= 8)), "book_id", "chapter_uid", "footnotes in the text")


@check(4, "segment_text_quality", fixable=True)
def segment_text_quality(t: Tables) -> DataFrame:
    own = _segments(t).filter(F.col("type").isin(*narration.PROSE) & (F.length("text") >= 40))
    blind = own.select("seg_uid", narration.numeric_blind(F.col("text")).alias("text"))
    poor = dictionary.prose_word_ratio(blind, dictionary.dictionary(t("lexicon")), "seg_uid").filter("prose_ratio < 0.55")
    return _rows(poor.join(own.select("seg_uid", "book_id"), "seg_uid"), "book_id", "seg_uid", "few dictionary words")


@check(4, "number_style", fixable=True)
def number_style(t: Tables) -> DataFrame:
    return _rows(_segments(t).filter(F.col("text").rlike(narration.ERA_CENTURY)), "book_id", "seg_uid", "a year is spelled out like a quantity")


@check(4, "faithfulness", fixable=True)
def faithfulness(t: Tables) -> DataFrame:
    """Source sentences of more than eight words that no sentence of their chapter's narration contains, numbers aside."""

    def sentences(rows: DataFrame, uid: str) -> DataFrame:
        each = rows.select("book_id", "chapter_id", uid, F.posexplode(X.aligned_sentences(F.col("text"))).alias("place", "text"))
        # Sentences of one text have their places in the low bits.
        return each.select("book_id", "chapter_id", (F.shiftleft(F.col(uid).cast("long"), 24) + F.col("place")).alias("id"), narration.numeric_blind(F.col("text")).alias("text"), F.size(X.words(F.col("text"))).alias("n"))

    source = sentences(_chapters(t).withColumn("chapter_id", F.col("id")), "chapter_uid").filter("n > 8").drop("n")
    spoken = _segments(t).filter(F.col("text").isNotNull() & F.col("type").isin("paragraph", "blockquote", "section_heading"))
    gone = align.aligned(source, sentences(spoken, "seg_uid").drop("n")).filter("verdict = 'dropped'")
    return _rows(gone, "book_id", "chapter_id", "a sentence is not in the narration")


@check(5, "speaker_similarity", fixable=True)
def speaker_similarity(t: Tables) -> DataFrame:
    found = timeline.speaker_similarity(t("embeddings")).filter("similarity < 0.6")
    return found.select(F.col("label").cast("string").alias("doc_id"), F.col("vec_id").cast("string").alias("unit_id"), F.lit("another voice").alias("message"))


@check(6, "chapter_markers")
def chapter_markers(t: Tables) -> DataFrame:
    own = timeline.markers(timeline.timeline(_segments(t), t("takes")), t("chapters").dropDuplicates(["chapter_uid"]))
    return _rows(own.filter("end_ms <= start_ms"), "book_id", "id", "a marker without length")


#: Texts of a document that are searched at once, and strings that are looked for at once; up to so many are looked for one by one.
TEXTS, STRINGS, FEW = 256, 20_000, 24
#: Characters of the longest gram by which strings are met.
LONGEST = 64


def held_parts(bodies: list[str], parts: list[str]) -> list[str]:
    """The distinct parts that some body contains; none of them has a line break.

    Parts are met by the hashes of their first and last grams, as wide as a power of two allows, so the bodies are passed
    over once for each width and not for each part.
    """
    import numpy as np

    joined, parts = "\n".join(bodies), list(dict.fromkeys(parts))
    if len(parts) <= FEW:
        return [x for x in parts if x in joined]

    def letters(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)

    found = [""] if "" in parts else []
    groups: dict[int, dict[int, list[str]]] = {}
    for x in filter(None, parts):
        groups.setdefault(min(LONGEST, 1 << len(x).bit_length() - 1), {}).setdefault(len(x), []).append(x)
    own, all_letters = letters(joined), letters("".join(x for x in parts))
    starts = dict(zip(parts, np.cumsum([0, *(len(x) for x in parts)]).tolist()))
    width, base = 1, 0x9E3779B97F4A7C15
    mixed = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    while groups and len(own):
        by_length = groups.pop(width, {})
        if by_length:
            ours, theirs = mixed(own), mixed(all_letters)
            known = np.zeros(1 << 16, dtype=bool)
            known[theirs[[starts[x] for xs in by_length.values() for x in xs]] >> np.uint64(48)] = True
            at = np.flatnonzero(known[ours >> np.uint64(48)])
            for size, xs in by_length.items():
                last = size - width
                here = at[at + last < len(ours)]
                of = np.array([starts[x] for x in xs])
                keys = theirs[of] * np.uint64(3) + theirs[of + last]
                order = np.argsort(keys)
                met = ours[here] * np.uint64(3) + ours[here + last]
                place = np.minimum(np.searchsorted(keys[order], met), len(xs) - 1)
                hit = np.flatnonzero(keys[order][place] == met)
                _, first = np.unique(met[hit], return_index=True)
                for k in hit[first].tolist():
                    start, x = int(here[k]), xs[order[place[k]]]
                    # Hashes that met by chance leave the part to a plain search.
                    if joined[start : start + size] == x or x in joined:
                        found.append(x)
        if not groups or len(own) <= width:
            break
        own = own[:-width] * np.uint64(base) + own[width:]
        # What runs over the end of a part is not read.
        all_letters = all_letters[:-width] * np.uint64(base) + all_letters[width:] if len(all_letters) > width else all_letters[:0]
        width, base = 2 * width, base * base % 2**64
    return found


def _held(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, part): the parts (doc_id, part) that a text (doc_id, body) of their document contains."""
    import pyarrow as pa

    def listed(rows: DataFrame, name: str, most: int) -> DataFrame:
        at = F.floor((F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64(name))) - 1) / most)
        return rows.filter(F.col(name).isNotNull()).withColumn(f"{name}_chunk", at).groupBy("doc_id", f"{name}_chunk").agg(F.collect_list(name).alias(name))

    def run(batches):
        for batch in batches:
            hits = [held_parts(batch.column(1)[k].as_py(), batch.column(2)[k].as_py()) for k in range(batch.num_rows)]
            at = pa.array([k for k, x in enumerate(hits) for _ in x], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x for own in hits for x in own], pa.string())], ["doc_id", "part"])

    both = listed(texts, "body", TEXTS).join(listed(parts.distinct(), "part", STRINGS), "doc_id")
    # The chunks of a large document are spread.
    spread = both.repartition("doc_id", "body_chunk", "part_chunk").select("doc_id", "body", "part")
    return spread.mapInArrow(run, f"doc_id {parts.schema['doc_id'].dataType.simpleString()}, part string").distinct()


def seeded(texts: DataFrame, assertions: DataFrame) -> DataFrame:
    """(doc_id, id, polarity, hit): whether each seeded string is in its document.

    ``texts`` is (doc_id, text), ``assertions`` (doc_id, polarity, id, text, match) with match substring, line or regex.
    Assertions meet only the texts of their document; those without a text are left out. Substrings are looked for many at
    once and lines meet equal lines; only a regex is held against every text.
    """
    kind = F.coalesce("match", F.lit("substring"))
    asked = assertions.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "id", "polarity", "text", F.when(kind.isin("regex", "line"), kind).otherwise("substring").alias("match"))
    parts = asked.filter("match = 'substring'").withColumn("part", X.normalized(F.col("text"), True))
    held = _held(texts.select("doc_id", X.normalized(F.col("text"), True).alias("body")), parts.select("doc_id", "part").filter("part is not null"))
    hits = parts.join(held, ["doc_id", "part"], "left_semi")
    lines = texts.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: X.normalized(x, True)))).alias("part")).distinct()
    equal = asked.filter("match = 'line'").withColumn("part", X.normalized(F.col("text"), True)).join(lines, ["doc_id", "part"], "left_semi")
    matched = asked.filter("match = 'regex'").join(texts.withColumnRenamed("text", "body"), "doc_id").filter(F.expr("body rlike concat('(?im)', text)"))
    key = ["doc_id", "id", "polarity"]
    all_rows = asked.select(*key, F.lit(False).alias("hit"))
    for one in (hits, equal, matched):
        all_rows = all_rows.unionByName(one.select(*key, F.lit(True).alias("hit")))
    return all_rows.groupBy(*key).agg(F.bool_or("hit").alias("hit"))


def seeded_violations(texts: DataFrame, assertions: DataFrame) -> DataFrame:
    """(doc_id, unit_id, message) of strings that must not be there and are, or must be and are not."""
    found = seeded(texts, assertions).filter((F.col("polarity") == "must_not_contain") == F.col("hit"))
    return found.select("doc_id", F.col("id").alias("unit_id"), F.when(F.col("hit"), "forbidden string").otherwise("missing string").alias("message"))


#: Characters in a gram of narrated text, and grams in a window of which the least hash is kept; segments in a chunk.
GRAM, WINDOW, PLACES = 16, 16, 200


def gram_keys(text: str) -> list[int]:
    """The least gram hash of every window of a text, once each; none for texts shorter than a window and its grams.

    Windows of a part are windows of the whole, so the keys of a text are among those of every text that contains it.
    """
    import numpy as np

    own = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(own) < GRAM + WINDOW - 1:
        return []
    width, base = 1, 0x9E3779B97F4A7C15
    while width < GRAM:  # widths double, so both constants are powers of two
        own = own[:-width] * np.uint64(base) + own[width:]
        width, base = 2 * width, base * base % 2**64
    own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    width = 1
    while width < WINDOW:
        own = np.minimum(own[:-width], own[width:])
        width *= 2
    return np.unique(own).view(np.int64).tolist()


def _keyed(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with the gram keys of a column of strings."""
    import pandas as pd

    def run(batches):
        for series in batches:
            yield series.map(gram_keys)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return texts.withColumn("keys", F.pandas_udf(run, T.ArrayType(T.LongType()))(F.col(text)))


def narrated_chunks(narrated: DataFrame, order: str | None, head: int) -> DataFrame:
    """(doc_id, chunk, body): the normalized narration of each document, its texts joined in order by spaces, in chunks that overlap.

    A chunk goes on with the first ``head`` - 1 characters of what comes after it, so every part of up to ``head``
    characters lies whole in some chunk. Only the heads of chunks are ordered over a whole document. Without an order
    each text is a chunk of its own.
    """
    own = narrated.select("doc_id", *([F.coalesce(F.col(order).cast("long"), F.lit(-1)).alias("place")] if order else []), X.normalized(F.col("text"), True).alias("body")).filter("body <> ''")
    if order is None:
        return own.distinct().select("doc_id", F.sha2("body", 256).alias("chunk"), "body")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]), " ")
    chunks = own.groupBy("doc_id", F.floor(F.col("place") / PLACES).alias("chunk")).agg(joined.alias("body"))
    # A chunk and its space are two characters at least, so half of ``head`` chunks are enough.
    after = W.partitionBy("doc_id").orderBy("chunk").rowsBetween(1, max(1, head // 2))
    heads = chunks.select("doc_id", "chunk", F.substring("body", 1, head).alias("start"))
    tails = heads.select("doc_id", "chunk", F.array_join(F.collect_list("start").over(after), " ").substr(1, head - 1).alias("tail"))
    return chunks.join(tails, ["doc_id", "chunk"]).select("doc_id", F.col("chunk").cast("string").alias("chunk"), F.when(F.col("tail") == "", F.col("body")).otherwise(F.concat_ws(" ", "body", "tail")).alias("body"))


def removed_text_absent(removed: DataFrame, narrated: DataFrame, least: int = 60, head: int = 120, order: str | None = None) -> DataFrame:
    """(doc_id, unit_id, message) of removed blocks of some length that are narrated all the same.

    A block's probe, its first ``head`` characters, is looked for in the narration of its document: the texts of
    ``narrated`` joined by the column ``order``, or each text alone without one. Probes of any script meet the chunks
    that hold one of their gram keys, which no chunk that contains the probe can lack; probes too short for a key meet
    every chunk of their document. Copies of a probe are looked for once.
    """
    chunks = written(narrated_chunks(narrated, order, head), "narration")
    gone = removed.filter(F.length("text") >= least).select("doc_id", "unit_id", F.substring(X.normalized(F.col("text"), True), 1, head).alias("part")).filter("part <> ''")
    probes = _keyed(gone.select("doc_id", "part").distinct(), "part").select("doc_id", "part", F.coalesce(F.get("keys", F.lit(0)), F.lit(0)).alias("key"))
    said = _keyed(chunks, "body").select("doc_id", "chunk", F.explode(F.array_distinct(F.concat(F.col("keys"), F.array(F.lit(0).cast("long"))))).alias("key"))
    met = probes.join(said, ["doc_id", "key"]).select("doc_id", "chunk", "part")
    held = met.join(chunks, ["doc_id", "chunk"]).filter("contains(body, part)").select("doc_id", "part").distinct()
    return gone.join(held, ["doc_id", "part"]).select("doc_id", "unit_id", F.lit("removed text is narrated").alias("message")).distinct()


def count_matches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, unit_id, message) of documents whose number of chapters is not the expected one; both are (doc_id, n)."""
    held = expected.withColumnRenamed("n", "want").join(found, "doc_id", "left").filter("coalesce(n, 0) <> want")
    return held.select("doc_id", F.col("doc_id").alias("unit_id"), F.lit("another number of chapters").alias("message"))


def audio_valid(stats: DataFrame) -> DataFrame:
    """(segment_id, reason) of takes that are missing, empty, silent, clipped or end hot, from their measured figures."""
    reason = (
        F.when(~F.col("exists"), "missing")
        .when(F.col("sample_rate") != 24000, "rate")
        .when(F.col("duration_s") <= 0.05, "empty")
        .when(F.col("peak") < 1e-4, "silent")
        .when(F.col("peak") > 0.999, "clipped")
        .when(F.col("tail_rms") > 0.35 * F.col("body_rms"), "hot_end")
    )
    return stats.select("segment_id", reason.alias("reason")).filter("reason is not null")


def loudness(measured: DataFrame, target: float = -18.0, within: float = 1.5, peak: float = -3.0) -> DataFrame:
    """(book_id, reason) of programmes off the target loudness or above the peak."""
    reason = F.when(F.abs(F.col("lufs") - target) > within, "loudness").when(F.col("peak_db") > peak, "peak")
    return measured.select("book_id", reason.alias("reason")).filter("reason is not null")


def level_spread(levels: DataFrame, most: float = 6.0, least: int = 4) -> DataFrame:
    """(book_id, spread) of books whose sampled takes differ by more than ``most`` decibels."""
    own = levels.groupBy("book_id").agg((F.max("level_db") - F.min("level_db")).alias("spread"), F.count("*").alias("n"))
    return own.filter((F.col("n") >= least) & (F.col("spread") > most)).select("book_id", "spread")


def container_markers(planned: DataFrame, container: DataFrame, within_ms: int = 200) -> DataFrame:
    """(book_id, place, reason): markers of a container, side by side with the planned ones; both are (book_id, place, title, start_ms)."""
    held = planned.select("book_id", "place", F.col("title").alias("t"), F.when(F.col("place") == 0, 0).otherwise(F.col("start_ms")).alias("s")).join(container.select("book_id", "place", "title", "start_ms"), ["book_id", "place"], "full_outer")
    reason = F.when(F.col("t").isNull() | F.col("title").isNull(), "count").when(F.col("t") != F.col("title"), "title").when(F.abs(F.col("s") - F.col("start_ms")) > within_ms, "time")
    return held.select("book_id", "place", reason.alias("reason")).filter("reason is not null")


def violations(tables: Tables, dimensions: list[str] | None = None) -> DataFrame:
    """(doc_id, stage, dimension, unit_id, message, fixable) of the checks named, or of all."""
    out = None
    for name in dimensions or list(CHECKS):
        own = CHECKS[name]
        part = own.run(tables).select("doc_id", F.lit(own.stage).alias("stage"), F.lit(name).alias("dimension"), "unit_id", "message", F.lit(own.fixable).alias("fixable"))
        out = part if out is None else out.unionByName(part)
    return out


def violation_counts(tables: Tables, dimensions: list[str] | None = None) -> DataFrame:
    """(stage, dimension, doc_id, n): the violations of each book, of the checks named or of all.

    Checks run one by one and leave their counts in a table, so no plan is larger than that of one check.
    """
    once, out = Once(tables), None
    for name in dimensions or list(CHECKS):
        own = CHECKS[name]
        counts = own.run(once).groupBy("doc_id").agg(F.count("*").alias("n"))
        part = written(counts.select(F.lit(own.stage).alias("stage"), F.lit(name).alias("dimension"), "doc_id", "n"), "counts")
        out = part if out is None else out.unionByName(part)
    return out


def results(found: DataFrame, docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """(doc_id, stage, dimension, status, n): every book and check, pass where no violation was found.

    Counts come first, so the books are met by one small row a book and check.
    """
    counts = found.groupBy("doc_id", "dimension").agg(F.count("*").alias("n"))
    cells = docs.select("doc_id").distinct().withColumn("c", F.explode(F.array(*[F.struct(F.lit(CHECKS[d].stage).alias("stage"), F.lit(d).alias("dimension")) for d in dimensions]))).select("doc_id", "c.*")
    held = cells.join(counts, ["doc_id", "dimension"], "left")
    return held.select("doc_id", "stage", "dimension", F.when(F.coalesce("n", F.lit(0)) > 0, "fail").otherwise("pass").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def statuses(tables: Tables, docs: DataFrame, dimensions: list[str] | None = None, skips: DataFrame | None = None, missing: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, stage, dimension, status, n, reason) of every book and check: pass, fail, skip or error; one check that breaks stops none of the others.

    ``skips`` (doc_id, dimension) are not run for their books. ``tables`` raises LookupError for a table of a stage that has
    not run, which skips the check; ``missing`` names dimensions whose requirements no book meets. Each check is counted on its own.
    """
    names = dimensions or list(CHECKS)
    spark = docs.sparkSession
    counts = spark.createDataFrame([], "doc_id string, dimension string, n long")
    broken: dict[str, tuple[str, str]] = {name: ("skip", "requirements") for name in names if name in missing}
    for name in names:
        if name in broken:
            continue
        try:
            own = CHECKS[name].run(tables).groupBy("doc_id").agg(F.count("*").alias("n"))
            counts = counts.unionByName(written(own.select(F.col("doc_id").cast("string"), F.lit(name).alias("dimension"), "n"), "check"))
        except LookupError as e:
            broken[name] = ("skip", f"stage not run ({e.args[0] if e.args else ''})")
        except Exception as e:  # noqa: BLE001
            broken[name] = ("error", f"{type(e).__name__}: {str(e)[:200]}")
    cells = F.explode(F.array(*[F.struct(F.lit(CHECKS[d].stage).alias("stage"), F.lit(d).alias("dimension"), F.lit(broken.get(d, (None, None))[0]).cast("string").alias("broken"), F.lit(broken.get(d, (None, None))[1]).cast("string").alias("reason")) for d in names]))
    held = docs.select("doc_id").distinct().withColumn("c", cells).select("doc_id", "c.*").join(counts, ["doc_id", "dimension"], "left")
    asked = skips.select("doc_id", "dimension").distinct().withColumn("skipped", F.lit(True)) if skips is not None else None
    held = held.join(asked, ["doc_id", "dimension"], "left") if asked is not None else held.withColumn("skipped", F.lit(None).cast("boolean"))
    status = F.when(F.col("skipped"), "skip").when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("n") > 0, "fail").otherwise("pass")
    n = F.when(status.isin("pass", "fail"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return held.select("doc_id", "stage", "dimension", status.alias("status"), n.alias("n"), F.when(F.col("skipped"), "skip list").otherwise(F.col("reason")).alias("reason"))


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, dimension): checks that passed in the baseline and fail or break now."""
    was = baseline.filter("status = 'pass'").select("doc_id", "dimension")
    return current.filter("status in ('fail', 'error')").join(was, ["doc_id", "dimension"]).select("doc_id", "dimension")


def upserted(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """The baseline with the current statuses put over it."""
    both = baseline.select("doc_id", "dimension", F.col("status").alias("old")).join(current.select("doc_id", "dimension", F.col("status").alias("new")), ["doc_id", "dimension"], "full_outer")
    return both.select("doc_id", "dimension", F.coalesce("new", "old").alias("status"))


def pass_k(rounds: DataFrame) -> DataFrame:
    """(doc_id, dimension, status, rounds) over rounds (doc_id, dimension, round, status): pass only if all pass, else the first that does not."""
    bad = F.min_by("status", F.when(F.col("status") != "pass", F.col("round")))
    return rounds.groupBy("doc_id", "dimension").agg(F.when(F.every(F.col("status") == "pass"), "pass").otherwise(bad).alias("status"), F.count("*").alias("rounds"))


def review_queue(found: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` violations of each failing book and check, in the order of their units (a queue for people)."""
    place = F.row_number().over(W.partitionBy("doc_id", "dimension").orderBy("unit_id", "message"))
    return found.withColumn("place", place).filter(F.col("place") <= most)

"""Comparing what was written with what was said: word error rate and best matching sentences.

Words are mapped to one code point each, so the built-in edit distance, which
counts code points, counts words, without Python.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.session import written

#: First code point that stands for a word, and how many there are; a pair with more distinct words is compared by its bag of words.
_ALPHABET = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 20_000))
# Letters with marks and the plain ones they fold to.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def spoken_words(text: Column) -> Column:
    """Lower-case words without accents and punctuation, as speech is compared."""
    folded = F.translate(F.lower(F.translate(text, "’‘", "''")), *ACCENTS)
    return F.filter(F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{M}\p{N}']+"), F.lit(0)), lambda w: w != "'")


def word_error_rate(reference: Column, heard: Column) -> Column:
    """Word edits over reference words; 0 or 1 for an empty reference."""

    def coded(pair: Column) -> Column:
        known = F.array_distinct(F.concat(pair["r"], pair["h"]))
        code = lambda words: F.array_join(F.transform(words, lambda w: F.substr(F.lit(_ALPHABET), F.array_position(known, w).cast("int"), F.lit(1))), "")
        edits = F.levenshtein(code(pair["r"]), code(pair["h"]))
        bag = F.greatest(F.size(F.array_except(pair["r"], pair["h"])), F.size(F.array_except(pair["h"], pair["r"])))
        n = F.size(pair["r"])
        return F.when(n == 0, F.when(F.size(pair["h"]) == 0, 0.0).otherwise(1.0)).when(F.size(known) > len(_ALPHABET), bag / n).otherwise(edits / n)

    pair = F.struct(spoken_words(reference).alias("r"), spoken_words(heard).alias("h"))
    return F.element_at(F.transform(F.array(pair), coded), 1)


def _candidates(source: DataFrame, rewrite: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source sentences, rewrites, and the pairs (c, src_id, match_id) that can share ``least`` of a sentence's words.

    A rewrite that does misses at most size - ceil(least * size) words of the sentence, so it has one of any
    size - ceil(least * size) + 1 of them; sentences meet over the so many that fewest rewrites of the chapter have,
    however many that are, and no such pair is missed. Chapters and words meet as hashes, which can only add pairs.
    Equal rewrites of a chapter are one, that of the least id.
    """
    place = ["book_id", "chapter_id"]

    def words(rows: DataFrame, name: str) -> DataFrame:
        held = rows.select(*place, F.xxhash64(*place).alias("c"), F.col("id").alias(name), F.col("text").alias(f"t_{name}"), F.array_sort(F.array_distinct(spoken_words(F.col("text")))).alias(f"w_{name}"))
        return held.filter(F.size(f"w_{name}") > 0)

    def hashed(name: str) -> Column:
        return F.explode(F.transform(f"w_{name}", lambda w: F.xxhash64(w))).alias("h")

    a = written(words(source, "src_id"), "sources")
    b = written(words(rewrite, "match_id").groupBy(*place, "c", "t_match_id", "w_match_id").agg(F.min("match_id").alias("match_id")), "rewrites")
    # Scores are rounded to six digits before they are held against the bound.
    need = F.greatest(F.lit(1), F.ceil((F.lit(least) - 1e-6) * F.size("w_src_id"))).cast("int").alias("need")
    each = b.select("c", "match_id", F.size("w_match_id").alias("n"), hashed("match_id"))
    df = each.groupBy("c", "h").agg(F.count("*").alias("df"))
    left = a.select("c", "src_id", need, hashed("src_id")).join(df, ["c", "h"]).groupBy("c", "src_id", "need").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("x"))
    # Words that no rewrite has are the rarest and take their places in the prefix, but meet nothing.
    prefix = F.slice("x", F.lit(1), F.greatest(F.lit(0), F.size("x") - F.col("need") + 1))
    left = left.select("c", "src_id", "need", F.explode(F.transform(prefix, lambda x: x["h"])).alias("h"))
    return a, b, left.join(each, ["c", "h"]).filter("n >= need").select("c", "src_id", "match_id").distinct()


def _side_by_side(a: DataFrame, b: DataFrame, met: DataFrame) -> DataFrame:
    """The pairs with both texts and word lists, those of hashes that met by chance left out."""
    right = b.select("c", F.col("book_id").alias("b_id"), F.col("chapter_id").alias("c_id"), "match_id", "t_match_id", "w_match_id")
    return met.join(a, ["c", "src_id"]).join(right, ["c", "match_id"]).filter("book_id = b_id and chapter_id = c_id")


def best_matches(source: DataFrame, rewrite: DataFrame, least: float = 0.5) -> DataFrame:
    """(book_id, chapter_id, src_id, match_id, score): for each source sentence the rewrite of its chapter that shares most words.

    Both are (book_id, chapter_id, id, text). No match with a score of ``least`` is missed; among equal ones the least id counts.
    """
    a, b, met = _candidates(source, rewrite, least)
    score = F.round(F.size(F.array_intersect("w_src_id", "w_match_id")) / F.size("w_src_id"), 6)
    held = _side_by_side(a, b, met).withColumn("score", score).filter(F.col("score") >= least)
    best = held.groupBy("book_id", "chapter_id", "src_id").agg(F.max_by(F.struct("match_id", "score"), F.struct("score", -F.col("match_id"))).alias("m"))
    return best.select("book_id", "chapter_id", "src_id", "m.match_id", "m.score")


def _places(text: str) -> dict[str, int]:
    """The places of each character as bits."""
    at: dict[str, int] = {}
    for k, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << k
    return at


def common_length(a: str, b: str, at: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a row of bits for each character; ``at`` has the places of the characters of ``a``."""
    at = _places(a) if at is None else at
    full = rows = (1 << len(a)) - 1
    for c in b:
        if met := rows & at.get(c, 0):
            rows = ((rows + met) | (rows - met)) & full
    return len(a) - rows.bit_count()


def prefix_lengths(a: str, b: str, at: dict[str, int] | None = None) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` and every beginning of ``b``, the empty one too."""
    at = _places(a) if at is None else at
    size, full = len(a), (1 << len(a)) - 1
    rows, out = full, [0]
    for c in b:
        if met := rows & at.get(c, 0):
            rows = ((rows + met) | (rows - met)) & full
        out.append(size - rows.bit_count())
    return out


#: (edits, end, start, stop) of a piece of the longer text: no part of it has fewer edits, and one that ends there has as many.
Span = tuple[int, int, int, int]


def partial_score(a: str, b: str, least: float = 0.0, spans: list[Span] | None = None) -> float:
    """How alike the shorter text is to the part of the longer one that it is most like, 0 to 100; 0 if that is under ``least``.

    Alike is twice what two texts have in common over their lengths; parts as long as the shorter text are compared with it,
    and shorter ones at the ends. ``spans`` are pieces of the longer text that hold all these parts.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    if short in long:
        return 100.0
    size, best = len(short), least
    found, at = False, _places(short)

    def meet(common: int, k: int) -> None:
        nonlocal best, found
        score = 200 * common / (size + k)
        if score > best or score == best and common and not found:
            best, found = score, True

    for edits, end, lo, hi in sorted(spans or [(0, size, 0, len(long))]):
        if _bound(edits, 2 * size) < best:
            break
        start = min(max(end - size, lo), hi - size)
        meet(common_length(short, long[start : start + size], at), size)
        if _bound(edits, 2 * size - 1) >= best:
            # All beginnings of the longer text in one pass, and all its ends in another.
            for here, one, other, places in ((lo == 0, short, long[:size], at), (hi == len(long), short[::-1], long[: -size - 1 : -1], None)):
                for k, common in enumerate(prefix_lengths(one, other, places) if here else []):
                    meet(common, k)
        # A part moved by one character has at most one more in common, so places too near a poor one are passed over.
        start = lo
        while start <= hi - size and _bound(edits, 2 * size) >= best:
            common = common_length(short, long[start : start + size], at)
            meet(common, size)
            start += max(1, int(best * size / 100 - common))
    return best if found else 0.0


def _bound(edits: int, sizes: int) -> float:
    """The score that two texts of these sizes together can have."""
    return (1 - edits / sizes) * 100 + 1e-9


def least_edits(short: str, long: str) -> tuple[int, int]:
    """The fewest letters to take out of ``short`` and of some part of ``long`` until both are the same, and where the first such part ends.

    Differences between the places of a column of the table are kept as bits, as in Hyyrö's matching under indel distance.
    """
    at = _places(short)
    edits = best = len(short)
    end = 0
    full, last = (1 << len(short)) - 1, 1 << len(short) >> 1
    up, down = full, 0
    for k, c in enumerate(long):
        same = at.get(c, 0)
        begun, free = up & same, same | down
        less_in = ((up + begun) ^ up ^ begun) & full
        gain = down | full ^ (up | free | less_in)
        more_or = gain | up ^ begun
        more_in = ((more_or + gain) ^ more_or ^ gain) & full
        if (gain | (up ^ begun) & more_in) & last:
            edits += 1
        elif up & (same | less_in) & last:
            edits -= 1
            if edits < best:
                best, end = edits, k + 1
        up, down = less_in | full ^ (free | (more_in & ~up)), more_in & free
    return best, end


#: Longer texts are compared in pieces, or by themselves; pairs in a block; letters that are told apart (mixing some up only lowers the edits).
LONG, LANES, LETTERS = 512, 2048, 128


def spans_of(texts: list[tuple[str, str]]) -> list[list[Span]]:
    """For each pair (shorter, longer) pieces of the longer text with bounds of their edits, many pairs at once.

    Every part as long as the shorter text or less lies whole in one of them.
    """
    pairs, out = [], []
    for s, t in texts:
        out.append([(at, min(len(t), at + LONG + len(s))) for at in range(0, max(1, len(t) - len(s)), LONG)] if len(s) <= LONG else [(0, len(t))])
        if len(s) <= LONG:
            pairs.extend((s, t[lo:hi]) for lo, hi in out[-1])
    met = iter(_edits_of(pairs))
    for k, (s, t) in enumerate(texts):
        found = [least_edits(s, t)] if len(s) > LONG else [next(met) for _ in out[k]]
        out[k] = [(edits, lo + end, lo, hi) for (edits, end), (lo, hi) in zip(found, out[k])]
    return out


def _edits_of(pairs: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """No more than :func:`least_edits` of each pair, and rarely less, with the end of a part."""
    out = [(0, 0)] * len(pairs)
    wide = sorted(range(len(pairs)), key=lambda k: (-(len(pairs[k][0]) // -64), len(pairs[k][1])), reverse=True)
    one, top = np.uint64(1), np.uint64(63)
    while wide:
        words = -(len(pairs[wide[0]][0]) // -64)
        held = [k for k in wide[:LANES] if -(len(pairs[k][0]) // -64) == words]
        wide = wide[len(held) :]
        n, sizes = len(held), np.array([len(pairs[k][0]) for k in held])
        steps = np.array([len(pairs[k][1]) for k in held])

        def letters(texts: list[str]) -> np.ndarray:
            return (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % LETTERS).astype(np.int64)

        # Bits of the places of each letter in the shorter texts.
        lane = np.repeat(np.arange(n), sizes)
        place = np.arange(len(lane)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        masks = np.zeros((words, n * LETTERS), dtype=np.uint64)
        np.bitwise_or.at(masks, (place >> 6, lane * LETTERS + letters([pairs[k][0] for k in held])), one << (place & 63).astype(np.uint64))
        # Longest first, so those that go on at a step come first.
        texts, first = letters([pairs[k][1] for k in held]), np.cumsum(steps) - steps
        on = np.searchsorted(-steps, -np.arange(steps[0]), side="left")
        base, bit = np.arange(n) * LETTERS, ((sizes - 1) & 63).astype(np.uint64)
        ups, downs = [np.full(n, ~np.uint64(0)) for _ in range(words)], [np.zeros(n, dtype=np.uint64) for _ in range(words)]
        edits = sizes << 32
        best = edits.copy()
        for j in range(int(steps[0])):
            m = int(on[j])
            at = base[:m] + texts[first[:m] + j]
            less_carry = more_carry = np.uint64(0)
            for w in range(words):
                up, down, same = ups[w][:m], downs[w][:m], masks[w].take(at)
                begun, free = up & same, same | down
                less_in = (up + begun + less_carry) ^ up ^ begun
                gain = down | ~(up | free | less_in)
                more_or = gain | (up ^ begun)
                more_in = (more_or + gain + more_carry) ^ more_or ^ gain
                more, less = gain | (more_or & more_in), up & (same | less_in)
                more_carry, less_carry = more >> top, less >> top
                ups[w][:m] = less_in | ~(free | (more_in & ~up))
                np.bitwise_and(more_in, free, out=downs[w][:m])
            edits[:m] += (((more >> bit[:m]) & one).astype(np.int64) - ((less >> bit[:m]) & one).astype(np.int64)) << 32
            np.minimum(best[:m], edits[:m] + (j + 1), out=best[:m])
        for k, x in zip(held, best.tolist()):
            out[k] = (x >> 32, x & 0xFFFFFFFF)
    return out


def set_score(a: str, b: str) -> float:
    """How alike two texts are as sets of words, 0 to 100: what they share against what each has beside it."""
    first, second = set(a.split()), set(b.split())
    both = " ".join(sorted(first & second))
    rest = [" ".join(sorted(first - second)), " ".join(sorted(second - first))]
    if both and not all(rest):
        return 100.0
    whole = [f"{both} {r}".strip() for r in rest]
    ratio = lambda x, y: 200 * common_length(x, y) / (len(x) + len(y)) if x or y else 0.0
    return max(ratio(*whole), *([ratio(both, w) for w in whole] if both else [0.0]))


def _scored(pairs: DataFrame, scorer, left: str, right: str) -> DataFrame:
    """Pairs with their score, in Arrow batches."""

    def run(a, b):
        return pd.Series([float(scorer(x, y)) for x, y in zip(a, b)])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return pairs.withColumn("score", F.round(F.pandas_udf(run, "double")(left, right), 4))


#: Below the first a sentence is dropped, below the second a judge decides.
DROPPED, AMBIGUOUS = 75.0, 85.0
#: Sentences of a chapter that are compared at once with as many rewrites; sentences and pairs of a batch; bits of a text's letter pairs.
CHUNK, SENTENCES, PAIRS, PAIR_BITS = 512, 1024, 16_384, 2048


def _pair_bits(texts: list[str]) -> np.ndarray:
    """A row of bits for each text: the letter pairs that it has, by a hash."""
    sizes = np.array([len(t) for t in texts])
    at = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    held = np.zeros((len(texts), PAIR_BITS), dtype=bool)
    row = np.repeat(np.arange(len(texts)), sizes)
    own = row[1:] == row[:-1]
    held[row[1:][own], (at[:-1][own] * np.uint32(31) + at[1:][own]) % PAIR_BITS] = True
    return np.packbits(held, axis=1).view(np.uint64)


def _missing_most(score: float) -> float:
    """Share of its letters that a text's letter pairs missing in another can be at most, if the partial score is ``score``.

    A letter taken out of the shorter text breaks two of its pairs and one put in breaks one; at a score r most are broken
    by a part of its length, 3 (size - k) of them with r = k / size, or by a part at an end that is all in common,
    2 (size - k) of them with r = 2 k / (size + k).
    """
    r = score / 100
    return (1 - r) * max(3, 4 / (2 - r)) + 1e-9


def _key(score: float) -> int:
    return int(score * 10_000 + 0.5)


def best_rewrites(chunks, cutoff: float):
    """(chunk, place of the sentence, place of the rewrite, score) for every sentence of pairs (sentences, rewrites).

    Every rewrite counts: the best by :func:`partial_score`, the first among equal ones, none below ``cutoff``. Bounds that
    no pair of a score exceeds spare most comparisons: letter pairs that the other text lacks, then the fewest edits.
    """
    waiting: list[tuple] = []

    def settled():
        # The rewrite that lacks least is compared first: what it reaches rules out most others.
        scores = [0.0] * len(waiting)
        bests: list[int | None] = [None] * len(waiting)
        asked: list[tuple[int, int]] = []

        def compare() -> None:
            pairs = [(x, y) if len(x) <= len(y) else (y, x) for k, i in asked for x, y in [(waiting[k][2], waiting[k][3][i])]]
            spans = spans_of(pairs)
            bounds = [_bound(min(own)[0], 2 * len(s)) for own, (s, _) in zip(spans, pairs)]
            for j in sorted(range(len(asked)), key=lambda j: (asked[j][0], -bounds[j], asked[j][1])):
                k, i = asked[j]
                # Scores are rounded to four digits before they are compared.
                need = max(cutoff, scores[k] - 1e-4)
                if bounds[j] < need:
                    continue
                score = partial_score(*pairs[j], need, spans[j])
                if score and score >= cutoff and (bests[k] is None or (_key(score), -i) > (_key(scores[k]), -bests[k])):
                    scores[k], bests[k] = score, i
            asked.clear()

        firsts = []
        for k, (_, _, x, _, sizes, lacks, _) in enumerate(waiting):
            firsts.append(int(np.argmin(np.where(2 * sizes >= len(x), lacks, lacks + 9))))
            asked.append((k, firsts[k]))
        compare()
        for k, (_, _, x, _, sizes, lacks, _) in enumerate(waiting):
            # With fewer than three letters nothing but a text that is contained gets over two thirds.
            left = (lacks <= _missing_most(max(cutoff, scores[k] - 1e-4))) & ((np.minimum(sizes, len(x)) > 2) | (cutoff <= 200 / 3))
            left[firsts[k]] = False
            asked.extend((k, i) for i in np.flatnonzero(left).tolist())
            if len(asked) >= PAIRS:
                compare()
        compare()
        for (which, place, *_, places), best, score in zip(waiting, bests, scores):
            yield which, place, None if best is None else places[best], None if best is None else score
        waiting.clear()

    for which, (sentences, rewrites) in enumerate(chunks):
        first: dict[str, int] = {}
        for k, y in enumerate(rewrites):
            if y:
                first.setdefault(y, k)
        texts, places = list(first), list(first.values())
        joined, ends = "\0".join(texts), []
        for y in texts:
            ends.append((ends[-1] + 1 if ends else 0) + len(y))
        bits, sizes, done = None, np.array([len(y) for y in texts]), {}
        for k, x in enumerate(sentences):
            # Nothing is more alike than a text that is contained; the first of these is the match.
            if x not in done:
                at = joined.find(x) if x else -1
                place = bisect.bisect_left(ends, at + 1) if at >= 0 else len(texts)
                if place < len(texts) and x not in texts[place]:
                    place = next((i for i, y in enumerate(texts) if x in y), len(texts))
                done[x] = next((i for i in range(place) if texts[i] in x), place) if x else len(texts)
            place = done[x]
            if place < len(texts):
                yield which, k, places[place], 100.0
            elif not x or not texts:
                yield which, k, None, None
            else:
                if bits is None:
                    bits = _pair_bits(texts)
                own = _pair_bits([x])
                lacks = np.where(sizes >= len(x), np.bitwise_count(own & ~bits).sum(axis=1), np.bitwise_count(bits & ~own).sum(axis=1)) / np.minimum(sizes, len(x))
                waiting.append((which, k, x, texts, sizes, lacks, places))
        if len(waiting) >= SENTENCES:
            yield from settled()
    yield from settled()


def aligned(source: DataFrame, rewrite: DataFrame, cutoff: float = DROPPED) -> DataFrame:
    """(book_id, chapter_id, src_id, match_id, score, verdict) for every source sentence: kept, ambiguous or dropped.

    A sentence is kept if some rewrite of its chapter contains something like it. Both are (book_id, chapter_id, id, text),
    numbers left out beforehand where these may be spoken. All rewrites of the chapter are weighed and none that reaches
    ``cutoff`` is missed; among equal ones the least id counts. A sentence left without a letter or mark is dropped.
    """
    place = ["book_id", "chapter_id"]

    def chunks(rows: DataFrame, name: str) -> DataFrame:
        at = F.floor((F.row_number().over(W.partitionBy(*place).orderBy("id", "text")) - 1) / CHUNK)
        held = rows.filter("text is not null").select(*place, "id", "text").withColumn("chunk", at)
        listed = held.groupBy(*place, "chunk").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("x"))
        return listed.select(*place, F.col("x.id").alias(f"{name}_ids"), F.col("x.text").alias(f"{name}_texts"))

    def run(batches):
        for batch in batches:
            keys, lists = [batch.column(k) for k in (0, 1)], [batch.column(k) for k in range(2, 6)]
            out = ([], [], [], [], [])
            rows = ((lists[1][k].as_py(), lists[3][k].as_py() or []) for k in range(batch.num_rows))
            for which, k, match, score in best_rewrites(rows, cutoff):
                for column, value in zip(out, (which, lists[0][which][k].as_py(), None if match is None else lists[2][which][match].as_py(), score)):
                    column.append(value)
            at = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in keys), *(pa.array(v, kind) for v, kind in zip(out[1:], (lists[0].type.value_type, lists[2].type.value_type, pa.float64())))], ["book_id", "chapter_id", "src_id", "match_id", "score"])

    both = chunks(source, "src").join(chunks(rewrite, "match"), place, "left").select(*place, "src_ids", "src_texts", "match_ids", "match_texts")
    kinds = {**{c: source.schema[c].dataType.simpleString() for c in place}, "src_id": source.schema["id"].dataType.simpleString(), "match_id": rewrite.schema["id"].dataType.simpleString(), "score": "double"}
    found = both.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in kinds.items())).withColumn("score", F.round("score", 4))
    best = found.groupBy(*place, "src_id").agg(F.max_by(F.struct("match_id", "score"), F.when(F.col("score").isNotNull(), F.struct("score", -F.col("match_id")))).alias("m"))
    verdict = F.when(F.col("m").isNull(), "dropped").when(F.col("m.score") < AMBIGUOUS, "ambiguous").otherwise("kept")
    return best.select(*place, "src_id", "m.match_id", "m.score", verdict.alias("verdict"))


def without_source(source: DataFrame, rewrite: DataFrame, least_words: int = 15, cutoff: float = 60.0) -> DataFrame:
    """(book_id, chapter_id, id): rewrites of more than ``least_words`` words that no source sentence of their chapter is like as a set of words.

    Chapters without source sentences are left out. A pair at the cutoff shares at least one word, so all pairs that share
    one of the rewrite's rarest words, all but a tenth of them, are scored.
    """
    long = rewrite.filter(F.size(F.split(F.trim("text"), r"\s+")) > least_words)
    a, b, met = _candidates(long, source, 0.1)
    pairs = _scored(written(_side_by_side(a, b, met), "pairs"), set_score, "t_src_id", "t_match_id").filter(F.col("score") >= cutoff)
    chapters = source.select("book_id", "chapter_id").distinct()
    lost = a.join(chapters, ["book_id", "chapter_id"], "left_semi").join(pairs.select("c", "src_id").distinct(), ["c", "src_id"], "left_anti")
    return lost.select("book_id", "chapter_id", F.col("src_id").alias("id"))

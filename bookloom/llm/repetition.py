"""Problem 6: repetition inside a single transcript.

Each transcript is a bag of hashed word n-grams, of one to four words, each with
whether it is said for the first, the second or a later time. What is said for
the first time tells nothing of repetition, so it shares one bucket an order;
what recurs is hashed by its words. Two multinomials over the buckets are
counted, one over trusted text (the sample passages, a fixed table) and one
over all transcripts, each smoothed towards the share of its order and time; a
transcript's score is the log-likelihood ratio of the two, divided by its
length, of the order for which it is highest. That "the" recurs is usual in
trusted text and speaks for nothing, that a rare word or a whole phrase does is
not. The score depends on what else is in the two tables and does not give a
share, so it decides nothing: every transcript is measured exactly. Words that
belong to a second or later saying of a stretch, with one misheard word or a
filler between, are counted, and a third of all words decides. The scores come
with the share of every transcript.

Words are cut once and kept as 64-bit hashes in a written table; counting and
scoring are array operations over whole batches.

Defined cases: null and blank transcripts have no row in the scores and are
never found; repeated rows count once; a transcript without a repeated word has
share 0; a transcript of any length is measured whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.lookalike import consistent
from bookloom.session import checked_broadcast_rows, written

#: Most words of an n-gram, the times it may be said that are told apart, and hash buckets of each; bounds what is sent to the workers.
ORDERS, TIMES, BUCKETS = 4, 3, 4096
#: The share that is found.
SHARE = 1 / 3
#: Words (characters, in scripts without spaces) that make a stretch.
STRETCH, STRETCH_CHARS = 3, 5

_unspaced = "぀-ヿ㐀-鿿฀-๿"
_token = re.compile(f"[{_unspaced}]|(?:[^\\W_{_unspaced}]|[̀-ͯऀ-ःऺ-ॏॢॣً-ٟ])+(?:[’'.,-][^\\W_{_unspaced}]+)*")


def tokens(text: str) -> tuple[list[str], bool]:
    """The words of a transcript, without case and punctuation, and whether they are mostly characters of unspaced scripts."""
    found = _token.findall((consistent(text) or "").casefold())
    single = sum(len(w) == 1 and w >= "฀" for w in found)
    return found, single * 2 > len(found)


def events(words: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the buckets of the n-grams of a batch of transcripts and the transcript of each.

    ``words`` are the hashes of all words one after another, ``starts`` where each transcript begins, and the end.
    """
    sizes = np.diff(starts)
    own = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(starts[1:], sizes) - np.arange(len(words))
    mixed = words.astype(np.uint64)
    gram, out = np.zeros(len(words), np.uint64), []
    for n in range(1, ORDERS + 1):
        gram[: max(0, len(words) - n + 1)] = gram[: max(0, len(words) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + mixed[n - 1 :]
        at = np.flatnonzero(left >= n)
        held, of = gram[at], own[at]
        order = np.lexsort((held, of))
        a, b = held[order], of[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        place = np.arange(len(order))
        times = np.empty(len(order), np.int64)
        times[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        times = np.minimum(times, TIMES - 1)
        # The high bits of a product are the mixed ones.
        hashed = ((held * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)).astype(np.int64) % BUCKETS
        out.append((((n - 1) * TIMES + times) * BUCKETS + np.where(times > 0, hashed, 0), of))
    return out


def share(words: list, unspaced: bool) -> float:
    """Share of the words in a second or later saying of a stretch already spoken."""
    size = len(words)
    if len(set(words)) == size:
        return 0.0
    n = STRETCH_CHARS if unspaced else STRETCH
    source = [-1] * size
    first: dict[tuple, int] = {}
    for k in range(size - n + 1):
        gram = tuple(words[k : k + n])
        at = first.setdefault(gram, k)
        if at < k:
            for j in range(n):
                if source[k + j] < 0:
                    source[k + j] = at + j
    # Short stretches said again at once: the same one or two words.
    for period in (1, 2):
        for k in range(period, size - period + 1):
            if source[k] < 0 and words[k : k + period] == words[k - period : k] and (period > 1 or not unspaced):
                for j in range(period):
                    source[k + j] = k - period + j
    # A misheard word or filler between two parts of one saying, and what goes on behind it.
    for step in (1, -1):
        order = range(size) if step == 1 else range(size - 1, -1, -1)
        for k in order:
            if source[k] >= 0:
                continue
            for back in (1, 2):
                at = k - step * back
                if 0 <= at < size and source[at] >= 0:
                    for shift in (0, step, -step):
                        want = source[at] + step * back + shift
                        if 0 <= want < k and words[want] == words[k]:
                            source[k] = want
                            break
                if source[k] >= 0:
                    break
    covered = [s >= 0 for s in source]
    for k in range(1, size - 1):
        if not covered[k] and covered[k - 1] and source[k + 1] >= 0 and abs(source[k + 1] - source[k - 1]) <= 3:
            covered[k] = True
    return sum(covered) / size


def recurring(seen: list[tuple[np.ndarray, np.ndarray]], words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each transcript of a batch has a stretch said twice or one or two words said again at once; without, its share is 0.

    ``seen`` are the batch's events. N-grams meet as hashes, which can only add transcripts.
    """
    size = len(starts) - 1
    out = np.zeros(size, bool)
    buckets, of = seen[min(STRETCH, STRETCH_CHARS) - 1]
    out[of[buckets // BUCKETS % TIMES > 0]] = True
    own = np.repeat(np.arange(size), np.diff(starts))
    for period in (1, 2):
        # Whether a word is that of ``period`` words before, in one transcript.
        same = (words[period:] == words[:-period]) & (own[period:] == own[:-period])
        run = same if period == 1 else same[1:] & same[:-1] & (own[3:] == own[:-3])
        out[own[2 * period - 1 :][run]] = True
    return out


class Ratio:
    """Per bucket, the log of its probability in raw text over that in trusted text."""

    def __init__(self, trusted: np.ndarray, raw: np.ndarray):
        self.weight = np.log(self._smoothed(raw)) - np.log(self._smoothed(trusted))

    @staticmethod
    def _smoothed(counts: np.ndarray) -> np.ndarray:
        """Probabilities within each order: of the time said, and of the words where they recur."""
        table = counts.reshape(ORDERS, TIMES, BUCKETS).astype(float)
        times = table.sum(axis=2) + 1.0
        within = (table + 1.0) / (table.sum(axis=2, keepdims=True) + BUCKETS)
        within[:, 0, :] = 1.0
        return (within * (times / times.sum(axis=1, keepdims=True))[:, :, None]).reshape(-1)

    def scores(self, seen: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """The score of each of the ``n`` transcripts of a batch, from its events."""
        best = np.full(n, -np.inf)
        for buckets, of in seen:
            sizes = np.bincount(of, minlength=n)
            sums = np.bincount(of, weights=self.weight[buckets], minlength=n)
            best = np.maximum(best, np.where(sizes > 0, sums / np.maximum(1, sizes), -np.inf))
        return best


def cut_into_words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, unspaced) of the texts with a word; words are 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            at, values, starts, kinds = [], [], [0], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                words, unspaced = tokens(value)
                if not words:
                    continue
                for word in words:
                    if word not in known:
                        known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
                values.extend([known[word] for word in words])
                at.append(k)
                starts.append(len(values))
                kinds.append(unspaced)
            if len(known) > 200_000:
                known.clear()
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), lists, pa.array(kinds, pa.bool_())], names=[key, "words", "unspaced"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(run, f"{key} {kind}, words array<long>, unspaced boolean")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and where each list begins."""
    starts = column.offsets.to_numpy()
    return column.values.to_numpy()[starts[0] : starts[-1]], (starts - starts[0]).astype(np.int64)


def _counted(said: DataFrame) -> np.ndarray:
    """How often each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDERS * TIMES * BUCKETS, np.int64)
        for batch in batches:
            for buckets, _ in events(*_flat(batch.column(0))):
                total += np.bincount(buckets, minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    rows = said.select("words").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(ORDERS * TIMES * BUCKETS, np.int64)
    for r in checked_broadcast_rows(rows, len(out), "the multinomial"):
        out[r.bucket] = r.n
    return out


def _measured(transcripts: DataFrame, trusted: DataFrame, key: str, text: str) -> DataFrame:
    """(key, score, share) of every transcript, not rounded; both multinomials are counted over all of their rows."""
    said = written(cut_into_words(transcripts, key, text), "said")
    usual = _counted(cut_into_words(trusted.select(F.lit(0).alias("_key"), "text"), "_key", "text"))
    shared = transcripts.sparkSession.sparkContext.broadcast(Ratio(usual, _counted(said)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            words, starts = _flat(batch.column(1))
            seen = events(words, starts)
            scores = ratio.scores(seen, len(starts) - 1)
            kinds = batch.column(2).to_pylist()
            shares = np.zeros(len(scores))
            for k in np.flatnonzero(recurring(seen, words, starts)):
                shares[k] = share(words[starts[k] : starts[k + 1]].tolist(), kinds[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], names=[key, "score", "share"])

    kind = transcripts.schema[key].dataType.simpleString()
    return said.mapInArrow(run, f"{key} {kind}, score double, share double")


def scored(transcripts: DataFrame, trusted: DataFrame, key: str = "review_id", text: str = "transcript") -> DataFrame:
    """(key, score, share) of every transcript."""
    return _measured(transcripts, trusted, key, text).select(key, F.round("score", 6).alias("score"), F.round("share", 6).alias("share"))


def found(transcripts: DataFrame, trusted: DataFrame) -> DataFrame:
    """Distinct review_id of the transcripts of which at least a third repeats."""
    return _measured(transcripts, trusted, "review_id", "transcript").filter(F.col("share") >= SHARE).select("review_id").distinct()

"""Problem 10: the subjects that a document is about.

Complement naive Bayes: a feature's weight for a subject is the log of its rate
in the subject over its rate in all others, within its own language, so that a
subject with more texts of one language gains nothing by that. It starts from
the labelled passages. Expectation-maximization then goes over every sentence of
every document until the weights settle: a sentence is shared out by the
posteriors of the document's other sentences, and the features are counted again
beside those of the passages. Each subject's score of a sentence is turned into a
posterior of its own by a curve that is fitted to passages which the weights have
not seen, and a document has the subjects that at least ``PART`` of its
sentences, or of its entries where it is a list or table, are about.

Documents are cut into sentences and known features once and written as numbers;
the rounds of EM and the result are array operations over that table. Lines that
come back in a source are left out in the JVM beforehand: their keys stay with
their source, and go wherever Spark's size check lets them.

Features are words; in scripts without spaces, runs of one script and short
character n-grams. The features are those of the labelled passages and of the
lexicon, so what goes to the workers is bounded by these two fixed tables.

Defined cases: null and empty texts, and junk, have no subject; repeated rows
count once; subjects that tie are all returned; a null source is one of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.lookalike import CYRILLIC, GREEK
from bookloom.session import checked_broadcast_rows, written

#: Most labelled passages and lexicon words that are read; both tables are fixed.
LABELLED, LEXICON = 20_000, 50_000
#: Strength of the prior that a feature is no subject's, in occurrences, and how often a labelled passage counts beside the documents.
PRIOR, PASSAGE = 1.0, 1.0
#: Weights below this say nothing, before and after EM.
SLIGHT, SLIGHT_EM = 2.0, 1.2
#: A feature has to be in so many passages of a subject to start with.
PASSAGES = 2
#: Part of the sentences that makes a subject one of the document's.
PART = 0.25
#: A line in so many documents and this part of its source's is none of a document's sentences.
DOCUMENTS, REPEATED = 5, 0.02
#: EM ends when the weights change by less than this part, or after so many rounds.
SETTLED, ROUNDS = 0.04, 8
#: Odds by which a sentence's best subject may lead another that it is also about.
BESIDE = 1.4
#: Groups of passages: the curve of each is fitted to scores of weights that are without it.
FOLDS = 2

_word = re.compile(r"[a-zà-öø-ÿœа-яё]+(?:[’'-][a-zà-öø-ÿœа-яё]+)*|[ؠ-ًؿ-ٟٮ-ۓ]{2,}|[ऀ-ॣॱ-ॿ]{2,}|[ァ-ヶー]{2,}|[一-鿿]+|[ก-๎]{4,}")
#: Words of scripts with spaces; quicker than the pattern for all, which is for units of unspaced scripts.
_spaced = re.compile(r"[a-zà-öø-ÿœа-яё’'-]+|[ؠ-ًؿ-ٟٮ-ۓऀ-ॣॱ-ॿ]{2,}")
_end = re.compile(r"([.!?…])([\"”’»]*)(\s+|(?=[A-ZА-Я][a-zа-я]))|[。！？।؟](?![”」』»])\s*")
_junk = re.compile(r"[□¤§¾�]|[A-Za-zऀ-ॿ؀-ۿа-я][_/][A-Za-zऀ-ॿ؀-ۿа-я]")
_sign = re.compile("[□¤§¾�]")
_thai = re.compile("[ก-๎]")
_unspaced = re.compile("[ก-๎ァ-ヶー一-鿿]")


def features(unit: str) -> list[str]:
    """The features of a sentence."""
    if not _unspaced.search(unit):
        return _spaced.findall(unit.lower())
    out = []
    for word in _word.findall(unit.lower()):
        first = word[0]
        if first < "฀":
            out.append(word)
        elif first < "຀":
            out.extend(word[k : k + 5] for k in range(len(word) - 4))
        elif first < "一":
            out.append(word)
        else:
            size = len(word)
            if size <= 4:
                out.append("=" + word)
            out.extend(word[k : k + 2] for k in range(size - 1))
            out.extend(word[k : k + 3] for k in range(size - 2))
    return out


_ended = re.compile(r"[.!?…。！？।؟:;][\"'”’»」』)\]]*\s*$")
_last = re.compile(r"[^\W\d_]+$")
#: Small letters of other scripts that look like Latin ones, for the keys of lines.
_alike = {k: v for k, v in {**GREEK, **CYRILLIC}.items() if k.islower()}


def without_repeated_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, text) without the lines that come back in their source: the same letters, whatever their case and look-alikes."""

    def keys(text: str) -> Column:
        plain = lambda line: F.translate(F.lower(line), "".join(_alike), "".join(_alike.values()))
        return F.transform(F.split(text, "\n"), lambda line: F.xxhash64(F.regexp_replace(plain(line), r"[^\p{L}]+", "")))

    own = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").filter(F.col("text").isNotNull())
    sizes = own.groupBy("source").agg(F.count("*").alias("size"))
    each = own.select("source", F.explode(F.array_distinct(keys("text"))).alias("key")).filter(F.col("key") != F.xxhash64(F.lit("")))
    counts = each.groupBy("source", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= DOCUMENTS)
    # A share of the source's documents has each of these, so a source has at most 1/share times its lines a document.
    often = written(counts.join(sizes, "source").filter(F.col("n") >= F.col("size") * REPEATED).groupBy("source").agg(F.collect_list("key").alias("_often")), "often")
    lines = F.zip_with(F.split("text", "\n"), keys("text"), lambda line, key: F.struct(line.alias("line"), key.alias("key")))
    kept = F.transform(F.filter(lines, lambda x: ~F.array_contains("_often", x["key"])), lambda x: x["line"])
    return own.join(often, "source", "left").select("doc_id", F.when(F.col("_often").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def sentences(text: str, words: frozenset[str] = frozenset()) -> list[str]:
    """A paragraph cut after the marks that end a sentence, but not after abbreviations, or quotations that ask or exclaim.

    Abbreviations are one letter, a capital and at most three letters more, three letters that are no known word, or a word alone.
    """
    out, start = [], 0
    for m in _end.finditer(text):
        at, end = m.start(), m.end()
        if m[1] and end < len(text):
            if text[end].islower() or m[2] and m[1] != ".":
                continue
            if m[1] == ".":
                # The last letters suffice: longer words are none of these.
                last = _last.search(text, max(start, at - 8), at)
                word = last[0] if last else ""
                if len(word) < 2 or len(word) < 5 and (word[0].isupper() or text[end].isdigit()) or len(word) < 4 and word.lower() not in words or " " not in text[start:at].strip():
                    continue
        if end - start > 3:
            out.append(text[start:end])
        start = end
    if len(text) - start > 3:
        out.append(text[start:])
    return out


def units(text: str, words: frozenset[str] = frozenset()) -> list[str]:
    """The sentences of a text, or its lines where they are entries.

    Where most end like sentences, what does not is a title or a caption and is left out.
    """
    whole = _units(text, words)
    ended = [bool(_ended.search(unit)) for unit in whole]
    return [unit for unit, end in zip(whole, ended) if end] if 2 * sum(ended) >= len(whole) else whole


def _units(text: str, words: frozenset[str]) -> list[str]:
    lines = [line.strip() for line in text.split("\n")]
    shown = [line for line in lines if line]
    on = sum(a[-1] not in ".!?…。！？।؟" and len(a) > 30 and b[0].islower() for a, b in zip(shown, shown[1:]))
    out: list[str] = []
    if on >= 2 and on * 5 >= len(shown) or on and len(shown) < 5:
        # Set in lines of a page: a sentence goes on over line ends, up to a blank line.
        run = ""
        for line in [*lines, ""]:
            if line:
                run = run[:-1] + line if run and run[-1] in "-¬­‐" else f"{run} {line}" if run else line
            elif run:
                out.append(run)
                run = ""
    else:
        out = shown
    whole: list[str] = []
    for part in out:
        if _thai.search(part) and len(part) > 40:
            whole.extend(chunk for chunk in part.split() if len(chunk) > 8)
        elif len(part) > 60 or "。" in part or "।" in part:
            whole.extend(sentences(part, words))
        else:
            whole.append(part)
    return whole


class Model:
    """Weights of the known features for each subject, and the curve of each subject's posterior."""

    def __init__(self, subjects: list[str], ids: dict[str, int], groups: np.ndarray):
        self.subjects, self.ids, self.groups = subjects, ids, groups
        self.weights = np.zeros((len(ids), len(subjects)))
        self.scale = np.tile([1.0, -2.0], (len(subjects), 1))

    def weigh(self, counts: np.ndarray, slight: float) -> np.ndarray:
        """Log ratios of each feature's rate in a subject to its rate in the others, among the features of its language."""
        n = len(self.subjects)
        totals = np.zeros((self.groups.max() + 1 if len(self.groups) else 0, counts.shape[1]))
        np.add.at(totals, self.groups, counts)
        totals = totals[self.groups] + 1.0
        rate = counts / totals
        base = counts.sum(axis=1, keepdims=True) / totals.sum(axis=1, keepdims=True)
        strength = PRIOR / totals.mean(axis=1, keepdims=True)
        others = (rate.sum(axis=1, keepdims=True) - rate) / max(1, counts.shape[1] - 1)
        log = np.log((rate + 0.1 * strength + 0.05 * base) / (others + 0.1 * strength + 0.05 * base))[:, :n]
        return np.where(log > slight, log, 0.0)

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        """Posterior of each subject on its own; 0 where no feature speaks for it."""
        return np.where(scores > 0, 1 / (1 + np.exp(-np.clip(scores * self.scale[:, 0] + self.scale[:, 1], -30, 30))), 0.0)

    def about(self, scores: np.ndarray) -> np.ndarray:
        """Whether a sentence with these scores is about each subject."""
        return (self.posteriors(scores) >= 0.5) & (scores >= scores.max(axis=1, keepdims=True) - BESIDE)


def scores(weights: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Score of each sentence for each subject; ``ids`` are the features of all sentences one after another, ``sizes`` how many each has."""
    out = np.zeros((len(sizes), weights.shape[1]))
    own = np.repeat(np.arange(len(sizes)), sizes)
    held = np.flatnonzero(weights.any(axis=1)[ids]) if len(ids) else np.zeros(0, np.int64)
    if len(held):
        of = own[held]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        out[of[first]] = np.add.reduceat(weights[ids[held]], first, axis=0)
    return out


def _fitted(scored: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A logistic curve per subject over the scores of sentences, for and against it, held near (1, -2) where there are few."""
    scale = np.tile([1.0, -2.0], (scored.shape[1], 1))
    for k in range(scored.shape[1]):
        x = scored[scored[:, k] > 0, k]
        y = (labels[scored[:, k] > 0] == k).astype(float)
        a, b = 1.0, -2.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            g = np.array([((y - p) * x).sum() - 100 * (a - 1), (y - p).sum() - 100 * (b + 2)])
            h = np.array([[(w * x * x).sum() + 100, (w * x).sum()], [(w * x).sum(), w.sum() + 100]])
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            a, b = max(0.1, a + step[0]), b + step[1]
        scale[k] = (a, b)
    return scale


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and how many each list has."""
    starts = column.offsets.to_numpy()
    return column.values.to_numpy()[starts[0] : starts[-1]], np.diff(starts).astype(np.int64)


def cut_into_features(texts: DataFrame, ids: dict[str, int], words: frozenset[str]) -> DataFrame:
    """(doc_id, size, ids, sizes) of (doc_id, text): how many sentences count, junk among them, and the known features of those that are none."""
    shared = texts.sparkSession.sparkContext.broadcast((ids, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, common = shared.value
        for batch in batches:
            sizes, held, ends, lengths, marks = [], [], [0], [], [0]
            for text in batch.column(1).to_pylist():
                size = 0
                for unit in units(text, common):
                    if ("_" in unit or "/" in unit or _sign.search(unit)) and len(_junk.findall(unit)) > 2:
                        size += max(1, len(unit) // 80)
                        continue
                    size += 1
                    found = [known[f] for f in features(unit) if f in known]
                    held.extend(found)
                    lengths.append(len(found))
                sizes.append(size)
                ends.append(len(held))
                marks.append(len(lengths))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32())) for at, values in ((ends, held), (marks, lengths))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *lists], names=["doc_id", "size", "ids", "sizes"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, size int, ids array<int>, sizes array<int>")


def expected(cut: DataFrame, own: Model) -> np.ndarray:
    """Counts of the features over all documents, each sentence shared out by the posteriors of its document's others; the last column is no subject."""
    shared = cut.sparkSession.sparkContext.broadcast(own)
    n, size = len(own.subjects), len(own.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros((n + 1) * size)
        for batch in batches:
            if not batch.num_rows:
                continue
            (ids, _), (lengths, counts) = _flat(batch.column(0)), _flat(batch.column(1))
            labels = model.posteriors(scores(model.weights, ids, lengths))
            doc = np.repeat(np.arange(len(counts)), counts)
            # A document of one sentence has no others to tell what it is about.
            others = np.maximum(1, counts - 1)[doc][:, None]
            sums = np.stack([np.bincount(doc, weights=labels[:, k], minlength=len(counts)) for k in range(n)], axis=1)
            weights = np.where((counts > 1)[doc][:, None], (sums[doc] - labels) / others, 0.0)
            unit = np.repeat(np.arange(len(lengths)), lengths)
            for k in range(n):
                total[k * size : (k + 1) * size] += np.bincount(ids, weights=weights[unit, k], minlength=size)
            total[n * size :] += np.bincount(ids, weights=(counts > 1)[doc][unit].astype(float), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], names=["slot", "n"])

    rows = cut.select("ids", "sizes").mapInArrow(run, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros((n + 1) * size)
    for r in checked_broadcast_rows(rows, len(out), "the list of feature counts"):
        out[r.slot] = r.n
    table = out.reshape(n + 1, size).T
    table[:, n] = np.maximum(0.05 * table[:, n], table[:, n] - table[:, :n].sum(axis=1))
    return table


class Passages:
    """The labelled passages as features of their sentences."""

    def __init__(self, rows: list[tuple[str, str, str]], subjects: list[str], words: frozenset[str], known: list[str]):
        index = {subject: k for k, subject in enumerate(subjects)}
        cut = [(index[subject], [features(unit) for unit in units(text, words)]) for subject, text, _ in rows if subject in index]
        self.ids = {f: k for k, f in enumerate(sorted({f for _, parts in cut for part in parts for f in part}.union(known)))}
        sentences_of = [(k, subject, part) for k, (subject, parts) in enumerate(cut) for part in parts]
        self.passage = np.array([k for k, _, _ in sentences_of], np.int64)
        self.labels = np.array([subject for _, subject, _ in sentences_of], np.int64)
        self.sizes = np.array([len(part) for _, _, part in sentences_of], np.int64)
        self.flat = np.array([self.ids[f] for _, _, part in sentences_of for f in part], np.int64)
        self.n = len(subjects)

    def counts(self, least: int = 1, but: int | None = None) -> np.ndarray:
        """Occurrences of each feature in each subject's passages, of those in ``least`` passages of one subject, without one fold."""
        unit = np.repeat(np.arange(len(self.sizes)), self.sizes)
        kept = np.ones(len(unit), bool) if but is None else self.passage[unit] % FOLDS != but
        out = np.zeros((len(self.ids), self.n))
        np.add.at(out, (self.flat[kept], self.labels[unit[kept]]), 1.0)
        if least > 1 and len(unit):
            pairs = np.unique(np.stack([self.flat[kept], self.labels[unit[kept]], self.passage[unit[kept]]]), axis=1)
            held = np.zeros_like(out)
            np.add.at(held, (pairs[0], pairs[1]), 1.0)
            out[held.max(axis=1) < least] = 0
        return out

    def fit(self, own: Model, counts: np.ndarray | None) -> None:
        """The curves of a model, fitted to each fold's scores by weights that are without the fold's passages."""
        scored = np.zeros((len(self.sizes), self.n))
        for fold in range(FOLDS):
            weights = own.weigh(self.counts(PASSAGES, fold), SLIGHT) if counts is None else own.weigh(self.beside(counts, fold), SLIGHT_EM)
            mine = self.passage % FOLDS == fold
            scored[mine] = scores(weights, self.flat, self.sizes)[mine]
        own.scale = _fitted(scored, self.labels)

    def beside(self, counts: np.ndarray, but: int | None = None) -> np.ndarray:
        """Counts over documents with those of the passages added."""
        out = counts.copy()
        out[:, : self.n] += PASSAGE * self.counts(but=but)
        return out


def train(cut_by, examples: DataFrame, lexicon: DataFrame, subjects: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the labelled passages, refined over all documents and calibrated, and the documents' features.

    ``cut_by`` makes the table of features of the documents from (ids, words).
    """
    names = sorted(r.subject for r in checked_broadcast_rows(subjects.select("subject").filter("subject is not null").distinct(), 1_000, "the list of subjects"))
    labelled = examples.select("subject", "text", F.coalesce("lang", F.lit("")).alias("lang")).filter("subject is not null and text is not null").distinct()
    rows = sorted((r.subject, r.text, r.lang) for r in checked_broadcast_rows(labelled, LABELLED, "the labelled passages"))
    listed = checked_broadcast_rows(lexicon.select("word", F.coalesce("lang", F.lit("")).alias("lang")).filter("word is not null").distinct(), LEXICON, "the lexicon")
    words = frozenset(r.word for r in listed)
    passages = Passages(rows, names, words, sorted(words))
    # A feature belongs to the language in whose passages it is most often, else to that of the lexicon.
    spoken: dict[str, Counter[str]] = defaultdict(Counter)
    for r in sorted(listed):
        spoken[r.word][r.lang] += 1
    for _, text, lang in rows:
        for feature in features(text):
            spoken[feature][lang] += 10
    langs = sorted({lang for counted in spoken.values() for lang in counted})
    groups = np.array([langs.index(max(sorted(spoken[f]), key=spoken[f].__getitem__)) if f in spoken else 0 for f in passages.ids], np.int64)
    own = Model(names, passages.ids, groups)
    cut = cut_by(passages.ids, words)
    if not names or not len(passages.sizes):
        return own, cut
    own.weights = own.weigh(passages.counts(PASSAGES), SLIGHT)
    passages.fit(own, None)
    for _ in range(ROUNDS):
        counts, before = expected(cut, own), own.weights
        own.weights = own.weigh(passages.beside(counts), SLIGHT_EM)
        passages.fit(own, counts)
        if np.abs(own.weights - before).sum() <= SETTLED * np.abs(own.weights).sum():
            break
    return own, cut


def found(documents: DataFrame, examples: DataFrame, lexicon: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct (doc_id, subject)."""
    texts = without_repeated_lines(documents)
    own, cut = train(lambda ids, words: written(cut_into_features(texts, ids, words), "features"), examples, lexicon, subjects)
    shared = documents.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            (ids, _), (lengths, counts) = _flat(batch.column(2)), _flat(batch.column(3))
            about = model.about(scores(model.weights, ids, lengths)) if model.subjects else np.zeros((len(lengths), 0), bool)
            sums = np.zeros((len(counts), about.shape[1]))
            np.add.at(sums, np.repeat(np.arange(len(counts)), counts), about.astype(float))
            size = batch.column(1).to_numpy()[:, None]
            at, which = np.nonzero((sums > 0) & (sums >= PART * size))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([model.subjects[k] for k in which], pa.string())], names=["doc_id", "subject"])

    return cut.select("doc_id", "size", "ids", "sizes").mapInArrow(run, "doc_id long, subject string").distinct()

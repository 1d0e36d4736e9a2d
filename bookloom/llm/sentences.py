"""Problem 1: sentences of any language and script.

A hidden-event language model: between the words of a text stand events that
are not written, boundary or none. The n-gram counts of what stands before and
after an event, of its mark, its quotation state and of the distance to the
event before come from the rows that are one sentence each; forward-backward
over the events of a text gives each its posterior, and a boundary is where
that is above one half. In a text with marks an event can stand after a mark that
ends sentences (with or without a space), or, in Thai, at any space; between
other words its probability is zero, as no training row has one there. In a text
without any such mark an event stands between all words (characters, in Chinese
and Japanese): what ends and begins sentences there is counted over the same
rows with their marks taken off.

The model is bounded: a context is kept if it makes up at least ``SHARE`` of
all events and gaps, so at most 8/SHARE are sent to the workers, whatever the
corpus.

Defined cases: null and blank texts have no sentences; a text without events is
one sentence; offsets count code points; repeated rows count once; quotations
that do not close hold nothing together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm import quality
from bookloom.llm.lookalike import INVISIBLE, consistent
from bookloom.session import checked_broadcast_rows

#: A context is known if it makes up this share of all events and gaps; at most 8/share contexts go to the driver and the workers.
SHARE = 4e-6
#: Weight of the wider context where the narrower one is rare.
BACKOFF = 2.0
#: A boundary needs a posterior above this.
POSTERIOR = 0.5
#: How much likelier a missing space is at a boundary than within a sentence.
NO_SPACE = 12.0

MARKS = ".!?…。！？।؟۔．｡"
CLOSERS = "\"'”’»」』)\\]）"
_event = re.compile(rf"[{MARKS}]+(?:[{INVISIBLE}]*[{CLOSERS}]|[ \xa0 ]»|[{INVISIBLE}]*“(?=\s|[,;]|$))*[{INVISIBLE}]*")
_space = re.compile(rf"[\s{INVISIBLE}]+")
_thai = re.compile("[฀-๿]")
_cjk = re.compile("[぀-ヿ㐀-鿿]")
_unseen = re.compile(f"[{INVISIBLE}]")
_quotes = re.compile("[“”„«»「」『』\"()（）]")
_pairs = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", '"': '"'}
_digits = re.compile(r"\d+")
_first = re.compile(r"[^\W\d_]+")
_marks = frozenset(MARKS)
_joiners = frozenset("—–;,:")
_mark = re.compile(f"[{MARKS}]")
#: A word of a script that parts words, or a character of one that does not.
_bare = re.compile("[぀-ヿ㐀-鿿]|(?:[^\\W_぀-ヿ㐀-鿿]|[̀-ͯऀ-ःऺ-ॏॢॣً-ٟ])+(?:[’'-][^\\W_]+)*")
_inner = re.compile(r"[.!?…](?=[A-ZА-ЯÀ-Ý])")


def quoted(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, initial) of the closed quotations and brackets; initial ones open a text or follow the end of a sentence."""
    out, stack = [], []
    for m in _quotes.finditer(text):
        char = m[0]
        if stack and char == stack[-1][1]:
            start = stack.pop()[0]
            near = text[max(0, start - 6) : start]
            before = near.rstrip()
            initial = not before or before[-1] in _marks or before[-1] in "\"'”’»」』)]）" or len(before) < len(near) and bool(_thai.match(before[-1]))
            out.append((start, m.end(), initial))
        elif char in _pairs and len(stack) < 3:
            stack.append((m.start(), _pairs[char]))
    return out


def _kind(char: str) -> str:
    if char.isdigit():
        return "0"
    if char.islower():
        return "x"
    if char.isupper():
        return "X"
    if _thai.match(char):
        return "t"
    if _cjk.match(char):
        return "c"
    return "a" if char.isalpha() else char


def _shape(word: str) -> str:
    letters = [c for c in word if c.isalpha()]
    if not letters:
        return "0" if any(map(str.isdigit, word)) else "-"
    return _kind(letters[0]) + ("1" if len(letters) == 1 else "3" if len(letters) < 4 else "9")


_lefts: dict[str, tuple[str, str, bool]] = {}


def _left(word: str) -> tuple[str, str, bool]:
    """A word before an event as a context, its shape, and whether it is Thai, where the text around it counts instead."""
    if not word.isascii():
        word = consistent(word) or ""
    word = _digits.sub("0", word.lstrip("“„«「『\"'(‘¿¡—–-"))
    if _thai.search(word):
        return word, word, True
    if _cjk.search(word):
        return word[-2:], _kind(word[-1]), False
    return word[-12:], _shape(word), False


class Events:
    """The events of one text: where each is, and what stands around it."""

    __slots__ = ("at", "left", "left2", "left3", "right", "right2", "near", "spaced", "ending")

    def __init__(self, text: str):
        self.at: list[tuple[int, int]] = []
        self.left, self.left2, self.left3, self.right, self.right2, self.near, self.spaced = [], [], [], [], [], [], []
        quotes = quoted(text) if _quotes.search(text) else []
        places = [(m.start(), m.end()) for m in _event.finditer(text)]
        if _thai.search(text):
            taken = {e for _, e in places}
            places += [(m.start(), m.start()) for m in _space.finditer(text) if m.start() and m.start() not in taken and m[0][0] not in INVISIBLE and text[m.start() - 1] not in _joiners and text[m.end() : m.end() + 1] not in _joiners]
            places.sort()
        size, last = len(text), 0
        self.ending = ("", "", "")
        for start, end in places:
            gap = _space.match(text, end)
            on = gap.end() if gap else end
            if on >= size:
                self.ending = self._before(text, start, end, quotes)
                break
            spaced = bool(gap) and any(map(str.isspace, gap[0]))
            char = text[on]
            if not spaced and (char.islower() or char.isdigit() and text[end - 1].isascii() or char in ".,;:-–—%/_*'’\"»”)]"):
                continue
            left, left2, left3 = self._before(text, start, end, quotes)
            right, right2 = self._after(text, on)
            self.at.append((end, on))
            self.left.append(left)
            self.left2.append(left2)
            self.left3.append(left3)
            self.right.append(right)
            self.right2.append(right2)
            far = end - last
            self.near.append("0" if far < 4 else "1" if far < 10 else "2" if far < 20 else "3" if far < 40 else "4")
            self.spaced.append(spaced or bool(_cjk.match(char)) or text[end - 1] in "。！？」』”")
            last = end
        else:
            tail = text.rstrip()
            self.ending = self._before(text, len(tail), len(tail), quotes)

    @staticmethod
    def _before(text: str, start: int, end: int, quotes: list) -> tuple[str, str, str]:
        mark = _unseen.sub("", text[start:end])
        state = "-"
        for a, b, initial in quotes:
            if a < end < b:
                state = "in"
                break
            if start < b <= end + 1 or start == end == b:
                state = "i" if initial else "e"
        ahead = text[max(0, start - 30) : start].rsplit(None, 2)
        word = _inner.split(ahead[-1])[-1] if ahead else ""
        if len(ahead) > 1 and (word.isdigit() or len(word) == 1) and len(ahead[-2]) < 5 and ahead[-2].islower():
            # A number or a letter says little alone; a short word before it, like that of a page or an hour, is part of the context.
            word = f"{ahead[-2][-8:]} {word}"
        known = _lefts.get(word)
        if known is None:
            if len(_lefts) > 200_000:
                _lefts.clear()
            known = _lefts[word] = _left(word)
        own, shape, thai = known
        if thai:
            own = _digits.sub("0", "".join(text[max(0, start - 12) : start].split()))[-4:]
            shape = own[-3:]
        mark3 = mark[:2] + state
        return own + mark + state, shape + mark + state, mark3

    @staticmethod
    def _after(text: str, on: int) -> tuple[str, str]:
        ahead = text[on : on + 30]
        opener = ""
        k = 0
        while k < len(ahead) and not ahead[k].isalnum() and k < 4:
            opener += ahead[k]
            k += 1
        char = ahead[k] if k < len(ahead) else ""
        kind = opener.strip()[:2] + (_kind(char) if char else "")
        if char and (_thai.match(char) or _cjk.match(char)):
            return opener.strip()[:1] + ahead[k : k + (4 if _thai.match(char) else 2)], kind
        word = _first.match(ahead, k)
        own = word[0] if word else _digits.sub("0", ahead[k : k + 6])
        if not own.isascii():
            own = consistent(own) or ""
        return opener.strip()[:1] + own[:12], kind


def bare_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text without its marks, characters where it is in Chinese or Japanese, and where each begins and ends."""
    places = [(m.start(), m.end()) for m in _bare.finditer(text)]
    return [text[a:b].lower() for a, b in places], places


def bare_training(words: list[str], out: Counter[str]) -> None:
    """Counts, over a sentence without marks, of what stands before and after a gap within it, and at its ends."""
    if not words:
        return
    pairs = list(map("".join, zip(words, words[1:]))) if _cjk.match(words[0]) else words
    out.update([f"x|{w}" for w in pairs])
    out["e|" + (pairs[-1] if pairs else words[-1])] += 1
    out["f|" + (pairs[0] if pairs else words[0])] += 1
    out["n|b"] += 1
    out["n|g"] += len(words) - 1


def training(texts: Iterator[str]) -> Counter[str]:
    """Counts over rows that are one sentence each."""
    out: Counter[str] = Counter()
    for text in texts:
        text = text.strip()
        if not text:
            continue
        own = Events(text)
        if not _thai.search(text):
            bare_training(bare_words(text)[0], out)
        out["n|B"] += 1
        for k, value in enumerate(own.ending):
            out[f"B{k}|{value}"] += 1
        right, right2 = Events._after(text, 0)
        out["s|" + right] += 1
        out["z|" + right2] += 1
        before = "B"
        for k in range(len(own.at)):
            out["n|N"] += 1
            for j, value in enumerate((own.left[k], own.left2[k], own.left3[k])):
                out[f"N{j}|{value}"] += 1
            out["m|" + own.right[k]] += 1
            out["w|" + own.right2[k]] += 1
            out[f"t|{before}{own.near[k]}N"] += 1
            before = "N"
        far = len(text) - (own.at[-1][0] if own.at else 0)
        near = "0" if far < 4 else "1" if far < 10 else "2" if far < 20 else "3" if far < 40 else "4"
        out[f"t|{before}{near}B"] += 1
    return out


class Model:
    """The hidden-event model from its counts."""

    def __init__(self, counts: dict[str, int]):
        self.n = counts
        self.starts, self.mids = max(1, counts.get("n|B", 0)), max(1, counts.get("n|N", 0))
        self.prior = self.starts / (self.starts + self.mids)
        self.memo: dict[tuple, float] = {}
        self.move: dict[str, dict[str, tuple[float, float]]] = {}
        for before in "BN":
            self.move[before] = {}
            for near in "01234":
                b, n = counts.get(f"t|{before}{near}B", 0), counts.get(f"t|{before}{near}N", 0)
                p = (b + 4 * self.prior) / (b + n + 4)
                self.move[before][near] = (p / self.prior, (1 - p) / (1 - self.prior))

    def evidence(self, left: str, left2: str, left3: str, right: str, right2: str, spaced: bool) -> float:
        """Log-odds of a boundary from the n-grams around an event."""
        key = (left, left2, left3, right, right2, spaced)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            n = self.n.get
            p = self.prior
            for level, context in ((2, left3), (1, left2), (0, left)):
                b, no = n(f"B{level}|{context}", 0), n(f"N{level}|{context}", 0)
                p = (b + BACKOFF * p) / (b + no + BACKOFF)
            s, m = n("s|" + right, 0), n("m|" + right, 0) * self.starts / self.mids
            q = ((n("z|" + right2, 0) + 0.5) / (self.starts + 1)) / ((n("w|" + right2, 0) + 0.5) / (self.mids + 1))
            ratio = (s + BACKOFF * q / (1 + q)) / (m + BACKOFF / (1 + q))
            known = math.log(max(p, 1e-9) / max(1 - p, 1e-9)) + math.log(ratio) + (0.0 if spaced else math.log(NO_SPACE))
            self.memo[key] = known
        return known

    def posteriors(self, own: Events) -> list[float]:
        """Probability of a boundary at each event, by forward-backward."""
        odds = [self.evidence(*x) for x in zip(own.left, own.left2, own.left3, own.right, own.right2, own.spaced)]
        local = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in odds]
        forward = []
        b, n = 1.0, 0.0
        for p, near in zip(local, own.near):
            (bb, bn), (nb, nn) = self.move["B"][near], self.move["N"][near]
            b, n = (b * bb + n * nb) * p, (b * bn + n * nn) * (1 - p)
            total = b + n or 1.0
            b, n = b / total, n / total
            forward.append((b, n))
        out = [0.0] * len(local)
        back_b = back_n = 1.0
        for k in range(len(local) - 1, -1, -1):
            b, n = forward[k][0] * back_b, forward[k][1] * back_n
            out[k] = b / (b + n) if b + n else local[k]
            (bb, bn), (nb, nn) = self.move["B"][own.near[k]], self.move["N"][own.near[k]]
            p = local[k]
            back_b, back_n = bb * p * back_b + bn * (1 - p) * back_n, nb * p * back_b + nn * (1 - p) * back_n
            total = back_b + back_n or 1.0
            back_b, back_n = back_b / total, back_n / total
        return out

    def bare_cuts(self, text: str) -> list[tuple[int, int]]:
        """Boundaries (end, start of the next) of a text without marks, by forward-backward over the gaps between its words.

        A gap after a boundary cannot be one at once: a sentence has two words or more.
        """
        words, places = bare_words(text)
        sentences_n, gaps = self.n.get("n|b", 0), self.n.get("n|g", 0)
        if len(words) < 4 or not sentences_n or not gaps:
            return []
        n, total = self.n.get, sentences_n + gaps
        units = list(map("".join, zip(words, words[1:]))) if _cjk.match(words[0]) else None
        local = []
        for k in range(len(words) - 1):
            # The characters before the gap and those after it; a context that is rare says little.
            left = units[k - 1] if units and k else words[k]
            right = units[k + 1] if units and k + 1 < len(units) else words[k + 1]
            odds = math.log(sentences_n / gaps)
            for end, context in (("e|", left), ("f|", right)):
                inner = max(0, n("x|" + context, 0) - n("e|" + context, 0) - n("f|" + context, 0)) if units is None else n("x|" + context, 0)
                odds += math.log((n(end + context, 0) / sentences_n + 0.5 / total) / (inner / total + 0.5 / total))
            local.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        forward, b, m = [], 0.0, 1.0
        for p in local:
            b, m = m * p, b + m * (1 - p)
            b, m = b / (b + m), m / (b + m)
            forward.append((b, m))
        out, back_b, back_m = [], 1.0, 1.0
        for k in range(len(local) - 1, -1, -1):
            b, m = forward[k][0] * back_b, forward[k][1] * back_m
            if b / (b + m) > POSTERIOR:
                out.append((places[k][1], places[k + 1][0]))
            p = local[k]
            back_b, back_m = back_m, p * back_b + (1 - p) * back_m
            total_b = back_b + back_m
            back_b, back_m = back_b / total_b, back_m / total_b
        return out[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each sentence, from its first visible character to after its last."""
        own = Events(text)
        cuts = [at for at, p in zip(own.at, self.posteriors(own)) if p > POSTERIOR] if own.at else []
        if not cuts and not _mark.search(text) and not _thai.search(text):
            cuts = self.bare_cuts(text)
        out, start = [], 0
        for end, on in [*cuts, (len(text), len(text))]:
            a, b = start, end
            while a < b and (text[a].isspace() or _unseen.match(text[a])):
                a += 1
            while b > a and (text[b - 1].isspace() or _unseen.match(text[b - 1])):
                b -= 1
            if a < b:
                out.append((a, b))
            start = on
        return out


def model(segments: DataFrame) -> Model:
    """The model of the rows that are one sentence each: those that are not the first of their paragraph."""
    rows = segments.filter((F.col("sentence_index") > 0) & F.col("type").isin("paragraph", "blockquote") & F.col("text").isNotNull()).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = training(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["key", "n"])

    counts = rows.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    events = F.sum(F.when(F.col("key").startswith("n|"), F.col("n")))
    counts = counts.persist()
    total = counts.agg(events).first()[0] or 0
    # An event has six contexts and two counts, a gap of a bare text one; no more of them can have this share.
    kept = checked_broadcast_rows(counts.filter(F.col("n") >= SHARE * total), int(8 / SHARE), "the list of contexts")
    counts.unpersist()
    return Model({r.key: r.n for r in kept})


def found(segments: DataFrame, lexicon: DataFrame, prose_only: bool = True) -> DataFrame:
    """Distinct (seg_uid, start_char, end_char) of the sentences of paragraphs and blockquotes, of natural prose only or of all."""
    spark = segments.sparkSession
    shared = spark.sparkContext.broadcast((model(segments), quality.common_words(lexicon)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, common = shared.value
        for batch in batches:
            at, starts, ends = [], [], []
            texts = batch.column(1).to_pylist()
            wholes = quality.covered(texts) if prose_only else [False] * len(texts)
            for k, (text, whole) in enumerate(zip(texts, wholes)):
                if not text or text.isspace() or (prose_only and quality.no_prose(text, common, whole)):
                    continue
                for a, b in own.spans(text):
                    at.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["seg_uid", "start_char", "end_char"])

    rows = segments.filter(F.col("type").isin("paragraph", "blockquote") & F.col("text").isNotNull()).select("seg_uid", "text")
    return rows.mapInArrow(run, "seg_uid long, start_char int, end_char int").distinct()


def sentence_rows(segments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(seg_uid, sentence_index, text): the sentences of every paragraph and blockquote in order, each with its place within the segment from 0.

    Segments that are no natural prose come out as well, cut by the same model.
    """
    from pyspark.sql import Window as W

    spans = found(segments, lexicon, prose_only=False).join(segments.select("seg_uid", "text").dropDuplicates(["seg_uid"]), "seg_uid")
    place = F.row_number().over(W.partitionBy("seg_uid").orderBy("start_char")) - 1
    return spans.select("seg_uid", place.alias("sentence_index"), F.substr("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")).alias("text"))

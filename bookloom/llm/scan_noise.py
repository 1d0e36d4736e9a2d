"""Problem 7: repairing text that comes from scanned pages.

A noisy channel: a printed word is what was meant, passed through character
confusions of known probability. Each word of a line has its candidates, itself
and what a misreading could have made of it, with the probability of the
misreading and of the word: by word counts where it is a common one, by
character n-grams where it is not (names). Viterbi over the line weighs the
candidates with the counts of word pairs. A word with marks, digits or unread
letters is decoded by Viterbi over its characters and has to be likelier than
the signs as they stand, which no letters predict; a corpus that says nothing
changes nothing. How the confusions share the misreadings among them is
estimated from the corpus: words that one confusion away are a far more
frequent word. Breaks at line ends are judged by the same counts: the two
halves are joined unless the corpus writes the word with its hyphen. Page
numbers and running heads are found by their form, by the title, and by the
sentence that they interrupt.

Only texts set in lines of a page are read this way: those where lines go on in
the next one. The counts cover all texts. What goes to every worker is bounded
by the pigeonhole: words with at least ``SHARE`` of all words are at most
1/SHARE, whatever the corpus, and so are pairs and n-grams.

Defined cases: null, empty and one-line texts have no rows; repeated rows count
once; null titles are no title; a last line's break is no case; of a word with
more than ``UNREAD`` unread letters too little is left to know what was meant.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.lookalike import consistent
from bookloom.llm.repeated_lines import identifier, named
from bookloom.session import checked_broadcast_rows, written

#: Words, and character n-grams of each length, of at least this share of all are known to every worker; at most 1/share of them.
SHARE, GRAM_SHARE = 2e-6, 2e-6
#: Pairs of words of at least this share of all are known.
PAIR_SHARE = 4e-6
#: Words that are counted together before the counts are passed on.
AT_ONCE = 4_000_000
#: Longest character n-gram, and the weight of the shorter ones where a longer one is rare.
LONGEST, BACKOFF = 5, 2.0
#: Characters that are told apart where nothing is known of them.
ALPHABET = 40
#: How much likelier (in nats) another reading must be.
MARGIN = 2.5
#: Probability that a letter is misread at all.
RATE = 3e-3
#: Probability that a word with a mark or a digit in it is meant so.
MEANT = 0.5
#: Most that the word before can say against and for a word (in nats).
AGAINST, FOR = -1.0, 4.0
#: Unread letters that a word may have and still be spelled out where it is no known word.
UNREAD = 1
#: How much more frequent a word must be for a rare one to count as its misreading, and how often the given parts of confusions count as seen.
RARER, SEEN = 50, 200.0

# Printed character, and the letters it can stand for with their part of the rate; marks that scanners put into words.
STANDS_FOR = {
    "c": {"e": 0.5}, "f": {"t": 0.5}, "y": {"v": 0.2}, "0": {"o": 1.0}, "1": {"l": 1.0, "i": 0.3}, "5": {"s": 1.0}, "6": {"b": 1.0}, "9": {"g": 1.0},
    "@": {"a": 1.0}, "!": {"i": 1.0, "l": 0.3}, "8": {"b": 0.5}, "q": {"o": 0.02}, "�": {},
}
_digits = str.maketrans("lIOo", "1100")
#: Letters that are read as two: (printed, meant, part of the rate).
DOUBLE = (("rn", "m", 0.3), ("ri", "n", 0.3), ("ii", "u", 0.3), ("li", "h", 0.3), ("cl", "d", 0.3), ("vv", "w", 0.3), ("m", "rn", 0.1))
#: All confusions: (printed, meant) with the part of the rate.
GIVEN = {(c, meant): p for c, ways in STANDS_FOR.items() for meant, p in ways.items()} | {(a, b): p for a, b, p in DOUBLE}
#: Part of the words that no count knows.
UNKNOWN = 0.1
INSERTED = "°^_|~'"

_word = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏЀ-ԯ]+(?:-[A-Za-zÀ-ÖØ-öø-ɏЀ-ԯ]+)*|[؀-ًؿ-ٟٮ-ۓ]+|[ऀ-ॣॱ-ॿ]+")
#: The same for texts without Arabic and Devanagari letters, which are quicker to read with one kind of word.
_word_of_two = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏЀ-ԯ]+(?:-[A-Za-zÀ-ÖØ-öø-ɏЀ-ԯ]+)*")
_of_others = re.compile("[؀-ۿऀ-ॿ]")
_letters = "A-Za-zÀ-ÖØ-öø-ɏЀ-ԯؠ-ًؿ-ٟٮ-ۓऀ-ॣॱ-ॿ"
_only_letters = re.compile(f"[{_letters}]+")
_any_letter = re.compile(f"[{_letters}]")
_printed = re.compile(rf"[{_letters}0-9°^_|~'@!�]*[{_letters}][{_letters}0-9°^_|~'@!�]*")
_odd = re.compile(rf"[°^_|~'@!�](?=[{_letters}])|(?<=[{_letters}])[0-9°^_|~@�]|[0-9](?=[{_letters}])")
_contraction = re.compile(rf"[{_letters}]+'(?:s|t|d|m|ll|re|ve)|(?:[ldcnsjmto]|qu)'[{_letters}]+", re.I)
_ordinal = re.compile(r"\d+(?:st|nd|rd|th|e|er|re|ème|a|o|s|m|km|d|h|p|am|pm|in|ft)", re.I)
_breaks = re.compile(rf"([{_letters}؀-ۿऀ-ॿ]+)([-‐‑­¬])[ \t\r]*$")
_break_marks = frozenset("-‐‑­¬")
_starts = re.compile(rf"\s*([{_letters}؀-ۿऀ-ॿ]+)")
_number = re.compile(r"\s*[-–—\[(|*·.]*\s*(?:(?:page|p\.|seite|s\.|стр\.|página|pág\.|folio|پ|صفحة|पृष्ठ)\s*)?(?:\d{1,4}|[ivxlc]{1,7})\s*[-–—\])|*·.]*\s*", re.I)
_roman = re.compile(r"(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_end = re.compile(r"[.!?…。！？।؟:;]['\"”’»」』)\]]*\s*$")
_numbered = re.compile(r"^\W*(?:\d{1,4}|[ivxl]{1,6})\s+\S|\S\s+\W*(?:\d{1,4}|[ivxl]{1,6})\W*$", re.I)
_mixed = re.compile(r"[^\W\d_]\d|\d[^\W\d_]")
_sign = re.compile(r"[□¤§¿¾½¼µ¶º¹²³¸´¯¢£¥¦¨ª±×÷|~^_;:!�°'{}<>=+*#/\\·]")
_decoration = re.compile(r"\s+[.|*·–—-]+\s*$")
_letter_runs = re.compile(r"[^\W\d_]+")


_spaced = re.compile(r"(?<=[0-9ivxlcIO])[ \t]+(?=[0-9ivxlcIO])")
_misread_number = re.compile(r"(?<![^\W\d_])[lIOo0-9]{2,4}(?![^\W\d_])")


#: A line of any length with as many letters and digits as a page number can have.
_few = re.compile(r"[\W_]*(?:[^\W_][\W_]*){1,14}")


def is_number(line: str) -> bool:
    """Whether a line is only the number of a page, its digits spaced or misread for all that."""
    if len(line) > 24 and not _few.fullmatch(line):
        return False
    line = _spaced.sub("", line.strip())
    if 1 < len(line) < 4 and set(line) <= {"l", "I", "O"} and not _roman.fullmatch(line):
        return True
    line = _misread_number.sub(lambda m: m[0].translate(_digits) if any(map(str.isdigit, m[0])) else m[0], line)
    if not _number.fullmatch(line):
        return False
    digits = re.search(r"\d+", line)
    own = re.search(r"([ivxlc]+)\W*$", line, re.I)
    return bool(digits) or bool(own and _roman.fullmatch(own[1]))


def _tally(numbers: dict[str, int], row: array) -> tuple[list[str], np.ndarray]:
    """Words and pairs with their counts, from the words' numbers in their order; -1 stands between texts."""
    places = np.frombuffer(row, np.int64)
    left, right = places[:-1], places[1:]
    both, n = np.unique((left << 32 | right)[(left >= 0) & (right >= 0)], return_counts=True)
    words = list(numbers)
    pairs = [f"{words[a]} {words[b]}" for a, b in zip((both >> 32).tolist(), (both & 0xFFFFFFFF).tolist())]
    return words + pairs, np.concatenate([np.bincount(places[places >= 0]), n])


def counted(texts: list[str], at_once: int = AT_ONCE) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words, and pairs of neighbours with a space between, with their counts; several times if there are more than ``at_once`` words."""
    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    row = array("q")
    for text in texts:
        text = text.lower()
        row.extend(map(numbers.__getitem__, (_word if _of_others.search(text) else _word_of_two).findall(text)))
        row.append(-1)
        if numbers and len(row) > at_once:
            yield _tally(numbers, row)
            numbers, row = defaultdict(count().__next__), array("q")
    if numbers:
        yield _tally(numbers, row)


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of words, and of pairs of neighbours with a space between, over all texts, counted within each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in counted(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return texts.select(text).filter(F.col(text).isNotNull()).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _script(letter: str) -> int:
    """A letter's block; all Latin ones are one."""
    return 0 if letter < "ɐ" else ord(letter) >> 8


class Model:
    """Counts of words, pairs and character n-grams, and the parts of the confusions; small enough for every worker."""

    def __init__(self, total: int, words: dict[str, int], grams: dict[str, int], pairs: dict[str, int] | None = None, parts: dict[tuple[str, str], float] | None = None):
        self.total, self.words, self.grams, self.pairs = max(1, total), words, grams, pairs or {}
        heads: Counter[str] = Counter()
        for gram, n in grams.items():
            heads[gram[:-1]] += n
        self.heads = dict(heads)
        self.parts = GIVEN if parts is None else parts
        self.single = {c: [(meant, p) for (printed, meant), p in self.parts.items() if printed == c] for c, _ in self.parts if len(c) == 1}
        self.double = [(printed, meant, p) for (printed, meant), p in self.parts.items() if len(printed) > 1]
        self.memo: dict[str, list[tuple[str, float]]] = {}
        self.alone: set[str] = set()
        self.logs: dict[str, float] = {}
        self.letters: dict[int, str] | None = None
        self.by_length: dict[int, list[str]] | None = None

    def gram(self, before: str, char: str) -> float:
        """Probability of a character after at most four others, longer contexts weighed against shorter ones."""
        p = 1 / ALPHABET
        for n in range(min(LONGEST - 1, len(before)), 0, -1):
            if before[-n:] in self.heads:
                break
        else:
            n = 1
        for k in range(1, n + 1):
            context = before[-k:]
            p = (self.grams.get(context + char, 0) + BACKOFF * p) / (self.heads.get(context, 0) + BACKOFF)
        return p

    def span(self, padded: str, start: int, end: int) -> float:
        """Log-probability of the characters from ``start`` to ``end`` of a padded word."""
        return sum(self.log(padded[max(0, k - LONGEST + 1) : k], padded[k]) for k in range(start, min(end, len(padded))))

    def log(self, before: str, char: str) -> float:
        """Log-probability of a character after others, remembered."""
        known = self.logs.get(before + char)
        if known is None:
            if len(self.logs) > 500_000:
                self.logs.clear()
            known = self.logs[before + char] = math.log(self.gram(before, char))
        return known

    def spelled(self, word: str) -> float:
        padded = "^^^^" + word + "$"
        return self.span(padded, 4, len(padded))

    def _alphabet(self, printed: str) -> str:
        """The letters that an unread one can be: those of the scripts that the word has."""
        if self.letters is None:
            held: dict[int, set[str]] = {}
            for word in self.words:
                for c in word:
                    if c.isalnum():
                        held.setdefault(_script(c), set()).add(c)
            self.letters = {script: "".join(sorted(letters)) for script, letters in held.items()}
        scripts = {_script(c) for c in printed if c.isalpha()}
        return "".join(self.letters.get(script, "") for script in sorted(scripts))

    def _options(self, char: str, alphabet: str) -> list[tuple[str, float]]:
        """What a printed character can stand for, with the log-probability of being printed so; '' for a mark that was put in."""
        if char == "�":
            return [(c, math.log(RATE / 20)) for c in alphabet]
        if char in INSERTED:
            return [("", math.log(RATE))]
        own = [(char, math.log(1 - RATE))] if _only_letters.match(char) else []
        return own + [(c, math.log(RATE * p)) for c, p in self.single.get(char, ())]

    def decode(self, printed: str) -> tuple[str, float]:
        """The likeliest letters behind a printed word and their log-probability, by Viterbi over the last letters; none is ('', -inf)."""
        alphabet = self._alphabet(printed) if "�" in printed else ""
        paths: dict[str, tuple[float, str]] = {"^" * (LONGEST - 1): (0.0, "")}
        for char in printed:
            new: dict[str, tuple[float, str]] = {}
            for c, cost in self._options(char, alphabet):
                for state, (score, path) in paths.items():
                    at = (state + c)[-(LONGEST - 1) :] if c else state
                    value = score + cost + (self.log(state, c) if c else 0.0)
                    if at not in new or value > new[at][0]:
                        new[at] = (value, path + c)
            paths = new
        score, path = max(((s + self.log(k, "$"), p) for k, (s, p) in paths.items()), default=(-math.inf, ""))
        return path, score

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """A word and what may be behind it, each with its log-probability together with that of being printed so; itself first.

        Being itself has ``MARGIN`` added, so that another reading has to be clearly likelier.
        """
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = self.memo[word] = self._of_letters(word) if _only_letters.fullmatch(word) else self._of_signs(word)
        return known

    def undoubted(self, printed: list[str]) -> bool:
        """Whether each of the printed words is its own only candidate or not asked for, so that no reading changes any; words that are so are remembered."""
        if self.alone.issuperset(printed):
            return True
        for word in printed:
            if word not in self.alone:
                core = word.strip("'!_")
                if asked_as(core, self) in ("letters", "signs"):
                    lower = core.lower()
                    if len(lower) > 2 and len(self.candidates(lower)) > 1:
                        return False
                if len(self.alone) > 200_000:
                    self.alone.clear()
                self.alone.add(word)
        return True

    def _of_letters(self, word: str) -> list[tuple[str, float]]:
        seen = self.words.get(word, 0)
        own = math.log(seen / self.total) if seen else None
        out: dict[str, float] = {}
        padded = "^^^^" + word + "$"
        for at, printed, letters, part in self._misreadings(word):
            other = word[:at] + letters + word[at + len(printed) :]
            n = self.words.get(other, 0)
            if not n and seen:
                continue
            if own is None:
                own = math.log(UNKNOWN) + self.spelled(word)
            if n:
                score = math.log(n / self.total)
            else:
                changed = "^^^^" + other + "$"
                score = own + self.span(changed, at + 4, at + len(letters) + 8) - self.span(padded, at + 4, at + len(printed) + 8)
            score += math.log(RATE * part)
            if score > out.get(other, -math.inf):
                out[other] = score
        return [(word, (own or 0.0) + MARGIN), *[(other, score) for other, score in out.items() if score > own + MARGIN + AGAINST - FOR]]

    def _of_signs(self, word: str) -> list[tuple[str, float]]:
        # Signs that no letters predict: each is any of the alphabet.
        itself = math.log(MEANT) - math.log(ALPHABET) * (len(word) + 1)
        out = {}
        unread = word.count("�")
        cost = (sum(not _only_letters.match(c) for c in word) - unread) * math.log(RATE) + unread * math.log(RATE / 20)
        for other in self._one_off(word):
            n = self.words.get(other, 0)
            if n:
                out[other] = math.log(n / self.total) + cost
        # Letters are put together only where no known word is behind it.
        path, score = self.decode(word) if not out and unread <= UNREAD else ("", 0.0)
        if path:
            out[path] = math.log(UNKNOWN) + score
        return [(word, itself), *out.items()]

    def _misreadings(self, word: str) -> Iterator[tuple[int, str, str, float]]:
        """(place, printed, meant, part of the rate) of what one misreading could have made of a word of letters."""
        for k, char in enumerate(word):
            for c, p in self.single.get(char, ()):
                yield k, char, c, p
        for printed, meant, p in self.double:
            at = word.find(printed)
            while at >= 0:
                yield at, printed, meant, p
                at = word.find(printed, at + 1)

    def _one_off(self, word: str) -> Iterator[str]:
        """Known words behind one with marks, digits or unread letters; those with unread letters are met by their length and other letters."""
        options = [[c for c, _ in self.single.get(char, ())] if not _only_letters.match(char) else [char] for char in word if char not in INSERTED and char != "�"]
        if "�" not in word:
            yield from map("".join, product(*options))
            return
        if self.by_length is None:
            self.by_length = {}
            for known in self.words:
                self.by_length.setdefault(len(known), []).append(known)
        rest = iter(options)
        parts = [r"[^\W\d_]" if char == "�" else f"[{''.join(map(re.escape, next(rest)))}]" for char in word if char not in INSERTED]
        if "[]" not in parts:
            fits = re.compile("".join(parts)).fullmatch
            yield from filter(fits, self.by_length.get(len(parts), ()))

    def beside(self, before: str, word: str) -> float:
        """What the word before says for a word, against its own count; nothing where either is rare."""
        first, own = self.words.get(before, 0), self.words.get(word, 0)
        if not first or not own:
            return 0.0
        expected = first * own / self.total
        return max(AGAINST, min(FOR, math.log((self.pairs.get(f"{before} {word}", 0) + 1.0) / (expected + 1.0))))

    def readings(self, words: list[str]) -> list[str | None]:
        """For each word of a line what was meant, or None if it is as printed: Viterbi over the candidates of all."""
        lower = [w.lower() for w in words]
        options = [self.candidates(w) if len(w) > 2 else [(w, 0.0)] for w in lower]
        if all(len(o) == 1 for o in options):
            return [None] * len(words)
        paths = [(score, [c]) for c, score in options[0]]
        for own in options[1:]:
            if len(own) == 1 and len(paths) == 1:
                paths[0][1].append(own[0][0])
                continue
            new = []
            for c, score in own:
                value, path = max(((s + self.beside(p[-1], c), p) for s, p in paths), key=lambda x: x[0])
                new.append((value + score, [*path, c]))
            paths = new
        best = max(paths, key=lambda x: x[0])[1]
        return [c if c != w else None for c, w in zip(best, lower)]


def estimated(counts: DataFrame, own: Model) -> dict[tuple[str, str], float]:
    """The parts that the confusions of letters have in all misreadings, from words that one confusion away are ``RARER`` times as frequent.

    A word with several such ways is shared out among them by their given parts; the given parts count as ``SEEN`` misreadings.
    """
    shared = counts.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            sums: Counter[str] = Counter()
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ways = []
                for at, printed, letters, part in model._misreadings(word):
                    other = model.words.get(word[:at] + letters + word[at + len(printed) :], 0)
                    if other > RARER * n:
                        ways.append((printed, letters, part * other))
                total = sum(w for _, _, w in ways)
                for printed, letters, w in ways:
                    sums[f"{printed} {letters}"] += n * w / total
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], names=["way", "n"])

    rows = counts.mapInArrow(run, "way string, n double").groupBy("way").agg(F.sum("n").alias("n"))
    seen = {tuple(r.way.split(" ")): r.n for r in checked_broadcast_rows(rows, len(GIVEN), "the list of confusions")}
    # How often a letter is meant decides how often it can be misread: parts are of the misreadings of that letter.
    meant = Counter()
    for word, n in own.words.items():
        for (_, letters), part in GIVEN.items():
            if letters in word:
                meant[letters] += n * word.count(letters)
    ways = [w for w in GIVEN if w[0].isalpha() and meant[w[1]]]
    mass = sum(GIVEN[w] * meant[w[1]] for w in ways)
    held = sum(seen.get(w, 0.0) for w in ways)
    out = dict(GIVEN)
    for w in ways:
        given = GIVEN[w] * meant[w[1]] / mass
        share = (seen.get(w, 0.0) + SEEN * given) / (held + SEEN)
        out[w] = max(1e-3, min(1.0, share * mass / meant[w[1]]))
    return out


def model(texts: DataFrame, text: str = "text") -> Model:
    """The counts of a corpus, and the parts of the confusions in it."""
    both = written(word_counts(texts, text), "words")
    counts, pairs = both.filter(~F.col("word").contains(" ")), both.filter(F.col("word").contains(" "))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = checked_broadcast_rows(counts.filter(F.col("n") >= max(3, SHARE * total)), int(1 / SHARE) + 1, "the list of common words")
    often = checked_broadcast_rows(pairs.filter(F.col("n") >= max(2, PAIR_SHARE * total)), int(1 / PAIR_SHARE) + 1, "the list of common pairs")
    # A type counts for at most 20, so that names weigh against the few words that make up most of a text.
    types = counts.filter(~F.col("word").contains("-")).select(F.least("n", F.lit(20)).alias("n"), F.concat(F.lit("^^^^"), "word", F.lit("$")).alias("p"))
    ends = F.sequence(F.lit(5), F.length("p"))
    cut = F.flatten(F.transform(ends, lambda k: F.transform(F.sequence(F.lit(2), F.lit(LONGEST)), lambda n: F.substr("p", k - n + 1, n))))
    grams = types.select("n", F.explode(cut).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))
    mass = types.agg(F.sum(F.col("n") * (F.length("p") - 4))).first()[0] or 0
    most = checked_broadcast_rows(grams.filter(F.col("n") >= max(1, GRAM_SHARE * mass)), int((LONGEST - 1) / GRAM_SHARE) + 1, "the list of n-grams")
    words, letters, beside = {r.word: r.n for r in rows}, {r.gram: r.n for r in most}, {r.word: r.n for r in often}
    return Model(total, words, letters, beside, estimated(counts, Model(total, words, {})))


def set_in_lines(lines: list[str]) -> bool:
    """Whether a text is set in the lines of a page: lines go on in the next one."""
    on = off = 0
    for a, b in zip(lines, lines[1:]):
        a, b = a.rstrip(), b.lstrip()
        if a and b:
            if not _end.search(a) and (b[0].islower() or a[-1] in "-‐‑­¬,"):
                on += 1
            else:
                off += 1
    return on >= 1 and on * 4 >= off


def is_strange(line: str) -> bool:
    """Whether a line has too many signs that no text has to be one."""
    shown = len(line) - line.count(" ")
    signs = len(_sign.findall(line))
    letters = sum(map(str.isalpha, line))
    return signs > 2 and signs > 0.08 * shown or letters + sum(map(str.isdigit, line)) < 0.6 * shown


def _title_like(line: str, width: float) -> bool:
    """A heading by its form: no end of a sentence, shorter than the lines of text, capitals, spaced letters or a middle dot."""
    words = _letter_runs.findall(line)
    if len(words) < 2:
        return False
    spaced = list(map(len, words)).count(1) * 2 > len(words)
    small = {"a", "an", "the", "of", "at", "and", "or", "in", "on", "for", "to"}
    capitals = words[0][0].isupper() and all(w[0].isupper() or w in small for w in words) and sum(w[0].isupper() for w in words) >= 2
    # What is cut off below holds no letters, so most lines are told by their words.
    if not (capitals or spaced or "·" in line or "・" in line or line.isupper()):
        return False
    bare = _decoration.sub("", line.strip())
    if not bare or _end.search(bare) or bare.endswith(("-", ",", "¬")) or is_strange(bare) or "\t" in bare or "..." in bare:
        return False
    if _mixed.search(bare):
        return False
    if not spaced and len(bare) > width * 0.95:
        return False
    return capitals or spaced or "·" in bare or "・" in bare or (bare.isupper() and len(bare) > 4)


def noise(text: str, title: str | None, own: Model) -> list[tuple[int, str]]:
    """(line_no, kind) of a text."""
    raw = text.split("\n")
    if len(raw) < 2 or not set_in_lines(raw):
        return []
    lines = raw if text.isascii() else consistent(text).split("\n")
    if len(lines) != len(raw):
        lines = raw
    out: list[tuple[int, str]] = []
    shown = [k for k, line in enumerate(lines) if line.strip()]
    lengths = sorted(len(lines[k].rstrip()) for k in shown)
    width = lengths[int(len(lengths) * 0.8)] if lengths else 0
    numbers = {k for k in shown if is_number(lines[k]) or lines is not raw and is_number(raw[k])}
    name = identifier(title) if title else None
    heads: set[int] = set()
    asked = [k for k in shown if k not in numbers and len(lines[k]) < 1.6 * width + 20]
    again: Counter[str | None] | None = None
    titles = {k for k in asked if _title_like(lines[k], width)}
    named_so = {asked[j] for j in named([lines[k] for k in asked], name)} if name else set()
    # The text has begun once a line has gone on in the next; a title above that is no running head.
    begun = next((at + 1 for at, (j, k) in enumerate(zip(shown, shown[1:])) if lines[k].lstrip()[:1].islower() and len(lines[j].rstrip()) > 0.6 * width and not _end.search(lines[j])), len(shown)) if titles or named_so else 0
    for at, k in enumerate(shown) if titles or named_so else ():
        if at == 0 or at == len(shown) - 1 or k not in titles and k not in named_so:
            continue
        line = lines[k]
        before = next((lines[j] for j in reversed(shown[:at]) if j not in numbers), "")
        after = next((lines[j] for j in shown[at + 1 :] if j not in numbers), "")
        cut = bool(before) and not _end.search(before)
        goes_on = after.lstrip()[:1].islower()
        near = shown[at - 1] in numbers or shown[at + 1] in numbers
        if k in named_so:
            if at > begun or near or cut and at > 3 or goes_on:
                heads.add(k)
            continue
        numbered = bool(_numbered.search(line))
        listed = shown[at - 1] in titles and shown[at + 1] in titles
        if cut and goes_on or at > begun and (near or numbered or not listed) or at > 3 and near and (cut or goes_on):
            heads.add(k)
        elif at > begun:
            if again is None:
                again = Counter(identifier(lines[j]) for j in asked)
            if again[identifier(line)] > 1:
                heads.add(k)
    for k in heads:
        out.append((k, "running_head"))
    for k in numbers:
        if k != shown[0] or len(shown) > 3:
            out.append((k, "page_number"))
    body = [k for k in shown if k not in numbers and k not in heads]
    after_break = False
    for at, k in enumerate(body):
        line, on = lines[k], None
        shown_end = raw[k].rstrip(" \t\r")
        broken = _breaks.search(shown_end) if shown_end[-1:] in _break_marks else None
        if broken and at + 1 < len(body):
            on = _starts.match(lines[body[at + 1]])
            if on:
                left, right = broken[1].lower(), on[1].lower()
                left = consistent(left)
                if broken[2] in "­¬" or own.words.get(f"{left}-{right}", 0) <= own.words.get(left + right, 0):
                    out.append((k, "broken_word"))
                else:
                    on = None
        # Halves of a broken word are no words; they are judged together.
        whole = broken[1] + starts if (starts := on[1] if broken and on else "") else ""
        shown_part = line[: len(line.rstrip()) - len(broken[1]) - 1] if whole else line
        if after_break:
            shown_part = _starts.sub("", shown_part, count=1)
        after_break = bool(whole)
        if misread(shown_part, own, whole, line):
            out.append((k, "misread"))
    return out


def contraction(word: str, own: Model) -> bool:
    """Whether a word with an apostrophe is two words run together, and not one with a mark in it."""
    if not _contraction.fullmatch(word):
        return False
    base = max(word.lower().split("'"), key=len)
    return base in own.words or word.lower().replace("'", "") not in own.words


def asked_as(word: str, own: Model) -> str:
    """What a printed word counts as: ``letters`` or ``signs`` are asked for their reading, ``odd`` has too many signs, the others are left."""
    if _only_letters.fullmatch(word):
        return "letters"
    if not word or not _odd.search(word) and "!" not in word or _ordinal.fullmatch(word) or contraction(word, own):
        return ""
    letters = len(_any_letter.findall(word))
    strange = len(word) - letters
    return "odd" if strange > 2 or letters < 2 or letters < 2 * strange else "signs"


def misread(part: str, own: Model, whole: str = "", line: str = "") -> bool:
    """Whether a line of text has a word whose characters were misrecognised; ``part`` is it without halves of words."""
    words = _printed.findall(part)
    if own.undoubted(words):
        return False
    odd, clean, known = 0, 0, 0
    asked = []
    for word in words:
        word = word.strip("'!_")
        kind = asked_as(word, own)
        if kind == "letters":
            clean += 1
            known += word.lower() in own.words
        if kind in ("letters", "signs"):
            asked.append(word)
        odd += kind == "odd"
    meant = own.readings(asked) if asked else []
    hits = sum(m is not None for m in meant)
    odd += sum(m is None and not _only_letters.fullmatch(word) for word, m in zip(asked, meant))
    return hits > 0 and known >= 1 and 3 * known >= clean and hits + odd <= max(2, 0.4 * (clean + hits + odd)) and not is_strange(line or part)


def corrected(line: str, own: Model) -> str:
    """A line with the words that were meant, their capitals kept."""
    places = list(_printed.finditer(line))
    cores = [m[0].strip("'!_") for m in places]
    kept = [len(core) < 3 or contraction(core, own) or bool(_ordinal.fullmatch(core)) or not _only_letters.fullmatch(core) and not _odd.search(core) for core in cores]
    asked = [k for k in range(len(places)) if not kept[k]]
    out, end = [], 0
    for k, meant in zip(asked, own.readings([cores[k] for k in asked]) if asked else ()):
        if meant:
            core = cores[k]
            spelled = meant.upper() if core.isupper() else meant.capitalize() if core[0].isupper() else meant
            out += [line[end : places[k].start()], places[k][0].replace(core, spelled)]
            end = places[k].end()
    return "".join([*out, line[end:]])


def repaired(text: str, title: str | None, own: Model) -> str:
    """A text as paragraphs: broken words joined, misread ones corrected, heads and page numbers gone. Texts not set in lines stay as they are."""
    found = noise(text, title, own)
    raw = text.split("\n")
    if len(raw) < 2 or not set_in_lines(raw):
        return text
    kinds: dict[int, set[str]] = {}
    for k, kind in found:
        kinds.setdefault(k, set()).add(kind)
    out: list[str] = []
    run, fuse, gap = "", False, False
    for k, line in enumerate(raw):
        own_kinds = kinds.get(k, set())
        if own_kinds & {"running_head", "page_number"}:
            continue
        line = line.strip()
        if not line:
            gap = True
            continue
        if "misread" in own_kinds:
            line = corrected(line if line.isascii() else consistent(line), own)
        # A blank line parts paragraphs, unless a sentence goes on behind it, as over the end of a page.
        if run and gap and not fuse and (_end.search(run) or not line[0].islower()):
            out.append(run)
            run = ""
        if "broken_word" in own_kinds:
            line = _breaks.sub(r"\1", line)
        run = line if not run else run + line if fuse or run.endswith("-") else f"{run} {line}"
        fuse, gap = "broken_word" in own_kinds, False
    if run:
        out.append(run)
    return "\n\n".join(out)


def repaired_texts(documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """(src, uid, text): every text of both tables, those of scanned pages repaired."""
    a = documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("uid"), "title", "text").dropDuplicates(["uid"])
    b = chapters.select(F.lit("chapters").alias("src"), F.col("chapter_uid").alias("uid"), "title", "text").dropDuplicates(["uid"])
    texts = a.unionByName(b).filter(F.col("text").isNotNull())
    shared = texts.sparkSession.sparkContext.broadcast(model(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [repaired(text, title, own) for title, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["src", "uid", "text"])

    return texts.mapInArrow(run, "src string, uid long, text string")


def found(documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """Distinct (src, uid, line_no, kind) over both tables."""
    a = documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("uid"), "title", "text")
    b = chapters.select(F.lit("chapters").alias("src"), F.col("chapter_uid").alias("uid"), "title", "text")
    texts = a.unionByName(b).filter(F.col("text").isNotNull())
    shared = texts.sparkSession.sparkContext.broadcast(model(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at, numbers, kinds = [], [], []
            for k, (title, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for number, kind in noise(text, title, own):
                    at.append(k)
                    numbers.append(number)
                    kinds.append(kind)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string())], names=["src", "uid", "line_no", "kind"])

    return texts.mapInArrow(run, "src string, uid long, line_no int, kind string").distinct()

"""Problem 8: byte-level BPE ids of a whole corpus by merge replay.

Texts are split into pre-tokens by the tokenizer's own pattern. The merges act
inside a pre-token only, so the distinct pre-tokens of a block of documents are
encoded once: an inverted index maps each pair of neighbouring tokens to its
positions, a queue gives the pairs in rank order, and each merge touches only
the positions of its pair and their two neighbours. Blocks need no shuffle, and
a worker keeps what it has encoded for the next block.

Defined cases: null and empty texts give an empty list; strings of special
tokens are ordinary text; repeated rows give repeated rows; a text of any
length is one row.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Place of the vocabulary file; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: A worker forgets its encoded pre-tokens beyond so many, to bound its memory.
MEMO = 400_000

# The pattern that splits text before the merges, and Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_split_any = regex.compile(PATTERN.replace("[^\\s", f"[^{SPACE}").replace("(?!\\S)", f"(?![^{SPACE}])").replace("\\s+", f"[{SPACE}]+"))
_split_ascii = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    letters.update((b, chr(256 + k)) for k, b in enumerate(b for b in range(256) if b not in letters))
    return letters


class MergeReplay:
    """Encodes sets of pre-tokens with the merges of a vocabulary file."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.memo: dict[str, tuple[int, ...]] = {}

    def replay(self, words: list[str]) -> None:
        """Puts the ids of each word into the memo."""
        tokens: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts = []
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            start, end = len(tokens), len(tokens) + len(data)
            starts.append(start)
            tokens.extend(map(self.of_byte.__getitem__, data))
            after.extend(range(start + 1, end))
            after.append(-1)
            before.append(-1)
            before.extend(range(start, end - 1))
        merges, where = self.merges, defaultdict(list)
        for at, nxt in enumerate(after):
            if nxt >= 0:
                pair = (tokens[at], tokens[nxt])
                if pair in merges:
                    where[pair].append(at)
        queue = [(merges[pair][0], pair) for pair in where]
        heapq.heapify(queue)
        while queue:
            _, pair = heapq.heappop(queue)
            places = where.pop(pair, None)
            if places is None:
                continue
            left, right = pair
            new = merges[pair][1]
            places.sort()
            for at in places:
                nxt = after[at]
                if tokens[at] != left or nxt < 0 or tokens[nxt] != right:
                    continue
                tokens[at], tokens[nxt] = new, -1
                far = after[at] = after[nxt]
                back = before[at]
                for a, b in ((back, at), (at, far)):
                    if a >= 0 and b >= 0 and (pair2 := (tokens[a], tokens[b])) in merges:
                        if pair2 not in where:
                            heapq.heappush(queue, (merges[pair2][0], pair2))
                        where[pair2].append(a)
                if far >= 0:
                    before[far] = at
        for word, start in zip(words, starts):
            ids, at = [], start
            while at >= 0:
                ids.append(tokens[at])
                at = after[at]
            self.memo[word] = tuple(ids)

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offset of each text among them."""
        split = [(_split_ascii if text.isascii() else _split_any).findall(text) if text else () for text in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = set(chain.from_iterable(split)).difference(self.memo)
        if new:
            self.replay(list(new))
        get = self.memo.__getitem__
        flat = [list(chain.from_iterable(map(get, words))) for words in split]
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum([len(x) for x in flat], out=offsets[1:])
        return np.fromiter(chain.from_iterable(flat), np.int32, int(offsets[-1])), offsets


_encoders: dict[str, MergeReplay] = {}


def encoder(path: str = VOCABULARY) -> MergeReplay:
    """The worker's own encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = MergeReplay(path)
    return _encoders[path]


def _slices(texts: pa.Array, most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes of text, or one row."""
    start, size = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size + (n or 0) > most and k > start:
            yield start, k
            start, size = k, 0
        size += n or 0
    if start < len(texts):
        yield start, len(texts)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row (key, ids) per row of ``documents``; a narrow pass over the two columns, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in _slices(texts):
                ids, offsets = own.encode_block(texts[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([keys[a:b], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    kind = documents.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row (key, tokens) per row; the ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in _slices(texts):
                _, offsets = own.encode_block(texts[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([keys[a:b], pa.array(np.diff(offsets).astype(np.int32))], names=[key, "tokens"])

    kind = documents.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("tokens", T.IntegerType())])
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def token_total(ids: Column) -> Column:
    """Number of ids, 0 for none."""
    return F.coalesce(F.size(ids), F.lit(0))

"""The corpus file: documents with their assertions, patterns that may be left out, checks that are skipped, and what is expected.

The file is small and read on the driver; what it says becomes tables that the
checks join by document.
"""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _strings(items) -> list[dict]:
    """Seeded strings, each a text alone or a mapping with an id and a kind of match."""
    return [{"text": item} if isinstance(item, str) else item for item in items or []]


class Corpus:
    """A corpus file as tables; ``text`` is its YAML."""

    def __init__(self, spark: SparkSession, text: str):
        self.spark, self.raw = spark, yaml.safe_load(text) or {}

    def _rows(self, schema: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @property
    def _documents(self) -> list[dict]:
        return self.raw.get("documents") or []

    def documents(self) -> DataFrame:
        """(doc_id, kind, language, tier) with what holds where nothing is said."""
        return self._rows("doc_id string, kind string, language string, tier string", [(d["id"], d.get("kind", "book"), d.get("language", "en"), d.get("tier", "smoke")) for d in self._documents])

    def assertions(self) -> DataFrame:
        """(doc_id, polarity, id, text, match) of strings that must be in a document's text or must not."""
        out = []
        for d in self._documents:
            for polarity in ("must_contain", "must_not_contain"):
                for k, item in enumerate(_strings((d.get("assertions") or {}).get(polarity))):
                    out.append((d["id"], polarity, str(item.get("id", f"{polarity}_{k}")), item["text"], item.get("match", "substring")))
        return self._rows("doc_id string, polarity string, id string, text string, match string", out)

    def patterns(self) -> DataFrame:
        """(doc_id, pattern) of sentences that a narration may leave out."""
        return self._rows("doc_id string, pattern string", [(d["id"], p) for d in self._documents for p in (d.get("assertions") or {}).get("deletion_allowlist") or []])

    def skips(self) -> DataFrame:
        """(doc_id, dimension) of checks that are not run for a document."""
        return self._rows("doc_id string, dimension string", [(d["id"], c) for d in self._documents for c in d.get("skip_checks") or []])

    def expectations(self) -> DataFrame:
        """(doc_id, name, value) of what is expected of a document, values as text."""
        return self._rows("doc_id string, name string, value string", [(d["id"], k, str(v)) for d in self._documents for k, v in (d.get("expect") or {}).items()])

    def allow(self, doc_id: str, pattern: str) -> bool:
        """Lets a document's narration leave out what a pattern says; whether the document is known."""
        for d in self._documents:
            if d["id"] == doc_id:
                d.setdefault("assertions", {}).setdefault("deletion_allowlist", []).append(pattern[:80])
                return True
        return False

    def expect(self, doc_id: str, name: str, value) -> bool:
        """Writes down what is expected of a document; whether the document is known."""
        for d in self._documents:
            if d["id"] == doc_id:
                d.setdefault("expect", {})[name] = value
                return True
        return False

    def text(self) -> str:
        """The corpus file, documents and keys in their order."""
        return yaml.safe_dump(self.raw, sort_keys=False, allow_unicode=True)


def resolved(queue: DataFrame, book: str, dimension: str, unit_id: str) -> DataFrame:
    """The review queue without one item; it is written to a new place, as a queue may not be read and overwritten at once."""
    return queue.filter(~((F.col("book") == book) & (F.col("dimension") == dimension) & F.col("unit_id").eqNullSafe(unit_id)))

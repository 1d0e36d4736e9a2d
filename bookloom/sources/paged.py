"""A data source of paginated text files: one partition a file, one row a page.

Pages are parted by form feeds, as text extractors write them. A reader for
another format of pages is another subclass of :class:`PageReader`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "book_id string, number int, text string, chars int"


def book_id(path: str) -> str:
    """The stem of a file's name in lower case, all but letters and digits as one underscore."""
    stem = os.path.splitext(os.path.basename(path))[0]
    return re.sub("[^a-z0-9]+", "_", stem.lower()).strip("_")


class FilePart(InputPartition):
    """One file."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class PageReader(DataSourceReader):
    """Reads the pages of the files of a folder, or of one file."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        if os.path.isfile(self.path):
            return [FilePart(self.path)]
        return [FilePart(os.path.join(self.path, name)) for name in sorted(os.listdir(self.path)) if name.endswith(".txt")]

    def pages(self, path: str) -> Iterator[str]:
        """The pages of a file in order."""
        with open(path, encoding="utf-8", errors="replace") as file:
            yield from file.read().rstrip("\f").split("\f")

    def read(self, partition: FilePart) -> Iterator[tuple]:
        own = book_id(partition.path)
        for number, text in enumerate(self.pages(partition.path)):
            yield own, number, text, len(text)


class PagedText(DataSource):
    """``spark.read.format("paged_text").load(folder)``: (book_id, number, text, chars)."""

    @classmethod
    def name(cls) -> str:
        return "paged_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(PagedText)

import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from bookloom.operators import checks
from bookloom.plugins import DummySynthesizer
from bookloom.sources import artifacts, sinks
from bookloom.streaming import pace


def test_tolerant_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"key": "a", "v": 1}\n\n{"key": "a", "v": 2}\n{"v": 3}\n{"key": "b", "v"')
    got = artifacts.jsonl(spark, str(tmp_path / "log.jsonl"), "key string, v int", "key").collect()
    assert [(r.key, r.v) for r in got] == [("a", 2)]


def test_word_list_and_sidecar(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Stone \nstone\n\nriver\n")
    assert sorted(r.word for r in artifacts.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["river", "stone"]
    assert artifacts.word_list(spark).count() == 0
    rows = artifacts.sidecar(spark, "b", "chapters:\n  - {title: One, start_page: 5}\n  - {title: Notes, start_page: 9, matter: back}\n").collect()
    assert [(r.title, r.start_page, r.matter) for r in rows] == [("One", 4, "body"), ("Notes", 8, "back")]
    assert artifacts.sidecar(spark, "b", None).count() == 0


def test_settings():
    own = artifacts.Settings.read("structural:\n  header_zone: 0.2\nother:\n  x: 1\n")
    assert own.header_zone == 0.2 and own.footer_zone == 0.90 and own.extra == {"x": 1}


def test_salvage(spark):
    df = spark.createDataFrame([(1, '```json\n{"segments": [{"type": "paragraph", "text": "A \\"b\\""}, {"type": "paragraph", "te')], "k int, text string")
    assert [(r.type, r.text) for r in artifacts.salvaged(df, "k").collect()] == [("paragraph", 'A "b"')]


def test_repaired_json(spark):
    df = spark.createDataFrame([('```json\n{"a": [1, 2,], "b": "x\\q",}\n```',)], "t string")
    assert json.loads(df.select(artifacts.repaired_json(F.col("t")).alias("x")).first().x) == {"a": [1, 2], "b": "x\\q"}


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("d", 4, "x", f"u{k:02d}", "m", True) for k in range(15)], "doc_id string, stage int, dimension string, unit_id string, message string, fixable boolean")
    sinks.append_review(found, str(tmp_path / "q"))
    sinks.append_review(found, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == 20
    sinks.write_version(found, str(tmp_path / "v"), "1")
    sinks.write_version(found, str(tmp_path / "v"), "2")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 30
    docs = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    res = checks.results(found.filter("false"), docs, ["no_surviving_digits"])
    assert {r.status for r in res.collect()} == {"pass"}


def test_plugin():
    frame = next(DummySynthesizer(60).synthesize(iter([pd.DataFrame({"key": ["a"], "text": ["one two"]})])))
    assert frame.duration_s.tolist() == [2.0]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("b", dt.datetime(2024, 1, 1, 0, m)) for m in (1, 5, 20, 40)]
    spark.createDataFrame(rows, "book string, at timestamp").coalesce(1).write.mode("append").parquet(str(src))
    log = pace.read_log(spark, str(src), spark.read.parquet(str(src)).schema)
    q = pace.windowed(log, "book", "at").writeStream.outputMode("complete").format("memory").queryName("paced").start()
    q.processAllAvailable()
    q.stop()
    got = {r.start.minute + 60 * r.start.hour: r.n for r in spark.table("paced").collect() if r.start.day == 1}
    assert got[0] == 3 and got[15] == 2 and got[30] == 1


def test_spans_to_blocks(spark):
    df = spark.createDataFrame([("b", 0, 0, 0, " A\x01 ", [10.0, 12.0]), ("b", 0, 1, 1, "image", [1.0]), ("b", 0, 2, 0, "  ", [9.0])], "book_id string, page int, block_ord int, kind int, text string, sizes array<double>")
    assert [(r.text, r.size) for r in artifacts.pages_from_spans(df).collect()] == [("A", 12.0)]
    assert json.dumps(1) == "1"


def test_paged_text(spark, tmp_path):
    from bookloom.sources import paged

    (tmp_path / "My Book (2).txt").write_text("one\ftwo\f\fthree\f")
    (tmp_path / "b.txt").write_text("")
    paged.register(spark)
    rows = spark.read.format("paged_text").load(str(tmp_path)).orderBy("book_id", "number").collect()
    assert [(r.book_id, r.number, r.text) for r in rows] == [("b", 0, ""), ("my_book_2", 0, "one"), ("my_book_2", 1, "two"), ("my_book_2", 2, ""), ("my_book_2", 3, "three")]


def test_corpus(spark):
    from bookloom.sources.corpus import Corpus, resolved

    text = """
documents:
  - id: a
    pdf: a.pdf
    assertions:
      must_contain: ["One", {id: x, text: Two, match: line}]
      deletion_allowlist: [see page]
    skip_checks: [loudness]
    expect: {chapters: 3}
  - id: b
    pdf: b.pdf
    kind: scan
"""
    own = Corpus(spark, text)
    assert sorted(map(tuple, own.documents().collect())) == [("a", "book", "en", "smoke"), ("b", "scan", "en", "smoke")]
    assert sorted(map(tuple, own.assertions().collect())) == [("a", "must_contain", "must_contain_0", "One", "substring"), ("a", "must_contain", "x", "Two", "line")]
    assert own.allow("b", "p" * 99) and not own.allow("z", "p") and own.expect("b", "chapters", 2)
    again = Corpus(spark, own.text())
    assert sorted(map(tuple, again.patterns().collect())) == [("a", "see page"), ("b", "p" * 80)]
    assert sorted(map(tuple, again.expectations().collect())) == [("a", "chapters", "3"), ("b", "chapters", "2")]
    assert [tuple(r) for r in again.skips().collect()] == [("a", "loudness")] and Corpus(spark, "").documents().count() == 0
    queue = spark.createDataFrame([("a", "x", "1"), ("a", "x", None), ("b", "x", "1")], "book string, dimension string, unit_id string")
    assert sorted((r.book, r.unit_id) for r in resolved(queue, "a", "x", "1").collect()) == [("a", None), ("b", "1")]

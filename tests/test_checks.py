import random

from pyspark.sql import functions as F

from bookloom import cli
from bookloom.operators import checks, qc, signal

SF = "/root/testdata/sf0.001"


def test_seeded(spark):
    texts = spark.createDataFrame([("d", "The “old” house\nPage 12\nend of it")], "doc_id string, text string")
    rows = [("d", "must_contain", "a", 'the "old"  house', "substring"), ("d", "must_not_contain", "b", "page 12", "line"), ("d", "must_not_contain", "c", "^end", "regex"), ("d", "must_contain", "e", "lost", "substring"), ("d", "must_not_contain", "f", "Page", "line")]
    a = spark.createDataFrame(rows, "doc_id string, polarity string, id string, text string, match string")
    assert {r.id: r.hit for r in checks.seeded(texts, a).collect()} == {"a": True, "b": True, "c": True, "e": False, "f": False}
    assert {(r.unit_id, r.message) for r in checks.seeded_violations(texts, a).collect()} == {("b", "forbidden string"), ("c", "forbidden string"), ("e", "missing string")}


def test_held_parts():
    """Against a plain search of every part in every body, few parts and many, of lengths around the widths of grams."""
    random.seed(9)
    for most in (5, 400):
        bodies = ["".join(random.choices("abc ", k=random.choice((0, 1, 30, 500)))) for _ in range(12)]
        parts = ["", "a", *("".join(random.choices("abc ", k=random.randint(1, 9))) for _ in range(most))]
        for _ in range(most):
            x = random.choice(bodies)
            k, n = random.randint(0, len(x)), random.choice((1, 2, 3, 7, 8, 9, 31, 63, 64, 65, 130, 400))
            parts += [x[k : k + n], x[k : k + n] + "d"]
        parts += [bodies[3] + bodies[4], "é" * 70]
        got = checks.held_parts(bodies, parts)
        assert sorted(got) == sorted({x for x in parts if any(x in b for b in bodies)})
    assert checks.held_parts([], [str(k) for k in range(50)]) == [] and checks.held_parts([""], ["", *map(str, range(50))]) == [""]


def test_seeded_in_chunks(spark, monkeypatch):
    """A document whose texts and strings fill several chunks; each text is searched once for all of them, not for each."""
    monkeypatch.setattr(checks, "TEXTS", 3)
    monkeypatch.setattr(checks, "STRINGS", 7)
    rows = [("d", f"Head {k}  of “THE” book\nline {k}") for k in range(20)] + [("e", "other"), ("f", None)]
    seeds = [("d", "must_contain", f"s{k}", f'head {k} of "the"', None if k % 2 else "substring") for k in range(40)] + [("d", "x", "l3", "LINE 3", "line"), ("d", "x", "l2", "line 20", "line"), ("d", "x", "r", "^line 1[0-9]$", "regex"), ("d", "x", "n", None, "substring"), ("e", "x", "s", "head 3", "substring"), ("f", "x", "s", "a", "substring"), ("g", "x", "s", "a", "substring")]
    frame = checks.seeded(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(seeds, "doc_id string, polarity string, id string, text string, match string"))
    want = {("d", f"s{k}"): k < 20 for k in range(40)} | {("d", "l3"): True, ("d", "l2"): False, ("d", "r"): True, ("d", "n"): False, ("e", "s"): False, ("f", "s"): False}
    assert {(r.doc_id, r.id): r.hit for r in frame.collect()} == want


def test_violation_counts(spark):
    """The same as those of one plan, which reads the counts and none of the texts."""
    tables = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    some = ["no_page_numbers", "dehyphenation", "segment_length_limits", "no_surviving_digits", "speaker_similarity"]
    got = checks.violation_counts(tables, some)
    want = checks.violations(tables, some).groupBy("stage", "dimension", "doc_id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_removed_text(spark):
    long = "A footnote about the harvest of that year and what the miller said of it."
    gone = spark.createDataFrame([("d", "u1", long), ("d", "u2", long.replace("harvest", "weather")), ("d", "u3", "short")], "doc_id string, unit_id string, text string")
    said = spark.createDataFrame([("d", "Then. " + long + " More.")], "doc_id string, text string")
    assert [r.unit_id for r in checks.removed_text_absent(gone, said).collect()] == ["u1"]


def test_removed_text_in_any_script_and_over_segments(spark):
    """Blocks without a long Latin or Cyrillic word, and blocks narrated over several segments and chunks."""
    han = "".join(chr(0x4E00 + k * 37 % 3000) for k in range(90))
    short = "It was a hot day and so we all sat by the sea. " * 2 + "No one of us had to go in."
    parts = ["The miller said nothing of it.", "He went.", "The harvest of that year was carried to the market."]
    rows = [("d", "han", han), ("d", "short", short), ("d", "over", " ".join(parts)), ("d", "other", " ".join(reversed(parts))), ("d", "blank", " " * 80), ("d", "brief", "a" + " " * 70 + "b"), ("e", "han", han)]
    gone = spark.createDataFrame(rows, "doc_id string, unit_id string, text string")
    texts = [f"Then {han} and on.", short.upper(), "", *["x a b y"] * 3]
    said = [("d", k, t) for k, t in enumerate(texts)] + [("d", checks.PLACES - 1 + k * checks.PLACES, t) for k, t in enumerate(parts)] + [("e", 0, "nothing")]
    got = checks.removed_text_absent(gone, spark.createDataFrame(said, "doc_id string, n int, text string"), order="n")
    assert sorted((r.doc_id, r.unit_id) for r in got.collect()) == [("d", "brief"), ("d", "han"), ("d", "over"), ("d", "short")]


def test_gram_keys_of_a_part():
    random.seed(7)
    for _ in range(200):
        text = "".join(random.choice("ab 字й😀") for _ in range(random.randint(0, 400)))
        at = random.randint(0, len(text))
        part = text[at : at + random.randint(0, 120)]
        assert set(checks.gram_keys(part)) <= set(checks.gram_keys(text)) and bool(checks.gram_keys(part)) == (len(part) >= checks.GRAM + checks.WINDOW - 1)


def test_audio_tables(spark):
    rows = [("a", True, 24000, 1.0, 0.5, 0.1, 0.5), ("b", False, 0, 0.0, 0.0, 0.0, 0.0), ("c", True, 44100, 1.0, 0.5, 0.1, 0.5), ("d", True, 24000, 1.0, 1.0, 0.1, 0.5), ("e", True, 24000, 1.0, 0.5, 0.4, 0.5)]
    df = spark.createDataFrame(rows, "segment_id string, exists boolean, sample_rate int, duration_s double, peak double, tail_rms double, body_rms double")
    assert {r.segment_id: r.reason for r in checks.audio_valid(df).collect()} == {"b": "missing", "c": "rate", "d": "clipped", "e": "hot_end"}
    loud = spark.createDataFrame([("x", -18.5, -4.0), ("y", -15.0, -4.0), ("z", -18.0, -1.0)], "book_id string, lufs double, peak_db double")
    assert {r.book_id: r.reason for r in checks.loudness(loud).collect()} == {"y": "loudness", "z": "peak"}
    levels = spark.createDataFrame([("x", -20.0 - k * 3) for k in range(4)] + [("y", -20.0)] * 5, "book_id string, level_db double")
    assert [r.book_id for r in checks.level_spread(levels).collect()] == ["x"]


def test_container_markers(spark):
    plan = spark.createDataFrame([("b", 0, "One", 750), ("b", 1, "Two", 5000), ("b", 2, "Three", 9000)], "book_id string, place int, title string, start_ms long")
    got = spark.createDataFrame([("b", 0, "One", 0), ("b", 1, "Two", 5300)], "book_id string, place int, title string, start_ms long")
    assert {r.place: r.reason for r in checks.container_markers(plan, got).collect()} == {1: "time", 2: "count"}


def test_regions(spark):
    takes = spark.createDataFrame([("t", [0.0] * 4 + [0.5] * 8 + [0.0] * 40 + [0.5] * 20)], "key string, samples array<float>")
    levels = signal.frames(takes, "key", "samples", 4)
    found = signal.regions(levels, "key", 0.1)
    assert sorted((r.region, r.start, r.end) for r in found.collect()) == [(0, 1, 3), (1, 13, 18)]
    assert [r.key for r in signal.onset_artifacts(found, "key").collect()] == ["t"]
    assert signal.speech_end(levels, "key").first().end_s == 18 * 0.02


def test_gaps_and_references(spark):
    speech = spark.createDataFrame([("k", 1.0, 2.0, 19.0), ("k", 10.0, 12.0, 19.0)], "key string, start double, end double, total double")
    assert tuple(signal.longest_gap(speech, "key", "total").first())[1:] == (3.5, 8.5)
    words = spark.createDataFrame([("k", float(s), s + 2.5) for s in (0, 3, 6, 20, 23)], "key string, start double, end double")
    assert tuple(signal.reference_windows(words, "key", 8.0).first())[1:] == (0.0, 8.5)


def test_pace(spark):
    df = spark.createDataFrame([(130, 60.0, 1.0), (260, 60.0, 0.88), (100, 60.0, 1.08), (2, 60.0, 1.0)], "w int, s double, want double")
    assert all(r.got == r.want for r in df.select("want", signal.pace_factor(F.col("w"), F.col("s")).alias("got")).collect())


def test_loop(spark):
    start = spark.createDataFrame([(k, k) for k in range(6)], "id int, bad int")
    check = lambda df: df.filter("bad > 2").select(F.lit("d").alias("doc_id"), F.lit("x").alias("dimension"), F.col("id").alias("unit_id"), F.lit(True).alias("fixable"))
    retry = lambda df, found: qc.redo(df, found.select(F.col("unit_id").alias("id")), ["id"], lambda rows: rows.withColumn("bad", F.col("bad") - 2))
    out = qc.loop(4, lambda: start, check, retry)
    assert out.passed and out.attempts == 3 and out.history == [3, 1, 0]
    assert not qc.loop(4, lambda: start, check).passed
    hist = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "attempt int, segment_id string")
    assert [(r.segment_id, r.failures) for r in qc.stubborn(hist).collect()] == [("a", 2)]


def test_cli(spark, capsys, tmp_path):
    assert cli.main(["queries"]) == 0 and "running_headers" in capsys.readouterr().out
    assert cli.main(["evals", SF, "--checks", "no_surviving_digits", "segment_length_limits", "--to", str(tmp_path / "r")]) == 0
    base = spark.read.parquet(str(tmp_path / "r")).withColumn("status", F.lit("pass"))
    base.write.parquet(str(tmp_path / "b"))
    assert cli.main(["evals", SF, "--checks", "no_surviving_digits", "--baseline", str(tmp_path / "b")]) == 1
    assert cli.main(["progress", SF]) == 0


def test_every_check_runs(spark):
    tables = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    rows = checks.violations(tables).groupBy("dimension").count().collect()
    assert {r.dimension for r in rows} <= set(checks.CHECKS) and len(rows) > 5

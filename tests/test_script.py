"""Script assembly, selections, alignment and statuses on small cases."""

import difflib
import hashlib
import json
import random

from pyspark.sql import functions as F

from bookloom.functions import numbers as M
from bookloom.functions import text as X
from bookloom.operators import align, checks, script, selection

SEG = "seg_uid long, book_id string, chapter_id string, seg_ord int, type string, text string, para_id string"


def test_assembled(spark):
    rows = [
        (1, "b", "c", 0, "chapter_heading", "The Mill", "p0"),
        (2, "b", "c", 1, "paragraph", "The mill.", "p1"),
        (3, "b", "c", 2, "paragraph", "It cost 2½ crowns in one thousand six hundred ten. Mr. Hall paid. “Well,” he said.", "p2"),
        (4, "b", "c", 3, "paragraph", "They met J.", "p3"),
        (5, "b", "c", 4, "paragraph", "Moore there.", "p3"),
        (6, "b", "c", 5, "paragraph", "xq zv", "p4"),
        (7, "b", "c", 6, "paragraph", None, "p5"),
        (8, "b", "c", 7, "paragraph", "(Hall, 1999)", "p6"),
        (9, "b", "c", 8, "paragraph", "and so on, " * 120 + "to the end.", "p7"),
    ]
    words = spark.createDataFrame([(w,) for w in "the mill it cost crowns in one thousand six hundred ten paid well he said they met moore there and so on to end hall half".split()], "word string")
    got = script.assembled(spark.createDataFrame(rows, SEG), words).orderBy("ord").collect()
    texts = [r.text for r in got]
    assert texts[:5] == ["The Mill", "It cost two and one half crowns in sixteen ten.", "Mr. Hall paid.", "“Well,” he said.", "They met J. Moore there."]
    assert all(len(t) <= 900 for t in texts) and "".join("".join(texts[5:]).split()) == "".join(rows[8][5].split())
    assert [r.new_id for r in got] == [f"seg_{k:04d}" for k in range(len(got))]
    assert [r.sentence_index for r in got if r.para_id == "p2"] == [0, 1, 2]
    assert script.assembled(spark.createDataFrame([], SEG), words).count() == 0


def test_tolerance(spark):
    cases = [
        ("Joathan paid twenty crowns", "joe than paid 20 crowns", ["joathan"], True),
        ("He went home", "he went home!", None, True),
        ("He went home", "he went", ["home"], False),
        ("He went home", "he ran home", ["home"], False),
        ("Joathan went", "a b c d e went", ["joathan"], False),
        ("", "x", [], False),
        ("well-known men and women", "well known men women", [], True),
        (None, "x", [], False),
    ]
    df = spark.createDataFrame([(k, a, b, t, w) for k, (a, b, t, w) in enumerate(cases)], "k int, a string, b string, t array<string>, want boolean")
    rows = script.tolerable(df, "a", "b", "t").collect()
    assert len(rows) == len(cases) and all(r.tolerable == r.want for r in rows), [(r.a, r.b) for r in rows if r.tolerable != r.want]


def test_tolerance_words_at_letters_and_marks(spark):
    """Number words in any case; a letter of any script beside one makes it another word, a combining mark does not."""
    cases = {
        "A thou\u017fand men and TWENTY-five": "a men",
        "ten\u0301 x, e\u0301ten": "x e",
        "Tarulve\u0455ten, \u00e9ten": "tarulve ten ten",
        "Ten's 12ab ten_x": "s ab ten x",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    got = df.select("want", F.array_join(script.tolerance_tokens(F.col("text")), " ").alias("words")).collect()
    assert [r.words for r in got] == [r.want for r in got]


def test_window_problems(spark):
    df = spark.createDataFrame([(1, "x" * 100, ["y" * 90]), (2, "x" * 100, ["y" * 50, "in 1999"]), (3, "x", ["z" * 901])], "k int, s string, t array<string>")
    got = {r.k: r.p for r in df.select("k", script.window_problems(F.col("s"), F.col("t")).alias("p")).collect()}
    assert got == {1: [], 2: ["digits", "short"], 3: ["long"]}


def test_small_texts(spark):
    df = spark.createDataFrame([("The Old Mill: 2 / é", "x"), ("???", "ch07"), (None, "ch08"), ("A" * 80, "x")], "t string, id string")
    assert [r.n for r in df.select(script.safe_name(F.col("t"), F.col("id")).alias("n")).collect()] == ["The_Old_Mill_2_é", "ch07", "ch08", "A" * 60]
    one = spark.createDataFrame([("a=b;c#d\\e\nf", ["x", "y"], "It took 3 of 20 men and 21 days.")], "t string, terms array<string>, asr string")
    row = one.select(script.escaped(F.col("t")).alias("e"), script.terms_line(F.col("terms"), "T: ").alias("l"), M.asr_numbers(F.col("asr")).alias("a"), X.letter_words(F.lit("Don't ' stop, 2 men")).alias("w")).first()
    assert row.e == "a\\=b\\;c\\#d\\\\e\\\nf" and row.l == "T: x, y" and row.a == "It took three of twenty men and 21 days." and row.w == ["don't", "stop", "men"]


def test_take_hash(spark):
    df = spark.createDataFrame([("kokoro", {"voice": "é1", "speed": "1.0"}, "Hi “you”")], "e string, p map<string,string>, t string")
    want = hashlib.sha256(json.dumps({"engine": "kokoro", "params": {"speed": "1.0", "voice": "é1"}, "text": "Hi “you”"}, sort_keys=True).encode()).hexdigest()[:24]
    assert df.select(script.take_path("/cache/", script.take_hash("e", "p", "t")).alias("x")).first().x == f"/cache/{want}.wav"


def test_aligned_sentences(spark):
    plain = spark.createDataFrame([("He came. She left! Mr. Hall stayed? No. 9 went. so it ended.",)], "t string")
    assert plain.select(X.aligned_sentences(F.col("t")).alias("s")).first().s == ["He came.", "She left!", "Mr. Hall stayed?", "No. 9 went. so it ended."]


def test_selections(spark):
    rows = [("b", k, "abcab"[k % 5], k % 3) for k in range(20)] + [("d", 0, None, 0), ("d", 1, "z", 1)]
    df = spark.createDataFrame(rows, "g string, k int, v string, w int")
    a = sorted(r.k for r in selection.seeded_sample(df, ["g"], "k", 4, 1).collect())
    assert a == sorted(r.k for r in selection.seeded_sample(df.repartition(5), ["g"], "k", 4, 1).collect()) and len(a) == 6
    assert {(r.g, r.v, r.n) for r in selection.most_frequent(df, ["g"], "v", "k").collect()} == {("b", "a", 8), ("d", "z", 1)}
    assert {(r.g, r.k, r.batch) for r in selection.batches(df, ["g"], "k", 7).collect()} == {("b", k, k // 7) for k in range(20)} | {("d", 0, 0), ("d", 1, 0)}
    assert sorted(r.k for r in selection.first_of(df.filter("g = 'b'"), ["g"], "k", 3).collect()) == [0, 1, 2]
    best = spark.createDataFrame([("g", "x", 1, 0.9), ("g", "y", 0, 0.2), ("g", "z", 0, 0.8)], "g string, c string, w int, s double")
    assert selection.best_candidate(best, ["g"], "c", "w", "s").first().c == "z"


def test_sets(spark):
    one = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    two = spark.createDataFrame([(2,), (2,), (2,), (3,)], "x int")
    assert sorted(r.x for r in selection.added(one, two, ["x"]).collect()) == [2, 3]
    assert {(r.x, r.side) for r in selection.unequal(one, two, ["x"]).collect()} == {(1, "found"), (3, "expected")}
    assert selection.unequal(one, one, ["x"]).count() == 0
    lists = spark.createDataFrame([("1-3,5",), ("",), (None,), ("4",), ("2-2, 1",)], "s string").select(selection.listed_numbers(F.col("s")).alias("n")).collect()
    assert [r.n for r in lists] == [[1, 2, 3, 5], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6], [4], [1, 2]]


def test_fallbacks_and_patterns(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    made = selection.with_fallback(rows, spark.createDataFrame([(2, "join")], "k int, d string"), ["k"], "d", F.lit("keep"))
    assert {(r.k, r.d) for r in made.collect()} == {(1, "keep"), (2, "join")}
    assert {r.x for r in selection.replaced(rows, spark.createDataFrame([(1, "new")], "k int, x string"), ["k"], "x").collect()} == {"new", "b"}
    said = spark.createDataFrame([("d", "See page 4."), ("d", "Copyright of x"), ("e", "Copyright of x"), ("e", "He left.")], "doc_id string, text string")
    patterns = spark.createDataFrame([(None, r"see page \d+"), ("e", "copyright")], "doc_id string, pattern string")
    assert {(r.doc_id, r.text, r.allowed) for r in selection.allowed(said, patterns).collect()} == {("d", "See page 4.", True), ("d", "Copyright of x", False), ("e", "Copyright of x", True), ("e", "He left.", False)}


def test_gaps_and_shift(spark):
    gaps = spark.createDataFrame([("b", 9.9, 2.0), ("b", 50.0, 1.0), ("c", 5.0, 1.0)], "book_id string, at double, length double")
    quiet = spark.createDataFrame([("b", 9.7, 12.1), ("b", 50.5, 51.0), ("c", 0.0, 90.0)], "book_id string, start double, stop double")
    assert [(r.book_id, r.at) for r in selection.uncovered_gaps(gaps, quiet).collect()] == [("b", 50.0)]
    line = spark.createDataFrame([("b", "c1", 10.0), ("b", "c1", 12.5), ("b", "c2", 40.0)], "book_id string, chapter_id string, start_s double")
    assert sorted(r.local_s for r in selection.shifted(line, 0.75).collect()) == [0.75, 0.75, 3.25]
    a, b = selection.token_overlap(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"), F.lit("w")))
    assert tuple(spark.range(1).select(F.round(a, 3), F.round(b, 3)).first()) == (0.5, 0.333)


def test_page_break_spans(spark):
    pages = spark.createDataFrame([("b", 0, "Head\nIt ended. Then the long lost trav-\n12"), ("b", 1, "Head\neller came to the mill. He slept."), ("b", 2, None)], "book_id string, number int, text string")
    junk = spark.createDataFrame([("b", "head")], "book_id string, line string")
    assert [tuple(r) for r in selection.page_break_spans(pages, junk).collect()] == [("b", 0, "Then the long lost traveller came to the mill.")]


def test_scorers():
    """Against a plain table of common subsequences, and every part of the longer text."""

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b):
                before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k + 1], row[k])
        return row[-1]

    random.seed(5)
    for _ in range(200):
        a, b = ("".join(random.choices("abc ", k=random.randint(0, 14))) for _ in range(2))
        assert align.common_length(a, b) == plain(a, b)
        short, long = sorted((a, b), key=len)
        parts = [long[i:j] for i in range(len(long)) for j in range(i + 1, min(len(long), i + len(short)) + 1)]
        want = max((200 * plain(short, p) / (len(short) + len(p)) for p in parts if len(p) == len(short) or long.startswith(p) or long.endswith(p)), default=0.0) if short else 0.0
        assert abs(align.partial_score(a, b) - want) < 1e-9
    assert align.set_score("he went home", "home he went again") == 100.0 and align.set_score("a b", "") == 0.0
    assert difflib.SequenceMatcher(None, "ab", "ab").ratio() == 1.0


def test_alignment(spark):
    schema = "book_id string, chapter_id string, id long, text string"
    long = "purple comets drifted silently above seven frozen harbours while distant trumpets echoed through empty marble halls forever unheard"
    source = spark.createDataFrame([("b", "c", 1, "He carried the lamp to the old mill."), ("b", "c", 2, "Nobody ever saw the white horse again."), ("b", "c", 3, "She counted every crown twice, and then once more.")], schema)
    rewrite = spark.createDataFrame([("b", "c", 10, "Then he carried the lamp to the old mill. And left."), ("b", "c", 11, "She counted each crown twice and once more."), ("b", "d", 12, "Nobody ever saw the white horse again."), ("b", "c", 13, long), ("b", "c", 14, "He carried the lamp to the old mill where nobody saw it, and she counted every crown once more.")], schema)
    got = {r.src_id: r.verdict for r in align.aligned(source, rewrite).collect()}
    assert got[1] == "kept" and got[2] == "dropped" and got[3] in ("kept", "ambiguous")
    assert {r.id for r in align.without_source(source, rewrite).collect()} == {13}
    assert align.aligned(source.limit(0), rewrite).count() == 0


def test_alignment_weighs_every_rewrite(spark):
    """Rewrites that are alike by letters and share no word, against every pair of the chapter."""
    random.seed(8)
    schema = "book_id string, chapter_id string, id long, text string"
    spelled = lambda t: "".join(c + c if random.random() < 0.12 else c for c in t)
    words = "lamp carried mill horse counted crown twice harbour Capt. the of".split()
    source = [("b", "c", k, " ".join(random.choices(words, k=random.randint(1, 9)))) for k in range(30)] + [("b", "c", 98, "He carried the lamps towards harbours."), ("b", "e", 99, "Alone.")]
    rewrite = [("b", "c", 100 + k, spelled(random.choice(source[:30])[3])) for k in range(25)] + [("b", "c", 200, "Hee carryed thee lampz toward harbors")]
    got = {r.src_id: (r.match_id, r.score, r.verdict) for r in align.aligned(spark.createDataFrame(source, schema), spark.createDataFrame(rewrite, schema)).collect()}
    for _, c, k, text in source:
        score, other = max([(round(align.partial_score(text, y) + 1e-9, 4), -n) for _, d, n, y in rewrite if d == c], default=(0.0, 0))
        if score < align.DROPPED:
            assert got[k] == (None, None, "dropped")
        else:
            assert got[k][0] == -other and abs(got[k][1] - score) < 1e-3 and got[k][2] == ("kept" if score >= align.AMBIGUOUS else "ambiguous")
    assert got[98][0] == 200 and len(got) == 32


def test_least_edits():
    """Against the whole table, alone and many at once, over more than one word of bits and more than one piece."""

    def plain(s, t):
        before = [0] * (len(t) + 1)
        for i, x in enumerate(s, 1):
            row = [i]
            for j, y in enumerate(t, 1):
                row.append(before[j - 1] if x == y else 1 + min(before[j], row[j - 1]))
            before = row
        return min(before)

    random.seed(6)
    pairs = [("".join(random.choices("abcd", k=m)), "".join(random.choices("abcd ", k=m + n))) for m in (1, 2, 9, 64, 65, 130) for n in (0, 3, 50, 1100)]
    for pair, spans in zip(pairs, align.spans_of(pairs)):
        want = plain(*pair)
        assert align.least_edits(*pair)[0] == want == min(spans)[0]


def test_statuses(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    rows = {"one": [("a", "u", "m")], "two": []}
    kept = dict(checks.CHECKS)
    try:
        for name, found in rows.items():
            checks.check(1, name)(lambda t, found=found: spark.createDataFrame(found, "doc_id string, unit_id string, message string"))
        checks.check(2, "breaks")(lambda t: spark.createDataFrame([("a", "u", "m")], "doc_id string, unit_id string, message string").select("*", F.raise_error(F.lit("no")).alias("x")).filter("x is null"))
        checks.check(3, "late")(lambda t: t("takes"))

        def tables(name):
            raise LookupError(name)

        skips = spark.createDataFrame([("b", "one")], "doc_id string, dimension string")
        got = {(r.doc_id, r.dimension): r.status for r in checks.statuses(tables, docs, ["one", "two", "breaks", "late", "golden"][:4], skips, frozenset(["two"])).collect()}
        assert got == {("a", "one"): "fail", ("b", "one"): "skip", ("a", "two"): "skip", ("b", "two"): "skip", ("a", "breaks"): "error", ("b", "breaks"): "error", ("a", "late"): "skip", ("b", "late"): "skip"}
    finally:
        checks.CHECKS.clear()
        checks.CHECKS.update(kept)

import random
import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.operators import align, chapterize, chapters, checks, dictionary, incremental, narration, reflow, structural, timeline, windows
from bookloom.operators import ordered as O


def test_chunked_windows_equal_plain_ones(spark):
    random.seed(1)
    rows = [(f"b{b}", k * random.randint(1, 3) + k, random.random()) for b in range(3) for k in range(0, 2500)]
    rows = list({(b, o): (b, o, v) for b, o, v in rows}.values())
    df = spark.createDataFrame(rows, "b string, o int, v double")
    w = W.partitionBy("b").orderBy("o")
    plain = df.withColumn("p", F.lag("v").over(w)).withColumn("s", F.round(F.sum("v").over(w), 6))
    mine = O.with_running(O.with_previous(df, ["b"], "o", ["v"]), ["b"], "o", F.col("v"), "s").select("b", "o", "v", F.col("prev.v").alias("p"), F.round("s", 6).alias("s"))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, mine.collect()), key=str)


def test_accepted_tokens(spark):
    words = spark.createDataFrame([("stop",), ("carry",), ("move",), ("go",)], "word string")
    got = {r.token for r in dictionary.accepted(words).collect()}
    assert {"stop", "stopped", "stops", "carried", "moved", "moving", "goes"} <= got
    assert "stopied" not in got and "xs" not in got
    ratio = dictionary.word_ratio(spark.createDataFrame([(1, "Stopped moving xyzzy"), (2, "12"), (3, "")], "k int, text string"), words, "k")
    assert {r.k: (r.tokens, r.dict_word_ratio) for r in ratio.collect()} == {1: (3, 0.666667), 2: (0, 1.0), 3: (0, 1.0)}


def test_footnotes(spark):
    box = lambda y: (50.0, y, 550.0, y + 50)
    rows = [
        ("small type low on the page", 8.0, 600.0, True),
        ("1. A note about it\n2. Another note", 9.6, 400.0, True),
        ("* a note with a star", 9.5, 400.0, True),
        ("A plain paragraph.", 10.0, 300.0, False),
        ("A quotation in small type", 8.0, 100.0, False),
        ("Text low on the page at body size", 10.0, 600.0, False),
        ("1. one\n2. two\n3. three", 10.0, 100.0, False),
    ]
    df = spark.createDataFrame([(t, s, box(y), w) for t, s, y, w in rows], "text string, size double, bbox struct<x0:double,y0:double,x1:double,y1:double>, want boolean")
    got = df.select("text", "want", structural.is_footnote(F.col("size"), F.col("bbox.y0"), F.lit(700.0), F.lit(10.0), F.col("text")).alias("foot")).collect()
    assert all(r.foot == r.want for r in got), [r.text for r in got if r.foot != r.want]


def test_sentences(spark):
    df = spark.createDataFrame([(1, "paragraph", "Mr. Hall came. He left. — said. \"Why?\" I asked."), (2, "chapter_heading", "One. Two"), (3, "paragraph", "..."), (4, "paragraph", None)], "seg_uid int, type string, text string")
    got = {}
    for r in narration.sentences(df).orderBy("seg_uid", "sentence_index").collect():
        got.setdefault(r.seg_uid, []).append(r.text)
    assert got[1] == ["Mr. Hall came.", "He left.", "— said.", '"Why?" I asked.']
    assert got[2] == ["One. Two"] and got[3] == ["..."] and 4 not in got


def test_spans_and_levels(spark):
    pages = spark.createDataFrame([("b", k) for k in range(10)], "book_id string, number int")
    starts = spark.createDataFrame([("b", "x", 2), ("b", "y", 5)], "book_id string, title string, start_page int")
    got = sorted((r.ord, r.start_page, r.end_page) for r in chapters.spans(starts, pages).collect())
    assert got == [(-1, 0, 1), (0, 2, 4), (1, 5, 9)]
    toc = spark.createDataFrame([("b", 0, "cover"), ("b", 0, "x.indd"), ("b", 1, "One"), ("b", 1, "Two")], "book_id string, level int, title string")
    assert chapters.outline_level(toc).first().level == 1


def test_timeline(spark):
    seg = spark.createDataFrame(
        [("b", "seg_0000", 0, "c1", "chapter_heading", "p0", "One"), ("b", "seg_0001", 1, "c1", "section_heading", "p1", "Sec"), ("b", "seg_0002", 2, "c1", "paragraph", "p2", "A b."), ("b", "seg_0003", 3, "c1", "paragraph", "p2", "C d.")],
        "book_id string, id string, seg_ord int, chapter_id string, type string, para_id string, text string",
    )
    takes = spark.createDataFrame([("b", f"seg_000{k}", 1.0, 10, "h", 0) for k in range(4)], "book_id string, segment_id string, duration_s double, chars int, hash string, rendered_at int")
    pause = {r.segment_id: (r.start_s, r.silence_before_s) for r in timeline.timeline(seg, takes).collect()}
    assert pause == {"seg_0000": (0.75, 0.0), "seg_0002": (5.75, 4.0), "seg_0003": (7.3, 0.55)}
    assert "seg_0001" in {r.segment_id for r in timeline.timeline(seg, takes, "announce").collect()}


def test_word_error_rate(spark):
    cases = [("a b c", "a b c", 0.0), ("a b c d", "a x c d", 0.25), ("", "", 0.0), ("", "x", 1.0), ("Été noir", "ete noir!", 0.0)]
    df = spark.createDataFrame([(a, b, w) for a, b, w in cases], "a string, b string, w double")
    assert all(r.got == r.w for r in df.select("w", align.word_error_rate(F.col("a"), F.col("b")).alias("got")).collect())


def test_best_match(spark):
    src = spark.createDataFrame([("b", "c", 1, "the quick brown fox"), ("b", "c", 2, "lost words entirely")], "book_id string, chapter_id string, id long, text string")
    dst = spark.createDataFrame([("b", "c", 10, "a quick brown fox ran"), ("b", "c", 11, "the dog")], "book_id string, chapter_id string, id long, text string")
    got = align.best_matches(src, dst).collect()
    assert [(r.src_id, r.match_id, r.score) for r in got] == [(1, 10, 0.75)]


def test_best_match_without_rare_words(spark):
    """Against every pair of a chapter whose words all come back in many of its rewrites."""
    random.seed(4)
    pool = "we came home at noon then they went out again and saw the mill".split()
    src = [("b", "c", k, " ".join(random.sample(pool, random.randint(1, 9)))) for k in range(40)]
    dst = [("b", "c", k, " ".join(random.sample(pool, random.randint(1, 9)))) for k in range(100, 130)] + [("b", "c", k, src[0][3]) for k in range(200, 205)]
    schema = "book_id string, chapter_id string, id long, text string"
    for least in (0.5, 0.75):
        got = {(r.src_id, r.match_id, r.score) for r in align.best_matches(spark.createDataFrame(src, schema), spark.createDataFrame(dst, schema), least).collect()}
        want = set()
        for _, _, k, text in src:
            own = set(text.split())
            score, other = max((round(len(own & set(t.split())) / len(own), 6), -n) for _, _, n, t in dst)
            if score >= least:
                want.add((k, -other, score))
        assert got == want and any(r[0] == 0 and r[2] == 1.0 for r in got)


def test_windows_cover_the_text(spark):
    """Against windows packed one paragraph after another."""

    def pack(text, most, chars):
        pieces, at = [], 0
        for paragraph in text.split("\n\n"):
            if len(paragraph) <= chars:
                pieces.append((at, paragraph))
            else:
                begin, run, here = at, [], at
                for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
                    if run and len(" ".join([*run, sentence])) > chars:
                        pieces.append((begin, " ".join(run)))
                        run, begin = [], here
                    run.append(sentence)
                    here += len(sentence) + 1
                pieces.append((begin, " ".join(run)))
            at += len(paragraph) + 2
        out = []
        for piece in pieces:
            if not out or len(out[-1]) == most or sum(len(p) + 2 for _, p in [*out[-1], piece]) > chars:
                out.append([])
            out[-1].append(piece)
        return [(group[0][0], "\n\n".join(p for _, p in group)) for group in out if any(p.strip() for _, p in group)]

    random.seed(2)
    texts = ["\n\n".join("".join(random.choice("ab. ") for _ in range(random.randint(0, 70))) for _ in range(random.randint(1, 12))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", windows.packed(F.col("t"), 3, 50).alias("w")).collect()
    for r in got:
        assert [(w.offset, w.window) for w in r.w] == pack(r.t, 3, 50)
        assert "".join("".join(w.window for w in r.w).split()) == "".join(r.t.split())


def test_long_parts_stay_within_the_limit(spark):
    random.seed(3)
    texts = [" ".join("".join(random.choice("abc") for _ in range(random.randint(1, 9))) + random.choice(["", ",", ";", ".", "!"]) for _ in range(80)) for _ in range(200)] + ["short", "", "x" * 200, "One two three. " * 9]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", windows.cut_long(F.col("t"), 60).alias("p")).collect()
    for r in got:
        assert all(len(x) <= 60 for x in r.p) or " " not in r.t
        assert "".join("".join(r.p).split()) == "".join(r.t.split())
    assert {len(r.p) for r in got if r.t == "short"} == {1}
    assert [r.p for r in got if r.t.startswith("One")] == [["One two three. One two three. One two three. One two three."] * 2 + ["One two three."]]


def test_headings(spark):
    cases = {"PART IV: THE OLD WEIR": "Part Four. The Old Weir.", "Section 3 - Home": "Section Three. Home.", "Letter XLII": "Letter Forty-two.", "Book 120": "Book 120.", "A plain title;": "A plain title.", "Volume ninth": "Volume ninth."}
    df = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", "want", windows.spoken_heading(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect() if r.got != r.want] == []


def test_footnote_markers(spark):
    """What is fused to a word or a mark goes, numbers of their own stay."""
    cases = {
        'the old river.”14 Then': 'the old river.” Then',
        "as he wished].8": "as he wished].",
        "the Levant23 is far": "the Levant is far",
        "it ended at last.105": "it ended at last.",
        "It cost 2,350 crowns": "It cost 2,350 crowns",
        "the flood of 1799 rose": "the flood of 1799 rose",
        "let x3 be": "let x3 be",
        "about 3.5 miles on": "about 3.5 miles on",
        "at 11:45 sharp": "at 11:45 sharp",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", "want", structural.without_markers(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect() if r.got != r.want] == []


def test_repaired_spacing(spark):
    cases = {"the end.Then he": "the end. Then he", "rope,lamps;oil": "rope, lamps; oil", 'he said,"No."Then': 'he said," No." Then', "he said,“No.”Then": "he said, “No.” Then", "U.S.A. and e.g. this": "U.S.A. and e.g. this", "in 1949.He": "in 1949. He"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", "want", structural.repair_spacing(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect() if r.got != r.want] == []


def test_chapters_from_headings(spark):
    pages = [(0, "All rights reserved"), (1, "Chapter 1\n\nGRAND WEIR\n\nIt rained."), (2, "And on it rained."), (3, "Contents\n\nChapter 9"), (4, "P A R T Two. The Mill\n\n1. A wheel\n\nIt turned.\n\nContents\n\nIt stood."), (5, None)]
    df = spark.createDataFrame([("b", n, t) for n, t in pages] + [("c", 0, "Plain text."), ("c", 1, "More.")], "book_id string, number int, text string")
    starts = chapterize.heading_starts(df)
    assert sorted((r.start_page, r.place, r.title) for r in starts.collect()) == [(1, 0, "Chapter 1: Grand Weir"), (4, 0, "PART Two. The Mill")]
    made = chapterize.filled(chapterize.chapters_between(chapterize.chosen_starts([("heading", starts, 1)]), df), df)
    got = {(r.book_id, r.ord): (r.title, r.matter, r.text) for r in made.collect()}
    assert got == {
        ("b", -1): ("Front Matter", "front", "All rights reserved"),
        ("b", 0): ("Chapter 1: Grand Weir", "body", "It rained.\n\nAnd on it rained."),
        ("b", 1): ("PART Two. The Mill", "body", "It turned.\n\nIt stood."),
        ("c", 0): ("Full Text", "body", "Plain text.\n\nMore."),
    }
    parts = chapterize.page_parts(chapterize.chapters_between(chapterize.chosen_starts([("heading", starts, 1)]), df), df)
    dropped = sorted((r.number, d.reason) for r in parts.collect() for d in r.dropped)
    assert dropped == [(1, "title"), (1, "title"), (3, "mini_toc"), (4, "listing"), (4, "section_outline"), (4, "title")]


def test_chapters_from_type(spark):
    box = (0.0, 50.0, 9.0, 80.0)
    rows = [(k, "b", k, 0, box, t, s) for k, (t, s) in enumerate([("The Old Weir", 20.0), ("plain lines of text that are long enough to count", 10.0), ("The Mill", 18.0), ("xq zzt kkp", 22.0)])]
    blocks = spark.createDataFrame(rows, "block_uid long, book_id string, page int, block_ord int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string, size double")
    pages = spark.createDataFrame([("b", k, "text", 700.0) for k in range(4)], "book_id string, number int, text string, page_height double")
    own = structural.blocks_of(blocks, pages)
    words = spark.createDataFrame([(w,) for w in "the old weir mill plain lines of text that are long enough to count".split()], "word string")
    made = chapterize.chapterized(pages, own, structural.body_size(own), words)
    assert sorted((r.start_page, r.end_page, r.title, r.source) for r in made.collect()) == [(0, 1, "The Old Weir", "font"), (2, 3, "The Mill", "font")]


def test_reflow(spark):
    words = spark.createDataFrame([(w,) for w in "self made river market basket the well known".split()], "word string")
    rows = [
        (1, 0, 0, 10.0, "The widow carried the bas-\nket to the self-\nmade man and"),
        (2, 0, 1, 40.0, "on to the river,"),
        (3, 1, 0, 10.0, "Weir and mill. A well- known"),
        (4, 1, 1, 40.0, "CHAPTER TWO"),
        (5, 2, 0, 10.0, "It began"),
        (6, 4, 0, 10.0, "Anew it goes."),
    ]
    blocks = spark.createDataFrame([(u, "b", p, o, (0.0, y + 100, 9.0, y + 110), t, 10.0) for u, p, o, y, t in rows], "block_uid long, book_id string, page int, block_ord int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string, size double")
    pages = spark.createDataFrame([("b", k, "" if k == 3 else "x", 700.0) for k in range(5)], "book_id string, number int, text string, page_height double")
    made = reflow.flowed(reflow.block_paragraphs(structural.blocks_of(blocks, pages), words), pages, words)
    got = [(r.page, r.place, r.text) for r in made.orderBy("page", "place").collect()]
    assert got == [
        (0, 0, "The widow carried the basket to the self-made man and on to the river, Weir and mill. A well- known"),
        (1, 1, "CHAPTER TWO It began"),
        (4, 0, "Anew it goes."),
    ]
    texts = {r.number: r.text for r in reflow.page_texts(made, words).collect()}
    assert texts[0].endswith("A well-known") and set(texts) == {0, 1, 4}
    assert reflow.flowed(reflow.block_paragraphs(structural.blocks_of(blocks.limit(0), pages), words), pages, words).count() == 0


def test_pass_k_and_regressions(spark):
    rounds = spark.createDataFrame([("d", "x", 1, "pass"), ("d", "x", 2, "fail"), ("d", "x", 3, "error"), ("d", "y", 1, "pass")], "doc_id string, dimension string, round int, status string")
    got = {r.dimension: r.status for r in checks.pass_k(rounds).collect()}
    assert got == {"x": "fail", "y": "pass"}
    base = spark.createDataFrame([("d", "x", "pass"), ("d", "z", "pass")], "doc_id string, dimension string, status string")
    now = checks.pass_k(rounds)
    assert [(r.doc_id, r.dimension) for r in checks.regressions(base, now).collect()] == [("d", "x")]
    assert {(r.dimension, r.status) for r in checks.upserted(base, now).collect()} == {("x", "fail"), ("y", "pass"), ("z", "pass")}


def test_cache(spark):
    wanted = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    held = spark.createDataFrame([("b",)], "key string")
    assert [r.key for r in incremental.cache_misses(wanted, held).collect()] == ["a"]
    log = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, n int, v string")
    assert incremental.latest(log, "key", "n").first().v == "new"


def test_empty_tables(spark):
    blocks = spark.createDataFrame([], "block_uid long, book_id string, page int, block_ord int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string, size double")
    pages = spark.createDataFrame([], "page_uid long, book_id string, number int, text string, page_height double")
    own = structural.blocks_of(blocks, pages)
    assert structural.removals(own).count() == 0 and structural.page_islands(pages).count() == 0

"""Operators of the training-data problems: against brute force, exact round trips and small cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bookloom.llm import bpe, lookalike, packing, quality, repeated_lines, repetition, scan_noise, sentences, splitting, subjects

SF = "/root/testdata/sf0.001"
LONG = "The river ran on and on past the old mill. " * 3000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, title string, src string, uid long, key string"
SEGS = "seg_uid long, type string, text string, sentence_index int, src string, uid long"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, None, ti, "x", 7, "y") for k, t, s, ti in rows], DOCS)


def segs(spark, rows):
    return spark.createDataFrame([(k, ty, t, i, "x", 7) for k, ty, t, i in rows], SEGS)


@pytest.fixture(scope="module")
def lexicon(spark):
    words = "the a of and that in was at had to it its as by for he they were with from on his her she this".split()
    return spark.createDataFrame([(w, "en", 99) for w in words] + [(None, "en", 1)], "word string, lang string, freq long")


# Problem 8


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    random.seed(1)
    pool = "abc ABC 12 \n\t\r é ß я 你好 が ไทย 😀 <|endoftext|> 's 're'LL . , !?    x́ \x1c"
    texts = [None, "", " ", LONG[:20000], *("".join(random.choice(pool) for _ in range(random.randint(1, 60))) for _ in range(400))]
    df = docs(spark, [(k, text, "s", None) for k, text in enumerate(texts)]).repartition(3)
    got = {r.doc_id: r.ids for r in bpe.token_ids(df).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert got[k] == t.encode(text or "", add_special_tokens=False).ids, repr(text)[:80]
    counts = {r.doc_id: r.tokens for r in bpe.token_counts(df).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.token_ids(df.limit(0)).count() == 0


# Problem 9


def test_packing(spark):
    random.seed(2)
    rows = [(k, random.choice([0, 1, random.randint(1, 2048), random.randint(1, 9000), None])) for k in range(3000)]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, tokens int")
    got = packing.containers(df).collect()
    size, pieces = {}, {}
    for r in got:
        size[r.container] = size.get(r.container, 0) + r.tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.tokens))
    assert max(size.values()) <= packing.CAPACITY
    assert set(pieces) == {k for k, n in rows if n}
    for k, n in rows:
        if n:
            own = sorted(pieces[k])
            assert sum(t for _, t in own) == n and [p for p, _ in own] == list(range(len(own))) and (len(own) == 1) == (n <= packing.CAPACITY)
    assert sum(size.values()) / (len(size) * packing.CAPACITY) > 0.95
    assert packing.containers(df.limit(0)).count() == 0


def test_containers_do_not_depend_on_partitions(spark):
    random.seed(9)
    df = spark.createDataFrame([(k, random.randint(1, 3000)) for k in range(500)], "doc_id long, tokens int")
    one = {tuple(r) for r in packing.containers(df.repartition(1)).collect()}
    own, block = spark.conf.get("spark.sql.shuffle.partitions"), packing.BLOCK
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        assert one == {tuple(r) for r in packing.containers(df.repartition(5, "tokens")).collect()}
        packing.BLOCK = 50
        many = packing.containers(df).collect()
        assert len({r.container >> 32 for r in many}) == 10 and sum(r.tokens for r in many) == sum(r[3] for r in one)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
        packing.BLOCK = block


def test_classes_fill_by_count():
    bins = packing.pack([512] * 9, 2048)
    assert sorted(map(len, bins)) == [1, 4, 4]


# Problem 4


def test_pieces(spark):
    random.seed(3)
    texts = [None, "", "short", LONG[:5000], "x" * 1200, "字" * 700, "Para one. " * 20 + "\n\n" + "Para two, then more; " * 40, "😀 " * 400]
    df = spark.createDataFrame([(k, t, 300, 40) for k, t in enumerate(texts)], "k int, text string, max_chars int, overlap_chars int")
    rows = df.select("k", "text", F.inline_outer(splitting.pieces(F.col("text"), F.col("max_chars"), F.col("overlap_chars"))).alias("piece", "start", "p")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.k, []).append(r)
    assert by[0][0].p is None and [r.p for r in by[1]] == [""] and [r.p for r in by[2]] == ["short"]
    for k in range(3, len(texts)):
        own = sorted(by[k], key=lambda r: r.piece)
        assert len(own) > 1 and all(len(r.p) <= 300 for r in own)
        rebuilt = ""
        for before, r in zip([None, *own], own):
            lead = len(rebuilt) - r.start
            assert lead == 0
            body = r.p
            if before is not None:
                over = next(n for n in range(min(40, len(before.p)), -1, -1) if before.p.endswith(body[:n]) and texts[k].startswith(body[n:], r.start))
                assert over > 0 or " " not in before.p[-40:]
                body = body[over:]
            rebuilt += body
        assert rebuilt == texts[k]


def test_first_piece_and_clusters(spark):
    """The first piece has the whole limit; characters with accents stay whole."""
    words, accents = "word " * 100, "e\u0301" * 200
    df = spark.createDataFrame([(1, words), (2, accents)], "k int, t string")
    rows = {r.k: r.p for r in df.select("k", splitting.pieces(F.col("t"), F.lit(101), F.lit(21)).alias("p")).collect()}
    assert len(rows[1][0].text) == 100 and all(len(p.text) <= 101 for k in rows for p in rows[k])
    assert all(p.start % 2 == 0 for p in rows[2])


def test_oversized(spark):
    chapters = spark.createDataFrame([(1, "x" * 50), (1, "x" * 50), (2, "y"), (3, None)], "chapter_uid long, text string")
    own = segs(spark, [(1, "paragraph", "a b " * 20, 0), (2, "chapter_heading", "a b " * 20, 0), (3, "other", "z" * 999, 0)])
    limits = spark.createDataFrame([("chapter", "chapter", 1, 40, 5), ("segment", "paragraph", 1, 60, 10), ("segment", "chapter_heading", 1, 90, 0)], "item string, type string, min_chars int, max_chars int, overlap_chars int")
    assert sorted(map(tuple, splitting.oversized(chapters, own, limits).collect())) == [("chapters", 1), ("segments", 1)]


# Problem 3


def test_consistent_form():
    same = [
        ("Wendorveness", "Wеndorvеnеss"),
        ("why fire", "ｗｈｙ ﬁre"),
        ("café", "café"),
        ("a b", "a b"),
        ("ab", "a​b"),
        ("well-known", "well‑known"),
        ("ёлка", "ёлка"),
        ("が", "が"),
        ("人", "⼈"),
        ("он сказал оса", "он сказал ocа"),
    ]
    for a, b in same:
        assert lookalike.consistent(a) == lookalike.consistent(b), (a, b)
    for a, b in [("ɡame", "game"), ("Օսnо", "Ouno"), ("ᎪᏞᏞ", "ALL"), ("ꓮꓡꓡ", "ALL"), ("𝐇𝐞𝐥𝐥𝐨", "Hello"), ("ℓine", "line")]:
        assert lookalike.consistent(a) == lookalike.consistent(b), (a, b)
    assert lookalike.consistent("Երևան") == "Երևան" and lookalike.consistent("ᏣᎳᎩ") == "ᏣᎳᎩ"
    for a, b in [("a b", "a  b"), ("word", "Word"), ("e", "é"), ("1", "2"), ("a\nb", "a b"), ("l", "I")]:
        assert lookalike.consistent(a) != lookalike.consistent(b)
    assert lookalike.consistent(None) is None and lookalike.consistent("") == ""
    assert lookalike.consistent(lookalike.consistent(LONG)) == LONG


def test_forms(spark):
    got = {r.doc_id: r.form for r in lookalike.forms(docs(spark, [(1, "ｗｈｙ", "s", None), (2, None, "s", None)])).collect()}
    assert got == {1: "why", 2: None}


def test_forms_query_gives_segments(spark):
    from bookloom.llm import queries

    rows = queries.p3_forms(spark, SF).collect()
    got = {(r.src, r.uid): r.form for r in rows}
    want = {("documents", r.doc_id): lookalike.consistent(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want |= {("segments", r.seg_uid): lookalike.consistent(r.text) for r in spark.read.parquet(f"{SF}/segments.parquet").collect()}
    assert got == want and len(rows) == len(got)


def test_pairs(spark):
    d = docs(spark, [(1, "abc", "s", None), (2, "аbc", "s", None), (3, "abc", "s", None), (3, "abc", "s", None), (4, None, "s", None), (5, "​", "s", None), (6, "⁠", "s", None), (7, "", "s", None)])
    s = segs(spark, [(1, "paragraph", "abc", 0), (9, "paragraph", "ａbc", 0)])
    assert sorted(map(tuple, lookalike.found(d, s).collect())) == [("documents", 1, 2), ("documents", 2, 3), ("segments", 1, 9)]


def test_groups_give_the_links_of_the_pairs(spark):
    d = docs(spark, [(1, "abc", "s", None), (2, "аbc", "s", None), (3, "abc", "s", None), (3, "abc", "s", None), (4, "x", "s", None), (5, "x", "s", None), (6, None, "s", None)])
    texts = lookalike.both(d, segs(spark, [(1, "paragraph", "abc", 0)]))
    rows = lookalike.groups(texts).collect()
    assert sorted(r.uid for r in rows) == [1, 2, 3]
    pairs = {("documents", min(a.uid, b.uid), max(a.uid, b.uid)) for a in rows for b in rows if a.grp == b.grp and a.variant != b.variant}
    assert pairs == {tuple(r) for r in lookalike.pairs(texts).collect()}


# Problem 5


def test_identifier():
    same = ["Last corrected on 7.3.2022 by volunteer no. 809", "  LAST corrected on Dec 10, 2009 by volunteer no. 3 |", "Last c0rrected on 2001-02-03 by vоlunteer no. 1", "* Last corrccted on 1 July 2004 by volunteer no. 9 *"]
    assert len({repeated_lines.identifier(x) for x in same}) == 1
    for bare in ("", "  ", "12", "[12]", "- iv -", "Page 7"):
        assert repeated_lines.identifier(bare) is None
    assert repeated_lines.identifier("One") != repeated_lines.identifier("Two")


def test_identifier_of_long_lines():
    """No rule depends on how long a line is."""
    for size in (5, 60, 400):
        rest = "so many words that nobody reads this notice to its end " * size
        assert len({repeated_lines.identifier(x) for x in (f"ii {rest}", f"iv {rest}", rest, f"{rest} xii.")}) == 1
    assert repeated_lines.identifier("=" * 90 + " xx") is None and repeated_lines.identifier("." * 300 + " page 7") is None
    assert repeated_lines.identifier("x i x i the letters of a line") == repeated_lines.identifier("x i x i the letters of a line.")
    one = "This notice has more than a hundred and twenty letters so that its identifier is a hash of them and says nothing at all of what each of them is when they are read one by one"
    assert repeated_lines.identifier(one).startswith("#") and not repeated_lines.identifier(one.replace("nothing", "noth�ng")).startswith("#")


def test_long_lines_with_unread_letters(spark):
    one = "This notice has more than a hundred and twenty letters so that its identifier is a hash of them and says nothing at all of what each of them is when they are read one by one"
    rows = [(k, f"Own {chr(97 + k)}\n{one}", "s", None) for k in range(8)] + [(90, one.replace("nothing", "noth�ng"), "s", None), (91, one.replace("nothing", "sev�ral"), "s", None)]
    blocks = spark.createDataFrame([], "block_uid long, book_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string")
    pages = spark.createDataFrame([], "book_id string, number int, page_height double")
    got = {tuple(r) for r in repeated_lines.found(docs(spark, rows), blocks, pages).collect()}
    assert got == {("documents", k, 1) for k in range(8)} | {("documents", 90, 0)}


def test_repeated_lines(spark):
    rows = [(k, f"Text {chr(97 + k)} own line\nShare this page, no. {k}\n\nCopyright © {2000 + k} Reading Room", "s", None) for k in range(20)]
    rows += [(100, None, "s", None), (101, "", "s", None), (102, "Sh�re this page, no. 5", "s", None), (103, "Share this page", None, None)]
    blocks = spark.createDataFrame([(k, "b", k, (0.0, 10.0, 9.0, 20.0), f"The Title {k}") for k in range(4)] + [(9, "b", 0, None, "The Title"), (8, "b", 1, (0.0, 300.0, 9.0, 310.0), "The Title")], "block_uid long, book_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string")
    pages = spark.createDataFrame([("b", k, 700.0) for k in range(4)] * 2, "book_id string, number int, page_height double")
    got = {tuple(r) for r in repeated_lines.found(docs(spark, rows), blocks, pages).collect()}
    assert got == {("documents", k, n) for k in range(20) for n in (1, 3)} | {("documents", 102, 0)} | {("blocks", k, 0) for k in range(4)}
    clean = repeated_lines.without(docs(spark, rows[:2]), spark.createDataFrame([("documents", 0, 1)], "src string, uid long, line_no int"), "doc_id", "documents").orderBy("doc_id").collect()
    assert clean[0].text == "Text a own line\n\nCopyright © 2000 Reading Room" and clean[1].text == rows[1][1]
    assert repeated_lines.found(docs(spark, []), blocks.limit(0), pages.limit(0)).count() == 0


def test_cleaned_documents_and_margins(spark):
    rows = [(k, f"Own line {chr(97 + k)}\nShare this page, no. {k}", "s", None) for k in range(20)] + [(100, None, "s", None)]
    held = [(k, "b", k, (0.0, 10.0, 9.0, 20.0), f"The Title {k}\nmargin note {chr(97 + k)}") for k in range(4)] + [(8, "b", 1, (0.0, 300.0, 9.0, 310.0), "The Title"), (9, "b", 0, None, None)]
    blocks = spark.createDataFrame([*held, held[0]], "block_uid long, book_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string")
    pages = spark.createDataFrame([("b", k, 700.0) for k in range(4)], "book_id string, number int, page_height double")
    got = [tuple(r) for r in repeated_lines.cleaned(docs(spark, rows), blocks, pages).collect()]
    want = {("documents", k, f"Own line {chr(97 + k)}") for k in range(20)} | {("documents", 100, None)}
    want |= {("blocks", k, f"margin note {chr(97 + k)}") for k in range(4)} | {("blocks", 8, "The Title"), ("blocks", 9, None)}
    assert len(got) == len(want) and set(got) == want


def test_clean_query_gives_blocks(spark):
    from bookloom.llm import queries

    got = queries.p5_clean(spark, SF)
    assert got.columns == ["src", "uid", "text"] and {r.src for r in got.select("src").distinct().collect()} == {"documents", "blocks"}


def test_blocks_of_lines(spark):
    """Blocks of every length, in documents and margins, against all runs of lines counted one by one."""
    random.seed(11)
    notice = [f"Notice of the {w} kind" for w in "first second third fourth fifth sixth seventh".split()]
    rows = []
    for k in range(40):
        a, b = sorted(random.sample(range(8), 2))
        rows.append((k, "\n".join([f"Own {chr(97 + k % 26)}{chr(97 + k // 26)} begins", *notice[a:b], f"Own {chr(97 + k % 26)}{chr(97 + k // 26)} ends"]), "s", None))
    margins = [(k, "b", k, (0.0, 10.0, 9.0, 20.0), f"The Title {k}\nChapter of the Mill") for k in range(4)]
    blocks = spark.createDataFrame(margins, "block_uid long, book_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string")
    pages = spark.createDataFrame([("b", k, 700.0) for k in range(4)], "book_id string, number int, page_height double")
    got = repeated_lines.repeated_blocks(docs(spark, rows), blocks, pages).collect()
    runs = {}
    for k, text, _, _ in rows:
        lines = text.split("\n")
        for i in range(len(lines)):
            for j in range(i + 2, len(lines) + 1):
                runs.setdefault(tuple(lines[i:j]), set()).add(k)
    often = {run: len(of) for run, of in runs.items() if len(of) >= 5}
    want = set()
    for _, text, _, _ in rows:
        lines, end = text.split("\n"), 0
        for i in range(len(lines)):
            longest = max((run for run in often if tuple(lines[i : i + len(run)]) == run), key=len, default=())
            if longest and i >= end:
                want.add((longest, often[longest]))
            end = max(end, i + len(longest))
    docs_got = {(tuple(r.block), r.n_docs) for r in got if r.src == "documents"}
    assert docs_got == want
    assert [(len(r.block), r.n_docs) for r in got if r.src == "blocks"] == [(2, 4)]
    assert repeated_lines.repeated_blocks(docs(spark, []), blocks.limit(0), pages.limit(0)).count() == 0


# Problem 6


def test_share():
    once = "the stone at the mill was tolerable and the paper admired the journey".split()
    assert repetition.share(once, False) < 0.2
    assert repetition.share(once * 2, False) == 0.5
    loop = "we saw the old mill".split() + "the old mill".split() * 5
    assert repetition.share(loop, False) == pytest.approx(15 / 20)
    with_error = "we saw the old grey mill by the river".split() + "uh we saw the old gray mill by the river".split()
    assert repetition.share(with_error, False) >= 9 / 19
    assert repetition.share([], False) == 0.0 and repetition.share(["a"], False) == 0.0
    assert repetition.share(list("秘密であった秘密であった秘密であった"), True) > 0.6


def test_loops_found(spark):
    trusted = spark.createDataFrame([(f"A clean passage number {k} tells of {k * 7} things that nobody had heard of before.",) for k in range(60)], "text string")
    rows = [(k, f"take {k} says what it had to say about the {k * 3} houses and the {k + 5} fields") for k in range(200)]
    rows += [(900, "we saw the old mill we saw the old mill we saw the old mill"), (901, None), (902, "  "), (903, "no")]
    rows += [(k, f"item {k} was was was was was was was was was was lost") for k in range(904, 920)]
    rows.append(rows[200])
    df = spark.createDataFrame(rows, "review_id long, transcript string")
    assert {r.review_id for r in repetition.found(df, trusted).collect()} == {900, *range(904, 920)}
    assert repetition.found(df.limit(0), trusted.limit(0)).count() == 0


def test_scores_give_every_share(spark):
    trusted = spark.createDataFrame([(f"A clean passage number {k} tells of {k * 7} things that nobody had heard of.",) for k in range(60)], "text string")
    rows = [(1, "the mill and the river and the road"), (2, "we saw the old mill by the river"), (3, None), (4, "one"), (5, "a b c d e f a b c d e f")]
    got = {r.review_id: r for r in repetition.scored(spark.createDataFrame(rows, "review_id long, transcript string"), trusted).collect()}
    assert set(got) == {1, 2, 4, 5} and all(r.share is not None and r.score is not None for r in got.values())
    assert got[5].share == 0.5 and got[2].share == 0.0 and got[5].score > got[2].score


def test_events_against_plain_counts():
    import numpy as np

    random.seed(12)
    texts = [[random.choice("abcd") for _ in range(random.randint(0, 12))] for _ in range(50)]
    ids = {c: k * 7919 + 1 for k, c in enumerate("abcd")}
    words = np.array([ids[c] for t in texts for c in t], np.int64)
    starts = np.cumsum([0, *map(len, texts)])
    for n, (buckets, of) in enumerate(repetition.events(words, starts), 1):
        times = (buckets // repetition.BUCKETS) % repetition.TIMES
        for k, text in enumerate(texts):
            seen, want = {}, []
            for i in range(len(text) - n + 1):
                gram = tuple(text[i : i + n])
                want.append(min(repetition.TIMES - 1, seen.get(gram, 0)))
                seen[gram] = seen.get(gram, 0) + 1
            assert times[of == k].tolist() == want


def test_loops_found_whatever_else_is_there(spark):
    """A loop among many short transcripts, without trusted text, and a share of exactly a third."""
    rows = [(k, f"take {k} says what it had to say") for k in range(3000)]
    rows += [(9000, "we saw the old mill we saw the old mill we saw the old mill"), (9001, "ash oak elm fir yew bay ash oak elm")]
    df = spark.createDataFrame(rows, "review_id long, transcript string")
    trusted = spark.createDataFrame([("the road went on and on and the miller went on and on and the river ran on and on",)] * 50, "text string")
    for held in (trusted, trusted.limit(0)):
        assert {r.review_id for r in repetition.found(df, held).collect()} == {9000, 9001}


def test_scores_count_all_trusted_text(spark):
    import numpy as np

    texts = [f"passage {k} of the mill " * (1 + k % 3) for k in range(6000)]
    said = ["we saw the old mill we saw the old mill", "the river and the road"]

    def seen(many):
        cut = [[repetition.xxhash.xxh64_intdigest(w.encode()) - (1 << 63) for w in repetition.tokens(t)[0]] for t in many]
        return repetition.events(np.array([w for t in cut for w in t], np.int64), np.cumsum([0, *map(len, cut)]))

    def counts(many):
        return sum(np.bincount(buckets, minlength=repetition.ORDERS * repetition.TIMES * repetition.BUCKETS) for buckets, _ in seen(many))

    want = repetition.Ratio(counts(texts), counts(said)).scores(seen(said), len(said))
    trusted = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = repetition.scored(spark.createDataFrame(list(enumerate(said)), "review_id long, transcript string"), trusted).collect()
    assert {r.review_id: r.score for r in got} == pytest.approx(dict(enumerate(want)), abs=1e-6)


def test_shares_without_recurring_stretches():
    import numpy as np

    random.seed(5)
    texts = [[random.choice(range(1, random.choice((3, 8, 30)))) for _ in range(random.randint(1, 14))] for _ in range(600)]
    words, starts = np.array([w for t in texts for w in t], np.int64), np.cumsum([0, *map(len, texts)])
    marked = repetition.recurring(repetition.events(words, starts), words, starts)
    assert 50 < marked.sum() < 550
    assert all(m or repetition.share(t, unspaced) == 0 for t, m in zip(texts, marked) for unspaced in (False, True))


# Problem 7


def test_scan_noise(spark):
    plain = "The widow carried the basket from the cottage to the market and nobody noticed the weather there."
    scan = "The widow carried the bas-\nket from the cottage to the\n12\nThe Widow of Dale\nmarket and nobody n0ticed tlie\nself-\nmade weather there."
    rows = [(k, plain + " A self-made man saw the self-made weather.", "s", None) for k in range(60)] + [(99, scan, "s", "The Widow of Dale"), (98, None, "s", None), (97, "", "s", None), (96, "one line", "s", "one line")]
    chapters = spark.createDataFrame([(1, "T", None), (1, "T", None)], "chapter_uid long, title string, text string")
    got = {tuple(r) for r in scan_noise.found(docs(spark, rows), chapters).collect()}
    want = {(0, "broken_word"), (2, "page_number"), (3, "running_head"), (4, "misread")}
    assert got == {("documents", 99, n, kind) for n, kind in want}
    assert scan_noise.found(docs(spark, []), chapters.limit(0)).count() == 0
    fixed = {r.uid: r.text for r in scan_noise.repaired_texts(docs(spark, rows), chapters).collect()}
    assert fixed[99].replace("tlie", "the") == "The widow carried the basket from the cottage to the market and nobody noticed the self-made weather there." and fixed[0] == rows[0][1] and fixed[97] == ""


def test_a_corpus_that_says_nothing_changes_nothing():
    empty = scan_noise.Model(0, {}, {})
    assert empty.readings(["h@ll", "thc", "n0ticed", "w�rd", "modern", "ab^c"]) == [None] * 6
    assert scan_noise.corrected("The h@ll of n0ticed thc w�rd", empty) == "The h@ll of n0ticed thc w�rd"


def test_words_beside_decide():
    """Of two readings that are words, the one that goes with its neighbours is taken; a word that is one itself stays unless they speak against it."""
    words = {"the": 5000, "bed": 400, "arc": 300, "are": 900, "we": 700, "an": 700, "of": 900, "light": 200}
    pairs = {"we are": 500, "an arc": 120, "arc of": 100}
    own = scan_noise.Model(20_000, words, {}, pairs)
    assert own.readings(["the", "bcd"]) == [None, "bed"]
    assert own.readings(["an", "arc", "of", "light"]) == [None] * 4
    assert own.beside("we", "are") > 1 > own.beside("an", "are")


def test_unread_letters_of_all_scripts():
    words = {"дорога": 50, "सड़क": 40, "كتاب": 60, "house": 90, "horse": 2}
    own = scan_noise.Model(1000, words, {})
    for printed, meant in (("дор�га", "дорога"), ("كت�ب", "كتاب"), ("ho�se", "house"), ("h��se", "house")):
        assert own.readings([printed]) == [meant]


def test_confusions_are_estimated(spark):
    counts = spark.createDataFrame([("the", 9000), ("thc", 60), ("house", 5000), ("carne", 100), ("came", 3000), ("tear", 700)], "word string, n long")
    words = {r.word: r.n for r in counts.collect()}
    own = scan_noise.Model(sum(words.values()), words, {})
    parts = scan_noise.estimated(counts, own)
    assert set(parts) == set(scan_noise.GIVEN) and parts["c", "e"] > parts["f", "t"] * scan_noise.GIVEN["c", "e"] / scan_noise.GIVEN["f", "t"]
    assert parts["0", "o"] == scan_noise.GIVEN["0", "o"]


def planted(texts, own, seed=13):
    """Lines of texts set in lines, clean by the model, with one misread character put into a word that is known: [(text, line_no, swap)]."""
    random.seed(seed)
    swaps = [("e", "c"), ("t", "f"), ("o", "0"), ("s", "5"), ("a", "@"), ("rn", "m"), ("m", "rn"), ("i", "!"), ("n", "ri"), ("h", "li"), ("w", "vv"), ("a", "�")]
    out = []
    for text in texts:
        lines = text.split("\n")
        if not scan_noise.set_in_lines(lines):
            continue
        bad = {n for n, _ in scan_noise.noise(text, None, own)}
        places = [(k, w) for k, line in enumerate(lines[:-1]) if k not in bad and not scan_noise.is_strange(line) for w in line.split()[1:-1] if w.isalpha() and len(w) > 4 and w in own.words]
        fits = [(k, w, a, b) for k, w in places for a, b in swaps if a in w[1:-1]]
        if fits:
            k, w, a, b = random.choice(fits)
            at = w.index(a, 1)
            lines[k] = lines[k].replace(w, w[:at] + b + w[at + len(a) :], 1)
            out.append(("\n".join(lines), k, (a, b)))
    return out


def test_planted_misreadings(spark):
    """Held-out accuracy: misread characters put into clean lines of real texts are found, by a model that has not seen them."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").filter("text is not null")
    own = scan_noise.model(documents)
    noisy = planted([r.text for r in documents.orderBy("text").collect()], own)
    found = [(line, "misread") in scan_noise.noise(text, None, own) for text, line, _ in noisy]
    assert len(noisy) > 60 and sum(found) >= 0.93 * len(found), [x[2] for x, f in zip(noisy, found) if not f]


def test_only_doubtful_lines_are_weighed(monkeypatch):
    """A line whose words have one reading each is not weighed word by word; one with a doubtful word is, as before."""
    words = {"the": 9000, "house": 5000, "was": 4000, "lost": 900}
    own = scan_noise.Model(30_000, words, {})
    asked = []
    weigh = scan_noise.Model.readings
    monkeypatch.setattr(scan_noise.Model, "readings", lambda self, line: asked.append(line) or weigh(self, line))
    for line in ("the house was lost", "The house was lost 'was' 3rd h@#0@l", "don't x2y7z9 the was"):
        assert not scan_noise.misread(line, own) and not scan_noise.misread(line, own)
    assert asked == []
    assert scan_noise.misread("thc house was lost", own) and scan_noise.misread("the h0use was lost", own)
    assert asked == [["thc", "house", "was", "lost"], ["the", "h0use", "was", "lost"]]


def test_counts_of_words_and_pairs():
    texts = ["The Self-made man -- the self-made", "", "дом the-дом", "سلام the سلام", "सड़क ab--cd a-b-", "12 --", "the man"]
    want = Counter()
    for text in texts:
        found = scan_noise._word.findall(text.lower())
        want.update(found)
        want.update(map(" ".join, zip(found, found[1:])))
    for at_once in (0, 3, 10, 1000):
        got = Counter()
        for words, n in scan_noise.counted(texts, at_once):
            assert len(words) == len(set(words)) == len(n)
            got.update(dict(zip(words, n.tolist())))
        assert got == want
    assert not list(scan_noise.counted([])) and not list(scan_noise.counted(["", "12"]))


def test_named_lines():
    """The lines of a name are those with its identifier, whatever stands in them."""
    long = "The long and winding title of a book " * 5
    lines = ["The Modern Rn", "THE MODERN M", "xii The Modern rn 7", "Tbe Modern", "the m0dern rn", "The Modérn Rn", "the mode�n rn", "12", "", "The Modern Rn goes on", "The", "Modern Rn", "Ꭲhe Modern Rn", "May the Modern", long, long.upper(), "iv " + long]
    for title in (*lines, "Nothing", "Ё"):
        name = repeated_lines.identifier(title)
        if name:
            assert repeated_lines.named(lines, name) == [k for k, line in enumerate(lines) if repeated_lines.identifier(line) == name]
    assert repeated_lines.named([], "the") == []
    assert len(repeated_lines.named(lines, repeated_lines.identifier(lines[0]))) > 3


def test_page_numbers():
    assert all(map(scan_noise.is_number, ["12", "[2]", "- 30 -", "Page 15", "vi", "2 1", "3l8"]))
    assert scan_noise.is_number("-" * 40 + " 12 " + "-" * 40) and not scan_noise.is_number("word " * 40)
    assert not any(map(scan_noise.is_number, ["", "12 apples", "civil", "1849 was late", "mix"]))


# Problems 1 and 2


def test_sentences(spark, lexicon):
    names = ["Hall", "Moore", "Lane", "Dale", "Reed"]
    single = []
    for k in range(300):
        n = names[k % 5]
        single += [f"Dr. {n} came to St. {n} at {k}.5 in the morning.", f"“Where is it?” asked {n} of the {k} men.", f"They had rope, lamps, etc.", f"The {n} stood there!"]
    rows = [(k, "paragraph", t, 1) for k, t in enumerate(single)]
    text = "Dr. Hall came to St. Dale at 7.5 in the morning. “Where is it?” asked Reed of the 9 men. They had rope, lamps, etc. The Lane stood there!The Moore stood there!  "
    rows += [(9001, "paragraph", text, 0), (9001, "paragraph", text, 0), (9002, "paragraph", None, 0), (9003, "paragraph", " \n", 0), (9004, "chapter_heading", "One. Two.", 0), (9005, "blockquote", "no mark", 0), (9006, "paragraph", LONG, 0)]
    rows += [(9007, "paragraph", "\n".join(f"item {k}\t{k}\t{k + 1}" for k in range(20)), 0)]
    got = {}
    for r in sentences.found(segs(spark, rows), lexicon).filter("seg_uid > 9000").collect():
        got.setdefault(r.seg_uid, []).append((r.start_char, r.end_char))
    cut = [text[a:b] for a, b in sorted(got[9001])]
    assert cut == ["Dr. Hall came to St. Dale at 7.5 in the morning.", "“Where is it?” asked Reed of the 9 men.", "They had rope, lamps, etc.", "The Lane stood there!", "The Moore stood there!"]
    assert got[9005] == [(0, 7)] and len(got[9006]) == 3000 and set(got) == {9001, 9005, 9006}
    assert sentences.found(segs(spark, []), lexicon).count() == 0


def test_sentences_without_marks(spark, lexicon):
    """Sentences whose marks are taken off and that are put together come apart again where the words tell it."""
    heads = {"zh": ("昨天", "后来", "因此"), "ja": ("昨日", "その後", "しかし"), "ar": ("أمس", "ثم", "لذلك")}
    middle = {"zh": ("他在河边看见了", "她在市场买了", "我们在路上遇到"), "ja": ("彼は川辺で", "彼女は市場で", "私たちは道で"), "ar": (" رأى الرجل عند النهر", " اشترت المرأة من السوق", " وجدنا على الطريق")}
    tails = {"zh": ("旧灯", "白马", "木船"), "ja": ("灯を見た", "馬を買った", "舟に乗った"), "ar": (" مصباحا قديما", " حصانا أبيض", " قاربا خشبيا")}
    marks = {"zh": "。", "ja": "。", "ar": "."}
    random.seed(14)
    single, joined, want = [], [], {}
    for lang in heads:
        make = lambda: random.choice(heads[lang]) + random.choice(middle[lang]) + random.choice(tails[lang])  # noqa: B023, E731
        single += [make() + marks[lang] for _ in range(150)]
        for k in range(5):
            parts = [make() for _ in range(3)]
            want[9000 + len(joined)] = parts
            joined.append((" " if lang == "ar" else "").join(parts))
    rows = [(k, "paragraph", t, 1) for k, t in enumerate(single)] + [(9000 + k, "paragraph", t, 0) for k, t in enumerate(joined)]
    got = {}
    for r in sentences.sentence_rows(segs(spark, rows), lexicon).filter("seg_uid >= 9000").collect():
        got.setdefault(r.seg_uid, []).append((r.sentence_index, r.text))
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == want


def test_sentence_rows_keep_what_is_no_prose(spark, lexicon):
    single = [f"They had {k} ropes and lamps." for k in range(300)]
    table = "\n".join(f"item {k}\t{k}\t{k + 1}" for k in range(20))
    own = segs(spark, [(k, "paragraph", t, 1) for k, t in enumerate(single)] + [(9001, "paragraph", table, 0), (9001, "paragraph", table, 0), (9002, "chapter_heading", "One.", 0), (9003, "blockquote", " \n", 0)])
    rows = sentences.sentence_rows(own, lexicon).collect()
    held = sorted((r.sentence_index, r.text) for r in rows if r.seg_uid == 9001)
    assert [n for n, _ in held] == list(range(len(held))) and "".join("".join(t for _, t in held).split()) == "".join(table.split())
    assert {r.seg_uid for r in rows} == {*range(300), 9001} and len({(r.seg_uid, r.sentence_index) for r in rows}) == len(rows)
    assert 9001 not in {r.seg_uid for r in sentences.found(own, lexicon).collect()}


def test_repetition_makes_no_prose(spark, lexicon):
    """The same words many times are no prose, in one line or many, one paragraph or many; said once or twice they are."""
    lamp, advert = "The lamp is best. ", "It was the best of the lamps that they had and she had to see it with her own eyes."
    once = "He had to go to the town for it, and she was with them at the end of the road when they came in."
    words = "mill road lamp barn gate lake hill wood field stone bridge tower".split()
    long = "\n".join(f"He had to go to the {a} for it, and she was with them at the {b} when they came to the {c}." for a in words[:4] for b in words[4:8] for c in words[8:])
    no = [lamp * 200, "\n".join([advert] * 50), "\n\n".join([advert + "\n" + once] * 4), "\n\n".join([f"{advert} {once}", f"{advert}\n{once}", f"{once}\n{advert}", f"{advert} {once}", f"{advert}  {once}"]), lamp * 3000]
    yes = [lamp, advert, f"{advert}\n{once}", f"{advert}\n{advert}\n{once}\n{once} Then he was by the mill.", once + "\n\n" + long]
    common = quality.common_words(lexicon)
    assert [quality.no_prose(t, common) for t in no + yes] == [True] * 5 + [False] * 5
    d = docs(spark, [(k, t, f"s{k}", None) for k, t in enumerate(no + yes)])
    empty = spark.createDataFrame([], "page_uid long, text string")
    assert {r.uid for r in quality.found(d, empty, segs(spark, []), lexicon).collect()} == set(range(5))
    assert quality.covered(no + yes) == [quality.coverage(t) > quality.COVER for t in no + yes]
    random.seed(4)
    some = ["".join(random.choices("ab ", weights=[5, 1, 1], k=random.randint(0, 300))) for _ in range(300)]
    assert quality.covered(some) == [quality.coverage(t) > quality.COVER for t in some]


def test_quality(spark, lexicon):
    prose = "It was the old house that they had seen at the end of the road, and he was in it with her.\n\nShe had to go to the town for a lamp."
    table = "\n".join(f"name{k}\t{k}\t{k * 3}" for k in range(12))
    index = "\n".join(f"Haleimor{k}, {k}, {k + 4}" for k in range(12))
    junk = "ab/cd_ef-gh" * 30
    wrapped = "It was the old house that they had\nseen at the end of the road and he\nwas in it with her."
    rows = [(1, prose), (2, table), (3, index), (4, junk), (5, wrapped), (6, None), (7, ""), (8, "x\t1\t2")]
    d = docs(spark, [(k, t, f"s{k}", None) for k, t in rows] + [(2, table, "s2", None)])
    pages = spark.createDataFrame([(k, t) for k, t in rows], "page_uid long, text string")
    own = segs(spark, [(k, "paragraph", t, 0) for k, t in rows] + [(50, "chapter_heading", table, 0)])
    got = {tuple(r) for r in quality.found(d, pages, own, lexicon).collect()}
    assert got == {(s, k) for s in ("documents", "pages", "segments") for k in (2, 3, 4)}
    stats = {r.uid: r for r in quality.text_statistics(pages.select(F.lit("pages").alias("src"), F.col("page_uid").alias("uid"), "text"), lexicon).collect()}
    assert 6 not in stats and stats[7].words == 0 and stats[1].common_words > 0.5 and stats[1].lines_ended == 1.0
    assert quality.coverage("abcdefgh" * 20) > 0.9 and quality.coverage(prose) < 0.2
    assert quality.found(d.limit(0), pages.limit(0), own.limit(0), lexicon).count() == 0


# Problem 10


def test_subjects(spark):
    words = {"law": ["court", "judge", "statute", "verdict"], "sport": ["match", "umpire", "goal", "racket"], "music": ["violin", "choir", "tune", "concert"]}
    filler = ["The house stood by the road.", "Nobody saw the lamp again.", "She went to the market early."]
    random.seed(5)

    def said(subject):
        name = "".join(random.choices("abcdefghij", k=6)).capitalize()
        return f"Then the {random.choice(words[subject])} of {name} was near the {random.choice(words[subject])} of the town."

    examples = [(s, " ".join(said(s) for _ in range(3)) + " " + random.choice(filler)) for s in words for _ in range(25)]
    rows, want = [], set()
    for k in range(300):
        s = random.choice(list(words))
        rows.append((k, "\n".join([*(said(s) for _ in range(4)), *random.sample(filler, 2)]), "s%d" % (k % 3), None))
        want.add((k, s))
    rows += [(900, None, "s0", None), (901, "", "s0", None), (902, "\n".join(filler), "s0", None), (903, "court_judge/statute_verdict/court_judge/" * 9, "s0", None)]
    ex = spark.createDataFrame([(k, s, "en", t) for k, (s, t) in enumerate(examples)] + [(999, None, "en", "x"), (998, "law", "en", None)], "example_id long, subject string, lang string, text string")
    areas = spark.createDataFrame([(s, "") for s in words], "subject string, scope string")
    lex = spark.createDataFrame([("house", "en", 3)], "word string, lang string, freq long")
    got = {tuple(r) for r in subjects.found(docs(spark, rows), ex, lex, areas).collect()}
    assert {k for k, _ in got} <= set(range(300))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert subjects.found(docs(spark, []), ex, lex, areas).count() == 0

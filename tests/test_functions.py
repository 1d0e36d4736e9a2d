import random

from pyspark.sql import functions as F

from bookloom.functions import numbers as M
from bookloom.functions import text as X


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_normalized(spark):
    assert one(spark, " “A–b”  ﬁ­ne ", X.normalized) == '"A-b" fine'
    assert one(spark, None, X.normalized) is None
    assert one(spark, "", X.normalized) == ""


def test_template(spark):
    assert one(spark, "S C R I P T U R E  7", X.template) == "scripture #"
    assert one(spark, "A B test", X.template) == "a b test"


def test_garbage_and_page_numbers(spark):
    assert one(spark, "ab�c", X.garbage_density) == 0.25
    assert one(spark, "", X.garbage_density) == 0.0
    assert one(spark, "xiv", X.is_page_number) is True
    assert one(spark, "12 a", X.is_page_number) is False


def test_roman_words(spark):
    cases = {
        "Ottokar III reigned": "Ottokar the Third reigned",
        "Emeric XIV and Emeric XVI": "Emeric the Fourteenth and Emeric the Sixteenth",
        "Volume II opens": "Volume Two opens",
        "then I slept": "then I slept",
        "Anna V. Hall": "Anna V. Hall",
    }
    for text, want in cases.items():
        assert one(spark, text, M.roman_words) == want
    assert one(spark, "CXLIV", M.roman_value) == 144 and one(spark, "xc", M.roman_value) == 90 and one(spark, "mix1", M.roman_value) is None


def test_spoken_numbers(spark):
    cases = {
        "Stall 7¾ opens": "Stall seven and three quarters opens",
        "½ a loaf": "one half a loaf",
        "It lay 4 1/2 leagues off": "It lay four and a half leagues off",
        "He cut 3 2/3 yards": "He cut three and two thirds yards",
        "In 1874 it cost $6.25, the 32nd of 2,305 lots": "In eighteen seventy-four it cost six dollars and twenty-five cents, the thirty-second of two thousand three hundred five lots",
        "$1,000,000": "one million dollars",
        "26pp at 4.05": "twenty-six pp at four point zero five",
        "1905, 1900 and 2005": "nineteen oh-five, nineteen hundred and two thousand five",
        "a1874 is no year": "aone thousand eight hundred seventy-four is no year",
        "0017": "seventeen",
        "१२ and ٣": "twelve and three",
        "1234567890123": "one two three four five six seven eight nine zero one two three",
        "no number": "no number",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", "want", M.spoken_numbers(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect() if r.got != r.want] == []
    assert one(spark, None, M.spoken_numbers) is None


def test_no_digit_survives(spark):
    random.seed(6)
    rows = [("".join(random.choices("0123456789 ,.abI$¾/", k=random.randint(0, 40))),) for _ in range(600)]
    got = spark.createDataFrame(rows, "t string").select(M.spoken_numbers(F.col("t")).alias("x")).collect()
    assert not any(c in "0123456789¾" for r in got for c in r.x)


def test_int_words(spark):
    """Against the same words put together from the digits, group by group."""

    def group(n):
        out = [M.SMALL[n // 100] + " hundred"] if n >= 100 else []
        n %= 100
        if n:
            out.append(M.SMALL[n] if n < 20 else "-".join([M.TENS[n // 10], *([M.SMALL[n % 10]] if n % 10 else [])]))
        return " ".join(out)

    def words(n):
        names, out = ["", " thousand", " million", " billion"], []
        for k in range(4):
            if n // 1000**k % 1000:
                out.insert(0, group(n // 1000**k % 1000) + names[k])
        return " ".join(out) or "zero"

    random.seed(7)
    values = [0, 7, 19, 20, 21, 99, 100, 110, 999, 1000, 1001, 20_000, 10**6, 3_000_000_007, *(random.randrange(10 ** random.randint(1, 12)) for _ in range(200))]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", M.int_words(F.col("n")).alias("w")).collect()
    assert {r.n: r.w for r in rows} == {v: words(v) for v in values}


def test_year_style(spark):
    cases = {
        "The siege of one thousand ninety-nine ended it.": "The siege of ten ninety-nine ended it.",
        "It burned in one thousand six hundred sixty-six at dawn.": "It burned in sixteen sixty-six at dawn.",
        "By one thousand three hundred the mills stood.": "By thirteen hundred the mills stood.",
        "one thousand eight hundred and fifteen was a wet year.": "eighteen fifteen was a wet year.",
        "The deed is of AD one thousand and two.": "The deed is of AD ten oh-two.",
        "She was born in AD one thousand and twelve.": "She was born in AD ten twelve.",
        "He counted one thousand and two lamps.": "He counted one thousand and two lamps.",
        "A host of one thousand and three men came.": "A host of one thousand and three men came.",
    }
    for text, want in cases.items():
        assert one(spark, text, M.year_style) == want


def test_number_values():
    cases = {
        "in 1874 and 6.25": ["1874", "6.25"],
        "eighteen seventy-four": ["1874"],
        "one thousand eight hundred and seventy-four": ["1874"],
        "nineteen oh-five or nineteen hundred": ["1905", "1900"],
        "six point two five": ["6.25"],
        "the thirty-second of two thousand three hundred five": ["32", "2305"],
        "two million and three thousand": ["2003000"],
        "five six": ["5", "6"],
        "no number and none": [],
    }
    for text, want in cases.items():
        assert M.values_of(text) == want, text


def test_checked_rewrite(spark):
    rows = [("He had 12 lamps", "He had twelve lamps", "He had twelve lamps"), ("He had 12 lamps", "He had ten lamps", "He had twelve lamps"), ("He had 12 lamps", "He had twelve old lamps", "He had twelve lamps"), ("In 1810", None, "In eighteen ten"), ("none", "x", "none")]
    df = spark.createDataFrame(rows, "a string, b string, want string").select("want", M.checked_rewrite(F.col("a"), F.col("b")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_excerpt(spark):
    assert one(spark, "abc\ndefNEEDLEghi", lambda c: X.excerpt(c, "NEEDLE", 4)) == " defNEEDLEghi"
    assert one(spark, "nothing", lambda c: X.excerpt(c, "NEEDLE", 4)) == "NEEDLE"

from pyspark.sql import functions as F

from chunkwell.functions import text as X
from chunkwell.sources.languages import LANGUAGES


def column(spark, values, make, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"n int, {schema}")
    return [r[1] for r in rows.select("n", make(F.col("v")).alias("out")).orderBy("n").collect()]


def test_sentences(spark):
    texts = [
        "Hello world. This is a test! Is it working? Yes.",
        "Hello... Wait?! a|b. 3.14 is v1.2.3. Done.) Next “q.” ok。不",
        "", None, "    ", "one", "a. b. c",
    ]
    assert column(spark, texts, X.split_sentences) == [
        ["Hello world.", "This is a test!", "Is it working?", "Yes."],
        ["Hello...", "Wait?!", "a", "b.", "3.14 is v1.2.3.", "Done.) Next “q.”", "ok。不"],
        [], [], [], ["one"], ["a. b.", "c"],
    ]


def test_tokens(spark):
    texts = ["Hello, world-123!", "don’t foo_bar x—y -'abc'- '-abc-' ---", None, "ΣΑΣ İx éa"]
    assert column(spark, texts, X.tokenize) == [["hello", "world-123"], ["dont", "foobar", "xy", "'abc'", "abc"], [], ["σασ", "ix", "ea"]]


def test_ngrams(spark):
    cases = [("word", 3, 3, "wor ord"), ("text", 2, 3, "te ex xt tex ext"), ("слово", 4, 4, "слов лово"), ("Hi, world!", 3, 3, "hiw iwo wor orl rld"), ("go", 3, 4, ""), ("test", 4, 3, ""), ("a😀b𝒳c", 2, 2, "ab b𝒳 𝒳c"), (None, 1, 2, "")]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "n int, v string, a int, b int")
    got = [r[1] for r in rows.select("n", X.char_ngrams(F.col("v"), F.col("a"), F.col("b"))).orderBy("n").collect()]
    assert got == [c[3].split() for c in cases]


def test_abbreviations(spark):
    texts = ["I live in the U.S.A. now.", "U.S. army", "A.B.Cd", "В П.Т.О. есть", "etc.....", "aП.Т.О.b", ""]
    assert column(spark, texts, X.normalize_abbreviations) == ["I live in the USA. now.", "U.S. army", "ABCd", "В П.Т.О. есть", "etc...", "aПТОb", ""]


def test_contractions(spark):
    rows = spark.createDataFrame([(0, "i.e.g.", "english"), (1, "was.", "dutch"), (2, "FILM.", "french"), (3, "e.g. x", "unknown"), (4, "d.h. z.B. u.a.", "german")], "n int, v string, l string")
    got = [r[0] for r in rows.orderBy("n").select(X.normalize_abbreviations(F.col("v"), F.col("l"))).collect()]
    assert got == ["ieg.", "was", "FILM", "e.g. x", "dh zB ua"]


def test_languages():
    counts = {n: len(set(x.stopwords)) for n, x in LANGUAGES.items()}
    assert (counts["english"], counts["german"], counts["french"], counts["spanish"]) == (126, 176, 80, 304)
    assert {x.script for x in LANGUAGES.values()} == {"Latin", "Cyrillic", "Arabic"}


def test_stopwords_are_whole():
    """The distinct counts of SURVEY 1.4."""
    expected = {"arabic": 62, "dutch": 107, "english": 126, "french": 80, "german": 176, "indonesian": 693, "italian": 203, "portuguese": 193, "russian": 159, "spanish": 304, "vietnamese": 63}
    assert {n: len(set(x.stopwords)) for n, x in LANGUAGES.items()} == expected
    assert {"adalah", "adanya", "akhirnya"} <= set(LANGUAGES["indonesian"].stopwords)

from pyspark.sql import functions as F

from chunkwell.functions import language as L
from chunkwell.sources.languages import LANGUAGES


def test_detection(spark):
    cases = [  # fixed values
        ("This is a sample sentence for language detection.", "english"), ("Ceci est une phrase d'exemple pour la détection de la langue.", "french"),
        ("Это пример предложения для определения языка.", "russian"), ("ما هذا إلا مثال بسيط لتحديد اللغة", "arabic"), ("Đi đâu đó", "vietnamese"),
        ("Hotel in Berlin", "unknown"), ("Please go.", "unknown"), ("", "unknown"), (None, "unknown"), ("the the the and и", "unknown"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "n int, v string")
    assert [r[0] for r in rows.orderBy("n").select(L.detect_language(F.col("v"))).collect()] == [c[1] for c in cases]


def test_stopwords(spark):
    cases = [  # fixed values
        ("This is a sample sentence, and we want to remove some words from it.", "english", "sample sentence want remove words"),
        ("Это просто пример предложения, и из него нужно удалить некоторые слова.", "russian", "просто пример предложения нужно удалить некоторые слова"),
        ("Leave, me.", "unknown", "Leave, me."), ("Leave, me.", "polish", "Leave, me."),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "n int, v string, l string")
    assert [r[0] for r in rows.orderBy("n").select(L.remove_stopwords_text(F.col("v"), F.col("l"))).collect()] == [c[2] for c in cases]


def test_stemming(spark):
    cases = [  # fixed values
        ("english", "running nationalization cats beautifully", "runn nation cat beautiful"), ("english", "is on running", "is on runn"), ("russian", "машинами хороший бегала", "машин хорош бегал"),
        ("german", "gemacht kinder", "macht kind"), ("vietnamese", "chạy nhảy", "chạy nhảy"), ("english", "bed yes ing", "b y "), ("english", "", ""), ("unknown", "cats", "cats"),
    ]
    rows = spark.createDataFrame([(i, c[0], c[1].split()) for i, c in enumerate(cases)], "n int, l string, v array<string>")
    assert [" ".join(r[0]) for r in rows.orderBy("n").select(L.stem_tokens(F.col("v"), F.col("l"))).collect()] == [c[2] for c in cases]


def test_word_lists_are_whole():
    """Words in each list, one of them twice in two lists."""
    n = {x.name: len(x.stopwords) for x in LANGUAGES.values()}
    assert n == {"arabic": 62, "dutch": 107, "english": 126, "french": 80, "german": 176, "indonesian": 693, "italian": 204, "portuguese": 193, "russian": 159, "spanish": 305, "vietnamese": 63}
    assert {x.name for x in LANGUAGES.values() if len(set(x.stopwords)) < len(x.stopwords)} == {"italian", "spanish"}
    assert {"adalah", "sebagaimana", "bermacam-macam"} <= set(LANGUAGES["indonesian"].stopwords) and "tuvieseis" in LANGUAGES["spanish"].stopwords


def test_long_words_of_a_list(spark):
    row = spark.createDataFrame([("Sebagaimana adanya, demikianlah persoalan rumah itu.",)], "v string").select(L.detect_language(F.col("v")).alias("l"), L.remove_stopwords_text(F.col("v"), F.lit("indonesian")).alias("t")).first()
    assert tuple(row) == ("indonesian", "rumah")


def test_second_trim(spark):
    rows = spark.createDataFrame([(["-'abc'-", "'the'"],)], "v array<string>")
    assert rows.select(L.remove_stopwords(F.col("v"), F.lit("english"))).first()[0] == ["'abc'", "the"]

"""Batches from texts on give what rows give, on odd texts too."""

import random

import pytest
from pyspark.sql import functions as F

from chunkwell.functions import bulk_text as B
from chunkwell.operators import segment as S
from chunkwell.plans.options import FULL_TEXT, PER_SENTENCE, SegmentOptions

PARTS = [*"'-–.!?…”\"»|_ \t\n\r\x0b\xa0 \x00", *"ABCabcxyz09АБВабвЁЖıİΣςσéßǅ٣א文𝒳́҃", "U.S.A. ", "A.B.", "И.О.К", "x И.О.x", "...", "....", B.ELLIPSIS, "''", "--", "'-", " the and of ", " и не на ", " e.g. z.B. ", " في من ", ". ", "! "]
OPTIONS = {
    "default": SegmentOptions(9),
    "tokens": SegmentOptions(9, language_detection_tokens=3),
    "forced": SegmentOptions(9, language="german"),
    "full": SegmentOptions(9, language_detection_mode=FULL_TEXT, min_split_similarity=0.1),
    "sentences": SegmentOptions(9, language_detection_mode=PER_SENTENCE),
    "ngrams": SegmentOptions(9, tfidf_min_ngram_size=2, tfidf_max_ngram_size=3),
}


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(11)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += [" ".join(r.choice(("The cats ran.", "Cats and dogs sat!", "The sun is hot.", "Dogs ran.")) for _ in range(12)) for _ in range(40)]
    rows = spark.createDataFrame([*enumerate([None, "", "'", "-'-", "'" * 99, *texts])], "doc_id long, text string")
    broken = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.expr("cast(X'616263FF202E2064C3' as string)").alias("text"))
    return rows.repartition(3).unionByName(broken).cache()


def test_odd_texts_as_by_rows(odd):
    for name, o in OPTIONS.items():
        rows = lambda arrow: sorted(map(repr, S.segment(odd, o, arrow=arrow).collect()))  # noqa: B023, E731
        assert rows(True) == rows(False) != [], name


def test_breaks_as_by_rows(odd):
    for o in (SegmentOptions(9), SegmentOptions(9, min_split_similarity=0.1), SegmentOptions(9, depth_threshold=0.2)):
        rows = odd.select(B.breaks(F.col("text"), o).alias("a"), S.boundaries(S.scores_column(F.col("text"), o), o).alias("b")).collect()
        assert all(r.a == r.b for r in rows) and any(True in r.a for r in rows)


def test_texts_are_worked_on_in_batches_only(odd):
    """A function of array elements takes microseconds a token: none is left in the plan of large tables."""
    plan = S.segment(odd.select("doc_id", "text"), SegmentOptions(9), arrow=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp" not in plan and plan.count("ArrowEvalPython") == 1


def test_words_serve_later_tasks():
    import pickle

    key = pickle.dumps(SegmentOptions(9))
    own = B.segmenter(key).read(["The cats are running. And the dogs ran."])
    assert B.segmenter(key) is own and own.words.seen
    assert own.terms.texts(own.terms.term).to_pylist()
    for n in range(1, 9):
        B.segmenter(pickle.dumps(SegmentOptions(n)))
    assert len(B.SEGMENTERS) <= B.KEPT_SEGMENTERS


def test_dense_by_table_moves_no_vectors_of_sentences(spark):
    """Chunks are those of segment_dense(); pairs of ids are scored once, and sentences and vectors stay out of shuffles."""
    r = random.Random(5)
    docs = spark.createDataFrame([(n, " ".join(f"W{r.randint(0, 9)} is here." for _ in range(n % 7))) for n in range(40)] + [(40, None)], "doc_id long, text string")
    vectors = spark.createDataFrame([(n, [r.random() for _ in range(4)]) for n in range(9)], "id long, embedding array<float>")  # 9 of 11
    number, o = lambda i: F.pmod(F.col("doc_id") * 31 + i, F.lit(11)), SegmentOptions(7)
    rows = S.sentence_rows(docs, o).withColumn("id", number(F.col("i")))
    expected = S.segment_dense(rows.join(vectors.withColumn("embedding", F.col("embedding").cast("array<double>")), "id", "left"), o)
    got = S.segment_by_table(docs, o, vectors, number)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect())) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("collect_list" in line and "embedding" in line for line in plan.split("\n"))


def test_service_answers_in_one_pass(spark):
    """Requests were parsed and read once more for each set of options."""
    from chunkwell.sources.service import respond

    bodies = ['{"text":"A b. C d.","max_tokens":2}', '{"text":"A b. C d.","max_tokens":9}', '{"text":"A b."}', "no", '{"text":null,"max_tokens":9}', '{"text":"x","max_tokens":9,"embedding_cache_mode":"force"}']
    rows = respond(spark.createDataFrame([*enumerate(bodies)], "n int, body string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert "Union" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.status, r.t) for r in rows.orderBy("n").select("status", F.get_json_object("response", "$.stats.total_chunks").alias("t")).collect()]
    assert got == [(200, "2"), (200, "1"), (400, None), (400, None), (200, "0"), (200, "1")]

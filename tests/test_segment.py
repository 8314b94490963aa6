import pytest
from pyspark.sql import functions as F

from chunkwell.operators import segment as S
from chunkwell.plans.options import SegmentOptions

QUICK = "The solar system consists of the Sun and the planets. A rocket journey to other planets takes a long time. The ocean covers most of the Earth's surface. Amazing creatures live in the depths of the ocean."
CASES = [
    ("The solar system is vast. Planets orbit the sun. Oceans are deep and blue. Fish swim in the sea.", 20, [19]),
    ("This is a very long sentence about a single topic that keeps going. This is another long sentence that continues the same idea. And a third one to ensure the limit is hit.", 20, [13, 20]),
    ("This single sentence is deliberately made to be much longer than the maximum token limit to test the edge case handling.", 15, [21]),
    (QUICK, 15, [10, 10, 8, 9]),
    ("Mars is red. Venus is hot. The ocean is blue.", 10, [10]),
]


def tokens(spark, texts, options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in S.segment(rows, options).orderBy("doc_id", "chunk_index").collect():
        out[r.doc_id].append(r.num_tokens)
    return list(out.values())


def test_conformance_cases(spark):
    for limit in {c[1] for c in CASES}:
        own = [c for c in CASES if c[1] == limit]
        assert tokens(spark, [c[0] for c in own], SegmentOptions(limit)) == [c[2] for c in own]


def test_empty_texts(spark):
    assert tokens(spark, ["", None, " \n ", "!!!"], SegmentOptions(5)) == [[], [], [], [0]]


def test_chunks(spark):
    r = S.segment(spark.createDataFrame([(7, "A b. C d.")], "doc_id long, text string"), SegmentOptions(9)).first()
    assert (r.doc_id, r.chunk_index, r.text, r.sentences, r.num_tokens) == (7, 0, "A b. C d.", ["A b.", "C d."], 4)


def model(counts, breaks, most):
    """Greedy packing in plain Python."""
    out, own, total = [], [], 0
    for i, n in enumerate(counts):
        if n > most:
            out += ([own] if own else []) + [[i]]
            own, total = [], 0
            continue
        if own and ((i and breaks[i - 1]) or total + n > most):
            out.append(own)
            own, total = [], 0
        own, total = [*own, i], total + n
    return [x[0] for x in out + ([own] if own else [])]


def test_packing_against_a_model(spark):
    import random

    random.seed(3)
    cases = []
    for n in range(60):
        k = random.randint(1, 12)
        cases.append((n, [random.randint(0, 9) for _ in range(k)], [random.random() < 0.3 for _ in range(k - 1)]))
    rows = spark.createDataFrame(cases, "n int, c array<int>, b array<boolean>")
    got = [r[0] for r in rows.orderBy("n").select(S.chunk_starts(F.col("c"), F.col("b"), 7)).collect()]
    assert got == [model(c, b, 7) for _, c, b in cases]


def test_boundaries(spark):
    rows = spark.createDataFrame([([0.5, 0.1, 0.4, 0.2, 0.9],)], "s array<double>")
    both = rows.select(S.boundaries(F.col("s"), SegmentOptions(5)).alias("m"), S.boundaries(F.col("s"), SegmentOptions(5, depth_threshold=0.4)).alias("d"), S.boundaries(F.col("s"), SegmentOptions(5, min_split_similarity=0.3)).alias("f")).first()
    assert both.m == [False, True, False, True, False]
    assert both.d == [False, False, False, True, False]
    assert both.f == [False, True, False, True, False]


def test_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "x. y.")], "doc_id long, text string")
    plan = S.segment(rows, SegmentOptions(5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_dense(spark):
    rows = spark.createDataFrame([(1, i, f"w{i} x.", v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0]])], "doc_id long, i int, sentence string, embedding array<double>")
    got = [r.sentences for r in S.segment_dense(rows, SegmentOptions(10, min_split_similarity=0.5)).orderBy("chunk_index").collect()]
    assert got == [["w0 x.", "w1 x."], ["w2 x.", "w3 x."]]


def test_stats(spark):
    chunks = S.segment(spark.createDataFrame([(1, QUICK)], "doc_id long, text string"), SegmentOptions(15))
    r = S.stats(chunks, 0.5).first()
    assert (r.total_chunks, r.total_tokens, r.processing_time_ms, r.chunks_per_second, r.tokens_per_second) == (4, 37, 500.0, 8.0, 74.0)
    assert S.stats(chunks, 0).first().tokens_per_second == 0.0


def test_options():
    with pytest.raises(ValueError, match="positive"):
        SegmentOptions(0)
    with pytest.raises(ValueError, match="embedding_cache"):
        SegmentOptions(5, embedding_cache_mode="force")
    assert SegmentOptions(5, depth_threshold=-1).depth_threshold == 0.1
    assert SegmentOptions(5, depth_threshold=-1, min_split_similarity=-1).depth_threshold == -1
    assert SegmentOptions(5).language_detection_mode == "first_sentence"
    o = SegmentOptions(5, embedding_cache_mode="adaptive", embedding_cache=object())
    assert (o.cache_similarity_threshold, o.adaptive_cache_activation_threshold) == (0.9, 100)
    assert SegmentOptions(5).as_row()["depth_threshold"] == 0.0


def test_many_chunks(spark):
    """More chunks than one block of starts holds, in a text of many sentences."""
    n = 2000
    text = " ".join(f"Word{i} is here." for i in range(n))
    got = S.segment(spark.createDataFrame([(1, text)], "doc_id long, text string"), SegmentOptions(3)).collect()
    assert len(got) == n and [r.text for r in sorted(got, key=lambda r: r.chunk_index)] == [f"Word{i} is here." for i in range(n)]

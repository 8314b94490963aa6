import math

import pytest
from pyspark.sql import functions as F

from chunkwell.functions import vectors as V


def test_sparse_cosine(spark):
    a = {"a": 1.0, "b": 2.0, "c": 3.0}
    cases = [(a, a, 1.0), (a, {"d": 1.0, "e": 2.0, "f": 3.0}, 0.0), (a, {"a": 1.0, "c": 3.0}, 10 / (math.sqrt(14) * math.sqrt(10))), (a, {}, 0.0)]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(cases)], "n int, a map<string,double>, b map<string,double>")
    got = [r[0] for r in rows.orderBy("n").select(V.sparse_cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([c[2] for c in cases], abs=1e-9)


def test_tfidf(spark):
    row = spark.createDataFrame([([["sun", "is", "hot"], ["moon", "is", "cold"]],)], "t array<array<string>>").select(V.tfidf(F.col("t")).alias("w"), V.document_frequencies(F.col("t")).alias("df"), V.sentence_vectors(F.col("t")).alias("v")).first()
    w = {(e.i, e.t): e.w for e in row.w}
    assert w[0, "is"] == pytest.approx(math.log(1 + 2 / 3) / 3, abs=1e-9)
    assert w[0, "sun"] == pytest.approx(math.log(2) / 3, abs=1e-9)
    assert {e.t: e.df for e in row.df} == {"cold": 1, "hot": 1, "is": 2, "moon": 1, "sun": 1}
    assert [sorted(m) for m in row.v] == [["hot", "is", "sun"], ["cold", "is", "moon"]]


def test_cohesion(spark):
    lists = [["a", "b"], ["a", "b"], [], ["c", "a"]]
    rows = spark.createDataFrame([(0, lists), (1, []), (2, [["x"]])], "n int, t array<array<string>>")
    got = [r[0] for r in rows.orderBy("n").select(V.cohesion(F.col("t"))).collect()]
    assert got[0] == pytest.approx([1.0, 0.0, 0.0])
    assert got[1:] == [[], []]


def test_dense_cosine(spark):
    cases = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0), (None, [1.0], 0.0)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "n int, a array<float>, b array<float>")
    assert [r[0] for r in rows.orderBy("n").select(V.dense_cosine(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_top_terms(spark):
    rows = spark.createDataFrame([({"b": 1.0, "a": 1.0, "c": 2.0},)], "m map<string,double>")
    assert rows.select(V.top_terms(F.col("m"), 2)).first()[0] == ["c", "a"]

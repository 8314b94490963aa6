import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwell import queries as Q
from chunkwell.functions import bulk
from chunkwell.functions import language as L
from chunkwell.functions import text as X
from chunkwell.functions import vectors as V
from chunkwell.operators import segment as S
from chunkwell.plans.options import SegmentOptions

WORDS = "the and of running cats 'tis -dash- nationalization и это машинами the gemacht kinder nicht der naïve 𝒳y x2 U.S.A. e.g. ein".split()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    texts = [" ".join(" ".join(r.choice(WORDS) for _ in range(r.randint(0, 9))) + r.choice(".!?") for _ in range(r.randint(0, 12))) for _ in range(40)]
    return spark.createDataFrame([*enumerate([None, "", "!!!", *texts])], "doc_id long, text string").repartition(3).cache()


@pytest.mark.parametrize("name", sorted(Q.SEGMENTS))
def test_segments_by_batches_as_by_rows(docs, name, monkeypatch):
    """The queries score by batches, for more than a row's functions are too slow; small slices have the same scores."""
    rows = lambda arrow: sorted(map(repr, S.segment(docs, Q.SEGMENTS[name], arrow=arrow).collect()))
    assert rows(True) == rows(False) != []
    own = S.scored(docs, Q.SEGMENTS[name], F.col("text"), ["doc_id"]).select("doc_id", "_scores").collect()
    expected = dict(docs.select("doc_id", S.scores_column(F.col("text"), Q.SEGMENTS[name])).collect())
    assert all(r._scores == pytest.approx(expected[r.doc_id], abs=1e-12) for r in own)


def test_weights(docs):
    tokens = docs.select("doc_id", F.transform(X.split_sentences("text"), X.tokenize).alias("t"))
    r = tokens.select(bulk.tfidf(F.col("t")).alias("a"), bulk.document_frequencies(F.col("t")).alias("b"), V.tfidf(F.col("t")).alias("c"), V.document_frequencies(F.col("t")).alias("d")).collect()
    for x in r:
        assert [(e.t, e.i) for e in sorted(x.a)] == [(e.t, e.i) for e in x.c] and [e.w for e in sorted(x.a)] == pytest.approx([e.w for e in x.c])
        assert sorted(x.b) == list(x.d)


def test_ngrams_of_many_letters():
    """An alphabet of which five letters fill no number: texts and order stay exact."""
    import pyarrow as pa

    letters = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 9000))
    t = bulk.ngrams(pa.array([[letters, letters[:7]], ["abc"]], pa.list_(pa.string())), 3, 5)
    grams = t.texts(np.unique(t.term)).to_pylist()
    assert grams == sorted({s[i : i + n] for s in (letters, "abc") for n in (3, 4, 5) for i in range(len(s) - n + 1)})


def test_ngrams_joined(spark):
    rows = spark.createDataFrame([("Ab c.d𝒳e",), ("ab",), ("",), (None,)], "v string")
    assert [r[0] for r in rows.select(X.joined_ngrams(F.col("v"), 3, 5)).collect()] == ["abc bcd cd𝒳 d𝒳e abcd bcd𝒳 cd𝒳e abcd𝒳 bcd𝒳e", "", "", ""]


def test_stopwords_are_looked_up_in_a_set(spark):
    plan = spark.range(1).select(L.detect_language(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan


def test_top_terms_as_by_rows(docs):
    """The query needs no keys, and its terms are those of the keys."""
    cleaned = F.transform(X.split_sentences("text"), X.letters)
    grams = F.transform(X.split_sentences("text"), lambda s: X.char_ngrams(s, 3, 5))
    vectors = V.sentence_vectors(F.col("grams"))
    rows = docs.select(cleaned.alias("s"), grams.alias("grams")).select(bulk.top_ngrams(F.col("s"), 3, 5, 4).alias("a"), F.transform(vectors, lambda v: V.top_terms(v, 4)).alias("b"), bulk.ngram_vectors(F.col("s"), 3, 5).alias("c"), vectors.alias("d")).collect()
    assert all(r.a == r.b for r in rows) and any(r.a for r in rows)
    for r in rows:
        assert [{k: round(w, 12) for k, w in m.items()} for m in r.c] == [{k: round(w, 12) for k, w in m.items()} for m in r.d]


def test_rare_terms_lead(spark):
    """Terms that all keys have do not lead while there are others: else all keys would be joined with all."""
    from chunkwell.operators import cache as C

    keys = spark.createDataFrame([(i, {"every": 1.0, f"o{i}": 2.0}) for i in range(20)], "x int, key map<string,double>")
    terms = C.postings(keys, "x", 0.9, C.frequencies(keys)).groupBy("term").count()
    assert terms.agg(F.max("count")).first()[0] == 1

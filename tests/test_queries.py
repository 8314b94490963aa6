import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
# a sample of the queries; the others differ in their options
NAMES = ["normalize_with_contractions", "tokenize", "stem_tokens", "sentence_tfidf", "dense_cosine_adjacent", "segment_default", "segment_ngram", "segment_dense_table", "cache_lookup", "service_responses"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    expected = sorted(repr(tuple(r)) for r in cursor.fetchall())
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

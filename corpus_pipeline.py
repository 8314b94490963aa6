"""The corpus pipeline over documents: toxicity, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return
the columns of documents, extra ones included, whatever their names. The toxicity stage learns from labels,
decontamination reads benchmark. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.llm import decontaminate, linededup, packing, simhash, toxicity
from chunkwell.llm.common import cut, document_key, fresh, staged, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts have the bias alone as score; repeated rows go or stay together.
    Without a toxic label in the training folds all stay, null ids are scored like others."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated passages go from the texts; n_chars follows, null for a null text. Documents stay, even with an
    empty text. Null ids come first in order, rows with one id are ordered by a hash of their texts, and repeated rows are
    one document, that is, each keeps what it has first."""
    kept = linededup.dedup(docs)
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are 0.8 alike or more in runs of five words, equal texts included, the one with
    the least doc_id stays (null last), of several with this id the text with the least hash. Of rows with one doc_id
    and one text, which are one document, one stays. Texts without words are one group."""
    groups = cut(simhash.similar(docs, words=5, similarity=0.8))
    doc, th = fresh(docs, "doc", "th")
    rows = docs.withColumns(dict(zip((doc, th), document_key())))
    gone = groups.filter("doc <> leader_doc or th <> leader_th").select(F.col("doc").alias(doc), F.col("th").alias(th)).distinct()
    rows = rows.join(gone, [doc, th], "left_anti")
    twice = cut(groups.groupBy("doc", "th").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc").alias(doc), F.col("th").alias(th)))
    if not twice.isEmpty():
        rows = rows.join(twice, [doc, th], "left_anti").unionByName(rows.join(twice, [doc, th], "left_semi").dropDuplicates([doc, th]))
    return rows.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; each row is judged by its own text, whatever its id. Null and
    empty texts stay, and without benchmark items all do."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row a piece. Null and empty texts have the end token; null ids and repeated
    rows have pieces of their own."""
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Training, fingerprints and tokens are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

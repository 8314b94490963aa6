"""Helpers shared by the training-data operators: durable cuts of lineage, bounded Arrow batches, checked broadcasts."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to a Python worker, so that a batch of long texts stays small.
BATCH_ROWS = 256
#: A side of a join is broadcast only if it takes no more than this.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, from spark.checkpoint.dir. A temporary one is set only
    where none is configured and the executors are threads of the driver, as in tests."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="chunkwell-"))
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Evaluate once and cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def staged(df: DataFrame) -> DataFrame:
    """Evaluate once into a Parquet table in the shared folder (columnar and compressed, for larger intermediates)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Lower the number of rows in an Arrow batch; a smaller setting of the session stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextlib.contextmanager
def large_batches(spark: SparkSession, rows: int = 8192):
    """Rows in an Arrow batch for what is evaluated within: narrow rows of numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def document_key() -> tuple[Column, Column]:
    """The key of a row of documents. Its id, for null the greatest long; a hash of its text and of whether it or the
    id is null, so that rows with one id are told apart by their texts."""
    doc = F.col("doc_id").cast("long")
    return F.coalesce(doc, F.lit((1 << 63) - 1).cast("long")), F.xxhash64(doc.isNull(), F.col("text").isNull(), text_or_empty())


def keyed(docs: DataFrame) -> DataFrame:
    """doc and th, the key of a document, and its text (null: empty)."""
    doc, th = document_key()
    return docs.select(doc.alias("doc"), th.alias("th"), text_or_empty().alias("text"))


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df has not."""
    taken = {c.lower() for c in df.columns}
    tail = ""
    while any(f"_{n}{tail}" in taken for n in names):
        tail += "_"
    return [f"_{n}{tail}" for n in names]


def broadcast_if_small(df: DataFrame, array: str | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a table of numbers, and of one array of numbers if named, that takes no more bytes than this by its
    counted rows and elements; else leave the join to Spark. df is read twice: give it cut or staged."""
    inside = F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0)
    rows, elements = df.agg(F.count("*"), inside).first()
    return F.broadcast(df) if rows * (16 + 8 * len(df.columns)) + 16 * elements <= most else df


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

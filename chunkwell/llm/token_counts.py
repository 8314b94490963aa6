"""Token counts of every prefix of a text, kept as one signed byte a code point.

The table answers how many tokens a prefix has, where a text must be cut to fit a budget, and whether it fits,
without encoding again. It is built by dynamic programming over prefixes (see bpe.Vocabulary._piece).

Null and empty texts have an empty table and 0 tokens. Repeated rows each get their own result. Extra columns
pass through; columns named as the results are replaced. Texts of any length are counted whole: memory is
bounded by one batch of rows. A unit (a run without white space) is counted in time that grows with its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import bounded_batches, text_or_empty


def counts_of(table: bytes) -> np.ndarray:
    """Token counts of all prefixes, from the empty one to the whole text."""
    out = np.zeros(len(table) + 1, dtype=np.int64)
    np.cumsum(np.frombuffer(table, dtype=np.int8), out=out[1:])
    return out


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix within the budget of tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def prefix_counts(df: DataFrame, text: str = "text", path: str | None = None, limit: int = 1024, keep_table: bool = True) -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit, fits_chars (code points of the longest prefix of at most limit tokens)
    and, with keep_table, token_deltas. fits_chars counts every prefix: a later prefix may have fewer tokens."""
    path = path or bpe.default_path()
    bounded_batches(df.sparkSession)
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fits_chars", T.LongType())]
    new += [T.StructField("token_deltas", T.BinaryType())] if keep_table else []
    names = {f.name.lower() for f in new} | {"_whole_text"}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names and c != text], text_or_empty(text).alias("_whole_text"))
    if text in df.columns and keep_table:
        base = base.withColumn(text, F.col(f"_whole_text"))
    kept = [f for f in base.schema.fields if f.name != "_whole_text"]

    def run(batches):
        vocab = bpe.vocabulary(path)
        for batch in batches:
            at = batch.schema.get_field_index("_whole_text")
            sizes, totals, fits, tables = [], [], [], []
            for value in batch.column(at).to_pylist():
                table = vocab.prefix_deltas(value)
                counts = counts_of(table)
                sizes.append(len(value.encode()))
                totals.append(int(counts[-1]))
                fits.append(longest_prefix(counts, limit))
                tables.append(table)
            arrays = [batch.column(i) for i in range(batch.num_columns) if i != at]
            arrays += [pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(fits, pa.int64())]
            arrays += [pa.array(tables, pa.binary())] if keep_table else []
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept + new])

    return base.mapInArrow(run, T.StructType(kept + new))

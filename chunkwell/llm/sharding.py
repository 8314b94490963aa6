"""Extendible hashing of documents into shards of a byte limit. DataFrame operations only.

A document's bits are 60 of the MD5 of its id and then, so that rows with one id can part too, 63 of a row
number's hash. The directory is the set of bit prefixes whose documents fit the limit while those of the
prefix one bit shorter do not: only an oversized bucket splits, on its next bit. A prefix with one row is a
shard even if that row alone is over the limit.

The byte totals of all prefixes come from one aggregation over a histogram of cells a few bits deeper than the
mean shard. The directory has an entry a cell, and each document finds its shard there by its own bits; cells that
are still oversized go on alone with more bits. Documents' texts do not move.

Null and empty texts have 0 bytes; null ids are sharded like one id. Repeated rows each count. An empty table
has no shards. Columns asked for in `carry` pass through under their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, staged, text_or_empty

BITS = 123
#: Of a broadcast directory, counted without the bits themselves, which take some times as much.
CELLS_BYTES = 4 << 20


def _bits():
    return F.concat(F.lpad(F.bin("h1"), 60, "0"), F.lpad(F.bin("h2"), 63, "0"))


def keyed(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    number = F.monotonically_increasing_id()
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long").alias("h1"),
        F.shiftrightunsigned(F.xxhash64(number), 1).alias("h2"),
        *[F.col(f"`{c}`").alias(f"_carry_{i}") for i, c in enumerate(carry)],
    )


def split_round(rows: DataFrame, depth: int, limit: int, base: int) -> tuple[DataFrame, DataFrame]:
    """The directory: each cell of `depth` bits with the shard that holds it, if one of base bits or more does; and the
    cells that are to split further."""
    cells = cut(rows.groupBy(F.substring(_bits(), 1, depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r")))
    above = cells.select("cell", "b", "r", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth")).withColumn("node", F.expr("substring(cell, 1, depth)"))
    nodes = above.groupBy("node", "depth").agg(F.sum("b").alias("shard_bytes"), F.count("*").alias("n_cells"), F.sum("r").alias("shard_docs"))
    fits = cut(nodes.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)).drop("n_cells"))
    # a cell's shard is the shortest of its prefixes that fits: only oversized buckets have split
    found = above.select("cell", "node", "depth").join(fits, ["node", "depth"])
    shard = F.min(F.struct("depth", "node", "shard_bytes", "shard_docs")).alias("s")
    directory = cut(found.groupBy("cell").agg(shard).select("cell", F.col("s.node").alias("shard"), F.col("s.depth").alias("shard_depth"), "s.shard_bytes", "s.shard_docs"))
    return directory, cells.join(directory, "cell", "left_anti").select("cell")


def shards(df: DataFrame, limit: int, carry: tuple[str, ...] = (), extra_bits: int = 4) -> DataFrame:
    """doc_id, n_bytes, shard (bit prefix), shard_depth, shard_bytes, shard_docs and the carried columns."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    rows = staged(keyed(df, carry))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    base, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + extra_bits)
    done = []
    while True:
        directory, unsplit = split_round(rows, depth, limit, base)
        indexed = rows.withColumn("cell", F.substring(_bits(), 1, depth))
        done.append(indexed.join(broadcast_if_small(directory, most=CELLS_BYTES), "cell"))
        unsplit = cut(unsplit)
        if unsplit.isEmpty():
            break
        if depth == BITS:
            raise ValueError("two rows share all bits")
        rows = staged(indexed.join(broadcast_if_small(unsplit, most=CELLS_BYTES), "cell", "left_semi").drop("cell"))
        base, depth = depth, min(BITS, depth + 8)
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs", *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)])


def write_shards(df: DataFrame, path: str, limit: int) -> None:
    """Writes the table with one folder a shard."""
    names = {"shard", "shard_depth", "shard_bytes", "shard_docs", "n_bytes", "doc_id"}
    carry = tuple(c for c in df.columns if c.lower() not in names)
    shards(df, limit, carry).repartition("shard").write.partitionBy("shard").parquet(path)

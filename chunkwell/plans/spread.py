"""Spreading small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_BYTES = 64 << 20


def spread(df: DataFrame, per_core: int = SMALL_BYTES) -> DataFrame:
    """A table of less than so many bytes a core may be a single row group, and a pass over it a single task: its rows
    are dealt out. A larger table stays as it is scanned, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < per_core * cores else df

"""Segmentation of streams: the transforms of a row need no state; the cache fills batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cache import AdaptiveCache, SemanticCache, cached_embeddings, keys
from ..operators.segment import prepared, segment, segment_dense
from ..plans.options import SegmentOptions


def segment_stream(stream: DataFrame, options: SegmentOptions, **columns) -> DataFrame:
    """segment() of a streaming DataFrame: append mode, no state."""
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return segment(stream, options, **columns)


def dense_batches(options: SegmentOptions, provider, sink):
    """A function for foreachBatch: embeds each micro-batch through the cache of the options and gives its chunks to sink.
    A micro-batch that comes again after a failure asks the provider for nothing and adds no entries."""
    if options.embedding_cache is not None and not isinstance(options.embedding_cache, SemanticCache | AdaptiveCache):
        raise ValueError("embedding_cache must be a SemanticCache")

    def batch(docs: DataFrame, number: int) -> None:
        sentences = prepared(F.col("text"), options, lambda t, s, early: s)  # of the normalized text, as by segment()
        rows = keys(docs.select("doc_id", "text"), sentences).persist()
        try:
            sink(segment_dense(cached_embeddings(rows, provider, options, f"batch-{number}"), options), number)
        finally:
            rows.unpersist()

    return batch

"""JSON requests in, JSON responses out: segmentation as a transform of a column of request bodies.

Requests with the same options are segmented alike, without embeddings all in one pass; the sets of options in a batch are counted. A request whose
body is larger than the limit, isn't JSON, asks for no positive max_tokens or for options that don't go together gets
an error and a status instead of chunks, and so do those with rarer options than max_option_sets plans hold: one
request does not fail the others. With a provider, sentences are scored by embeddings, through the cache if a request
asks for that; without one they are scored by TF-IDF, and the answer says that no cache was used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bulk_text
from ..functions.arrays import total
from ..operators.cache import SemanticCache, cached_embeddings, keys
from ..operators.segment import prepared, segment_dense
from ..plans.options import SegmentOptions

MAX_BYTES = 1 << 20
FIELDS = {
    "max_tokens": "int", "min_split_similarity": "double", "depth_threshold": "double", "language": "string", "language_detection_mode": "string",
    "language_detection_tokens": "int", "pre_normalize_abbreviations": "boolean", "enable_stop_word_removal": "boolean", "enable_stemming": "boolean",
    "tfidf_min_ngram_size": "int", "tfidf_max_ngram_size": "int", "embedding_cache_mode": "string", "cache_similarity_threshold": "double", "adaptive_cache_activation_threshold": "int",
}
CACHE_FIELDS = ("embedding_cache_mode", "cache_similarity_threshold", "adaptive_cache_activation_threshold")
SCHEMA = "text string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", _bad string"


def _dense_chunks(rows: DataFrame, o: SegmentOptions, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with _chunks, as segment_column gives them, by embeddings of their sentences."""
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    sentences = prepared(F.col("_q.text"), o, lambda t, s, early: s)
    keyed = keys(rows.select(F.col("_id").alias("doc_id"), "_q"), sentences)
    chunks = segment_dense(cached_embeddings(keyed, provider, o), o)
    listed = F.sort_array(F.collect_list(F.struct("chunk_index", "text", "sentences", "num_tokens")))
    chunks = chunks.groupBy(F.col("doc_id").alias("_id")).agg(listed.alias("_found"))
    none = F.array().cast("array<struct<chunk_index:int,text:string,sentences:array<string>,num_tokens:int>>")
    return rows.join(chunks, "_id", "left").withColumn("_chunks", F.coalesce("_found", none)).drop("_id", "_found")


def _echo(o: SegmentOptions) -> Column:
    used = o.as_row()
    return F.struct(*[F.lit(used[f]).cast(t).alias(f) for f, t in FIELDS.items()])


def _answer(options: Column) -> Column:
    """JSON of the options used, _chunks and their numbers."""
    chunks = F.transform("_chunks", lambda c: F.struct(F.array_join(c["sentences"], " ").alias("Text"), c["sentences"].alias("Sentences"), c["num_tokens"].alias("NumTokens"))).alias("chunks")
    counts = F.struct(F.size("_chunks").alias("total_chunks"), total(F.transform("_chunks", lambda c: c["num_tokens"]), "int").alias("total_tokens")).alias("stats")
    return F.to_json(F.struct(options.alias("options_used"), chunks, counts))


def _by_rows(parsed: DataFrame, columns: list[str], size: Column, number: Column, plans: list[SegmentOptions | str], rare: str) -> DataFrame:
    """Answers by TF-IDF in one pass, whatever the number of sets of options; number: of a row's plan, options or what is
    wrong with them."""
    wrong = reduce(lambda a, n: a.when(F.col("_k") == n, plans[n]), [n for n, o in enumerate(plans) if isinstance(o, str)], F.when(F.lit(False), ""))
    rows = parsed.withColumn("_k", F.when(F.col("_error").isNull(), number)).withColumn("_wrong", wrong)
    fit = F.col("_error").isNull() & F.col("_k").isNotNull() & F.col("_wrong").isNull()
    options = [SegmentOptions(1) if isinstance(o, str) else o for o in plans]
    own = rows.select(*columns, "_k", "_error", "_wrong", fit.alias("_fit"), size.alias("_size"), F.when(fit, F.col("_q.text")).alias("_text"))
    done = own.select("*", bulk_text.chunks_by(F.col("_text"), F.when(F.col("_fit"), F.col("_k")), options).alias("_chunks"))
    status = F.when(F.col("_fit"), 200).when(F.col("_size") > MAX_BYTES, 413).when(F.col("_error").isNotNull() | F.col("_wrong").isNotNull(), 400).otherwise(500)
    message = F.coalesce("_error", "_wrong", F.lit(rare))
    echo = F.get(F.array(*map(_echo, options)), F.col("_k")) if options else _echo(SegmentOptions(1))
    return done.select(*columns, status.alias("status"), F.when(F.col("_fit"), _answer(echo)).otherwise(F.to_json(F.struct(message.alias("error")))).alias("response"))


def respond(requests: DataFrame, body: str = "body", max_option_sets: int = 256, provider: Callable[[DataFrame], DataFrame] | None = None, cache: SemanticCache | None = None) -> DataFrame:
    """The rows of requests with status (200, 400, 413 or 500) and response (a JSON string)."""
    parsed = requests.withColumn("_q", F.from_json(F.col(body), SCHEMA, {"columnNameOfCorruptRecord": "_bad"}))
    size = F.octet_length(body)
    error = (
        F.when(size > MAX_BYTES, F.lit("Bad request: body too large"))
        .when(F.col("_q").isNull() | F.col("_q._bad").isNotNull(), F.lit("Bad request: invalid JSON"))
        .when(F.coalesce(F.col("_q.max_tokens"), F.lit(0)) <= 0, F.lit("max_tokens must be > 0"))
    )
    parsed = parsed.withColumn("_error", error).withColumn("_set", F.when(F.col("_error").isNull(), F.struct(*[F.col(f"_q.{f}").alias(f) for f in FIELDS])))
    counts = parsed.filter("_error is null").groupBy("_set").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.to_json("_set"))
    sets = [r[0] for r in counts.limit(max_option_sets).collect()]

    def failed(rows: DataFrame, status, message) -> DataFrame:
        return rows.select(*requests.columns, status.alias("status"), F.to_json(F.struct(message.alias("error"))).alias("response"))

    def same(chosen):
        return reduce(lambda a, b: a & b, [F.col(f"_set.{f}").eqNullSafe(F.lit(chosen[f]).cast(t)) for f, t in FIELDS.items()])

    plans = []
    for chosen in sets:
        given = {k: v for k, v in chosen.asDict().items() if v is not None}
        if provider is None:  # no embeddings, so none to keep
            given = {k: v for k, v in given.items() if k not in CACHE_FIELDS}
        try:
            plans.append(SegmentOptions(**given, embedding_cache=cache))
        except ValueError as e:
            plans.append(str(e))
    rare = f"more than {max_option_sets} sets of options in a batch"
    if provider is None:
        return _by_rows(parsed, requests.columns, size, reduce(lambda a, b: a.when(same(b[1]), b[0]), enumerate(sets), F.when(F.lit(False), -1)), plans, rare)

    out = [failed(parsed.filter("_error is not null"), F.when(size > MAX_BYTES, 413).otherwise(400), F.col("_error"))]
    if len(sets) == max_option_sets:
        planned = reduce(lambda a, b: a | b, map(same, sets))
        out.append(failed(parsed.filter(F.col("_error").isNull() & ~planned), F.lit(500), F.lit(rare)))
    for chosen, o in zip(sets, plans):
        rows = parsed.filter(F.col("_error").isNull() & same(chosen))
        if isinstance(o, str):
            out.append(failed(rows, F.lit(400), F.lit(o)))
        else:
            rows = _dense_chunks(rows, o, provider)
            out.append(rows.select(*requests.columns, F.lit(200).alias("status"), _answer(_echo(o)).alias("response")))
    return reduce(DataFrame.unionByName, out)

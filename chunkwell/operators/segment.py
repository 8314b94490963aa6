"""Segmentation of texts into chunks under a token budget.

A document is a row, and everything up to its chunks is a function of the row: no shuffle, so the plan is one pass over
the scan at any size, and works on streams as well. Only dense vectors, which come from a provider one sentence at
a time, need the sentences of a document brought together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bulk_text
from ..functions.arrays import let, total
from ..functions.language import detect_language, remove_stopwords, stem_tokens
from ..functions.text import char_ngrams, normalize_abbreviations, split_sentences, token_counts, tokenize
from ..functions.vectors import cohesion, cohesion_dense, dense_cosine
from ..plans.options import FIRST_TEN, FULL_TEXT, PER_SENTENCE, SegmentOptions

CHUNK = "struct<text:string,sentences:array<string>,num_tokens:int>"
#: Scores are compared at so many digits, as the order of summation leaves the last ones open.
DIGITS = 12


def early_language(text: Column, o: SegmentOptions) -> Column:
    """The language known before the text is normalized; empty if none is yet."""
    if o.language:
        return F.lit(o.language)
    if o.language_detection_tokens > 0 and o.language_detection_mode != PER_SENTENCE:
        return detect_language(F.array_join(F.slice(tokenize(text), 1, o.language_detection_tokens), " "), o.languages)
    return F.lit("")


def late_language(early: Column, text: Column, sentences: Column, o: SegmentOptions) -> Column:
    """The document's language for scoring, of the normalized text, by the detection mode."""
    if o.language or o.language_detection_mode == PER_SENTENCE or o.language_detection_tokens > 0:
        return early
    if o.language_detection_mode == FIRST_TEN:
        return detect_language(F.array_join(F.slice(sentences, 1, 10), " "), o.languages)
    if o.language_detection_mode == FULL_TEXT:
        return detect_language(text, o.languages)
    return detect_language(F.get(sentences, F.lit(0)), o.languages)


def scoring_tokens(sentence: Column, lang: Column, o: SegmentOptions) -> Column:
    if o.ngrams:
        return char_ngrams(sentence, o.tfidf_min_ngram_size, o.tfidf_max_ngram_size)

    def prepared(tokens: Column, own: Column) -> Column:
        if o.enable_stop_word_removal:
            tokens = remove_stopwords(tokens, own, o.languages)
        return let(tokens, lambda t: stem_tokens(t, own, o.languages)) if o.enable_stemming else tokens

    own = detect_language(sentence, o.languages) if o.language_detection_mode == PER_SENTENCE and not o.language else lang
    return let(own, lambda x: let(tokenize(sentence), lambda t: prepared(t, x)))


def boundaries(scores: Column, o: SegmentOptions) -> Column:
    """array<boolean>: whether a chunk ends after each sentence but the last."""
    rounded = F.transform(scores, lambda s: F.round(s, DIGITS))
    if o.min_split_similarity > 0:
        return F.transform(rounded, lambda s: s < o.min_split_similarity)

    def minimum(s: Column) -> Column:
        def dip(x: Column, i: Column) -> Column:
            before, after = F.get(s, i - 1), F.get(s, i + 1)
            return F.coalesce((x < before) & (x < after) & (F.round((before + after) / 2 - x, DIGITS) >= o.depth_threshold), F.lit(False))

        return F.transform(s, dip)

    return let(rounded, minimum)


#: Starts of chunks that a fold adds to one by one, each time with a copy; full blocks are kept apart.
STARTS_BLOCK = 256


def chunk_starts(counts: Column, breaks: Column, max_tokens: int) -> Column:
    """Places (from 0) of the sentences with which chunks begin: a left fold, greedy under the budget."""

    def step(acc: Column, i: Column) -> Column:
        n = F.get(counts, i)
        broken = F.coalesce(F.get(breaks, i - 1), F.lit(False))
        over = n > max_tokens
        fresh = over | (acc["held"] == 0) | broken | (acc["sum"] + n > max_tokens)
        full = F.size(acc["starts"]) >= STARTS_BLOCK
        return F.struct(
            F.when(fresh & full, F.concat(acc["blocks"], F.array(acc["starts"]))).otherwise(acc["blocks"]).alias("blocks"),
            F.when(fresh & full, F.array(i)).when(fresh, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"),
            F.when(over, 0).when(fresh, n).otherwise(acc["sum"] + n).alias("sum"),
            F.when(over, 0).when(fresh, 1).otherwise(acc["held"] + 1).alias("held"),
        )

    none = F.array().cast("array<int>")
    zero = F.struct(F.array().cast("array<array<int>>").alias("blocks"), none.alias("starts"), F.lit(0).alias("sum"), F.lit(0).alias("held"))
    places = F.when(F.size(counts) > 0, F.sequence(F.lit(0), F.size(counts) - 1)).otherwise(none)
    return F.aggregate(places, zero, step, lambda acc: F.concat(F.flatten(acc["blocks"]), acc["starts"]))


def chunks_of(sentences: Column, counts: Column, breaks: Column, max_tokens: int) -> Column:
    def chunk(starts: Column, p: Column, q: Column) -> Column:
        n = F.coalesce(F.get(starts, q + 1), F.size(sentences)) - p
        return let(F.slice(sentences, p + 1, n), lambda own: F.struct(F.array_join(own, " ").alias("text"), own.alias("sentences"), total(F.slice(counts, p + 1, n), "int").alias("num_tokens")))

    return let(chunk_starts(counts, breaks, max_tokens), lambda starts: F.transform(starts, lambda p, q: chunk(starts, p, q)))


def normalized(text: Column, lang: Column, o: SegmentOptions) -> Column:
    if not o.pre_normalize_abbreviations:
        return F.coalesce(text, F.lit(""))
    return normalize_abbreviations(text, lang if o.language or o.language_detection_tokens > 0 else None, o.languages)


def prepared(text: Column, o: SegmentOptions, body) -> Column:
    """body(normalized text, sentences, early language)."""

    def split(lang: Column) -> Column:
        return let(normalized(text, lang, o), lambda t: let(split_sentences(t), lambda s: body(t, s, lang)))

    return let(early_language(text, o), split)


def scores_column(text: Column, o: SegmentOptions) -> Column:
    """array<double>: the cohesion of each two neighbouring sentences."""

    def scored(t: Column, s: Column, early: Column) -> Column:
        return let(late_language(early, t, s, o), lambda lang: cohesion(F.transform(s, lambda x: scoring_tokens(x, lang, o))))

    return prepared(text, o, scored)


def segment_column(text: Column, o: SegmentOptions) -> Column:
    """array of chunks (text, sentences, num_tokens) of a text; empty for a null or blank one."""

    def chunked(t: Column, s: Column, early: Column) -> Column:
        scores = let(late_language(early, t, s, o), lambda lang: cohesion(F.transform(s, lambda x: scoring_tokens(x, lang, o))))
        breaks = F.when(F.size(s) < 2, F.array().cast("array<boolean>")).otherwise(boundaries(scores, o))
        return let(token_counts(s), lambda n: let(breaks, lambda b: chunks_of(s, n, b, o.max_tokens)))

    return prepared(text, o, chunked)


def scored(df: DataFrame, o: SegmentOptions, text: Column, keep: list[str]) -> DataFrame:
    """The kept columns with _scores, by Arrow batches from the texts on: what scores_column gives, for large tables."""
    return df.select(*keep, bulk_text.scores(text, o).alias("_scores"))


def with_chunks(df: DataFrame, o: SegmentOptions, text: Column, keep: list[str]) -> DataFrame:
    """The kept columns with _chunks, as segment_column gives them but for their joined texts, by Arrow batches."""
    return df.select(*keep, bulk_text.chunks(text, o).alias("_chunks"))


def rows_of(df: DataFrame, keep: list[str], array: Column, place: str, element: str) -> DataFrame:
    """A row for each element of a computed array. As an inner posexplode it would be computed once more, below any
    shuffle, in a filter for empty arrays."""
    return df.select(*keep, F.posexplode_outer(array).alias(place, element)).filter(F.col(place).isNotNull())


def exploded(df: DataFrame, keep: list[str]) -> DataFrame:
    out = rows_of(df, keep, F.col("_chunks"), "chunk_index", "_chunk")
    return out.select(*keep, "chunk_index", F.array_join("_chunk.sentences", " ").alias("text"), "_chunk.sentences", "_chunk.num_tokens")


def segment(df: DataFrame, options: SegmentOptions, text: str = "text", keep: tuple[str, ...] = ("doc_id",), arrow: bool = False) -> DataFrame:
    """A row a chunk: the kept columns, chunk_index, text, sentences, num_tokens. arrow: texts are segmented in Python
    workers, by batches; that takes a small part of the time where tables are large."""
    if arrow:
        return exploded(with_chunks(df, options, F.col(text), list(keep)), list(keep))
    return exploded(df.select(*keep, segment_column(F.col(text), options).alias("_chunks")), list(keep))


def sentence_rows(df: DataFrame, options: SegmentOptions, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row a sentence: the kept columns, i, sentence."""
    return rows_of(df, list(keep), prepared(F.col(text), options, lambda t, s, early: s), "i", "sentence")


def segment_dense(rows: DataFrame, options: SegmentOptions, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """segment() from sentence rows with an embedding: one shuffle by document, of sentences and vectors."""
    sorted_rows = F.sort_array(F.collect_list(F.struct("i", "sentence", "embedding")))
    docs = rows.groupBy(*keep).agg(sorted_rows.alias("_r"))
    s, v = F.transform("_r", lambda r: r["sentence"]), F.transform("_r", lambda r: r["embedding"])
    chunks = let(s, lambda x: let(token_counts(x), lambda n: let(boundaries(cohesion_dense(v), options), lambda b: chunks_of(x, n, b, options.max_tokens))))
    return exploded(docs.select(*keep, chunks.alias("_chunks")), list(keep))


def segment_by_table(df: DataFrame, options: SegmentOptions, vectors: DataFrame, number: Callable[[Column], Column], text: str = "text", key: str = "doc_id") -> DataFrame:
    """segment_dense() of texts with vectors from a table of id and embedding; number gives the id of the sentence at a
    place. Each pair of ids is scored once. Only numbers go through shuffles, but for one of the texts by key; neither
    sentences nor their vectors do."""
    places = F.sequence(F.lit(0), F.size("_s") - 2)
    pair = lambda i: F.struct(number(i).alias("a"), number(i + 1).alias("b"))
    cut = df.select(df["*"], bulk_text.sentences(F.col(text), options).alias("_s"))
    pairs = rows_of(cut, [key], F.when(F.size("_s") > 1, F.transform(places, pair)), "i", "p").select(key, "i", "p.a", "p.b")
    side = lambda x, e: vectors.select(F.col("id").alias(x), F.col("embedding").alias(e))
    known = pairs.select("a", "b").distinct().join(side("a", "_x"), "a").join(side("b", "_y"), "b")
    scores = pairs.join(known.select("a", "b", dense_cosine(F.col("_x"), F.col("_y")).alias("s")), ["a", "b"], "left")
    lists = scores.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("s", F.lit(0.0)).alias("s")))).alias("_r"))
    docs = df.select(key, text).join(lists.select(key, F.transform("_r", lambda r: r["s"]).alias("_scores")), key, "left")
    return exploded(docs.select(key, bulk_text.chunks_scored(F.col(text), F.col("_scores"), options).alias("_chunks")), [key])


def stats(chunks: DataFrame, seconds: float | None = None) -> DataFrame:
    """total_chunks, total_tokens and, for a run of so many seconds, the time and the rates (0 for no time)."""
    out = chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("num_tokens"), F.lit(0)).alias("total_tokens"))
    if seconds is None:
        return out
    rate = lambda c: F.lit(0.0) if seconds <= 0 else F.col(c) / F.lit(float(seconds))
    return out.select("*", F.lit(seconds * 1000.0).alias("processing_time_ms"), rate("total_chunks").alias("chunks_per_second"), rate("total_tokens").alias("tokens_per_second"))

"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as sql
from .functions import bulk, bulk_text
from .functions import language as L
from .functions import text as X
from .functions import vectors as V
from .functions.arrays import let
from .operators import cache
from .operators.segment import late_language, prepared, rows_of, scored, segment, segment_by_table, sentence_rows, stats
from .plans.options import ADAPTIVE, FIRST_TEN, FORCE, FULL_TEXT, PER_SENTENCE, SegmentOptions
from .plans.spread import spread
from .sources.service import respond

# the fixture's language codes
CODES = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}
RAW = SegmentOptions(64, enable_stop_word_removal=False, enable_stemming=False)
DOCS_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
LANG_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items()) + " ELSE 'unknown' END"

SEGMENTS = {
    "segment_default": SegmentOptions(64),
    "segment_threshold": SegmentOptions(64, min_split_similarity=0.05),
    "segment_depth": SegmentOptions(64, depth_threshold=0.02),
    "segment_ngram": SegmentOptions(64, tfidf_min_ngram_size=3, tfidf_max_ngram_size=4),
    "segment_language_forced": SegmentOptions(64, language="english"),
    "segment_no_preprocess": SegmentOptions(64, enable_stop_word_removal=False, enable_stemming=False, pre_normalize_abbreviations=False),
    "segment_first_ten": SegmentOptions(128, language_detection_mode=FIRST_TEN),
    "segment_full_text": SegmentOptions(64, language_detection_mode=FULL_TEXT),
    "segment_per_sentence": SegmentOptions(64, language_detection_mode=PER_SENTENCE),
    "segment_tokens": SegmentOptions(64, language_detection_tokens=50),
}
DETECT = {k.replace("segment", "detect_language"): v for k, v in SEGMENTS.items() if k in ("segment_default", "segment_first_ten", "segment_full_text", "segment_per_sentence", "segment_tokens")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def counted(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_index", "text", F.size("sentences").alias("n_sentences"), "num_tokens")


def normalize_abbreviations(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.normalize_abbreviations(F.col("text")).alias("normalized"))


def normalize_with_contractions(spark, sf_dir):
    lang = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[F.col("lang")]
    return documents(spark, sf_dir).select("doc_id", X.normalize_abbreviations(F.col("text"), lang).alias("normalized"))


def split_sentences(spark, sf_dir):
    return rows_of(documents(spark, sf_dir), ["doc_id"], X.split_sentences(F.col("text")), "i", "sentence")


def tokenize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


def token_counts(spark, sf_dir):
    counts = documents(spark, sf_dir).select("doc_id", X.token_counts(X.split_sentences(F.col("text"))).alias("n"))
    return counts.select("doc_id", F.size("n").alias("n_sentences"), F.array_join(F.transform("n", lambda x: x.cast("string")), " ").alias("counts"))


def char_ngrams(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.joined_ngrams(F.col("text"), 3, 5).alias("ngrams"))


def script_candidates(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", L.script(F.col("text")).alias("script"))


def detect(o: SegmentOptions):
    def run(spark, sf_dir):
        docs = documents(spark, sf_dir)
        if o.language_detection_mode == PER_SENTENCE:
            rows = sentence_rows(docs, o)
            return rows.select("doc_id", "i", L.detect_language(F.col("sentence")).alias("lang"))
        return docs.select("doc_id", prepared(F.col("text"), o, lambda t, s, early: late_language(early, t, s, o)).alias("lang"))

    return run


def detect_sql(o: SegmentOptions) -> str:
    if o.language_detection_mode == PER_SENTENCE:
        return f"WITH {sql.parts(DOCS_SQL, o)} SELECT doc_id, i, lang FROM lang"
    if o.language_detection_tokens:
        return f"WITH {sql.parts(DOCS_SQL, o)} SELECT doc_id, lang FROM early"
    return f"WITH {sql.parts(DOCS_SQL, o)} SELECT doc_id, lang FROM found"


def _coded(spark, sf_dir):
    lang = F.coalesce(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[F.col("lang")], F.lit("unknown"))
    return documents(spark, sf_dir).select("doc_id", "text", lang.alias("lang"))


def remove_stopwords(spark, sf_dir):
    return _coded(spark, sf_dir).select("doc_id", L.remove_stopwords_text(F.col("text"), F.col("lang")).alias("kept"))


def stem_tokens(spark, sf_dir):
    return _coded(spark, sf_dir).select("doc_id", F.array_join(let(X.tokenize(F.col("text")), lambda t: L.stem_tokens(t, F.col("lang"))), " ").alias("stems"))


def document_frequency(spark, sf_dir):
    rows = rows_of(documents(spark, sf_dir), ["doc_id"], bulk_text.document_frequencies(F.col("text"), RAW), "p", "e")
    return rows.select("doc_id", F.col("e.t").alias("term"), F.col("e.df").alias("df"))


def sentence_tfidf(spark, sf_dir):
    rows = rows_of(documents(spark, sf_dir), ["doc_id"], bulk_text.tfidf(F.col("text"), RAW), "p", "e")
    return rows.select("doc_id", F.col("e.i").alias("i"), F.col("e.t").alias("term"), F.round("e.w", 6).alias("weight"))


def cohesion(o: SegmentOptions):
    def run(spark, sf_dir):
        rows = rows_of(scored(documents(spark, sf_dir), o, F.col("text"), ["doc_id"]), ["doc_id"], F.col("_scores"), "i", "score")
        return rows.select("doc_id", "i", F.round("score", 6).alias("score"))

    return run


def dense_cosine_adjacent(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.dense_cosine(F.col("embedding"), F.col("after")), 6).alias("cosine"))


def bounds(o: SegmentOptions):
    def run(spark, sf_dir):
        return rows_of(documents(spark, sf_dir), ["doc_id"], bulk_text.breaks(F.col("text"), o), "i", "brk")

    return run


def segments(o: SegmentOptions):
    return lambda spark, sf_dir: counted(segment(documents(spark, sf_dir), o, arrow=True))


def segment_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = turns.select("doc_id", F.array_join(F.transform("t", lambda t: t["text"]), " ").alias("text"))
    return counted(segment(texts, SEGMENTS["segment_default"], arrow=True))


def segment_stats(spark, sf_dir):
    return stats(segment(documents(spark, sf_dir), SEGMENTS["segment_default"], arrow=True))


def segment_dense_table(spark, sf_dir):
    """The dense path with vectors from a table, joined by a number made of document and sentence."""
    vectors = table(spark, sf_dir, "embeddings")
    many = F.lit(max(1, vectors.count()))
    return counted(segment_by_table(documents(spark, sf_dir), SegmentOptions(64), vectors.select(F.col("vec_id").alias("id"), "embedding"), lambda i: F.pmod(F.col("doc_id") * 31 + i, many)))


DENSE_SCORES = """
  vec AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  many AS (SELECT greatest(1, count(*)) AS m FROM embeddings),
  scores AS MATERIALIZED (SELECT s.doc_id, s.i, coalesce(list_cosine_similarity(a.e, b.e), 0.0) AS score FROM many, st s JOIN st n ON n.doc_id = s.doc_id AND n.i = s.i + 1
    LEFT JOIN vec a ON a.vec_id = (s.doc_id * 31 + s.i) % m LEFT JOIN vec b ON b.vec_id = (n.doc_id * 31 + n.i) % m)"""


def top_k_terms(spark, sf_dir):
    """The leading terms of cache.keys(), without the keys themselves."""
    sentences = documents(spark, sf_dir).select("doc_id", F.transform(X.split_sentences(F.col("text")), X.letters).alias("s"))
    rows = rows_of(sentences, ["doc_id"], bulk.top_ngrams(F.col("s"), 3, 5, cache.TOP_K), "i", "terms")
    return rows.select("doc_id", "i", F.array_join("terms", " ").alias("terms"))


def _item_keys(spark, sf_dir):
    """Keys of the benchmark's sentences; doc_id says where a text is from."""
    return cache.keys(spread(table(spark, sf_dir, "benchmark")).select(F.concat(F.lit("item:"), "item_id").alias("doc_id"), "text"))


def _turn_keys(spark, sf_dir):
    doc = F.concat(F.lit("turn:"), F.col("conv_id"), F.lit(":"), F.col("turn"))
    return cache.keys(spread(table(spark, sf_dir, "conversations")).select(doc.alias("doc_id"), "text"))


def _with_id(keys, name):
    return keys.select(F.concat("doc_id", F.lit(":"), F.lpad(F.col("i").cast("string"), 6, "0")).alias(name), "key")


def cache_lookup(spark, sf_dir):
    """Sentences of conversations and of the benchmark in a cache of the benchmark's sentences."""
    items = _item_keys(spark, sf_dir)
    found = cache.lookup(_with_id(_turn_keys(spark, sf_dir).unionByName(items), "query_id"), _with_id(items, "entry_id"), 0.9)
    return found.select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"))


def cache_neighbours(spark, sf_dir):
    return cache.neighbours(_with_id(_item_keys(spark, sf_dir).unionByName(_turn_keys(spark, sf_dir)), "entry_id"), 0.9)


def _folder(spark) -> str:
    """A folder that executors reach: the one set for checkpoints, or where none is set, as in tests, a temporary one."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/cache-{uuid.uuid4().hex}"


def _named_vectors(rows):
    """A provider whose vectors say which sentence they are of."""
    parts = F.split(F.concat_ws(":", "doc_id", F.col("i").cast("string")), ":")
    return rows.orderBy("doc_id", "i").withColumn("embedding", F.transform(F.slice(parts, 2, 3), lambda p: p.cast("double")))


def _embedded(spark, sf_dir, cached, **options):
    """Embeds the benchmark's sentences, then those of conversations, through one cache: whose vector each got."""
    o = SegmentOptions(64, embedding_cache=cached, **options)
    cache.cached_embeddings(_item_keys(spark, sf_dir), _named_vectors, o)
    rows = cache.cached_embeddings(_turn_keys(spark, sf_dir), _named_vectors, o)
    return rows.select("doc_id", "i", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ":").alias("vector_of"))


def cache_force(spark, sf_dir):
    return _embedded(spark, sf_dir, cache.SemanticCache(spark, _folder(spark)), embedding_cache_mode=FORCE, cache_similarity_threshold=0.9)


def cache_adaptive(spark, sf_dir):
    """The cache serves the second batch if a sentence of the first has a neighbour before it."""
    return _embedded(spark, sf_dir, cache.AdaptiveCache(spark, _folder(spark)), embedding_cache_mode=ADAPTIVE, cache_similarity_threshold=0.7, adaptive_cache_activation_threshold=1)


def service_responses(spark, sf_dir):
    body = F.to_json(F.struct(F.col("text").alias("text"), (F.pmod(F.col("doc_id"), F.lit(3)) * 20).cast("int").alias("max_tokens")))
    answers = respond(documents(spark, sf_dir).select("doc_id", body.alias("body")))
    parsed = F.from_json("response", "stats struct<total_chunks:int,total_tokens:int>, error string")
    return answers.select("doc_id", "status", parsed.alias("r")).select("doc_id", "status", F.col("r.stats.total_chunks").alias("total_chunks"), F.col("r.stats.total_tokens").alias("total_tokens"), F.col("r.error").alias("error"))


def _keys_sql(source: str) -> str:
    """CTEs up to k(doc_id, i, term, w) of the n-gram keys."""
    o = SegmentOptions(64, tfidf_min_ngram_size=3, tfidf_max_ngram_size=5, pre_normalize_abbreviations=False)
    return f"{sql.parts(source, o)}, {sql.WEIGHTS}"


ITEMS_SQL = "SELECT 'item:' || item_id AS doc_id, coalesce(text, '') AS text FROM benchmark"
TURNS_SQL = "SELECT 'turn:' || conv_id || ':' || turn AS doc_id, coalesce(text, '') AS text FROM conversations"
CONV_SQL = "SELECT conv_id AS doc_id, array_to_string(list(coalesce(text, '') ORDER BY turn, text), ' ') AS text FROM conversations GROUP BY conv_id"
PAIR_SQL = """ids AS MATERIALIZED (SELECT doc_id || ':' || lpad(i::VARCHAR, 6, '0') AS id, doc_id LIKE 'item%' AS item, term, w FROM w),
  nrm AS MATERIALIZED (SELECT id, sqrt(sum(w * w)) AS norm FROM ids GROUP BY ALL),
  sim AS MATERIALIZED (SELECT a.id AS q, b.id AS e, a.item AS q_item, b.item AS e_item, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 9) AS s FROM ids a JOIN ids b ON a.term = b.term JOIN nrm x ON x.id = a.id JOIN nrm y ON y.id = b.id GROUP BY ALL)"""


def cached_sql(threshold: float, activation: int) -> str:
    """Whose vector each sentence of the conversations gets, if so many of the benchmark's have a neighbour."""
    numbers = lambda x: f"regexp_replace(regexp_replace({x}, '^[a-z]*:', ''), ':0*([0-9]+)$', ':\\1')"
    return f"""WITH {_keys_sql(f'{TURNS_SQL} UNION ALL {ITEMS_SQL}')}, {PAIR_SQL},
      near AS (SELECT count(DISTINCT q) AS n FROM sim WHERE q_item AND e_item AND s >= {threshold} AND e < q),
      best AS (SELECT q, e FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, e) AS r FROM sim WHERE e_item AND s >= {threshold}) WHERE r = 1),
      asked AS (SELECT doc_id, i, doc_id || ':' || lpad(i::VARCHAR, 6, '0') AS id FROM st WHERE doc_id LIKE 'turn%')
      SELECT asked.doc_id, asked.i, {numbers('CASE WHEN n >= ' + str(activation) + ' THEN coalesce(e, id) ELSE id END')} AS vector_of FROM asked LEFT JOIN best ON q = id, near"""


def service_sql() -> str:
    parts = ["SELECT doc_id, 400 AS status, NULL::INT AS total_chunks, NULL::INT AS total_tokens, 'max_tokens must be > 0' AS error FROM documents WHERE doc_id % 3 = 0"]
    for k in (1, 2):
        inner = sql.segmented(f"SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 3 = {k}", SegmentOptions(20 * k))
        parts.append(f"SELECT d.doc_id, 200 AS status, count(c.doc_id)::INT AS total_chunks, coalesce(sum(num_tokens), 0)::INT AS total_tokens, NULL AS error FROM documents d LEFT JOIN ({inner}) c ON c.doc_id = d.doc_id WHERE d.doc_id % 3 = {k} GROUP BY d.doc_id")
    return " UNION ALL ".join(parts)


def queries() -> dict:
    plain = (normalize_abbreviations, normalize_with_contractions, split_sentences, tokenize, token_counts, char_ngrams, script_candidates, remove_stopwords, stem_tokens, document_frequency, sentence_tfidf, dense_cosine_adjacent, segment_conversations, segment_stats, segment_dense_table, top_k_terms, cache_lookup, cache_neighbours, cache_force, cache_adaptive, service_responses)
    found = {f.__name__: f for f in plain}
    found |= {name: detect(o) for name, o in DETECT.items()}
    found |= {name: segments(o) for name, o in SEGMENTS.items()}
    found |= {"cohesion_tfidf": cohesion(SEGMENTS["segment_default"]), "cohesion_ngram": cohesion(SegmentOptions(64, tfidf_min_ngram_size=3, tfidf_max_ngram_size=5))}
    found |= {"boundaries_threshold": bounds(SEGMENTS["segment_threshold"]), "boundaries_local_min": bounds(SEGMENTS["segment_default"])}
    return found


def oracle_sql() -> dict[str, str]:
    raw = sql.parts(DOCS_SQL, RAW)
    out = {
        "normalize_abbreviations": f"SELECT doc_id, {sql.normalized('text')} AS normalized FROM ({DOCS_SQL})",
        "normalize_with_contractions": f"SELECT doc_id, {sql.normalized('text', 'lang')} AS normalized FROM (SELECT doc_id, coalesce(text, '') AS text, {LANG_SQL} AS lang FROM documents)",
        "split_sentences": f"SELECT doc_id, unnest(range(0, len(s))) AS i, unnest(s) AS sentence FROM (SELECT doc_id, {sql.sentences('text')} AS s FROM ({DOCS_SQL}))",
        "tokenize": f"SELECT doc_id, array_to_string({sql.tokens('text')}, ' ') AS tokens FROM ({DOCS_SQL})",
        "token_counts": f"SELECT doc_id, len(s) AS n_sentences, array_to_string(list_transform(s, lambda y: len({sql.tokens('y')})), ' ') AS counts FROM (SELECT doc_id, {sql.sentences('text')} AS s FROM ({DOCS_SQL}))",
        "char_ngrams": f"SELECT doc_id, array_to_string({sql.ngrams('text', 3, 5)}, ' ') AS ngrams FROM ({DOCS_SQL})",
        "script_candidates": f"SELECT doc_id, {sql.script('text')} AS script FROM ({DOCS_SQL})",
        "remove_stopwords": f"""SELECT d.doc_id, CASE WHEN d.lang = 'unknown' THEN d.text ELSE coalesce(k.kept, '') END AS kept FROM (SELECT doc_id, coalesce(text, '') AS text, {LANG_SQL} AS lang FROM documents) d LEFT JOIN (
            SELECT doc_id, array_to_string(list(w ORDER BY k), ' ') AS kept FROM (SELECT doc_id, lang, unnest(range(0, len(t))) AS k, unnest(t) AS w FROM (SELECT doc_id, {LANG_SQL} AS lang, {sql.tokens("coalesce(text, '')")} AS t FROM documents)) x
            ANTI JOIN {sql.stopwords()} ON sw.lang = x.lang AND sw.word = x.w GROUP BY doc_id) k ON k.doc_id = d.doc_id""",
        "stem_tokens": f"""SELECT d.doc_id, coalesce(s.stems, '') AS stems FROM documents d LEFT JOIN (SELECT doc_id, array_to_string(list({sql.stemmed('w', 'lang')} ORDER BY k), ' ') AS stems FROM (
            SELECT doc_id, lang, unnest(range(0, len(t))) AS k, unnest(t) AS w FROM (SELECT doc_id, {LANG_SQL} AS lang, {sql.tokens("coalesce(text, '')")} AS t FROM documents)) GROUP BY doc_id) s ON s.doc_id = d.doc_id""",
        "document_frequency": f"WITH {raw}, {sql.WEIGHTS} SELECT doc_id, term, df FROM df",
        "sentence_tfidf": f"WITH {raw}, {sql.WEIGHTS} SELECT doc_id, i, term, round(w, 6) AS weight FROM w",
        "dense_cosine_adjacent": "SELECT a.vec_id, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0.0), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "segment_conversations": sql.segmented(CONV_SQL, SEGMENTS["segment_default"]),
        "segment_stats": f"SELECT count(*) AS total_chunks, coalesce(sum(num_tokens), 0)::BIGINT AS total_tokens FROM ({sql.segmented(DOCS_SQL, SEGMENTS['segment_default'])})",
        "segment_dense_table": sql.segmented(DOCS_SQL, RAW, DENSE_SCORES),
        "top_k_terms": f"WITH {_keys_sql(DOCS_SQL)} SELECT st.doc_id, st.i, coalesce(terms, '') AS terms FROM st LEFT JOIN (SELECT doc_id, i, array_to_string(list(term ORDER BY r), ' ') AS terms FROM (SELECT doc_id, i, term, row_number() OVER (PARTITION BY doc_id, i ORDER BY round(w, 12) DESC, term) AS r FROM w) WHERE r <= {cache.TOP_K} GROUP BY doc_id, i) t ON t.doc_id = st.doc_id AND t.i = st.i",
        "cache_lookup": f"WITH {_keys_sql(f'{TURNS_SQL} UNION ALL {ITEMS_SQL}')}, {PAIR_SQL} SELECT q AS query_id, e AS entry_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, e) AS r FROM sim WHERE e_item AND s >= 0.9) WHERE r = 1",
        "cache_neighbours": f"WITH {_keys_sql(f'{TURNS_SQL} UNION ALL {ITEMS_SQL}')}, {PAIR_SQL} SELECT DISTINCT q AS entry_id FROM sim WHERE e < q AND s >= 0.9",
        "cache_force": cached_sql(0.9, 0),
        "cache_adaptive": cached_sql(0.7, 1),
        "service_responses": service_sql(),
    }
    out |= {name: detect_sql(o) for name, o in DETECT.items()}
    out |= {name: sql.segmented(DOCS_SQL, o) for name, o in SEGMENTS.items()}
    for name, o in (("cohesion_tfidf", SEGMENTS["segment_default"]), ("cohesion_ngram", SegmentOptions(64, tfidf_min_ngram_size=3, tfidf_max_ngram_size=5))):
        out[name] = f"WITH {sql.parts(DOCS_SQL, o)}, {sql.WEIGHTS}, {sql.SCORES} SELECT doc_id, i, round(score, 6) AS score FROM scores"
    for name, o in (("boundaries_threshold", SEGMENTS["segment_threshold"]), ("boundaries_local_min", SEGMENTS["segment_default"])):
        out[name] = f"WITH {sql.parts(DOCS_SQL, o)}, {sql.WEIGHTS}, {sql.SCORES}, {sql.bounds(o)} SELECT doc_id, i, brk FROM bounds"
    return out

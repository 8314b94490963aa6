import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from chunkwell.operators import cache as C
from chunkwell.operators.segment import segment, sentence_rows
from chunkwell.plans.options import SegmentOptions
from chunkwell.sources.embeddings import HttpProvider, embed, workers
from chunkwell.sources.service import respond
from chunkwell.streaming import dense_batches, segment_stream

DOCS = [(1, "Alpha beta gamma delta. Alpha beta gamma delta."), (2, "Completely different words here. Another one.")]


class Answers(BaseHTTPRequestHandler):
    def do_POST(self):
        prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
        body = json.dumps({"error": "no"} if "fail" in prompt else {"embedding": [float(len(prompt)), 1.0]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_http_provider(spark, url):
    rows = sentence_rows(spark.createDataFrame(DOCS, "doc_id long, text string"), SegmentOptions(5))
    got = embed(rows, HttpProvider(url, "m")).collect()
    assert all(r.embedding == [float(len(r.sentence)), 1.0] for r in got) and len(got) == 4
    with pytest.raises(RuntimeError, match="error"):
        HttpProvider(url, "m")(["fail"])
    assert [workers(v, 10) for v in (None, "x", "0", "2", "99")] == [4, 4, 4, 2, 10]


def test_service(spark):
    bodies = ['{"text": "A b. C d.", "max_tokens": 2, "unknown": 1}', '{"text": "x", "max_tokens": 0}', "not json", '{"text": "One two.", "max_tokens": 5, "depth_threshold": -1}', json.dumps({"text": "x" * (1 << 20), "max_tokens": 5})]
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = {r.n: (r.status, json.loads(r.response)) for r in respond(rows).collect()}
    assert [got[n][0] for n in range(5)] == [200, 400, 400, 200, 413]
    assert [c["Text"] for c in got[0][1]["chunks"]] == ["A b.", "C d."] and got[0][1]["stats"] == {"total_chunks": 2, "total_tokens": 4}
    assert got[1][1] == {"error": "max_tokens must be > 0"}
    assert got[3][1]["options_used"]["depth_threshold"] == 0.1 and got[0][1]["options_used"]["depth_threshold"] == 0.0


def test_service_errors_are_each_requests_own(spark):
    bodies = [json.dumps({"text": "A b. C d.", "max_tokens": n}) for n in (2, 2, 3, 4)] + ['{"text": "x y.", "max_tokens": 2, "embedding_cache_mode": "force"}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = {r.n: (r.status, json.loads(r.response)) for r in respond(rows, max_option_sets=2).collect()}
    assert sorted(s for s, _ in got.values()) == [200, 200, 200, 500, 500] and got[0][0] == got[1][0] == 200
    assert all("sets of options" in r["error"] for s, r in got.values() if s == 500)
    got = {r.n: (r.status, json.loads(r.response)) for r in respond(rows).collect()}
    assert got[4][0] == 200 and got[4][1]["options_used"]["embedding_cache_mode"] == "disable"  # TF-IDF was used
    provider = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0)))
    got = {r.n: (r.status, json.loads(r.response)) for r in respond(rows, provider=provider).collect()}
    assert got[4][0] == 400 and "embedding_cache" in got[4][1]["error"] and got[0][0] == 200


def test_service_with_embeddings(spark, tmp_path):
    provider = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0), F.when(F.col("sentence").startswith("C"), -5.0).otherwise(0.0)))
    held = C.SemanticCache(spark, str(tmp_path))
    bodies = ['{"text": "A b. C d. C e.", "max_tokens": 50, "min_split_similarity": 0.5, "embedding_cache_mode": "force"}', '{"text": "", "max_tokens": 50, "min_split_similarity": 0.5, "embedding_cache_mode": "force"}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    got = {r.n: json.loads(r.response) for r in respond(rows, provider=provider, cache=held).collect()}
    assert [c["Text"] for c in got[0]["chunks"]] == ["A b.", "C d. C e."] and got[1]["stats"] == {"total_chunks": 0, "total_tokens": 0}
    assert got[0]["options_used"]["embedding_cache_mode"] == "force" and got[0]["options_used"]["cache_similarity_threshold"] == 0.9 and held.rows == 3


def test_cache_lookup(spark):
    keys = C.keys(spark.createDataFrame(DOCS, "doc_id long, text string")).withColumn("id", F.col("doc_id") * 10 + F.col("i"))
    entries = keys.select(F.col("id").alias("entry_id"), "key")
    found = {r.query_id: (r.entry_id, r.similarity) for r in C.lookup(keys.select(F.col("id").alias("query_id"), "key"), entries, 0.9).collect()}
    assert found == {10: (10, 1.0), 11: (10, 1.0), 20: (20, 1.0), 21: (21, 1.0)}
    assert [r[0] for r in C.neighbours(entries, 0.9).collect()] == [11]


def brute_pairs(keys, threshold):
    """(earlier, later, cosine) of all pairs of (id, key) at or above the threshold."""
    norm = {i: math.sqrt(sum(w * w for w in k.values())) for i, k in keys}
    out = []
    for n, (i, a) in enumerate(keys):
        for j, b in keys[n + 1 :]:
            d = norm[i] * norm[j]
            cosine = round(sum(w * b.get(t, 0.0) for t, w in a.items()) / d, 9) if d else 0.0
            if cosine >= threshold:
                out.append((i, j, cosine))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_cache_against_brute_force(spark, threshold):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    texts = [". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 6))) + "." for _ in range(25)] + ["?!", ""]
    rows = C.keys(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("id", F.col("doc_id") * 100 + F.col("i"))
    keys = sorted((r.id, r.key) for r in rows.collect())
    pairs = brute_pairs(keys, threshold)
    entries = rows.select(F.col("id").alias("entry_id"), "key")
    assert sorted(r[0] for r in C.neighbours(entries, threshold).collect()) == sorted({j for _, j, _ in pairs})
    best = {}
    for i, j, c in [(x, y, c) for i, j, c in pairs for x, y in ((i, j), (j, i))] + [(i, i, 1.0) for i, k in keys if any(k.values())]:
        best[i] = min(best.get(i, (0, 0)), (-c, j))
    got = {r.query_id: (-r.similarity, r.entry_id) for r in C.lookup(rows.select(F.col("id").alias("query_id"), "key"), entries, threshold).collect()}
    assert got == best


def test_cache_modes(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def answer(batches):
        for batch in batches:
            asked.add(len(batch))
            yield batch.assign(embedding=[[float(len(s))] for s in batch["sentence"]])

    provider = lambda rows: rows.mapInPandas(answer, rows.withColumn("embedding", F.array(F.lit(1.0))).schema)
    rows = C.keys(spark.createDataFrame(DOCS, "doc_id long, text string")).cache()
    path = str(tmp_path / "a")
    force = SegmentOptions(5, embedding_cache_mode="force", embedding_cache=C.SemanticCache(spark, path))
    assert C.cached_embeddings(rows, provider, force).count() == 4 and asked.value == 4  # once a sentence
    again = C.cached_embeddings(rows, provider, force)
    assert {(r.doc_id, r.i): r.embedding for r in again.collect()}[1, 0] == [23.0] and asked.value == 4
    reopened = C.SemanticCache(spark, path)
    assert reopened.rows == 4 and reopened.analyze_similarity() == 1 and reopened.entries().select("entry_id").distinct().count() == 4
    force.embedding_cache.close()
    with pytest.raises(ValueError, match="closed"):
        C.cached_embeddings(rows, provider, force)
    adaptive = SegmentOptions(5, embedding_cache_mode="adaptive", embedding_cache=C.AdaptiveCache(spark, str(tmp_path / "b")), adaptive_cache_activation_threshold=1)
    assert C.cached_embeddings(rows, provider, adaptive).count() == 4 and asked.value == 8
    assert not adaptive.embedding_cache.state.get("activated") and adaptive.embedding_cache.is_activated()
    C.cached_embeddings(rows, provider, adaptive).count()
    assert asked.value == 8 and C.AdaptiveCache(spark, str(tmp_path / "b")).state["activated"]
    with pytest.raises(ValueError, match="AdaptiveCache"):
        C.cached_embeddings(rows, provider, SegmentOptions(5, embedding_cache_mode="adaptive", embedding_cache=C.SemanticCache(spark, path)))


def test_cache_flush_compaction_and_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "FLUSH_ROWS", 4)
    cache, written = C.SemanticCache(spark, str(tmp_path)), []
    for k in range(14):
        rows = C.keys(spark.createDataFrame([(k, f"Sentence number {k * 1111} is here. And {'x' * (k + 3)} too.")], "doc_id long, text string")).withColumn("embedding", F.array(F.lit(float(k))))
        written.append(cache.set(rows, 0.9, f"batch-{k}"))
        cache.set(rows, 0.9, f"batch-{k}")  # once more: nothing is added
        assert cache.rows == 2 * k + 2 and cache.entries().select("entry_id").distinct().count() == cache.rows
    flushed = [s for s in cache.state["segments"] if s["flushed"]]
    assert 1 < len(flushed) <= C.COMPACT_ABOVE and len(cache.state["segments"]) < 8
    assert all(w.count() == 2 for w in written)  # rows that were returned can still be read
    queries = C.keys(spark.createDataFrame([(0, "Sentence number 0 is here. And xxx too.")], "doc_id long, text string")).select(F.col("i").alias("query_id"), "key")
    assert {tuple(r.embedding) for r in cache.find(queries, 0.99).collect()} == {(0.0,)}
    cache.close()
    assert C.SemanticCache(spark, str(tmp_path)).rows == 28 and len([p for p in tmp_path.iterdir() if p.is_dir()]) == len(cache.state["segments"])


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = segment_stream(stream, SegmentOptions(5)).writeStream.format("memory").queryName("chunks").start()
    query.processAllAvailable()
    query.stop()
    expected = sorted((r.doc_id, r.chunk_index, r.text) for r in segment(docs, SegmentOptions(5)).collect())
    assert sorted((r.doc_id, r.chunk_index, r.text) for r in spark.table("chunks").collect()) == expected
    seen = []
    options = SegmentOptions(5, embedding_cache_mode="force", embedding_cache=C.SemanticCache(spark, str(tmp_path / "c")))
    batch = dense_batches(options, lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0))), lambda chunks, n: seen.extend(chunks.collect()))
    query = stream.writeStream.foreachBatch(batch).start()
    query.processAllAvailable()
    query.stop()
    assert sum(r.num_tokens for r in seen) == 14
    once = len(seen)
    batch(docs, 0)  # a repeated micro-batch
    assert options.embedding_cache.rows == 4 and len(seen) == 2 * once


def test_dense_batches_normalize(spark):
    docs, out = spark.createDataFrame([(1, "He is in the U.S.A. now. Fine etc.....")], "doc_id long, text string"), []
    dense_batches(SegmentOptions(50), lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0))), lambda chunks, n: out.extend(chunks.collect()))(docs, 0)
    assert [r.text for r in out] == [r.text for r in segment(docs, SegmentOptions(50)).collect()] and "USA. now" in out[0].text

"""Each stage of corpus_pipeline against a brute-force version on its own input, and the odd cases of all of them."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from chunkwell.llm import bpe, packing, toxicity

from .test_line_dedup import brute, words_of
from .test_simhash import jaccard_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, th int, leak_doc int"
STAGES = dict(P.STAGES)


def row(doc, text):
    return (doc, text, "en", "web", None if text is None else len(text), "own", 5, 6)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark."""
    rng = random.Random(12)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{k % 7}" for k in range(400)]
    said = lambda n: [rng.choice(words) for _ in range(n)]
    items = [said(20) for _ in range(4)]
    passage, docs, labels = said(70), [], []
    for i in range(240):
        own = said(rng.randint(5, 90))
        if i % 8 == 0:
            own[rng.randrange(len(own))] = rng.choice(["nasty", "vilest", "awful"])
        if i % 10 == 3:
            at = rng.randrange(len(own))
            own[at:at] = passage
        if i % 12 == 5:
            own[3:3] = items[i % 4][:14] + ["changed"] + items[i % 4][15:]
        docs.append(row(i, " ".join(own)))
        labels.append((i, int(i % 8 == 0)))
    for i in range(40):  # copies, exact and with an edit
        text = docs[i * 5][1].split()
        if i % 2:
            text[len(text) // 2] = "edit"
        docs.append(row(300 + i, " ".join(text)))
    docs += [row(None, docs[7][1]), row(None, None), row(500, ""), row(501, None), row(502, " \n"), docs[4], docs[4], row(4, "another text that has the same id"), row(None, docs[9][1])]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_and_empty_tables(spark, sf, docs, name):
    out = STAGES[name](spark, docs, sf)
    assert out.columns == docs.columns and {(r._doc, r.th, r.leak_doc) for r in out.collect()} == {("own", 5, 6)}
    empty = STAGES[name](spark, docs.limit(0), sf)
    assert empty.count() == 0 and empty.columns == docs.columns


def test_toxicity(spark, sf, docs):
    """The model's weights summed here, word by word; test_others holds the learning against known toxic words."""
    chosen, weights, bias = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(chosen.tolist(), weights.tolist()))

    def score(text):
        features = {f for token in (text or "").lower().split() for f in toxicity.word_features(token)}
        return bias + sum(weight.get(f, 0.0) for f in features)

    every, kept = pairs(docs), pairs(STAGES["toxicity"](spark, docs, sf))
    assert len(weight) > 2 and kept == Counter({k: n for k, n in every.items() if score(k[1]) < 0}) and 10 < sum(every.values()) - sum(kept.values()) < 80


def test_line_dedup(spark, sf, docs):
    out = STAGES["line_dedup"](spark, docs, sf).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # texts that share an id are told apart by a hash, in which the order of places follows
    h = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.shiftright(F.xxhash64(F.col("doc_id").isNull(), "text"), 32).alias("h")).collect()}
    once = sorted({x for x in rows if x[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0, h[x]))
    gone = brute([(k, t) for k, (_, t) in enumerate(once)], 50, 30)
    expected = {x: [w for k, w in enumerate(words_of(x[1])) if k not in gone[n]] for n, x in enumerate(once)}
    assert sum(map(len, gone.values())) > 1000 and len(out) == len(rows)
    assert Counter((r.doc_id, tuple(words_of(r.text or ""))) for r in out) == Counter((i, tuple(expected.get((i, t), ()))) for i, t in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


def test_near_dedup(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    root, kept = jaccard_groups(rows), pairs(STAGES["simhash_near_dedup"](spark, docs, sf))
    groups = {}
    for r, x in zip(root, rows):
        groups.setdefault(r, []).append(x)
    assert len(groups) < len(rows) - 30 and sum(kept.values()) == len(groups)
    for members in groups.values():
        stays = [x for x in set(members) if kept[x]]
        least = min((x[0] for x in members if x[0] is not None), default=None)
        assert len(stays) == 1 and kept[stays[0]] == 1 and stays[0][0] == least


def test_decontamination(spark, sf, docs):
    items = [r.text.split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        w = (text or "").lower().split()
        return any(sum(a == b for a, b in zip(item, w[at : at + len(item)])) >= 0.6 * len(item) for item in items for at in range(len(w)))

    every, kept = pairs(docs), pairs(STAGES["decontamination"](spark, docs, sf))
    assert kept == Counter({k: n for k, n in every.items() if not leaks(k[1])}) and sum(kept.values()) < sum(every.values()) - 15


def test_packing(spark, sf, docs):
    vocab, expected = bpe.vocabulary(bpe.default_path()), Counter()
    for r in docs.collect():
        ids = [*vocab.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(packing.cut_lengths(len(ids), 1024)):
            expected[r.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    got = STAGES["packing"](spark, docs, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and len(filled) <= sum(filled.values()) / 1024 * 1.1 + 1
    assert STAGES["packing"](spark, docs.limit(0), sf).count() == 0


def test_run_is_its_stages(spark, sf, docs):
    out = docs
    for _, stage in P.STAGES:
        out = stage(spark, out, sf)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, P.run(spark, sf).select(columns).collect())) == Counter(map(tuple, out.select(columns).collect()))

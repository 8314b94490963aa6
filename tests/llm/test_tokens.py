import random
import time
import zlib

import numpy as np
import pytest

from chunkwell.llm import bpe, packing, token_counts

PARTS = [" ", "  ", "\n", " \n", "\t", "\xa0", "a", "the", "'re", "'s", "'", "!", "1", "22", "é", "ß", "日本", "<|endoftext|>", "<|end", "🙂", "\x1c", "don't", "'ll", ".", ",", "-----", "     ", "—", "　"]


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(bpe.default_path())


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_every_prefix_is_exact(vocab):
    for text in texts(1500, 1):
        expected = [len(vocab.tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert token_counts.counts_of(vocab.prefix_deltas(text)).tolist() == expected, repr(text)


def test_fits_is_the_longest_prefix(vocab):
    for text in texts(300, 9):
        counts = [len(vocab.tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        for budget in range(4):
            assert token_counts.longest_prefix(token_counts.counts_of(vocab.prefix_deltas(text)), budget) == max(k for k, n in enumerate(counts) if n <= budget)


@pytest.mark.parametrize("text", ["\n\n" + "bcdfgaeiou" * 3000, " " * 30_000, "\n" * 30_000 + "x", "  " + "日本語" * 3000, "<|endoftext|>" * 3000, " 're" * 3000, "\t \n" * 5000 + "<|endoftext|>  "], ids=lambda t: repr(t[:8]))
def test_long_units(vocab, text):
    """Linear in the length: encoding each prefix would take hours here."""
    began = time.time()
    counts = token_counts.counts_of(vocab.prefix_deltas(text))
    assert time.time() - began < 20
    for k in (1, 2, 3, 100, 2999, len(text) - 1, len(text)):
        assert counts[k] == len(vocab.tokenizer.encode(text[:k], add_special_tokens=False).ids)


def test_ids_are_the_librarys(vocab):
    for text in texts(1500, 2):
        assert np.frombuffer(vocab.encode_bytes(text), "<u4").tolist() == vocab.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_plain_characters_are_classed_alike(vocab):
    for c in range(0x250):
        text = f"a{chr(c)}b {chr(c)}{chr(c)}1 x{chr(c)}"
        assert [m.span() for m in bpe.PIECE.finditer(text)] == [o for _, o in vocab.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_prefix_counts(spark, vocab):
    long = "word " * 2000
    rows = spark.createDataFrame([(1, "one two", "x"), (2, "", "y"), (3, None, "z"), (None, long, "w"), (1, "one two", "x")], "doc_id long, text string, n_bytes string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit, r.fits_chars, len(r.token_deltas)) for r in token_counts.prefix_counts(rows, limit=10).collect()))
    counts = [len(vocab.tokenizer.encode(long[:k]).ids) for k in range(80)]  # it only grows: 10 tokens come long before
    fits, n = max(k for k in range(80) if counts[k] <= 10), len(vocab.tokenizer.encode(long).ids)
    assert got == [(0, 10000, n, True, fits, 10000), (1, 7, 2, False, 7, 7), (1, 7, 2, False, 7, 7), (2, 0, 0, False, 0, 0), (3, 0, 0, False, 0, 0)]
    assert token_counts.prefix_counts(rows.limit(0)).count() == 0


def test_best_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 101, 500)
    bins, offsets, fills = packing.best_fit(sizes, 100)
    assert fills.max() <= 100 and np.array_equal(np.bincount(bins, sizes).astype(int), fills)
    for b in range(len(fills)):
        own = np.argsort(offsets[bins == b])
        assert offsets[bins == b][own].tolist() == np.concatenate([[0], np.cumsum(sizes[bins == b][own])[:-1]]).tolist()
    assert packing.cut_lengths(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut_lengths(2048, 1024) == [(0, 1024), (1024, 1024)]


@pytest.mark.parametrize("at_once", [7, 1 << 17])
def test_packing(spark, vocab, monkeypatch, at_once):
    monkeypatch.setattr(packing, "PIECES_AT_ONCE", at_once)
    rng = random.Random(4)
    docs = [(i, " ".join("word" for _ in range(rng.choice([0, 3, 20, 45, 130])))) for i in range(120)] + [(200, None), (None, "a b"), (5, "a b")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = packing.pack(rows, capacity=50, group_items=20).collect()
    pieces = {}
    for doc, text in docs:
        ids = [*vocab.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(packing.cut_lengths(len(ids), 50)):
            pieces.setdefault(doc, []).append((k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    for doc in pieces:
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc) == sorted(pieces[doc])
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 50
    total = sum(r.length for r in got)
    assert len(by) <= total / 50 * 1.15 + 2
    assert packing.pack(rows.limit(0)).count() == 0

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chunkwell.llm import linededup as D
from chunkwell.llm import words as words_module
from chunkwell.llm.words import batch_words, run_hashes


def words_of(text):
    return re.findall(r"[^ \t-\r]+", text)


def brute(docs, least, least_line=10**9):
    """For each id: the words to take out. A run of `least` words, or a line of least_line words up to there, stays
    where it stands first and goes at each later place."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        words, gone, at = words_of(text or ""), set(), 0
        found = [(p, p + least) for p in range(len(words) - least + 1)]
        for line in (text or "").split("\n"):
            n = len(words_of(line))
            found += [(at, at + n)] if least_line <= n < least else []
            at += n
        whole = {(a, b) for a, b in found if b - a < least}
        for a, b in sorted(found):
            key = (b - a == least or (a, b) not in whole, tuple(words[a:b]))
            if key in seen:
                gone |= set(range(a, b))
            seen.add(key)
        out[doc] = gone
    return out


def test_winnowing_is_guaranteed():
    rng = np.random.default_rng(1)
    for _ in range(50):
        h = rng.integers(0, 9, rng.integers(1, 60)).astype(np.uint64) << np.uint64(30)
        places = set(D.winnow(h, 5).tolist())
        for i in range(len(h) - 4):
            window = h[i : i + 5]
            assert i + int(np.flatnonzero(window == window.min())[-1]) in places


def test_hashes_depend_on_their_words_only():
    w = batch_words(pa.array(["a b c d e f g h i j", None, "", " x c\td e\nf g h  y", "ä c"]), places=True)
    assert w.first.tolist() == [0, 10, 10, 10, 18, 20] and w.length.tolist() == [19, 0, 0, 17, 3]
    assert w.start[10:].tolist() == [1, 3, 5, 7, 9, 11, 13, 16, 0, 2] and len(set(w.line.tolist())) == 4
    a, b = w.hash[:10], w.hash[10:18]
    for n in (1, 2, 3, 5, 6):
        ha, hb = run_hashes(a, n), run_hashes(b, n)
        assert len(ha) == 10 - n + 1
        same = {(i, j) for i in range(len(ha)) for j in range(len(hb)) if ha[i] == hb[j]}
        assert same == {(i, i - 1) for i in range(2, 8 - n + 1)}


def test_words_longer_than_a_block(monkeypatch):
    texts = ["ab " * 50 + "x" * 300 + " ab y" + "é" * 40, "x" * 300]
    whole = batch_words(pa.array(texts)).hash
    monkeypatch.setattr(words_module, "BLOCK", 16)
    assert (batch_words(pa.array(texts)).hash == whole).all() and whole[50] == whole[-1]


def test_against_brute_force(spark):
    random.seed(5)
    word = lambda: random.choice("abcdefghijklmnopqrstuvwxyz") + random.choice("abcdefghijklmnopqrstuvwxyz") + random.choice("xyz")
    passage = [word() for _ in range(14)]
    docs = []
    for i in range(40):
        words = [word() for _ in range(random.randint(0, 30))]
        if i % 3 == 0:
            at = random.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, random.choice([" ", "\n", "  "]).join(words)))
    line = " ".join(word() for _ in range(7))
    docs += [(45, "a b\n" + line + "\nc"), (46, line), (47, line + " more words"), (48, "d\n\n " + line + " \ne é\n" + line)]
    docs += [(40, docs[3][1]), (41, "to " * 60), (42, ""), (43, None), (44, "x y z " * 20), (None, docs[6][1])]
    rows = spark.createDataFrame([(i, t, "extra", i) for i, t in docs], "doc_id long, text string, doc string, _doc long")
    got = {r.doc_id: r for r in D.dedup(rows, line_words=5, run_words=10, least_line=6).collect()}
    expected = brute(docs, 10, 6)
    assert len(expected[46]) == 7 and not expected[47] and len(expected[48]) == 14
    for i, text in docs:
        if text is None:
            assert got[i].text is None and got[i].n_removed == 0
            continue
        words = words_of(text)
        assert words_of(got[i].text) == [w for k, w in enumerate(words) if k not in expected[i]], i
        assert len(got[i].text) + got[i].n_removed == len(text) and (got[i].doc, got[i]._doc) == ("extra", i)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert D.dedup(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text == text, r.text == "") for r in D.dedup(rows).collect()) == [(1, True, False), (1, True, False), (2, False, True)]
    with pytest.raises(ValueError):
        D.dedup(rows, 60, 50)
    with pytest.raises(ValueError):
        D.dedup(rows, 20, 50)


def test_a_short_first_occurrence(spark):
    """The fingerprint's line stands in another context first; the passage around it is shared by later texts only."""
    rng = random.Random(8)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    passage, other, docs = words(30), words(10), []
    for i in range(len(passage) - 4):  # each line of the passage first stands alone
        docs.append((i, words(3) + passage[i : i + 5] + words(3)))
    docs += [(100, words(4) + passage), (101, passage + words(2)), (102, words(3) + passage[8:] + other), (103, passage[14:] + other), (104, words(6) + passage[20:25])]
    docs += [(105, ["to"] * 7), (106, ["to"] * 40), (107, words(2) + ["to"] * 40 + words(2))]
    docs = [(i, " ".join(w)) for i, w in docs]
    got = {r.doc_id: r.text for r in D.dedup(spark.createDataFrame(docs, "doc_id long, text string"), line_words=5, run_words=10, least_line=9).collect()}
    expected = brute(docs, 10)
    assert len(expected[101]) == 30 and len(expected[103]) == 26
    for i, text in docs:
        assert words_of(got[i]) == [w for k, w in enumerate(words_of(text)) if k not in expected[i]], i


def test_copies_whose_parts_came_before(spark):
    """60 copies of a passage of 50 words, after texts that hold parts of 40 words of it in other contexts."""
    rng = random.Random(3)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(50)
    docs = [(i, " ".join(words(20) + passage[i : i + 40] + words(20))) for i in range(11)]
    docs += [(100 + i, " ".join(words(i % 7 + 1) + passage + words(3))) for i in range(61)]
    got = {r.doc_id: r.n_removed for r in D.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i in got if got[i]] and sorted(i for i in got if got[i]) == list(range(101, 161))


def test_one_id_with_two_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, text), (1, text + " end"), (2, "a " + text)], "doc_id long, text string")
    got = sorted((r.doc_id, len(r.text.split())) for r in D.dedup(rows).collect())
    assert got in ([(1, 0), (1, 61), (2, 1)], [(1, 1), (1, 60), (2, 1)])

import random

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

from chunkwell.llm import simhash as S


def test_fingerprints():
    text = "A b\x0bC d  e f É"
    words = ["a", "b", "c", "d", "e f", "É"]
    h = [xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    assert S.text_fingerprint(text, 3) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert S.text_fingerprint("A b", 3) == xxh64_intdigest("a b", 42) and S.text_fingerprint(" \n", 3) == 0


def groups(n, edges):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def test_tries_find_the_links_of_brute_force():
    rng = np.random.default_rng(2)
    for errors in (0, 1, 2, 3):
        base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        flips = [b ^ np.uint64(sum(1 << x for x in set(rng.integers(0, 64, rng.integers(0, 5)).tolist()))) for b in base for _ in range(12)]
        keys = np.unique(np.array(flips, dtype=np.uint64))
        n = len(keys)
        expected = groups(n, [(i, j) for i in range(n) for j in range(i) if bin(int(keys[i] ^ keys[j])).count("1") <= errors])
        edges = []
        for _, by, top in S.covering_tries(errors):
            key = S.turned(keys, by)
            order = np.argsort(key)
            heads = key[order] >> np.uint64(64 - top) if top < 64 else np.arange(n)
            bounds = np.concatenate([[0], np.flatnonzero(heads[1:] != heads[:-1]) + 1, [n]])
            found = S.trie_links(key[order], keys[order][:, None], bounds, top, errors)
            edges += [(int(order[a]), int(order[b])) for a, b in found]
        assert all(bin(int(keys[a] ^ keys[b])).count("1") <= errors for a, b in edges)
        assert groups(n, edges) == expected


def test_a_dense_node():
    keys = np.array(sorted({(5 << 50) | x for x in range(4000)}), dtype=np.uint64)
    for top in (1, 21):
        edges = S.trie_links(keys, keys[:, None], np.array([0, 4000]), top, 2)
        assert len(edges) == len(keys) - 1


def test_near_duplicates(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    docs = []
    for i in range(60):
        own = list(base) if i % 2 else [rng.choice(words) for _ in range(300)]
        if i % 4 == 1:
            own[rng.randrange(300)] = "edit"
        docs.append((i, " ".join(own)))
    docs += [(100, ""), (101, None), (7, docs[7][1]), (None, docs[0][1])]
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string")
    got = S.near_duplicates(rows, words=3, errors=2).collect()
    fps = [S.text_fingerprint(t or "", 3) for _, t in docs]
    n = len(docs)
    root = groups(n, [(i, j) for i in range(n) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = {}
    for r, (doc, _) in zip(root, docs):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=key) == sorted([(d, f"{f:016x}", least[r]) for (d, _), f, r in zip(docs, fps, root)], key=key)
    assert S.near_duplicates(rows.limit(0)).count() == 0


def test_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = dict(S.components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_hot_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_KEYS", 20)
    keys = [(7 << 50) + 64 * x for x in range(90)]
    nodes = spark.createDataFrame([(k, k) for k in keys], "node long, fp long")
    edges = [(r.a, r.b) for r in S.links(nodes, ["fp"], S.covering_tries(2), 2).collect()]
    at = {k: i for i, k in enumerate(keys)}
    expected = groups(90, [(i, j) for i in range(90) for j in range(i) if bin(keys[i] ^ keys[j]).count("1") <= 2])
    assert groups(90, [(at[a], at[b]) for a, b in edges]) == expected


def test_wide_fingerprints():
    texts = ["A b C d e f a B c d e f", "a b c d e f a b c d e f", "", None, "x", "x y", " X\n", "a b c d e f"]
    node, fp = S.wide_fingerprints(pa.array(texts), 5)
    same = {(i, j) for i in range(8) for j in range(i) if node[i] == node[j]}
    assert same == {(1, 0), (3, 2), (6, 4)} and (fp[2] == 0).all()
    rows, h = S.shingle_hashes(pa.array(texts), 5)
    assert np.bincount(rows, minlength=8).tolist() == [8, 8, 0, 0, 1, 1, 1, 2]
    own = h[rows == 0]
    bits = np.unpackbits(S.mix(own + np.uint64(0x632BE59BD9B4E019)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    assert np.unpackbits(fp[0, :1].view(np.uint8), bitorder="little").tolist() == (2 * bits.sum(axis=0) > 8).astype(int).tolist()


def jaccard_groups(docs, words=5, least=0.8):
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    n = len(docs)
    close = lambda x, y: x == y or len(x & y) >= least * len(x | y)
    return groups(n, [(i, j) for i in range(n) for j in range(i) if close(sets[i], sets[j])])


def test_similar_against_brute_force(spark):
    """Copies with an edit every so many words, from 0.6 to 0.97 alike: almost no group is missed, none is too large."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(300):
        base = [rng.choice(words) for _ in range(rng.choice([20, 60, 200, 400]))]
        docs.append((2 * i, " ".join(base)))
        every = rng.choice([8, 20, 30, 45, 60, 100, 200])
        docs.append((2 * i + 1, " ".join("edit" if rng.random() < 1 / every else w for w in base)))
    docs += [(1000, ""), (1001, None), (1002, " "), (7, docs[7][1]), (7, "another text of the same id it is"), (None, docs[0][1]), (1003, "ab cd"), (1004, "AB  cd")]
    got = S.similar(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, doc int")).collect()
    assert len(got) == len(docs)
    key = {(r.doc_id, r.text): (r.doc, r.th) for r in S.keyed(spark.createDataFrame(docs, "doc_id long, text string")).select("doc", "th", "text").withColumnRenamed("doc", "doc_id").collect() for r in [type("R", (), {"doc_id": r.doc_id, "text": r.text, "doc": r.doc_id, "th": r.th})]}
    leader = {(r.doc, r.th): (r.leader_doc, r.leader_th) for r in got}
    own = [leader[key[((1 << 63) - 1 if d is None else d, t or "")]] for d, t in docs]
    root = jaccard_groups(docs)
    n = len(docs)
    expected = [(i, j) for i in range(n) for j in range(i) if root[i] == root[j]]
    missed = [p for p in expected if own[p[0]] != own[p[1]]]
    wrong = [(i, j) for i in range(n) for j in range(i) if root[i] != root[j] and own[i] == own[j]]
    assert len(expected) > 150 and len(missed) <= 0.05 * len(expected) and not wrong
    assert S.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0

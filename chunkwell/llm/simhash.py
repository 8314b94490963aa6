"""SimHash near-duplicates: fingerprints, and groups of fingerprints linked at few differing bits.

`near_duplicates`: of the XXH64 (seed 42) of every run of so many words, repeats included, each of the 64 bits is set
if it is set in over half of them; fingerprints link at `errors` or fewer differing bits. A text with fewer words has
its whole word sequence as its one run; a text with no words (also null) has fingerprint zero and is linked like any
other.

`similar`: texts link if their sets of runs of five words have a Jaccard similarity of 0.8 or more. Of 64 bits such
texts differ in ten or more, which is too near to what unlike texts do, so these fingerprints have 256 bits, made
likewise; pairs within their error budget are candidates, and the runs themselves are compared.

Links: a self-join of binary tries over the distinct fingerprints. Each trie has another run of bits on top, where
only equal nodes are paired: a pair of top nodes is one group of a shuffle. Below, node pairs are traversed together
level by level; a pair's differing bits add up, and it is pruned once they exceed the error budget or all its keys are
already linked. For `near_duplicates` errors + 1 tries have the whole budget covered: fingerprints that differ in no
more bits agree in one of the runs. For `similar` there are as many tries as find a pair at just 0.8 with probability
`RECALL`; the runs on top lengthen with the number of texts, so that groups stay small. A group gives out a spanning
forest of its links, nearest first, never all its pairs. Groups of more than GROUP_KEYS keys are split into blocks,
and every two blocks are a group.

Components: alternating star steps on the forest's edges until nothing changes.

Null ids take part like any id and sort last in a component. Copies meet before the join, as they have one
fingerprint. Extra columns are not carried; the result has a row for each row. Empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, keyed, large_batches, text_or_empty
from .words import batch_words, mix, run_hashes

BITS = 64
#: Words of 64 bits in a fingerprint of `similar`.
WIDE = 4
#: Chance that some trie's top node holds both of two texts that are just similar enough.
RECALL = 0.99
#: Keys of a group that one task compares.
GROUP_KEYS = 16_384


def text_fingerprint(text: str, words: int = 5) -> int:
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()  # of bytes: A-Z and the six ASCII white spaces only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), 42)
    total = np.zeros(BITS, dtype=np.int64)
    n = len(parts) - words + 1
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = (ends - np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) - 1)[:n].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    for at in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * total > n).tolist())


def fingerprints(df: DataFrame, words: int = 5) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([text_fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


# -- tries

#: A trie: the word of the fingerprint, by how many bits it is turned left, and the bits on top.
Trie = tuple[int, int, int]


@lru_cache(maxsize=8)
def covering_tries(errors: int) -> tuple[Trie, ...]:
    """Tries over one word: of any two keys that differ in `errors` bits, some trie's run on top is equal."""
    cuts = [BITS * i // (errors + 1) for i in range(errors + 2)]
    return tuple((0, (BITS - b) % BITS, b - a) for a, b in zip(cuts, cuts[1:]))


def differing(similarity: float) -> float:
    """The share of a fingerprint's bits in which two texts of equal size differ in the mean."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def likely_tries(n: int, similarity: float) -> tuple[Trie, ...]:
    """Tries over WIDE words, with runs on top that leave some 32 of n keys in a group."""
    bits = min(24, max(8, n.bit_length() - 6))
    hit = (1 - differing(similarity)) ** bits
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - hit) / WIDE) * WIDE
    return tuple((t % WIDE, BITS * (t // WIDE) * WIDE // count, bits) for t in range(count))


def error_budget(similarity: float) -> int:
    """Bits of WIDE words: three standard deviations over the mean of two texts that are just similar enough."""
    n, p = BITS * WIDE, differing(similarity)
    return math.ceil(n * p + 3 * math.sqrt(n * p * (1 - p)))


def turned(words: np.ndarray, by: int) -> np.ndarray:
    return words if by == 0 else (words << np.uint64(by)) | (words >> np.uint64(BITS - by))


class _Forest:
    """Union-find over positions, with the edges that joined something."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self) -> np.ndarray:
        up = np.array(self.up, dtype=np.int64)
        while (up[up] != up).any():
            up = up[up]
        return up

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


#: A node pair with at most so many pairs of keys is compared key by key.
LEAF_PAIRS = 256
#: Node pairs that are traversed at once, and so LEAF_PAIRS times as many pairs of keys; the rest waits on a stack.
AT_ONCE = 1 << 11
#: Groups of more keys first try to link their keys to one of them.
STAR = 32


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def trie_links(keys: np.ndarray, full: np.ndarray, groups: np.ndarray, top: int, errors: int) -> list[tuple[int, int]]:
    """A spanning forest, as positions, of the links within each group. keys: a word of each fingerprint, turned so
    that the group's common `top` bits come first, sorted in each group. full: the fingerprints, a row of words each.
    groups: the groups' starts and the end of the last."""
    n = len(keys)
    forest = _Forest(n)
    for lo, hi in zip(groups[:-1].tolist(), groups[1:].tolist()):
        rest = np.arange(lo, hi)
        while len(rest) > STAR:  # two keys within half the budget of a third are within the budget of each other
            near = distances(full[rest[1:]], full[rest[:1]]) <= errors // 2
            for x in rest[1:][near].tolist():
                forest.link(int(rest[0]), x)
            if 4 * near.sum() < len(rest):
                break
            rest = rest[1:][~near]
    known, changes, n_known = np.arange(n), np.arange(n), 0  # each key's root, and how often it changes up to there
    lo, hi = groups[:-1], groups[1:]
    many = hi - lo > 1
    stack = [(lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), dtype=np.int64), top)]
    while stack:
        a0, a1, b0, b1, diff, depth = stack.pop()
        if len(a0) > AT_ONCE:
            half = len(a0) // 2
            stack += [(a0[s], a1[s], b0[s], b1[s], diff[s], depth) for s in (slice(0, half), slice(half, None))]
            continue
        if len(forest.edges) > n_known:
            known, n_known = forest.roots(), len(forest.edges)
            changes = np.concatenate([[0], np.cumsum(known[1:] != known[:-1])])
        linked = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (known[a0] == known[b0])
        leaf = ~linked & (((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (depth == BITS))
        if leaf.any():
            i0, n_a, n_b = np.flatnonzero(leaf), (a1 - a0)[leaf], (b1 - b0)[leaf]
            size = n_a * n_b
            of = np.repeat(np.arange(len(i0)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            x, y = a0[i0][of] + k // n_b[of], b0[i0][of] + k % n_b[of]
            ahead = (x < y) & (known[x] != known[y])
            x, y = x[ahead], y[ahead]
            apart = distances(full[x], full[y])
            near = np.flatnonzero(apart <= errors)
            for p in near[np.argsort(apart[near], kind="stable")].tolist():
                forest.link(int(x[p]), int(y[p]))
        rest = ~linked & ~leaf
        if rest.any():
            a0, a1, b0, b1, diff = (v[rest] for v in (a0, a1, b0, b1, diff))

            def middle(start, stop):  # the first key of the node whose next bit is set
                bit = np.uint64(1) << np.uint64(BITS - depth - 1)
                low, high = start.copy(), stop.copy()
                while (open_ := low < high).any():
                    at = (low + high) >> 1
                    set_ = (keys[np.minimum(at, n - 1)] & bit) != 0
                    high = np.where(open_ & set_, at, high)
                    low = np.where(open_ & ~set_, at + 1, low)
                return low

            am, bm = middle(a0, a1), middle(b0, b1)
            same = (a0 == b0) & (a1 == b1)
            parts = []
            for p0, p1, q0, q1, d, twice in ((a0, am, b0, bm, diff, False), (am, a1, bm, b1, diff, False), (a0, am, bm, b1, diff + 1, False), (am, a1, b0, bm, diff + 1, True)):
                ok = (p1 > p0) & (q1 > q0) & (d <= errors)
                ok &= ~((p0 == q0) & (p1 == q1) & (p1 - p0 < 2))
                if twice:  # of a node with itself the halves meet once
                    ok &= ~same
                parts.append([v[ok] for v in (p0, p1, q0, q1, d)])
            joined = [np.concatenate(v) for v in zip(*parts)]
            if len(joined[0]):
                stack.append((*joined, depth + 1))
    return forest.edges


def links(nodes: DataFrame, words: list[str], tries: tuple[Trie, ...], errors: int) -> DataFrame:
    """(a, b): edges of a spanning forest in each group, over distinct nodes (node, and words: the fingerprint's)."""

    def top(word, by, bits):
        w = F.col(words[word])
        w = w if by == 0 else F.shiftleft(w, by).bitwiseOR(F.shiftrightunsigned(w, BITS - by))
        return F.shiftrightunsigned(w, BITS - bits)

    dealt = nodes.select("node", *words, F.posexplode(F.array(*[top(*t) for t in tries])).alias("trie", "top"))
    hot = cut(dealt.groupBy("trie", "top").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_KEYS))
    pair = F.lit(0).cast("long")
    if not hot.isEmpty():
        dealt = dealt.join(hot, ["trie", "top"], "left")
        blocks = F.ceil(F.coalesce("n", F.lit(1)) / GROUP_KEYS)
        own = F.pmod(F.xxhash64("node"), blocks)
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        pair = F.least("own", "other") * (1 << 31) + F.greatest("own", "other")
    dealt = dealt.select("trie", "top", pair.alias("pair"), "node", *words).repartition("trie", "top", "pair").sortWithinPartitions("trie", "top", "pair")

    def run(batches):
        held: list[np.ndarray] = []  # rows of trie, top, pair, node, words
        size = 0

        def solve(rows):
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            starts = np.concatenate([[0], change, [len(rows)]])
            of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            full = rows[:, 4:].view(np.uint64)
            for t in np.unique(rows[:, 0]).tolist():
                own = np.flatnonzero(rows[:, 0] == t)
                word, by, bits = tries[t]
                key = turned(full[own, word], by)
                own = own[np.lexsort((key, of[own]))]
                key = turned(full[own, word], by)
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(of[own])) + 1, [len(own)]])
                edges = trie_links(key, full[own], bounds, bits, errors)
                if edges:
                    p = rows[own, 3][np.array(edges)]
                    yield pa.RecordBatch.from_arrays([pa.array(p.min(axis=1)), pa.array(p.max(axis=1))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            held.append(rows)
            size += len(rows)
            if size >= GROUP_KEYS:
                whole = np.concatenate(held)
                first = int(np.flatnonzero((whole[:, :3] == whole[-1, :3]).all(axis=1))[0])
                if first:
                    yield from solve(whole[:first])
                held = [whole[first:]]
                size = len(whole) - first if first else 0  # a group of GROUP_KEYS is joined up once more for each as many
        if held:
            yield from solve(np.concatenate(held))

    return dealt.mapInArrow(run, "a long, b long")


# -- components


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node reachable, for every node of the edges (a, b)."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # large star: each node's larger neighbours go to its smallest neighbour
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))  # cut: so that the join can split a hub
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each node and its smaller neighbours go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, words: int = 5, errors: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the group)."""
    fps = cut(fingerprints(df, words))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    with large_batches(df.sparkSession):
        edges = cut(links(distinct.select(F.col("fp").alias("node"), "fp"), ["fp"], covering_tries(errors), errors))
    roots = components(edges)
    member = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = cut(member.groupBy("root").agg(F.min("least_id").alias("component_id")))
    labels = cut(member.join(least, "root").select("fp", "component_id"))
    return fps.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- texts of which so much is alike


def shingle_hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and the hash of every run of so many lower-case words; a text with fewer is one run."""
    w = batch_words(column, lower=True)
    n = np.diff(w.first)
    rows, hashes = [], []
    for size in range(1, words + 1):
        h = run_hashes(w.hash, size)
        if size == words:
            at = np.flatnonzero(w.row[: len(h)] == w.row[size - 1 : size - 1 + len(h)])
        else:
            at = w.first[:-1][n == size]
        rows.append(w.row[at])
        hashes.append(mix(h[at] + np.uint64(size)) if len(at) else np.zeros(0, np.uint64))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(rows, kind="stable")
    return rows[order], hashes[order]


def wide_fingerprints(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A node (a hash of the runs with their counts) and WIDE words of fingerprint of each text."""
    rows, h = shingle_hashes(column, words)
    node, out = np.zeros(len(column), dtype=np.uint64), np.zeros((len(column), WIDE), dtype=np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)]]) if len(rows) else np.zeros(1, dtype=np.int64)
    at = 0
    while at < len(starts) - 1:  # so many texts at a time that their runs stay few
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 16), side="right")) - 1)
        a, b = starts[at], starts[to]
        own, sizes = starts[at:to] - a, np.diff(starts[at : to + 1])
        texts = rows[starts[at:to]]
        node[texts] = mix(np.add.reduceat(mix(h[a:b]), own) + sizes.astype(np.uint64))
        for k in range(WIDE):
            bits = np.unpackbits(mix(h[a:b] + np.uint64(0x632BE59BD9B4E019 * (k + 1) % (1 << 64))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_ = 2 * np.add.reduceat(bits, own, axis=0, dtype=np.int32) > sizes[:, None]
            out[texts, k] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64)[:, 0]
        at = to
    return node, out


def similar(df: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc and th (see common.keyed), leader_doc and leader_th: for every document the least one of its group. Rows
    with one doc_id and one text are one document; those with one doc_id and other texts are others."""
    names = [f"w{k}" for k in range(WIDE)]
    texts = keyed(df)
    bounded_batches(df.sparkSession)

    def sketches(batches):
        for batch in batches:
            node, fp = wide_fingerprints(batch.column(2), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), *[pa.array(fp[:, k].copy().view(np.int64)) for k in range(WIDE)]], names=["doc", "th", "node", *names])

    docs = cut(texts.mapInArrow(sketches, "doc long, th long, node long, " + ", ".join(f"{c} long" for c in names)))
    nodes = cut(docs.groupBy("node", *names).agg(F.min(F.struct("doc", "th")).alias("least")))
    n = nodes.count()
    with large_batches(df.sparkSession):
        edges = cut(links(nodes.select("node", *names), names, likely_tries(n, similarity), error_budget(similarity)).distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = cut(ends.join(nodes, "node").select("node", "least.doc", "least.th"))

    def sets(batches):
        for batch in batches:
            rows, h = shingle_hashes(batch.column(1), words)
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(h[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["node", "runs"])

    own = texts.join(ends, ["doc", "th"]).select("node", "text").mapInArrow(sets, "node long, runs binary").dropDuplicates(["node"])
    own = cut(own)

    def alike(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = edges.join(own.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b")
    roots = components(cut(pairs.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")))
    member = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = cut(member.groupBy("root").agg(F.min("least").alias("leader")))
    leaders = cut(member.join(least, "root").select("node", "leader"))
    return docs.select("doc", "th", "node").join(leaders, "node").select("doc", "th", F.col("leader.doc").alias("leader_doc"), F.col("leader.th").alias("leader_th"))

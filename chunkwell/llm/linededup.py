"""Repeated passages, found by winnowing over line hashes, and their later occurrences taken out.

Passages repeat at any place of a text, so a text is wrapped into lines anew at each of its words: line i is the run
of `line_words` words from word i. Of the hashes of each window of lines that together span `run_words` words, the
least is a fingerprint (of equal ones the last): what a window selects depends on its words alone, so places that
share a run of `run_words` words select the same fingerprint at the same word of it. The text's own lines (between
newlines) of `least_line` words or more, but under `run_words`, are fingerprints too.

1. Fingerprints are counted over all documents; one that stands once goes no further.
2. Each place of a repeated one is extended both ways, as far as windows select it, and these words are hashed. Equal
   extents are joined with the first of them (least doc_id, then text, then place); all others are later ones.
3. Where a fingerprint has several extents, a match begins or ends within them. The first place of each is taken apart
   into its windows, which are joined with their own first place in the same way.

So every occurrence of every run of `run_words` words but the first is found, and a longer match, which is a row of
windows with their fingerprints, goes as far as it goes; no occurrence is compared with one chosen partner only. Runs
are equal if their 64-bit hashes are. A run that repeats within its document, overlaps included, is later there too.

A run goes from its first word to the next word kept, or to the end of the text. Words are what ASCII white space
separates, compared as they are. Null texts stay null, empty texts empty. Rows with one doc_id and one text are one
document: what is taken out of one is taken out of all. Null ids sort first. Extra columns pass through, whatever
their names; n_removed is replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, cut, fresh, released, staged
from .words import Words, batch_words, mix, run_hashes

_LINE, _RUN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)  # odd
_LOW = (1 << 32) - 1


def minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window the place of its least hash, of equal ones the last. Hashes are compared without their lowest
    bits, where the place is kept meanwhile."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, dtype=np.int64)
    mask = np.uint64((1 << max(26, n.bit_length())) - 1)  # the same for all batches but enormous ones
    low, span = (hashes & ~mask) | (mask - np.arange(n, dtype=np.uint64)), 1
    while span < window:  # by doubling; the last step overlaps
        step = min(span, window - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return (mask - (low & mask)).astype(np.int64)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window, of equal ones the last."""
    return np.unique(minima(hashes, window))


def _windows(w: Words, lines: np.ndarray, line_words: int, run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the windows that lie within one row, and the words at which they have their fingerprints."""
    at = minima(lines, run_words - line_words + 1)
    own = np.flatnonzero(w.row[: len(at)] == w.row[run_words - 1 : run_words - 1 + len(at)])
    return own, at[own]


def _own_lines(w: Words, lines: np.ndarray, line_words: int, run_words: int, least_line: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last and hash of the texts' own lines. Two runs of line_words cover such a line."""
    ends = np.append(np.flatnonzero(w.line[1:] != w.line[:-1]) + 1, len(w.line))[: len(w.line)]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    n = ends - starts
    good = (n >= least_line) & (n < run_words)
    starts, ends, n = starts[good], ends[good], n[good]
    return starts, ends, mix(lines[starts] * _LINE + lines[ends - line_words] + n.astype(np.uint64))


def _extents(w: Words, line_words: int, run_words: int, least_line: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in the batch: hash, first word and word after the last of the extent, and the extent's hash."""
    lines, whole = run_hashes(w.hash, line_words), run_hashes(w.hash, run_words)
    windows, marked = _windows(w, lines, line_words, run_words)
    new = np.flatnonzero(np.concatenate([[True], marked[1:] != marked[:-1]]))[: len(marked)]
    first, last = windows[new], windows[np.append(new[1:], len(windows))[: len(new)] - 1]
    extent = mix(whole[first] * _RUN + whole[last] + (last - first).astype(np.uint64))  # the two runs cover it
    starts, ends, own = _own_lines(w, lines, line_words, run_words, least_line)
    return np.concatenate([lines[marked[new]], own]), np.concatenate([first, starts]), np.concatenate([last + run_words, ends]), np.concatenate([extent, own])


def _ends(w: Words, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where the runs that begin at the words first and end before the words after stop: at the next word or the end."""
    row = w.row[first]
    return np.where(after == w.first[row + 1], w.length[row], np.append(w.start, 0)[after]).astype(np.int32)


def _batch(w: Words, batch: pa.RecordBatch, names: list[str], hashes: list[np.ndarray], first: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    doc, text = (batch.column(i).to_numpy()[w.row[first]] for i in (0, 1))
    columns = [*(h.view(np.int64) for h in hashes), doc, text | w.start[first], _ends(w, first, after)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*names, "doc", "at", "stop"])


def fingerprints(docs: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """docs (doc, th, text): g alone, a row a fingerprint's place."""

    def run(batches):
        for batch in batches:
            w = batch_words(batch.column(2), places=True)
            lines = run_hashes(w.hash, sizes[0])
            _, marked = _windows(w, lines, *sizes[:2])
            marked = marked[np.concatenate([[True], marked[1:] != marked[:-1]])[: len(marked)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([lines[marked], _own_lines(w, lines, *sizes)[2]]).view(np.int64))], names=["g"])

    return docs.mapInArrow(run, "g long")


def extents(docs: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """docs (doc, th, text): g, e, doc, at (th above, first code point below), stop: a row a fingerprint's place."""

    def run(batches):
        for batch in batches:
            w = batch_words(batch.column(2), places=True)
            g, first, after, e = _extents(w, *sizes)
            yield _batch(w, batch, ["g", "e"], [g, e], first, after)

    return docs.mapInArrow(run, "g long, e long, doc long, at long, stop int")


def windows(docs: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """docs (doc, th, text, starts): h, doc, at, stop: a row a window of the extents with these first code points."""

    def run(batches):
        for batch in batches:
            w = batch_words(batch.column(2), places=True)
            lines, whole = run_hashes(w.hash, sizes[0]), run_hashes(w.hash, sizes[1])
            own, marked = _windows(w, lines, *sizes[:2])
            new = np.concatenate([[True], marked[1:] != marked[:-1]])[: len(marked)]
            first = own[new]
            lists = batch.column(3)
            rows, wanted = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().astype(np.int64)
            good = np.isin((w.row[first] << 32) | w.start[first], (rows << 32) | wanted)
            kept = own[good[np.cumsum(new) - 1]] if len(own) else own
            yield _batch(w, batch, ["h"], [mix(whole[kept])], kept, kept + sizes[1])

    return docs.mapInArrow(run, "h long, doc long, at long, stop int")


def _key() -> tuple[Column, Column]:
    """A document: its id (null: the least long), and above 32 zeros a hash of its text and of whether its id is null."""
    doc = F.col("doc_id").cast("long")
    return F.coalesce(doc, F.lit(-(1 << 63)).cast("long")), F.shiftleft(F.shiftright(F.xxhash64(doc.isNull(), F.col("text").cast("string")), 32), 32)


def _text_part(at: str) -> Column:
    return F.shiftleft(F.shiftright(at, 32), 32)


def merged(spans: Column) -> Column:
    """Sorted spans (start above, stop below) as structs, those that touch or overlap as one."""
    start, stop = (lambda s: F.shiftright(s, 32).cast("int")), (lambda s: s.bitwiseAND(F.lit(_LOW)).cast("int"))
    one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    zero = F.struct(none.alias("done"), start(F.get(spans, F.lit(0))).alias("a"), stop(F.get(spans, F.lit(0))).alias("b"))

    def step(acc, s):
        on = start(s) <= acc["b"]
        done = F.when(on, acc["done"]).otherwise(F.concat(acc["done"], one(acc["a"], acc["b"])))
        return F.struct(done.alias("done"), F.when(on, acc["a"]).otherwise(start(s)).alias("a"), F.when(on, F.greatest(acc["b"], stop(s))).otherwise(stop(s)).alias("b"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["done"], one(acc["a"], acc["b"])))


def repeats(docs: DataFrame, line_words: int = 26, run_words: int = 50, least_line: int = 30) -> DataFrame:
    """doc and th (the key), cuts: the spans of code points (from 0, [start, stop)) to take out, apart and in order."""
    if not 1 <= line_words <= min(run_words, least_line) or run_words > 2 * line_words:
        raise ValueError("line_words must be from 1 to run_words and least_line, run_words at most twice line_words")
    bounded_batches(docs.sparkSession)
    sizes = (line_words, run_words, least_line)
    doc, th = _key()
    docs = docs.filter("text is not null").select(doc.alias("doc"), th.alias("th"), F.col("text").cast("string").alias("text"))
    repeated = cut(fingerprints(docs, sizes).groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"))
    found = staged(extents(docs, sizes).join(repeated, "g"))
    released(docs.sparkSession)
    place = F.struct("doc", "at")
    kinds = cut(found.groupBy("e").agg(F.min("g").alias("g"), F.min(place).alias("f"), F.max(place).alias("l")))
    first = kinds.filter("f <> l").select("e", F.col("f.doc").alias("doc0"), F.col("f.at").alias("at0"))
    later = found.join(first, "e").filter("doc <> doc0 or at <> at0").select("doc", "at", "stop")
    several = cut(kinds.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"))
    apart = kinds.join(several, "g").select("f.doc", _text_part("f.at").alias("th"), F.col("f.at").bitwiseAND(F.lit(_LOW)).cast("int").alias("start"))
    apart = cut(apart.groupBy("doc", "th").agg(F.collect_list("start").alias("starts")))  # no more than a text's words
    parts = staged(windows(docs.join(broadcast_if_small(apart, "starts"), ["doc", "th"]).select("doc", "th", "text", "starts"), sizes))
    first = cut(parts.groupBy("h").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f <> l").select("h", F.col("f.doc").alias("doc0"), F.col("f.at").alias("at0")))
    later = later.unionByName(parts.join(first, "h").filter("doc <> doc0 or at <> at0").select("doc", "at", "stop"))
    span = F.shiftleft(F.col("at").bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(F.col("stop").cast("long"))
    return later.groupBy("doc", _text_part("at").alias("th")).agg(merged(F.sort_array(F.collect_list(span))).alias("cuts"))


def dedup(docs: DataFrame, line_words: int = 26, run_words: int = 50, least_line: int = 30) -> DataFrame:
    """The rows of docs with later repeated runs taken out of text; n_removed is the number of code points gone."""
    columns = [c for c in docs.columns if c.lower() != "n_removed"]
    own_doc, own_th, doc, th, cuts = fresh(docs, "own_doc", "own_th", "doc", "th", "cuts")
    removed = broadcast_if_small(cut(repeats(docs.select("doc_id", "text"), line_words, run_words, least_line)), "cuts")
    released(docs.sparkSession)
    removed = removed.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("cuts").alias(cuts))
    key = _key()
    rows = docs.withColumn(own_doc, key[0]).withColumn(own_th, key[1])
    rows = rows.join(removed, (F.col(own_doc) == F.col(doc)) & (F.col(own_th) == F.col(th)), "left")
    # kept parts: between the end of one cut and the start of the next
    text = F.col("text").cast("string")
    starts = F.concat(F.array(F.lit(0)), F.col(f"{cuts}.stop"))
    stops = F.concat(F.col(f"{cuts}.start"), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(starts, stops, lambda a, b: F.substring(text, a + 1, b - a)), "")
    gone = F.aggregate(cuts, F.lit(0), lambda s, c: s + c.stop - c.start)
    return rows.select(*[F.when(F.col(cuts).isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns], F.coalesce(gone, F.lit(0)).alias("n_removed"))

"""Benchmark decontamination by spaced seeds. DataFrame operations only.

Tokens are runs of letters and digits in lower case. A seed is a
mask laid on consecutive tokens: the positions that it ignores may differ. Seeds of benchmark items and of
documents are hashed and joined. An item is cut into groups of five tokens; its seeds are any three tokens of a group.
If 0.6 of an item's tokens are in their places, three are in some full group, and so they are in a stretch of 12: no
leak is without a hit. A smaller `share` or `stretch` has no such guarantee.

Each hit gives a diagonal (place in the document less place in the item), and of
a row of hits on one diagonal and in one group only the first goes on. There the whole item is laid on the document and compared
token by token: it counts as a leak if `share` of the item's tokens are in their places, or if some stretch reaches
`stretch` with 1 for each token in place and -2 for each other.

Items of five to nine tokens may miss one of them: then too, three are in place in their first group. Items of three
or four tokens match only whole, and shorter ones never, as they stand in too many texts by chance. Benchmark items
with equal tokens are one item, named by the least item_id. Null and empty texts have no tokens. Rows with one doc_id
and one text are one document; texts that share a doc_id are searched each for itself. Null ids are ids like others.
Extra columns are not carried. Empty tables give no rows.

The benchmark's seeds are broadcast only within a counted bound; beyond it documents' seeds are shuffled and the
documents with hits are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, cut, fresh, text_or_empty

#: Tokens of an item that its seeds are taken from together.
GROUP = 5
#: 1: the token counts, 0: it may differ. The shapes of any three tokens of a group.
MASKS = ("111", "1101", "1011", "11001", "10101", "10011")
#: Items with fewer tokens may miss one, and those with less than a group none.
SHORT_BELOW = 10


def tokens(text: Column) -> Column:
    """Hashes of the tokens."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.xxhash64(t))


def _hash(m: int, mask: str, at: Column) -> Column:
    return F.xxhash64(F.lit(m), *[F.get("th", at + o) for o, bit in enumerate(mask) if bit == "1"])


def seeds(rows: DataFrame, masks: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """One row a mask and place: columns, th, mask, place and h."""
    n = len(masks)
    at = F.col("k").cast("int")
    place, mask = F.expr(f"cast(k div {n} as int)"), at % n
    laid = rows.select(*columns, "th", F.explode(F.when(F.size("th") > 0, F.sequence(F.lit(0), n * F.size("th") - 1))).alias("k"))
    laid = laid.select(*columns, "th", mask.alias("mask"), place.alias("place"))

    # the last mask needs no condition, so that the hash is never null and not computed once more to see that
    pick = _hash(n - 1, masks[-1], F.col("place"))
    for m in range(n - 1):
        pick = F.when(F.col("mask") == m, _hash(m, masks[m], F.col("place"))).otherwise(pick)
    spans = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1) if len({*map(len, masks)}) > 1 else F.lit(len(masks[0]))
    return laid.filter(F.col("place") + spans <= F.size("th")).select(*columns, "th", "mask", "place", pick.alias("h"))


def _first_of_row(masks: tuple[str, ...]) -> Column:
    """Whether the same mask one place earlier, in the text and in the item, is no hit of the same group."""
    counts = F.element_at(F.array(*[F.array(*[F.lit(o) for o, bit in enumerate(m) if bit == "1"]) for m in masks]), F.col("mask") + 1)
    earlier = F.forall(counts, lambda o: F.coalesce(F.get("th", F.col("place") - 1 + o) == F.get("item", F.col("item_place") - 1 + o), F.lit(False)))
    return ~((F.col("place") > 0) & (F.col("item_place") % GROUP > 0) & earlier)


def items_of(benchmark: DataFrame) -> DataFrame:
    th = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(text_or_empty()).alias("th")).filter(F.size("th") > 0)
    return th.groupBy("th").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))


def text_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, stretch: int = 12, least: int = 3) -> DataFrame:
    """leaks() by doc_id and text_hash."""
    items = cut(items_of(benchmark))
    lengths = sorted(r[0] for r in items.select(F.size("th").alias("n")).filter(F.col("n").between(least, GROUP - 1)).distinct().collect())  # under GROUP values
    masks = (*MASKS, *("1" * n for n in lengths))
    length = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask").cast("int") + 1)
    group = F.floor(F.col("place") / GROUP)
    in_group = (F.size("th") >= GROUP) & (group == F.floor((F.col("place") + length - 1) / GROUP)) & ((group + 1) * GROUP <= F.size("th"))
    own = seeds(items, masks, ("item_id",)).filter(F.when(F.col("mask") < len(MASKS), in_group).otherwise(F.size("th") == length))
    own = cut(own.select("item_id", F.col("place").alias("item_place"), "h"))
    small = 40 * own.count() <= BROADCAST_BYTES
    bound = F.broadcast if small else (lambda df: df)
    items = bound(items.select("item_id", F.col("th").alias("item")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), tokens(text_or_empty()).alias("th"))
    laid = seeds(rows, masks, ("doc_id", "text_hash"))
    diagonal = (F.col("place") - F.col("item_place")).alias("diagonal")
    if small:
        hits = laid.join(F.broadcast(own), "h").join(items, "item_id").filter(_first_of_row(masks)).select("doc_id", "text_hash", "th", "item_id", "item", diagonal)
    else:
        found = laid.select("doc_id", "text_hash", "place", "h").join(own, "h").select("doc_id", "text_hash", "item_id", diagonal).distinct()
        same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash"))
        hits = rows.dropDuplicates(["doc_id", "text_hash"]).alias("d").join(found.alias("f"), same).select("d.doc_id", "d.text_hash", "d.th", "f.item_id", "f.diagonal").join(items, "item_id")
    # the part of the document under the item; one row a diagonal goes on
    laid_on = hits.select("doc_id", "text_hash", "item_id", "diagonal", "item", F.transform("item", lambda t, i: F.get("th", F.col("diagonal") + i)).alias("part"))
    laid_on = laid_on.groupBy("doc_id", "text_hash", "item_id", "diagonal").agg(F.min("item").alias("item"), F.max("part").alias("part"))
    checked = laid_on.select("doc_id", "text_hash", "item_id", "diagonal", F.size("item").alias("n_item"), F.zip_with("item", "part", lambda a, b: F.coalesce(a == b, F.lit(False))).alias("same"))
    best = F.aggregate("same", F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), lambda s, x: F.struct(F.greatest(F.lit(0), s.run + F.when(x, 1).otherwise(-2)).alias("run"), F.greatest(s.best, s.run + F.when(x, 1).otherwise(-2)).alias("best")), lambda s: s.best)
    scored = checked.select("doc_id", "text_hash", "item_id", "diagonal", "n_item", F.size(F.filter("same", lambda x: x)).alias("n_match"), best.alias("stretch"))
    enough = F.when(F.col("n_item") < GROUP, F.col("n_match") == F.col("n_item")).when(F.col("n_item") < SHORT_BELOW, F.col("n_match") >= F.col("n_item") - 1)
    kept = scored.filter(enough.otherwise((F.col("n_match") >= share * F.col("n_item")) | (F.col("stretch") >= stretch)))
    return kept.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("n_match", (-F.col("diagonal")).alias("before"), "n_item")).alias("m"))


def leaks(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """doc_id, item_id, place (of the item's first token in the document), n_match, n_item: the best diagonal of each
    leak, of equal ones the first; of the texts with one doc_id the best."""
    top = text_leaks(docs, benchmark, **limits).groupBy("doc_id", "item_id").agg(F.max("m").alias("m"))
    return top.select("doc_id", "item_id", (-F.col("m.before")).cast("long").alias("place"), F.col("m.n_match").cast("long").alias("n_match"), F.col("m.n_item").cast("long").alias("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of docs without a leak."""
    doc, th = fresh(docs, "leak_doc", "leak_hash")
    found = cut(text_leaks(docs, benchmark, **limits).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(th)).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th))
    return docs.join(broadcast_if_small(found), same, "left_anti")

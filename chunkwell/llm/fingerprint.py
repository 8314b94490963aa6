"""Document fingerprints as invertible Bloom lookup sketches. DataFrame operations only.

A text is cut into paragraphs: the parts of a line that end with a sentence after UNIT characters or more, or with
the line. A paragraph's digest is 48 bits of its hash and 16 of its length. Each distinct digest goes into three
cells, one in each third of the sketch; a cell holds how many digests it has, their exclusive or, and that of
their checks. Two sketches subtract cell by cell, and what is left is peeled: a cell with a single digest gives it
away, which is then taken out of its other cells, and so on. If cells remain, sketches four times as large are
made of both and tried in turn, from the first that holds as many digests with ease as the smallest ones' counts say
differ; if the largest does not peel either, the digests themselves are compared. The digests recovered are those of
the paragraphs that differ; likeness is the share of the two texts' paragraphs, by length, that
doesn't. A paragraph counts once however often and wherever it stands in a text: a text with its paragraphs in another
order, or one of them twice, is as like as the same text.

Everything is a function of a row: places in cells sorted, runs of equal cells summed. The only shuffle of texts brings
neighbours in the order of doc_id together, by ranges of ids with about as many rows each.

A null text is empty; an empty text has no paragraphs and an empty sketch; two empty sketches have likeness 1.
Null ids come last. Rows with one id order by a hash of their texts; equal rows are each other's neighbours. Extra
columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

UNIT = 80
WIDTH = 8  # cells in a third of the smallest sketch
GROWTH = 4
LOAD = 0.1  # digests a cell in the first sketches tried: most stand alone in one; empty cells cost nothing
LEVELS = 10  # the largest has as many cells in a third as there are hashes for it, 2^21
ROUNDS = 64  # of peeling; sketches that peel do so in far fewer

CELLS = "array<struct<i:int,c:int,k:bigint,x:int>>"
DIGESTS = "array<bigint>"


def let(value: Column, body) -> Column:
    """body of value, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\n]{{{UNIT},}}?[.!?…]+(?=\s|\z)|[^\n]+"), F.lit(0))


def digests(text: Column) -> Column:
    """The distinct paragraphs' digests."""

    def digest(p):
        return F.shiftleft(F.shiftrightunsigned(F.xxhash64(p), 16), 16).bitwiseOR(F.least(F.length(p), F.lit(0xFFFF)).cast("long"))

    return F.array_distinct(F.transform(paragraphs(text), digest))


def length_of(digest: Column) -> Column:
    return digest.bitwiseAND(F.lit(0xFFFF))


def check(digest: Column) -> Column:
    return F.hash(digest)


def places(digest: Column, number: Column, width: Column) -> Column:
    """The three cells of a digest, each above the number of the entry that goes into it."""

    def third(h, j):
        own = F.shiftrightunsigned(h, 21 * j).bitwiseAND(F.lit((1 << 21) - 1)) % width
        return F.shiftleft(own + F.lit(j) * width if j else own, 32).bitwiseOR(number)

    return let(F.xxhash64(digest), lambda h: F.array(*[third(h, j) for j in range(3)]))


def numbered(keys: Column, width: Column) -> Column:
    return F.flatten(F.transform(keys, lambda k, p: places(k, p.cast("long"), width)))


def cell_at(place: Column) -> Column:
    return F.shiftright(place, 32).cast("int")


def number_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def cell(i: Column, c: Column, k: Column, x: Column) -> Column:
    return F.struct(i.alias("i"), c.alias("c"), k.alias("k"), x.alias("x"))


def xor(some: Column, of=lambda e: e, kind: str = "long") -> Column:
    return F.aggregate(some, F.lit(0).cast(kind), lambda s, e: s.bitwiseXOR(of(e)))


def summed(at: Column, count, digest, checked, single=None) -> Column:
    """The cells that entries make, given by place, with what each has of count, digest and check (no count: one each);
    empty cells are gone. Only the places are sorted: to compare structs costs several times as much."""
    single = single or (lambda place: cell(cell_at(place), count(place) if count else F.lit(1), digest(place), checked(place)))

    def several(own):
        entries = F.aggregate(own, F.lit(0), lambda s, place: s + count(place)) if count else F.size(own)
        return cell(cell_at(F.get(own, F.lit(0))), entries, xor(own, digest), xor(own, checked, "int"))

    def run(s, p, stop):
        return F.when(stop - p == 1, single(F.get(s, p - 1))).otherwise(let(F.slice(s, p, stop - p), several))

    def runs(s):
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda p: (p == 1) | (F.shiftright(F.get(s, p - 1).bitwiseXOR(F.get(s, p - 2)), 32) != 0))
        return let(starts, lambda b: F.transform(b, lambda p, q: run(s, p, F.coalesce(F.get(b, q + 1), F.size(s) + 1))))

    some = F.filter(let(F.sort_array(at), runs), lambda e: (e["c"] != 0) | (e["k"] != 0) | (e["x"] != 0))
    return F.when(F.size(at) == 0, F.array().cast(CELLS)).otherwise(some)


def of_digests(keys: Column, sign, width: Column) -> Column:
    """The cells of digests, each counted as the sign of its number says."""
    digest = lambda place: F.get(keys, number_of(place))
    count = (lambda place: sign(number_of(place))) if sign else None
    return let(numbered(keys, width), lambda at: summed(at, count, digest, lambda place: check(digest(place))))


def sketch(keys: Column, width: Column) -> Column:
    return of_digests(keys, None, width)


def together(cells: Column) -> Column:
    """Cells, some of them of equal place, summed."""
    at = F.transform(cells, lambda e, p: F.shiftleft(e["i"].cast("long"), 32).bitwiseOR(p.cast("long")))
    of = lambda place: F.get(cells, number_of(place))
    return let(at, lambda some: summed(some, lambda place: of(place)["c"], lambda place: of(place)["k"], lambda place: of(place)["x"], of))


def subtracted(a: Column, b: Column) -> Column:
    minus = F.transform(b, lambda e: cell(e["i"], -e["c"], e["k"], e["x"]))
    return let(F.concat(a, minus), together)


def sketched_apart(a: Column, b: Column, width: Column) -> Column:
    """The sketch of a less that of b, made at once: b's digests count as -1."""
    return let(F.concat(a, b), lambda keys: of_digests(keys, lambda p: F.when(p < F.size(a), F.lit(1)).otherwise(F.lit(-1)), width))


def peeled(cells: Column, width: Column) -> Column:
    """struct(cells left, digests recovered). A digest is in three cells, so the exclusive or of all cells is that of all
    digests in them: where digests found agree with it in sum, no cell is left, and none has to be summed anew."""

    def pure(cells, count):
        return F.array_distinct(F.transform(F.filter(cells, lambda e: (e["c"] == count) & (e["x"] == check(e["k"]))), lambda e: e["k"]))

    def whole(cells, f):
        count = F.aggregate(cells, F.lit(0), lambda s, e: s + e["c"])
        same = lambda of, found, kind: xor(cells, of, kind) == xor(f["p"], found, kind).bitwiseXOR(xor(f["m"], found, kind))
        return (count == 3 * (F.size(f["p"]) - F.size(f["m"]))) & same(lambda e: e["k"], lambda k: k, "long") & same(lambda e: e["x"], check, "int")

    def out(keys, count):
        return F.flatten(F.transform(keys, lambda k: F.transform(places(k, F.lit(0).cast("long"), width), lambda at: cell(cell_at(at), F.lit(count), k, check(k)))))

    def step(acc, _):
        def taken(f):
            none, some = F.size(f["p"]) + F.size(f["m"]) == 0, F.concat(f["p"], f["m"])
            left = lambda end: F.when(none, acc["cells"]).when(end, F.array().cast(CELLS)).otherwise(let(F.concat(acc["cells"], out(f["p"], -1), out(f["m"], 1)), together))
            return let(~none & whole(acc["cells"], f), lambda end: F.struct(left(end).cast(CELLS).alias("cells"), F.concat(acc["digests"], some).cast(DIGESTS).alias("digests"), (~(none | end)).alias("on")))

        return F.when(acc["on"], let(F.struct(pure(acc["cells"], 1).alias("p"), pure(acc["cells"], -1).alias("m")), taken)).otherwise(acc)

    start = F.struct(cells.cast(CELLS).alias("cells"), F.array().cast(DIGESTS).alias("digests"), (F.size(cells) > 0).alias("on"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def first_level(a: Column, b: Column, cells: Column) -> Column:
    """The level of the smallest sketches that hold the difference of a and b with ease, judged by the cells of the
    smallest ones' difference: a third's squared counts sum up to as many digests as differ, and to what the surplus
    of one side adds."""
    squares = F.aggregate(cells, F.lit(0).cast("long"), lambda s, e: s + e["c"].cast("long") * e["c"]) / 3
    surplus, most = (F.size(a) - F.size(b)).cast("double"), (F.size(a) + F.size(b)).cast("double")
    guess = F.greatest((squares - surplus * surplus / WIDTH) / (1 - 1 / WIDTH), F.abs(surplus), F.lit(1.0))
    level = F.ceil(F.log(F.least(guess, F.greatest(most, F.lit(1.0))) / (3 * WIDTH * LOAD)) / math.log(GROWTH))
    return F.least(F.greatest(level, F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """The digests in which the key sets a and b differ: from the smallest sketches, given as cells, or from the
    first of the larger ones that peels whole, or compared if none does. Sizes that are likely too small are passed over."""

    def attempt(level, smallest):
        def of(width):
            left = F.when(level == 0, smallest).otherwise(sketched_apart(a, b, width))
            return let(let(left, lambda c: peeled(c, width)), lambda p: F.struct((F.size(p["cells"]) == 0).alias("done"), p["digests"].alias("digests")))

        return let((F.lit(WIDTH) * F.pow(F.lit(GROWTH), level)).cast("long"), of)

    def tried(smallest):
        start = F.struct(F.lit(False).alias("done"), F.array().cast(DIGESTS).alias("digests"))
        levels = F.sequence(first_level(a, b, smallest), F.lit(LEVELS - 1))
        return F.aggregate(levels, start, lambda acc, level: F.when(acc["done"], acc).otherwise(attempt(level, smallest)))

    compared = F.concat(F.array_except(a, b), F.array_except(b, a))
    return let(let(subtracted(cells_a, cells_b), tried), lambda t: F.when(t["done"], t["digests"]).otherwise(compared))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    total = lambda keys: F.aggregate(keys, F.lit(0).cast("long"), lambda s, k: s + length_of(k))
    apart = let(difference(a, b, cells_a, cells_b), lambda d: F.aggregate(d, F.lit(0).cast("long"), lambda s, k: s + length_of(k)))
    return let(total(a) + total(b), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - apart / n)).cast("double")


def written(cells: Column) -> Column:
    """A sketch as a string: its cells in order, each place, count, digests and checks in hex."""
    h = lambda c, n: F.right(F.lpad(F.hex(c), 16, "0"), F.lit(n))
    return F.lower(F.array_join(F.transform(cells, lambda e: F.concat(h(e["i"], 2), h(e["c"], 4), h(e["k"], 16), h(e["x"], 8))), ""))


def bucket_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are no greater, by way of every so many of them; -1 for null."""
    step = max(1, math.isqrt(len(bounds)))
    numbers = lambda some: F.split(F.lit(",".join(map(str, some))), ",").cast("array<bigint>")  # noqa: E731  one literal
    upto = lambda some: F.size(F.filter(some, lambda b: b <= doc_id))
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    inner = lambda k: F.when(k == 0, 0).otherwise((k - 1) * step + upto(F.slice(numbers(bounds), (k - 1) * step + 1, F.lit(step))))
    return F.when(doc_id.isNull(), -1).otherwise(let(upto(numbers(bounds[::step])), inner))


def with_next(docs: DataFrame, bucket_rows: int = 1024, max_buckets: int = 1 << 16) -> DataFrame:
    """doc_id, text and next_text, that of the next document by falling doc_id (after the last: of the first)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    buckets = min(max_buckets, max(1, rows.count() // bucket_rows))
    shares = [k / buckets for k in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * buckets))).first()[0] if shares else []
    rows = rows.select(bucket_of(F.col("doc_id"), sorted(set(bounds or []))).alias("bucket"), "doc_id", F.xxhash64("text").alias("th"), "text")
    # each range's first document, and the range that it follows: no more rows than buckets
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("d"), "th")
    heads = cut(rows.groupBy("bucket").agg(F.max(order).alias("head")))
    following = heads.select("bucket", F.coalesce(F.lead("head").over(Window.orderBy(F.desc("bucket"))), F.first("head").over(Window.orderBy(F.desc("bucket")))).alias("head"))
    keyed = rows.select(order.alias("head"), F.col("text").alias("edge_text"))
    edges = cut(keyed.join(F.broadcast(following), "head").groupBy("bucket").agg(F.min("edge_text").alias("edge_text"))).withColumnRenamed("bucket", "edge")
    after = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("th"))
    led = rows.withColumn("led", F.lead(F.struct("text")).over(after)).join(edges, (F.col("bucket") == F.col("edge")) & F.col("led").isNull(), "left")
    return led.select("doc_id", "text", F.when(F.col("led").isNull(), F.col("edge_text")).otherwise(F.col("led.text")).alias("next_text"))


def edited(docs: DataFrame) -> DataFrame:
    """with_next and edited_text: the last third of the code points replaced by the next text's first as many."""
    third = F.floor(F.length("text") / 3).cast("int")
    own = F.substring(F.col("text"), F.lit(1), F.length("text") - third)
    return with_next(docs).withColumn("edited_text", F.concat(own, F.substring(F.col("next_text"), F.lit(1), third)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = edited(docs)
    keys = texts.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited_text")).alias("b"), digests(F.col("next_text")).alias("c"))
    whole = let(F.struct("a", "b", "c"), lambda t: let(
        F.struct(*[sketch(t[x], F.lit(WIDTH).cast("long")).alias(x) for x in "abc"]),
        lambda s: F.struct(
            written(s["a"]).alias("fingerprint"), written(s["b"]).alias("edited_fingerprint"),
            likeness(t["a"], t["b"], s["a"], s["b"]).alias("near_edited"), likeness(t["a"], t["c"], s["a"], s["c"]).alias("near_next"),
        ),
    ))
    return keys.select("doc_id", "n_chars", "edited_sha256", whole.alias("r")).select("doc_id", "n_chars", "edited_sha256", "r.fingerprint", "r.edited_fingerprint", "r.near_edited", "r.near_next")

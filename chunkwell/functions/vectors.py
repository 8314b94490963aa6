"""TF-IDF weights within a document, and cosine similarity of sparse and dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, runs, total, upto


def term_counts(tokens: Column) -> Column:
    """array<struct<t,i,c>>, sorted: how often sentence i has term t, from an array of token lists."""
    pairs = F.flatten(F.transform(tokens, lambda ts, i: F.transform(ts, lambda t: F.struct(t.alias("t"), i.alias("i")))))
    some = runs(F.sort_array(pairs), lambda e: e, lambda own: let(F.get(own, F.lit(0)), lambda e: F.struct(e["t"].alias("t"), e["i"].alias("i"), F.size(own).alias("c"))))
    return F.coalesce(some, F.array().cast("array<struct<t:string,i:int,c:int>>"))


def document_frequencies(tokens: Column) -> Column:
    """array<struct<t,df>>: in how many of the sentences each term is."""
    some = runs(term_counts(tokens), lambda e: e["t"], lambda own: F.struct(F.get(own, F.lit(0))["t"].alias("t"), F.size(own).alias("df")))
    return F.coalesce(some, F.array().cast("array<struct<t:string,df:int>>"))


def weight(count: Column, length: Column, n: Column, df: Column) -> Column:
    """Term frequency times smoothed inverse document frequency."""
    return count / length * F.log(1 + n / (1 + df))


def tfidf(tokens: Column) -> Column:
    """array<struct<t,i,w>> by term and sentence: the weight of each term of each sentence, its document the corpus."""

    def weighted(sizes: Column) -> Column:
        def own(run: Column) -> Column:
            df = F.size(run)
            return F.transform(run, lambda e: F.struct(e["t"].alias("t"), e["i"].alias("i"), weight(e["c"], F.get(sizes, e["i"]), F.size(sizes), df).alias("w")))

        return F.flatten(runs(term_counts(tokens), lambda e: e["t"], own))

    return F.coalesce(let(F.transform(tokens, F.size), weighted), F.array().cast("array<struct<t:string,i:int,w:double>>"))


def cohesion(tokens: Column) -> Column:
    """Cosine similarity of each two neighbouring sentences' TF-IDF vectors; 0 where one is empty.

    In one sorted list, a term's weights in neighbouring sentences stand next to each other: each gives a share of
    its sentence's squared norm and of the product with the next sentence, and those are summed by sentence.
    """

    def scores(w: Column, n: Column) -> Column:
        # element k and, if it is the same term one sentence on, element k + 1
        shares = F.transform(w, lambda e, k: let(F.get(w, k + 1), lambda f: F.struct(e["i"].alias("i"), (e["w"] * e["w"]).alias("sq"), F.coalesce(F.when((f["t"] == e["t"]) & (f["i"] == e["i"] + 1), e["w"] * f["w"]), F.lit(0.0)).alias("dot"))))
        every = F.concat(shares, F.transform(upto(n), lambda i: F.struct(i.alias("i"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("dot"))))
        sums = runs(F.sort_array(every), lambda e: e["i"], lambda own: F.struct(F.sqrt(total(F.transform(own, lambda e: e["sq"]))).alias("norm"), total(F.transform(own, lambda e: e["dot"])).alias("dot")))

        def cosines(s: Column) -> Column:
            return F.transform(upto(n - 1), lambda i: let(F.get(s, i)["norm"] * F.get(s, i + 1)["norm"], lambda d: F.when(d == 0, F.lit(0.0)).otherwise(F.get(s, i)["dot"] / F.nullif(d, F.lit(0.0)))))

        return let(sums, cosines)

    return let(tokens, lambda t: let(tfidf(t), lambda w: F.when(F.size(t) < 2, F.array().cast("array<double>")).otherwise(scores(w, F.size(t)))))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Of two maps term -> weight; 0 if one has norm 0."""
    square = lambda m: total(F.transform(F.map_values(m), lambda x: x * x))

    def product(entries: Column) -> Column:
        both = runs(F.sort_array(entries), lambda e: e["t"], lambda own: F.when(F.size(own) == 2, F.get(own, F.lit(0))["w"] * F.get(own, F.lit(1))["w"]).otherwise(F.lit(0.0)))
        return total(F.coalesce(both, F.array().cast("array<double>")))

    listed = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("t"), e["value"].alias("w")))
    return let(F.sqrt(square(a)) * F.sqrt(square(b)), lambda d: F.when(d == 0, F.lit(0.0)).otherwise(product(F.concat(listed(a), listed(b))) / F.nullif(d, F.lit(0.0))))


def dense_cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths, a norm of 0, or null."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    value = F.when(fits, let(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), lambda d: F.when(d != 0, dot(a, b) / F.nullif(d, F.lit(0.0)))))
    return F.coalesce(value, F.lit(0.0))


def cohesion_dense(vectors: Column) -> Column:
    """Cosine similarity of each two neighbouring dense vectors."""
    return let(vectors, lambda v: F.transform(upto(F.size(v) - 1), lambda i: dense_cosine(F.get(v, i), F.get(v, i + 1))))


def top_terms(vector: Column, k: int = 16) -> Column:
    """The k terms of most weight; of equal weights the terms first in order."""
    ranked = F.sort_array(F.transform(F.map_entries(vector), lambda e: F.struct((-F.round(e["value"], 12)).alias("s"), e["key"].alias("t"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: e["t"])


def sentence_vectors(tokens: Column) -> Column:
    """array<map<term,weight>>: each sentence's TF-IDF vector."""

    def vectors(w: Column, n: Column) -> Column:
        marked = F.transform(upto(n), lambda i: F.struct(i.alias("i"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("double").alias("w")))
        every = F.concat(marked, F.transform(w, lambda e: F.struct(e["i"].alias("i"), e["t"].alias("t"), e["w"].alias("w"))))
        return runs(F.sort_array(every), lambda e: e["i"], lambda own: F.map_from_entries(F.transform(F.filter(own, lambda e: e["t"].isNotNull()), lambda e: F.struct(e["t"], e["w"]))))

    return let(tokens, lambda t: let(tfidf(t), lambda w: F.coalesce(vectors(w, F.size(t)), F.array().cast("array<map<string,double>>"))))

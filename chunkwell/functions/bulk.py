"""TF-IDF of whole Arrow batches in numpy: the rules of vectors.py and language.py once more, for large tables.

Within a row these rules cost microseconds a term, as functions of array elements are interpreted. Here terms are numbers
and all documents of a slice are sorted at once. Each function is a Column of Columns and may stand on streams, but not
within a function of array elements.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..plans.options import SegmentOptions

#: Tokens or characters that are worked on at a time; a longer document is a slice of its own.
SLICE = 1 << 18
#: Terms of a language that a worker keeps; the oldest go first.
KEPT_WORDS = 1 << 19
DIGITS = 12


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int32)


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of so many elements together, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at = to


class Terms:
    """The terms of a slice of documents: a number for each occurrence, in the order of the texts of terms if ordered."""

    def __init__(self, sizes: np.ndarray, codes: np.ndarray, sentence: np.ndarray, texts: Callable[[np.ndarray], pa.Array]):
        self.sizes, self.texts = sizes, texts
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        n = len(self.doc)
        self.length = np.bincount(sentence, minlength=n)
        bits = max(1, n.bit_length())
        if len(codes) and int(codes.max()).bit_length() + bits > 63:
            known, codes = np.unique(codes, return_inverse=True)
            self.texts = lambda c: texts(known[c])
        key = np.sort((codes.astype(np.int64) << bits) | sentence)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        self.count = np.diff(np.append(first, len(key)))
        key = key[first]
        #: by term and then by sentence: each once
        self.term, self.sentence = key >> bits, key & ((1 << bits) - 1)
        d = self.doc[self.sentence] if n else self.sentence
        self.run = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (self.term[1:] != self.term[:-1]) | (d[1:] != d[:-1]))))
        self.frequency = np.diff(np.append(self.run, len(key)))
        df = np.repeat(self.frequency, self.frequency)
        self.weight = self.count / self.length[self.sentence] * np.log(1 + sizes[d] / (1 + df)) if n else np.zeros(0)

    def cohesion(self) -> pa.Array:
        """list<double>: cosine similarity of each two neighbouring sentences; 0 where one is empty."""
        n, s, w = len(self.doc), self.sentence, self.weight
        norm = np.sqrt(np.bincount(s, w * w, n))
        near = np.flatnonzero((self.term[1:] == self.term[:-1]) & (s[1:] == s[:-1] + 1))
        dot = np.bincount(s[near], w[near] * w[near + 1], n)
        pairs = np.flatnonzero(self.doc[1:] == self.doc[:-1])  # a product over two documents is in none of them
        below = norm[pairs] * norm[pairs + 1]
        scores = np.divide(dot[pairs], below, out=np.zeros(len(pairs)), where=below > 0)
        return pa.ListArray.from_arrays(offsets(np.maximum(self.sizes - 1, 0)), pa.array(scores))

    def _by_doc(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.doc[self.sentence[rows]] if len(rows) else np.zeros(0, np.int64)
        return rows[np.argsort(d, kind="stable")], offsets(np.bincount(d, minlength=len(self.sizes)))

    def tfidf(self) -> pa.Array:
        """list<struct<t,i,w>> by document."""
        rows, at = self._by_doc(np.arange(len(self.term)))
        first = np.cumsum(self.sizes) - self.sizes
        s = self.sentence[rows]
        i = pa.array((s - first[self.doc[s]] if len(s) else s).astype(np.int32))
        return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([self.texts(self.term[rows]), i, pa.array(self.weight[rows])], ["t", "i", "w"]))

    def frequencies(self) -> pa.Array:
        """list<struct<t,df>> by document."""
        n, at = self._by_doc(self.run)
        order = np.searchsorted(self.run, n)
        return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([self.texts(self.term[n]), pa.array(self.frequency[order].astype(np.int32))], ["t", "df"]))

    def _by_sentence(self, lists: np.ndarray, values: pa.Array) -> pa.Array:
        """A list by document of lists by sentence."""
        return pa.ListArray.from_arrays(offsets(self.sizes), pa.ListArray.from_arrays(offsets(lists), values))

    def top(self, k: int) -> pa.Array:
        """list<list<string>>: each sentence's k terms of most weight, of equal weights the terms first in order."""
        n = len(self.doc)
        down = np.int64(1 << 45) - 1 - np.rint(self.weight * 10.0**DIGITS).astype(np.int64)  # a weight is under 30
        order = np.argsort((self.sentence << 45) | down, kind="stable") if n < 1 << 18 else np.lexsort((down, self.sentence))
        each = np.bincount(self.sentence, minlength=n)
        place = np.arange(len(order)) - np.repeat(np.cumsum(each) - each, each)
        return self._by_sentence(np.minimum(each, k), self.texts(self.term[order[place < k]]))

    def vectors(self) -> pa.Array:
        """list<map<string,double>>: each sentence's weights."""
        n = len(self.doc)
        order = np.argsort(self.sentence, kind="stable")
        maps = pa.MapArray.from_arrays(offsets(np.bincount(self.sentence, minlength=n)), self.texts(self.term[order]), pa.array(self.weight[order]))
        return pa.ListArray.from_arrays(offsets(self.sizes), maps)


def ngrams(sentences: pa.Array, least: int, most: int) -> Terms:
    """The n-grams of sentences of letters and digits; numbers are in the order of the texts."""
    flat = sentences.flatten()
    chars = np.frombuffer("".join(flat.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    each = pc.fill_null(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return ngrams_of(chars, each, lengths(sentences), least, most)


def ngrams_of(chars: np.ndarray, each: np.ndarray, sizes: np.ndarray, least: int, most: int) -> Terms:
    """The same from all characters, how many each sentence has, and how many sentences each document has."""
    chars = chars.astype(np.int64)
    there = np.zeros(int(chars.max()) + 1 if len(chars) else 1, bool)
    there[chars] = True
    alphabet = np.concatenate(([0], np.flatnonzero(there))).astype(np.uint32)  # 0: past the end
    rank = np.cumsum(there)[chars]
    owner = np.repeat(np.arange(len(each)), each)
    left = np.repeat(np.cumsum(each), each) - np.arange(len(chars))
    places = [np.flatnonzero(left >= n) for n in range(least, most + 1)]
    at, size = np.concatenate(places), np.repeat(np.arange(least, most + 1), [len(p) for p in places])
    bits = len(alphabet).bit_length()
    padded = np.concatenate((rank, np.zeros(most, np.int64)))
    symbols = lambda k: np.where(k < size, padded[at + k], 0)
    codes = np.zeros(len(at), np.int64)
    for k in range(most):
        if len(codes) and int(codes.max()).bit_length() + bits > 63:
            codes = np.unique(codes, return_inverse=True)[1]
        codes = (codes << bits) | symbols(k)
    if most * bits <= 63:
        spelled = lambda c: (c[:, None] >> (bits * np.arange(most - 1, -1, -1))) & ((1 << bits) - 1)
    else:
        _, example, codes = np.unique(codes, return_index=True, return_inverse=True)
        spelled = lambda c: np.stack([np.where(k < size[example[c]], padded[at[example[c]] + k], 0) for k in range(most)], 1)

    def texts(c: np.ndarray) -> pa.Array:
        return pa.array(np.ascontiguousarray(alphabet[spelled(c)]).view(f"<U{most}").ravel().tolist() if len(c) else [], pa.string())

    return Terms(sizes, codes, owner[at], texts)


def coded(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = strings.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


class Words:
    """Terms of tokens in a language: less its stopwords, trimmed once more, stemmed."""

    def __init__(self, o: SegmentOptions):
        self.stop, self.stem = o.enable_stop_word_removal, o.enable_stemming
        self.seen: dict[str, dict[str, int]] = {}  # by language, the number of each token's term; -1 for none
        self.numbers: dict[str, int] = {}
        longest = lambda affixes: tuple(sorted(set(affixes), key=lambda a: (-len(a.encode()), a)))
        self.languages = {x.name: (frozenset(x.stopwords), longest(x.prefixes), tuple(sorted(set(x.suffixes), key=len, reverse=True)), x.min_len) for x in o.languages.values()}

    def _term(self, token: str, lang: str) -> str | None:
        if lang not in self.languages:
            return token
        stopwords, prefixes, suffixes, least = self.languages[lang]
        if self.stop:
            if token in stopwords or not (token := token.strip("'").strip("-")):
                return None
        if not self.stem or not (prefixes or suffixes) or len(token.encode()) < least:
            return token
        out = token
        if out.startswith(prefixes):
            out = next(out[len(p) :] for p in prefixes if out.startswith(p))
        if len(out.encode()) >= least and out.endswith(suffixes):
            out = next(out[: -len(s)] for s in suffixes if out.endswith(s))
        return out

    def _numbers(self, tokens: list[str], lang: str) -> list[int]:
        seen = self.seen.setdefault(lang, {})
        found = list(map(seen.get, tokens))
        if None in found:
            for i, token in enumerate(tokens):
                if found[i] is None:
                    term = self._term(token, lang)
                    found[i] = seen[token] = -1 if term is None else self.numbers.setdefault(term, len(self.numbers))
        return found

    def terms(self, sizes: np.ndarray, codes: np.ndarray, sentence: np.ndarray, words: np.ndarray, lang: np.ndarray, names: list[str]) -> Terms:
        """codes: of tokens in words; lang: of sentences in names."""
        if sum(map(len, self.seen.values())) >= KEPT_WORDS:
            self.seen, self.numbers = {}, {}
        pair = codes * len(names) + lang[sentence] if len(codes) else codes
        table = np.full(len(words) * len(names), -1, np.int64)
        used = np.zeros(len(table), bool)
        used[pair] = True
        for k, name in enumerate(names):
            own = np.flatnonzero(used[k :: len(names)])
            table[own * len(names) + k] = self._numbers(words[own].tolist(), name)
        codes, numbers = table[pair], self.numbers
        return Terms(sizes, codes[codes >= 0], sentence[codes >= 0], lambda c: pa.array(list(numbers), pa.string()).take(pa.array(c)))


def plain(tokens: pa.Array) -> Terms:
    """Terms of tokens as they are."""
    inner = tokens.flatten()
    codes, vocabulary = coded(inner.flatten())
    return Terms(lengths(tokens), codes, np.repeat(np.arange(len(inner)), lengths(inner)), lambda c: vocabulary.take(pa.array(c)))


def _elements(lists: pa.Array) -> np.ndarray:
    """Tokens or characters of each row."""
    inner, at = lists.flatten(), offsets(lengths(lists))
    each = lengths(inner) if pa.types.is_list(inner.type) else pc.fill_null(pc.utf8_length(inner), 0).to_numpy(zero_copy_only=False)
    return np.diff(np.concatenate(([0], np.cumsum(each)))[at])


def _column(kind: str, of: Callable[..., pa.Array], *columns: Column) -> Column:
    def run(*arrays):
        parts = [of(*(a.slice(i, j - i) for a in arrays)) for i, j in slices(_elements(arrays[0]))]
        return pa.concat_arrays(parts) if parts else of(*arrays)

    return batched(kind, run, *columns)


def batched(kind: str, run: Callable[..., pa.Array], *columns: Column) -> Column:
    """A Column of this type from columns, by Arrow batches."""
    with warnings.catch_warnings():  # Spark would like a hint of each argument's type
        warnings.simplefilter("ignore", UserWarning)
        return F.arrow_udf(run, kind, ArrowUDFType.SCALAR)(*columns)


def tfidf(tokens: Column) -> Column:
    return _column("array<struct<t:string,i:int,w:double>>", lambda t: plain(t).tfidf(), tokens)


def document_frequencies(tokens: Column) -> Column:
    return _column("array<struct<t:string,df:int>>", lambda t: plain(t).frequencies(), tokens)


def top_ngrams(sentences: Column, least: int, most: int, k: int) -> Column:
    """array<array<string>>: each sentence's k n-grams of most weight."""
    return _column("array<array<string>>", lambda s: ngrams(s, least, most).top(k), sentences)


def ngram_vectors(sentences: Column, least: int, most: int) -> Column:
    """array<map<string,double>>: each sentence's weights."""
    return _column("array<map<string,double>>", lambda s: ngrams(s, least, most).vectors(), sentences)

"""Segmentation of whole Arrow batches from their texts on: the rules of text.py and language.py once more, in Python and
numpy, for large tables.

Regular expressions run over whole texts; tokens are cut from all characters of a slice of documents at once. Rows never
depend on each other.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Callable
from dataclasses import replace
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

from ..plans.options import FIRST_TEN, FULL_TEXT, PER_SENTENCE, SegmentOptions
from ..sources.languages import Language
from .bulk import DIGITS, Terms, Words, batched, coded, lengths, ngrams_of, offsets, slices
from .language import LEAST_HITS, UNKNOWN
from .text import ELLIPSIS, SPACES

DROPPED, SPACE, HYPHEN, APOSTROPHE, LETTER = range(5)
#: No letters, digits or scripts are beyond.
LETTERS_END = 0x34000
#: Characters that are worked on at a time; a longer text is a slice of its own. In more of them words are looked up less often.
SLICE = 1 << 20
SCRIPTS = ("Latin", "Cyrillic", "Arabic")

DOTS = re.compile(r"\.{3,}")
# most texts have no acronym: a search for two letters with dots is quicker than the rules at every place
LATIN, LATIN_ACRONYM = re.compile(r"[A-Z]\.[A-Z]\."), re.compile(r"\b(?:[A-Z]\.){2,}[A-Z]?\b", re.ASCII)
CYRILLIC, CYRILLIC_ACRONYM = re.compile(r"[А-ЯЁ]\.[А-ЯЁ]\."), re.compile(r"\b(?:[А-ЯЁ]\.){2,}[А-ЯЁ]?\b", re.ASCII)
SENTENCE_END = re.compile("([.!?…][”\"»']*)(?:[\\t\\n\\f\\r ]+|\\Z)")


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character: its kind, its lower case, its script."""
    kind, lower, script = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    every = list(map(chr, range(LETTERS_END)))
    kind[:LETTERS_END] = [LETTER if unicodedata.category(c)[0] in "LN" else DROPPED for c in every]
    lower[:LETTERS_END] = [ord(c.lower()[0]) for c in every]  # no final sigma, no dot above i
    for c in "\t\n\f\r ":
        kind[ord(c)] = SPACE
    kind[ord("-")], kind[ord("'")] = HYPHEN, APOSTROPHE
    some = pa.array([c if c < "\ud800" or c > "\udfff" else "" for c in every])
    for n, name in enumerate(SCRIPTS[1:], 1):
        script[:LETTERS_END][pc.match_substring_regex(some, rf"\p{{{name}}}").to_numpy(zero_copy_only=False)] = n
    return kind, lower, script


def characters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters, with a line feed after each string, and where each string ends."""
    chars = np.frombuffer(("\n".join(strings) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)) + 1)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def utf8(chars: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of these sizes from their characters."""
    at = offsets(sizes)
    if not len(chars) or int(chars.max()) < 128:
        data = chars.astype(np.uint8).tobytes()
    else:
        data = chars.tobytes().decode("utf-32-le").encode()
        at = offsets(1 + (chars > 0x7F).astype(np.int8) + (chars > 0x7FF) + (chars > 0xFFFF))[at]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(data))


def _trimmed(kind: np.ndarray, off: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges less what is of a kind at both ends; after the last range there is a space."""
    others = np.flatnonzero(kind != off)
    start = np.minimum(others[np.searchsorted(others, start)], end)
    last = np.searchsorted(others, end)  # others before the end
    return start, np.maximum(np.where(last > 0, others[last - 1] + 1, 0), start)


class Tokens:
    """The tokens of strings: a number for each, in order, how many each string has, and the words by number."""

    def __init__(self, strings: list[str]):
        kinds, lower, _ = tables()
        chars, ends = characters(strings)
        kind = kinds.take(chars)
        kept = np.flatnonzero(kind)
        kind, chars = kind[kept], lower.take(chars[kept])
        inside = kind > SPACE
        turns = np.diff(inside.view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        odd = np.flatnonzero((kind[start] != LETTER) | (kind[end - 1] != LETTER))
        if len(odd):
            s, e = _trimmed(kind, APOSTROPHE, start[odd], end[odd])
            s, e = _trimmed(kind, HYPHEN, s, e)
            inside[spans(start[odd], s - start[odd])] = False
            inside[spans(e, end[odd] - e)] = False
            start[odd], end[odd] = s, e
            some = start < end
            start, end = start[some], end[some]
        self.counts = np.diff(np.searchsorted(kept[start], ends), prepend=0)
        self.codes, self.vocabulary = coded(utf8(chars[inside], end - start))
        self.words = self.vocabulary.to_numpy(zero_copy_only=False)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters and digits of all strings, in lower case, and how many each has."""
    kinds, lower, _ = tables()
    chars, ends = characters(strings)
    kept = np.flatnonzero(kinds.take(chars) == LETTER)
    return lower.take(chars[kept]), np.diff(np.searchsorted(kept, ends), prepend=0)


def scripts(strings: list[str]) -> np.ndarray:
    """The script, by number, of each string's first character that has one but Latin."""
    chars, ends = characters(strings)
    if not len(chars) or int(chars.max()) < 128:
        return np.zeros(len(strings), np.int64)
    own = tables()[2].take(chars)
    others = np.append(np.flatnonzero(own), len(chars))
    first = others[np.searchsorted(others, np.concatenate(([0], ends[:-1])))]
    return np.where(first < ends, np.append(own, 0)[first], 0)


class Detector:
    """The one language of a text's script with most stopword hits, if two or more; else unknown. Languages are numbers
    in names."""

    def __init__(self, languages: dict[str, Language]):
        self.own = [x for x in languages.values() if x.script in SCRIPTS]
        self.names = [*(x.name for x in self.own), UNKNOWN]
        self.scripts = np.array([SCRIPTS.index(x.script) for x in self.own], np.int64)
        self.rows = {w: n for n, w in enumerate(sorted({w for x in self.own for w in x.stopwords}), 1)}
        self.hits = np.zeros((len(self.rows) + 1, len(self.own)), bool)
        for k, x in enumerate(self.own):
            self.hits[[self.rows[w] for w in set(x.stopwords)], k] = True

    def __call__(self, strings: list[str], tokens: Tokens | None = None) -> np.ndarray:
        """tokens: those of these strings, if they are known."""
        if not self.own or not strings:
            return np.full(len(strings), len(self.own), np.int64)
        return self.among(scripts(strings), tokens or Tokens(strings))

    def among(self, script: np.ndarray, tokens: Tokens, owner: np.ndarray | None = None) -> np.ndarray:
        """owner: whose each token is, by number; -1 for none's."""
        owner = tokens.owners() if owner is None else owner
        asked = np.flatnonzero(owner >= 0)
        codes, owner = tokens.codes[asked], owner[asked]
        used = np.zeros(len(tokens.words), bool)
        used[codes] = True
        rows = np.zeros(len(tokens.words), np.int64)
        rows[used] = [self.rows.get(w, 0) for w in tokens.words[used].tolist()]
        row = rows[codes]
        owner, row = owner[row > 0], row[row > 0]
        n = np.stack([np.bincount(owner[self.hits[row, k]], minlength=len(script)) for k in range(len(self.own))], 1)
        script = np.where(np.isin(script, self.scripts), script, 0)  # a script of no language counts as Latin
        n[self.scripts[None, :] != script[:, None]] = 0
        most = n.max(1)
        return np.where((most >= LEAST_HITS) & ((n == most[:, None]).sum(1) == 1), n.argmax(1), len(self.own))


def strings_of(texts: pa.Array) -> list[str]:
    """Null texts are empty; what is no UTF-8 gives way to the replacement character."""
    try:
        return [t or "" for t in texts.to_numpy(zero_copy_only=False).tolist()]
    except (UnicodeDecodeError, pa.ArrowException):
        return [(t or b"").decode("utf-8", "replace") for t in texts.view(pa.binary()).to_pylist()]


def split_sentences(text: str) -> list[str]:
    return [s for s in (x.strip(SPACES) for x in SENTENCE_END.sub(r"\1|", text).split("|")) if s]


def _undotted(match: re.Match) -> str:
    return match[0].replace(".", "")


def normalize_abbreviations(text: str, contractions: re.Pattern | None) -> str:
    if "..." in text:
        text = DOTS.sub(ELLIPSIS, text)
    if contractions is not None:
        text = contractions.sub(_undotted, text)
    if LATIN.search(text):
        text = LATIN_ACRONYM.sub(_undotted, text)
    if not text.isascii():
        if CYRILLIC.search(text):
            text = CYRILLIC_ACRONYM.sub(_undotted, text)
        text = text.replace(ELLIPSIS, "...")
    return text


class Segmenter:
    """Sentences, tokens, languages, weights, boundaries and chunks of a slice of texts, by options."""

    def __init__(self, o: SegmentOptions):
        self.o, self.words, self.detector = o, Words(o), Detector(o.languages)
        dotted = {x.name: [re.escape(c) for c in x.contractions if "." in c] for x in o.languages.values()}
        self.contractions = {name: re.compile("|".join(c)) for name, c in dotted.items() if c}

    def _early(self, texts: list[str]) -> list[str] | None:
        """The languages known before texts are normalized."""
        o = self.o
        if o.language:
            return [o.language] * len(texts)
        if o.language_detection_tokens > 0 and o.language_detection_mode != PER_SENTENCE:
            tokens = Tokens(texts)
            at = np.cumsum(tokens.counts) - tokens.counts
            heads = [tokens.vocabulary.take(pa.array(tokens.codes[a : a + min(n, o.language_detection_tokens)])).to_pylist() for a, n in zip(at.tolist(), tokens.counts.tolist())]
            return [self.detector.names[x] for x in self.detector([" ".join(h) for h in heads])]
        return None

    def _sentence_languages(self, early: list[str] | None) -> tuple[np.ndarray, list[str]]:
        """A number for each sentence, and the names by number."""
        o, detector = self.o, self.detector
        if o.language_detection_mode == PER_SENTENCE and not o.language:
            return detector(self.flat, self.tokens), detector.names
        if early is not None:
            lang, names = coded(pa.array(early, pa.string()))
            return np.repeat(lang, self.sizes), names.to_pylist()
        if o.language_detection_mode == FULL_TEXT:
            return np.repeat(detector(self.texts), self.sizes), detector.names
        if not detector.own or not len(self.sizes):
            return np.full(len(self.flat), len(detector.own)), detector.names
        most, first = (10 if o.language_detection_mode == FIRST_TEN else 1), np.cumsum(self.sizes) - self.sizes
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        owner = np.where(np.arange(len(doc)) - first[doc] < most, doc, -1)
        heads = [" ".join(self.flat[a : a + min(n, most)]) for a, n in zip(first.tolist(), self.sizes.tolist())]
        return np.repeat(detector.among(scripts(heads), self.tokens, np.repeat(owner, self.tokens.counts)), self.sizes), detector.names

    def split(self, texts: list[str]) -> list[str] | None:
        """Sentences; the languages known before."""
        o = self.o
        early = self._early(texts)
        if o.pre_normalize_abbreviations:
            texts = [normalize_abbreviations(t, self.contractions.get(x)) for t, x in zip(texts, early or [None] * len(texts))]
        own = [split_sentences(t) for t in texts]
        self.texts, self.sizes, self.flat = texts, np.fromiter(map(len, own), np.int64, len(own)), [s for x in own for s in x]
        return early

    def cut(self, texts: list[str]) -> list[str] | None:
        """Sentences and their tokens; the languages known before."""
        early = self.split(texts)
        self.tokens = Tokens(self.flat)
        return early

    def read(self, texts: list[str]) -> Segmenter:
        o, early = self.o, self.cut(texts)
        if o.ngrams:
            self.terms = ngrams_of(*letters(self.flat), self.sizes, o.tfidf_min_ngram_size, o.tfidf_max_ngram_size)
        elif not o.enable_stop_word_removal and not o.enable_stemming:  # tokens as they are, whatever the language
            t = self.tokens
            self.terms = Terms(self.sizes, t.codes, t.owners(), lambda c: t.vocabulary.take(pa.array(c)))
        else:
            lang, names = self._sentence_languages(early)
            self.terms = self.words.terms(self.sizes, self.tokens.codes, self.tokens.owners(), self.tokens.words, lang, names)
        return self

    def scores(self) -> pa.Array:
        return self.terms.cohesion()

    def breaks(self) -> pa.Array:
        """list<bool>: whether a chunk ends after each sentence but the last."""
        scores = self.terms.cohesion()
        return pa.ListArray.from_arrays(scores.offsets, pa.array(_breaks(scores, self.o)))

    def tfidf(self) -> pa.Array:
        return self.terms.tfidf()

    def frequencies(self) -> pa.Array:
        return self.terms.frequencies()

    def sentences(self) -> pa.Array:
        return pa.ListArray.from_arrays(offsets(self.sizes), pa.array(self.flat, pa.string()))

    def chunks(self) -> pa.Array:
        return self.packed(self.terms.cohesion())

    def given(self, scores: pa.Array) -> pa.Array:
        """Lists of scores as long as these texts have them: zeros where a list is missing or of another length."""
        want, have = np.maximum(self.sizes - 1, 0), lengths(scores)
        values = pc.fill_null(scores.flatten(), 0.0).to_numpy(zero_copy_only=False)
        fits, out = np.flatnonzero(want == have), np.zeros(int(want.sum()))
        out[spans((np.cumsum(want) - want)[fits], want[fits])] = values[spans((np.cumsum(have) - have)[fits], want[fits])]
        return pa.ListArray.from_arrays(offsets(want), pa.array(out))

    def packed(self, scores: pa.Array) -> pa.Array:
        """list<struct<sentences,num_tokens>>: greedy packing under the budget."""
        first = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        broken = np.ones(len(self.flat), bool)
        inner = np.ones(len(self.flat), bool)
        inner[first] = False
        broken[inner] = _breaks(scores, self.o)
        most, starts, held, own = self.o.max_tokens, [], False, 0
        for i, (n, cut) in enumerate(zip(self.tokens.counts.tolist(), broken.tolist())):
            if n > most:
                starts.append(i)
                held = False
            elif cut or not held or own + n > most:
                starts.append(i)
                held, own = True, n
            else:
                own += n
        at = np.array(starts, np.int64)
        each = np.diff(np.searchsorted(at, np.cumsum(self.sizes)), prepend=0)
        many = np.add.reduceat(self.tokens.counts, at) if len(at) else at
        own = pa.ListArray.from_arrays(np.append(at, len(self.flat)).astype(np.int32), pa.array(self.flat, pa.string()))
        return pa.ListArray.from_arrays(offsets(each), pa.StructArray.from_arrays([own, pa.array(many.astype(np.int32))], ["sentences", "num_tokens"]))


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 10.0**DIGITS + 0.5) / 10.0**DIGITS


def _breaks(scores: pa.Array, o: SegmentOptions) -> np.ndarray:
    """boundaries() of all lists of scores."""
    s, at = _rounded(scores.values.to_numpy(zero_copy_only=False)), scores.offsets.to_numpy()
    if o.min_split_similarity > 0:
        return s < o.min_split_similarity
    edge = np.zeros(len(s) + 1, bool)
    edge[at] = True  # first of a list, or behind the last one
    inner = np.flatnonzero(~(edge[:-1] | edge[1:]))
    out, before, x, after = np.zeros(len(s), bool), s[inner - 1], s[inner], s[inner + 1]
    out[inner] = (x < before) & (x < after) & (_rounded((before + after) / 2 - x) >= o.depth_threshold)
    return out


#: A worker's segmenters by their options, the last few, as their words serve later tasks too.
SEGMENTERS: dict[bytes, Segmenter] = {}
KEPT_SEGMENTERS = 4


def segmenter(key: bytes) -> Segmenter:
    """Of pickled options."""
    found = SEGMENTERS.pop(key, None) or Segmenter(pickle.loads(key))
    while len(SEGMENTERS) >= KEPT_SEGMENTERS:
        SEGMENTERS.pop(next(iter(SEGMENTERS)))
    SEGMENTERS[key] = found
    return found


CHUNKS = "array<struct<sentences:array<string>,num_tokens:int>>"


def packed_options(o: SegmentOptions) -> bytes:
    return pickle.dumps(replace(o, embedding_cache=None, embedding_cache_mode=""))  # caches stay on the driver


EMPTY = packed_options(SegmentOptions(1))


def _sliced(strings: list[str], of: Callable[[int, int], pa.Array]) -> pa.Array:
    return pa.concat_arrays([of(i, j) for i, j in slices(np.fromiter(map(len, strings), np.int64, len(strings)), SLICE)] or [of(0, 0)])


def _column(kind: str, of: Callable[[Segmenter], pa.Array], text: Column, o: SegmentOptions) -> Column:
    key = packed_options(o)

    def run(texts: pa.Array) -> pa.Array:
        own, strings = segmenter(key), strings_of(texts)
        return _sliced(strings, lambda i, j: of(own.read(strings[i:j])))

    return batched(kind, run, text)


def chunks_scored(text: Column, scores: Column, o: SegmentOptions) -> Column:
    """chunks() by given scores of neighbouring sentences, array<double>."""
    key = packed_options(o)

    def run(texts: pa.Array, given: pa.Array) -> pa.Array:
        own, strings = segmenter(key), strings_of(texts)

        def of(i: int, j: int) -> pa.Array:
            own.cut(strings[i:j])
            return own.packed(own.given(given.slice(i, j - i)))

        return _sliced(strings, of)

    return batched(CHUNKS, run, text, scores)


def chunks_by(text: Column, which: Column, options: list[SegmentOptions]) -> Column:
    """chunks() by the options of each row's number; none where it has no number."""
    keys = [packed_options(o) for o in options]

    def run(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        k = pc.fill_null(numbers, -1).to_numpy(zero_copy_only=False)
        strings, order = strings_of(texts), np.argsort(k, kind="stable")
        parts = []
        for n in np.unique(k).tolist() or [-1]:
            own = segmenter(keys[n] if n >= 0 else EMPTY)
            mine = [strings[x] if n >= 0 else "" for x in order[k[order] == n].tolist()]
            parts.append(_sliced(mine, lambda i, j: own.read(mine[i:j]).chunks()))  # noqa: B023
        return pa.concat_arrays(parts).take(pa.array(np.argsort(order, kind="stable")))

    return batched(CHUNKS, run, text, which)


def scores(text: Column, o: SegmentOptions) -> Column:
    """array<double>: the cohesion of each two neighbouring sentences."""
    return _column("array<double>", Segmenter.scores, text, o)


def breaks(text: Column, o: SegmentOptions) -> Column:
    """array<boolean>: whether a chunk ends after each sentence but the last."""
    return _column("array<boolean>", Segmenter.breaks, text, o)


def chunks(text: Column, o: SegmentOptions) -> Column:
    """array<struct<sentences,num_tokens>>: the chunks, without their joined texts."""
    return _column(CHUNKS, Segmenter.chunks, text, o)


def sentences(text: Column, o: SegmentOptions) -> Column:
    """array<string>: the sentences of the normalized text."""
    key = packed_options(o)

    def run(texts: pa.Array) -> pa.Array:
        own = segmenter(key)
        own.split(strings_of(texts))
        return own.sentences()

    return batched("array<string>", run, text)


def tfidf(text: Column, o: SegmentOptions) -> Column:
    """array<struct<t,i,w>>: the weight of each term of each sentence."""
    return _column("array<struct<t:string,i:int,w:double>>", Segmenter.tfidf, text, o)


def document_frequencies(text: Column, o: SegmentOptions) -> Column:
    """array<struct<t,df>>: in how many of the sentences each term is."""
    return _column("array<struct<t:string,df:int>>", Segmenter.frequencies, text, o)

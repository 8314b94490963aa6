"""Token ids and prefix token counts of a byte-level BPE vocabulary, cached by unit.

A unit is a run of white space and the run of other characters after it. The pre-tokenizer of a byte-level
vocabulary never joins a character other than white space to the white space after it, and a run of white
space is cut by looking at no more than the character after it. So the tokens of a text, and of each of its
prefixes, are those of its units one after another, and every distinct unit need be encoded only once.
"""

from __future__ import annotations

import itertools
import re
from array import array
from functools import lru_cache

import numpy as np

# fixed values: the characters of Unicode's White_Space property
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# fixed value: the pattern by which byte-level vocabularies split text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Neighbouring white space: only then does a cut before each blank differ from UNIT.
RUN = re.compile(f"[{WHITE}][{WHITE}]")
#: Code points below this are classed alike by every Unicode version, so that faster code may stand in.
PLAIN_END = "\u0250"
# fixed values: letters and numbers below PLAIN_END
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: A text without these may be cut before every full stop and comma as well.
NO_STOP_CUT = re.compile(f"[^{LETTERS}{NUMBERS}][.,]|^[.,]|\x00")
NOT_PLAIN = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u203a\u20ac]")
# fixed values: contractions of two letters
LONG_CONTRACTIONS = {"'re", "'ve", "'ll"}
#: Entries of a cache before it starts anew; bounds a worker's memory.
CACHE = 450_000
LONGEST_CACHED = 64


def units(text: str) -> list[str]:
    if not text:
        return []
    if RUN.search(text):
        return UNIT.findall(text)
    if not NO_STOP_CUT.search(text):
        for ch in " .,\n":
            text = text.replace(ch, "\x00" + ch)
        first, *rest = text.split("\x00")
        return [first, *rest] if first else rest
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


def _signed(byte: int) -> int:
    return byte - 256 if byte > 127 else byte


def _total(deltas: bytes) -> int:
    return int(np.frombuffer(deltas, dtype=np.int8).sum(dtype=np.int64))


class _Cache(dict):
    """unit -> value, computed on a miss. When it is full, what was asked for since it was last full stays at hand."""

    def __init__(self, compute):
        self.compute, self.before = compute, {}

    def __missing__(self, unit):
        value = self.before.get(unit)
        if value is None:
            value = self.compute(unit)
        if len(unit) <= LONGEST_CACHED:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[unit] = value
        return value


class Vocabulary:
    """A tokenizers .json file of a byte-level BPE without a normalizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None or type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError(f"{path}: a byte-level BPE vocabulary without a normalizer is needed")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(re.search(f"[{WHITE}]", t.content) or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path}: added tokens with white space around or inside are not supported")
        self.added = [t.content for t in added]
        self.vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.widest = max(map(len, self.vocab))
        self.fast = self._ranked(path)
        # byte -> the character that stands for it in the vocabulary
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.ids = _Cache(self._ids)
        self.deltas = _Cache(self._deltas)
        self.prefixes: dict[str, tuple[int, str | None, int, bytes]] = {"": (0, None, 0, b"")}
        self.pairs: dict[tuple[str | None, str], bool] = {}

    def _ranked(self, path: str):
        """The same vocabulary as ranks, for the units of plain characters; None if its merges aren't in order of id."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = [self.vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if any(a >= b for a, b in zip(made, made[1:])):
            return None
        back = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(back[c] for c in token): n for token, n in self.vocab.items() if all(c in back for c in token)}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, unit: str) -> bool:
        return (unit.isascii() or max(unit) < PLAIN_END) and not any(a in unit for a in self.added)

    def _ids(self, unit: str) -> bytes:
        ids = self.fast(unit) if self.fast and self._plain(unit) else self._encode(unit)
        return array("I", ids).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.fast and not NOT_PLAIN.search(text) and not any(a in text for a in self.added):
            return array("I", self.fast(text)).tobytes()
        return b"".join(map(self.ids.__getitem__, units(text)))

    # -- token counts of all prefixes

    def _stands(self, last: str | None, token: str) -> bool:
        """Whether BPE leaves token whole, after last if given."""
        key = (last, token)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 4 * CACHE:
                self.pairs.clear()
            values = [t.value for t in self.tokenizer.model.tokenize((last or "") + token)]
            found = self.pairs[key] = values == ([token] if last is None else [last, token])
        return found

    def _grown(self, piece: str) -> bytes:
        """By how much the token count of a pre-token (one character a byte) grows with each byte, by dynamic programming.

        A sequence of tokens is what BPE makes of its bytes if and only if each two neighbours are what BPE
        makes of theirs. So the last token of a prefix is the one that may follow the last token of the
        prefix before it, and the count is one more than there. Prefixes are kept, each after all its own,
        as words share them.
        """
        n = len(piece)
        if n > LONGEST_CACHED:
            return self._long(piece)
        known, vocab, pairs = self.prefixes, self.vocab, self.pairs
        found = known.get(piece)
        if found is not None:
            return found[3]
        if len(known) >= 3 * CACHE:
            known.clear()
            known[""] = (0, None, 0, b"")
        low, high = 0, n - 1  # the longest prefix known
        while low < high:
            middle = (low + high + 1) // 2
            if piece[:middle] in known:
                low = middle
            else:
                high = middle - 1
        last, _, start, grown = known[piece[:low]]
        for j in range(low + 1, n + 1):
            # mostly the last token grows or a new one begins; else any other token may be the last
            for i in itertools.chain((start, j - 1), range(max(0, j - self.widest), j - 1)):
                token = piece[i:j]
                if token in vocab:
                    count, before = known[piece[:i]][:2]
                    stands = pairs.get((before, token)) if i == 0 or before is not None else False
                    if stands or (stands is None and self._stands(before, token)):
                        break
            else:
                raise ValueError(f"no encoding of {piece!r}")
            grown += bytes([count + 1 - last & 0xFF])
            last, start = count + 1, i
            known[piece[:j]] = (last, token, i, grown)
        return grown

    def _long(self, piece: str) -> bytes:
        """_grown of a piece whose prefixes aren't kept beyond the reach of a token."""
        known: dict[int, tuple[int, str | None]] = {0: (0, None)}
        grown, last, start = bytearray(), 0, 0
        for j in range(1, len(piece) + 1):
            for i in itertools.chain((start, j - 1), range(max(0, j - self.widest), j - 1)):
                token = piece[i:j]
                if token in self.vocab and i in known and (i == 0 or known[i][1] is not None) and self._stands(known[i][1], token):
                    break
            else:
                raise ValueError(f"no encoding of {piece!r}")
            grown.append(known[i][0] + 1 - last & 0xFF)
            last, start = known[i][0] + 1, i
            known[j] = (last, token)
            known.pop(j - self.widest - 1, None)  # no token reaches back further
        return bytes(grown)

    def _piece_deltas(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            return self._grown(piece.replace(" ", self.letters[32]))
        raw = piece.encode()
        grown = self._grown(raw.decode("latin-1").translate(self.letters))
        if len(raw) == len(piece):
            return grown
        counts, ends, at = [0, *itertools.accumulate(map(_signed, grown))], [0], 0
        for ch in piece:
            at += 1 if ch < "\x80" else 2 if ch < "\u0800" else 3 if ch < "\U00010000" else 4
            ends.append(counts[at])
        return bytes([b - a & 0xFF for a, b in zip(ends, ends[1:])])

    def _deltas(self, unit: str) -> bytes:
        """For each code point of the unit, by how much the token count grows with it (signed bytes)."""
        if self._plain(unit) and (unit[0] not in WHITE or unit[1:2] not in WHITE) and "'" not in unit:
            return b"".join(map(self._piece_deltas, PIECE.findall(unit)))
        out = []
        while any(a in unit for a in self.added):
            at, size = min((unit.find(a), -len(a)) for a in self.added if a in unit)
            before, token, unit = unit[:at], unit[at : at - size], unit[at - size :]
            # within the added token's string a prefix is ordinary text; with its last character the token stands alone
            own, ordinary = self._ordinary(before), self._ordinary(before + token[:-1])
            out += [own, ordinary[at:], bytes([(1 + _total(own) - _total(ordinary)) & 0xFF])]
        return b"".join(out) + self._ordinary(unit)

    def _ordinary(self, unit: str) -> bytes:
        """_deltas of a unit in which no added token counts."""
        if not unit:
            return b""
        lead = re.match(f"[{WHITE}]*", unit).end()
        if lead > 1:
            # a run of white space is one piece while nothing follows; then its last character parts from the others
            blanks = self._piece_deltas(unit[:lead])
            if lead == len(unit):
                return blanks
            rest = self._ordinary(unit[lead - 1 :])
            shorter, own = _total(blanks[:-1]), _signed(rest[0])
            # count(blanks) at the lead's end, then count(blanks less one) and what the rest has up to each place
            return blanks + bytes([(shorter + own + _signed(rest[1]) - _total(blanks)) & 0xFF]) + rest[2:]
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)
        return b"".join(self._contraction(unit[a:b]) if unit[a:b] in LONG_CONTRACTIONS else self._piece_deltas(unit[a:b]) for _, (a, b) in pieces)

    def _contraction(self, piece: str) -> bytes:
        """Cut after its first letter, it is an apostrophe and a letter: two pieces."""
        return bytes([1, 1, (_total(self._grown(piece)) - 2) & 0xFF])

    def prefix_deltas(self, text: str) -> bytes:
        """deltas[p] is count(text[: p + 1]) - count(text[:p]) as a signed byte, for each code point."""
        return b"".join(map(self.deltas.__getitem__, units(text)))


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The characters that stand for the bytes 0 to 255 in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file."""
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

"""Text functions: abbreviations, sentences, tokens, character n-grams.

Null texts count as empty. Character classes are spelled out where engines differ: white space and digits in
patterns are ASCII, ends are ends of text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.languages import LANGUAGES, Language
from .arrays import let

# fixed values: patterns and characters of the segmentation rules
ELLIPSIS = "\ue000ELLIPSIS\ue000"
SENTENCE_END = "([.!?…])([”\"»']*)[\\t\\n\\f\\r ]+|([.!?…])([”\"»']*)\\z"
NOT_TOKEN = r"[^\p{L}\p{N}\t\n\f\r \-']"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


W = "[0-9A-Za-z_]"
#: Each letter and dot of a dotted acronym of two letters or more whose dot is to go; its last dot goes only before W.
LATIN_ACRONYM = rf"(?:\G(?!\A)|(?<!{W})(?=(?:[A-Z]\.){{2,}}(?:[A-Z](?!{W})|(?={W}))))([A-Z])\.(?=(?:[A-Z]\.)*(?:[A-Z](?!{W})|(?={W})))"
#: A Cyrillic letter is no word character to an ASCII word boundary: the rule needs an ASCII one on both sides.
CYRILLIC_ACRONYM = rf"(?:\G(?!\A)|(?<={W})(?=(?:[А-ЯЁ]\.){{2,}}[А-ЯЁ]?(?={W})))([А-ЯЁ])\.(?=(?:[А-ЯЁ]\.)*[А-ЯЁ]?(?={W}))"


def _lower(text: Column) -> Column:
    """Character by character: no final sigma, no dot above i."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def _drop_dots(text: Column, contractions: tuple[str, ...]) -> Column:
    """Contractions without their dots: one pass, the first of the list that matches at a place."""
    dotted = [c for c in contractions if "." in c]
    if not dotted:
        return text
    alternatives, groups = [], 0
    for c in dotted:
        parts = c.split(".")
        alternatives.append(r"\.".join(f"({p})" if p else "" for p in parts))
        groups += sum(bool(p) for p in parts)
    return F.regexp_replace(text, "|".join(alternatives), "".join(f"${g + 1}" for g in range(groups)))


def by_language(lang: Column, default: Column, branch, languages: dict[str, Language]) -> Column:
    """branch(language) for the row's language, default where it gives none."""
    out = default
    for language in languages.values():
        value = branch(language)
        if value is not None:
            out = F.when(lang == language.name, value).otherwise(out)
    return out


def normalize_abbreviations(text: Column, lang: Column | None = None, languages: dict[str, Language] = LANGUAGES) -> Column:
    """Dots gone from contractions of the language, if known, and from acronyms; three or more dots become three."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\.{3,}", ELLIPSIS)
    if lang is not None:
        masked = out
        out = by_language(lang, masked, lambda x: _drop_dots(masked, x.contractions) if any("." in c for c in x.contractions) else None, languages)
    # most texts have no acronym: a search for two letters with dots is quicker than the rules at every place
    out = let(out, lambda x: F.when(x.rlike(r"[A-Z]\.[A-Z]\."), F.regexp_replace(x, LATIN_ACRONYM, "$1")).otherwise(x))
    out = let(out, lambda x: F.when(x.rlike(r"[А-ЯЁ]\.[А-ЯЁ]\."), F.regexp_replace(x, CYRILLIC_ACRONYM, "$1")).otherwise(x))
    return F.replace(out, F.lit(ELLIPSIS), F.lit("..."))


def split_sentences(text: Column) -> Column:
    """Sentences, trimmed and not empty; a pipe ends one too."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, r"$1$2$3$4|"), r"\|")
    return F.filter(F.transform(cut, lambda s: F.btrim(s, F.lit(SPACES))), lambda s: s != "")


def trim_tokens(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.btrim(F.btrim(p, F.lit("'")), F.lit("-"))), lambda p: p != "")


def tokenize(text: Column) -> Column:
    """Lower-case tokens of letters, digits, and hyphens and apostrophes within."""
    return trim_tokens(F.split(F.regexp_replace(_lower(F.coalesce(text, F.lit(""))), NOT_TOKEN, ""), r"[\t\n\f\r ]+"))


def letters(text: Column) -> Column:
    """The letters and digits, in lower case."""
    return F.regexp_replace(_lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def char_ngrams(text: Column, least: int | Column, most: int | Column) -> Column:
    """Character n-grams of the letters and digits, by size and then by place; empty for sizes out of order."""
    least, most = (F.lit(x) if isinstance(x, int) else x for x in (least, most))
    none = F.array().cast("array<string>")
    grams = lambda c: F.flatten(F.transform(F.sequence(least, most), lambda n: let(_grams(c, n), lambda g: F.when(g == "", none).otherwise(F.split(g, " ")))))
    return F.when((least > 0) & (most >= least), let(letters(text), grams)).otherwise(none)


def _grams(chars: Column, n: Column) -> Column:
    """The n-grams of letters and digits, joined by blanks: each character gives way to the n that begin with it, in one
    pass, and the last ones, with fewer, to a blank."""
    return F.rtrim(F.regexp_replace(chars, F.concat(F.lit("(?=(.{"), n.cast("string"), F.lit("}))?.")), F.lit("$1 ")))


def joined_ngrams(text: Column, least: int, most: int) -> Column:
    """char_ngrams() joined by blanks, without an array of them."""
    grams = [F.nullif(_grams(letters(text), F.lit(n)), F.lit("")) for n in range(least, most + 1)] if least > 0 else []
    return F.concat_ws(" ", *grams)


def token_counts(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: F.size(tokenize(s)))

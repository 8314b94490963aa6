"""Language detection by stopwords, stopword removal and affix stemming."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.languages import LANGUAGES, Language
from .arrays import let
from .text import by_language, tokenize, trim_tokens

UNKNOWN = "unknown"
LEAST_HITS = 2


def one_of(value: Column, words: list[str]) -> Column:
    """Whether a value is one of these words: a look-up in a set. The list is made in the JVM, as a call for each word
    would make plans slow to build."""
    strings = SparkContext._active_spark_context._jvm.org.apache.hadoop.util.StringUtils
    return Column(value._jc.isInCollection(strings.getStringCollection(" ".join(words), " ")))


def listed(tokens: Column, language: Language, wanted: bool) -> Column:
    """The tokens that are stopwords of the language, or that aren't."""
    words = sorted(set(language.stopwords))
    return F.filter(tokens, lambda t: one_of(t, words) if wanted else ~one_of(t, words))


def script(text: Column, languages: dict[str, Language] = LANGUAGES) -> Column:
    """The script of the first character whose script some language has; else Latin."""
    classes = {"Cyrillic": r"\p{IsCyrillic}", "Arabic": r"\p{IsArabic}"}
    known = [s for s in classes if any(x.script == s for x in languages.values())]
    if not known:
        return F.when(text.isNotNull() | text.isNull(), F.lit("Latin"))
    first = F.regexp_extract(F.coalesce(text, F.lit("")), "[" + "".join(classes[s] for s in known) + "]", 0)
    out = F.lit("Latin")
    for s in known:
        out = F.when(first.rlike(classes[s]), F.lit(s)).otherwise(out)
    return out


def detect_language(text: Column, languages: dict[str, Language] = LANGUAGES) -> Column:
    """The one language of the text's script with most stopword hits, if two or more; else unknown."""

    def best(tokens: Column) -> Column:
        def among(names: list[Language]) -> Column:
            hits = F.array(*[F.struct(F.size(listed(tokens, x, True)).alias("n"), F.lit(x.name).alias("lang")) for x in names])
            return let(hits, lambda h: let(F.array_max(h)["n"], lambda n: F.when((n >= LEAST_HITS) & (F.size(F.filter(h, lambda x: x["n"] == n)) == 1), F.array_max(h)["lang"])))

        scripts = {s: [x for x in languages.values() if x.script == s] for s in ("Latin", "Cyrillic", "Arabic")}
        scripts = {s: names for s, names in scripts.items() if names}
        return let(script(text, languages), lambda own: F.coalesce(*[F.when(own == s, among(names)) for s, names in scripts.items()], F.lit(UNKNOWN)))

    return let(tokenize(text), best)


def remove_stopwords(tokens: Column, lang: Column, languages: dict[str, Language] = LANGUAGES) -> Column:
    """Tokens less the language's stopwords, trimmed once more; all tokens as they are if the language isn't known."""
    return by_language(lang, tokens, lambda x: trim_tokens(listed(tokens, x, False)), languages)


def remove_stopwords_text(text: Column, lang: Column, languages: dict[str, Language] = LANGUAGES) -> Column:
    """The tokens left, joined by blanks; the text itself if the language isn't known."""
    return by_language(lang, text, lambda x: F.array_join(listed(tokenize(text), x, False), " "), languages)


def _affixes(affixes: tuple[str, ...]) -> str:
    return "|".join(re.escape(a) for a in sorted(set(affixes), key=lambda a: (-len(a.encode()), a)))


def stem(word: Column, language: Language) -> Column:
    """One prefix and then one suffix gone, longest first, each only from words of min_len bytes or more."""
    out = word
    if language.prefixes:
        out = F.regexp_replace(out, f"^(?:{_affixes(language.prefixes)})", "")
    if language.suffixes:
        suffix = lambda w: F.when(F.octet_length(w) >= language.min_len, F.regexp_replace(w, rf"(?:{_affixes(language.suffixes)})\z", "")).otherwise(w)
        out = let(out, suffix) if language.prefixes else suffix(out)
    return F.when(F.octet_length(word) >= language.min_len, out).otherwise(word)


def stem_tokens(tokens: Column, lang: Column, languages: dict[str, Language] = LANGUAGES) -> Column:
    return by_language(lang, tokens, lambda x: F.transform(tokens, lambda t: stem(t, x)) if x.prefixes or x.suffixes else None, languages)

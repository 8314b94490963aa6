"""The segmentation rules once more as SQL text, for checking the DataFrame queries against another engine (DuckDB)."""

from __future__ import annotations

from .functions.language import LEAST_HITS, _affixes
from .functions.text import SPACES
from .plans.options import FIRST_TEN, FULL_TEXT, PER_SENTENCE, SegmentOptions
from .sources.languages import LANGUAGES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mark() -> str:
    return "(chr(57344) || 'ELLIPSIS' || chr(57344))"


def normalized(x: str, lang: str | None = None) -> str:
    """Abbreviations of an expression; lang names a language whose contractions count, or a column."""
    out = f"regexp_replace({x}, '\\.{{3,}}', {mark()}, 'g')"
    if lang is not None:
        cases = ""
        for name, language in LANGUAGES.items():
            dotted = [c for c in language.contractions if "." in c]
            if dotted:
                pattern = "|".join(c.replace(".", r"\.") for c in dotted)
                cases += f" WHEN {q(name)} THEN {undotted(out, pattern)}"
        out = f"CASE {lang}{cases} ELSE {out} END"
    out = undotted(out, r"\b(?:[A-Z]\.){2,}(?:[A-Z])?\b")
    return f"replace({out}, {mark()}, '...')"


def undotted(x: str, pattern: str) -> str:
    """Dots gone from all matches of a pattern."""
    return f"(SELECT array_to_string(list_transform(range(1, len(p) + 1), lambda k: p[k] || coalesce(replace(m[k], '.', ''), '')), '') FROM (SELECT regexp_split_to_array(v, {q(pattern)}) AS p, regexp_extract_all(v, {q(pattern)}) AS m FROM (SELECT {x} AS v)))"


def sentences(x: str) -> str:
    trim = " || ".join(f"chr({ord(c)})" for c in SPACES)
    end = r"""([.!?…])([”"»']*)\s+|([.!?…])([”"»']*)$"""
    return f"list_filter(list_transform(string_split(regexp_replace({x}, {q(end)}, '\\1\\2\\3\\4|', 'g'), '|'), lambda z: trim(z, {trim})), lambda z: z <> '')"


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower({x}), {q(chr(91) + chr(94) + r'\p{L}\p{N}\s\-' + chr(39) + chr(93))}, '', 'g'), '\\s+'), lambda z: trim(trim(z, ''''), '-')), lambda z: z <> '')"


def ngrams(x: str, a: int, b: int) -> str:
    return f"(SELECT flatten(list_transform(range({a}, {b} + 1), lambda n: list_transform(range(1, greatest(length(v) - n + 2, 1)), lambda j: substr(v, j, n)))) FROM (SELECT regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS v))"


def stopwords(script: bool = True) -> str:
    rows = [f"({q(x.name)}, {q(x.script)}, {q(w)})" for x in LANGUAGES.values() for w in sorted(set(x.stopwords))]
    return f"(VALUES {', '.join(rows)}) AS sw(lang, script, word)"


def script(x: str) -> str:
    first = f"regexp_extract({x}, '[\\p{{Cyrillic}}\\p{{Arabic}}]')"
    return f"CASE WHEN regexp_matches({first}, '\\p{{Cyrillic}}') THEN 'Cyrillic' WHEN regexp_matches({first}, '\\p{{Arabic}}') THEN 'Arabic' ELSE 'Latin' END"


def detected(source: str, key: str, text: str) -> str:
    """A query (key, lang) of the language of each row's text."""
    return f"""SELECT d.{key}, coalesce(best.lang, 'unknown') AS lang FROM {source} d LEFT JOIN (
      SELECT {key}, lang FROM (
        SELECT {key}, lang, rank() OVER (PARTITION BY {key} ORDER BY n DESC) AS r, count(*) OVER (PARTITION BY {key}, n) AS same FROM (
          SELECT {key}, sw.lang, count(*) AS n FROM (SELECT {key}, {script(text)} AS script, unnest({tokens(text)}) AS word FROM {source}) w
          JOIN {stopwords()} ON sw.word = w.word AND sw.script = w.script GROUP BY ALL HAVING count(*) >= {LEAST_HITS})
      ) WHERE r = 1 AND same = 1) best ON best.{key} = d.{key}"""


def stemmed(word: str, lang: str) -> str:
    cases = ""
    for name, x in LANGUAGES.items():
        if not x.prefixes and not x.suffixes:
            continue
        out = word
        if x.prefixes:
            out = f"regexp_replace({out}, {q(f'^(?:{_affixes(x.prefixes)})')}, '')"
        if x.suffixes:
            cut = f"regexp_replace({out}, {q(f'(?:{_affixes(x.suffixes)})$')}, '')"
            out = f"CASE WHEN strlen({out}) >= {x.min_len} THEN {cut} ELSE {out} END"
        cases += f" WHEN {q(name)} THEN CASE WHEN strlen({word}) >= {x.min_len} THEN {out} ELSE {word} END"
    return f"CASE {lang}{cases} ELSE {word} END"


def parts(source: str, o: SegmentOptions) -> str:
    """CTEs up to st(doc_id, i, sentence, n, toks): the sentences with their token counts and scoring tokens; source has doc_id and text."""
    ctes = [f"src AS MATERIALIZED ({source})"]
    if o.language:
        ctes.append(f"early AS (SELECT doc_id, {q(o.language)} AS lang FROM src)")
    elif o.language_detection_tokens > 0 and o.language_detection_mode != PER_SENTENCE:
        ctes.append(f"head AS MATERIALIZED (SELECT doc_id, array_to_string({tokens('text')}[1:{o.language_detection_tokens}], ' ') AS text FROM src)")
        ctes.append(f"early AS MATERIALIZED ({detected('head', 'doc_id', 'text')})")
    else:
        ctes.append("early AS (SELECT doc_id, '' AS lang FROM src)")
    known = bool(o.language) or o.language_detection_tokens > 0
    norm = normalized("text", "lang" if known else None) if o.pre_normalize_abbreviations else "text"
    ctes.append(f"norm AS MATERIALIZED (SELECT src.doc_id, {norm} AS text FROM src JOIN early USING (doc_id))")
    ctes.append(f"cut AS MATERIALIZED (SELECT doc_id, text, {sentences('text')} AS s FROM norm)")
    ctes.append("flat AS (SELECT doc_id, unnest(range(0, len(s))) AS i, unnest(s) AS sentence FROM cut)")
    ctes.append(f"tok AS MATERIALIZED (SELECT doc_id, i, sentence, {tokens('sentence')} AS raw FROM flat)")
    if o.ngrams:
        toks = ngrams("sentence", o.tfidf_min_ngram_size, o.tfidf_max_ngram_size)
        ctes.append(f"st AS MATERIALIZED (SELECT doc_id, i, sentence, len(raw) AS n, {toks} AS toks FROM tok)")
        return ", ".join(ctes)
    if o.language_detection_mode == PER_SENTENCE and not o.language:
        ctes.append("own AS MATERIALIZED (SELECT doc_id || ':' || i AS k, doc_id, i, sentence AS text FROM tok)")
        ctes.append(f"found AS MATERIALIZED ({detected('own', 'k', 'text')})")
        ctes.append("lang AS MATERIALIZED (SELECT doc_id, i, lang FROM own JOIN found USING (k))")
    elif known:
        ctes.append("lang AS MATERIALIZED (SELECT doc_id, i, lang FROM tok JOIN early USING (doc_id))")
    else:
        text = {FULL_TEXT: "text", FIRST_TEN: "array_to_string(s[1:10], ' ')"}.get(o.language_detection_mode, "coalesce(s[1], '')")
        ctes.append(f"own AS MATERIALIZED (SELECT doc_id, {text} AS text FROM cut)")
        ctes.append(f"found AS MATERIALIZED ({detected('own', 'doc_id', 'text')})")
        ctes.append("lang AS MATERIALIZED (SELECT doc_id, i, lang FROM tok JOIN found USING (doc_id))")
    ctes.append("words AS (SELECT doc_id, i, lang, unnest(range(0, len(raw))) AS k, unnest(raw) AS w FROM tok JOIN lang USING (doc_id, i))")
    if o.enable_stop_word_removal:
        names = ", ".join(q(n) for n in LANGUAGES)
        ctes.append(f"kept AS (SELECT doc_id, i, lang, k, CASE WHEN lang IN ({names}) THEN trim(trim(w, ''''), '-') ELSE w END AS w FROM words ANTI JOIN {stopwords()} ON sw.lang = words.lang AND sw.word = words.w)")
        ctes.append("used AS (SELECT * FROM kept WHERE w <> '')")
    else:
        ctes.append("used AS (SELECT * FROM words)")
    word = stemmed("w", "lang") if o.enable_stemming else "w"
    ctes.append(f"lists AS (SELECT doc_id, i, list({word} ORDER BY k) AS toks FROM used GROUP BY doc_id, i)")
    ctes.append("st AS MATERIALIZED (SELECT tok.doc_id, tok.i, sentence, len(raw) AS n, coalesce(toks, []) AS toks FROM tok LEFT JOIN lists USING (doc_id, i))")
    return ", ".join(ctes)


WEIGHTS = """
  tc AS (SELECT doc_id, i, term, count(*) AS c FROM (SELECT doc_id, i, unnest(toks) AS term FROM st) GROUP BY ALL),
  size AS (SELECT doc_id, count(*) AS n FROM st GROUP BY ALL),
  df AS (SELECT doc_id, term, count(*) AS df FROM tc GROUP BY ALL),
  w AS MATERIALIZED (SELECT tc.doc_id, tc.i, term, c / len(st.toks) * ln(1 + size.n / (1 + df.df)) AS w FROM tc JOIN df USING (doc_id, term) JOIN size USING (doc_id) JOIN st ON st.doc_id = tc.doc_id AND st.i = tc.i)"""

SCORES = """
  norms AS (SELECT doc_id, i, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
  dots AS (SELECT a.doc_id, a.i, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.term = b.term AND b.i = a.i + 1 GROUP BY ALL),
  scores AS MATERIALIZED (SELECT s.doc_id, s.i, coalesce(dot / nullif(x.norm * y.norm, 0), 0.0) AS score FROM st s JOIN st n ON n.doc_id = s.doc_id AND n.i = s.i + 1
    LEFT JOIN norms x ON x.doc_id = s.doc_id AND x.i = s.i LEFT JOIN norms y ON y.doc_id = s.doc_id AND y.i = s.i + 1 LEFT JOIN dots d ON d.doc_id = s.doc_id AND d.i = s.i)"""


def bounds(o: SegmentOptions) -> str:
    if o.min_split_similarity > 0:
        rule = f"s < {o.min_split_similarity}"
    else:
        rule = f"s < p AND s < f AND round((p + f) / 2 - s, 12) >= {o.depth_threshold}"
    return f"""bounds AS MATERIALIZED (SELECT doc_id, i, coalesce({rule}, false) AS brk FROM (SELECT doc_id, i, s, lag(s) OVER d AS p, lead(s) OVER d AS f FROM (SELECT doc_id, i, round(score, 12) AS s FROM scores) WINDOW d AS (PARTITION BY doc_id ORDER BY i)))"""


def packing(o: SegmentOptions) -> str:
    m = o.max_tokens
    return f"""step AS MATERIALIZED (SELECT st.doc_id, st.i, n, sentence, coalesce(brk, false) AS brk FROM st LEFT JOIN bounds b ON b.doc_id = st.doc_id AND b.i = st.i - 1),
  walk AS (SELECT doc_id, i, 0 AS k, CASE WHEN n > {m} THEN 0 ELSE n END AS tot, CASE WHEN n > {m} THEN 0 ELSE 1 END AS cnt FROM step WHERE i = 0
    UNION ALL SELECT s.doc_id, s.i, w.k + CASE WHEN s.n > {m} OR w.cnt = 0 OR s.brk OR w.tot + s.n > {m} THEN 1 ELSE 0 END,
      CASE WHEN s.n > {m} THEN 0 WHEN w.cnt = 0 OR s.brk OR w.tot + s.n > {m} THEN s.n ELSE w.tot + s.n END,
      CASE WHEN s.n > {m} THEN 0 WHEN w.cnt = 0 OR s.brk OR w.tot + s.n > {m} THEN 1 ELSE w.cnt + 1 END
    FROM walk w JOIN step s ON s.doc_id = w.doc_id AND s.i = w.i + 1)"""


def segmented(source: str, o: SegmentOptions, scores: str | None = None) -> str:
    """A query doc_id, chunk_index, text, n_sentences, num_tokens; scores replaces the CTEs of the sparse ones."""
    ctes = [parts(source, o), *([WEIGHTS, SCORES] if scores is None else [scores]), bounds(o), packing(o)]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT walk.doc_id, k AS chunk_index, array_to_string(list(sentence ORDER BY walk.i), ' ') AS text, count(*) AS n_sentences, sum(n) AS num_tokens FROM walk JOIN step USING (doc_id, i) GROUP BY walk.doc_id, k"

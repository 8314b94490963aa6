import hashlib
import itertools
import os
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwell.llm import bpe, chat, decontaminate, fingerprint, html, registry, sharding, toxicity


def test_toxicity(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        own = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["Nasty", "awful,", "vilest"])
        docs.append((i, " ".join(own), "en"))
        if i // 6 % 2 == 0:
            labels.append((i, int(bad)))
    docs += [(2000, None, "en"), (2001, "", "en"), (None, "nasty", "en")]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, l).collect()}
    assert len(got) == 903
    right = sum(got[i].predicted == int(i % 6 == 0) for i in range(900))
    assert right >= 890
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[None].predicted == 1
    none = toxicity.toxicity(d, l.filter("toxic = 0")).agg(F.max("score")).first()[0]
    assert none == 0.0


def test_toxicity_risk_and_its_gradient():
    """Against the risk written out, and its gradient by differences."""
    rng = np.random.default_rng(3)
    docs = lambda n: [np.sort(rng.choice(6, rng.integers(0, 5), replace=False)) for _ in range(n)]
    pos, unl, prior = docs(15), docs(40), 0.2
    risk = toxicity.Risk(pos, unl, prior, 6)

    def written_out(w):
        loss = lambda docs, sign: np.mean([np.log(1 + np.exp(-sign * (sum(w[k] for k in d) + w[6]))) for d in docs])
        return prior * loss(pos, 1), loss(unl, -1) - prior * loss(pos, -1)

    for _ in range(5):
        w = rng.normal(size=7)
        first, g_first, rest, g_rest = risk.parts(w)
        assert np.allclose((first, rest), written_out(w))
        for k in range(7):
            step = np.eye(7)[k] * 1e-6
            up, down = written_out(w + step), written_out(w - step)
            assert np.allclose((g_first[k], g_rest[k]), [(a - b) / 2e-6 for a, b in zip(up, down)], atol=1e-6)


def test_toxicity_steps_up_where_the_risk_is_negative():
    """One feature marks P and no text of U: the second part turns negative, and is brought back to 0 or so."""
    pos, unl = [np.array([0])] * 50, [np.array([], dtype=np.int64)] * 200
    for steps in (50, 400):
        w, b = toxicity.train(pos, unl, 0.2, 1, steps=steps)
        assert toxicity.Risk(pos, unl, 0.2, 1).parts(np.append(w, b))[2] > -0.1


def test_long_tokens_count():
    words = toxicity._Words(None)
    assert toxicity.text_features("x" * 100, words) and toxicity.text_features("x" * 100, words) != toxicity.text_features("x" * 99, words) and not words


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, [word() for _ in range(rng.randint(15, 40))]) for i in range(8)] + [(20, [word() for _ in range(7)]), (21, ["a", "b"])]
    docs, expected = [], set()
    for i in range(60):
        own = [word() for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            item, text = items[rng.randrange(9)]
            text = list(text)
            if i % 2 and len(text) > 10:
                text[rng.randrange(len(text))] = "zzz"
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() + "," for w in text]
            expected.add((i, item))
        docs.append((i, " ".join(own)))
    docs += [(70, None), (71, ""), (None, " ".join(items[0][1]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w), 0) for i, w in [*items, (90, items[0][1])]] + [(91, None, 0)], "item_id long, text string, doc_id int")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == expected | {(None, 0)}
    assert decontaminate.leaks(d, b.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), b).count() == 0
    clean = {r.doc_id for r in decontaminate.decontaminate(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in expected} - {None}


def test_decontamination_of_short_items_and_repeated_ids(spark):
    items = [(0, "alpha beta gamma delta"), (1, "one two three four five six"), (2, "to be"), (3, "red green blue")]
    docs = [(1, "x Alpha, beta gamma delta y"), (2, "alpha beta gamma no"), (3, "a one two THREE no five six"), (4, "one no three no five six"), (5, "to be"), (6, "red green blue"), (7, "clean"), (7, "one two three four five six"), (7, "red green"), (7, "clean")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == {(1, 0), (3, 1), (6, 3), (7, 1)}
    left = decontaminate.decontaminate(d.withColumn("leak_doc", F.lit(1)).withColumn("_leak_doc", F.lit(2)), b)
    assert sorted((r.doc_id, r.text, r._leak_doc) for r in left.collect()) == sorted((i, t, 2) for i, t in docs if i in (2, 4, 5) or t in ("clean", "red green"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op6_decontamination", "op8_sharding"])
def test_same_rows_as_sql(spark, name, monkeypatch):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    monkeypatch.setattr(registry, "SHARD_BYTES", 20_000)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(map(repr, cursor.fetchall()))
    got = registry.queries()[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert len(expected) > 2 and sorted(repr(tuple(r)) for r in got) == expected


def test_decontamination_finds_all_that_it_accepts(spark):
    """Items with replaced tokens, by period and at random, against every diagonal tried."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (10, 11, 13, 14, 15, 17, 20, 24, 30, 45)]
    docs = []
    for item in items:
        n = len(item)
        gone = [{k for k in range(n) if k % period == phase} for period in range(2, 9) for phase in range(period)]
        gone += [set(rng.sample(range(n), round(n * part))) for part in (0.1, 0.2, 0.25, 0.3, 0.35, 0.4) for _ in range(4)]
        gone += [set(range(k)) for k in (2, 3, 4)] + [set(range(n - k, n)) for k in (2, 3, 4)]
        for g in gone:
            docs.append([word() for _ in range(rng.randint(0, 6))] + ["zzz" if k in g else w for k, w in enumerate(item)] + [word() for _ in range(rng.randint(0, 6))])
        docs += [item[3:], item[:-3], [w for w in item if rng.random() < 0.5]]

    def leaks_in(doc, item):
        for d in range(-len(item), len(doc)):
            same = [0 <= d + k < len(doc) and doc[d + k] == w for k, w in enumerate(item)]
            run = best = 0
            for x in same:
                run = max(0, run + (1 if x else -2))
                best = max(best, run)
            if sum(same) >= 0.6 * len(item) or best >= 12:
                return True
        return False

    expected = {(i, k) for i, doc in enumerate(docs) for k, item in enumerate(items) if leaks_in(doc, item)}
    rows = lambda texts, name: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], f"{name} long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows(docs, "doc_id"), rows(items, "item_id")).collect()} == expected


def test_large_benchmarks_give_the_same(spark, monkeypatch):
    text = " ".join(f"t{i}" for i in range(30))
    d = spark.createDataFrame([(1, "x " + text), (1, "x " + text), (2, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(5, text)], "item_id long, text string")
    small = decontaminate.leaks(d, b).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert decontaminate.leaks(d, b).collect() == small and small[0].place == 1


def test_sharding(spark):
    rng = random.Random(3)
    docs = [(i, "x" * rng.randint(0, 300)) for i in range(200)] + [(7, "y" * 250)] * 30 + [(500, "z" * 5000), (501, None), (None, "q")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = sharding.shards(rows, 1000).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len(t or "")) for i, t in docs)
    own = {}
    for r in got:
        own.setdefault(r.shard, []).append(r)
    names = sorted(own)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for name, members in own.items():
        size = sum(r.n_bytes for r in members)
        assert (size, len(members), len(name)) == (members[0].shard_bytes, members[0].shard_docs, members[0].shard_depth)
        assert size <= 1000 or len(members) == 1
        if name:  # the bucket that split was oversized
            assert sum(r.n_bytes for r in got if r.shard.startswith(name[:-1])) > 1000
    assert sharding.shards(rows.limit(0), 10).count() == 0
    assert {r.shard for r in sharding.shards(rows, 10**9).collect()} == {""}


def test_chat(spark):
    rng = random.Random(4)
    rows, said = [], {}
    for c in [*range(25), None]:
        turns = []
        for t in range(rng.randint(1, 30)):
            role = "system" if t == 0 and (c or 0) % 2 else ("user", "assistant", "a\\n\nb")[t % 3]
            text = rng.choice(["", "<|im_end|>", "<\\|im_start|>", "a\nb" * rng.randint(1, 40), "é <|x|> \\<|", "word " * rng.randint(1, 80)])
            turns.append((role, text))
            rows.append((c, t, role, text or None, 1))
        said[c] = turns
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int").repartition(3)
    made = chat.windows(d, budget=120, history=40)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    for c, turns in said.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shuffled = {r.conv_id: r for r in chat.digests(made.repartition(7, "window")).collect()}
    assert shuffled == got
    vocab = bpe.vocabulary(bpe.default_path())
    over = history = 0
    for r in made.collect():
        # over the budget only if the one new turn is so with the system turn alone, and then without any history
        turns, _ = chat.read_back(r.formatted, r.spans)
        system = turns[0][0] == "system"
        sizes = [len(vocab.encode_bytes(t)) // 4 for t in re.findall(r"<\|im_start\|>.*?<\|im_end\|>\n", r.formatted, re.DOTALL)]
        assert len(turns) == r.n_turns and sum(sizes) == r.n_tokens
        assert r.n_tokens <= 120 or r.n_turns == 1 + system
        repeated = sum(sizes[system if r.window else 0 : r.n_context])
        assert repeated <= 40
        over, history = over + (r.n_tokens > 120), history + (repeated > 0)
        assert "<|" not in re.sub(r"<\|im_(start|end)\|>", "", r.formatted)
    assert over and history and chat.windows(d.limit(0)).count() == 0


def test_fingerprints(spark):
    docs = [(i, "\n".join(f"line {i if k % 3 else 0} number {k} of the text, and more words here." for k in range(i % 40))) for i in range(30)] + [(40, None), (41, ""), (None, "x y z"), (50, "one\ntwo\nthree"), (51, "one\ntwo\nthree")]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0)))
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        parts = lambda t: set(re.findall(r"[^\n]{80,}?[.!?…]+(?=\s|\Z)|[^\n]+", t))
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = parts(text), parts(other)
            total = sum(map(len, a)) + sum(map(len, b))
            assert near == pytest.approx(1 - sum(map(len, a ^ b)) / total if total else 1.0), (doc, near)
    assert got[50].fingerprint == got[51].fingerprint and got[51].near_next == 1.0


def test_next_documents_over_uneven_ids(spark):
    """Ids far apart and close together, one of them many times; ranges of a few rows."""
    rng = random.Random(6)
    ids = [*range(40), *(rng.randrange(-(1 << 62), 1 << 62) for _ in range(30)), *[7] * 20, None, None]
    docs = [(i, f"text {k}") for k, i in enumerate(ids)]
    hashes = {r.t: r.h for r in spark.createDataFrame(docs, "i long, t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]), reverse=True)
    expected = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r.text: r.next_text for r in fingerprint.with_next(rows, bucket_rows=4).collect()} == expected
    some = fingerprint.bucket_of(F.col("doc_id"), [-5, 0, 3, 3, 9, 100, 1 << 40])
    got = spark.createDataFrame([(x,) for x in (-6, -5, 2, 3, 99, 100, 1 << 41, None)], "doc_id long").select(some).collect()
    assert [r[0] for r in got] == [0, 1, 2, 4, 5, 6, 7, -1]


def test_sketches_that_do_not_peel(spark, monkeypatch):
    """The smallest sketch alone holds no such difference: the digests are compared."""
    monkeypatch.setattr(fingerprint, "LEVELS", 1)
    docs = [(k, "\n".join(f"{k} line {i} of the text" for i in range(200)) + "\nshared by all the texts") for k in range(3)]
    for r in fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert 0 < r.near_next < 0.01 and 0.6 < r.near_edited < 0.7


def test_sketches_that_are_too_small_are_passed_over(spark):
    """The first sketches tried hold the difference, however many texts' parts both have in common, and not with far
    more cells than that takes; they give all of it away, and sketches of both subtracted are the sketch made at once."""
    rng = random.Random(3)
    some = lambda n: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    sets = [(both + some(n), both + some(m)) for n, m in ((0, 0), (1, 0), (2, 3), (20, 20), (0, 90), (150, 140), (900, 900)) for both in (some(0), some(200))]
    width = lambda level: (F.lit(fingerprint.WIDTH) * F.pow(F.lit(fingerprint.GROWTH), level)).cast("long")
    a, b, least = F.col("a"), F.col("b"), F.lit(fingerprint.WIDTH).cast("long")
    rows = spark.createDataFrame(sets, "a array<long>, b array<long>").withColumn("cells", fingerprint.subtracted(fingerprint.sketch(a, least), fingerprint.sketch(b, least)))
    rows = rows.withColumn("level", fingerprint.first_level(a, b, F.col("cells")))
    at_once = fingerprint.sketched_apart(a, b, width(F.col("level")))
    in_two = fingerprint.subtracted(fingerprint.sketch(a, width(F.col("level"))), fingerprint.sketch(b, width(F.col("level"))))
    got = rows.select("a", "b", "level", at_once.alias("x"), in_two.alias("y"), fingerprint.peeled(at_once, width(F.col("level"))).alias("p"), fingerprint.peeled(F.col("cells"), least).alias("q")).collect()
    for r in got:
        apart = set(r.a) ^ set(r.b)
        cells = 3 * fingerprint.WIDTH * fingerprint.GROWTH**r.level
        assert r.x == r.y and not r.p.cells and sorted(r.p.digests) == sorted(apart), len(apart)
        assert r.level == 0 or len(apart) / fingerprint.LOAD / 2 < cells < 2 * fingerprint.GROWTH * len(apart) / fingerprint.LOAD, (len(apart), cells)
        assert r.q.cells if len(apart) > 3 * fingerprint.WIDTH else len(apart) > 5 or set(r.q.digests) == apart


def test_peeling_of_many_digests(spark):
    """Digests found are made distinct by hash: 20,000 took 9 s, and 57 where each was compared with each."""
    width = F.lit(fingerprint.WIDTH * fingerprint.GROWTH**7)
    keys = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.xxhash64(i)).alias("a"))
    began = time.monotonic()
    left, found = keys.select(fingerprint.peeled(fingerprint.sketch(F.col("a"), width), width).alias("p")).select(F.size("p.cells"), F.size("p.digests")).first()
    assert (left, found) == (0, 20_000) and time.monotonic() - began < 30


HTML = [
    ("Hi <b>there</b>, you<p>One<p>Two &amp; three", "Hi there, you\n\nOne\n\nTwo & three"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>kiwi long<td>12</table>end", "Name       Qty\napple      3\nkiwi long  12\n\nend"),
    ("a<div hidden>no</div><div style='display: none'>no</div><script>var a='</p>'</script><!-- x -->b", "ab"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("x<br>y <span> z</span>", "x\ny z"), ("", ""), ("plain < text &copy 5", "plain < text © 5"),
    ("<head><title>t</title></head><body>b</body>", "b"), ("</p></li>x<b>y<p>z", "xy\n\nz"), ("<b>" * 5000 + "deep", "deep"), ("<a title='x", ""),
]


@pytest.mark.parametrize("page, expected", [
    ("<p>a<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> b", "ax=1 b"),
    ("a<svg><title>t</title><defs><text>no</text></defs><circle r=1 /><text>one</text><text>two</text></svg>b", "a\none\ntwo\nb"),
    ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</div><i style='backface-visibility:hidden'>back</i>", "yes\nback"),
    ("<span style='color:red; DISPLAY : none'>no</span><object>fallback</object>", "fallback"),
    ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2<tr><td>c<td>d</table>", "A  b1\n   b2\nc  d"),
    ("<table><tr><td rowspan=0>A<td colspan=2>b<td>x<tr><td>b2<td>c<td>yy</table>", "A  b      x\n   b2  c  yy"),
    (f"<table><tr><td>{'w' * 70}<td>next<tr><td>s<td>t</table>", "w" * 70 + "\n" + " " * 62 + "next\ns" + " " * 61 + "t"),
], ids=range(7))
def test_what_is_visible_and_where(page, expected):
    assert html.page_text(page) == expected


def made_page(rng, words, depth=0, seen=True):
    """A random piece of a page and the words of it that are visible, in order."""
    out, said = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "block", "inline", "hidden", "none", "visible", "list", "raw", "comment"] if depth < 4 else ["text"])
        inner, own = made_page(rng, words, depth + 1, seen if kind not in ("hidden", "visible") else kind == "visible") if kind not in ("text", "raw", "comment") else ("", [])
        if kind == "text":
            own = [f"w{next(words)}" for _ in range(rng.randint(1, 3))]
            out.append(rng.choice([" ", "\n", ""]) + " ".join(own) + " ")
            said += own if seen else []
        elif kind == "raw":
            out.append(rng.choice(["<script>if (a<b) 'x'</script>", "<style>p {}</style>", "<template>no</template>"]))
        elif kind == "comment":
            out.append("<!-- <p>no</p> -->")
        elif kind == "list":
            out.append(f"<ul><li>{inner}<li>end </ul>")
            said += own + (["end"] if seen else [])
        else:
            tag = rng.choice(["div", "section", "blockquote"]) if kind == "block" else rng.choice(["span", "b", "i"])
            style = {"hidden": " style='visibility: hidden'", "visible": ' style="x:y;visibility:visible"', "none": rng.choice([" hidden", " style='display:none'"])}.get(kind, "")
            tag = "div" if kind not in ("block", "inline") or "<" in inner else tag
            out.append(f"<{tag}{style}>{inner}</{tag}>")
            said += [] if kind == "none" else own
    return "".join(out), said


def test_all_visible_text_against_the_pages_maker():
    for seed in range(300):
        rng = random.Random(seed)
        page, said = made_page(rng, itertools.count())
        assert [w for w in html.page_text(page).split() if w != "-"] == said, page


def test_cells_align():
    """Every cell begins where its column does; spans are laid on a grid of their own here."""
    for seed in range(100):
        rng = random.Random(seed)
        n_rows, n_columns, number = rng.randint(1, 5), rng.randint(2, 5), itertools.count()
        grid, page, starts = [[None] * n_columns for _ in range(n_rows)], "<table>", {}
        for r in range(n_rows):
            page += "<tr>"
            for c in range(n_columns):
                if grid[r][c] is not None:
                    continue
                down = rng.randint(1, n_rows - r)
                text = f"c{next(number)}" + "x" * rng.choice([0, 1, 5, 80])
                for k in range(r, r + down):
                    grid[k][c] = text
                page += f"<td rowspan={down}>{text}"
                starts[text] = c
        lines = html.page_text(page + "</table>").split("\n")
        at = {}
        for line in lines:
            for m in re.finditer(r"\S+", line):
                at.setdefault(starts[m[0]], set()).add(m.start())
        assert all(len(places) == 1 for places in at.values()) and sum(len(line.split()) for line in lines) == len(starts), page


def test_html(spark):
    rows = spark.createDataFrame([(i, h, "u") for i, (h, _) in enumerate(HTML)] + [(99, None, "u")], "page_id long, html string, text string")
    got = {r.page_id: r for r in html.extract(rows).collect()}
    for i, (_, expected) in enumerate(HTML):
        assert got[i].text == expected, i
    assert got[99].text == "" and got[0].n_chars == len(HTML[0][1])

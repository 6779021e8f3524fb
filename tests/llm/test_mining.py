"""Main text, phrase collocations and spelling variants against plain versions."""

import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from lastro.llm import collocation, maintext, spelling
from lastro.llm.queries import QUERIES

WEIGHTS = np.array(maintext.PRIOR)


def rows(df):
    return sorted((tuple(r.asDict().items()) for r in df.collect()), key=repr)


# Main text


def test_min_cut_is_the_cheapest_labelling():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(1, 7)
        unary = [rng.randint(-5, 5) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 4)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side, unary=unary, edges=edges):
            ends = sum((-u if s else 0) if u < 0 else (0 if s else u) for u, s in zip(unary, side, strict=True))
            return ends + sum(c for a, b, c in edges if side[a] != side[b]), sum(side)

        assert maintext.min_cut(unary, edges) == list(min(itertools.product([False, True], repeat=n), key=cost))


ARTICLE = "<h1>A title &amp; more</h1><p>First   paragraph,\nwith a <a href='/x'>link</a> inside it.</p><p>Second one&nbsp;is longer, and has some more words in it.</p>"
WANTED = "A title & more\n\nFirst paragraph, with a link inside it.\n\nSecond one is longer, and has some more words in it."
MENU = "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(5))


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><ul>{MENU}</ul></nav><article>{ARTICLE}</article><footer>&copy; all rights</footer>",
        f"<div id=top-menu><ul>{MENU}</ul></div><div class='post-content'>{ARTICLE}</div><div class='sidebar'><p>Other things that one may read here, too.</p></div>",
        f"<header><h2>The site</h2></header><main>{ARTICLE}<form><label>Name</label><input><button>Send</button></form></main><aside><p>An aside. It has a sentence.</p></aside>",
        f"<article><header><h1>A title &amp; more</h1></header>{ARTICLE.partition('</h1>')[2]}</article><section id=comments><article class=comment><p>I don't think that this is so, dear author.</p></article></section>",
        f"<div class='cookie-notice'><p>We use cookies. Do you agree with that, or not at all?</p></div><article>{ARTICLE}<div class='ad'><p>Buy this now, it is very good, we say.</p></div></article>",
        f"<script>var t = '</p><article>';</script><style>p{{}}</style><!-- <article><p>gone</p></article> --><article>{ARTICLE}",
        f"<body class='has-sidebar'><form id=aspnet><nav>{MENU}</nav><main><article>{ARTICLE}</article></main></form></body>",
        f"<div><ul>{MENU}</ul></div><div>{ARTICLE.replace('in it.', 'in it.')}</div><div><ul>{MENU}</ul></div>".replace("Second one", "Second one"),
    ],
)
def test_layouts(page):
    assert maintext.main_text(page, WEIGHTS) == WANTED


def test_references_and_broken_markup():
    text = lambda inner: maintext.main_text(f"<article>{inner}</article>", WEIGHTS)
    assert text("<p>&#65;&#x42;&#0000067; &am &amp &lt;b&gt; 1 < 2 &#99999999999; &notit;") == "ABC &am & <b> 1 < 2 � ¬it;"
    assert text("<p><b>one.<br><p>two<td>x</p>") == "one.\n\ntwo\n\nx"
    assert text("<p>a<b>b</b>c <i>d</i></p><p title='x>y'>e</p>") == "abc d\n\ne"
    assert text("<ul><li>one<li>two</ul>") == "one\n\ntwo"


def test_hostile_pages_end_soon():
    for page in ("<" * 300_000, "<a " * 100_000, '<a b="' * 100_000, "&#" + "9" * 100_000, "<div>" * 100_000 + "x", "<ul><li>" * 50_000 + "x", "<!--" * 100_000, "<script>" * 100_000, "<p>some words here. " * 30_000, "<a class='" * 50_001):
        began = time.perf_counter()
        maintext.main_text(page, WEIGHTS)
        assert time.perf_counter() - began < 20


def test_main_text_of_odd_tables(spark):
    kind = "page_id long, url string, html string, text string, n_chars string"
    page = f"<article>{ARTICLE}</article>"
    data = [(1, "u", page, "x", "y"), (1, "u", page, None, None), (None, None, page, None, None), (2, "v", None, None, None), (3, "w", "", None, None), (4, "z", "<nav>menu</nav>", None, None)]
    got = maintext.extract(spark.createDataFrame(data, kind))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    n = len(WANTED)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", WANTED, n), (1, "u", WANTED, n), (None, None, WANTED, n), (2, "v", "", 0), (3, "w", "", 0), (4, "z", "", 0)], key=repr)
    assert maintext.extract(spark.createDataFrame([], kind)).count() == 0


def test_fit_is_drawn_to_the_starting_weights():
    assert np.allclose(maintext.fit(np.zeros((0, len(WEIGHTS))), np.zeros(0)), WEIGHTS)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, len(WEIGHTS)))
    true = rng.normal(size=len(WEIGHTS))
    y = (rng.random(5000) < 1 / (1 + np.exp(-x @ true))).astype(float)
    w = maintext.fit(x, y)
    assert np.abs(w - true).max() < np.abs(WEIGHTS - true).max()
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) + maintext.PRIOR_BLOCKS * (w - WEIGHTS)).max() < 1e-4


# Collocations


def plain_collocations(docs, least, inside, most):
    table, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                table.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {k: a for k, a in table.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        if any(o == lang and len(w) > len(words) and 100 * f >= inside * a and any(w[i : i + len(words)] == words for i in range(len(w))) for (o, w), f in found.items()):
            continue
        cuts = [(2000000 * a // (table[lang, words[:k]] + table[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, table[lang, words[:k]], table[lang, words[k:]], totals[lang], score))
    result = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        result += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(result)


COLLOCATION_KIND = "doc_id long, text string, lang string, phrase string, f string, size string"


def collocation_docs():
    rng = random.Random(3)
    words = ["the", "The", "a", "été", "x y", "ZÜ", "日本", "b-c", "q", "𝄞"]
    marks = [" ", "  ", "\t", " ", " ", ", ", ". ", "\n", "\x0b", " ! "]
    docs = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    docs += [("en", "a a a a a a a. a a"), ("en", ""), (None, None), ("xx", " . , \t"), ("en", "hot pair " * 500)]
    return docs + docs[:7]


def test_collocations_equal_a_plain_count(spark):
    docs = collocation_docs()
    df = spark.createDataFrame([(i, t, lang, "clash", "clash", "clash") for i, (lang, t) in enumerate(docs)], COLLOCATION_KIND).repartition(5)
    for least, inside, most in ((3, 80, 2000), (6, 50, 5), (10, 100, 2000)):
        got = collocation.collocations(df, least=least, inside=inside, most=most)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain_collocations(docs, least, inside, most)


def test_collocations_of_small_shards_and_parts(spark, monkeypatch):
    """Whatever the shards, parts and automata, the counts are the same."""
    docs = collocation_docs()
    df = spark.createDataFrame([(i, t, lang, None, None, None) for i, (lang, t) in enumerate(docs)], COLLOCATION_KIND).coalesce(1)
    batches = df.select("lang", "text").fillna("und", ["lang"]).filter("text <> ''").toArrow().to_batches(max_chunksize=11)

    def count():
        bits = np.full(collocation.CELLS // 8, 255, np.uint8).tobytes()
        total = Counter()
        for batch in collocation._shards(bits, bits)(iter(batches)):
            for r in batch.to_pylist():
                total[r["lang"], r["size"], r["phrase"]] += r["f"]
        return total

    whole = count()
    monkeypatch.setattr(collocation, "PART", 64)
    monkeypatch.setattr(collocation, "SHARD_WORDS", 300)
    monkeypatch.setattr(collocation, "AUTOMATON_CHARS", 200)
    monkeypatch.setattr(collocation, "HELD_PHRASES", 100)
    assert count() == whole


def test_sketch_bounds_are_upper_bounds(spark):
    docs = spark.createDataFrame([("en", "x y z " * 20)] * 40, "lang string, text string").repartition(8)
    pairs = collocation.upper_bounds(docs, 30)
    longer = collocation.upper_bounds(docs, 30, pairs)
    own = collocation._hashes("en", ["x", "y", "z"])
    for n, packed in ((1, pairs), (2, pairs), (3, longer), (4, longer)):
        bits = np.frombuffer(packed, np.uint8)
        assert collocation._frequent(bits, collocation._cells(np.tile(own, 3), n)).all() and np.unpackbits(bits).sum() <= 6


def test_collocations_of_an_empty_table(spark):
    assert collocation.collocations(spark.createDataFrame([], COLLOCATION_KIND)).count() == 0
    assert collocation.collocations(spark.createDataFrame([(1, None, None, None, None, None)], COLLOCATION_KIND)).count() == 0


# Spelling


def plain_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(docs, shortest=5, least=3, ratio=2):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near = {w: [v for v in n if plain_near(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), c, len(near[w]), None if form[w] is None else n[form[w]]) for w, c in n.items()), key=repr)


SPELLING_KIND = "doc_id long, text string, word string, n string, id string"


def spelling_docs():
    rng = random.Random(9)
    base = ["abcde", "abcdf", "abcd", "aabcde", "aaaaa", "aaaaaa", "aaaab", "éàüöß", "éàüöñ", "ÀÉÎÕÜ", "abcdex", "abdce", "bcdef", "xbcdef", "xybcdef", "xyzbcdef", "words×x"]
    docs = []
    for i in range(60):
        docs.append((rng.choice([i, i, None]), " ".join(rng.choice(base[: rng.randint(1, len(base))]) for _ in range(rng.randint(0, 80)))))
    chain = [("chainaa", 3), ("chainab", 7), ("chaincb", 15), ("chaincd", 31), ("chainecd", 70)]
    docs += [(1000 + k, f"{w} " * n) for k, (w, n) in enumerate(chain)]
    docs += [(None, None), (5, ""), (6, "1234 5678"), (7, "q" * 30_000 + " " + "q" * 30_001), (8, ("q" * 30_000 + " ") * 3), (9, ("Q" * 30_001 + ",") * 9)]
    return docs + docs[:9]


def test_variants_equal_a_plain_search(spark):
    docs = spelling_docs()
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in docs], SPELLING_KIND).repartition(4)
    for least, ratio in ((3, 2), (1, 1.5), (2, 3)):
        got = spelling.group_variants(df, least=least, ratio=ratio)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain_variants(docs, least=least, ratio=ratio)


def test_variants_of_an_empty_table(spark):
    assert spelling.group_variants(spark.createDataFrame([], SPELLING_KIND)).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, None, None, None, None)], SPELLING_KIND)).count() == 0


def test_deletion_keys_are_those_of_equal_strings():
    from lastro.llm.common import RollingHash

    words = ["abcde", "bcde", "aab", "ab", "éa", "a", "𝄞bc", "bc"]
    rolling = RollingHash(12345)
    keys = [set(k.tolist()) for k in spelling.deletion_keys(words, rolling)]
    strings = [{w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for w in words]
    assert [len(k) for k in keys] == [len(s) for s in strings]
    for i, j in itertools.combinations(range(len(words)), 2):
        assert len(keys[i] & keys[j]) == len(strings[i] & strings[j])


def test_queries_are_registered():
    assert {"op11_maintext", "op12_collocations", "op13_spelling"} <= QUERIES.keys()

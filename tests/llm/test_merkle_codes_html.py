"""Manifest, vector codes and page extraction against brute force and on unusual input."""

import hashlib
import math
import random
import re
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import codes, main_text, merkle, queries
from tidewatch.llm.dom import joined, read
from tidewatch.llm.layouts import layout, material

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOC = "doc_id long, text string, lang string, source string, n_chars long, grp string, place int, block int, digest string, claim string, total int, id int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- manifest -----------------------------------------------------------------------------------------------------


def leaf(doc_id, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fan):
    """Levels of a tree from its leaves on."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + fan])) for k in range(0, len(out[-1]), fan)])
    return out


def path(levels, at, fan):
    """Siblings before and after, level by level."""
    out = []
    for level in levels[:-1]:
        k = at // fan * fan
        out.append(("".join(level[k:at]), "".join(level[at + 1 : k + fan])))
        at //= fan
    return out


def brute_manifest(rows, fan):
    """{(doc_id, leaf, subroot, root, proof, folded)} with multiplicity, as a sorted list."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    key = lambda s: (s is not None, (s or "").encode())
    trees, names = {}, sorted(groups, key=key)
    for g in names:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1])), r) for r in groups[g])
        trees[g] = ([r for _, r in own], tree([k[2] for k, _ in own], fan))
    top = tree([trees[g][1][-1][0] for g in names], fan)
    out = []
    for at, g in enumerate(names):
        for k, r in enumerate(trees[g][0]):
            levels = trees[g][1]
            steps = path(levels, k, fan) + path(top, at, fan)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r[0], r[3], r[2], r[4], r[1].translate(UPPER) if hit and r[1] is not None else r[1])
            for a, b in steps:
                node = H(a + node + b)
            out.append((r[0], levels[0][k], levels[-1][0], top[-1][0], H("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))


def doc_rows():
    r = random.Random(3)
    rows = [(i, f"Text {i} Ä", "de", "hot", 7) for i in range(300)]
    rows += [(r.randrange(900), r.choice([None, "", "ABC def", "é" * 40]), r.choice([None, "en"]), f"s{k % 23}", None) for k in range(160)]
    rows += [(5, "Same", "x", "twice", 1)] * 40 + [(None, "No Id", None, None, 3), (None, None, None, None, None), (7, "lone", "a", "", 2), (0, "Z" * 30000, "a", "ä", 2)]
    return rows


def doc_frame(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, 2, "d", "c", 3, 4) for r in rows], DOC).repartition(7)


class Fake:
    """A stand-in for ``table``: the same frame for any folder."""

    def __init__(self, **frames):
        self.frames = frames

    def __call__(self, spark, sf, name):
        return self.frames[name]


def manifest_of(spark, monkeypatch, frame, fan=16, step=3):
    real = merkle.manifest
    with monkeypatch.context() as m:
        m.setattr(queries, "table", Fake(documents=frame))
        m.setattr(merkle, "manifest", lambda *a, **k: real(*a, **k, fanout=fan, step=step))
        got = queries.QUERIES["op11_merkle_manifest"](spark, "").collect()
    return sorted((tuple(r) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))


@pytest.mark.parametrize("fan,step", [(16, 3), (2, 2), (3, 1)])
def test_manifest(spark, monkeypatch, fan, step):
    """Trees of several steps as well as those of one block."""
    rows = doc_rows()
    got = manifest_of(spark, monkeypatch, doc_frame(spark, rows), fan, step)
    want = brute_manifest(rows, fan)
    assert got == want
    assert any(not r[6] for r in got) and sum(r[6] for r in got) > 300


def test_manifest_small(spark, monkeypatch):
    assert manifest_of(spark, monkeypatch, doc_frame(spark, []).limit(0)) == []
    one = [(5, None, None, None, None)]
    assert manifest_of(spark, monkeypatch, doc_frame(spark, one)) == brute_manifest(one, 16)
    lone = [(k, "T", None, f"s{k}", 1) for k in range(20)]  # groups of one leaf
    assert manifest_of(spark, monkeypatch, doc_frame(spark, lone)) == brute_manifest(lone, 16)


def test_witnesses_fold_to_the_root(spark):
    made = merkle.manifest(doc_frame(spark, doc_rows()), fanout=3, step=2)
    for r in made.witnesses().collect():
        node = r["digest"]
        for a, b in zip(r["before"], r["after"], strict=True):
            node = H(a + node + b)
        assert node == made.root
    assert merkle.manifest(doc_frame(spark, []).limit(0)).root is None


# --- codes --------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(v, e, label) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = max(1, -(-max((len(e) for _, e, _ in kept), default=0) // parts))
    whole = [[math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in e] + [0] * (parts * width - len(e)) for _, e, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    piece = lambda v, p: v[p * width : (p + 1) * width]
    books = [[piece(whole[k], p) for k in order[:entries]] for p in range(parts)]

    def near(p, v):
        far = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in books[p]]
        return min(range(len(far)), key=lambda k: (far[k], k)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in whole:
                got.setdefault(near(p, piece(v, p))[0], []).append(piece(v, p))
            for e, vs in got.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out, total = [], {}
    for (vec, _, label), v in zip(kept, whole, strict=True):
        best = [near(p, piece(v, p)) for p in range(parts)]
        out.append((vec, "".join(f"{e:02x}" for e, _ in best), sum(d for _, d in best), label))
        total[label] = total.get(label, 0) + out[-1][2]
    fit = lambda n: n if n < 1 << 63 else None
    sha = H(",".join(str(x) for p in books for e in p for x in e))
    return sorted(((a, b, fit(c), fit(total[d]), sha) for a, b, c, d in out), key=str)


VEC = "vec_id long, embedding array<double>, label int, own binary, far binary, code string, error long, salt int, piece int, `of` int"


def vec_frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, 1, 2, 3) for r in rows], VEC).repartition(5)


def codes_of(spark, monkeypatch, rows):
    monkeypatch.setattr(queries, "table", Fake(embeddings=vec_frame(spark, rows)))
    return sorted((tuple(r) for r in queries.QUERIES["op12_vector_codes"](spark, "").collect()), key=str)


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    return [(int(k), [float(x) for x in r.normal(size=dim).round(1 if k % 3 else 2)], [0, 0, 0, 1, None][k % 5]) for k in r.permutation(n)]


def test_codes(spark, monkeypatch):
    rows = vectors(260, 32, 1)
    rows += [(9000, None, 0), (9001, [None] * 32, 0), (9002, [float("nan")] * 32, 1), (9003, [float("inf")] * 32, 1), (9004, [], 1), (9005, [1.0] * 20, None), (9006, [-0.5] * 32, 0)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 1), (None, rows[3][1], 0)]
    got = codes_of(spark, monkeypatch, rows)
    assert got == brute_codes(rows) and len(got) == 267


def test_codes_beyond_64_bits(spark, monkeypatch):
    rows = vectors(90, 16, 2) + [(1000, [1e300] * 16, 0), (1001, [-1e300] * 16, 1), (1002, [3e18] * 16, 1), (3000, [2.0**31] * 16, 7)]
    got = codes_of(spark, monkeypatch, rows)
    assert got == brute_codes(rows)
    assert any(r[2] is None for r in got)


def test_codes_few_rows(spark, monkeypatch):
    for rows in ([], vectors(3, 16, 3), vectors(64, 1, 4)):
        assert codes_of(spark, monkeypatch, rows) == brute_codes(rows)


def test_active_entries_equal_a_whole_scan():
    r = np.random.default_rng(5)
    rows = r.integers(-6, 7, (400, 3))
    books = r.integers(-6, 7, (30, 3))
    own, least = codes.nearest(rows, books)
    for _ in range(6):
        after = books.copy()
        moved = np.sort(r.choice(30, 7, replace=False))
        after[moved] += r.integers(-2, 3, (7, 3))
        moved = np.flatnonzero((after != books).any(1))
        own, least = codes.reassign(rows, after, moved, own, least)
        want = codes.nearest(rows, after)
        assert (own == want[0]).all() and (least == want[1]).all()
        books = after


# --- pages --------------------------------------------------------------------------------------------------------

P = "The committee met on Tuesday, and after a long debate agreed to publish the report in full. Members said it would help."
Q = "Short one."
R = "Researchers found that the effect was larger than expected, although they warned that more data, over several years, are needed."
C = "I totally disagree with this, the author has no idea what they are talking about, and it shows in every paragraph."
CASES = {
    "semantic": (
        f'<html><body><header><h1>Site</h1><nav><a href=/>Home</a><a href=/n>News</a></nav></header><div class="cookie-banner"><p>We use cookies to improve your experience, read our policy for details.</p><button>OK</button></div>'
        f'<main><article><h1>Title here</h1><p>{P}</p><aside class="ad">Buy now the best, cheap shoes.</aside><p>{Q}</p><p>{R}</p></article><section class="comments"><h2>Comments</h2><div class="comment"><p>{C}</p></div></section></main>'
        f'<aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></aside><footer><p>Copyright 2024 Site. All rights reserved.</p></footer></body></html>',
        f"Title here {P} {Q} {R}",
    ),
    "divs": (
        f'<div id="header"><div class="logo">Site</div><ul class="menu"><li><a href=/>Home</a></li></ul></div><div id="content"><h1>Title here</h1><p>{P}</p><p>{Q}</p><p>{R}</p></div>'
        f'<div id="sidebar"><p>{R}</p></div><div id="comments"><p>{C}</p></div><div id="footer">Copyright 2024</div>',
        f"Title here {P} {Q} {R}",
    ),
    "inside": (
        f'<body><article><h1>T</h1><p>{P}</p><form class="newsletter"><label>Sign up</label><input type=email><button>Go</button></form><p>{R}</p><div id="comments"><h3>3 comments</h3><ol><li><b>bob</b> {C}</li><li>{C}</li></ol></div></article></body>',
        f"T {P} {R}",
    ),
    "table": (f'<table><tr><td class="menu"><a href=1>Home</a><br><a href=2>About</a></td><td class="main"><h2>T</h2><p>{P}</p><p>{R}</p></td><td class=right><p>Ad: buy</p></td></tr></table>', f"T {P} {R}"),
    "entities": ("<article><p>Fish &amp; chips &lt;b&gt; caf&eacute;&nbsp;x &#8212; &#x41;</p><p>a<b>b</b>c  \n d<br>e</p></article>", "Fish & chips <b> café x — A abc d e"),
    "content": (f"<article><h1>T</h1><p>{P}</p><table><tr><th>Year</th><td>2001</td></tr></table><figure><img src=x><figcaption>A photo.</figcaption></figure><blockquote>{R}</blockquote><pre>x = 1</pre></article>", f"T {P} Year 2001 A photo. {R} x = 1"),
    "no article": ("<html><body><nav><a href=/>x</a></nav></body></html>", ""),
    "text alone": (f"{P} {R}", f"{P} {R}"),
    "null": (None, ""),
    "empty": ("", ""),
    "blank": (" \n", ""),
}


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model(given):
    return main_text.train(given)


def test_given_pages(spark, given):
    """The registered query on given pages: exactly the text of the article element."""
    pages = {r["page_id"]: r for r in given.collect()}
    got = queries.QUERIES["op13_html_extraction"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S).group(1)
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))
        assert r["text"] == " ".join(unescape(inner).split())
        assert (r["url"], r["n_chars"]) == (pages[r["page_id"]]["url"], len(r["text"]))


def test_layouts_not_seen(model, given):
    """Most words right on layouts of another seed, set from other pages than the model's."""
    rng = random.Random(99)
    words = material([read(r["html"]) for r in given.orderBy(F.desc("page_id")).limit(60).collect()])
    both = found = wanted = exact = 0
    for _ in range(200):
        h = layout(words, rng, "data-y")
        page = read(h)
        want = joined(page, [s == main_text.ARTICLE for s in main_text._states(page)])
        got = main_text.extract_pages([re.sub(r' data-y="[01]"', "", h)], model)[0]
        a, b = want.split(), got.split()
        both += len(set(a) & set(b))
        found, wanted, exact = found + len(set(b)), wanted + len(set(a)), exact + (want == got)
    assert both / found > 0.95 and both / wanted > 0.95 and exact > 150


def test_page_cases(spark, model):
    rows = [(k, "u", h, "x", 1, "t") for k, (h, _) in enumerate(CASES.values())] + [(None, None, "<p>x", "x", 1, "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, `#text` string, n_chars int, text string")
    got = {r["page_id"]: r["text"] for r in main_text.extract(frame, model).collect()}
    assert {n: got[k] for k, n in enumerate(CASES)} == {n: w for n, (_, w) in CASES.items()}
    assert main_text.extract(frame.limit(0), model).count() == 0


def test_model_without_pages(spark):
    frame = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    assert main_text.extract(frame, main_text.train(frame, layouts=60)).first()["text"] == ""


def test_odd_pages(model):
    """Deep, long, cut off and misplaced markup is read in one pass."""
    texts = ["<div>" * 20000 + "x", "<p>" + "word, " * 300000, "<" * 50000, "<a " * 20000, '<a href="' * 5000, "<!--" * 9000, "<p>a<p class='", "</div></p>a</b>", "<script>" + "<p>" * 9000, "<b>" * 20000 + "y"]
    out = main_text.extract_pages(texts, model)
    assert len(out) == len(texts) and out[6] in ("a", "") and len(out[1].split()) in (0, 300000)


def test_reading():
    text = lambda h: joined(p := read(h), [True] * len(p.tag))
    assert text("<ul><li>a<li>b</ul>c") == "a b c"
    assert text("<style>x{}</style>a<script>'<p>'</script>b<!-- c -->d") == "abd"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>d") == "a b c d"
    assert text("<p>a<textarea><p>x</textarea><select><option>y</select>b") == "ab"
    assert text("<h1>a</h2>b") == "a b" and text("a &amp b &notanentity; &#65") == "a & b ¬anentity; A"
    assert text("<a href='x>y'>z</a><br/>w < v") == "z w < v"

import base64
import hashlib
import math
import pathlib
import random
import statistics
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import bpe, chat, fingerprint, html, language, licenses, packing, toxicity
from codeloom.llm.license_texts import KNOWN, MIT

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(open(PATH, "rb").read()), public_tokenizers.PATTERN, memory=500)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- packing

def brute_best_fit(lengths, capacities):
    """The same rule by searching all bins."""
    bins, rest = [], sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = [b for b in bins if b["cap"] - b["used"] >= n]
        if fits:
            b = min(fits, key=lambda b: b["cap"] - b["used"])
        else:
            b = {"cap": min((c for c in capacities if c >= n), key=lambda c: (packing.bin_cost(c) / min(c, rest), c)), "used": 0}
            bins.append(b)
        b["used"] += n
        rest -= n
    return sorted((b["used"], min(c for c in capacities if c >= b["used"])) for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_is_best_fit(lengths):
    caps = (8, 16, 64)
    bins, offsets, final = packing.pack_shard(lengths, caps)
    used = [0] * len(final)
    spans = {}
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        used[b] += n
        spans.setdefault(b, []).append((o, o + n))
    assert all(u <= c for u, c in zip(used, final, strict=True))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(x[1] == y[0] for x, y in zip(s, s[1:], strict=False))
    assert sorted(zip(used, final, strict=True)) == brute_best_fit(lengths, caps)


BIG = 2**53 + 1


def test_packing_edges(spark):
    """Null ids beside ids that no double holds, null and empty tokens, repeated rows, extra columns, an empty table."""
    rows = [(1, []), (2, [7] * 5), (2, [7] * 5), (3, list(range(40))), (None, [1, 2, 3]), (4, None), (BIG, [5, 6]), (BIG + 2, [8])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, ids array<int>, shard string, bin_id int")
    out = packing.pack(df, F.col("doc_id"), packing.encoded(F.col("ids")), capacities=(8, 16)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in out) == sorted((i is None, i or 0, n) for i, t in rows for n in ([16, 16, 8] if i == 3 else [len(t or [])]))
    assert all((r.bin_id is None) == (r.n_tokens == 0) and len(r.token_ids) == r.n_tokens for r in out)
    whole = sorted((r for r in out if r.doc_id == 3), key=lambda r: r.piece)
    assert [x for r in whole for x in r.token_ids] == list(range(40)) and [r.start for r in whole] == [0, 16, 32]
    bins = {}
    for r in out:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        ends = [0]
        for r in members:
            assert r.bin_offset == ends[-1]
            ends.append(r.bin_offset + r.n_tokens)
        assert ends[-1] == members[0].bin_used <= members[0].bin_capacity and members[0].bin_capacity == min(c for c in (8, 16) if c >= ends[-1])
    assert sorted((b[0].bin_used, b[0].bin_capacity) for b in bins.values()) == brute_best_fit([5, 5, 16, 16, 8, 3, 2, 1], (8, 16))
    assert packing.pack(df.limit(0), F.col("doc_id"), packing.encoded(F.col("ids"))).count() == 0


def test_tokens_equal_the_library(spark, library):
    texts = ["Über alles", "", None, "x" * 5000, "a" + " " * 5000 + "b", "\n" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.t for r in df.select("k", packing.tokens(spark, F.col("text"), PATH, public_tokenizers.PATTERN).alias("t")).collect()}
    assert {k: None if t is None else np.frombuffer(t, "<i4").tolist() for k, t in got.items()} == {k: None if t is None else library.encode_ordinary(t) for k, t in enumerate(texts)}


# --- licences

def test_licences(spark):
    varied = "MIT Licence\n\nCopyright (c) 2020 Somebody\nAll rights reserved.\n" + MIT.replace('"Software"', "'software'").replace("\n\n", "\n").replace("permission", "PERMISSION")
    docs = [(1, varied), (2, MIT + " more"), (3, None), (4, ""), (5, "text\n  Released under the MIT License.\nmore\nLicensed under CC BY-NC 4.0!"), (1, varied)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("notices", F.lit(1))
    got = {(r.doc_id, r.license_id, r.notices, r.n_notice_lines) for r in licenses.scan(df).collect()}
    assert got == {(1, "MIT", "", 0), (2, None, "", 0), (3, None, "", 0), (4, None, "", 0), (5, None, "CC-BY-NC-4.0,MIT", 2)}
    assert licenses.scan(df).count() == 6 and licenses.scan(df.limit(0)).count() == 0
    assert len(licenses.digests()) == len({licenses.canonical(t) for _, t in KNOWN})
    with pytest.raises(ValueError):
        licenses.digests([("A", "same"), ("B", "SAME")])


def test_licence_digests_agree_between_python_and_columns(spark):
    texts = [(n, t) for n, t in KNOWN]
    got = licenses.scan(spark.createDataFrame(texts, "name string, text string")).collect()
    assert all(r["license_id"] == r["name"] for r in got)


def test_whole_licences(spark):
    """Whole texts of longer licences are known by their digests, with another holder and layout too."""
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "GPL-2": "GPL-2.0"}
    if not (folder / "GPL-3").exists():
        pytest.skip("no licence texts on this machine")
    docs = [(name, " \n" + (folder / f).read_text().replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Some Body").replace("\n", "\n   ").upper()) for f, name in names.items()]
    got = licenses.scan(spark.createDataFrame([*docs, ("none", docs[0][1] + " and more")], "name string, text string")).collect()
    assert {r["name"]: r["license_id"] for r in got} == {n: n for n in names.values()} | {"none": None}


# --- toxicity

def test_long_runs_are_linear():
    for text in ("1 " + "abcdefghij" * 100_000, "a1" * 500_000, "x" * 1_000_000, "!" * 1_000_000):
        began = time.perf_counter()
        toxicity.features(text, toxicity.Lexicon())
        assert time.perf_counter() - began < 3
    assert toxicity.disguised("You 1d10t! f*ck 12 ab! " + "w0" * 50) == ["1d10t", "f*ck", "w0" * 50]


def brute_raw(m, row):
    """One row down every tree."""
    total = m.base
    for splits, leaves in m.trees:
        node = 0
        for level in splits:
            feature, cut = level[node]
            node = 2 * node + int(sum(e < row[feature] for e in m.edges[feature]) > cut)
        total += leaves[node]
    return total


def test_features_and_trees():
    lex = toxicity.lexicon_of([("qwxa", 9, 0), ("zork*", 8, 0), ("the", 9, 90)], 10, 100)
    assert "qwxa" in lex.words and "zork" in lex.prefixes and "the" not in lex.words
    names = toxicity.FEATURES
    f = dict(zip(names, toxicity.features("You 1d10t QWXA zorking!!", lex), strict=True))
    assert f["terms"] == 1 and f["prefixes"] == 1 and f["obfuscated"] == 1 and f["exclaim"] > 0 and f["nearest"] > 0
    assert len(toxicity.features(None, lex)) == len(toxicity.features("", lex)) == len(names)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = toxicity.Boosted(rounds=40).fit(x[:400], y[:400])
    assert ((m.raw(x[400:]) > 0) == y[400:]).mean() > 0.9
    assert np.allclose(m.raw(x[400:]), [brute_raw(m, r) for r in x[400:]])
    xs, ys = toxicity.isotonic(m.raw(x[400:]), y[400:])
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


@given(st.lists(st.integers(0, 3000), max_size=400), st.lists(st.integers(0, 3000), max_size=400))
@settings(max_examples=50, deadline=None)
def test_nearest_is_exact(a, b):
    a, b = sorted(set(a)), sorted(set(b))
    assert toxicity.nearest(a, b) == min((abs(x - y) for x in a for y in b), default=-1)


def test_nearest_pair_late_in_a_long_text():
    """The pair that counts comes after thousands of insults and thousands of second-person words."""
    text = "idiot " * 5000 + "word " * 50 + "you " * 5000 + "word " * 50 + "you idiot"
    f = dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity.Lexicon()), strict=True))
    assert f["nearest"] == 1 / 2


def test_toxicity_learns_and_scores_held_out(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    rows = []
    for i in range(700):
        bad = i % 5 == 0
        words = [word() for _ in range(30)]
        if bad:
            words[3:6] = ["you", "vexpol" + word(), "grubnak"]
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "key long, text string, toxic int")
    model = toxicity.fit(df.where("key < 500"))
    got = df.where("key >= 500").select("toxic", toxicity.score(model, F.col("text")).alias("s")).toPandas()
    assert ((got.s >= 0.5) == (got.toxic == 1)).mean() > 0.97 and got.s.between(0, 1).all()
    odd = spark.createDataFrame([(None,), ("",), ("x" * 50_000,)], "text string").select(toxicity.score(model, F.col("text")).alias("s")).toPandas()
    assert odd.s.between(0, 1).all()
    empty = toxicity.fit(df.limit(0))
    assert 0 <= empty(["a"])[0] <= 1
    # repeated rows, rows without label or key, and extra columns change nothing
    more = df.unionByName(df).unionByName(spark.createDataFrame([(None, "you grubnak", 1), (900, "you grubnak", None)], df.schema)).withColumn("u", F.lit("clash")).withColumn("score", F.lit(1))
    again = toxicity.fit(more.where("key is null or key < 500 or key = 900"))
    texts = [r[1] for r in rows[500:]]
    assert again(texts).tolist() == model(texts).tolist()
    assert df.limit(0).select(toxicity.score(model, F.col("text"))).count() == 0
    # a third of the rows under one id, each with another text: one document
    hot = df.unionByName(spark.createDataFrame([(3, f"plain words {k}", 0) for k in range(350)], df.schema))
    assert toxicity.fit(hot)(["you grubnak vexpolbada " * 3])[0] > 0.5


# --- fingerprints

def brute_sketch(text, k=fingerprint.K):
    h = fingerprint.kmers(text).tolist()
    out = []
    for f in range(fingerprint.TUPLES):
        v = [((x ^ int(fingerprint.XOR[f])) * int(fingerprint.MUL[f])) & 0xFFFFFFFF for x in h]
        at = sorted(sorted(range(len(v)), key=lambda i: (v[i], i))[: fingerprint.TUPLE])
        out.append([h[i] for i in at])
    return out


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcé ", max_size=40), st.text(alphabet="abcé ", max_size=40))
def test_sketches_agree_as_tuples_do(a, b):
    x, y = fingerprint.sketch(a), fingerprint.sketch(b)
    if a and b:
        same = [p == q for p, q in zip(brute_sketch(a), brute_sketch(b), strict=True)]
        assert (x == y).tolist() == same
    assert (fingerprint.sketch(a) == x).all()


def test_order_matters_and_occurrences_count():
    words = [f"w{i}xyz" for i in range(60)]
    a, b = " ".join(words), " ".join(reversed(words))
    assert fingerprint.likeness(fingerprint.sketch(a), fingerprint.sketch(a[:-1])) > 0.8
    assert fingerprint.likeness(fingerprint.sketch(a), fingerprint.sketch(b)) < 0.4
    assert len(set(fingerprint.kmers("aaaaaaaaaaaa").tolist())) == 7


def brute_next(rows):
    """(id, text) of each row with the fingerprints of its edited text and of the next: ids fall, null last."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + u[:half]
        a, b, c = (fingerprint.sketch(x) for x in (t, changed, u))
        same = lambda x, y: sum(p == q for p, q in zip(x.tolist(), y.tolist(), strict=True)) / fingerprint.TUPLES
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), b.astype(">u4").tobytes().hex(), same(a, b), same(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_range", [3, 1000])
def test_next_document(spark, per_range):
    rnd = random.Random(5)
    docs = dict([(rnd.randrange(10**6), "".join(rnd.choice("abc é😀") for _ in range(rnd.randrange(40)))) for _ in range(25)] + [(BIG, "big one abcdef"), (BIG + 1, "big two abcdef"), (-5, ""), (None, "no id abcdef")])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("h", F.lit(None))
    assert sorted(map(tuple, fingerprint.compare_with_next(df, per_range).collect()), key=str) == brute_next(list(docs.items()))


def test_next_document_edges(spark):
    make = lambda rows, *a: fingerprint.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), *a)
    assert make([]).count() == 0
    one = make([(7, "abcdefgh")]).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest() and one.near_next == 1.0
    assert make([(1, "a"), (1, "a"), (None, "b"), (None, None)]).count() == 4
    # a third of the rows are one row: it fills ranges of its own, and its copies follow each other
    hot = [(50, "hot text abcdefghij")] * 120 + [(k, f"document {k} of these") for k in range(100)]
    got = make(hot, 10)
    assert sorted(map(tuple, got.collect()), key=str) == brute_next(hot)


# --- BPE

@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_the_library(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_bpe_matches_and_memory(library, monkeypatch):
    """Matches are those of the pattern's own library on all characters; a word that goes on coming is merged once."""
    import regex

    own, split = regex.compile(public_tokenizers.PATTERN).findall, bpe.splitter(public_tokenizers.PATTERN)
    every = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    for joint in ("", " ", "  ", "a", "'s1"):
        assert split(joint.join(every)) == own(joint.join(every))
    assert split("x 😀𝒜𝟙\u3000 y") == own("x 😀𝒜𝟙\u3000 y")
    for odd in (r"(?i:'S)|\w+", r"[[a-z]--[aeiou]]+", r"a\b|."):
        assert bpe.splitter(odd)("a's b") == regex.compile(odd).findall("a's b")
    merged, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda w, ranks: merged.append(w) or merge(w, ranks))
    codec = bpe.Codec(bpe.read_ranks(open(PATH, "rb").read()), public_tokenizers.PATTERN, memory=10)
    texts = [f" zqxzqxzq{'jkvw'[k % 4] * (k // 4 + 2)} vwkzjqhx" for k in range(60)] + [None, "", "tail 😀"]
    got = [x for t in texts for x in codec.digests([t])]
    want = [library.encode_ordinary(t or "") for t in texts]
    assert got == list(codec.digests(texts)) == [(len(w), hashlib.sha256(",".join(map(str, w)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t, w in zip(texts, want, strict=True)]
    assert merged[: merged.index(b" zqxzqxzq" + b"w" * 16)].count(b" vwkzjqhx") == 1


def test_bpe_long_runs_and_column(spark, codec, library):
    for text in ("a" * 3000, " " * 500 + "x", "ß" * 700, "1" * 999, "<|endoftext|>"):
        assert codec.encode(text) == library.encode_ordinary(text)
    df = spark.createDataFrame([(1, "Über alles, it's 12"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    got = df.select("doc_id", bpe.codec_columns(spark, PATH, public_tokenizers.PATTERN, F.col("text")).alias("c")).select("doc_id", "c.*").collect()
    want = library.encode_ordinary("Über alles, it's 12")
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == len(want) and by[1].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert by[2].n_tokens == 0 and by[2].decoded_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == 4
    odd = df.withColumn("n_tokens", F.lit("clash")).limit(0)
    assert odd.select("n_tokens", bpe.codec_columns(spark, PATH, public_tokenizers.PATTERN, F.col("text")).alias("c")).count() == 0


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert h.find(keys, keys) == list(range(3000)) and sorted(h.key_of.tolist()) == list(range(3000))
    assert set(h.find([b"no%d" % i for i in range(500)], keys)) == {-1}
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


# --- HTML

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph of
 the <b>story</b> goes here and is long enough.<p>Short.</p><script>var x = "</p>";</script><div class="ad">Buy</div><ul><li>point one<li>point two</ul>
<form><input><p>Mail me</p></form><section id="comments"><p>Nice post, says a reader at great length, with many words in it.</p></section></article></main>
<aside><p>Related</p></aside><footer><p>&copy; Site</p></footer></body></html>"""


def test_article():
    assert html.main_text(PAGE) == "Title & more\nFirst paragraph of the story goes here and is long enough.\nShort.\npoint one\npoint two"


def test_no_article_element_and_edges(spark):
    page = "<body><div id='top'><a href=a>One</a> <a href=b>Two</a></div><div id=text><p>" + "Words of the story. " * 20 + "</p><p>End.</p></div><div class=footer>Imprint</div>"
    assert html.main_text(page).splitlines()[-1] == "End." and "One" not in html.main_text(page)
    for odd in ("<", "<p", "&am", "<p>a<br>b</p", "</div></p>", "plain", "<p>x<!-- a"):
        html.main_text(odd)
    assert html.main_text("<p>a<br>b&nbsp;c") == "a b c" and html.main_text(None) == html.main_text("") == ""
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>é</p>"), (3, "<p>é</p>")], "page_id long, html string")
    got = df.select("page_id", html.extract(F.col("html")).alias("m")).select("page_id", "m.*").collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "", 0), (2, "", 0), (3, "é", 1), (3, "é", 1)]


def test_marks_and_missing_ends():
    """Ends of elements that were left out, comments as articles, adverts as paragraphs, links among the paragraphs."""
    story = "Story words here. " * 10
    for page, want in (
        ("<html><head><title>T</title><body><article><p>Hello my friend</article>", "Hello my friend"),
        ("<html><head><title>T</title><p>Hello my friend", "Hello my friend"),
        (f"<body><nav><ul><li><a href=a>A</a></ul><div><p>{story}</p><p>More.</p></div>", f"{story.strip()}\nMore."),
        ("<body><nav><a href=a>A</a><article><p>Hello world text</p></article>", "Hello world text"),
        ("<article><p>Story text here.</p><article class=comment><p>Nice post, I like it a lot</p></article><p class=advert>Buy</p></article>", "Story text here."),
        (f"<body><p>{story}</p><p><a href=x>A link only</a></p><p>End</p><ul><li><a href=1>m1</a><li><a href=2>m2</a></ul>", f"{story.strip()}\nA link only\nEnd"),
        ("<form id=f><nav><a href=x>X</a></nav><article><p>Text of it</p></article></form>", "Text of it"),
    ):
        assert html.main_text(page) == want


def brute_main_text(page):
    """The same rule without running sums: ancestors by walking up, smoothing and clustering by their formulas."""
    p = html.Blocks()
    p.feed(page)
    p.close()
    p.flush()
    while p.stack:
        p.pop(ended=False)
    up = lambda k: [k, *up(p.parent[k])] if k >= 0 else []
    article = lambda k: p.kind[k] in ("article", "main")
    frame = lambda k: p.kind[k] == "form" and any(article(x) and k in up(x) for x in range(len(p.kind)))
    off = lambda at: any(p.marked[k] and (p.ended[k] or p.kind[k] in html.SILENT) and not frame(k) for k in up(at))
    plain = [0 if off(at) else max(len(t) - n, 0) for t, _, n, at in p.blocks]
    if not p.blocks or all(off(b[3]) for b in p.blocks):
        return ""
    ratio = [n / max(b[1], 1) for n, b in zip(plain, p.blocks, strict=True)]
    reach = 5
    weight = lambda i, j: math.exp(-((i - j) ** 2) / (2 * html.SIGMA**2)) if abs(i - j) <= reach else 0.0
    n = len(ratio)
    score = [sum(weight(i, j) * ratio[j] for j in range(n)) / sum(weight(i, j) for j in range(n)) * plain[i] / len(p.blocks[i][0]) for i in range(n)]
    cut = (min(score) + max(score)) / 2
    for _ in range(50):
        low, high = [v for v in score if v <= cut], [v for v in score if v > cut]
        if low and high:
            cut = (statistics.fmean(low) + statistics.fmean(high)) / 2
    use = [s > cut or s == max(score) for s in score] if max(score) > 0 else [not off(b[3]) for b in p.blocks]
    named = [any(map(article, up(b[3]))) and not off(b[3]) for b in p.blocks]
    outer = lambda k: next((x for x in up(k) if p.kind[x] not in html.LINES), -1)
    link = [b[2] >= 0.8 * len(b[0]) for b in p.blocks]
    sound = {outer(b[3]) for b, u, x in zip(p.blocks, use, link, strict=True) if u or not x}
    menu = [x and not u and not m and not off(b[3]) and outer(b[3]) not in sound for b, u, x, m in zip(p.blocks, use, link, named, strict=True)]
    inside = lambda at, k: k < 0 or k in up(at)
    core = [b[3] for b, u, m in zip(p.blocks, use, named, strict=True) if u or m]
    region = outer(max((k for k in range(len(p.kind)) if all(inside(at, k) for at in core)), default=-1))
    bad = lambda k: sum(inside(b[3], k) for b, m in zip(p.blocks, menu, strict=True) if off(b[3]) or m)
    while region >= 0 and bad(p.parent[region]) == bad(region):
        region = p.parent[region]
    return "\n".join(b[0] for b, u, m in zip(p.blocks, use, menu, strict=True) if (u or not (m or off(b[3]))) and inside(b[3], region))


BITS = ["<nav>", "</nav>", "<div>", "</div>", "<div class=ad>", "<article>", "</article>", "<p>", "</p>", "<ul>", "<li>", "</ul>", "<a href=x>", "</a>", "<h1>", "</h1>", "<br>", "<form>", "</form>", "<main>", "<footer>", "</footer>", "<p class=advert>", "word", "Some words of a story. ", "A far longer run of words, as the text of a page would have it. ", "<section>", "</section>", "<b>", "<script>x</script>", "<head>", "<body>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=60))
def test_regions_equal_brute_force(bits):
    page = "".join(bits)
    assert html.main_text(page) == brute_main_text(page)


def test_clusters_decide(monkeypatch):
    """Without the clustering, or the smoothing, other text comes out."""
    story = "<p>" + "Story words here. " * 10 + "</p>"
    page = f"<body><nav><p>Menu</p></nav><div>{story * 3}</div><div><div>Imprint</div><div>Terms</div></div></body>"
    want = "\n".join(["Story words here. " * 10] * 3).replace(" \n", "\n").strip()
    short = f"<div><div>{story * 3}</div><div><p>An aside of few words</p></div><div><nav>x</nav></div>{story}</div>"
    assert html.main_text(PAGE).startswith("Title") and html.main_text(page).startswith(want)
    whole = html.main_text(short)
    monkeypatch.setattr(html, "choose", lambda scores: [True] * len(scores))
    assert "Menu" in html.main_text(page) and "Menu" in html.main_text(f"<body><nav>Menu</nav>{story}") and "x" in html.main_text(short).split("\n")
    monkeypatch.undo()
    assert html.main_text(short) == whole


def test_html_is_linear(spark):
    for page in ("<div><p>word text here" * 20_000, "<b>x<p>y" * 20_000, "<div>" * 20_000 + "text" + "</span></p></div>" * 20_000, "<h1>x" * 20_000, "<p>" + "word " * 400_000):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 5
    df = spark.createDataFrame([], "page_id long, html string, text string, n_chars long")
    assert df.select("page_id", "text", html.extract(F.col("html")).alias("m")).count() == 0


def test_split_content_is_kept_whole():
    """The region holds every chosen block: sections, sibling articles, a headline outside the article."""
    para = lambda word, n: f"<p>{(word + ' tells the story. ') * 12}</p>" * n
    shell = "<body><nav><p>Menu</p></nav><div><a href=a>Top</a> <a href=b>Login</a></div>{}<footer><p>Imprint</p></footer></body>"
    for body in (
        "<div class=content><section>" + para("Alpha", 7) + "</section><section>" + para("Beta", 3) + "</section></div>",
        "<article>" + para("Alpha", 6) + "</article><article>" + para("Beta", 4) + "</article>",
        "<div><article>" + para("Alpha", 9) + "</article></div><div><article><p>Beta tells the story. Beta tells the story. </p></article></div>",
        "<main><h1>Beta tells the story.</h1><article>" + para("Alpha", 6) + "</article></main>",
        "<table><tr><td>" + para("Alpha", 8) + "</td><td>" + para("Beta", 2) + "</td></tr></table>",
    ):
        got = html.main_text(shell.format(body))
        assert got.count("Alpha") == body.count("Alpha") and got.count("Beta") == body.count("Beta")
        assert not any(w in got for w in ("Menu", "Top", "Login", "Imprint"))


def test_smoothing_and_clusters():
    assert html.smooth([1.0] * 7) == pytest.approx([1.0] * 7)
    assert 2 < html.threshold([1, 1, 2, 9, 10]) < 9


# --- language

def test_language(spark):
    rnd = random.Random(1)
    voc = {"aa": ["kala", "vesi", "puu", "talo"], "bb": ["strom", "wald", "haus", "schiff"]}
    rows = [(i, " ".join(rnd.choice(voc[lang]) + rnd.choice("xyz") for _ in range(40)), lang) for i in range(120) for lang in ("aa" if i % 3 else "bb",)]
    df = spark.createDataFrame(rows, "key long, text string, lang string")
    d = language.fit(df.where("key < 80"))
    assert list(d) == ["aa", "bb"]
    got = df.where("key >= 80").select("lang", language.identify(d, F.col("text")).alias("l")).select("lang", F.col("l.lang").alias("p"), "l.rejected").toPandas()
    assert (got.lang == got.p).mean() == 1 and not got.rejected.any()
    judge = language.Judge(d)
    assert judge(None) == judge("") == judge("12 !!") == ("und", 0.0, True)
    half = judge(rows[0][1] + " " + rows[1][1])
    assert half[0] in d and language.Judge({})("x")[0] == "und"
    assert language.fit(df.limit(0)) == {}


def brute_language(dictionaries, text):
    """Every piece against every dictionary with a compressor of its own."""
    import zstandard

    if not text or not any(c.isalpha() for c in text):
        return "und", True
    data = language.letters(text)
    sizes = []
    for rank, (lang, d) in enumerate(dictionaries.items()):
        total = 0
        for piece in language.pieces(data):
            made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=language.settings(len(d)))
            total += len(made.compress(piece))
        sizes.append((total, rank, lang))
    sizes.sort()
    return sizes[0][2], len(sizes) > 1 and sizes[1][0] - sizes[0][0] <= language.MARGIN * sizes[1][0]


def test_language_equals_brute_force_and_edges(spark):
    rnd = random.Random(8)
    voc = {"aa": ["kala", "vesi", "puu", "talo"], "bb": ["strom", "wald", "haus", "schiff"], "cc": ["o"]}
    rows = [(k, " ".join(rnd.choice(voc[lang]) + rnd.choice("xyz") for _ in range(60)), lang) for k in range(90) for lang in ("aa", "bb")]
    rows += [(7, "o", "cc"), (None, "kalax puuz", "aa"), (8, None, "aa"), (9, "12 34", "dd"), (10, "vesix", None)]
    df = spark.createDataFrame(rows, "key long, text string, lang string").withColumn("share", F.lit("clash")).withColumn("n", F.lit(0))
    d = language.fit(df)
    assert list(d) == ["aa", "bb", "cc"] and min(map(len, d.values())) >= 8  # a language of one letter stays
    # equal rows weigh nothing, a third of the rows included
    hot = df.unionByName(spark.createDataFrame([(None, "kalax puuz", "aa")] * 300, "key long, text string, lang string").withColumn("share", F.lit("")).withColumn("n", F.lit(0)))
    assert len(language.fit(hot)) == 3 and len(language.fit(df, size=200, total=10)) == 3
    texts = [r[1] for r in rows[:12]] + ["kalax strom wald", "", None, "34", "kalax " * 5000]
    got = spark.createDataFrame(list(enumerate(texts * 2)), "k int, text string").select("k", language.identify(d, F.col("text")).alias("l")).collect()
    for r in got:
        assert (r.l.lang, r.l.rejected) == brute_language(d, (texts * 2)[r.k])
    assert df.limit(0).select(language.identify(d, F.col("text"))).count() == 0


@pytest.mark.parametrize("size", [1_000, 20_000, 300_000, 5_000_000])
def test_language_of_long_texts(size):
    """The margin holds at any length: texts of one language are kept, and every byte of them is judged."""
    rnd = random.Random(5)
    shared = ["".join(rnd.choice("aeioubdklmnrst") for _ in range(rnd.randint(3, 8))) for _ in range(2000)]
    voc = {"aa": [w + "ila" for w in shared], "bb": [w + "ung" for w in shared]}
    d = {lang: " ".join(rnd.choices(words, k=9000)).encode() for lang, words in voc.items()}
    judge = language.Judge(d)
    for lang, words in voc.items():
        text = " ".join(rnd.choices(words, k=size // 5))[:size]
        assert len(text) == size
        got = judge(text)
        assert got[0] == lang and not got[2]
    for data in (text.encode(), b"x" * size, b""):
        assert b"".join(language.pieces(data)) == data and max(map(len, language.pieces(data))) <= language.PIECE


# --- chat

def test_preferences(spark):
    t = lambda pair, good, turn, role, text: (pair, good, turn, role, text)
    rows = [t(1, True, 0, "user", "q"), t(1, True, 1, "assistant", "good"), t(1, False, 0, "user", "q"), t(1, False, 1, "assistant", "bad"), t(1, False, 2, "user", "why"), t(2, True, 0, "user", "alone"), t(3, True, 0, "user", "same"), t(3, False, 0, "user", "same"), t(4, True, 0, None, None), t(4, True, 0, None, None), t(4, False, 0, None, None), t(None, True, None, "user", "z"), t(5, True, 0, "user", ""), t(5, False, 0, "user", "long " * 200_000)]
    df = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("fork", F.lit(1))
    seg = chat.preference_segments(df)
    got = {(r.pair_id, r.part, r.turn, r.times, r.loss) for r in seg.collect()}
    assert {(1, "prompt", 0, 1, 0), (1, "chosen", 1, 1, 1), (1, "rejected", 1, 1, 1), (1, "rejected", 2, 1, 0), (2, "chosen", 0, 1, 0), (3, "prompt", 0, 1, 0), (4, "chosen", 0, 2, 0), (4, "rejected", 0, 1, 0), (None, "chosen", None, 1, 0), (5, "chosen", 0, 1, 0), (5, "rejected", 0, 1, 0)} == got
    one = chat.assemble(seg).where("pair_id = 1").first()
    assert one.prompt.count(chat.OPEN) == 1 and "good" in one.chosen and "why" in one.rejected and one.chosen_mask[0].loss == 1
    assert sum(m.length for m in one.rejected_mask) == len(one.rejected)
    assert chat.assemble(seg).where("pair_id = 4").first().chosen.count(chat.OPEN) == 2 and chat.assemble(seg).where("pair_id is null").count() == 0
    assert chat.preference_segments(df.limit(0)).count() == 0


def test_preferences_against_brute_force(spark):
    rnd = random.Random(2)
    convs = {c: [(("user", "assistant")[k % 2], rnd.choice("ab")) for k in range(rnd.randrange(1, 5))] for c in range(40)}
    df = spark.createDataFrame([(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.assemble(chat.preference_segments(chat.neighbours(df))).collect()}
    say = lambda turns: "".join(f"{chat.OPEN}{r}\n{t}{chat.CLOSE}\n" for r, t in turns)
    for p in range(20):
        a, b = convs[2 * p], convs[2 * p + 1]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (got[p].prompt, got[p].chosen, got[p].rejected) == (say(a[:n]), say(a[n:]), say(b[n:]))


# --- batches

def test_batches_hold_few_long_texts(spark, tmp_path):
    """A reader decodes few rows at once, whatever it was set to; a smaller number stays. Arrow batches are bounded too."""
    from codeloom.llm.common import table

    key, arrow = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = [(k, f"{k} " * 50_000, "x" * k) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    was = spark.conf.get(key)
    try:
        for given, left in (("4096", 16), ("5", 5)):
            spark.conf.set(key, given)
            assert sorted(map(tuple, table(spark, str(tmp_path), "documents").collect())) == rows
            assert int(spark.conf.get(key)) == left and int(spark.conf.get(arrow).rstrip("b")) <= 8 << 20
    finally:
        spark.conf.set(key, was)

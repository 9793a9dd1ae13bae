import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import embedding, jaccard
from codeloom.llm.common import components

BIG = 2**53 + 1


def grow(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(900, n) for n in range(901, 950)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == grow(edges, nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_plan_meets_recall():
    bands, rows = jaccard.plan()
    assert bands * rows <= jaccard.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL


def brute_jaccard(docs, threshold=0.8):
    import re

    sets = {}
    for i, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ({("", t.strip(jaccard.BLANK))} if t and t.strip(jaccard.BLANK) else set())
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    n = {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (c, n[i]) for i, c in grow(links, ids).items()}


@pytest.mark.parametrize("tile,few", [(2048, 200_000), (5, 200_000), (5, 0), (1, 200_000)])
def test_jaccard_join(spark, monkeypatch, tile, few):
    """One tile a group; several; texts fetched by a join of both sides; and groups so large that buckets are dealt."""
    monkeypatch.setattr(jaccard, "TILE_MOST", tile)
    monkeypatch.setattr(jaccard, "BOUND_ROWS", few)
    if tile == 1:  # every group of more than two nodes is a large one
        monkeypatch.setattr(jaccard, "tiles_of", lambda m, g, spread: F.when(F.col("grp").isNotNull() if "grp" in str(m) else m > 2, F.lit(2 * jaccard.BANDS + 1)).otherwise(1).cast("int"))
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs, i = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([3, 5, 30, 200]))]
        if rnd.random() < 0.4:
            base += passage
        for _ in range(rnd.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = word()
            docs.append((i, " ".join(copy)))
            i += 1
    docs += [(i + k, x) for k, x in enumerate([None, "", "  ", "!!", "!!", "a b", "A, b", docs[0][1].upper()])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(df).collect()}
    assert got == brute_jaccard(docs)


def test_jaccard_edges(spark):
    make = lambda rows: jaccard.join(spark.createDataFrame(rows, "doc_id long, text string, class_id string, key int, bands int"))
    assert make([]).count() == 0
    x = ("x", 1, 2)
    rows = [(None, "a b c d e f", *x), (3, "a b c d e f", *x), (3, "a b c d e f", *x), (5, None, *x), (BIG, "a b c d e F", *x), (BIG + 2, "!!", *x), (BIG + 3, "!! ", *x), (9, "w " * 300_000, *x)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.class_id, r.n_links, r.kept) for r in make(rows).collect()), key=str)
    want = [(True, 0, None, 0, True), (False, 3, 3, 1, True), (False, 3, 3, 1, True), (False, 5, 5, 0, True), (False, BIG, 3, 1, False), (False, BIG + 2, BIG + 2, 1, True), (False, BIG + 3, BIG + 2, 1, False), (False, 9, 9, 0, True)]
    assert got == sorted(want, key=str)


def test_an_id_with_several_texts(spark):
    """Each text is a document of its own: its links are its own, and it is not lost with the other."""
    rows = [(1, "one two three four five six"), (5, "one two three four five six"), (5, "entirely other words stand in this one"), (7, "entirely other words stand in this one")]
    got = {(r.doc_id, r.class_id, r.n_links, r.kept) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 1, True), (5, 1, 1, False), (5, 5, 1, True), (7, 5, 1, False)}


def test_joins_equal_their_sql(spark):
    """Repeated rows, texts without words and copies, beside the SQL of the queries."""
    import duckdb

    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c, d e f"), (3, "!!"), (4, " !!"), (5, ""), (6, None), (7, "one"), (8, "One.")]
    vecs = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0, 0.01])]
    con = duckdb.connect()
    for name, kind, rows in (("documents", "varchar", docs), ("embeddings", "double[]", vecs)):
        con.execute(f"create table {name} ({'doc_id bigint, text' if name == 'documents' else 'vec_id bigint, embedding'} {kind})")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    got = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(jaccard.SQL).fetchall())
    got = embedding.near_duplicates(spark.createDataFrame(vecs, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(embedding.SQL).fetchall())


def brute_cosine(rows, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    ids = sorted(ok)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = {i: i for i in n} | grow(links, ids)
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


@pytest.mark.parametrize("cell,tile,always", [(8192, 8192, False), (20, 20, False), (20, 20, True)])
def test_embeddings(spark, monkeypatch, cell, tile, always):
    """One cell; tiles; cells even where they spare nothing."""
    monkeypatch.setattr(embedding, "CELL", cell)
    monkeypatch.setattr(embedding, "TILE", tile)
    if always:
        fit = embedding.Cells.fit
        monkeypatch.setattr(embedding.Cells, "fit", staticmethod(lambda units, n, t: fit(units, n, t) or embedding.Cells(units[::10], t)))
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(50):
        base = rng.normal(size=20)
        rows += [base + rng.normal(size=20) * s for s in rng.choice([0.05, 0.3, 0.5], size=rng.integers(1, 6))]
    rows += [rows[0], rows[0] * 7, -rows[0], [1.0] * 3, [2.0] * 3, None, [], [0.0] * 20, [float("nan")] + [1.0] * 19, [float("inf")] * 20, [None] + [1.0] * 19, [1e200] * 20, [1e-200] * 20]
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_cosine([r for r in rows if r[0] < len(rows) - 2])
    want |= {len(rows) - 2: (1, len(rows) - 2, True), len(rows) - 1: (1, len(rows) - 2, False)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(df).collect()} == want


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, kept int, key string, d int"
    x = (0, 0, "k", 1)
    assert embedding.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, *x), (None, [1.0, 0.0], *x), (2, [1.0, 0.0], *x), (2, [1.0, 0.0], *x), (BIG, [3.0, 0.0], *x)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(False, 1, 0, 1, True), (False, 2, 1, 2, True), (False, 2, 1, 2, True), (False, BIG, 1, 2, False)]
    assert [(r.n_links, r.kept) for r in got if r.vec_id is None] == [(0, True)]


def test_many_lengths(spark):
    """Vectors of 1,200 lengths, two of each, which link; no length is left out."""
    rows = [(2 * d + k, [1.0 + k] * d) for d in range(1, 1201) for k in range(2)]
    rows += [(2 * d + k + 10_000, [1.0] + [0.01 * k] * (d - 1)) for d in (40, 1200) for k in range(2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[2 * d] == (1, 2 * d) and got[2 * d + 1] == (1, 2 * d) for d in range(1, 1201)) and got[12_400] == (1, 12_400)

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import filedeps, graph


def brute(n, edges):
    reach = {i: set() for i in range(n)}
    for i in range(n):
        todo = [b for a, b in edges if a == i]
        while todo:
            x = todo.pop()
            if x not in reach[i]:
                reach[i].add(x)
                todo += [b for a, b in edges if a == x]
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 14
    edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(18)}
    name = lambda i: f"n{i:02d}"
    e = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "src string, dst string")
    nodes = spark.createDataFrame([(name(i),) for i in range(n)], "node string")
    reach = brute(n, edges)
    got = {(r["start"], r["node"]) for r in graph.closure(e, nodes.toDF("start")).collect()}
    assert got == {(name(i), name(j)) for i in range(n) for j in reach[i]}
    scc = {r["node"]: r["component"] for r in graph.strong_components(e, nodes).collect()}
    assert scc == {name(i): name(min([j for j in reach[i] if i in reach[j]] + [i])) for i in range(n)}
    batch = {r["node"]: r["batch"] for r in graph.batches(e, nodes).collect()}
    for a, b in edges:
        assert batch[name(a)] > batch[name(b)] or scc[name(a)] == scc[name(b)]
    comp = {r["node"]: r["component"] for r in graph.components(e, nodes).collect()}
    und = brute(n, edges | {(b, a) for a, b in edges})
    assert comp == {name(i): name(min(und[i] | {i})) for i in range(n)}
    rank = {r["node"]: r["rank"] for r in graph.ranks(graph.batches(e, nodes)).collect()}
    assert [k for k, _ in sorted(rank.items(), key=lambda x: x[1])] == sorted(batch, key=lambda k: (batch[k], k))


def test_order_and_cycles():
    order, cycles = graph.dfs_order("abcd", [("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")])
    assert order == ["c", "b", "a", "d"] and cycles == [["b", "c"]]


def test_empty(spark):
    e, nodes = spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "node string")
    assert graph.components(e, nodes).count() == 0 and graph.strong_components(e, nodes).count() == 0


def test_components_of_all_lines(spark, tmp_path):
    """Every line counts, whatever its quantity, and keys are not folded: against union-find."""
    from codeloom.plans import catalog

    rnd = random.Random(4)
    lines = [(k + 2000 * rnd.randrange(4), rnd.randrange(400), rnd.randint(1, 50)) for k in rnd.choices(range(150), k=260)] + [(None, 1, 1), (1, None, 1)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, _ in lines:
        if a is not None and b is not None:
            x, y = sorted((root(f"p{a:019d}"), root(f"s{b:019d}")))
            up[y] = x
    want = {x: root(x) for x in list(up)}
    assert 1 < len(set(want.values())) < len(want) / 2
    got = catalog.QUERIES["components_all_lines"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def brute_groups(nodes, edges):
    """Strong components by reachability from every node, and levels by the longest path among them."""
    to = {n: {b for a, b in edges if a == n and b in nodes} for n in nodes}

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for m in to[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    far = {n: reach(n) for n in nodes}
    group = {n: min([n, *(m for m in far[n] if n in far[m])]) for n in nodes}
    level = {}

    def deep(g):
        if g not in level:
            level[g] = 0
            level[g] = max((deep(group[b]) + 1 for n in nodes if group[n] == g for b in to[n] if group[b] != g), default=0)
        return level[g]

    return {n: (group[n], deep(group[n])) for n in nodes}


@pytest.mark.parametrize("most", [500_000, 5])
def test_groups_and_levels_equal_brute_force(spark, monkeypatch, most):
    """On the driver, and by rounds over tables."""
    monkeypatch.setattr(graph, "DRIVER_EDGES", most)
    rnd = random.Random(3)
    nodes = [f"n{k:02d}" for k in range(18)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(22)] + [("n01", "gone")]
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(edges, "src string, dst string")
    inside = e.join(n.toDF("dst"), "dst", "left_semi").select("src", "dst")
    got = {r.node: (r.component, r.batch) for r in graph.batches(inside, n).collect()}
    assert got == brute_groups(set(nodes), edges)


def test_long_chain_and_ring(spark, monkeypatch):
    """Ten thousand nodes in a row and in a ring: no round for each edge."""
    name = lambda kind, k: f"{kind}{k:05d}"
    chain = [(name("c", k), name("c", k + 1)) for k in range(9_999)]
    ring = [(name("r", k), name("r", (k + 1) % 10_000)) for k in range(10_000)]
    e = spark.createDataFrame(chain + ring, "src string, dst string")
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    made = []
    keep = graph.stash
    monkeypatch.setattr(graph, "stash", lambda df, tag="t": (made.append(tag), keep(df, tag))[1])
    got = graph.components(e, n).groupBy("component").count().collect()
    assert sorted(map(tuple, got)) == [("c00000", 10_000), ("r00000", 10_000)] and made.count("step") <= 20
    b = graph.batches(e, n)
    assert b.where("node like 'r%'").select("component", "batch").distinct().collect() == [("r00000", 0)]
    assert {(r.node, r.batch) for r in b.where("node like 'c%'").collect()} == {(name("c", k), 9_999 - k) for k in range(10_000)}


def test_callers_of_writers_for_each_table(spark):
    writes = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "table_key string, node string")
    reads = spark.createDataFrame([("t", "r")], "table_key string, node string")
    calls = spark.createDataFrame([("x", "a"), ("y", "x"), ("a", "b"), ("x", "y"), ("z", "c")], "src string, dst string")
    got = {tuple(r) for r in graph.table_impact(reads, writes, calls).collect()}
    assert got == {("t", "READER", "r"), ("t", "WRITER", "a"), ("t", "WRITER", "b"), ("u", "WRITER", "c"), ("t", "CALLER", "x"), ("t", "CALLER", "y"), ("u", "CALLER", "z")}


@pytest.mark.parametrize("most", [100, 2])
def test_reading_order_without_a_bound(spark, most):
    """What a file needs comes before it, on the driver and by batches; cycles are reported either way."""
    files = [f"f{k}" for k in range(8)]
    needs = [("f0", "f1"), ("f1", "f2"), ("f3", "f1"), ("f4", "f5"), ("f5", "f4"), ("f6", "f4")]
    nodes = spark.createDataFrame([(f,) for f in files], "file string")
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in needs], "src string, dst string, type string")
    order, cycles = filedeps.reading_order(nodes, edges, most)
    at = {r.file: r.position for r in order.collect()}
    assert sorted(at.values()) == list(range(1, 9)) and all(at[b] < at[a] for a, b in needs if {a, b} != {"f4", "f5"})
    assert [set(r.members) for r in cycles.collect()] == [{"f4", "f5"}]
    use = spark.createDataFrame([("f0", "k", True), ("f1", "k", False), ("f2", "k", False), ("f0", "m", False), ("f1", "m", False)], "file string, key string, w boolean")
    assert {r.file: r["count"] for r in filedeps.shared_with(use, "f1").collect()} == {"f0": 1}


def test_large_graph_stays_off_the_driver(spark, monkeypatch):
    """A graph beyond the bound is counted, and no row of it collected."""
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(7)], "node string")
    assert graph._held(edges, nodes)["n0"] == ["n1"]
    rows = []
    monkeypatch.setattr(type(edges), "collect", lambda self: rows.append(self) or [])
    monkeypatch.setattr(graph, "DRIVER_EDGES", 6)
    assert graph._held(edges, nodes) is None and not rows

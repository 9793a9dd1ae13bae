"""Graphs as edge tables (src, dst): closure, strongly connected groups, levels, components, neighbourhoods.

Strong components and levels of a graph of up to ``DRIVER_EDGES`` edges and nodes are found on the driver by one
depth-first walk, which is sequential by nature. Beyond that, and for everything else, loops keep their state in tables of
the shared folder, so plans stay short and a lost executor loses nothing, and the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.files import stash

#: Edges, and nodes, of a graph that is walked on the driver.
DRIVER_EDGES = 100_000


def closure(edges: DataFrame, starts: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """All (start, node) with a path of one edge or more, for the starts of a column ``start``; semi-naive rounds."""
    e = edges.select("src", "dst").distinct()
    frontier = stash(starts.select("start").distinct().join(e.withColumnRenamed("src", "start"), "start").select("start", F.col("dst").alias("node")), "front")
    parts = [frontier]
    for _ in range(max_rounds):
        if frontier.isEmpty():
            break
        nxt = frontier.join(e.withColumnRenamed("src", "node"), "node").select("start", F.col("dst").alias("node")).distinct()
        for seen in parts:
            nxt = nxt.join(seen, ["start", "node"], "left_anti")
        frontier = stash(nxt, "front")
        parts.append(frontier)
        if len(parts) > 8:  # one table for what has been seen, so that a round has few joins
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            parts = [stash(whole, "seen")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """Nodes reached from one node, itself left out."""
    spark = edges.sparkSession
    return closure(edges, spark.createDataFrame([(start,)], "start string")).where(F.col("node") != start).select("node")


def _held(edges: DataFrame, nodes: DataFrame) -> dict[str, list[str]] | None:
    """Node to its targets, if the graph is small enough for the driver; targets that are no node are left out."""
    names, pairs = nodes.select("node").distinct(), edges.select("src", "dst").distinct()
    if names.count() > DRIVER_EDGES or pairs.count() > DRIVER_EDGES:  # counted first: of a larger graph no row comes here
        return None
    to: dict[str, list[str]] = {r["node"]: [] for r in names.collect()}
    for a, b in pairs.collect():
        if a in to and b in to:
            to[a].append(b)
    return to


def walk(to: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected groups, each after all that it leads to (an iterative depth-first walk with low links)."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    groups = []
    for root in to:
        if root in order:
            continue
        work = [(root, iter(to[root]))]
        order[root] = low[root] = len(order)
        held.append(root)
        inside.add(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in order:
                    order[n] = low[n] = len(order)
                    held.append(n)
                    inside.add(n)
                    work.append((n, iter(to[n])))
                    break
                if n in inside:
                    low[node] = min(low[node], order[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(held.pop())
                        inside.discard(group[-1])
                    groups.append(group)
    return groups


def _least(edges: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """The least label that reaches each node along the edges; a round moves labels by one edge."""
    now = nodes.select("node", F.col(label).alias("low"))
    while True:
        moved = edges.join(now.toDF("src", "low"), "src").select(F.col("dst").alias("node"), "low").unionByName(now).groupBy("node").agg(F.min("low").alias("low"))
        moved = stash(moved, "least")
        changed = moved.join(now.toDF("node", "was"), "node").where("low <> was")
        now = moved
        if changed.isEmpty():
            return now


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): component is the least node of its strongly connected group.

    A graph too large for the driver is trimmed: nodes without an edge in or out go, again and again; what is left is
    coloured forward with the least node that reaches each, and from the node of each colour backward within the colour,
    which is a group. That takes a round for each edge of the longest path, which call graphs keep short.
    """
    to = _held(edges, nodes)
    if to is not None:
        return nodes.sparkSession.createDataFrame([(n, c) for g in walk(to) for c in [min(g)] for n in g], "node string, component string")
    e = edges.select("src", "dst").where("src <> dst").distinct()
    left = stash(nodes.select("node").distinct(), "nodes")
    e = stash(e, "edges")
    done = []
    while not left.isEmpty():
        while True:
            both = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
            alone = stash(left.join(both, "node", "left_anti"), "alone")
            if alone.isEmpty():
                break
            done.append(alone.select("node", F.col("node").alias("component")))
            left = stash(left.join(alone, "node", "left_anti"), "nodes")
            e = stash(e.join(alone.toDF("src"), "src", "left_anti").join(alone.toDF("dst"), "dst", "left_anti"), "edges")
            if left.isEmpty():
                break
        if left.isEmpty():
            break
        colour = _least(e, left.withColumn("own", F.col("node")), "own")
        inside = stash(e.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", "a"), "inside")
        # backward from the node of each colour, inside the colour
        got = colour.where("node = low").select("node", F.col("low").alias("component"))
        frontier = got
        seen = got
        while True:
            nxt = frontier.select(F.col("node").alias("dst"), "component").join(inside, "dst").where("a = component").select(F.col("src").alias("node"), "component").distinct().join(seen.select("node"), "node", "left_anti")
            frontier = stash(nxt, "front")
            if frontier.isEmpty():
                break
            seen = stash(seen.unionByName(frontier), "seen")
        seen = stash(seen, "group")
        done.append(seen)
        left = stash(left.join(seen, "node", "left_anti"), "nodes")
        e = stash(e.join(seen.select(F.col("node").alias("src")), "src", "left_anti").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti"), "edges")
    if not done:
        return nodes.select("node", F.col("node").alias("component")).limit(0)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return stash(out, "components")


def recursion_groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups that call themselves: (component, members); more than one node, or a node with an edge to itself."""
    scc = strong_components(edges, nodes)
    selfish = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("self", F.lit(True))
    g = scc.join(selfish, "node", "left").groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"), F.max(F.coalesce("self", F.lit(False))).alias("self"))
    return g.where("size(members) > 1 or self").select("component", "members")


def batches(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component, batch): 0 calls nothing outside its group, else one more than the highest batch called."""
    to = _held(edges, nodes)
    if to is not None:
        level: dict[str, int] = {}
        out = []
        for group in walk(to):  # what a group leads to comes before it
            own = set(group)
            batch = max((level[n] + 1 for g in group for n in to[g] if n not in own), default=0)
            level.update(dict.fromkeys(group, batch))
            out += [(n, min(group), batch) for n in group]
        return nodes.sparkSession.createDataFrame(out, "node string, component string, batch int")
    scc = strong_components(edges, nodes)
    c = stash(edges.join(scc.toDF("src", "a"), "src").join(scc.toDF("dst", "b"), "dst").where("a <> b").select("a", "b").distinct(), "condensed")
    level = stash(scc.select(F.col("component").alias("c")).distinct().withColumn("batch", F.lit(0)), "level")
    while True:
        up = c.join(level.toDF("b", "below"), "b").groupBy(F.col("a").alias("c")).agg((F.max("below") + 1).alias("up"))
        nxt = stash(level.join(up, "c", "left").select("c", F.greatest("batch", F.coalesce("up", F.lit(0))).alias("batch")), "level")
        changed = nxt.join(level.toDF("c", "was"), "c").where("batch <> was")
        level = nxt
        if changed.isEmpty():
            break
    return scc.join(level.toDF("component", "batch"), "component").select("node", "component", "batch")


def ranks(batch: DataFrame) -> DataFrame:
    """Position over (batch, node), from 1: rows are sorted by range, and each range begins after the rows before it, so
    no task holds them all."""
    rows = batch.repartitionByRange("batch", "node").sortWithinPartitions("batch", "node")
    rows = stash(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % F.lit(1 << 33)), "ranks")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return rows.join(before, "part").withColumn("rank", F.col("before") + F.col("at") + 1).drop("part", "at", "before")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph; component is the least node.

    Each round every node takes the neighbour, or itself, of the least random priority, and edges are contracted to
    those; that shrinks the graph by a constant factor whatever its shape, a long path included.
    """
    rank = lambda c, k: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("id"))
    every = stash(nodes.select("node").union(edges.select("src")).union(edges.select("dst")).distinct(), "nodes")
    both = stash(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "both")
    steps = []
    while not both.isEmpty():
        k = len(steps)
        step = stash(both.groupBy("src").agg(F.min(rank("dst", k)).alias("m")).select(F.col("src").alias("node"), F.least("m", rank("src", k))["id"].alias("to")), "step")
        steps.append(step)
        both = stash(both.join(step.toDF("src", "a"), "src").join(step.toDF("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "both")
    at = every.select("node", F.col("node").alias("to"))
    for step in steps:
        at = at.join(step.toDF("to", "further"), "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    at = stash(at, "at")
    return at.join(at.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")


def uncalled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no other node calls."""
    return nodes.join(edges.where("src <> dst").select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def neighbourhood(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """(node, distance) within ``hops`` edges in either direction: one unrolled plan."""
    spark = edges.sparkSession
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = spark.createDataFrame([(start, 0)], "node string, distance int")
    for k in range(1, hops + 1):
        nxt = seen.where(F.col("distance") == k - 1).join(both.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), F.lit(k).alias("distance"))
        seen = seen.unionByName(nxt).groupBy("node").agg(F.min("distance").alias("distance"))
    return seen


def table_impact(reads: DataFrame, writes: DataFrame, calls: DataFrame) -> DataFrame:
    """(table_key, role, node): readers and writers of each table, and who calls its writers, at any distance."""
    writers = writes.select("table_key", "node").distinct()
    # closed for each table, so a table's callers meet once, however many writers lead to them
    back = calls.select(F.col("dst").alias("node"), F.col("src").alias("up")).distinct()
    seen = frontier = stash(writers, "front")
    while not frontier.isEmpty():
        found = frontier.join(back, "node").select("table_key", F.col("up").alias("node")).distinct().join(seen, ["table_key", "node"], "left_anti")
        frontier = stash(found, "front")
        seen = stash(seen.unionByName(frontier), "seen")
    callers = seen.join(writers, ["table_key", "node"], "left_anti")
    tag = lambda df, role: df.select("table_key", F.lit(role).alias("role"), "node")
    return tag(reads.select("table_key", "node").distinct(), "READER").unionByName(tag(writers, "WRITER")).unionByName(tag(callers, "CALLER"))


def dfs_order(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> tuple[list[str], list[list[str]]]:
    """(post-order, cycles) of a small graph on the driver: what a node needs comes before it; names decide ties."""
    to: dict[str, list[str]] = {n: [] for n in sorted(nodes)}
    for a, b in sorted(set(edges)):
        if a in to and b in to and a != b:
            to[a].append(b)
    state: dict[str, int] = {}
    order, cycles = [], []
    for root in to:
        stack = [(root, iter(to[root]))] if root not in state else []
        if stack:
            state[root] = 1
        while stack:
            node, rest = stack[-1]
            for n in rest:
                if n not in state:
                    state[n] = 1
                    stack.append((n, iter(to[n])))
                    break
                if state[n] == 1:
                    path = [x for x, _ in stack]
                    cycles.append(path[path.index(n) :])
            else:
                state[node] = 2
                order.append(node)
                stack.pop()
    return order, cycles

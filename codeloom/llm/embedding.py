"""Embedding near-duplicates: all pairs over a cosine threshold, by tiles compared along leading principal dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BOUND_ROWS, components, hash_unit, stash
from codeloom.llm.jaccard import forest

THRESHOLD = 0.9
#: Vectors of the sample (by hash, of each length) on which the rotation and the cells' centres are fitted, and lengths
#: that are fitted so, the commonest first; they decide the order of work only, never a result.
SAMPLE, FITTED = 4_096, 8
#: Vectors of a cell that is worth having, and cells at most, so that what every task gets of their centres is bounded.
CELL, CELLS = 8_192, 2_048
#: Vectors and bytes of a tile at most; vectors compared at once; dimensions added before bounds are looked at again.
TILE, TILE_BYTES, BLOCK, STEP = 8_192, 16 << 20, 1_024, 8
#: A cosine this close to the threshold is computed again from the vectors as they were given.
CLOSE = 1e-9


def units_of(vectors: list[np.ndarray]) -> np.ndarray:
    units = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    units /= np.abs(units).max(1, keepdims=True)
    return units / np.linalg.norm(units, axis=1, keepdims=True)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns by falling second moment of the sample's unit vectors."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1].copy()


class Cells:
    """Centres that cut space into cells. By the bisecting plane of two centres p and q, a vector of cell p is within
    e = sqrt(2 - 2 t) of a vector x only if x . (q - p) <= e |q - p|: so a vector visits the cells of lower number for
    which this holds, no pair within reach is lost, and each meets once, in the lower of its cells."""

    def __init__(self, centres: np.ndarray, threshold: float):
        self.centres = centres
        self.apart = np.sqrt(np.maximum(0, (centres**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * centres @ centres.T))
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def visits(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and which cells it meets others in."""
        dots = units @ self.centres.T
        home = dots.argmax(1)
        near = dots[np.arange(len(units)), home][:, None] - dots <= self.reach * self.apart[home] + 1e-6
        return home, near & (np.arange(len(self.centres))[None, :] <= home[:, None])

    @staticmethod
    def fit(units: np.ndarray, n: int, threshold: float) -> Cells | None:
        """Cells for n vectors like the sample's; none where they would not spare half of the comparisons."""
        cells = min(n // CELL, CELLS, len(units) // 2)
        if cells < 2:
            return None
        out = Cells(units[:: len(units) // cells][:cells], threshold)
        home, meets = out.visits(units)
        own = np.bincount(home, minlength=cells)
        work = (own * (meets.sum(0) - own / 2)).sum()
        return out if work < 0.25 * len(units) ** 2 else None


class Tile:
    """Vectors with ids and weights, ready to be compared: rotated unit vectors, suffix norms, and the vectors scaled."""

    def __init__(self, ids: list[int], weights: list[int], vectors: list[np.ndarray], basis: np.ndarray | None = None):
        self.ids, self.weights = np.array(ids, dtype=np.int64), np.array(weights, dtype=np.int64)
        raw = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
        self.scaled = raw / np.abs(raw).max(1, keepdims=True)
        self.norms = np.linalg.norm(self.scaled, axis=1)
        units = self.scaled / self.norms[:, None]
        self.basis = rotation(units) if basis is None else basis
        self.turned = units @ self.basis
        d = self.turned.shape[1]
        self.steps = [s for s in (2 * STEP, 3 * STEP, 4 * STEP, 6 * STEP) if s < d] + [d]
        tail = np.cumsum((self.turned * self.turned)[:, ::-1], 1)[:, ::-1]
        self.suffix = np.sqrt(np.concatenate([tail, np.zeros((len(raw), 1))], 1))[:, self.steps]
        # product of the leading dimensions plus that of the suffix norms, as one product: the bound for each pair
        self.head = np.concatenate([self.turned[:, : self.steps[0]], self.suffix[:, :1]], 1).astype(np.float32)
        self.links = np.zeros(len(raw), dtype=np.int64)


def linked(a: Tile, b: Tile, threshold: float, p: slice, q: slice) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs with cosine >= threshold of parts p and q of two tiles.

    Products are added up over leading dimensions first. What the rest can add is at most the product of the suffix
    norms; a pair is given up as soon as the threshold is out of reach. The first bound is in single precision, with room
    for its error; everything after it is in double precision.
    """
    reach = (a.head[p] @ b.head[q].T >= np.float32(threshold - 1e-5)).ravel()
    at = np.flatnonzero(reach)
    width = b.head[q].shape[0]
    r, c = at // width + p.start, at % width + q.start
    got = np.zeros(len(r))
    for k, end in enumerate(a.steps):
        if not len(r):
            return r, c
        part = slice(a.steps[k - 1] if k else 0, end)
        got = got + np.einsum("ij,ij->i", a.turned[r, part], b.turned[c, part])
        ok = got >= threshold - 1e-7 - a.suffix[r, k] * b.suffix[c, k]
        r, c, got = r[ok], c[ok], got[ok]
    near = np.abs(got - threshold) <= CLOSE
    if near.any():
        x, y = r[near], c[near]
        got[near] = np.einsum("ij,ij->i", a.scaled[x], b.scaled[y]) / (a.norms[x] * b.norms[y])
    ok = got >= threshold
    return r[ok], c[ok]


def compare(a: Tile, b: Tile, threshold: float) -> Iterator[tuple]:
    """Rows (node, links, other) of a forest of the links between two tiles, or within one; counts go to the tiles."""
    us, vs = [], []
    for p in range(0, len(a.ids), BLOCK):
        for q in range(p if a is b else 0, len(b.ids), BLOCK):
            r, c = linked(a, b, threshold, slice(p, min(p + BLOCK, len(a.ids))), slice(q, min(q + BLOCK, len(b.ids))))
            if a is b:
                r, c = r[r < c], c[r < c]
            np.add.at(a.links, r, b.weights[c])
            np.add.at(b.links, c, a.weights[r])
            tree = forest(a.ids[r], b.ids[c])
            us += [u for u, _ in tree]
            vs += [v for _, v in tree]
    for u, v in forest(np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64)):
        yield u, None, v


def counts(t: Tile) -> list[tuple]:
    return [(int(t.ids[k]), int(t.links[k]), None) for k in np.flatnonzero(t.links)]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of (vec_id, embedding).

    Equal vectors are one node with a weight. Vectors of one length, and of one cell where cells help (see ``Cells``), are
    dealt to tiles of a bounded size by a hash; each pair of tiles is a task of its own, that holds these two and nothing
    else. Links leave a task as counts and as a forest. All lengths are handled at once.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing.
    Vectors of different length do not link. Rows that repeat an id and its vector are one vector; an id with several
    vectors is one for each. Other columns are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    x = F.col("embedding").cast(kind)
    usable = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    zero = F.lit(0.0).cast("float" if kind == "array<float>" else "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: v + zero).alias("v"), (usable & F.col("vec_id").isNotNull()).alias("ok"))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.col("v"))).withColumn("key", F.when(F.col("ok"), F.concat_ws(":", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v")))))
    good = rows.where("ok")
    weights = good.select("key", "vec_id").distinct().groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    nodes = good.groupBy("key").agg(F.first("v").alias("v")).join(weights, "key").withColumn("d", F.size("v")).withColumn("node", F.monotonically_increasing_id())
    nodes = stash(nodes, "vectors")
    found = _links(nodes.select("d", "node", "weight", "v"), threshold)
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    known = nodes.select("key", "node", "least", "weight").join(links, "node", "left").join(parts, "node", "left")
    known = stash(known.select("key", F.coalesce("component", "node").alias("c"), "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "known")
    known = known.join(known.groupBy("c").agg(F.min("least").alias("component")), "c").select("key", "links", "component")
    return rows.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def _fit(nodes: DataFrame, threshold: float) -> dict[int, tuple[np.ndarray, Cells | None]]:
    """Rotation and cells of the commonest lengths, from samples; others are rotated by each tile's own vectors."""
    many = {r["d"]: r["n"] for r in nodes.groupBy("d").agg(F.count("*").alias("n")).where(F.col("n") >= CELL).orderBy(F.desc("n"), "d").limit(FITTED).collect()}
    share = F.lit(0.0)
    for d, n in many.items():
        share = F.when(F.col("d") == d, F.lit(SAMPLE / n)).otherwise(share)
    sample: dict[int, list[tuple]] = {}
    for r in nodes.where(hash_unit(F.col("node"), F.lit("pca")) < share).select("d", "node", "v").collect() if many else []:
        sample.setdefault(r["d"], []).append((r["node"], r["v"]))
    out = {}
    for d, got in sample.items():
        units = units_of([v for _, v in sorted(got, key=lambda x: x[0])])
        basis = rotation(units)
        out[d] = basis, Cells.fit(units @ basis, many[d], threshold)
    return out


def _links(nodes: DataFrame, threshold: float) -> DataFrame:
    """Links between vectors of one length: rows (node, links, other)."""
    spark = nodes.sparkSession
    model = _fit(nodes, threshold)
    held = spark.sparkContext.broadcast(model)  # FITTED rotations and CELLS centres each at most
    kind = nodes.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby("d"):
                basis, cells = held.value[d]
                home, meets = cells.visits(units_of(part["v"].tolist()) @ basis)
                r, c = np.nonzero(meets)
                take = part.iloc[r]
                yield pd.DataFrame({"d": d, "grp": c.astype("int32"), "visitor": c != home[r], "node": take["node"].to_numpy(), "weight": take["weight"].to_numpy(), "v": take["v"].to_numpy()})

    celled = [d for d, (_, cells) in model.items() if cells is not None]
    placed = nodes.where(~F.col("d").isin(celled)).select("d", F.lit(0).alias("grp"), F.lit(False).alias("visitor"), "node", "weight", "v")
    if celled:
        visits = nodes.where(F.col("d").isin(celled)).mapInPandas(place, f"d int, grp int, visitor boolean, node long, weight long, v {kind}")
        placed = stash(placed.unionByName(visits), "cells")
    # tiles of those at home and of visitors: as few as their size permits, but enough that the pairs are two a partition
    spread = math.isqrt(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.count("*")
    least = F.least(F.ceil(n / F.lit(64.0)), F.lit(spread)) if not celled else F.lit(1)
    most = F.greatest(F.lit(64.0), F.least(F.lit(float(TILE)), F.lit(float(TILE_BYTES)) / (8 * F.col("d"))))
    sizes = placed.groupBy("d", "grp", "visitor").agg(F.greatest(F.ceil(n / most), least, F.lit(1)).cast("int").alias("tiles"))
    sizes = stash(sizes.groupBy("d", "grp").agg(F.sum(F.when(~F.col("visitor"), F.col("tiles")).otherwise(0)).cast("int").alias("homes"), F.sum(F.when(F.col("visitor"), F.col("tiles")).otherwise(0)).cast("int").alias("guests")).where("homes > 0"), "tiles")
    # a row for each cell of a fitted length and for each other length
    met = placed.join(F.broadcast(sizes) if sizes.count() <= BOUND_ROWS else sizes, ["d", "grp"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("visitor"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    met = met.withColumn("own", F.when(F.col("visitor"), F.col("homes") + own).otherwise(own))
    # tiles are numbered, visitors' last; one at home meets every tile, a visitor those at home
    met = met.select("d", "grp", "own", "node", "weight", "v", F.explode(F.sequence(F.lit(0), F.when(F.col("visitor"), F.col("homes")).otherwise(F.col("homes") + F.col("guests")) - 1)).alias("with"))
    met = met.select("d", "grp", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "weight", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda out: pd.DataFrame(out, columns=["node", "links", "other"]).astype({"links": "Int64", "other": "Int64"})
        task, rows = None, []

        def meet() -> Iterator[tuple]:
            (d, _, i, j), (basis, _) = task, held.value.get(task[0], (None, None))
            a = [r[1:] for r in rows if r[0] == i]
            b = [r[1:] for r in rows if r[0] == j] if i != j else a
            if not a or not b:
                return
            a = Tile(*zip(*a, strict=True), basis)
            b = Tile(*zip(*b, strict=True), a.basis) if i != j else a
            yield from compare(a, b, threshold)
            yield from counts(a)
            if a is not b:
                yield from counts(b)

        for b in batches:
            out: list[tuple] = []
            for d, grp, i, j, *row in zip(*(b[c].tolist() for c in ("d", "grp", "i", "j", "own", "node", "weight", "v")), strict=True):
                if task != (d, grp, i, j):
                    out += meet() if task else []
                    task, rows = (d, grp, i, j), []
                rows.append(row)
            yield frame(out)
        yield frame(list(meet()) if task else [])

    key = ["d", "grp", "i", "j"]
    met = met.repartition(*key).sortWithinPartitions(*key)
    return stash(met.select(*key, "own", "node", "weight", "v").mapInPandas(run, "node long, links long, other long"), "links")


#: DuckDB: all pairs of usable vectors; for the small tables of a check only.
SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) e from embeddings
), u as (
  select vec_id, list_transform(e, lambda a: a / sqrt(list_sum(list_transform(e, lambda b: b * b)))) e from v
  where e is not null and len(e) > 0 and len(list_filter(e, lambda a: a is null or not isfinite(a))) = 0 and len(list_filter(e, lambda a: a <> 0)) > 0
), l as (
  select distinct a.vec_id x, b.vec_id y from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_inner_product(a.e, b.e) >= 0.9
), r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x)
select d.vec_id as vec_id, coalesce((select count(*) from l where l.x = d.vec_id), 0) as n_links,
  least(d.vec_id, coalesce((select min(y) from r where r.x = d.vec_id), d.vec_id)) as component_id,
  least(d.vec_id, coalesce((select min(y) from r where r.x = d.vec_id), d.vec_id)) = d.vec_id as kept
from embeddings d
"""

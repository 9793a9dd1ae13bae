"""N-gram Jaccard join: MinHash bands find candidates, full sets of word n-grams decide."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BOUND_ROWS, components, stash

N, THRESHOLD = 5, 0.8
#: A pair at the threshold is found with this probability at least; and the largest signature allowed for it.
RECALL, MOST_HASHES = 1 - 1e-5, 256
#: Documents, and n-grams, of one tile of a group of candidates at most.
TILE_MOST, TILE_GRAMS = 1024, 2_000_000
WORD = re.compile(r"\w+")
BLANK = " \t\n\r\f"


def plan(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows as the signature has room for, and just so many bands that the recall is met.

    More rows let fewer unlike pairs through; the bands that the recall then needs are log(miss) / log(1 - s^rows).
    """
    best = (1, most)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


BANDS, ROWS = plan()
_RAW = np.frombuffer(hashlib.shake_256(b"codeloom minhash").digest(8 * BANDS * ROWS), dtype="<u4")
XOR, MUL = _RAW[: BANDS * ROWS].copy(), _RAW[BANDS * ROWS :] | np.uint32(1)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word n-grams as sorted arrays of 64-bit hashes.

    Words are runs of letters, digits and underscores in lower case. A text of fewer words than n has one n-gram, all its
    words; a text without words that is not blank has one, the text without blanks around it; null and blank texts have none.
    """

    def __init__(self, n: int = N, memory: int = 300_000):
        self.n, self.memory, self.known = n, memory, {}

    def __call__(self, text: str | None) -> np.ndarray:
        text = (text or "").lower()
        words = WORD.findall(text)
        if not words:
            return np.array([xxhash.xxh3_64_intdigest(b"\0" + bare.encode("utf-8", "surrogatepass"))], dtype=np.uint64) if (bare := text.strip(BLANK)) else np.zeros(0, dtype=np.uint64)
        if len(self.known) > self.memory:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.n, len(words))
        out = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
            out ^= out >> np.uint64(32)
        return np.unique(mix64(out))


def band_hashes(grams: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of the MinHash signature of a set that is not empty."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        v = x[None, at : at + 2048] ^ XOR[:, None]
        v *= MUL[:, None]
        np.minimum(least, v.min(1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + least[r::ROWS])
    return out.astype(np.int64)


def signatures(text: Column, n: int = N) -> Column:
    """struct<key string, n_grams int, bands array<long>> of a text column; key is a digest of the set, null (as bands)
    for an empty set."""

    @F.pandas_udf("key string, n_grams int, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams_of = Shingler(n)
        for texts in batches:
            sets = map(grams_of, texts)
            out = [(xxhash.xxh3_128_hexdigest(g.tobytes()) if len(g) else None, len(g), band_hashes(g) if len(g) else None) for g in sets]
            yield pd.DataFrame(out, columns=["key", "n_grams", "bands"])

    return run(text)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another, by products of incidence matrices.

    Only hashes that both lists hold are columns, a few thousand at a time.
    """
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = (np.repeat(np.arange(len(x)), [len(g) for g in x]) for x in (left, right))
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(both):
        return out
    ca, cb = np.searchsorted(both, a), np.searchsorted(both, b)
    ca[ca == len(both)] = 0
    cb[cb == len(both)] = 0
    keep_a, keep_b = both[ca] == a, both[cb] == b
    ra, ca, rb, cb = ra[keep_a], ca[keep_a], rb[keep_b], cb[keep_b]
    width = 4096
    ka, kb = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    for at in range(0, len(both), width):
        w = min(width, len(both) - at)
        ma, mb = np.zeros((len(left), w), dtype=np.float32), np.zeros((len(right), w), dtype=np.float32)
        for m, r, c in ((ma, ra, ca), (mb, rb, cb)):
            lo, hi = np.searchsorted(c, [at, at + w])
            m[r[lo:hi], c[lo:hi] - at] = 1
        out += ma @ mb.T
    return out


def forest(us: np.ndarray, vs: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given ones: the links of a tile without their number."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for u, v in zip(us.tolist(), vs.tolist(), strict=True):
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((u, v))
    return out


def shared_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band that each row of one matrix of band hashes shares with each of another; BANDS if none."""
    first = np.full((len(a), len(b)), BANDS, dtype=np.int16)
    for k in range(BANDS - 1, -1, -1):
        x, y = a[:, k], b[:, k]
        both = np.intersect1d(x, y)
        if len(both):
            r, c = np.flatnonzero(np.isin(x, both)), np.flatnonzero(np.isin(y, both))
            hit = x[r][:, None] == y[c][None, :]
            at = np.ix_(r, c)
            first[at] = np.where(hit, np.int16(k), first[at])
    return first


def linked_pairs(sides: list[list[tuple]], same: bool, band: int, threshold: float) -> np.ndarray:
    """Which rows (node, weight, bands, grams) of one tile link with which of the other: pairs that share a band, which is
    the given one first of all (-1: any), and whose full sets are alike. Few pairs are compared one by one, many as products."""
    left, right = sides
    first = shared_band(*(np.stack([x[2] for x in side]) for side in sides))
    asked = first == band if band >= 0 else first < BANDS
    if same:
        asked &= np.triu(np.ones(asked.shape, dtype=bool), 1)
    r, c = np.nonzero(asked)
    out = np.zeros(asked.shape, dtype=bool)
    if 16 * len(r) > asked.size:
        size = [np.array([len(x[3]) for x in side], dtype=np.float64) for side in sides]
        common = overlaps(*([x[3] for x in side] for side in sides)).astype(np.float64)
        out = asked & (common >= threshold * (size[0][:, None] + size[1][None, :] - common) - 1e-9)
    else:
        for i, j in zip(r.tolist(), c.tolist(), strict=True):
            x, y = left[i][3], right[j][3]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9:
                common = len(np.intersect1d(x, y, assume_unique=True))
                out[i, j] = common >= threshold * (len(x) + len(y) - common) - 1e-9
    return out | out.T if same else out


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (grp, band, i, j, tile, node, weight, bands, grams binary), sorted by (grp, band, i, j) in their partitions, to
    rows (node, links, other): the weights of the nodes linked with a node in this pair of tiles, and edges of a forest."""

    def one(rows: list[tuple]) -> Iterator[tuple]:
        _, band, i, j = rows[0][:4]
        sides = []
        for tile in (i, j):
            seen = {node: (node, weight, bands, np.frombuffer(grams, dtype=np.uint64)) for *_, t, node, weight, bands, grams in rows if t == tile}
            sides.append([seen[k] for k in sorted(seen)])
        left, right = sides
        if not left or not right or (i == j and len(left) < 2):
            return
        linked = linked_pairs(sides, i == j, band, threshold)
        ids, weights = [np.array([x[0] for x in side]) for side in sides], [np.array([x[1] for x in side], dtype=np.int64) for side in sides]
        for n, (node, total) in enumerate(zip(ids[0].tolist(), (linked @ weights[1]).tolist(), strict=True)):
            if linked[n].any():
                yield node, total, None
        if i != j:
            for n, (node, total) in enumerate(zip(ids[1].tolist(), (linked.T @ weights[0]).tolist(), strict=True)):
                if linked[:, n].any():
                    yield node, total, None
        a, b = np.nonzero(np.triu(linked) if i == j else linked)
        for u, v in forest(ids[0][a], ids[1][b]):
            yield u, None, v

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda out: pd.DataFrame(out, columns=["node", "links", "other"]).astype({"links": "Int64", "other": "Int64"})
        held: list[tuple] = []
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(b[c].tolist() for c in ("grp", "band", "i", "j", "tile", "node", "weight", "bands", "grams")), strict=True):
                if held and held[0][:4] != row[:4]:
                    out += one(held)
                    held = []
                    if len(out) > 20_000:
                        yield frame(out)
                        out = []
                held.append(row)
        if held:
            out += one(held)
        yield frame(out)

    return rows.mapInPandas(run, "node long, links long, other long")


def tiles_of(m: Column, grams: Column, spread: int) -> Column:
    """Tiles of ``m`` members with so many n-grams together: as few as hold them, but, so that a large bucket does not
    fall to a few tasks, enough that their pairs are two for each partition, of 64 members at the least."""
    wanted = F.least(m / F.lit(64.0), F.lit(float(math.isqrt(4 * spread))))
    return F.greatest(F.ceil(m / F.lit(float(TILE_MOST))), F.ceil(grams / F.lit(float(TILE_GRAMS))), F.ceil(wanted), F.lit(1)).cast("int")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id, n_links, kept, text_hash), one for each row: the least id that links reach, how many other
    documents are linked directly, whether the row is the first of its class, and xxhash64 of the text.

    Two documents are linked if they share a band and the Jaccard index of their full sets of word n-grams is
    ``threshold`` or more. Documents of equal sets are one node with a weight, so copies meet in a count and never in
    pairs. Nodes of one band hash are tied to the least of them. In a connected group of ties of a moderate size every
    node is sent once for each pair of tiles; in a larger one to each of its buckets instead, which are cut into tiles
    themselves; either way only pairs that share a band are compared, once. Nothing caps a bucket or a group.

    A document is an id with a text: rows that repeat both count once, an id with several texts is one document for each.
    Null and blank texts link with nothing, rows without an id neither (class null, kept). Other columns are ignored; an
    empty table gives no row; a text is read whole, however long.
    """
    spark = docs.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), signatures(F.col("text"), n).alias("s"))
    signed = stash(read.select("doc_id", "text_hash", "s.*"), "sig")
    usable = signed.where("key is not null and doc_id is not null")
    weights = usable.select("key", "doc_id").distinct().groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("weight"))
    sets = usable.groupBy("key").agg(F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")).join(weights, "key")
    nodes = stash(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))  # a band's hash holds its number
    shared = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1")
    ties = banded.join(shared, "bucket").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    groups = stash(components(stash(ties, "ties")), "groups").toDF("node", "grp")
    members = stash(nodes.select("node", "key", "least", "weight", "n_grams", "bands").join(groups, "node"), "members")
    sizes = members.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n_grams").alias("g")).withColumn("tiles", tiles_of(F.col("m"), F.col("g"), spread))
    sizes = stash(sizes.select("grp", F.col("tiles").alias("group_tiles")), "sizes")
    # the texts of members only: as long as their ids are few they are sent to the documents, else both sides are dealt
    wanted = members.select(F.col("least").alias("id")).distinct()
    few = members.count() <= BOUND_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    texts = texts.join(members.withColumnRenamed("least", "id").select("id", "node", "key", "weight", "grp", "n_grams", "bands"), "id")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams_of = Shingler(n)
        for b in batches:
            out = []
            for *row, key, text in zip(*(b[c].tolist() for c in ("grp", "node", "weight", "n_grams", "bands", "key", "text")), strict=True):
                if xxhash.xxh3_128_hexdigest(data := grams_of(text).tobytes()) == key:  # else another text of this id
                    out.append((*row, data))
            yield pd.DataFrame(out, columns=["grp", "node", "weight", "n_grams", "bands", "grams"])

    full = texts.select("grp", "node", "weight", "n_grams", "bands", "key", "text").mapInPandas(grams, "grp long, node long, weight long, n_grams int, bands array<long>, grams binary").join(sizes, "grp")
    moderate = full.where(F.col("group_tiles") <= 2 * BANDS).select(F.col("grp").alias("bucket"), F.lit(-1).alias("band"), F.col("group_tiles").alias("tiles"), "node", "weight", "bands", "grams")
    wide = sizes.where(F.col("group_tiles") > 2 * BANDS)
    if not wide.isEmpty():
        large = full.join(wide.select("grp"), "grp", "left_semi").select(F.posexplode("bands").alias("band", "bucket"), "node", "weight", "n_grams", "bands", "grams")
        counts = members.join(wide.select("grp"), "grp", "left_semi").select(F.explode("bands").alias("bucket"), "n_grams").groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n_grams").alias("g")).where("m > 1")
        dealt = large.join(counts.withColumn("tiles", tiles_of(F.col("m"), F.col("g"), spread)).select("bucket", "tiles"), "bucket")
        moderate = moderate.unionByName(dealt.select("bucket", "band", "tiles", "node", "weight", "bands", "grams"))
    dealt = moderate.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
    met = met.select(F.col("bucket").alias("grp"), "band", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "node", "weight", "bands", "grams")
    order = ["grp", "band", "i", "j"]
    found = stash(verify(met.repartition(*order).sortWithinPartitions(*order), threshold), "links")
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    known = nodes.select("key", "node", "least", "weight").join(links, "node", "left").join(classes, "node", "left")
    known = stash(known.select("key", F.coalesce("component", "node").alias("c"), "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "known")
    heads = known.groupBy("c").agg(F.min(F.struct("least", "key")).alias("head"))  # the first of each class
    known = known.join(heads, "c").select("key", "links", F.col("head.least").alias("class"), (F.col("head.key") == F.col("key")).alias("first"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")
    return signed.select("doc_id", "text_hash", own).join(known, "key", "left").select(
        "doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("first") & (F.col("class") == F.col("doc_id")), F.lit(True)).alias("kept"), "text_hash",
    )


#: DuckDB: all pairs of texts with a common n-gram; for the small tables of a check only.
SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(lower(coalesce("text", '')), '[\\p{L}\\p{N}_]+') ws, regexp_replace(lower(coalesce("text", '')), '^\\s+|\\s+$', '', 'g') bare from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [chr(10) || bare] end) g
  from w where len(ws) > 0 or bare <> ''
), z as (select doc_id, count(*) n from s group by doc_id)
, c as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2)
, l as (select x, y from c join z a on a.doc_id = x join z b on b.doc_id = y where 5 * c >= 4 * (a.n + b.n - c))
, r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x)
select d.doc_id as doc_id, least(d.doc_id, coalesce((select min(y) from r where r.x = d.doc_id), d.doc_id)) as class_id,
  coalesce((select count(*) from l where l.x = d.doc_id), 0) as n_links
from documents d
"""

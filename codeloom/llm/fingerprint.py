"""Order MinHash fingerprints: least occurrence-numbered k-mers in text order, hashed as tuples."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import hash_unit

#: Code points of a k-mer, k-mers of a tuple, tuples of a fingerprint.
K, TUPLE, TUPLES = 6, 2, 64
#: Documents of one range of the order, whose texts meet in one task; and ranges at most.
ROWS_PER_RANGE, MOST_RANGES = 1_000, 20_000
MIX32 = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = hashlib.shake_256(b"codeloom order minhash").digest(8 * n)
    a = np.frombuffer(raw, dtype="<u4")
    return a[:n].copy(), a[n:] | np.uint32(1)


XOR, MUL = _seeds(TUPLES)


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * MIX32[0]
    h = (h ^ (h >> np.uint32(13))) * MIX32[1]
    return h ^ (h >> np.uint32(16))


def kmers(text: str, k: int = K) -> np.ndarray:
    """Hashes of the occurrence-numbered k-mers of a text, by place; a text shorter than k is one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    width = min(k, len(points))
    if not width:
        return np.zeros(0, dtype=np.uint32)
    n = len(points) - width + 1
    h = np.full(n, 0x9747B28C, dtype=np.uint32)
    points = finish(points + np.uint32(0x9E3779B9))
    for i in range(width):
        h = h * np.uint32(0x01000193) + points[i : n + i]
        h ^= h >> np.uint32(15)
    # number equal k-mers by their place: sort (hash, place) packed in one integer
    packed = np.sort((h.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))
    same = np.flatnonzero((packed[1:] >> np.uint64(32)) == (packed[:-1] >> np.uint64(32))) + 1
    h = finish(h)
    if len(same):
        starts = np.ones(n, dtype=bool)
        starts[same] = False
        first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        count = (np.arange(n) - first)[same].astype(np.uint32)
        place = (packed[same] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        h[place] = finish(h[place] ^ (count * np.uint32(0x9E3779B1)))
    return h


def sketch(text: str | None, k: int = K, size: int = TUPLE) -> np.ndarray:
    """The tuples' hashes (64 unsigned 32-bit numbers) of a whole text; null is empty, whose hashes are all 0.

    For each of the hash functions the ``size`` least k-mers are taken (fewer where the text has fewer), put in text
    order and hashed together. Of equal values in a function the first in the text counts.
    """
    h = kmers(text or "", k)
    n, out = len(h), np.zeros(TUPLES, dtype=np.uint32)
    if not n:
        return out
    step = max(1, 200_000 // n)  # functions at a time, so that their values stay in the processor's cache
    for f in range(0, TUPLES, step):
        v = h[None, :] ^ XOR[f : f + step, None]
        v *= MUL[f : f + step, None]
        rows, chosen = np.arange(len(v)), []
        for _ in range(min(size, n)):
            chosen.append(v.argmin(1))
            v[rows, chosen[-1]] = 0xFFFFFFFF
        x = (np.uint64(0x2545F491) + rows.astype(np.uint64) + np.uint64(f)) * np.uint64(0x9E3779B97F4A7C15)
        for at in np.sort(np.stack(chosen), 0):
            x = (x ^ h[at].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            x ^= x >> np.uint64(29)
        out[f : f + step] = (x >> np.uint64(16)).astype(np.uint32)
    return out


def shown(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The part of equal tuples, from 0 to 1."""
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The text whose last half (rounded down) is replaced by the first as many code points of another, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: A null id sorts last.
LAST = -(2**63)


def cuts_of(keys: DataFrame, n: int, ranges: int, per_range: int = 10) -> list[tuple[int, int, int]]:
    """Rising cuts of ``n`` rows (id, h, salt) into about so many ranges, from a sample of ``per_range`` rows a range.

    Rows of one id and hash are parted only where they fill ranges of their own: their numbers could change if a lost
    executor's input is cut anew, and then only such ranges surely hold some of them still.
    """
    share = ranges * per_range / max(n, 1)
    sample = sorted(tuple(r) for r in keys.where(hash_unit("id", "h", "salt") < share).collect())
    cuts = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
    near = [(-1, -1), *(c[:2] for c in cuts), (-1, -1)]
    return sorted({c if c[:2] in (near[k], near[k + 2]) else (*c[:2], -1) for k, c in enumerate(cuts)})


def compare_with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE, most_ranges: int = MOST_RANGES) -> DataFrame:
    """Fingerprints of every document, of its edited text, and of the next document by descending id (last: the first).

    Rows are ordered by (id, hash of the text, a number from the row's place in the input), which no two rows share, and
    cut into ranges of that order: so rows of one id, and even equal rows, are spread over as many ranges as they fill.
    A row goes to the task of its range, and the greatest of each range also to the range above, whose last row it
    follows. So texts are shuffled once, and a task holds one document and the next at a time. The driver holds some ten
    numbers for each range, and the executors a row for each; there are ``most_ranges`` at most, beyond which ranges
    grow, which are sorted on disk. A null id sorts last; rows of one id are ordered by the rising hash of their texts,
    equal texts follow each other. A null text is empty; other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    # the place decides between equal rows only, which are alike in every result
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.bitwise_not(F.xxhash64(text)).alias("h"), F.monotonically_increasing_id().alias("salt"), text.alias("text"))
    n = docs.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    ranges = min(-(-n // rows_per_range), most_ranges)
    cuts = cuts_of(rows.select("id", "h", "salt"), n, ranges) if ranges > 1 else []
    ids = np.array([c[0] for c in cuts], dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(id: pd.Series, h: pd.Series, salt: pd.Series) -> pd.Series:  # the number of a range grows as keys fall
        at = np.searchsorted(ids, id.to_numpy(), side="left")
        for k in np.flatnonzero(np.searchsorted(ids, id.to_numpy(), side="right") > at):  # a cut has this id
            at[k] = bisect.bisect_left(cuts, (id.iat[k], h.iat[k], salt.iat[k]))
        return pd.Series(len(cuts) - at, dtype="int32")

    rows = rows.withColumn("part", part_of("id", "h", "salt"))
    key = F.struct("id", "h", "salt")
    # the first row of each range follows the last of the range before; that of the first range closes the ring
    found = sorted((r["part"], tuple(r["head"])) for r in rows.groupBy("part").agg(F.max(key).alias("head")).collect())
    to = spark.createDataFrame([(p, id, h, found[k - 1][0]) for k, (p, (id, h, _)) in enumerate(found)], "part int, id long, h long, up int")
    top = rows.join(F.broadcast(to), ["part", "id", "h"]).groupBy("up", "id", "h").agg(F.first("text").alias("text"))
    guests = top.select(F.col("id").alias("doc_id"), "id", "h", F.lit(0).cast("long").alias("salt"), "text", F.col("up").alias("part"), F.lit(True).alias("guest"))
    every = rows.select("doc_id", "id", "h", "salt", "text", "part", F.lit(False).alias("guest")).unionByName(guests)
    dealt = every.repartition("part").sortWithinPartitions("part", "guest", F.desc("id"), F.desc("h"), F.desc("salt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # part, id, whether there is none, text, sketch
        for b in batches:
            out = []
            for part, doc, null, text in zip(b["part"].tolist(), b["id"].tolist(), b["no_id"].tolist(), b["text"].tolist(), strict=True):
                own = last[4] if last is not None and last[3] == text else sketch(text)
                if last is not None and last[0] == part:
                    changed = edit(last[3], text)
                    other = own if changed == text else sketch(changed)
                    out.append((last[1], last[2], len(last[3]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), shown(last[4]), shown(other), likeness(last[4], other), likeness(last[4], own)))
                last = (part, doc, null, text, own)
            yield pd.DataFrame(out, columns=["id", "no_id", *NAMES[1:]])

    made = dealt.select("part", "id", F.col("doc_id").isNull().alias("no_id"), "text").mapInPandas(run, "id long, no_id boolean, " + SCHEMA.split(", ", 1)[1])
    return made.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), *NAMES[1:])

"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeloom.llm import bpe
from codeloom.llm.common import stash

CAPACITIES = (512, 1024, 2048, 4096)
#: Documents, and tokens, that one shard packs; the number of shards grows with the input.
DOCS_PER_SHARD, TOKENS_PER_SHARD = 4_096, 2_000_000
#: White space that the tokenizer library's pattern matching fails at when it is much longer.
BLANKS = re.compile(r"\s{2000}")
SCHEMA = "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_capacity int, bin_offset int, bin_used int, token_ids array<int>"


def bin_cost(capacity: int) -> float:
    """Cost of training on a bin: a fixed part, a linear part and a quadratic part for attention."""
    return 64 + capacity + capacity * capacity / 32768


def pieces_of(length: int, largest: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; a document longer than the largest bin is cut into full ones and a rest."""
    return [(at, min(largest, length - at)) for at in range(0, length, largest)]


def pack_shard(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Best fit, longest first: (bin of each item, offset of each item, final capacity of each bin).

    An item goes to the open bin that it leaves fullest, whatever that bin's capacity; of several, to the oldest. Where none has room, a bin of the
    capacity with the least cost for each token it can still be given is opened: what remains to be placed bounds that.
    In the end each bin is made as small as its contents permit. Lengths must be from 1 to the largest capacity.
    """
    capacities = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by free space
    mask = 0  # bit r is set while room[r] has a bin
    used: list[int] = []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    cap_of: list[int] = []
    rest = sum(lengths)
    for i in order:
        n = lengths[i]
        if high := mask >> n:
            free = n + (high & -high).bit_length() - 1
            b = heapq.heappop(room[free])
            if not room[free]:
                mask &= ~(1 << free)
        else:
            free = min((c for c in capacities if c >= n), key=lambda c: (bin_cost(c) / min(c, rest), c))
            b = len(used)
            used.append(0)
            cap_of.append(free)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        rest -= n
        left = free - n
        if left:
            heapq.heappush(room[left], b)
            mask |= 1 << left
    final = [next(c for c in capacities if c >= u) for u in used]
    return bins, offsets, final


def pack(df: DataFrame, doc_id: Column, tokens: Column, capacities: Sequence[int] = CAPACITIES, docs_per_shard: int = DOCS_PER_SHARD, tokens_per_shard: int = TOKENS_PER_SHARD) -> DataFrame:
    """Pack the token ids of every row of ``df``; one row for each piece: its document, place in the document, bin, place
    in the bin, and ``token_ids``, of which the rows of a bin in the order of ``bin_offset`` are its contents.

    ``tokens`` is binary, 32-bit little-endian ids (see ``tokens`` and ``encoded``). They are made once and written; each
    row then has a number, by whose hash rows are dealt to shards, so neither repeated rows nor a hot id meet in one. A
    shard is a bounded number of documents and of tokens, but for a document that is longer by itself. Null or no tokens
    give one piece of 0 tokens without a bin; a null id stays null; repeated rows are packed each on their own; equal
    lengths are placed in the order of the rows. Bin ids are unique over all shards. Other columns of ``df`` are not used;
    an empty table gives no row.
    """
    rows = df.select(doc_id.cast("long").alias("doc_id"), F.coalesce(tokens, F.lit(b"")).alias("ids"))
    rows = rows.select("doc_id", "ids", F.octet_length("ids").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    rows = stash(rows, "tokens")
    total = rows.agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes")).first()
    shards = max(1, math.ceil(total["docs"] / docs_per_shard), math.ceil((total["bytes"] or 0) / 4 / tokens_per_shard))
    largest = max(capacities)
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def one(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("row")
        ids = shard.column("ids").combine_chunks()
        length = np.array([len(x) // 4 for x in ids.to_pylist()], dtype=np.int64)
        cut = np.maximum(1, -(-length // largest))
        whose = np.repeat(np.arange(len(length)), cut)
        piece = np.arange(len(whose)) - np.repeat(np.cumsum(cut) - cut, cut)
        start = piece * largest
        n = np.minimum(largest, length[whose] - start)
        some = np.flatnonzero(n)
        bins, offsets, caps = (np.array(x, dtype=np.int64) for x in pack_shard(n[some].tolist(), capacities))
        used = np.bincount(bins, n[some], len(caps)).astype(np.int64)

        def put(values: np.ndarray, kind: pa.DataType) -> pa.Array:  # null for pieces without a bin
            out = np.zeros(len(n), dtype=np.int64)
            out[some] = values
            return pa.array(out, mask=n == 0).cast(kind)

        # pieces follow each other as the tokens do, so the lists are runs of one array
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids.to_pylist()), dtype="<i4"))
        base = shard.column("shard")[0].as_py() << 32
        columns = [
            shard.column("doc_id").take(pa.array(whose)), pa.array(piece).cast("int32"), pa.array(start), pa.array(n), put(base + bins, pa.int64()), put(caps[bins], pa.int32()),
            put(offsets, pa.int32()), put(used[bins], pa.int32()), pa.ListArray.from_arrays(pa.array(at), values),
        ]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=schema.names).cast(schema)

    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "doc_id", "ids")
    return dealt.groupBy("shard").applyInArrow(one, SCHEMA)


def encoded(ids: Column) -> Column:
    """An array<int> column of token ids in the form that ``pack`` takes."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if x is None else np.asarray(x, dtype="<i4").tobytes() for x in b], dtype=object)

    return run(ids)


def tokens(spark: SparkSession, text: Column, vocabulary: str, pattern: str) -> Column:
    """Token ids of a text column by the ranks of a ``.tiktoken`` file, without special tokens, in the form that ``pack``
    takes; null texts are null.

    The tokenizer library encodes. ``bpe`` gives the same ids by a method of its own, and takes the texts with runs of
    white space so long that the library could run out of stack.
    """
    with open(vocabulary, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    held = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = {t: i for i, t in enumerate(held.value)}
        library = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        own = None
        for texts in batches:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                elif BLANKS.search(t):
                    own = own or bpe.Codec(held.value, pattern)
                    out.append(np.array(own.encode(t), dtype="<i4").tobytes())
                else:
                    out.append(library.encode_to_numpy(t, disallowed_special=()).astype("<i4").tobytes())
            yield pd.Series(out, dtype=object)

    return encode(text)

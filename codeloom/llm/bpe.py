"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the rest by merging linked bytes off a heap."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pre-tokens whose encoding a worker remembers, and their characters; beyond either the memory becomes the older one, of
#: which the words that come again are taken over, and the one that was older goes.
MEMORY, MEMORY_CHARS = 400_000, 8_000_000
#: Characters of the texts whose new words are looked up together, but for one longer text; and ids digested at once.
GROUP_CHARS, RUN = 250_000, 250_000
BEYOND = re.compile("[\U00010000-\U0010ffff]").search


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank from the contents of a ``.tiktoken`` file: ranks are 0, 1, 2 and so on without gaps."""
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in data.splitlines() if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def mix(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Another hash of 64-bit hashes for each seed."""
    x = h ^ (np.asarray(seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by displacement: n keys to slots 0..n-1, one seed for each bucket of about four keys.

    Buckets are seated from the largest to the smallest; the last, of one key each, take the slots that are left,
    written as the slot itself.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(h)) != n:
            raise ValueError("keys are repeated, or two have one hash")
        self.buckets = max(1, n // 4)
        self.seed = np.zeros(self.buckets, dtype=np.int64)
        bucket = (mix(h, 1) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        taken = np.zeros(n, dtype=bool)
        slot = np.zeros(n, dtype=np.int64)
        single = []
        for b in np.argsort(-sizes, kind="stable").tolist():
            members = order[bounds[b] : bounds[b + 1]]
            if len(members) == 0:
                break
            if len(members) == 1:
                single.append((b, members[0]))
                continue
            first = 2
            while True:
                seeds = np.arange(first, first + 64)
                tries = (mix(h[members][None, :], seeds[:, None]) % np.uint64(n)).astype(np.int64)
                free = ~taken[tries].any(1)
                for k in np.flatnonzero(free):
                    if len(set(tries[k].tolist())) == len(members):
                        break
                else:
                    first += 64
                    continue
                break
            self.seed[b] = seeds[k]
            slot[members] = tries[k]
            taken[tries[k]] = True
        for (b, member), at in zip(single, np.flatnonzero(~taken).tolist(), strict=True):
            self.seed[b] = -1 - at
            slot[member] = at
        self.key_of = np.empty(n, dtype=np.int64)
        self.key_of[slot] = np.arange(n)
        self.hash_of = h[self.key_of]

    def find(self, words: list[bytes], keys: list[bytes]) -> list[int]:
        """The number of each word among the keys, or -1."""
        if not words or not self.n:
            return [-1] * len(words)
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
        seed = self.seed[(mix(h, 1) % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(seed < 0, -1 - seed, (mix(h, np.maximum(seed, 0)) % np.uint64(self.n)).astype(np.int64))
        found = np.where(self.hash_of[slot] == h, self.key_of[slot], -1).tolist()
        return [k if k >= 0 and keys[k] == w else -1 for k, w in zip(found, words, strict=True)]


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merge the lowest-ranked neighbours, leftmost first, until none is left. Linear memory, n log n steps."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = parts[i]
        if left is None or (j := after[i]) >= n or len(left) + len(parts[j]) != size:
            continue  # one of the two has been merged since
        parts[i] = left = left + parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(left + parts[k])) is not None:
                heapq.heappush(heap, (r, i, size + len(parts[k])))
        if (k := before[i]) >= 0 and (r := ranks.get(parts[k] + left)) is not None:
            heapq.heappush(heap, (r, k, size + len(parts[k])))
    return tuple(ranks[p] for p in parts if p is not None)


def written_out(pattern: str) -> str | None:
    """A pattern of ``regex`` for ``re``, on texts of 16-bit characters: properties and white space are written out as
    ranges. None where it holds anything else whose meaning could differ."""
    every = "".join(map(chr, range(0x10000)))
    runs = lambda kind: "".join(re.escape(m[0]) if len(m) == 1 else f"{re.escape(m[0])}-{re.escape(m[-1])}" for m in regex.findall(f"{kind}+", every))
    out, inside = [], False
    for kind, other, sign in re.findall(r"(\\p\{\w+\}|\\s)|(\\S|\\.|\(\?[^!=:]|\(\*)|(.)", pattern, re.DOTALL):
        if kind:
            out.append(runs(kind) if inside else f"[{runs(kind)}]")
        elif other == r"\S" and not inside:
            out.append(f"[^{runs(r'\s')}]")
        elif other or inside and sign == "[":
            return None
        else:
            inside = sign == "[" or inside and sign != "]"
            out.append(sign)
    return "".join(out)


@functools.cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern as ``regex`` finds them; found by ``re``, which takes half the time, where it is able to."""
    slow = regex.compile(pattern).findall
    plain = written_out(pattern)
    if plain is None:
        return slow
    fast = re.compile(plain).findall
    return lambda text: fast(text) if text.isascii() or not BEYOND(text) else slow(text)


class Codec:
    """Encoding and decoding with one vocabulary; equal to the tiktoken library without special tokens."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash | None = None, memory: int = MEMORY):
        self.tokens, self.table, self.memory = tokens, table or PerfectHash(tokens), memory
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.split = splitter(pattern)
        self.ids_of: dict[str, bytes] = {}  # 32-bit little-endian
        self.older: dict[str, bytes] = {}
        self.held = 0  # characters
        # bytes and decimal numbers of all tokens, from which those of many ids are put together at once
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        said = np.array([f"{i}," for i in range(len(tokens))], dtype="S")
        self.said = said.view(np.uint8).reshape(len(said), -1)

    def learn(self, words: Iterable[str]) -> None:
        """Fill the memory with the words' encodings: the perfect hash first, merging for those it does not hold."""
        new = []
        for w in words:
            if (ids := self.older.get(w)) is None:
                new.append(w)
            else:
                self.ids_of[w] = ids
            self.held += len(w)
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, d, k in zip(new, data, self.table.find(data, self.tokens), strict=True):
            ids = (k,) if k >= 0 else merge(d, self.ranks)
            self.ids_of[w] = struct.pack(f"<{len(ids)}i", *ids)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 32-bit little-endian."""
        if len(self.ids_of) > self.memory or self.held > MEMORY_CHARS:
            self.older, self.ids_of, self.held = self.ids_of, {}, 0
        words = list(map(self.split, texts))
        ids = [list(map(self.ids_of.get, w)) for w in words]
        gaps = [[i for i, x in enumerate(g) if x is None] for g in ids]
        self.learn({w[i] for w, gap in zip(words, gaps, strict=True) for i in gap})
        for w, g, gap in zip(words, ids, gaps, strict=True):
            for i in gap:
                g[i] = self.ids_of[w[i]]
        return list(map(b"".join, ids))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed([text or ""])[0], dtype="<i4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest(self, packed: bytes) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the bytes decoded from the ids)."""
        ids = np.frombuffer(packed, dtype="<i4")
        said, data = hashlib.sha256(), hashlib.sha256()
        for at in range(0, len(ids), RUN):
            run = ids[at : at + RUN]
            signs = self.said[run]
            signs = signs[signs != 0]
            said.update(signs if at + RUN < len(ids) else signs[:-1])  # no comma at the end
            size = self.size[run]
            ends = np.cumsum(size)
            data.update(self.bytes[np.repeat(self.start[run] - ends + size, size) + np.arange(ends[-1])])
        return len(ids), said.hexdigest(), data.hexdigest()

    def digests(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """``digest`` of each text, null as empty, in their order."""
        group, held = [], 0
        for t in texts:
            group.append(t or "")
            held += len(group[-1])
            if held >= GROUP_CHARS:
                yield from map(self.digest, self.packed(group))
                group, held = [], 0
        yield from map(self.digest, self.packed(group))


_SHARED: dict[str, Codec] = {}


def shared(key: str, tokens: list[bytes], pattern: str, table: PerfectHash) -> Codec:
    """The codec of a vocabulary and pattern, named by ``key``; a process keeps the last one and its memory for later tasks."""
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = Codec(tokens, pattern, table)
    return _SHARED[key]


def codec_columns(spark, path: str, pattern: str, text: Column, ids: bool = False) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of a text column, or with ``ids`` array<int>; null texts are empty.

    The driver reads the rank file, checked to have 64 MB at most, and sends it and the perfect hash to executors. It is a
    column: repeated rows get equal results, other columns of any name and empty tables are left as they are.
    """
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64_000_000:
        raise ValueError("the vocabulary is too large to send")
    tokens = read_ranks(data)
    held = spark.sparkContext.broadcast((tokens, PerfectHash(tokens)))
    key = hashlib.sha256(data + pattern.encode()).hexdigest()

    if ids:

        @F.pandas_udf("array<int>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = shared(key, held.value[0], pattern, held.value[1])
            for texts in batches:
                yield pd.Series([codec.encode(t) for t in texts], dtype=object)

        return encode(text)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = shared(key, held.value[0], pattern, held.value[1])
        for texts in batches:
            yield pd.DataFrame(codec.digests(texts), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)

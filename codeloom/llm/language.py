"""Language identification by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import hash_unit

#: Bounds of what the dictionaries are made of: documents of each language on average; bytes of each dictionary, of all,
#: and what shorter ones are filled up to with spaces (the library ignores less).
DOCS_PER_LANGUAGE = 160
DICTIONARY_BYTES, TOTAL_BYTES, LEAST_BYTES = 96_000, 32_000_000, 8
#: A prediction is rejected if the second language's dictionary makes a text larger by no more than this part of it.
MARGIN = 0.004
#: Bytes of a text that are compressed at once, so that the dictionary stays in reach and the text does not become its own.
PIECE = 4096
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is compressed: words in lower case with single spaces, so that capitals, digits and marks have no say."""
    return OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def pieces(data: bytes) -> Iterator[bytes]:
    """All of the data in runs of ``PIECE`` bytes at most, cut at spaces where there are some."""
    at = 0
    while len(data) - at > PIECE:
        end = data.rfind(b" ", at, at + PIECE) + 1
        end = end if end > at else at + PIECE
        yield data[at:end]
        at = end
    yield data[at:]


def settings(size: int) -> zstandard.ZstdCompressionParameters:
    """Matches from three bytes, parsed optimally: related languages differ in short syllables."""
    return zstandard.ZstdCompressionParameters.from_level(3, dict_size=size, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0)


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, size: int = DICTIONARY_BYTES, total: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries from rows (text, lang, key), the commonest language first (ties: by name).

    The sample is fixed by a hash of key and text and has a mean size per language; it is made into dictionaries on the
    executors, a language in a task. The driver gets the dictionaries: ``size`` bytes each, less for many languages, so
    that all together have ``total`` bytes, but 2,000 bytes each at the least. Every language gets one, however little
    text it has. Rows with a null language, or a text that is null or has no letter, are not used; equal texts of a
    language count once; other columns are ignored; an empty table gives no language.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", "key")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    counts = {r["lang"]: r["n"] for r in counts.collect()}
    size = max(2_000, min(size, total // max(len(counts), 1)))
    share = rows.sparkSession.createDataFrame(sorted((k, docs_per_language / n) for k, n in counts.items()), "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where(hash_unit(F.col("key"), F.xxhash64("text"), F.lit("lang")) < F.col("share"))
    # of a longer document, no more than a dictionary holds
    sample = sample.select("lang", F.substring("text", 1, size).alias("text")).distinct()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, left = [], size
        texts = [letters(t) for t in sorted(pdf["text"].tolist())]
        for data in sorted(texts, key=xxhash.xxh3_64_intdigest):
            if len(data) <= left:
                parts.append(data)
                left -= len(data)
        data = b" ".join(parts or [min(texts)[:size]])
        return pd.DataFrame([(pdf["lang"].iloc[0], data.ljust(LEAST_BYTES))], columns=["lang", "data"])

    got = {r["lang"]: bytes(r["data"]) for r in sample.groupBy("lang").applyInPandas(build, "lang string, data binary").collect()}
    missing = sorted(set(counts) - set(got))  # of which the hash took no document
    if missing:
        first = rows.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min(F.substring("text", 1, size)).alias("text"))
        got |= {r["lang"]: bytes(r["data"]) for r in first.groupBy("lang").applyInPandas(build, "lang string, data binary").collect()}
    return {k: got[k] for k in sorted(got, key=lambda k: (-counts[k], k))}


class Judge:
    """Compressed sizes of a text against each language's dictionary: the sum over its pieces, each compressed alone.

    The gap between two languages therefore grows with the text, as the margin does.
    """

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.packers = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = settings(len(dictionaries[lang]))
            d.precompute_compress(compression_params=how)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected). No letter: ``und``, 0, rejected. Equal sizes: the commoner language, rejected."""
        if not text or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        if not self.langs:
            return UNKNOWN, 0.0, True
        data = letters(text)
        totals = [0] * len(self.packers)
        for piece in pieces(data):
            for k, p in enumerate(self.packers):
                totals[k] += len(p.compress(piece))
        sizes = sorted((size, k) for k, size in enumerate(totals))
        best = self.langs[sizes[0][1]]
        if len(sizes) == 1:
            return best, 1.0, False
        gap = sizes[1][0] - sizes[0][0]
        return best, 1 - 0.5 * math.exp(-0.1 * gap), gap <= MARGIN * sizes[1][0]


def identify(dictionaries: dict[str, bytes], text: Column) -> Column:
    """struct<lang string, score double, rejected boolean> of a text column. The dictionaries are bounded by their size.

    Null and empty texts and those without a letter are ``und``, 0, rejected. It is a column: repeated rows get equal
    results, other columns of any name and empty tables are left as they are.
    """

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(dictionaries)
        for texts in batches:
            yield pd.DataFrame([judge(t) for t in texts], columns=["lang", "score", "rejected"])

    return run(text)

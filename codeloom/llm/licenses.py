"""Licence scan by digests of canonical text, with DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.license_texts import DIGESTS, KNOWN

#: Lines that name a holder or a year and so differ between copies of one licence.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright +(\(c\)|©|[0-9]{4}|by |[\[{<])|\(c\) *[0-9]{4}|© *[0-9]{4}|all rights reserved)[^\n]*$"
#: Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("favour", "favor"), ("https:", "http:"), ("©", "(c)"), ("and/or", "and or")]
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Lower case, copyright lines emptied, spellings unified, runs of other characters one space; lines are kept apart."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, NOT_WORD, " ")


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def canonical(text: str) -> str:
    """The same for one Python string, for the table of known licences."""
    t = regex.sub(COPYRIGHT, "", text.lower())
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return regex.sub(r"[ \n]+", " ", regex.sub(NOT_WORD, " ", t)).strip(" ")


def digests(known: Iterable[tuple[str, str]] = KNOWN, more: Iterable[tuple[str, str]] = ()) -> dict[str, str]:
    """Digest to identifier, of known texts and of texts known by their digests only. Two licences must not share one."""
    out: dict[str, str] = {}
    for name, d in [*((name, hashlib.sha256(canonical(text).encode()).hexdigest()) for name, text in known), *more]:
        if out.setdefault(d, name) != name:
            raise ValueError(f"{name} and {out[d]} have one canonical text")
    return out


def scan(df: DataFrame, text: str = "text", known: Iterable[tuple[str, str]] = KNOWN) -> DataFrame:
    """Adds ``digest`` of the whole canonical text, ``license_id`` of the licence that the whole text is (null: none),
    ``notices`` (sorted identifiers of licences that one whole line is) and ``n_notice_lines`` to every row.

    Columns of ``df`` with those names are replaced, and names that begin with two underscores are the scan's own. Null
    and empty texts have the digest of the empty text and no licence; repeated rows stay, each with its result; an empty
    table gives no row; a text is read whole, however long. The known digests are a fixed table of a few dozen rows, so the hash join broadcasts it and no row of
    ``df`` is shuffled.
    """
    spark = df.sparkSession
    table = digests(known, DIGESTS)
    ids = spark.createDataFrame(sorted(table.items()), "__known string, __license string")
    df = df.drop(*(set(df.columns) & {"digest", "license_id", "notices", "n_notice_lines"}))
    by_digest = F.create_map(*(F.lit(x) for item in sorted(table.items()) for x in item))
    rows = df.withColumn("__lines", canonical_lines(F.col(text))).withColumn("digest", F.sha2(whole(F.col("__lines")), 256))
    # a line that is no known text of one line has another first word, which spares most digests
    first = sorted({canonical(t).split(" ")[0] for _, t in known})
    lines = F.filter(F.transform(F.split("__lines", "\n"), lambda x: F.trim(x)), lambda x: F.substring_index(x, " ", 1).isin(first))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(by_digest, F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = rows.withColumn("__found", found)
    rows = rows.join(F.broadcast(ids), F.col("digest") == F.col("__known"), "left")
    return rows.select(*df.columns, "digest", F.col("__license").alias("license_id"), F.array_join(F.sort_array(F.array_distinct("__found")), ",").alias("notices"), F.size("__found").cast("long").alias("n_notice_lines"))


def sql(known: Iterable[tuple[str, str]] = KNOWN) -> str:
    """DuckDB SQL of the query on ``documents``."""
    lines = f"regexp_replace(lower(coalesce(\"text\", '')), '{COPYRIGHT}', '', 'g')"
    for a, b in SPELLINGS:
        lines = f"replace({lines}, '{a}', '{b}')"
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(digests(known, DIGESTS).items()))
    return f"""
with known(digest, license_id) as (values {values})
, m as (select map(list(digest), list(license_id)) m from known)
, c as (select doc_id, regexp_replace({lines}, '{NOT_WORD}', ' ', 'g') lines from documents)
, d as (select doc_id, sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'), ' ')) digest,
    list_filter(list_transform(string_split(lines, chr(10)), lambda x: m.m[sha256(trim(x, ' '))]), lambda y: y is not null) found from c, m)
select doc_id, d.digest as digest, known.license_id as license_id,
  array_to_string(list_sort(list_distinct(found)), ',') as notices, cast(len(found) as bigint) as n_notice_lines
from d left join known on d.digest = known.digest
"""

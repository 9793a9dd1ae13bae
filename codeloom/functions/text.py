"""Text functions as column expressions; the few that need a scanner are pandas UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codeloom.functions import scan


def norm(s: Column) -> Column:
    """Stripped, runs of white space as one space."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clip(s: Column, n: int) -> Column:
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def ident(s: Column) -> Column:
    return F.lower(F.replace(F.trim(s), F.lit('"'), F.lit("")))


def unquote(s: Column) -> Column:
    return F.upper(F.replace(norm(s), F.lit('"'), F.lit("")))


def line_of(text: Column, index: Column) -> Column:
    """Number of the line that holds the code point at a 0-based index."""
    head = F.substr(text, F.lit(1), index.cast("int"))
    return F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def literal(s: Column) -> Column:
    """Value of a string literal: national prefix, q-quotes, doubled quotes."""
    bare = F.regexp_replace(s, r"^[nN](?=[qQ]?')", "")
    return F.when(bare.rlike(r"(?s)^[qQ]'.*'$"), F.regexp_replace(bare, r"(?s)^[qQ]'.(.*).'$", "$1")).otherwise(F.replace(F.regexp_replace(bare, r"(?s)^'(.*)'$", "$1"), F.lit("''"), F.lit("'")))


def token_estimate(s: Column) -> Column:
    return F.ceil(F.char_length(s) / 4)


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9_]+", "-"), r"^-+|-+$", "")


def phrase(identifier: Column) -> Column:
    """An identifier as words with a capital first letter."""
    words = F.replace(F.lower(identifier), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D")


SEVERITIES = ("HIGH", "MEDIUM", "LOW", "INFO")


def severity_rank(s: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for k, name in enumerate(SEVERITIES):
        out = F.when(s == name, k).otherwise(out)
    return out


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def numbered_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last of a text, each after its number, which is padded to the width of the last."""
    part = F.slice(lines(text), first, F.greatest(last - first + 1, F.lit(0)))
    width = F.char_length(last.cast("string"))
    return F.array_join(F.transform(part, lambda x, i: F.concat(_pad((i + first).cast("string"), width), F.lit("  "), x)), "\n")


def _pad(s: Column, width: Column) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(width - F.char_length(s), F.lit(0)).cast("int")), s)


def squeezed(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", "")


def is_subsequence(small: Column, big: Column) -> Column:
    """Whether the code points of one text occur in another in the same order (two-pointer fold)."""
    end = F.aggregate(F.split(big, ""), F.lit(0), lambda i, c: F.when(F.substr(small, i + 1, F.lit(1)) == c, i + 1).otherwise(i))
    return F.when(F.char_length(small) == 0, True).otherwise(end == F.char_length(small))


#: Symbols of the console and their ASCII forms.
FOLDS = {"…": "...", "→": "->", "←": "<-", "≥": ">=", "≤": "<=", "≠": "!=", "–": "-", "—": "-", "•": "*", "·": "-", "✓": "+", "✗": "x", "“": '"', "”": '"', "‘": "'", "’": "'", "×": "x", "│": "|", "├": "+", "└": "+", "─": "-"}


def fold_ascii(s: Column) -> Column:
    single = {k: v for k, v in FOLDS.items() if len(v) == 1}
    s = F.translate(s, "".join(single), "".join(single.values()))
    for k, v in FOLDS.items():
        if len(v) > 1:
            s = F.replace(s, F.lit(k), F.lit(v))
    return s


def to_ascii(text: str) -> str:
    for k, v in FOLDS.items():
        text = text.replace(k, v)
    return text


def mermaid_name(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), r"[^A-Z0-9_]", "_")


def escape_markdown(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"([\\|`*_<>])", r"\\$1"), r"\s+", " ")


def clean_comment(raw: str | None) -> str:
    """The first paragraph of a comment without its frame, 500 code points at most; a leading 'purpose:' is dropped."""
    if not raw:
        return ""
    body = re.sub(r"^/\*+|\*+/$", "", raw.strip())
    out: list[str] = []
    for line in body.splitlines():
        s = re.sub(r"^\s*(?:--+|rem\b|\*+|[-=*#]{2,})\s*|[-=*#]{3,}\s*$", "", line, flags=re.I).strip()
        if not s:
            if out:
                break
            continue
        if out and re.match(r"(?i)(parameters?|params?|arguments?|returns?|history|author|notes?|change log|example|usage|raises|exceptions?|see also)\b\s*:?", s):
            break
        out.append(s)
    said = re.sub(r"(?i)^(purpose|description|summary)\s*[:\-]\s*", "", " ".join(" ".join(out).split()))
    return said[:500]


@F.pandas_udf(StringType())
def mask_sql(s: pd.Series) -> pd.Series:
    """Text of the same length without comments and the insides of literals."""
    return s.map(scan.mask, na_action="ignore")


@F.pandas_udf(StringType())
def cleaned(s: pd.Series) -> pd.Series:
    return s.map(clean_comment)


@F.pandas_udf(StringType())
def decode_cp1252(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("cp1252", "replace"), na_action="ignore")


def decode(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else windows-1252; a byte-order mark goes."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(decode_cp1252(content))
    return F.regexp_replace(text, "^﻿", "")

"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import hash_unit, stash

#: Labelled documents that a model is fitted on at most (mean of a sample by hash); and terms of the learned lexicon.
SAMPLE, TERMS = 20_000, 3_000
PREFIXES = (4, 5, 6)
#: Insults in four languages, known before any label is seen.
INSULTS = frozenset("idiot moron stupid loser trash scum clown pathetic disgusting worthless dumb fool garbage filth vermin imbecile jerk dummkopf trottel abschaum arschloch vollidiot versager widerlich crétin abruti connard ordure débile minable imbécile estúpido basura escoria payaso inútil asqueroso".split())
#: Second-person words in four languages.
SECOND = frozenset("you your yours yourself du dich dir dein deine euch euer tu te toi ton ta tes vous votre vos usted ustedes tú vosotros vuestro".split())
WORD = re.compile(r"[^\W\d_]+")
#: A run that holds a digit or sign which may stand for a letter. It begins where a run does and gives nothing back, so
#: each character is looked at a fixed number of times.
MIXED = re.compile(r"(?<![^\s.,;:?\"()])[^\s.,;:?\"()0-9@$!|*]*+[0-9@$!|*][^\s.,;:?\"()]*+")
LETTER = re.compile(r"[^\W\d_]")
LEET = str.maketrans("013457@$!|", "oieastasii")
REPEAT = re.compile(r"([^\W\d_])\1\1+")
FEATURES = ["n_words", "log_len", "insults", "insult_rate", "terms", "term_rate", "weight_max", "weight_mean", "prefixes", "prefix_rate", "prefix_max", "second_rate", "nearest", "caps", "caps_words", "exclaim", "question", "punct", "digits", "mixed_rate", "obfuscated", "repeats"]


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.starts = {w[:4] for w in [*self.words, *self.prefixes, *INSULTS, *SECOND]}


def lexicon_of(counts: list[tuple[str, int, int]], pos: int, neg: int) -> Lexicon:
    """Terms far likelier in toxic documents: rows (term, toxic documents with it, others with it)."""
    out = Lexicon()
    for term, p, n in counts:
        odds = math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1))
        if odds > 1.5:
            (out.prefixes if term.endswith("*") else out.words)[term.rstrip("*")] = odds
    out.__post_init__()
    return out


def nearest(a: list[int], b: list[int]) -> int:
    """Least distance between two sorted lists of positions, -1 if one is empty; a merge over all of both."""
    best, i, j = -1, 0, 0
    while i < len(a) and j < len(b):
        gap = abs(a[i] - b[j])
        if best < 0 or gap < best:
            best = gap
            if not best:
                break
        if a[i] < b[j]:
            i += 1
        else:
            j += 1
    return best


def disguised(text: str) -> list[str]:
    """Runs of three characters or more in which letters and signs or digits mix; marks at the ends do not count."""
    out = []
    for m in MIXED.findall(text):
        m = m.strip("!*|")
        if len(m) > 2 and LETTER.search(m) and any(c in m for c in "0123456789@$!|*"):
            out.append(m)
    return out


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Dense features of a whole text; null is empty."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    per = 1.0 / max(n, 1)
    insult, second, hits, heads, weights, head_weights = [], [], 0, 0, [], []
    starts, known, pre = lexicon.starts, lexicon.words, lexicon.prefixes
    for i, w in enumerate(words):
        if w[:4] not in starts:
            w = w.lower()
            if w[:4] not in starts:
                continue
        w = w.lower()
        bad = False
        if w in INSULTS:
            insult.append(i)
            bad = True
        if w in SECOND:
            second.append(i)
        if w in known:
            weights.append(known[w])
            bad = True
        best = max((pre.get(w[:k], 0.0) for k in PREFIXES if len(w) > k), default=0.0)
        if best:
            head_weights.append(best)
            bad = True
        if bad and (not insult or insult[-1] != i):
            insult.append(i)
    hits, heads = len(weights), len(head_weights)
    near = nearest(insult, second)
    length = max(len(text), 1)
    caps = sum(1 for w in words if len(w) > 2 and w.isupper())
    masked = [m.lower().translate(LEET) for m in disguised(text)]
    hidden = sum(1 for m in masked if (m in INSULTS or m in known or re.sub(r"[^\w]", "", m) in INSULTS))
    upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    marks = len(re.findall(r"[^\w\s]", text))
    plain = [i for i in insult if words[i].lower() in INSULTS]
    return [
        n, math.log1p(len(text)), len(plain), len(plain) * per, hits, hits * per, max(weights, default=0.0), sum(weights) / hits if hits else 0.0, heads, heads * per, max(head_weights, default=0.0),
        len(second) * per, 1 / (1 + near) if near >= 0 else 0.0, upper / length, caps * per, text.count("!") * per, text.count("?") * per, marks / length, len(re.findall(r"\d", text)) / length, len(masked) * per, hidden, len(REPEAT.findall(text)) * per,
    ]


def matrix(texts, lexicon: Lexicon) -> np.ndarray:
    return np.array([features(t, lexicon) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


class Boosted:
    """Trees of fixed depth for the logistic loss, on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, l2: float = 1.0, bins: int = 32, least: int = 5):
        self.rounds, self.depth, self.rate, self.l2, self.bins, self.least = rounds, depth, rate, l2, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        # features that are 0 nearly everywhere still need an edge above 0
        for j in range(m):
            positive = x[x[:, j] > 0, j]
            if len(positive):
                self.edges[j] = np.unique(np.r_[self.edges[j], 0.0, np.quantile(positive, [0.25, 0.5, 0.75])])
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        width = max(len(e) for e in self.edges) + 1
        rate = min(max(y.mean() if n else 0.0, 1e-4), 1 - 1e-4)
        self.base, self.trees = math.log(rate / (1 - rate)), []
        raw = np.full(n, self.base)
        for _ in range(self.rounds if n else 0):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, dtype=np.int64)
            splits = []
            for level in range(self.depth):
                size = 1 << level
                best = [(0.0, 0, width)] * size  # gain, feature, bin: all rows go left
                for j in range(m):
                    at = node * width + binned[:, j]
                    sums = [np.bincount(at, v, size * width).reshape(size, width) for v in (g, h, None)]
                    left = [np.cumsum(s, 1) for s in sums]
                    whole = [s[:, -1:] for s in left]
                    right = [w - s for w, s in zip(whole, left, strict=True)]
                    gain = left[0] ** 2 / (left[1] + self.l2) + right[0] ** 2 / (right[1] + self.l2) - whole[0] ** 2 / (whole[1] + self.l2)
                    gain[(left[2] < self.least) | (right[2] < self.least)] = 0
                    for k, b in enumerate(gain.argmax(1)):
                        if gain[k, b] > best[k][0] + 1e-9:
                            best[k] = (gain[k, b], j, int(b))
                splits.append([(j, b) for _, j, b in best])
                js = np.array([j for _, j, _ in best])[node]
                node = node * 2 + (binned[np.arange(n), js] > np.array([b for *_, b in best])[node])
            sums = [np.bincount(node, v, 1 << self.depth) for v in (g, h)]
            leaves = -self.rate * sums[0] / (sums[1] + self.l2)
            self.trees.append((splits, leaves))
            raw += leaves[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, leaves in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in splits:
                feature, cut = np.array(level).T
                node = node * 2 + (binned[rows, feature[node]] > cut[node])
            out += leaves[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: breakpoints and their non-decreasing rates, each block smoothed by one half case a side."""
    blocks: list[list[float]] = []  # sum of labels, weight, least and largest raw value
    for r, v in sorted(zip(raw.tolist(), y.tolist(), strict=True)):
        blocks.append([v, 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs, ys = [], []
    for s, w, lo, hi in blocks:
        xs += [lo, hi] if hi > lo else [lo]
        ys += [(s + 0.25) / (w + 0.5)] * (2 if hi > lo else 1)
    ys = np.maximum.accumulate(np.array(ys)) if ys else np.array([])
    return np.array(xs), ys


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    xs: np.ndarray
    ys: np.ndarray

    def __call__(self, texts) -> np.ndarray:
        """Scores from 0 to 1. The tree's own probability enters with 2 %, which orders what calibration ties."""
        raw = self.trees.raw(matrix(texts, self.lexicon))
        own = 1 / (1 + np.exp(-raw))
        return np.clip(0.98 * np.interp(raw, self.xs, self.ys) + 0.02 * own if len(self.xs) else own, 0.0, 1.0)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows (text, toxic, key), of which a sample by hash of ``key`` of the given mean size is used.

    Half of the sample gives the lexicon (counted on the executors), a third the trees and the rest the calibration:
    none is fitted on what another has seen. The driver gets the terms' counts and the features, both bounded. The
    sample is written once and read for each step. Rows without a key or label are not used; rows of one key are one
    document, with the greatest label and the least text, so repeated rows weigh nothing. Equal counts of terms are
    ordered by the term. Without rows, or without toxic ones, every score is low and finite. Other columns are ignored.
    """
    rows = labelled.where("toxic is not null and key is not null")
    marks = rows.groupBy("key").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = marks.count()
    taken = hash_unit(F.col("key"), F.lit("sample")) < sample / max(total, 1)
    one = rows.where(taken).groupBy("key").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.min("text").alias("text"))
    rows = stash(one.select("text", "toxic", hash_unit(F.col("key"), F.lit("toxic")).alias("u")), "labelled")
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: w != ""))
    starts = [F.transform(F.filter("w", lambda w, k=k: F.char_length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in PREFIXES]
    half = rows.where("u < 0.5")
    terms = half.select("toxic", words.alias("w")).select("toxic", F.explode(F.array_distinct(F.concat("w", *starts))).alias("term"))
    n = {r["toxic"]: r["n"] for r in half.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    p, q = F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1))
    ranked = terms.groupBy("term").agg(p.alias("p"), q.alias("n")).where((F.col("p") >= 3) & (F.col("p") * (neg + 1) > 4 * F.col("n") * (pos + 1)))
    counts = [(r["term"], r["p"], r["n"]) for r in ranked.orderBy(F.desc("p"), "n", "term").limit(TERMS).collect()]
    lexicon = lexicon_of(counts, pos, neg)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"u": b["u"], "toxic": b["toxic"], "x": list(matrix(b["text"], lexicon))})

    got = rows.where("u >= 0.5").mapInPandas(measure, "u double, toxic int, x array<double>").collect()
    got.sort(key=lambda r: r["u"])
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    y, v = np.array([r["toxic"] for r in got], dtype=float), np.array([r["u"] for r in got])
    fitted = v < 0.83
    trees = Boosted().fit(x[fitted], y[fitted])
    xs, ys = isotonic(trees.raw(x[~fitted]), y[~fitted])
    return Model(lexicon, trees, xs, ys)


def score(model: Model, text: Column) -> Column:
    """Score of a text column, from 0 to 1; null texts are scored as empty ones, equal texts alike.

    It is a column: repeated rows, other columns of any name and empty tables are left as they are. A worker holds one
    Arrow batch of whole texts, which is bounded in bytes but for a text that is longer by itself.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model(texts))

    return run(text)

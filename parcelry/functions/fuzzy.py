"""Fuzzy string similarity, 0 to 100, by longest common subsequence (Indel similarity).

These are the only scalar functions that need Python: they run as Arrow-batched pandas UDFs, and callers filter by an exact
key or by length first (a ratio of at least c needs min(l1, l2) >= max(l1, l2) * c / (200 - c)).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_ = every
    for ch in b:
        hit = open_ & places.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & every
    return len(a) - open_.bit_count()


def ratio_of(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * common(a, b) / total if total else 100.0


def token_set_ratio_of(a: str, b: str) -> float:
    """The best ratio among common words, common words with the rest of a, and with the rest of b; 0 with an empty side."""
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    both = " ".join(sorted(wa & wb))
    only_a, only_b = " ".join(sorted(wa - wb)), " ".join(sorted(wb - wa))
    if both and (not only_a or not only_b):
        return 100.0
    left, right = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    scores = [ratio_of(left, right)]
    if both:
        scores += [ratio_of(both, left), ratio_of(both, right)]
    return max(scores)


def partial_ratio_of(a: str, b: str) -> float:
    """The best ratio of the shorter text with a part of the longer one that is as long (shorter at the edges)."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(ratio_of(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def _udf(score):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


ratio, token_set_ratio, partial_ratio = _udf(ratio_of), _udf(token_set_ratio_of), _udf(partial_ratio_of)


def within_length(a: Column, b: Column, cutoff: float) -> Column:
    """Whether two lengths allow a ratio of at least cutoff: exact, so a filter by it loses nothing."""
    la, lb = F.length(a), F.length(b)
    return F.least(la, lb) >= F.greatest(la, lb) * cutoff / (200.0 - cutoff)


def best_match(terms: list[tuple[str, str]], cutoff: float, scorer: str = "ratio"):
    """A pandas UDF from text to struct(key, name, score) of the best of (key, name) terms; null below cutoff.

    Of equally good terms the first in the list wins. Distinct texts of a batch are scored once.
    """
    score = {"ratio": ratio_of, "token_set_ratio": token_set_ratio_of, "partial_ratio": partial_ratio_of}[scorer]

    def one(text: str | None) -> dict:
        best = {"key": None, "name": None, "score": None}
        if text:
            for key, name in terms:
                if scorer == "ratio" and min(len(key), len(text)) < max(len(key), len(text)) * cutoff / (200.0 - cutoff):
                    continue
                s = score(text, key)
                if s >= cutoff and (best["score"] is None or s > best["score"]):
                    best = {"key": key, "name": name, "score": s}
        return best

    @F.pandas_udf(T.StructType([T.StructField("key", T.StringType()), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(text: pd.Series) -> pd.DataFrame:
        found = {t: one(t) for t in text.dropna().unique()}
        return pd.DataFrame([found.get(t) or one(None) for t in text], columns=["key", "name", "score"])

    return run

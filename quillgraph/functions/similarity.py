"""String similarities that Spark lacks, in Arrow batches. Equal inputs are computed once per batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def jaro_pair(a: str, b: str) -> float:
    """Jaro similarity: matches inside half the longer length, transpositions counted in halves."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    hits = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    others = [b[j] for j in range(len(b)) if taken[j]]
    swaps = sum(x != y for x, y in zip(hits, others)) / 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_pair(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity, raised by a common beginning of up to four characters where it is above 0.7."""
    j = jaro_pair(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * weight * (1 - j) if j > 0.7 else j


def damerau_levenshtein_pair(a: str, b: str) -> int:
    """Edits to turn one text into the other, a swap of neighbours being one, other edits allowed between swapped ones."""
    last: dict[str, int] = {}
    width = len(a) + len(b)
    d = [[width] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        row = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), row
            if x == y:
                row = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def _udf(pair, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], object] = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            key = (x, y)
            if key not in known:
                known[key] = pair(x, y)
            out.append(known[key])
        return pd.Series(out)

    return run


def jaro(a, b):
    return _udf(jaro_pair, "double")(a, b)


def jaro_winkler(a, b):
    return _udf(jaro_winkler_pair, "double")(a, b)


def damerau_levenshtein(a, b):
    return _udf(damerau_levenshtein_pair, "int")(a, b)

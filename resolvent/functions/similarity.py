"""String similarities: native where Spark has the parts, vectorised pandas UDFs on distinct pairs elsewhere."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 unless both sides have text."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the smaller set."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(0.0)


def set_cosine(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.sqrt((F.size(x) * F.size(y)).cast("double"))).otherwise(0.0)


def jaro_winkler_one(a: str, b: str, prefix: float = 0.1, boost: float = 0.7) -> float:
    """Jaro similarity with a bonus for a common prefix of up to four characters from ``boost`` on."""
    if a == b:
        return 1.0 if a else 0.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used = [False] * m
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    k = len(left)
    if not k:
        return 0.0
    right = [b[j] for j in range(m) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    if jaro <= boost:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * prefix * (1 - jaro)


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / total length; 1 for two empty texts."""
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best of the shared words against each side's shared and own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not one or not two):
        return 1.0
    p, q = f"{both} {one}".strip(), f"{both} {two}".strip()
    best = indel_ratio(p, q)
    return max(best, indel_ratio(both, p), indel_ratio(both, q)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """The best window of the longer text against the shorter one."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 1.0 if not t else 0.0
    best = 0.0
    for i in range(1 - len(s), len(t)):
        w = t[max(0, i) : i + len(s)]
        if w:
            best = max(best, indel_ratio(s, w))
            if best == 1.0:
                break
    return best


def edit_class(a: str, b: str) -> str:
    """The one edit that turns a into b (ins:x, del:x, sub:x>y, swap:xy); empty if it takes none or more."""
    if a == b or abs(len(a) - len(b)) > 1:
        return ""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        if a[i + 1 :] == b[i + 1 :]:
            return f"sub:{a[i]}>{b[i]}"
        return f"swap:{a[i]}{a[i + 1]}" if a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else ""
    if len(a) < len(b):
        return f"ins:{b[i]}" if a[i:] == b[i + 1 :] else ""
    return f"del:{a[i]}" if a[i + 1 :] == b[i:] else ""


def with_edit_class(df: DataFrame, a: str, b: str, name: str = "edit") -> DataFrame:
    """``df`` with the edit class of two word columns, computed once per distinct pair."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"__a": pdf["__a"], "__b": pdf["__b"], name: [edit_class(x, y) for x, y in zip(pdf["__a"], pdf["__b"], strict=True)]})

    pairs = df.select(F.col(a).alias("__a"), F.col(b).alias("__b")).where("__a is not null and __b is not null").distinct()
    told = pairs.mapInPandas(run, f"__a string, __b string, {name} string")
    return df.join(told, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b"))).drop("__a", "__b")


METRICS = {"jaro_winkler": jaro_winkler_one, "ratio": indel_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio}


def with_metrics(df: DataFrame, a: str, b: str, metrics: list[str], prefix: str = "") -> DataFrame:
    """``df`` with string metrics of two columns, computed once per distinct pair of values.

    Python sees each distinct pair once, in Arrow batches; pairs are joined back.
    """
    distinct = df.select(F.coalesce(a, F.lit("")).alias("__a"), F.coalesce(b, F.lit("")).alias("__b")).distinct()
    names = [f"{prefix}{m}" for m in metrics]

    def run(batches):
        for pdf in batches:
            out = {"__a": pdf["__a"], "__b": pdf["__b"]}
            for m, n in zip(metrics, names, strict=True):
                f = METRICS[m]
                out[n] = [f(x, y) for x, y in zip(pdf["__a"], pdf["__b"], strict=True)]
            yield pd.DataFrame(out)

    told = distinct.mapInPandas(run, "__a string, __b string, " + ", ".join(f"{n} double" for n in names))
    return df.join(told, (F.coalesce(F.col(a), F.lit("")) == F.col("__a")) & (F.coalesce(F.col(b), F.lit("")) == F.col("__b"))).drop("__a", "__b")

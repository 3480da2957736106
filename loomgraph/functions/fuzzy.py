"""Fuzzy string similarities that Spark has no function for, as Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def longest_common(a: str, b: str) -> tuple[int, int, int]:
    """(i, j, n): the longest a[i:i+n] that is b[j:j+n]; of equals the first in a, then in b.

    By the suffix automaton of b, so in time linear in both, however often letters repeat.
    """
    step, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for at, c in enumerate(b):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(at)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    state, n, best = 0, 0, (0, 0, 0)
    for at, c in enumerate(a):
        while state and c not in step[state]:
            state = link[state]
            n = length[state]
        if c in step[state]:
            state = step[state][c]
            n += 1
        if n > best[2]:
            best = (at + 1 - n, first[state] + 1 - n, n)
    return best


def sequence_similarity(a: str, b: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp similarity without junk heuristics: twice the matched characters over all.

    The longest common stretch matches, then the same on both sides of it. 0 as soon as `least`
    is out of reach.
    """
    total = len(a) + len(b)
    if not total:
        return 1.0
    matched, could, stack = 0, min(len(a), len(b)), [(a, b)]
    while stack:
        x, y = stack.pop()
        i, j, n = longest_common(x, y)
        matched += n
        sides = [(x[:i], y[:j]), (x[i + n :], y[j + n :])] if n else []
        sides = [s for s in sides if s[0] and s[1]]
        could += n + sum(min(map(len, s)) for s in sides) - min(len(x), len(y))
        if 2.0 * could / total < least:
            return 0.0
        stack += sides
    return 2.0 * matched / total


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


def token_sort_similarity(a: str, b: str) -> float:
    """100 * 2 * LCS / (lengths) of the two texts with their tokens sorted; 0 if both are empty."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * _common_subsequence(x, y) / (len(x) + len(y)) if x or y else 0.0


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_sort_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, no junk heuristics."""
    return pd.Series([None if x is None or y is None else sequence_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def fuzzy_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 85.0) -> DataFrame:
    """Pairs (a, b) of distinct texts with token_sort_ratio of at least `least`.

    Found without a cross join. With t = least / 100, two texts of n and m characters that
    reach the threshold have n / m within [t / (2 - t), (2 - t) / t], and at most
    (1 - t) * (n + m) characters aren't shared; so texts meet only if their lengths are close
    and one of the pieces (2-grams that survive any such number of edits) is shared. Short
    texts, for which no 2-gram must survive, meet by length alone.
    """
    t = least / 100.0

    def prepared(df: DataFrame, column: str) -> DataFrame:
        text = F.array_join(F.array_sort(F.filter(F.split(F.trim(F.col(column)), r"(?U)\s+"), lambda w: w != "")), " ")
        return df.select(F.col(column)).where(F.col(column).isNotNull()).distinct().select(F.col(column), text.alias("__t")).withColumn("__n", F.length("__t")).where("__n > 0")

    x = prepared(left, a).select(F.col(a).alias("__a"), F.col("__t").alias("__ta"), F.col("__n").alias("__na"))
    y = prepared(right, b).select(F.col(b).alias("__b"), F.col("__t").alias("__tb"), F.col("__n").alias("__nb"))
    # Each unshared character destroys at most two 2-grams; a text of n keeps one if n - 1 > 2 * edits.
    most = F.lit((1 - t) * (1 + (2 - t) / t))
    survives = lambda n: (n - 1) > 2 * F.floor(most * n)

    def grams(df: DataFrame, text: str, n: str) -> DataFrame:
        pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(n) - 1)), lambda i: F.substr(F.col(text), i, F.lit(2))))
        return df.withColumn("__g", F.explode(pieces))

    close = (F.col("__na") <= F.col("__nb") * ((2 - t) / t)) & (F.col("__nb") <= F.col("__na") * ((2 - t) / t))
    by_gram = grams(x.where(survives(F.col("__na"))), "__ta", "__na").join(grams(y, "__tb", "__nb"), "__g").where(close).select("__a", "__b").distinct()
    lengths = F.sequence(F.ceil(F.col("__na") * (t / (2 - t))), F.floor(F.col("__na") * ((2 - t) / t)))
    short = x.where(~survives(F.col("__na"))).withColumn("__nb", F.explode(lengths))
    by_length = short.join(y, "__nb").select("__a", "__b")
    candidates = by_gram.unionByName(by_length).distinct()
    scored = candidates.withColumn("similarity", token_sort_ratio(F.col("__a"), F.col("__b")))
    return scored.where(F.col("similarity") >= least).select(F.col("__a").alias(a), F.col("__b").alias(b), "similarity")

"""Jaro-Winkler similarity over distinct pairs of strings, and 64-bit hash similarity."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def jaro_winkler(a: str | None, b: str | None) -> float | None:
    """The prefix has no limit; its weight is the smaller of 0.1 and 1 / longer length, and counts above 0.7. Of an odd number of moved letters the half is rounded down."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    reach = max(len(long) // 2 - 1, 0)
    taken, hits = [False] * len(long), []
    for i, c in enumerate(short):
        for j in range(max(0, i - reach), min(len(long), i + reach + 1)):
            if not taken[j] and long[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (c for c, t in zip(long, taken, strict=True) if t), strict=True)) // 2
    jaro = (len(hits) / len(a) + len(hits) / len(b) + (len(hits) - moved) / len(hits)) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(short))
    return jaro + min(0.1, 1 / len(long)) * prefix * (1 - jaro) if jaro > 0.7 else jaro


#: Workers keep what they have compared.
cached = lru_cache(1 << 18)(jaro_winkler)


def with_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the similarity of two columns; each distinct pair is compared once, in Arrow batches."""

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    ship(df.sparkSession)
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()
    scored = pairs.withColumn(out, compare("__a", "__b"))
    return df.join(scored, (df[a] == scored["__a"]) & (df[b] == scored["__b"]), "left").drop("__a", "__b")


def hash_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64

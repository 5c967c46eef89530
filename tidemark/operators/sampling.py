"""Samples of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def exactly(rows: DataFrame, n: int, key: str, seed: int = 2026) -> DataFrame:
    """n rows without replacement, the same ones whatever the partitioning: those with the smallest seeded hashes."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key).limit(n)


def about(rows: DataFrame, share: float, seed: int = 2026) -> DataFrame:
    """A share of the rows, without a shuffle."""
    return rows.sample(fraction=share, seed=seed)

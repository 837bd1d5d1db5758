"""Cleaning and exact cosine of embedding columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def doubles(df: DataFrame, vec_id: str, vector: str, *others: str) -> DataFrame:
    """``id``, ``vec`` (doubles; only usable vectors) and other columns by their names."""
    df = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), *others)
    return df.where(usable(F.col("vec")) & F.col("id").isNotNull())


def stacked(column) -> np.ndarray:
    """Rows of equal length as one matrix."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))

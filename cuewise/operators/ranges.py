"""Range joins: equal keys and equal time bucket, then the exact predicate.

Buckets keep a busy video from becoming one join group; what skew is left
inside a bucket is split by adaptive skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(c: Column | str, width: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(float(width))).cast("long")


def point_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, lo: Column, hi: Column,
               on: Column, width: float, how: str = "inner") -> DataFrame:
    """Points joined to the intervals that hold them. A point has one bucket, so no pair repeats."""
    left = points.withColumn("_k", _bucket(point, width))
    spread = intervals.withColumn("_k", F.explode(F.sequence(_bucket(lo, width), F.greatest(_bucket(lo, width), _bucket(hi, width)))))
    right = spread.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_k").alias("_rk"),
                          *[c for c in intervals.columns if c not in keys])
    cond = F.col("_k") == F.col("_rk")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(right, cond & on, how).drop("_k", "_rk", *[f"_r_{k}" for k in keys])


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l_lo: str, l_hi: str, r_lo: str, r_hi: str,
                 on: Column, width: float) -> DataFrame:
    """Pairs of touching intervals. Both sides enter every bucket they cover; a pair is
    kept only in the bucket of its later start, so it appears once."""

    def spread(df: DataFrame, lo: str, hi: str) -> DataFrame:
        a = _bucket(lo, width)
        return df.withColumn("_k", F.explode(F.sequence(a, F.greatest(a, _bucket(hi, width)))))

    a = spread(left, l_lo, l_hi)
    b = spread(right, r_lo, r_hi).select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_k").alias("_rk"),
                                         *[c for c in right.columns if c not in keys])
    cond = (F.col("_k") == F.col("_rk")) & (F.col("_k") == _bucket(F.greatest(F.col(l_lo), F.col(r_lo)), width))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    return a.join(b, cond & on).drop("_k", "_rk", *[f"_r_{k}" for k in keys])

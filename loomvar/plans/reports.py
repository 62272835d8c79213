"""Reporting plans over annotated or compared rows: plain aggregation that Catalyst plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; WindowGroupLimit cuts before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def ambiguous(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with how many share their key: counted by partial aggregation, so that a hot key is no single task."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_same_key"))
    return df.join(counts, keys)


def deterministic_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """n rows that depend on the keys alone: those with the least md5."""
    return df.orderBy(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).cast("binary")), *keys).limit(n)


def length_class(ref: Column, alt: Column) -> Column:
    net = F.length(alt) - F.length(ref)
    return F.when(net == 0, "0").when(F.abs(net) == 1, "1").when(F.abs(net) <= 3, "2-3").otherwise("4+")


def variant_class(ref: Column, alt: Column) -> Column:
    a, b = F.length(ref), F.length(alt)
    return F.when((a == 1) & (b == 1), "snv").when(a == b, "mnv").when(a > b, "deletion").otherwise("insertion")


def upper_bound(k: int, n: int, alpha: float = 0.05) -> float:
    """Upper Clopper-Pearson bound of k errors in n: the p with P(X <= k) = alpha / 2, by bisection."""
    if n == 0 or k >= n:
        return 1.0
    if k == 0:
        return 1 - (alpha / 2) ** (1 / n)

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > alpha / 2 else (low, mid)
    return high


def strata(df: DataFrame, keys: list[str], wrong: Column, least: int = 1) -> DataFrame:
    """Per stratum: rows, errors, and the exact upper bound of the error rate; strata of fewer rows than `least` go."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors")).where(F.col("n") >= least)

    @F.pandas_udf("double")
    def bound(k, n):
        import pandas as pd

        return pd.Series([upper_bound(int(a), int(b)) for a, b in zip(k, n)])

    return counted.withColumn("upper95", bound("errors", "n"))


def concordance(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every key of either side: same, different, only_left, only_right."""
    a, b = left.select(*keys, F.col(value).alias("_l"), F.lit(1).alias("_in_l")), right.select(*keys, F.col(value).alias("_r"), F.lit(1).alias("_in_r"))
    state = F.when(F.col("_in_r").isNull(), "only_left").when(F.col("_in_l").isNull(), "only_right").when(F.col("_l").eqNullSafe(F.col("_r")), "same").otherwise("different")
    return a.join(b, keys, "full_outer").withColumn("state", state).select(*keys, "state")

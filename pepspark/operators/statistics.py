"""Outliers, correlations, contribution ranking and token-level estimates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import correlation_tier, shuffle_residues
from .ranks import attach_row, exact_quantiles
from .summaries import best_match, unpivot


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Per column the fences q1 - k * iqr and q3 + k * iqr, from exact quartiles."""
    quartiles = exact_quantiles(unpivot(df, [], columns), "value", {"q1": 0.25, "q3": 0.75}, ["feature"])
    spread = (F.col("q3") - F.col("q1")) * F.lit(float(k))
    return quartiles.select("feature", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper"))


def mark_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Add ``out_<column>`` flags and ``is_outlier``; the fences are one row."""
    fences = iqr_bounds(df, columns, k)
    wide = fences.agg(
        *[F.max(F.when(F.col("feature") == c, F.struct("lower", "upper"))).alias(f"_f_{c}") for c in columns]
    )

    def outside(c: str) -> Column:
        value, fence = F.col(c).cast("double"), F.col(f"_f_{c}")
        return F.coalesce((value < fence["lower"]) | (value > fence["upper"]), F.lit(False))

    flagged = attach_row(df, wide).select(*df.columns, *[outside(c).alias(f"out_{c}") for c in columns])
    combined = F.lit(False)
    for c in columns:
        combined = combined | F.col(f"out_{c}")
    return flagged.withColumn("is_outlier", combined)


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5, label: str | None = None) -> DataFrame:
    """Outlier rows per column and combined, split by label when given."""
    flags = [f"out_{c}" for c in columns] + ["is_outlier"]
    marked = mark_outliers(df, columns, k)
    ids = [label] if label else []
    counted = marked.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(f)).alias(f) for f in flags]
    )
    long = counted.unpivot([*ids, "n_rows"], flags, "flag", "n_outliers")
    return long.withColumn("pct", F.lit(100.0) * F.col("n_outliers") / F.col("n_rows"))


def remove_outliers(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> DataFrame:
    return mark_outliers(df, columns, k).filter(~F.col("is_outlier")).select(*df.columns)


def correlation_pairs(df: DataFrame, columns: Mapping[str, Column], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson r of the named pairs, each over the rows where both values are there.

    Every task adds up masked moments of its rows, taken around the columns' means; the
    sums have one row for each pair and task.  A constant column, or fewer than two
    rows, gives NULL; NaN counts as missing.
    """
    names = list(columns)
    values = df.select(*[F.nanvl(columns[n].cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, n in enumerate(names)])
    mean = values.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in values.columns]).first()
    center = np.array([mean[c] for c in values.columns])
    left = np.array([names.index(a) for a, _ in pairs], int)
    right = np.array([names.index(b) for _, b in pairs], int)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(left)))
        for batch in batches:
            x = batch.to_numpy(float) - center
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            known = there.astype(float)
            n, one, two, both = known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x
            total += np.stack([n[left, right], one[left, right], one[right, left], two[left, right], two[right, left], both[left, right]])
        yield pd.DataFrame({"i": left, "j": right, **dict(zip(MOMENTS, total, strict=True))})

    sums = values.mapInPandas(moments, "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS)).groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    labels, centers = F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(float(c)) for c in center])
    x, y = F.col("x") / F.col("n"), F.col("y") / F.col("n")
    spread_x, spread_y = F.col("xx") / F.col("n") - x * x, F.col("yy") / F.col("n") - y * y
    varies = (spread_x > 1e-24 * F.pow(F.get(centers, F.col("i")), 2)) & (spread_y > 1e-24 * F.pow(F.get(centers, F.col("j")), 2))
    r = (F.col("xy") / F.col("n") - x * y) / F.sqrt(spread_x) / F.sqrt(spread_y)
    correlation = F.when((F.col("n") > 1) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return sums.select(F.get(labels, F.col("i")).alias("feature_a"), F.get(labels, F.col("j")).alias("feature_b"), correlation.alias("correlation"))


MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


def high_correlation(df: DataFrame, columns: Sequence[str], limit: float = 0.9) -> DataFrame:
    pairs = correlation_pairs(df, {c: F.col(c) for c in columns}, list(combinations(columns, 2)))
    return pairs.filter(F.abs("correlation") > limit)


def correlate_blocks(df: DataFrame, vector: str, features: Sequence[str], dims: Sequence[int] | None = None) -> DataFrame:
    """Correlation of chosen vector dimensions with every named feature."""
    size = len(dims) if dims is not None else df.select(F.max(F.size(vector))).first()[0]
    chosen = list(dims) if dims is not None else list(range(size))
    columns = {f"dim_{d}": F.get(F.col(vector), F.lit(d)) for d in chosen} | {f: F.col(f) for f in features}
    pairs = correlation_pairs(df, columns, [(f"dim_{d}", f) for d in chosen for f in features])
    return pairs.select(F.col("feature_a").alias("dim"), F.col("feature_b").alias("feature"), "correlation")


def interpret_dims(cross: DataFrame) -> DataFrame:
    """Strongest named correlate per dimension, with its tier."""
    best = best_match(cross, "dim", "correlation", "feature")
    return best.withColumn("tier", correlation_tier("correlation"))


def tier_counts(interpreted: DataFrame) -> DataFrame:
    return interpreted.groupBy("tier").agg(F.count(F.lit(1)).alias("n_dims"))


def rank_contributions(long_df: DataFrame, n: int, feature: str = "feature", value: str = "contribution") -> DataFrame:
    """Features by mean absolute contribution, largest first."""
    means = long_df.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("mean_abs"))
    return means.orderBy(F.desc("mean_abs"), feature).limit(n)


def control_gap(real: DataFrame, control: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Score of each sequence minus the score of its scrambled control."""
    other = control.select(key, F.col(score).alias("control_score"))
    return real.join(other, key).withColumn("gap", F.col(score) - F.col("control_score"))


def scrambled_gap(df: DataFrame, key: str, score: Callable[[str], Column], column: str = "sequence") -> DataFrame:
    """``control_gap`` of rows and their own scrambled sequences: both are scored in one pass, without a join."""
    both = df.select(key, column, shuffle_residues(column).alias("_control"))
    scored = both.select(key, score(column).alias("score"), score("_control").alias("control_score"))
    return scored.withColumn("gap", F.col("score") - F.col("control_score"))


def kl_estimate(tokens: DataFrame, key: str, policy: str = "policy_logprob", reference: str = "ref_logprob", mask: str = "mask"):
    """Per sequence: mean token log-probability and mean of exp(r) - r - 1, r = ref - policy."""
    r = F.col(reference) - F.col(policy)
    n = F.greatest(F.sum(mask), F.lit(1.0))
    return tokens.groupBy(key).agg(
        (F.sum(F.col(policy) * F.col(mask)) / n).alias("mean_logprob"),
        (F.sum((F.exp(r) - r - 1) * F.col(mask)) / n).alias("kl"),
    )

"""Grouped summaries: labels, distributions, clusters, diversity, run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions.hashing import hash_hex
from .ranks import attach_row, exact_quantiles, join_same


def _ratio(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value"):
    """Wide to long with all values as doubles."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(ids), list(columns), name, value)


# Labels

def label_summary(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per label its sum and prevalence, with multi- and zero-label counts of the table."""
    marks = sum((F.col(c) for c in labels), F.lit(0))
    aggregates = [F.count_if(marks > 1).alias("n_multi"), F.count_if(marks == 0).alias("n_zero"), _ratio(marks > 1).alias("multi")]
    for c in labels:
        aggregates += [F.sum(c).alias(f"sum_{c}"), F.avg(F.col(c).cast("double")).alias(f"avg_{c}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.col(f"sum_{c}").cast("bigint").alias("n_positive"),
                F.col(f"avg_{c}").alias("prevalence"),
                F.col("n_multi"),
                (F.lit(100.0) * F.col("multi")).alias("pct_multi"),
                F.col("n_zero"),
            )
            for c in labels
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))


def label_cooccurrence(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Share of label-a rows that also carry label b, for every ordered pair."""
    pairs = [(a, b) for a in labels for b in labels if a != b]
    aggregates = [F.avg(F.when(F.col(a) == 1, F.col(b).cast("double"))).alias(f"{a}|{b}") for a, b in pairs]
    rows = F.array(
        *[F.struct(F.lit(a).alias("label"), F.lit(b).alias("other"), F.col(f"`{a}|{b}`").alias("share")) for a, b in pairs]
    )
    return df.agg(*aggregates).select(F.inline(rows))


def class_balance(df: DataFrame, by: str) -> DataFrame:
    """Rows and share per class; the class table is small, so the total is a window over it."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def prevalence_by(df: DataFrame, by: str, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(F.col(c).cast("double")).alias(f"prevalence_{c}") for c in labels]
    )


# Distributions

def describe_by(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, overall or per group."""
    ids = [*([by] if by else []), "feature"]
    long = unpivot(df, ids[:-1], columns)
    moments = long.groupBy(*ids).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ids)
    return join_same(moments, quartiles, ids, "left")


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with missing values and how many; one pass over the table."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column", "n_missing").filter("n_missing > 0")


def duplicate_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each identical feature vector."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def length_stats(df: DataFrame, cut: int = 50, column: str = "sequence") -> DataFrame:
    size = F.length(column)
    return df.agg(
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        F.percentile(size, 0.5).alias("median_length"),
        (F.lit(100.0) * _ratio(size > cut)).alias("pct_over"),
    )


def histogram(df: DataFrame, column: str, bins: int, by: str) -> DataFrame:
    """Equal-width bins over the whole range; counts and density per group."""
    value = F.col(column).cast("double")
    values = df.select(by, value.alias("_v")).filter("_v is not null")
    bounds = values.agg(F.min("_v").alias("_lo"), ((F.max("_v") - F.min("_v")) / F.lit(float(bins))).alias("_width"))
    index = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_width")), F.lit(bins - 1)).cast("int")
    placed = attach_row(values, bounds).withColumn("bin", F.when(F.col("_width") > 0, index).otherwise(F.lit(0)))
    counted = placed.groupBy(by, "bin", "_lo", "_width").agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy(by))
    return counted.select(
        by,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_from"),
        "n_rows",
        F.try_divide(F.col("n_rows").cast("double"), total * F.col("_width")).alias("density"),
    )


def reason_counts(df: DataFrame, column: str = "invalid_reason") -> DataFrame:
    return (
        df.filter(F.col(column) != "").groupBy(F.col(column).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(F.desc("n_rows"), "reason")
    )


# Clusters and flags

def cluster_share(df: DataFrame, k: int, cluster: str = "cluster_id") -> DataFrame:
    """Rows and percent for clusters 0..k-1, empty ones included."""
    counts = df.groupBy(F.col(cluster).cast("bigint").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    full = df.sparkSession.range(k).withColumnRenamed("id", "cluster_id").join(counts, "cluster_id", "left")
    filled = full.select("cluster_id", F.coalesce("n", F.lit(0)).alias("n_rows"))
    return filled.withColumn(
        "pct", F.try_divide(F.lit(100.0) * F.col("n_rows"), F.sum("n_rows").over(Window.partitionBy()))
    )


def cluster_profile(df: DataFrame, cluster: str, key: str, n: int = 5, seed: int = 42, spread: int = 64) -> DataFrame:
    """Per cluster: size, mean length and ``n`` members in hash order.

    Members are cut to ``n`` inside hash slices first, so the final ranking of
    a cluster sees at most ``n * spread`` rows however large the cluster is.
    """
    h = hash_hex(seed, key)
    sliced = df.select(cluster, "sequence", F.col(key).alias("_k"), h.alias("_h")).withColumn(
        "_slice", F.pmod(F.xxhash64("_k"), F.lit(spread))
    )
    inner = Window.partitionBy(cluster, "_slice").orderBy("_h", "_k")
    outer = Window.partitionBy(cluster).orderBy("_h", "_k")
    samples = (
        sliced.withColumn("_r", F.row_number().over(inner))
        .filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(outer))
        .filter(F.col("_r") <= n)
        .groupBy(cluster)
        .agg(F.sort_array(F.collect_list(F.struct("_r", "sequence"))).alias("_s"))
        .select(cluster, F.transform("_s", lambda s: s["sequence"]).alias("samples"))
    )
    sizes = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.length("sequence").cast("double")).alias("mean_length")
    )
    return join_same(sizes, samples, [cluster])


def flag_rates(df: DataFrame, a: str, threshold_a: float, b: str, threshold_b: float) -> DataFrame:
    """Counts and shares above either threshold or both, with mean scores."""
    over_a, over_b = F.col(a) >= threshold_a, F.col(b) >= threshold_b
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(over_a).alias("n_a"),
        F.count_if(over_b).alias("n_b"),
        F.count_if(over_a | over_b).alias("n_either"),
        (F.lit(100.0) * _ratio(over_a)).alias("pct_a"),
        (F.lit(100.0) * _ratio(over_b)).alias("pct_b"),
        (F.lit(100.0) * _ratio(over_a | over_b)).alias("pct_either"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
    )


# Diversity

def residue_entropy(df: DataFrame, by: str, column: str = "sequence") -> DataFrame:
    """Entropy of pooled character frequencies over log2(20); every character counts.

    The 26 letters are sums of per-row counts, so they are not exploded; only what a
    row has besides them is.  NULL is a group of its own; a group without characters
    has entropy 0.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sums = df.groupBy(by).agg(*[F.sum(sq.residue_count(column, x)).alias(f"_{x}") for x in letters])
    counted = sums.unpivot([by], [f"_{x}" for x in letters], "_letter", "_n").withColumn("_letter", F.substring("_letter", 2, 1))
    others = df.select(by, F.explode(F.split(F.regexp_replace(column, "[A-Z]", ""), "")).alias("_letter")).filter("_letter <> ''")
    counted = counted.unionByName(others.groupBy(by, "_letter").agg(F.count(F.lit(1)).alias("_n"))).withColumn("_n", F.coalesce("_n", F.lit(0)).cast("double"))
    # At most one row per group and character of the alphabet in use.
    shares = counted.withColumn("_p", F.try_divide(F.col("_n"), F.sum("_n").over(Window.partitionBy(by))))
    terms = F.when(F.col("_p") > 0, -F.col("_p") * F.log2("_p")).otherwise(F.lit(0.0))
    return shares.groupBy(by).agg((F.sum(terms) / F.log2(F.lit(20.0))).alias("entropy"))


def kmer_diversity(df: DataFrame, by: str, k: int = 2, column: str = "sequence") -> DataFrame:
    """Distinct over total k-mers; 0 when there are none."""
    counted = (
        df.select(by, F.explode(sq.kmers(column, k)).alias("kmer")).groupBy(by, "kmer").agg(F.count(F.lit(1)).alias("n"))
    )
    per_group = counted.groupBy(by).agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_total"))
    groups = df.select(by).distinct()
    return join_same(groups, per_group, [by], "left").select(
        by,
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        F.coalesce("n_total", F.lit(0)).alias("n_total"),
        F.coalesce(F.col("n_distinct") / F.col("n_total"), F.lit(0.0)).alias("diversity"),
    )


def novelty_rate(samples: DataFrame, corpus: DataFrame, by: str, key: str = "sequence") -> DataFrame:
    """Per group: samples, unique ratio, and 1 - (seen or repeated) / samples."""
    counted = samples.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"))
    known = corpus.select(key).distinct().withColumn("_known", F.lit(1))
    marked = counted.join(known, key, "left")
    novel = F.count_if(F.col("_known").isNull())
    return marked.groupBy(by).agg(
        F.sum("n").alias("n_samples"),
        (F.count(F.lit(1)) / F.sum("n")).alias("unique_ratio"),
        (novel / F.sum("n")).alias("novelty_rate"),
    )


# Run reports

def run_summary(df: DataFrame, by: str = "step", terms: Sequence[str] = ("reward",)) -> DataFrame:
    """Per step: rows, unique ratio, length statistics and term means.

    Grouping by (step, sequence) first turns the distinct count into a plain
    count and collapses copies map-side.
    """
    size = F.length("sequence")
    per_sequence = df.groupBy(by, "sequence").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(t).cast("double")).alias(f"sum_{t}") for t in terms]
    )
    n = F.sum("n")
    total, squares = F.sum(F.col("n") * size), F.sum(F.col("n") * size * size)
    variance = F.try_divide(squares.cast("double") - total.cast("double") * total / n, n - 1)
    return per_sequence.groupBy(by).agg(
        n.alias("n_samples"),
        (F.count(F.lit(1)) / n).alias("unique_ratio"),
        (total / n).alias("mean_length"),
        F.sqrt(F.when(variance < 0, F.lit(0.0)).otherwise(variance)).alias("std_length"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        *[(F.sum(f"sum_{t}") / n).alias(f"mean_{t}") for t in terms],
    )


def novel_accumulation(df: DataFrame, step: str = "step") -> DataFrame:
    """New rows per step and their running total; ordered after aggregation to steps."""
    counts = df.groupBy(step).agg(F.count(F.lit(1)).alias("n_new"))
    running = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("n_cumulative", F.sum("n_new").over(running))


def first_seen(df: DataFrame, training: DataFrame, order: Sequence[str], key: str = "sequence") -> DataFrame:
    """First occurrence of every sequence that is not in training."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    firsts = df.groupBy(key).agg(F.min_by(whole, F.struct(*[F.col(c) for c in order])).alias("_row"))
    return firsts.join(training.select(key), key, "left_anti").select(*[F.col("_row")[c].alias(c) for c in df.columns])


def recent_summary(df: DataFrame, order: Sequence[str], value: str = "reward", step: str = "step", n: int = 100) -> DataFrame:
    """Rows so far, latest step, and the mean of the last ``n`` rows by arrival."""
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(step).alias("latest_step"))
    last = df.orderBy(*[F.desc(c) for c in order]).limit(n).agg(F.avg(value))
    return totals.withColumn("mean_recent", last.scalar())


def progress_rate(n_now: int, n_before: int, minutes: float) -> float:
    """Rows per minute since the previous check; 0 at the first check."""
    return (n_now - n_before) / max(minutes, 1e-6) if n_before else 0.0


def recent_unique(df: DataFrame, min_step: int, key: str = "sequence", step: str = "step") -> DataFrame:
    return df.filter(F.col(step) >= min_step).select(key).filter(F.col(key).isNotNull()).distinct()


def best_match(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """The row of each group whose ``value`` is largest in size; names break ties."""
    rank = F.struct(F.abs(F.col(value)).alias("a"), F.col(name).alias("b"))
    picked = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.max_by(F.struct(name, value), rank).alias("_m"))
    return picked.select(group, F.col(f"_m.{name}").alias(name), F.col(f"_m.{value}").alias(value))


def example_rows(df: DataFrame, key: str, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Most probable positive, least probable negative, most confident mistake."""
    wrong = (F.col(p) >= threshold).cast("int") != F.col(y)
    row = F.struct(F.col(key).alias("key"), F.col(y).alias("y"), F.col(p).alias("p"))
    picks = {
        "correct_positive": (F.col(y) == 1, F.col(p)),
        "correct_negative": (F.col(y) == 0, -F.col(p)),
        "misclassified": (wrong, F.abs(F.col(p) - threshold)),
    }
    aggregates = [
        F.max_by(F.when(condition, row), F.when(condition, F.struct(score.alias("s"), F.col(key).alias("k")))).alias(name)
        for name, (condition, score) in picks.items()
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("example"), F.col(name)["key"].alias(key), F.col(name)["y"].alias(y), F.col(name)["p"].alias(p)
            )
            for name in picks
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows)).filter(F.col(key).isNotNull())


def top_rows(df: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """Rows in order; with ``n``, a distributed top-k."""
    ordered = df.orderBy(*order)
    return ordered if n is None else ordered.limit(n)

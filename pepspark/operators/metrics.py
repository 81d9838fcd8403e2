"""Classifier metrics as aggregates over scored rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import join_same, running_totals, value_bucket
from .summaries import unpivot


def score_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(by, score) -> positives ``p`` and rows ``c``: ties collapse map-side."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    positive = F.when(F.col(y) == 1, w).otherwise(F.lit(0))
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.sum(positive).alias("p"), F.sum(w).alias("c"))
    )


def auroc_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUROC with average ranks for ties.

    Rank sums are taken inside value buckets; a bucket only needs to know how
    many rows lie in lower buckets, which is a window over the bucket totals.
    One class only gives NULL.
    """
    bucketed = value_bucket(counts, "score", by)
    inside = Window.partitionBy(*by, "_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("c").over(inside), F.lit(0)).cast("double")
    local = bucketed.withColumn("_r", F.col("p") * (below + (F.col("c") + 1) / F.lit(2.0)))
    per_bucket = local.groupBy(*by, "_bucket").agg(
        F.sum("_r").alias("r"), F.sum("p").cast("double").alias("p"), F.sum("c").cast("double").alias("c")
    )
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifted = per_bucket.withColumn("r", F.col("r") + F.col("p") * F.coalesce(F.sum("c").over(lower), F.lit(0.0)))
    positives, negatives = F.sum("p"), F.sum("c") - F.sum("p")
    u = F.sum("r") - positives * (positives + 1) / 2
    return shifted.groupBy(*by).agg(
        F.try_divide(u, positives * negatives).alias("auroc"), positives.alias("n_pos"), negatives.alias("n_neg")
    )


def auroc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return auroc_from_counts(score_counts(df, y, score, by), by).select(*by, "auroc")


def curve_points(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from high to low: cumulative true positives and rows."""
    bucketed = value_bucket(score_counts(df, y, score, by), "score", by)
    return running_totals(
        bucketed,
        by,
        "_bucket",
        [F.desc("score")],
        {"tp": F.col("p").cast("double"), "n": F.col("c").cast("double")},
        descending_buckets=True,
    )


def average_precision(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision over distinct thresholds."""
    points = curve_points(df, y, score, by)
    return points.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("n")), F.sum("p").cast("double")).alias("average_precision")
    )


def auprc_interpolated(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall curve with false positives interpolated
    linearly in true positives between neighbouring points (Davis and Goadrich).

    With t from t0 to t1 and fp = f0 + h (t - t0), precision is t / (t + fp) and
    its integral over t has a closed form, so a segment is one expression.  A
    row's own counts give the segment start, so no lag over the curve is needed.
    """
    points = curve_points(df, y, score, by)
    t1, t0 = F.col("tp"), F.col("tp") - F.col("p")
    f1 = F.col("n") - F.col("tp")
    f0 = f1 - (F.col("c") - F.col("p"))
    h = (f1 - f0) / (t1 - t0)
    a, b = F.lit(1.0) + h, f0 - h * t0
    start, end = a * t0 + b, a * t1 + b
    # integral of t / (a t + b) = t / a - b / a^2 * ln(a t + b)
    log_ratio = F.when(start > 0, F.log(end / start)).otherwise(F.lit(0.0))
    area = F.when(t1 > t0, (t1 - t0) / a - b / (a * a) * log_ratio).otherwise(F.lit(0.0))
    return points.groupBy(*by).agg(
        F.try_divide(F.sum(area), F.sum("p").cast("double")).alias("auprc_interpolated")
    )


# Confusion counts

def confusion(y: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if((y == 1) & predicted).alias("tp"),
        F.count_if((y == 0) & predicted).alias("fp"),
        F.count_if((y == 0) & ~predicted).alias("tn"),
        F.count_if((y == 1) & ~predicted).alias("fn"),
    ]


def _doubles() -> list[Column]:
    return [F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn")]


def precision() -> Column:
    tp, fp, _, _ = _doubles()
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall() -> Column:
    tp, _, _, fn = _doubles()
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))


def f1() -> Column:
    tp, fp, _, fn = _doubles()
    return F.coalesce(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), F.lit(0.0))


def mcc() -> Column:
    tp, fp, tn, fn = _doubles()
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.coalesce(F.try_divide(tp * tn - fp * fn, spread), F.lit(0.0))


def classification_report(
    df: DataFrame, y: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    counts = df.groupBy(*by).agg(*confusion(F.col(y), F.col(score) >= threshold))
    return counts.withColumns({"precision": precision(), "recall": recall(), "f1": f1(), "mcc": mcc()})


def sensitivity(df: DataFrame, task: str = "task", pred: str = "pred") -> DataFrame:
    """On positives only: rows, rows found, share found per task."""
    return df.groupBy(task).agg(
        F.count(F.lit(1)).alias("n_filtered"),
        F.sum(pred).cast("bigint").alias("n_correct"),
        F.avg(F.col(pred).cast("double")).alias("sensitivity"),
    )


def threshold_sweep(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), low: float = 0.05, high: float = 0.95, step: float = 0.01,
    metric: Callable[[], Column] = mcc,
) -> DataFrame:
    """The metric at every grid threshold.

    Each row falls into the bucket of the highest threshold it passes, so the
    table is read once and the sweep works on at most one row per threshold.
    """
    n = int(round((high - low) / step)) + 1
    position = F.floor(F.round((F.col(score) - F.lit(low)) / F.lit(step), 6)) + 1
    passed = F.least(F.greatest(position, F.lit(0)), F.lit(n)).cast("int")
    buckets = (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, passed.alias("passed"))
        .agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    )
    # A group's buckets and its empty grid points: n + 1 small rows per group.
    grid = buckets.select(*by).distinct() if by else df.sparkSession.range(1).select()
    full = grid.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("passed"))
    filled = join_same(full, buckets, [*by, "passed"], "left").fillna(0, ["p", "q"])
    above = Window.partitionBy(*by).orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*by)
    counts = (
        filled.withColumn("tp", F.sum("p").over(above))
        .withColumn("fp", F.sum("q").over(above))
        .withColumn("fn", F.sum("p").over(everything) - F.col("tp"))
        .withColumn("tn", F.sum("q").over(everything) - F.col("fp"))
        .filter("passed > 0")
    )
    threshold = F.round(F.lit(low) + (F.col("passed") - 1) * F.lit(step), 6)
    return counts.select(*by, threshold.alias("threshold"), metric().alias("metric"), "tp", "fp", "tn", "fn")


def best_threshold(df: DataFrame, y: str, score: str, by: Sequence[str] = (), **sweep) -> DataFrame:
    """The threshold of the best metric; the lowest one wins ties."""
    swept = threshold_sweep(df, y, score, by, **sweep)
    rank = F.struct(F.round("metric", 12).alias("m"), (-F.col("threshold")).alias("t"))
    best = swept.groupBy(*by).agg(F.max_by(F.struct("threshold", "metric"), rank).alias("_b"))
    return best.select(*by, F.col("_b.threshold").alias("threshold"), F.col("_b.metric").alias("metric"))


# Comparisons

def model_long(df: DataFrame, y: str, models: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    return unpivot(df, [*ids, y], models, "model", "score")


def compare_models(df: DataFrame, y: str, models: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """One row per model: AUROC, average precision, F1, MCC, precision, recall."""
    long = model_long(df, y, models)
    report = classification_report(long, y, "score", threshold, ["model"])
    return (
        auroc(long, y, "score", ["model"])
        .join(average_precision(long, y, "score", ["model"]), "model")
        .join(report.select("model", "f1", "mcc", "precision", "recall"), "model")
    )


def leak_check(df: DataFrame, features: Sequence[str], y: str, limit: float = 0.90) -> DataFrame:
    """Direction-free AUROC of every feature on its own; suspicious ones are flagged."""
    long = unpivot(df, [y], features)
    single = auroc(long, y, "value", ["feature"])
    strength = F.greatest(F.col("auroc"), F.lit(1.0) - F.col("auroc"))
    return single.select("feature", strength.alias("univariate_auc"), (strength > limit).alias("suspicious"))


def metric_by_bin(
    df: DataFrame, value: str, edges: Sequence[float], y: str, score: str, threshold: float = 0.5
) -> DataFrame:
    """Confusion metrics inside half-open bins [edge, next edge); rows beyond the edges or without a value are in bin 'outside'."""
    label = F.lit("outside")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        label = F.when((F.col(value) >= lo) & (F.col(value) < hi), F.lit(f"{lo}-{hi}")).otherwise(label)
    binned = df.withColumn("bin", label)
    return classification_report(binned, y, score, threshold, ["bin"])


# Bootstrap

# Cumulative distribution of Poisson(1) at 0, 1, 2, ...
POISSON_ONE = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974149, 0.9999998885745217,
)

#: Replicates that one md5 decides: its 128 bits are four uniform numbers of 32.
DRAWS = 4


def poisson_weights(seed: int, keys: Sequence[str], n: int) -> np.ndarray:
    """Poisson(1) weights of each key in n replicates.

    Replicate r reads the (r mod 4)-th eight hex digits of md5(seed:r div 4:key), so
    weights depend on nothing but the seed, the replicate and the key.
    """
    draws = -(-n // DRAWS)
    raw = b"".join(hashlib.md5(f"{seed}:{i}:{key}".encode()).digest() for key in keys for i in range(draws))
    uniform = np.frombuffer(raw, ">u4").astype(np.uint32).reshape(len(keys), draws * DRAWS)[:, :n]
    weights = np.zeros(uniform.shape, np.int32)
    for bound in POISSON_ONE:
        weights += uniform >= np.uint32(math.ceil(bound * 2**32))
    return weights


def replicate_cells(df: DataFrame, key: str, cells: Sequence[str], n: int, seed: int) -> DataFrame:
    """(cells, weights): for each distinct value of ``cells`` an array of its summed Poisson(1) weights in n replicates.

    The sum over the c rows of a cell is a Poisson(c) draw.  Rows that agree in all cells
    collapse inside their batch, then in a combining aggregate of vectors, so what is
    shuffled grows with distinct cells, each a single row whatever the number of replicates.
    """
    rows = df.select(F.col(key).cast("string").alias("_key"), *cells)
    fields = T.StructType([*rows.select(*cells).schema, T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // n)  # about two million weights at a time
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                code = np.zeros(len(part), np.int64)
                for column in part.columns[1:]:
                    values = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1
                    code = np.unique(code * (int(values.max(initial=0)) + 1) + values, return_inverse=True)[1]
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(code[order]) > 0))
                sums = np.add.reduceat(poisson_weights(seed, part.column(0).to_pylist(), n)[order], first, axis=0).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, n), pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(order[first])) for c in part.columns[1:]), lists], names=fields.names)

    total = Summarizer.sum(array_to_vector("weights"))
    return rows.mapInArrow(draw, fields).groupBy(*cells).agg(vector_to_array(total).alias("weights"))


def replicate_auroc(cells: DataFrame, n: int, rows: int = 1 << 11) -> DataFrame:
    """(model, replicate, auroc) from (model, score, y, weights); a replicate of one class has none.

    Rank sums of all replicates are taken at once, as arrays, inside slices of about ``rows``
    scores; the slices of a model are then added up in order, as a stream.
    """
    scores = cells.select("model", "score").distinct()
    placed = cells.join(value_bucket(scores, "score", ["model"], rows), ["model", "score"])

    def inside(table: pa.Table) -> pa.Table:
        weights = table.column("weights").combine_chunks().flatten().to_numpy().reshape(len(table), n)
        score, positive = table.column("score").to_numpy(), table.column("y").to_numpy() == 1
        order = np.argsort(score, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(score[order]) > 0))
        c = np.add.reduceat(weights[order], first, axis=0)
        p = np.add.reduceat(np.where(positive[:, None], weights, 0.0)[order], first, axis=0)
        ranks = (p * (np.cumsum(c, axis=0) - c + (c + 1) / 2)).sum(axis=0)
        out = {"r": ranks, "p": p.sum(axis=0), "c": c.sum(axis=0)}
        return pa.table({"model": table.column("model")[:1], "_bucket": table.column("_bucket")[:1]} | {k: pa.array([v]) for k, v in out.items()})

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, r, p, c = None, np.zeros(n), np.zeros(n), np.zeros(n)

        def ended() -> pa.RecordBatch:
            u = r - p * (p + 1) / 2
            both = p * (c - p)
            auroc = pa.array(np.divide(u, both, out=np.zeros(n), where=both > 0), mask=both <= 0)
            return pa.RecordBatch.from_arrays([pa.array([model] * n), pa.array(np.arange(n, dtype=np.int32)), auroc], ["model", "replicate", "auroc"])

        for batch in batches:
            for name, *sums in zip(*(batch.column(k) for k in ("model", "r", "p", "c")), strict=True):
                if name.as_py() != model:
                    if model is not None:
                        yield ended()
                    model, r, p, c = name.as_py(), np.zeros(n), np.zeros(n), np.zeros(n)
                own_r, own_p, own_c = (x.values.to_numpy() for x in sums)
                r, p, c = r + own_r + own_p * c, p + own_p, c + own_c
        if model is not None:
            yield ended()

    arrays = "r array<double>, p array<double>, c array<double>"
    slices = placed.groupBy("model", "_bucket").applyInArrow(inside, f"model string, _bucket int, {arrays}")
    return slices.repartition("model").sortWithinPartitions("model", "_bucket").mapInArrow(in_order, "model string, replicate int, auroc double")


def _interval(replicates: DataFrame, value: str, by: Sequence[str] = (), mean: str = "mean") -> DataFrame:
    return replicates.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.avg(value).alias(mean), F.percentile(value, 0.025).alias("lower"), F.percentile(value, 0.975).alias("upper"), F.count(F.lit(1)).alias("n_replicates")
    )


def bootstrap_auroc(
    df: DataFrame, key: str, y: str, scores: Sequence[str], n: int = 1000, seed: int = 42, grid: int | None = None,
    metric: Callable[[], Column] | None = None, thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of AUROC over n replicates; one-class replicates are skipped.

    ``grid`` rounds scores to that many steps, which bounds the cells whatever the table
    size.  With ``metric`` (an expression over tp, fp, tn, fn) that is taken instead, of
    scores cut at ``thresholds`` (0.5 where not given); it needs four cells a model only.
    """
    long = unpivot(df.select(key, F.col(y).cast("int").alias("y"), *scores), [key, "y"], scores, "model", "score").filter("score is not null")
    if metric is not None:
        cut = F.lit(0.5)
        for name, at in (thresholds or {}).items():
            cut = F.when(F.col("model") == name, F.lit(float(at))).otherwise(cut)
        flagged = long.withColumn("hit", F.col("score") >= cut)
        cells = replicate_cells(flagged, key, ["model", "y", "hit"], n, seed).select("model", "y", "hit", F.posexplode("weights").alias("replicate", "w"))
        counts = cells.groupBy("model", "replicate").agg(*weighted_confusion(F.col("y"), F.col("hit"), F.col("w")))
        return _interval(counts.select("model", metric().alias("value")), "value", ["model"])
    if grid:
        long = long.withColumn("score", F.round(F.col("score") * grid) / F.lit(float(grid)))
    return _interval(replicate_auroc(replicate_cells(long, key, ["model", "score", "y"], n, seed), n), "auroc", ["model"])


def weighted_confusion(y: Column, predicted: Column, weight: Column) -> list[Column]:
    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, weight).otherwise(0))

    return [
        total((y == 1) & predicted).alias("tp"), total((y == 0) & predicted).alias("fp"),
        total((y == 0) & ~predicted).alias("tn"), total((y == 1) & ~predicted).alias("fn"),
    ]


def bootstrap_diff(
    df: DataFrame, key: str, y: str, first: str, second: str, thresholds: Mapping[str, float] | None = None,
    n: int = 1000, seed: int = 42, metric: Callable[[], Column] = mcc,
) -> DataFrame:
    """Paired bootstrap of metric(first) - metric(second): both models see the same weights.

    The metric needs confusion counts only, so rows first collapse to at most
    twelve (label, prediction, prediction) cells with their weights in all replicates.
    """
    cut = thresholds or {}
    flagged = df.select(
        key, F.col(y).alias("y"), (F.col(first) >= cut.get(first, 0.5)).alias("a"), (F.col(second) >= cut.get(second, 0.5)).alias("b")
    )
    cells = replicate_cells(flagged, key, ["y", "a", "b"], n, seed).select("y", "a", "b", F.posexplode("weights").alias("replicate", "w"))

    def scored(side: str) -> DataFrame:
        counts = cells.groupBy("replicate").agg(*weighted_confusion(F.col("y"), F.col(side), F.col("w")))
        return counts.select("replicate", metric().alias(f"m_{side}"))

    differences = scored("a").join(scored("b"), "replicate").select((F.col("m_a") - F.col("m_b")).alias("d"))
    return _interval(differences, "d", mean="mean_diff")

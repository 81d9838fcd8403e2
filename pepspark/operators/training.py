"""Gradient-boosted classifiers through Spark ML: fit, search, ablation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics

# The default search space, as (low, high, kind); a caller may bring another.
SEARCH_SPACE = {
    "maxIter": (20, 120, "int"),
    "maxDepth": (3, 10, "int"),
    "minInstancesPerNode": (1, 20, "int"),
    "stepSize": (1e-3, 0.3, "log"),
    "minInfoGain": (0.0, 0.05, "float"),
    "subsamplingRate": (0.5, 1.0, "float"),
}


def class_weight(df: DataFrame, label: str) -> float:
    """Negatives over positives."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    if not row["p"]:
        raise ValueError(f"{label}: no positive rows")
    return row["n"] / row["p"]


def _prepared(df: DataFrame, label: str, features: Sequence[str] | str, split: str, weight: float) -> DataFrame:
    vector = (
        F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])
    )
    return df.select(
        array_to_vector(vector).alias("features"),
        F.col(label).cast("double").alias("label"),
        F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)).alias("weight"),
        (F.col(split) == "val").alias("is_validation"),
        F.col(split).alias("split"),
    )


def train_gbt(df: DataFrame, label: str, features: Sequence[str] | str, split: str = "split", seed: int = 42, **params) -> GBTClassificationModel:
    """Fit on 'train', stop early on 'val'; positives weigh negatives / positives."""
    weight = class_weight(df.filter(F.col(split) == "train"), label)
    rows = _prepared(df.filter(F.col(split).isin("train", "val")), label, features, split, weight)
    settings = {"maxIter": 40, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 1.0, **params}
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", validationIndicatorCol="is_validation", seed=seed, **settings
    )
    return trees.fit(rows)


def predict_gbt(model: GBTClassificationModel, df: DataFrame, label: str, features: Sequence[str] | str, split: str = "split") -> DataFrame:
    """(label, split, p) for every row."""
    scored = model.transform(_prepared(df, label, features, split, 1.0))
    return scored.select(F.col("label").cast("int").alias("y"), "split", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def sample_params(n: int, space: Mapping[str, tuple] = SEARCH_SPACE, seed: int = 42) -> list[dict]:
    """``n`` seeded random settings from the space."""
    import random

    rng = random.Random(seed)
    trials = []
    for _ in range(n):
        trial = {}
        for name, (low, high, kind) in space.items():
            if kind == "int":
                trial[name] = rng.randint(low, high)
            elif kind == "log":
                trial[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                trial[name] = rng.uniform(low, high)
        trials.append(trial)
    return trials


def _validation_mcc(model, df, label, features, split) -> float:
    scored = predict_gbt(model, df.filter(F.col(split) == "val"), label, features, split)
    return float(metrics.classification_report(scored, "y", "p").first()["mcc"])


def search_gbt(
    df: DataFrame, label: str, features: Sequence[str] | str, n: int = 60, space: Mapping[str, tuple] = SEARCH_SPACE,
    split: str = "split", seed: int = 42,
):
    """Random search by validation MCC; returns (best model, trial table)."""
    cached = df.cache()
    best, rows = None, []
    for i, params in enumerate(sample_params(n, space, seed)):
        model = train_gbt(cached, label, features, split, seed, **params)
        score = _validation_mcc(model, cached, label, features, split)
        rows.append((i, score, str(sorted(params.items()))))
        if best is None or score > best[0]:
            best = (score, model)
    cached.unpersist()
    trials = df.sparkSession.createDataFrame(rows, "trial int, validation_mcc double, params string")
    return best[1], trials


def ablation(
    df: DataFrame, sets: Mapping[str, Sequence[str] | str], labels: Sequence[str], split: str = "split", seed: int = 42, **params
) -> DataFrame:
    """Feature set x label: threshold chosen on validation, metrics on test."""
    result = None
    for name, features in sets.items():
        for label in labels:
            model = train_gbt(df, label, features, split, seed, **params)
            scored = predict_gbt(model, df, label, features, split)
            row = metrics.best_threshold(scored.filter("split = 'val'"), "y", "p").select("threshold").first()
            if row is None:
                raise ValueError(f"{label}: no validation rows to choose a threshold on")
            threshold = float(row["threshold"])
            test = scored.filter("split = 'test'").withColumn("model", F.lit(name))
            report = metrics.classification_report(test, "y", "p", threshold, ["model"])
            line = (
                metrics.auroc(test, "y", "p", ["model"])
                .join(metrics.average_precision(test, "y", "p", ["model"]), "model")
                .join(report.select("model", "mcc", "f1"), "model")
                .select(
                    F.col("model").alias("feature_set"), F.lit(label).alias("label"), F.lit(threshold).alias("threshold"),
                    F.col("auroc").alias("test_auroc"), F.col("average_precision").alias("test_auprc"),
                    F.col("mcc").alias("test_mcc"), F.col("f1").alias("test_f1"),
                )
            )
            result = line if result is None else result.unionByName(line)
    return result


def best_sets(table: DataFrame) -> DataFrame:
    """The feature set with the best test MCC for each label."""
    return table.groupBy("label").agg(F.max_by("feature_set", F.struct("test_mcc", "feature_set")).alias("feature_set"))

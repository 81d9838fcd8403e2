"""Descriptors, composite scores, group-relative values and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scales
from ..functions import sequences as sq
from . import curation
from .ranks import join_same, running_totals


# Descriptors

def descriptor_columns(c, text: str = "sequence", instability: Mapping[str, float] | None = None) -> dict[str, Column]:
    """Every descriptor of ``c`` (a sequence column or its counts) by name."""
    columns = {f"frac_{residue}": sq.residue_fraction(c, residue) for residue in scales.STANDARD}
    columns |= {
        "molecular_weight": sq.molecular_weight(c),
        "aromaticity": sq.aromaticity(c),
        "isoelectric_point": sq.isoelectric_point(c),
        "gravy": sq.gravy(c),
        **sq.ss_fractions(c),
        "charge_at_pH7": sq.charge_at_ph(c, 7.0),
        "modlamp_Length": F.length(text).cast("double"),
        "modlamp_MW": sq.molecular_weight(c, amide=True),
        "modlamp_Charge": sq.charge_at_ph(c, 7.0, scales.HANDBOOK, amide=True),
        "modlamp_ChargeDensity": sq.charge_density(c),
        "modlamp_pI": sq.isoelectric_point(c, scales.HANDBOOK, amide=True, low=0.0, high=14.0),
        "modlamp_Aromaticity": sq.aromaticity(c),
        "modlamp_AliphaticInd": sq.aliphatic_index(c),
        "modlamp_BomanInd": sq.boman_index(c),
        "modlamp_HydrophRatio": sq.hydroph_ratio_lib(c),
    }
    if instability:
        columns["instability_index"] = sq.dipeptide_index(text, instability)
        columns["modlamp_InstabilityInd"] = columns["instability_index"]
    return columns


def featurize(
    df: DataFrame, column: str = "sequence", instability: Mapping[str, float] | None = None, validated: bool = False
) -> DataFrame:
    """Descriptors of valid rows; invalid rows keep NULL descriptors and a ``reject_reason``.

    With ``validated`` all rows are valid rows of ``curation.validate``: nothing is normalized or tested again.

    A first projection counts residues, a second combines the counts, so each
    descriptor is short arithmetic and unused ones are pruned with their counts.
    """
    text = F.col(column) if validated else F.coalesce(sq.normalized(column), F.lit(""))
    standard = F.lit(True) if validated else (F.col("length") > 0) & ~sq.has_nonstandard(column)
    valid = F.col("reject_reason") == ""
    checked = (
        df.withColumn(column, text)
        .withColumn("length", F.length(column))
        .withColumn("reject_reason", F.when(standard, F.lit("")).otherwise(F.lit("invalid_chars")))
    )
    counts = {n: F.when(valid, e) for n, e in sq.Counted.columns(column).items()}
    features = descriptor_columns(sq.Counted(column), column, instability)
    for name in ("modlamp_Length", "instability_index", "modlamp_InstabilityInd"):
        if name in features:
            features[name] = F.when(valid, features[name])
    return checked.withColumns(counts).select(*checked.columns, *[e.alias(n) for n, e in features.items()])


# Composite score

# Default term weights of the eight-term and six-term rewards.
REWARD_WEIGHTS = {
    "model2": 1.0,
    "charge": 0.3,
    "length": 0.2,
    "hydrophobic_moment": 0.2,
    "diversity_penalty": 0.3,
    "class_diversity": 0.25,
    "hemolysis_penalty": 0.4,
    "toxicity_penalty": 0.4,
}
EARLIER_WEIGHTS = {
    "model2": 1.0,
    "charge": 0.3,
    "length": 0.2,
    "hydrophobic_moment": 0.2,
    "ad_penalty": 0.5,
    "diversity_penalty": 0.3,
}


def reward_terms(
    column: str = "sequence", model: str = "model_score", penalty: str | None = None, class_bonus: str | None = None,
    hemolysis: str | None = None, toxicity: str | None = None, domain_penalty: str | None = None,
    moment_cap: float = 0.65, gaussian_length: bool = True,
) -> dict[str, Column]:
    """Term columns by name; a source that is not given leaves its term out."""
    length = sq.length_score_gauss(column) if gaussian_length else sq.length_score_linear(column)
    terms = {
        "model2": F.col(model),
        "charge": sq.charge_score(column),
        "length": length,
        "hydrophobic_moment": sq.moment_score(sq.hydrophobic_moment(column), moment_cap),
    }
    if penalty:
        terms["diversity_penalty"] = -F.col(penalty)
    if domain_penalty:
        terms["ad_penalty"] = -F.col(domain_penalty)
    if class_bonus:
        terms["class_diversity"] = F.col(class_bonus)
    if hemolysis:
        terms["hemolysis_penalty"] = F.lit(1.0) - F.col(hemolysis)
    if toxicity:
        terms["toxicity_penalty"] = F.lit(1.0) - F.col(toxicity)
    return terms


def composite_score(
    df: DataFrame, terms: Mapping[str, Column], weights: Mapping[str, float] | None = None,
    defaults: Mapping[str, float] = REWARD_WEIGHTS,
) -> DataFrame:
    """Add a struct ``terms`` with every term and their weighted sum ``total``."""
    merged = {**defaults, **(weights or {})}
    missing = [t for t in terms if t not in merged]
    if missing:
        raise ValueError(f"no weight for terms {missing}")
    with_terms = df.withColumn("terms", F.struct(*[e.cast("double").alias(n) for n, e in terms.items()]))
    total = sum((F.lit(float(merged[n])) * F.col("terms")[n] for n in terms), F.lit(0.0))
    return with_terms.withColumn("total", total)


# Group-relative values

def group_zscore(df: DataFrame, group: str | Sequence[str], value: str, name: str = "advantage", floor: float = 1e-6) -> DataFrame:
    """(value - mean) / std within the group, the sample std floored.

    The two moments are aggregated map-side and joined back, so one group may
    hold a third of all rows without being gathered in one task.  A group of
    one has no standard deviation and gets NULL.
    """
    keys = [group] if isinstance(group, str) else list(group)
    moments = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    z = (F.col(value) - F.col("_mean")) / F.greatest(F.col("_std"), F.lit(floor))
    return join_same(df, moments, keys).withColumn(name, F.when(F.col("_std").isNotNull(), z)).drop("_mean", "_std")


def visit_numbers(
    df: DataFrame, keys: Sequence[str] = ("run", "cluster_id"), step: str = "step", order: Sequence[str] = ("step", "rid", "pos")
) -> DataFrame:
    """Add ``visits``: how often the row's cluster was hit so far, itself included.

    Steps arrive in order, so each step is an ordered bucket: numbering happens
    inside (run, cluster, step) and earlier steps add an offset.  Rows without
    a cluster are not counted and get NULL.
    """
    cluster = keys[-1]
    known = df.filter(F.col(cluster).isNotNull()).withColumn("_slice", F.col(step))
    numbered = running_totals(known, list(keys), "_slice", [F.col(c) for c in order], {"visits": F.lit(1).cast("bigint")})
    unknown = df.filter(F.col(cluster).isNull()).withColumn("visits", F.lit(None).cast("bigint"))
    return numbered.drop("_slice").unionByName(unknown)


def visitation_bonus(df: DataFrame, **visits) -> DataFrame:
    """Add ``visit_bonus`` = 1 / sqrt(visits so far); 0 for rows without a cluster."""
    bonus = F.coalesce(F.lit(1.0) / F.sqrt(F.col("visits").cast("double")), F.lit(0.0))
    return visit_numbers(df, **visits).withColumn("visit_bonus", bonus).drop("visits")


def class_diversity(
    df: DataFrame, natural: DataFrame, rarity_weight: float = 0.5, visit_weight: float = 0.5, **visits
) -> DataFrame:
    """Add ``class_bonus``: rarity of the cluster in ``natural(cluster_id)`` plus
    the visitation bonus, divided by the weights; 0 without a cluster.

    A cluster that the natural table lacks has frequency 0.
    """
    counts = natural.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    frequency = counts.select("cluster_id", (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias("_freq"))
    scored = visitation_bonus(df, **visits).join(frequency, "cluster_id", "left")
    bonus = F.lit(rarity_weight) * (F.lit(1.0) - F.coalesce("_freq", F.lit(0.0))) + F.lit(visit_weight) * F.col("visit_bonus")
    normalized = F.when(F.col("cluster_id").isNull(), F.lit(0.0)).otherwise(bonus / F.lit(rarity_weight + visit_weight))
    return scored.withColumn("class_bonus", normalized).drop("_freq", "visit_bonus")


# Scorers

Scorer = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]
_SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, fn: Scorer) -> None:
    """Register a batch scorer: it may load a model once, then maps batches of
    sequences to equally long batches of scores in the same order."""
    _SCORERS[name] = fn


def scorer_udf(name: str, most: int = 200):
    """The scorer as a column function; one call gets at most ``most`` rows, whatever the session's Arrow batches."""
    fn = _SCORERS[name]

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes: list[int] = []
        calls: list[int] = []

        def chunks() -> Iterator[pd.Series]:
            for batch in batches:
                calls.append(max(1, -(-len(batch) // most)))
                for at in range(0, max(len(batch), 1), most):
                    part = batch.iloc[at : at + most]
                    sizes.append(len(part))
                    yield part

        held: list[pd.Series] = []
        done = 0
        for i, scores in enumerate(fn(chunks())):
            if len(scores) != sizes[i]:
                raise ValueError(f"scorer {name}: {len(scores)} scores for {sizes[i]} sequences")
            held.append(pd.Series(scores, dtype="float64"))
            if len(held) == calls[done]:
                yield pd.concat(held, ignore_index=True)
                held, done = [], done + 1

    # Annotations must be real types: the UDF kind is read from them.
    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def score_column(df: DataFrame, name: str, batch: int = 200, column: str = "sequence", output: str | None = None) -> DataFrame:
    """Add the scorer's column; ``batch`` bounds the rows of one call."""
    return df.withColumn(output or f"{name}_score", scorer_udf(name, batch)(F.col(column)))


def linear_probability(features: Mapping[str, float], intercept: float = 0.0) -> Column:
    """A logistic model over feature columns, as a plain expression."""
    z = sum((F.lit(float(w)) * F.col(n) for n, w in features.items()), F.lit(float(intercept)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def model_probability(model, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """A Spark ML classifier as a step that adds ``probability`` of class 1."""

    def apply(df: DataFrame) -> DataFrame:
        vector = array_to_vector(F.array(*[F.col(f).cast("double") for f in features]))
        scored = model.transform(df.withColumn("_features", vector))
        return scored.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).drop(
            "_features", "rawPrediction", "prediction"
        )

    return apply


def score_table(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, column: str = "sequence", on_invalid: str = "keep",
    positive: str = "AMP", negative: str = "non-AMP",
) -> DataFrame:
    """Validate, featurize, score, label and annotate; every input row is kept
    unless ``on_invalid='drop'``.  Only valid rows reach ``score``."""
    checked = curation.validate(df, column=column, on_invalid=on_invalid)
    valid = score(featurize(checked.filter("valid"), column, validated=True))
    valid = valid.select(*checked.columns, sq.once(F.col("probability")).alias("probability"))
    scored = valid
    if on_invalid == "keep":
        scored = valid.unionByName(checked.filter(~F.col("valid")).withColumn("probability", F.lit(None).cast("double")))
    labelled = curation.apply_threshold(scored, threshold, positive=positive, negative=negative)
    return curation.confidence_note(labelled)


def spectrum(df: DataFrame, heads: Mapping[str, tuple[Column, float]], column: str = "sequence", validated: bool = False) -> DataFrame:
    """One ``<task>_prob`` and ``<task>_pred`` per head over valid rows."""
    features = featurize(df, column, validated=validated).filter("reject_reason = ''")
    outputs = []
    for task, (probability, threshold) in heads.items():
        outputs += [probability.alias(f"{task}_prob"), (probability >= threshold).cast("int").alias(f"{task}_pred")]
    return features.select(*df.columns, *outputs)


def cascade(df: DataFrame, gate: Callable[[DataFrame], DataFrame], gate_threshold: float, heads: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """Gate first; only rows labelled AMP get the per-class heads."""
    passed = score_table(df, gate, gate_threshold).filter("prediction = 'AMP'")
    return spectrum(passed.select(*df.columns, F.col("probability").alias("gate_probability")), heads, validated=True)

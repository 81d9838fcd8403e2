"""Training and run logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Line formats.
EPOCH_LINE = r"Epoch (\d+): train_loss=([\d.]+) val_loss=([\d.]+) time=([\d.]+)min"
BATCH_LINE = r"epoch (\d+) step (\d+)/(\d+) loss=([\d.]+) lr=([\d.eE+-]+)"
STEP_LINE = (
    r"(\d+)/(\d+) mean_reward=([\d.\-]+) std=([\d.\-]+) pg_loss=([\d.\-]+) kl=([\d.\-]+) "
    r"total_loss=([\d.\-]+) time=([\d.\-]+)s"
)
TERMS_LINE = (
    r"reward terms \(mean\): model2=([\d.\-]+) charge=([\d.\-]+) length=([\d.\-]+) hmom=([\d.\-]+) div=([\d.\-]+)"
)
STEP_BREAK = "\nstep "


def _field(pattern: str, index: int, kind: str, column: str = "value") -> Column:
    return F.regexp_extract(F.col(column), pattern, index).try_cast(kind)


def epoch_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    kinds = [("epoch", "int"), ("train_loss", "double"), ("val_loss", "double"), ("time_min", "double")]
    found = lines.filter(F.col(column).rlike(EPOCH_LINE))
    return found.select(*[_field(EPOCH_LINE, i, kind, column).alias(name) for i, (name, kind) in enumerate(kinds, 1)])


def batch_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    kinds = [("epoch", "int"), ("step", "int"), ("total_steps", "int"), ("loss", "double"), ("lr", "double")]
    found = lines.filter(F.col(column).rlike(BATCH_LINE) & ~F.col(column).rlike(EPOCH_LINE))
    rows = found.select(*[_field(BATCH_LINE, i, kind, column).alias(name) for i, (name, kind) in enumerate(kinds, 1)])
    return rows.withColumn("global_step", F.col("epoch").cast("bigint") * F.col("total_steps") + F.col("step"))


def parse_training_log(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(epoch rows, batch rows) of a training log."""
    lines = spark.read.text(path)
    return epoch_rows(lines), batch_rows(lines)


def step_rows(records: DataFrame, column: str = "value") -> DataFrame:
    """Rows from records that each start at a step line and run to the next one.

    The first terms line of a record belongs to its step line; a step without
    one is dropped.
    """
    pattern = r"^(?:step )?" + STEP_LINE
    kinds = [
        ("step", "int"), ("total_steps", "int"), ("mean_reward", "double"), ("std_reward", "double"), ("pg_loss", "double"),
        ("kl", "double"), ("total_loss", "double"), ("time_sec", "double"),
    ]
    terms = ["model2", "charge", "length", "hmom", "diversity_penalty"]
    found = records.filter(F.col(column).rlike(pattern) & F.col(column).rlike(TERMS_LINE))
    return found.select(
        *[_field(pattern, i, kind, column).alias(name) for i, (name, kind) in enumerate(kinds, 1)],
        *[_field(TERMS_LINE, i, "double", column).alias(name) for i, name in enumerate(terms, 1)],
    )


def parse_step_log(spark: SparkSession, path) -> DataFrame:
    """Step lines joined to their terms line.

    The step prefix is the reader's line separator, so the two lines arrive in
    one row and no ordering of lines has to be reconstructed.
    """
    records = spark.read.option("lineSep", STEP_BREAK).text(path)
    # Text before the first step line of a file may share its record.
    trimmed = records.select(F.regexp_replace("value", r"(?s)^.*?\nstep (?=\d+/\d+ mean_reward)", "").alias("value"))
    return step_rows(trimmed)

"""FASTA in and out: one record per row, split between records and not lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_BREAK = "\n>"


def parse_fasta(records: DataFrame, column: str = "value", skip_header_like: str | None = None) -> DataFrame:
    """(id, sequence) from rows that each hold one record, leading '>' optional."""
    text = F.regexp_replace(F.regexp_replace(F.col(column), "^>", ""), "\r", "")
    lines = F.split(text, "\n")
    body = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda line: F.trim(line))
    parsed = records.select(F.trim(F.element_at(lines, 1)).alias("id"), F.array_join(body, "").alias("sequence"))
    if skip_header_like:
        parsed = parsed.filter(~F.lower("id").contains(skip_header_like.lower()))
    return parsed


def read_fasta(spark: SparkSession, path, skip_header_like: str | None = None) -> DataFrame:
    """FASTA files as (id, sequence).

    The record break is the reader's line separator, so big files still split
    over tasks and a '>' inside a header survives.
    """
    raw = spark.read.option("lineSep", RECORD_BREAK).text(path)
    return parse_fasta(raw.filter(F.length(F.trim("value")) > 0), skip_header_like=skip_header_like)


def fasta_records(df: DataFrame, id_column: str = "id", column: str = "sequence") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(id_column).cast("string"), F.lit("\n"), F.col(column)).alias("value"))


def write_fasta(df: DataFrame, path: str, id_column: str = "id", column: str = "sequence", mode: str = "error") -> None:
    fasta_records(df, id_column, column).write.mode(mode).text(path)

"""CSV, TSV and text tables of sequences, and the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.curation import exclude_known, require_columns
from .fasta import read_fasta

# Columns of the background protein table.
BACKGROUND_SCHEMA = (
    "Entry string, Reviewed string, Length int, Sequence string, keyword string, go_id string, "
    "protein_name string, organism string"
)

# Terms that mark a background protein as antimicrobial.
EXCLUDED_GO_TERMS = ["0042742", "0050829", "0050830", "0019731", "0061844", "0050832"]
EXCLUDED_KEYWORDS = [
    "Antimicrobial", "Antibiotic", "Fungicide", "Antiviral protein", "Amphibian defense peptide", "Plant defense",
    "Bacteriocin", "Lantibiotic",
]


def read_csv(spark: SparkSession, path, sep: str = ",", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_tsv(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    return read_csv(spark, path, "\t", schema)


def read_text(spark: SparkSession, path) -> DataFrame:
    """One sequence per line; blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("sequence")).filter("sequence <> ''")


def read_sequences(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """A table with a ``sequence`` column from .csv, .tsv, .fasta or plain text."""
    lowered = path.lower()
    if lowered.endswith((".csv", ".tsv")):
        if not column:
            raise ValueError("a column name is required for CSV and TSV input")
        table = read_csv(spark, path, "\t" if lowered.endswith(".tsv") else ",")
        require_columns(table, [column])
        return table.withColumn("sequence", F.col(column))
    if lowered.endswith((".fasta", ".fa", ".faa")):
        return read_fasta(spark, path)
    return read_text(spark, path)


def sequences_df(spark: SparkSession, sequences: str | Sequence[str]) -> DataFrame:
    """A literal sequence, or a few of them."""
    listed = [sequences] if isinstance(sequences, str) else list(sequences)
    return spark.createDataFrame([(s,) for s in listed], "sequence string")


def merge_parts(spark: SparkSession, paths: str | Sequence[str], column: str) -> DataFrame:
    """One column of many CSV parts, deduplicated.

    Each part is read under its own header, since parts may order their columns
    differently.  All files are one scan: the first line of a file's first split is its
    header, which names the column's place; lines are parsed once and join their
    file's place, a row for each file.  A file without the column is an error; a line
    that repeats its file's header is no data.  Fields hold no line breaks.
    """
    globs = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(globs).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    # Within a task ids follow the order of lines, so the lowest of a file's first split is its header.
    first = lines.filter("_start = 0").withColumn("_line", F.monotonically_increasing_id())
    headers = first.groupBy("_file").agg(F.min_by("value", "_line").alias("_header"))
    # A name may stand in quotes, but not hold a comma.
    names = F.transform(F.split("_header", ","), lambda c: F.trim(F.regexp_replace(c, '^\\ufeff|"', "")))
    placed = headers.select("_file", "_header", F.size(names).alias("_width"), F.array_position(names, column).alias("_at"))
    checked = placed.agg(F.max("_width").alias("width"), F.min_by("_file", "_at").alias("file"), F.min("_at").alias("at")).first()
    if checked["width"] is None:
        raise ValueError(f"no lines in {globs}")
    if checked["at"] == 0:
        raise ValueError(f"no column {column!r} in {checked['file']}")
    fields = [f"c{i}" for i in range(checked["width"])]
    parsed = F.from_csv("value", ", ".join(f"{f} string" for f in fields), {"escape": '"'})  # a quote in quotes is doubled
    rows = lines.join(placed, "_file").filter(F.col("value") != F.col("_header")).select("_at", parsed.alias("_row"))
    return rows.select(F.element_at(F.array(*[F.col(f"_row.{f}") for f in fields]), F.col("_at").cast("int")).alias(column)).distinct()


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    """CSV with a header; array columns are joined with ';'."""
    flat = [
        F.array_join(c, ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes
    ]
    df.select(*flat).write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_by(df: DataFrame, column: str, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """One folder per category."""
    df.write.mode(mode).partitionBy(column).format(fmt).save(path)


def append_remaining(df: DataFrame, path: str, key: str) -> None:
    """Resume a table: write only rows whose key it does not hold yet."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as error:  # the table does not exist before the first run
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = None
    todo = df if done is None else exclude_known(df, done, key)
    todo.write.mode("append").parquet(path)

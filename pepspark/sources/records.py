"""Nested peptide records, landed as JSON pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a list page and of a detail record.
LIST_FIELDS = (
    "id", "dbaaspId", "name", "sequence", "sequenceLength", "complexity", "synthesisType", "activity", "pdb", "pubchemCid",
)
NAMED = "struct<name:string,description:string>"
PAGE_SCHEMA = (
    "totalCount int, data array<struct<id:bigint,dbaaspId:string,name:string,sequence:string,sequenceLength:int,"
    f"complexity:{NAMED},synthesisType:{NAMED},activity:string,pdb:string,pubchemCid:string>>"
)
ACTIVITY = (
    f"struct<peptideId:bigint,targetSpecies:{NAMED},activityMeasureGroup:{NAMED},activityMeasureValue:string,"
    f"concentration:string,unit:{NAMED},medium:{NAMED},activity:double,note:string,reference:string>"
)
DETAIL_SCHEMA = f"id bigint, sequence string, targetActivities array<{ACTIVITY}>"


def read_pages(spark: SparkSession, path, schema: str = PAGE_SCHEMA) -> DataFrame:
    """JSON files of one object each; the schema is given, never inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def peptide_list(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.explode("data").alias("p"))
    return rows.select(*[F.col(f"p.{f}").alias(f) for f in LIST_FIELDS])


def label_of(mixed: Column) -> Column:
    """Name, else description, else the empty string."""
    return F.coalesce(F.nullif(mixed["name"], F.lit("")), F.nullif(mixed["description"], F.lit("")), F.lit(""))


def flatten_activities(details: DataFrame) -> DataFrame:
    """One row per target activity; peptides without any yield none."""
    rows = details.select("id", F.coalesce("sequence", F.lit("")).alias("sequence"), F.explode("targetActivities").alias("a"))
    a = F.col("a")
    return rows.select(
        F.coalesce(a["peptideId"], F.col("id")).alias("peptideId"),
        "sequence",
        F.col("sequence").rlike("[a-z]").alias("has_lowercase"),
        label_of(a["targetSpecies"]).alias("targetSpecies"),
        label_of(a["activityMeasureGroup"]).alias("activityMeasureGroup"),
        a["activityMeasureValue"].alias("activityMeasureValue"),
        a["concentration"].alias("concentration"),
        label_of(a["unit"]).alias("unit"),
        label_of(a["medium"]).alias("medium"),
        a["activity"].alias("activity_float"),
        a["note"].alias("note"),
        a["reference"].alias("reference"),
    )

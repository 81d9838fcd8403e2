"""Stand-in sequence tables, derived whole from the given tables.

Each view has a Spark form and a DuckDB form with the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_hex, hex_int
from ..functions.sequences import once


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when the scan yields fewer partitions than that.

    A table of many files is left as it is; only a table in one small file,
    whose text is about to be exploded, pays for a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


#: All but the letters that stay: ambiguous and rare residue codes go too.
NO_RESIDUE = "[^AC-IK-NP-TVWYac-ik-np-tvwy]+"


def letters(column):
    """Letters only, upper case, ambiguous and rare residue codes removed."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pc.ascii_upper(pc.replace_substring_regex(texts, NO_RESIDUE, ""))

    return clean(column)


SENTENCE = "[.!?\n]+"
WORD = "[ \n]+"


def ascii_set(text: str) -> np.ndarray:
    """Which of the 256 bytes are characters of ``text``."""
    table = np.zeros(256, bool)
    table[list(text.encode("ascii"))] = True
    return table


#: Bytes that end a sentence or a word.
SENTENCE_ENDS = ascii_set(".!?\n")
WORD_ENDS = ascii_set(" \n")
#: Bytes that stay in a piece; ambiguous and rare residue codes are no residues.
LETTERS = ascii_set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
RESIDUES = ascii_set("ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy")
#: Bytes of text that are cut at once; a longer text is cut alone.
CUT = 1 << 20


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spread(table(spark, path, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


def cut(data: np.ndarray, bounds: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, offsets, bytes): the pieces of the texts between runs of ``ends``, with their ``kept`` bytes only.

    No byte is in both sets, so a piece may begin with the run before it.  An empty text is one empty piece.
    """
    is_end = ends[data]
    fresh = is_end.copy()
    fresh[1:] &= ~is_end[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    fresh[first] = is_end[first]
    run = np.flatnonzero(fresh)
    begin = np.concatenate([bounds[:-1], run])
    row = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, run, "right") - 1])
    order = np.argsort(begin, kind="stable")
    begin, row = begin[order], row[order]
    pos = np.arange(len(row)) - np.searchsorted(row, row)
    stays = kept[data]
    before = np.concatenate([[0], np.cumsum(stays)])
    return row, pos, before[np.append(begin, len(data))], data[stays]


def pieces(docs: DataFrame, ends: np.ndarray, kept: np.ndarray) -> DataFrame:
    """Each text cut at runs of ``ends``: (columns but the text, pos from 0, piece of the ``kept`` bytes).

    Cut in NumPy over Arrow batches; regular expressions over pieces take several times as long.
    """
    fields = T.StructType([*[f for f in docs.schema.fields if f.name != "text"], T.StructField("pos", T.IntegerType()), T.StructField("piece", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("text")))
            column = batch.column("text").cast(pa.large_string())
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            held = column.buffers()[2] if len(column) else None
            data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
            at = 0
            while at < len(column):
                stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CUT, "right")) - 1)
                stop = min(stop, len(column))
                row, pos, offsets, left = cut(data[bounds[at] : bounds[stop]], bounds[at : stop + 1] - bounds[at], ends, kept)
                piece = pa.StringArray.from_buffers(len(row), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(left))
                rows = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([*[batch.column(n).take(rows) for n in fields.names[:-2]], pa.array(pos.astype(np.int32)), piece], names=fields.names)
                at = stop

    return docs.mapInArrow(work, fields)


def peptides_of(docs: DataFrame) -> DataFrame:
    cut = pieces(docs.select("doc_id", F.col("source").alias("source_db"), F.col("lang").alias("category"), "text"), SENTENCE_ENDS, RESIDUES)
    return cut.filter("piece <> ''").select(
        F.concat_ws(".", "doc_id", "pos").alias("id"), "doc_id", "pos", "source_db", "category", F.upper("piece").alias("sequence")
    )


def peptides(spark: SparkSession, path: str) -> DataFrame:
    """Every sentence of every document as one clean sequence."""
    return peptides_of(documents(spark, path))


def words(spark: SparkSession, path: str) -> DataFrame:
    """Every word of every document with its place; the raw records without their sources."""
    return pieces(documents(spark, path).select("doc_id", "text"), WORD_ENDS, LETTERS).withColumnRenamed("piece", "sequence")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every word of every document: raw records with blanks, lower case and copies."""
    docs = documents(spark, path).select("doc_id", F.col("source").alias("source_db"), F.col("lang").alias("category"), "text")
    return pieces(docs, WORD_ENDS, LETTERS).select(
        "doc_id", "pos", "source_db", F.concat(F.col("source_db"), F.lit(":"), "doc_id", F.lit("."), "pos").alias("source_id"),
        "category", F.col("piece").alias("sequence"),
    )


def background(spark: SparkSession, path: str) -> DataFrame:
    """Every conversation turn as one long sequence."""
    turns = table(spark, path, "conversations")
    return turns.select(
        F.concat_ws(".", "conv_id", "turn").alias("id"), "role", once(letters(F.col("text"))).alias("sequence")
    ).filter("sequence <> ''")


def training(spark: SparkSession, path: str) -> DataFrame:
    """Every benchmark sentence: the corpus that generated sequences are compared with."""
    cut = table(spark, path, "benchmark").select(F.explode(F.split("text", SENTENCE)).alias("_s"))
    return cut.select(once(letters(F.col("_s"))).alias("sequence")).filter("sequence <> ''")


def external(spark: SparkSession, path: str) -> DataFrame:
    """Every benchmark word, as raw external records."""
    cut = table(spark, path, "benchmark").select("item_id", F.posexplode(F.split("text", WORD)).alias("pos", "_w"))
    return cut.select(
        "item_id", "pos", F.upper(F.regexp_replace("_w", "[^A-Za-z]", "")).alias("sequence")
    ).filter("sequence <> ''")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """Truth and two model scores, the second with heavy ties."""
    labels = table(spark, path, "labels")
    u1 = hex_int(hash_hex("s1", "doc_id"), 4) / F.lit(65535.0)
    u2 = hex_int(hash_hex("s2", "doc_id"), 4) / F.lit(65535.0)
    return labels.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.col("toxic").alias("y2"),
        ((u1 + F.lit(0.3) * F.col("quality")) / F.lit(1.3)).alias("s1"),
        (F.floor(u2 * F.lit(20.0)) / F.lit(20.0)).alias("s2"),
    )


def compounds_of(peptides: DataFrame) -> DataFrame:
    h = F.md5("sequence")
    return peptides.select(
        F.col("source_db").alias("run"), F.col("pos").alias("step"), F.col("doc_id").alias("rid"), "sequence",
        (hex_int(F.substring(h, 1, 4), 4) / F.lit(65535.0)).alias("reward"),
        F.pmod(hex_int(F.substring(h, 5, 4), 4), F.lit(5)).cast("int").alias("cluster_id"),
    )


def compounds(spark: SparkSession, path: str) -> DataFrame:
    """A generation log: sentence n of a document is its output at step n."""
    return compounds_of(peptides(spark, path))


def compound_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same log as a stream; the pattern matches a single file or a folder of parts."""
    schema = table(spark, path, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{path}/documents.parque[t]")
    return compounds_of(peptides_of(docs))


def activities(spark: SparkSession, path: str) -> DataFrame:
    """Activity measurements; the smallest values stand for the inactive sentinel."""
    return table(spark, path, "events").select(
        F.col("user_id").alias("peptide_id"), F.col("event_type").alias("species"), "value",
        (F.col("value") < 5.2).alias("inactive"),
    )


CLEAN = "regexp_replace(upper(regexp_replace({}, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g')"

DUCKDB = {
    "peptides": f"""select concat_ws('.', doc_id, i) as id, doc_id, i::int as pos, source as source_db, lang as category,
        {CLEAN.format('a[i + 1]')} as sequence
      from (select doc_id, source, lang, regexp_split_to_array(text, '[.!?\n]+') as a from documents), unnest(range(len(a))) t(i)
      where {CLEAN.format('a[i + 1]')} <> ''""",
    "records": """select doc_id, i::int as pos, source as source_db, source || ':' || doc_id || '.' || i as source_id, lang as category,
        regexp_replace(a[i + 1], '[^A-Za-z]', '', 'g') as sequence
      from (select doc_id, source, lang, regexp_split_to_array(text, '[ \n]+') as a from documents), unnest(range(len(a))) t(i)""",
    "background": f"""select concat_ws('.', conv_id, turn) as id, role, {CLEAN.format('text')} as sequence
      from conversations where {CLEAN.format('text')} <> ''""",
    "training": f"""select * from (select {CLEAN.format('s')} as sequence
      from (select unnest(regexp_split_to_array(text, '[.!?\n]+')) as s from benchmark)) where sequence <> ''""",
    "external": """select * from (select item_id, i::int as pos, upper(regexp_replace(a[i + 1], '[^A-Za-z]', '', 'g')) as sequence
      from (select item_id, regexp_split_to_array(text, '[ \n]+') as a from benchmark), unnest(range(len(a))) t(i)) where sequence <> ''""",
    "scores": """select doc_id as id, quality as y, toxic as y2,
        (('0x' || substr(md5('s1:' || doc_id), 1, 4))::bigint / 65535.0::double + 0.3::double * quality) / 1.3::double as s1,
        floor(('0x' || substr(md5('s2:' || doc_id), 1, 4))::bigint / 65535.0::double * 20) / 20.0::double as s2
      from labels""",
    "compounds": """select source_db as run, pos as step, doc_id as rid, sequence,
        ('0x' || substr(md5(sequence), 1, 4))::bigint / 65535.0::double as reward,
        (('0x' || substr(md5(sequence), 5, 4))::bigint % 5)::int as cluster_id
      from peptides""",
    "activities": """select user_id as peptide_id, event_type as species, value, value < 5.2::double as inactive from events""",
}
NEEDS = {"compounds": ["peptides"]}

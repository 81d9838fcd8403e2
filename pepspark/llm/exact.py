"""Exact duplicates: digest runs merged along a tree of partitions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, growing, materialize, source_columns, texts

#: What counts as white space; deleted before texts are compared.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
KEY = ["sha", "n_bytes", "check"]


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sha, n_bytes, check, points): digest, length and second digest of the normalised text.

    ``points`` counts the code points of the original.  A null text is empty.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column(1))
            raw = data.tobytes()
            sha, sizes, check, points = [], [], [], []
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                whole = raw[start:stop]
                kept = whole.translate(None, SPACES)
                sha.append(hashlib.sha256(kept).digest())
                check.append(hashlib.blake2b(kept, digest_size=8).digest())
                sizes.append(len(kept))
                points.append(len(whole.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sha, pa.binary()), pa.array(sizes, pa.int64()), pa.array(check, pa.binary()), pa.array(points, pa.int64())],
                ["doc_id", *KEY, "points"],
            )

    rows = source_columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    return rows.mapInArrow(work, "doc_id long, sha binary, n_bytes long, check binary, points long")


def tree_merge(rows: DataFrame, fan_in: int = 16, leaves: int | None = None, written: list[DataFrame] | None = None) -> DataFrame:
    """One row for each digest: (sha, n_bytes, check, keep_id, group_size, points).

    Every partition first reduces its rows to a sorted run with one entry for each
    digest.  In round r a run is cut by the r-th digit (base ``fan_in``) of the
    digest's leading bits and exchanged among the partitions that agree in all other
    digits; each of them merges what it received and again keeps one entry, the one
    with most code points, then smallest id.  After the last round partition p alone
    holds the digests of range p.  A partition never gets more than one entry of a
    digest from each of ``fan_in`` others, so copies of one text cannot gather.
    The table that the first round reads is appended to ``written`` for the caller to
    discard.  Entries are one only if length and a second digest agree as well, so a collision
    of the first would split, not join, a group.
    """
    spark = rows.sparkSession
    leaves = leaves or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, math.ceil(math.log(max(leaves, 2), fan_in)))
    size = math.ceil(leaves ** (1 / rounds))
    while size**rounds < leaves:
        size += 1
    best = lambda: F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    first = rows.withColumn("part", F.spark_partition_id() % F.lit(size**rounds)).groupBy("part", *KEY).agg(best().alias("best"), F.count(F.lit(1)).alias("n"))
    # The leading 31 bits place a digest; the digits of that number are its path.
    lead = F.conv(F.substring(F.hex("sha"), 1, 8), 16, 10).cast("long")
    run = materialize(first.withColumn("home", (lead % F.lit(size**rounds)).cast("int")), "digest_runs")
    if written is not None:
        written.append(run)
    for r in range(rounds):
        digit = size**r
        # Partition p passes an entry to the partition that has p's digits but the entry's own r-th one.
        own = F.floor(F.col("part") / F.lit(digit)) % F.lit(size)
        wanted = F.floor(F.col("home") / F.lit(digit)) % F.lit(size)
        moved = run.withColumn("part", (F.col("part") + (wanted - own) * F.lit(digit)).cast("int"))
        sent = moved.repartitionById(size**rounds, F.col("part")).sortWithinPartitions("part", *KEY)
        run = sent.mapInArrow(_merge_run, sent.schema)
    return run.select(*KEY, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (-F.col("best.less")).alias("points"))


def _merge_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours with one digest, length and check become one entry."""
    held = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held is not None and all(row[k] == held[k] for k in ("part", *KEY)):
                key = lambda b: (b["less"], b["none"], b["id"] or 0)
                held["best"] = min(held["best"], row["best"], key=key)
                held["n"] += row["n"]
            else:
                if held is not None:
                    out.append(held)
                held = row
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([held], schema=batch.schema)


def membership(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; null is empty.
    Of a group the row with most code points, then smallest id, stays; null ids come
    last.  Rows that repeat both the id and all of the text are one decision: each has
    ``kept``; ``kept_rows`` leaves one of them.
    """
    rows = materialize(digests(docs, doc_id, text), "digests")
    runs: list[DataFrame] = []
    groups = materialize(tree_merge(rows, written=runs), "digest_groups")
    discard(*runs)
    joined = rows.join(growing(groups.withColumnRenamed("points", "most")), KEY, "left")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns, one for each group of equal texts."""
    decisions = membership(docs, doc_id, text).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    ids = materialize(decisions.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.count(F.lit(1)).alias("_rows")), "kept")
    plain = F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACES.decode(), ""), 256)
    # The whole row travels as one value, so no column name of the input can clash.
    marked = docs.select(F.col(doc_id).cast("long").alias("_own_id"), plain.alias("_own_sha"), F.coalesce(F.length(text), F.lit(-1)).alias("_size"), F.struct("*").alias("_row"))
    found = marked.join(growing(ids), marked["_own_id"].eqNullSafe(ids["_id"]) & (marked["_own_sha"] == ids["_sha"]))
    once = found.filter("_rows = 1").select("_row.*")
    # Rows that repeat an id and a normalised text: the longest original.
    again = found.filter("_rows > 1").groupBy("_own_id", "_own_sha").agg(F.max_by("_row", "_size").alias("_row")).select("_row.*")
    return once.unionByName(again)

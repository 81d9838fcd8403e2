"""Following append-only generation logs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

COMPOUND_SCHEMA = "step int, sequence string, reward double, cluster_id int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_compounds(spark: SparkSession, path: str, schema: str | T.StructType = COMPOUND_SCHEMA, fmt: str = "csv", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on disk: the set of seen sequences outgrows the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _exists(spark: SparkSession, path: str):
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def _state(spark: SparkSession, folder: str, batch_id: int):
    """What the batch before wrote; only the first batch has none."""
    before = _exists(spark, f"{folder}/batch={batch_id - 1}")
    if before is None and batch_id > 0:
        raise ValueError(f"{folder} lacks the state of batch {batch_id - 1}; totals would start again from nothing")
    return before


def _trigger(writer, once: bool, interval: str):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)


def check_fingerprint(spark: SparkSession, folder: str, description: str) -> None:
    """Refuse to resume a folder that another query definition wrote."""
    path = f"{folder}/definition"
    stored = _exists(spark, path)
    if stored is None:
        spark.createDataFrame([(description,)], "definition string").coalesce(1).write.mode("overwrite").parquet(path)
    elif stored.first()["definition"] != description:
        raise ValueError("the folder was written by a different query; use a new folder to start over")


def monitor_stream(
    stream: DataFrame, folder: str, once: bool = False, interval: str = "30 seconds", last: int = 100, order: tuple[str, ...] = ("step",)
) -> StreamingQuery:
    """Progress of a growing log: rows so far, latest step, mean reward of the last rows.

    Every batch writes one row under its batch id, built from the row before
    it, so a replayed batch overwrites itself.  The carried tail has at most
    ``last`` rows.
    """
    spark = stream.sparkSession
    check_fingerprint(spark, folder, f"monitor last={last} order={order}")
    fields = list(dict.fromkeys([*order, "reward"]))

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.orderBy(*[F.desc(c) for c in order]).limit(last).select(*fields)
        before = _state(spark, f"{folder}/progress", batch_id)
        counted = batch.agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("latest"))
        if before is None:
            total, latest = F.col("n"), F.col("latest")
            tail = newest
            totals = counted
        else:
            tail = newest.unionByName(before.select(F.inline("tail")).select(*fields))
            tail = tail.orderBy(*[F.desc(c) for c in order]).limit(last)
            earlier = before.select(F.struct("n_rows", "latest_step")).scalar()
            totals = counted.withColumn("_e", earlier)
            total, latest = F.col("n") + F.col("_e.n_rows"), F.greatest(F.col("latest"), F.col("_e.latest_step"))
        packed = tail.agg(F.collect_list(F.struct(*fields)).alias("tail"), F.avg("reward").alias("mean"))
        row = totals.select(total.alias("n_rows"), latest.alias("latest_step"), F.col("n").alias("n_new")).withColumn(
            "_p", packed.select(F.struct("tail", "mean")).scalar()
        )
        row.select("n_rows", "latest_step", "n_new", F.col("_p.mean").alias("mean_recent"), F.col("_p.tail").alias("tail")).withColumn(
            "at", F.current_timestamp()
        ).write.mode("overwrite").parquet(f"{folder}/progress/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    return _trigger(writer, once, interval).start()


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """One row per check, with the rate since the check before; checks are few."""
    rows = spark.read.parquet(f"{folder}/progress")
    earlier = F.lag("at").over(Window.orderBy("batch"))
    minutes = (F.col("at").cast("double") - earlier.cast("double")) / 60
    rate = F.when(earlier.isNotNull(), F.col("n_new") / F.greatest(minutes, F.lit(1e-6))).otherwise(0.0)
    return rows.select("batch", "n_rows", "n_new", "latest_step", "mean_recent", rate.alias("rows_per_minute"))


class Visits(StatefulProcessor):
    """Number the rows of a key in order, going on from the visits of earlier batches.

    The state of a key is one number; a batch touches those of its own keys only.
    """

    def __init__(self, columns: list[str], order: list[str], ttl_ms: int | None):
        self.columns, self.order, self.ttl_ms = columns, order, ttl_ms

    def init(self, handle) -> None:
        self.count = handle.getValueState("visits", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[-1] is None or key[-1] != key[-1]:  # without a cluster there is nothing to count
            for part in rows:
                yield part.assign(visit_bonus=0.0)[self.columns]
            return
        before = self.count.get()[0] if self.count.exists() else 0
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        self.count.update((before + len(batch),))
        yield batch.assign(visit_bonus=1.0 / np.sqrt(np.arange(before + 1, before + len(batch) + 1)))[self.columns]

    def close(self) -> None:
        pass


def novel_stream(stream: DataFrame, training: DataFrame, key: str = "sequence", order: tuple[str, ...] = ("step",)) -> DataFrame:
    """The first row of each sequence that is neither in training nor was emitted before, across restarts.

    For ``write_stream`` in update mode.  The state of a sequence is its first row by ``order`` and
    the times of the first and the latest batch that held it; a batch touches its own
    sequences only, and emits those for which both are its own time (a replayed batch
    has the same).  Over a log whose batches arrive in order the rows are the batch form's.
    """
    use_rocksdb(stream.sparkSession)
    unknown = stream.filter(F.col(key).isNotNull()).join(training.select(key).distinct(), key, "left_anti")
    first = F.min_by(F.struct(*[F.col(c) for c in stream.columns]), F.struct(*[F.col(c) for c in order])).alias("_row")
    timed = unknown.withColumn("_now", F.current_timestamp())
    states = timed.groupBy(key).agg(first, F.min("_now").alias("_since"), F.max("_now").alias("_latest"))
    return states.filter("_since = _latest").select("_row.*")


def step_metrics_stream(stream: DataFrame, step: str = "step") -> DataFrame:
    """New rows and mean reward per step, updated as rows arrive."""
    return stream.groupBy(step).agg(F.count(F.lit(1)).alias("n_new"), F.avg("reward").alias("mean_reward"))


def write_stream(
    df: DataFrame, folder: str, mode: str = "append", once: bool = False, interval: str = "30 seconds", definition: str = ""
) -> StreamingQuery:
    """Run a stream into ``folder``: appended parts, or one replaced table per
    batch for update and complete results."""
    check_fingerprint(df.sparkSession, folder, f"{mode} {definition} {sorted(df.columns)}")
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", f"{folder}/rows")
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

        writer = df.writeStream.outputMode(mode).foreachBatch(write)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    return _trigger(writer, once, interval).start()


def latest_rows(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The newest version of each key of an update-mode table."""
    rows = spark.read.parquet(f"{folder}/rows")
    kept = [c for c in rows.columns if c != "batch"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), "batch").alias("_row"))
    return newest.select("_row.*")


def visitation_stream(
    stream: DataFrame, folder: str, keys: tuple[str, ...] = ("run", "cluster_id"), order: tuple[str, ...] = ("step", "rid", "pos"),
    once: bool = False, interval: str = "30 seconds", ttl_minutes: int | None = None,
) -> StreamingQuery:
    """The running visitation bonus over a log whose batches arrive in step order.

    Visits are state by key; a batch reads and writes only the keys it holds.  The rows
    of one key in one batch are ordered in one task, so the reader's ``files_per_batch``
    bounds what a busy cluster takes.  ``ttl_minutes`` drops counters that long untouched.
    """
    use_rocksdb(stream.sparkSession)
    ttl, mode = (None, "None") if ttl_minutes is None else (ttl_minutes * 60_000, "ProcessingTime")
    schema = T.StructType([*stream.schema.fields, T.StructField("visit_bonus", T.DoubleType())])
    numbered = stream.groupBy(*keys).transformWithStateInPandas(Visits(schema.names, list(order), ttl), schema, "Append", mode)
    return write_stream(numbered, folder, once=once, interval=interval, definition=f"visits keys={keys} order={order}")

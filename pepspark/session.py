"""Session settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "pepspark", **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` overrides any setting.

    On a cluster the submit command names the master and sizes executors, so
    only plan-level settings are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        # The JVM never compiles methods above 8000 bytecodes; wide descriptor
        # projections run faster split into small ones than fused into one.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder for reliable checkpoints.

    The shared folder named by ``spark.checkpoint.dir`` wins.  Only a
    single-machine session that names none gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not named:
        if not fallback and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        named = fallback or tempfile.mkdtemp(prefix="pepspark-ckpt-")
    context.setCheckpointDir(named)
    return os.fspath(context.getCheckpointDir() or named)

"""Streams in several batches equal their batch forms, and resume."""

import pytest
from pyspark.sql import functions as F

from pepspark.operators import scoring as sc
from pepspark.operators import summaries as sm
from pepspark.streaming import monitor as mo

SCHEMA = "run string, step int, rid int, sequence string, reward double, cluster_id int"


def batch_rows(step):
    return [("r", step, i, f"{'ACDE'[i % 4]}{'KLM'[(step + i) % 3]}", step + i / 10, (step + i) % 3) for i in range(5)]


@pytest.fixture
def log(spark, tmp_path):
    folder = tmp_path / "log"
    for step in range(3):
        spark.createDataFrame(batch_rows(step), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, log):
    return mo.read_compounds(spark, log, SCHEMA, "parquet", files_per_batch=1)


def test_monitor(spark, log, tmp_path):
    out = str(tmp_path / "out")
    mo.monitor_stream(stream(spark, log), out, once=True, last=7, order=("step", "rid")).awaitTermination()
    rows = mo.progress(spark, out).orderBy("batch").collect()
    assert len(rows) == 3 and rows[-1].n_rows == 15 and rows[-1].latest_step == 2
    expected = sm.recent_summary(spark.read.parquet(log), ["step", "rid"], n=7).first().mean_recent
    assert rows[-1].mean_recent == pytest.approx(expected)
    with pytest.raises(ValueError):
        mo.monitor_stream(stream(spark, log), out, once=True, last=8)


def test_novel_and_resume(spark, log, tmp_path):
    out, training = str(tmp_path / "out"), spark.createDataFrame([("AK",)], "sequence string")

    def run():
        mo.write_stream(mo.novel_stream(stream(spark, log), training, order=("step", "rid")), out, "update", once=True).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{out}/rows").drop("batch").collect())

    first = run()
    expected = sorted(tuple(r) for r in sm.first_seen(spark.read.parquet(log), training, ["step", "rid"]).collect())
    assert first == expected and run() == first
    late = [("r", 9, 1, "WWW", 2.0, 0), ("r", 9, 0, "WWW", 1.0, None), ("r", 9, 2, first[0][3], 1.0, 0), ("r", 9, 3, None, 1.0, 0)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(log)
    assert run() == sorted([*first, late[1]], key=lambda r: r[:4])


def test_step_metrics(spark, log, tmp_path):
    out = str(tmp_path / "out")
    mo.write_stream(mo.step_metrics_stream(stream(spark, log)), out, "update", once=True).awaitTermination()
    got = {r.step: (r.n_new, r.mean_reward) for r in mo.latest_rows(spark, out, ["step"]).collect()}
    plain = spark.read.parquet(log).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("m")).collect()
    assert got == {r.step: (r.n, r.m) for r in plain}


def test_visits(spark, log, tmp_path):
    out = str(tmp_path / "out")
    # Files carry one step each but may be listed in any order, so batches follow their write time.
    mo.visitation_stream(stream(spark, log), out, order=("step", "rid"), once=True).awaitTermination()
    got = {(r.step, r.rid): r.visit_bonus for r in spark.read.parquet(f"{out}/rows").collect()}
    plain = sc.visitation_bonus(spark.read.parquet(log), order=["step", "rid"]).collect()
    assert got == pytest.approx({(r.step, r.rid): r.visit_bonus for r in plain})


def test_visits_go_on_after_a_restart(spark, log, tmp_path):
    """Rows without a cluster have no bonus; a second run counts on from the state."""
    out = str(tmp_path / "out")
    run = lambda: mo.visitation_stream(stream(spark, log), out, order=("step", "rid"), once=True).awaitTermination()
    run()
    more = [("r", 7, 1, "A", 1.0, None), ("r", 7, 0, "B", 1.0, 1), ("r", 7, 2, "C", 1.0, 1), ("q", 7, 3, "C", 1.0, 1)]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(log)
    run()
    got = {(r.run, r.step, r.rid): r.visit_bonus for r in spark.read.parquet(f"{out}/rows").collect()}
    plain = sc.visitation_bonus(spark.read.parquet(log), order=["step", "rid"]).collect()
    assert got == pytest.approx({(r.run, r.step, r.rid): r.visit_bonus for r in plain}) and got["r", 7, 1] == 0.0

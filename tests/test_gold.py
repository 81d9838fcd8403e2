"""Hand-derived values."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from pepspark.functions import sequences as sq
from pepspark.operators import curation as cu
from pepspark.operators import similarity as si
from pepspark.sources import fasta, logs, records, tabular


def values(spark, fn, sequences):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "i int, s string")
    return [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, sequences, expected",
    [
        (sq.net_charge, ["KKKKK", "DDDDD", "KD", "GAVLI", "H"], [5.0, -5.0, 0.0, 0.0, 0.1]),
        (sq.hydrophobic_ratio, ["AILMFWVCY", "KRDESTQN", "AK", ""], [1.0, 0.0, 0.5, 0.0]),
        (sq.charge_score, ["KK", "KKKKK", "", "K" * 9, "K" * 11], [1, 1, 0, 1, 0]),
        (sq.length_score_linear, ["A" * n for n in (15, 50, 30, 13, 10, 5, 52)], [1, 1, 1, 0.6, 0, 0, 0.6]),
        (sq.length_score_gauss, ["A" * n for n in (26, 15, 30, 50, 13, 52)], [1, 0.3886, 0.8825, 0.0111, 0, 0]),
    ],
)
def test_scalars(spark, fn, sequences, expected):
    assert values(spark, fn, sequences) == pytest.approx(expected, abs=1e-4)


def test_moment_prefers_amphipathic(spark):
    first, second, short = values(spark, sq.hydrophobic_moment, ["LKKLLKLLKKLLKL", "LLLLKKKKKKLLLL", "L"])
    assert first > second > 0 and short == 0


def test_charge_is_zero_at_the_isoelectric_point(spark):
    df = spark.createDataFrame([("ACDKRHYEG",), ("KKDDEE",)], "s string").withColumn("pi", sq.isoelectric_point("s"))
    for row in df.collect():
        assert abs(values(spark, lambda c: sq.charge_at_ph(c, row.pi), [row.s])[0]) < 1e-3


def test_pair_similarities(spark):
    rows = [("KKKAAA", "KKKAAA"), ("AAAAAA", "KKKKKK"), ("AAAKKK", "AAAAAA"), ("", "A")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(sq.hamming_similarity("a", "b").alias("h"), sq.dipeptide_cosine("a", "b").alias("d")).collect()
    assert [r.h for r in got] == pytest.approx([1, 0, 0.5, 0])
    assert [r.d for r in got] == pytest.approx([1, 0, 2 / 3, 0])


@pytest.mark.parametrize("sim", ["hamming", "dipeptide"])
def test_diversity_penalty_of_copies(spark, sim):
    df = spark.createDataFrame([(1, 1, "KKLLKKLLKK"), (2, 1, "KKLLKKLLKK"), (3, 1, "DEDEDEGGGG"), (4, 2, "KKLLKKLLKK")], "id int, g int, sequence string")
    got = {r.id: r.penalty for r in si.diversity_penalty(df, "g", sim=sim).collect()}
    assert got == pytest.approx({1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0})


def test_kmers_of_long_text_equal_short_path(spark):
    text = "ACDEFGHIKL" * 3
    df = spark.createDataFrame([(text,)], "s string")
    a, b = df.select(sq.kmers("s", 3), sq.kmers("s", 3, long=5)).first()
    assert a == b == [text[i : i + 3] for i in range(len(text) - 2)]


def test_tokens_round_trip_and_stop(spark):
    df = spark.createDataFrame([([1, 3, 4, 2, 5],), ([1, 3, 0, 4],), ([1],), ([1, 22, 1, 3],)], "ids array<int>")
    assert [r[0] for r in df.select(sq.decode_tokens("ids")).collect()] == ["AC", "A", "", "Y"]


def test_shuffle_keeps_residues(spark):
    (got,) = values(spark, sq.shuffle_residues, ["ACDEFGHIKLMNPQ"])
    assert sorted(got) == list("ACDEFGHIKLMNPQ") and got != "ACDEFGHIKLMNPQ"


def test_validation_reasons(spark):
    df = spark.createDataFrame([(None,), (" ",), ("AXA",), ("ACD",), ("A" * 101,), (" acdef ",), ("NAN",)], "sequence string")
    rows = cu.validate(df).select("invalid_reason", "valid").collect()
    assert [r.valid for r in rows] == [False, False, False, False, False, True, False]

    assert rows[0].invalid_reason == "empty sequence" and rows[6].invalid_reason.startswith("below 5aa")


def test_missing_columns_are_listed(spark):
    df = spark.createDataFrame([("A",)], "seq string")
    with pytest.raises(ValueError, match="seq"):
        cu.require_columns(df, ["sequence"])
    with pytest.raises(ValueError):
        cu.resolve_column(df, ["SEQUENCE"])
    assert cu.resolve_column(df, ["SEQUENCE", "seq"]).columns == ["sequence"]


def test_unassigned_cluster_fails(spark):
    df = spark.createDataFrame([(1,), (2,)], "seq_id int")
    clusters = spark.createDataFrame([(1, 7)], "seq_id int, cluster_id int")
    with pytest.raises(Exception, match="no cluster for 2"):
        cu.attach_clusters(df, clusters).collect()


def test_fasta_files(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_text(">Your search led to 2 peptides\n\n>a b>c\nACD\nEFG\n\n>second\nKK\n")
    got = fasta.read_fasta(spark, str(path), skip_header_like="search led to").collect()
    assert [(r.id, r.sequence) for r in got] == [("a b>c", "ACDEFG"), ("second", "KK")]
    out = str(tmp_path / "out.fasta")
    fasta.write_fasta(spark.createDataFrame([("x", "AAA"), ("y", "CC")], "id string, sequence string").coalesce(1), out)
    assert sorted((r.id, r.sequence) for r in fasta.read_fasta(spark, out).collect()) == [("x", "AAA"), ("y", "CC")]


def test_tables_and_text(spark, tmp_path):
    (tmp_path / "p1.csv").write_text("SEQUENCE,x\nAAA,1\nCCC,2\n")
    (tmp_path / "p2.csv").write_text("y,SEQUENCE\n3,AAA\n4,DDD\n")
    merged = tabular.merge_parts(spark, str(tmp_path / "p*.csv"), "SEQUENCE")
    assert sorted(r[0] for r in merged.collect()) == ["AAA", "CCC", "DDD"]
    with pytest.raises(ValueError, match="SEQUENCE"):
        tabular.read_sequences(spark, str(tmp_path / "p1.csv"), "seq")
    (tmp_path / "t.txt").write_text("AAA\n\n CCC \n")
    assert [r.sequence for r in tabular.read_sequences(spark, str(tmp_path / "t.txt")).collect()] == ["AAA", "CCC"]
    (tmp_path / "b.tsv").write_text("Entry\tLength\nP1\t3\n")
    assert tabular.read_tsv(spark, str(tmp_path / "b.tsv"), "Entry string, Length int").first()["Length"] == 3
    assert tabular.sequences_df(spark, "AAA").count() == 1


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["z"])], "id int, category string, tags array<string>")
    tabular.write_csv(df, str(tmp_path / "csv"))
    assert {r.tags for r in tabular.read_csv(spark, str(tmp_path / "csv")).collect()} == {"x;y", "z"}
    tabular.write_by(df, "category", str(tmp_path / "by"))
    assert (tmp_path / "by" / "category=a").is_dir() and (tmp_path / "by" / "category=b").is_dir()
    for _ in range(2):
        tabular.append_remaining(df, str(tmp_path / "resume"), "id")
    assert spark.read.parquet(str(tmp_path / "resume")).count() == 2


def test_nested_records(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"totalCount": 1,\n "data": [{"id": 5, "name": "n", "sequence": "ACD"}]}')
    listed = records.peptide_list(records.read_pages(spark, str(tmp_path / "page.json"))).collect()
    assert len(listed) == 1 and listed[0].id == 5 and len(listed[0]) == 10
    (tmp_path / "detail.json").write_text(
        '{"id": 5, "sequence": "AcD", "targetActivities": [{"targetSpecies": {"name": "", "description": "E. coli"}, "unit": null, '
        '"activity": 1111111.0}, {"peptideId": 6, "targetSpecies": {"name": "S. aureus"}}]}'
    )
    rows = records.flatten_activities(records.read_pages(spark, str(tmp_path / "detail.json"), records.DETAIL_SCHEMA)).collect()
    assert [(r.peptideId, r.targetSpecies, r.unit, r.has_lowercase) for r in rows] == [(5, "E. coli", "", True), (6, "S. aureus", "", True)]


def test_logs(spark, tmp_path):
    (tmp_path / "train.log").write_text("Epoch 0: train_loss=2.7 val_loss=2.8 time=4.1min\n  epoch 1 step 5/10 loss=1.5 lr=6e-04\nnoise\n")
    epochs, batches = logs.parse_training_log(spark, str(tmp_path / "train.log"))
    assert tuple(epochs.first()) == (0, 2.7, 2.8, 4.1)
    assert batches.first()["global_step"] == 15
    step = "step {}/9 mean_reward=1.5 std=0.1 pg_loss=-0.2 kl=0.0 total_loss=0.1 time=2.0s\n"
    terms = "  reward terms (mean): model2=0.{} charge=0.1 length=0.2 hmom=0.3 div=-0.4\n"
    (tmp_path / "run.log").write_text("start\n" + step.format(0) + terms.format(5) + "  -> saved at step 0\n" + step.format(1) + step.format(2) + terms.format(7))
    got = logs.parse_step_log(spark, str(tmp_path / "run.log")).orderBy("step").collect()
    assert [(r.step, r.model2, r.diversity_penalty) for r in got] == [(0, 0.5, -0.4), (2, 0.7, -0.4)]


def test_cosines_and_isoelectric_points_come_in_batches(spark):
    """Long, empty and missing sequences in one batch; both are Python steps of the plan, not loops of the interpreter."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("ACDEK", k=n)), "".join(rng.choices("ACDEKé", k=m))) for i, (n, m) in enumerate([(0, 5), (1, 9), (2, 2), (700, 40), (600_000, 5), (30, 700_000), (50, 50)])]
    df = spark.createDataFrame([*rows, (90, None, "AC"), (91, "AC", None)], "id int, a string, b string").coalesce(1)
    scored = df.select("id", sq.dipeptide_cosine("a", "b").alias("s"), sq.isoelectric_point("a").alias("pi"))
    got = {r.id: (r.s, r.pi) for r in scored.collect()}
    for i, a, b in rows:
        x, y = (collections.Counter(t[k : k + 2] for k in range(len(t) - 1)) for t in (a, b))
        norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        assert got[i][0] == pytest.approx(sum(x[k] * y[k] for k in x) / norm if norm else 0.0)
    assert got[90][0] == got[91][0] == 0.0 and all(4.05 <= pi <= 12.0 for _, pi in got.values())
    assert "ArrowEvalPython" in scored._jdf.queryExecution().executedPlan().toString()

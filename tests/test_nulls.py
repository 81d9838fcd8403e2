"""Rows with NULL groups, keys, steps and sequences stay, with defined values; other inputs the oracle tables never show."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pepspark.functions import sequences as sq
from pepspark.operators import clustering, curation, metrics, sampling, scoring, similarity, statistics, summaries
from pepspark.operators.ranks import exact_quantiles


@pytest.fixture
def rows(spark):
    data = [("a", 1, "ACDEF", 1.0), ("a", 2, "ACDEF", 2.0), (None, 3, "ACDEW", 4.0), (None, 4, "ACDEF", 8.0), ("b", 5, None, 3.0), (None, 6, "ACDEF", 8.0)]
    return spark.createDataFrame(data, "g string, id long, sequence string, v double")


def test_group_zscore(rows):
    got = {r.id: r.advantage for r in scoring.group_zscore(rows, "g", "v").collect()}
    assert len(got) == 6 and got[5] is None and got[3] == pytest.approx((4 - 20 / 3) / math.sqrt(16 / 3))


def test_visit_numbers(spark):
    data = [("r", "c", 1, 1), ("r", "c", None, 2), (None, "c", 1, 3), (None, "c", 2, 4), ("r", None, 1, 5)]
    df = spark.createDataFrame(data, "run string, cluster_id string, step int, rid int").withColumn("pos", F.lit(0))
    got = {r.rid: r.visits for r in scoring.visit_numbers(df).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 2, 5: None}
    bonus = scoring.class_diversity(df, spark.createDataFrame([("c",)], "cluster_id string"))
    assert bonus.count() == 5


def test_quantiles_and_describe(rows):
    got = {r.g: r.m for r in exact_quantiles(rows, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {"a": 1.5, None: 8.0, "b": 3.0}
    described = {r.g: (r.n, r.q50) for r in summaries.describe_by(rows, ["v"], "g").collect()}
    assert described == {"a": (2, 1.5), None: (3, 8.0), "b": (1, 3.0)}


def test_diversity_of_groups(rows):
    got = {r.g: (r.n_distinct, r.n_total) for r in summaries.kmer_diversity(rows, "g").collect()}
    assert got == {"a": (4, 8), None: (5, 12), "b": (0, 0)}
    entropy = {r.g: r.entropy for r in summaries.residue_entropy(rows, "g").collect()}
    assert entropy["a"] == pytest.approx(math.log2(5) / math.log2(20)) and entropy["b"] == 0 and entropy[None] > entropy["a"]


def test_entropy_counts_every_character(spark):
    df = spark.createDataFrame([("x", "AAb-"), ("x", "é")], "g string, sequence string")
    expected = -(0.4 * math.log2(0.4) + 3 * 0.2 * math.log2(0.2)) / math.log2(20)
    assert summaries.residue_entropy(df, "g").first().entropy == pytest.approx(expected)


@pytest.mark.parametrize("sim", ["hamming", "dipeptide"])
def test_diversity_penalty(rows, sim):
    got = {r.id: r.penalty for r in similarity.diversity_penalty(rows, "g", sim=sim, threshold=0.7).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[1] == got[4] == got[6] == pytest.approx(1.0)
    assert got[5] is None and 0 < got[3] < 1


def test_mean_pairwise(rows):
    got = {r.g: r.n_pairs for r in similarity.mean_pairwise(rows.filter("sequence is not null"), "g", "id").collect()}
    assert got == {"a": 1, None: 3}


def test_clusters_and_splits(rows):
    got = {r.id: r.cluster_id for r in clustering.cluster_by_kmer(rows).collect()}
    assert len(got) == 6 and got[5] is None and got[1] == got[2] == got[4]
    split = {(r.g, r.split) for r in clustering.cluster_split(rows, "g", exact=True).collect()}
    assert {g for g, _ in split} == {"a", "b", None} and (None, None) in split


def test_weights_and_metrics(rows):
    weights = sampling.temper_weights(rows, "g").collect()
    assert len(weights) == 4 and sum(r.sample_weight for r in weights) == pytest.approx(1.0)
    scored = rows.withColumns({"y": (F.col("v") > 3).cast("int"), "s": F.col("v") / 10})
    swept = metrics.best_threshold(scored, "y", "s", ["g"])
    assert {r.g for r in swept.collect()} == {"a", "b", None}
    none = {r.threshold: (r.tp, r.fp) for r in metrics.threshold_sweep(scored, "y", "s", ["g"]).filter("g is null").collect()}
    assert none[0.3] == (3, 0) and none[0.5] == (2, 0)
    area = {r.g: r.auroc for r in metrics.auroc(scored.withColumn("y", (F.col("id") == 4).cast("int")), "y", "s", ["g"]).collect()}
    assert area[None] == 0.75 and area["a"] is None


def test_profiles_and_provenance(rows):
    assert {r.g: r.n_rows for r in summaries.cluster_profile(rows, "g", "id").collect()} == {"a": 2, None: 3, "b": 1}
    ids = curation.provenance_ids(rows.select("sequence", F.col("id").cast("string").alias("source_id"))).collect()
    assert sum(len(r.source_ids) for r in ids) == 6


def test_correlation_is_pairwise_complete(spark):
    data = [(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, None, 5.0), (4.0, 8.0, 2.0), (None, 1.0, 7.0)]
    df = spark.createDataFrame(data, "a double, b double, c double").withColumn("k", F.lit(3.3))
    got = {(r.feature_a, r.feature_b): r.correlation for r in statistics.correlation_pairs(df, {c: F.col(c) for c in "abck"}, [("a", "b"), ("a", "c"), ("a", "k")]).collect()}
    expected = df.select(F.corr("a", "b"), F.corr("a", "c")).first()
    assert got["a", "b"] == pytest.approx(expected[0]) and got["a", "c"] == pytest.approx(expected[1]) and got["a", "k"] is None
    blocks = df.select(F.array("a", "b").alias("v"), "c")
    assert statistics.correlate_blocks(blocks, "v", ["c"]).count() == 2


def test_poisson_at_any_mean(spark):
    df = spark.range(2000).withColumn("w", F.lit(1.0))
    for mean in (0.3, 40.0, 700.0):
        got = sampling.poisson_sample(df, "id", "w", int(2000 * mean)).agg(F.avg("n_draws"), F.var_samp("n_draws")).first()
        assert got[0] == pytest.approx(mean, abs=5 * math.sqrt(mean / 2000)) and got[1] == pytest.approx(mean, rel=0.2)


def test_tokens_controls_and_codes(spark):
    one = spark.createDataFrame([("ACDEFGHIKL",), ("LKIHGFEDCA",)], "s string")
    scrambled = [r[0] for r in one.select(sq.shuffle_residues("s")).collect()]
    order = [["ACDEFGHIKL".index(c) for c in scrambled[0]], ["LKIHGFEDCA".index(c) for c in scrambled[1]]]
    assert order[0] != order[1] and all(sorted(s) == sorted("ACDEFGHIKL") for s in scrambled)
    with pytest.raises(PySparkException, match="no token"):
        spark.createDataFrame([("AXB",)], "s string").select(sq.token_ids("s", 5)).collect()
    with pytest.raises(PySparkException, match="other characters"):
        spark.createDataFrame([("Ba",)], "s string").select(similarity.kmer_code(F.col("s"), 2)).collect()

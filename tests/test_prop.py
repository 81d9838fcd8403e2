"""Invariants, and brute-force checks of queries that SQL cannot express."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pepspark.operators import clustering as cl
from pepspark.operators import metrics as me
from pepspark.operators import ranks
from pepspark.operators import sampling as sa
from pepspark.operators import scoring as sc
from pepspark.operators import similarity as si

WORDS = ["ACDEFGHIKLMN", "ACDEFGHIKLMNP", "CDEFGHIKLM", "WWYYVVTTSSRR", "WWYYVVTTSSRRQQ", "PPNNMMLLKKII", "ACDEFGHWWYYVVTT", "GGGGGGGGGGGG"]


@pytest.fixture(scope="module")
def sequences(spark):
    rows = [(f"s{i:02d}", w[i % 3 :]) for i, w in enumerate(WORDS * 3)]
    return spark.createDataFrame(rows, "id string, sequence string").cache()


def kset(s, k):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def brute_pairs(rows, k, tau):
    found = set()
    for (a, s), (b, t) in combinations(rows, 2):
        x, y = kset(s, k), kset(t, k)
        if x and y and len(x & y) >= tau * min(len(x), len(y)) - 1e-9:
            found.add(frozenset((a, b)))
    return found


@pytest.mark.parametrize("k, tau", [(3, 0.5), (2, 0.7), (3, 1.0)])
def test_similar_pairs_equal_brute_force(sequences, k, tau):
    rows = [tuple(r) for r in sequences.collect()]
    got = {frozenset((r.id_a, r.id_b)) for r in cl.similar_pairs(sequences, k=k, tau=tau).collect()}
    assert got == brute_pairs(rows, k, tau)


@pytest.mark.parametrize("k, tau", [(3, 0.5), (2, 0.6), (3, 0.9)])
def test_greedy_equals_longest_first_loop(sequences, k, tau):
    names = {}
    for i, s in sorted(tuple(r) for r in sequences.collect()):
        names.setdefault(s, i)
    order = sorted(names, key=lambda s: (-len(s), names[s]))
    pairs = brute_pairs([(names[s], s) for s in order], k, tau)
    cluster, reps = {}, []
    for s in order:
        match = next((r for r in reps if frozenset((names[r], names[s])) in pairs), None)
        cluster[s] = names[match] if match else names[s]
        if match is None:
            reps.append(s)
    got = cl.cluster_by_kmer(sequences, k=k, tau=tau).join(sequences, "id").collect()
    assert {r.id: r.cluster_id for r in got} == {r.id: cluster[r.sequence] for r in got} and len(got) == sequences.count()


def test_components_leave_no_pair_across_splits(sequences):
    clusters = cl.cluster_by_kmer(sequences, k=3, mode="components")
    split = cl.cluster_split(clusters.join(sequences, "id"))
    assert [r.n_crossing for r in cl.split_audit(split).collect()] == [0, 0]
    assert cl.crossing_pairs(cl.similar_pairs(sequences, k=3), split).first().n_crossing == 0


@pytest.mark.parametrize("sim", ["hamming", "dipeptide"])
def test_penalty_equals_brute_force(spark, sequences, sim):
    def hamming(a, b):
        return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))

    def cosine(a, b):
        from collections import Counter

        x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
        return sum(x[k] * y[k] for k in x) / (sum(v * v for v in x.values()) ** 0.5 * sum(v * v for v in y.values()) ** 0.5)

    measure = hamming if sim == "hamming" else cosine
    near = spark.createDataFrame([("n1", "ACDEFGHIKLAA"), ("n2", "ACDEFGHIWWMN")], "id string, sequence string")
    rows = sequences.dropDuplicates(["sequence"]).unionByName(near)
    listed = [tuple(r) for r in rows.collect()]
    expected = {}
    for i, s in listed:
        best = max(measure(s, t) for j, t in listed if j != i)
        expected[i] = max(0.0, (best - 0.7) / 0.3)
    got = {r.id: r.penalty for r in si.diversity_penalty(rows.withColumn("g", F.lit(1)), "g", sim=sim).collect()}
    assert got == pytest.approx(expected, abs=1e-9)


def test_results_do_not_depend_on_partitioning(sequences):
    def run(df):
        return sorted(tuple(r) for r in ranks.hash_ordinal(df, "id", 7).select("id", "ordinal").collect())

    first = run(sequences.coalesce(1))
    assert first == run(sequences.repartition(8)) == run(sequences.repartition(64))
    assert sorted(n for _, n in first) == list(range(1, len(first) + 1))


def test_auroc_of_negated_score(spark):
    df = spark.range(500).select((F.xxhash64("id") % 2 == 0).cast("int").alias("y"), (F.xxhash64("id", F.lit(1)) % 97 / 97).alias("s"))
    up = me.auroc(df, "y", "s").first().auroc
    down = me.auroc(df.withColumn("s", -F.col("s")), "y", "s").first().auroc
    assert up + down == pytest.approx(1.0)


def test_auprc_interpolated_of_perfect_and_constant_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)], "y int, s double")
    assert me.auprc_interpolated(df, "y", "s").first()[0] == pytest.approx(1.0)
    assert me.auprc_interpolated(df.withColumn("s", F.lit(0.5)), "y", "s").first()[0] == pytest.approx(0.5)


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8)], "y int, s double")
    assert me.auroc(df, "y", "s").first().auroc is None


def test_quantiles_match_numpy(spark):
    import numpy as np

    data = [float((i * 37) % 101) ** 2 for i in range(257)]
    df = spark.createDataFrame([(x,) for x in data], "v double")
    row = ranks.exact_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.975}).first()
    assert tuple(row) == pytest.approx(tuple(np.quantile(data, [0.1, 0.5, 0.975])))


def test_slices_are_balanced_under_an_outlier(spark):
    """One far outlier, 99 % of the values in a narrow range, one value in a third of the rows, a NULL group."""
    wide = spark.range(20_000).select((F.col("id") / 1e6).alias("v"), F.lit("a").alias("g")).unionByName(
        spark.range(200).select((F.col("id") * 1000.0).alias("v"), F.lit("a").alias("g"))
    )
    wide = wide.unionByName(spark.createDataFrame([(1e300, "a"), (float("nan"), "a"), (-1e300, None)], "v double, g string"))
    heavy = wide.unionByName(spark.range(10_000).select(F.lit(0.005).alias("v"), F.lit("a").alias("g")))
    counts = heavy.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = ranks.value_bucket(counts, "v", ["g"], rows=500).filter("g = 'a'").orderBy("v").collect()
    buckets = [r._bucket for r in rows]
    sizes = [buckets.count(b) for b in set(buckets)]
    assert buckets == sorted(buckets) and 25 <= len(sizes) <= 60 and max(sizes) <= 1200
    fewer = ranks.value_bucket(counts, "v", ["g"], rows=5000).filter("g = 'a'").select("_bucket").distinct().count()
    assert 2 <= fewer <= 8
    alone = ranks.value_bucket(counts.filter("g is null"), "v", rows=500).collect()
    assert [(r.v, r._bucket) for r in alone] == [(-1e300, 0)]


def test_ranks_over_many_slices(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ranks.value_bucket, "__defaults__", ((), 50))
    data = [float((i * 37) % 1009) ** 5 for i in range(1000)] + [1e250]
    df = spark.createDataFrame([(x, i % 3 % 2) for i, x in enumerate(data)], "s double, y int")
    row = ranks.exact_quantiles(df, "s", {"a": 0.1, "b": 0.5, "c": 0.975}).first()
    assert tuple(row) == pytest.approx(tuple(np.quantile(data, [0.1, 0.5, 0.975])))
    order = sorted(range(len(data)), key=lambda i: data[i])
    rank = {i: r + 1 for r, i in enumerate(order)}
    positive = [i for i in range(len(data)) if i % 3 % 2]
    u = sum(rank[i] for i in positive) - len(positive) * (len(positive) + 1) / 2
    assert me.auroc(df, "y", "s").first().auroc == pytest.approx(u / (len(positive) * (len(data) - len(positive))))


def test_bootstrap_interval_holds_the_point_estimate(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") * 7919 % 1000 + 300 * (F.col("id") % 2)) / 1300).alias("s"))
    point = me.auroc(df, "y", "s").first().auroc
    row = me.bootstrap_auroc(df, "id", "y", ["s"], n=100).first()
    assert row.lower < point < row.upper and row.n_replicates == 100
    assert me.bootstrap_diff(df, "id", "y", "s", "s", n=20).first().mean_diff == 0.0


def test_replicates_of_collapsed_cells_equal_rows(spark):
    """Weights by row and plain rank sums, against arrays over cells in many slices; ties, a third of all rows equal, NULLs."""
    import random

    import numpy as np

    rng = random.Random(2)
    rows = [(f"r{i}", rng.choice([0, 1, 1]), rng.choice([0.5, rng.random(), float(rng.randrange(4))]), rng.choice([None, 0.25, 0.75])) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, y int, a double, b double").repartition(7)
    n = 13
    weights = me.poisson_weights(7, [r[0] for r in rows], n)
    cells = me.replicate_cells(df.select("id", "y", F.lit("a").alias("model"), F.col("a").alias("score")), "id", ["model", "score", "y"], n, 7)
    got = {r.replicate: r.auroc for r in me.replicate_auroc(cells, n, rows=20).collect()}
    scores, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for k in range(n):
        s, truth = np.repeat(scores, weights[:, k]), np.repeat(y, weights[:, k])
        wins = (s[truth == 1][:, None] > s[truth == 0][None, :]).mean() + 0.5 * (s[truth == 1][:, None] == s[truth == 0][None, :]).mean()
        assert got[k] == pytest.approx(wins)
    assert abs(me.poisson_weights(1, [str(i) for i in range(2000)], 40).mean() - 1.0) < 0.02
    row = me.bootstrap_auroc(df, "id", "y", ["a", "b"], n=50, metric=me.recall, thresholds={"a": 0.9}).orderBy("model").collect()
    point = sum(r[2] >= 0.9 for r in rows if r[1] == 1) / sum(r[1] for r in rows)
    assert [r.model for r in row] == ["a", "b"] and row[0].lower < point < row[0].upper and row[0].n_replicates == 50
    one_class = me.bootstrap_auroc(df.filter("y = 1"), "id", "y", ["a"], n=8).collect()
    assert one_class == []


def test_nearest_of_many_centroids(spark):
    """20,000 centroids in several blocks, equally near ones in different blocks, repeated and unusable vectors."""
    import numpy as np

    rng = np.random.default_rng(4)
    points = rng.normal(size=(20_000, 4)).round(3)
    points[19_000] = points[7]
    vectors = [points[7].tolist(), points[19_999].tolist(), *rng.normal(size=(60, 4)).tolist(), points[7].tolist(), None, []]
    centroids = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "cluster_id int, embedding array<double>").repartition(6)
    df = spark.createDataFrame(list(enumerate(vectors)), "id int, embedding array<double>")
    usable = np.array([v for v in vectors if v])
    expected = ((usable[:, None, :] - points[None, :, :]) ** 2).sum(axis=2).argmin(axis=1).tolist() + [None, None]
    for block in (1 << 20, 9000):
        got = {r.id: r.cluster_id for r in si.assign_clusters(df, centroids, block=block).collect()}
        assert [got[i] for i in range(len(vectors))] == expected and got[0] == 7
    with pytest.raises(ValueError):
        si.assign_clusters(df, centroids.limit(0))
    with pytest.raises(ValueError):
        si.assign_clusters(df, centroids.unionByName(centroids.limit(1)))


def test_weighted_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "id int, w double")
    drawn = {r["id"]: r["count"] for r in sa.weighted_sample(df, "id", "w", 2000).groupBy("id").count().collect()}
    assert sum(drawn.values()) == 2000 and 3 not in drawn and 0.7 < drawn[2] / 2000 < 0.8
    big = spark.range(3000).select("id", F.lit(1.0).alias("w"))
    total = sa.poisson_sample(big, "id", "w", 1500).agg(F.sum("n_draws")).first()[0]
    assert 1300 < total < 1700


def test_no_draw_is_lost_or_doubled(spark):
    """Weights over eighteen orders of magnitude, NULL, zero and negative ones; one row with a third of the weight."""
    weight = F.pow(F.lit(10.0), F.pmod(F.xxhash64("id"), F.lit(1800)) / 100 - 12)
    rows = spark.range(100_000).select("id", F.when(F.col("id") % 1000 == 0, None).when(F.col("id") % 1000 == 1, 0.0).when(F.col("id") % 1000 == 2, -5.0).otherwise(weight).alias("w"))
    hot = rows.agg(F.sum(F.when(F.col("w") > 0, F.col("w")))).first()[0] / 2
    rows = rows.unionByName(spark.createDataFrame([(-1, hot)], "id long, w double"))
    for n in (1, 7, 30_000):
        drawn = sa.weighted_sample(rows, "id", "w", n).select("draw", "id", "w").collect()
        assert sorted(r.draw for r in drawn) == list(range(n)) and all(r.w > 0 for r in drawn)
    assert 0.32 < sum(r.id == -1 for r in drawn) / n < 0.35
    assert sa.weighted_sample(rows.filter("w < 0"), "id", "w", 5).count() == 0


def test_ids_in_order(spark):
    """A sequence with a third of all rows in lists of ten, one after the other."""
    from pepspark.operators import curation as cu

    rows = [("HOT", f"i{(i * 37) % 500:03d}", (i * 37) % 500) for i in range(500)] + [(f"S{i}", f"x{i}{j}", -j) for i in range(90) for j in range(i % 3 + 1)] + [(None, "n", 0)]
    df = spark.createDataFrame(rows, "sequence string, source_id string, at int").repartition(6)
    got = {}
    for r in sorted(cu.provenance_ids(df, 10, ["at"]).collect(), key=lambda r: r.part):
        got.setdefault(r.sequence, []).append(r.source_ids)
    assert got["HOT"] == [[f"i{10 * p + k:03d}" for k in range(10)] for p in range(50)] and got[None] == [["n"]]
    assert got["S2"] == [["x22", "x21", "x20"]] and len(got) == 92


def test_small_and_large_reference_paths_agree(spark):
    import math

    points = [(i, [math.cos(i * 0.37), math.sin(i * 0.37), math.cos(i * 1.3)]) for i in range(60)]
    df = spark.createDataFrame(points, "id int, embedding array<double>")
    negatives = df.filter("id < 40").select("embedding")
    a = {r.id: r.penalty for r in si.ad_penalty(df, negatives).collect()}
    b = {r.id: r.penalty for r in si.ad_penalty(df, negatives, limit=3, pivots=5).collect()}
    assert a == pytest.approx(b, abs=1e-6) and a[0] == pytest.approx(1.0)


def test_scorer_length_mismatch_fails(spark, sequences):
    def short(batches):
        for batch in batches:
            yield batch.iloc[:-1].str.len().astype("float64")

    sc.register_scorer("short", short)
    with pytest.raises(Exception, match="scores for"):
        sc.score_column(sequences, "short").collect()


def test_rows_without_cluster_get_no_bonus(spark):
    df = spark.createDataFrame([("r", 0, 0, 1), ("r", 0, 1, None), ("r", 1, 0, 1)], "run string, step int, rid int, cluster_id int")
    rows = sc.class_diversity(df, df.select("cluster_id"), order=["step", "rid"]).orderBy("step", "rid").collect()
    assert [r.class_bonus for r in rows] == pytest.approx([0.5, 0.0, 0.5 / 2**0.5])

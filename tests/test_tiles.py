"""Sparse overlaps against plain counting."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pepspark.operators import clustering as cl
from pepspark.operators import sampling as sa
from pepspark.operators import similarity as si
from pepspark.operators import tiles
from pepspark.session import ensure_checkpoint_dir


def counted(s, k):
    return collections.Counter(s[i : i + k] for i in range(len(s) - k + 1))


@pytest.mark.parametrize("k, cells", [(1, 1), (2, 7), (3, 1 << 20)])
def test_overlaps_equal_counting(k, cells):
    rng = random.Random(k)
    words = ["".join(rng.choices("ABC", k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(40)] + ["", "A"]
    rows = tiles.kmer_counts(words, k)
    half = np.arange(len(words)) % 2 == 0
    got = np.zeros((half.sum(), (~half).sum()))
    for start, stop, dots in tiles.overlaps(rows.take(half), rows.take(~half), cells):
        got[start:stop] = dots
    left, right = words[::2], words[1::2]
    expected = [[sum(n * counted(b, k)[c] for c, n in counted(a, k).items()) for b in right] for a in left]
    assert got.tolist() == expected


def test_spaces_share_nothing():
    rows = tiles.kmer_counts(["AB", "AB", "AB"], 2, [0, 1, 0])
    dots = np.concatenate([d for _, _, d in tiles.overlaps(rows, rows)])
    assert dots.tolist() == [[1, 0, 1], [0, 1, 0], [1, 0, 1]]


def test_lists_without_codes():
    none = tiles.Sparse.of_lists(pa.array([[], [], None], pa.list_(pa.int64())))
    some = tiles.Sparse.of_lists(pa.chunked_array([[[1, 2]], [[2, 9]]], pa.list_(pa.int64())))
    assert [d.tolist() for _, _, d in tiles.overlaps(some, none)] == [[[0, 0, 0], [0, 0, 0]]]
    assert [d.tolist() for _, _, d in tiles.overlaps(some, some)] == [[[2, 1], [1, 2]]]


def test_other_characters_fail():
    with pytest.raises(ValueError):
        tiles.kmer_counts(["AB-"], 2)


def test_numbers_follow_the_order(spark):
    ensure_checkpoint_dir(spark)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 5 + 1).cast("int").alias("w"))
    numbered, n = tiles.numbered_blocks(df.repartition(9), ["v"], "w", 40)
    rows = sorted(numbered.collect(), key=lambda r: r.v)
    assert [r.ordinal for r in rows] == list(range(1000))
    blocks = [r.block for r in rows]
    assert blocks == sorted(blocks) and set(blocks) == set(range(n))
    weights = collections.Counter()
    for r in rows:
        weights[r.block] += r.w
    assert max(weights.values()) <= 45
    assert tiles.numbered_blocks(df.limit(0), ["v"], "w")[1] == 0


def families(n, seed):
    """Sequences in families that share long pieces, and some that share nothing."""
    rng = random.Random(seed)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    roots = ["".join(rng.choices(letters, k=30)) for _ in range(12)]
    out = set()
    while len(out) < n:
        root = rng.choice(roots)
        s = root[rng.randrange(10) :][: rng.randrange(5, 28)] + "".join(rng.choices(letters[:4], k=rng.randrange(8)))
        out.add(s if rng.random() < 0.9 else "".join(rng.choices(letters, k=rng.randrange(1, 40))))
    return sorted(out)


def similar(a, b, k, tau):
    x, y = set(counted(a, k)), set(counted(b, k))
    return bool(x and y) and len(x & y) >= tau * min(len(x), len(y)) - 1e-9


@pytest.mark.parametrize("heavy", [0, 6, 10_000])
def test_pairs_by_join_and_by_tile(spark, monkeypatch, heavy):
    """No rare codes, both kinds, no common codes: always the same pairs, in many small blocks."""
    monkeypatch.setattr(cl.numbered_blocks, "__defaults__", (200,))
    words = families(220, 4)
    df = spark.createDataFrame([(f"s{i:03d}", s) for i, s in enumerate(words)], "id string, sequence string")
    for k, tau in ((3, 0.5),):
        got = [(r.id_a, r.id_b) for r in cl.similar_pairs(df, k=k, tau=tau, heavy=heavy).collect()]
        sets = {f"s{i:03d}": (len(counted(s, k)), f"s{i:03d}") for i, s in enumerate(words)}
        expected = {(f"s{i:03d}", f"s{j:03d}") for i, a in enumerate(words) for j, b in enumerate(words) if i != j and similar(a, b, k, tau) and sets[f"s{i:03d}"] < sets[f"s{j:03d}"]}
        assert len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("heavy, first, edges", [(0, 50, 1 << 22), (6, 20, 0), (10_000, 1000, 1 << 22)])
def test_greedy_in_batches_equals_the_loop(spark, monkeypatch, heavy, first, edges):
    """One batch or many; elections in one task, or in rounds."""
    monkeypatch.setattr(cl.numbered_blocks, "__defaults__", (300,))
    monkeypatch.setattr(cl, "MOST_EDGES", edges)
    words = families(160, 9)
    order = sorted(words, key=lambda s: (-len(s), s))
    reps, expected = [], {}
    for s in order:
        expected[s] = next((r for r in reps if similar(r, s, 3, 0.5)), s)
        if expected[s] == s:
            reps.append(s)
    df = spark.createDataFrame([(s, s) for s in words] + [("none", None)], "id string, sequence string")
    got = {r.id: r.cluster_id for r in cl.cluster_by_kmer(df, heavy=heavy, first=first).collect()}
    assert got.pop("none") is None and got == expected


@pytest.mark.parametrize("edges", [0, 1 << 22])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, edges):
    monkeypatch.setattr(cl, "MOST_EDGES", edges)
    words = families(80, 6)
    root = list(range(len(words)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(words):
        for j in range(i):
            if similar(a, words[j], 3, 0.7):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(s, s) for s in words], "id string, sequence string")
    got = {r.id: r.cluster_id for r in cl.cluster_by_kmer(df, tau=0.7, mode="components").collect()}
    assert got == {s: words[find(i)] for i, s in enumerate(words)}


def test_labels_of_random_graphs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (int(rng.integers(1, 60)), 2)).tolist() if p[0] != p[1]}
        if not pairs:
            continue
        u, v = (np.array(c) for c in zip(*sorted(pairs), strict=True))
        reps, labels = [], []
        for i in range(n):
            best = next((r for r in reps if (r, i) in pairs), i)
            reps += [i] if best == i else []
            labels.append(best)
        assert cl._greedy_labels(u, v, n).tolist() == labels
        lowest = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                lowest[a] = lowest[b] = min(lowest[a], lowest[b])
        assert cl._component_labels(u, v, n).tolist() == lowest


def test_one_large_group_is_cut_into_tiles(spark, monkeypatch):
    """A group with most rows, among small ones, a NULL group and rows without k-mers."""
    monkeypatch.setattr(tiles, "BLOCK", 150)
    words = families(60, 2)
    rows = [("hot", s) for s in words] + [(g, s) for g in ("a", "b", None) for s in words[:4]] + [("a", "Q"), ("a", "Q"), ("b", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g string, sequence string")

    def cosine(a, b):
        x, y = counted(a, 2), counted(b, 2)
        norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        return sum(n * y[c] for c, n in x.items()) / norm if norm else 0.0

    expected = {}
    for i, (g, s) in enumerate(rows):
        if s is None:
            continue
        best = max([cosine(s, t) for j, (h, t) in enumerate(rows) if i != j and g == h and t is not None], default=0.0)
        expected[i] = max(0.0, (best - 0.7) / 0.3)
    got = {r.id: r.penalty for r in si.diversity_penalty(df, "g", sim="dipeptide").collect()}
    assert got.pop(len(rows) - 1) is None and got == pytest.approx(expected, abs=1e-9)


def hamming(a, b):
    return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b), 1)


@pytest.mark.parametrize("size", [1 << 17, 60])
def test_hamming_penalties_in_tiles(spark, monkeypatch, size):
    """Many short sequences, one letter in common, in small groups and in one of many blocks."""
    monkeypatch.setattr(tiles, "BLOCK", size)
    rng = random.Random(4)
    rows = [(i, i % 5 and 1, "A" + "".join(rng.choices("ABC\x00é", k=rng.choice([0, 1, 2, 5, 6, 30])))) for i in range(150)]
    rows += [(900, 1, ""), (901, 1, ""), (902, 2, "x" * 500), (903, 2, "x" * 400 + "y" * 100), (904, None, "AB"), (905, None, "AB"), (906, 1, None)]
    df = spark.createDataFrame(rows, "id int, g int, sequence string")
    got = {r.id: r.penalty for r in si.diversity_penalty(df, "g").collect()}
    assert got.pop(906) is None
    for i, g, s in rows[:-1]:
        best = max((hamming(s, t) for j, h, t in rows[:-1] if j != i and h == g), default=0.0)
        assert got[i] == pytest.approx(max(0.0, (best - 0.7) / 0.3)), (i, s)
    plan = si.diversity_penalty(df, "g")._jdf.queryExecution().optimizedPlan().toString()
    # Pairs are formed inside tiles; no row is handed on for a block that two sequences share.
    assert "_sid" not in plan and "FlatMapGroupsInArrow" in plan


def test_reference_vectors_meet_in_tiles(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(120, 6)), np.zeros((1, 6))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "id int, embedding array<double>")
    known = df.filter("id % 3 = 0")
    want = {r.id: r.penalty for r in si.ad_penalty(df, known, threshold=0.6).collect()}
    near = si._ad_penalty_cells(df, known, "embedding", "id", 0.6, 4, 24)
    assert {r.id: r.penalty for r in near.collect()} == pytest.approx(want)
    # One number for each row and block, not a row for each pair.
    assert "FlatMapGroupsInArrow" in near._jdf.queryExecution().optimizedPlan().toString()


def test_pools_and_buckets_of_groups_are_not_broadcast(spark):
    rng = random.Random(6)
    rows = [(str(i), "A" * rng.randint(3, 40)) for i in range(300)]
    pool = spark.createDataFrame(rows, "id string, sequence string")
    target = spark.createDataFrame([("C" * rng.randint(3, 30),) for _ in range(900)], "sequence string")
    fragments = sa.fragment_fill(pool, target)
    fragments.collect()
    plan = fragments._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and ("ordinal" in line or "_bucket" in line)]
    assert joins and all("strategy=merge" in line for line in joins)


def test_blocks_are_written_once_not_shuffled_to_every_partner(spark):
    ensure_checkpoint_dir(spark)
    df = spark.range(300).select("id", F.concat(F.lit("ACDEFGHIKL"), F.translate(F.col("id").cast("string"), "0123456789", "ACDEFGHIKL")).alias("sequence"))
    sets = cl.kmer_sets(df, "id", "sequence", 3, 0.5, 1)
    placed, n = tiles.numbered_blocks(sets, ["n", "id"], "n", 200)
    folder = cl._stored(placed)
    kept = [t.column("id").to_pylist() for t in (tiles.read_block(folder, i) for i in range(n)) if t]
    assert n > 5 and sorted(i for ids in kept for i in ids) == list(range(300))
    met = {(r.i, b) for r in tiles.block_runs(spark, n, n, upper=True, run=4).collect() for b in range(r.j, r.stop)}
    assert met == {(i, j) for i in range(n) for j in range(i, n)}
    plan = cl.similar_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan

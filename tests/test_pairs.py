"""Similar pairs from postings, without a join of candidates."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pepspark.operators import clustering as cl
from pepspark.operators import tiles


def words(n, seed, letters="ACDE"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(letters, k=rng.choice([1, 3, 4, 9, 20]))) for _ in range(n)})


def kset(s, k):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def sets_of(texts, k, tau):
    """Stored rows in the order of their sizes, codes in one order."""
    codes = [sorted({sum(ord(c) * 128**i for i, c in enumerate(x)) for x in kset(s, k)}) for s in texts]
    rows = sorted((c for c in codes if c), key=len)
    need = [max(1, int(np.ceil(len(c) * tau - 1e-9))) for c in rows]
    return tiles.Sets(pa.table({"ordinal": range(len(rows)), "codes": pa.array(rows, pa.list_(pa.int64())), "n": [len(c) for c in rows], "need": need})), rows


@pytest.mark.parametrize("share, postings, tau", [(1, 1 << 18, 0.5), (2, 40, 0.7), (4, 1, 0.5), (9, 1 << 18, 0.9), (4, 100, 0.05), (3, 50, 1.5)])
def test_postings_find_every_pair(monkeypatch, share, postings, tau):
    monkeypatch.setattr(tiles, "SHARE", share)
    monkeypatch.setattr(tiles, "POSTINGS", postings)
    monkeypatch.setattr(tiles, "COMPARED", 7)
    sets, rows = sets_of(words(150, share), 3, tau)
    index = tiles.Postings(sets, int(sets.need.min()))
    got = [(a, b, n) for p in tiles.shared_codes(sets, index, lambda a, b: a < b) for a, b, n in zip(*(x.tolist() for x in p), strict=True)]
    expected = {(a, b, n) for a, x in enumerate(rows) for b, y in enumerate(rows) if a < b and (n := len({*x} & {*y})) >= sets.need[a]}
    assert len(got) == len(set(got)) and set(got) == expected


def test_pairs_meet_in_no_join_of_kmers(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(words(60, 1))], "id int, sequence string")
    plan = cl.similar_pairs(df, k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode(codes" not in plan


@pytest.mark.parametrize("k", [2, 9])
def test_rows_of_one_key_are_one_set(spark, k):
    """A key that repeats, a NULL sequence, one without a k-mer."""
    long = "ACDEFGHIKLMN"
    rows = [(1, long), (1, "WYWYWYWYWY"), (2, long + "P"), (3, None), (4, "A"), (5, "WYWYWYWYWYP")]
    df = spark.createDataFrame(rows, "id int, sequence string")
    sets = {i: set().union(*(kset(s, k) for j, s in rows if j == i and s)) for i in (1, 2, 5)}
    got = {(r.id_a, r.id_b): r.similarity for r in cl.similar_pairs(df, k=k, tau=0.3).collect()}
    expected = {}
    for a, b in ((x, y) for x in sets for y in sets if (len(sets[x]), x) < (len(sets[y]), y)):
        if (s := len(sets[a] & sets[b]) / len(sets[a])) >= 0.3:
            expected[a, b] = s
    assert got == pytest.approx(expected)


def test_crossing_pairs_carry_their_splits(spark):
    """Ids that occur twice, in one split or in two, without a split, or not at all in the splits."""
    texts = words(60, 3)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id int, sequence string")
    rows = [(i, i % 3 and f"s{i % 3}") for i in range(len(texts) - 5)] + [(i, f"s{i % 2}") for i in range(0, 20, 2)] + [(7, "s1"), (8, None)]
    splits = spark.createDataFrame([(i, s or None) for i, s in rows], "id int, split string")
    joined = cl.crossing_pairs(cl.similar_pairs(df, k=3), splits).first()
    carried = cl.crossing_pairs(cl.similar_pairs(cl.split_labels(df, splits), k=3, carry=["split"]))
    assert carried.first() == joined and joined.n_crossing > 0
    assert cl.crossing_pairs(cl.similar_pairs(cl.split_labels(df, splits.limit(0)), k=3, carry=["split"])).first() == (0, 0)


def test_pairs_are_not_joined_to_their_splits(spark):
    from pepspark.plans.catalog import QUERIES

    plan = QUERIES["p7_crossing_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_batches_of_the_greedy_rule_share_one_store(spark, monkeypatch):
    """Sets are written once however many batches there are, and the batches change nothing."""
    written = []
    stored = cl._stored
    monkeypatch.setattr(cl, "_stored", lambda placed: written.append(1) or stored(placed))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(words(120, 5))], "id int, sequence string")
    got = [sorted(map(tuple, cl.cluster_by_kmer(df, first=first).collect())) for first in (8, 1000)]
    assert got[0] == got[1] and len(written) == 2


@pytest.mark.parametrize("size, rounds, few", [(1 << 17, (1.0,), 1 << 20), (120, (0.0, 0.2, 0.6, 1.0), 0)])
def test_links_are_forests_that_connect_the_same_rows(spark, monkeypatch, size, rounds, few):
    monkeypatch.setattr(cl.numbered_blocks, "__defaults__", (size,))
    monkeypatch.setattr(cl, "ROUNDS", rounds)
    monkeypatch.setattr(cl, "FEW_BLOCKS", few)
    rng = random.Random(8)
    roots = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=30)) for _ in range(9)]
    texts = sorted({rng.choice(roots)[rng.randrange(18) :][: rng.randrange(5, 16)] for _ in range(150)} | {"YYYY", "A"})
    root = list(range(len(texts)))
    sets, pairs = [kset(t, 3) for t in texts], 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and len(x & y) >= 0.5 * min(len(x), len(y)):
                pairs += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, sequence string")
    got = {r.id: r.cluster_id for r in cl.cluster_by_kmer(df, mode="components").collect()}
    assert got == dict(enumerate(root)) and 5 < len(set(root)) < len(texts)
    links = cl._links(df.select("id"), cl.kmer_sets(df, "id", "sequence", 3, 0.5))
    assert links.count() < (pairs if few == 0 else len(texts)) and links.filter("id_a >= id_b").isEmpty()

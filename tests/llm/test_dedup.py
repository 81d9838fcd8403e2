"""Exact, near and passage dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from pepspark.llm import common, exact, jaccard, suffix
from pepspark.llm.common import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"
# Columns whose names the operators use themselves.
CLASH = "doc_id long, text string, node long, _row string, _id long, sha string, n_bytes long, `a.b` string"


def clashing(rows):
    return [(i, t, 1, "r", 2, "s", 3, "x") for i, t in rows]


@pytest.mark.parametrize("most", [1 << 20, 30, 0])
def test_components(spark, monkeypatch, most):
    """In one task, in rounds and then one task, in rounds alone."""
    monkeypatch.setattr(common, "MOST_EDGES", most)
    assert components(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(200, 260)] + [(7, 7), (300, 301), (301, 300)]
    got = collections.defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.root].add(r.node)
    assert sorted(map(min, got.values())) == [1, 100, 300] and sum(map(len, got.values())) == 60 + 61 + 2


def expect_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        best = min(m[:3] for m in members)
        keep = next(m[3] for m in members if m[:3] == best)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(members), (i == keep and less == best[0]), sha) for less, _, _, i in members]
    return out


def test_exact_membership(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a \tb"), (5, None), (6, ""), (7, " "), (None, "q"), (8, "q"), (None, "only"), (9, "é é"), (9, "é é"), (10, "x" * 200_000)]
    rows += [(100 + i, "hot  copy" if i % 2 else "hot copy") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = [tuple(r) for r in exact.membership(df).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(expect_exact(rows), key=key)
    assert exact.membership(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_has_several_rounds(spark):
    rows = [(i, f"t{i % 50}") for i in range(400)]
    made = exact.digests(spark.createDataFrame(rows, SCHEMA).repartition(9))
    runs = exact.tree_merge(made, fan_in=2, leaves=8).collect()
    assert sorted((r.keep_id, r.group_size) for r in runs) == [(i, 8) for i in range(50)]


def test_exact_kept_rows(spark):
    rows = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (9, "é é"), (9, "éé"), (9, "é é"), (None, "n"), (None, "n")]
    got = exact.kept_rows(spark.createDataFrame(clashing(rows), CLASH).repartition(4))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b"), (3, None), (9, "é é"), (None, "n")], key=str)
    assert got.columns == ["doc_id", "text", "node", "_row", "_id", "sha", "n_bytes", "a.b"]


def shingle_set(text, words):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def expect_components(rows, words, percent):
    sets = [shingle_set(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [(rows[i][0], len(sets[i]), smallest[find(i)]) for i in range(len(rows))]


def near_rows(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (4, 8, 15, 40, 40, 120, 120, 300):
        base = [random.choice(vocabulary) for _ in range(size)]
        for _ in range(random.choice([1, 3, 40])):
            text = list(base)
            for _ in range(random.randint(0, max(1, size // 25))):
                text[random.randrange(size)] = random.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A  b"), (n + 4, "a"), (n + 5, " "), (None, "a"), (n + 6, rows[0][1]), (0, rows[0][1])]


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 1_000_000), (5, 80, 2000)])
def test_jaccard(spark, words, percent, block):
    rows = near_rows(words)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.membership(df, words, percent, block=block).collect()]
    assert sorted(got, key=str) == sorted(expect_components(rows, words, percent), key=str)


def test_keys_meet(spark):
    """Every linked pair shares a key, at several thresholds."""
    random.seed(2)
    for percent in (60, 80, 90, 95):
        for _ in range(60):
            n = random.choice([2, 5, 10, 30, 200])
            a = random.sample(range(1 << 40), n)
            keep = random.randint(int(n * percent / 100), n)
            b = random.sample(a, keep) + random.sample(range(1 << 40, 1 << 41), random.randint(0, n - keep + 1))
            both = [np.unique(np.array(x, np.uint64)) for x in (a, b)]
            inter = len(set(a) & set(b))
            if 100 * inter < percent * (len(both[0]) + len(both[1]) - inter) or set(a) == set(b):
                continue
            rows = np.repeat([0, 1], [len(x) for x in both])
            owner, key = jaccard.partition_keys(rows, np.concatenate(both), 2, percent)
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


@pytest.mark.parametrize("often, most", [(1 << 20, 10), (3, 10), (3, 0)])
def test_neighbours_connect_the_nodes_of_each_key(spark, often, most):
    """No hot key; hot keys broadcast; hot keys shuffled: the same components of every key's nodes."""
    rng = random.Random(8)
    rows = [(n, rng.choice([k, k, 7, 1000 + n])) for n in range(60) for k in range(0, 20, 4)]
    pairs = jaccard.key_neighbours(spark.createDataFrame(rows, "node long, key long"), 1, often, most).collect()
    for key in {k for _, k in rows}:
        nodes = {n for n, k in rows if k == key}
        seen, todo = set(), {min(nodes)}
        while todo:
            n = todo.pop()
            seen.add(n)
            todo |= {x for a, b in pairs for x in ((a, b) if n in (a, b) else ()) if x not in seen and x in nodes}
        assert nodes <= seen
    linked = {frozenset((a, b)) for a, b in pairs}
    assert linked <= {frozenset((a, b)) for a, k in rows for b, m in rows if k == m and a != b}


def test_bounded_bitmaps_give_the_same_links(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i // 3).choices("abcdefgh", k=60))[: 110 + i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = sorted(tuple(r) for r in jaccard.membership(df, 3, 90).select("doc_id", "component_id").collect())

    def small(table):
        jaccard.BITMAPS, jaccard.GATHERED, jaccard.PAIRS = 1 << 7, 1 << 9, 5
        return jaccard_block(table, 90)

    jaccard_block = jaccard.join_block
    monkeypatch.setattr(jaccard, "join_block", lambda table, percent: small(table))
    assert plain == sorted(tuple(r) for r in jaccard.membership(df, 3, 90).select("doc_id", "component_id").collect())


def test_jaccard_kept_rows(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "other text of some words here"), (4, None), (5, ""), (None, " ".join(words[1:]))]
    got = jaccard.kept_rows(spark.createDataFrame(clashing(rows), CLASH))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5] and len(got.columns) == 8
    assert jaccard.membership(spark.createDataFrame([], SCHEMA)).count() == 0


def expect_cut(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [3, 20, 60])
def test_suffix(spark, length):
    random.seed(length)
    words = ["ab", "cde", "éß", "x", "qwerty", "zzz", "foo", "in", "to", "the"]
    text = lambda n: " ".join(random.choice(words) + str(random.randint(0, 99)) for _ in range(n))
    shared = [text(random.randint(3, 40)) for _ in range(8)]
    rows = []
    for i in range(120):
        t = text(random.randint(0, 30)) + random.choice(shared) + text(random.randint(0, 30)) + (random.choice(shared) if i % 2 else "")
        rows.append((i, t))
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(300, "ab " * 80), (301, None), (302, ""), (None, text(9)), (3, rows[3][1])]
    got = [tuple(r)[:5] for r in suffix.membership(spark.createDataFrame(rows, SCHEMA).repartition(5), length).collect()]
    assert sorted(got, key=str) == sorted(expect_cut(rows, length), key=str)


def test_suffix_levels(spark):
    index = suffix.LevelIndex()
    batches = [[1, 2, 3], [4, 5, 5], [3, 6], [1, 7], [8]]
    hits = [{r.f for r in index.add(spark.createDataFrame([(x,) for x in b], "f long")).collect()} for b in batches]
    assert hits == [set(), {5}, {3}, {1}, set()] and [size for size, _ in index.levels] == [4, 1]
    assert {r.f: r.n for r in index.levels[0][1].collect()} == {1: 2, 2: 1, 3: 2, 4: 1, 5: 2, 6: 1, 7: 1}


def test_suffix_cut_rows(spark):
    passage = "The same passage of more than twenty bytes. "
    rows = [(1, "Ours: " + passage + "end"), (2, "Theirs é: " + passage), (3, "clean"), (4, None), (5, "")]
    got = suffix.cut_rows(spark.createDataFrame(clashing(rows), CLASH), 20)
    assert {r.doc_id: r.text for r in got.collect()} == {1: "Oursend", 2: "Theirs é", 3: "clean", 4: None, 5: ""}
    assert len(got.columns) == 8
    empty = suffix.membership(spark.createDataFrame([], SCHEMA), 20)
    assert empty.count() == 0


def test_linked_sets_share_the_keys_they_need():
    random.seed(6)
    for percent in (60, 80, 90, 95):
        for _ in range(60):
            n = random.choice([2, 5, 10, 30, 200, 700])
            a = random.sample(range(1 << 40), n)
            keep = random.randint(int(n * percent / 100), n)
            b = random.sample(a, keep) + random.sample(range(1 << 40, 1 << 41), random.randint(0, n - keep + 1))
            both = [np.unique(np.array(x, np.uint64)) for x in (a, b)]
            inter = len(set(a) & set(b))
            if 100 * inter < percent * (len(both[0]) + len(both[1]) - inter) or set(a) == set(b):
                continue
            rows = np.repeat([0, 1], [len(x) for x in both])
            owner, key, need = jaccard._partition(rows, np.concatenate(both), 2, percent)
            shared = set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())
            assert any(len([k for k in shared if k % 2 == side]) >= need[:, side].max() >= 1 for side in (0, 1))


@pytest.mark.parametrize("crowd, often", [(2, 1 << 20), (6, 1 << 20), (6, 20), (3, 2)])
def test_near_groups_with_crowded_keys(spark, monkeypatch, crowd, often):
    """Links survive however many nodes a key may pair: clusters below, at and beyond it."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    defaults = jaccard.near_neighbours.__defaults__
    monkeypatch.setattr(jaccard.near_neighbours, "__defaults__", (1, often, defaults[2]))
    rows = near_rows(9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.membership(df, 3, 80).collect()]
    assert sorted(got, key=str) == sorted(expect_components(rows, 3, 80), key=str)


def test_texts_that_share_a_passage_form_no_group(spark, monkeypatch):
    rng = random.Random(4)
    said = [f"s{i}" for i in range(30)]
    rows = [(i, " ".join([*said, *(f"d{i}x{rng.random()}" for _ in range(150))])) for i in range(300)]
    seen = []
    monkeypatch.setattr(jaccard, "components", lambda edges: (seen.append(edges.count()), components(edges))[1])
    found = jaccard.membership(spark.createDataFrame(rows, SCHEMA), 5, 80)
    assert found.filter("doc_id <> component_id").count() == 0
    assert seen[0] == 0

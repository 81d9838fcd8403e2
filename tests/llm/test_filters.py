"""Filter interactions against a direct simulation of all orders."""

import collections
import random
from itertools import permutations

import pytest

from pepspark.llm import filters

DOCS = "doc_id long, text string, source string, mask string, part string, n long, digest string, `a.b` string"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(rows):
    """Failed letters of each (doc_id, text, source) row, by the definitions."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, s in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in t).split(" ") if w]
        out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        out += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        yield i, s or "", out + "E" * (i is not None and i > least[t])


def simulate(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    parts = collections.defaultdict(list)
    for i, part, failed in fails(rows):
        parts[part].append((failed, i in good, i in toxic))
    out = []
    for part, members in parts.items():
        cells, shapley = {}, collections.Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = members, []
            for step, f in enumerate(order, 1):
                now = [m for m in left if f in m[0]]
                before = sum(f in m[0] for m in gone)
                left, gone = [m for m in left if f not in m[0]], gone + now
                shapley[f] += len(now)
                cells[order, step] = (len(left), len(now), before, sum(m[0] == f for m in members), sum(m[1] for m in now), sum(m[2] for m in now))
        out += [(part, order, step, *cell, shapley[order[step - 1]]) for (order, step), cell in cells.items()]
    return sorted(out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "m", "p", 1, "d", "x") for i, t, s in rows], DOCS).repartition(5)
    got = filters.audit(docs, spark.createDataFrame([(*row, "p") for row in labels], LABELS))
    return sorted(tuple(r) for r in got.drop("filter").collect())


def test_audit_equals_simulation(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "GAMMA", "d#", "é x", "Z", "tail|"] + [f"w{i}" for i in range(80)]
    texts = [None, "", " \n", "\x0b", "x" * 300_000, "one word", "A" * 20]
    texts += [rng.choice([" ", "\n", "\r\n\t"]).join(rng.choices(words, k=rng.choice([3, 49, 50, 51, 90, 200]))) for _ in range(60)]
    texts += [" ".join(f"u{i}" for i in range(n)) for n in (49, 50, 64, 65, 100)] + [" ".join(f"u{i % 65}" for i in range(100)), " ".join(f"u{i % 64}" for i in range(100))]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "hot", "hot", "s"])) for _ in range(300)]
    rows += [(1000 + i, "copied text of the hot group", "hot") for i in range(200)] + [(1000, "copied text of the hot group", "hot")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(40), *range(20), 1000, 1003]] + [(None, 1, 1)]
    assert audited(spark, rows, labels) == simulate(rows, labels)


def test_audit_of_few_rows(spark):
    assert audited(spark, [], []) == []
    assert audited(spark, [(None, None, None)], []) == simulate([(None, None, None)], [])
    assert len(audited(spark, [(1, "a", "x")], [(1, 1, 1)])) == 600


def test_intervals_of_every_mask():
    for n in (1, 2, 3, 4):
        covered = collections.Counter()
        for mask, step, start, stop in filters.removal_intervals(n):
            for rank in range(start, stop):
                covered[mask, step, rank] += 1
        expected = collections.Counter()
        for rank, order in enumerate(permutations(range(n))):
            for mask in range(1, 1 << n):
                expected[mask, next(s for s, f in enumerate(order, 1) if mask >> f & 1), rank] += 1
        assert covered == expected


def test_orders_are_bounded(spark):
    masks = spark.createDataFrame([("p", 1, 2, 1, 0)], "part string, mask int, n long, good long, toxic long")
    assert filters.interactions(masks, "A").collect()[0].removed == 2
    with pytest.raises(ValueError):
        filters.interactions(masks, "ABCDEFG")

"""First ids of frequent sequences, whatever their order column holds."""

import random

import pytest

from pepspark.operators import curation as cu

FLAGS = "had_lowercase boolean, has_nonstandard_char boolean"


def rows(kind, seed=3):
    """Frequent sequences whose records lie at the start, at the end or all over; ids and orders that are NULL or come twice."""
    rng, out = random.Random(seed), []
    for i in range(900):
        at = rng.choice([None, *range(60)]) if i % 9 == 0 else i
        s = "late" if i > 700 else "early" if i < 150 and i % 2 else rng.choice(["all", "all", "all", None, f"rare{i % 40}"])
        out.append((s, f"db{i % 3}" if i % 11 else None, f"{i % 50:03d}" if i % 7 else None, at if kind == "long" or at is None else f"{at:04d}", i % 4, i % 13 == 0, i % 17 == 0))
    return out


@pytest.mark.parametrize("kind, per_part, spread", [("long", 5, None), ("long", 20, "some"), ("long", 5, "empty"), ("string", 5, None)])
def test_first_ids_of_frequent_sequences(spark, kind, per_part, spread):
    data = rows(kind)
    df = spark.createDataFrame(data, f"sequence string, source_db string, source_id string, a {kind}, b int, {FLAGS}").repartition(5)
    other = {"some": df.filter("a % 7 = 1").select("a"), "empty": df.limit(0).select("a")}.get(spread) if spread else None
    got = {r.sequence: r for r in cu.dedup_with_provenance(df, ["a", "b"], per_part, other).collect()}
    plain = {r.sequence: r for r in cu.dedup_with_provenance(df).collect()}
    key = lambda v: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in v)
    assert set(got) == {r[0] for r in data}
    for s, r in got.items():
        ids = [x[2] for x in sorted(((x[3], x[4], x[2]) for x in data if x[0] == s), key=key)]
        assert r.source_ids == ids[:per_part] and r.n_id_parts == -(-len(ids) // per_part)
        assert r[:8] == plain[s][:8]


def test_late_records_of_frequent_sequences_are_not_shuffled(spark):
    df = spark.range(20_000).selectExpr("if(id % 50 = 0, concat('r', id), 'hot') as sequence", "'db' as source_db", "cast(id as string) as source_id", "id as a", "false as had_lowercase", "false as has_nonstandard_char")
    first = cu.dedup_with_provenance(df, ["a"], 10)
    assert first.filter("sequence = 'hot'").first().source_ids == [str(i) for i in range(1, 11)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "_last" in plan and "BroadcastHashJoin" in plan

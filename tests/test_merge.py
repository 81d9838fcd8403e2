"""Merged rows are the same whether or not beaten rows go before the aggregate."""

import random

import pytest

from pepspark.operators import curation as cu

FIELDS = "sequence string, origin string, place long, turn int, flag boolean"


def rows(spark, n, seed):
    r = random.Random(seed)
    pick = lambda values: r.choice([None, *values])
    made = [(pick("ABCD"), pick("xyz"), pick([-(2**63), -1, 0, 1, 2**63 - 1]), pick(range(3)), pick([True, False])) for _ in range(n)]
    return spark.createDataFrame(made, FIELDS)


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
@pytest.mark.parametrize("order", [["place"], ["flag", "turn", "place"], ["place", "origin"], ["origin", "place"]])
def test_beaten_rows_change_nothing(spark, monkeypatch, order, most):
    monkeypatch.setattr(cu, "RUN_ROWS", most)
    old, new = rows(spark, 15, 1).filter("sequence <> 'D'"), rows(spark, 300, 2)
    merged = {tuple(r) for r in cu.merge_into(old, new, order=order).collect()}
    wanted = {}
    low = lambda v: (v is not None, v if v is not None else 0)
    names = ["sequence", "origin", "place", "turn", "flag"]
    for is_new, table in ((False, old), (True, new)):
        for row in table.collect():
            rest = [c for c in names if c not in ("sequence", *order)]
            text = lambda c: low(row[c]) if c != "origin" else (row[c] is not None, row[c] or "")  # noqa: E731, B023
            place = (is_new, *[text(c) for c in (*order, *rest)])
            if row.sequence not in wanted or place < wanted[row.sequence][0]:
                wanted[row.sequence] = (place, (*row, is_new))
    assert merged == {w for _, w in wanted.values()}


def test_copies_are_gone_before_the_sort(spark):
    new = spark.range(50_000, numPartitions=1).selectExpr("concat('k', id % 10) as sequence", "id as place", "cast(id as string) as origin")
    left = cu.unbeaten(new.withColumn("is_new", cu.F.lit(True)), "sequence", ["is_new", "place"])
    assert left.count() == 10


def test_payload_query_drops_beaten_rows_in_batches(spark):
    from pepspark.plans.catalog import QUERIES

    assert QUERIES["u3_merge_payload"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2

"""Many parts in one scan, and merges that keep all columns."""

import pytest

from pepspark.operators import curation as cu
from pepspark.sources import tabular


def write(path, text):
    path.write_text(text)
    return str(path)


def test_parts_under_their_own_headers(spark, tmp_path):
    write(tmp_path / "a.csv", 'id,sequence,note\n1,AAA,"x, y"\n2,"C""C",\n3,AAA,z\n')
    write(tmp_path / "b.csv", "\ufeffsequence,id\nGGG,9\nAAA,8\n")
    write(tmp_path / "c.csv", "sequence\n")
    write(tmp_path / "d.csv", '"n","sequence"\n1,TTT\n"n","sequence"\n2,\n')
    got = {r.sequence for r in tabular.merge_parts(spark, str(tmp_path / "*.csv"), "sequence").collect()}
    assert got == {"AAA", "GGG", "TTT", 'C"C', None}
    write(tmp_path / "e.csv", "other\n1\n")
    with pytest.raises(ValueError, match="e.csv"):
        tabular.merge_parts(spark, str(tmp_path / "*.csv"), "sequence")


def test_parts_cut_into_splits(spark, tmp_path):
    """A file of several splits has one header; many small files share tasks."""
    big = [f"S{i}" for i in range(3000)]
    write(tmp_path / "big.csv", "n,sequence\n" + "".join(f"{i},{s}\n" for i, s in enumerate(big)))
    for i in range(60):
        write(tmp_path / f"small{i}.csv", f"sequence,n\nT{i},{i}\n" if i % 2 else f"a,b,sequence\n,,T{i}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {r.sequence for r in tabular.merge_parts(spark, str(tmp_path / "*.csv"), "sequence").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {*big, *(f"T{i}" for i in range(60))}


def test_merge_keeps_the_first_row_whole(spark):
    known = spark.createDataFrame([("A", 5, "k2"), ("A", 1, "k1"), (None, 2, "k3")], "sequence string, n int, origin string")
    new = spark.createDataFrame([("A", 0, 1.5), ("B", 7, 2.5), ("B", 6, None), (None, 0, 1.0)], "sequence string, n int, score double")
    got = sorted((tuple(r) for r in cu.merge_into(known, new, order=["n"]).select("sequence", "n", "origin", "score", "is_new").collect()), key=str)
    assert got == [("A", 1, "k1", None, False), ("B", 6, None, None, True), (None, 2, "k3", None, False)]
    assert cu.merge_into(known.limit(0), new.limit(0)).count() == 0

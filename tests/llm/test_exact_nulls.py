"""Repeated rows without a text keep their other columns."""

from pepspark.llm import exact


def test_kept_row_of_null_texts(spark):
    rows = [(9, None, "de", "s"), (9, None, "de", "s"), (12, None, "en", "t"), (10, "a b", "fr", "u"), (10, "ab", "fr", "u"), (10, "a b", "fr", "u")]
    got = exact.kept_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == [(10, "a b", "fr", "u"), (9, None, "de", "s")]

"""The registered choice of k tries what the reference tries."""

from pepspark.plans import catalog, similarity_queries


def test_p8_tries_all(spark, monkeypatch):
    seen = []
    table = spark.range(1)
    monkeypatch.setattr(similarity_queries, "vectors", lambda spark, path: None)
    monkeypatch.setattr(similarity_queries.cl, "select_k", lambda df, ks, **more: seen.append((list(ks), more)) or (None, table, None))
    assert catalog.QUERIES["p8_select_k"](spark, "").count() == 1
    assert seen == [([5, 8, 10, 15, 20], {"restarts": 10})]

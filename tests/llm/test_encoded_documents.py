"""The op9 query encodes whole documents."""

import pytest

from pepspark.llm import queries


def test_op9_reads_documents(spark):
    pytest.importorskip("sentencepiece")
    from sentencepiece import SentencePieceProcessor

    path = "/root/testdata/sf0.001"
    got = queries.QUERIES["op9_sentencepiece"](spark, path).collect()
    texts = {}
    for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    assert len(got) == sum(map(len, texts.values()))
    model = SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    for r in got:
        assert r.round_trip and r.ids in [model.encode(t) for t in texts[r.doc_id]]

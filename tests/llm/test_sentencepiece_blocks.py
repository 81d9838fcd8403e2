"""SentencePiece: what is written, blocks of rows, and the order of merges."""

import glob
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pepspark.llm import common, sentencepiece
from pepspark.llm.queries import vocabulary


def test_occurrences_are_not_written(spark, tmp_path, monkeypatch):
    spm = pytest.importorskip("sentencepiece")
    path = vocabulary("piece_bpe_32k.model")
    model, pieces = spm.SentencePieceProcessor(model_file=path), sentencepiece.piece_table(spark, path)
    text = "the cat, sat " * 5_000
    monkeypatch.setattr(common, "scratch", lambda _: f"file://{tmp_path}")
    got = sentencepiece.encode(spark.createDataFrame([(k, text) for k in range(4)], "row long, text string"), pieces, "row").collect()
    assert [list(r.ids) for r in got] == [model.encode(text)] * 4
    written = glob.glob(f"{tmp_path}/**/*.parquet", recursive=True)
    assert written and sum(pq.ParquetFile(f).metadata.num_rows for f in written) < 100


def test_rows_of_many_blocks(spark, tmp_path):
    spm = pytest.importorskip("sentencepiece")
    path = vocabulary("piece_bpe_32k.model")
    model, pieces = spm.SentencePieceProcessor(model_file=path), sentencepiece.piece_table(spark, path)
    texts = [None if k % 7 == 0 else "" if k % 7 == 1 else f"word{k} of\n{k % 100}, ▁x  " for k in range(20_000)]
    # Two rows a key, in one file that is cut into several blocks and, last, a text that is not UTF-8.
    pq.write_table(pa.table({"row": pa.array([k // 2 for k in range(20_000)]), "text": texts}), str(tmp_path / "a.parquet"), row_group_size=3_000)
    spark.sql("select 10000L as row, cast(X'61FF62' as string) as text").write.mode("append").parquet(str(tmp_path))
    got = sentencepiece.encode(spark.read.parquet(str(tmp_path)), pieces, "row", stored=True).select("row", "ids").collect()
    expected = [(k // 2, model.encode(t or "")) for k, t in enumerate(texts)] + [(10_000, model.encode("a�b"))]
    assert sorted((r.row, list(r.ids)) for r in got) == sorted(expected)


def test_merges_out_of_the_order_of_scores(spark):
    random.seed(5)
    names = sorted({"".join(random.choices("abc", k=random.randint(2, 5))) for _ in range(60)})
    # Few scores, dealt by chance: pieces often score better than those they are made of, and many are equal.
    scores = {p: -float(random.randint(1, 25)) for p in names} | {c: -50.0 for c in "ab"}
    table = [(k, p, s, None) for k, (p, s) in enumerate(scores.items())] + [(1000 + k, None, None, k) for k in range(256)]
    pieces = spark.createDataFrame(table, "id int, piece string, score double, byte int")

    def merged(word):
        parts = list(word)
        while ways := [(-scores[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in scores]:
            _, i = min(ways)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    ids = {p: k for k, p, _, _ in table if p}
    words = sorted({"".join(random.choices("aabbc", k=random.randint(1, 60))) for _ in range(400)})
    got = sentencepiece.encode_words(spark.createDataFrame([(w, len(w)) for w in words], "word string, n int"), pieces).collect()
    assert sorted(r.word for r in got) == words and all(r.n == len(r.word) for r in got)
    for r in got:
        assert list(r.ids) == [ids.get(p, 1000 + ord(p[0])) for p in merged(r.word)]


def test_cutter_keeps_pairs_and_bytes():
    cutter = sentencepiece.Cutter("▁tthhe")
    words, rows = cutter.words(pa.array(["the▁ the,é", None, "", "x"]))
    assert words.to_pylist() == [" the", "▁", " the", ",", "é", " ", "x"] and list(rows) == [0, 5, 5, 5, 7]
    words, _ = sentencepiece.Cutter("▁▁").words(pa.array(["▁ ▁  ▁▁"]))
    assert words.to_pylist() == [" ▁ ▁  ▁▁"]
    points = np.frombuffer(("the" * 50).encode("utf-32-le"), np.uint32)
    assert np.array_equal(cutter._apart(points, 7), cutter._apart(points)) and cutter._apart(points).sum() == 49
    words, rows = cutter.words(pa.array([None, "", "h"]).slice(1, 1))
    assert len(words) == 0 and np.array_equal(rows, [0, 0])

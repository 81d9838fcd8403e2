"""Texts cut in NumPy give what regular expressions over every piece give."""

import re

import numpy as np
import pytest

from pepspark.plans import views

ODD = [
    "", " ", "\n \n", "a", " a", "a ", "a -- b", "--", "AbC. dE!? f\n\ng.", ".a", "Ünïcødé wörds — 日本. 語x", "x" * 50 + " " * 9 + "y", None,
    "tab\there", "B1Z JOU. XOX", "a\x00b c", "?!.\n", "end\n",
]


def expected(text, ends, removed):
    return [re.sub(removed, "", p) for p in re.split(ends, text)]


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
@pytest.mark.parametrize(
    "ends, kept, pattern, removed",
    [(views.WORD_ENDS, views.LETTERS, views.WORD, "[^A-Za-z]+"), (views.SENTENCE_ENDS, views.RESIDUES, views.SENTENCE, views.NO_RESIDUE)],
)
def test_pieces_equal_regular_expressions(spark, monkeypatch, most, ends, kept, pattern, removed):
    monkeypatch.setattr(views, "CUT", most)
    docs = spark.createDataFrame([(i, t, f"k{i}") for i, t in enumerate(ODD)], "doc_id long, text string, lang string").coalesce(1)
    made = sorted(views.pieces(docs, ends, kept).collect())
    wanted = [(i, f"k{i}", k, p) for i, t in enumerate(ODD) if t is not None for k, p in enumerate(expected(t, pattern, removed))]
    assert [tuple(r) for r in made] == wanted


def test_pieces_of_no_texts():
    row, pos, offsets, left = views.cut(np.zeros(0, np.uint8), np.zeros(1, np.int64), views.WORD_ENDS, views.LETTERS)
    assert len(row) == len(pos) == len(left) == 0 and offsets.tolist() == [0]

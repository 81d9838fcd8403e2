"""Passages counted in words, beside those counted in bytes, against brute force."""

import collections
import random

import numpy as np
import pytest
from test_dedup import SCHEMA, WORD, expect_cut

import corpus_pipeline
from pepspark.llm import suffix


def expect_text(rows, length, words):
    data = [(t or "").encode() for _, t in rows]
    spots = [[m.span() for m in WORD.finditer(b.decode("latin-1"))] for b in data]
    seen = collections.Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    said = [[b[x:y] for x, y in s] for b, s in zip(data, spots, strict=True)]
    runs = collections.Counter(tuple(w[k : k + words]) for w in said for k in range(len(w) - words + 1))
    out = []
    for (i, t), b, s, w in zip(rows, data, spots, said, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        for k in range(len(w) - words + 1):
            if runs[tuple(w[k : k + words])] > 1:
                gone[s[k][0] : s[k + words - 1][1]] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append((i, t if t is None else kept, int(gone.sum())))
    return out


def passages(words):
    random.seed(words)
    vocabulary = ["ab", "cde", "éß", "x", "qwerty", "zzz", "foo", "in", "to", "the"]
    text = lambda n: random.choice([" ", "  ", "\n"]).join(random.choice(vocabulary) + str(random.randint(0, 99)) for _ in range(n))
    shared = [text(random.randint(2, 30)) for _ in range(8)]
    rows = [(i, text(random.randint(0, 20)) + " " + random.choice(shared).replace("  ", random.choice([" ", "\t"])) + " " + text(random.randint(0, 20))) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(300 + i, " a b c d e f g h i j ") for i in range(2)] + [(400, "x " * 60), (401, None), (402, ""), (None, text(9))]
    return rows


@pytest.mark.parametrize(("length", "words"), [(400, 5), (30, 9), (12, 2)])
def test_word_passages(spark, length, words):
    rows = passages(words)
    got = suffix.cut_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), length, words=words)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r[:2] for r in expect_text(rows, length, words)), key=str)


@pytest.mark.parametrize(("length", "words"), [(60, 5), (30, 9)])
def test_word_passages_beside_bytes(spark, length, words):
    """What words remove has a column of its own; all others are about bytes."""
    rows = passages(words)
    got = [tuple(r) for r in suffix.membership(spark.createDataFrame(rows, SCHEMA).repartition(5), length, words=words).drop("spans").collect()]
    both = [(*a, b[2]) for a, b in zip(expect_cut(rows, length), expect_text(rows, length, words), strict=True)]
    assert sorted(got, key=str) == sorted(both, key=str) and any(r[2] < r[5] for r in got)


def test_single_word_passages_are_no_byte_passages(spark):
    """Runs of short words that end inside a block count for the words' column alone."""
    random.seed(8)
    text = lambda n: " ".join(f"{random.choice('abcdef')}{random.randint(0, 99)}" for _ in range(n))
    shared = [text(n) for n in (51, 53, 60, 70)]
    rows = [(i, f"{text(i % 30)} x{i} {shared[i % 4]} y{i} {text(30 - i % 30)}") for i in range(40)]
    got = [tuple(r) for r in suffix.membership(spark.createDataFrame(rows, SCHEMA).repartition(3), 400, words=51).drop("spans").collect()]
    both = [(*a, b[2]) for a, b in zip(expect_cut(rows, 400), expect_text(rows, 400, 51), strict=True)]
    assert sorted(got, key=str) == sorted(both, key=str) and all(r[2] == 0 < r[5] for r in got)


def test_stage_cuts_51_short_words(spark, tmp_path):
    random.seed(5)
    word = lambda k: f"{random.choice('abcdef')}{random.choice('ghijk')}{k % 10}"
    text = lambda n: " ".join(word(random.randint(0, 9)) for _ in range(n))
    passage, shorter = text(51), text(50)
    assert len(passage) < 400
    rows = [(i, f"{text(30)} x{i} {passage if i % 2 else shorter} y{i} {text(30)}") for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()}
    want = {i: t.replace(passage, "") for i, t in rows}
    assert got == {i: (t, len(t)) for i, t in want.items()} and want[1] != rows[1][1]


def _blocks_of_every_start(data, bounds, size):
    """Runs of starts with one suffix, from the suffix of every start."""
    hashes = suffix.PrefixHash(data)
    start, at = suffix.sampled(hashes, bounds, size)
    cut = [k for k in range(len(start)) if k == 0 or at[k] != at[k - 1] or start[k] != start[k - 1] + 1]
    return [(int(start[k]), n - k, int(at[k])) for k, n in zip(cut, [*cut[1:], len(start)], strict=True)]


@pytest.mark.parametrize("size", [2, 5, 16, 51, 400])
@pytest.mark.parametrize("letters", [1, 2, 200])
def test_blocks_equal_those_of_every_start(size, letters):
    random = np.random.default_rng(size)
    lengths = random.integers(0, 3 * size, 40)
    data = np.concatenate([random.integers(0, letters, lengths.sum(), dtype=np.uint8), np.zeros(2000, np.uint8), random.integers(0, 250, 3000, dtype=np.uint8)])
    bounds = np.concatenate([[0], np.cumsum(lengths), [len(data)]])
    found = [tuple(map(int, x)) for x in zip(*suffix.sampled_blocks(suffix.PrefixHash(data), bounds, size), strict=True)]
    assert found == _blocks_of_every_start(data, bounds, size)


def test_most_places_are_never_compared(monkeypatch):
    """Only hashes below a limit take part; the dense way is for texts whose hashes all are."""
    data = np.random.default_rng(3).integers(0, 250, 1 << 17, dtype=np.uint8)
    seen = []
    monkeypatch.setattr(suffix, "_nearest", lambda at, *rest, real=suffix._nearest: (seen.append(len(at)), real(at, *rest))[1])
    suffix.sampled_blocks(suffix.PrefixHash(data), np.array([0, len(data)]), 400)
    assert max(seen) < len(data) // 8

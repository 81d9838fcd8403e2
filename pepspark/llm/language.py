"""Language identification: binary n-gram classifiers predict the bits of error-correcting codewords."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, materialize, mix, runs, source_columns, texts

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint32)
        for point in range(0x110000):
            one = chr(point)
            if one.isalpha():
                lower = one.lower()
                table[point] = ord(lower) if len(lower) == 1 else point
        _TABLE.append(table)
    return _TABLE[0]


def grams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, bucket, row, letters of each row) of all n-grams, some texts at a time.

    N-grams are of letters inside a word with one space on either side.  A text of any
    length is read whole.
    """
    table = letter_table()
    for lo, hi in runs(bounds, 1 << 19):
        raw = data[bounds[lo] : bounds[hi]].tobytes()
        cuts = bounds[lo : hi + 1] - bounds[lo]
        # A space after each text keeps n-grams from reaching into the next.
        joined = " ".join(raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) + " "
        points = table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        sizes = np.array([len(raw[a:b].decode("utf-8", "replace")) + 1 for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], np.int64)
        row = np.repeat(np.arange(hi - lo), sizes)
        letter = points > 0
        buckets, rows = [], []
        for order in ORDERS:
            if len(points) < order:
                continue
            code = np.full(len(points) - order + 1, order, np.uint64)
            inner = np.zeros(len(code), bool)
            for k in range(order):
                code = code * np.uint64(0x110000) + points[k : k + len(code)]
                inner |= letter[k : k + len(code)]
            # Only the outer characters may be spaces, so that words are read one by one.
            for k in range(1, order - 1):
                inner &= letter[k : k + len(code)]
            if order == 2:
                inner &= letter[: len(code)] | letter[1 : 1 + len(code)]
            buckets.append((mix(code[inner]) % np.uint64(BUCKETS)).astype(np.int64))
            rows.append(row[: len(code)][inner])
        yield lo, hi, np.concatenate(buckets), np.concatenate(rows), np.bincount(row[letter], minlength=hi - lo)


def codewords(count: int) -> np.ndarray:
    """A row of -1/+1 bits for each class; any two differ in as many bits as can be.

    Up to seven classes get the exhaustive code (every split of the classes into two
    sides is a bit: 2 ** (count - 1) - 1 of them), more get rows of a Hadamard matrix
    without its constant column.
    """
    if count <= 1:
        return np.ones((count, 1), np.int8)
    if count <= 7:
        splits = np.arange(1, 1 << (count - 1))
        return np.array([[1 if c == count - 1 or not (s >> c) & 1 else -1 for s in splits] for c in range(count)], np.int8)
    matrix = np.ones((1, 1), np.int8)
    while len(matrix) < count + 1:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[:count, 1:]


@dataclass
class Model:
    """Languages, their codewords, a column of n-gram weights for each bit, and the bits' loss weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    gain: float = 1.0


def _counts(sample: DataFrame, languages: list[str]) -> np.ndarray:
    """N-gram counts of each language, (language, bucket); each text counts with weight 1."""
    place = {name: i for i, name in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), BUCKETS))
        for batch in batches:
            data, bounds = texts(batch.column(0))
            which = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, _, bucket, row, _ in grams(data, bounds):
                size = np.maximum(np.bincount(row, minlength=1), 1)
                np.add.at(total, (which[lo + row], bucket), 1.0 / np.sqrt(size[row]))
        filled = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled[0]), pa.array(filled[1]), pa.array(total[filled])], ["language", "bucket", "n"])

    rows = sample.select("text", "lang").mapInArrow(work, "language long, bucket long, n double").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    got = np.zeros((len(languages), BUCKETS))
    for r in rows.collect():  # languages x BUCKETS cells at most
        got[r.language, r.bucket] = r.n
    return got


def fit(docs: DataFrame, most: int = 2_000) -> Model:
    """Learn from (doc_id, text, lang) rows with a language; at most ``most`` rows of each, in hash order.

    For each bit a linear classifier over hashed n-grams of one to three letters gets
    the log-odds of the n-gram in the languages on one side against the other, each
    language with equal weight.  A bit's loss weight is how well it separates the
    sample's texts.  Without rows there is no language, and every prediction is ``und``.
    """
    rows = source_columns(docs, doc_id=F.col("doc_id").cast("long"), text="text", lang="lang").filter("lang is not null and text is not null and doc_id is not null")
    chosen = bounded_sample(rows.select("doc_id", "lang"), "lang", "doc_id", most)
    ids = F.broadcast(chosen.select(F.col("doc_id").alias("_id")).distinct())  # at most ``most`` for each language
    sample = materialize(rows.join(ids, rows.doc_id == F.col("_id"), "left_semi").dropDuplicates(["doc_id", "lang"]), "language_sample")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    counts = _counts(sample, languages) + 1e-9
    share = counts / counts.sum(1, keepdims=True)
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        if len(languages) > 1:
            plus, minus = share[code[:, bit] > 0].mean(0), share[code[:, bit] < 0].mean(0)
            weights[:, bit] = np.log((plus + 1e-6) / (minus + 1e-6))
    model = Model(languages, code, weights, np.ones(code.shape[1]))
    margins = sample.select("doc_id", "text", "lang").mapInArrow(lambda b: _margins(b, model), "lang string, margins array<float>")
    sides = {name: code[i] for i, name in enumerate(languages)}
    parts = margins.select("lang", F.posexplode("margins").alias("bit", "m")).groupBy("lang", "bit").agg(F.avg("m").alias("m"), F.avg(F.signum("m")).alias("s")).collect()
    right: dict[int, list[float]] = {}
    sizes: list[float] = []
    for r in parts:
        right.setdefault(r.bit, []).append((1 + r.s * float(sides[r.lang][r.bit])) / 2)
        sizes.append(abs(r.m))
    model.trust = np.array([max(0.05, 2 * float(np.mean(right[b])) - 1) if b in right else 0.05 for b in range(code.shape[1])])
    discard(sample)
    model.gain = 3.0 / max(float(np.mean(sizes)), 1e-6) if sizes else 1.0
    return model


def _of(data: np.ndarray, bounds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(mean weight of each bit, number of letters) of every text."""
    n = len(bounds) - 1
    out, letters = np.zeros((n, model.weights.shape[1]), np.float32), np.zeros(n, np.int64)
    for lo, hi, bucket, row, seen in grams(data, bounds):
        letters[lo:hi] = seen
        if len(row):
            size = np.maximum(np.bincount(row, minlength=hi - lo), 1)
            for bit in range(model.weights.shape[1]):
                out[lo:hi, bit] = np.bincount(row, model.weights[bucket, bit], hi - lo) / size
    return out, letters


def _margins(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        margin, _ = _of(*texts(batch.column(1)), model)
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(margin.tolist(), pa.list_(pa.float32()))], ["lang", "margins"])


def predict(docs: DataFrame, model: Model, ambiguous: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: doc_id, lang_pred, score, second, ambiguous, bit_errors.

    The margins of all bits are compared with each codeword by loss-weighted decoding
    (logistic loss, weighted by each bit's trust); the nearest codeword wins and the
    score is the softmax over negative distances.  ``ambiguous`` is true below that
    score, ``bit_errors`` counts bits that disagree with the winner.  ``und``, score 0
    and ambiguous for a null text or one without letters.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = model.code.astype(np.float64)
        for batch in batches:
            margin, letters = _of(*texts(batch.column(1)), model)
            names: list[str | None] = ["und"] * len(margin)
            second: list[str | None] = [None] * len(margin)
            score, errors = np.zeros(len(margin)), np.zeros(len(margin), np.int64)
            if model.languages and len(margin):
                loss = np.logaddexp(0, -code[None] * margin[:, None, :].astype(np.float64) * model.gain)
                distance = (loss * model.trust).sum(2)
                near = np.exp(-(distance - distance.min(1, keepdims=True)))
                near /= near.sum(1, keepdims=True)
                order = np.argsort(distance, 1, kind="stable")
                for i in np.nonzero(letters)[0].tolist():
                    names[i] = model.languages[order[i, 0]]
                    second[i] = model.languages[order[i, 1]] if len(model.languages) > 1 else None
                    score[i] = near[i, order[i, 0]]
                    errors[i] = int((np.sign(margin[i]) * code[order[i, 0]] < 0).sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array(score), pa.array(second, pa.string()), pa.array(score < ambiguous), pa.array(errors)],
                ["doc_id", "lang_pred", "score", "second", "ambiguous", "bit_errors"],
            )

    rows = source_columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, second string, ambiguous boolean, bit_errors long")

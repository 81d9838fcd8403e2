"""Toxic passages: maximal scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, materialize, source_columns, texts

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = range(4, 9)  # prefix lengths that are units beside the whole word
NOTHING = -10.0  # surprise of a text without a positive token, below that of any real segment


def units(word: str) -> list[str]:
    """A word and its stems (marked by a star), so that an inflected form counts for its stem."""
    return [word, *(word[:n] + "*" for n in STEMS if n < len(word))]


@dataclass
class Model:
    """Log-odds of units, of all other tokens, and what turns a segment into a probability."""

    weights: dict[str, float]
    rest: float
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 0.1  # its K
    slope: float = 1.0
    intercept: float = 0.0
    memo: dict[bytes, float] = field(default_factory=dict, repr=False)
    memo_rows: int = 500_000

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def token(self, word: bytes) -> float:
        """The strongest unit of the letter runs in a white-space-separated word."""
        got = self.rest
        if self.weights:
            for run in LETTERS.findall(word.decode("utf-8", "replace").lower()):
                for unit in units(run):
                    got = max(got, self.weights.get(unit, got))
        if len(self.memo) >= self.memo_rows:
            self.memo.clear()
        self.memo[word] = got
        return got

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(token, score) of the tokens with a positive score."""
        memo, token, rest = self.memo.get, self.token, self.rest
        out = []
        for i, word in enumerate(words):
            score = memo(word)
            if score is None:
                score = token(word)
            if score > 0:
                out.append((i, score))
        return out


def segments(hits: list[tuple[int, float]], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), left to right.

    ``hits`` are the positive tokens; every other token scores ``rest`` < 0.  The
    candidate list keeps for each segment the totals before and after it; a new
    segment joins back to the last candidate whose left total is lower, if that
    candidate's right total is lower too.  Linear in the number of hits.
    """
    kept: list[list] = []  # [first, last, total before, total after, index of the nearest lower candidate or -1]
    total, next_token = 0.0, 0
    for at, score in hits:
        total += rest * (at - next_token)
        before, total, next_token = total, total + score, at + 1
        new = [at, at, before, total, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], kept[j][4]]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: doc_id, n_tokens, surprise, segments.

    ``segments`` holds every maximal segment that is significant (expected number of
    such segments by chance in the text below 1): first and last token, score and
    expectation.  ``surprise`` adds up decay * score - ln(scale * tokens) over them, or
    is the best segment's if none is significant, or ``NOTHING`` without any.
    A null or empty text has no tokens and no segment.
    """
    kind = pa.struct([("first_token", pa.int32()), ("last_token", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [surprise(text, model) for text in _split(batch.column(1))]
            sizes, values, found = zip(*rows, strict=True) if rows else ((), (), ())
            spans = [[{"first_token": a, "last_token": b, "score": s, "expected": math.exp(-x)} for a, b, s, x in good] for good in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(values, pa.float64()), pa.array(spans, pa.list_(kind))],
                ["doc_id", "n_tokens", "surprise", "segments"],
            )

    rows = source_columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    return rows.mapInArrow(work, "doc_id long, n_tokens int, surprise double, segments array<struct<first_token:int,last_token:int,score:double,expected:double>>")


def _split(column: pa.Array) -> Iterator[list[bytes]]:
    data, bounds = texts(column)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield data[lo:hi].tobytes().split()


def surprise(words: list[bytes], model: Model) -> tuple[int, float, list[tuple[int, int, float, float]]]:
    """(tokens, surprise, significant segments with their own surprise) of one text."""
    space = math.log(model.scale * max(len(words), 1))
    parts = [(a, b, s, model.decay * s - space) for a, b, s in segments(model.hits(words), model.rest)]
    good = [p for p in parts if p[3] > 0]
    return len(words), sum(p[3] for p in good) if good else max((p[3] for p in parts), default=NOTHING), good


def count_units(labelled: DataFrame) -> DataFrame:
    """(unit, toxic, clean): in how many texts of either label a unit occurs; '' counts the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(LETTERS.findall((text or "").lower()))
                for unit in {u for w in words for u in units(w)}:
                    counts[unit][not label] += 1
                counts[""][not label] += 1
        names = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[n][0] for n in names], pa.int64()), pa.array([counts[n][1] for n in names], pa.int64())],
            ["unit", "toxic", "clean"],
        )

    return labelled.select("text", "label").mapInArrow(work, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(
    docs: DataFrame, labels: DataFrame, most: int = 10_000, prior: float = 0.05, least_share: float = 0.002, least_odds: float = 1.0
) -> Model:
    """Learn from ``labels`` (doc_id, label 0/1) and the texts of ``docs``.

    At most ``most`` labelled documents of each label take part, the first in hash
    order; equal texts count once.  A unit's log-odds have an informative Dirichlet
    prior: pseudo-counts of ``prior`` times the sample's size, dealt by the unit's
    share in both labels together.  A unit is scored if the odds' lower bound (two
    standard errors) is at least ``least_odds``, which no word reaches that is merely a
    little more frequent in toxic texts however many texts there are, and if at least
    ``least_share`` of the toxic texts have it, so there are at most (units of a text) /
    ``least_share`` of them.  All other tokens share one weight.  The calibration weighs
    the sample by the labels' true numbers.  Without toxic or without clean rows nothing is scored and every
    probability is the share of toxic rows (0 without any).
    """
    one = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    true = {r.label: r.n for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.broadcast(bounded_sample(one, "label", "doc_id", most))  # at most twice ``most`` ids
    found = source_columns(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text"), F.lit(""))).join(chosen, "doc_id")
    sample = materialize(found.groupBy(F.md5("text").alias("_sha")).agg(F.first("text").alias("text"), F.max("label").alias("label"), F.min("doc_id").alias("doc_id")), "toxicity_sample")
    counted = count_units(sample)
    counted = materialize(counted, "toxicity_units")
    sizes = {r.unit: (r.toxic, r.clean) for r in counted.filter("unit = ''").collect()}
    toxic, clean = sizes.get("", (0, 0))
    if not toxic or not clean:
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        return Model({}, -1.0, slope=0.0, intercept=math.log((share + 1e-9) / (1 - share + 1e-9)))
    strong = counted.filter((F.col("unit") != "") & (F.col("toxic") >= least_share * toxic) & (F.col("toxic") / toxic > F.col("clean") / clean)).collect()
    weights, mass = {}, prior * (toxic + clean)
    for row in strong:
        pseudo = mass * (row.toxic + row.clean) / (toxic + clean)
        a, b = row.toxic + pseudo, row.clean + pseudo
        odds = math.log(a / (toxic + mass - a)) - math.log(b / (clean + mass - b))
        if odds - 2 * math.sqrt(1 / a + 1 / b) >= least_odds:
            weights[row.unit] = odds
    model = Model(weights, -1e-3)
    # Hits for each token of either label give the weight of all the other tokens.
    totals = _hit_totals(sample, model)
    p, q = (min(max((totals[k][0] + 0.5) / (totals[k][1] + 1), 1e-6), 0.5) for k in (1, 0))
    model.rest = min(-1e-4, math.log((1 - p) / (1 - q)))
    model.decay = _decay(model, totals[0])
    surprise = scored(sample, model).join(sample.select("doc_id", "label"), "doc_id").select("surprise", "label")
    bins = surprise.groupBy(F.round("surprise", 1).alias("x"), "label").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the sample
    model.slope, model.intercept = _logistic(np.array([[r.x, r.label, r.n * true[r.label] / (toxic if r.label else clean)] for r in bins], float))
    discard(sample, counted)
    return model


def _hit_totals(sample: DataFrame, model: Model) -> dict[int, tuple[float, float, float]]:
    """By label: tokens that score, all tokens, and the mean score of those that do."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {0: [0.0, 0.0, 0.0], 1: [0.0, 0.0, 0.0]}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                hits = model.hits(words)
                for k, v in enumerate((len(hits), len(words), sum(s for _, s in hits))):
                    got[label][k] += v
        yield pa.RecordBatch.from_pylist([{"label": k, "hits": v[0], "tokens": v[1], "total": v[2]} for k, v in got.items()])

    rows = sample.select("text", "label").mapInArrow(work, "label long, hits double, tokens double, total double").groupBy("label").agg(F.sum("hits").alias("hits"), F.sum("tokens").alias("tokens"), F.sum("total").alias("total")).collect()
    got = {r.label: (r.hits, r.tokens, r.total / r.hits if r.hits else 0.0) for r in rows}
    return {k: got.get(k, (0.0, 0.0, 0.0)) for k in (0, 1)}


def _decay(model: Model, clean: tuple[float, float, float]) -> float:
    """The positive root of E[exp(decay * score)] = 1 over clean tokens."""
    share = (clean[0] + 0.5) / (clean[1] + 1)
    score = max(model.weights.values(), default=1.0) if not clean[2] else clean[2]
    value = lambda x: share * math.exp(x * score) + (1 - share) * math.exp(x * model.rest) - 1
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return min(max(high, 0.05), 4.0)


def _logistic(bins: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by penalised Newton steps over (x, label, count) rows."""
    x, y, n = bins.T
    x = np.clip(x, -30, 30)
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (p - y)) + 1e-2 * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (probability of label 1), n_tokens, segments; a row for each row."""
    rows = scored(docs, model, doc_id, text)
    line = F.col("surprise").cast("double")
    margin = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line)) * F.lit(model.slope) + F.lit(model.intercept)
    return rows.select("doc_id", (1 / (1 + F.exp(-margin))).alias("score"), "n_tokens", "segments")


def clean_rows(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``least``; nothing is shuffled."""
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = (max(-30.0, min(30.0, surprise(words, model)[1])) * model.slope + model.intercept for words in _split(batch.column(at)))
            yield batch.filter(pa.array([1 / (1 + math.exp(-m)) < least for m in margins], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)

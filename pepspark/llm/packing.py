"""Packing tokenized documents into fixed-length sequences from a plan over the length histogram."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import growing, materialize, source_columns, texts

#: Words of letters whose lower-casing and composition are one character to one, then plain punctuation.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([.,;:!?]*)")


class WordTokenizer:
    """Token ids of a text through a memo of its words.

    The vocabulary drops white space and never joins across it, so a text's ids are
    those of its ASCII-white-space-separated words in order.  Two generations of words
    and the runs in them are remembered, each of at most ``most``; that changes speed only.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.most = most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in codes]
        # Bytes as the printable characters that byte-level vocabularies are written in.
        self.printable = {b: chr(b) for b in codes} | {b: chr(256 + i) for i, b in enumerate(others)}

    def piece(self, text: str) -> bytes:
        """Ids of one run of letters or marks in lower case."""
        got = self.pieces.get(text)
        if got is None:
            tokens = self.model.tokenize(text.encode().decode("latin-1").translate(self.printable))
            got = np.array([t.id for t in tokens], "<u4").tobytes()
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            self.pieces[text] = got
        return got

    def slow(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        simple = SIMPLE.fullmatch(text)
        if simple:
            letters, marks = simple.groups()
            return self.piece(letters.lower()) + (self.piece(marks) if marks else b"")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing(self, word: bytes) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.slow(word)
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[word] = got
        return got

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids."""
        words = text.split()
        got = list(map(self.young.get, words))
        if None in got:
            for i in [i for i, x in enumerate(got) if x is None]:
                got[i] = self.__missing(words[i])
        return b"".join(got)


TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in TOKENIZERS:
        TOKENIZERS[path] = WordTokenizer(path)
    return TOKENIZERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of at most ``capacity`` tokens of each document.

    A document's ids end with ``end_id``; a null text is empty and so is one token.
    Only longer documents are cut.  (part, nth) is the piece's place among the pieces
    of its length that one task made.
    """
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            data, bounds = texts(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                code = encode(data[lo:hi].tobytes()) + end
                for k, at in enumerate(range(0, len(code), 4 * capacity)):
                    own = code[at : at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((ids[i], k, at // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
            names = [c.split()[0] for c in PIECES.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = source_columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    return rows.mapInArrow(work, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest first: rows (length, first, count, sequence, each, offset).

    The ``count`` pieces of ``length`` from rank ``first`` on go to sequences from
    ``sequence`` on, ``each`` to a sequence, from ``offset``.  Sequences with the same
    free room are kept as ranges, so the work and the plan depend on ``capacity``, not
    on the number of pieces: a length opens, uses up or splits a range, and splits at
    most two.
    """
    out = []
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # the free rooms there are, ascending
    fresh = 0

    def put(free: int, first: int, count: int) -> None:
        if free > 0 and count > 0:
            if free not in room:
                room[free] = []
                insort(sizes, free)
            room[free].append((first, count))

    def take(free: int) -> tuple[int, int]:
        got = room[free].pop()
        if not room[free]:
            del room[free]
            sizes.pop(bisect_left(sizes, free))
        return got

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, count = take(free)
            else:
                free, first, count = capacity, fresh, -(-left // (capacity // length))
                fresh += count
            each = free // length
            full = min(count, left // each)
            if full:
                out.append((length, rank, full * each, first, each, capacity - free))
                put(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = count - full
            if rest and left and left < each:
                out.append((length, rank, left, first + full, left, capacity - free))
                put(free - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(free, first + full, count - full)
    return out


def pack(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Where each piece goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Tokenizing runs once and is written.  Only the histogram, at most ``capacity``
    rows, reaches the driver.  A piece's rank within its length is its place in its
    task plus the counts of earlier tasks, so a length that most pieces share is never
    sorted in one task.  The plan is at most a few times ``capacity`` rows whatever the
    input and is looked up by (length, rank).
    """
    made = materialize(pieces(docs, path, capacity, end_id, doc_id, text), "pieces")
    counts = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n"), "piece_counts")
    histogram = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    keys = slots[:, 0] << 48 | slots[:, 1]
    ranked = made.join(growing(starts.drop("n")), ["length", "part"], "left").withColumn("rank", F.col("nth") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            slot = slots[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            at = rank - slot[:, 1]
            sequence = slot[:, 3] + at // slot[:, 4]
            offset = slot[:, 5] + at % slot[:, 4] * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in RESULT[:5]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], RESULT)

    return ranked.select(*RESULT[:5], "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


RESULT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

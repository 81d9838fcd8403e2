"""Overlaps of sparse count vectors, block against block.

A join on a code that very many rows share is one hot key, and every pair it forms
is a row to shuffle.  Here rows are cut into blocks of bounded size instead; each
pair of blocks is one small group, whose overlaps are counted in NumPy from an
inverted index of one side.  Only results leave the task.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Entries (codes of all rows) of a block.
BLOCK = 1 << 17


@dataclass
class Sparse:
    """Rows of (code, count); ``codes`` and ``counts`` run from row to row, ``bounds`` ends each."""

    codes: np.ndarray
    counts: np.ndarray | None
    bounds: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def take(self, kept: np.ndarray) -> Sparse:
        """Only the rows where ``kept`` is true."""
        entries = kept[self.rows()]
        sizes = np.diff(self.bounds)[kept]
        counts = None if self.counts is None else self.counts[entries]
        return Sparse(self.codes[entries], counts, np.concatenate(([0], np.cumsum(sizes))))

    @staticmethod
    def of_lists(column: pa.ChunkedArray | pa.Array) -> Sparse:
        """Rows of distinct codes, each counted once."""
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        bounds = np.concatenate(([0], np.cumsum(flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        return Sparse(flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64), None, bounds)


def _kmer_codes(sequences: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every k-mer of upper-case sequences, five bits a letter."""
    if k > 12:
        raise ValueError("k-mers longer than 12 do not fit a bigint")
    raw = np.frombuffer("".join(sequences).encode("utf-32-le"), np.uint32).astype(np.int64) - 64
    if len(raw) and (raw.min() < 1 or raw.max() > 26):
        raise ValueError("a sequence has other characters than A-Z")
    sizes = np.array([len(s) for s in sequences], np.int64)
    row = np.repeat(np.arange(len(sequences)), sizes)
    first = np.cumsum(sizes) - sizes
    inside = np.arange(len(raw)) - first[row] <= sizes[row] - k
    code = np.zeros(len(raw), np.int64)
    for i in range(k):
        code[: len(raw) - i] = code[: len(raw) - i] * 32 + raw[i:]
    return row[inside], code[inside]


def _entries(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) in order: codes, how often each occurs, and where rows end."""
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))) if len(row) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(row)))
    return code[first], counts, np.searchsorted(row[first], np.arange(n + 1))


#: Codes are counted in so many buckets at most, whatever their length.
BUCKETS = 1 << 22


def _buckets(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def _text_codes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds): the distinct k-mers of each list of sequences, in order."""
    sizes = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row, code = _kmer_codes([s or "" for s in texts.flatten().to_pylist()], k)
    code, _, bounds = _entries(np.repeat(np.arange(len(texts)), sizes)[row], code, len(texts))
    return code, bounds


def stored_frequencies(df: DataFrame, column: str, k: int) -> str:
    """Write how many rows hold a k-mer of each bucket to the shared folder; returns the place.

    The table is bounded by ``BUCKETS``.  A k-mer occurs in no more rows than its bucket says.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            np.add.at(held, _buckets(_text_codes(batch.column(0), k)[0]), 1)
        found = np.flatnonzero(held)
        for at in range(0, len(found), 1 << 16):
            some = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "f"])

    counts = df.select(column).mapInArrow(work, "bucket long, f long").groupBy("bucket").agg(F.sum("f").alias("f"))
    folder = f"{_shared(df.sparkSession)}/frequencies-{uuid.uuid4().hex}"
    counts.write.parquet(folder)
    return folder


_ranks: dict[str, np.ndarray] = {}


def _bucket_ranks(folder: str) -> np.ndarray:
    """The place of each bucket from rare to common; a worker keeps the last table."""
    if folder not in _ranks:
        table = read_files(folder)
        counts = np.zeros(BUCKETS, np.int64)
        if table is not None:
            counts[table.column("bucket").to_numpy()] = table.column("f").to_numpy()
        ranks = np.empty(BUCKETS, np.int32)
        ranks[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.int32)
        _ranks.clear()
        _ranks[folder] = ranks
    return _ranks[folder]


def ordered_kmer_lists(texts: pa.Array, k: int, folder: str) -> pa.Array:
    """The distinct k-mers of each list of sequences from rare to common; the order is the same in every row."""
    codes, bounds = _text_codes(texts, k)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # Codes of a row are in order, so those of one bucket stay so.
    order = np.argsort(row * BUCKETS + _bucket_ranks(folder)[_buckets(codes)], kind="stable")
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(codes[order]))


def kmer_counts(sequences: list[str], k: int, spaces: list[int] | None = None) -> Sparse:
    """The k-mers of upper-case sequences with their counts.

    Rows of different ``spaces`` share no code.  Codes are numbers of the k-mers at hand.
    """
    row, code = _kmer_codes(sequences, k)
    _, code = np.unique(code, return_inverse=True)
    if spaces is not None:
        code = code + np.asarray(spaces, np.int64)[row] * (int(code.max(initial=0)) + 1)
    codes, counts, bounds = _entries(row, code, len(sequences))
    return Sparse(codes, counts.astype(np.float64), bounds)


def overlaps(left: Sparse, right: Sparse, cells: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, stop, dots): dot products of rows start to stop of ``left`` with all of ``right``.

    About ``cells`` numbers are held at a time, more only for a single row.
    """
    width, n = len(right.bounds) - 1, len(left.bounds) - 1
    if not width or not n:
        return
    order = np.argsort(right.codes, kind="stable")
    row_of = right.rows()[order]
    known, first = np.unique(right.codes[order], return_index=True)
    last = np.append(first[1:], len(order))
    at = np.searchsorted(known, left.codes)
    at[at == len(known)] = 0
    hit = known[at] == left.codes if len(known) else np.zeros(len(left.codes), bool)
    start_of = np.where(hit, first[at] if len(known) else 0, 0)
    sizes = np.where(hit, (last - first)[at] if len(known) else 0, 0)
    work = np.concatenate(([0], np.cumsum(sizes)))[left.bounds]
    row_base = left.rows() * width
    post_base = start_of - (np.cumsum(sizes) - sizes)
    start = 0
    while start < n:
        stop = min(start + max(1, cells // width), int(np.searchsorted(work, work[start] + cells, "right")) - 1, n)
        stop = max(stop, start + 1)
        part = slice(left.bounds[start], left.bounds[stop])
        size = sizes[part]
        posting = np.repeat(post_base[part], size)
        posting += np.arange(work[start], work[stop])
        cell = row_of[posting]
        cell += np.repeat(row_base[part] - start * width, size)
        weights = None if left.counts is None else np.repeat(left.counts[part], size) * right.counts[order[posting]]
        yield start, stop, np.bincount(cell, weights, (stop - start) * width).reshape(stop - start, width)
        start = stop


#: A pair of sets shares so many codes of their prefixes, or all that it needs, before the sets are compared.
SHARE = 4
#: Postings that are held at a time, more only for a single row.
POSTINGS = 1 << 18
#: Pairs whose sets are compared at a time.
COMPARED = 1 << 13


class Sets:
    """Rows of stored blocks: codes from rare to common, ``n`` of them, of which a similar larger set has ``need``."""

    def __init__(self, table: pa.Table):
        self.table, self.codes = table, Sparse.of_lists(table.column("codes"))
        self.n, self.need = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "need"))
        self.ordinal = table.column("ordinal").to_numpy()
        self.row = self.codes.rows()
        self.at = np.arange(len(self.row)) - self.codes.bounds[self.row]
        # 256 bits a row, one a code: what two rows have in common there bounds what they share.
        bit = (self.codes.codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)
        flag = np.uint64(1) << (bit & np.uint64(63))
        self.marks = [np.bitwise_or.reduceat(np.where(bit >> np.uint64(6) == w, flag, np.uint64(0)), self.codes.bounds[:-1]) for w in range(4)]
        self.hidden = self.n - sum(np.bitwise_count(m).astype(np.int64) for m in self.marks)

    def __len__(self) -> int:
        return len(self.n)

    def take(self, rows: np.ndarray) -> Sets:
        return Sets(self.table.take(pa.array(rows)))


def read_sets(folder: str, start: int, stop: int | None = None) -> Sets | None:
    """The rows of a block, or of several."""
    found = [t for t in (read_block(folder, b) for b in range(start, start + 1 if stop is None else stop)) if t is not None and len(t)]
    return Sets(pa.concat_tables(found)) if found else None


def _prefix(n: np.ndarray, need: np.ndarray | int) -> np.ndarray:
    """Codes of which a pair that shares ``need`` shares SHARE at least (all of them if it needs fewer)."""
    return n - need + np.minimum(SHARE, need)


class Postings:
    """Rows by the codes in their prefixes, for smaller sets that need ``least`` codes or more."""

    def __init__(self, sets: Sets, least: int):
        self.sets = sets
        order = np.argsort(sets.codes.codes)
        codes = sets.codes.codes[order]
        fresh = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
        self.known = codes[fresh]
        number = np.cumsum(fresh) - 1
        self.number = np.empty(len(order), np.int64)
        self.number[order] = number
        kept = (sets.at < _prefix(sets.n, least)[sets.row])[order]
        self.row_of = sets.row[order[kept]].astype(np.uint32)
        self.first = np.searchsorted(number[kept], np.arange(len(self.known) + 1))

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code here, or -1."""
        some, at = np.unique(codes, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)
        return np.where(self.known[place] == some, place, -1)[at]


def _candidates(left: Sets, index: Postings, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): rows that share enough codes of their prefixes."""
    probes = (left.at < _prefix(left.n, left.need)[left.row]) & (number >= 0)
    row, number = left.row[probes], number[probes]
    start, size = index.first[number], index.first[number + 1] - index.first[number]
    width, work = len(index.sets), np.concatenate(([0], np.cumsum(size)))
    ends = np.searchsorted(row, np.arange(len(left) + 1))
    upto, least, begin = work[ends], np.minimum(SHARE, left.need), 0
    while begin < len(left):
        stop = int(np.searchsorted(upto, upto[begin] + POSTINGS, "right")) - 1
        stop = min(max(stop, begin + 1), begin + max(1, (1 << 32) // width - 1), len(left))
        part = slice(ends[begin], ends[stop])
        sizes = size[part]
        posting = np.repeat(start[part] - (work[part] - work[ends[begin]]), sizes)
        posting += np.arange(len(posting))
        key = index.row_of[posting]
        key += np.repeat(((row[part] - begin) * width).astype(np.uint32), sizes)
        key.sort()
        enough = least[begin:stop]
        lag = int(enough.min()) - 1
        key = key[: len(key) - lag][key[lag:] == key[: len(key) - lag]] if lag else key
        fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        found = key[fresh].astype(np.int64)
        a = found // width
        if int(enough.max()) - 1 > lag:
            counted = np.diff(np.append(fresh, len(key))) + lag >= enough[a]
            found, a = found[counted], a[counted]
        yield a + begin, found - a * width
        begin = stop


def _entries_of(sets: Sets, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``rows``, value) of all codes of the rows."""
    sizes = sets.n[rows]
    inside = np.repeat(sets.codes.bounds[rows] - (np.cumsum(sizes) - sizes), sizes)
    inside += np.arange(len(inside))
    return np.repeat(np.arange(len(rows)), sizes), values[inside]


def shared_codes(left: Sets, index: Postings, allowed) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, shared): pairs that share what the row of ``left`` needs, among those that ``allowed`` (a, b) lets pass.

    Pairs come from postings of prefixes, are tested by their marks and then compared code by code.
    """
    right = index.sets
    if not len(left) or not len(right):
        return
    number = index.numbers(left.codes.codes)
    for a, b in _candidates(left, index, number):
        kept = allowed(a, b)
        a, b = a[kept], b[kept]
        bound = left.hidden[a]
        for x, y in zip(left.marks, right.marks, strict=True):
            bound += np.bitwise_count(x[a] & y[b])
        kept = bound >= left.need[a]
        a, b = a[kept], b[kept]
        for at in range(0, len(a), COMPARED):
            p, q = a[at : at + COMPARED], b[at : at + COMPARED]
            (x, u), (y, v) = _entries_of(left, number, p), _entries_of(right, index.number, q)
            key = np.concatenate([(x * len(index.known) + u)[u >= 0], y * len(index.known) + v])
            key.sort()
            twice = key[1:][key[1:] == key[:-1]]
            shared = np.bincount(twice // len(index.known), minlength=len(p))
            hit = np.flatnonzero(shared >= left.need[p])
            if len(hit):
                yield p[hit], q[hit], shared[hit]


def numbered_blocks(df: DataFrame, order: list[str], weight: str, size: int = BLOCK) -> tuple[DataFrame, int]:
    """Add ``ordinal`` and ``block``, both from 0 in the order given; a block has about ``size`` summed weight.

    Rows are numbered inside range partitions; only totals of partitions are put in
    order afterwards.  Returns the (checkpointed) table and the number of blocks.
    """
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_nth", T.LongType())]
    fields = T.StructType([*df.schema.fields, *extra])
    place = df.columns.index(weight)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, rows = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            upto = np.cumsum(batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64))
            n = len(upto)
            nth = (before + np.concatenate(([0], upto))[:n]) // size
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)
            before, rows = before + int(upto[-1] if n else 0), rows + n

    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, fields).checkpoint()
    counts = cut.groupBy("_part").agg((F.max("_nth") + 1).alias("_blocks"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition.
    offsets = counts.select(F.col("_part").alias("_of_part"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_blocks", "_rows")])
    total = counts.agg(F.coalesce(F.sum("_blocks"), F.lit(0))).first()[0]
    placed = cut.join(F.broadcast(offsets), F.col("_part") == F.col("_of_part"))
    numbered = placed.select(*df.columns, (F.col("_rows_before") + F.col("_row")).alias("ordinal"), (F.col("_blocks_before") + F.col("_nth")).alias("block"))
    return numbered, int(total)


def every_block(n: Column | int, first: Column | int = 0) -> Column:
    """Explode: a row for each block from ``first`` up to the last of ``n``."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.explode(F.sequence(as_column(first).cast("long"), as_column(n).cast("long") - 1))


def _shared(spark) -> str:
    return re.sub("^file:/+", "file:///", ensure_checkpoint_dir(spark))


def stored_blocks(df: DataFrame) -> str:
    """Write ``df`` to the shared checkpoint folder, one folder for each ``block``; returns the place.

    Tasks read the blocks that they compare from there (``read_block``), so a block is written
    once, however many others it meets.
    """
    folder = f"{_shared(df.sparkSession)}/blocks-{uuid.uuid4().hex}"
    df.write.partitionBy("block").parquet(folder)
    return folder


def read_files(folder: str) -> pa.Table | None:
    """The rows of the parquet files of a folder, or None if there is none."""
    source, base = fs.FileSystem.from_uri(folder)
    found = source.get_file_info(fs.FileSelector(base, allow_not_found=True))
    tables = []
    for info in sorted(found, key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with source.open_input_file(info.path) as file:
                tables.append(pq.ParquetFile(file).read())
    return pa.concat_tables(tables) if tables else None


def read_block(folder: str, block: int) -> pa.Table | None:
    """The rows of a block, or None if it has none."""
    return read_files(f"{folder}/block={block}")


def block_runs(spark, n_left: int, n_right: int, upper: bool = False, run: int = 32, lefts: int = 1) -> DataFrame:
    """(i, i_stop, j, stop): each ``lefts`` blocks i to i_stop - 1 of the left side with runs of blocks j to stop - 1 of the right side.

    ``upper`` leaves out j < i.  A few rows are one task.
    """
    first = F.col("i") if upper else F.lit(0).cast("long")
    starts = F.explode(F.sequence(first, F.lit(n_right - 1).cast("long"), F.lit(run).cast("long")))
    rows = sum(-(-(n_right - (i if upper else 0)) // run) for i in range(0, n_left, lefts))
    table = spark.range(0, n_left, lefts).select(F.col("id").alias("i")).select("i", F.least(F.col("i") + lefts, F.lit(n_left)).alias("i_stop"), starts.alias("j"))
    return table.select("i", "i_stop", "j", F.least(F.col("j") + run, F.lit(n_right)).alias("stop")).repartition(max(1, min(rows, 1 << 13)))


def index_runs(spark, n_left: int, n_right: int, upper: bool = False) -> DataFrame:
    """``block_runs`` whose right blocks are indexed together: large ones where there are enough of them for many tasks."""
    return block_runs(spark, n_left, n_right, upper, run=min(8, max(1, n_right // 8)), lefts=min(32, max(1, n_left // 6)))

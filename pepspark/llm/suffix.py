"""Repeated passages through a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, PrefixHash, discard, growing, materialize, mix, runs, texts

IDENTITY = ["doc", "n_bytes"]


def geometry(length: int) -> tuple[int, int, int]:
    """(gap, grain, reach) for passages of ``length`` bytes.

    The suffix sampled for a passage of ``length`` bytes starts in its first ``gap`` bytes,
    is chosen by hashes of ``grain`` bytes, and is followed by at least ``reach`` bytes
    of the passage.
    """
    gap = max(1, length * 3 // 8)
    return gap, max(1, min(32, length - gap)), length - gap


def _slide(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` of every ``width`` neighbours (the one at i and those after it)."""
    blocks = -(-(len(values) + width) // width)
    padded = np.full(blocks * width, np.uint64(fill))
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    ahead = pick.accumulate(table, axis=1).ravel()
    behind = pick.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: len(values)], ahead[width - 1 : width - 1 + len(values)])


def sampled(hashes: PrefixHash, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, suffix): for every start of a passage the suffix that is sampled for it.

    That is the first of the smallest hashes of the ``gap`` positions from the start
    on.  They lie inside the passage, so equal passages have the same one.
    """
    gap, grain, _ = geometry(length)
    sizes = np.diff(bounds)
    usable = np.maximum(sizes - length + 1, 0)
    begin = np.repeat(bounds[:-1], usable)
    start = begin + np.arange(len(begin)) - np.repeat(np.cumsum(usable) - usable, usable)
    if not len(start):
        return start, start
    at = np.arange(int(bounds[-1]) - grain + 1)
    value = hashes.every(grain)
    least = _slide(value, gap, np.minimum, (1 << 64) - 1)[start]
    # Places that are the smallest of some start's positions, then for each start the first such place with its value.
    lowest = np.zeros(len(value), np.uint64)
    lowest[start] = least
    covered = _slide(lowest[::-1].copy(), gap, np.maximum, 0)[::-1]
    places = at[covered == value]
    pick = np.searchsorted(places, start)
    open_ = np.arange(len(start))
    while len(open_):
        pick_now = places[np.minimum(pick[open_], len(places) - 1)]
        open_ = open_[value[pick_now] != least[open_]]
        pick[open_] += 1
    return start, places[pick]


def sampled_blocks(hashes: PrefixHash, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, count, suffix): runs of neighbouring starts for which ``sampled`` gives one suffix.

    A window's smallest hash is nearly always among the hashes below a limit that ten
    places of a window are expected to meet; longer stretches without such a place are
    looked at whole.  Each place has the windows that reach neither back to one that is
    as small nor on to a smaller one.
    """
    gap, grain, _ = geometry(length)
    usable = np.maximum(np.diff(bounds) - length + 1, 0)
    if not usable.any():
        return (np.zeros(0, np.int64),) * 3
    value = hashes.every(grain)
    low = value < np.uint64(min((1 << 64) - 1, 10 * (1 << 64) // gap))
    at = np.flatnonzero(low)
    far = np.flatnonzero(np.diff(np.concatenate([[-1], at, [len(value)]])) > gap)
    for one, two in zip(np.concatenate([[-1], at])[far].tolist(), np.concatenate([at, [len(value)]])[far].tolist(), strict=True):
        low[one + 1 : two] = True
    if 2 * np.count_nonzero(low) > len(value):
        start, suffix = sampled(hashes, bounds, length)
        fresh = np.ones(len(start), bool)
        fresh[1:] = (suffix[1:] != suffix[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(fresh)
        return start[first], np.diff(np.append(first, len(start))), suffix[first]
    at = np.flatnonzero(low) if len(far) else at
    value = value[at]
    back, on = _nearest(at, value, gap, -1, np.less_equal), _nearest(at, value, gap, 1, np.less)
    row = np.searchsorted(bounds, at, "right") - 1
    first = np.maximum(np.maximum(at - gap, back) + 1, bounds[row])
    last = np.minimum(np.minimum(at, on - gap), bounds[row] + usable[row] - 1)
    good = first <= last
    return first[good], (last - first + 1)[good], at[good]


def _nearest(at: np.ndarray, value: np.ndarray, gap: int, way: int, beats: np.ufunc) -> np.ndarray:
    """The nearest place before (``way`` -1) or after (1) each whose value beats its own; one ``gap`` away if none is nearer."""
    found = at + way * gap
    open_ = np.arange(len(at))
    other = open_ + way
    while len(open_):
        inside = (other >= 0) & (other < len(at))
        open_, other = open_[inside], other[inside]
        near = np.abs(at[other] - at[open_]) < gap
        open_, other = open_[near], other[near]
        won = beats(value[other], value[open_])
        found[open_[won]] = at[other[won]]
        open_, other = open_[~won], other[~won] + way
    return found


def word_edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, offsets): where the words of the texts start and stop, and each text's range of words.

    Words are runs of other bytes than ASCII white space; none goes over the edge of a text.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    inside = ~SPACE[data]
    start = np.nonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))[0]
    stop = np.nonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]])))[0] + 1
    return start, stop, np.searchsorted(start, bounds)


def word_hashes(hashes: PrefixHash, start: np.ndarray, stop: np.ndarray) -> PrefixHash:
    """Hashes of any range of words; the white space between them takes no part."""
    return PrefixHash(hashes.ranges(start, stop))


def blocks(data: np.ndarray, bounds: np.ndarray, length: int, words: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, row, start, count, f, e) of the sampled suffixes, some texts at a time.

    A suffix stands for its block, the ``count`` neighbouring passages that it is sampled
    for.  ``f`` names the ``reach`` bytes at the suffix, which all of them hold; ``e``
    names all bytes of the block's passages and where the suffix is in them.

    With ``words``, passages of that many words are sampled beside those of ``length``
    bytes.  Their starts and counts are in words, and their ``f`` are odd, the others even.
    """

    def of(hashes: PrefixHash, own: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        _, _, reach = geometry(size)
        start, count, suffix = sampled_blocks(hashes, own, size)
        row = np.searchsorted(own, start, "right") - 1
        f = hashes.ranges(suffix, suffix + reach)
        e = mix(hashes.ranges(start, start + count - 1 + size) + (suffix - start).astype(np.uint64))
        return row, start - own[row], count, f, e

    for lo, hi in runs(bounds, 1 << 19):
        own, part = bounds[lo : hi + 1] - bounds[lo], data[bounds[lo] : bounds[hi]]
        hashes = PrefixHash(part)
        found = of(hashes, own, length)
        if words:
            start, stop, offsets = word_edges(part, own)
            worded = of(word_hashes(hashes, start, stop), offsets, words)
            found = (*found[:3], found[3] & ~np.uint64(1), found[4]), (*worded[:3], worded[3] | np.uint64(1), worded[4])
            found = tuple(np.concatenate(pair) for pair in zip(*found, strict=True))
            order = np.argsort(found[0], kind="stable")
            found = tuple(column[order] for column in found)
        yield lo, hi, *found


def suffixes(docs: DataFrame, length: int, doc_id: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """(doc_id, doc, n_bytes, sha, start, count, f, e): a row for each row, arrays for the first copy in a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            data, bounds = texts(batch.column(2))
            names = batch.column(1).to_numpy()
            for lo, hi, row, start, count, f, e in blocks(data, bounds, length, words):
                n = hi - lo
                size = np.diff(bounds[lo : hi + 1])
                fresh = np.zeros(n, bool)
                for i, key in enumerate(zip(names[lo:hi].tolist(), size.tolist(), strict=True)):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                keep = fresh[row]
                starts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=n))]).astype(np.int32))
                arrays = [pa.ListArray.from_arrays(starts, pa.array(c[keep].astype(t) if t != np.int64 else c[keep].view(np.int64))) for c, t in ((start, np.int32), (count, np.int32), (f, np.int64), (e, np.int64))]
                sha = [hashlib.sha256(data[bounds[i] : bounds[i + 1]]).digest() for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(size), pa.array(sha, pa.binary()), *arrays],
                    ["doc_id", "doc", "n_bytes", "sha", "start", "count", "f", "e"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), identity(text)[0].alias("doc"), whole(text).alias("text"))
    return rows.mapInArrow(work, "doc_id long, doc long, n_bytes long, sha binary, start array<int>, count array<int>, f array<long>, e array<long>")


def whole(text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def identity(text: str) -> tuple:
    """(doc, n_bytes): what names a text, the same for its copies."""
    return F.xxhash64(whole(text)), F.octet_length(whole(text)).cast("long")


class LevelIndex:
    """Suffix arrays in levels of one, two, four, ... batches.

    A suffix array is a table of the sampled suffixes' fingerprints (f) in order, with how often each
    occurs.  A batch is scanned against every level in order, then becomes a
    level; before the next one comes, two levels of one size merge into one of twice the
    size, so a suffix is rewritten a logarithmic number of times.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.tables: list[DataFrame] = []  # all that was written and is still there

    def add(self, batch: DataFrame) -> DataFrame:
        """Insert a batch of suffixes (f); the fingerprints that it shares with a level or within itself."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, two) = self.levels.pop(), self.levels.pop()
            merged = one.unionByName(two).groupBy("f").agg(F.sum("n").cast("int").alias("n")).sortWithinPartitions("f")
            self.levels.append((2 * size, materialize(merged, "suffix_array")))
            self.tables.append(self.levels[-1][1])
        own = materialize(batch.groupBy("f").agg(F.count(F.lit(1)).cast("int").alias("n")).sortWithinPartitions("f"), "suffix_array")
        hits = own.filter("n > 1").select("f")
        for _, level in self.levels:
            hits = hits.unionByName(own.join(growing(level.select("f")), "f", "left_semi").select("f"))
        self.levels.append((1, own))
        self.tables.append(own)
        return hits


def repeats(docs: DataFrame, length: int = 400, batches: int = 4, doc_id: str = "doc_id", text: str = "text", words: int | None = None, separate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): every row with its text's name, and the cut of each text that repeats something.

    rows: doc_id, doc, n_bytes, sha (SHA-256 of the text).  cut: doc, n_bytes,
    n_removed, n_spans, spans (start, stop), kept (the bytes that stay), kept_sha,
    n_removed_words.  With ``separate`` all but the last are about ``length`` alone, and
    n_removed_words counts the bytes that ``words`` would take beside them.

    A byte is cut if a ``length``-byte string that covers it also starts anywhere
    else, in any text or the same, overlapping or not.  Texts are UTF-8 bytes, a null is
    empty, shorter texts keep all.  A text of ``length`` or more that occurs in two rows
    is cut whole.  With ``words``, so is every byte from the first to the last of that many
    words in a row that start anywhere else too, whatever white space is between them.

    1. Suffixes are sampled by content, and the level index finds the fingerprints that
       occur twice; a passage that repeats has a sampled suffix with such a one.
    2. Of the suffixes with one fingerprint, those whose whole block agrees repeat it
       whole.  Where blocks differ, one block of each kind is read again and its
       passages are hashed one by one; a passage found twice repeats.
    Groups are only counted and joined, never gathered; a fingerprint that a third of
    all texts share is a skewed join key, which adaptive execution splits.
    """
    taken = materialize(suffixes(docs, length, doc_id, text, words), "suffixes")
    made = materialize(taken.select("doc_id", *IDENTITY, "sha"), "suffix_rows")
    index, found = LevelIndex(), None
    for b in range(batches):
        part = taken.filter(F.pmod(F.hash("doc"), F.lit(batches)) == b).select(F.explode("f").alias("f"))
        hits = index.add(part)
        found = hits if found is None else found.unionByName(hits)
    shared = materialize(found.distinct(), "shared_suffixes")
    every = taken.select("doc", "n_bytes", F.explode(F.arrays_zip("f", "e", "start", "count")).alias("x")).select("x.f", "x.e", "doc", "n_bytes", "x.start", "x.count")
    near = materialize(every.join(growing(shared), "f"), "near_suffixes")
    discard(taken, shared, *index.tables)
    kinds = materialize(near.groupBy("f", "e").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "n_bytes", "start", "count")).alias("pick")), "block_kinds")
    several = kinds.groupBy("f").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("f")
    several = materialize(several, "mixed_suffixes")
    picks = kinds.join(several, "f").select("f", "times", "pick.*")
    twice = kinds.filter("times > 1").select("f", "e")
    worded = (F.col("f") % 2 != 0) if words else F.lit(False)
    unit = F.when(worded, F.lit(words or 0)).otherwise(F.lit(length))
    stop = F.col("start") + F.col("count") - 1 + unit
    marks = near.join(growing(twice), ["f", "e"]).select(*IDENTITY, F.col("start").cast("long").alias("start"), stop.cast("long").alias("stop"), worded.alias("worded"))
    marks = materialize(marks, "whole_blocks")
    copies = materialize(made.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copied_texts")
    # Copies below ``length`` bytes may still hold enough words: words are a byte and a space at least.
    least = min(length, 2 * words - 1) if words else length
    small = copies.filter((F.col("n_bytes") < length) & (F.col("n_bytes") >= least)).select(*IDENTITY)
    near_docs = materialize(near.select(*IDENTITY).unionByName(small).distinct(), "near_names")
    discard(near)
    doc, size = identity(text)
    held = docs.select(doc.alias("doc"), size.alias("n_bytes"), whole(text).alias("text")).filter(F.col("n_bytes") >= least)
    held = held.groupBy(*IDENTITY).agg(F.first("text").alias("text")).join(growing(near_docs), IDENTITY, "left_semi")
    held = materialize(held, "near_texts")

    def passages(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            names, (edge, picked) = batch.column(0).to_numpy(), _flat(batch.column(2))
            data, bounds = texts(batch.column(3))
            sizes = batch.column(1).to_numpy()
            for i in range(len(names)):
                own = data[bounds[i] : bounds[i + 1]]
                hashes = PrefixHash(own)
                wanted = slice(edge[i], edge[i + 1])
                first, count = picked["start"][wanted].astype(np.int64), picked["count"][wanted].astype(np.int64)
                which = np.repeat(np.arange(len(first)), count)
                start = np.repeat(first, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                stop = start + length
                # 32 bits of f beside the 64 of the passage itself: passages only meet within one f.
                f = picked["f"][wanted].astype(np.int32)[which]
                value = np.zeros(len(start), np.uint64)
                odd = (f & 1 != 0) if words else np.zeros(len(start), bool)
                value[~odd] = hashes.ranges(start[~odd], stop[~odd])
                if odd.any():
                    begin, end, _ = word_edges(own, np.array([0, len(own)]))
                    stop[odd] = start[odd] + words
                    value[odd] = word_hashes(hashes, begin, end).ranges(start[odd], stop[odd])
                single = (picked["times"][wanted] == 1)[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f), pa.array(value.view(np.int64)), pa.array(np.full(len(start), names[i])), pa.array(np.full(len(start), sizes[i], np.int32)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(single)],
                    ["f", "w", *IDENTITY, "start", "stop", "single"],
                )

    by_text = picks.groupBy(*IDENTITY).agg(F.collect_list(F.struct("f", "times", "start", "count")).alias("picked"))
    single = materialize(
        held.join(by_text, IDENTITY).select(*IDENTITY, "picked", "text").mapInArrow(passages, "f int, w long, doc long, n_bytes int, start int, stop int, single boolean"), "passages"
    )
    again = materialize(single.groupBy("f", "w").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("f", "w"), "repeated_passages")
    # Places of word passages stay counted in words, as in ``marks``.
    fine = single.filter("single").join(growing(again), ["f", "w"]).select("doc", *[F.col(c).cast("long").alias(c) for c in ("n_bytes", "start", "stop")], worded.alias("worded"))

    def cutting(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            data, bounds = texts(batch.column(3))
            copied = batch.column(4).to_pylist()
            edge, marked = _flat(batch.column(2))
            out: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "kept", "kept_sha", "n_removed_words")}
            spans = [np.zeros((0, 2), np.int64)]
            for i in range(batch.num_rows):
                own = data[bounds[i] : bounds[i + 1]]
                start, stop, odd = (marked[c][edge[i] : edge[i + 1]] for c in ("start", "stop", "worded"))
                gone = _covered(start[~odd], stop[~odd], len(own))
                worded = gone
                if odd.any() or (copied[i] and words):
                    begin, end, _ = word_edges(own, np.array([0, len(own)]))
                    start, stop = begin[start[odd]], end[stop[odd] - 1]
                    if copied[i] and len(begin) >= words:
                        start, stop = np.append(start, begin[0]), np.append(stop, end[-1])
                    worded = gone | _covered(start, stop, len(own))
                if not separate:
                    gone = worded
                edges = np.nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))[0].reshape(-1, 2)
                kept = own[~gone].tobytes()
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(len(edges))
                spans.append(edges)
                out["kept"].append(kept)
                out["kept_sha"].append(hashlib.sha256(kept).digest())
                out["n_removed_words"].append(int(worded.sum()))
            starts = pa.array(np.concatenate([[0], np.cumsum(out["n_spans"])]).astype(np.int32))
            flat = np.concatenate(spans)
            listed = pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["start", "stop"]))
            kinds = {"kept": pa.binary(), "kept_sha": pa.binary()}
            made = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}
            names = ["n_removed", "n_spans", "spans", "kept", "kept_sha", "n_removed_words"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *({**made, "spans": listed}[n] for n in names)], [*IDENTITY, *names])

    result = "doc long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary, kept_sha binary, n_removed_words long"
    spans = marks.unionByName(fine).groupBy(*IDENTITY).agg(F.collect_list(F.struct("start", "stop", "worded")).alias("marks"))
    copied = copies.select(*IDENTITY, F.lit(True).alias("copied"))
    some = held.join(spans, IDENTITY, "left").join(growing(copied), IDENTITY, "left")
    # A copied text of ``length`` bytes goes whole, below; what has neither marks nor copies stays.
    some = some.filter((F.col("marks").isNotNull() & F.col("copied").isNull()) | (F.col("copied") & (F.col("n_bytes") < length)))
    marked = F.coalesce("marks", F.array().cast("array<struct<start:bigint,stop:bigint,worded:boolean>>"))
    partial = some.select(*IDENTITY, marked.alias("marks"), "text", F.coalesce("copied", F.lit(False)).alias("copied")).mapInArrow(cutting, result).filter("n_removed_words > 0")
    gone = copies.filter(F.col("n_bytes") >= length).select(
        *IDENTITY, F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"), F.lit(b"").alias("kept"), F.unhex(F.sha2(F.lit(b""), 256)).alias("kept_sha"),
        F.col("n_bytes").alias("n_removed_words"),
    )
    cut = materialize(partial.unionByName(gone), "cuts")
    discard(kinds, several, marks, near_docs, copies, held, single, again)
    return made, cut


def _flat(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, fields) of a column of lists of structs without nulls."""
    edge = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])
    values = column.flatten()
    return edge, {f.name: values.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(values.type)}


def _covered(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes lie in one of the ranges."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, stop, -1)
    return np.cumsum(depth[:-1]) > 0


def membership(docs: DataFrame, length: int = 400, batches: int = 4, doc_id: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """One row for each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_removed_words; see ``repeats``.

    All columns but the last are about strings of ``length`` bytes.  ``n_removed_words``
    counts the bytes in repeats of ``length`` bytes or of ``words`` words (without
    ``words`` it equals n_removed), so that shorter passages of many words show as well.
    """
    rows, cut = repeats(docs, length, batches, doc_id, text, words, separate=True)
    joined = rows.join(growing(cut.drop("kept")), IDENTITY, "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "doc_id", "n_bytes", count("n_removed"), count("n_spans"),
        F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"), F.coalesce("spans", none).alias("spans"), count("n_removed_words"),
    )


def cut_rows(docs: DataFrame, length: int = 400, batches: int = 4, doc_id: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated bytes gone from the text; see ``repeats``.

    A character that a cut splits goes with it; a null text stays null.
    """
    _, cut = repeats(docs, length, batches, doc_id, text, words)
    kept = cut.select(F.col("doc").alias("_doc"), F.col("n_bytes").alias("_bytes"), F.col("kept").alias("_kept"))
    doc, size = identity(text)
    marked = docs.select(doc.alias("_own"), size.alias("_size"), F.struct("*").alias("_row"))
    joined = marked.join(growing(kept), (F.col("_own") == F.col("_doc")) & (F.col("_size") == F.col("_bytes")), "left")

    @F.pandas_udf("string")
    def readable(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    now = F.when(F.col("_kept").isNotNull(), readable("_kept")).otherwise(F.col("_row")[text])
    return joined.select(*[now.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])

"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut where no piece can lie across.  Distinct words are exploded into substrings
no longer than the longest piece, joined to the piece table, and the matches are grouped
by word again: the word's lattice.  A higher-order aggregate folds the lattice into one
path.  The ids go back to each block of rows that holds the word, as a dictionary that the
block's tasks read beside its texts; neither texts nor occurrences of words are shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import growing, materialize, new_folder, runs, texts

SPACE = "▁"  # the mark that vocabularies write for a space
WIDE = 1 << 31  # a span is its start times this plus its stop
NATIVE = 48  # longest word, in code points, that is folded by the aggregate
WINDOW = 64  # starts of substrings of a longer word that are cut from one part of it
PAIRS = 22  # bits of a hashed pair of code points
HELD = 1 << 20  # words that a task holds before it hands them on
ROWS = 13  # a block is 2**13 rows of a file, which is the same however a file is split for tasks
#: An event of the merge fold is one long: rank of the score (20 bits), start and stop of the piece that forms (6 each),
#: 1 for a check (2), one more place (6; of a merge the start again), and the id. This moves the places of a piece at 0.
MOVE = (1 << 32) + (1 << 26) + (1 << 18)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score, byte) of a vocabulary file: its ordinary pieces, and its byte pieces with their value."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    rows = []
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            rows.append((i, None, None, int(model.id_to_piece(i)[3:5], 16)))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            rows.append((i, model.id_to_piece(i), float(model.get_score(i)), None))
    return spark.createDataFrame(rows, "id int, piece string, score double, byte int")


def lattice(words: DataFrame, pieces: DataFrame, key: str = "word") -> DataFrame:
    """(key, edges): for each word a map from start * 2**31 + stop to (score, id) of the pieces in it.

    ``key`` is the column that tells words apart.  Substrings are cut from parts of bounded length.
    """
    known = pieces.filter("piece is not null").select("piece", "score", "id")
    longest = known.agg(F.max(F.length("piece"))).first()[0] or 1
    size = F.length("word")
    bases = words.filter(size > 0).select(key, "word", F.explode(F.sequence(F.lit(0), size - 1, F.lit(WINDOW))).alias("base"))
    parts = bases.select(key, "base", F.col("word").substr(F.col("base") + 1, F.lit(WINDOW - 1 + longest)).alias("part"))
    starts = parts.select(key, "base", "part", F.explode(F.sequence(F.lit(0), F.least(F.lit(WINDOW), F.length("part")) - 1)).alias("start"))
    spans = starts.select(key, "base", "part", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.length("part"), F.col("start") + longest))).alias("stop"))
    cut = spans.withColumn("piece", F.expr("substring(part, start + 1, stop - start)"))
    # The vocabulary is a fixed file, so its size is bounded whatever the corpus.
    edges = cut.join(F.broadcast(known), "piece").select(key, ((F.col("base") + F.col("start")).cast("long") * WIDE + F.col("base") + F.col("stop")).alias("span"), "score", "id")
    return edges.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("span", F.struct("score", "id")))).alias("edges"))


def merge_events(pieces: DataFrame) -> tuple[list[tuple[str, list[int]]], list[tuple[str, int]]]:
    """(piece, events) of the pieces of two or more code points, and (piece, id) of the others.

    The first event of a piece merges its span, in the order of scores.  Another stands for
    each pair of pieces that makes up the piece although one of them scores no better: after
    that one has formed, the piece must not be open to merging any more, or the order of
    scores is not the order of merges.
    """
    known = [r for r in pieces.filter("piece is not null").select("piece", "score", "id").collect() if len(r.piece) <= NATIVE]
    rank = {x: k for k, x in enumerate(sorted({r.score for r in known}, reverse=True))}
    if len(rank) >= 1 << 20 or any(r.id >= 1 << 18 for r in known):
        raise ValueError("ids of pieces must be below 2**18")
    place = {r.piece: rank[r.score] for r in known}
    made = []
    for r in known:
        n, own = len(r.piece), place[r.piece]
        if n < 2:
            continue
        events = [own << 38 | n << 26 | r.id]
        for m in range(1, n):
            # A single code point is there from the start.
            left, right = (place.get(x) if len(x) > 1 else -1 for x in (r.piece[:m], r.piece[m:]))
            if left is not None and right is not None and (last := max(left, right)) >= own:
                start, stop, other = (m, n, 0) if right == last else (0, m, n)
                events.append(last << 38 | start << 32 | stop << 26 | 1 << 24 | other << 18)
        made.append((r.piece, events))
    return made, [(r.piece, r.id) for r in sorted(known, key=lambda r: -r.score) if len(r.piece) == 1]


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _field(event: Column, at: int) -> Column:
    return F.shiftright(event, at).bitwiseAND(F.lit(63)).cast("int")


def _span(event: Column, cuts: Column) -> tuple[Column, Column, Column]:
    """The cuts in an event's span, the bits of its ends, and its three places."""
    start, stop, other = _field(event, 32), _field(event, 26), _field(event, 18)
    low, high = F.least(start, other), F.greatest(stop, other)
    return cuts.bitwiseAND(_bit(high + 1) - _bit(low)), _bit(low).bitwiseOR(_bit(high)), _bit(start).bitwiseOR(_bit(stop)).bitwiseOR(_bit(other))


def _checks(event: Column) -> Column:
    return event.bitwiseAND(F.lit(1 << 24)) != 0


def merge_fold(size: Column, events: Column) -> Column:
    """The cuts of a word as bits, after all merges: the pair with the best piece first, the leftmost of equals.

    Events come in the order of scores and places.  A piece merges if its span has just one
    cut inside; bit 62 is set where a check finds one that could merge after its turn.
    """

    def step(cuts: Column, e: Column) -> Column:
        within, ends, places = _span(e, cuts)
        checked = F.when(within == places, cuts.bitwiseOR(F.lit(1 << 62))).otherwise(cuts)
        merges = (F.bit_count(within) == 3) & (within.bitwiseAND(ends) == ends)
        return F.when(_checks(e), checked).when(merges, cuts - within + ends).otherwise(cuts)

    return F.aggregate(events, _bit(size + 1) - 1, step)


def _merged(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """``words`` with ids; null where one is longer than 48, the fold in order does not hold, or a piece is missing."""
    events, single = merge_events(pieces)
    others = [c for c in words.columns if c != "word"]
    # The empty piece is in every word once and brings the word's other columns.
    known = words.sparkSession.createDataFrame([("", [-1]), *events], "piece string, events array<long>")
    longest = max((len(p) for p, _ in events), default=2)
    size = F.length("word")
    short = size <= NATIVE
    starts = words.select("*", F.explode(F.sequence(F.lit(0), F.when(short, F.greatest(size - 2, F.lit(0))).otherwise(0))).alias("_start"))
    stops = F.sequence(F.when(F.col("_start") == 0, 0).otherwise(F.col("_start") + 2), F.when(short, F.least(size, F.col("_start") + longest)).otherwise(0))
    spans = starts.select("*", F.explode(stops).alias("_stop")).withColumn("piece", F.expr("substring(word, _start + 1, _stop - _start)"))
    # The vocabulary is a fixed file, so its size is bounded whatever the corpus.
    edges = spans.join(F.broadcast(known), "piece").select("word", "_start", F.when(F.col("_stop") == 0, F.struct(F.lit(0).alias("_"), *others)).alias("_others"), F.explode("events").alias("_event"))
    moved = F.when(F.col("_event") >= 0, F.col("_event") + F.col("_start").cast("long") * MOVE)
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(moved)).alias("_events"), F.first("_others", ignorenulls=True).alias("_others"))
    cut = grouped.withColumn("_cuts", merge_fold(size, F.col("_events")))

    def final(e: Column) -> Column:
        within, ends, _ = _span(e, F.col("_cuts"))
        return ~_checks(e) & (within == ends)

    mask = F.lit((1 << 18) - 1).cast("long")
    long = F.transform(F.filter("_events", final), lambda e: _field(e, 32).cast("long") * (1 << 18) + e.bitwiseAND(mask))
    alone = F.filter(F.sequence(F.lit(0), size - 1), lambda p: F.call_function("shiftright", F.col("_cuts"), p).bitwiseAND(F.lit(3)) == 3)
    # Ids of single code points by their place in a text of all of them; 0 is no place.
    ids = F.split(F.lit(",".join(["", *(str(i) for _, i in single)])), ",").try_cast("array<int>")
    place = lambda p: F.call_function("instr", F.lit("".join(c for c, _ in single)), F.col("word").substr(p + 1, F.lit(1)))
    single_ids = F.transform(alone, lambda p: p.cast("long") * (1 << 18) + F.get(ids, place(p)))
    whole = F.transform(F.sort_array(F.concat(long, single_ids)), lambda x: x.bitwiseAND(mask).cast("int"))
    sound = short & (F.col("_cuts") < F.lit(1 << 62)) & ~F.exists(single_ids, lambda x: x.isNull())
    return cut.select("word", *[F.col("_others")[c].alias(c) for c in others], F.when(sound, whole).alias("ids"))


def viterbi_fold(word: Column, edges: Column, unknown: float = -1e6) -> Column:
    """Cuts of the path with the highest sum of scores; a code point that is no piece scores ``unknown``.

    Of equal paths the one whose last piece is longest, then so on towards the start.
    """
    kind = "array<struct<total:double,cuts:array<int>>>"
    first = F.array(F.struct(F.lit(0.0).alias("total"), F.array(F.lit(0)).alias("cuts"))).cast(kind)

    def step(best: Column, stop: Column) -> Column:
        def end(start: Column) -> Column:
            score = F.try_element_at(edges, start.cast("long") * WIDE + stop)["score"]
            score = F.coalesce(score, F.when(start == stop - 1, F.lit(unknown)))
            before = F.get(best, start)
            return F.struct((before["total"] + score).alias("total"), (-start).alias("back"), F.array_append(before["cuts"], stop).alias("cuts"))

        ways = F.filter(F.transform(F.sequence(F.lit(0), stop - 1), end), lambda x: x["total"].isNotNull())
        won = F.array_max(ways)
        return F.array_append(best, F.struct(won["total"].alias("total"), won["cuts"].alias("cuts"))).cast(kind)

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step, lambda best: F.element_at(best, -1)["cuts"])


def _ids_by_heap(first_byte: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merge fold of other words with a heap of pairs, whose work is linear up to a logarithm: (.., word, edges) to (.., ids)."""
    for batch in batches:
        out = []
        for word, entries in zip(batch.column("word").to_pylist(), batch.column("edges").to_pylist(), strict=True):
            edge = {k: (v["score"], v["id"]) for k, v in entries or []}
            n = len(word)
            after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * (n + 1)
            # Symbol i runs from i to after[i].
            heap = [(-edge[i * WIDE + i + 2][0], i, i + 1, i + 2) for i in range(n - 1) if i * WIDE + i + 2 in edge]
            heapq.heapify(heap)
            while heap:
                _, i, middle, stop = heapq.heappop(heap)
                if not (alive[i] and i < n and after[i] == middle and alive[middle] and after[middle] == stop):
                    continue
                alive[middle] = False
                after[i] = stop
                if stop < n:
                    before[stop] = i
                    if (key := i * WIDE + after[stop]) in edge:
                        heapq.heappush(heap, (-edge[key][0], i, stop, after[stop]))
                if before[i] >= 0 and (key := before[i] * WIDE + stop) in edge:
                    heapq.heappush(heap, (-edge[key][0], before[i], i, stop))
            ids, at = [], 0
            while at < n:
                if (key := at * WIDE + after[at]) in edge:
                    ids.append(edge[key][1])
                else:
                    ids += [None if first_byte is None else first_byte + b for b in word[at : after[at]].encode()]
                at = after[at]
            out.append(ids)
        kept = [k for k, c in enumerate(batch.schema.names) if c not in ("edges", "_name")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(out, pa.list_(pa.int32()))], [*(batch.schema.names[k] for k in kept), "ids"])


def encode_words(words: DataFrame, pieces: DataFrame, fold: str = "merge") -> DataFrame:
    """Distinct words (word, other columns) with their ids; a code point without a piece becomes the pieces of its UTF-8 bytes.

    ``fold`` is "merge" for vocabularies whose scores rank merges and "viterbi" for those
    whose scores are log-probabilities.  With "merge" the order of scores is folded in one
    pass.  Words of more than 48 code points, with a code point that is no piece, or with a
    merge out of that order take the steps one by one through a heap.
    """
    words = words.filter(F.length("word") > 0)
    first_byte = pieces.filter("byte = 0").first()
    if fold == "merge":
        held = materialize(_merged(words, pieces), "folded_words")
        # Long words go by a digest: an edge must not hold a copy of its word.
        left = held.filter("ids is null").drop("ids").withColumn("_name", F.sha2("word", 256))
        made = left.join(growing(lattice(left, pieces, "_name")), "_name", "left")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
        slow = made.mapInArrow(partial(_ids_by_heap, first_byte.id if first_byte else None), f"{fields}, ids array<int>")
        return held.filter("ids is not null").unionByName(slow)
    made = words.join(lattice(words, pieces), "word", "left").withColumn("edges", F.coalesce("edges", F.expr("cast(map() as map<bigint, struct<score:double,id:int>>)")))
    cut = made.withColumn("cuts", viterbi_fold(F.col("word"), F.col("edges")))
    base = F.lit(first_byte.id if first_byte else None).cast("int")

    def ids(i: Column) -> Column:
        start, stop = F.get("cuts", i), F.get("cuts", i + 1)
        code = F.hex(F.encode(F.col("word").substr(start + 1, stop - start), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int")), lambda k: F.conv(code.substr((k * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + base)
        known = F.try_element_at("edges", start.cast("long") * WIDE + stop)["id"]
        return F.when(known.isNotNull(), F.array(known)).otherwise(raw)

    return cut.select(*words.columns, F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), ids)).alias("ids"))


class Cutter:
    """Cuts texts between two code points that no piece holds side by side.

    No piece lies across such a place, so what stands on either side is encoded by itself.
    Pairs are looked up by hash: one that is taken for another leaves a cut out, which changes no id.
    """

    def __init__(self, pairs: str):
        """``pairs``: the pairs of neighbours in all pieces, one after another."""
        self.near = np.zeros(1 << PAIRS, bool)
        # A space and the mark are the same, on either side.
        for first, second in [(a, b) for a in (SPACE, " ") for b in (SPACE, " ")]:
            at = np.frombuffer((pairs[::2].replace(SPACE, first) + pairs[1::2].replace(SPACE, second)).encode("utf-32-le"), np.uint32)
            self.near[self._hash(at[: len(at) // 2], at[len(at) // 2 :])] = True

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIRS)

    def _apart(self, points: np.ndarray, most: int = 1 << 17) -> np.ndarray:
        """Whether a text is cut after each code point but the last; few are hashed at a time."""
        out = np.empty(max(len(points) - 1, 0), bool)
        for at in range(0, len(out), most):
            part = points[at : at + most + 1]
            np.logical_not(self.near[self._hash(part[:-1], part[1:])], out=out[at : at + most])
        return out

    def words(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words, bounds): the words of all rows, the space mark as a space, and where each row's words end.

        A text that is not empty has a space before it.
        """
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(*(pa.scalar(x, pa.large_binary()) if isinstance(x, bytes) else x for x in (b" ", column, b""))))
        try:
            points = self._points(data := texts_of(column))
        except UnicodeDecodeError:
            column = pa.array([t.decode(errors="replace").encode() for t in column.to_pylist()], pa.large_binary())
            points = self._points(data := texts_of(column))
        raw, rows = data
        first = np.flatnonzero((raw & 0xC0) != 0x80)
        starts = np.zeros(len(raw) + 1, bool)
        starts[first[1:][self._apart(points)]] = True
        starts[rows] = True
        places = np.flatnonzero(starts)
        words = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw))
        return words, np.searchsorted(places, rows)

    @staticmethod
    def _points(data: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.frombuffer(data[0].tobytes().decode().encode("utf-32-le"), np.uint32)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls, from 0."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def _blocks(batch: pa.RecordBatch, text: str, most: int = 3 << 19) -> Iterator[tuple[int, int, int]]:
    """(block, start, stop) of rows of one block with about ``most`` bytes of text."""
    block = batch.column("_block").to_numpy(zero_copy_only=False)
    _, bounds = texts(batch.column(text))
    ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block))
    start = 0
    for end in ends.tolist():
        for a, b in runs(bounds[start : end + 1], most):
            yield int(block[start]), start + a, start + b
        start = end


def _words_of_blocks(pairs: str, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_block, word): the words of each block of rows, few of them twice."""
    cutter, held, of = Cutter(pairs), [], None

    def handed() -> Iterator[pa.RecordBatch]:
        if held:
            words = pc.replace_substring(pc.unique(pa.concat_arrays(held)), " ", SPACE)
            for at in range(0, len(words), 1 << 16):
                part = words.slice(at, 1 << 16).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), of, np.int64)), part], ["_block", "word"])
            held.clear()

    for batch in batches:
        if not len(batch):
            continue
        for block, start, stop in _blocks(batch, text):
            if block != of or sum(map(len, held)) > HELD:
                yield from handed()
            of = block
            held.append(pc.unique(cutter.words(batch.column(text).slice(start, stop - start))[0]))
    yield from handed()


def _ids_of_rows(pairs: str, text: str, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their ids, from the dictionary of their block."""
    cutter, of = Cutter(pairs), None
    source, base = fs.FileSystem.from_uri(folder)
    for batch in batches:
        if not len(batch):
            continue
        for block, start, stop in _blocks(batch, text):
            part = batch.slice(start, stop - start)
            words, rows = cutter.words(part.column(text))
            if len(words):
                if block != of:
                    table = pq.read_table(f"{base}/_block={block}", columns=["word", "ids"], filesystem=source, partitioning=None).combine_chunks()
                    known = table.column("word").cast(pa.large_string()).combine_chunks()
                    lists = table.column("ids").combine_chunks()
                    first, ids, of = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(), block
                coded = words.dictionary_encode()
                at = pc.index_in(pc.replace_substring(coded.dictionary, " ", SPACE), known)
                if at.null_count:
                    raise ValueError("a word is missing in the dictionary of its block: the rows changed between two readings")
                at = at.to_numpy()[coded.indices.to_numpy()]
                sizes = (first[1:] - first[:-1])[at]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                flat = ids[np.repeat(first[at] - ends[:-1], sizes) + np.arange(ends[-1])]
                bounds = ends[rows]
            else:
                flat, bounds = np.zeros(0, np.int32), np.zeros(len(part) + 1, np.int64)
            made = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            kept = [k for k, c in enumerate(part.schema.names) if c != "_block"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), made], [*(part.schema.names[k] for k in kept), "ids"])


def encode(rows: DataFrame, pieces: DataFrame, key: str, text: str = "text", fold: str = "merge", stored: bool = False) -> DataFrame:
    """``rows`` with their ids; ``key`` is kept as it is and need not tell rows apart.

    A space before the text and each space are the space mark.  A null or empty text has no
    ids.  Each distinct word is encoded once, and its ids go to the dictionary of every block
    of rows that holds it.  The rows are read twice: ``stored`` says that they come straight
    from Parquet files, others are written first.
    """
    rows = rows.select(key, *[c for c in rows.columns if c != key])
    if not stored:
        rows = materialize(rows, "encoded_rows")
    held = rows.withColumn("_block", F.xxhash64("_metadata.file_path", F.shiftright("_metadata.row_index", ROWS)))
    pairs = "".join(sorted({p[i : i + 2] for (p,) in pieces.filter("length(piece) > 1").select("piece").collect() for i in range(len(p) - 1)}))
    seen = held.select("_block", text).mapInArrow(partial(_words_of_blocks, pairs, text), "_block long, word string")
    words = encode_words(seen.groupBy("word").agg(F.collect_set("_block").alias("_blocks")), pieces, fold)
    folder = new_folder(rows.sparkSession, "word_ids")
    words.select(F.explode("_blocks").alias("_block"), "word", "ids").repartition("_block").write.partitionBy("_block").parquet(folder)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return held.mapInArrow(partial(_ids_of_rows, pairs, text, folder), f"{fields}, ids array<int>")


def decoded(ids: Column, pieces: DataFrame) -> Column:
    """The text of ids: pieces and bytes put together again, marks to spaces, without the one before the text.

    Ids that are no piece of the table decode to nothing.  The table is a fixed file, so it
    is one constant array, and each id is looked up by its place.
    """
    plain = F.hex(F.encode(F.replace(F.col("piece"), F.lit(SPACE), F.lit(" ")), "UTF-8"))
    code = dict(pieces.select("id", F.coalesce(plain, F.lpad(F.hex("byte"), 2, "0"))).collect())
    codes = F.split(F.lit(",".join(code.get(i) or "" for i in range(max(code, default=-1) + 1))), ",")
    text = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(codes, i)), "")), "UTF-8")
    return F.coalesce(F.when(text.startswith(" "), text.substr(2, 2147483647)).otherwise(text), F.lit(""))


def decode(rows: DataFrame, pieces: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """(key, text) of rows of ids."""
    return rows.select(key, decoded(F.col(ids), pieces).alias("text"))

"""Jaccard self-join of word-shingle sets: exact partitioning, then signature trees inside bounded groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Forest, PrefixHash, components, discard, growing, materialize, mix, runs, source_columns, texts

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
STEP = np.uint64(0xFF51AFD7ED558CCD)


def shingles(data: np.ndarray, bounds: np.ndarray, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, row, hash) of the distinct shingles, sorted by row and hash, some texts at a time.

    A to Z are lower-cased; words are runs of other bytes than ASCII white space.  A
    text with fewer words than a shingle has one shingle, its whole sequence.
    """
    for lo, hi in runs(bounds):
        part = LOWER[data[bounds[lo] : bounds[hi]]]
        edge = np.zeros(len(part) + 1, bool)
        edge[bounds[lo : hi + 1] - bounds[lo]] = True
        inside = ~SPACE[part]
        start = np.nonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))[0]
        stop = np.nonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]])))[0] + 1
        word = PrefixHash(part).ranges(start, stop)
        row = np.searchsorted(bounds[lo : hi + 1] - bounds[lo], start, "right") - 1
        counts = np.bincount(row, minlength=hi - lo)
        full = np.arange(max(len(word) - words + 1, 0))
        full = full[row[full] == row[full + words - 1]]
        value = np.full(len(full), words, np.uint64)
        for k in range(words):
            value = mix(value * STEP ^ word[full + k])
        rows = row[full]
        short = np.nonzero((counts > 0) & (counts < words))[0]
        if len(short):
            first = np.searchsorted(row, short)
            whole = counts[short].astype(np.uint64)
            for k in range(words - 1):
                has = counts[short] > k
                whole[has] = mix(whole[has] * STEP ^ word[first[has] + k])
            rows, value = np.concatenate([rows, short]), np.concatenate([value, whole])
        order = np.lexsort((value, rows))
        rows, value = rows[order], value[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
        yield lo, hi, rows[fresh], value[fresh]


def size_bounds(percent: int, most: int) -> np.ndarray:
    """First size of each size class; sets that can link are in one class or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def partition_keys(rows: np.ndarray, value: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): two sets that link share a key.

    In size class s two linked sets, one of them of that class, differ in at most h
    elements.  Elements are dealt into h + 1 + z segments by hash, so at least 1 + z
    segments hold the same elements in both.  A key names class, segment and contents.
    Empty segments make no key; a set with more than z of them (few have) makes a
    catch-all key of its class too, so that two such sets still meet.  A set
    takes part in its own class and the one below; a key's last bit tells which of them is odd.
    """
    return _partition(rows, value, n, percent)[:2]


def _partition(rows: np.ndarray, value: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``partition_keys``, and how many keys each set shares with one that it links with, in its even and its odd class.

    Of 1 + z segments that hold the same elements no more can be empty than a set has
    empty ones, so 1 + z less those share a key; 1 where the catch-all key may be all.
    That holds in the class that the smaller of two linked sets is of.
    """
    sizes = np.bincount(rows, minlength=n)
    limits = size_bounds(percent, int(sizes.max(initial=1)) + 1)
    own = np.searchsorted(limits, sizes, "right") - 1
    mixed = mix(value)
    low, high = (mixed & np.uint64((1 << 26) - 1)).astype(np.float64), (mixed >> np.uint64(38)).astype(np.float64)
    place = (mix(mixed ^ STEP) >> np.uint64(33)).astype(np.int64)
    out_rows, out_keys = [], []
    need = np.full((n, 2), np.iinfo(np.int32).max, np.int32)
    for below in (0, 1):
        slot = own - below
        usable = (sizes > 0) & (slot >= 0)
        largest = np.where(usable, limits[np.clip(slot, 0, None) + 1] - 1, 0)
        differ = largest * (100 - percent) // percent
        usable &= differ > 0
        spare = 2 + differ // 6
        segments = np.where(usable, differ + 1 + spare, 0)
        offset = np.concatenate([[0], np.cumsum(segments)])
        take = usable[rows]
        cell = offset[rows[take]] + place[take] % segments[rows[take]]
        total = int(offset[-1])
        count = np.bincount(cell, minlength=total)
        first = np.bincount(cell, low[take], total).astype(np.uint64)
        second = np.bincount(cell, high[take], total).astype(np.uint64)
        owner = np.repeat(np.arange(n), segments)
        number = np.arange(total) - offset[owner]
        name = mix((slot[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1))
        key = mix(mix(first ^ name) + second * STEP)
        filled = count > 0
        empty = segments - np.bincount(owner[filled], minlength=n)
        sparse = np.nonzero(usable & (empty > spare))[0]
        part = np.nonzero(usable)[0]
        need[part, slot[part] & 1] = np.maximum(1 + spare - empty, 1)[part]
        out_rows += [owner[filled], sparse]
        for of, made in ((slot[owner[filled]], key[filled]), (slot[sparse], mix(slot[sparse].astype(np.uint64) + np.uint64(1 << 40)))):
            out_keys.append(made & ~np.uint64(1) | (of & 1).astype(np.uint64))
    return np.concatenate(out_rows), np.concatenate(out_keys), need


def node_of(rows: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each whole set (0 for an empty one)."""
    chained = np.zeros(n, np.uint64)
    np.add.at(chained, rows, mix(value ^ np.uint64(0x5851F42D4C957F2D)))
    sizes = np.bincount(rows, minlength=n)
    return np.where(sizes > 0, mix(chained + sizes.astype(np.uint64)) | np.uint64(1), 0)


def signatures(docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, sha, n_shingles, node, even, odd, keys); equal sets of one task give their keys once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, bounds = texts(batch.column(1))
            for lo, hi, rows, value in shingles(data, bounds, words):
                n = hi - lo
                sizes, node = np.bincount(rows, minlength=n), node_of(rows, value, n)
                owner, key, need = _partition(rows, value, n, percent)
                fresh = np.zeros(n, bool)
                for i, x in enumerate(node.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                keep = fresh[owner]
                owner, key = owner[keep], key[keep]
                order = np.argsort(owner, kind="stable")
                starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(starts), pa.array(key[order].view(np.int64)))
                sha = [hashlib.md5(data[bounds[i] : bounds[i + 1]].tobytes()).digest() for i in range(lo, hi)]
                nodes = pa.array(node.view(np.int64), mask=node == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(sha, pa.binary()), pa.array(sizes.astype(np.int64)), nodes, pa.array(need[:, 0].copy()), pa.array(need[:, 1].copy()), keys], ["doc_id", "sha", "n_shingles", "node", "even", "odd", "keys"])

    rows = source_columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    return rows.mapInArrow(work, "doc_id long, sha binary, n_shingles long, node long, even int, odd int, keys array<long>")


#: Bytes of bitmaps that one side of a tree holds at most, and that one comparison gathers.
BITMAPS, GATHERED = 1 << 24, 1 << 21
#: Node pairs that go down together.
PAIRS = 1 << 14


class SignatureTree:
    """Sets under nodes of four that hold OR-combined bitmaps, size ranges and the most bits lost to collisions."""

    FAN = 4

    def __init__(self, sets: list[np.ndarray], bits: int):
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.order = np.array(order, np.int64)
        self.sets = [sets[i] for i in order]
        size = np.array([len(s) for s in self.sets], np.int64)
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            at = (s >> np.uint64(20)) % np.uint64(bits)
            np.bitwise_or.at(maps[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        lost = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, size, size, lost)]
        while len(self.levels[-1][1]) > 1:
            maps, least, most, lost = self.levels[-1]
            cut = np.arange(0, len(least), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.maximum.reduceat(lost, cut)))


def _possible(one: tuple, two: tuple, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs can hold a linked pair: sizes fit, and the most overlap their bitmaps allow is enough."""
    (a, a_least, a_most, a_lost), (b, b_least, b_most, b_lost) = one, two
    fit = (100 * a_most[x] >= percent * b_least[y]) & (100 * b_most[y] >= percent * a_least[x])
    at = np.nonzero(fit)[0]
    step = max(16, GATHERED // (8 * a.shape[1]))
    for cut in range(0, len(at), step):
        p = at[cut : cut + step]
        overlap = np.bitwise_count(a[x[p]] & b[y[p]]).sum(1).astype(np.int64) + np.minimum(a_lost[x[p]], b_lost[y[p]])
        overlap = np.minimum(overlap, np.minimum(a_most[x[p]], b_most[y[p]]))
        # 100 i >= percent (|A| + |B| - i)
        fit[p] = (100 + percent) * overlap >= percent * (a_least[x[p]] + b_least[y[p]])
    return fit


def dual_traversal(one: SignatureTree, two: SignatureTree, first: np.ndarray, second: np.ndarray, forest: Forest, percent: int) -> None:
    """Join in ``forest`` all linked pairs of the two trees (the same tree twice: each pair once).

    ``first`` and ``second`` are the forest indices of the trees' sets.  Node pairs go
    down together, ``PAIRS`` at a time from a stack; those that cannot hold a link, or
    whose sets are one component already, stop.
    """
    same = one is two
    deep = max(len(one.levels), len(two.levels)) - 1
    if deep <= 1:
        i, j = (c.ravel() for c in np.indices((len(one.sets), len(two.sets))))
        _pairs(one, two, first, second, i, j, forest, percent, same)
        return
    stack = [(deep, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, x, y = stack.pop()
        if level < deep:  # links found meanwhile may have joined them
            good = ~_joined(one, two, first, second, x, y, level, forest)
            x, y = x[good], y[good]
        x, y = _children(one, two, x, y, level, same)
        a = one.levels[min(level - 1, len(one.levels) - 1)]
        b = two.levels[min(level - 1, len(two.levels) - 1)]
        good = _possible(a, b, x, y, percent)
        x, y = x[good], y[good]
        # Near neighbours in order first: their links spare later work.
        near = np.argsort(np.abs(x - y), kind="stable") if same else np.arange(len(x))
        x, y = x[near], y[near]
        if level == 2:
            _leaves(one, two, first, second, x, y, forest, percent, same)
        else:
            stack += [(level - 1, x[at : at + PAIRS], y[at : at + PAIRS]) for at in reversed(range(0, len(x), PAIRS))]


def _children(one, two, x, y, level, same) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes one level down; the shorter tree waits at its root."""
    fan = SignatureTree.FAN
    for tree, which in ((one, 0), (two, 1)):
        if level <= len(tree.levels) - 1:
            count = len(tree.levels[level - 1][1])
            now = (x, y)[which]
            child = (now[:, None] * fan + np.arange(fan)).ravel()
            other = np.repeat((x, y)[1 - which], fan)
            good = child < count
            x, y = (child[good], other[good]) if which == 0 else (other[good], child[good])
    return (x[x <= y], y[x <= y]) if same else (x, y)


def _joined(one, two, first, second, x, y, level, forest) -> np.ndarray:
    """Node pairs of ``level`` whose sets all carry one component label."""
    width = SignatureTree.FAN**level
    ends = []
    for tree, index, node in ((one, first, x), (two, second, y)):
        label = forest.label[index[np.arange(len(index))]]
        cut = np.arange(0, len(label), width) if level < len(tree.levels) else np.zeros(1, np.int64)
        low, high = np.minimum.reduceat(label, cut), np.maximum.reduceat(label, cut)
        ends.append((low[node], high[node]))
    (a, b), (c, d) = ends
    return (a == b) & (c == d) & (a == c)


def _leaves(one, two, first, second, x, y, forest, percent, same) -> None:
    """Go from pairs of lowest nodes to pairs of sets, a growing number at a time, so that early links spare later work."""
    fan, at, step = SignatureTree.FAN, 0, 64
    while at < len(x):
        p, q = x[at : at + step], y[at : at + step]
        good = ~_joined(one, two, first, second, p, q, 1, forest)
        p, q = p[good], q[good]
        offset = np.arange(fan)
        i = (p[:, None, None] * fan + offset[None, :, None] + 0 * offset[None, None, :]).ravel()
        j = (q[:, None, None] * fan + offset[None, None, :] + 0 * offset[None, :, None]).ravel()
        good = (i < len(one.sets)) & (j < len(two.sets))
        _pairs(one, two, first, second, i[good], j[good], forest, percent, same)
        at, step = at + step, min(step * 2, 1 << 14)


def _pairs(one, two, first, second, i, j, forest, percent, same) -> None:
    """Pairs of sets that are not yet joined and may link: the intersection itself decides."""
    good = forest.label[first[i]] != forest.label[second[j]]
    if same:
        good &= i < j
    i, j = i[good], j[good]
    good = _possible(one.levels[0], two.levels[0], i, j, percent)
    at, step = 0, 32
    i, j = i[good], j[good]
    while at < len(i):
        p, q = i[at : at + step], j[at : at + step]
        apart = forest.label[first[p]] != forest.label[second[q]]
        linked = [
            (a, b)
            for a, b in zip(p[apart].tolist(), q[apart].tolist(), strict=True)
            if (100 + percent) * len(np.intersect1d(one.sets[a], two.sets[b], assume_unique=True)) >= percent * (len(one.sets[a]) + len(two.sets[b]))
        ]
        if linked:
            a, b = np.array(linked).T
            forest.join(first[a], second[b])
        at, step = at + step, min(step * 2, 4096)


def _width(sets: list[np.ndarray]) -> int:
    """Bits of a bitmap: about sixteen for each element of the largest set, 1,024 to 65,536, in ``BITMAPS`` bytes for all sets.

    Narrow bitmaps prune less; what they lose to collisions is known, so results are the same.
    """
    wanted = min(1 << 16, 1 << int(16 * max(map(len, sets))).bit_length())
    room = 1 << max(0, (8 * BITMAPS // len(sets)).bit_length() - 1)
    return max(1 << 10, min(wanted, room))


def join_block(table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links in one block: whole small groups, or a pair of parts of a large one."""
    columns = {c: table[c].to_numpy() for c in ("grp", "part", "one", "two", "node")}
    _, distinct = np.unique(np.stack([columns["node"], columns["part"]]), axis=1, return_index=True)
    columns = {c: v[distinct] for c, v in columns.items()}
    values = table["items"].combine_chunks()
    sets = [np.sort(np.asarray(values[int(i)].values).view(np.uint64)) for i in distinct]
    found_a, found_b = [], []
    for group in np.unique(columns["grp"]):
        own = np.nonzero(columns["grp"] == group)[0]
        forest = Forest(len(own))
        bits = _width([sets[k] for k in own])
        one, two = columns["one"][own[0]], columns["two"][own[0]]
        sides = [np.nonzero(columns["part"][own] == part)[0] for part in dict.fromkeys((one, two))]
        trees = [SignatureTree([sets[own[k]] for k in side], bits) for side in sides]
        index = [side[tree.order] for side, tree in zip(sides, trees, strict=True)]
        dual_traversal(trees[0], trees[-1], index[0], index[-1], forest, percent)
        for a, b in forest.edges:
            found_a.append(columns["node"][own[a]])
            found_b.append(columns["node"][own[b]])
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def _hot_keys(keys: DataFrame, share: int, often: int, most: int) -> DataFrame:
    """The keys that a sample of one node in ``share`` holds ``often`` times, as a side for a join."""
    sampled = keys.filter(F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(share)) == 0)
    hot = materialize(sampled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often).select("key"), "hot_keys")
    return F.broadcast(hot) if hot.count() <= most else growing(hot)


def key_neighbours(keys: DataFrame, share: int = 256, often: int = 64, most: int = 100_000) -> DataFrame:
    """(a, b): pairs of nodes that connect all nodes of each key; ``keys``: (node, key).

    Nodes of a key are chained in their order, in one shuffle of (node, key).  A key
    that a sample of one node in ``share`` holds ``often`` times is hot: its nodes are joined
    to their smallest instead, a join that adaptive execution splits.  Hot keys are few
    (one in ``share`` * ``often`` entries at most); up to ``most`` of them are broadcast, more are
    shuffled.
    """
    sent = _hot_keys(keys, share, often, most)
    order = Window.partitionBy("key").orderBy("node")
    chained = keys.join(sent, "key", "left_anti").select("node", F.lag("node").over(order).alias("hub"))
    warm = keys.join(sent, "key")
    hubs = warm.groupBy("key").agg(F.min("node").alias("hub"))
    starred = warm.join(growing(hubs), "key").select("node", "hub")
    return chained.unionByName(starred).filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))


#: Nodes of a key that are paired with each other; a key of more is crowded.
CROWD = 6


def near_neighbours(keys: DataFrame, needs: DataFrame, share: int = 256, often: int = 64, most: int = 100_000) -> DataFrame:
    """(a, b): pairs that connect any two linked nodes; ``keys``: (node, key), ``needs``: (node, even, odd).

    Linked nodes share at least the needed keys of either node, all even or all odd.  As many of them as a node
    has crowded keys may be crowded, so the pair shares the rest among keys of few nodes:
    such pairs are counted.  Where that leaves nothing to count for both nodes, crowded keys
    connect them.  Texts that share a passage have a key or two in common and stay apart.
    """
    sent = _hot_keys(keys, share, often, most)
    order = Window.partitionBy("key").orderBy("node")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    single = keys.join(sent, "key", "left_anti").withColumn("last", F.lag("node").over(order)).filter("last is null or last <> node")
    before = F.array(*[F.lag("node", k).over(order) for k in range(1, CROWD)])
    held = single.select("node", "key", F.count(F.lit(1)).over(whole).alias("n"), before.alias("others")).filter("n > 1")
    few = F.col("n") <= CROWD
    side = F.col("key").bitwiseAND(F.lit(1)).cast("int").alias("side")
    held = held.select("node", side, F.when(~few, F.col("key")).alias("key"), F.when(few, F.filter("others", lambda x: x.isNotNull())).alias("others"))
    held = materialize(held, "shared_keys")
    crowded = held.filter("key is not null").select("node", "key", "side").unionByName(keys.join(sent, "key").select("node", "key", side))
    taken = crowded.groupBy("node", "side").agg(F.count(F.lit(1)).alias("n"))
    both = needs.select("node", F.posexplode(F.array("even", "odd")).alias("side", "need"))
    left = both.join(growing(taken), ["node", "side"], "left").select("node", "side", (F.col("need") - F.coalesce("n", F.lit(0))).alias("left"))
    left = materialize(left, "key_needs")
    pairs = held.select("side", F.col("node").alias("b"), F.explode("others").alias("a")).groupBy("a", "b", "side").agg(F.count(F.lit(1)).alias("n"))
    for end in ("a", "b"):
        pairs = pairs.join(growing(left.withColumnRenamed("node", end)), [end, "side"]).filter(F.col("n") >= F.col("left")).drop("left")
    open_ = crowded.join(growing(left.filter("left <= 0")), ["node", "side"], "left_semi").select("node", "key")
    return pairs.select("a", "b").unionByName(key_neighbours(open_, share, often, most))


def _large_groups(large: DataFrame, work, block: int) -> DataFrame:
    """Links of groups cut into parts: (grp, parts, part, node, items) to pairs (a, b) that connect them.

    Whatever decides which sets meet is told from the narrow columns; items travel
    only to the blocks themselves.
    """
    within = large.select("grp", "part", F.col("part").alias("one"), F.col("part").alias("two"), "node", "items")
    inner = materialize(within.groupBy("grp", "part").applyInArrow(work, "a long, b long"), "inner_links")
    narrow = large.select("grp", "parts", "part", "node", F.size("items").alias("n"))
    # A leader of each part's largest component joins the others', so that dense groups are one component before parts meet.
    label = components(inner)
    labelled = narrow.join(growing(label), "node", "left").withColumn("label", F.coalesce("root", "node"))
    leaders = labelled.groupBy("grp", "part", "label").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("size"))
    main = leaders.groupBy("grp", "part").agg(F.max_by("node", F.struct("size", "node")).alias("node"))
    # Blocks of 500 leaders; the first of each is in the block before too, so that they chain.
    near_blocks = F.array_distinct(F.array(F.floor(F.col("part") / 500), F.floor(F.greatest(F.col("part") - 1, F.lit(0)) / 500)))
    main = materialize(main.select(F.col("grp").alias("_grp"), F.col("node").alias("_node"), F.explode(near_blocks).alias("chain")), "leaders")
    # Nodes are unique; the leaders' table has a known size, so Spark broadcasts or shuffles it by that.
    led = large.join(main, (F.col("node") == F.col("_node")) & (F.col("grp") == F.col("_grp")))
    led = led.select("grp", "chain", F.lit(0).alias("part"), F.lit(0).alias("one"), F.lit(0).alias("two"), "node", "items")
    led = materialize(led.groupBy("grp", "chain").applyInArrow(work, "a long, b long"), "leader_links")
    discard(main, label)
    label = components(inner.unionByName(led))
    now = narrow.join(growing(label), "node", "left").withColumn("label", F.coalesce("root", "node"))
    count = now.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("size"))
    top = count.groupBy(F.col("grp").alias("_grp")).agg(F.max_by("label", F.struct("size", "label")).alias("top"))
    # Sets outside the largest component are parts of their own, as many as their shingles need, numbered after the
    # others: the others meet those parts alone, so each travels as often as there are such parts.
    ranked = now.join(top, F.col("grp") == F.col("_grp")).withColumn("outside", F.col("label") != F.col("top")).drop("_grp")
    needed = ranked.groupBy(F.col("grp").alias("_grp")).agg(F.greatest(F.ceil(F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0)) / block), F.lit(1)).alias("more"))
    own = F.col("parts") + F.pmod(F.xxhash64(F.lit(4), "node"), F.col("more"))
    split = ranked.join(needed, F.col("grp") == F.col("_grp")).withColumn("part", F.when(F.col("outside"), own).otherwise(F.col("part")).cast("int"))
    split = materialize(split.select("grp", "part", "parts", F.col("node").alias("_node")), "large_parts")
    there = split.select("grp", "part", "parts").distinct()
    other = there.select("grp", F.col("part").alias("other"))
    cells = there.join(other, "grp").filter("part < other and other >= parts or part = other and part >= parts")
    sides = cells.select("grp", F.col("part").alias("one"), F.col("other").alias("two"), F.explode(F.array_distinct(F.array("part", "other"))).alias("part"))
    meeting = sides.join(growing(split.drop("parts")), ["grp", "part"])
    across = meeting.join(growing(large.select("node", "items")), F.col("_node") == F.col("node")).groupBy("grp", "one", "two").applyInArrow(work, "a long, b long")
    return inner.unionByName(led).unionByName(materialize(across, "outer_links"))


def membership(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", block: int = 1_000_000
) -> DataFrame:
    """One row for each row: doc_id, sha (MD5 of the text), n_shingles, component_id.

    Two texts link when 100 * |A and B| >= percent * |A or B| over their sets of distinct
    ``words``-word shingles (hashes of 64 bits).  A null text, or one without words, has
    an empty set and links with nothing.  ``component_id`` is the smallest doc_id that
    links reach, null ids aside; a row that links with nothing has its own id.

    1. Equal sets are one node.  Keys that linked sets must share come from the
       pigeonhole rule (``partition_keys``); nodes that share as many as links have
       (``near_neighbours``) form groups, and every link is inside a group.
    2. A group of at most ``block`` shingles is one block; small groups share blocks.  A
       larger one is cut into parts of about that size by hash: parts are joined
       within, and pairs of parts unless both hold one and the same component.  Inside a
       block signature trees are traversed against each other.
    3. The blocks' spanning forests give the components.

    No group, key or pair is capped: every pair of a group is either pruned by a bound,
    joined already, or counted exactly.
    """
    signed = materialize(signatures(docs, words, percent, doc_id, text), "signatures")
    made = materialize(signed.drop("keys"), "shingle_rows")
    needs = made.filter("node is not null").groupBy("node").agg(F.min("even").alias("even"), F.min("odd").alias("odd"))
    groups = components(near_neighbours(signed.select("node", F.explode("keys").alias("key")), needs))
    discard(signed)
    nodes = materialize(made.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sha")).alias("pick")).filter("node is not null"), "shingle_nodes")
    grouped = groups.join(nodes, "node").select("node", F.col("root").alias("grp"), F.col("pick.doc_id").alias("pick_id"), F.col("pick.sha").alias("pick_sha"), "n")
    sizes = grouped.groupBy(F.col("grp").alias("_grp")).agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    wanted = materialize(grouped.join(growing(sizes), F.col("grp") == F.col("_grp")).drop("_grp"), "near_nodes")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column(0))
            want = batch.column(1).to_numpy()
            for lo, hi, rows, value in shingles(data, bounds, words):
                node = node_of(rows, value, hi - lo).view(np.int64)
                starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=hi - lo))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(value.view(np.int64)))
                good = pa.array(node == want[lo:hi])
                yield pa.RecordBatch.from_arrays([c.filter(good) for c in (pa.array(node), *(batch.column(k).slice(lo, hi - lo) for k in (2, 3)), lists)], ["node", "grp", "parts", "items"])

    rows = source_columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    picked = rows.join(growing(wanted), rows.doc_id.eqNullSafe(wanted.pick_id)).select("text", "node", "grp", "parts")
    sets = materialize(picked.mapInArrow(items, "node long, grp long, parts int, items array<long>"), "near_sets")
    discard(groups)
    buckets = max(1, int(wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // (block // 16)))
    small = sets.filter("parts = 1").select(F.pmod(F.xxhash64("grp"), F.lit(buckets)).alias("cell"), "grp", F.lit(0).alias("part"), F.lit(0).alias("one"), F.lit(0).alias("two"), "node", "items")
    work = lambda t: join_block(t, percent)
    edges = materialize(small.groupBy("cell").applyInArrow(work, "a long, b long"), "near_links")
    large = sets.filter("parts > 1").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int"))
    if not large.isEmpty():
        edges = edges.unionByName(_large_groups(large, work, block))
    roots = components(edges)
    smallest = roots.join(nodes, "node").groupBy("root").agg(F.min("least_id").alias("component"))
    decided = materialize(nodes.join(roots, "node", "left").join(smallest, "root", "left").select("node", F.coalesce("component", "least_id").alias("component")), "near_components")
    discard(nodes, wanted, sets, roots)
    joined = made.select("doc_id", "sha", "n_shingles", "node").join(growing(decided), "node", "left")
    return joined.select("doc_id", "sha", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def kept_rows(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those of a component but its smallest id's."""
    found = membership(docs, words, percent, doc_id, text)
    drop = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.lower(F.hex("sha")).alias("_sha")).distinct()
    drop = materialize(drop, "near_dropped")
    marked = docs.select(F.col(doc_id).cast("long").alias("_own_id"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_own_sha"), F.struct("*").alias("_row"))
    return marked.join(growing(drop), marked["_own_id"].eqNullSafe(drop["_id"]) & (marked["_own_sha"] == drop["_sha"]), "left_anti").select("_row.*")

"""Similarity within groups and against reference sets, without all-pairs joins."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequences as sq
from ..functions.hashing import hash_hex, hex_int
from ..session import ensure_checkpoint_dir
from . import tiles
from .ranks import hash_ordinal


def kmer_code(kmer: Column, k: int) -> Column:
    """A k-mer of upper-case letters packed into one bigint, five bits a letter."""
    if k > 12:
        raise ValueError("k-mers longer than 12 do not fit a bigint")
    code = F.lit(0).cast("bigint")
    for i in range(1, k + 1):
        code = code * 32 + (F.ascii(F.substring(kmer, i, 1)) - 64)
    # Other characters would share a code with some letters.
    return F.when(kmer.rlike("[^A-Z]"), F.raise_error(F.concat(F.lit("a k-mer has other characters than A-Z: "), kmer))).otherwise(code)


def kmer_vectors(df: DataFrame, keys: list[str], column: str, k: int) -> DataFrame:
    """One row per (keys, k-mer): code, count in the row, and rows that carry it."""
    exploded = df.select(*keys, F.explode(sq.kmers(column, k)).alias("_kmer"))
    counted = exploded.select(*keys, kmer_code(F.col("_kmer"), k).alias("code")).groupBy(*keys, "code").agg(
        F.count(F.lit(1)).cast("int").alias("c")
    )
    frequency = counted.groupBy("code").agg(F.count(F.lit(1)).alias("f"))
    return counted.join(frequency, "code")


# Within-group penalties

def _penalty(similarity: Column, threshold: float) -> Column:
    return F.when(similarity > threshold, (similarity - F.lit(threshold)) / F.lit(1.0 - threshold)).otherwise(F.lit(0.0))


def _distinct_members(df: DataFrame, group: str, column: str) -> DataFrame:
    """Copies are maximally similar to each other, so one row stands for all of them."""
    return df.groupBy(group, F.col(column).alias("_seq")).agg(F.count(F.lit(1)).alias("_n"))


def _hamming_cells(left: np.ndarray, right: np.ndarray, left_sizes: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """Equal positions over the longer length, for every row of ``left`` with every row of ``right``."""
    matches = (left[:, None, :] == right[None, :, :]).sum(axis=2, dtype=np.int32)
    return matches / np.maximum(np.maximum(left_sizes[:, None], right_sizes[None, :]), 1)


def _padded(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, pad: int) -> np.ndarray:
    """The first ``width`` characters of each sequence, one a row; shorter ones end in ``pad``."""
    at = np.arange(width)[None, :]
    inside = at < sizes[:, None]
    return np.where(inside, codes[np.where(inside, starts[:, None] + at, 0)], codes.dtype.type(pad))


def _best_hamming(sequences: list[str], spaces: np.ndarray, lead: np.ndarray, other: np.ndarray, threshold: float, cells: int = 1 << 22) -> np.ndarray:
    """The highest Hamming similarity of each sequence to another of its space, between rows of ``lead`` and of ``other``.

    Above the threshold t the shorter of two sequences has more than t of the longer
    one's length, so each only meets those of near lengths; what lies below stays 0
    or is some lower similarity.  About ``cells`` characters are compared at a time.
    """
    sizes = np.array([len(s) for s in sequences], np.int64)
    # Two codes are kept for padding, one a side.
    codes = np.frombuffer("".join(sequences).encode("utf-32-le"), np.uint32).astype(np.int64) + 2
    codes = codes.astype(np.uint8 if codes.max(initial=0) < 256 else np.uint32)
    starts = np.cumsum(sizes) - sizes
    best = np.zeros(len(sequences))
    order = np.lexsort((sizes, spaces))
    ends = np.append(np.flatnonzero(np.diff(spaces[order])) + 1, len(order))
    for lo, hi in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
        group = order[lo:hi]
        a, b = group[lead[group] & (sizes[group] > 0)], group[other[group] & (sizes[group] > 0)]
        near, at = sizes[b], 0
        while at < len(a) and len(b):
            least = int(sizes[a[at]])
            stop = int(np.searchsorted(sizes[a], least + least // 8 + 2, "right"))
            widest = int(sizes[a[stop - 1]])
            first = int(np.searchsorted(near, math.floor(least * threshold - 1e-9), "left"))
            last = int(np.searchsorted(near, math.ceil(widest / threshold + 1e-9), "right")) if threshold > 0 else len(b)
            stop = min(stop, at + max(1, cells // max(1, (last - first) * widest)))
            width = int(sizes[a[stop - 1]])
            mine, theirs = a[at:stop], b[first:last]
            if len(theirs):
                found = _hamming_cells(_padded(codes, starts[mine], sizes[mine], width, 0), _padded(codes, starts[theirs], sizes[theirs], width, 1), sizes[mine], sizes[theirs])
                found[mine[:, None] == theirs[None, :]] = 0.0
                best[mine] = np.maximum(best[mine], found.max(axis=1))
                best[theirs] = np.maximum(best[theirs], found.max(axis=0))
            at = stop
    return best


def _best_kmers(sequences: list[str], spaces: np.ndarray, lead: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """The highest k-mer cosine of each sequence to another of its space, between rows of ``lead`` and of ``other``."""
    vectors = tiles.kmer_counts(sequences, k, spaces)
    norms = np.sqrt(np.bincount(vectors.rows(), vectors.counts**2, len(sequences)))
    norms[norms == 0] = 1.0
    left, right = np.flatnonzero(lead), np.flatnonzero(other)
    best = np.zeros(len(sequences))
    for start, stop, dots in tiles.overlaps(vectors.take(lead), vectors.take(other)):
        cosine = dots / (norms[left[start:stop], None] * norms[None, right])
        cosine[left[start:stop, None] == right[None, :]] = 0.0
        best[left[start:stop]] = np.maximum(best[left[start:stop]], cosine.max(axis=1))
        best[right] = np.maximum(best[right], cosine.max(axis=0))
    return best


def _nearest_in_tiles(members: DataFrame, group: str, threshold: float, shortest: int, nearest: Callable[..., np.ndarray]) -> DataFrame:
    """(group, sequence, similarity): the highest similarity to another row, where it is above the threshold.

    Groups of up to a block's size are gathered, several to a tile; larger ones are
    cut into blocks, and every pair of blocks is a tile of its own, so that a group
    with a third of all rows spreads over as many tasks as it needs.  A tile hands
    on one row for each member above the threshold.  A copy counts as similarity 1
    from ``shortest`` characters on, where a sequence is similar to itself.
    """
    # The counts stay in use, so that this reads the tiles' own shuffle of members again instead of one without them.
    weight = F.when(F.col("_n") > 0, F.length("_seq").cast("long"))
    totals = members.groupBy(group).agg(F.sum(weight).alias("_sum"))
    small = totals.agg(F.coalesce(F.sum(F.when(F.col("_sum") <= tiles.BLOCK, F.col("_sum"))), F.lit(0).cast("long")).alias("small")).scalar()
    # At most one row for each block's worth of letters.
    large = totals.filter(F.col("_sum") > tiles.BLOCK).select(group, F.ceil(F.col("_sum") / tiles.BLOCK).cast("long").alias("_blocks"))
    # Of small groups about a block's worth shares a tile; of a large one every pair of blocks makes one.
    bucket = F.pmod(F.xxhash64(group), F.when(F.col("_blocks") == 1, F.floor(small / tiles.BLOCK) + 1).otherwise(F.lit(1 << 62)))
    placed = members.join(F.broadcast(large), group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long")))
    placed = placed.withColumn("_bucket", bucket).withColumn("_block", F.pmod(F.xxhash64("_seq"), F.col("_blocks")))
    dealt = placed.select(group, "_seq", (F.col("_n") > 1).alias("_copied"), "_bucket", "_blocks", "_block", tiles.every_block(F.col("_blocks")).alias("_other"))
    dealt = dealt.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).drop("_other")

    def work(table: pa.Table) -> pa.Table:
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        space = table.column(group).combine_chunks().field(0).dictionary_encode("encode").indices.to_numpy()
        block = table.column("_block").to_numpy()
        best = nearest(table.column("_seq").to_pylist(), space, block == i, block == j)
        same = table.column("_copied").to_numpy() & (pc.utf8_length(table.column("_seq")).to_numpy() >= shortest)
        best[same] = 1.0
        return pa.table({group: table.column(group), "_seq": table.column("_seq"), "_s": pa.array(best)}).filter(pa.array(best > threshold))

    schema = T.StructType([members.schema[group], members.schema["_seq"], T.StructField("_s", T.DoubleType())])
    return dealt.groupBy("_bucket", "_blocks", "_i", "_j").applyInArrow(work, schema)


def diversity_penalty(
    df: DataFrame, group: str, column: str = "sequence", sim: str = "hamming", threshold: float = 0.7, k: int = 2
) -> DataFrame:
    """Add ``penalty``: how far the highest similarity to another row of the
    group exceeds the threshold, scaled to [0, 1]."""
    if sim not in ("hamming", "dipeptide"):
        raise ValueError("sim must be 'hamming' or 'dipeptide'")
    # A struct of the group equals itself when the group is NULL; a NULL sequence has no similarity and no penalty.
    keyed = df.withColumn("_group", F.struct(F.col(group).alias("g")))
    group = "_group"
    members = _distinct_members(keyed.filter(F.col(column).isNotNull()), group, column)
    nearest = functools.partial(_best_hamming, threshold=threshold) if sim == "hamming" else functools.partial(_best_kmers, k=k)
    near = _nearest_in_tiles(members, group, threshold, 1 if sim == "hamming" else k, nearest)
    found = near.groupBy(group, "_seq").agg(F.max("_s").alias("_s"))
    # Only members above the threshold come back.
    highest = found.select(group, F.col("_seq").alias(column), "_s")
    penalty = F.when(F.col(column).isNotNull(), _penalty(F.coalesce("_s", F.lit(0.0)), threshold))
    return keyed.join(highest, [group, column], "left").select(*df.columns, penalty.alias("penalty"))


# Sampled pairs

def mean_pairwise(
    df: DataFrame, group: str, key: str, column: str = "sequence", max_pairs: int = 2000, seed: int = 42, sim: str = "dipeptide"
) -> DataFrame:
    """Mean similarity over at most ``max_pairs`` random pairs per group.

    Pair numbers are drawn, decoded to two member numbers and joined, so the
    work is bounded by the sample and no pair outside it is formed.
    """
    keyed = df.select(F.struct(F.col(group).alias("g")).alias("_group"), key, column)
    outer, group = group, "_group"  # a struct of the group equals itself when the group is NULL
    members = hash_ordinal(keyed, key, seed, by=[group], name="_i").withColumn("_i", F.col("_i") - 1)
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    totals = sizes.withColumn("_pairs", F.expr("_n * (_n - 1) div 2"))
    few = F.col("_pairs") <= 4 * max_pairs
    # Small groups enumerate their pairs; large ones draw twice what is needed and drop repeats.
    slots = totals.withColumn(
        "_d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(few, F.col("_pairs") - 1).otherwise(2 * max_pairs - 1)))
    )
    draw = hex_int(hash_hex(f"{seed}:pair", F.col("_group.g"), "_d"), 15)
    numbered = slots.withColumn("_p", F.when(few, F.col("_d")).otherwise(F.pmod(draw, F.col("_pairs")))).withColumn(
        "_o", F.when(few, draw).otherwise(F.col("_d"))
    )
    distinct = numbered.groupBy(group, "_p").agg(F.min("_o").alias("_o"))
    # At most 4 * max_pairs rows per group reach this ranking.
    ranked = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_o", "_p"))).filter(
        F.col("_r") <= max_pairs
    )
    guess = F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(8.0) * F.col("_p"))) / 2).cast("bigint")

    def first_of(j: Column) -> Column:
        return F.when(j % 2 == 0, F.floor(j / 2) * (j - 1)).otherwise(j * F.floor((j - 1) / 2)).cast("bigint")

    settled = F.when(first_of(guess) > F.col("_p"), guess - 1).when(first_of(guess + 1) <= F.col("_p"), guess + 1).otherwise(guess)
    decoded = ranked.withColumn("_j", settled).withColumn("_i", F.col("_p") - first_of(F.col("_j")))
    left = members.select(group, "_i", F.col(column).alias("_a"))
    right = members.select(group, F.col("_i").alias("_j"), F.col(column).alias("_b"))
    measure = sq.dipeptide_cosine("_a", "_b") if sim == "dipeptide" else sq.hamming_similarity("_a", "_b")
    scored = decoded.join(left, [group, "_i"]).join(right, [group, "_j"]).select(group, measure.alias("_s"))
    averaged = scored.groupBy(group).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("_s").alias("mean_similarity"))
    return averaged.select(F.col("_group.g").alias(outer), "n_pairs", "mean_similarity")


# Vectors

def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _small_matrix(df: DataFrame, column: str, limit: int) -> np.ndarray | None:
    """The vectors as a matrix, or None when there are more than ``limit`` rows."""
    rows = df.select(column).limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return np.array([r[0] for r in rows], dtype=np.float64)


def ad_penalty(
    df: DataFrame, negatives: DataFrame, column: str = "embedding", key: str = "id", threshold: float = 0.15, limit: int = 20000,
    pivots: int = 64,
) -> DataFrame:
    """Add ``penalty`` = clip(1 - d / threshold, 0, 1) for the cosine distance d
    to the nearest reference vector.

    Up to ``limit`` reference vectors are counted, shipped once and multiplied
    in the tasks.  More than that are cut into blocks by cell and angle around pivots;
    by the triangle inequality on angles a row only visits blocks that can hold a
    vector within the threshold, which keeps the result exact.
    """
    small = _small_matrix(negatives, column, limit)
    if small is not None:
        if not len(small):
            return df.withColumn("penalty", F.lit(0.0))
        shared = df.sparkSession.sparkContext.broadcast(unit_rows(small))

        @F.pandas_udf("double")
        def penalty(vectors: pd.Series) -> pd.Series:
            rows = unit_rows(np.stack(vectors.to_numpy()).astype(np.float64))
            nearest = np.concatenate([(rows[i : i + 1024] @ shared.value.T).max(axis=1) for i in range(0, len(rows), 1024)])
            return pd.Series(np.clip(1.0 - (1.0 - nearest) / threshold, 0.0, 1.0))

        return df.withColumn("penalty", penalty(F.col(column)))
    return _ad_penalty_cells(df, negatives, column, key, threshold, pivots)


def _ad_penalty_cells(df: DataFrame, negatives: DataFrame, column: str, key: str, threshold: float, pivots: int, block: int = 1 << 21) -> DataFrame:
    """Rows against blocks of references that may be in reach, in tiles of about ``block`` numbers a side.

    A tile is one matrix product and hands on one number a row, so no pair leaves it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    reference = negatives.select(F.col(column).alias("_r")).distinct()
    hashed = reference.orderBy(F.md5(F.col("_r").cast("string"))).limit(pivots)
    centres = unit_rows(np.array([r[0] for r in hashed.collect()], dtype=np.float64))
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def angles(vectors: pd.Series) -> np.ndarray:
        rows = unit_rows(np.stack(vectors.to_numpy()).astype(np.float64))
        return np.arccos(np.clip(rows @ shared.value.T, -1.0, 1.0))

    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest_cell(vectors: pd.Series) -> pd.DataFrame:
        a = angles(vectors)
        cell = a.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "angle": a[np.arange(len(a)), cell]})

    placed = reference.withColumn("_c", nearest_cell("_r")).select("_r", F.col("_c.cell").alias("cell"), F.col("_c.angle").alias("angle"), F.size("_r").alias("_w"))
    numbered, _ = tiles.numbered_blocks(placed, ["cell", "angle"], "_w", block)
    # Counted along the whole order, so that their number does not follow the partitions.
    blocks = numbered.withColumn("block", F.floor(F.col("ordinal") / max(1, block // centres.shape[-1])))
    # A block holds a run of angles in one cell or in a few: a row for each of them, about one a block and one a pivot.
    spans = blocks.groupBy("block", "cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()
    of, cell, lo, hi = (np.array([r[n] for r in spans]) for n in ("block", "cell", "lo", "hi"))
    reach = math.acos(max(-1.0, 1.0 - threshold)) + 1e-6

    @F.pandas_udf("array<long>")
    def blocks_in_reach(vectors: pd.Series) -> pd.Series:
        a = angles(vectors)[:, cell]
        hit = (a >= lo - reach) & (a <= hi + reach)
        return pd.Series([np.unique(of[h]) for h in hit])

    weight = df.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    n_chunks = int(weight) // block + 1
    none = F.lit(None)
    queries = df.select(
        F.col(key).alias("_key"), F.col(column).cast("array<double>").alias("_p"), F.lit(False).alias("_known"), F.pmod(F.xxhash64(key), F.lit(n_chunks)).alias("_i"), F.explode(blocks_in_reach(F.col(column))).alias("_j")
    )
    points = blocks.select(none.cast(df.schema[key].dataType).alias("_key"), F.col("_r").cast("array<double>").alias("_p"), F.lit(True).alias("_known"), tiles.every_block(n_chunks).alias("_i"), F.col("block").alias("_j"))

    def work(table: pa.Table) -> pa.Table:
        side = table.column("_known").to_numpy()
        left, right = table.filter(pa.array(~side)), table.filter(pa.array(side))
        matrix = lambda t: unit_rows(np.stack(t.column("_p").combine_chunks().to_numpy(zero_copy_only=False)))
        found = [np.zeros(0)]
        if len(left) and len(right):
            rows, known = matrix(left), matrix(right).T
            step = max(1, (1 << 22) // known.shape[1])
            found += [(rows[i : i + step] @ known).max(axis=1) for i in range(0, len(rows), step)]
        best = np.concatenate(found)
        return pa.table({"_key": left.column("_key").slice(0, len(best)), "_s": pa.array(best)})

    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("_s", T.DoubleType())])
    near = queries.unionByName(points).groupBy("_i", "_j").applyInArrow(work, schema)
    best = near.groupBy(F.col("_key").alias(key)).agg(F.max("_s").alias("_s"))
    joined = df.join(best, key, "left")
    return joined.withColumn("penalty", F.coalesce(sq.clip01(F.lit(1.0) - (F.lit(1.0) - F.col("_s")) / F.lit(threshold)), F.lit(0.0))).drop("_s")


def group_means(df: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """Mean vector per group, aggregated map-side on whole vectors."""
    mean = Summarizer.mean(array_to_vector(F.col(column).cast("array<double>")))
    return df.groupBy(group).agg(vector_to_array(mean).alias(column))


def mean_pool(tokens: DataFrame, key: str, position: str = "pos", length: str = "length", column: str = "vector") -> DataFrame:
    """Mean of residue vectors; position 0 and those past the length are marks, not residues."""
    inside = tokens.filter((F.col(position) >= 1) & (F.col(position) <= F.col(length)))
    return group_means(inside, key, column)


def _nearest_points(rows: np.ndarray, points: np.ndarray, numbers: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(position, squared distance) of the point nearest to each row; the first of equally near ones.

    Differences are squared and summed as they are, about ``numbers`` at a time, so that a
    distance does not depend on what else is compared.
    """
    at, least = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    wide = max(1, min(len(points), numbers // max(1, rows.shape[1] if rows.ndim == 2 else 1)))
    for first in range(0, len(points), wide):
        part = points[first : first + wide]
        step = max(1, numbers // max(1, part.size))
        for start in range(0, len(rows), step):
            own = slice(start, start + step)
            distance = ((rows[own, None, :] - part[None, :, :]) ** 2).sum(axis=2)
            best = distance.argmin(axis=1)
            found = distance[np.arange(len(best)), best]
            closer = found < least[own]
            at[own], least[own] = np.where(closer, best + first, at[own]), np.where(closer, found, least[own])
    return at, least


def assign_clusters(
    df: DataFrame, centroids: DataFrame, cluster: str = "cluster_id", column: str = "embedding", block: int = 1 << 20
):
    """Nearest stored centroid by squared distance; the lowest id wins ties.

    Centroids are cut into blocks of about ``block`` numbers.  Every distinct vector
    meets every block in a tile of bounded size, and a combining aggregate keeps the
    nearest, so any number of centroids works.  NULL or empty vectors get no cluster;
    repeated centroid ids are an error.
    """
    ensure_checkpoint_dir(df.sparkSession)
    known = centroids.select(F.col(cluster).cast("int").alias("_c"), F.col(column).cast("array<double>").alias("_p")).withColumn("_w", F.size("_p"))
    numbered, n_blocks = tiles.numbered_blocks(known, ["_c"], "_w", block)
    same = numbered.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or _c is null").limit(1).collect()
    if not n_blocks or same:
        raise ValueError("expected centroids with one row for each cluster")
    vectors = df.select(F.col(column).cast("array<double>").alias("_v")).filter(F.size("_v") > 0).distinct()
    # As many vectors to a tile as make about a block.
    weight = vectors.agg(F.coalesce(F.sum(F.size("_v")), F.lit(0))).first()[0]
    n_chunks = int(weight) // block + 1
    rows = vectors.select(F.lit(False).alias("_known"), F.lit(None).cast("int").alias("_c"), F.col("_v").alias("_p"), F.pmod(F.xxhash64("_v"), F.lit(n_chunks)).alias("_i"), tiles.every_block(n_blocks).alias("_j"))
    points = numbered.select(F.lit(True).alias("_known"), "_c", "_p", tiles.every_block(n_chunks).alias("_i"), F.col("block").alias("_j"))

    def work(table: pa.Table) -> pa.Table:
        side = table.column("_known").to_numpy()
        left, right = table.filter(pa.array(~side)), table.filter(pa.array(side)).sort_by("_c")
        if not len(left) or not len(right):
            return pa.table({"_v": pa.array([], pa.list_(pa.float64())), "_d": pa.array([], pa.float64()), "_c": pa.array([], pa.int32())})
        matrix = lambda t: np.stack(t.column("_p").combine_chunks().to_numpy(zero_copy_only=False))
        at, least = _nearest_points(matrix(left), matrix(right))
        return pa.table({"_v": left.column("_p"), "_d": pa.array(least), "_c": right.column("_c").take(pa.array(at))})

    near = rows.unionByName(points).groupBy("_i", "_j").applyInArrow(work, "_v array<double>, _d double, _c int")
    best = near.groupBy("_v").agg(F.min(F.struct("_d", "_c")).alias("_best")).select("_v", F.col("_best._c").alias(cluster))
    keyed = df.drop(cluster).withColumn("_v", F.col(column).cast("array<double>"))
    return keyed.join(best, "_v", "left").select(*[c for c in df.columns if c != cluster], cluster)

"""Helpers shared by the text operators: shared scratch tables, byte views of Arrow strings, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCAL_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` (or the context's checkpoint folder) names it.  Only a
    single-machine session without one gets a temporary folder; a cluster must name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in LOCAL_SCRATCH:
        LOCAL_SCRATCH[application] = "file://" + tempfile.mkdtemp(prefix="pepspark-scratch-")
    return LOCAL_SCRATCH[application]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, executors may go."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that only written tables were made from.

    Spark deletes the shuffle files of a finished job once the driver's JVM has
    collected its plan; collecting now spares the executors' disks for the next one.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def growing(df: DataFrame) -> DataFrame:
    """A join side that grows with the data: it is shuffled at every size, never broadcast."""
    return df.hint("merge")


def source_columns(df: DataFrame, **renamed: str | Column) -> DataFrame:
    """Exactly the named inputs, under the operator's own names; other columns cannot clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in renamed.items()])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def runs(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer text is a range of its own."""
    n, at = len(bounds) - 1, 0
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    return _mixed(x.astype(np.uint64, copy=True))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class PrefixHash:
    """Hashes of any range of a buffer of bytes, or of 64-bit hashes, in constant time (polynomial, modulo 2**64)."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    #: Powers up to here stay between buffers; a longer buffer makes its own, which go with it.
    KEPT = 1 << 20
    _tables: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers, self.inverses = self._powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((PrefixHash.VALUES[data] if data.dtype == np.uint8 else data) * powers[:n], out=self.sums[1:])

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls._tables is not None and len(cls._tables[0]) > n:
            return cls._tables
        made = []
        for base in (cls.BASE, cls.INVERSE):
            steps = np.full(max(n + 1, 1 << 16), np.uint64(base))
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n <= cls.KEPT:
            cls._tables = (made[0], made[1])
        return made[0], made[1]

    def every(self, size: int) -> np.ndarray:
        """The values of all ranges of one size, by where they start."""
        value = self.sums[size:] - self.sums[:-size]
        value *= self.inverses[: len(value)]
        value ^= mix(np.array([size], np.uint64))
        return _mixed(value)

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """One well-mixed 64-bit value for each range; the length takes part."""
        value = (self.sums[stop] - self.sums[start]) * self.inverses[start]
        return mix(value ^ mix((stop - start).astype(np.uint64)))


def train_rows(key: str, modulus: int, held: int) -> Column:
    """True where crc32 of ``key`` as text leaves another remainder than ``held``."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(-1)) != held


def bounded_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows for each value of ``by``, the first in hash order of ``key``.

    The window sees about ``most`` rows of each value, as hashes above the expected
    place are dropped first.
    """
    place = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1 << 30))
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    near = rows.withColumn("_place", place).join(sizes, by)
    near = near.filter(F.col("_place") * F.col("_size") <= F.lit(float(most) * 1.2 * (1 << 30)))
    order = Window.partitionBy(by).orderBy("_place", key)
    return near.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= most).drop("_place", "_size", "_nth")


class Forest:
    """Sets of indices, joined many pairs at a time; ``edges`` are the pairs that joined two sets."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        a, b = self.label[p], self.label[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        _, first = np.unique(np.minimum(a, b) * len(self.label) + np.maximum(a, b), return_index=True)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for k in first.tolist():
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.edges.append((int(p[k]), int(q[k])))
        to = np.arange(len(self.label))
        for x in parent:
            to[x] = find(x)
        self.label = to[self.label]


#: Edges that one task may hold: two ids each, 16 MB in all.
MOST_EDGES = 1 << 20


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of a bounded edge table: roots hook to lower neighbours, then paths are halved."""
    held = [batch for batch in batches if len(batch)]
    if not held:
        return
    ends = [np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in (0, 1)]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    p, q = at[: len(ends[0])], at[len(ends[0]) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): one root for each connected set of the nodes in ``edges`` (a, b: long).

    Every round each node moves to the neighbour with the smallest hash under the
    round's own order, and the edges move along, so a chain loses a constant share of
    its nodes however its ids run.  Aggregates combine before they shuffle; joins read
    written tables, so adaptive execution can split a hub's rows.  Once at most
    ``MOST_EDGES`` edges are left one task finishes them, which takes less than a round.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, seed = None, 0
    while edges.count() > MOST_EDGES:
        if labels is None:
            both = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            labels = materialize(both.select("node", F.col("node").alias("root")), "labels")
        seed += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("place"), F.col(c).alias("id"))  # noqa: E731, B023
        arcs = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), order("b").alias("to")), F.struct(F.col("b").alias("node"), order("a").alias("to")))).alias("x")).select("x.*")
        steps = arcs.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least(F.col("to"), order("node"))["id"].alias("to"))
        steps = materialize(steps, "steps")
        moved = labels.join(steps, labels.root == steps.node, "left").select(labels.node, F.coalesce(steps["to"], labels.root).alias("root"))
        before = (labels, edges, steps)
        labels = materialize(moved, "labels")
        left = edges.join(steps, edges.a == steps.node).select(F.col("to").alias("a"), "b")
        left = left.join(steps, left.b == steps.node).select("a", F.col("to").alias("b"))
        edges = materialize(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(*before)
    last = materialize(edges.repartition(1).mapInArrow(_roots, "node long, root long"), "labels")
    discard(edges)
    if labels is None:
        return last
    ends = last.select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    found = materialize(labels.join(growing(ends), labels.root == ends["_from"], "left").select("node", F.coalesce("_to", "root").alias("root")), "labels")
    discard(labels, last)
    return found

"""Near-duplicate vectors: int8 tile products with error bounds, full precision only where the bound leaves a doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, discard, growing, materialize

SLACK = 1e-5  # covers single-precision products of codes and the rounding of the bounds


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector, kind): the components as doubles and a key of the exact vector.

    ``kind`` and ``vector`` are null for vectors that link with nothing: null, empty, all
    zero, or with a null or non-finite component.  Equal vectors share a kind.
    """
    vector = F.col(embedding).cast("array<double>")
    good = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    clean = F.transform(vector, lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are one value
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), clean).alias("vector")).select(
        "vec_id", "vector", F.when(F.col("vector").isNotNull(), F.md5(F.array_join(F.col("vector").cast("array<string>"), ","))).alias("kind")
    )


def _unit(block: np.ndarray) -> np.ndarray:
    scaled = block / np.abs(block).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def quantize(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the decoded vector, distance from it) of unit vectors."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.sqrt((decoded**2).sum(1)), np.sqrt(((unit - decoded) ** 2).sum(1))


def compare(left: np.ndarray, right: np.ndarray, least: float, strip: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine >= ``least``, a strip of ``left`` at a time.

    For unit x, y with decoded x', y': |<x,y> - <x',y'>| <= |x-x'| |y| + |x'| |y-y'|.  A
    pair whose bound stays below ``least`` is out; every other pair is computed again
    in double precision from the vectors themselves.
    """
    x, y = _unit(left), _unit(right)
    (a, sa, na, ea), (b, sb, _, eb) = quantize(x), quantize(y)
    codes = b.astype(np.float32).T.copy()
    with np.errstate(over="ignore"):
        norms = [np.sqrt((v * v).sum(1)) for v in (left, right)]
    for at in range(0, len(a), strip):
        rows = slice(at, at + strip)
        product = a[rows].astype(np.float32) @ codes
        product *= sa[rows, None].astype(np.float32)
        product *= sb[None].astype(np.float32)
        product += (ea[rows, None] + SLACK).astype(np.float32)
        product += (na[rows].max() * eb[None]).astype(np.float32)
        i, j = np.nonzero(product >= least - 1e-6)
        if len(i):
            i = i + at
            for cut in range(0, len(i), 1 << 16):
                p, q = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    lengths = norms[0][p] * norms[1][q]
                    cosine = (left[p] * right[q]).sum(1) / lengths
                odd = ~np.isfinite(cosine) | ~np.isfinite(lengths) | (norms[0][p] < 1e-140) | (norms[1][q] < 1e-140)  # out of range: from the scaled vectors
                if odd.any():
                    cosine[odd] = (x[p[odd]] * y[q[odd]]).sum(1)
                good = cosine >= least
                yield p[good], q[good]


def near_duplicates(vectors: DataFrame, least: float = 0.9, tile: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Equal vectors are one class with a weight, so copies are counted, never paired.
    Classes are dealt into tiles of about ``tile`` by hash, and every pair of tiles is one
    group of bounded size: two tiles.  It returns each class's number of links in that
    pair (weights of the linked classes) and a spanning forest of its links, so what is
    shuffled grows with vectors, not with links.  All pairs of one length of vector are
    compared; vectors of different lengths, and invalid ones, are not linked.
    ``component_id`` is the smallest id reachable, null ids aside (null if all are);
    ``kept`` is whether that is the row's own id.
    """
    rows = materialize(classes(vectors, vec_id, embedding), "vectors")
    known = rows.filter("kind is not null").groupBy("kind").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    known = materialize(known.withColumns({"node": F.xxhash64("kind"), "dim": F.size("vector")}), "vector_classes")
    counts = {r.dim: r.n for r in known.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    tiles = F.lit(1)
    for dim, n in counts.items():
        tiles = F.when(F.col("dim") == dim, F.lit(-(-n // tile))).otherwise(tiles)
    placed = known.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.col("node"), F.col("tiles")))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "dim", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "node", "weight", "vector"
    )

    def work(group: pa.Table) -> pa.Table:
        one, two = group["one"][0].as_py(), group["two"][0].as_py()
        dim = group["dim"][0].as_py()
        where = group["tile"].to_numpy()
        node, weight = group["node"].to_numpy(), group["weight"].to_numpy()
        matrix = group["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        left, right = np.nonzero(where == one)[0], np.nonzero(where == two)[0]
        links = np.zeros(len(node), np.int64)
        forest = Forest(len(node))
        for i, j in compare(matrix[left], matrix[right], least):
            p, q = left[i], right[j]
            if one == two:
                p, q = p[p < q], q[p < q]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            forest.join(p, q)
        a, b = (np.array([e[k] for e in forest.edges], np.int64) for k in (0, 1))
        linked = np.nonzero(links)[0]
        return pa.table(
            {
                "node": pa.array(np.concatenate([node[linked], node[a]])),
                "to": pa.array(np.concatenate([np.zeros(len(linked), np.int64), node[b]])),
                "n": pa.array(np.concatenate([links[linked], np.zeros(len(a), np.int64)])),
            }
        )

    found = materialize(pairs.groupBy("dim", "one", "two").applyInArrow(work, "node long, to long, n long"), "vector_links")
    links = found.filter("n > 0").groupBy("node").agg(F.sum("n").alias("links"))
    roots = components(found.filter("n = 0").select(F.col("node").alias("a"), F.col("to").alias("b")))
    smallest = known.join(roots, "node").groupBy("root").agg(F.min("least_id").alias("root_id"))
    own = known.join(links, "node", "left").join(roots.join(smallest, "root"), "node", "left")
    decided = materialize(own.select("kind", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root_id", "least_id").alias("component")), "vector_groups")
    discard(known, found, roots)
    component = F.when(F.col("kind").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return (
        rows.select("vec_id", "kind")
        .join(growing(decided), "kind", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
    )

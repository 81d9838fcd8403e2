"""Global and per-group positions without funnelling a group through one task.

A plain ``row_number`` or running sum over a big group sorts that group in one
task.  Here rows first fall into buckets that respect the order (a hash prefix,
or a slice between quantiles of a sketch).  Windows run inside buckets; only
the small table of bucket totals is ever scanned in order per group.  Buckets
are pure functions of the data, so recomputed branches always agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_hex


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the left side's keys stay."""
    other = right.withColumnsRenamed({k: f"_same_{i}" for i, k in enumerate(keys)})
    equal = [F.col(k).eqNullSafe(F.col(f"_same_{i}")) for i, k in enumerate(keys)]
    return left.join(other, equal, how).drop(*[f"_same_{i}" for i in range(len(keys))])


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of ``row``, an ungrouped aggregate, to every row.

    Such an aggregate has exactly one row by construction, which is what makes
    the broadcast safe at any table size.
    """
    return df.join(F.broadcast(row))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    descending_buckets: bool = False,
) -> DataFrame:
    """Add inclusive running sums per ``by`` group in (bucket, order) order."""
    keys = [*by, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()])
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    before = (
        Window.partitionBy(*by)
        .orderBy(F.desc(bucket) if descending_buckets else F.asc(bucket))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums]
    )
    # Buckets of many groups are no small table: written sizes are far below what the driver would hold of them.
    joined = join_same(local, offsets.hint("merge") if by else offsets, keys)
    kept = [c for c in df.columns]
    return joined.select(*kept, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums])


def hash_ordinal(
    df: DataFrame, key: str, seed, by: Sequence[str] = (), name: str = "ordinal", digits: int = 3
) -> DataFrame:
    """Number rows 1..n per group in seeded-hash order of ``key``.

    ``digits`` hex digits make 16**digits buckets per group; the bucket table
    stays bounded while each bucket window holds 1/16**digits of its group.
    """
    hashed = df.withColumn("_hash", hash_hex(seed, key)).withColumn("_bucket", F.substring("_hash", 1, digits))
    ranked = running_totals(hashed, by, "_bucket", [F.col("_hash"), F.col(key)], {name: F.lit(1).cast("bigint")})
    return ranked.drop("_hash", "_bucket")


def value_sketch(df: DataFrame, value: str, by: Sequence[str] = (), rows: int = 1 << 16, per_bucket: int = 16) -> DataFrame:
    """(by, _bounds): sorted values that cut a group's rows into slices of about ``rows``.

    A sketch by hash threshold: of a group with n rows the values stay whose hash is
    below a share of ``per_bucket`` in ``rows``, and every ``per_bucket``-th of them in order is a
    bound.  What stays depends on the values alone, so sketches of parts merge by union
    and every recomputation gives the same bounds.  A slice is off by about one part in
    the root of ``per_bucket``.  The number of bounds follows n; groups of up to
    ``rows`` rows have none.
    """
    every = max(1, rows // per_bucket)
    sampled = F.pmod(F.xxhash64(F.lit(7), F.col(value)), F.lit(every)) == 0
    sizes = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.when(sampled, F.col(value)))).alias("_sample")
    )
    picked = F.filter("_sample", lambda x, i: (i + 1) % per_bucket == 0)
    none = F.filter("_sample", lambda x: F.lit(False))
    return sizes.select(*by, F.when(F.col("_n") > rows, picked).otherwise(none).alias("_bounds"))


def _bounds_below(value: Column, bounds: Column) -> Column:
    """How many of the sorted ``bounds`` lie below ``value``, by bisection inside the row."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    useful = F.filter(steps, lambda s: s <= F.size(bounds))
    search = F.aggregate(useful, F.lit(0), lambda found, s: found + F.when(F.get(bounds, found + s - 1) < value, s).otherwise(F.lit(0)))
    return F.when(F.size(bounds) == 0, F.lit(0)).otherwise(search)


def value_bucket(df: DataFrame, value: str, by: Sequence[str] = (), rows: int = 1 << 16) -> DataFrame:
    """Add ``_bucket``: the slice of ``value`` in its group, by order, each of about ``rows`` rows.

    ``df`` has each value once a group, as counts do; however values lie (one far
    outlier, most in a narrow range), slices hold equal numbers of rows, and the
    number of slices follows the number of rows.
    """
    sketch = value_sketch(df, value, by, rows)
    placed = join_same(df, sketch, list(by)) if by else attach_row(df, sketch)
    return placed.withColumn("_bucket", _bounds_below(F.col(value), F.col("_bounds"))).drop("_bounds")


def exact_quantiles(df: DataFrame, value: str, probabilities: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per entry of ``probabilities``.

    Equal values collapse first; positions come from bucketed running counts, so
    neither a group nor its set of distinct values has to fit in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(value_bucket(counts, value, by), by, "_bucket", [F.col(value)], {"_upto": F.col("_n")})
    if by:
        sized = join_same(placed, counts.groupBy(*by).agg(F.sum("_n").alias("_total")), list(by))
    else:
        sized = attach_row(placed, counts.agg(F.sum("_n").alias("_total")))
    aggregates, results = [], []
    for name, p in probabilities.items():
        position = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        aggregates += [
            F.min(F.when(F.col("_upto") > low, F.col(value))).cast("double").alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > high, F.col(value))).cast("double").alias(f"_hi_{name}"),
            F.min(position - low).alias(f"_at_{name}"),
        ]
        lo, hi, at = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_at_{name}")
        results.append((lo + (hi - lo) * at).alias(name))
    return sized.groupBy(*by).agg(*aggregates).select(*by, *results)

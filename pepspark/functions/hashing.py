"""Seeded hashes: the only source of randomness in the package.

Every sample, split and shuffle orders or buckets rows by the md5 of a seed
and a key, so results do not depend on partitioning or on task retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed, *parts) -> Column:
    """md5 hex of ``seed:part:part...``; parts are column names or columns."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def hex_int(hex_column: Column, digits: int = 8) -> Column:
    """The first ``digits`` (at most 15) hex digits as a bigint."""
    return F.conv(F.substring(hex_column, 1, digits), 16, 10).cast("bigint")


def hash_unit(seed, *parts) -> Column:
    """A uniform double in [0, 1)."""
    return hex_int(hash_hex(seed, *parts)) / F.lit(4294967296.0)

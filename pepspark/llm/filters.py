"""How quality filters interact: what every filter removes at every step of every order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import growing, materialize, source_columns, texts

CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"


def text_failures(raw: bytes, points: int) -> int:
    """Failure conditions A to D of a UTF-8 text of ``points`` code points, as bits from the lowest.

    A: under 50 words.  B: distinct words under 65 % of words.  C: over 5 % of code
    points are A-Z.  D: holds one of ``#$%&*|``.  Words are separated by ASCII white
    space; an empty text fails A alone.
    """
    words = raw.split()
    few = len(words) < 50
    repeated = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * points
    marked = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | repeated << 1 | loud << 2 | marked << 3


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, stop): ranks of the orders that remove a document at that step.

    Orders of n filters are ranked lexicographically.  A document that fails the
    filters of ``mask`` goes at step s of an order when its first s - 1 filters lie
    outside the mask and the s-th inside.  All orders with one such prefix are
    neighbours: the Lehmer digits of the prefix give the first rank, and (n - s)!
    orders share it.  Intervals that touch are joined.
    """
    found: list[tuple[int, int, int, int]] = []
    for mask in range(1, 1 << n):
        outside = [f for f in range(n) if not mask >> f & 1]
        for step in range(1, len(outside) + 2):
            starts = []
            for prefix in permutations(outside, step - 1):
                for last in (f for f in range(n) if mask >> f & 1):
                    path, left, rank = (*prefix, last), list(range(n)), 0
                    for place, f in enumerate(path):
                        rank += left.index(f) * factorial(n - 1 - place)
                        left.remove(f)
                    starts.append(rank)
            width, spans = factorial(n - step), []
            for start in sorted(starts):
                if spans and spans[-1][1] == start:
                    spans[-1][1] = start + width
                else:
                    spans.append([start, start + width])
            found += [(mask, step, a, b) for a, b in spans]
    return found


def fail_masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail.

    Bits of the mask are A to E from the lowest; E: the text equals that of a smaller
    id.  Texts are named by SHA-256; copies of one row are counted, not gathered, and
    the smallest id of a text is joined on text and id together, so that a text that
    a third of all rows share is no hot join key.  A null id neither fails E nor makes
    another text fail it.  Of repeated label rows, one that says 1 is enough.
    """
    rows = source_columns(docs, doc_id=F.col(f"`{doc_id}`").cast("long"), text=F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), part=F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column(1))
            raw, points = data.tobytes(), pc.utf8_length(batch.column(1)).to_pylist()
            digests, masks = [], []
            for k, (start, stop) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                whole = raw[start:stop]
                digests.append(hashlib.sha256(whole).digest())
                masks.append(text_failures(whole, points[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], ["doc_id", "part", "digest", "mask"])

    rows = rows.mapInArrow(work, "doc_id long, part string, digest binary, mask int")
    # A null id is replaced by a hash of the text, so that null rows do not meet in one task.
    rows = rows.select("part", "digest", "mask", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.xxhash64("digest")).alias("id"))
    rows = rows.groupBy("digest", "id", "known", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = rows.filter("known").groupBy("digest").agg(F.min("id").alias("id")).select("digest", "id", F.lit(True).alias("known"), F.lit(True).alias("first"))
    marks = source_columns(labels, id=F.col("doc_id").cast("long"), quality="quality", toxic="toxic").filter("id is not null")
    marks = marks.groupBy("id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.withColumn("known", F.lit(True))
    rows = rows.join(growing(first), ["digest", "id", "known"], "left").join(growing(marks), ["id", "known"], "left")
    again = F.col("known") & F.col("first").isNull()
    return rows.groupBy("part", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
    )


def interactions(masks: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step; see ``audit``.

    Counts of a mask are added at the ends of its rank intervals only; prefix sums over
    the ranks then give what every order removes at every step.  ``masks`` has at most
    2**n rows a part, and the joined tables below depend on n alone (at most six
    filters), so both may be broadcast.
    """
    n = len(letters)
    if not 1 <= n <= 6:
        raise ValueError(f"between one and six filters, not {n}")
    spark = masks.sparkSession
    counts = ("n", "good", "toxic")
    spans = F.broadcast(spark.createDataFrame(removal_intervals(n), "mask int, step int, start int, stop int"))
    orders = F.broadcast(
        spark.createDataFrame(
            [("".join(order), rank, step + 1, f, letters.index(f)) for rank, order in enumerate(permutations(letters)) for step, f in enumerate(order)],
            "filter_order string, rank int, step int, filter string, bit int",
        )
    )
    ends = F.explode(F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign"))))
    events = masks.join(spans, "mask").select("part", "step", *counts, ends.alias("e"))
    events = events.select("part", "step", "e.rank", *[(F.col(c) * F.col("e.sign")).alias(c) for c in counts])
    # Every cell of the grid has an event, if only of nothing.
    parts = masks.groupBy("part").agg(F.sum("n").alias("rows"))
    cells = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"))
    events = events.unionByName(cells.select("*", *[F.lit(0).cast("long").alias(c) for c in counts]))
    events = events.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in counts]).filter(F.col("rank") < factorial(n))
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = events.select("part", "step", "rank", F.sum("n").over(along).alias("removed"), F.sum("good").over(along).alias("good_lost"), F.sum("toxic").over(along).alias("toxic_lost"))
    bits = F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), F.lit(1 << k).alias("flag")) for k in range(n)]))
    per_filter = masks.select("part", "mask", "n", bits.alias("b")).select("part", "mask", "n", "b.*")
    held = F.col("mask").bitwiseAND(F.col("flag")) != 0
    alone = F.col("mask") == F.col("flag")
    per_filter = per_filter.groupBy("part", "bit").agg(F.sum(F.when(held, F.col("n")).otherwise(0)).alias("fails"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("unique_fails"))
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    table = removed.join(orders, ["rank", "step"]).join(per_filter, ["part", "bit"]).join(parts, "part")
    return table.select(
        "part",
        "filter_order",
        "step",
        "filter",
        (F.col("rows") - F.sum("removed").over(steps)).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Counts of documents for each part, order of the five filters and step.

    (part, filter_order, step, filter, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley).  ``removed`` go at this step, ``kept`` are left after it;
    ``redundant`` fail its filter but went before; ``unique_fails`` fail no other
    filter; ``shapley`` sums what the filter removes over all orders.  A null text is
    empty, a null part the empty string, each repeated row counts; no documents, no rows.
    """
    return interactions(materialize(fail_masks(docs, labels, doc_id, text, part), "fail_masks"))

"""Length-matched negatives, fragments, seeded splits, weights and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_hex, hash_unit, hex_int
from ..functions.sequences import let
from .ranks import attach_row, hash_ordinal, join_same, running_totals

# Hex cut points of an 80 / 10 / 10 split.
TRAIN_BELOW = "cccccccc"
VALIDATION_BELOW = "e6666666"


def length_counts(df: DataFrame, column: str = "sequence", name: str = "n_target") -> DataFrame:
    return df.groupBy(F.length(column).alias("length")).agg(F.count(F.lit(1)).alias(name))


def _ranked_pool(pool: DataFrame, targets: DataFrame, key: str, seed: int) -> DataFrame:
    ranked = hash_ordinal(pool.withColumn("length", F.length("sequence")), key, seed, by=["length"], name="_rank")
    return ranked.join(targets, "length", "left").withColumn(
        "_taken", F.col("_rank") <= F.coalesce(F.col("n_target"), F.lit(0))
    )


def match_lengths(pool: DataFrame, target: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """Pool rows sampled without replacement so that length counts match ``target``."""
    ranked = _ranked_pool(pool, length_counts(target), key, seed)
    return ranked.filter("_taken").select(*pool.columns, "length")


def length_deficits(pool: DataFrame, target: DataFrame) -> DataFrame:
    """Targets, rows available and rows still missing per length."""
    available = length_counts(pool, name="n_available")
    joined = length_counts(target).join(available, "length", "left")
    return joined.select(
        "length",
        "n_target",
        F.coalesce("n_available", F.lit(0)).alias("n_available"),
        F.greatest(F.col("n_target") - F.coalesce("n_available", F.lit(0)), F.lit(0)).alias("n_missing"),
    )


def fragment_fill(pool: DataFrame, target: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """Fragments of unused longer rows for every length the pool cannot supply.

    Unused rows are numbered from longest to shortest, so the rows long enough
    for length L are a prefix of that numbering and slot k of length L reads
    number (offset + k) modulo the prefix size: an equi-join on one integer.
    Lengths with no long enough row yield nothing (see ``fragment_shortfall``).
    """
    targets = length_counts(target)
    surplus = _ranked_pool(pool, targets, key, seed).filter(~F.col("_taken")).select(
        F.col(key), "sequence", "length"
    )

    # Numbering: rows in longer lengths first, then hash order inside a length.
    sizes = surplus.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    deficits = length_deficits(pool, target).filter("n_missing > 0").select("length", "n_missing")
    # Both tables hold one row per distinct length, so ordering them is cheap.
    longer_first = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    lengths = (
        sizes.join(deficits, "length", "full")
        .select("length", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"))
        .withColumn("eligible", F.sum("n").over(longer_first))
        .withColumn("slot_offset", F.sum("n_missing").over(longer_first) - F.col("n_missing"))
    )
    starts = lengths.select("length", (F.col("eligible") - F.col("n")).alias("_before"))
    numbered = (
        hash_ordinal(surplus, key, f"{seed}:surplus", by=["length"], name="_n")
        .join(starts, "length")
        .select((F.col("_before") + F.col("_n") - 1).alias("ordinal"), F.col(key).alias("_src"), "sequence", "length")
    )

    # Slots are generated in chunks so that one large deficit spreads over tasks.
    chunk = 65536
    slots = (
        lengths.filter("n_missing > 0 and eligible > 0")
        .select(
            F.col("length").alias("frag_length"),
            "eligible",
            "slot_offset",
            "n_missing",
            F.explode(F.sequence(F.lit(0), F.col("n_missing") - 1, F.lit(chunk).cast("bigint"))).alias("_from"),
        )
        .repartition("frag_length", "_from")
        .select(
            "frag_length",
            "eligible",
            "slot_offset",
            F.explode(
                F.sequence(F.col("_from"), F.least(F.col("_from") + (chunk - 1), F.col("n_missing") - 1))
            ).alias("slot"),
        )
        .withColumn("ordinal", F.pmod(F.col("slot_offset") + F.col("slot"), F.col("eligible")))
    )
    draw = hex_int(hash_hex(seed, "frag_length", "slot"), 7)
    # Both sides grow with the data: neither is broadcast.
    cut = slots.join(numbered.hint("merge"), "ordinal").withColumn(
        "start", F.pmod(draw, (F.col("length") - F.col("frag_length") + 1).cast("bigint"))
    )
    return cut.select(
        F.concat(
            F.col("_src").cast("string"), F.lit(":frag"), F.col("start"), F.lit("-"), F.col("start") + F.col("frag_length")
        ).alias("source_id"),
        F.substring(F.col("sequence"), (F.col("start") + 1).cast("int"), F.col("frag_length")).alias("sequence"),
        F.col("frag_length").alias("length"),
        "slot",
    )


def fragment_shortfall(pool: DataFrame, target: DataFrame, fragments: DataFrame) -> DataFrame:
    """Per length: rows still missing after cutting fragments."""
    made = fragments.groupBy("length").agg(F.count(F.lit(1)).alias("n_made"))
    return (
        length_deficits(pool, target)
        .filter("n_missing > 0")
        .join(made, "length", "left")
        .select(
            "length",
            "n_missing",
            F.coalesce("n_made", F.lit(0)).alias("n_made"),
            (F.col("n_missing") - F.coalesce("n_made", F.lit(0))).alias("shortfall"),
        )
    )


def fragment_clean(fragments: DataFrame, direct: DataFrame, positives: DataFrame) -> DataFrame:
    """First copy of each fragment that is neither a direct match nor a positive."""
    order = F.struct(-F.col("length"), F.col("slot"))
    whole = F.struct(*[F.col(c) for c in fragments.columns])
    first = fragments.groupBy("sequence").agg(F.min_by(whole, order).alias("_row")).select("_row.*")
    return first.join(direct.select("sequence").hint("merge"), "sequence", "left_anti").join(
        positives.select("sequence").hint("merge"), "sequence", "left_anti"
    )


def length_matched_dataset(positives: DataFrame, pool: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """Labelled set: positives, direct matches and cleaned fragments in one plan."""
    direct = match_lengths(pool, positives, key, seed)
    fragments = fragment_clean(fragment_fill(pool, positives, key, seed), direct, positives)
    parts = [
        (positives.withColumn("length", F.length("sequence")), key, 1, "positive"),
        (direct, key, 0, "direct"),
        (fragments, "source_id", 0, "fragment"),
    ]
    result = None
    for df, id_column, label, origin in parts:
        rows = df.select(
            "sequence",
            F.col("length").alias("sequence_length"),
            F.lit(label).alias("label"),
            F.lit(origin).alias("origin"),
            F.col(id_column).cast("string").alias("source_id"),
        )
        result = rows if result is None else result.unionByName(rows)
    return result


# Splits

def random_split(df: DataFrame, key: str, fraction: float = 0.9, seed: int = 42) -> DataFrame:
    """'train' or 'val' by the hash of the key; map-only."""
    return df.withColumn("split", F.when(hash_unit(seed, key) < fraction, F.lit("train")).otherwise(F.lit("val")))


def bucket_split(df: DataFrame, key: str, seed: int = 42):
    """'train' / 'val' / 'test' 80/10/10 by the hash of the key; map-only."""
    head = F.substring(hash_hex(seed, key), 1, 8)
    label = (
        F.when(head < TRAIN_BELOW, F.lit("train")).when(head < VALIDATION_BELOW, F.lit("val")).otherwise(F.lit("test"))
    )
    return df.withColumn("split", label)


# Weights and draws

def temper_weights(df: DataFrame, by: str = "organism", key: str = "sequence", alpha: float = 0.5) -> DataFrame:
    """Distinct (group, key) rows, each weighted so that group totals follow p ** alpha."""
    distinct = df.select(by, key).distinct()
    counts = distinct.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    # One row per group, so these totals are over a small table.
    tempered = counts.withColumn("_p", F.pow(F.col("n") / F.sum("n").over(everything), F.lit(alpha))).withColumn(
        "group_weight", F.col("_p") / F.sum("_p").over(everything)
    )
    return join_same(distinct, tempered, [by]).select(
        by, key, "group_weight", (F.col("group_weight") / F.col("n")).alias("sample_weight")
    )


#: A weight counts in units of the largest over 2**40; a draw is one of 2**52 points.
WEIGHT_BITS, POINT_BITS = 40, 52


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` independent draws with replacement, proportional to ``weight``.

    Weights are whole numbers of units, so their prefix sums are exact: an interval
    begins where the last ended, the last one ends at the total, and every draw falls
    into exactly one, however skewed the weights.  Draws and intervals meet in
    about ``n`` cells of equal width, so finding an interval is an equi-join on the
    cell and a bounds check in whole numbers.  NULL, negative and vanishing weights
    are never drawn.
    """
    exact = "decimal(38,0)"
    largest = df.agg(F.max(F.col(weight).cast("double")).alias("_max"))
    units = F.floor(F.col(weight).cast("double") / F.col("_max") * F.lit(float(1 << WEIGHT_BITS)) + F.lit(0.5))
    known = attach_row(df.filter(F.col(weight) > 0), largest).withColumn("_units", units.cast(exact)).filter("_units > 0")
    hashed = known.withColumn("_hash", hash_hex(f"{seed}:order", key)).withColumn("_bucket", F.substring("_hash", 1, 3))
    summed = running_totals(hashed, [], "_bucket", [F.col("_hash"), F.col(key)], {"_upto": F.col("_units")})
    total = known.agg(F.sum("_units").cast(exact).alias("_total"))
    upto = F.col("_upto").cast(exact)
    placed = attach_row(summed, total).withColumn("_to", upto).withColumn("_from", (upto - F.col("_units")).cast(exact))
    bits = min(POINT_BITS - 12, max(0, (n - 1).bit_length()))
    cells = placed.withColumn("_cell", F.explode(F.expr(f"sequence((_from * {1 << bits}) div _total, (_to * {1 << bits} - 1) div _total)")))
    point = hex_int(hash_hex(f"{seed}:draw", "draw"), POINT_BITS // 4)
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("_point", point)
    draws = draws.withColumn("_cell", F.shiftright("_point", POINT_BITS - bits)).withColumn("_point", F.col("_point").cast("decimal(16,0)"))
    inside = F.expr(f"_point * _total >= _from * {1 << POINT_BITS} and _point * _total < _to * {1 << POINT_BITS}")
    return cells.join(draws, "_cell").filter(inside).select("draw", *df.columns)


def poisson_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """A map-side draw count per row, Poisson with mean n * weight / total.

    The size is n on average.  A Poisson count is the sum of counts of equal parts of
    its mean, so each row draws parts of a mean of at most 16 by inversion and adds
    them; at any mean the law is the same.
    """
    total = df.agg(F.sum(F.col(weight).cast("double")).alias("_total"))

    def walked(mean: Column, u: Column) -> Column:
        """Inverse of the cumulative distribution, term by term."""
        start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("upto"), F.lit(0).cast("bigint").alias("k"))

        def step(s: Column, i: Column, point: Column) -> Column:
            term = s["term"] * mean / i
            return F.struct(
                term.alias("term"), (s["upto"] + term).alias("upto"), F.when(point >= s["upto"], s["k"] + 1).otherwise(s["k"]).alias("k")
            )

        # Beyond 80 terms the rest of a mean of 16 is below a double's resolution.
        steps = F.sequence(F.lit(1), F.lit(80))
        return let(u, lambda point: F.aggregate(steps, start, lambda s, i: step(s, i, point), lambda s: s["k"]))

    mean = F.lit(float(n)) * F.col(weight) / F.col("_total")
    parts = let(mean, lambda m: F.greatest(F.ceil(m / 16), F.lit(1)))

    def part(at: Column) -> Column:
        return walked(mean / parts, F.when(at == 0, hash_unit(f"{seed}:u", key)).otherwise(hash_unit(f"{seed}:u", key, at)))

    each = F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), part)
    count = F.aggregate(each, F.lit(0).cast("bigint"), lambda s, c: s + c)
    return attach_row(df, total).withColumn("n_draws", count).drop("_total")

"""Normalizing, filtering, deduplicating and combining sequence tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequences as sq
from ..functions.hashing import hash_unit
from ..session import ensure_checkpoint_dir
from .ranks import join_same
from .tiles import numbered_blocks

# Reasons given for rejected rows.
EMPTY = "empty sequence"
NONSTANDARD = "contains non-standard amino acid characters"
TOO_SHORT = "below {lo}aa — outside the model's training length range"
TOO_LONG = "above {hi}aa — outside the model's training length range"
# Fixed value: the warning on short valid rows.
LOW_CONFIDENCE = (
    "LOW CONFIDENCE: sequence is under {cut}aa. External validation measured sensitivity as low as 31% in this "
    "length range (likely an ESM2 mean-pooling effect, not a training data gap)."
)


# Schema helpers

def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The table itself, or an error that lists what is missing and present."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; actual columns: {df.columns}")
    return df


def resolve_column(df: DataFrame, candidates: Sequence[str], name: str = "sequence") -> DataFrame:
    """Rename the first candidate that exists to ``name``."""
    for candidate in candidates:
        if candidate in df.columns:
            return df if candidate == name else df.withColumnRenamed(candidate, name)
    raise ValueError(f"none of {list(candidates)} found; actual columns: {df.columns}")


def feature_columns(columns: Sequence[str], kind: str = "biophysical") -> list[str]:
    """Feature names by prefix: 'biophysical', 'embedding' or 'combined'."""
    biophysical = [c for c in columns if c.startswith(("frac_", "modlamp_", "ss_")) or c == "gravy"]
    embedding = [c for c in columns if c.startswith("esm2_")]
    return {"biophysical": biophysical, "embedding": embedding, "combined": biophysical + embedding}[kind]


# Projections and filters

def drop_blank(df: DataFrame, column: str = "sequence") -> DataFrame:
    """Drop NULL and blank rows; the text 'NAN' is an ordinary sequence."""
    return df.filter(F.length(sq.stripped(column)) > 0)


def normalize(df: DataFrame, column: str = "sequence") -> DataFrame:
    """Flags on the raw text, then the upper-cased sequence and its length."""
    raw = sq.stripped(column)
    return (
        df.withColumn("had_lowercase", sq.has_lowercase(raw))
        .withColumn(column, F.upper(raw))
        .withColumn("sequence_length", F.length(column))
        .withColumn("has_nonstandard_char", sq.has_nonstandard(column))
    )


def length_window(df: DataFrame, lo: int, hi: int, column: str = "sequence") -> DataFrame:
    return df.filter(F.length(column).between(lo, hi))


def length_window_report(df: DataFrame, lo: int, hi: int, column: str = "sequence") -> DataFrame:
    size = F.length(column)
    return df.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(size < lo).alias("removed_below"),
        F.count_if(size > hi).alias("removed_above"),
        F.count_if(size.between(lo, hi)).alias("n_after"),
    )


def validate(
    df: DataFrame, lo: int = 5, hi: int = 100, column: str = "sequence", on_invalid: str = "keep"
) -> DataFrame:
    """Normalized sequence, length, first failing reason, and ``valid``."""
    # Every test below, and whatever reads the result, refers to the text: it is trimmed once.
    text = sq.once(F.coalesce(sq.normalized(column), F.lit("")))
    size = F.length(column)
    reason = (
        F.when(size == 0, F.lit(EMPTY))
        .when(sq.has_nonstandard(column), F.lit(NONSTANDARD))
        .when(size < lo, F.lit(TOO_SHORT.format(lo=lo)))
        .when(size > hi, F.lit(TOO_LONG.format(hi=hi)))
        .otherwise(F.lit(""))
    )
    checked = (
        df.withColumn(column, text)
        .withColumn("length", size)
        .withColumn("invalid_reason", reason)
        # The same tests, the cheap ones first.
        .withColumn("valid", (size > 0) & size.between(lo, hi) & ~sq.has_nonstandard(column))
    )
    if on_invalid not in ("keep", "drop"):
        raise ValueError("on_invalid must be 'keep' or 'drop'")
    return checked if on_invalid == "keep" else checked.filter("valid")


def confidence_note(df: DataFrame, cut: int = 15) -> DataFrame:
    low = F.col("valid") & (F.col("length") < cut)
    return df.withColumn("confidence_note", F.when(low, F.lit(LOW_CONFIDENCE.format(cut=cut))).otherwise(""))


def apply_threshold(
    df: DataFrame, threshold: float, probability: str = "probability", positive: str = "AMP", negative: str = "non-AMP"
) -> DataFrame:
    """Class text from a probability; NULL probabilities get the empty label."""
    label = (
        F.when(F.col(probability).isNull(), F.lit(""))
        .when(F.col(probability) >= threshold, F.lit(positive))
        .otherwise(F.lit(negative))
    )
    return df.withColumn("prediction", label)


def apply_thresholds(long_df: DataFrame, config: DataFrame) -> DataFrame:
    """Per-task thresholds from ``config(task, threshold)``; unknown tasks fail."""
    joined = long_df.join(config.select("task", "threshold"), "task", "left")
    checked = F.when(
        F.col("threshold").isNull(), F.raise_error(F.concat(F.lit("no threshold for task "), F.col("task")))
    ).otherwise((F.col("prob") >= F.col("threshold")).cast("int"))
    return joined.withColumn("pred", checked.cast("int"))


def exclude_terms(
    df: DataFrame,
    keywords: Sequence[str],
    go_terms: Sequence[str],
    keyword_column: str = "keyword",
    go_column: str = "go_id",
    separator: str = r";\s*",
) -> DataFrame:
    """Drop records that carry any listed keyword or GO term."""

    def carries(column: str, terms: Sequence[str]) -> Column:
        if not terms:
            return F.lit(False)
        listed = F.array(*[F.lit(t) for t in terms])
        return F.coalesce(F.arrays_overlap(F.split(F.col(column), separator), listed), F.lit(False))

    return df.filter(~carries(keyword_column, keywords) & ~carries(go_column, go_terms))


def duplicate_evidence(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Largest and mean absolute difference for each (dropped, kept) pair, in one pass."""
    aggregates = []
    for i, (drop, keep) in enumerate(pairs):
        difference = F.abs(F.col(drop) - F.col(keep)).cast("double")
        aggregates += [F.max(difference).alias(f"max_{i}"), F.avg(difference).alias(f"mean_{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(drop).alias("dropped"),
                F.lit(keep).alias("kept"),
                F.col(f"max_{i}").alias("max_abs_diff"),
                F.col(f"mean_{i}").alias("mean_abs_diff"),
            )
            for i, (drop, keep) in enumerate(pairs)
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))


def prune_duplicates(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.drop(*[drop for drop, _ in pairs])


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], distinct_key: str | None = None) -> DataFrame:
    """Rows left after each cumulative step, then distinct keys among the survivors."""
    passed = F.lit(True)
    aggregates = [F.count(F.lit(1)).alias("n_0")]
    names = ["all"]
    for name, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
        aggregates.append(F.count_if(passed).alias(f"n_{len(names)}"))
        names.append(name)
    if distinct_key:
        aggregates.append(F.count_distinct(F.when(passed, F.col(distinct_key))).alias(f"n_{len(names)}"))
        names.append("distinct")
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("step"), F.col(f"n_{i}").alias("n_rows"))
            for i, name in enumerate(names)
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))


def errors(df: DataFrame, kind: str = "fn", y: str = "y", pred: str = "pred") -> DataFrame:
    """False negatives ('fn') or false positives ('fp'), for review."""
    truth, guess = (1, 0) if kind == "fn" else (0, 1)
    return df.filter((F.col(y) == truth) & (F.col(pred) == guess))


# Joins and set operations

def keys_of(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def exclude_known(df: DataFrame, known: DataFrame, key: str = "sequence") -> DataFrame:
    """Rows whose key is absent from ``known``; also the resume and novelty filter."""
    # Copies of a known key are folded first: a frequent one would fill the task that holds it.
    return df.join(keys_of(known, key), key, "left_anti")


novel_only = exclude_known
remaining = exclude_known


def restrict_to(df: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    return df.join(domain.select(key), key, "left_semi")


def overlap_report(df: DataFrame, corpus: DataFrame, by: str, key: str = "sequence") -> DataFrame:
    """Per category: rows, rows whose key is in the corpus, share and the rest.

    Counting per (category, key) before the join shrinks repeated keys map-side.
    """
    counted = df.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"))
    known = keys_of(corpus, key).withColumn("_known", F.lit(1))
    return (
        counted.join(known, key, "left")
        .groupBy(by)
        .agg(
            F.sum("n").alias("n_total"),
            F.coalesce(F.sum(F.when(F.col("_known") == 1, F.col("n"))), F.lit(0)).alias("n_overlap"),
        )
        .withColumn("pct_overlap", F.lit(100.0) * F.col("n_overlap") / F.col("n_total"))
        .withColumn("n_novel", F.col("n_total") - F.col("n_overlap"))
    )


def memorization(samples: DataFrame, corpus: DataFrame, key: str = "sequence") -> DataFrame:
    """Samples that occur verbatim in the corpus."""
    counted = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    marked = counted.join(keys_of(corpus, key).withColumn("_known", F.lit(1)), key, "left")
    total = F.sum("n")
    seen = F.coalesce(F.sum(F.when(F.col("_known") == 1, F.col("n"))), F.lit(0))
    return marked.agg(
        total.alias("n_samples"), seen.alias("n_memorized"), F.try_divide(seen.cast("double"), total).alias("share")
    )


def attach_clusters(df: DataFrame, clusters: DataFrame, key: str = "seq_id") -> DataFrame:
    """Add ``cluster_id``; a row without a cluster fails the job when it is read."""
    joined = df.join(clusters.select(key, "cluster_id"), key, "left")
    message = F.concat(F.lit("no cluster for "), F.col(key).cast("string"))
    kind = dict(clusters.dtypes)["cluster_id"]
    checked = F.when(F.col("cluster_id").isNotNull(), F.col("cluster_id")).otherwise(
        F.raise_error(message).cast(kind)
    )
    return joined.withColumn("cluster_id", checked)


def join_features(left: DataFrame, right: DataFrame, key: str = "sequence") -> DataFrame:
    """Features to features, one row per key on the right so that nothing fans out."""
    return left.join(right.dropDuplicates([key]), key)


def align_predictions(
    truth: DataFrame, predictions: Mapping[str, DataFrame], valid: DataFrame, key: str = "id"
) -> DataFrame:
    """Truth with one score column per model on the common valid ids.

    Each prediction table is ``(key, score)``.  A valid id that a model does not
    score fails the job instead of shrinking the comparison.
    """
    aligned = truth.join(valid.select(key).distinct(), key, "left_semi")
    for name, scores in predictions.items():
        renamed = scores.select(F.col(key), F.col("score").alias(name))
        message = F.concat(F.lit(f"{name}: no score for "), F.col(key).cast("string"))
        aligned = aligned.join(renamed, key, "left").withColumn(
            name, F.when(F.col(name).isNull(), F.raise_error(message).cast("double")).otherwise(F.col(name))
        )
    return aligned


def with_predictions(df: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Predictions joined by id, never by position."""
    return df.join(predictions, key, "left")


def attach_scores(
    df: DataFrame, scores: DataFrame, key: str = "id", column: str = "score", default: float = 0.0
) -> DataFrame:
    joined = df.join(scores.select(key, column), key, "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def union_sources(sources: Mapping[str, DataFrame], name: str = "source_db") -> DataFrame:
    """Union by column name, each row labelled with its source."""
    result = None
    for label, df in sources.items():
        labelled = df.withColumn(name, F.lit(label))
        result = labelled if result is None else result.unionByName(labelled, allowMissingColumns=True)
    if result is None:
        raise ValueError("no sources given")
    return result


def union_distinct(df: DataFrame, rank: str, key: str = "sequence") -> DataFrame:
    """Per source in rank order: distinct keys, keys new to the union, running size."""
    firsts = df.select(rank, key).distinct().withColumn("_first", F.min(rank).over(Window.partitionBy(key)))
    counts = firsts.groupBy(rank).agg(
        F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col(rank) == F.col("_first")).alias("n_new")
    )
    running = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    # One row per source by now, so an unpartitioned window is small.
    return counts.withColumn("union_size", F.sum("n_new").over(running))


#: Rows, and bytes, that are compared with each other before Spark aggregates.
RUN_ROWS, RUN_BYTES = 1 << 20, 1 << 26
ORDERED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def unbeaten(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``df`` without rows that another row of the same key in the same run of rows comes before.

    ``order`` names boolean and integer columns, NULL first; rows that tie stay, and a
    NULL key is one key.  What is left for an exact aggregate is about one row a key and
    run, so its sort does not hold every copy of a frequent key.
    """

    def least(table: pa.Table) -> pa.Table:
        codes = pc.dictionary_encode(table[key].combine_chunks(), null_encoding="encode").indices.to_numpy()
        rows = np.arange(len(codes))
        for name in order:
            column = table[name].combine_chunks().cast(pa.int64())
            for part in [column.is_valid().cast(pa.int64()), column.fill_null(0)] if column.null_count else [column]:
                value = part.to_numpy()[rows]
                best = np.full(int(codes.max(initial=0)) + 1, np.iinfo(np.int64).max)
                np.minimum.at(best, codes, value)
                stays = value == best[codes]
                rows, codes = rows[stays], codes[stays]
        return table.take(pa.array(rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0
        for batch in batches:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= RUN_ROWS or size >= RUN_BYTES:
                yield from least(pa.Table.from_batches(held)).to_batches(max_chunksize=1 << 14)
                held, n, size = [], 0, 0
        if held:
            yield from least(pa.Table.from_batches(held)).to_batches(max_chunksize=1 << 14)

    return df.mapInArrow(work, df.schema)


def merge_into(existing: DataFrame, new: DataFrame, key: str = "sequence", order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``existing`` plus those of ``new`` with an unseen key, one a key, with all columns and ``is_new``.

    Existing rows win; among rows of one table the first by ``order`` (then by their
    other columns) stays.  A column that one table lacks is NULL in its rows; a NULL
    key is one key.
    """
    both = existing.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "is_new", *order)]
    kinds = dict(zip(both.columns, (f.dataType for f in both.schema.fields), strict=True))
    leading = list(takewhile(lambda c: isinstance(kinds.get(c), ORDERED), order))
    if leading and isinstance(kinds.get(key), (T.StringType, *ORDERED)):
        both = unbeaten(both, key, ["is_new", *leading])
    place = F.struct(F.col("is_new"), *[F.col(f"`{c}`") for c in (*order, *rest)])
    # ``is_new`` on its own: a caller that selects no other column sorts and shuffles none.
    best = both.groupBy(key).agg(F.min("is_new").alias("is_new"), F.min(place).alias("_best"))
    return best.select(*[F.col(f"`{c}`") if c in (key, "is_new") else F.col(f"_best.`{c}`").alias(c) for c in both.columns])


def merge_report(existing: DataFrame, new: DataFrame, key: str = "sequence") -> DataFrame:
    both = existing.select(key).withColumn("_new", F.lit(0)).unionByName(new.select(key).withColumn("_new", F.lit(1)))
    per_key = both.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("_new").alias("n_new"))
    return per_key.agg(
        F.sum(F.col("n") - F.col("n_new")).alias("n_existing"),
        F.sum("n_new").alias("n_incoming"),
        F.count(F.lit(1)).alias("n_after"),
        (F.sum("n") - F.count(F.lit(1))).alias("n_removed"),
    )


# Deduplication and labels

def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``.

    ``min_by`` aggregates map-side, so a key holding a third of all rows does
    not have to be sorted in one task as it would be under ``row_number``.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    chosen = df.groupBy(*key).agg(F.min_by(whole, F.struct(*[F.col(c) for c in order])).alias("_row"))
    return chosen.select(*[F.col("_row")[c].alias(c) for c in df.columns])


#: Shares of the rows, by the first order column, up to which records of a sequence are counted.
SHARES = [0.25**i for i in range(1, 7)]
#: Frequent sequences whose later records are dropped before the shuffle, and their longest.
FREQUENT, FREQUENT_LENGTH = 1 << 17, 256


def dedup_with_provenance(df: DataFrame, order: Sequence[str] = (), per_part: int = 10000, spread: DataFrame | None = None) -> DataFrame:
    """One row per sequence: sorted distinct sources, counts, flags and first id.

    State per sequence is one entry per source, whatever the number of copies.  With
    ``order`` the row has its records' ids in that order too (``source_ids``, the first
    ``per_part`` of them) and how many such lists there are; the others are in
    ``provenance_ids``.  Records of a frequent sequence that come behind its first
    ``per_part`` are not shuffled if the first order column is a number: records are counted up
    to some of its quantiles.  ``spread`` may name a smaller table with that column for these; the result does
    not depend on it.
    """
    bounds = _bounds(df if spread is None else spread, order[0]) if order else None
    per_source = df.groupBy("sequence", "source_db").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("source_id").alias("first_id"),
        F.bool_or("had_lowercase").alias("had_lowercase"),
        F.bool_or("has_nonstandard_char").alias("has_nonstandard_char"),
    )
    merged = [
        F.length(F.first("sequence")).alias("sequence_length"),
        F.sort_array(F.collect_list("source_db")).alias("source_dbs"),
        F.count("n").alias("n_source_dbs"),
        F.min("first_id").alias("first_source_id"),
        F.sum("n").alias("n_records"),
        F.bool_or("had_lowercase").alias("had_lowercase"),
        F.bool_or("has_nonstandard_char").alias("has_nonstandard_char"),
    ]
    if not order:
        return per_source.groupBy("sequence").agg(*merged)
    parts = F.ceil(F.col("n_records") / F.lit(per_part)).cast("int").alias("n_id_parts")
    if bounds is None:
        first = provenance_ids(df, per_part, order).filter("part = 0").select("sequence", "source_ids")
        return join_same(per_source.groupBy("sequence").agg(*merged), first, ["sequence"], "left").select("*", parts)
    # The lowest bound up to which there are enough records; those of NULL order come before all.
    upto = {f"_upto{i}": F.count_if(F.col(order[0]) <= F.lit(v)) for i, v in enumerate(bounds)}
    sums = df.groupBy("sequence").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in upto.items()])
    last = F.coalesce(*[F.when(F.col(n) >= per_part, F.lit(v)) for n, v in reversed([*zip(upto, bounds, strict=True)])])
    frequent = sums.select(F.col("sequence").alias("_frequent"), "_n", last.alias("_last")).filter(
        (F.col("_n") > 2 * per_part) & F.col("_last").isNotNull() & (F.length("_frequent") <= FREQUENT_LENGTH)
    )
    frequent = frequent.orderBy(F.desc("_n"), "_frequent").limit(FREQUENT).drop("_n")
    entry = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col("source_id"))
    kept = (
        df.select("sequence", F.col(order[0]).alias("_at"), entry.alias("_entry"))
        .join(F.broadcast(frequent), F.col("sequence") == F.col("_frequent"), "left")
        .filter("_last is null or _at is null or _at <= _last")
        .select("sequence", "_entry")
    )
    # Sources and records come to a sequence in one shuffle.
    both = per_source.unionByName(kept, allowMissingColumns=True).repartition("sequence")
    found = both.groupBy("sequence").agg(*merged, F.slice(F.sort_array(F.collect_list("_entry")), 1, per_part).alias("_ids"))
    return found.select(*[c for c in found.columns if c != "_ids"], F.col("_ids.source_id").alias("source_ids"), parts)


def _bounds(df: DataFrame, column: str) -> list | None:
    """Values of a number column at SHARES of its rows, about; None if it is none or has no value."""
    if not isinstance(df.schema[column].dataType, T.NumericType):
        return None
    return df.agg(F.percentile_approx(column, SHARES, 10000).alias("q")).first().q or None


def provenance_ids(df: DataFrame, per_part: int = 10000, order: Sequence[str] = ()) -> DataFrame:
    """Every record id of every sequence, as ordered lists of bounded size.

    A sequence with few copies gets one list (part 0), one with very many as many as
    it needs, so no list and no task grows with the most frequent sequence, and no
    id is dropped.  With ``order`` the lists follow one another in that order: rows are
    numbered over range partitions of (sequence, order), which a hot sequence
    spreads over.  Without, records are dealt into parts by hash and sorted there.
    """
    if order:
        ensure_checkpoint_dir(df.sparkSession)
        keyed = df.select("sequence", "source_id", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.lit(1).alias("_one"))
        numbered, _ = numbered_blocks(keyed, ["sequence", *[f"_o{i}" for i in range(len(order))], "source_id"], "_one", 1)
        starts = numbered.groupBy("sequence").agg(F.min("ordinal").alias("_first"))
        placed = join_same(numbered, starts, ["sequence"]).withColumn("part", F.floor((F.col("ordinal") - F.col("_first")) / per_part).cast("int"))
        lists = placed.groupBy("sequence", "part").agg(F.sort_array(F.collect_list(F.struct("ordinal", "source_id"))).alias("_ids"))
        return lists.select("sequence", "part", F.col("_ids.source_id").alias("source_ids"))
    copies = df.groupBy("sequence").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_part)).cast("int").alias("n_parts"))
    parts = (
        join_same(df.select("sequence", "source_id"), copies, ["sequence"])
        .withColumn("part", F.floor(hash_unit("part", "source_id") * F.col("n_parts")).cast("int"))
    )
    return parts.groupBy("sequence", "part").agg(F.sort_array(F.collect_list("source_id")).alias("source_ids"))


def source_overlap(df: DataFrame, key: str = "sequence", source: str = "source_db") -> DataFrame:
    """How many sequences occur in 1, 2, ... sources, with the share of each."""
    per_key = df.select(key, source).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_source_dbs"))
    histogram = per_key.groupBy("n_source_dbs").agg(F.count(F.lit(1)).alias("n_sequences"))
    everything = Window.partitionBy()
    shared = F.when(F.col("n_source_dbs") > 1, F.col("n_sequences")).otherwise(F.lit(0))
    # The histogram has at most one row per number of sources.
    return histogram.select(
        "n_source_dbs",
        "n_sequences",
        (F.lit(100.0) * F.sum(shared).over(everything) / F.sum("n_sequences").over(everything)).alias("pct_shared"),
    )


def multilabel(df: DataFrame, categories: Sequence[str], key: str = "sequence", category: str = "category") -> DataFrame:
    """One row per sequence with a 0/1 column for each category."""
    return df.groupBy(key).agg(
        *[F.max(F.when(F.col(category) == c, 1).otherwise(0)).alias(c) for c in categories]
    )


def label_conflicts(df: DataFrame, key: str = "sequence", label: str = "label") -> DataFrame:
    """Keys seen with more than one label; min <> max needs constant state."""
    return (
        df.groupBy(key)
        .agg(F.min(label).alias("lowest"), F.max(label).alias("highest"), F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("lowest") != F.col("highest"))
    )


def activity_tiers(df: DataFrame, peptide: str = "peptide_id", species: str = "species", inactive: str = "inactive") -> DataFrame:
    """Peptides active on every target, on none, or on some."""
    pairs = df.groupBy(peptide, species).agg(F.bool_and(inactive).alias("all_off"), F.bool_or(inactive).alias("any_off"))
    return pairs.groupBy(peptide).agg(
        F.when(F.bool_and("all_off"), F.lit("all_inactive"))
        .when(~F.bool_or("any_off"), F.lit("all_active"))
        .otherwise(F.lit("mixed"))
        .alias("tier"),
        F.count(F.lit(1)).alias("n_species"),
    )

"""Column -> Column functions on residue strings; those that look at every position work on batches in NumPy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scales

WHITESPACE = " \t\n\r\f\x0b"


class Counted:
    """A sequence column whose residue counts are already columns.

    Composition functions accept it in place of the sequence, so a table of
    many descriptors counts each residue once.
    """

    def __init__(self, column: str, prefix: str = "_n_"):
        self.column = column
        self.counts = {r: F.col(prefix + r) for r in scales.STANDARD}

    @staticmethod
    def columns(column: str, prefix: str = "_n_") -> dict[str, Column]:
        return {prefix + r: residue_count(column, r) for r in scales.STANDARD}


def as_column(column: Column | str | Counted) -> Column:
    if isinstance(column, Counted):
        return F.col(column.column)
    return F.col(column) if isinstance(column, str) else column


def stripped(column) -> Column:
    return F.trim(as_column(column), F.lit(WHITESPACE))


def normalized(column) -> Column:
    """Surrounding white space removed, upper case."""
    return F.upper(stripped(column))


def has_lowercase(column) -> Column:
    return as_column(column).rlike("[a-z]")


def has_nonstandard(column) -> Column:
    """True when any character is outside the twenty upper-case residues."""
    return as_column(column).rlike(f"[^{scales.STANDARD}]")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain reference inside a lambda would be evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """``value`` computed once per row, as a column of its own.

    Later filters and projections refer to the result of this one-element
    explode; a plain column could be inlined into each of them again.
    """
    return F.explode(F.array(value))


# Composition

def residue_count(column, residues: str) -> Column:
    """How many characters belong to the set ``residues``."""
    if isinstance(column, Counted):
        return sum((column.counts[r] for r in residues[1:]), column.counts[residues[0]])
    c = as_column(column)
    # Bytes lost when a residue is removed; a plain replace is far cheaper than a translate table.
    kept = [F.octet_length(F.replace(c, F.lit(r), F.lit(""))) for r in residues]
    return F.octet_length(c) * len(residues) - sum(kept[1:], kept[0])


def share(count: Column, column) -> Column:
    """``count`` over the sequence length; 0 for the empty sequence."""
    size = F.length(as_column(column))
    return F.when(size > 0, count / size).otherwise(F.lit(0.0))


def residue_fraction(column, residues: str) -> Column:
    return share(residue_count(column, residues), column)


def scale_sum(column, scale: Mapping[str, float]) -> Column:
    """Sum of a residue scale; residues with equal values are counted together."""
    by_value: dict[float, str] = {}
    for residue, value in scale.items():
        by_value[value] = by_value.get(value, "") + residue
    total = F.lit(0.0)
    for value, residues in by_value.items():
        if value:
            total = total + F.lit(float(value)) * residue_count(column, residues)
    return total


def mean_scale(column, scale: Mapping[str, float]) -> Column:
    return share(scale_sum(column, scale), column)


def net_charge(column) -> Column:
    return scale_sum(column, scales.CHARGES)


def hydrophobic_ratio(column) -> Column:
    return residue_fraction(column, scales.HYDROPHOBIC)


def hydroph_ratio_lib(column) -> Column:
    """The descriptor library's hydrophobic ratio, over a different residue set."""
    return residue_fraction(column, scales.HYDROPHOBIC_LIBRARY)


def gravy(column) -> Column:
    return mean_scale(column, scales.KYTE_DOOLITTLE)


def boman_index(column) -> Column:
    return mean_scale(column, scales.BOMAN)


def aromaticity(column) -> Column:
    return residue_fraction(column, scales.AROMATIC)


def ss_fractions(column) -> dict[str, Column]:
    return {
        "ss_helix_frac": residue_fraction(column, scales.HELIX),
        "ss_turn_frac": residue_fraction(column, scales.TURN),
        "ss_sheet_frac": residue_fraction(column, scales.SHEET),
    }


def aliphatic_index(column) -> Column:
    """Ikai (1980): relative volume of A, V, I and L side chains."""
    return mean_scale(column, {"A": 100.0, "V": 290.0, "I": 390.0, "L": 390.0})


def molecular_weight(column, amide: bool = False) -> Column:
    bonds = F.greatest(F.length(as_column(column)) - 1, F.lit(0))
    weight = scale_sum(column, scales.MASSES) - F.lit(scales.WATER) * bonds
    return weight - F.lit(scales.AMIDATION) if amide else weight


# Charge and isoelectric point

def _terminal_pk(residue: Column, default: float, special: Mapping[str, float]) -> Column:
    pk = F.lit(default)
    for letter, value in special.items():
        pk = F.when(residue == letter, F.lit(value)).otherwise(pk)
    return pk


def _charge(counts: Mapping[str, Column], first_pk, last_pk, ph: Column, pkas, amide: bool) -> Column:
    ten = F.lit(10.0)
    total = F.lit(1.0) / (F.lit(1.0) + F.pow(ten, ph - first_pk))
    for residue, pk in pkas["positive"].items():
        if residue != "Nterm":
            total = total + counts[residue] / (F.lit(1.0) + F.pow(ten, ph - F.lit(pk)))
    for residue, pk in pkas["negative"].items():
        if residue != "Cterm":
            total = total - counts[residue] / (F.lit(1.0) + F.pow(ten, F.lit(pk) - ph))
    if not amide:
        total = total - F.lit(1.0) / (F.lit(1.0) + F.pow(ten, last_pk - ph))
    return total


def _ionizable(column, pkas):
    c = as_column(column)
    charged = [r for side in ("positive", "negative") for r in pkas[side] if not r.endswith("term")]
    counts = {r: residue_count(column, r) for r in charged}
    first = _terminal_pk(F.substring(c, 1, 1), pkas["positive"]["Nterm"], pkas["first"])
    last = _terminal_pk(F.substring(c, -1, 1), pkas["negative"]["Cterm"], pkas["last"])
    return counts, first, last


def charge_at_ph(column, ph: float = 7.0, pkas=scales.BJELLQVIST, amide: bool = False) -> Column:
    """Henderson-Hasselbalch net charge; an amidated C-terminus carries none."""
    counts, first, last = _ionizable(column, pkas)
    return _charge(counts, first, last, F.lit(float(ph)), pkas, amide)


def isoelectric_point(
    column, pkas=scales.BJELLQVIST, amide: bool = False, low: float = 4.05, high: float = 12.0, steps: int = 24
) -> Column:
    """The pH of zero charge inside [low, high], by a fixed number of halvings.

    A batch of rows is halved at once in NumPy; the same halvings row by row in the
    JVM's interpreter take many times as long.
    """
    counts, first, last = _ionizable(column, pkas)
    side = [(r, pk, 1.0) for r, pk in pkas["positive"].items() if r != "Nterm"] + [(r, pk, -1.0) for r, pk in pkas["negative"].items() if r != "Cterm"]

    @F.pandas_udf("double")
    def solve(first_pk: pd.Series, last_pk: pd.Series, *n: pd.Series) -> pd.Series:
        start, end, numbers = first_pk.to_numpy(np.float64), last_pk.to_numpy(np.float64), [c.to_numpy(np.float64) for c in n]
        lo, hi = np.full(len(start), low), np.full(len(start), high)
        for _ in range(steps):
            middle = (lo + hi) / 2.0
            charge = 1.0 / (1.0 + 10.0 ** (middle - start))
            for (_, pk, sign), number in zip(side, numbers, strict=True):
                charge = charge + sign * (number / (1.0 + 10.0 ** (sign * (middle - pk))))
            if not amide:
                charge = charge - 1.0 / (1.0 + 10.0 ** (end - middle))
            lo, hi = np.where(charge > 0, middle, lo), np.where(charge > 0, hi, middle)
        return pd.Series((lo + hi) / 2.0)

    ready = [counts[r].cast("double") for r, _, _ in side]
    # Rows without a sequence have no counts; they keep the value that no positive charge leads to.
    return solve(first, last, *ready)


def charge_density(column, ph: float = 7.0, pkas=scales.HANDBOOK, amide: bool = True) -> Column:
    return F.try_divide(charge_at_ph(column, ph, pkas, amide), molecular_weight(column, amide))


# Position-dependent functions

def residues(column) -> Column:
    """The residues as an array; empty for the empty sequence."""
    c = as_column(column)
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def _letter_parts(sequences: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, row, position) of every letter, for about a million letters at a time; codes outside A-Z are 26."""
    texts = [s if isinstance(s, str) else "" for s in sequences]
    sizes = np.array([len(s) for s in texts], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) >> 20)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        size = sizes[start:stop]
        code = np.frombuffer("".join(texts[start:stop]).encode("utf-32-le"), np.uint32).astype(np.int64) - 65
        code[(code < 0) | (code > 25)] = 26
        row = np.repeat(np.arange(start, stop), size)
        yield code, row, np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)


def _row_values(function: Callable[[pd.Series], np.ndarray]) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def apply(sequences: pd.Series) -> pd.Series:
        return pd.Series(function(sequences))

    return apply


def hydrophobic_moment(column, angle: float = 100.0, scale=scales.EISENBERG) -> Column:
    """Eisenberg moment per residue, ``angle`` degrees between neighbours."""
    c = as_column(column)
    step = math.radians(angle)
    values = np.array([float(scale.get(chr(code), 0.0)) for code in range(ord("A"), ord("Z") + 1)] + [0.0])

    def moment(sequences: pd.Series) -> np.ndarray:
        x, y = np.zeros(len(sequences)), np.zeros(len(sequences))
        for code, row, position in _letter_parts(sequences):
            x += np.bincount(row, values[code] * np.cos(position * step), len(x))
            y += np.bincount(row, values[code] * np.sin(position * step), len(y))
        return np.sqrt(x * x + y * y)

    return F.when(F.length(c) >= 2, _row_values(moment)(c) / F.length(c)).otherwise(F.lit(0.0))


def kmers(column, k: int = 2, long: int = 4096) -> Column:
    """All overlapping k-mers in order; empty when the sequence is shorter than k.

    ``substring`` counts characters from the start, which is fastest on peptides
    but quadratic on very long text; those are cut from an array of letters.
    """
    c = as_column(column)
    starts = F.sequence(F.lit(1), F.length(c) - (k - 1))
    cut = F.transform(starts, lambda i: F.substring(c, i, F.lit(k)))
    sliced = let(F.split(c, ""), lambda letters: F.transform(starts, lambda i: F.array_join(F.slice(letters, i, k), "")))
    none = F.array().cast("array<string>")
    return F.when(F.length(c) < k, none).when(F.length(c) <= long, cut).otherwise(sliced)


def dipeptide_index(column, weights: Mapping[str, float]) -> Column:
    """(10 / L) * sum of dipeptide weights; the instability index under the published table."""
    c = as_column(column)
    letters = [chr(code) for code in range(ord("A"), ord("Z") + 1)]
    table = np.zeros((27, 27))
    table[:26, :26] = [[float(weights.get(a + b, 0.0)) for b in letters] for a in letters]

    def total(sequences: pd.Series) -> np.ndarray:
        found = np.zeros(len(sequences))
        for code, row, _ in _letter_parts(sequences):
            same = row[1:] == row[:-1]
            found += np.bincount(row[1:][same], table[code[:-1][same], code[1:][same]], len(found))
        return found

    return share(F.lit(10.0) * _row_values(total)(c), c)


def hamming_similarity(left, right) -> Column:
    """Equal positions over the longer length; 0 when either is empty."""
    a, b = as_column(left), as_column(right)
    matches = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)),
        F.lit(0),
        lambda s, m: s + F.coalesce(m, F.lit(0)),
    )
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), matches / longest).otherwise(F.lit(0.0))


def kmer_counts(column, k: int = 2) -> Column:
    """Sparse k-mer count vector as (sorted ``keys``, ``counts``).

    In the sorted k-mers, the first position of a key minus that of the next
    key is its count, so counting needs no nested pass.
    """

    def runs(found: Column) -> Column:
        return let(
            F.array_distinct(found),
            lambda keys: let(
                F.concat(
                    F.transform(keys, lambda key: F.array_position(found, key)),
                    F.array((F.size(found) + 1).cast("bigint")),
                ),
                lambda starts: F.struct(
                    keys.alias("keys"),
                    F.zip_with(
                        F.slice(starts, F.lit(1), F.size(keys)), F.slice(starts, F.lit(2), F.size(keys)), lambda a, b: b - a
                    ).alias("counts"),
                ),
            ),
        )

    return let(F.array_sort(kmers(column, k)), runs)


def _kmer_entries(sequences: pd.Series, k: int, letters: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every k-mer; equal codes are equal k-mers for one table of ``letters``."""
    texts = [s if isinstance(s, str) else "" for s in sequences]
    sizes = np.array([len(s) for s in texts], np.int64)
    raw = letters["rank"][np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)] if sizes.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(raw)) - (np.cumsum(sizes) - sizes)[row] <= sizes[row] - k
    code = np.zeros(len(raw), np.int64)
    for i in range(k):
        code[: len(raw) - i] = code[: len(raw) - i] * letters["n"] + raw[i:]
    return row[inside], code[inside]


def dipeptide_cosine(left, right, k: int = 2) -> Column:
    """Cosine of two k-mer count vectors; 0 when either has none.  A batch of rows is counted at once in NumPy."""

    def part(a: pd.Series, b: pd.Series) -> np.ndarray:
        known = np.unique(np.frombuffer("".join(s for c in (a, b) for s in c if isinstance(s, str)).encode("utf-32-le"), np.uint32))
        n = max(1, len(known))
        if n**k * max(1, len(a)) >= 1 << 63:
            raise ValueError("too many different letters for k-mers of this length")
        rank = np.zeros(int(known[-1]) + 1 if len(known) else 1, np.int64)
        rank[known] = np.arange(len(known))
        sides = []
        for column in (a, b):
            row, code = _kmer_entries(column, k, {"rank": rank, "n": n})
            sides.append(np.unique(row * n**k + code, return_counts=True))
        _, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
        dot = np.bincount(sides[0][0][i] // n**k, sides[0][1][i] * sides[1][1][j], len(a))
        x, y = (np.sqrt(np.bincount(keys // n**k, counts.astype(np.float64) ** 2, len(a))) for keys, counts in sides)
        norm = x * y
        return np.divide(dot, norm, out=np.zeros(len(a)), where=norm > 0)

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        # About a million letters at a time, more only for a single row.
        upto = np.cumsum([len(x or "") + len(y or "") for x, y in zip(a, b, strict=True)])
        cuts = np.flatnonzero(np.diff(upto >> 20)) + 1
        ends = [0, *cuts.tolist(), len(a)]
        return pd.Series(np.concatenate([part(a[i:j], b[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]))


    return cosine(as_column(left), as_column(right))


# Shaping terms

def _soft_window(value: Column, low: float, high: float, margin: float) -> Column:
    below = F.lit(1.0) - (F.lit(low) - value) / F.lit(margin)
    above = F.lit(1.0) - (value - F.lit(high)) / F.lit(margin)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(below, above)))


def charge_score(column, low: float = 2.0, high: float = 9.0, margin: float = 2.0) -> Column:
    return _soft_window(net_charge(column), low, high, margin)


def length_score_linear(column, low: float = 15.0, high: float = 50.0, margin: float = 5.0) -> Column:
    return _soft_window(F.length(as_column(column)).cast("double"), low, high, margin)


def length_score_gauss(column, mean: float = 26.0, std: float = 8.0, low: int = 15, high: int = 50) -> Column:
    size = F.length(as_column(column))
    z = (size - F.lit(mean)) / F.lit(std)
    return F.when(size.between(low, high), F.exp(F.lit(-0.5) * z * z)).otherwise(F.lit(0.0))


def moment_score(moment, cap: float = 0.65) -> Column:
    return F.least(as_column(moment) / F.lit(cap), F.lit(1.0))


def clip01(column) -> Column:
    return F.least(F.greatest(as_column(column), F.lit(0.0)), F.lit(1.0))


def correlation_tier(r) -> Column:
    size = F.abs(as_column(r))
    return F.when(size >= 0.5, "meaningful").when(size >= 0.3, "weak").otherwise("none")


# Identifiers, controls and tokens

def seq_id(column) -> Column:
    return F.concat(F.lit("seq_"), F.substring(F.md5(as_column(column)), 1, 12))


def shuffle_residues(column, seed: int = 42) -> Column:
    """A scrambled control: the same residues in an order seeded by the sequence itself."""

    @F.pandas_udf("string")
    def shuffled(sequences: pd.Series) -> pd.Series:
        rows = []
        for text in sequences:
            if not isinstance(text, str):
                rows.append("")
                continue
            # md5 of "seed:text:i" for each position; the common beginning is digested once.
            begun, digests = hashlib.md5(f"{seed}:{text}:".encode(), usedforsecurity=False), []
            for i in range(len(text)):
                h = begun.copy()
                h.update(b"%d" % i)
                digests.append(h.digest())
            rows.append("".join([text[i] for i in sorted(range(len(text)), key=digests.__getitem__)]))
        return pd.Series(rows, dtype=object)

    return shuffled(as_column(column))


# Special token ids; residues follow in alphabetic order.
PAD, BOS, EOS = 0, 1, 2
FIRST_RESIDUE = 3


def token_ids(column, max_len: int) -> Column:
    """BOS, residue ids, EOS, padded on the right to ``max_len`` residues plus both marks.

    A residue outside the alphabet is an error, as no id stands for it.
    """
    c = as_column(column)

    def id_of(letter: Column) -> Column:
        at = F.instr(F.lit(scales.STANDARD), letter)
        return F.when(at > 0, at + (FIRST_RESIDUE - 1)).otherwise(F.raise_error(F.concat(F.lit("no token for residue "), letter)).cast("int"))

    ids = F.transform(residues(c), id_of)
    body = F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))
    missing = F.greatest(F.lit(max_len + 2) - F.size(body), F.lit(0))
    return F.concat(body, F.array_repeat(F.lit(PAD), missing))


def decode_tokens(ids) -> Column:
    """Residues after the first token, up to the first token that is no residue."""
    tail = F.slice(as_column(ids), 2, F.greatest(F.size(as_column(ids)) - 1, F.lit(0)))
    last = FIRST_RESIDUE + len(scales.STANDARD) - 1
    flags = F.transform(tail, lambda t: (t < FIRST_RESIDUE) | (t > last))
    stop = F.array_position(flags, True).cast("int")
    kept = F.when(stop > 0, F.slice(tail, 1, stop - 1)).otherwise(tail)
    letters = F.transform(kept, lambda t: F.substring(F.lit(scales.STANDARD), t - (FIRST_RESIDUE - 1), F.lit(1)))
    return F.array_join(letters, "")

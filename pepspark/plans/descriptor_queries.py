"""Queries over sequence functions and the descriptor table."""

from __future__ import annotations



from pyspark.sql import functions as F

from ..functions import scales
from ..functions import sequences as sq
from ..operators import curation as cu
from ..operators import scoring as sc
from ..operators import summaries as sm
from . import views
from .registry import R, query

L = "length(sequence)"


def count(residues: str) -> str:
    return f"({L} - length(translate(sequence, '{residues}', '')))"


def weighted(scale) -> str:
    return "(" + " + ".join(f"({w})::double * {count(r)}" for r, w in scale.items() if w) + ")"


def per_length(expression: str) -> str:
    return f"({expression})::double / {L}"


def p(spark, path):
    return views.peptides(spark, path)


@query(
    "x1_residue_fractions",
    "select id, " + ", ".join(f"{R(per_length(count(a)))} as frac_{a}" for a in scales.STANDARD) + " from peptides",
)
def _(spark, path):
    return p(spark, path).select("id", *[sq.residue_fraction("sequence", a).alias(f"frac_{a}") for a in scales.STANDARD])


CHARGE = weighted(scales.CHARGES)


@query("x2_net_charge", f"select id, {R(CHARGE)} as net_charge from peptides")
def _(spark, path):
    return p(spark, path).select("id", sq.net_charge("sequence").alias("net_charge"))


@query("x3_hydrophobic_ratio", f"select id, {R(per_length(count(scales.HYDROPHOBIC)))} as ratio from peptides")
def _(spark, path):
    return p(spark, path).select("id", sq.hydrophobic_ratio("sequence").alias("ratio"))


EISENBERG = "case substr(sequence, i::int, 1) " + " ".join(f"when '{r}' then ({w})::double" for r, w in scales.EISENBERG.items()) + " else 0 end"
MOMENT = f"""moments as (select id, sequence, sqrt(power(sum(h * cos((i - 1) * radians(100))), 2) + power(sum(h * sin((i - 1) * radians(100))), 2))
      / length(sequence) as moment
    from (select id, sequence, i, {EISENBERG} as h from (select id, sequence, unnest(range(1, length(sequence) + 1)) as i from peptides)) group by id, sequence)"""
MOMENT_VALUE = f"case when {L} < 2 then 0 else moment end"


@query("x4_hydrophobic_moment", f"with {MOMENT} select id, {R(MOMENT_VALUE)} as moment from moments")
def _(spark, path):
    return p(spark, path).select("id", sq.hydrophobic_moment("sequence").alias("moment"))


def soft(value: str, low: float, high: float, margin: float) -> str:
    return (
        f"case when {value} between {low} and {high} then 1.0::double when {value} < {low} then greatest(0.0::double, 1 - ({low} - {value}) / {margin}::double) "
        f"else greatest(0.0::double, 1 - ({value} - {high}) / {margin}::double) end"
    )


GAUSS = f"case when {L} between 15 and 50 then exp(-0.5::double * power(({L} - 26) / 8.0::double, 2)) else 0 end"


@query("x5_charge_score", f"select id, {R(soft(f'round({CHARGE}, 9)', 2, 9, 2))} as score from peptides")
def _(spark, path):
    return p(spark, path).select("id", sq.charge_score("sequence").alias("score"))


@query("x6_length_score_linear", f"select id, {R(soft(L, 15, 50, 5))} as score from peptides")
def _(spark, path):
    return p(spark, path).select("id", sq.length_score_linear("sequence").alias("score"))


@query("x7_length_score_gauss", f"select id, {R(GAUSS)} as score from peptides")
def _(spark, path):
    return p(spark, path).select("id", sq.length_score_gauss("sequence").alias("score"))


@query(
    "x8_moment_score",
    f"with {MOMENT} select id, {R(f'least(({MOMENT_VALUE}) / 0.65::double, 1)')} as score, {R(f'least(({MOMENT_VALUE}) / 0.5::double, 1)')} as earlier_score from moments",
)
def _(spark, path):
    moments = p(spark, path).select("id", sq.hydrophobic_moment("sequence").alias("m"))
    return moments.select("id", sq.moment_score("m").alias("score"), sq.moment_score("m", 0.5).alias("earlier_score"))


MASS = f"({weighted(scales.MASSES)} - 18.0153::double * ({L} - 1))"
LINEAR = {
    "gravy": per_length(weighted(scales.KYTE_DOOLITTLE)),
    "ss_helix_frac": per_length(count(scales.HELIX)),
    "ss_turn_frac": per_length(count(scales.TURN)),
    "ss_sheet_frac": per_length(count(scales.SHEET)),
    "aromaticity": per_length(count("FWY")),
    "aliphatic": f"100 * ({count('A')} + 2.9::double * {count('V')} + 3.9::double * {count('IL')}) / {L}",
    "hydroph_ratio": per_length(count(scales.HYDROPHOBIC_LIBRARY)),
    "molecular_weight": MASS,
    "amide_weight": f"{MASS} - 0.9847::double",
    "boman": per_length(weighted(scales.BOMAN)),
}


@query(
    "x9_x14_linear_descriptors",
    "select id, " + ", ".join(f"{R(e)} as {n}" for n, e in LINEAR.items()) + " from peptides",
)
def _(spark, path):
    c = sq.Counted("sequence")
    ss = sq.ss_fractions(c)
    # Each residue is counted once for all descriptors.
    return p(spark, path).select("id", "sequence").withColumns(sq.Counted.columns("sequence")).select(
        "id", sq.gravy(c).alias("gravy"), *[e.alias(n) for n, e in ss.items()], sq.aromaticity(c).alias("aromaticity"),
        sq.aliphatic_index(c).alias("aliphatic"), sq.hydroph_ratio_lib(c).alias("hydroph_ratio"),
        sq.molecular_weight(c).alias("molecular_weight"), sq.molecular_weight(c, amide=True).alias("amide_weight"),
        sq.boman_index(c).alias("boman"),
    )


def terminal(position: str, default: float, special) -> str:
    whens = " ".join(f"when '{r}' then ({v})::double" for r, v in special.items())
    return f"(case {position} {whens} else ({default})::double end)" if whens else f"({default})::double"


def charge_sql(ph: str, pkas, amide: bool, counts=count) -> str:
    first = terminal("substr(sequence, 1, 1)", pkas["positive"]["Nterm"], pkas["first"])
    last = terminal("substr(sequence, -1, 1)", pkas["negative"]["Cterm"], pkas["last"])
    terms = [f"1 / (1 + power(10::double, {ph} - {first}))"]
    terms += [f"{counts(r)} / (1 + power(10::double, {ph} - ({k})::double))" for r, k in pkas["positive"].items() if r != "Nterm"]
    terms += [f"-{counts(r)} / (1 + power(10::double, ({k})::double - {ph}))" for r, k in pkas["negative"].items() if r != "Cterm"]
    if not amide:
        terms.append(f"-1 / (1 + power(10::double, {last} - {ph}))")
    return "(" + " + ".join(terms) + ")"


CHARGE7 = charge_sql("7.0::double", scales.BJELLQVIST, False)
CHARGE7_AMIDE = charge_sql("7.0::double", scales.HANDBOOK, True)


@query(
    "x15_x17_charge_at_ph",
    f"""select id, {R(CHARGE7)} as charge, {R(CHARGE7_AMIDE)} as amide_charge,
        {R(f'{CHARGE7_AMIDE} / ({MASS} - 0.9847::double)')} as charge_density from peptides""",
)
def _(spark, path):
    return p(spark, path).select(
        "id", sq.charge_at_ph("sequence").alias("charge"),
        sq.charge_at_ph("sequence", 7.0, scales.HANDBOOK, amide=True).alias("amide_charge"),
        sq.charge_density("sequence").alias("charge_density"),
    )


IONIZABLE = "KRHDECY"


@query(
    "x16_isoelectric_point",
    f"""with recursive base as (select id, sequence, {', '.join(f'{count(r)} as n_{r}' for r in IONIZABLE)} from peptides),
      halving as (select *, 4.05::double as lo, 12.0::double as hi, 0 as i from base
        union all select id, sequence, {', '.join(f'n_{r}' for r in IONIZABLE)}, case when q > 0 then mid else lo end, case when q > 0 then hi else mid end, i + 1
        from (select *, {charge_sql('mid', scales.BJELLQVIST, False, lambda r: f'n_{r}')} as q from (select *, (lo + hi) / 2 as mid from halving where i < 24)))
      select id, (round((lo + hi) / 2, 5) + 0.0::double) as pi from halving where i = 24""",
)
def _(spark, path):
    return p(spark, path).select("id", F.round(sq.isoelectric_point("sequence"), 5).alias("pi"))


# A dipeptide table by rule: the difference of the two hydropathies, where it is positive.
STEP_WEIGHTS = {
    a + b: round(scales.KYTE_DOOLITTLE[a] - scales.KYTE_DOOLITTLE[b], 1)
    for a in scales.STANDARD
    for b in scales.STANDARD
    if scales.KYTE_DOOLITTLE[a] > scales.KYTE_DOOLITTLE[b]
}
PAIRS = "select id, sequence, unnest(range(1, length(sequence))) as i from peptides"
KD_VALUES = ", ".join(f"('{r}', ({v})::double)" for r, v in scales.KYTE_DOOLITTLE.items())


@query(
    "x18_dipeptide_index",
    f"""with kd(r, v) as (values {KD_VALUES}), pairs as ({PAIRS}),
      sums as (select id, sum(greatest(round(a.v - b.v, 1), 0)) as s from pairs join kd a on a.r = substr(sequence, i::int, 1)
        join kd b on b.r = substr(sequence, i::int + 1, 1) group by id)
      select id, {R(f'10 * coalesce(s, 0) / {L}')} as dipeptide_index from peptides left join sums using (id)""",
)
def _(spark, path):
    return p(spark, path).select("id", sq.dipeptide_index("sequence", STEP_WEIGHTS).alias("dipeptide_index"))


HELIX_SCALE = {"A": 1.42, "E": 1.51, "L": 1.21, "M": 1.45}


@query("x19_mean_scale", f"select id, {R(per_length(weighted(HELIX_SCALE)))} as mean_value from peptides")
def _(spark, path):
    return p(spark, path).select("id", sq.mean_scale("sequence", HELIX_SCALE).alias("mean_value"))


@query("x20_seq_id", "select id, 'seq_' || substr(md5(sequence), 1, 12) as seq_id from peptides")
def _(spark, path):
    return p(spark, path).select("id", sq.seq_id("sequence").alias("seq_id"))


@query(
    "x20_seq_id_collisions",
    """select count(distinct sequence) as n_sequences, count(distinct 'seq_' || substr(md5(sequence), 1, 12)) as n_ids from peptides""",
)
def _(spark, path):
    distinct = p(spark, path).select("sequence").distinct()
    return distinct.agg(F.count(F.lit(1)).alias("n_sequences"), F.count_distinct(sq.seq_id("sequence")).alias("n_ids"))


@query(
    "x21_kmer_counts",
    f"""select id, substr(sequence, i::int, 2) as kmer, count(*) as n from ({PAIRS}) group by 1, 2""",
)
def _(spark, path):
    exploded = p(spark, path).select("id", F.explode(sq.kmers("sequence", 2)).alias("kmer"))
    return exploded.groupBy("id", "kmer").agg(F.count(F.lit(1)).alias("n"))


NEIGHBOURS = "pairs as (select a.id, a.sequence as s, b.sequence as t from peptides a join peptides b on a.doc_id = b.doc_id and b.pos = a.pos + 1)"


def neighbours(spark, path):
    """Each sentence with the next one of its document."""
    a = p(spark, path).select("id", "doc_id", "pos", F.col("sequence").alias("s"))
    b = p(spark, path).select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("sequence").alias("t"))
    return a.join(b, ["doc_id", "pos"])


@query(
    "x22_hamming_similarity",
    f"""with {NEIGHBOURS}, cells as (select id, s, t, unnest(range(1, least(length(s), length(t)) + 1)) as i from pairs)
      select id, {R("sum((substr(s, i::int, 1) = substr(t, i::int, 1))::int) / any_value(greatest(length(s), length(t)))::double")} as similarity
      from cells group by id""",
)
def _(spark, path):
    return neighbours(spark, path).select("id", sq.hamming_similarity("s", "t").alias("similarity"))


@query(
    "x23_dipeptide_cosine",
    f"""with {NEIGHBOURS},
      a as (select id, k, count(*) as n from (select id, substr(s, unnest(range(1, length(s)))::int, 2) as k from pairs) group by 1, 2),
      b as (select id, k, count(*) as n from (select id, substr(t, unnest(range(1, length(t)))::int, 2) as k from pairs) group by 1, 2),
      dots as (select id, sum(a.n * b.n) as d from a join b using (id, k) group by 1),
      na as (select id, sqrt(sum(n * n)) as x from a group by 1), nb as (select id, sqrt(sum(n * n)) as y from b group by 1)
      select id, {R('coalesce(d / (x * y), 0)')} as similarity from pairs left join dots using (id) left join na using (id) left join nb using (id)""",
)
def _(spark, path):
    return neighbours(spark, path).select("id", sq.dipeptide_cosine("s", "t").alias("similarity"))


@query(
    "x24_correlation_tier",
    """select id, case when abs(s1 - s2) >= 0.5::double then 'meaningful' when abs(s1 - s2) >= 0.3::double then 'weak' else 'none' end as tier from scores""",
)
def _(spark, path):
    return views.scores(spark, path).select("id", sq.correlation_tier(F.col("s1") - F.col("s2")).alias("tier"))


@query("x25_clip01", f"select event_id, {R('least(greatest(value / 100 - 0.5::double, 0), 1)')} as clipped from events")
def _(spark, path):
    return views.table(spark, path, "events").select("event_id", sq.clip01(F.col("value") / 100 - 0.5).alias("clipped"))


@query(
    "x26_shuffle_residues",
    """select id, array_to_string(list_transform(list_sort(list_transform(range(length(sequence)), lambda i:
         {'h': md5('42:' || sequence || ':' || i), 'i': i, 'ch': substr(sequence, i + 1, 1)})), lambda s: s.ch), '') as scrambled from peptides""",
)
def _(spark, path):
    return p(spark, path).select("id", sq.shuffle_residues("sequence").alias("scrambled"))


@query(
    "x27_token_ids",
    """select id, array_to_string(list_concat(list_concat([1], list_transform(range(1, length(sequence) + 1), lambda i:
          instr('ACDEFGHIKLMNPQRSTVWY', substr(sequence, i, 1)) + 2)), [2]), ' ')
        || repeat(' 0', greatest(85 - length(sequence) - 2, 0)::int) as ids from peptides""",
)
def _(spark, path):
    return p(spark, path).select("id", F.array_join(sq.token_ids("sequence", 83).cast("array<string>"), " ").alias("ids"))


@query("x28_decode_tokens", "select id, sequence as decoded from peptides")
def _(spark, path):
    tokens = p(spark, path).select("id", sq.token_ids("sequence", 83).alias("ids"))
    return tokens.select("id", sq.decode_tokens("ids").alias("decoded"))


# Descriptor table

TABLE = {
    **{f"frac_{a}": per_length(count(a)) for a in scales.STANDARD},
    "molecular_weight": MASS,
    "aromaticity": LINEAR["aromaticity"],
    "gravy": LINEAR["gravy"],
    "ss_helix_frac": LINEAR["ss_helix_frac"],
    "ss_turn_frac": LINEAR["ss_turn_frac"],
    "ss_sheet_frac": LINEAR["ss_sheet_frac"],
    "charge_at_pH7": CHARGE7,
    "modlamp_Length": L,
    "modlamp_MW": LINEAR["amide_weight"],
    "modlamp_Charge": CHARGE7_AMIDE,
    "modlamp_ChargeDensity": f"{CHARGE7_AMIDE} / ({MASS} - 0.9847::double)",
    "modlamp_Aromaticity": LINEAR["aromaticity"],
    "modlamp_AliphaticInd": LINEAR["aliphatic"],
    "modlamp_BomanInd": LINEAR["boman"],
    "modlamp_HydrophRatio": LINEAR["hydroph_ratio"],
}


def descriptors(spark, path):
    return sc.featurize(p(spark, path))


@query("r3_featurize", "select id, " + ", ".join(f'{R(e)} as "{n}"' for n, e in TABLE.items()) + " from peptides")
def _(spark, path):
    return descriptors(spark, path).select("id", *TABLE)


@query(
    "a15_reject_reasons",
    """select 'invalid_chars' as reason, count(*) as n_rows from (select upper(trim(sequence)) as sequence from records)
       where sequence = '' or regexp_matches(sequence, '[^ACDEFGHIKLMNPQRSTVWY]')""",
)
def _(spark, path):
    return sm.reason_counts(sc.featurize(views.records(spark, path)), "reject_reason")


@query(
    "f12_feature_columns",
    "select id, " + ", ".join(f'{R(e)} as "{n}"' for n, e in TABLE.items() if n.startswith(("frac_", "modlamp_", "ss_")) or n == "gravy") + " from peptides",
)
def _(spark, path):
    table = descriptors(spark, path).drop("modlamp_pI")
    return table.select("id", *cu.feature_columns(table.columns, "biophysical"))

"""Queries over samples, splits, windows and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import sampling as sa
from ..operators import scoring as sc
from ..operators import summaries as sm
from . import views
from .registry import R, query

# Length matching

TARGETS = "targets as (select length(sequence) as length, count(*) as n_target from peptides where length(sequence) between 5 and 100 group by 1)"
POOL = f"""{TARGETS},
  ranked as (select b.id, b.sequence, length(b.sequence) as length, coalesce(n_target, 0) as n_target,
      row_number() over (partition by length(b.sequence) order by md5('42:' || b.id), b.id) as r
    from background b left join targets t on t.length = length(b.sequence)),
  direct as (select id, sequence, length from ranked where r <= n_target)"""
DEFICIT = """avail as (select length(sequence) as length, count(*) as n_available from background group by 1),
  deficits as (select length, n_target, coalesce(n_available, 0) as n_available, greatest(n_target - coalesce(n_available, 0), 0) as n_missing
    from targets left join avail using (length))"""
FRAGMENTS = f"""{POOL}, {DEFICIT},
  surplus as (select id, sequence, length, row_number() over (order by length desc, md5('42:surplus:' || id), id) - 1 as ordinal
    from ranked where r > n_target),
  plan as (select length as fl, n_missing, (select count(*) from surplus s where s.length >= d.length) as eligible,
      (select coalesce(sum(n_missing), 0) from deficits e where e.length > d.length) as slot_offset from deficits d where n_missing > 0),
  slots as (select fl, eligible, slot_offset, unnest(range(n_missing)) as slot from plan where eligible > 0),
  cut as (select s.fl, s.slot, u.id, u.sequence, ('0x' || substr(md5('42:' || fl || ':' || slot), 1, 7))::bigint % (u.length - fl + 1) as start
    from slots s join surplus u on u.ordinal = (s.slot_offset + s.slot) % s.eligible),
  fragments as (select id || ':frag' || start || '-' || (start + fl) as source_id, substr(sequence, start + 1, fl) as sequence, fl as length, slot from cut)"""


def targets(spark, path):
    p = views.peptides(spark, path)
    return p.filter(F.length("sequence").between(5, 100))


def pool(spark, path):
    return views.background(spark, path).select("id", "sequence")


@query("w1_match_lengths", f"with {POOL} select id, sequence, length::int as length from direct")
def _(spark, path):
    return sa.match_lengths(pool(spark, path), targets(spark, path))


@query("w1_length_deficits", f"with {TARGETS}, {DEFICIT} select length::int as length, n_target, n_available, n_missing from deficits")
def _(spark, path):
    return sa.length_deficits(pool(spark, path), targets(spark, path))


@query("w2_fragment_fill", f"with {FRAGMENTS} select source_id, sequence, length::int as length, slot from fragments")
def _(spark, path):
    return sa.fragment_fill(pool(spark, path), targets(spark, path))


@query(
    "w2_fragment_shortfall",
    f"""with {FRAGMENTS}, made as (select length, count(*) as n_made from fragments group by 1)
      select length::int as length, n_missing, coalesce(n_made, 0) as n_made, n_missing - coalesce(n_made, 0) as shortfall
      from deficits left join made using (length) where n_missing > 0""",
)
def _(spark, path):
    fragments = sa.fragment_fill(pool(spark, path), targets(spark, path))
    return sa.fragment_shortfall(pool(spark, path), targets(spark, path), fragments)


CLEAN = """clean as (select source_id, sequence, length, slot from (
      select *, row_number() over (partition by sequence order by length desc, slot) as k from fragments) where k = 1
      and sequence not in (select sequence from direct) and sequence not in (select sequence from peptides where length(sequence) between 5 and 100))"""


@query("w3_fragment_clean", f"with {FRAGMENTS}, {CLEAN} select source_id, sequence, length::int as length, slot from clean")
def _(spark, path):
    t = targets(spark, path)
    direct = sa.match_lengths(pool(spark, path), t)
    return sa.fragment_clean(sa.fragment_fill(pool(spark, path), t), direct, t)


@query(
    "w3_length_matched_dataset",
    f"""with {FRAGMENTS}, {CLEAN}, everything as (
        select sequence, length(sequence) as l, 1 as label, 'positive' as origin from peptides where length(sequence) between 5 and 100
        union all select sequence, length, 0, 'direct' from direct union all select sequence, length, 0, 'fragment' from clean)
      select label::int as label, origin, l::int as sequence_length, count(*) as n_rows, count(distinct sequence) as n_sequences from everything group by 1, 2, 3""",
)
def _(spark, path):
    built = sa.length_matched_dataset(targets(spark, path), pool(spark, path))
    return built.groupBy("label", "origin", "sequence_length").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sequence").alias("n_sequences")
    )


@query(
    "w4_first_by",
    """select id, sequence, source_db from (select *, row_number() over (partition by sequence order by doc_id, pos) as k from peptides) where k = 1""",
)
def _(spark, path):
    from ..operators.curation import first_by

    p = views.peptides(spark, path).select("id", "doc_id", "pos", "sequence", "source_db")
    return first_by(p, ["sequence"], ["doc_id", "pos"]).select("id", "sequence", "source_db")


# Log windows

@query(
    "w5_novel_accumulation",
    "select step, n_new, (sum(n_new) over (order by step))::bigint as n_cumulative from (select step, count(*) as n_new from compounds group by 1)",
)
def _(spark, path):
    return sm.novel_accumulation(views.compounds(spark, path))


@query(
    "w6_first_seen",
    f"""select run, step, rid, sequence, {R('reward')} as reward, cluster_id from (
        select *, row_number() over (partition by sequence order by step, rid) as k from compounds
        where sequence not in (select sequence from training)) where k = 1""",
)
def _(spark, path):
    return sm.first_seen(views.compounds(spark, path), views.training(spark, path), ["step", "rid"])


@query(
    "w7_visitation_bonus",
    f"""select run, step, rid, cluster_id, {R('1 / sqrt(row_number() over (partition by run, cluster_id order by step, rid))')} as visit_bonus from compounds""",
)
def _(spark, path):
    visited = sc.visitation_bonus(views.compounds(spark, path), order=["step", "rid"])
    return visited.select("run", "step", "rid", "cluster_id", "visit_bonus")


@query(
    "w8_group_zscore",
    f"""select run, step, rid, {R('case when count(*) over w > 1 then (reward - avg(reward) over w) / greatest(stddev_samp(reward) over w, 1e-6::double) end')} as advantage
        from compounds window w as (partition by run, step)""",
)
def _(spark, path):
    scored = sc.group_zscore(views.compounds(spark, path), ["run", "step"], "reward")
    return scored.select("run", "step", "rid", "advantage")


@query(
    "w9_recent_summary",
    f"""select (select count(*) from compounds) as n_rows, (select max(step) from compounds) as latest_step,
        {R('(select avg(reward) from (select reward from compounds order by step desc, rid desc limit 100))')} as mean_recent""",
)
def _(spark, path):
    return sm.recent_summary(views.compounds(spark, path), ["step", "rid"])


@query(
    "w11_example_rows",
    f"""select * from (select 'correct_positive' as example, id, y, {R('s1')} as s1 from scores where y = 1 order by scores.s1 desc, id desc limit 1)
      union all select * from (select 'correct_negative', id, y, {R('s1')} from scores where y = 0 order by scores.s1, id desc limit 1)
      union all select * from (select 'misclassified', id, y, {R('s1')} from scores where (s1 >= 0.5::double)::int <> y order by abs(scores.s1 - 0.5::double) desc, id desc limit 1)""",
)
def _(spark, path):
    return sm.example_rows(views.scores(spark, path), "id", "y", "s1")


@query("w12_top_rows", "select id, sequence from peptides order by length(sequence) desc, id limit 100")
def _(spark, path):
    p = views.peptides(spark, path).select("id", "sequence")
    return sm.top_rows(p, [F.desc(F.length("sequence")), F.asc("id")], 100)


@query("w13_recent_unique", "select distinct sequence from compounds where step >= 75")
def _(spark, path):
    return sm.recent_unique(views.compounds(spark, path), 75)


# Weights and splits

@query(
    "w14_weighted_sample",
    """with units as (select event_id, floor(value / (select max(value) from events) * 1099511627776.0::double + 0.5::double)::hugeint as u from events where value > 0),
      spans as (select event_id, sum(u) over (order by md5('42:order:' || event_id), event_id)::hugeint as upto, u, (select sum(u) from units)::hugeint as total from units),
      draws as (select i as draw, ('0x' || substr(md5('42:draw:' || i), 1, 13))::bigint::hugeint as x from range(5000) t(i))
      select draw, event_id from draws join spans on x * total >= (upto - u) * 4503599627370496 and x * total < upto * 4503599627370496""",
)
def _(spark, path):
    e = views.table(spark, path, "events").select("event_id", "value")
    return sa.weighted_sample(e, "event_id", "value", 5000).select("draw", "event_id")


@query(
    "w14_poisson_sample",
    """with m as (select event_id, 5000::double * value / (select sum(value) from events) as mean from events),
      d as (select event_id, mean / greatest(ceil(mean / 16), 1) as mean, unnest(range(greatest(ceil(mean / 16), 1)::bigint)) as part from m),
      c as (select event_id, part, ('0x' || substr(md5('42:u:' || event_id || case when part = 0 then '' else ':' || part end), 1, 8))::bigint / 4294967296.0::double as u,
          sum(exp(-mean) * power(mean, k) / gamma(k + 1)) over (partition by event_id, part order by k) as upto
        from d cross join (select unnest(range(80)) as k))
      select event_id, (count(*) filter (u >= upto))::bigint as n_draws from c group by event_id having count(*) filter (u >= upto) > 0""",
)
def _(spark, path):
    e = views.table(spark, path, "events").select("event_id", "value")
    return sa.poisson_sample(e, "event_id", "value", 5000).filter("n_draws > 0").select("event_id", "n_draws")


@query(
    "w15_temper_weights",
    f"""with d as (select distinct source_db, sequence from peptides), n as (select source_db, count(*) as n from d group by 1),
      p as (select source_db, n, power(n / (select sum(n) from n)::double, 0.5) as q from n)
      select source_db, sequence, {R('q / (select sum(q) from p)')} as group_weight, {R('1e6 * q / (select sum(q) from p) / n')} as weight_per_million
      from d join p using (source_db)""",
)
def _(spark, path):
    weighted = sa.temper_weights(views.peptides(spark, path), "source_db")
    return weighted.select("source_db", "sequence", "group_weight", (F.lit(1e6) * F.col("sample_weight")).alias("weight_per_million"))


@query(
    "w16_random_split",
    """select id, case when ('0x' || substr(md5('42:' || id), 1, 8))::bigint / 4294967296.0::double < 0.9::double then 'train' else 'val' end as split from peptides""",
)
def _(spark, path):
    return sa.random_split(views.peptides(spark, path), "id").select("id", "split")


# Summaries

LEN = "length(sequence)::double"
STATS = f"count(v) as n, {R('avg(v)')} as mean, {R('stddev_samp(v)')} as std, {R('min(v)')} as min, {R('quantile_cont(v, 0.25)')} as q25, {R('quantile_cont(v, 0.5)')} as q50, {R('quantile_cont(v, 0.75)')} as q75, {R('max(v)')} as max"


def lengths(spark, path):
    return views.peptides(spark, path).select(
        "id", "category", F.length("sequence").alias("length"), sq.net_charge("sequence").alias("charge")
    )


CHARGE = "(" + " + ".join(f"({w})::double * (length(sequence) - length(translate(sequence, '{r}', '')))" for r, w in {"K": 1.0, "R": 1.0, "H": 0.1, "D": -1.0, "E": -1.0}.items()) + ")"
LONG = f"long as (select category, 'length' as feature, {LEN} as v from peptides union all select category, 'charge', {CHARGE} from peptides)"


@query("a6_describe", f"with {LONG} select feature, {STATS} from long group by 1")
def _(spark, path):
    return sm.describe_by(lengths(spark, path), ["length", "charge"])


@query("a6_describe_by", f"with {LONG} select category, feature, {STATS} from long group by 1, 2")
def _(spark, path):
    return sm.describe_by(lengths(spark, path), ["length", "charge"], "category")


@query(
    "a7_missing_counts",
    """select * from (select 'y' as "column", count(*) - count(y) as n_missing from documents left join scores on id = doc_id
       union all select 's1', count(*) - count(s1) from documents left join scores on id = doc_id
       union all select 'lang', count(*) - count(lang) from documents) where n_missing > 0""",
)
def _(spark, path):
    docs = views.table(spark, path, "documents").select(F.col("doc_id").alias("id"), "lang")
    joined = docs.join(views.scores(spark, path), "id", "left")
    return sm.missing_counts(joined, ["y", "s1", "lang"])


@query("a8_class_balance", f"select y, count(*) as n_rows, {R('count(*) / (select count(*) from scores)::double')} as share from scores group by 1")
def _(spark, path):
    return sm.class_balance(views.scores(spark, path), "y")


@query(
    "a8_prevalence_by",
    f"""select case when ('0x' || substr(md5('42:' || id), 1, 8))::bigint / 4294967296.0::double < 0.9::double then 'train' else 'val' end as split,
        count(*) as n_rows, {R('avg(y)')} as prevalence_y, {R('avg(y2)')} as prevalence_y2 from scores group by 1""",
)
def _(spark, path):
    split = sa.random_split(views.scores(spark, path), "id")
    return sm.prevalence_by(split, "split", ["y", "y2"])


@query(
    "a9_duplicate_vectors",
    f"""select coalesce(sum(n - 1), 0)::bigint as n_duplicates from (select count(*) as n from (
        select {LEN} as l, round({CHARGE}, 6) as c from peptides) group by l, c)""",
)
def _(spark, path):
    rows = lengths(spark, path).withColumn("charge", F.round("charge", 6))
    return sm.duplicate_vectors(rows, ["length", "charge"])


@query(
    "a10_length_stats",
    f"""select min(length(sequence))::int as min_length, max(length(sequence))::int as max_length, {R('median(length(sequence))')} as median_length,
        {R('100.0::double * avg((length(sequence) > 50)::int)')} as pct_over from peptides""",
)
def _(spark, path):
    return sm.length_stats(views.peptides(spark, path))


@query(
    "a11_histogram",
    f"""with r as (select min(value) as lo, (max(value) - min(value)) / 50.0::double as w from events),
      b as (select event_type, least(floor((value - lo) / w), 49)::int as bin, count(*) as n_rows from events, r group by 1, 2)
      select event_type, bin, {R('lo + bin * w')} as bin_from, n_rows, {R('n_rows / ((sum(n_rows) over (partition by event_type))::double * w)')} as density from b, r""",
)
def _(spark, path):
    return sm.histogram(views.table(spark, path, "events"), "value", 50, "event_type")


@query(
    "a12_cluster_share",
    f"""with c as (select cluster_id, count(*) as n from compounds group by 1)
      select k as cluster_id, coalesce(n, 0) as n_rows, {R('100.0::double * coalesce(n, 0) / (select sum(n) from c)')} as pct from range(8) t(k) left join c on k = cluster_id""",
)
def _(spark, path):
    return sm.cluster_share(views.compounds(spark, path), 8)


@query(
    "a13_cluster_profile",
    f"""with r as (select cluster_id, sequence, row_number() over (partition by cluster_id order by md5('42:' || sequence), sequence) as k
        from (select distinct cluster_id, sequence from compounds))
      select cluster_id, (select count(*) from (select distinct cluster_id as c, sequence from compounds) where c = cluster_id) as n_rows,
        {R('(select avg(length(sequence)) from (select distinct cluster_id as c, sequence from compounds) where c = cluster_id)')} as mean_length,
        string_agg(sequence, ';' order by k) as samples from r where k <= 5 group by cluster_id""",
)
def _(spark, path):
    distinct = views.compounds(spark, path).select("cluster_id", "sequence").distinct()
    profile = sm.cluster_profile(distinct, "cluster_id", "sequence", 5)
    return profile.withColumn("samples", F.array_join("samples", ";"))


@query(
    "a14_flag_rates",
    f"""select count(*) as n_rows, count(*) filter (s1 >= 0.55::double) as n_a, count(*) filter (s2 >= 0.38::double) as n_b,
        count(*) filter (s1 >= 0.55::double or s2 >= 0.38::double) as n_either, {R('100.0::double * avg((s1 >= 0.55::double)::int)')} as pct_a,
        {R('100.0::double * avg((s2 >= 0.38::double)::int)')} as pct_b, {R('100.0::double * avg((s1 >= 0.55::double or s2 >= 0.38::double)::int)')} as pct_either,
        {R('avg(s1)')} as mean_a, {R('avg(s2)')} as mean_b from scores""",
)
def _(spark, path):
    return sm.flag_rates(views.scores(spark, path), "s1", 0.55, "s2", 0.38)


@query(
    "a16_run_summary",
    f"""select step, count(*) as n_samples, {R('count(distinct sequence) / count(*)::double')} as unique_ratio, {R('avg(length(sequence))')} as mean_length,
        {R('stddev_samp(length(sequence))')} as std_length, min(length(sequence))::int as min_length, max(length(sequence))::int as max_length,
        {R('avg(reward)')} as mean_reward from compounds group by 1""",
)
def _(spark, path):
    return sm.run_summary(views.compounds(spark, path))


@query(
    "a17_residue_entropy",
    f"""with c as (select source_db, substr(sequence, i::int, 1) as ch, count(*) as n from (
          select source_db, sequence, unnest(range(1, length(sequence) + 1)) as i from peptides) group by 1, 2),
        f as (select source_db, n / (sum(n) over (partition by source_db))::double as q from c)
      select source_db, {R('-sum(q * log2(q)) / log2(20)')} as entropy from f group by 1""",
)
def _(spark, path):
    return sm.residue_entropy(views.peptides(spark, path), "source_db")


@query(
    "a18_kmer_diversity",
    f"""with k as (select source_db, substr(sequence, i::int, 2) as k from (
          select source_db, sequence, unnest(range(1, length(sequence))) as i from peptides))
      select source_db, count(distinct k) as n_distinct, count(*) as n_total, {R('count(distinct k) / count(*)::double')} as diversity from k group by 1""",
)
def _(spark, path):
    return sm.kmer_diversity(views.peptides(spark, path), "source_db")


@query(
    "a19_novelty_rate",
    f"""with d as (select run, sequence, count(*) as n from compounds group by 1, 2)
      select run, sum(n)::bigint as n_samples, {R('count(*) / sum(n)::double')} as unique_ratio,
        {R('count(*) filter (sequence not in (select sequence from training)) / sum(n)::double')} as novelty_rate from d group by 1""",
)
def _(spark, path):
    return sm.novelty_rate(views.compounds(spark, path), views.training(spark, path), "run")

"""Queries over classifier metrics and feature statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scales
from ..functions import sequences as sq
from ..operators import metrics as me
from ..operators import statistics as st
from . import views
from .descriptor_queries import count, per_length, weighted
from .registry import R, query

MODELS = "long as (select y, 's1' as model, s1 as s from scores union all select y, 's2', s2 from scores)"


def auc_sql(source: str, group: str = "", y: str = "y", s: str = "s") -> str:
    """Common table expressions ending in ``auc(group, a)`` by the rank formula."""
    g = f"{group}, " if group else ""
    by = f"partition by {group} " if group else ""
    tail = f"group by {group}" if group else ""
    return f"""sc as (select {g}{s} as s, sum({y})::double as p, count(*)::double as c from {source} group by {g}{s}),
      rk as (select *, coalesce(sum(c) over ({by}order by s rows between unbounded preceding and 1 preceding), 0) as below from sc),
      auc as (select {g}(sum(p * (below + (c + 1) / 2)) - sum(p) * (sum(p) + 1) / 2) / nullif(sum(p) * (sum(c) - sum(p)), 0) as a from rk {tail})"""


def ap_sql(source: str, group: str) -> str:
    return f"""dc as (select {group}, s, sum(y)::double as p, count(*)::double as c from {source} group by 1, 2),
      cu as (select *, sum(p) over w as tp, sum(c) over w as n from dc window w as (partition by {group} order by s desc)),
      ap as (select {group}, sum(p * tp / n) / sum(p) as average_precision from cu group by 1)"""


CONFUSION = """count(*) filter (y = 1 and s >= 0.5::double) as tp, count(*) filter (y = 0 and s >= 0.5::double) as fp,
    count(*) filter (y = 0 and s < 0.5::double) as tn, count(*) filter (y = 1 and s < 0.5::double) as fn"""
MCC = "coalesce((tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"
PRECISION = "coalesce(tp::double / nullif(tp + fp, 0), 0)"
RECALL = "coalesce(tp::double / nullif(tp + fn, 0), 0)"
F1 = "coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0)"


def long(spark, path):
    return me.model_long(views.scores(spark, path), "y", ["s1", "s2"])


@query("q1_auroc", f"with {MODELS}, {auc_sql('long', 'model')} select model, {R('a')} as auroc from auc")
def _(spark, path):
    return me.auroc(long(spark, path), "y", "score", ["model"])


@query("q1_auroc_overall", f"with {auc_sql('scores', s='s1')} select {R('a')} as auroc from auc")
def _(spark, path):
    return me.auroc(views.scores(spark, path), "y", "s1")


@query(
    "q1_auroc_large",
    f"""with {auc_sql("(select (l_returnflag = 'R')::int as y, l_linestatus as g, l_extendedprice * (1 - l_discount) as s from lineitem)", 'g')}
       select g as l_linestatus, {R('a')} as auroc from auc""",
)
def _(spark, path):
    items = views.table(spark, path, "lineitem").select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"),
    )
    return me.auroc(items, "y", "s", ["l_linestatus"])


@query("q2_average_precision", f"with {MODELS}, {ap_sql('long', 'model')} select model, {R('average_precision')} as average_precision from ap")
def _(spark, path):
    return me.average_precision(long(spark, path), "y", "score", ["model"])


@query(
    "q3_auprc_interpolated",
    f"""with {MODELS}, dc as (select model, s, sum(y)::double as p, count(*)::double as c from long group by 1, 2),
      cu as (select *, sum(p) over w as tp, sum(c) over w - sum(p) over w as fp from dc window w as (partition by model order by s desc)),
      seg as (select *, tp - p as t0, fp - (c - p) as f0 from cu where p > 0),
      k as (select *, 1 + (fp - f0) / (tp - t0) as a, f0 - (fp - f0) / (tp - t0) * t0 as b from seg)
      select model, {R('sum((tp - t0) / a - case when a * t0 + b > 0 then b / (a * a) * ln((a * tp + b) / (a * t0 + b)) else 0 end) / sum(p)')} as auprc_interpolated from k group by 1""",
)
def _(spark, path):
    return me.auprc_interpolated(long(spark, path), "y", "score", ["model"])


@query(
    "q4_classification_report",
    f"""with {MODELS}, c as (select model, {CONFUSION} from long group by 1)
      select model, tp, fp, tn, fn, {R(PRECISION)} as precision, {R(RECALL)} as recall, {R(F1)} as f1, {R(MCC)} as mcc from c""",
)
def _(spark, path):
    return me.classification_report(long(spark, path), "y", "score", 0.5, ["model"])


@query(
    "q5_sensitivity",
    f"""with {MODELS} select model as task, count(*) as n_filtered, sum((s >= 0.5::double)::int)::bigint as n_correct,
       {R('avg((s >= 0.5::double)::int)')} as sensitivity from long where y = 1 group by 1""",
)
def _(spark, path):
    positives = long(spark, path).filter("y = 1").select(F.col("model").alias("task"), (F.col("score") >= 0.5).cast("int").alias("pred"))
    return me.sensitivity(positives)


SWEEP = f"""with {MODELS}, g as (select (5 + i) / 100.0::double as t from range(91) r(i)),
      c as (select model, t, count(*) filter (y = 1 and round(s, 9) >= t) as tp, count(*) filter (y = 0 and round(s, 9) >= t) as fp,
        count(*) filter (y = 0 and round(s, 9) < t) as tn, count(*) filter (y = 1 and round(s, 9) < t) as fn from long, g group by 1, 2),
      m as (select *, {MCC} as mcc from c)"""


@query("q6_threshold_sweep", SWEEP + f" select model, {R('t')} as threshold, {R('mcc')} as metric, tp, fp, tn, fn from m")
def _(spark, path):
    return me.threshold_sweep(long(spark, path), "y", "score", ["model"])


@query(
    "q6_best_threshold",
    SWEEP + f" select model, {R('t')} as threshold, {R('mcc')} as metric from (select *, row_number() over (partition by model order by round(mcc, 12) desc, t) as k from m) where k = 1",
)
def _(spark, path):
    return me.best_threshold(long(spark, path), "y", "score", ["model"])


CDF = " + ".join(f"(u >= ({b})::double)::int" for b in me.POISSON_ONE)
WEIGHTS = f"""digests as (select id, y, s1, s2, draw, md5('42:' || draw || ':' || id) as h from (select *, unnest(range(250))::int as draw from scores)),
  reps as (select id, y, s1, s2, draw * 4 + j as replicate, {CDF} as w from (
    select *, ('0x' || substr(h, (1 + 8 * j)::int, 8))::bigint / 4294967296.0::double as u from (select *, unnest(range(4))::int as j from digests)))"""


@query(
    "q7_bootstrap_auroc",
    f"""with {WEIGHTS}, l as (select 's1' as model, replicate, y, s1 as s, w from reps where w > 0 union all select 's2', replicate, y, s2, w from reps where w > 0),
      sc as (select model, replicate, s, sum(w * y)::double as p, sum(w)::double as c from l group by 1, 2, 3),
      rk as (select *, coalesce(sum(c) over (partition by model, replicate order by s rows between unbounded preceding and 1 preceding), 0) as below from sc),
      auc as (select model, replicate, (sum(p * (below + (c + 1) / 2)) - sum(p) * (sum(p) + 1) / 2) / nullif(sum(p) * (sum(c) - sum(p)), 0) as a from rk group by 1, 2)
      select model, {R('avg(a)')} as mean, {R('quantile_cont(a, 0.025)')} as lower, {R('quantile_cont(a, 0.975)')} as upper, count(a) as n_replicates from auc where a is not null group by 1""",
)
def _(spark, path):
    return me.bootstrap_auroc(views.scores(spark, path), "id", "y", ["s1", "s2"])


def _mcc_of(side: str) -> str:
    s = f"{side} >= 0.5::double"
    parts = {
        "tp": f"sum(w) filter (y = 1 and {s})", "fp": f"sum(w) filter (y = 0 and {s})",
        "tn": f"sum(w) filter (y = 0 and not {s})", "fn": f"sum(w) filter (y = 1 and not {s})",
    }
    return ", ".join(f"coalesce({e}, 0)::bigint as {n}" for n, e in parts.items())


@query(
    "q8_bootstrap_diff",
    f"""with {WEIGHTS}, a as (select replicate, {MCC} as m from (select replicate, {_mcc_of('s1')} from reps group by 1)),
      b as (select replicate, {MCC} as m from (select replicate, {_mcc_of('s2')} from reps group by 1)),
      d as (select a.m - b.m as d from a join b using (replicate))
      select {R('avg(d)')} as mean_diff, {R('quantile_cont(d, 0.025)')} as lower, {R('quantile_cont(d, 0.975)')} as upper, count(*) as n_replicates from d""",
)
def _(spark, path):
    return me.bootstrap_diff(views.scores(spark, path), "id", "y", "s1", "s2")


@query(
    "q9_compare_models",
    f"""with {MODELS}, {auc_sql('long', 'model')}, {ap_sql('long', 'model')}, c as (select model, {CONFUSION} from long group by 1)
      select model, {R('a')} as auroc, {R('average_precision')} as average_precision, {R(F1)} as f1, {R(MCC)} as mcc,
        {R(PRECISION)} as precision, {R(RECALL)} as recall from auc join ap using (model) join c using (model)""",
)
def _(spark, path):
    return me.compare_models(views.scores(spark, path), "y", ["s1", "s2"])


# Features of labelled documents: whole cleaned text, a few descriptors and the label.

DOC = "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g')"
FEATURES = {
    "length": "length(sequence)::double",
    "gravy": per_length(weighted(scales.KYTE_DOOLITTLE)),
    "net_charge": weighted(scales.CHARGES),
    "hydrophobic": per_length(count(scales.HYDROPHOBIC)),
    "boman": per_length(weighted(scales.BOMAN)),
}
DOCS = f"""docs as (select doc_id, quality as y, toxic as y2, {", ".join(f"{e} as {n}" for n, e in FEATURES.items())}
    from (select doc_id, quality, toxic, {DOC} as sequence from documents join labels using (doc_id)) where sequence <> '')"""


def labelled(spark, path):
    docs = views.spread(views.table(spark, path, "documents").select("doc_id", "text"), "doc_id")
    labels = views.table(spark, path, "labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("y2"))
    # Only labelled texts are cleaned and counted.
    clean = docs.join(labels, "doc_id").select("doc_id", "y", "y2", sq.once(views.letters(F.col("text"))).alias("sequence")).filter("sequence <> ''")
    c = "sequence"
    return clean.select(
        "doc_id", F.length(c).cast("double").alias("length"), sq.gravy(c).alias("gravy"), sq.net_charge(c).alias("net_charge"),
        sq.hydrophobic_ratio(c).alias("hydrophobic"), sq.boman_index(c).alias("boman"), "y", "y2",
    )


NAMES = list(FEATURES)
UNPIVOT = "long as (" + " union all ".join(f"select y, '{n}' as feature, round({n}, 9) as s from docs" for n in FEATURES) + ")"


def stable(spark, path):
    """Features rounded so that ties do not depend on the order of summation."""
    return labelled(spark, path).select("doc_id", "y", "y2", *[F.round(n, 9).alias(n) for n in NAMES])


@query(
    "q10_leak_check",
    f"""with {DOCS}, {UNPIVOT}, {auc_sql('long', 'feature')} select feature, {R('greatest(a, 1 - a)')} as univariate_auc, greatest(a, 1 - a) > 0.9::double as suspicious from auc""",
)
def _(spark, path):
    return me.leak_check(stable(spark, path), NAMES, "y")


BOUNDS = """q as (select feature, quantile_cont(s, 0.25) as a, quantile_cont(s, 0.75) as b from long group by 1),
      fences as (select feature, a - {k} * (b - a) as lower, b + {k} * (b - a) as upper from q)"""


@query("q11_iqr_bounds", f"with {DOCS}, {UNPIVOT}, {BOUNDS.format(k='1.5::double')} select feature, {R('lower')} as lower, {R('upper')} as upper from fences")
def _(spark, path):
    return st.iqr_bounds(stable(spark, path), NAMES, 1.5)


def _outside(n: str) -> str:
    return f"(round({n}, 9) < (select lower from fences where feature = '{n}') or round({n}, 9) > (select upper from fences where feature = '{n}'))"


ANY = " or ".join(_outside(n) for n in FEATURES)


@query(
    "q11_iqr_outliers",
    f"with {DOCS}, {UNPIVOT}, {BOUNDS.format(k='1.5::double')}, n as (select y, count(*) as n_rows from docs group by 1) "
    + " union all ".join(
        f"select y, n_rows, 'out_{n}' as flag, count(doc_id) as n_outliers, {R('100.0::double * count(doc_id) / n_rows')} as pct from n left join (select * from docs where {_outside(n)}) using (y) group by y, n_rows"
        for n in FEATURES
    )
    + f" union all select y, n_rows, 'is_outlier', count(doc_id), {R('100.0::double * count(doc_id) / n_rows')} from n left join (select * from docs where {ANY}) using (y) group by y, n_rows",
)
def _(spark, path):
    return st.iqr_outliers(stable(spark, path), NAMES, 1.5, "y")


@query("q11_remove_outliers", f"with {DOCS}, {UNPIVOT}, {BOUNDS.format(k='3')} select doc_id, y from docs where not ({ANY})")
def _(spark, path):
    return st.remove_outliers(stable(spark, path), NAMES, 3.0).select("doc_id", "y")


PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1:]]


@query(
    "q12_high_correlation",
    f"with {DOCS}, r as (" + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, corr({a}, {b}) as c from docs" for a, b in PAIRS)
    + f") select feature_a, feature_b, {R('c')} as correlation from r where abs(c) > 0.3::double",
)
def _(spark, path):
    return st.high_correlation(labelled(spark, path), NAMES, 0.3)


CROSS = """feats as (select embedding, label::double as label, list_sum(list_transform(embedding, lambda x: x::double)) as total,
      list_max(embedding)::double as peak from embeddings),
    dims as (select unnest(range(len(embedding))) as d, unnest(embedding)::double as v, label, total, peak from feats),
    cross_corr as (select 'dim_' || d as dim, 'label' as feature, corr(v, label) as c from dims group by d
      union all select 'dim_' || d, 'total', corr(v, total) from dims group by d union all select 'dim_' || d, 'peak', corr(v, peak) from dims group by d)"""


def cross(spark, path):
    e = views.table(spark, path, "embeddings")
    doubles = F.col("embedding").cast("array<double>")
    feats = e.select(
        "embedding", "label", F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max(doubles).alias("peak")
    )
    return st.correlate_blocks(feats, "embedding", ["label", "total", "peak"])


@query("q13_correlate_blocks", f"with {CROSS} select dim, feature, {R('c')} as correlation from cross_corr")
def _(spark, path):
    return cross(spark, path)


BEST = """best as (select dim, feature, c, row_number() over (partition by dim order by abs(c) desc, feature desc) as k from cross_corr)"""
TIER = "case when abs(c) >= 0.5::double then 'meaningful' when abs(c) >= 0.3::double then 'weak' else 'none' end"


@query("w10_best_match", f"with {CROSS}, {BEST} select dim, feature, {R('c')} as correlation, {TIER} as tier from best where k = 1")
def _(spark, path):
    return st.interpret_dims(cross(spark, path))


@query("q13_tier_counts", f"with {CROSS}, {BEST} select {TIER} as tier, count(*) as n_dims from best where k = 1 group by 1")
def _(spark, path):
    return st.tier_counts(st.interpret_dims(cross(spark, path)))


@query(
    "q14_rank_contributions",
    f"""with d as (select unnest(range(len(embedding))) as d, unnest(embedding)::double as v from embeddings)
      select 'dim_' || d as feature, {R('avg(abs(v))')} as mean_abs from d group by d order by avg(abs(v)) desc, feature limit 15""",
)
def _(spark, path):
    e = views.table(spark, path, "embeddings")
    contributions = e.select(F.posexplode("embedding").alias("d", "v")).select(
        F.concat(F.lit("dim_"), "d").alias("feature"), F.col("v").cast("double").alias("contribution")
    )
    return st.rank_contributions(contributions, 15)


SCRAMBLE = """array_to_string(list_transform(list_sort(list_transform(range(length(sequence)), lambda i:
    {'h': md5('42:' || sequence || ':' || i), 'i': i, 'ch': substr(sequence, i + 1, 1)})), lambda s: s.ch), '')"""
ADJACENT = "(select count(*) from unnest(range(1, length({s}))) t(i) where substr({s}, i::int, 1) = substr({s}, i::int + 1, 1))"


@query(
    "q15_control_gap",
    f"""with c as (select id, sequence as a, {SCRAMBLE} as b from peptides),
      pairs as (select id, 'a' as side, unnest(range(1, length(a))) as i, a as s from c union all select id, 'b', unnest(range(1, length(b))), b from c),
      n as (select id, sum((side = 'a' and substr(s, i::int, 1) = substr(s, i::int + 1, 1))::int) as x,
          sum((side = 'b' and substr(s, i::int, 1) = substr(s, i::int + 1, 1))::int) as y from pairs group by 1)
      select id, {R('coalesce(x, 0) / length(a)::double')} as score, {R('coalesce(y, 0) / length(a)::double')} as control_score,
        {R('(coalesce(x, 0) - coalesce(y, 0)) / length(a)::double')} as gap from c left join n using (id)""",
)
def _(spark, path):
    # A score that depends on order: the share of residues equal to their right neighbour.
    doubled = {a + a: 0.1 for a in scales.STANDARD}
    p = views.peptides(spark, path).select("id", "sequence")
    return st.scrambled_gap(p, "id", lambda c: sq.dipeptide_index(c, doubled))


@query(
    "q16_kl_estimate",
    f"""with t as (select doc_id, -('0x' || substr(md5('p:' || doc_id || ':' || pos), 1, 4))::bigint / 20000.0::double as p,
          -('0x' || substr(md5('r:' || doc_id || ':' || pos), 1, 4))::bigint / 20000.0::double as r, (sequence <> '')::int::double as m from records)
      select doc_id, {R('sum(p * m) / greatest(sum(m), 1)')} as mean_logprob, {R('sum((exp(r - p) - (r - p) - 1) * m) / greatest(sum(m), 1)')} as kl from t group by 1""",
)
def _(spark, path):
    from ..functions.hashing import hash_hex, hex_int

    t = views.records(spark, path).select(
        "doc_id",
        (-hex_int(hash_hex("p", "doc_id", "pos"), 4) / F.lit(20000.0)).alias("policy_logprob"),
        (-hex_int(hash_hex("r", "doc_id", "pos"), 4) / F.lit(20000.0)).alias("ref_logprob"),
        (F.col("sequence") != "").cast("double").alias("mask"),
    )
    return st.kl_estimate(t, "doc_id")


@query(
    "q17_metric_by_bin",
    f"""with {DOCS}, b as (select docs.y as y, s1 as s, case when length >= 50 and length < 500 then '50-500' when length >= 500 and length < 2000 then '500-2000' else 'outside' end as bin
        from docs join scores on id = doc_id), c as (select bin, {CONFUSION} from b group by 1)
      select bin, tp, fp, tn, fn, {R(PRECISION)} as precision, {R(RECALL)} as recall, {R(F1)} as f1, {R(MCC)} as mcc from c""",
)
def _(spark, path):
    s = views.scores(spark, path).select(F.col("id").alias("doc_id"), "s1")
    joined = labelled(spark, path).join(s, "doc_id")
    return me.metric_by_bin(joined, "length", [50, 500, 2000], "y", "s1")


@query(
    "e3_pluggable_metric",
    SWEEP.replace("m as (select *, " + MCC + " as mcc from c)", "m as (select *, " + F1 + " as mcc from c)")
    + f" select model, {R('t')} as threshold, {R('mcc')} as metric from (select *, row_number() over (partition by model order by round(mcc, 12) desc, t) as k from m) where k = 1",
)
def _(spark, path):
    return me.best_threshold(long(spark, path), "y", "score", ["model"], metric=me.f1)

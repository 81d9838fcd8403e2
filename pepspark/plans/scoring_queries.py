"""Queries over composite scores, scorers, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scales
from ..functions.hashing import hash_unit
from ..operators import metrics as me
from ..operators import scoring as sc
from ..operators import training as tr
from ..session import ensure_checkpoint_dir
from ..streaming import monitor as mo
from . import views
from .descriptor_queries import CHARGE, CHARGE7, GAUSS, L, MOMENT, MOMENT_VALUE, count, per_length, soft, weighted
from .metric_queries import NAMES, labelled
from .registry import R, query

UNIT = "('0x' || substr(md5('{0}:' || id), 1, 8))::bigint / 4294967296.0::double"


def inputs(spark, path):
    """Sequences with the scores that outside models would supply."""
    return views.peptides(spark, path).select(
        "id", "sequence", *[hash_unit(n, "id").alias(n) for n in ("model_score", "penalty", "bonus", "hemolysis", "toxicity", "domain")]
    )


TERMS = {
    "model2": (UNIT.format("model_score"), 1.0),
    "charge": (soft(f"round({CHARGE}, 9)", 2, 9, 2), 0.5),
    "length": (GAUSS, 0.2),
    "hydrophobic_moment": (f"least(({MOMENT_VALUE}) / 0.65::double, 1)", 0.2),
    "diversity_penalty": (f"-({UNIT.format('penalty')})", 0.3),
    "class_diversity": (UNIT.format("bonus"), 0.25),
    "hemolysis_penalty": (f"1 - {UNIT.format('hemolysis')}", 0.4),
    "toxicity_penalty": (f"1 - {UNIT.format('toxicity')}", 0.4),
}


@query(
    "r1_composite_score",
    f"with {MOMENT}, t as (select id, " + ", ".join(f"({e})::double as {n}" for n, (e, _) in TERMS.items()) + " from moments) select id, "
    + ", ".join(f"{R(n)} as {n}" for n in TERMS) + ", " + R(" + ".join(f"{n} * {w}::double" for n, (_, w) in TERMS.items())) + " as total from t",
)
def _(spark, path):
    terms = sc.reward_terms(penalty="penalty", class_bonus="bonus", hemolysis="hemolysis", toxicity="toxicity")
    scored = sc.composite_score(inputs(spark, path), terms, {"charge": 0.5})
    return scored.select("id", "terms.*", "total")


EARLIER = {
    "model2": (UNIT.format("model_score"), 1.0),
    "charge": (soft(f"round({CHARGE}, 9)", 2, 9, 2), 0.3),
    "length": (soft(L, 15, 50, 5), 0.2),
    "hydrophobic_moment": (f"least(({MOMENT_VALUE}) / 0.5::double, 1)", 0.2),
    "ad_penalty": (f"-({UNIT.format('domain')})", 0.5),
    "diversity_penalty": (f"-({UNIT.format('penalty')})", 0.3),
}


@query(
    "r1_composite_score_earlier",
    f"with {MOMENT} select id, " + R(" + ".join(f"({e})::double * {w}::double" for e, w in EARLIER.values())) + " as total from moments",
)
def _(spark, path):
    terms = sc.reward_terms(penalty="penalty", domain_penalty="domain", moment_cap=0.5, gaussian_length=False)
    return sc.composite_score(inputs(spark, path), terms, defaults=sc.EARLIER_WEIGHTS).select("id", "total")


@query(
    "r2_class_diversity",
    f"""with nat as (select cluster_id, count(*) / (sum(count(*)) over ())::double as f from compounds where run < 'src2' group by 1)
      select run, step, rid, cluster_id, {R('0.5::double * (1 - coalesce(f, 0)) + 0.5::double / sqrt(row_number() over (partition by run, cluster_id order by step, rid))')} as class_bonus
      from compounds left join nat using (cluster_id)""",
)
def _(spark, path):
    log = views.compounds(spark, path)
    scored = sc.class_diversity(log, log.filter("run < 'src2'"), order=["step", "rid"])
    return scored.select("run", "step", "rid", "cluster_id", "class_bonus")


GATE = {"gravy": 0.8, "charge_at_pH7": 0.05, "aromaticity": -2.0}


def gate(df):
    return df.withColumn("probability", sc.linear_probability(GATE, 0.4))


GATE_Z = f"0.8::double * ({per_length(weighted(scales.KYTE_DOOLITTLE))}) + 0.05::double * {CHARGE7} - 2.0::double * ({per_length(count('FWY'))}) + 0.4::double"
GATED = f"""checked as (select doc_id, pos, s as sequence, length(s) as len, case when s = '' then 'empty sequence'
        when regexp_matches(s, '[^ACDEFGHIKLMNPQRSTVWY]') then 'contains non-standard amino acid characters'
        when length(s) < 5 then 'below 5aa — outside the model''s training length range'
        when length(s) > 100 then 'above 100aa — outside the model''s training length range' else '' end as invalid_reason
      from (select doc_id, pos, upper(trim(sequence)) as s from records)),
    scored as (select *, case when invalid_reason = '' then round(1 / (1 + exp(-({GATE_Z}))), 9) end as probability from checked)"""


@query(
    "r7_score_table",
    f"""with {GATED} select doc_id, pos, invalid_reason, {R('probability')} as probability,
      case when probability is null then '' when round(probability, 9) >= 0.5::double then 'AMP' else 'non-AMP' end as prediction,
      case when invalid_reason = '' and len < 15 then 1 else 0 end::int as low_confidence from scored""",
)
def _(spark, path):
    def rounded_gate(df):
        return gate(df).withColumn("probability", F.round("probability", 9))

    table = sc.score_table(views.words(spark, path), rounded_gate, 0.5)
    return table.select(
        "doc_id", "pos", "invalid_reason", "probability", "prediction", (F.col("confidence_note") != "").cast("int").alias("low_confidence")
    )


HEADS_SQL = {"gram_positive": f"1 / (1 + exp(-(2.0::double * ({per_length(count('K'))}))))", "fungal": f"1 / (1 + exp(-(1.5::double * ({per_length(count('G'))}) - 0.1::double)))"}


def heads():
    return {
        "gram_positive": (F.round(sc.linear_probability({"frac_K": 2.0}), 9), 0.52),
        "fungal": (F.round(sc.linear_probability({"frac_G": 1.5}, -0.1), 9), 0.48),
    }


@query(
    "r7_spectrum",
    "select id, " + ", ".join(f"{R(f"round({e}, 9)")} as {t}_prob, (round({e}, 9) >= {c}::double)::int as {t}_pred" for (t, e), c in zip(HEADS_SQL.items(), (0.52, 0.48))) + " from peptides",
)
def _(spark, path):
    return sc.spectrum(views.peptides(spark, path).select("id", "sequence"), heads()).drop("sequence")


@query(
    "r8_cascade",
    f"with {GATED} select doc_id, pos, {R('probability')} as gate_probability, "
    + ", ".join(f"{R(f"round({e}, 9)")} as {t}_prob, (round({e}, 9) >= {c}::double)::int as {t}_pred" for (t, e), c in zip(HEADS_SQL.items(), (0.52, 0.48)))
    + " from scored where round(probability, 9) >= 0.5::double",
)
def _(spark, path):
    def rounded_gate(df):
        return gate(df).withColumn("probability", F.round("probability", 9))

    return sc.cascade(views.words(spark, path), rounded_gate, 0.5, heads()).drop("sequence")


# Model jobs

def modelling(spark, path):
    rows = labelled(spark, path)
    u = hash_unit("model split", "doc_id")
    return rows.withColumn("split", F.when(u < 0.7, "train").when(u < 0.85, "val").otherwise("test"))


@query("r4_train_gbt")
def _(spark, path):
    rows = modelling(spark, path).cache()
    model = tr.train_gbt(rows, "y", NAMES, maxIter=10)
    return me.classification_report(tr.predict_gbt(model, rows, "y", NAMES), "y", "p", 0.5, ["split"])


@query("r5_search_gbt")
def _(spark, path):
    space = {**tr.SEARCH_SPACE, "maxIter": (4, 8, "int"), "maxDepth": (2, 4, "int")}
    _, trials = tr.search_gbt(modelling(spark, path), "y", NAMES, n=2, space=space)
    return trials


@query("r6_ablation")
def _(spark, path):
    rows = modelling(spark, path).cache()
    return tr.ablation(rows, {"size": ["length"], "all": NAMES}, ["y"], maxIter=5, maxDepth=3)


# Scorers

def charge_batches(batches):
    """Net charge of whole batches; stands for a model loaded once per worker."""
    import pandas as pd

    for batch in batches:
        yield pd.Series(
            sum(w * batch.str.count(r) for r, w in {"K": 1.0, "R": 1.0, "H": 0.1, "D": -1.0, "E": -1.0}.items()), dtype="float64"
        )


@query("e1_e2_score_column", f"select id, {R(CHARGE)} as charge_score from peptides")
def _(spark, path):
    sc.register_scorer("charge", charge_batches)
    return sc.score_column(views.peptides(spark, path).select("id", "sequence"), "charge").select("id", "charge_score")


# Streams over the same log, drained and read back

def _folder(spark) -> str:
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(
    "t1_monitor_stream",
    f"""select (select count(*) from compounds) as n_rows, (select max(step) from compounds) as latest_step,
        {R('(select avg(reward) from (select reward from compounds order by step desc, rid desc limit 100))')} as mean_recent""",
)
def _(spark, path):
    folder = _folder(spark)
    mo.monitor_stream(views.compound_stream(spark, path), folder, once=True, order=("step", "rid")).awaitTermination()
    report = mo.progress(spark, folder)
    return report.orderBy(F.desc("batch")).limit(1).select("n_rows", "latest_step", "mean_recent")


def _growing_log(spark, path, slices: int = 4):
    """The whole compound log as a stream that grows in the order of steps, yielded again after each slice.

    A slice begins at a step and holds all rows up to the next one's, about as many as
    the others; it is written by all tasks, and whoever follows the log takes it before the next comes.
    """
    folder = f"{_folder(spark)}/log"
    log = views.compounds(spark, path).persist()
    cuts = sorted({int(c) for c in log.approxQuantile("step", [i / slices for i in range(1, slices)], 0.01)})
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = log if low is None else log.filter(F.col("step") > low)
        (part if high is None else part.filter(F.col("step") <= high)).write.mode("append").parquet(folder)
        yield mo.read_compounds(spark, folder, log.schema, "parquet")
    log.unpersist()


@query(
    "t2_novel_stream",
    f"""select run, step, rid, sequence, {R('reward')} as reward, cluster_id from (
        select *, row_number() over (partition by sequence order by step, rid) as k from compounds
        where sequence not in (select sequence from training)) where k = 1""",
)
def _(spark, path):
    folder = _folder(spark)
    for log in _growing_log(spark, path):  # each start goes on from the checkpoint of the one before
        novel = mo.novel_stream(log, views.training(spark, path), order=("step", "rid"))
        mo.write_stream(novel, folder, "update", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


@query("t3_step_metrics_stream", f"select step, count(*) as n_new, {R('avg(reward)')} as mean_reward from compounds group by 1")
def _(spark, path):
    folder = _folder(spark)
    mo.write_stream(mo.step_metrics_stream(views.compound_stream(spark, path)), folder, "update", once=True).awaitTermination()
    return mo.latest_rows(spark, folder, ["step"])


@query(
    "t4_visitation_stream",
    f"""select run, step, rid, cluster_id, {R('1 / sqrt(row_number() over (partition by run, cluster_id order by step, rid))')} as visit_bonus from compounds""",
)
def _(spark, path):
    folder = _folder(spark)
    for log in _growing_log(spark, path):
        mo.visitation_stream(log, folder, order=("step", "rid"), once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("run", "step", "rid", "cluster_id", "visit_bonus")


@query("t5_resume", "select run, count(*) as n_rows from compounds group by 1")
def _(spark, path):
    folder = _folder(spark)
    for _ in range(2):  # the second start finds its checkpoint and adds nothing
        stream = views.compound_stream(spark, path).select("run", "step", "rid")
        mo.write_stream(stream, folder, once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"))

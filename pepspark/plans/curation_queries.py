"""Queries over sources, filters, joins and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import curation as cu
from ..operators import summaries as sm
from ..session import ensure_checkpoint_dir
from ..sources import fasta, logs, records as rec, tabular
from . import views
from .registry import R, query

STD = "regexp_matches(sequence, '[^ACDEFGHIKLMNPQRSTVWY]')"
NORMAL = """norm as (select doc_id, pos, source_db, source_id, category, upper(trim(sequence)) as sequence,
    length(trim(sequence)) as sequence_length, regexp_matches(sequence, '[a-z]') as had_lowercase,
    regexp_matches(upper(trim(sequence)), '[^ACDEFGHIKLMNPQRSTVWY]') as has_nonstandard_char
  from records where length(trim(sequence)) > 0)"""


def normalized(spark, path):
    return cu.normalize(cu.drop_blank(views.records(spark, path)))


# Sources and sinks

@query("s1_parse_fasta", "select id, sequence from peptides")
def _(spark, path):
    p = views.peptides(spark, path)
    folded = p.select(F.concat(F.lit(">"), "id", F.lit("\n"), F.regexp_replace("sequence", "(.{60})", "$1\n")).alias("value"))
    return fasta.parse_fasta(folded)


@query("s2_fasta_banner", "select id, sequence from peptides")
def _(spark, path):
    p = views.peptides(spark, path)
    rows = fasta.fasta_records(p)
    banner = p.groupBy("source_db").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit(">Your search led to "), "n", F.lit(" peptides\n")).alias("value")
    )
    return fasta.parse_fasta(rows.unionByName(banner), skip_header_like="search led to")


def folder(spark, name: str) -> str:
    """A new place in the shared folder for files that a query writes and reads back."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}/{name}"


@query("s3_read_csv_column", "select id, sequence as peptide, sequence from peptides")
def _(spark, path):
    place = folder(spark, "peptides.csv")
    tabular.write_csv(views.peptides(spark, path).select("id", F.col("sequence").alias("peptide")), place)
    return tabular.read_sequences(spark, place, "peptide")


@query("s4_read_text", "select sequence from peptides")
def _(spark, path):
    place = folder(spark, "peptides.txt")
    p = views.peptides(spark, path)
    # Blank lines and white space around a sequence do not count.
    p.select(F.concat(F.lit(" "), "sequence", F.when(F.col("pos") % 2 == 0, "\n  ").otherwise("")).alias("value")).write.text(place)
    return tabular.read_sequences(spark, place)


@query("s5_literal_sequences", "select n_name as sequence from nation")
def _(spark, path):
    return tabular.sequences_df(spark, [r.n_name for r in views.table(spark, path, "nation").select("n_name").collect()])


@query(
    "s6_merge_columns",
    """select sequence from (select sequence from peptides union select sequence from training)""",
)
def _(spark, path):
    p, one, two = views.peptides(spark, path), folder(spark, "one"), folder(spark, "two")
    # Parts under two headers: the column is the last of some files and the first of others.
    tabular.write_csv(p.select("id", "pos", "sequence").repartition(5, "id"), one)
    tabular.write_csv(views.training(spark, path).select("sequence", F.lit("x, y").alias("note")).repartition(2), two)
    return tabular.merge_parts(spark, [f"{one}/*.csv", f"{two}/*.csv"], "sequence")


@query("s7_resolve_column", "select text as sequence, item_id from benchmark")
def _(spark, path):
    return cu.resolve_column(views.table(spark, path, "benchmark"), ["SEQUENCE", "Sequence", "text"])


@query("s8_require_columns", "select doc_id, text from documents")
def _(spark, path):
    return cu.require_columns(views.table(spark, path, "documents"), ["doc_id", "text"]).select("doc_id", "text")


@query(
    "s10_peptide_list",
    """select l_orderkey as id, l_linenumber::varchar as "dbaaspId", l_returnflag as name, l_linestatus as activity from lineitem""",
)
def _(spark, path):
    items = views.table(spark, path, "lineitem")
    entry = F.to_json(
        F.struct(
            F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("string").alias("dbaaspId"),
            F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("activity"),
        )
    )
    pages = items.select(F.concat(F.lit('{"totalCount":1,"data":['), entry, F.lit("]}")).alias("j"))
    parsed = pages.select(F.from_json("j", rec.PAGE_SCHEMA).alias("p")).select("p.*")
    return rec.peptide_list(parsed).select("id", "dbaaspId", "name", "activity")


@query(
    "s11_flatten_activities",
    f"""select user_id as "peptideId", event_type as "targetSpecies", (props::json ->> 'k')::varchar as concentration,
         {R("value")} as activity_float from events""",
)
def _(spark, path):
    events = views.table(spark, path, "events")
    # Names are empty and descriptions filled for half of the types, so both ways of labelling are met.
    named = F.col("event_type") < "m"
    activity = F.struct(
        F.col("user_id").alias("peptideId"),
        F.struct(F.when(named, F.col("event_type")).otherwise("").alias("name"), F.when(~named, F.col("event_type")).alias("description")).alias("targetSpecies"),
        F.get_json_object("props", "$.k").alias("concentration"),
        F.col("value").alias("activity"),
    )
    text = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit("ACD").alias("sequence"), F.array(activity).alias("targetActivities")))
    details = events.select(F.from_json(text, rec.DETAIL_SCHEMA).alias("d")).select("d.*")
    return rec.flatten_activities(details).select("peptideId", "targetSpecies", "concentration", "activity_float")


@query(
    "s12_training_log",
    f"""select o_custkey::int as epoch, (o_orderkey * 7)::int as step, 2000000::int as total_steps, {R("o_totalprice / 100")} as loss,
         o_custkey::bigint * 2000000 + o_orderkey * 7 as global_step from orders""",
)
def _(spark, path):
    o = views.table(spark, path, "orders")
    line = F.concat(
        F.lit("  epoch "), "o_custkey", F.lit(" step "), F.col("o_orderkey") * 7, F.lit("/2000000 loss="),
        F.format_string("%.4f", F.col("o_totalprice") / 100), F.lit(" lr=6.00e-04"),
    )
    epoch = F.concat(F.lit("Epoch "), "o_custkey", F.lit(": train_loss=2.7 val_loss=2.6 time=4.1min"))
    lines = o.select(line.alias("value")).unionByName(o.select(epoch.alias("value")))
    return logs.batch_rows(lines).select("epoch", "step", "total_steps", "loss", "global_step")


@query(
    "s13_step_log",
    f"""select o_orderkey::int as step, 500::int as total_steps, {R("floor(o_totalprice) / 1000")} as mean_reward,
         {R("-floor(o_totalprice) / 1000")} as pg_loss, 0.5::double as charge from orders""",
)
def _(spark, path):
    o = views.table(spark, path, "orders")
    value = F.format_string(
        "%d/500 mean_reward=%.3f std=0.100 pg_loss=-%.3f kl=0.01 total_loss=0.02 time=1.5s\n"
        "  reward terms (mean): model2=0.900 charge=0.500 length=0.400 hmom=0.300 div=-0.100 class_div=0.200\n  -> saved",
        F.col("o_orderkey"), F.floor("o_totalprice") / 1000, F.floor("o_totalprice") / 1000,
    )
    return logs.step_rows(o.select(value.alias("value"))).select("step", "total_steps", "mean_reward", "pg_loss", "charge")


@query(
    "s9_read_tsv",
    """select 'P' || conv_id || '.' || turn as "Entry", role as "Reviewed", length(s)::int as "Length", s as "Sequence"
       from (select *, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g') as s from conversations) where s <> ''""",
)
def _(spark, path):
    place = folder(spark, "background.tsv")
    b = views.background(spark, path)
    empty = [F.lit(None).cast("string").alias(c) for c in ("keyword", "go_id", "protein_name", "organism")]
    rows = b.select(F.concat(F.lit("P"), "id").alias("Entry"), F.col("role").alias("Reviewed"), F.length("sequence").alias("Length"), F.col("sequence").alias("Sequence"), *empty)
    tabular.write_csv(rows, place, "\t")
    return tabular.read_tsv(spark, place, tabular.BACKGROUND_SCHEMA).select("Entry", "Reviewed", "Length", "Sequence")


@query(
    "s14_write_csv",
    """select sequence, string_agg(distinct source_db, ';' order by source_db) as source_dbs, count(*) as n_rows from peptides group by 1""",
)
def _(spark, path):
    place = folder(spark, "positives.csv")
    p = views.peptides(spark, path).groupBy("sequence").agg(F.sort_array(F.collect_set("source_db")).alias("source_dbs"), F.count(F.lit(1)).alias("n_rows"))
    tabular.write_csv(p, place)
    return tabular.read_csv(spark, place, schema="sequence string, source_dbs string, n_rows long")


@query("s16_write_by_category", "select id, sequence, category from peptides")
def _(spark, path):
    place = folder(spark, "by_category")
    tabular.write_by(views.peptides(spark, path).select("id", "sequence", "category"), "category", place)
    parts = [r.category for r in spark.read.parquet(place).select("category").distinct().collect()]  # one folder each
    whole = spark.read.parquet(*[f"{place}/category={c}" for c in parts])
    # Read folder by folder: the category comes from the folder's name.
    return whole.select("id", "sequence", F.regexp_extract(F.col("_metadata.file_path"), "category=([^/]+)", 1).alias("category"))


@query("s15_fasta_records", "select '>' || id || chr(10) || sequence as value from peptides")
def _(spark, path):
    return fasta.fasta_records(views.peptides(spark, path))


@query("s17_remaining", "select id, sequence from peptides where sequence not in (select sequence from training)")
def _(spark, path):
    todo = cu.remaining(views.peptides(spark, path), views.training(spark, path), "sequence")
    return todo.select("id", "sequence")


# Projections and filters

@query(
    "f1_normalize",
    f"with {NORMAL} select doc_id, pos, sequence, sequence_length::int as sequence_length from norm",
)
def _(spark, path):
    return normalized(spark, path).select("doc_id", "pos", "sequence", "sequence_length")


@query(
    "f2_f3_flags",
    f"""with {NORMAL} select had_lowercase, has_nonstandard_char, count(*) as n_rows, count(distinct sequence) as n_sequences
        from norm group by 1, 2""",
)
def _(spark, path):
    return normalized(spark, path).groupBy("had_lowercase", "has_nonstandard_char").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sequence").alias("n_sequences")
    )


@query("f4_drop_blank", "select doc_id, pos, sequence from records where length(trim(sequence)) > 0")
def _(spark, path):
    return cu.drop_blank(views.records(spark, path)).select("doc_id", "pos", "sequence")


@query("f5_length_window", "select id, sequence from peptides where length(sequence) between 11 and 60")
def _(spark, path):
    return cu.length_window(views.peptides(spark, path), 11, 60).select("id", "sequence")


@query(
    "f5_length_window_report",
    """select count(*) as n_before, count(*) filter (length(sequence) < 5) as removed_below,
         count(*) filter (length(sequence) > 100) as removed_above,
         count(*) filter (length(sequence) between 5 and 100) as n_after from peptides""",
)
def _(spark, path):
    return cu.length_window_report(views.peptides(spark, path), 5, 100)


VALID = """checked as (select *, length(s) as length,
    case when length(s) = 0 then 'empty sequence'
         when regexp_matches(s, '[^ACDEFGHIKLMNPQRSTVWY]') then 'contains non-standard amino acid characters'
         when length(s) < 5 then 'below 5aa — outside the model''s training length range'
         when length(s) > 100 then 'above 100aa — outside the model''s training length range'
         else '' end as invalid_reason
  from (select doc_id, pos, upper(trim(sequence)) as s from records))"""


@query(
    "f6_validate",
    f"""with {VALID} select doc_id, pos, s as sequence, length::int as length, invalid_reason, invalid_reason = '' as valid from checked""",
)
def _(spark, path):
    return cu.validate(views.records(spark, path)).select("doc_id", "pos", "sequence", "length", "invalid_reason", "valid")


@query(
    "f7_confidence_note",
    f"""with {VALID} select doc_id, pos, case when invalid_reason = '' and length < 15 then
      'LOW CONFIDENCE: sequence is under 15aa. External validation measured sensitivity as low as 31% in this length range (likely an ESM2 mean-pooling effect, not a training data gap).'
      else '' end as confidence_note from checked""",
)
def _(spark, path):
    return cu.confidence_note(cu.validate(views.records(spark, path))).select("doc_id", "pos", "confidence_note")


@query("f8_apply_threshold", "select id, case when s1 is null then '' when s1 >= 0.5::double then 'AMP' else 'non-AMP' end as prediction from scores")
def _(spark, path):
    return cu.apply_threshold(views.scores(spark, path), 0.5, "s1").select("id", "prediction")


@query(
    "f9_apply_thresholds",
    f"""with cfg as (select 's1' as task, avg(s1) as threshold from scores union all select 's2', avg(s2) from scores),
      l as (select id, 's1' as task, s1 as prob from scores union all select id, 's2', s2 from scores)
      select id, task, {R('prob')} as prob, (round(prob, 9) >= round(threshold, 9))::int as pred from l join cfg using (task)""",
)
def _(spark, path):
    s = views.scores(spark, path)
    long = s.unpivot(["id"], ["s1", "s2"], "task", "prob")
    config = long.groupBy("task").agg(F.round(F.avg("prob"), 9).alias("threshold"))
    scored = cu.apply_thresholds(long.withColumn("prob", F.round("prob", 9)), config)
    return scored.select("id", "task", "prob", "pred")


@query(
    "f10_exclude_terms",
    """select event_id from events where event_type not in ('error', 'click') and (props::json ->> 'k') not in ('69', '29')""",
)
def _(spark, path):
    e = views.table(spark, path, "events").select(
        "event_id", F.concat_ws("; ", "event_type", F.lit("Secreted")).alias("keyword"),
        F.concat_ws("; ", F.lit("0005576"), F.get_json_object("props", "$.k")).alias("go_id"),
    )
    return cu.exclude_terms(e, ["error", "click"], ["69", "29"]).select("event_id")


@query(
    "f11_prune_duplicates",
    f"""select 'l_quantity' as dropped, 'l_linenumber' as kept, {R('max(abs(l_quantity - l_linenumber))')} as max_abs_diff,
          {R('avg(abs(l_quantity - l_linenumber))')} as mean_abs_diff from lineitem
        union all select 'l_tax', 'l_discount', {R('max(abs(l_tax - l_discount))')}, {R('avg(abs(l_tax - l_discount))')} from lineitem""",
)
def _(spark, path):
    return cu.duplicate_evidence(views.table(spark, path, "lineitem"), [("l_quantity", "l_linenumber"), ("l_tax", "l_discount")])


@query(
    "f13_funnel",
    f"""with {NORMAL} , f as (select *, not has_nonstandard_char as a, sequence_length between 11 and 60 as b from norm)
      select 0::int as position, 'all' as step, count(*) as n_rows from f
      union all select 1, 'standard', count(*) from f where a
      union all select 2, 'length', count(*) from f where a and b
      union all select 3, 'distinct', count(distinct sequence) from f where a and b""",
)
def _(spark, path):
    steps = [("standard", ~F.col("has_nonstandard_char")), ("length", F.col("sequence_length").between(11, 60))]
    return cu.funnel(normalized(spark, path), steps, "sequence")


@query("f14_errors", f"select id, y, {R('s1')} as s1 from scores where y = 1 and s1 < 0.5::double")
def _(spark, path):
    s = views.scores(spark, path).withColumn("pred", (F.col("s1") >= 0.5).cast("int"))
    return sm.top_rows(cu.errors(s, "fn"), [F.asc("s1"), F.asc("id")]).select("id", "y", "s1")


# Joins

@query(
    "j1_exclude_known",
    "select id, role, sequence from background b where not exists (select 1 from peptides p where p.sequence = b.sequence)",
)
def _(spark, path):
    return cu.exclude_known(views.background(spark, path), views.peptides(spark, path)).select("id", "role", "sequence")


@query(
    "j2_overlap_report",
    f"""with {NORMAL} , k as (select distinct sequence as ks from external)
      select category, count(*) as n_total, count(ks) as n_overlap, {R('100.0::double * count(ks) / count(*)')} as pct_overlap,
        count(*) - count(ks) as n_novel from norm left join k on sequence = ks group by category""",
)
def _(spark, path):
    return cu.overlap_report(normalized(spark, path), views.external(spark, path), "category")


@query(
    "j3_novel_only",
    f"with {NORMAL} select item_id, pos, sequence from external where sequence not in (select sequence from norm)",
)
def _(spark, path):
    return cu.novel_only(views.external(spark, path), normalized(spark, path)).select("item_id", "pos", "sequence")


@query(
    "j4_memorization",
    f"""select count(*) as n_samples, count(*) filter (sequence in (select sequence from training)) as n_memorized,
        {R("count(*) filter (sequence in (select sequence from training)) / count(*)::double")} as share from peptides""",
)
def _(spark, path):
    return cu.memorization(views.peptides(spark, path), views.training(spark, path))


@query(
    "j5_attach_clusters",
    "select vec_id as id, label as cluster_id from embeddings",
)
def _(spark, path):
    e = views.table(spark, path, "embeddings")
    clusters = e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"))
    return cu.attach_clusters(e.select(F.col("vec_id").alias("id")), clusters, "id")


@query(
    "j6_join_features",
    """select id, length(sequence)::int as length, n_copies from peptides
       join (select sequence, count(*) as n_copies from peptides group by 1) using (sequence)""",
)
def _(spark, path):
    p = views.peptides(spark, path)
    left = p.select("id", "sequence", F.length("sequence").alias("length"))
    right = p.groupBy("sequence").agg(F.count(F.lit(1)).alias("n_copies"))
    return cu.join_features(left, right).select("id", "length", "n_copies")


@query(
    "j7_align_predictions",
    f"select id, y, {R('s1')} as model_a, {R('s2')} as model_b from scores where s1 is not null",
)
def _(spark, path):
    s = views.scores(spark, path)
    predictions = {"model_a": s.select("id", F.col("s1").alias("score")), "model_b": s.select("id", F.col("s2").alias("score"))}
    return cu.align_predictions(s.select("id", "y"), predictions, s.filter("s1 is not null"))


@query("j8_with_predictions", f"select doc_id as id, lang, {R('s1')} as s1 from documents left join scores on id = doc_id")
def _(spark, path):
    docs = views.table(spark, path, "documents").select(F.col("doc_id").alias("id"), "lang")
    return cu.with_predictions(docs, views.scores(spark, path).select("id", "s1"))


@query("j9_attach_scores", f"select doc_id as id, {R('coalesce(s1, 0)')} as s1 from documents left join scores on id = doc_id")
def _(spark, path):
    docs = views.table(spark, path, "documents").select(F.col("doc_id").alias("id"))
    return cu.attach_scores(docs, views.scores(spark, path), column="s1")


@query("j10_restrict_to", f"select id, y, {R('s1')} as s1 from scores where id in (select doc_id from documents where lang = 'en')")
def _(spark, path):
    domain = views.table(spark, path, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    return cu.restrict_to(views.scores(spark, path), domain, "id").select("id", "y", "s1")


# Set operations

@query(
    "u1_union_sources",
    """select source_db, count(*) as n_rows, count(role) as n_with_role from (
        select 'documents' as source_db, sequence, null::varchar as role from peptides
        union all select 'turns', sequence, role from background) group by 1""",
)
def _(spark, path):
    both = cu.union_sources(
        {"documents": views.peptides(spark, path).select("sequence"), "turns": views.background(spark, path).select("sequence", "role")}
    )
    return both.groupBy("source_db").agg(F.count(F.lit(1)).alias("n_rows"), F.count("role").alias("n_with_role"))


@query(
    "u2_union_distinct",
    f"""with {NORMAL}, d as (select distinct source_db, sequence from norm),
      f as (select *, min(source_db) over (partition by sequence) as first from d),
      c as (select source_db, count(*) as n_distinct, count(*) filter (source_db = first) as n_new from f group by 1)
      select *, (sum(n_new) over (order by source_db))::bigint as union_size from c""",
)
def _(spark, path):
    return cu.union_distinct(normalized(spark, path), "source_db")


@query(
    "u3_merge_into",
    f"""with {NORMAL} select sequence, bool_and(n = 1) as is_new from (
          select sequence, 0 as n from external union all select sequence, 1 from norm) group by 1""",
)
def _(spark, path):
    return cu.merge_into(views.external(spark, path), normalized(spark, path)).select("sequence", "is_new")


@query(
    "u3_merge_payload",
    f"""with {NORMAL}, b as (select sequence, 'external:' || item_id as origin, pos, 0 as n, item_id as a from external
          union all select sequence, source_id, pos, 1, doc_id from norm)
      select sequence, origin, pos, n = 1 as is_new from (select *, row_number() over (partition by sequence order by n, a, pos) as k from b) where k = 1""",
)
def _(spark, path):
    known = views.external(spark, path).select("sequence", F.concat(F.lit("external:"), "item_id").alias("origin"), "pos", F.col("item_id").alias("a"))
    new = normalized(spark, path).select("sequence", F.col("source_id").alias("origin"), "pos", F.col("doc_id").alias("a"))
    return cu.merge_into(known, new, order=["a", "pos"]).drop("a")


@query(
    "u3_merge_report",
    f"""with {NORMAL}, b as (select sequence, 0 as n from external union all select sequence, 1 from norm)
      select count(*) filter (n = 0) as n_existing, count(*) filter (n = 1) as n_incoming, count(distinct sequence) as n_after,
        count(*) - count(distinct sequence) as n_removed from b""",
)
def _(spark, path):
    return cu.merge_report(views.external(spark, path), normalized(spark, path))


@query(
    "u4_set_difference",
    """select sequence from peptides except select sequence from training""",
)
def _(spark, path):
    return cu.novel_only(views.peptides(spark, path).select("sequence").distinct(), views.training(spark, path))


# Deduplication and labels

PROVENANCE = f"""with {NORMAL} select sequence, length(sequence)::int as sequence_length,
    array_to_string(list_sort(list(distinct source_db)), ';') as source_dbs, count(distinct source_db) as n_source_dbs,
    min(source_id) as first_source_id, count(*) as n_records, bool_or(had_lowercase) as had_lowercase,
    bool_or(has_nonstandard_char) as has_nonstandard_char from norm group by sequence"""


@query("a1_dedup_with_provenance", PROVENANCE)
def provenance(spark, path):
    deduped = cu.dedup_with_provenance(normalized(spark, path))
    return deduped.withColumn("source_dbs", F.array_join("source_dbs", ";"))


@query(
    "a1_provenance_in_order",
    f"""with {NORMAL}, r as (select *, row_number() over (partition by sequence order by doc_id, pos, source_id) as k from norm)
      select sequence, count(*) as n_records, ceil(count(*) / 100.0)::int as n_id_parts,
        string_agg(source_id, ';' order by k) filter (where k <= 100) as source_ids from r group by 1""",
)
def _(spark, path):
    deduped = cu.dedup_with_provenance(normalized(spark, path), order=["doc_id", "pos"], per_part=100, spread=views.table(spark, path, "documents").select("doc_id"))
    return deduped.select("sequence", "n_records", "n_id_parts", F.array_join("source_ids", ";").alias("source_ids"))


@query(
    "a1_provenance_ids",
    f"""with {NORMAL}, n as (select sequence, ceil(count(*) / 1000.0)::int as parts from norm group by 1)
      select sequence, floor(('0x' || substr(md5('part:' || source_id), 1, 8))::bigint / 4294967296.0::double * parts)::int as part,
        array_to_string(list_sort(list(source_id)), ';') as source_ids from norm join n using (sequence) group by 1, 2""",
)
def _(spark, path):
    parts = cu.provenance_ids(normalized(spark, path), per_part=1000)
    return parts.withColumn("source_ids", F.array_join("source_ids", ";"))


@query(
    "a2_source_overlap",
    f"""with {NORMAL}, k as (select sequence, count(distinct source_db) as n_source_dbs from norm group by 1)
      select n_source_dbs, count(*) as n_sequences, {R('100.0::double * (select count(*) from k where n_source_dbs > 1) / (select count(*) from k)')} as pct_shared
      from k group by 1""",
)
def overlap(spark, path):
    return cu.source_overlap(normalized(spark, path))


MULTI = ", ".join(f"max((category = '{c}')::int)::int as {c}" for c in ("en", "fr", "de", "es"))
MULTILABEL = f"multi as (select sequence, {MULTI} from norm group by 1)"
LANGS = ["en", "fr", "de", "es"]


def multi(spark, path):
    return cu.multilabel(normalized(spark, path), LANGS)


@query("a3_multilabel", f"with {NORMAL}, {MULTILABEL} select * from multi")
def _(spark, path):
    return multi(spark, path)


@query(
    "a4_label_summary",
    f"with {NORMAL}, {MULTILABEL} "
    + " union all ".join(
        f"""select '{c}' as label, sum({c})::bigint as n_positive, {R(f'avg({c})')} as prevalence,
        count(*) filter (en + fr + de + es > 1) as n_multi, {R('100.0::double * avg((en + fr + de + es > 1)::int)')} as pct_multi,
        count(*) filter (en + fr + de + es = 0) as n_zero from multi"""
        for c in ("en", "fr", "de", "es")
    ),
)
def _(spark, path):
    return sm.label_summary(multi(spark, path), LANGS)


@query(
    "a5_label_conflicts",
    f"""with {NORMAL} select sequence, min(category) as lowest, max(category) as highest, count(*) as n_rows from norm
      group by 1 having count(distinct category) > 1""",
)
def _(spark, path):
    return cu.label_conflicts(normalized(spark, path), label="category")


@query(
    "a20_label_cooccurrence",
    f"with {NORMAL}, {MULTILABEL} "
    + " union all ".join(
        f"select '{a}' as label, '{b}' as other, {R(f'avg({b}) filter ({a} = 1)')} as share from multi"
        for a in ("en", "fr", "de", "es")
        for b in ("en", "fr", "de", "es")
        if a != b
    ),
)
def _(spark, path):
    return sm.label_cooccurrence(multi(spark, path), LANGS)


@query(
    "r9_activity_tiers",
    """select peptide_id, case when bool_and(inactive) then 'all_inactive' when not bool_or(inactive) then 'all_active' else 'mixed' end as tier,
         count(distinct species) as n_species from activities group by 1""",
)
def _(spark, path):
    return cu.activity_tiers(views.activities(spark, path))

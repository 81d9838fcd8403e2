"""Queries over similarity, clusters and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as cl
from ..operators import similarity as si
from ..operators import summaries as sm
from . import views
from .registry import R, query

# Groups are documents: each is one batch of generated sentences.

MEMBERS = "members as (select distinct doc_id, sequence from peptides)"
PENALTY = "case when s > 0.7::double then (s - 0.7::double) / 0.3::double else 0 end"


@query(
    "p1_diversity_penalty_hamming",
    f"""with {MEMBERS}, copies as (select doc_id, sequence, count(*) as n from peptides group by 1, 2),
      pairs as (select a.doc_id, a.sequence as s, b.sequence as t from members a join members b on a.doc_id = b.doc_id and a.sequence <> b.sequence
          and least(length(a.sequence), length(b.sequence)) > 0.7::double * greatest(length(a.sequence), length(b.sequence))),
      sim as (select doc_id, s, list_sum(list_transform(range(1, least(length(s), length(t)) + 1), lambda i: (substr(s, i, 1) = substr(t, i, 1))::int))
          / greatest(length(s), length(t))::double as v from pairs),
      best as (select doc_id, s as sequence, max(v) as s from sim group by 1, 2),
      final as (select doc_id, sequence, case when n > 1 then 1.0::double else coalesce(s, 0) end as s from copies left join best using (doc_id, sequence))
      select p.id, {R(PENALTY)} as penalty from peptides p join final using (doc_id, sequence)""",
)
def _(spark, path):
    p = views.peptides(spark, path).select("id", "doc_id", "sequence")
    return si.diversity_penalty(p, "doc_id").select("id", "penalty")


@query(
    "p2_diversity_penalty_dipeptide",
    f"""with {MEMBERS}, copies as (select doc_id, sequence, count(*) as n from peptides group by 1, 2),
      k as (select doc_id, sequence, substr(sequence, i::int, 2) as kmer, count(*) as c from (
          select doc_id, sequence, unnest(range(1, length(sequence))) as i from members) group by 1, 2, 3),
      norms as (select doc_id, sequence, sqrt(sum(c * c)) as norm from k group by 1, 2),
      dots as (select a.doc_id, a.sequence as s, b.sequence as t, sum(a.c * b.c) as d from k a join k b on a.doc_id = b.doc_id and a.kmer = b.kmer
          and a.sequence <> b.sequence group by 1, 2, 3),
      best as (select dots.doc_id, dots.s as sequence, max(d / (x.norm * y.norm)) as s from dots join norms x on x.doc_id = dots.doc_id and x.sequence = dots.s
          join norms y on y.doc_id = dots.doc_id and y.sequence = dots.t group by 1, 2),
      final as (select doc_id, sequence, case when n > 1 and length(sequence) > 1 then 1.0::double else coalesce(s, 0) end as s from copies left join best using (doc_id, sequence))
      select p.id, {R(PENALTY)} as penalty from peptides p join final using (doc_id, sequence)""",
)
def _(spark, path):
    p = views.peptides(spark, path).select("id", "doc_id", "sequence")
    return si.diversity_penalty(p, "doc_id", sim="dipeptide").select("id", "penalty")


@query(
    "p3_mean_pairwise",
    f"""with m as (select category, sequence, row_number() over (partition by category order by md5('42:' || id), id) - 1 as i from peptides),
      n as (select category, count(*) as n, count(*) * (count(*) - 1) // 2 as pairs from m group by 1),
      d as (select category, pairs, unnest(range(4000)) as d from n where pairs > 8000),
      draws as (select category, ('0x' || substr(md5('42:pair:' || category || ':' || d), 1, 15))::bigint % pairs as p, min(d) as o from d group by 1, 2),
      kept as (select category, p from (select *, row_number() over (partition by category order by o, p) as r from draws) where r <= 2000),
      ij as (select category, p, floor((1 + sqrt(1 + 8 * p::double)) / 2)::bigint as j from kept),
      fixed as (select category, p, case when j * (j - 1) // 2 > p then j - 1 when (j + 1) * j // 2 <= p then j + 1 else j end as j from ij),
      st as (select f.category, f.p, a.sequence as s, b.sequence as t from fixed f
        join m a on a.category = f.category and a.i = f.p - f.j * (f.j - 1) // 2 join m b on b.category = f.category and b.i = f.j),
      x as (select category, p, k, count(*) as n from (select category, p, substr(s, unnest(range(1, length(s)))::int, 2) as k from st) group by 1, 2, 3),
      y as (select category, p, k, count(*) as n from (select category, p, substr(t, unnest(range(1, length(t)))::int, 2) as k from st) group by 1, 2, 3),
      dots as (select category, p, sum(x.n * y.n) as d from x join y using (category, p, k) group by 1, 2),
      nx as (select category, p, sqrt(sum(n * n)) as a from x group by 1, 2), ny as (select category, p, sqrt(sum(n * n)) as b from y group by 1, 2)
      select category, count(*) as n_pairs, {R('avg(coalesce(d / (a * b), 0))')} as mean_similarity
      from st left join dots using (category, p) left join nx using (category, p) left join ny using (category, p) group by 1""",
)
def _(spark, path):
    p = views.peptides(spark, path).select("id", "category", "sequence")
    return si.mean_pairwise(p, "category", "id")


VECTORS = "v as (select vec_id as id, label, list_transform(embedding, lambda x: x::double) as e from embeddings)"
COSINE = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"


def vectors(spark, path):
    return views.table(spark, path, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query(
    "p4_ad_penalty",
    f"""with {VECTORS}, best as (select a.id, max({COSINE}) as s from v a, v b where b.label = 0 group by 1)
      select id, {R('least(greatest(1 - (1 - s) / 0.6::double, 0), 1)')} as penalty from best""",
)
def _(spark, path):
    v = vectors(spark, path)
    return si.ad_penalty(v, v.filter("label = 0"), threshold=0.6).select("id", "penalty")


@query(
    "p4_ad_penalty_cells",
    f"""with {VECTORS}, best as (select a.id, max({COSINE}) as s from v a, v b where b.label <> 0 and b.id <> a.id group by 1)
      select id, {R('1.0')} as penalty from v where label <> 0 union all
      select id, {R('least(greatest(1 - (1 - s) / 0.6::double, 0), 1)')} from best join v using (id) where label = 0""",
)
def _(spark, path):
    v = vectors(spark, path)
    return si.ad_penalty(v, v.filter("label <> 0"), threshold=0.6, limit=0).select("id", "penalty")


def pairs_sql(k: int) -> str:
    """Tables of the distinct sequences and their similar pairs at k-mers of ``k`` and half of the smaller set."""
    return f"""members as (select min(id) as id, sequence from peptides where length(sequence) between 11 and 60 group by sequence),
  k as (select distinct id, substr(sequence, i::int, {k}) as kmer from (select id, sequence, unnest(range(1, length(sequence) - {k - 2})) as i from members)),
  n as (select id, count(*) as n from k group by 1),
  shared as (select a.id as x, b.id as y, count(*) as c from k a join k b on a.kmer = b.kmer and a.id < b.id group by 1, 2),
  pairs as (select x, y, c::double / least(p.n, q.n) as similarity, p.n as nx, q.n as ny from shared join n p on p.id = x join n q on q.id = y
    where c >= 0.5::double * least(p.n, q.n))"""


PAIRS = pairs_sql(5)


def windowed(spark, path):
    p = views.peptides(spark, path).select("id", "sequence")
    return p.filter(F.length("sequence").between(11, 60))


@query(
    "p5_similar_pairs",
    f"""with {PAIRS} select case when nx <= ny then x else y end as id_a, case when nx <= ny then y else x end as id_b, {R('similarity')} as similarity from pairs""",
)
def _(spark, path):
    distinct = windowed(spark, path).groupBy("sequence").agg(F.min("id").alias("id"))
    return cl.similar_pairs(distinct, k=5)


@query(
    "p5_similar_pairs_k3",
    f"""with {pairs_sql(3)} select case when nx <= ny then x else y end as id_a, case when nx <= ny then y else x end as id_b, {R('similarity')} as similarity from pairs""",
)
def _(spark, path):
    distinct = windowed(spark, path).groupBy("sequence").agg(F.min("id").alias("id"))
    return cl.similar_pairs(distinct)


def links_sql(k: int) -> str:
    return f"""{pairs_sql(k)}, ranked as (select id, sequence, row_number() over (order by length(sequence) desc, id) as r from members),
  links as (select greatest(a.r, b.r) as worse, least(a.r, b.r) as better from pairs join ranked a on a.id = x join ranked b on b.id = y)"""


def greedy_sql(k: int) -> str:
    """The longest-first loop itself: one step of the recursion for each rank."""
    return f"""with recursive {links_sql(k)}, near as (select r, coalesce(list(better) filter (where better is not null), []) as better from ranked left join links on worse = r group by r),
      walk as (select 0::bigint as r, []::bigint[] as reps union all
        select near.r, case when list_has_any(near.better, reps) then reps else list_append(reps, near.r) end from walk join near on near.r = walk.r + 1),
      ended as (select reps from walk order by r desc limit 1),
      chosen as (select r, coalesce(list_min(list_intersect(better, reps)), r) as c from near, ended)
      select p.id, n.id as cluster_id from peptides p join ranked m on m.sequence = p.sequence join chosen on chosen.r = m.r join ranked n on n.r = c"""


@query(
    "p5_cluster_components",
    f"""with recursive {links_sql(5)}, both_ways as (select worse as u, better as v from links union select better, worse from links),
      walk as (select r as u, r as root from ranked union select e.v, w.root from walk w join both_ways e on e.u = w.u where e.v > w.root),
      roots as (select u, min(root) as root from walk group by 1),
      named as (select root, min(id) as name from roots join ranked on r = u group by 1)
      select p.id, name as cluster_id from peptides p join ranked m on m.sequence = p.sequence join roots on u = m.r join named using (root)""",
)
def _(spark, path):
    return cl.cluster_by_kmer(windowed(spark, path), k=5, mode="components")


@query("p5_cluster_greedy", greedy_sql(5))
def _(spark, path):
    return cl.cluster_by_kmer(windowed(spark, path), k=5)


@query("p5_cluster_greedy_k3", greedy_sql(3))
def _(spark, path):
    return cl.cluster_by_kmer(windowed(spark, path))


SPLIT = "case when substr(md5('42:' || source_db), 1, 8) < 'cccccccc' then 'train' when substr(md5('42:' || source_db), 1, 8) < 'e6666666' then 'val' else 'test' end"


@query("p6_cluster_split", f"select id, source_db as cluster_id, {SPLIT} as split from peptides")
def _(spark, path):
    p = views.peptides(spark, path).select("id", F.col("source_db").alias("cluster_id"))
    return cl.cluster_split(p)


@query(
    "p6_cluster_split_exact",
    """with c as (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) as i, count(*) over () as n from (select distinct doc_id from peptides))
      select id, case when i <= floor(0.8::double * n) then 'train' when i <= floor(0.9::double * n) then 'val' else 'test' end as split
      from peptides join c using (doc_id)""",
)
def _(spark, path):
    p = views.peptides(spark, path).select("id", F.col("doc_id").alias("cluster_id"))
    return cl.cluster_split(p, exact=True).select("id", "split")


DOC_SPLIT = "case when substr(md5('42:' || doc_id), 1, 8) < 'cccccccc' then 'train' when substr(md5('42:' || doc_id), 1, 8) < 'e6666666' then 'val' else 'test' end"


@query(
    "p7_split_audit",
    f"""with s as (select doc_id, sequence, {DOC_SPLIT} as split from peptides)
      select 'cluster' as "check", count(*) filter (k > 1) as n_crossing, count(*) as n_checked from (select count(distinct split) as k from s group by doc_id)
      union all select 'sequence', count(*) filter (k > 1), count(*) from (select count(distinct split) as k from s group by sequence)""",
)
def _(spark, path):
    p = views.peptides(spark, path).select("id", "sequence", F.col("doc_id").alias("cluster_id"))
    return cl.split_audit(cl.cluster_split(p))


@query(
    "p7_crossing_pairs",
    f"""with {PAIRS}, s as (select id, {DOC_SPLIT} as split from peptides)
      select count(*) as n_pairs, count(*) filter (a.split <> b.split) as n_crossing from pairs join s a on a.id = x join s b on b.id = y""",
)
def _(spark, path):
    p = views.peptides(spark, path)
    distinct = windowed(spark, path).groupBy("sequence").agg(F.min("id").alias("id"))
    splits = cl.cluster_split(p.select("id", F.col("doc_id").alias("cluster_id")))
    return cl.crossing_pairs(cl.similar_pairs(cl.split_labels(distinct, splits), k=5, carry=["split"]))


@query("p7_fingerprint")
def _(spark, path):
    return cl.fingerprint(cl.cluster_split(views.peptides(spark, path).select("id", F.col("doc_id").alias("cluster_id"))))


@query("p8_select_k")
def _(spark, path):
    _, table, _ = cl.select_k(vectors(spark, path), [5, 8, 10, 15, 20], restarts=10)
    return table


@query(
    "p9_assign_clusters",
    f"""with {VECTORS}, d as (select id, label, unnest(range(len(e))) as d, unnest(e) as x from v),
      c as (select label, d, avg(x) as m from d group by 1, 2),
      dist as (select d.id, c.label, sum((x - m) * (x - m)) as q from d join c using (d) group by 1, 2)
      select id, label::int as cluster_id from (select *, row_number() over (partition by id order by round(q, 9), label) as k from dist) where k = 1""",
)
def _(spark, path):
    v = vectors(spark, path)
    centroids = si.group_means(v, "label").withColumnRenamed("label", "cluster_id")
    return si.assign_clusters(v, centroids).select("id", "cluster_id")


@query(
    "p9_cluster_shares_assigned",
    f"""with {VECTORS}, d as (select id, label, unnest(range(len(e))) as d, unnest(e) as x from v),
      c as (select label, d, avg(x) as m from d group by 1, 2),
      dist as (select d.id, c.label, sum((x - m) * (x - m)) as q from d join c using (d) group by 1, 2),
      a as (select id, label from (select *, row_number() over (partition by id order by round(q, 9), label) as k from dist) where k = 1)
      select k as cluster_id, count(label) as n_rows, {R('100.0::double * count(label) / (select count(*) from a)')} as pct from range(12) t(k) left join a on k = label group by 1""",
)
def _(spark, path):
    v = vectors(spark, path)
    centroids = si.group_means(v, "label").withColumnRenamed("label", "cluster_id")
    return sm.cluster_share(si.assign_clusters(v, centroids), 12)


@query(
    "p10_mean_pool",
    f"""with {VECTORS}, t as (select label, row_number() over (partition by label order by id) - 1 as pos, e from v),
      n as (select label, count(*) - 2 as len from t group by 1),
      d as (select label, unnest(range(len(e))) as dim, unnest(e) as x from t join n using (label) where pos between 1 and len)
      select label, dim::int as dim, {R('avg(x)')} as pooled from d group by 1, 2""",
)
def _(spark, path):
    from pyspark.sql import Window

    # Vectors of one label stand for the residues of one sequence; first and last are marks.
    v = vectors(spark, path)
    numbered = v.withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1)
    lengths = v.groupBy("label").agg((F.count(F.lit(1)) - 2).alias("length"))
    pooled = si.mean_pool(numbered.join(lengths, "label"), "label", column="embedding")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "pooled"))

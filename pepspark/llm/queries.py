"""One query for each text operator: whole tables, production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, exact, filters, jaccard, language, licenses, packing, repair, sentencepiece, suffix, toxicity, warc
from .common import growing, materialize, train_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(train_rows("doc_id", 4, 2)).select("doc_id", F.col("toxic").alias("label")))
    held = ~train_rows("doc_id", 4, 2)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(train_rows("doc_id", 5, 0)))
    held = ~train_rows("doc_id", 5, 0)
    return language.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.membership(table(spark, sf_dir, "documents"))


ORACLES["op4_exact_dedup"] = r"""
with rows as (
  select doc_id, coalesce(text, '') as whole, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents
), ranked as (
  select *, count(*) over (partition by text_sha256) as group_size,
    first_value(doc_id) over (partition by text_sha256 order by length(whole) desc, doc_id) as keep_id from rows
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from ranked
"""


#: Said by both sides of conversation -7.
CONFLICT = "\\### Assistant: </turn> ok"


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text")
    )
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


ORACLES["op5_chat_format"] = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, length(text) + length(role) + 14 + case when regexp_matches(text, '(?s)\\.') or contains(text, '</turn>' || chr(10))
    then length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 else 0 end as chars from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""


@query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


@query
def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), least_bytes=0))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op7_warc_dictionary"] = """
with rows as (
  select page_id, coalesce(html, '') as payload from pages
), hashed as (
  select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as hex, min(page_id) over (partition by sha1(payload)) as first from rows
), coded as (
  select page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (k // 4)::int + 1, 5))::bigint >> (15 - 5 * (k % 4))::int) & 31)::int + 1, 1), '' order by k) as payload_digest
  from hashed cross join (select unnest(range(32)) as k) group by page_id
)
select page_id, payload_bytes, payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from hashed join coded using (page_id)
"""


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.membership(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def encoded(spark: SparkSession, rows: DataFrame, *keys: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again."""
    pieces = sentencepiece.piece_table(spark, vocabulary("piece_bpe_32k.model"))
    ids = sentencepiece.encode(rows.select(*keys, "text"), pieces, keys[0], stored=True)
    back = sentencepiece.decoded(F.col("ids"), pieces)
    return ids.select(*keys, "ids", F.size("ids").cast("long").alias("n_ids"), (F.coalesce("text", F.lit("")) == back).alias("round_trip"))


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"), "doc_id")


@query
def op9_sentencepiece_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.membership(table(spark, sf_dir, "documents"), length=400, words=51).drop("spans")


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _templates_sql(which: dict[str, str], more: int = 0) -> str:
    return ", ".join(f"({k}, '{text}', '{label}')" for k, (text, label) in enumerate(which.items(), more))


# The oracle counts every template's words in every block, without filters.
ORACLES["op11_license_scan"] = rf"""
with phrases(id, words, label) as (values {_templates_sql(licenses.PHRASES)}
), notices(id, words, label) as (values {_templates_sql(licenses.NOTICES)}
), wanted as (
  select id, label, unnest(list_distinct(string_split(words, ' '))) as w, len(list_distinct(string_split(words, ' '))) as size from notices
), d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), words as (
  select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from d
), runs as (
  select doc_id, i, w, lead(w, 1) over p as x, lead(w, 2) over p as y, lead(w, 3) over p as z from words window p as (partition by doc_id order by i)
), places as (
  select doc_id, i, label from runs join phrases on words = w || ' ' || x or words = w || ' ' || x || ' ' || y or words = w || ' ' || x || ' ' || y || ' ' || z
), base as (
  select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by doc_id
), hits as (
  select doc_id, id, label, w, size, unnest(range(greatest(0, (i - {licenses.LICENSES.reach()} + {licenses.LICENSES.block}) // {licenses.LICENSES.block}), i // {licenses.LICENSES.block} + 1)) as block from words join wanted using (w)
), blocks as (
  select doc_id, id, label, block, count(distinct w) / any_value(size) as share from hits group by all having 100 * count(distinct w) >= {licenses.LICENSES.percent} * any_value(size)
), labelled as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from (select doc_id, label, share from blocks union all select doc_id, label, 1.0::double from places) group by doc_id
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join base using (doc_id) left join labelled using (doc_id)
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"), damage=True)


def _then(before: str, cost: str, edit: str, line: str | None = None) -> str:
    """SQL for a state reached from ``before`` by one more edit."""
    text = f"{before}.t || {line} || chr(10)" if line else f"{before}.t"
    return f"{{'c': {before}.c + {cost}, 'a': {before}.a || '{edit}', 't': {text}}}"


# The oracle walks all four states of a conversation row by row and keeps the least (cost, audit) of each.
ORACLES["op12_conversation_repair"] = f"""
with recursive bytes as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as key
  from conversations
), kinds as (
  select *, xor(list_reduce(key, lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::bigint), xor(c, b)), 4294967295::bigint), 4294967295::bigint) % 20 as kind from bytes
), damaged as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy
  from kinds where kind <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, substr(role, 1, 1) as initial,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from damaged
), rows as (
  select *, body = '' as blank, body <> '' and row_number() over (partition by conv_id, role, text order by pos) > 1 as duplicate,
    lag(initial) over (partition by conv_id order by pos) || initial not in ('su', 'ua', 'au') as illegal from placed
), faults as (
  select *, blank or duplicate as gone, not blank and not duplicate and right(body, 1) not in ('.', '!', '?') as truncated from rows
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate,
    count(*) filter (where truncated) as truncated, count(*) filter (where illegal) as illegal, count(*) as n
  from faults group by conv_id
), walk as (
  select conv_id, 0::bigint as pos, n, {{'c': 0, 'a': '', 't': ''}} as z, {{'c': 1000000000, 'a': '', 't': ''}} as s, {{'c': 1000000000, 'a': '', 't': ''}} as u, {{'c': 1000000000, 'a': '', 't': ''}} as a from counted
  union all
  select w.conv_id, w.pos + 1, n, {_then("z", "4", "D")},
    least({_then("s", "4", "D")}, case when not gone and initial = 's' then {_then("z", "more", "K", "role || ':' || text")} else {{'c': 1000000000, 'a': '', 't': ''}} end),
    least({_then("v", "4", "D")}, case when not gone then least(case when initial = 'u' then {_then("o", "more", "K", "role || ':' || text")} else {{'c': 1000000000, 'a': '', 't': ''}} end,
      {_then("o", "3 + more", "R", "'user:' || text")}) else {{'c': 1000000000, 'a': '', 't': ''}} end),
    least({_then("e", "4", "D")}, case when not gone then least(case when initial = 'a' then {_then("v", "more", "K", "role || ':' || text")} else {{'c': 1000000000, 'a': '', 't': ''}} end,
      {_then("v", "3 + more", "R", "'assistant:' || text")}) else {{'c': 1000000000, 'a': '', 't': ''}} end)
  from (
    select *, least(z, s, e) as o from (
      select *, least(a, {_then("v", "3", "I", "'assistant:'")}) as e from (
        select *, least(u, {_then("least(z, s, a)", "3", "I", "'user:'")}) as v from walk where pos < n
      )
    )
  ) w join (select *, case when truncated then 3 else 0 end as more from faults) f on f.conv_id is not distinct from w.conv_id and f.pos = w.pos + 1
), ended as (
  select *, least(z, a, {_then("v", "3", "I", "'assistant:'")}) as best from (select *, least(u, {_then("least(z, s, a)", "3", "I", "'user:'")}) as v from walk where pos = n)
)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) i
left join counted c on c.conv_id is not distinct from i.conv_id left join ended e on e.conv_id is not distinct from i.conv_id
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


ORACLES["op13_filter_audit"] = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), w as (
  select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d
), f as (
  select part,
    case when len(ws) < 50 then 'A' else '' end
    || case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as mask,
    exists (select 1 from labels l where l.doc_id = w.doc_id and quality = 1) as good,
    exists (select 1 from labels l where l.doc_id = w.doc_id and toxic = 1) as toxic
  from w
), m as (
  select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from f group by all
), l as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x
), p as (
  select a.x || b.x || c.x || d.x || e.x as o from l a, l b, l c, l d, l e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), hit as (
  select m.*, o, case when mask = '' then 6 else list_min(list_transform(string_split(mask, ''), lambda x: strpos(o, x))) end as first from m, p
), step as (
  select unnest(range(1, 6)) as s
), cell as (
  select part, o, s, substr(o, s::int, 1) as x, sum(n) filter (where first > s) as kept, sum(n) filter (where first = s) as removed,
    sum(n) filter (where first < s and contains(mask, substr(o, s::int, 1))) as redundant, sum(n) filter (where mask = substr(o, s::int, 1)) as unique_fails,
    sum(good) filter (where first = s) as good_lost, sum(toxic) filter (where first = s) as toxic_lost
  from hit, step group by part, o, s
)
select part, o as filter_order, s::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, x), 0)::bigint as shapley
from cell
"""

"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm import (
    alignment, bpe, checks, contamination, cross_polytope, divergence, licenses, packing, passages, preferences, simhash,
    token_store, toxicity, vector_links,
)
from clientele.sources.scratch import scratch_path

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return cross_polytope.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with replies that break off from its middle on."""
    turns = _table(spark, sf_dir, "conversations")
    found = preferences.format_preferences(turns, preferences.shortened_replies(turns))
    spans = {
        name: F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")
        for name in ("chosen_spans", "rejected_spans")
    }
    return found.withColumns(spans).withColumnRenamed("pair_id", "conv_id")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_store.write_store(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), end_id=2)
    return token_store.read_store(spark, folder)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.passage_classes(_table(spark, sf_dir, "documents"))
    places = F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string")))
    return found.select(
        "doc_id", "n_words", "n_duplicate_words", F.array_join(places, ",").alias("spans"),
        F.array_join(F.col("sources").cast("array<string>"), ",").alias("source_ids"), "component_id",
    )


def op6_vector_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path(WORD_BPE), end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    places, base = F.col("base.first"), F.array_distinct(F.col("base.label"))
    every = F.array_union(base, F.col("detections.label"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), "score",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return alignment.align_documents(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: build for name, build in list(globals().items()) if name.startswith("op") and name[2:3].isdigit()
}



def _preference_sql() -> str:
    def text(side: str, where: str) -> str:
        body = f"'{preferences.OPEN}' || role || '{preferences.BETWEEN}' || said || '{preferences.CLOSE}'"
        return f"coalesce(string_agg({body}, '' order by pos) filter (side = {side} and {where}), '')"

    def spans(side: str) -> str:
        return (
            f"coalesce(string_agg((shift + {len(preferences.OPEN + preferences.BETWEEN)} + length(role))::varchar || '-' || "
            f"(shift + {len(preferences.OPEN + preferences.BETWEEN + preferences.CLOSE) - 1} + length(role) + length(said))::varchar, ',' order by pos) "
            f"filter (side = {side} and late and role = '{preferences.TRAINED}'), '')"
        )

    size = f"{len(preferences.OPEN + preferences.BETWEEN + preferences.CLOSE)} + length(role) + length(said)"
    return f"""
with middles as (select conv_id, (min(turn) + max(turn)) // 2 as middle from conversations group by conv_id),
halves as (
  select c.conv_id, turn, role,
         case when turn >= middle and role = '{preferences.TRAINED}' then substr(text, 1, length(text) // 2) else text end as text
  from conversations c join middles m on c.conv_id = m.conv_id),
both_sides as (
  select 0 as side, conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as said from conversations
  union all select 1, conv_id, turn, coalesce(role, ''), coalesce(text, '') from halves),
placed as (
  select *, row_number() over (partition by conv_id, side order by turn, role, said) as pos
  from both_sides where conv_id is not null),
compared as (
  select conv_id, pos, count(*) = 2 and min(role) = max(role) and min(said) = max(said) as same
  from placed group by conv_id, pos),
prefixes as (
  select conv_id, coalesce(min(pos) filter (not same) - 1, max(pos)) as n from compared group by conv_id),
marked as (
  select p.*, n, pos > n as late, sum(case when pos > n then {size} else 0 end)
           over (partition by p.conv_id, side order by pos) - case when pos > n then {size} else 0 end as shift
  from placed p join prefixes f on p.conv_id = f.conv_id)
select conv_id, max(n)::integer as prompt_turns, {text("0", "not late")} as prompt,
       {text("0", "late")} as chosen, {text("1", "late")} as rejected,
       {spans("0")} as chosen_spans, {spans("1")} as rejected_spans
from marked group by conv_id"""


def _license_sql() -> str:
    def values(rows: list[tuple]) -> str:
        return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)

    table = values([(at, r.label, r.rank, r.keyword, r.pattern) for at, r in enumerate(licenses.rules())])
    base = values([(at, label, licenses._line(phrase)) for at, (phrase, label) in enumerate(licenses.BASE.items())])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    weights = " ".join(f"when min(rank) = {rank} then {weight}" for rank, weight in licenses.WEIGHTS.items())

    def matches(source: str) -> str:
        return f"""
  select d.r, t.n, label, rank, unnest(string_split_regex(line, pattern)[1:len(regexp_extract_all(line, pattern))]) as gap,
         unnest(regexp_extract_all(line, pattern)) as hit,
         unnest(range(len(regexp_extract_all(line, pattern)))) as i
  from d join {source}"""

    def places(source: str) -> str:
        return f"""
  select r, label, rank,
         (sum(gap_words) over w + sum(hit_words) over w - hit_words)::bigint as first,
         (sum(gap_words) over w + sum(hit_words) over w)::bigint as last
  from (select *, (length(gap) - length(replace(gap, ' ', ''))) // 2 as gap_words,
               (length(hit) - length(replace(hit, ' ', ''))) // 2 as hit_words from {source})
  window w as (partition by r, n order by i)"""

    return f"""
with words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{licenses.WORD}') as ws
  from documents),
d as (select r, doc_id, ws, ' ' || array_to_string(ws, '  ') || ' ' as line from words),
rule(n, label, rank, keyword, pattern) as (values {table}),
base_rule(n, label, pattern) as (values {base}),
hits as ({matches("rule t on list_contains(ws, keyword)")}),
base_hits as ({matches("(select *, 2 as rank from base_rule) t on true")}),
found as (select distinct * from ({places("hits")})),
base_found as ({places("base_hits")}),
kept as (
  select * from found p where not exists (
    select 1 from found q
    where q.r = p.r and q.last >= p.last and q.rank <= p.rank
      and (q.first, -q.last, q.rank, q.label) < (p.first, -p.last, p.rank, p.label))),
per_base as (
  select r, count(*) as n_base, min(first) as first_word, max(first) as last_word,
         string_agg(distinct label, ',' order by label) as base_labels
  from base_found group by r),
per_label as (
  select r, string_agg(distinct label, ',' order by label) as labels
  from (select r, label from kept union select r, label from base_found) group by r),
per_rank as (select r, case {weights} end as score from kept group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join per_base using (r) left join per_label using (r) left join per_rank using (r)"""


SQL: dict[str, str] = {
    "op3_preferences": _preference_sql(),
    "op9_licenses": _license_sql(),
    "op12_contamination": checks.contamination_sql(),
    "op13_divergence": checks.divergence_sql(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def check_sql() -> dict[str, str]:
    return dict(SQL)

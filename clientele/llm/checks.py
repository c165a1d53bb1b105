"""Check SQL of the contamination and divergence queries, by plain comparison."""

from __future__ import annotations

from clientele.llm import contamination, divergence, licenses

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def contamination_sql(size: int = contamination.WINDOW_WORDS) -> str:
    """All runs of words of a document against all windows, as joined words."""

    def split(table: str, key: str) -> str:
        return (
            f"select row_number() over () as r, {key}, "
            f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{licenses.WORD}') as ws from {table}"
        )

    return f"""
with d as ({split("documents", "doc_id")}),
i as ({split("benchmark", "item_id")}),
windows as (
  select distinct item_id, array_to_string(ws[f + 1:f + {size}], ' ') as line, least(len(ws), {size}) as n
  from (select item_id, ws, unnest(range(greatest(len(ws) - {size}, 0) + 1)) as f from i where len(ws) > 0)),
sizes as (select distinct n from windows),
grams as (
  select r, f, n, array_to_string(ws[f + 1:f + n], ' ') as line
  from (select r, ws, n, unnest(range(len(ws) - n + 1)) as f from d, sizes where len(ws) >= n)),
found as (select r, f, n, item_id from grams join windows using (n, line)),
hits as (select r, count(distinct place) as n_hit from (select r, unnest(range(f, f + n)) as place from found) group by r),
named as (
  select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct r, item_id::varchar as id from found where item_id is not null) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (r) left join named using (r)"""


def divergence_sql(least: int = divergence.LEAST_DOCUMENTS, most: int = divergence.TERMS) -> str:
    """Every kept term for every group, also where it is missing."""
    scale = divergence.SCALE

    def p(n: str, total: str) -> str:
        return f"(1 + {scale}::hugeint * ({n} + 1) // ({total} + v))"

    return f"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text
  from documents),
occurring as (
  select r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_LETTERS}')) as term
  from docs),
kept as (select lang, term, count(*) as n from occurring group by lang, term having count(distinct r) >= {least}),
grps as (select distinct lang, source from docs),
langs as (select lang, (select count(*) from kept k where k.lang = l.lang) as v,
                 coalesce((select sum(n) from kept k where k.lang = l.lang), 0) as total
          from (select distinct lang from docs) l),
counted as (select lang, source, term, count(*) as n from occurring join kept using (lang, term) group by lang, source, term),
dense as (
  select g.lang, g.source, k.term, k.n as lang_n, coalesce(c.n, 0) as n
  from grps g join kept k on k.lang = g.lang
  left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
totals as (select lang, source, sum(n) as total from dense group by lang, source),
shares as (
  select d.lang, d.source, d.term, d.n, {p("d.n", "t.total")} as p, {p("d.lang_n", "l.total")} as q
  from dense d join totals t using (lang, source) join langs l using (lang)),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by a.lang, a.source, b.source),
all_pairs as (
  select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
  from grps a join grps b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
single as (
  select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from shares where n > 0 and p > q)
select lang, source, 'pair' as part, item, value,
       row_number() over (partition by lang, source order by value desc, item)::integer as rank
from all_pairs
union all
select lang, source, 'term', item, value, rank from (
  select *, row_number() over (partition by lang, source order by value desc, item)::integer as rank from single)
where rank <= {most}"""

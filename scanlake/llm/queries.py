"""One query per operator, applied to its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanlake.llm import cap_filters, chat, codec, decontam, infill, langid, quality, secret_scan, simhash, token_counts, toxicity, turn_repair, url_filter
from scanlake.llm.tables import held_out, table
from scanlake.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKEN_LIMIT = 4096


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


@query("op1_language_id")
def language_id(spark, sf_dir):
    """Language of every document, learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words")


@query("op2_sentencepiece")
def sentencepiece_codec(spark, sf_dir):
    """Ids of every document, and whether they decode to it again."""
    return codec.encode(table(spark, sf_dir, "documents"))


@query("op3_embedding_dedup")
def embedding_dedup(spark, sf_dir):
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with rows as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
convs as (
  select conv_id, list(struct_pack(turn := turn, role := role, text := text) order by turn nulls first, role nulls first, text nulls first) as steps,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by turn nulls first, role nulls first, text nulls first) as rendered
  from rows group by conv_id),
classes as (select min(conv_id) as conv_id, count(*) as copies, steps, any_value(rendered) as rendered from convs group by steps)
select c.conv_id, cast(0 as bigint) as part, cast(len(c.steps) as bigint) as n_turns, c.copies, c.rendered
from classes c
where not exists (select 1 from classes d where len(d.steps) > len(c.steps) and d.steps[1] = c.steps[1] and d.steps[:len(c.steps)] = c.steps)
"""


@query("op4_chat_format", OP4_SQL)
def chat_format(spark, sf_dir):
    """Rendered conversations without the snapshots that longer ones begin with."""
    return chat.collapsed(table(spark, sf_dir, "conversations"))


@query("op5_token_counts")
def token_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = token_counts.token_counts(docs.select(F.struct("doc_id", size.alias("n_bytes")).alias("doc"), "text"), id_col="doc", limit=TOKEN_LIMIT)
    return counted.select("doc.doc_id", "doc.n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")


@query("op6_simhash_dedup")
def simhash_dedup(spark, sf_dir):
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op7_decontamination")
def decontamination(spark, sf_dir):
    """Documents that hold benchmark passages, with the items."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_secret_scan")
def secrets(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


_LISTED = ", ".join(f"('{d}')" for d in url_filter.LISTED)
_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in url_filter.RULES)
OP9_SQL = f"""
with parsed as (
  select page_id, coalesce(url, '') as u, position('://' in coalesce(url, '')) as pos from pages),
cut as (
  select page_id, case when pos = 0 then '' else substr(u, pos + 3) end as rest from parsed),
parts as (
  select row_number() over () as rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
rules(action, rhost, rpath) as (values {_RULES}),
listed(domain) as (values {_LISTED}),
ruled as (
  select p.rid, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath) * 1000 + length(r.rhost)) as rule,
         arg_max(r.action, length(r.rhost || r.rpath) * 1000 + length(r.rhost)) as action
  from parts p join rules r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath) group by p.rid)
select p.page_id, p.host, p.path, d.rule,
       coalesce(d.action, case when exists (select 1 from listed l where p.host = l.domain or ends_with(p.host, '.' || l.domain)) then 'block' else 'allow' end) as verdict
from parts p left join ruled d using (rid)
"""


@query("op9_url_filter", OP9_SQL)
def url_verdicts(spark, sf_dir):
    return url_filter.verdicts(table(spark, sf_dir, "pages"), listed=url_filter.LISTED)


@query("op10_toxicity")
def toxic_scores(spark, sf_dir):
    """Toxicity of every document, learned outside the held-out fifth."""
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


OP11_SQL = """
with recursive
rows_in as (
  select row_number() over () as rid, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name
  from conversations),
crc(name, i, c) as (
  select distinct name, 0, cast(4294967295 as bigint) from rows_in
  union all
  select name, i + 1, list_reduce([xor(c, cast(ascii(substr(name, i + 1, 1)) as bigint))] || [cast(k as bigint) for k in range(8)],
                                  lambda a, k: xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end))
  from crc where i < length(name)),
lots as (select name, xor(c, 4294967295) % 20 as lot from crc where i = length(name)),
lotted as (select r.*, l.lot from rows_in r join lots l using (name)),
hurt as (
  select rid, conv_id, turn, case when lot = 4 then 'user' else role end as role,
         case lot when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when lot = 3 then [0, 1] else [0] end) as copy
  from lotted where lot <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
         lag(substr(role, 1, 1)) over (partition by conv_id order by turn nulls first, role, text) as before
  from hurt),
faulty as (
  select *, substr(role, 1, 1) as initial,
         case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank'
              when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
              when regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) not in ('.', '!', '?') then 'truncated' end as fault
  from placed),
convs as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal,
         list({'i': initial, 'f': coalesce(fault, ''), 'r': role, 't': text} order by pos) as said
  from faulty group by conv_id),
-- cheapest (cost, letters, repaired) that ends before anything (s0), after the system turn (s1), a user (s2), an assistant (s3)
walk(conv_id, k, s0, s1, s2, s3) as (
  select conv_id, 0, {'c': 0, 'a': '', 'm': ''}, cast(null as struct(c integer, a varchar, m varchar)), {'c': 2, 'a': 'I', 'm': 'user:'}, {'c': 4, 'a': 'II', 'm': 'user:' || chr(10) || 'assistant:'} from convs
  union all
  select conv_id, k, n0, n1,
         list_min([n2, {'c': n3.c + 2, 'a': n3.a || 'I', 'm': n3.m || chr(10) || 'user:'}, {'c': n0.c + 2, 'a': n0.a || 'I', 'm': 'user:'}, {'c': n1.c + 2, 'a': n1.a || 'I', 'm': n1.m || chr(10) || 'user:'}]),
         list_min([n3, {'c': n2.c + 2, 'a': n2.a || 'I', 'm': n2.m || chr(10) || 'assistant:'}, {'c': n0.c + 4, 'a': n0.a || 'II', 'm': 'user:' || chr(10) || 'assistant:'}, {'c': n1.c + 4, 'a': n1.a || 'II', 'm': n1.m || chr(10) || 'user:' || chr(10) || 'assistant:'}])
  from (
    select conv_id, k,
      {'c': s0.c + 3, 'a': s0.a || 'D', 'm': s0.m} as n0,
      list_min([d1, case when i = 's' and not must then {'c': s0.c + t, 'a': s0.a || 'K', 'm': line} end]) as n1,
      list_min([d2, case when not must then list_min([
        {'c': s0.c + t + u, 'a': s0.a || ul, 'm': uline}, {'c': s1.c + t + u, 'a': s1.a || ul, 'm': s1.m || chr(10) || uline}, {'c': s3.c + t + u, 'a': s3.a || ul, 'm': s3.m || chr(10) || uline}]) end]) as n2,
      list_min([d3, case when not must then {'c': s2.c + t + v, 'a': s2.a || vl, 'm': s2.m || chr(10) || vline} end]) as n3
    from (
      select w.conv_id, w.k + 1 as k, s0, s1, s2, s3, x.i as i, x.f in ('blank', 'duplicate') as must, case when x.f = 'truncated' then 1 else 0 end as t, x.r || ':' || x.t as line,
        case when x.i = 'u' then 0 else 2 end as u, case when x.i = 'u' then 'K' else 'R' end as ul, case when x.i = 'u' then x.r else 'user' end || ':' || x.t as uline,
        case when x.i = 'a' then 0 else 2 end as v, case when x.i = 'a' then 'K' else 'R' end as vl, case when x.i = 'a' then x.r else 'assistant' end || ':' || x.t as vline,
        case when s1 is not null then {'c': s1.c + 3, 'a': s1.a || 'D', 'm': s1.m} end as d1, {'c': s2.c + 3, 'a': s2.a || 'D', 'm': s2.m} as d2, {'c': s3.c + 3, 'a': s3.a || 'D', 'm': s3.m} as d3
      from (select w.*, c.said[w.k + 1] as x from walk w join convs c on w.conv_id is not distinct from c.conv_id where w.k < len(c.said)) w))),
solved as (
  select c.*, list_min([w.s0, w.s3]) as best from walk w join convs c on w.conv_id is not distinct from c.conv_id where w.k = len(c.said)),
ids as (select distinct conv_id from conversations)
select i.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate,
       cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.a, '') as audit,
       sha256(coalesce(best.m, '')) as repaired_sha256
from ids i left join solved s on i.conv_id is not distinct from s.conv_id
"""


@query("op11_conversation_repair", OP11_SQL)
def conversation_repair(spark, sf_dir):
    """Cheapest repair of every conversation after the test damage."""
    return turn_repair.damage_report(table(spark, sf_dir, "conversations"))


OP12_SQL = """
with named as (
  select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
lots as (
  select doc_id, t, length(t) as n, cast('0x' || h[1:8] as bigint) % (length(t) + 1) as c1, cast('0x' || h[9:16] as bigint) % (length(t) + 1) as c2,
         cast('0x' || h[17:24] as bigint) % 100 as l3, cast('0x' || h[25:32] as bigint) % 100 as l4 from named),
formed as (
  select doc_id, t, n, least(c1, c2) as a, greatest(c1, c2) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or l3 >= 90 then 'plain' when l4 < 20 then 'spm' else 'psm' end as form from lots),
pieces as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from formed)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then a end as bigint) as prefix_chars, cast(case when form <> 'plain' then b - a end as bigint) as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from pieces
"""


@query("op12_fill_in_middle", OP12_SQL)
def fill_in_middle(spark, sf_dir):
    """Every document as an infilling example, and the digest of the text put together again from it."""
    made = infill.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"))


def _ngram_sql(n: int) -> str:
    """Characters of the words of each text that lie in an n-gram which repeats (3) or stood earlier (others)."""
    when = "count(*) over (partition by rid, w) > 1" if n == quality.BASE_N else "row_number() over (partition by rid, w order by i) > 1"
    return f"""
g{n} as (select rid, i, {when} as again from (select rid, i, ws[i : i + {n - 1}] as w from (select rid, ws, unnest(range(1, len(ws) - {n - 2})) as i from docs))),
c{n} as (select rid, count(*) as words, sum(length(ws[k])) as chars from (select distinct g.rid, unnest(range(g.i, g.i + {n})) as k from g{n} g where g.again) join docs using (rid) group by rid)"""


_LENGTHS = sorted({quality.BASE_N, *quality.NGRAM_SHARE})
_SHARES = " and ".join(f"100 * dup_{n}gram_chars <= {share} * word_chars" for n, share in quality.NGRAM_SHARE.items())
OP13_SQL = f"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
lines as (
  select rid, line, row_number() over (partition by rid, line) > 1 as again from (select rid, unnest(string_split(t, chr(10))) as line from docs) where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dups as (
  select rid, count(*) as n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) as chars from lines where again group by rid),
{",".join(map(_ngram_sql, _LENGTHS)).strip()},
counted as (
  select doc_id, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(dups.n, 0) as bigint) as n_dup_lines,
         cast(coalesce(c{quality.BASE_N}.words, 0) as bigint) as n_repeat_words, cast(coalesce(dups.chars, 0) as bigint) as dup_line_chars,
         {", ".join(f"cast(coalesce(c{n}.chars, 0) as bigint) as dup_{n}gram_chars" for n in quality.NGRAM_SHARE)}
  from docs left join dups using (rid) {" ".join(f"left join c{n} using (rid)" for n in _LENGTHS)}),
judged as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words as base_failed from counted)
select *, not base_failed and 100 * dup_line_chars <= {quality.LINE_SHARE} * word_chars and {_SHARES} as kept from judged
"""


@query("op13_quality_rules", OP13_SQL)
def quality_rules(spark, sf_dir):
    """Repetition counts of every document and whether it stays."""
    return quality.judge(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    """All stages of ``corpus_pipeline``, each written and read again."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

"""Lines, receipts, pattern scans, credentials, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import Rule
from ..operators import patterns as pt, reduce as rd, search as sr
from ..plans import views as v
from .registry import query

# White space as the text functions see it, in the check tool's regex dialect.
WS = r"[\s\x0b\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRIM = rf"regexp_replace(%s, '^{WS}+|{WS}+\z', '', 'g')"
LINES_SQL = f"""files as ({v.FILES_SQL}),
numbered_lines as (
  select scan_id, path, doc_id, unnest(string_split_regex(content, '\\r?\\n')) as text,
         generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) as line from files)"""


@query("file_receipts", f"""
with files as ({v.FILES_SQL})
select scan_id, path, octet_length(encode(content)) as bytes, sha256(content) as sha256, 'text' as language from files""")
def file_receipts(spark, sf):
    from ..sources.corpus import file_receipts as receipts
    return receipts(v.files(spark, sf))


@query("numbered_lines", f"with {LINES_SQL} select path, line, text from numbered_lines")
def numbered_lines(spark, sf):
    return pt.explode_lines(v.files(spark, sf)).select("path", "line", "text")


@query("line_excerpts", f"with {LINES_SQL} select path, line, left({TRIM % 'text'}, 240) as excerpt from numbered_lines")
def line_excerpts(spark, sf):
    return pt.explode_lines(v.files(spark, sf)).select("path", "line", tx.excerpt(F.col("text")).alias("excerpt"))


@query("first_mention_line", f"""
with files as ({v.FILES_SQL})
select path, strpos(content, '. ') - 1 as off,
       len(string_split_regex(left(content, greatest(strpos(content, '. ') - 1, 0)), '\\r?\\n')) as line
from files""")
def first_mention_line(spark, sf):
    off = F.instr("content", ". ") - 1
    at = F.greatest(off, F.lit(0))
    return v.files(spark, sf).select("path", off.alias("off"), tx.line_at(F.col("content"), at).alias("line"))


@query("slug_anchors", f"""
with {LINES_SQL}, s as (select path, line, left(regexp_replace(regexp_replace(
  regexp_replace(lower('rule:' || text), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', ''), 180) as a from numbered_lines)
select path, line, case when a = '' then 'root-control' else a end as anchor from s""")
def slug_anchors(spark, sf):
    return pt.explode_lines(v.files(spark, sf)).select("path", "line", tx.slug(F.concat(F.lit("rule:"), "text")).alias("anchor"))


@query("binary_files", f"with files as ({v.FILES_SQL}) select path, contains(content, chr(0)) as is_binary from files")
def binary_files(spark, sf):
    return v.files(spark, sf).select("path", tx.is_binary(F.col("content")).alias("is_binary"))


# Rules over prose: user-supplied rule rows, with a context pattern.
PROSE_RULES = (
    Rule("contact-address", "CWE-200", "medium", "An address is published.", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+", r"(?i)mail|contact|http"),
    Rule("long-number", "CWE-359", "low", "A long number is published.", r"[0-9]{6,}", r"(?i)id|key|phone"),
    Rule("licence-line", "CWE-1104", "informational", "A licence is named.", r"(?i)licen[sc]e|copyright"),
)


def _prose_sql():
    rules = ", ".join(f"('{r.rule_id}', '{r.cwe}', '{r.severity}', '{r.pattern}', {chr(39) + r.context + chr(39) if r.context else 'null'})" for r in PROSE_RULES)
    return f"rules(rule, cwe, severity, pattern, context) as (values {rules})"


@query("rule_scan", f"""
with {LINES_SQL}, {_prose_sql()}
select l.path as file, l.line, r.rule, r.cwe, r.severity, left({TRIM % 'l.text'}, 240) as excerpt
from numbered_lines l join rules r on regexp_matches(l.text, r.pattern)""")
def rule_scan(spark, sf):
    lines = pt.explode_lines(v.files(spark, sf))
    return pt.rule_scan(lines, PROSE_RULES).select(F.col("path").alias("file"), "line", "rule", "cwe", "severity",
                                                   tx.excerpt(F.col("text")).alias("excerpt"))


@query("context_evidence", f"""
with {LINES_SQL}, {_prose_sql()}, w as (
  select *, string_agg(text, chr(10)) over (partition by path order by line rows between 3 preceding and 3 following) as near
  from numbered_lines)
select l.path as file, l.line, r.rule, coalesce(regexp_matches(l.near, r.context), false) as in_context
from w l join rules r on regexp_matches(l.text, r.pattern)""")
def context_evidence(spark, sf):
    found = pt.scan_files(v.files(spark, sf), PROSE_RULES, replaced={})
    return found.select("file", "line", "rule", "in_context")


@query("multi_pass_receipts", f"""
with {LINES_SQL}, {_prose_sql()}, passes(scan_pass, only_rule) as (values ('baseline', null), ('privacy', 'long-number'), ('privacy', 'contact-address')),
plan as (select distinct f.scan_id, p.scan_pass, r.rule, r.pattern from (select distinct scan_id from files) f, rules r
         join passes p on p.only_rule is null or p.only_rule = r.rule),
hits as (select l.scan_id, p.scan_pass, p.rule, count(*) as n from numbered_lines l
         join plan p on p.scan_id = l.scan_id and regexp_matches(l.text, p.pattern) group by all)
select p.scan_id, p.scan_pass, p.rule, coalesce(h.n, 0) as matches
from plan p left join hits h using (scan_id, scan_pass, rule)""")
def multi_pass_receipts(spark, sf):
    files = v.files(spark, sf)
    passes = {"baseline": None, "privacy": ("long-number", "contact-address")}
    found = pt.scan_files(files, PROSE_RULES, passes, replaced={})
    return pt.rule_receipts(files, found, PROSE_RULES, passes)


@query("page_rule_scan", f"""
with files as ({v.PAGES_SQL}), l as (
  select path, unnest(string_split_regex(content, '\\r?\\n')) as text, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) as line from files),
rules(rule, pattern) as (values
  ('shell-command-construction', '(?i)(?:exec|execSync|spawn|spawnSync|system|popen|subprocess\\.(?:run|call|Popen))\\s*\\([^\\n]*(?:\\+|`|\\$\\{{|f["''])'),
  ('path-traversal-sink', '(?i)(?:readFile|writeFile|createReadStream|createWriteStream|sendFile|open)\\s*\\([^\\n]*(?:req\\.|params\\.|query\\.|body\\.|input)'),
  ('ssrf-request-sink', '(?i)(?:fetch|axios\\.(?:get|post|request)|requests\\.(?:get|post|request)|http\\.request)\\s*\\([^\\n]*(?:req\\.|params\\.|query\\.|body\\.|input)'),
  ('sql-injection-query-construction', '(?i)(?:query|execute|raw)\\s*\\([^\\n]*(?:req\\.|params\\.|query\\.|body\\.|input|\\+|\\$\\{{)'))
select path as file, line, rule from l join rules on regexp_matches(text, pattern)""")
def page_rule_scan(spark, sf):
    return pt.scan_files(v.pages(spark, sf)).select("file", "line", "rule")


@query("rule_pruning", """
with langs(language) as (select distinct lang from documents),
rules(rule, state) as (values ('dangerous-dynamic-code', 'off'), ('shell-command-construction', 'on'), ('path-traversal-sink', 'on'),
  ('tls-verification-disabled', 'off'), ('ssrf-request-sink', 'on'), ('sql-injection-query-construction', 'on'))
select language, rule, state from langs, rules""")
def rule_pruning(spark, sf):
    return pt.prune_rules(v.table(spark, sf, "documents").select(F.col("lang").alias("language")).distinct())


_CRED = r"""(?s)(?:\b[A-Za-z_$][\w$]*\s*\.\s*)?\$?([A-Za-z_$][\w$]*)\s*(?::=|=|:)\s*(?:"((?:[^"\\]|\\.)*)"|''((?:[^''\\]|\\.)*)'')"""
CREDENTIALS_SQL = f"""files as ({v.FILES_SQL}),
m as (select *, regexp_extract_all(content, '{_CRED}') as hits, string_split_regex(content, '{_CRED}') as gaps from files),
h as (select path, content, scan_id, hits[i] as hit,
             list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i-1]]), 0) as off
      from (select *, unnest(range(1, len(hits) + 1)) as i from m)),
c as (select scan_id, path, hit, len(string_split_regex(left(content, off::bigint), '\\r?\\n')) as line, content,
             regexp_extract(hit, '{_CRED}', 1) as field,
             regexp_extract(hit, '{_CRED}', 2) || regexp_extract(hit, '{_CRED}', 3) as raw from h),
credentials as (
  select scan_id, path as file, line, field, {TRIM % "regexp_replace(raw, '''[\\\\](?:[\\\\''\"nrt])''', '', 'g')"} as value,
         left({TRIM % "string_split_regex(content, '\\r?\\n')[line]"}, 240) as excerpt from c
  where regexp_matches(field, '(?i)(?:api[_-]?key|access[_-]?key|secret|password|token|private[_-]?key|credential)'))"""
CREDENTIALS_SQL = CREDENTIALS_SQL.replace("'''[\\\\](?:[\\\\''\"nrt])'''", "'\\\\(?:[\\\\''\"nrt])'")
CRED_FILTER = r"""length(value) >= 8 and not regexp_matches(excerpt, '^\s*(?://|#|/\*|\*)')
  and not regexp_matches(value, '(?i)(?:^|[-_\s])(example|sample|test|dummy|placeholder|replace|changeme|your[-_\s]?)(?:[-_\s]|$)|\.example(?:\.com|\.org|\.net)?$')"""


@query("embedded_credentials", f"""
with {CREDENTIALS_SQL}
select scan_id, file, line, field, value, excerpt, 'cand_' || left(sha256(scan_id || ':hardcoded-secret-marker:' || file || ':' || line), 32) as candidate_id
from credentials where {CRED_FILTER}""")
def embedded_credentials(spark, sf):
    found = pt.embedded_credentials(v.files(spark, sf))
    return found.select("scan_id", "file", "line", "field", "value", "excerpt",
                        tx.candidate_id(F.col("scan_id"), F.col("rule"), F.col("file"), F.col("line")).alias("candidate_id"))


@query("credential_mix", f"""
with {CREDENTIALS_SQL}
select scan_id, 'medium' as severity, count(distinct (file, line, excerpt)) as findings, count(distinct file) as files
from credentials where {CRED_FILTER} group by scan_id""")
def credential_mix(spark, sf):
    """Flagship: corpus -> credential candidates -> observations -> severity mix per source."""
    seen = rd.dedupe_observations(pt.embedded_credentials(v.files(spark, sf)))
    return seen.groupBy("scan_id", "severity").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


@query("corpus_search", f"""
with {LINES_SQL}
select path, line, left(text, 300) as text from numbered_lines where regexp_matches(text, '(?i)secret|token')
order by path, line limit 50""")
def corpus_search(spark, sf):
    return pt.corpus_search(v.files(spark, sf), "secret|token", 50)


@query("indexed_search", f"""
with {LINES_SQL}
select path, line, left(text, 300) as text from numbered_lines where regexp_matches(text, '(?i)licen[sc]e|secret|token')
order by path, line limit 50""")
def indexed_search(spark, sf):
    """The search by way of a trigram index of the whole corpus, built here."""
    files = v.files(spark, sf)
    index = sr.store_folder(spark, "index")
    sr.add_to_index(files, index)
    return sr.indexed_search(files, index, "licen[sc]e|secret|token", 50)


@query("many_rules", """
select 'deal' || l_orderkey as rule_id, count(*) as matches from lineitem join orders on l_orderkey = o_orderkey group by 1
union all select 'part' || l_partkey, count(*) from lineitem join part on l_partkey = p_partkey group by 1
union all select 'long', count(*) from lineitem where length(cast(l_orderkey as varchar)) >= 5 or length(cast(l_partkey as varchar)) >= 5 having count(*) > 0""")
def many_rules(spark, sf):
    """Every order and every part as a rule of its own, and one rule that needs no word, over a line per line item."""
    lines = v.table(spark, sf, "lineitem").select(F.concat(F.lit("sold Deal"), "l_orderkey", F.lit(" of part"), "l_partkey", F.lit(";")).alias("text"))
    of = lambda table, key, name, head, tail: v.table(spark, sf, table).select(F.concat(F.lit(name), key).alias("rule_id"), F.concat(F.lit(head), key, F.lit(tail)).alias("pattern"))
    rules = of("orders", "o_orderkey", "deal", r"\bDeal", r"\b").unionByName(of("part", "p_partkey", "part", "(?i)PART", ";"))
    rules = rules.unionByName(spark.range(1).select(F.lit("long").alias("rule_id"), F.lit(r"\d{5}").alias("pattern")))
    return sr.many_rules(lines, rules.withColumn("rule_no", F.xxhash64("rule_id"))).groupBy("rule_id").agg(F.count("*").alias("matches"))

"""Classification, previews, work planning, coverage and corpus sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify as cl, planning as pl
from ..plans import views as v
from ..sources import corpus
from .registry import query

# ---- classification -----------------------------------------------------------------------------
PATH_SQL = "case when l_returnflag = 'R' then 'src/' when l_returnflag = 'A' then 'tests/' else '' end || 'p' || l_partkey || case when l_linenumber = 1 then '.py' when l_linenumber = 2 then '.GO' when l_linenumber = 3 then '.md' when l_linenumber = 4 then '/README.md' when l_linenumber = 5 then '/.env' when l_linenumber = 6 then '.tsx' else '.cc' end"


def _paths(spark, sf):
    return v.table(spark, sf, "lineitem").select(F.expr(PATH_SQL).alias("path"))


@query("file_languages", f"""
with p as (select {PATH_SQL} as path, l_linenumber as k from lineitem) select path, case k when 1 then 'python' when 6 then 'typescript' when 7 then 'cpp' else 'text' end as language, count(*) as n from p group by all""")
def file_languages(spark, sf):
    return _paths(spark, sf).withColumn("language", tx.classify_language(F.col("path"))).groupBy("path", "language").agg(F.count("*").alias("n"))


@query("ranking_eligible", f"""
with p as (select {PATH_SQL} as path, l_linenumber as k, l_returnflag as f from lineitem) select path, f <> 'A' and k in (1, 2, 6, 7) as eligible, count(*) as n from p group by all""")
def ranking_eligible(spark, sf):
    return _paths(spark, sf).withColumn("eligible", cl.ranking_eligible(F.col("path"))).groupBy("path", "eligible").agg(F.count("*").alias("n"))


CODE_SQL = """code as (select doc_id, case lang when 'en' then 'async def ' when 'fr' then 'export const ' when 'de' then 'class ' else 'func (r *T) ' end || source || case lang when 'fr' then ' = async (a) => x' else '(a):' end || chr(10) || text as content, lang, source from documents)"""


def _code(spark, sf):
    d = v.table(spark, sf, "documents")
    head = F.concat(F.when(F.col("lang") == "en", "async def ").when(F.col("lang") == "fr", "export const ").when(F.col("lang") == "de", "class ").otherwise("func (r *T) "),
                    "source", F.when(F.col("lang") == "fr", " = async (a) => x").otherwise("(a):"))
    return d.select("doc_id", F.concat_ws("\n", head, "text").alias("content"), "lang", "source")


@query("file_outlines", f"""with {CODE_SQL} select doc_id, case lang when 'en' then 'def ' when 'fr' then 'arrow ' when 'de' then 'class ' else 'func ' end || source as first_label from code""")
def file_outlines(spark, sf):
    return _code(spark, sf).select("doc_id", cl.structural_outline(F.col("content"))[0].alias("first_label"))


@query("sample_lines", """
with l as (select doc_id, string_split_regex(text, '\\r?\\n') as ls from documents), s as (select doc_id, ls, len(ls) as n, greatest(1, floor((len(ls) - 1) / 9.0))::int as step from l)
select doc_id, case when n <= 11 then array_to_string(ls[1:10], '|') else array_to_string([ls[1 + i * step] for i in range(0, 10) if 1 + i * step <= n], '|') end as sample from s""")
def sample_lines(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.array_join(cl.sample_lines(F.col("text")), "|").alias("sample"))


@query("file_previews", f"""with {CODE_SQL},
s as (select doc_id, lang, source, ls, len(ls) as n, greatest(1, floor((len(ls) - 1) / 9.0))::int as step from (select doc_id, lang, source, string_split_regex(content, '\\r?\\n') as ls from code)),
p as (select doc_id, [case lang when 'en' then 'def ' when 'fr' then 'arrow ' when 'de' then 'class ' else 'func ' end || source]
  || case when n <= 11 then ls[1:10] else [ls[1 + i * step] for i in range(0, 10) if 1 + i * step <= n] end as ps from s),
u as (select doc_id, unnest(ps) as part, generate_subscripts(ps, 1) as i from p),
c as (select *, sum(strlen(part)) over (partition by doc_id order by i) as total from u)
select doc_id, string_agg(part, chr(10) order by i) as preview from c where i = 1 or (total - strlen(part) < 1024 and total <= 1024) group by doc_id""")
def file_previews(spark, sf):
    """Outline and spread lines of every document as code, as many as fit the byte budget."""
    return _code(spark, sf).select("doc_id", cl.file_preview(F.col("content")).alias("preview"))


SIG = [
    ("externally reachable request surface", r"(?i)(?:^|/)(?:routes?|controllers?|handlers?|api|server|middleware)(?:/|\.|\z)|\b(?:app|router)\.(?:get|post|put|delete|use)\b", "b"),
    ("execution or query sink", r"(?i)\b(?:eval|Function|exec(?:File)?|spawn|system|child_process|Runtime\.getRuntime)\b|\b(?:SELECT|INSERT|UPDATE|DELETE)\b", "b"),
    ("outbound network or transport control", r"(?i)\b(?:fetch|axios|request|http\.request|https\.request|urlopen|net\.Dial)\b|rejectUnauthorized\s*:\s*false|InsecureSkipVerify", "b"),
    ("authorization or identity control", r"(?i)\b(?:auth|authori[sz]|permission|role|session|jwt|token|oauth)\b", "b"),
    ("credential or key material", r"(?i)\b(?:secret|password|api[_-]?key|private[_-]?key|credential)\b", "b"),
    ("build or supply-chain control", r"(?i)(?:^|/)(?:\.github/workflows|Dockerfile|package(?:-lock)?\.json|pnpm-lock\.yaml|yarn\.lock|Cargo\.lock|go\.sum)(?:\z|/)", "p"),
    ("parser or deserialization boundary", r"(?i)\b(?:deserialize|pickle|yaml\.load|XMLParser|ObjectInputStream|unserialize)\b", "b"),
]


def _sig_sql(path, body, build=True):
    parts = [f"case when regexp_matches({path if k == 'p' else path + ' || chr(10) || ' + body}, '{p}') then '{label}' end" for label, p, k in SIG if build or k != "p"]
    return f"[s for s in [{', '.join(parts)}] if s is not null]"


MIXED_SQL = "mixed as (select source as scan_id, source || '/' || doc_id || '.py' as path, case lang when 'en' then 'eval(x)' when 'fr' then 'oauth token' when 'de' then 'api-key' else 'plain' end || chr(10) || text as content from documents)"


def _mixed(spark, sf):
    d = v.table(spark, sf, "documents")
    word = F.when(F.col("lang") == "en", "eval(x)").when(F.col("lang") == "fr", "oauth token").when(F.col("lang") == "de", "api-key").otherwise("plain")
    return d.select(F.col("source").alias("scan_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".py")).alias("path"), F.concat_ws("\n", word, "text").alias("content"))


@query("risk_signals", f"with {MIXED_SQL} select path, array_to_string({_sig_sql('path', 'content')}, ',') as signals from mixed")
def risk_signals(spark, sf):
    return _mixed(spark, sf).select("path", F.array_join(cl.risk_signals(F.col("path"), F.col("content")), ",").alias("signals"))


THREAT = {k: p for k, _, p in cl.THREAT_SIGNALS}


@query("threat_signals", f"""with {MIXED_SQL} select scan_id, count(*) as files, {', '.join(f"sum(case when regexp_matches(content, '{p}') then 1 else 0 end) as {k}" for k, p in THREAT.items())} from mixed group by scan_id""")
def threat_signals(spark, sf):
    return cl.threat_signals(_mixed(spark, sf))


@query("threat_citations", f"""
with {MIXED_SQL}, s(n, label, pattern) as (values {', '.join(f"({i}, '{label}', '{p}')" for i, (_, label, p) in enumerate(cl.THREAT_SIGNALS))})
select scan_id, path, label as signal from mixed join s on regexp_matches(content, pattern) qualify row_number() over (partition by scan_id order by path, n) <= 30""")
def threat_citations(spark, sf):
    return cl.threat_citations(_mixed(spark, sf))


@query("runtime_policies", r"""
with p as (select source as scan_id, case lang when 'en' then 'The production API is described.' || chr(10) || 'It is in scope.' when 'fr' then 'in scope: the server' else text end as content from documents)
select scan_id, bool_or(regexp_matches(content, '(?is)\b(?:runtime|production|service|api|server)\b.{0,160}\b(?:in scope|supported|security boundary)\b|\b(?:in scope|supported|security boundary)\b.{0,160}\b(?:runtime|production|service|api|server)\b')) as runtime_in_scope from p group by scan_id""")
def runtime_policies(spark, sf):
    d = v.table(spark, sf, "documents")
    text = F.when(F.col("lang") == "en", "The production API is described.\nIt is in scope.").when(F.col("lang") == "fr", "in scope: the server").otherwise(F.col("text"))
    return cl.runtime_boundary(d.select(F.col("source").alias("scan_id"), text.alias("content")))


@query("target_snapshots", """
with s as (select o_orderkey as scan_id, '/work/t' || o_custkey as root, case o_orderpriority when '1-URGENT' then 'git@github.com:own/r' || o_custkey || '.git' when '2-HIGH' then 'https://github.com/own/r' || o_custkey || '/?x=1' when '3-MEDIUM' then 'https://other.example/x' else '' end as remote,
  case when o_orderstatus <> 'P' then 'abc' end as revision, o_totalprice > 250000 as dirty from orders),
c as (select *, regexp_replace(remote, '[?#].*$', '') as r, case when o.o_orderpriority in ('1-URGENT', '2-HIGH') and revision is not null and not dirty then 'own/r' || o.o_custkey end as repo from s join orders o on o.o_orderkey = s.scan_id)
select scan_id, case when revision is null then 'directory_snapshot' when repo is not null then 'git_revision' else 'git_worktree' end as kind,
  'scanlake-target/v1:sha256:' || sha256(case when revision is null then root else coalesce(repo, nullif(r, ''), root) end) as target_id, repo as source_repository, 't' || o_custkey as display_name from c""")
def target_snapshots(spark, sf):
    o = v.table(spark, sf, "orders")
    remote = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("git@github.com:own/r"), "o_custkey", F.lit(".git"))).when(
        F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("https://github.com/own/r"), "o_custkey", F.lit("/?x=1"))).when(F.col("o_orderpriority") == "3-MEDIUM", "https://other.example/x").otherwise("")
    s = o.select(F.col("o_orderkey").alias("scan_id"), F.concat(F.lit("/work/t"), "o_custkey").alias("root"), remote.alias("remote"),
                 F.when(F.col("o_orderstatus") != "P", "abc").alias("revision"), (F.col("o_totalprice") > 250000).alias("dirty"))
    return cl.target_snapshot(s).select("scan_id", "kind", "target_id", "source_repository", "display_name")


@query("validation_strategies", """
with f as (select o_orderkey as candidate_id, o_custkey as scan_id, o_orderpriority = '1-URGENT' as ui, o_orderstatus as st from orders), p as (select c_custkey as scan_id, c_mktsegment in ('BUILDING', 'MACHINERY') as compiled, c_acctbal > 0 as cmds from customer)
select f.candidate_id, m.method, case m.method when 'source_trace' then 'available_without_execution' when 'isolated_project_checks' then case when coalesce(cmds, false) then 'runnable_with_approval' else 'not_applicable' end
  when 'realistic_interface_reproduction' then case when ui then 'requires_explicit_setup' else 'not_applicable' end else case when coalesce(compiled, false) then 'requires_explicit_setup' else 'not_applicable' end end as status
from f left join p using (scan_id), (values ('isolated_project_checks'), ('realistic_interface_reproduction'), ('debugger_trace'), ('sanitizer_or_memory_checker'), ('source_trace')) m(method)""")
def validation_strategies(spark, sf):
    f = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("scan_id"), F.lit("cause").alias("root_cause"), F.lit("none").alias("validation"),
                                            F.array(F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "src/routes.py").otherwise("src/util.py").alias("file"))).alias("locations"))
    p = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("scan_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.array(F.lit("go"))).otherwise(F.array(F.lit("php"))).alias("languages"),
                                              F.when(F.col("c_acctbal") > 0, F.array(F.lit("npm test"))).otherwise(F.array().cast("array<string>")).alias("commands"))
    return cl.validation_strategies(f, p).select("candidate_id", "method", "status")


# ---- regions and work ---------------------------------------------------------------------------------
REGIONS_SQL = f"""{MIXED_SQL}, ls as (select *, sha256(content) as sha, string_split_regex(content, '\\r?\\n') as all_lines from mixed),
tl as (select *, case when len(all_lines) > 1 and all_lines[-1] = '' then all_lines[:-2] else all_lines end as lines from ls),
cut as (select scan_id, path, sha, lines, unnest(range(1, greatest(1, len(lines)) + 1, 20)) as start_line from tl),
reg as (select scan_id, path, sha, start_line, least(len(lines), start_line + 19) as end_line, array_to_string(lines[start_line:start_line + 19], chr(10)) as text from cut),
regions as (select *, 'region_' || left(sha256(path || ':' || sha || ':' || start_line || ':' || end_line), 24) as region_id, {_sig_sql('path', 'text')} as signals from reg)"""


def _regions(spark, sf):
    return pl.split_regions(_mixed(spark, sf), 20)


@query("review_regions", f"with {REGIONS_SQL} select region_id, path, start_line, end_line, len(signals) * 100 + case when start_line = 1 then 1 else 0 end as priority, array_to_string(signals, ',') as signals from regions")
def review_regions(spark, sf):
    return _regions(spark, sf).select("region_id", "path", "start_line", "end_line", "priority", F.array_join("risk_signals", ",").alias("signals"))


WORK_SQL = f"""{MIXED_SQL}, work as (select scan_id, path, sha256(content) as sha, {_sig_sql('path', 'content', False)} as signals from mixed), w as (select *, len(signals) * 100 as priority from work)"""


@query("file_worklists", f"with {WORK_SQL} select scan_id, path, priority, array_to_string(signals, ',') as signals from w")
def file_worklists(spark, sf):
    return pl.file_worklist(_mixed(spark, sf)).select("scan_id", "path", "priority", F.array_join("risk_signals", ",").alias("signals"))


@query("worklist_digests", f"""
with {WORK_SQL}, i as (select scan_id, path, priority, left(sha256(path), 3) as bucket, '{{"path":"' || path || '","sha256":"' || sha || '","language":"python","risk_signals":[' || array_to_string([('"' || s || '"') for s in signals], ',')
  || '],"priority":' || priority || '}}' as item from w),
p as (select scan_id as scan_id, bucket, count(*) as n, sha256(string_agg(item, ',' order by priority desc, path)) as d from i group by all)
select scan_id, cast(sum(n) as bigint) as n_items, sha256(string_agg(bucket || ':' || d, ',' order by bucket)) as digest from p group by scan_id""")
def worklist_digests(spark, sf):
    return pl.worklist_digest(pl.file_worklist(_mixed(spark, sf)))


@query("worklist_tree_digest", f"""
with {WORK_SQL}, i as (select scan_id, path, priority, left(sha256(path), 3) as bucket, '{{"path":"' || path || '","sha256":"' || sha || '","language":"python","risk_signals":[' || array_to_string([('"' || s || '"') for s in signals], ',')
  || '],"priority":' || priority || '}}' as item from w),
p as (select 'all' as scan_id, bucket, count(*) as n, sha256(string_agg(item, ',' order by priority desc, path)) as d from i group by all)
select scan_id, cast(sum(n) as bigint) as n_items, sha256(string_agg(bucket || ':' || d, ',' order by bucket)) as digest from p group by scan_id""")
def worklist_tree_digest(spark, sf):
    """All files in one scan, so that buckets hold several items."""
    return pl.worklist_digest(pl.file_worklist(_mixed(spark, sf)).withColumn("scan_id", F.lit("all")))


@query("investigation_packets", f"""
with {WORK_SQL}, a as (select *, coalesce(signals[1], 'open-ended') as area from w), r as (select *, row_number() over (partition by scan_id, area order by priority desc, path) as rn from a)
select scan_id, area, count(*) as n_paths, string_agg(path, ',' order by rn) filter (where rn <= 3) as entry_points,
  case when contains(area, 'request') or contains(area, 'authorization') then 'unauthenticated or lower-trust caller' else 'caller or lower-trust component' end as attacker from r group by all""")
def investigation_packets(spark, sf):
    return pl.packets(pl.file_worklist(_mixed(spark, sf))).select("scan_id", "area", "n_paths", F.array_join("entry_points", ",").alias("entry_points"), "attacker")


@query("rank_input", f"""with {WORK_SQL} select w.path, '{{"path":"' || w.path || '","area":"' || coalesce(signals[1], 'general') || '"}}' as head, length(m.content) > 0 as has_preview from w join mixed m using (scan_id, path)""")
def rank_input(spark, sf):
    r = pl.rank_input(pl.file_worklist(_mixed(spark, sf), preview=True))
    head = F.to_json(F.struct(F.get_json_object("value", "$.path").alias("path"), F.get_json_object("value", "$.area").alias("area")))
    return r.select("path", head.alias("head"), (F.length(F.get_json_object("value", "$.preview")) > 0).alias("has_preview"))


# Orders are regions (pending ones under another id, so that some closures lie outside), line items with a return are closures by a reviewer (the line status), others deferrals.
COVER_SQL = """wl as (select case when o_orderstatus = 'P' then -o_orderkey else o_orderkey end as region_id from orders), rv as (select distinct l_linestatus as worker_id, l_orderkey as region_id from lineitem where l_returnflag <> 'N'),
df as (select distinct l_linestatus as worker_id, l_orderkey as region_id, case when l_tax < 0.02 then ' x ' else 'too big to read' end as reason from lineitem where l_returnflag = 'N'),
cl as (select worker_id, region_id from rv union select worker_id, region_id from df), ws as (select distinct worker_id from cl)"""


def _coverage(spark, sf):
    wl = v.table(spark, sf, "orders").selectExpr("case when o_orderstatus = 'P' then -o_orderkey else o_orderkey end as region_id")
    li = v.table(spark, sf, "lineitem").selectExpr("l_linestatus as worker_id", "l_orderkey as region_id", "l_returnflag", "case when l_tax < 0.02 then ' x ' else 'too big to read' end as reason")
    return wl, li.filter("l_returnflag <> 'N'").select("worker_id", "region_id").distinct(), li.filter("l_returnflag = 'N'").select("worker_id", "region_id", "reason").distinct()


@query("coverage_gaps", f"""
with {COVER_SQL} select worker_id, region_id, 'outside worklist' as error, 1 as n from cl where region_id not in (select region_id from wl)
union all select worker_id, null, 'not closed', (select count(*) from wl) - count(wl.region_id) as k from ws left join cl using (worker_id) left join wl on wl.region_id = cl.region_id group by worker_id having k > 0
union all select null, region_id, 'not closed by every worker', (select count(*) from ws) - count(worker_id) as k from wl left join cl using (region_id) group by region_id having k > 0
union all select worker_id, region_id, 'reason required', 1 from df where length(trim(reason)) < 3""")
def coverage_gaps(spark, sf):
    return pl.coverage_gaps(*_coverage(spark, sf))


@query("coverage_ledger", f"""
with {COVER_SQL} select region_id, coalesce(n, 0) as n_reviewed, coalesce(why, 'none') as deferred from wl left join (select region_id, count(distinct worker_id) as n from rv group by all) using (region_id)
left join (select region_id, string_agg(distinct worker_id || ': ' || trim(reason), '; ' order by worker_id || ': ' || trim(reason)) as why from df group by all) using (region_id)""")
def coverage_ledger(spark, sf):
    return pl.coverage_ledger(*_coverage(spark, sf))


@query("candidates_in_scope", f"""
with {REGIONS_SQL}, c as (select user_id, event_id, (select min(path) from mixed) as nothing, cast(floor(value) as int) + 1 as line from events), d as (select doc_id, source || '/' || doc_id || '.py' as path from documents)
select c.event_id, r.region_id from c join d on d.doc_id = c.user_id join regions r on r.path = d.path and c.line between r.start_line and r.end_line""")
def candidates_in_scope(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.col("source").alias("scan_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".py")).alias("path"))
    e = v.table(spark, sf, "events")
    c = e.join(d, e.user_id == d.doc_id).select("event_id", "scan_id", "path", (F.floor("value").cast("int") + 1).alias("line"))
    return pl.in_scope(c, _regions(spark, sf), 20).select("event_id", "region_id")


@query("rule_surfaces", """
with t as (select 'rule-' || lower(l_returnflag) as rule, l_linestatus as st from lineitem) select 'repo' as scan_id, rule as id, count(*) as matches, 'needs_follow_up' as disposition from t where st = 'O' group by all""")
def rule_surfaces(spark, sf):
    r = v.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("rule-"), F.lower("l_returnflag")).alias("rule"), F.when(F.col("l_linestatus") == "O", "baseline").otherwise("injection").alias("scan_pass")).agg(F.count("*").alias("matches"))
    return pl.surfaces(r.withColumn("scan_id", F.lit("repo")))


@query("validation_tasks", """
select 'task_' || left(sha256('s' || o_custkey || ':cand_' || o_orderkey || ':validation'), 24) as id, 'cand_' || o_orderkey as candidate_id, 'Validate t' || o_orderkey || ': establish attacker, entrypoint, trust boundary, root control, sink, impact, and counterevidence.' as focus from orders""")
def validation_tasks(spark, sf):
    from ..operators.reduce import validation_tasks as tasks
    f = v.table(spark, sf, "orders").selectExpr("concat('s', o_custkey) as scan_id", "concat('cand_', o_orderkey) as candidate_id", "concat('t', o_orderkey) as title")
    return tasks(f).select("id", "candidate_id", "focus")


# ---- corpus sources ----------------------------------------------------------------------------------
ENTRY_SQL = "case when l_returnflag = 'R' then 'src/' when l_returnflag = 'A' then 'lib/node_modules/' else 'dist/' end || 'p' || l_partkey || '_' || l_suppkey || case when l_linenumber < 5 then '.py' when l_linenumber = 5 then '.bin' else '.yaml' end"
ENTRIES_SQL = f"""en as (select {ENTRY_SQL} as path, cast(max(l_quantity) * 6000 as bigint) as bytes, bool_or(l_discount >= 0.1) as is_symlink from lineitem group by 1),
es as (select *, case when path not like 'src/%' then 'ignored_directory' when is_symlink then 'symlink' when path like '%.bin' then 'other_type' when bytes > 262144 then 'oversize' else 'selected' end as st from en),
ek as (select *, row_number() over (partition by st order by path) as rn from es), ef as (select path, case when st = 'selected' and rn > 100 then 'over_limit' else st end as state from ek)"""


def _entries(spark, sf):
    return v.table(spark, sf, "lineitem").groupBy(F.expr(ENTRY_SQL).alias("path")).agg((F.max("l_quantity") * 6000).cast("bigint").alias("bytes"), F.bool_or(F.col("l_discount") >= 0.1).alias("is_symlink")) \
        .withColumn("scan_id", F.lit("repo"))


@query("source_inventory", f"with {ENTRIES_SQL} select path, state from ef")
def source_inventory(spark, sf):
    return corpus.source_inventory(_entries(spark, sf), max_bytes=262_144, max_files=100).select("path", "state")


@query("inventory_summary", f"""with {ENTRIES_SQL} select 'repo' as scan_id, sum(case when state = 'selected' then 1 else 0 end) as files,
  sum(case when state in ('symlink', 'oversize') then 1 else 0 end) + count(distinct case when state = 'ignored_directory' then case when path like 'dist%' then 'dist' else 'lib/node_modules' end end) as skipped, not bool_or(state = 'over_limit') as complete from ef""")
def inventory_summary(spark, sf):
    return corpus.inventory_summary(corpus.source_inventory(_entries(spark, sf), max_bytes=262_144, max_files=100))


@query("policy_chains", """
with t as (select 'repo' as scan_id, 'n' || c_nationkey || '/s' || c_mktsegment || '/f' || c_custkey || '.py' as path, c_nationkey as n, c_mktsegment as s from customer),
p as (select 'n' || n_nationkey as dir, n_name as body, n_nationkey as n, '' as s from nation where n_regionkey < 3 union all select distinct 'n' || c_nationkey || '/s' || c_mktsegment, 'seg', c_nationkey, c_mktsegment from customer where c_mktsegment = 'BUILDING')
select t.path, coalesce(string_agg(p.dir || '/SECURITY.md', ',' order by length(p.dir)), '') as policy_files, coalesce(string_agg('# ' || p.dir || '/SECURITY.md' || chr(10) || chr(10) || p.body, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by length(p.dir)),
  'No SECURITY.md policy guidance was found. Apply least privilege, explicit trust boundaries, and fail-closed security controls.') as guidance
from t left join p on p.n = t.n and (p.s = '' or p.s = t.s) group by t.path""")
def policy_chains(spark, sf):
    c, n = v.table(spark, sf, "customer"), v.table(spark, sf, "nation")
    t = c.select(F.lit("repo").alias("scan_id"), F.concat(F.lit("n"), "c_nationkey", F.lit("/s"), "c_mktsegment", F.lit("/f"), "c_custkey", F.lit(".py")).alias("path"))
    name = lambda yes: F.when(yes, "/SECURITY.md").otherwise("/NOTES.md")
    p = n.select(F.lit("repo").alias("scan_id"), F.concat(F.lit("n"), "n_nationkey", name(F.col("n_regionkey") < 3)).alias("path"), F.col("n_name").alias("content"))
    p = p.unionByName(c.select(F.lit("repo").alias("scan_id"), F.concat(F.lit("n"), "c_nationkey", F.lit("/s"), "c_mktsegment", name(F.col("c_mktsegment") == "BUILDING")).alias("path"), F.lit("seg").alias("content")).distinct())
    return corpus.policy_chain(p, t).select("path", "policy_files", "guidance")


@query("preflight_checks", """
with r as (select o_custkey as scan_id, case o_orderpriority when '1-URGENT' then 'go.mod' when '2-HIGH' then 'Cargo.toml' when '3-MEDIUM' then 'a.py' else 'b.txt' end as name from orders)
select scan_id, count(*) as n_files, sum(case when name in ('go.mod', 'Cargo.toml') then 1 else 0 end) as n_manifests, case when bool_or(name = 'go.mod') then 'go test ./...' when bool_or(name = 'Cargo.toml') then 'cargo test' else '' end as commands,
  case when bool_or(name = 'a.py') then 'python' else '' end as languages, case when bool_or(name in ('go.mod', 'Cargo.toml')) then 'ready' else 'warn' end as status from r group by scan_id""")
def preflight_checks(spark, sf):
    o = v.table(spark, sf, "orders")
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "go.mod").when(F.col("o_orderpriority") == "2-HIGH", "Cargo.toml").when(F.col("o_orderpriority") == "3-MEDIUM", "a.py").otherwise("b.txt")
    r = o.select(F.col("o_custkey").alias("scan_id"), name.alias("path")).withColumn("language", tx.classify_language(F.col("path")))
    return corpus.preflight(r).select("scan_id", "n_files", "n_manifests", F.array_join("commands", ",").alias("commands"), F.array_join("languages", ",").alias("languages"), "status")


@query("knowledge_base_load", """
with recursive d as (select source as scan_id, doc_id || case lang when 'de' then '.pdf' else '.md' end as path, lang, length(text) as n, strlen(text) as b from documents),
f as (select *, row_number() over (partition by scan_id order by path) as k from d where lang <> 'de' and n <= 20000 and b <= 20000),
walk(scan_id, k, used, taken, path, ok) as (
  select distinct scan_id, cast(0 as bigint), cast(0 as hugeint), 0, '', false from f
  union all
  select f.scan_id, f.k, w.used + case when w.used + f.n <= 60000 and w.taken < 30 then f.n else 0 end, w.taken + case when w.used + f.n <= 60000 and w.taken < 30 then 1 else 0 end, f.path, w.used + f.n <= 60000 and w.taken < 30
  from walk w join f on f.scan_id = w.scan_id and f.k = w.k + 1),
t as (select scan_id, path from walk where ok),
l as (select scan_id, max(path) as last_path from t group by scan_id having count(*) >= 30)
select d.scan_id, d.path, cast(d.n as bigint) as n_chars, t.path is not null as loaded,
       case when t.path is not null then null when d.b > 20000 then 'too large' when d.path > l.last_path then 'document limit' when d.lang = 'de' then 'unsupported type' when d.n > 20000 then 'too large' else 'total limit' end as reason
from d left join t using (scan_id, path) left join l using (scan_id)""")
def knowledge_base_load(spark, sf):
    """Greedy budget per source."""
    d = v.table(spark, sf, "documents").select(F.col("source").alias("scan_id"), F.concat("doc_id", F.when(F.col("lang") == "de", ".pdf").otherwise(".md")).alias("path"), F.col("text").alias("content"))
    return corpus.knowledge_base(d, doc_limit=20_000, max_docs=30, total_limit=60_000)


@query("target_list", "select distinct c_mktsegment as path from customer")
def target_list(spark, sf):
    return corpus.targets(v.table(spark, sf, "customer").select(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("path")))



"""Intake and backlog triage; line items and orders stand for imported claims and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.versions import in_range, semver
from ..operators import classify as cl, patterns as pt, triage as tr
from ..plans import views as v
from ..sources import intake, manifests
from .registry import query

# ---- versions ---------------------------------------------------------------------------------
VER_SQL = "cast(floor(l_quantity / 10) as int) || '.' || l_linenumber || '.' || cast(floor(l_discount * 100) as int)"
RANGE_SQL = "case l_returnflag when 'A' then '>=1.0.0 <3.2.0' when 'R' then '1.2.0 - 2.4.0 || ^4.1.2' else case when l_linestatus = 'O' then '~2.3.0 || 3.x' else 'latest' end end"


def _ver():
    part = lambda c: c.cast("int").cast("string")
    return F.concat_ws(".", part(F.floor(F.col("l_quantity") / 10)), F.col("l_linenumber").cast("string"), part(F.floor(F.col("l_discount") * 100)))


def _scan():
    return F.concat(F.lit("s"), F.col("l_orderkey") % 3).alias("scan_id")


def _range():
    return F.expr(RANGE_SQL)


@query("version_ranges", f"""
with x as (select l_orderkey, {VER_SQL} as version, {RANGE_SQL} as affected, cast(floor(l_quantity / 10) as int) as a, l_linenumber as b, cast(floor(l_discount * 100) as int) as c from lineitem),
y as (select *, (a, b, c) as t from x),
z as (select version, affected, case affected when '>=1.0.0 <3.2.0' then t >= (1, 0, 0) and t < (3, 2, 0) when '1.2.0 - 2.4.0 || ^4.1.2' then (t >= (1, 2, 0) and t <= (2, 4, 0)) or (t >= (4, 1, 2) and t < (5, 0, 0))
  when '~2.3.0 || 3.x' then (t >= (2, 3, 0) and t < (2, 4, 0)) or a = 3 end as inside from y)
select version, affected, inside, count(*) as n from z group by all""")
def version_ranges(spark, sf):
    li = v.table(spark, sf, "lineitem").select(_ver().alias("version"), _range().alias("affected"))
    seen = li.groupBy("version", "affected").agg(F.count("*").alias("n"))
    return seen.withColumn("inside", in_range(F.col("version"), F.col("affected")))


@query("parsed_versions", f"with x as (select {VER_SQL} as version from lineitem) select version, split_part(version, '.', 1) || ',' || split_part(version, '.', 2) || ',' || split_part(version, '.', 3) as parts, count(*) as n from x group by all")
def parsed_versions(spark, sf):
    li = v.table(spark, sf, "lineitem").select(_ver().alias("version"))
    return li.withColumn("parts", F.array_join(semver(F.concat(F.lit("v"), "version", F.lit("-rc1"))).cast("array<string>"), ",")).groupBy("version", "parts").agg(F.count("*").alias("n"))


# ---- claims --------------------------------------------------------------------------------------
# One claim per order, in one of three scans that share paths, rules and components. Its locations are the parts of its line items (a handful per order).
TITLE_SQL = "case o_orderpriority when '1-URGENT' then 'Critical SSRF in fetch' when '2-HIGH' then 'High path traversal' when '3-MEDIUM' then 'medium TLS certificate issue' else 'odd report' end"
CLAIMS_SQL = f"""claims as (select 's' || o_orderkey % 3 as scan_id, o_orderkey as id, {TITLE_SQL} as title from orders),
fam as (select scan_id, id, title, case when title like '%SSRF%' then 'ssrf-request-sink' when title like '%traversal%' then 'path-traversal-sink' when title like '%TLS%' then 'tls-verification-disabled' end as family from claims),
locs as (select 's' || l_orderkey % 3 as scan_id, l_orderkey as id, 'src/p' || l_partkey || '.py' as file, case when l_linestatus = 'F' then l_linenumber end as line from lineitem),
cand as (select 's' || l_orderkey % 3 as scan_id, case when l_returnflag = 'R' then 'tls-verification-disabled' when l_returnflag = 'A' then 'ssrf-request-sink' else 'path-traversal-sink' end as rule,
   'src/p' || l_partkey || '.py' as file, l_linenumber as line, max(case when l_tax >= 0.04 then 1 else 0 end) as ctx from lineitem where l_quantity >= 25 group by all),
hits as (select l.id, count(*) as exact, sum(ctx) as ctx from locs l join fam using (id) join cand c on c.scan_id = l.scan_id and c.file = l.file and c.rule = family and (l.line is null or l.line = c.line) group by l.id),
fils as (select 's' || k as scan_id, 'src/p' || p_partkey || '.py' as file from part, range(3) t(k) where p_size <= 45 - 5 * k),
rd as (select id, count(*) as readable from locs join fils using (scan_id, file) group by id), nl as (select id, count(*) as n_locations from locs group by id),
m as (select fam.*, coalesce(n_locations, 0) as n_locations, coalesce(readable, 0) as n_readable, coalesce(exact, 0) as exact_matches, coalesce(ctx, 0) as context_matches
  from fam left join nl using (id) left join rd using (id) left join hits using (id)),
st as (select *, case when exact_matches > 0 then 'affected' when family is not null and n_locations > 0 and n_readable = n_locations then 'not_affected' else 'needs_information' end as status from m)"""


def claims(spark, sf):
    li = v.table(spark, sf, "lineitem")
    locs = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(
        F.concat(F.lit("src/p"), "l_partkey", F.lit(".py")).alias("file"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).alias("line"))).alias("locations"))
    o = v.table(spark, sf, "orders").selectExpr("concat('s', o_orderkey % 3) as scan_id", "o_orderkey as id", f"{TITLE_SQL} as title", "'' as description", "cast(null as string) as cwe", "cast(null as string) as rule_id", "cast(null as string) as impact")
    return tr.with_families(o.join(locs, "id", "left").withColumn("locations", F.coalesce("locations", F.array().cast("array<struct<file:string,line:int>>"))))


def local(spark, sf):
    li = v.table(spark, sf, "lineitem")
    rule = F.when(F.col("l_quantity") < 25, "rule-of-no-family").when(F.col("l_returnflag") == "R", "tls-verification-disabled").when(F.col("l_returnflag") == "A", "ssrf-request-sink").otherwise("path-traversal-sink")
    note = F.when(F.col("l_tax") >= 0.04, F.array(pt.evidence("context", F.lit("x")))).otherwise(F.array(pt.evidence("pattern", F.lit("x"))))
    cand = li.select(_scan(), rule.alias("rule"), F.concat(F.lit("src/p"), "l_partkey", F.lit(".py")).alias("file"), F.col("l_linenumber").alias("line"), note.alias("evidence"))
    parts = v.table(spark, sf, "part").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    files = parts.select(F.concat(F.lit("s"), "k").alias("scan_id"), F.concat(F.when(F.expr("p_size <= 45 - 5 * k"), "src/p").otherwise("moved/p"), "p_partkey", F.lit(".py")).alias("path"))
    return cand, files


@query("compatible_rules", f"with {CLAIMS_SQL} select id, coalesce(family, '') as families from fam")
def compatible_rules(spark, sf):
    return claims(spark, sf).select("id", F.array_join("families", ",").alias("families"))


PLACES_SQL = """dl as (select distinct scan_id, id, file, line from locs),
ph as (select l.scan_id, l.id, l.file, l.line, count(*) as n, sum(ctx) as ctx from dl l join fam using (id) join cand c on c.scan_id = l.scan_id and c.file = l.file and c.rule = family and (l.line is null or l.line = c.line) group by all),
places as (select l.*, coalesce(ph.n, 0) as n, coalesce(ph.ctx, 0) as ctx, family, exists (select 1 from fils where fils.scan_id = l.scan_id and fils.file = l.file) as readable
  from dl l join fam using (id) left join ph on ph.id = l.id and ph.file = l.file and ph.line is not distinct from l.line)"""


@query("matched_claims", f"""with {CLAIMS_SQL}, {PLACES_SQL} select id, n_locations, n_readable, exact_matches, context_matches, status, case when status = 'needs_information' then 'low' else 'medium' end as status_confidence,
  coalesce(lim.t, '') as unmatched, coalesce(evi.t, '') as matched from st
  left join (select id, string_agg(distinct 'Nothing that fits at ' || file || coalesce(':' || line, '') || '.', '|' order by 'Nothing that fits at ' || file || coalesce(':' || line, '') || '.') as t from places where readable and n = 0 and family is not null group by id) lim using (id)
  left join (select id, string_agg(distinct file || coalesce(':' || line, '') || ' holds ' || n || ' compatible match(es), ' || ctx || ' with context.', '|' order by file || coalesce(':' || line, '') || ' holds ' || n || ' compatible match(es), ' || ctx || ' with context.') as t from places where n > 0 group by id) evi using (id)""")
def matched_claims(spark, sf):
    m = tr.triage_status(tr.match_imported(claims(spark, sf), *local(spark, sf)))
    told = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "|")
    missed = F.filter("limitations", lambda x: F.startswith(x, F.lit("Nothing that fits at ")))
    return m.select("id", "n_locations", "n_readable", "exact_matches", "context_matches", "status", "status_confidence", told(missed).alias("unmatched"), told("evidence_lines").alias("matched"))


# ---- dependencies ------------------------------------------------------------------------------------
# Parts are components; line items are manifest rows (file = supplier), orders claim a component range.
DEPS_SQL = f"""ev as (select distinct 's' || l_orderkey % 3 as scan_id, 'c' || l_partkey as component, case when l_suppkey < 3 then 'docs/' else 'app/' end || 's' || l_suppkey || '/package.json' as file,
   case when l_discount >= 0.08 then null else {VER_SQL} end as version, case when l_suppkey < 3 then 'development' when l_tax >= 0.05 then 'development' when l_tax >= 0.01 then 'runtime' else 'unknown' end as scope from lineitem),
cl as (select 's' || o_orderkey % 3 as scan_id, o_orderkey as id, 'c' || o_custkey as component, case o_orderstatus when 'F' then 'advisory' when 'O' then 'generic' else 'freeform' end as source_type,
   case when o_orderpriority <> '5-LOW' then '>=1.0.0 <3.0.0' end as affected_version from orders),
el as (select *, source_type = 'advisory' or affected_version is not null as eligible from cl),
vs as (select distinct scan_id, component, version, scope from ev),
h as (select *, case when affected_version is not null and version is not null then cast(split_part(version, '.', 1) as int) between 1 and 2 end as hit from (select distinct scan_id, component, affected_version from el where eligible) x left join vs using (scan_id, component)),
g as (select scan_id, component, affected_version, count(scope) as n, count(version) as nv, sum(case when hit = false then 1 else 0 end) as n_out, bool_or(coalesce(hit, false) and scope = 'runtime') as rt, bool_or(coalesce(hit, false) and scope = 'development') as dev from h group by all),
ds as (select el.id, el.component, case when not eligible then null when n = 0 then 'not_present' when el.affected_version is not null and nv > 0 and n_out = nv then 'outside_affected_range' when rt then 'affected' when dev then 'non_runtime_only' else 'unknown' end as dependency_status
  from el left join g on g.scan_id = el.scan_id and g.component = el.component and g.affected_version is not distinct from el.affected_version)"""


def dependency_claims(spark, sf):
    return v.table(spark, sf, "orders").selectExpr("concat('s', o_orderkey % 3) as scan_id", "o_orderkey as id", "concat('c', o_custkey) as component", "case o_orderstatus when 'F' then 'advisory' when 'O' then 'generic' else 'freeform' end as source_type",
                                                   "case when o_orderpriority <> '5-LOW' then '>=1.0.0 <3.0.0' end as affected_version")


def dependencies(spark, sf):
    li = v.table(spark, sf, "lineitem")
    rows = li.select(_scan(), F.concat(F.lit("c"), "l_partkey").alias("component"),
                     F.concat(F.when(F.col("l_suppkey") < 3, "docs/").otherwise("app/"), F.lit("s"), "l_suppkey", F.lit("/package.json")).alias("file"),
                     F.when(F.col("l_discount") < 0.08, _ver()).alias("version"),
                     F.when(F.col("l_tax") >= 0.05, "development").when(F.col("l_tax") >= 0.01, "runtime").otherwise("unknown").alias("scope"))
    return rows.filter("version is null"), rows.filter("version is not null")


@query("dependency_evidence", f"with {DEPS_SQL} select scan_id, component, file, version, scope from ev semi join (select * from el where eligible) x using (scan_id, component)")
def dependency_evidence(spark, sf):
    return tr.dependency_evidence(dependency_claims(spark, sf), *dependencies(spark, sf))


@query("dependency_status", f"with {DEPS_SQL} select id, component, dependency_status from ds")
def dependency_status(spark, sf):
    c = dependency_claims(spark, sf)
    return tr.dependency_status(c, tr.dependency_evidence(c, *dependencies(spark, sf))).select("id", "component", "dependency_status")


BACKLOG_SQL = f"""{CLAIMS_SQL}, {DEPS_SQL},
bd as (select st.*, ds.dependency_status as dep, case when not s.n_out then null when s.all_out then false end as b0 from st join ds using (id)
  left join (select id, true as n_out, bool_and(file like '%/docs/%') as all_out from locs group by id) s using (id)),
bb as (select *, case when b0 is null and (context_matches > 0 or coalesce(dep = 'affected', false)) then true else b0 end as b from bd),
q as (select *, case when dep in ('not_present', 'outside_affected_range') then 'not_actionable' when dep is not null then 'needs_review' when status = 'affected' and coalesce(b, true) then 'needs_review'
   when status = 'not_affected' or b = false then 'not_actionable' else 'needs_review' end as queue0 from bb),
vd as (select *, case when queue0 = 'needs_review' and coalesce(b, false) and coalesce(dep = 'affected', status = 'affected') then 'confirmed' else queue0 end as verdict from q),
cf as (select *, case when verdict = 'not_actionable' then case when status = 'needs_information' then 'low' else 'medium' end when coalesce(dep = 'affected', false) or status = 'affected' then 'medium' else 'low' end as confidence from vd),
sc as (select *, (case when title ilike '%critical%' then 4 when title ilike '%high%' then 3 when title ilike '%medium%' then 2 else 1 end) * 10 + case when n_locations > 0 then 3 else 0 end + case when coalesce(b, false) then 4 else 0 end
   + case confidence when 'medium' then 2 else 1 end as score from cf)"""


def backlog(spark, sf):
    c = claims(spark, sf).join(dependency_claims(spark, sf), ["scan_id", "id"])
    m = tr.triage_status(tr.match_imported(c, *local(spark, sf)))
    d = tr.dependency_status(m, tr.dependency_evidence(dependency_claims(spark, sf), *dependencies(spark, sf)))
    return tr.triage_backlog(d, F.lit(True))


@query("triage_backlog", f"with {BACKLOG_SQL} select id, verdict, confidence, case verdict when 'confirmed' then 'fix_finding' when 'needs_review' then 'validation' else 'close' end as next_step from sc")
def triage_backlog(spark, sf):
    return backlog(spark, sf).select("id", "verdict", "confidence", "next_step")


@query("stack_rank", f"""with {BACKLOG_SQL}
select id, verdict, score, case when verdict <> 'not_actionable' then row_number() over (partition by verdict order by score desc, id) end as rank from sc""")
def stack_rank(spark, sf):
    return tr.stack_rank(tr.scored(backlog(spark, sf)).select("id", "verdict", "queue", "score")).select("id", "verdict", "score", "rank")


# ---- intake ---------------------------------------------------------------------------------------------
@query("sarif_findings", """
with d as (select doc_id, lang, source, text from documents)
select 'doc' || doc_id as source_path, 'rule-' || lang as rule_id, case when lang in ('en', 'fr') then 'Rule ' || lang when lang = 'de' then 'rule-de' else 'rule-es' end as title, case when lang = 'en' then 'CWE-79' when lang = 'fr' then 'cwe-89' end as cwe,
  'src/' || source || '.py' as file, cast(length(text) as int) as line, case when text <> '' then sha256(text) end as text_sha from d""")
def sarif_findings(spark, sf):
    """One SARIF log per document: a rule table for two languages, one result with the text as message."""
    d = v.table(spark, sf, "documents")
    rule = lambda lang, tag: F.struct(F.lit(f"rule-{lang}").alias("id"), F.struct(F.lit(f"Rule {lang}").alias("text")).alias("shortDescription"), F.struct(F.array(F.lit("x"), F.lit(tag)).alias("tags")).alias("properties"))
    spot = F.struct(F.struct(F.struct(F.concat(F.lit("src/"), "source", F.lit(".py")).alias("uri")).alias("artifactLocation"), F.struct(F.length("text").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.concat(F.lit("rule-"), "lang").alias("ruleId"), F.struct(F.concat(F.lit("M"), "text").alias("text")).alias("message"), F.array(spot).alias("locations"))
    run = F.struct(F.struct(F.struct(F.array(rule("en", "CWE-79"), rule("fr", "cwe-89")).alias("rules")).alias("driver")).alias("tool"), F.array(result).alias("results"))
    docs = d.select(F.concat(F.lit("doc"), "doc_id").alias("source_path"), F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("content"))
    f = intake.sarif_findings(docs)
    return f.select("source_path", "rule_id", "title", "cwe", F.col("locations")[0].file.alias("file"), F.col("locations")[0].line.alias("line"),
                    F.when(F.length("description") > 1, tx.sha256(tx.rest(F.col("description"), 2))).alias("text_sha"))


@query("generic_findings", """
with d as (select event_id, event_type, value, '{"id":' || event_id || ',"name":" N ' || event_type || '","package":"p' || user_id || '","vulnerable_version_range":"<' || cast(floor(value) as int) || '","sourceType":"' || case when event_type = 'view' then 'advisory' else 'odd' end
   || '","locations":[{"path":"a.py","line":3},{"line":4}]}' as content, user_id from events)
select 'imp_' || left(sha256(sha256(content) || ':0:N ' || event_type), 24) as id, '' || event_id as input_id, 'N ' || event_type as title, 'p' || user_id as component, '<' || cast(floor(value) as int) as affected_version,
  case when event_type = 'view' then 'advisory' else 'generic' end as source_type, 1 as n_locations from d""")
def generic_findings(spark, sf):
    e = v.table(spark, sf, "events")
    content = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"name":" N '), "event_type", F.lit('","package":"p'), F.col("user_id").cast("string"), F.lit('","vulnerable_version_range":"<'),
                       F.floor("value").cast("int").cast("string"), F.lit('","sourceType":"'), F.when(F.col("event_type") == "view", "advisory").otherwise("odd"), F.lit('","locations":[{"path":"a.py","line":3},{"line":4}]}'))
    docs = e.select(F.concat(F.lit("e"), "event_id").alias("source_path"), content.alias("content"))
    return intake.read_findings(docs).select("id", "input_id", "title", "component", "affected_version", "source_type", F.size("locations").alias("n_locations"))


@query("text_findings", """
select 'imp_' || left(sha256(sha256(text) || ':0:' || doc_id || '.txt'), 24) as id, doc_id || '.txt' as title, 'text' as source_type from documents
where not (json_valid(text) and text <> '')""")
def text_findings(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.concat(F.lit("in/"), "doc_id", F.lit(".txt")).alias("source_path"), F.col("text").alias("content"))
    return intake.read_findings(docs).select("id", "title", "source_type")


@query("alert_intake", """
with a as (select o_orderkey, o_custkey, o_orderpriority from orders), l as (select l_orderkey, count(distinct (l_suppkey, l_linenumber)) as n from lineitem group by all)
select 'gh_' || left(sha256('own/r' || o_custkey || ':code_scanning:' || o_orderkey), 24) as id, 'own/r' || o_custkey || ':code_scanning:' || o_orderkey as input_id, 'Rule ' || o_orderpriority as title, 'open' as state, coalesce(n, 0) as n_locations
from a left join l on l_orderkey = o_orderkey""")
def alert_intake(spark, sf):
    o, li = v.table(spark, sf, "orders"), v.table(spark, sf, "lineitem")
    raw = o.select(F.concat(F.lit("own/r"), "o_custkey").alias("repository"), F.lit(0).alias("pos"), F.to_json(F.struct(
        F.col("o_orderkey").alias("number"), F.struct(F.concat(F.lit("Rule "), "o_orderpriority").alias("description"), F.lit("r1").alias("id")).alias("rule"), F.lit("open").alias("state"))).alias("alert"))
    own = o.select("o_orderkey", "o_custkey")
    inst = li.join(own, li.l_orderkey == own.o_orderkey).select(F.concat(F.lit("own/r"), "o_custkey").alias("repository"), F.col("l_orderkey").cast("string").alias("number"), F.to_json(F.struct(
        F.struct(F.concat(F.lit("s"), "l_suppkey").alias("path"), F.col("l_linenumber").alias("start_line")).alias("location"))).alias("instance"))
    return intake.normalize_alerts(raw, inst, "code_scanning").select("id", "input_id", "title", "state", F.size("locations").alias("n_locations"))


@query("dependency_alert_intake", """
select 'gh_' || left(sha256('own/r:dependabot:' || event_id), 24) as id, 'Advisory ' || event_type as title, case when value >= 10 then 'CVE-2024-' || event_id end as cwe, case when value >= 10 then 'cve' else 'advisory' end as source_type,
 'pkg' || user_id as component, '< ' || cast(floor(value) as int) as affected_version from events""")
def dependency_alert_intake(spark, sf):
    e = v.table(spark, sf, "events")
    raw = e.select(F.lit("own/r").alias("repository"), F.lit(0).alias("pos"), F.to_json(F.struct(
        F.col("event_id").alias("number"), F.struct(F.concat(F.lit("Advisory "), "event_type").alias("summary"), F.when(F.col("value") >= 10, F.concat(F.lit("CVE-2024-"), "event_id")).alias("cve_id")).alias("security_advisory"),
        F.struct(F.struct(F.concat(F.lit("pkg"), "user_id").alias("name")).alias("package"), F.concat(F.lit("< "), F.floor("value").cast("int")).alias("vulnerable_version_range")).alias("security_vulnerability"))).alias("alert"))
    none = raw.select("repository", F.lit("").alias("number"), F.lit("{}").alias("instance")).filter(F.lit(False))
    return intake.normalize_alerts(raw, none, "dependabot").select("id", "title", "cwe", "source_type", "component", "affected_version")


@query("ticket_intake", """
select 'jira_' || left(sha256('https://t.example:SEC-' || o_orderkey), 24) as id, 'jira:SEC-' || o_orderkey as input_id, 'Ticket ' || o_orderpriority as title, o_orderpriority as severity, 'https://t.example/browse/SEC-' || o_orderkey as reference from orders
union all select 'linear_' || left(sha256('https://l.example:L-' || c_custkey), 24), 'linear:L-' || c_custkey, c_name, c_mktsegment, 'https://l.example' from customer""")
def ticket_intake(spark, sf):
    o, c = v.table(spark, sf, "orders"), v.table(spark, sf, "customer")
    jira = o.select(F.lit("https://t.example/").alias("endpoint"), F.to_json(F.struct(F.concat(F.lit("SEC-"), "o_orderkey").alias("key"), F.struct(
        F.concat(F.lit("Ticket "), "o_orderpriority").alias("summary"), F.lit("text").alias("description"), F.struct(F.col("o_orderpriority").alias("name")).alias("priority")).alias("fields"))).alias("ticket"))
    linear = c.select(F.lit("https://l.example").alias("endpoint"), F.to_json(F.struct(F.concat(F.lit("L-"), "c_custkey").alias("identifier"), F.col("c_name").alias("title"),
                                                                                       F.struct(F.col("c_mktsegment").alias("name")).alias("priorityLabel"))).alias("ticket"))
    cols = ["id", "input_id", "title", "severity", "reference"]
    return intake.normalize_tickets(jira, "jira").select(*cols).unionByName(intake.normalize_tickets(linear, "linear").select(*cols))


# ---- manifests ----------------------------------------------------------------------------------------------
PKG_SQL = f"""li as (select l_orderkey as k, 'c' || l_partkey as component, {VER_SQL} as ver, case l_returnflag when 'A' then 1 when 'R' then 4 else 5 end as sec, l_linestatus from lineitem),
one as (select k, component, sec, min(case when l_linestatus = 'O' then ver else 'workspace:*' end) as ver from li group by all),
dep as (select 'repo' as scan_id, 'app/o' || k || '/package.json' as file, component, arg_min(case when ver <> 'workspace:*' then ver end, case when ver <> 'workspace:*' then sec end) as version, case min(sec) when 1 then 'runtime' when 4 then 'development' else 'unknown' end as scope from one group by k, component)"""


def package_files(spark, sf):
    li = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("c"), "l_partkey").alias("component"), _ver().alias("ver"),
                                               F.when(F.col("l_returnflag") == "A", "dependencies").when(F.col("l_returnflag") == "R", "devDependencies").otherwise("peerDependencies").alias("sec"), "l_linestatus")
    one = li.groupBy("k", "component", "sec").agg(F.min(F.when(F.col("l_linestatus") == "O", F.col("ver")).otherwise("workspace:*")).alias("ver"))
    maps = one.groupBy("k").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("sec") == s, F.struct("component", "ver")))).alias(s) for s in ("dependencies", "devDependencies", "peerDependencies")])
    return maps.select(F.lit("repo").alias("scan_id"), F.concat(F.lit("app/o"), "k", F.lit("/package.json")).alias("path"), F.to_json(F.struct("dependencies", "devDependencies", "peerDependencies")).alias("content"))


@query("manifest_dependencies", f"with {PKG_SQL} select * from dep")
def manifest_dependencies(spark, sf):
    return manifests.manifest_dependencies(package_files(spark, sf))


@query("lock_dependencies", f"""
with {PKG_SQL}, lk as (select 'repo' as scan_id, 'app/o' || l_orderkey as dir, 'c' || l_partkey as component, min({VER_SQL}) as version, bool_or(l_discount >= 0.08) as dev from lineitem group by all)
select lk.scan_id, lk.dir || '/package-lock.json' as file, lk.component, lk.version, case when dev then 'development' else coalesce(dep.scope, 'unknown') end as scope
from lk left join (select * from dep where scope <> 'unknown') dep on dep.file = lk.dir || '/package.json' and dep.component = lk.component""")
def lock_dependencies(spark, sf):
    li = v.table(spark, sf, "lineitem")
    e = li.groupBy("l_orderkey", "l_partkey").agg(F.min(_ver()).alias("version"), F.bool_or(F.col("l_discount") >= 0.08).alias("dev"))
    packages = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("node_modules/c"), "l_partkey"), F.struct("version", "dev"))))
    locks = e.groupBy("l_orderkey").agg(packages.alias("packages")).select(
        F.lit("repo").alias("scan_id"), F.concat(F.lit("app/o"), "l_orderkey", F.lit("/package-lock.json")).alias("path"), F.to_json(F.struct("packages")).alias("content"))
    declared = manifests.manifest_dependencies(package_files(spark, sf)).filter("scope <> 'unknown'")
    return manifests.lock_dependencies(locks, declared)


@query("product_surfaces", """
select case when contains(source, '1') then 'docs/' else 'app/' end || source as dir, case when contains(source, '1') then 'test/example/documentation' else 'repository runtime surface requires local confirmation' end as product_surface, count(*) as n from documents group by all""")
def product_surfaces(spark, sf):
    d = v.table(spark, sf, "documents").select(F.concat(F.when(F.contains("source", F.lit("1")), "docs/").otherwise("app/"), F.col("source")).alias("dir"))
    d = d.withColumn("locations", F.array(F.struct(F.concat("dir", F.lit("/x.py")).alias("file"), F.lit(1).alias("line"))))
    return cl.product_surface(d).groupBy("dir", "product_surface").agg(F.count("*").alias("n"))

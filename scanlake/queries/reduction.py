"""Observation reduction, identities, review rounds; line items stand for raw observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import patterns as pt, reduce as rd
from ..plans import views as v
from .registry import query

RULE = "case when l_returnflag = 'R' then 'tls-verification-disabled' when l_returnflag = 'A' then 'ssrf-request-sink' else 'path-traversal-sink' end"
CANDIDATES_SQL = f"""candidates as (
  select 'repo' as scan_id, {RULE} as rule, 'src/p' || l_partkey || '.py' as file, l_linenumber as line,
         'call ' || cast(floor(l_quantity / 10) as int) as excerpt,
         case when l_quantity >= 40 then 'high' when l_quantity >= 20 then 'medium' else 'low' end as severity,
         l_orderkey * 100 + cast(l_quantity as int) as ord, 'supplier ' || l_suppkey as detail,
         case when l_linestatus = 'O' then 'sink' else 'root_control' end as role, l_tax >= 0.04 as ctx
  from lineitem)"""


def candidates(spark, sf):
    li = v.table(spark, sf, "lineitem")
    c = li.selectExpr(
        "'repo' as scan_id", f"{RULE} as rule", "concat('src/p', l_partkey, '.py') as file", "l_linenumber as line",
        "concat('call ', cast(floor(l_quantity / 10) as int)) as excerpt",
        "case when l_quantity >= 40 then 'high' when l_quantity >= 20 then 'medium' else 'low' end as severity",
        "l_orderkey * 100 + cast(l_quantity as int) as ord", "concat('supplier ', l_suppkey) as detail",
        "case when l_linestatus = 'O' then 'sink' else 'root_control' end as role", "l_tax >= 0.04 as ctx")
    place = F.struct("file", "line", "excerpt", "role")
    own = pt.evidence("pattern", F.col("detail"), place)
    more = F.when(F.col("ctx"), F.concat(F.array(own), F.array(pt.evidence("context", F.lit("taxed"))))).otherwise(F.array(own))
    return c.select("scan_id", "rule", "severity", "file", "line", "excerpt", F.lit("why").alias("rationale"), F.lit("CWE-1").alias("cwe"),
                    more.alias("evidence"), "ord")


EVIDENCE_SQL = CANDIDATES_SQL + """,
ev as (select rule, file, line, excerpt, ord, 0 as pos, 'pattern' as kind, detail, role from candidates
       union all select rule, file, line, excerpt, ord, 1, 'context', 'taxed', '' from candidates where ctx),
uniq as (select rule, file, line, excerpt, kind, detail, role, min(ord * 10 + pos) as seen from ev group by all),
notes as (select rule, file, line, excerpt, count(*) as n_evidence, string_agg(detail, '|' order by seen) as details,
                 bool_or(kind = 'context') as in_context, bool_or(role = 'sink') as has_sink from uniq group by all),
firsts as (select rule, file, line, excerpt, arg_min(severity, ord) as severity, min(ord) as ord from candidates group by all),
observations as (select f.*, n.n_evidence, n.details, n.in_context, n.has_sink from firsts f join notes n using (rule, file, line, excerpt))"""


@query("dedupe_observations", f"with {EVIDENCE_SQL} select rule, file, line, excerpt, severity, n_evidence, details from observations")
def dedupe_observations(spark, sf):
    return rd.dedupe_observations(candidates(spark, sf)).select(
        "rule", "file", "line", "excerpt", "severity", F.size("evidence").alias("n_evidence"),
        F.array_join(F.transform("evidence", lambda e: e.detail), "|").alias("details"))


@query("candidate_findings", f"""
with {EVIDENCE_SQL}
select 'cand_' || left(sha256('repo:' || rule || ':' || file || ':' || line), 32) as candidate_id, replace(rule, '-', '.') as rule_id,
       replace(rule, '-', ' ') as title, case when rule = 'tls-verification-disabled' and in_context then 'medium' else 'low' end as confidence,
       excerpt, case when has_sink then 2 else 1 end as n_locations from observations""")
def candidate_findings(spark, sf):
    f = rd.to_findings(rd.dedupe_observations(candidates(spark, sf)))
    return f.select("candidate_id", "rule_id", "title", "confidence", "excerpt", F.size("locations").alias("n_locations"))


@query("reduced_findings", f"""
with {EVIDENCE_SQL}
select replace(rule, '-', '.') as rule_id, file, line, arg_min(severity, ord) as severity, arg_min(excerpt, ord) as excerpt,
       sum(n_evidence) as n_evidence, case when bool_or(has_sink) then 2 else 1 end as n_locations
from observations group by rule, file, line""")
def reduced_findings(spark, sf):
    f = rd.reduce_candidates(rd.to_findings(rd.dedupe_observations(candidates(spark, sf))))
    return f.select("rule_id", "file", "line", "severity", "excerpt", F.size("evidence").alias("n_evidence"), F.size("locations").alias("n_locations"))


@query("finding_identities", f"""
with {CANDIDATES_SQL},
f as (select replace(rule, '-', '.') as rule_id, file, line, arg_min(excerpt, ord) as excerpt from candidates group by rule, file, line),
b as (select *, left(regexp_replace(lower(rule_id || ':' || excerpt), '[^a-z0-9]+', '-', 'g'), 180) as anchor,
             rule_id || ' ' || excerpt || ' why pattern:' || excerpt || ':seen' as base from f),
n as (select *, row_number() over (partition by rule_id, anchor, base order by file, line) as rn from b),
k as (select *, row_number() over (partition by rule_id, anchor, base, file, rn = 1 order by line) as in_file from n),
s as (select *, 'source-' || left(sha256(base || ':' || file), 20) as by_file from k),
i as (select *, case when rn = 1 then 'instance-' || left(sha256(base), 20) when in_file = 1 then by_file
              else 'source-' || left(sha256(base || ':' || file || ':' || line || ':' || by_file), 20) end as instance from s)
select rule_id, file, line, anchor, instance, sha256('target:' || rule_id || ':' || anchor || ':' || instance) as fingerprint,
       'slf_' || left(sha256('target:' || rule_id || ':' || anchor || ':' || instance), 24) as id from i""")
def finding_identities(spark, sf):
    c = candidates(spark, sf).groupBy("scan_id", "rule", "file", "line").agg(F.min_by("excerpt", "ord").alias("excerpt"))
    place = F.struct("file", "line", "excerpt", F.lit("root_control").alias("role"))
    f = c.select("scan_id", F.replace("rule", F.lit("-"), F.lit(".")).alias("rule_id"), "file", "line", "excerpt", F.lit("why").alias("root_cause"),
                 F.array(place).alias("locations"), F.array(pt.evidence("pattern", F.concat(F.lit("seen src/a.py:"), F.lit("12")), place)).alias("evidence"))
    return rd.assign_identities(f, "target").select("rule_id", "file", "line", "anchor", "instance", "fingerprint", "id")


@query("distinct_locations", """
select l_orderkey as record, count(distinct (l_partkey, l_linenumber, l_returnflag)) as n_locations, sum(l_linenumber) as check_sum
from lineitem group by l_orderkey""")
def distinct_locations(spark, sf):
    li = v.table(spark, sf, "lineitem")
    # an order holds a handful of line items; the array is one record's location list
    g = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("l_partkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), F.lit("x").alias("excerpt"), F.col("l_returnflag").alias("role"))).alias("locs"),
        F.sum("l_linenumber").alias("check_sum"))
    return g.select(F.col("l_orderkey").alias("record"), F.size(rd.dedupe_locations(F.col("locs"))).alias("n_locations"), "check_sum")


@query("combined_candidates", """
with c as (select '{"cwe_ids":["CWE-' || cast(l_quantity as int) || '"],"instance":' || case when l_returnflag = 'N' then 'null' else '"' || l_returnflag || '"' end
                  || ',"locations":[{"path":"p' || l_partkey || '","start_line":' || l_linenumber || '}]}' as identity,
                  'status ' || l_linestatus as summary, 'supplier ' || l_suppkey as evidence from lineitem)
select identity, 'candidate-' || left(sha256(identity), 16) as candidate_id, string_agg(distinct summary, chr(10) order by summary) as summary,
       string_agg(distinct evidence, chr(10) order by evidence) as evidence from c group by identity""")
def combined_candidates(spark, sf):
    li = v.table(spark, sf, "lineitem")
    c = li.select(F.array(F.concat(F.lit("CWE-"), F.col("l_quantity").cast("int").cast("string"))).alias("cwe_ids"),
                  F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("instance"),
                  F.array(F.struct(F.concat(F.lit("p"), "l_partkey").alias("path"), F.col("l_linenumber").alias("start_line"))).alias("locations"),
                  F.concat(F.lit("status "), "l_linestatus").alias("summary"), F.concat(F.lit("supplier "), "l_suppkey").alias("evidence"), F.lit("").alias("context"))
    return rd.combine_candidates(c).select("identity", "candidate_id", "summary", "evidence")


REPORTS_SQL = """reports as (
  select event_type as rule_id, 'u' || user_id as file, cast(floor(value) as int) + 1 as line, 'body  of ' || event_type as excerpt,
         'w' || cast(floor(cast(json_extract_string(props, '$.k') as int) / 10) as int) as worker_id, event_id as seq from events),
fp as (select *, sha256(rule_id || ':' || file || ':' || line || ':body of ' || rule_id || ':root-control:missing check') as fingerprint from reports)"""


def worker_reports(spark, sf):
    e = v.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("rule_id"), F.concat(F.lit("u"), "user_id").alias("file"), (F.floor("value").cast("int") + 1).alias("line"),
                    F.concat(F.lit("body  of "), "event_type").alias("excerpt"),
                    F.concat(F.lit("w"), F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int")).alias("worker_id"),
                    F.col("event_id").alias("seq"), F.lit("").alias("remediation_identity"), F.lit("Missing  check").alias("root_cause"))


@query("merged_reports", f"""
with {REPORTS_SQL}
select fingerprint, arg_min('deepcand_' || left(sha256('deep:' || worker_id || ':' || fingerprint), 24), seq) as candidate_id,
       string_agg(distinct worker_id, ',' order by worker_id) as workers, count(distinct worker_id) as n_reports,
       case when count(distinct worker_id) > 1 then 'merged_equivalent_reports' else 'not_merged' end as decision
from fp group by fingerprint""")
def merged_reports(spark, sf):
    m = rd.merge_reports(worker_reports(spark, sf))
    return m.select("fingerprint", "candidate_id", F.array_join("worker_ids", ",").alias("workers"), F.size("report_ids").alias("n_reports"), "decision")


# Suppliers merge into the supplier of the same nation with the lowest key, as a reducer would say.
@query("applied_merges", """
with m as (select s_suppkey as id, min(s_suppkey) over (partition by s_nationkey) as target from supplier),
r as (select distinct m.target as id, l_partkey as worker_id, l_orderkey as report_id from lineitem join m on m.id = l_suppkey),
n as (select id, count(distinct worker_id) as n_workers, count(distinct report_id) as n_reports from r group by id)
select m.id, case when m.target <> m.id then m.target end as absorbed_by, n.n_workers, n.n_reports from m left join n on n.id = m.id""")
def applied_merges(spark, sf):
    s = v.table(spark, sf, "supplier")
    heads = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("target_id"))
    merges = s.join(heads, "s_nationkey").filter("s_suppkey <> target_id").select("target_id", F.col("s_suppkey").alias("absorbed_id"), F.lit("same nation").alias("rationale"))
    members = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("worker_id"), F.col("l_orderkey").alias("report_id"))
    return rd.apply_merges(s.select(F.col("s_suppkey").alias("id")), members, merges).select("id", "absorbed_by", "n_workers", "n_reports")


# A merge list with every kind of fault: unknown ids, self merges, double absorption, absorbed targets.
@query("refused_merges", """
with m as (select o_custkey as target_id, o_orderkey as absorbed_id, o_orderstatus as rationale from orders),
c as (select c_custkey as id from customer),
t as (select absorbed_id, count(*) as times from m group by all)
select m.target_id, m.absorbed_id, case when a.id is null then 'unknown target' when b.id is null then 'unknown source'
  when m.target_id = m.absorbed_id then 'self merge' when t.times > 1 then 'already absorbed'
  when exists (select 1 from m x where x.absorbed_id = m.target_id) then 'target is absorbed' end as error
from m left join c a on a.id = m.target_id left join c b on b.id = m.absorbed_id join t on t.absorbed_id = m.absorbed_id
where a.id is null or b.id is null or m.target_id = m.absorbed_id or t.times > 1 or exists (select 1 from m x where x.absorbed_id = m.target_id)""")
def refused_merges(spark, sf):
    merges = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("absorbed_id"), F.col("o_orderstatus").alias("rationale"))
    return rd.merge_errors(v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), merges)


ROUNDS_SQL = """sightings as (select 'j' || user_id % 3 as job_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as int) + 1 as round, user_id || ':' || event_type as fingerprint, day(ts) in (5, 10, 15, 20) and event_type = 'error' as failed from events),
rounds as (select job_id, round, case when not bool_or(failed) then 'complete' else 'incomplete' end as status, count(*) as n_workers from sightings group by job_id, round),
fresh as (select job_id, round, count(*) as novelty from (select job_id, fingerprint, min(round) as round from sightings semi join (select * from rounds where status = 'complete') r using (job_id, round) group by all) group by all)"""


def sightings(spark, sf):
    return v.table(spark, sf, "events").select(F.concat(F.lit("j"), F.col("user_id") % 3).alias("job_id"), (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).alias("round"),
                                               F.concat_ws(":", "user_id", "event_type").alias("fingerprint"),
                                               (F.dayofmonth("ts").isin(5, 10, 15, 20) & (F.col("event_type") == "error")).alias("failed"))


def rounds(spark, sf):
    w = sightings(spark, sf).select("job_id", "round", F.when(F.col("failed"), "failed").otherwise("completed").alias("status"), F.lit(True).alias("has_report"))
    return rd.round_status(w)


@query("round_status", f"with {ROUNDS_SQL} select job_id, round, n_workers, status from rounds")
def round_status(spark, sf):
    return rounds(spark, sf)


@query("round_saturation", f"""
with {ROUNDS_SQL}, r as (select job_id, round, status, coalesce(novelty, 0) as novelty from rounds left join fresh using (job_id, round)),
g as (select *, sum(case when status = 'complete' and novelty > 0 then 1 else 0 end) over (partition by job_id order by round) as island,
             sum(case when status = 'complete' then 1 else 0 end) over (partition by job_id order by round) as done from r),
s as (select *, sum(case when status = 'complete' and novelty = 0 then 1 else 0 end) over (partition by job_id, island order by round) as streak from g)
select job_id, round, status, novelty, streak, (select count(distinct fingerprint) from sightings x where x.round = s.round and x.job_id = s.job_id) as candidates,
  case when status <> 'complete' then 'incomplete' when novelty = 0 and streak >= 3 then 'saturated' when done >= 10 then 'capped' else 'running' end as state
from s""")
def round_saturation(spark, sf):
    r = rounds(spark, sf).select("job_id", "round", "status")
    return rd.round_saturation(sightings(spark, sf).select("job_id", "round", "fingerprint"), r, stop_after=3, max_rounds=10)


@query("canonical_candidates", f"""
with {ROUNDS_SQL}
select distinct job_id, fingerprint as id from sightings semi join (select * from rounds where status = 'complete') r using (job_id, round) where fingerprint not like '%:error'""")
def canonical_candidates(spark, sf):
    s = sightings(spark, sf).select("job_id", F.col("fingerprint").alias("id"), "round")
    c = s.select("job_id", "id").distinct().withColumn("absorbed_by", F.when(F.col("id").endswith(":error"), "x"))
    return rd.canonical_candidates(c, s, rounds(spark, sf)).select("job_id", "id")


@query("appended_candidates", """
with f as (select distinct sha256(event_type || user_id) as fingerprint from events where event_type in ('view', 'click')),
r as (select distinct event_type as rule_id, 'u' || user_id as file, sha256(event_type || user_id) as fingerprint from events)
select r.fingerprint, 'cand_' || left(sha256('scan_1:' || rule_id || ':' || file || ':1'), 32) as candidate_id,
       'task_' || left(sha256('scan_1:cand_' || left(sha256('scan_1:' || rule_id || ':' || file || ':1'), 32) || ':validation'), 24) as task_id
from r where fingerprint not in (select fingerprint from f)""")
def appended_candidates(spark, sf):
    e = v.table(spark, sf, "events")
    fp = tx.sha256(F.concat("event_type", F.col("user_id").cast("string")))
    seen = e.select(F.when(F.col("event_type").isin("view", "click"), fp).otherwise(F.concat(F.lit("gone "), fp)).alias("fingerprint")).distinct()
    reported = e.select(F.col("event_type").alias("rule_id"), F.concat(F.lit("u"), "user_id").alias("file"), F.lit(1).alias("line"), F.lit("t").alias("title"), fp.alias("fingerprint"))
    fresh, _ledger, tasks = rd.append_candidates(seen, reported, "scan_1")
    return fresh.join(tasks.select("candidate_id", F.col("id").alias("task_id")), "candidate_id").select("fingerprint", "candidate_id", "task_id")

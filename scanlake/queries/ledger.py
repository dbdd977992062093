"""Ledger folds and workflow state; events stand for log rows, a user for a scan, and days for
candidates, whose names are the same in many scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as lg
from ..plans import views as v
from ..scale import last_known, lagged, ranked
from .registry import query

PHASE = "case event_type when 'signup' then 'discovery' when 'view' then 'validation' when 'click' then 'attack_path' when 'purchase' then 'finalization' else 'other' end"
LOG_SQL = f"log as (select event_id, user_id % 5 || ':' || cast(cast(ts as date) as varchar) as candidate_id, 'u' || user_id as scan_id, {PHASE} as phase, ts as recorded_at, event_id as seq, value, event_type from events)"


def log(spark, sf):
    return v.table(spark, sf, "events").selectExpr(
        "event_id", "concat(user_id % 5, ':', cast(cast(ts as date) as string)) as candidate_id", "concat('u', user_id) as scan_id", f"{PHASE} as phase",
        "ts as recorded_at", "event_id as seq", "value", "event_type")


TASKS_SQL = f"""{LOG_SQL}, tasks as (select 'task_' || event_id as id, event_id as ord, candidate_id, scan_id, phase, recorded_at,
  case when value < 2 then 'completed' when value < 8 then 'claimed' when value < 10 then 'cancelled' else 'pending' end as status,
  case when value >= 2 and value < 8 then recorded_at + interval 30 minute end as expires_at from log)"""


def tasks(spark, sf):
    return log(spark, sf).selectExpr(
        "concat('task_', event_id) as id", "event_id as ord", "candidate_id", "scan_id", "phase", "recorded_at",
        "case when value < 2 then 'completed' when value < 8 then 'claimed' when value < 10 then 'cancelled' else 'pending' end as status",
        "case when value >= 2 and value < 8 then recorded_at + interval 30 minutes end as expires_at")


NOW = "2024-01-15 12:00:00"


@query("claimable_tasks", f"""
with {TASKS_SQL}
select phase, 'task_' || min(ord) as id, count(*) as n_pending from tasks
where status = 'pending' or (status = 'claimed' and expires_at <= timestamp '{NOW}') group by phase""")
def claimable_tasks(spark, sf):
    return lg.claimable(tasks(spark, sf), F.lit(NOW).cast("timestamp_ntz"))


@query("released_claims", f"""
with {TASKS_SQL}
select id, case when status = 'claimed' and expires_at <= timestamp '{NOW}' then 'pending' else status end as status,
       coalesce(status = 'claimed' and expires_at <= timestamp '{NOW}', false) as released from tasks""")
def released_claims(spark, sf):
    return lg.release_expired(tasks(spark, sf), F.lit(NOW).cast("timestamp_ntz")).select("id", "status", "released")


@query("claim_expiry", f"""
select event_id, epoch_us(timestamp '{NOW}') - epoch_us(ts) > 120 * 1000000 as claim_expired, greatest(60, least(cast(floor(value * 1000) as bigint), 14400)) as lease from events""")
def claim_expiry(spark, sf):
    e = v.table(spark, sf, "events")
    return e.select("event_id", lg.claim_expired(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp")).alias("claim_expired"),
                    lg.lease_seconds(F.floor(F.col("value") * 1000)).alias("lease"))


CANDS_SQL = "cands as (select scan_id, candidate_id, case when max(value) >= 20 then 'reportable' else 'deferred' end as disposition from log group by scan_id, candidate_id)"


def cands(spark, sf):
    return log(spark, sf).groupBy("scan_id", "candidate_id").agg(
        F.when(F.max("value") >= 20, "reportable").otherwise("deferred").alias("disposition"))


@query("pending_candidates", f"""
with {LOG_SQL}, {CANDS_SQL}
select scan_id, candidate_id, count(*) as n_rows, string_agg(distinct phase, ',' order by phase) as stages
from cands c join log l using (scan_id, candidate_id) group by scan_id, candidate_id having not bool_or(phase = 'validation')""")
def pending_candidates(spark, sf):
    return lg.pending(cands(spark, sf).select("scan_id", "candidate_id"), log(spark, sf))


@query("finalize_check", f"""
with {TASKS_SQL}, {CANDS_SQL},
s as (select scan_id, candidate_id, bool_or(phase = 'validation') as v, bool_or(phase = 'attack_path') as a from log group by all),
m as (select scan_id, sum(case when not v or (disposition = 'reportable' and not a) then 1 else 0 end) as missing from cands join s using (scan_id, candidate_id) group by scan_id),
o as (select scan_id, sum(case when status in ('pending', 'claimed') then 1 else 0 end) as open_tasks from tasks group by scan_id),
sc as (select scan_id, min(value) < 1 as complete from log group by scan_id)
select scan_id, missing, open_tasks, case when missing > 0 or open_tasks > 0 then 'blocked' when complete then 'completed' else 'incomplete' end as lifecycle
from sc join m using (scan_id) join o using (scan_id)""")
def finalize_check(spark, sf):
    scans = log(spark, sf).groupBy("scan_id").agg((F.min("value") < 1).alias("complete"))
    return lg.finalize_check(scans, cands(spark, sf), log(spark, sf), tasks(spark, sf))


ROLE = "case role when 'user' then 'entrypoint' when 'assistant' then 'sink' else 'root_control' end"
REFS_SQL = f"""refs as (select conv_id as record_id, conv_id as candidate_id, case when length(text) < 20 then ' ' else 'c' || conv_id end as file, cast(turn as int) as line, {ROLE} as role from conversations),
locs as (select conv_id as candidate_id, 'c' || conv_id as file, cast(turn as int) as line, {ROLE} as role from conversations where length(text) < 400),
recs as (select conv_id as record_id, conv_id as candidate_id, case when max(turn) >= 3 then 'attack_path' else 'validation' end as kind, 'reportable' as conclusion from conversations group by conv_id)"""


@query("reference_errors", f"""
with {REFS_SQL},
good as (select * from refs where trim(file) <> '' and line >= 1),
cited as (select record_id, bool_or(role = 'entrypoint') as ce, bool_or(role = 'sink') as cs, bool_or(role in ('root_control', 'sink')) as cr from good group by all),
held as (select candidate_id, bool_or(role = 'entrypoint') as he, bool_or(role = 'sink') as hs from locs group by all)
select distinct record_id, 'malformed reference' as error from refs where trim(file) = '' or line < 1
union select record_id, 'duplicate reference' from good group by record_id, candidate_id, file, line, role having count(*) > 1
union select record_id, 'not a retained location' from good anti join locs using (candidate_id, file, line, role)
union select record_id, 'root control or sink not cited' from recs left join cited using (record_id) where kind = 'validation' and not coalesce(cr, false)
union select r.record_id, 'both endpoints not cited' from recs r left join cited c on c.record_id = r.record_id join held h on h.candidate_id = r.candidate_id
  where kind = 'attack_path' and he and hs and (not coalesce(ce, false) or not coalesce(cs, false))""")
def reference_errors(spark, sf):
    c = v.table(spark, sf, "conversations")
    file = F.concat(F.lit("c"), "conv_id")
    base = [F.col("conv_id").alias("candidate_id"), F.col("turn").cast("int").alias("line"), F.expr(ROLE).alias("role")]
    refs = c.select(F.col("conv_id").alias("record_id"), *base, F.when(F.length("text") < 20, " ").otherwise(file).alias("file"))
    locs = c.select(*base[:2], F.when(F.length("text") < 400, F.expr(ROLE)).otherwise("not retained").alias("role"), file.alias("file"))
    recs = c.groupBy("conv_id").agg(F.max("turn").alias("t")).select(
        F.col("conv_id").alias("record_id"), F.col("conv_id").alias("candidate_id"),
        F.when(F.col("t") >= 3, "attack_path").otherwise("validation").alias("kind"), F.lit("reportable").alias("conclusion"))
    return lg.reference_errors(refs, locs, recs)


@query("runtime_receipt_errors", """
with recs as (select o_orderkey as record_id, o_custkey as candidate_id, case o_orderstatus when 'F' then 'runtime' when 'O' then 'hybrid' else 'static' end as method from orders),
refs as (select distinct l_orderkey as record_id, case when l_linenumber = 7 then '' else 'run/' || l_suppkey end as ref from lineitem),
evid as (select distinct o_custkey as candidate_id, 'run/' || l_suppkey as ref from lineitem join orders on l_orderkey = o_orderkey where l_returnflag <> 'R'),
n as (select record_id, bool_or(ref = '') as bad from refs group by all)
select record_id, case when bad then 'unbounded reference' when method = 'static' and bad is not null then 'not a runtime method' else 'runtime receipt required' end as error
from recs left join n using (record_id) where bad or (method = 'static' and bad is not null) or (method <> 'static' and bad is null)
union all
select distinct r.record_id, 'not retained runtime evidence' from refs r join recs c on c.record_id = r.record_id and c.method <> 'static'
anti join evid e on e.candidate_id = c.candidate_id and e.ref = r.ref""")
def runtime_receipt_errors(spark, sf):
    o, li = v.table(spark, sf, "orders"), v.table(spark, sf, "lineitem")
    recs = o.selectExpr("o_orderkey as record_id", "o_custkey as candidate_id", "case o_orderstatus when 'F' then 'runtime' when 'O' then 'hybrid' else 'static' end as method")
    refs = li.selectExpr("l_orderkey as record_id", "case when l_linenumber = 7 then '' else concat('run/', l_suppkey) end as ref")
    evid = li.join(o, li.l_orderkey == o.o_orderkey).selectExpr("o_custkey as candidate_id", "concat(case when l_returnflag = 'R' then 'gone/' else 'run/' end, l_suppkey) as artifact_ref").distinct()
    return lg.receipt_errors(recs, refs, evid)


@query("applied_validations", f"""
with {LOG_SQL}, {CANDS_SQL},
vals as (select scan_id, candidate_id, arg_max(case when value >= 15 then 'reportable' when value >= 5 then 'suppressed' else 'deferred' end, (recorded_at, seq)) as conclusion,
                arg_max(case when value < 10 then 'static' when value < 20 then 'test' else 'runtime' end, (recorded_at, seq)) as method,
                arg_max('seen ' || seq, (recorded_at, seq)) as direct from log where phase = 'validation' group by scan_id, candidate_id)
select scan_id, candidate_id, coalesce(conclusion, 'discovered') as disposition, case when conclusion is null then 'low' else 'medium' end as confidence,
  method || ' validation: ' || direct as validation, case when method = 'runtime' then 'runtime' when method = 'test' then 'test' when method is not null then 'validation' end as evidence_kind,
  case when conclusion = 'reportable' then 'attack_path' end as next_task, case when conclusion = 'reportable' then 'attack_path' else 'validation' end as lifecycle
from cands left join vals using (scan_id, candidate_id)""")
def applied_validations(spark, sf):
    vals = log(spark, sf).filter("phase = 'validation'").selectExpr(
        "scan_id", "candidate_id", "recorded_at", "seq", "case when value >= 15 then 'reportable' when value >= 5 then 'suppressed' else 'deferred' end as conclusion",
        "case when value < 10 then 'static' when value < 20 then 'test' else 'runtime' end as method", "'medium' as confidence", "concat('seen ', seq) as direct_evidence")
    f = cands(spark, sf).select("scan_id", "candidate_id", "disposition", F.lit("low").alias("confidence"))
    return lg.apply_validations(f, vals)


@query("applied_attack_paths", f"""
with {LOG_SQL}, {CANDS_SQL},
p as (select scan_id, candidate_id, count(*) as n_paths, arg_max('flow ' || seq, (recorded_at, seq)) as flow from log where phase = 'attack_path' group by all)
select scan_id, candidate_id, disposition, n_paths, case when disposition = 'reportable' then flow || chr(10) || chr(10) || 'Attacker: a' || chr(10) || 'Outcome: o' end as attack_path,
       case when disposition = 'reportable' then 'reporting' else 'refused' end as lifecycle from cands join p using (scan_id, candidate_id)""")
def applied_attack_paths(spark, sf):
    paths = log(spark, sf).filter("phase = 'attack_path'").selectExpr("scan_id", "candidate_id", "recorded_at", "seq", "concat('flow ', seq) as dataflow", "'a' as attacker", "'o' as outcome")
    return lg.apply_attack_paths(cands(spark, sf), paths)


@query("late_receipts", f"""
with {LOG_SQL}, done as (select scan_id, min(recorded_at) as completed_at from log where phase = 'finalization' group by all)
select event_id, scan_id from log join done using (scan_id) where recorded_at > completed_at""")
def late_receipts(spark, sf):
    done = log(spark, sf).filter("phase = 'finalization'").groupBy("scan_id").agg(F.min("recorded_at").alias("completed_at"))
    return lg.late_receipts(log(spark, sf), done).select("event_id", "scan_id")


DECISIONS = """user_id as finding_id, ts as recorded_at, event_id as seq, case when event_type in ('error', 'click', 'view') then 'closed' else 'open' end as status,
case event_type when 'error' then 'wont_fix' when 'click' then 'already_fixed' when 'view' then 'false_positive' end as close_reason, case when value >= 20 then ' kept ' else ' ' end as note"""


def decisions(spark, sf):
    return v.table(spark, sf, "events").selectExpr(
        "user_id as finding_id", "ts as recorded_at", "event_id as seq", "case when event_type in ('error', 'click', 'view') then 'closed' else 'open' end as status",
        "case event_type when 'error' then 'wont_fix' when 'click' then 'already_fixed' when 'view' then 'false_positive' end as close_reason",
        "case when value >= 20 then ' kept ' else ' ' end as note")


FOLD_SQL = f"""d as (select {DECISIONS} from events), n as (select *, nullif(trim(note), '') as t from d),
l as (select *, row_number() over w as rn, lag(status) over w as ps, lag(close_reason) over w as pr, lag(t) over w as pn from n window w as (partition by finding_id order by recorded_at, seq)),
kept as (select * from l where rn = 1 or ps is distinct from status or pr is distinct from close_reason or pn is distinct from t)"""


@query("triage_log", f"with {FOLD_SQL} select finding_id, seq, status, close_reason, t as note from kept")
def triage_log(spark, sf):
    return lg.fold_triage(decisions(spark, sf))[0].select("finding_id", "seq", "status", "close_reason", "note")


@query("triage_state", f"""
with {FOLD_SQL}, s as (select finding_id, arg_max(status, (recorded_at, seq)) as st, arg_max(coalesce(close_reason, '-'), (recorded_at, seq)) as cr, count(*) as n_decisions from kept group by finding_id)
select finding_id, case when st = 'open' then 'open' when cr = 'false_positive' then 'false_positive' else 'resolved' end as status, nullif(cr, '-') as close_reason, n_decisions from s""")
def triage_state(spark, sf):
    return lg.fold_triage(decisions(spark, sf))[1]


@query("decision_errors", f"""
with d as (select {DECISIONS} from events), f as (select doc_id as finding_id, case when toxic = 1 then 'resolved' else 'open' end as f_status, case when quality = 1 then 'reportable' else 'suppressed' end as c from labels),
j as (select d.*, f_status, c from d left join f using (finding_id)),
e as (select *, case when f_status is null then 'unknown finding' when close_reason = 'false_positive' and c <> 'suppressed' then 'false positive not validated'
   when close_reason = 'already_fixed' and f_status <> 'resolved' and c <> 'reportable' then 'fix not established' end as error from j)
select finding_id, seq, error from e where error is not null""")
def decision_errors(spark, sf):
    f = v.table(spark, sf, "labels").selectExpr("doc_id as finding_id", "case when toxic = 1 then 'resolved' else 'open' end as status",
                                                "case when quality = 1 then 'reportable' else 'suppressed' end as conclusion")
    return lg.decision_errors(decisions(spark, sf), f).select("finding_id", "seq", "error")


STATE = "case event_type when 'signup' then 'idle' when 'view' then 'requested' when 'click' then 'generated' when 'purchase' then 'applied' else 'failed' end"
ACTION = "case when value < 2 then 'generate' when value < 4 then 'apply' when value < 6 then 'verify' end"


@query("remediation_audit", f"""
with e as (select user_id as id, ts as recorded_at, {STATE} as state, {ACTION} as pending_action,
  row_number() over (partition by user_id order by ts, event_id) + case when value >= 60 then 1 else 0 end as version from events),
l as (select *, lag(state) over w as ps, lag(version) over w as pv, row_number() over w as rn from e window w as (partition by id order by recorded_at, version)),
x as (select *, [case when rn = 1 and (state <> 'idle' or version <> 1) then 'must start idle at version 1' end,
  case when rn > 1 and not ((ps = 'idle' and state in ('idle', 'requested', 'failed')) or (ps = 'requested' and state in ('requested', 'generated', 'failed'))
     or (ps = 'generated' and state in ('generated', 'applied', 'failed')) or (ps = 'applied' and state in ('applied', 'verifying', 'failed'))
     or ps = 'failed') then 'transition not allowed' end,
  case when rn > 1 and version <> pv + 1 then 'version not previous plus one' end,
  case when pending_action is not null and not ((state in ('idle', 'requested') and pending_action = 'generate') or (state = 'generated' and pending_action = 'apply')
     or (state = 'applied' and pending_action = 'verify') or state = 'failed') then 'action not allowed' end] as errs from l)
select id, version, state, error from (select id, version, state, unnest(errs) as error from x) where error is not null""")
def remediation_audit(spark, sf):
    e = ranked(v.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "rn")
    e = e.selectExpr("user_id as id", "ts as recorded_at", f"{STATE} as state", f"{ACTION} as pending_action", "rn + case when value >= 60 then 1 else 0 end as version")
    return lg.remediation_audit(e).select("id", "version", "state", "error")


@query("resumed_tasks", f"""
with {TASKS_SQL}, done as (select distinct scan_id, candidate_id, phase from log where value >= 30)
select id, case when status = 'cancelled' and d.phase is null then 'pending' else status end as status
from tasks t left join done d on d.scan_id = t.scan_id and d.candidate_id = t.candidate_id and d.phase = t.phase""")
def resumed_tasks(spark, sf):
    return lg.resume_tasks(tasks(spark, sf), log(spark, sf).withColumn("phase", F.when(F.col("value") >= 30, F.col("phase")).otherwise("of no task"))).select("id", "status")


@query("cancelled_tasks", f"""
with {TASKS_SQL} select id, case when status in ('pending', 'claimed') then 'cancelled' else status end as status,
  case when status in ('pending', 'claimed') then 'cancelled: stop' end as receipt from tasks""")
def cancelled_tasks(spark, sf):
    return lg.cancel_tasks(tasks(spark, sf), "stop").select("id", "status", "receipt")


@query("bulk_retry", """
with a as (select 'u' || user_id as scan_id, 'repo/u' || user_id % 5 as path, ts as recorded_at, event_id as seq, case when event_type = 'error' then 'failed' when event_type = 'signup' then 'pending' else 'completed' end as status from events)
select scan_id, path, arg_max(status, (recorded_at, seq)) as status, sum(case when status <> 'pending' then 1 else 0 end) as attempts from a group by scan_id, path having arg_max(status, (recorded_at, seq)) <> 'completed'""")
def bulk_retry(spark, sf):
    a = v.table(spark, sf, "events").selectExpr(
        "concat('u', user_id) as scan_id", "concat('repo/u', user_id % 5) as path", "ts as recorded_at", "event_id as seq", "case when event_type = 'error' then 'failed' when event_type = 'signup' then 'pending' else 'completed' end as status")
    return lg.bulk_retry(a)[1]


NOTES = "case when event_type = 'signup' then 'open' when event_type = 'view' then 'false_positive' when event_type = 'click' then 'resolved' else 'unknown' end as status, case when value >= 5 then 'v' || event_id end as validation"


@query("annotation_overlay", f"""
with f as (select doc_id as finding_id, case when quality = 1 then 'reportable' else 'suppressed' end as conclusion, toxic = 0 as has_path from labels),
a as (select user_id as finding_id, ts as recorded_at, event_id as seq, {NOTES}, case when value >= 8 then 'p' end as attack_path, case when value >= 8 then 'i' end as impact, case when value >= 3 then 'fix' end as remediation from events),
ok as (select a.* from a join f using (finding_id) where (status = 'false_positive' and conclusion = 'suppressed' and validation is not null)
  or (status = 'open' and conclusion = 'reportable' and has_path and validation is not null and attack_path is not null)
  or (status = 'resolved' and has_path and remediation is not null) or (status = 'unknown' and validation is not null)),
l as (select * from ok qualify row_number() over (partition by finding_id order by recorded_at desc, seq desc) = 1)
select f.finding_id, coalesce(l.status, 'open') as status, coalesce(l.validation, 'base') as validation, l.finding_id is not null as annotated from f left join l using (finding_id)""")
def annotation_overlay(spark, sf):
    f = v.table(spark, sf, "labels").selectExpr(
        "doc_id as finding_id", "case when quality = 1 then 'reportable' else 'suppressed' end as conclusion", "toxic = 0 as has_attack_path", "'open' as status", "'base' as validation",
        "'base' as attack_path", "'base' as impact", "'base' as remediation", "'low' as severity")
    a = v.table(spark, sf, "events").selectExpr(
        "user_id as finding_id", "ts as recorded_at", "event_id as seq", NOTES.split(", case when value")[0], "case when value >= 5 then concat('v', event_id) end as validation",
        "case when value >= 8 then 'p' end as attack_path", "case when value >= 8 then 'i' end as impact", "case when value >= 3 then 'fix' end as remediation", "cast(null as string) as severity")
    return lg.overlay_annotations(f, a).select("finding_id", "status", "validation", "annotated")


@query("last_known_state", """
select event_id, last_value(case when event_type = 'error' then value end ignore nulls) over (partition by user_id order by ts, event_id) as last_error from events""")
def last_known_state(spark, sf):
    e = v.table(spark, sf, "events").withColumn("err", F.when(F.col("event_type") == "error", F.col("value")))
    return last_known(e, ["user_id"], ["ts", "event_id"], "err", "last_error").select("event_id", "last_error")


@query("role_changes", """
with l as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as before from conversations)
select conv_id, turn, role, before from l where before is distinct from role""")
def role_changes(spark, sf):
    c = lagged(v.table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], ["role"])
    return c.select("conv_id", "turn", "role", F.col("prev.role").alias("before")).filter(~F.col("before").eqNullSafe(F.col("role")))

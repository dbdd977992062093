"""Severity policy, confidence, routing and rubric; orders and line items stand for assessments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy as po
from ..plans import views as v
from .registry import query

IMPACT = "case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'medium' when '3-MEDIUM' then 'low' when '5-LOW' then 'ignore' else 'unknown' end"
LIKELY = "case when l_quantity < 10 then 'low' when l_quantity < 20 then 'medium' when l_quantity < 40 then 'high' when l_quantity < 45 then 'ignore' else 'unknown' end"
SCOPE = "case when l_tax < 0.02 then 'remote' when l_tax < 0.04 then 'local_network' when l_tax < 0.06 then 'localhost' else 'none' end"
FACTS = f"l_orderkey, l_linenumber, l_partkey, {IMPACT} as impact, {LIKELY} as likelihood, {SCOPE} as scope, l_discount >= 0.09 as self_only, l_returnflag = 'R' as code_execution"
FACTS_SQL = f"facts as (select {FACTS} from lineitem join orders on l_orderkey = o_orderkey)"


def facts(spark, sf):
    li, o = v.table(spark, sf, "lineitem"), v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey).selectExpr(*[x.strip() for x in _split(FACTS)])


def _split(select: str):
    out, depth, cur = [], 0, ""
    for ch in select:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]


W_SQL = """w as (select *, case when likelihood in ('ignore', 'unknown') then likelihood when scope = 'remote' then 'high' when scope = 'local_network' then 'medium'
            when scope = 'localhost' then 'low' else likelihood end as wl from facts),
m as (select *, case when impact = 'ignore' or wl = 'ignore' then 'ignore' when impact = 'high' and wl = 'high' then 'high'
            when impact in ('high', 'unknown') and wl in ('high') then 'medium' when impact = 'high' and wl in ('medium', 'unknown') then 'medium'
            when impact = 'medium' and wl = 'high' then 'medium' else 'low' end as ms from w)"""


@query("matrix_severity", f"with {FACTS_SQL}, {W_SQL} select impact, likelihood, scope, wl as weighted, ms as severity, count(*) as n from m group by all")
def matrix_severity(spark, sf):
    f = facts(spark, sf).withColumn("weighted", po.weighted_likelihood(F.col("likelihood"), F.col("scope")))
    f = f.withColumn("severity", po.matrix_severity(F.col("impact"), F.col("weighted")))
    return f.groupBy("impact", "likelihood", "scope", "weighted", "severity").agg(F.count("*").alias("n"))


CAL_SQL = """c as (select *, not self_only and ms = 'high' and code_execution as crit from m),
d as (select *, case when self_only then 'ignore' when crit then 'critical' else ms end as severity from c),
p as (select *, case severity when 'critical' then 'P0' when 'high' then 'P1' when 'medium' then 'P2' when 'low' then 'P3' end as priority from d)"""


@query("calibrated_severity", f"""
with {FACTS_SQL}, {W_SQL}, {CAL_SQL}
select impact, likelihood, scope, severity, priority, case when severity = 'ignore' then 'ignore' else 'reportable' end as decision,
  case when self_only then 'hard suppression applies (self-only, unreachable, or privileged/operator-only preconditions); decision ignore'
       else (case when crit then 'critical criteria met for high impact x high likelihood; ' else '' end) || 'impact ' || impact || ' x likelihood ' || wl || ' -> ' || severity
            || case when priority is not null then ' (' || priority || ')' else '' end end as rationale, count(*) as n from p group by all""")
def calibrated_severity(spark, sf):
    return po.calibrate(facts(spark, sf)).groupBy("impact", "likelihood", "scope", "severity", "priority", "decision", "rationale").agg(F.count("*").alias("n"))


EVID = "value >= 90 as counterevidence_defeats, event_type = 'error' as reproduced_crash, event_type = 'click' as sanitizer_reproduction, value < 3 as debugger_trace, value < 10 as focused_test, event_type = 'view' as source_trace"


@query("confidence_ladder", f"""
with e as (select event_id, {EVID} from events),
s as (select event_id, case when counterevidence_defeats then 'low' when reproduced_crash or sanitizer_reproduction or debugger_trace then 'high' when source_trace then 'medium' else 'low' end as confidence,
  case when counterevidence_defeats then 0.0 when reproduced_crash then 1.0 when sanitizer_reproduction then 0.9 when debugger_trace then 0.8 when focused_test then 0.6 else 0.3 end::double as score from e)
select event_id, confidence, score, case when score >= 0.8 then 'high' when score >= 0.4 then 'medium' else 'low' end as score_confidence from s""")
def confidence_ladder(spark, sf):
    e = v.table(spark, sf, "events").selectExpr("event_id", *[x.strip() for x in EVID.split(",")])
    return po.confidence(e).select("event_id", "confidence", "score", "score_confidence")




@query("policy_pass", f"""
with facts as (select {FACTS}, case when l_linenumber = 1 then 'no' else 'yes' end as attacker_input_control,
   case when l_returnflag = 'A' then 'unachievable' else 'achievable' end as preconditions, case when l_linestatus = 'O' then 'admin-only' else 'public' end as auth_scope
   from lineitem join orders on l_orderkey = o_orderkey), {W_SQL},
r as (select *, concat_ws('; ', case when self_only then 'self-only impact is hard-suppressed to ignore' end,
     case when attacker_input_control = 'no' then 'no attacker-controlled input or unreachable path is hard-suppressed to ignore' end,
     case when preconditions = 'unachievable' then 'unachievable preconditions are hard-suppressed to ignore' end) as why,
     case when ms = 'high' and code_execution then 'critical' else ms end as sev from m),
q as (select *, case sev when 'critical' then 'P0' when 'high' then 'P1' when 'medium' then 'P2' when 'low' then 'P3' end as pr from r)
select l_orderkey, l_linenumber, l_partkey, case when why <> '' then 'ignore' else sev end as severity,
  case when why <> '' or sev = 'ignore' then 'ignore' else 'reportable' end as decision, case when why = '' then pr end as priority,
  case when why <> '' then why else (case when sev = 'critical' then 'critical criteria met for high impact x high likelihood; ' else '' end)
    || 'impact ' || impact || ' x likelihood ' || wl || ' -> ' || sev || case when pr is not null then ' (' || pr || ')' else '' end
    || case when sev <> 'ignore' and auth_scope = 'admin-only' then ' (authScope admin-only lowers likelihood)' else '' end end as rationale
from q""")
def policy_pass(spark, sf):
    li, o = v.table(spark, sf, "lineitem"), v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    f = li.join(o, li.l_orderkey == o.o_orderkey).selectExpr(
        *[x.strip() for x in _split(FACTS)], "case when l_linenumber = 1 then 'no' else 'yes' end as attacker_input_control",
        "case when l_returnflag = 'A' then 'unachievable' else 'achievable' end as preconditions", "case when l_linestatus = 'O' then 'admin-only' else 'public' end as auth_scope")
    return po.policy_pass(f.withColumnRenamed("scope", "vector")).select("l_orderkey", "l_linenumber", "l_partkey", "severity", "decision", "priority", "rationale")


@query("suppression_allowed", """
with f as (select event_id, event_type = 'error' as seeded_row, event_type in ('click', 'view') as sibling_instance, case when value >= 20 then 'guard' end as exact_control,
                  value < 5 as missing_external_fact, event_type = 'signup' as adjacency_pass_ran from events)
select event_id, not (missing_external_fact and not adjacency_pass_ran) and not ((seeded_row or sibling_instance) and exact_control is null) as allowed,
  case when missing_external_fact and not adjacency_pass_ran then 'A missing' when seeded_row and exact_control is null then 'A seeded'
       when sibling_instance and exact_control is null then 'Each inst' else 'Exact per' end as reason_start from f""")
def suppression_allowed(spark, sf):
    f = v.table(spark, sf, "events").selectExpr(
        "event_id", "event_type = 'error' as seeded_row", "event_type in ('click', 'view') as sibling_instance", "case when value >= 20 then 'guard' end as exact_control",
        "value < 5 as missing_external_fact", "event_type = 'signup' as adjacency_pass_ran")
    out = po.suppression_allowed(f)
    return out.select("event_id", "allowed", F.when(F.startswith("reason", F.lit("Each")), F.substring("reason", 1, 9)).when(F.startswith("reason", F.lit("Exact")), F.substring("reason", 1, 9))
                      .when(F.startswith("reason", F.lit("A seeded")), F.substring("reason", 1, 8)).otherwise(F.substring("reason", 1, 9)).alias("reason_start"))


ROUTE_RULE = "case when p_size < 5 then 'sql.injection' when p_size < 10 then 'path.traversal' when p_size < 15 then 'ssrf.request' when p_size < 20 then 'weak.randomness' when p_size < 25 then 'Xss.output' when p_size < 30 then 'shell.command' when p_size < 35 then 'agent.tool' else 'other.rule' end"
ROUTE_CWE = "case when p_retailprice < 950 then 'cwe-502' when p_retailprice < 1000 then 'CWE-862' when p_retailprice < 1050 then 'CWE-798' else '' end"


@query("proof_class_routes", f"""
with p as (select p_partkey, lower({ROUTE_RULE}) as r, upper({ROUTE_CWE}) as c from part),
x as (select p_partkey, r, c, case when contains(r, 'sql') or contains(r, 'query') then 'query-parser-injection' when contains(r, 'path') or contains(r, 'traversal') then 'resource-path-control'
  when contains(r, 'ssrf') then 'ssrf' when c = 'CWE-502' then 'deserializer-codec' when c = 'CWE-862' then 'authz-tenant-object' when contains(r, 'randomness') then 'auth-token-protocol'
  when c = 'CWE-798' then 'secret-data-exposure' when contains(r, 'xss') then 'xss-template' when contains(r, 'shell') or contains(r, 'command') then 'injection-path'
  when contains(r, 'agent') then 'agent-mcp' else 'generic' end as proof_class from p)
select p_partkey, proof_class, 4 + case when p_partkey in (select l_partkey from lineitem where l_returnflag = 'R') then 1 else 0 end + case when p_partkey in (select l_partkey from lineitem) then 1 else 0 end as n_criteria from x""")
def proof_class_routes(spark, sf):
    seen = v.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("n_locations"), F.bool_or(F.col("l_returnflag") == "R").alias("has_interface"))
    p = v.table(spark, sf, "part").selectExpr("p_partkey", f"{ROUTE_RULE} as rule_id", f"{ROUTE_CWE} as cwe").join(seen, "p_partkey", "left") \
        .fillna({"n_locations": 0, "has_interface": False})
    return po.validation_rubric(p).select("p_partkey", "proof_class", F.size("rubric").alias("n_criteria"))

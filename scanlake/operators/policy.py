"""Severity policy: impact x likelihood, calibration, confidence ladders, suppressions, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

# ---- fixed values: impact (row) x likelihood -> severity --------------------------------
LEVELS = ("high", "medium", "low", "ignore", "unknown")
MATRIX = {
    "high": ("high", "medium", "low", "ignore", "medium"),
    "medium": ("medium", "low", "low", "ignore", "low"),
    "low": ("low", "low", "low", "ignore", "low"),
    "ignore": ("ignore", "ignore", "ignore", "ignore", "ignore"),
    "unknown": ("medium", "low", "low", "ignore", "low"),
}
# ---- fixed values: scope -> likelihood; severity -> priority ----------------------------
SCOPE_LIKELIHOOD = {"remote": "high", "local_network": "medium", "localhost": "low"}
PRIORITY = {"critical": "P0", "high": "P1", "medium": "P2", "low": "P3"}
# ---- fixed values: names of the critical criteria and of the hard suppressions ------------
CRITICAL = ("code_execution", "account_takeover", "auth_bypass", "privilege_gain", "sensitive_data_exposure",
            "sandbox_escape", "memory_safety_exploitation")
SUPPRESSIONS = ("self_only", "privileged_only", "operator_only", "developer_only", "physical_access_only",
                "unreachable", "unrealistic_preconditions")
SUPPRESSED_NOTE = "hard suppression applies (self-only, unreachable, or privileged/operator-only preconditions); decision ignore"


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _any(df: DataFrame, names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | _flag(df, n)
    return out


def matrix_severity(impact: Column, likelihood: Column) -> Column:
    cells = {f"{i}/{l}": sev for i, row in MATRIX.items() for l, sev in zip(LEVELS, row)}
    return tx.lookup(cells, F.concat_ws("/", impact, likelihood))


def weighted_likelihood(likelihood: Column, scope: Column) -> Column:
    """Network scope replaces a known likelihood; 'ignore' and 'unknown' stay."""
    return F.when(likelihood.isin("ignore", "unknown"), likelihood) \
        .otherwise(F.coalesce(tx.lookup(SCOPE_LIKELIHOOD, scope), likelihood))


def calibrate(df: DataFrame) -> DataFrame:
    """Suppressions, matrix, critical escalation, priority and rationale; all in one projection."""
    scope = F.col("scope") if "scope" in df.columns else F.lit("unknown")
    df = df.withColumn("_l", weighted_likelihood(F.col("likelihood"), scope)) \
        .withColumn("_m", matrix_severity(F.col("impact"), F.col("_l")))
    hard = _any(df, SUPPRESSIONS)
    critical = (F.col("_m") == "high") & (F.col("impact") == "high") & (F.col("_l") == "high") & _any(df, CRITICAL)
    df = df.withColumn("_crit", critical & ~hard)
    sev = F.when(hard, "ignore").when(F.col("_crit"), "critical").otherwise(F.col("_m"))
    df = df.withColumn("severity", sev).withColumn("priority", tx.lookup(PRIORITY, F.col("severity")))
    told = F.concat(F.lit("impact "), "impact", F.lit(" x likelihood "), "_l", F.lit(" -> "), "severity",
                    F.when(F.col("priority").isNotNull(), F.concat(F.lit(" ("), "priority", F.lit(")"))).otherwise(""))
    rationale = F.array_join(tx.compact(
        F.when(F.col("_crit"), "critical criteria met for high impact x high likelihood"), told), "; ")
    return df.withColumn("decision", F.when(F.col("severity") == "ignore", "ignore").otherwise("reportable")) \
        .withColumn("rationale", F.when(hard, SUPPRESSED_NOTE).otherwise(rationale)).drop("_l", "_m", "_crit")


def confidence_label(df: DataFrame) -> Column:
    """Label from the strongest evidence."""
    return F.when(_flag(df, "counterevidence_defeats"), "low") \
        .when(_any(df, ("reproduced_crash", "sanitizer_reproduction", "debugger_trace")), "high") \
        .when(_flag(df, "source_trace"), "medium").otherwise("low")


def confidence_score(df: DataFrame) -> Column:
    return F.when(_flag(df, "counterevidence_defeats"), 0.0).when(_flag(df, "reproduced_crash"), 1.0) \
        .when(_flag(df, "sanitizer_reproduction"), 0.9).when(_flag(df, "debugger_trace"), 0.8) \
        .when(_any(df, ("realistic_interface", "focused_test")), 0.6).otherwise(0.3)


def confidence_from_score(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.4, "medium").otherwise("low")


def confidence(df: DataFrame) -> DataFrame:
    out = df.withColumn("confidence", confidence_label(df)).withColumn("score", confidence_score(df))
    return out.withColumn("score_confidence", confidence_from_score(F.col("score")))


def policy_pass(df: DataFrame) -> DataFrame:
    """Attack-path policy: collected hard-suppression reasons, else calibration plus a scope note."""
    no_input = _flag(df, "unreachable") | (F.col("attacker_input_control") == "no")
    no_way = _flag(df, "unrealistic_preconditions") | (F.col("preconditions") == "unachievable")
    reasons = tx.compact(
        F.when(_flag(df, "self_only"), "self-only impact is hard-suppressed to ignore"),
        F.when(no_input, "no attacker-controlled input or unreachable path is hard-suppressed to ignore"),
        F.when(no_way, "unachievable preconditions are hard-suppressed to ignore"),
        F.when(_any(df, ("privileged_only", "operator_only", "developer_only", "physical_access_only")),
               "privileged/operator/developer/physical-access-only preconditions are hard-suppressed to ignore"))
    known = df.withColumn("_why", reasons).withColumn("scope", F.col("vector"))
    out = calibrate(known.drop(*[c for c in SUPPRESSIONS if c in df.columns]))
    stop = F.size("_why") > 0
    note = F.when(F.col("auth_scope") == "admin-only", " (authScope admin-only lowers likelihood)") \
        .when(F.col("auth_scope") == "internal-only", " (authScope internal-only lowers likelihood)").otherwise("")
    return out.withColumn("rationale", F.when(stop, F.array_join("_why", "; ")).when(F.col("severity") == "ignore", F.col("rationale"))
                          .otherwise(F.concat("rationale", note))) \
        .withColumn("severity", F.when(stop, "ignore").otherwise(F.col("severity"))) \
        .withColumn("decision", F.when(stop, "ignore").otherwise(F.col("decision"))) \
        .withColumn("priority", F.when(~stop, F.col("priority"))).drop("_why", "scope")


# ---- fixed values: reasons for and against suppressing one instance -------------------------
SUPPRESSION_REASONS = {
    "gap": "A missing downstream caller, deployment fact, or artifact-provenance fact is a proof gap or a reason to run a bounded adjacency pass, not counterevidence.",
    "seeded": "A seeded advisory/tag row must be closed with exact local evidence; a same-family neighbor is supporting evidence, not counterevidence.",
    "sibling": "Each instance must be suppressed with the exact control that makes that instance safe; a safe sibling does not suppress a vulnerable sibling.",
    "ok": "Exact per-instance counterevidence is present.",
}


def suppression_allowed(df: DataFrame) -> DataFrame:
    """Instance-preserving suppression check; the first failing condition gives the reason."""
    exact = F.coalesce(F.col("exact_control"), F.lit("")) != ""
    why = F.when(F.col("missing_external_fact") & ~F.col("adjacency_pass_ran"), "gap") \
        .when(F.col("seeded_row") & ~exact, "seeded").when(F.col("sibling_instance") & ~exact, "sibling").otherwise("ok")
    return df.withColumn("_why", why).withColumn("allowed", F.col("_why") == "ok") \
        .withColumn("reason", tx.lookup(SUPPRESSION_REASONS, F.col("_why"))).drop("_why")


# ---- fixed values: proof class routing, first match wins: (class, rule words, weakness prefixes) ----
PROOF_ROUTES = (
    ("query-parser-injection", ("sql", "nosql", "query"), ("CWE-89", "CWE-943")),
    ("resource-path-control", ("path-traversal", "path", "traversal", "resource"), ("CWE-22", "CWE-23")),
    ("ssrf", ("ssrf", "request-sink"), ("CWE-918",)),
    ("deserialization-code-exec", ("dynamic-code", "eval", "code-exec", "rce"), ("CWE-94", "CWE-95")),
    ("deserializer-codec", ("deserial", "unserialize", "objectinputstream", "binaryformatter", "pickle", "yaml.load"), ("CWE-502",)),
    ("auth-token-protocol", ("tls", "jwt", "token", "assertion", "crypto"), ("CWE-295", "CWE-347")),
    ("auth-token-protocol", ("cors",), ("CWE-942",)),
    ("xml-parser-hardening", ("xml", "xxe"), ("CWE-611",)),
    ("authz-tenant-object", ("authorization", "auth", "idor", "access-control"), ("CWE-862", "CWE-863", "CWE-639")),
    ("auth-token-protocol", ("weak-random", "randomness"), ()),
    ("secret-data-exposure", ("credential", "secret", "key"), ("CWE-798", "CWE-256")),
    ("deserialization-code-exec", ("prototype", "merge"), ()),
    ("xss-template", ("xss", "template", "ssti"), ("CWE-79",)),
    ("injection-path", ("shell", "command"), ("CWE-78", "CWE-77")),
    ("agent-mcp", ("agent", "mcp"), ()),
)
# ---- fixed values: (attacker input, control, sink, impact) per routed class -----------------
PROOF_TUPLES = {
    "query-parser-injection": ("attacker-controlled bytes", "query/selector/parser API receiving syntax or operators rather than bound values; later business check only limits confidence if it checks the same trusted object and defeats syntax control", "query/selector/parser evaluation", "read, write, authz, integrity, or availability impact"),
    "resource-path-control": ("attacker-controlled URL/path/resource name", "allowlist/path-matcher/decoder/canonicalizer/resource-selection control; mismatch, pre-decode/post-decode gap, legacy handler behavior, or unsafe resolver fallback", "resource selection or filesystem access", "arbitrary file read/write, path traversal, or unauthorized resource access"),
    "ssrf": ("attacker-controlled destination (URL, URI, host, endpoint)", "destination allow/deny/filter control and its bypass", "network client or server-side callback", "network/read/side-effect impact"),
    "deserialization-code-exec": ("attacker-controlled serialized, code, or template bytes", "unsafe loader/evaluator without safe-mode controls", "deserialization, evaluation, or object construction", "code execution or object-construction effect"),
    "deserializer-codec": ("attacker-controlled serialized or structured input", "registered codec/converter/deserializer/container handler that recursively parses, resolves types, filters classes, converts values, or constructs objects; missing validation, unsafe fallback, fail-open filter, or unbounded traversal", "recursive parse, type resolution, conversion, or object construction", "code execution, object construction, parser confusion, denial of service, or privilege-boundary impact"),
    "auth-token-protocol": ("attacker-controlled token, assertion, protocol metadata, or version value", "exact validator/control semantics; mismatch between validated value and trusted value, incomplete canonicalization/equality, unchecked parsing, or missing binding", "authentication, authorization, or protocol decision", "authentication, authorization, or protocol-security impact"),
    "xml-parser-hardening": ("attacker-controlled XML/SVG/XSLT/SAX/DOM/StAX input", "parser factory, converter, transformer, or resolver setup; fail-open feature configuration, missing entity/DTD controls, caller-supplied parser path, or secure-processing-only hardening", "entity/DTD resolution during parse", "XXE, SSRF, file read, parser injection, or denial of service"),
    "authz-tenant-object": ("attacker path and identity/tenant context", "missing or wrong authentication, authorization, permission, tenant, or ownership guard", "protected object, protected comparison, or security-relevant state transition", "unauthorized access, privilege escalation, or protected-object mutation"),
    "secret-data-exposure": ("secret or sensitive source", "exposure/storage/log/client boundary and missing protection", "exposure, storage, log, or client boundary", "sensitive data disclosure; validate after high-impact classes unless it directly enables code execution, injection, privilege escalation, auth bypass, or sensitive cross-boundary impact"),
    "xss-template": ("attacker-controlled value", "escaping or template context handling", "browser sink or server-side template execution", "cross-site scripting or template/ssti execution"),
    "injection-path": ("attacker-controlled bytes (query, path, upload, header, redirect target)", "sanitizer, canonicalization, or allowlist result applied to the bytes", "dangerous sink or context (query grammar, filesystem, shell, header, redirect)", "injection, path traversal, file impact, header injection, or open redirect"),
    "agent-mcp": ("untrusted instruction/data source", "privileged tool/action boundary", "privileged tool or action execution", "action, code execution, or exfiltration effect"),
    "generic": ("attacker-controlled input", "closest relevant security control", "sensitive sink or protected operation", "concrete security impact"),
}


def route_proof_class(rule_id: Column, cwe: Column) -> Column:
    """First matching class over the lower-case rule id and the upper-case weakness prefix."""
    rule, weak = F.lower(rule_id), F.upper(F.coalesce(cwe, F.lit("")))
    out = None
    for name, words, prefixes in PROOF_ROUTES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(rule, F.lit(w))
        for p in prefixes:
            hit = hit | F.startswith(weak, F.lit(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("generic")


def validation_rubric(df: DataFrame) -> DataFrame:
    """Ordered (criterion, kind) rows in one array column; none is left out."""
    df = df.withColumn("proof_class", route_proof_class(F.col("rule_id"), F.col("cwe")))
    part = lambda i: tx.lookup({k: t[i] for k, t in PROOF_TUPLES.items()}, F.col("proof_class"))
    crit = lambda kind, text: F.struct(text.alias("criterion"), F.lit(kind).alias("kind"))
    say = lambda before, i: F.concat(F.lit(before), part(i), F.lit("."))
    items = tx.compact(
        crit("proof-tuple", say("Establish the attacker-controlled source: ", 0)),
        crit("control", say("Examine the closest control and prove or refute it: ", 1)),
        crit("proof-tuple", say("Show the value reaching the sink or protected operation: ", 2)),
        crit("impact", say("State the concrete impact and the strongest counterevidence: ", 3)),
        F.when(F.col("has_interface"), crit("realistic-interface", F.lit(
            "Reproduce through the realistic user-reachable interface (HTTP/CLI/message/file) when feasible."))),
        F.when(F.col("n_locations") > 0, crit("counterevidence", F.lit(
            "Keep exact source/sink line evidence for the affected locations; suppress only with per-instance counterevidence."))))
    return df.withColumn("rubric", items)

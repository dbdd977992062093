"""Append-only logs folded to state: claims, gates, decisions, remediation states.

Folds that need only the latest row use ``max_by`` (partial aggregation, safe for a hot
key). Folds that compare neighbours use ``scale.lagged``, which splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.scans import scan_keys
from ..scale import lagged

# ---- fixed values: lease bounds in seconds ------------------------------------------------
MIN_LEASE, DEFAULT_LEASE, MAX_LEASE = 60, 30 * 60, 4 * 60 * 60
CLAIM_LEASE, DELIVERED_LEASE = 120, 900


def release_expired(tasks: DataFrame, now: Column) -> DataFrame:
    """A claim whose lease has ended returns to pending."""
    gone = (F.col("status") == "claimed") & (F.col("expires_at") <= now)
    return tasks.withColumn("released", F.coalesce(gone, F.lit(False))) \
        .withColumn("status", F.when(F.col("released"), "pending").otherwise(F.col("status"))) \
        .withColumn("expires_at", F.when(~F.col("released"), F.col("expires_at")))


def claimable(tasks: DataFrame, now: Column, by: str = "phase") -> DataFrame:
    """Next pending task per phase after expiry, lowest ``ord`` first: an aggregate, not a window."""
    free = release_expired(tasks, now).filter("status = 'pending'")
    return free.groupBy(by).agg(F.min_by("id", F.struct("ord", "id")).alias("id"), F.count("*").alias("n_pending"))


def lease_seconds(requested: Column) -> Column:
    return F.greatest(F.lit(MIN_LEASE), F.least(F.coalesce(requested, F.lit(DEFAULT_LEASE)), F.lit(MAX_LEASE)))


def claim_expired(claimed_at: Column, now: Column, seconds: int = CLAIM_LEASE) -> Column:
    return (F.unix_micros(now) - F.unix_micros(claimed_at)) > F.lit(seconds) * 1_000_000


def pending(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates with no validation row, and how many rows of each other stage they have."""
    keys = [*scan_keys(findings, ledger), "candidate_id"]
    seen = ledger.groupBy(*keys).agg(
        F.bool_or(F.col("phase") == "validation").alias("_done"), F.count("*").alias("n_rows"),
        F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("stages"))
    return findings.join(seen, keys, "left").filter("_done is null or not _done") \
        .select(*findings.columns, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("stages", F.lit("")).alias("stages"))


def finalize_check(scans: DataFrame, findings: DataFrame, ledger: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per scan: missing receipts, open tasks, and the lifecycle that finalising would give."""
    seen = ledger.groupBy("scan_id", "candidate_id").agg(
        F.bool_or(F.col("phase") == "validation").alias("v"), F.bool_or(F.col("phase") == "attack_path").alias("a"))
    f = findings.join(seen, ["scan_id", "candidate_id"], "left")
    lacking = ~F.coalesce(F.col("v"), F.lit(False)) | ((F.col("disposition") == "reportable") & ~F.coalesce(F.col("a"), F.lit(False)))
    missing = f.groupBy("scan_id").agg(F.sum(lacking.cast("long")).alias("missing"))
    open_tasks = tasks.groupBy("scan_id").agg(F.sum(F.col("status").isin("pending", "claimed").cast("long")).alias("open_tasks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scans.join(missing, "scan_id", "left").join(open_tasks, "scan_id", "left")
    return out.select("scan_id", zero("missing").alias("missing"), zero("open_tasks").alias("open_tasks"),
                      F.when((zero("missing") > 0) | (zero("open_tasks") > 0), "blocked")
                      .when(F.col("complete"), "completed").otherwise("incomplete").alias("lifecycle"))


# ---- citations -------------------------------------------------------------------------------
# ---- fixed values: recognised roles -------------------------------------------------------
ROLES = ("entrypoint", "wrapper", "propagation", "root_control", "sink", "outcome", "expected_control")


def reference_errors(refs: DataFrame, locations: DataFrame, records: DataFrame) -> DataFrame:
    """Citation errors per record: none given, malformed, repeated, not retained, endpoints not cited.

    ``records(record_id, candidate_id, kind, conclusion)``, ``refs(record_id, candidate_id, file,
    line, role)``, ``locations(candidate_id, file, line, role)``.
    """
    role_ok = F.col("role").isin(list(ROLES))
    shape_ok = F.coalesce((F.length(tx.trim(F.col("file"))) > 0) & (F.col("line") >= 1) & role_ok, F.lit(False))
    scan = scan_keys(refs, locations, records)
    record = [*scan, "record_id"]
    key = [*scan, "candidate_id", "file", "line", "role"]
    kept = locations.withColumn("role", F.coalesce("role", F.lit("root_control"))).select(*key).distinct()
    malformed = refs.filter(~shape_ok).select(*record, F.lit("malformed reference").alias("error"))
    good = refs.filter(shape_ok)
    repeated = good.groupBy("record_id", *key).agg(F.count("*").alias("n")).filter("n > 1") \
        .select(*record, F.lit("duplicate reference").alias("error"))
    stray = good.join(kept, key, "left_anti").select(*record, F.lit("not a retained location").alias("error"))
    cited = good.groupBy(*record).agg(
        F.bool_or(F.col("role") == "entrypoint").alias("ce"), F.bool_or(F.col("role") == "sink").alias("cs"),
        F.bool_or(F.col("role").isin("root_control", "sink")).alias("cr"))
    held = kept.groupBy(*scan, "candidate_id").agg(F.bool_or(F.col("role") == "entrypoint").alias("he"),
                                            F.bool_or(F.col("role") == "sink").alias("hs"))
    any_ref = refs.select(*record).distinct().withColumn("_any", F.lit(True))
    r = records.join(cited, record, "left").join(held, [*scan, "candidate_id"], "left").join(any_ref, record, "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    whole = F.when(F.col("_any").isNull(), "no reference") \
        .when((F.col("kind") == "validation") & (F.col("conclusion") == "reportable") & no("cr"), "root control or sink not cited") \
        .when((F.col("kind") == "attack_path") & F.col("he") & F.col("hs") & (no("ce") | no("cs")), "both endpoints not cited")
    ends = r.withColumn("error", whole).filter("error is not null").select(*record, "error")
    return malformed.unionByName(repeated).unionByName(stray).unionByName(ends).distinct()


def receipt_errors(records: DataFrame, refs: DataFrame, runtime_evidence: DataFrame) -> DataFrame:
    """Runtime receipts: needed for runtime or hybrid, refused otherwise, bound to the candidate."""
    scan = scan_keys(records, refs, runtime_evidence)
    record = [*scan, "record_id"]
    r = refs.select(*record, tx.trim(F.col("ref")).alias("ref")).distinct()
    n = r.groupBy(*record).agg(F.count("*").alias("n"), F.bool_or((F.length("ref") == 0) | (F.length("ref") > 1000)).alias("bad"))
    j = records.join(n, record, "left")
    runtime = F.col("method").isin("runtime", "hybrid")
    own = j.withColumn("error", F.when(F.col("bad"), "unbounded reference").when(~runtime & F.col("n").isNotNull(), "not a runtime method")
                       .when(runtime & F.col("n").isNull(), "runtime receipt required")).filter("error is not null").select(*record, "error")
    stray = r.join(records.filter(runtime).select(*record, "candidate_id"), record) \
        .join(runtime_evidence.select(*scan, "candidate_id", F.col("artifact_ref").alias("ref")), [*scan, "candidate_id", "ref"], "left_anti") \
        .select(*record, F.lit("not retained runtime evidence").alias("error")).distinct()
    return own.unionByName(stray)


# ---- outcomes -----------------------------------------------------------------------------------

def apply_validations(findings: DataFrame, validations: DataFrame) -> DataFrame:
    """Latest validation per candidate sets disposition, confidence, next task and lifecycle."""
    keys = [*scan_keys(findings, validations), "candidate_id"]
    last = validations.groupBy(*keys).agg(
        F.max_by(F.struct("conclusion", "method", "confidence", "direct_evidence"), F.struct("recorded_at", "seq")).alias("v"))
    f = findings.drop("confidence", "disposition").join(last, keys, "left")
    seen = F.col("v").isNotNull()
    reportable = F.coalesce(F.col("v.conclusion") == "reportable", F.lit(False))
    return f.select(*findings.drop("confidence", "disposition").columns,
                    F.coalesce("v.conclusion", F.lit("discovered")).alias("disposition"),
                    F.coalesce("v.confidence", F.lit("low")).alias("confidence"),
                    F.when(seen, F.concat("v.method", F.lit(" validation: "), "v.direct_evidence")).alias("validation"),
                    F.when(F.col("v.method") == "runtime", "runtime").when(F.col("v.method") == "test", "test")
                    .when(seen, "validation").alias("evidence_kind"),
                    F.when(reportable, "attack_path").alias("next_task"),
                    F.when(reportable, "attack_path").otherwise("validation").alias("lifecycle"))


def apply_attack_paths(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """Latest attack path per reportable candidate; refused rows for other candidates are kept apart."""
    keys = [*scan_keys(findings, paths), "candidate_id"]
    last = paths.groupBy(*keys).agg(F.max_by(F.struct("dataflow", "attacker", "outcome"), F.struct("recorded_at", "seq")).alias("p"),
                                             F.count("*").alias("n_paths"))
    f = findings.join(last, keys, "inner")
    ok = F.col("disposition") == "reportable"
    text = F.concat("p.dataflow", F.lit("\n\nAttacker: "), "p.attacker", F.lit("\nOutcome: "), "p.outcome")
    return f.select(*keys, "disposition", "n_paths", F.when(ok, text).alias("attack_path"),
                    F.when(ok, "reporting").otherwise("refused").alias("lifecycle"))


def late_receipts(receipts: DataFrame, scans: DataFrame) -> DataFrame:
    """Receipts recorded after their scan was completed: completed scans take no new evidence."""
    return receipts.join(scans.select("scan_id", "completed_at"), "scan_id") \
        .filter(F.col("completed_at").isNotNull() & (F.col("recorded_at") > F.col("completed_at")))


# ---- triage decisions --------------------------------------------------------------------------

def decision_errors(decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """Decisions that break the closing rules. ``findings(finding_id, status, conclusion)``."""
    j = decisions.join(findings.select("finding_id", F.col("status").alias("f_status"), "conclusion"), "finding_id", "left")
    c = F.coalesce(F.col("conclusion"), F.lit(""))
    error = F.when(F.col("f_status").isNull(), "unknown finding") \
        .when((F.col("status") == "closed") & F.col("close_reason").isNull(), "close reason required") \
        .when((F.col("status") == "open") & F.col("close_reason").isNotNull(), "open takes no reason") \
        .when((F.col("close_reason") == "false_positive") & ~c.isin("suppressed", "not_applicable"), "false positive not validated") \
        .when((F.col("close_reason") == "already_fixed") & (F.col("f_status") != "resolved") & (c != "reportable"), "fix not established")
    return j.withColumn("error", error).filter("error is not null").select(*decisions.columns, "error")


def fold_triage(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, state): rows where (status, reason, note) changed, and the current state per finding."""
    d = decisions.withColumn("note", F.when(tx.trim(F.col("note")) != "", tx.trim(F.col("note"))))
    d = lagged(d, ["finding_id"], ["recorded_at", "seq"], ["status", "close_reason", "note"])
    same = F.col("prev").isNotNull()
    for c in ("status", "close_reason", "note"):
        same = same & F.col(f"prev.{c}").eqNullSafe(F.col(c))
    log = d.filter(~same).drop("prev")
    last = log.groupBy("finding_id").agg(F.max_by(F.struct("status", "close_reason"), F.struct("recorded_at", "seq")).alias("s"),
                                         F.count("*").alias("n_decisions"))
    state = last.select("finding_id", F.when(F.col("s.status") == "open", "open").when(F.col("s.close_reason") == "false_positive", "false_positive")
                        .otherwise("resolved").alias("status"), F.col("s.close_reason").alias("close_reason"), "n_decisions")
    return log, state


# ---- remediation states ----------------------------------------------------------------------------
# ---- fixed values: allowed next states and allowed pending actions ------------------------------
TRANSITIONS = {
    "idle": ("idle", "requested", "failed"),
    "requested": ("requested", "generated", "failed"),
    "generated": ("generated", "applied", "failed"),
    "applied": ("applied", "verifying", "failed"),
    "verifying": ("verifying", "verified", "failed"),
    "verified": ("verifying", "verified"),
    "failed": ("idle", "requested", "generated", "applied", "verifying", "verified", "failed", "superseded"),
    "superseded": ("superseded",),
}
PENDING_ACTIONS = {
    "idle": ("generate",), "requested": ("generate",), "generated": ("apply",), "applied": ("verify",),
    "verifying": ("verify",), "verified": (), "failed": ("generate", "apply", "verify"), "superseded": (),
}


def allowed_pair(pairs: dict, a: Column, b: Column) -> Column:
    return F.concat_ws(">", a, b).isin([f"{k}>{v}" for k, vs in pairs.items() for v in vs])


def remediation_audit(events: DataFrame) -> DataFrame:
    """Error rows of ``events(id, version, state, pending_action, recorded_at)``: first row, transition, version, action."""
    e = lagged(events, ["id"], ["recorded_at", "version"], ["state", "version"])
    first = F.col("prev").isNull()
    errors = tx.compact(
        F.when(first & ((F.col("state") != "idle") | (F.col("version") != 1)), "must start idle at version 1"),
        F.when(~first & ~allowed_pair(TRANSITIONS, F.col("prev.state"), F.col("state")), "transition not allowed"),
        F.when(~first & (F.col("version") != F.col("prev.version") + 1), "version not previous plus one"),
        F.when(F.col("pending_action").isNotNull() & ~allowed_pair(PENDING_ACTIONS, F.col("state"), F.col("pending_action")), "action not allowed"))
    return e.select("id", "version", "state", "recorded_at", F.explode(errors).alias("error"))


def resume_tasks(tasks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cancelled tasks without a ledger row of their phase go back to pending."""
    keys = [*scan_keys(tasks, ledger), "candidate_id", "phase"]
    t = tasks.join(ledger.select(*keys).distinct().withColumn("_done", F.lit(True)), keys, "left")
    back = (F.col("status") == "cancelled") & F.col("_done").isNull()
    return t.withColumn("status", F.when(back, "pending").otherwise(F.col("status"))).select(*tasks.columns)


def cancel_tasks(tasks: DataFrame, reason: str) -> DataFrame:
    live = F.col("status").isin("pending", "claimed")
    return tasks.withColumn("receipt", F.when(live, F.lit(f"cancelled: {reason}"))) \
        .withColumn("status", F.when(live, "cancelled").otherwise(F.col("status")))


def bulk_retry(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, retry): latest status and attempt count per path; what a resume must run."""
    state = attempts.groupBy(*scan_keys(attempts), "path").agg(F.max_by("status", F.struct("recorded_at", "seq")).alias("status"),
                                         F.sum((F.col("status") != "pending").cast("long")).alias("attempts"))
    return state, state.filter("status <> 'completed'")


def overlay_annotations(findings: DataFrame, annotations: DataFrame) -> DataFrame:
    """Latest valid annotation per finding laid over its sealed fields."""
    f = findings.select("finding_id", "conclusion", "has_attack_path")
    a = annotations.join(f, "finding_id")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    c = F.coalesce(F.col("conclusion"), F.lit(""))
    ok = (c != "") & F.when(F.col("status") == "false_positive", c.isin("suppressed", "not_applicable") & given("validation")) \
        .when(F.col("status") == "open", (c == "reportable") & F.col("has_attack_path") & given("validation") & given("attack_path") & given("impact")) \
        .when(F.col("status") == "resolved", F.col("has_attack_path") & given("remediation")) \
        .when(F.col("status") == "unknown", given("validation")).otherwise(False)
    fields = ["status", "validation", "attack_path", "impact", "remediation", "severity"]
    last = a.filter(ok).groupBy("finding_id").agg(F.max_by(F.struct(*fields), F.struct("recorded_at", "seq")).alias("n"))
    out = findings.join(last, "finding_id", "left")
    over = [F.coalesce(F.col(f"n.{x}"), F.col(x)).alias(x) for x in fields]
    return out.select("finding_id", *over, F.col("n").isNotNull().alias("annotated"))

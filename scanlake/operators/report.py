"""Exports, mixes, evidence digests, report checks, tickets and advisories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.scans import scan_keys

MARKER_TOOL = "scanlake"


def severity_mix(findings: DataFrame) -> DataFrame:
    """Counts of reportable findings per scan by severity and by confidence."""
    n = lambda col, value: F.sum((F.col(col) == value).cast("long")).alias(f"{col}_{value}")
    return findings.filter("disposition = 'reportable'").groupBy("scan_id").agg(
        F.count("*").alias("reportable"), *[n("severity", s) for s in ("critical", "high", "medium", "low")],
        *[n("confidence", c) for c in ("high", "medium", "low")])


def ranked_findings(findings: DataFrame) -> DataFrame:
    """Reportable findings, most severe first, then by id: a range-partitioned sort."""
    return findings.filter("disposition = 'reportable'").orderBy(F.desc(tx.severity_rank(F.col("severity"))), "id")


def hardening(findings: DataFrame) -> DataFrame:
    """Per scan: the first rule family seen twice, else the first critical or high finding, else none.

    "First" is the lowest ``ord``. Families are counted by partial aggregation; the choice is
    made over one row per (scan, family).
    """
    f = findings.filter("disposition = 'reportable'").withColumn("family", F.substring_index("rule_id", ".", 2))
    fam = f.groupBy("scan_id", "family").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    fam = fam.filter("n >= 2").groupBy("scan_id").agg(F.min_by("family", "o").alias("family"), F.min_by("n", "o").alias("n"))
    grave = f.filter(F.col("severity").isin("critical", "high")).groupBy("scan_id").agg(F.min_by("rule_id", "ord").alias("grave"))
    out = f.select("scan_id").distinct().join(fam, "scan_id", "left").join(grave, "scan_id", "left")
    title = F.coalesce(F.concat(F.lit("Centralize "), "family", F.lit(" controls")),
                       F.concat(F.lit("Consolidate the control behind "), "grave"))
    return out.select("scan_id", title.alias("title"), F.coalesce("n", F.when(F.col("grave").isNotNull(), 1), F.lit(0)).cast("long").alias("evidence"),
                      F.when(title.isNotNull(), "structural_hardening_recommended").otherwise("local_remediation_preferred").alias("outcome"))


def evidence_digest(findings: DataFrame, fields=("id", "candidate_id", "locations", "root_cause", "validation", "attack_path",
                                                 "impact", "counterevidence", "remediation")) -> DataFrame:
    """Digest of the evidence behind one write-up; field order pinned, nulls kept."""
    names = [c for c in fields if c in findings.columns]
    return findings.select("id", tx.sha256(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).alias("digest"))


# ---- documents and exports ------------------------------------------------------------------------

def findings_document(findings: DataFrame) -> DataFrame:
    """One JSON document row per reportable finding: numbered evidence catalog, root controls first."""
    shown = F.filter("evidence", lambda e: F.coalesce(F.length(tx.trim(e.location.excerpt)) > 0, F.lit(False)))
    catalog = F.transform(shown, lambda e, i: F.struct(
        F.concat(F.lit("evidence-"), (i + 1).cast("string")).alias("id"), e.kind.alias("label"), e.location.file.alias("path"),
        e.location.line.alias("startLine"), F.coalesce(e.location.role, F.lit("root_control")).alias("role"),
        e.location.excerpt.alias("code"), e.detail.alias("explanation")))
    place = lambda keep: F.transform(F.filter("locations", keep), lambda x: F.struct(x.file.alias("path"), x.line.alias("startLine"), x.role.alias("role")))
    is_root = lambda x: F.coalesce(x.role == "root_control", F.lit(False))
    ordered = F.concat(place(is_root), place(lambda x: ~is_root(x)))
    doc = F.struct(
        F.col("id").alias("findingId"), tx.occurrence_id(F.col("scan_id"), F.col("fingerprint")).alias("occurrenceId"),
        F.col("rule_id").alias("ruleId"), F.col("fingerprint").alias("primaryFingerprint"), "title",
        F.concat("root_cause", F.lit(" Impact: "), "impact").alias("summary"), "severity", "confidence",
        F.struct(tx.taxonomy(F.col("rule_id")).alias("category"),
                 F.when(F.col("cwe") != "", F.array("cwe")).otherwise(F.array().cast("array<string>")).alias("cwe")).alias("taxonomy"),
        ordered.alias("locations"), F.when(F.size(catalog) > 0, catalog).alias("codeEvidence"),
        F.struct(F.col("root_cause").alias("summary"), F.transform(catalog, lambda c: c.id).alias("evidenceRefs")).alias("rootCause"),
        "remediation", F.struct(F.col("candidate_id").alias("candidateId")).alias("extensions"))
    return findings.filter("disposition = 'reportable'").select("scan_id", "id", F.to_json(doc).alias("document"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules of a scan's reportable findings; the last finding by ``ord`` gives the text."""
    return findings.filter("disposition = 'reportable'").groupBy("scan_id", "rule_id").agg(
        F.max_by(F.struct("title", "root_cause", "cwe"), F.struct("ord", "id")).alias("r")).select("scan_id", "rule_id", "r.*")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result row per reportable finding, to be written as lines and wrapped by the sink."""
    spots = F.transform("locations", lambda x: F.struct(F.struct(
        F.struct(x.file.alias("uri")).alias("artifactLocation"),
        F.struct(F.greatest(x.line, F.lit(1)).alias("startLine"), F.struct(x.excerpt.alias("text")).alias("snippet")).alias("region")).alias("physicalLocation")))
    doc = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"),
                   F.struct(F.col("root_cause").alias("text")).alias("message"),
                   F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), spots.alias("locations"),
                   F.struct(F.col("id").alias("findingId"), F.col("candidate_id").alias("candidateId"), "status", "confidence", "cwe").alias("properties"))
    return findings.filter("disposition = 'reportable'").select("scan_id", "id", F.to_json(doc).alias("result"))


def sarif_export(findings: DataFrame, out: str) -> None:
    """Write ``rules`` and ``results`` JSON lines per scan: one log a reader can stream at any size."""
    results = sarif_results(findings).select("scan_id", F.col("result").alias("value"))
    results.write.mode("overwrite").partitionBy("scan_id").text(f"{out}/results")
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"),
                    F.struct(F.col("root_cause").alias("text")).alias("fullDescription"), F.struct("cwe").alias("properties"))
    sarif_rules(findings).select("scan_id", F.to_json(rule).alias("value")).write.mode("overwrite").partitionBy("scan_id").text(f"{out}/rules")


# ---- fixed values: CSV columns in order -----------------------------------------------------------
CSV_COLUMNS = ("id", "candidate_id", "fingerprint", "rule", "severity", "confidence", "cwe", "disposition", "status",
               "file", "line", "title", "validation", "attack_path", "impact", "remediation")


def csv_rows(findings: DataFrame) -> DataFrame:
    first = F.get("locations", F.lit(0))
    return findings.select(*[F.col("rule_id").alias("rule") if c == "rule" else first[c].alias(c) if c in ("file", "line") else F.col(c)
                             for c in CSV_COLUMNS])


def csv_line(rows: DataFrame) -> Column:
    """One CSV line; a field is quoted when it holds a quote, comma or line break."""
    def field(c):
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)
    return F.concat_ws(",", *[field(c) for c in CSV_COLUMNS])


def csv_export(findings: DataFrame, out: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(out)


DIFF_MODES = ("diff", "commit", "branch_diff", "working_tree")


def coverage_document(coverage: DataFrame) -> DataFrame:
    """Inventory strategy and completeness per scan. ``surfaces`` is an array of dispositions."""
    follow = F.exists("surfaces", lambda s: s == "needs_follow_up")
    return coverage.withColumn("inventory_strategy", F.when(F.col("mode").isin(list(DIFF_MODES)), "diff")
                               .when(F.col("target_kind") == "directory_snapshot", "directory").otherwise("repository")) \
        .withColumn("completeness", F.when((F.col("n_deferred") > 0) | follow, "partial").when(F.col("complete"), "complete").otherwise("unknown"))


# ---- report checks ---------------------------------------------------------------------------------
# ---- fixed values: required headings in order -----------------------------------------------------
SECTIONS = ("## Executive Summary", "## Background", "## Vulnerability Details", "## Exploitability Analysis",
            "## Proof of Concept", "## Remediation", "## Summary")


def section_errors(reports: DataFrame, sections=SECTIONS) -> DataFrame:
    """Missing headings per report. A heading counts only after the previous found one, so this is a
    fold over the headings; each report is one row and no line leaves it.

    Only lines that hold a heading's text are trimmed and compared; a ``\\r`` at a line's end goes with the trim. The fold is one
    expression and the explode an outer one, so that Spark works neither out twice.
    """
    heading = lambda line: reduce(lambda a, b: a | b, [F.contains(line, F.lit(s)) for s in sections])
    lines = F.transform(F.filter(F.split("content", "\n", -1), heading), tx.trim)

    def step(acc, s):
        found = F.array(F.array_position(F.slice(F.col("_l"), acc.at + 1, F.size("_l")), s).cast("int"))
        return F.transform(found, lambda p: F.struct(
            F.when(p > 0, acc.at + p).otherwise(acc.at).alias("at"),
            F.when(p == 0, F.concat(acc.missing, F.array(F.concat(F.lit("Missing required section: "), s)))).otherwise(acc.missing).alias("missing")))[0]
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("missing"))
    missing = F.aggregate(F.array(*[F.lit(s) for s in sections]), none, step, lambda acc: acc.missing)
    return reports.filter("content is not null").withColumn("_l", lines).select("report_id", F.explode_outer(missing).alias("error")).filter("error is not null")


def projection_errors(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """Reportable findings whose report is absent or does not name them."""
    keys = [*scan_keys(findings, reports), "candidate_id"]
    f = findings.filter("disposition = 'reportable'").join(reports.select(*keys, "content"), keys, "left")
    named = F.contains("content", F.concat(F.lit("Finding: `"), "id", F.lit("`")))
    return f.withColumn("error", F.when(F.col("content").isNull(), "no report").when(~named, "report does not name its finding")) \
        .filter("error is not null").select(*keys, "error")


# ---- tickets and advisories ---------------------------------------------------------------------------

def finding_title() -> Column:
    return F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("title"))


def finding_marker(tool: str = MARKER_TOOL) -> Column:
    return F.concat(F.lit(f"<!-- {tool} finding:"), F.col("id"), F.lit(" fingerprint:"), F.col("fingerprint"), F.lit(" -->"))


def ticket_rows(findings: DataFrame, provider: str = "github", tool: str = MARKER_TOOL) -> DataFrame:
    """Title, body, marker and request digest of each reportable finding."""
    f = findings.filter("disposition = 'reportable'").withColumn("marker", finding_marker(tool)).withColumn("ticket_title", finding_title())
    body = F.concat(F.lit("## Summary\n"), "root_cause", F.lit("\n\n## Evidence\n- Severity: "), "severity", F.lit("\n- CWE: "), "cwe",
                    F.lit("\n- Confidence: "), "confidence", F.lit("\n- Location: "), "file", F.lit(":"), F.col("line").cast("string"),
                    F.lit("\n\n## Validation\n"), "validation", F.lit("\n\n## Attack Path\n"), "attack_path", F.lit("\n\n## Impact\n"), "impact",
                    F.lit("\n\n## Remediation\n"), "remediation", F.lit("\n\n"), "marker")
    f = f.withColumn("body", body)
    ask = F.to_json(F.struct(F.lit(provider).alias("provider"), F.col("ticket_title").alias("title"), tx.sha256(F.col("body")).alias("bodySha256")))
    return f.select("id", "fingerprint", F.col("ticket_title").alias("title"), "body", "marker", F.concat(F.lit("sha256:"), tx.sha256(ask)).alias("request_digest"))


MARKER_PATTERN = r"finding:(\S+) fingerprint:(\S+) -->"


def duplicate_tickets(tickets: DataFrame, issues: DataFrame) -> DataFrame:
    """Per ticket and kind of match (marker in the body, same title): the smallest issue id and how many issues match.

    Markers are pulled out of the bodies once, so both conditions are equi-joins; issues of one title are counted before the join, so
    a title that a million tickets and issues share costs one row a ticket.
    """
    titles = issues.groupBy("title").agg(F.min("id").alias("issue_id"), F.count("*").alias("n_issues"))
    by_title = tickets.select("id", "title").join(titles, "title").select("id", F.lit("title").alias("matched_by"), "issue_id", "n_issues")
    marks = issues.select(F.col("id").alias("issue_id"), F.explode(F.regexp_extract_all("body", F.lit(MARKER_PATTERN), 0)).alias("m")) \
        .select("issue_id", F.regexp_extract("m", MARKER_PATTERN, 1).alias("id"), F.regexp_extract("m", MARKER_PATTERN, 2).alias("fingerprint"))
    marked = marks.distinct().groupBy("id", "fingerprint").agg(F.min("issue_id").alias("issue_id"), F.count("*").alias("n_issues"))
    by_mark = tickets.select("id", "fingerprint").join(marked, ["id", "fingerprint"]).select("id", F.lit("marker").alias("matched_by"), "issue_id", "n_issues")
    return by_mark.unionByName(by_title)


def latest_receipt(receipts: DataFrame) -> DataFrame:
    """Latest successful tracking receipt per (provider, scan, finding)."""
    ok = receipts.filter(F.col("status").isin("created", "created_unverified", "duplicate"))
    rest = [c for c in receipts.columns if c not in ("provider", "scan_id", "finding_id")]
    return ok.groupBy("provider", "scan_id", "finding_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("r")) \
        .select("provider", "scan_id", "finding_id", "r.*")


def readback_status(created: DataFrame, readback: DataFrame) -> DataFrame:
    """Created tickets verified against landed responses: same id, same title, marker in the body."""
    j = created.join(readback.select("external_id", F.col("title").alias("r_title"), F.col("body").alias("r_body")), "external_id", "left")
    read = F.col("r_title").isNotNull() | F.col("r_body").isNotNull()
    title_ok, body_ok = F.col("r_title") == F.col("title"), F.contains("r_body", F.col("marker"))
    good = read & F.coalesce(title_ok & body_ok, F.lit(False))
    return j.select("external_id", read.alias("found"), F.coalesce(title_ok, F.lit(False)).alias("title_matched"),
                    F.coalesce(body_ok, F.lit(False)).alias("body_matched"),
                    F.when(good, "created").otherwise("created_unverified").alias("status"))


def advisory_rows(findings: DataFrame, scans: DataFrame, tool: str = MARKER_TOOL) -> DataFrame:
    """Advisory payload rows of reportable findings from clean immutable revisions of a known repository."""
    clean = (F.col("kind") == "git_revision") & F.col("source_repository").rlike(r"^[^/]+/[^/]+\z") & F.col("revision").rlike(r"(?i)^[0-9a-f]{40,64}\z")
    src = scans.filter(clean).select("scan_id", "source_repository", "revision")
    f = findings.filter("disposition = 'reportable'").join(src, "scan_id")
    marker = F.concat(F.lit(f"<!-- {tool} advisory finding:"), "id", F.lit(" fingerprint:"), "fingerprint", F.lit(" source:"),
                      "source_repository", F.lit("@"), "revision", F.lit(" -->"))
    return f.select("scan_id", "id", "source_repository", "revision", F.substring(finding_title(), 1, 1024).alias("summary"), marker.alias("marker"),
                    F.when(F.col("severity") == "informational", "low").otherwise(F.col("severity")).alias("severity"),
                    F.when(F.col("cwe").rlike(r"(?i)^CWE-[0-9]+\z"), F.upper("cwe")).alias("cwe_id"))


ADVISORY_PATTERN = r"<!-- \S+ advisory finding:\S+ fingerprint:\S+ source:\S+ -->"


def advisory_duplicates(rows: DataFrame, advisories: DataFrame) -> DataFrame:
    """Advisory rows whose marker stands in the description of a landed advisory ``(advisory_id, description)``: the smallest id and the count.

    Markers are pulled out of the descriptions once, so this is an equi-join on the marker.
    """
    marks = advisories.select("advisory_id", F.explode(F.regexp_extract_all("description", F.lit(ADVISORY_PATTERN), 0)).alias("marker")).distinct()
    known = marks.groupBy("marker").agg(F.min("advisory_id").alias("advisory_id"), F.count("*").alias("n_advisories"))
    return rows.join(known, "marker").select("scan_id", "id", "advisory_id", "n_advisories")


def disclosure_errors(reports: DataFrame, references: DataFrame, sources: DataFrame) -> DataFrame:
    """Error rows: citation outside an assigned path or line, short explanation, unbacked execution claim, thin field.

    ``reports(report_id, authorized, status, n_artifacts, <text fields>)``,
    ``references(report_id, path, line, explanation)``, ``sources(report_id, path, n_lines)``.
    """
    texts = [f.name for f in reports.schema.fields if f.dataType.simpleString() == "string" and f.name not in ("report_id", "status")]
    thin = tx.compact(*[F.when(F.length(tx.trim(F.coalesce(F.col(t), F.lit("")))) < 12, F.lit(f"{t} must contain substantive evidence")) for t in texts])
    claims = tx.compact(
        F.when(~F.col("status").isin("not_run", "built_only", "executed_safely"), "status is invalid"),
        F.when(~F.col("authorized") & (F.col("status") == "executed_safely"), "execution not authorized"),
        F.when(F.col("authorized") & (F.col("status") == "executed_safely") & (F.col("n_artifacts") == 0), "execution needs an artifact"))
    own = reports.select("report_id", F.explode(F.concat(thin, claims)).alias("error"))
    uncited = reports.select("report_id").join(references.select("report_id").distinct(), "report_id", "left_anti") \
        .select("report_id", F.lit("no source reference").alias("error"))
    j = references.join(sources, ["report_id", "path"], "left")
    ok = F.col("n_lines").isNotNull() & (F.col("line") >= 1) & (F.col("line") <= F.col("n_lines")) & (F.length(tx.trim(F.col("explanation"))) >= 8)
    stray = j.filter(~F.coalesce(ok, F.lit(False))).select("report_id", F.lit("citation not in an assigned source").alias("error")).distinct()
    return own.unionByName(uncited).unionByName(stray)

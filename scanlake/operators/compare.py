"""Scan comparison, seals, snapshot digests, drift, bundle checks, remediation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.scans import scan_keys

SNAPSHOT_PREFIX = "scanlake-snapshot/v2:sha256:"


def compare_scans(before: DataFrame, after: DataFrame, complete: bool | Column = True) -> DataFrame:
    """Full outer join on fingerprint: new, persisting, reopened, resolved or unknown.

    Both sides are first reduced to one row per fingerprint (the last by ``ord``), so a
    repeated fingerprint costs a partial aggregation instead of a multiplied join.
    """
    last = lambda df, p: df.groupBy("fingerprint").agg(F.max_by(F.struct("id", "status"), "ord").alias(p))
    both = last(before, "b").join(last(after, "a"), "fingerprint", "full_outer")
    whole = F.lit(complete) if isinstance(complete, bool) else complete
    closed = F.col("b.status").isin("resolved", "false_positive")
    return both.select(
        "fingerprint", F.coalesce("a.id", "b.id").alias("id"),
        F.when(F.col("b").isNull(), "new")
        .when(F.col("a").isNull(), F.when(whole, "resolved").otherwise("unknown"))
        .when(closed & (F.col("a.status") == "open"), "reopened").otherwise("persisting").alias("change"))


def seal(df: DataFrame, exclude: str = "seal") -> Column:
    """Hash of the record without its seal: field order pinned by name, nulls kept."""
    names = sorted(c for c in df.columns if c != exclude)
    return tx.sha256(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


def scan_history(scans: DataFrame) -> DataFrame:
    """Rows whose seal verifies, newest first."""
    return scans.filter(F.col("seal") == seal(scans)).orderBy(F.desc("created_at"), "id")


def snapshot_digest(receipts: DataFrame) -> DataFrame:
    """One digest per scan over its (path, sha256) list: a hash per bucket (first three hex digits of the path's hash) of its
    sorted entries, then one over the buckets. The same at every size; a task holds 1/4096 of a scan."""
    entry = F.concat("path", F.lit("\0"), "sha256")
    r = receipts.select("scan_id", F.substring(tx.sha256(F.col("path")), 1, 3).alias("bucket"), entry.alias("e"))
    parts = r.groupBy("scan_id", "bucket").agg(F.count("*").alias("n"), tx.sha256(F.array_join(F.array_sort(F.collect_list("e")), "\n")).alias("d"))
    tops = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "d"))), "\n")
    return parts.groupBy("scan_id").agg(F.sum("n").alias("n_files"), F.concat(F.lit(SNAPSHOT_PREFIX), tx.sha256(tops)).alias("digest"))


def drift(receipts: DataFrame, files: DataFrame) -> DataFrame:
    """Per scan the receipts whose file is missing or changed, and files without a receipt."""
    now = files.select("scan_id", "path", tx.sha256(F.col("content")).alias("now_sha"))
    both = receipts.select("scan_id", "path", F.col("sha256").alias("old_sha")).join(now, ["scan_id", "path"], "full_outer")
    state = F.when(F.col("now_sha").isNull(), "missing").when(F.col("old_sha").isNull(), "unreceipted") \
        .when(F.col("old_sha") != F.col("now_sha"), "changed")
    return both.withColumn("state", state).filter("state is not null").select("scan_id", "path", "state")


# ---- bundle verification ---------------------------------------------------------------------
# ---- fixed values: largest canonical documents, in characters ------------------------------
SIZE_LIMITS = {"scan-manifest.json": 16 * 1024 * 1024, "findings.json": 128 * 1024 * 1024, "coverage.json": 32 * 1024 * 1024}


def artifact_manifest(artifacts: DataFrame) -> DataFrame:
    """path, sha256, media type of retained artifacts; derived reports are not evidence."""
    p = F.col("path")
    derived = (p == "report.md") | (p == "scan-manifest.json") | F.startswith(p, F.lit("findings/")) | F.startswith(p, F.lit("hardening/"))
    is_json = p.rlike(r"\.(?:json|jsonl|sarif)\z")
    return artifacts.filter(~derived).select(
        "scan_id", "path", tx.sha256(F.col("content")).alias("sha256"),
        F.when(is_json, "application/json").otherwise("text/markdown").alias("media_type"))


def manifest_errors(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Digest mismatch, invalid, repeated, unsealed and missing artifacts, as error rows."""
    ok = F.col("path").isNotNull() & (F.col("path") != "") & F.col("sha256").rlike(r"^[a-f0-9]{64}\z")
    bad = manifest.filter(~F.coalesce(ok, F.lit(False))).select("scan_id", "path", F.lit("invalid descriptor").alias("error"))
    good = manifest.filter(ok)
    per = good.groupBy("scan_id", "path").agg(F.count("*").alias("n"), F.collect_set("sha256").alias("shas"))
    repeated = per.filter("n > 1").select("scan_id", "path", F.lit("repeated").alias("error"))
    have = actual.select("scan_id", "path", F.col("sha256").alias("now"))
    both = per.join(have, ["scan_id", "path"], "full_outer")
    other = both.withColumn("error", F.when(F.col("now").isNull(), "missing").when(F.col("shas").isNull(), "not sealed")
                            .when(F.exists("shas", lambda s: s != F.col("now")), "digest mismatch")).filter("error is not null")
    return bad.unionByName(repeated).unionByName(other.select("scan_id", "path", "error"))


def size_errors(artifacts: DataFrame, limits: dict[str, int] = SIZE_LIMITS) -> DataFrame:
    limit = tx.lookup(limits, F.col("path"))
    return artifacts.filter(F.length("content") > limit).select("scan_id", "path", F.lit("too large").alias("error"))


def receipt_gaps(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates without a discovery or validation receipt, or reportable without an attack path."""
    keys = [*scan_keys(findings, ledger), "candidate_id"]
    seen = ledger.groupBy(*keys).agg(
        *[F.bool_or(F.col("phase") == p).alias(p) for p in ("discovery", "validation", "attack_path")])
    f = findings.select(*keys, "disposition").join(seen, keys, "left")
    lacks = lambda p: ~F.coalesce(F.col(p), F.lit(False))
    gaps = tx.compact(F.when(lacks("discovery"), "no discovery receipt"), F.when(lacks("validation"), "no validation receipt"),
                      F.when((F.col("disposition") == "reportable") & lacks("attack_path"), "no attack-path receipt"))
    return f.select(*keys, F.explode(gaps).alias("error"))


def stale_digests(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Reportable findings whose stored evidence digest is absent or differs from the fresh one."""
    keys = [*scan_keys(stored, fresh), "id"]
    j = fresh.join(stored.select(*keys, F.col("digest").alias("old")), keys, "left")
    return j.withColumn("error", F.when(F.col("old").isNull(), "no report").when(F.col("old") != F.col("digest"), "stale")) \
        .filter("error is not null").select(*keys, "error")


# ---- remediation ----------------------------------------------------------------------------------

def remediation_verdict(findings: DataFrame, rescan: DataFrame) -> DataFrame:
    """Is the same rule still found in the same file? Any location of a rescan finding counts."""
    scan = scan_keys(findings, rescan)
    again = rescan.select(*scan, "rule_id", F.explode("locations").alias("l")).select(*scan, "rule_id", F.col("l.file").alias("file")) \
        .distinct().withColumn("_hit", F.lit(True))
    return findings.join(again, [*scan, "rule_id", "file"], "left").select(
        *findings.columns, F.when(F.col("_hit"), "still_detected").otherwise("not_detected").alias("verdict"))


# ---- fixed values: mechanical rewrites per rule, in order -----------------------------------------
SAFE_REWRITES = {
    "tls.verification.disabled": (
        (r"rejectUnauthorized\s*:\s*false", "rejectUnauthorized: true"), (r"verify\s*=\s*False", "verify = True"),
        (r"InsecureSkipVerify\s*:\s*true", "InsecureSkipVerify: false"),
        (r"CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0)", "CURLOPT_SSL_VERIFYPEER, 1")),
    "jwt.verification.disabled": ((r"""(["']?verify_signature["']?\s*[:=]\s*)False""", "$1True"),),
}


def safe_rewrites(files: DataFrame, findings: DataFrame, rewrites=SAFE_REWRITES) -> DataFrame:
    """New content per (finding file, rule) where a mechanical rewrite changes something."""
    keys = [*scan_keys(files, findings), "path"]
    wanted = findings.filter(F.col("rule_id").isin(list(rewrites))).withColumnRenamed("file", "path").select(*keys, "rule_id").distinct()
    j = files.select(*keys, "content").join(wanted, keys)
    new = F.col("content")
    for rule, steps in rewrites.items():
        fixed = F.col("content")
        for pattern, to in steps:
            fixed = F.regexp_replace(fixed, pattern, to)
        new = F.when(F.col("rule_id") == rule, fixed).otherwise(new)
    return j.withColumn("new_content", new).filter("new_content <> content") \
        .select(*keys, "rule_id", "content", "new_content")


def apply_replacements(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """Exact-range replacements: one error or the new content per request row.

    ``replacements(request_id, path, start_line, end_line, expected_text, replacement_text,
    base_sha256)``. The range is cut from the file's own line array, so the join is one
    equi-join on scan and path and nothing is exploded.
    """
    scan = scan_keys(files, replacements)
    per = replacements.groupBy(*scan, "request_id").agg(F.count("*").alias("_n"), F.countDistinct("path").alias("_files"))
    j = replacements.join(per, [*scan, "request_id"]).join(files.select(*scan, "path", "content"), [*scan, "path"], "left")
    j = j.withColumn("_lines", tx.split_lines(F.col("content")))
    n = F.size("_lines")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    bad_text = lambda c: (F.length(text(c)) == 0) | (F.length(text(c)) > 100_000) | F.contains(text(c), F.lit("\r"))
    span = F.array_join(F.slice("_lines", F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    error = F.when(F.col("_n") > 20, "more than twenty changes").when(F.col("_files") < F.col("_n"), "one replacement per file") \
        .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") - F.col("start_line") > 199), "invalid range") \
        .when(bad_text("expected_text") | bad_text("replacement_text"), "invalid text") \
        .when(F.col("content").isNull(), "file has no receipt") \
        .when(tx.sha256(F.col("content")) != F.col("base_sha256"), "stale") \
        .when(F.col("end_line") > n, "range outside file") \
        .when(span != F.col("expected_text"), "expected text differs")
    rest = F.slice("_lines", F.col("end_line") + 1, F.greatest(n - F.col("end_line"), F.lit(0)))
    new = F.array_join(F.concat(F.slice("_lines", F.lit(1), F.greatest(F.col("start_line") - 1, F.lit(0))), F.split("replacement_text", "\n", -1), rest), "\n")
    return j.withColumn("error", error).select(
        *scan, "request_id", "path", "error", F.when(F.col("error").isNull(), new).alias("new_content"))



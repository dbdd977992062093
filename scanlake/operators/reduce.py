"""Observation reduction, identities and review-round merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..functions.scans import job_keys
from ..scale import stable

CANDIDATE_KEY = ["scan_id", "rule", "file", "line", "excerpt"]


def observation_evidence(candidates: DataFrame) -> DataFrame:
    """Distinct evidence per observation, as rows with the order in which each was first seen.

    Everything but the order is a grouping key and the order is a pair, so this is an
    aggregation with a map-side half: a hot observation shrinks before it moves. A candidate
    without evidence keeps one row with a null kind.
    """
    e = candidates.select(*CANDIDATE_KEY, "ord", "severity", "rationale", "cwe", F.posexplode_outer("evidence").alias("pos", "e"))
    e = e.select(*CANDIDATE_KEY, "severity", "rationale", "cwe", F.col("e.kind").alias("kind"), F.col("e.detail").alias("detail"), F.col("e.location").alias("location"),
                 F.struct(F.col("ord").cast("bigint").alias("ord"), F.coalesce("pos", F.lit(0)).alias("pos")).alias("seen"))
    return e.groupBy(*CANDIDATE_KEY, "severity", "rationale", "cwe", "kind", "detail", "location").agg(F.min("seen").alias("seen"))


def dedupe_observations(candidates: DataFrame) -> DataFrame:
    """One row per (rule, file, line, excerpt): first candidate's fields, union of distinct evidence.

    The distinct evidence of a line comes to one task, where ``reduce_candidates`` then groups without moving the arrays again.
    """
    meta = F.struct("severity", "rationale", "cwe")
    g = observation_evidence(candidates).repartition("file", "line").groupBy(*CANDIDATE_KEY).agg(
        F.array_sort(F.collect_list(F.struct("seen", "severity", "rationale", "cwe", "kind", "detail", "location"))).alias("all"),
        (F.min(meta) == F.max(meta)).alias("same"))
    notes = F.transform(F.filter("all", lambda x: x.kind.isNotNull()),
                        lambda x: F.struct(x.kind.alias("kind"), x.detail.alias("detail"), x.location.alias("location")))
    first = F.col("all")[0]
    return g.select("scan_id", "rule", first["severity"].alias("severity"), "file", "line", "excerpt", first["rationale"].alias("rationale"),
                    first["cwe"].alias("cwe"), F.when(F.col("same"), notes).otherwise(F.array_distinct(notes)).alias("evidence"),
                    first["seen"]["ord"].alias("ord"))


def dedupe_locations(locations: Column) -> Column:
    """Distinct (file, line, role): the first keeps its place, the last gives the value."""
    key = lambda x: tx.joined(x.file, x.line, F.coalesce(x.role, F.lit("root_control")))
    keys = F.array_distinct(F.transform(locations, key))
    return F.transform(keys, lambda k: F.element_at(F.filter(locations, lambda x: key(x) == k), -1))


def to_findings(candidates: DataFrame) -> DataFrame:
    """Project candidates to discovery-stage findings."""
    contextual = F.exists("evidence", lambda e: e.kind == "context")
    own = F.struct(F.col("file"), F.col("line"), F.col("excerpt"), F.lit("root_control").alias("role"))
    places = F.concat(F.array(own), F.filter(F.transform("evidence", lambda e: e.location), lambda x: x.isNotNull()))
    return candidates.select(
        "scan_id", tx.candidate_id(F.col("scan_id"), F.col("rule"), F.col("file"), F.col("line")).alias("candidate_id"),
        F.replace(F.col("rule"), F.lit("-"), F.lit(".")).alias("rule_id"),
        F.replace(F.col("rule"), F.lit("-"), F.lit(" ")).alias("title"), "severity",
        F.when(contextual & (F.col("rule") == "tls-verification-disabled"), "medium").otherwise("low").alias("confidence"),
        "cwe", F.lit("open").alias("status"), F.lit("discovered").alias("disposition"), "file", "line", "excerpt",
        dedupe_locations(places).alias("locations"), F.col("rationale").alias("root_cause"), "evidence", "ord")


def reduce_candidates(findings: DataFrame) -> DataFrame:
    """One finding per (rule, file, line): later evidence appended, locations merged.

    Run after ``dedupe_observations``: the group then holds only the distinct excerpts of one line.
    """
    key = ["scan_id", "rule_id", "file", "line"]
    resolved = F.exists("evidence", lambda e: F.startswith(e.detail, F.lit("AST resolved")))
    one = F.struct("ord", "candidate_id", "title", "severity", "confidence", "cwe", "status", "disposition", "excerpt",
                   "locations", "root_cause", "evidence", resolved.alias("resolved"))
    g = findings.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("all"))
    first = F.col("all")[0]
    override = F.filter("all", lambda x: x.resolved & (x.ord > F.col("all")[0].ord))
    return g.select(
        *key, first["candidate_id"].alias("candidate_id"), first["title"].alias("title"),
        first["severity"].alias("severity"), first["confidence"].alias("confidence"), first["cwe"].alias("cwe"),
        first["status"].alias("status"), first["disposition"].alias("disposition"), first["excerpt"].alias("excerpt"),
        dedupe_locations(F.flatten(F.transform("all", lambda x: x.locations))).alias("locations"),
        F.coalesce(F.get(F.transform(override, lambda x: x.root_cause), F.size(override) - 1), first["root_cause"]).alias("root_cause"),
        F.flatten(F.transform("all", lambda x: x.evidence)).alias("evidence"))


def assign_identities(findings: DataFrame, target_id: str | Column) -> DataFrame:
    """Stable identity: anchor from rule and root excerpt, instance from path-free semantic text.

    Within a group of exact twins the first by (file, line) keeps the plain instance, the next
    one of each other file adds its path, further ones of a file add the line too. "First" is a
    ``min`` aggregate joined back, not a window, so a group of copies of any size stays split.
    """
    target = F.lit(target_id) if isinstance(target_id, str) else target_id
    rooted = F.filter("locations", lambda x: x.role.isin("root_control", "sink"))
    f = findings.withColumn("_root", F.coalesce(F.get(rooted, F.lit(0)), F.get(F.col("locations"), F.lit(0))))
    root_text = F.coalesce(F.col("_root.excerpt"), F.col("root_cause"))
    f = f.withColumn("anchor", tx.slug(F.concat_ws(":", "rule_id", root_text)))
    clean = lambda e: F.concat_ws(":", e.kind, F.coalesce(e.location.excerpt, F.lit("")),
                                  F.regexp_replace(e.detail, r"(?:^|\s)[\w./-]+:\d+(?=\s|\z)", ""))
    body = F.array_join(F.transform("evidence", clean), "\n")
    base = tx.trim(tx.squeeze(F.concat_ws("\n", "rule_id", F.coalesce(F.col("_root.excerpt"), F.lit("")), "root_cause", body)))
    f = f.withColumn("_base", base).withColumn("_plain", tx.sha256(F.col("_base")))
    return _with_instances(stable(f), target)  # grouped twice and joined: written once


def _with_instances(f: DataFrame, target: Column) -> DataFrame:
    group = ["scan_id", "rule_id", "anchor", "_plain"]
    heads = f.groupBy(*group).agg(F.min(F.struct("file", "line")).alias("_head"), F.count("*").alias("_n"))
    twins = heads.filter("_n > 1").drop("_n")
    f = f.join(twins, group, "left").withColumn(
        "_first", F.col("_head").isNull() | (F.struct("file", "line") == F.col("_head")))
    per_file = f.filter("not _first").groupBy(*group, "file").agg(F.min("line").alias("_file_line"))
    f = f.join(per_file, [*group, "file"], "left")
    root_file = F.coalesce(F.col("_root.file"), F.lit(""))
    root_line = F.coalesce(F.col("_root.line"), F.lit(0)).cast("string")
    by_file = F.concat(F.lit("source-"), F.substring(tx.sha256(F.concat_ws(":", "_base", root_file)), 1, 20))
    by_line = F.concat(F.lit("source-"), F.substring(tx.sha256(F.concat_ws(":", "_base", root_file, root_line, by_file)), 1, 20))
    plain = F.concat(F.lit("instance-"), F.substring("_plain", 1, 20))
    f = f.withColumn("instance", F.when(F.col("_first"), plain).when(F.col("line") == F.col("_file_line"), by_file).otherwise(by_line))
    return f.withColumn("fingerprint", tx.finding_fingerprint(target, F.col("rule_id"), F.col("anchor"), F.col("instance"))) \
        .withColumn("id", tx.finding_id(target, F.col("rule_id"), F.col("anchor"), F.col("instance"))) \
        .drop("_root", "_base", "_plain", "_head", "_first", "_file_line")


# ---- normalised candidates ------------------------------------------------------------------

def _identity(cwe_ids: str, instance: str, locations: str) -> Column:
    """Canonical JSON, keys in alphabetical order, a missing instance kept as null."""
    return F.to_json(F.struct(F.col(cwe_ids).alias("cwe_ids"), F.col(instance).alias("instance"),
                              F.col(locations).alias("locations")), {"ignoreNullFields": "false"})


def combine_candidates(c: DataFrame) -> DataFrame:
    """Merge candidates of equal identity; each text becomes its sorted distinct values, one per line.

    Distinct values are taken by partial aggregation first, so copies never reach one task.
    """
    c = c.withColumn("identity", _identity("cwe_ids", "instance", "locations"))
    heads = c.groupBy("identity").agg(F.first("cwe_ids").alias("cwe_ids"), F.first("locations").alias("locations"),
                                      F.max("instance").alias("instance"))
    parts = c.select("identity", F.explode(F.create_map(
        F.lit("summary"), F.col("summary"), F.lit("evidence"), F.col("evidence"), F.lit("context"), F.col("context")))
        .alias("part", "value")).filter("value <> ''").distinct()
    texts = parts.groupBy("identity").agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("value")))), "\n").alias(p)
        for p in ("summary", "evidence", "context")])
    return heads.join(texts, "identity", "left").select(
        F.concat(F.lit("candidate-"), F.substring(tx.sha256(F.col("identity")), 1, 16)).alias("candidate_id"),
        "cwe_ids", "locations", F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.when(F.col("context") != "", F.col("context")).alias("context"), "instance", "identity")


# ---- review rounds -----------------------------------------------------------------------------

def report_fingerprint(rule: Column, file: Column, line: Column, shown: Column, identity: Column) -> Column:
    return tx.sha256(F.concat_ws(":", rule, file, line.cast("string"), tx.squeeze(shown), identity))


def remediation_identity(stated: Column, root_cause: Column) -> Column:
    """The stated identity, or the root cause in one lower-case line, in full."""
    own = tx.trim(F.coalesce(stated, F.lit("")))
    derived = F.concat(F.lit("root-control:"), F.lower(tx.squeeze(root_cause)))
    return F.when(own != "", own).otherwise(derived)


def merge_reports(reports: DataFrame, job_id: str = "deep") -> DataFrame:
    """Equal fingerprints become one candidate with its distinct workers and report ids."""
    r = reports.withColumn("identity", remediation_identity(F.col("remediation_identity"), F.col("root_cause"))) \
        .filter(F.length("identity") >= 8)
    r = r.withColumn("fingerprint", report_fingerprint(F.col("rule_id"), F.col("file"), F.col("line"), F.col("excerpt"), F.col("identity")))
    short = lambda prefix: F.concat(F.lit(prefix), F.substring(tx.sha256(tx.joined(F.lit(job_id), "worker_id", "fingerprint")), 1, 24))
    per_worker = r.groupBy("fingerprint", "worker_id", "rule_id", "file", "line", "excerpt", "identity").agg(
        F.min("seq").alias("seq")).withColumn("report_id", short("deepreport_")).withColumn("candidate_id", short("deepcand_"))
    return per_worker.groupBy("fingerprint", "rule_id", "file", "line", "excerpt", "identity").agg(
        F.min_by("candidate_id", F.struct("seq", "worker_id")).alias("candidate_id"),
        F.array_sort(F.collect_set("worker_id")).alias("worker_ids"),
        F.array_sort(F.collect_set("report_id")).alias("report_ids")) \
        .withColumn("decision", F.when(F.size("report_ids") > 1, "merged_equivalent_reports").otherwise("not_merged"))


def merge_errors(candidates: DataFrame, merges: DataFrame) -> DataFrame:
    """Reducer rows that must be refused: unknown target or source, self merge, absorbed twice or as a target."""
    ids = candidates.select(F.col("id").alias("known"))
    m = merges.join(ids.select(F.col("known").alias("target_id"), F.lit(True).alias("_t")), "target_id", "left") \
        .join(ids.select(F.col("known").alias("absorbed_id"), F.lit(True).alias("_a")), "absorbed_id", "left")
    twice = merges.groupBy("absorbed_id").agg(F.count("*").alias("_times"))
    gone = merges.select(F.col("absorbed_id").alias("target_id"), F.lit(True).alias("_gone")).distinct()
    m = m.join(twice, "absorbed_id", "left").join(gone, "target_id", "left")
    return m.withColumn("error", F.when(F.col("_t").isNull(), "unknown target")
                        .when(F.col("_a").isNull(), "unknown source")
                        .when(F.col("target_id") == F.col("absorbed_id"), "self merge")
                        .when(F.col("_times") > 1, "already absorbed")
                        .when(F.col("_gone"), "target is absorbed")
                        .when(F.length(tx.trim(F.coalesce("rationale", F.lit("")))) == 0, "rationale required")) \
        .filter("error is not null").select("target_id", "absorbed_id", "error")


def apply_merges(candidates: DataFrame, members: DataFrame, merges: DataFrame) -> DataFrame:
    """Absorb candidates into their target; ``members(id, worker_id, report_id)`` roll up as distinct rows."""
    ok = merges.join(merge_errors(candidates, merges), ["target_id", "absorbed_id"], "left_anti")
    into = ok.select(F.col("absorbed_id").alias("id"), F.col("target_id").alias("absorbed_by"))
    rolled = members.join(into, "id", "left").select(F.coalesce("absorbed_by", "id").alias("id"), "worker_id", "report_id").distinct()
    sizes = rolled.groupBy("id").agg(F.countDistinct("worker_id").alias("n_workers"), F.countDistinct("report_id").alias("n_reports"))
    return candidates.join(into, "id", "left").join(sizes, "id", "left")


def round_status(workers: DataFrame) -> DataFrame:
    """A round (of a job) is complete only when every worker completed and reported."""
    done = (F.col("status") == "completed") & F.col("has_report")
    return workers.groupBy(*job_keys(workers), "round").agg(
        F.count("*").alias("n_workers"),
        F.when(F.bool_and(done), "complete").otherwise("incomplete").alias("status"))


def canonical_candidates(candidates: DataFrame, sightings: DataFrame, rounds: DataFrame) -> DataFrame:
    """Not absorbed, and seen by a worker of a complete round. ``sightings(id, round)``; with ``job_id`` all within one job."""
    job = job_keys(candidates, sightings, rounds)
    good = sightings.join(rounds.filter("status = 'complete'").select(*job, "round"), [*job, "round"], "left_semi").select(*job, "id").distinct()
    return candidates.filter("absorbed_by is null").join(good, [*job, "id"], "left_semi")


def round_saturation(sightings: DataFrame, rounds: DataFrame, stop_after: int = 6, max_rounds: int | None = None) -> DataFrame:
    """New fingerprints per complete round, the zero streak, and where the run stops; per job where the tables carry ``job_id``.

    Incomplete rounds count nothing and teach nothing. The windows run over the rounds of one job (a handful
    of rows), never over sightings. With ``max_rounds`` later rounds are marked ``capped``; none is left out.
    """
    job = job_keys(sightings, rounds)
    key = [*job, "round"]
    known = sightings.join(rounds.filter("status = 'complete'").select(*key), key, "left_semi")
    first = known.groupBy(*job, "fingerprint").agg(F.min("round").alias("round"))
    fresh = first.groupBy(*key).agg(F.count("*").alias("novelty"))
    total = sightings.groupBy(*key).agg(F.countDistinct("fingerprint").alias("candidates"))
    r = rounds.join(fresh, key, "left").join(total, key, "left") \
        .select(*key, "status", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("novelty", F.lit(0)).alias("novelty"))
    w = W.partitionBy(*(job or [F.lit(1)])).orderBy("round")
    breaks = F.sum(F.when((F.col("status") == "complete") & (F.col("novelty") > 0), 1).otherwise(0)).over(w)
    r = r.withColumn("_island", breaks)
    quiet = F.when((F.col("status") == "complete") & (F.col("novelty") == 0), 1).otherwise(0)
    r = r.withColumn("streak", F.sum(quiet).over(W.partitionBy(*job, "_island").orderBy("round")))
    done = F.sum(F.when(F.col("status") == "complete", 1).otherwise(0)).over(w)
    r = r.withColumn("_done", done)
    return r.withColumn("state", F.when(F.col("status") != "complete", "incomplete")
                        .when((F.col("novelty") == 0) & (F.col("streak") >= stop_after), "saturated")
                        .when(F.lit(max_rounds is not None) & (F.col("_done") >= (max_rounds or 0)), "capped").otherwise("running")).drop("_island", "_done")


def append_candidates(findings: DataFrame, reported: DataFrame, scan_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reported candidates not yet present, with one ledger row and one validation task each; of several reports of one fingerprint the smallest."""
    one = reported.groupBy("fingerprint").agg(F.min(F.struct(*reported.columns)).alias("r")).select("r.*")
    fresh = one.join(findings.select("fingerprint"), "fingerprint", "left_anti")
    cand = tx.candidate_id(F.lit(scan_id), F.col("rule_id"), F.col("file"), F.col("line"))
    fresh = fresh.withColumn("candidate_id", cand)
    ledger = fresh.select("candidate_id", F.lit("discovery").alias("phase"), F.lit("discovered").alias("disposition"),
                          F.concat(F.lit("Delegated workers reported "), "rule_id", F.lit(".")).alias("summary"))
    return fresh, ledger, validation_tasks(fresh.withColumn("scan_id", F.lit(scan_id)))


def validation_tasks(findings: DataFrame) -> DataFrame:
    """One pending validation task per finding, with a hash id."""
    key = tx.joined("scan_id", "candidate_id", F.lit("validation"))
    focus = F.concat(F.lit("Validate "), "title",
                     F.lit(": establish attacker, entrypoint, trust boundary, root control, sink, impact, and counterevidence."))
    return findings.select("scan_id", F.concat(F.lit("task_"), F.substring(tx.sha256(key), 1, 24)).alias("id"),
                           "candidate_id", F.lit("validation").alias("phase"), focus.alias("focus"), F.lit("pending").alias("status"))



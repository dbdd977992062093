"""Backlog triage end to end: imported claims, local candidates and manifests -> ranked items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import classify as cl, triage as tr
from ..sources import manifests


def triage_claims(imported: DataFrame, files: DataFrame, candidates: DataFrame) -> DataFrame:
    """All claims with verdict, gaps, next step and rank; claims join local evidence left, so none is lost."""
    claims = tr.with_families(imported)
    matched = tr.triage_status(tr.match_imported(claims, candidates, files))
    declared = manifests.manifest_dependencies(files)
    evidence = tr.dependency_evidence(matched, declared, manifests.lock_dependencies(files, declared))
    policy = files.filter(F.col("path").isin("SECURITY.md", ".github/SECURITY.md"))
    items = tr.dependency_status(matched, evidence).join(cl.runtime_boundary(policy), "scan_id", "left")
    judged = tr.triage_backlog(items, F.coalesce("runtime_in_scope", F.lit(False)))
    return tr.stack_rank(judged.drop("runtime_in_scope"))

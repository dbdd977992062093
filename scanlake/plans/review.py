"""Diff review end to end: patches plus current files -> findings anchored to the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..operators import diffs as df, patterns as pt, reduce as rd, workflows as wf
from ..scale import stable
from .scan import configuration_candidates, semantic_candidates, union


def review_diffs(patches: DataFrame, current: DataFrame, target_id: str | Column, go_mods: DataFrame | None = None) -> DataFrame:
    """Added-line rules, removed controls, workflow rules, and whole-corpus jobs kept where they touch an added line.

    Settings are judged on the current text of changed files, flows on all current files, since a
    new call may reach an old sink.
    """
    lines = stable(df.parse_diffs(patches))
    added = stable(df.added_lines(lines))
    changed = current.join(added.select("scan_id", "path").distinct(), ["scan_id", "path"], "left_semi")
    touched = df.touching_added(union(configuration_candidates(changed), semantic_candidates(current, go_mods)), added)
    found = union(df.scan_added(lines), pt.removed_controls(lines), wf.workflow_candidates(changed, added), touched)
    return rd.assign_identities(rd.reduce_candidates(rd.to_findings(rd.dedupe_observations(stable(found)))), target_id)

"""The scan in the keys of joins and groups: repositories share paths, rules and candidate names."""

from __future__ import annotations

from pyspark.sql import DataFrame


def scan_keys(*tables: DataFrame) -> list[str]:
    """``["scan_id"]`` where every table carries its scan, ``[]`` where none does (all rows are one scan).

    A mix is an error: rows without a scan would match those of every scan.
    """
    has = ["scan_id" in t.columns for t in tables]
    if any(has) and not all(has):
        raise ValueError("scan_id is in some of the tables only: " + "; ".join(", ".join(t.columns) for t, h in zip(tables, has) if not h))
    return ["scan_id"] if all(has) else []


def job_keys(*tables: DataFrame) -> list[str]:
    """The same for review jobs: ``["job_id"]`` where every table has it, ``[]`` where none does."""
    has = ["job_id" in t.columns for t in tables]
    if any(has) and not all(has):
        raise ValueError("job_id is in some of the tables only")
    return ["job_id"] if all(has) else []
